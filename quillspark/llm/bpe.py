"""Byte-level BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent words (pre-tokens) are counted over all documents and the ``lexicon_size`` most frequent ones are
encoded once and compiled into a minimal acyclic automaton: equal suffixes share states, each
arc adds a number, and the sum along a word is its place in the table of id sequences.  The
arrays travel as one broadcast of bounded size (``lexicon_size`` words of up to ``MAX_WORD`` bytes), each
task memory-maps them and walks all distinct words of a block at once.  Words that
the lexicon does not hold are merged exactly: lowest rank first, leftmost of equals.

Texts are cut into units at single spaces first.  A space right after a character that is no whitespace starts a
pre-token, so the pre-token pattern runs once per distinct unit of a block.  Texts with a space after any whitespace (a run
of mixed whitespace is one pre-token) or with a special token are cut by the pattern itself.

Counting cuts every text at its single spaces; the words of a unit that some block holds ``BLOCK_COUNT`` times are lexicon
candidates, and their counts add up over those units and blocks.  The lexicon decides speed only, never an id.  Defined cases: null and empty texts have no ids; null
ids and repeated rows give one row each; an empty table gives none (its lexicon is empty); extra columns are not read.
Vocabularies are files of the tokenizers library with a byte-level BPE model, at a path that every executor can open.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark._ship import ship_package
from quillspark.llm._blocks import text_runs
from quillspark.llm.elias_fano import MappedArrays

#: Pre-token pattern of byte-level BPE (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space after whitespace: the characters of the pattern's ``\s``, spelled out for RE2, whose own ``\s`` is ASCII.
SPACE_RUN = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "
LEXICON_SIZE = 50_000
BLOCK_COUNT = 8
MAX_WORD = 64
LONG_WORD = 2048               # bytes from which a word is merged by a heap on its own
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
_NONE = np.iinfo(np.int32).max


def default_vocabulary() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Byte ids, merges by pair, and the bytes of every id."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        ids = spec["model"]["vocab"]
        self.pattern = regex.compile(PATTERN)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        tokens = [b""] * self.size
        for token, i in ids.items():
            tokens[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_start = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.byte_id = np.array([ids[c] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank = key[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.special_pattern = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") \
            if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], _NONE).astype(np.int32)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


# --- exact merging ---------------------------------------------------------------------------

def merge_one(v: Vocabulary, word: bytes) -> list[int]:
    """BPE of one long word with a heap of pairs, O(n log n)."""
    sym = [int(x) for x in v.byte_id[np.frombuffer(word, np.uint8)]]
    n = len(sym)
    nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))
    a = np.array(sym, np.int64)
    heap = [(int(r), i, sym[i], sym[i + 1]) for i, r in enumerate(v.ranks(a[:-1], a[1:])) if r != _NONE]
    heapq.heapify(heap)
    dead = bytearray(n)

    def push(i):
        j = nxt[i]
        if j >= 0:
            r = int(v.ranks(np.array([sym[i]], np.int64), np.array([sym[j]], np.int64))[0])
            if r != _NONE:
                heapq.heappush(heap, (r, i, sym[i], sym[j]))
    while heap:
        r, i, left, right = heapq.heappop(heap)
        j = nxt[i]
        if dead[i] or j < 0 or sym[i] != left or sym[j] != right:
            continue
        sym[i] = int(v.merged[r])
        dead[j] = 1
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prv[nxt[j]] = i
        if prv[i] >= 0:
            push(prv[i])
        push(i)
    return [s for s, d in zip(sym, dead, strict=True) if not d]


def merge_words(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, start offsets) of every word; all words merge side by side, one pair kind per word and step."""
    long = {i: merge_one(v, w) for i, w in enumerate(words) if len(w) > LONG_WORD}
    lens = np.array([0 if i in long else len(w) for i, w in enumerate(words)], np.int64)
    sym = v.byte_id[np.frombuffer(b"".join(w for i, w in enumerate(words) if i not in long), np.uint8)]
    word = np.repeat(np.arange(len(words)), lens)
    done = [(np.full(len(x), i), np.arange(len(x)), np.array(x, np.int64)) for i, x in long.items()]
    rank = np.full(len(sym), _NONE, np.int32)
    if len(sym) > 1:
        rank[:-1] = np.where(word[:-1] == word[1:], v.ranks(sym[:-1], sym[1:]), _NONE)
    while len(sym):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        per = np.diff(np.concatenate([first, [len(sym)]]))
        least = np.minimum.reduceat(rank, first)
        over = least == _NONE
        if over.any():
            out = np.repeat(over, per)
            done.append((word[out], (np.arange(len(sym)) - np.repeat(first, per))[out], sym[out]))
            least, per, sym, word, rank = least[~over], per[~over], sym[~out], word[~out], rank[~out]
            if not len(sym):
                break
        hit = rank == np.repeat(least, per)
        # of overlapping equal pairs (aaa) every second one merges, from the left
        run_start = hit & ~np.concatenate([[False], hit[:-1]])
        at = np.arange(len(sym))
        hit &= ((at - np.maximum.accumulate(np.where(run_start, at, 0))) & 1) == 0
        i = np.flatnonzero(hit)
        sym[i] = v.merged[rank[i]]
        keep = np.ones(len(sym), bool)
        keep[i + 1] = False
        new_at = np.cumsum(keep) - 1
        sym, word, rank = sym[keep], word[keep], rank[keep]
        i = new_at[i]
        near = np.zeros(len(sym), bool)
        near[i] = near[np.maximum(i - 1, 0)] = True
        touched = np.flatnonzero(near)
        right = np.minimum(touched + 1, len(sym) - 1)
        same = (word[touched] == word[right]) & (right > touched)
        rank[touched] = np.where(same, v.ranks(sym[touched], sym[right]), _NONE)
    if not done:
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    w, pos, ids = (np.concatenate([d[k] for d in done]) for k in range(3))
    order = np.lexsort((pos, w))
    return ids[order], np.concatenate([[0], np.cumsum(np.bincount(w, minlength=len(words)))])


# --- the lexicon -----------------------------------------------------------------------------

def compile_lexicon(v: Vocabulary, words: list[bytes]) -> dict[str, np.ndarray]:
    """Arrays of the minimal acyclic transducer over ``words`` and of the id sequences it leads to.

    Words are added in order; a state is frozen as soon as no later word can reach it, and a frozen state with the
    same arcs and finality as an earlier one is that earlier one.
    """
    words = sorted(set(words))
    frozen: dict[tuple, int] = {}
    arcs: list[list[tuple[int, int, int]]] = []            # of a state: (byte, words before, target)
    finals, counts = [], []

    def freeze(children: list, final: bool) -> int:
        key = (final, tuple(children))
        if key not in frozen:
            before, own = int(final), []
            for byte, target in children:
                own.append((byte, before, target))
                before += counts[target]
            frozen[key] = len(arcs)
            arcs.append(own), finals.append(final), counts.append(before)
        return frozen[key]

    path: list[list] = [[[], False]]                          # open states along the last word
    last = b""
    for w in [*words, None]:
        common = 0
        if w is not None:
            while common < min(len(w), len(last)) and w[common] == last[common]:
                common += 1
        while len(path) - 1 > common:
            children, final = path.pop()
            path[-1][0].append((last[len(path) - 1], freeze(children, final)))
        if w is not None:
            path += [[[], False] for _ in w[common:]]
            path[-1][1] = True
            last = w
    root = freeze(*path[0])
    flat = [(s * 256 + byte, before, target) for s, own in enumerate(arcs) for byte, before, target in own]
    ids, start = merge_words(v, words)
    key, before, target = (np.array([f[k] for f in flat], np.int64) for k in range(3))
    return {"key": key, "before": before, "target": target.astype(np.int32), "final": np.array(finals, np.uint8),
            "root": np.array([root], np.int64), "ids": ids.astype(np.uint32), "start": start}


class Lexicon:
    """The transducer over memory-mapped arrays."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays

    def find(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the id table, -1 if the lexicon lacks it."""
        a = self.a
        out = np.full(len(words), -1, np.int64)
        if not len(a["key"]) or not words:
            return out
        lens = np.array([len(w) for w in words], np.int64)
        start = np.concatenate([[0], np.cumsum(lens)])
        text = np.frombuffer(b"".join(words), np.uint8)
        live = np.flatnonzero((lens > 0) & (lens <= MAX_WORD))
        state = np.full(len(live), a["root"][0], np.int64)
        number = np.zeros(len(live), np.int64)
        depth = 0
        while len(live):
            key = state * 256 + text[start[live] + depth]
            at = np.minimum(np.searchsorted(a["key"], key), len(a["key"]) - 1)
            ok = a["key"][at] == key
            live, at, number = live[ok], at[ok], number[ok]
            state = a["target"][at].astype(np.int64)
            number = number + a["before"][at]
            depth += 1
            end = lens[live] == depth
            got = end & (a["final"][state] > 0)
            out[live[got]] = number[got]
            live, state, number = live[~end], state[~end], number[~end]
        return out


# --- texts -----------------------------------------------------------------------------------

TAKE_PLACES = 1 << 18          # entries of a ragged array taken at a time; one longer list is taken at once


def list_runs(ends: np.ndarray, limit: int) -> list[int]:
    """Cuts of lists (``ends``: 0, then the end of each) into runs of about ``limit`` entries, one list at least."""
    at = np.searchsorted(ends, np.arange(0, ends[-1], limit), side="left")
    return np.unique(np.concatenate([[0], at, [len(ends) - 1]])).tolist()


def ragged_take(flat: np.ndarray, start: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``order`` of a ragged array, one after the other, and their start offsets."""
    lens = (start[1:] - start[:-1])[order]
    out = np.concatenate([[0], np.cumsum(lens)])
    taken = np.empty(out[-1], flat.dtype)
    # places are spelled out for some lists at a time: eight bytes each, of a byte table eight times the result
    cut = list_runs(out, TAKE_PLACES)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        lo, hi = out[a], out[b]
        taken[lo:hi] = flat[np.repeat(start[:-1][order[a:b]] - out[a:b], lens[a:b]) + np.arange(lo, hi)]
    return taken, out


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts cut at single spaces: distinct pieces, code of each piece in turn (2 * place, + 1 after a space), pieces per text."""
    lists = pc.split_pattern(texts, " ")
    per = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    code = pc.list_flatten(lists).dictionary_encode()
    after_space = np.ones(len(code), np.int64)
    after_space[np.cumsum(per) - per] = 0
    return code.dictionary, code.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + after_space, per


def _unit_words(v: Vocabulary, pieces: pa.Array, unit: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of units (codes of ``_pieces``) one after the other, and how many each has; ASCII letters are one word."""
    strings = pieces.take(pa.array(unit >> 1))
    after = pa.array((unit & 1).astype(bool))
    strings = pc.if_else(after, pc.binary_join_element_wise(" ", strings, ""), strings)
    lens = np.ones(len(unit), np.int64)
    mixed = np.flatnonzero(~pc.match_substring_regex(strings, "^ ?[A-Za-z]+$").to_numpy(zero_copy_only=False))
    if not len(mixed):
        return strings, lens
    found = [v.pattern.findall(s) for s in strings.take(pa.array(mixed)).to_pylist()]
    lens[mixed] = [len(f) for f in found]
    flat = pa.concat_arrays([strings, pa.array([w for f in found for w in f], pa.string())])
    start = np.arange(len(unit))
    start[mixed] = len(unit) + np.cumsum(lens[mixed]) - lens[mixed]
    at = np.cumsum(lens) - lens
    return flat.take(pa.array(np.repeat(start - at, lens) + np.arange(lens.sum()))), lens


class Units:
    """Texts as sequences of distinct units, units as sequences of distinct words."""

    def __init__(self, v: Vocabulary, texts: pa.Array):
        odd = pc.match_substring_regex(texts, SPACE_RUN)
        for s in v.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~odd)
        pieces, code, per = _pieces(texts.take(pa.array(plain)))
        held = np.bincount(code, minlength=2 * len(pieces)) > 0
        words, unit_lens = _unit_words(v, pieces, np.flatnonzero(held))
        seqs, lens, rows = [(np.cumsum(held) - 1)[code]], [per], [plain]
        extra: list = []
        for i in np.flatnonzero(odd).tolist():
            units = self._cut(v, texts[i].as_py())
            seqs.append(np.arange(len(units)) + len(unit_lens) + len(extra))
            extra += units
            lens.append(np.array([len(units)])), rows.append(np.array([i]))
        seq, lens, rows = np.concatenate(seqs), np.concatenate(lens), np.concatenate(rows)
        back = np.argsort(rows, kind="stable")
        self.seq, self.row_start = ragged_take(seq, np.concatenate([[0], np.cumsum(lens)]), back)
        special = [k for k, w in enumerate(extra) if isinstance(w, int)]
        words = pa.concat_arrays([words, pa.array(["" if isinstance(w, int) else w for w in extra], pa.string())]) \
            .dictionary_encode()
        self.word_start = np.concatenate([[0], np.cumsum(unit_lens), unit_lens.sum() + 1 + np.arange(len(extra))])
        self.word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = words.dictionary.cast(pa.binary()).to_pylist()
        # special tokens follow the words
        self.special = [extra[k] for k in special]
        self.word[int(unit_lens.sum()) + np.array(special, np.int64)] = len(self.words) + np.arange(len(special))

    @staticmethod
    def _cut(v: Vocabulary, text: str) -> list:
        """Words of a text, special tokens as their ids."""
        parts = v.special_pattern.split(text) if v.special_pattern else [text]
        out: list = []
        for p in parts:
            out += [v.special[p]] if p in v.special else v.pattern.findall(p)
        return out


def encode_texts(v: Vocabulary, lexicon: Lexicon, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, start offsets)."""
    u = Units(v, texts)
    place = lexicon.find(u.words)
    unseen = np.flatnonzero(place < 0)
    ids, start = merge_words(v, [u.words[i] for i in unseen.tolist()])
    # one id table: the lexicon's, then the merged words', then special ids
    base = len(lexicon.a["start"]) - 1
    table = np.concatenate([lexicon.a["ids"].astype(np.int64), ids, np.array(u.special, np.int64)])
    starts = np.concatenate([lexicon.a["start"], lexicon.a["start"][-1] + start[1:]])
    starts = np.concatenate([starts, starts[-1] + 1 + np.arange(len(u.special))])
    place[unseen] = base + np.arange(len(unseen))
    place = np.concatenate([place, base + len(unseen) + np.arange(len(u.special))])
    unit_ids, in_unit = ragged_take(table, starts, place[u.word])
    unit_start = in_unit[u.word_start]
    out, out_start = ragged_take(unit_ids, unit_start, u.seq)
    return out, out_start[u.row_start]


def decode_ids(v: Vocabulary, ids: np.ndarray, start: np.ndarray) -> list[str]:
    """The text of each run of ids (bytes that are no UTF-8 become U+FFFD)."""
    flat, at = ragged_take(v.token_bytes, v.token_start, ids)
    raw, cut = memoryview(flat), at[start].tolist()
    return [str(raw[a:b], "utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]


RUN_BYTES = 6 << 20            # text bytes encoded at a time
OUT_IDS = 1 << 18              # ids decoded at a time; a longer document goes alone


def _texts(run: pa.Table) -> pa.Array:
    return pc.fill_null(run.combine_chunks().column(1).chunk(0), "")


def _count(batches, path: str):
    v = vocabulary(path)
    for run in text_runs(batches, RUN_BYTES):
        pieces, code, _ = _pieces(_texts(run))
        n = np.bincount(code, minlength=2 * len(pieces))
        often = np.flatnonzero(n >= BLOCK_COUNT)
        words, lens = _unit_words(v, pieces, often)
        rows = pa.table({"word": words, "n": np.repeat(n[often], lens)}).filter(pc.less_equal(pc.binary_length(words), MAX_WORD))
        yield from rows.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks().to_batches()


def _encode(batches, path: str, lexicon):
    v = vocabulary(path)
    with MappedArrays(lexicon.value) as arrays:
        lex = Lexicon(arrays)
        for run in text_runs(batches, RUN_BYTES):
            ids, start = encode_texts(v, lex, _texts(run))
            rows = run.combine_chunks().column(0).chunk(0)
            # ids leave and are decoded some documents at a time
            cut = list_runs(start, OUT_IDS)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                own = ids[start[a]:start[b]].astype("<u4")
                at = start[a:b + 1] - start[a]
                yield pa.RecordBatch.from_arrays([
                    rows.slice(a, b - a), pa.array(np.diff(at)),
                    pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(4 * at), pa.py_buffer(own)])
                    .cast(pa.binary()),
                    pa.array(decode_ids(v, own.astype(np.int64), at), pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])
            del ids, start, rows, run
            pa.default_memory_pool().release_unused()


def frequent_words(docs: DataFrame, text_col: str, path: str, size: int) -> list[bytes]:
    """The ``size`` most frequent candidate words of all documents (a bounded list)."""
    rows = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = rows.mapInArrow(lambda it: _count(it, path), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word.encode() for r in n.orderBy(F.desc("n"), "word").limit(size).collect()]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                  lexicon_size: int = LEXICON_SIZE) -> DataFrame:
    """(doc_id, n_tokens, ids as little-endian 32-bit integers, decoded text) of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    path = path or default_vocabulary()
    words = frequent_words(docs, text_col, path, lexicon_size)
    lexicon = spark.sparkContext.broadcast(compile_lexicon(vocabulary(path), words))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _encode(it, path, lexicon), SCHEMA)


