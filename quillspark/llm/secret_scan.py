"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

Text that a BPE vocabulary knows costs few tokens; random keys cost many.  Every maximal
run of 20 or more characters ``[A-Za-z0-9+/_=-]`` that has letters and digits is
tokenised with a tiktoken vocabulary, and one with under 2 characters a token is reported as
kind ``random``.  Known digests (hexadecimal of a digest's length) and identifiers (UUIDs,
names joined by ``_``, ``-`` or ``/`` whose longest piece is an ordinary word or a number) are
left out first, as are runs that a fixed pattern already covers.

Fixed patterns (kinds ``assign``, ``access``, ``hex``) are matched leftmost and non-overlapping per kind, and
matches under their least length are dropped.  Offsets are code points, ends exclusive; the span of ``assign`` is
its whole match.

Defined cases: null and empty texts have no span; null ids and repeated rows are
passed through, one result row each; an empty table gives none; extra columns are not read.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark._ship import ship_package
from quillspark.llm._blocks import text_runs

KINDS = ("assign", "access", "hex", "random")
MAX_RATIO = 2.0
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")     # the runs of _HEX that are long enough
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: One cheap pass tells which texts can have a span at all.
_ANY = (r"(?i:(password|passwd|secret|token|api_?key)[\"']? *[:=])|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
        r"|[A-Za-z0-9+/_=-]{20}")
_DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_PIECES = re.compile(r"[+/_=-]+")
_CAMEL = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}")
SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_encodings: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _encoding(path: str):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                             special_tokens={})
    return _encodings[path]


def known(run: str) -> bool:
    """Whether a run is a digest or an identifier rather than a possible key."""
    if re.fullmatch(r"[0-9A-Fa-f]+", run) and len(run) in _DIGEST_LENGTHS or _UUID.fullmatch(run):
        return True
    pieces = [p for p in _PIECES.split(run) if p]
    named = sum(len(m) for p in pieces for m in _CAMEL.findall(p)) + sum(len(p) for p in pieces if p.isdigit())
    return named >= 0.8 * sum(map(len, pieces))


def random_spans(text: str, taken: list, encoding, max_ratio: float) -> list[tuple[str, int, int]]:
    out = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        run = m[0]
        if not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)) or known(run):
            continue
        if any(x < b and a < y for _, x, y in taken):
            continue
        if len(run) < max_ratio * len(encoding.encode_ordinary(run)):
            out.append(("random", a, b))
    return out


def text_spans(text: str, encoding, max_ratio: float = MAX_RATIO) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind as listed."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    out += random_spans(text, out, encoding, max_ratio)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _scan(batches, path: str, max_ratio: float):
    encoding = _encoding(path)
    for run in text_runs(batches):
        run = run.combine_chunks()
        texts = pc.fill_null(run.column(1).chunk(0), "")
        hit = pc.match_substring_regex(texts, _ANY).to_pylist()
        spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in text_spans(t.as_py(), encoding, max_ratio)]
                 if h else [] for h, t in zip(hit, texts, strict=True)]
        yield pa.RecordBatch.from_arrays([run.column(0).chunk(0), pa.array(spans, pa.list_(_SPAN))],
                                         names=["doc_id", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                 max_ratio: float = MAX_RATIO) -> DataFrame:
    """(doc_id, spans) of every row of ``docs``."""
    ship_package(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _scan(it, path, max_ratio), SCHEMA)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", vocabulary: str | None = None,
           max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs`` with every span's text replaced by ``mark``; columns and other rows as they were."""
    ship_package(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    at = docs.columns.index(text_col)

    def clean(batches):
        encoding = _encoding(path)
        for batch in (b for part in text_runs(batches, at=at) for b in part.combine_chunks().to_batches()):
            texts = batch.column(at)
            hit = pc.fill_null(pc.match_substring_regex(texts, _ANY), False).to_pylist()
            if any(hit):
                out = [_masked(t.as_py(), encoding, max_ratio, mark) if h else t.as_py()
                       for h, t in zip(hit, texts, strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            yield batch
    return docs.mapInArrow(clean, docs.schema)


def _masked(text: str, encoding, max_ratio: float, mark: str) -> str:
    out, at = [], 0
    for _, a, b in text_spans(text, encoding, max_ratio):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
