"""Column builders for the text rules.

Every builder maps a string Column to a Column and contains no Python UDF, so
it runs inside whole-stage codegen (or inside a higher-order-function lambda,
where the sections pipeline uses them to stay within one row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and build an expression of it (a one-element ``transform``).

    An expression that uses a costly value several times would otherwise repeat
    it wherever Catalyst inlines it (predicate push-down copies aliases into the
    filter; a lambda gets no common-subexpression elimination).
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def rx_sub(c: Column, rx: P.Rx, repl: str = "") -> Column:
    """``re.sub`` equivalent; ``repl`` is literal text (no group references)."""
    return F.regexp_replace(c, rx.java, repl.replace("\\", "\\\\").replace("$", "\\$"))


def rx_sub_if(c: Column, needles, rx: P.Rx, repl: str = "") -> Column:
    """``rx_sub`` run only when the text holds one of ``needles``.

    Each needle is a literal the pattern cannot match without, so the result is
    the same; the byte search skips the String round trip a regex pass costs.
    """
    def guarded(x):
        cond = None
        for n in needles:
            cond = x.contains(n) if cond is None else cond | x.contains(n)
        return F.when(cond, closed_sub(x, rx, repl) if rx.body.endswith(">") else rx_sub(x, rx, repl)).otherwise(x)
    return let(c, guarded)


def before_last(x: Column, mark: str) -> tuple[Column, Column]:
    """The text up to its last ``mark``, that included, and the rest."""
    rest = F.substring_index(x, mark, -1)
    return F.left(x, F.length(x) - F.length(rest)), rest


def closed_sub(x: Column, rx: P.Rx, repl: str = "") -> Column:
    """``rx_sub`` for a pattern that ends in ``>``: nothing behind the last one is searched, so that markup which is never
    closed is not searched to the end from every ``<``."""
    head, rest = before_last(x, ">")
    return F.concat(rx_sub(head, rx, repl), rest)


def strip(c: Column) -> Column:
    """``str.strip()``: trim every character ``str.isspace`` accepts (plain ``trim`` takes spaces only)."""
    return F.trim(c, F.lit(P.WHITESPACE_CHARS))


def is_upper(c: Column) -> Column:
    """``str.isupper()``: at least one upper-case letter and no lower/title-case one."""
    return c.rlike(P.ALL_UPPER.java)


def squeeze_newlines_and_spaces(c: Column) -> Column:
    c = rx_sub_if(c, ["\n"], P.THREE_NEWLINES, "\n\n")
    # a lone space maps to itself: only runs of two or a tab change anything
    return rx_sub_if(c, ["  ", "\t"], P.SPACE_RUN, " ")


def zero_fill(c: Column) -> Column:
    """P1 on any integral/string column: ``str(x).zfill(10)`` (never truncates)."""
    s = c.cast("string")
    return F.when(F.length(s) >= 10, s).otherwise(F.lpad(s, 10, "0"))


# ---------------------------------------------------------------------------
# T9 SGML clean
# ---------------------------------------------------------------------------
def clean_sgml_text(c: Column) -> Column:
    c = rx_sub_if(c, ["<"], P.ANY_TAG)
    c = squeeze_newlines_and_spaces(c)
    c = rx_sub(c, P.SYMBOL_LINE)
    c = rx_sub_if(c, ["\n"], P.TWO_NEWLINES, "\n\n")
    return strip(c)


# ---------------------------------------------------------------------------
# T10 iXBRL clean
# ---------------------------------------------------------------------------
def clean_ixbrl_text(c: Column) -> Column:
    c = rx_sub_if(c, ["<ix:"], P.IX_OPEN)
    c = rx_sub_if(c, ["</ix:"], P.IX_CLOSE)
    c = rx_sub_if(c, ["<style"], P.STYLE_BLOCK)
    c = rx_sub_if(c, ['style="'], P.STYLE_ATTR)
    c = rx_sub_if(c, ["<br"], P.BR_TAG, "\n")
    c = rx_sub_if(c, ["<p"], P.P_OPEN, "\n\n")
    c = rx_sub_if(c, ["</p>"], P.P_CLOSE)
    c = rx_sub_if(c, ["<div"], P.DIV_OPEN, "\n")
    c = rx_sub_if(c, ["</div>"], P.DIV_CLOSE)
    c = rx_sub_if(c, ["<"], P.ANY_TAG)
    c = squeeze_newlines_and_spaces(c)
    c = rx_sub(c, P.SYMBOL_LINE)
    return strip(c)


# ---------------------------------------------------------------------------
# T11 section clean
# ---------------------------------------------------------------------------
def _dropped_line(line: Column) -> Column:
    cond = F.lit(False)
    for prefix in P.DROPPED_LINE_PREFIXES:
        cond = cond | line.startswith(prefix)
    return cond | line.rlike(P.TECHNICAL_LINE.java)


def clean_section_text(c: Column, compat: bool = True) -> Column:
    """T11.  ``compat=False`` uses script patterns that cannot run into prose."""
    c = rx_sub_if(c, ['style="'], P.STYLE_ATTR)
    c = rx_sub_if(c, ['class="'], P.CLASS_ATTR)
    c = rx_sub_if(c, ['id="'], P.ID_ATTR)
    c = rx_sub_if(c, ["<"], P.BR_TAG_I, "\n")
    c = rx_sub_if(c, ["<"], P.P_TAG_I, "\n")
    c = rx_sub_if(c, ["<"], P.DIV_TAG_I, "\n")
    c = rx_sub_if(c, ["<"], P.SPAN_TAG_I)
    c = rx_sub_if(c, ["<"], P.SCRIPT_BLOCK_I)
    c = rx_sub_if(c, ["var"], P.JS_VAR if compat else P.JS_VAR_SAFE)
    c = rx_sub_if(c, ["function"], P.JS_FUNCTION if compat else P.JS_FUNCTION_SAFE)
    c = rx_sub_if(c, ["<!--"], P.COMMENT)
    c = rx_sub_if(c, ["<"], P.ANY_TAG)
    c = rx_sub_if(c, ["\n"], P.THREE_NEWLINES, "\n\n")
    # a lone space maps to itself: only runs of two or a tab change anything
    c = rx_sub_if(c, ["  ", "\t"], P.SPACE_RUN, " ")
    c = rx_sub_if(c, ["\n "], P.NEWLINE_SPACE, "\n")
    lines = F.transform(F.split(c, "\n", -1), strip)
    kept = F.filter(lines, lambda x: (x == F.lit("")) | ~_dropped_line(x))
    return strip(F.array_join(kept, "\n"))


# ---------------------------------------------------------------------------
# T12 / T13 HTML to text
# ---------------------------------------------------------------------------
#: A character reference: numeric, or a name with or without its semicolon.
_REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


_BUCKETS = 1024


def _named_references() -> list[str]:
    """Names of HTML 5 (the standard library's table) and their characters, dealt to buckets by the name's checksum."""
    import zlib
    from html.entities import html5
    buckets = [["\x01"] for _ in range(_BUCKETS)]
    for name in sorted(html5):
        buckets[zlib.crc32(name.encode()) % _BUCKETS].append(f"{name}\x02{html5[name]}\x01")
    return ["".join(b) for b in buckets]


def _open_names() -> str:
    """Pattern of the names that HTML 5 knows without a semicolon, longer ones first."""
    from html.entities import html5
    return "^(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"


def _numeric_reference(ref: Column) -> Column:
    """Character of ``#...`` as HTML 5 reads it: windows-1252 for 128-159, U+FFFD for what is no character."""
    digits = F.regexp_extract(ref, "([0-9a-fA-F]+);?$", 1)
    number = F.when(F.lower(F.substring(ref, 1, 2)) == "#x", F.conv(digits, 16, 10)).otherwise(digits)
    code = F.when(F.length(F.ltrim(number, F.lit("0"))) > 9, F.lit(0x110000)).otherwise(number.cast("long"))
    legacy = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))
    hexa = F.lpad(F.hex(code), 8, "0")
    char = F.decode(F.unhex(hexa), "UTF-32")
    dropped = ((code >= 1) & (code <= 8)) | ((code >= 0xE) & (code <= 0x1F)) | (code == 0xB) | (code == 0x7F) \
        | ((code >= 0xFDD0) & (code <= 0xFDEF)) | (F.pmod(code, F.lit(0x10000)) >= 0xFFFE)
    return F.when((code == 0) | ((code >= 0xD800) & (code <= 0xDFFF)) | (code > 0x10FFFF), "\ufffd") \
        .when((code >= 0x80) & (code <= 0x9F), F.substring(F.lit(legacy), (code - 0x7F).cast("int"), F.lit(1))) \
        .when(code == 0xD, "\r").when(dropped, "").otherwise(char)


def _decode_reference(whole: Column, buckets: Column) -> Column:
    """One reference (with its ``&``); an unknown name is tried by its longest known beginning, then left alone."""
    ref = F.substring(whole, F.lit(2), F.length(whole))

    def characters(name):
        bucket = F.get(buckets, F.pmod(F.crc32(name.cast("binary")), F.lit(_BUCKETS)).cast("int"))
        return let(bucket, lambda b: let(F.instr(b, F.concat(F.lit("\x01"), name, F.lit("\x02"))), lambda at: F.when(
            at > 0, F.substring_index(F.substring(b, at + F.length(name) + 2, F.length(b)), "\x01", 1))))

    def named(r):
        # the whole name or its longest beginning, as in the standard: only names that need no semicolon begin others
        begun = F.regexp_extract(r, _open_names(), 0)
        return let(characters(r), lambda c: F.when(c.isNotNull(), c).otherwise(let(begun, lambda b: F.when(
            b == "", F.concat(F.lit("&"), r)).otherwise(F.concat(characters(b), F.substring(r, F.length(b) + 1, F.length(r)))))))
    return let(ref, lambda r: F.when(F.startswith(r, F.lit("#")), _numeric_reference(r)).otherwise(named(r)))


def decode_entities(c: Column) -> Column:
    """All character references of HTML 5, each once (``html.unescape``)."""
    buckets = F.split(F.lit("\x03".join(_named_references())), "\x03")       # folded to a constant

    def decoded(x):
        refs = F.transform(F.regexp_extract_all(x, F.lit(_REFERENCE), 0), lambda r: _decode_reference(r, buckets))
        parts = F.split(x, _REFERENCE, -1)
        return let(F.struct(refs.alias("refs"), parts.alias("parts")), lambda b: F.array_join(F.zip_with(F.concat(
            F.array(F.lit("")), b["refs"]), b["parts"], lambda r, p: F.concat(r, p)), ""))
    return let(c, lambda x: F.when(x.contains("&"), decoded(x)).otherwise(x))


def strip_markup(c: Column) -> Column:
    """Drop script/style elements, comments, declarations and tags; keep text nodes.

    One leftmost-first pass, so markup is consumed in document order the way a
    tokenizer meets it (a tag running into a later declaration stays one tag).
    """
    def stripped(x):
        closed = ~F.substring_index(x, ">", -1).contains("<")
        return F.when(closed, F.regexp_replace(x, P.HTML_MARKUP_JAVA, "")).otherwise(
            F.array_join(let(markup_split(x), lambda b: b["texts"]), ""))
    return let(c, lambda x: F.when(x.contains("<"), stripped(x)).otherwise(x))


def markup_split(x: Column) -> Column:
    """struct<tags, names, texts>: the markup of a page in order, the names of its tags (with ``/`` before that of an end tag; ''
    for other markup), and the texts before, between and behind it.

    No tag starts behind the last ``>``, so only the text up to there is searched for tags; the rest is text, unless an
    element or comment that is never closed holds it.
    """
    def whole(b):
        last = F.coalesce(F.try_element_at(b["tags"], F.lit(-1)), F.lit(""))
        held = (last.rlike(r"(?i)^<(?:script|style)\b") & ~last.rlike(r"(?i)</(?:script|style)[^<>]*>$")) \
            | (F.startswith(last, F.lit("<!--")) & ~F.endswith(last, F.lit("-->")))
        rest = F.when(held, F.lit("")).otherwise(F.substring_index(b["rest"], "<!--", 1))
        n = F.size(b["texts"])
        return F.struct(b["tags"].alias("tags"), b["names"].alias("names"), F.concat(F.slice(b["texts"], F.lit(1), n - 1), F.array(
            F.concat(F.element_at(b["texts"], n), rest))).alias("texts"))

    head, rest = before_last(x, ">")
    return let(F.struct(head.alias("head"), rest.alias("rest")), lambda h: let(F.struct(
        F.regexp_extract_all(h["head"], F.lit(P.HTML_MARKUP_JAVA), 0).alias("tags"),
        F.regexp_extract_all(h["head"], F.lit(P.HTML_MARKUP_JAVA), 1).alias("names"),
        F.split(h["head"], P.HTML_MARKUP_JAVA, -1).alias("texts"), h["rest"].alias("rest")), whole))


def paired(tags: Column) -> Column:
    """array<struct<open, close>> in the order of ``open``: which tags of one element belong together.

    ``tags`` is an array of structs with ``k`` (a tag's place) and ``closing``, in order.  The depth of a tag follows from its
    place and its rank among the open or the close tags alone; sorted by depth and place, an open tag's own close tag comes next.
    ``close`` is null for an element that is never closed.
    """
    def by_level(ts):
        placed = F.transform(ts, lambda x, j: F.struct(x["k"].alias("k"), x["closing"].alias("closing"), j.alias("j")))
        return let(placed, lambda p: F.array_sort(F.concat(
            F.transform(F.filter(p, lambda x: ~x["closing"]), lambda x, r: F.struct(
                (2 * r + 1 - x["j"]).alias("level"), x["k"].alias("k"), F.lit(True).alias("open"))),
            F.transform(F.filter(p, lambda x: x["closing"]), lambda x, r: F.struct(
                (x["j"] - 2 * r).alias("level"), x["k"].alias("k"), F.lit(False).alias("open"))))))

    def partners(es):
        return F.array_sort(F.transform(F.filter(F.transform(es, lambda e, i: let(F.get(es, i + 1), lambda n: F.struct(
            e["open"].alias("open"), e["k"].alias("k"),
            F.when((n["level"] == e["level"]) & ~n["open"], n["k"]).alias("close")))), lambda e: e["open"]),
            lambda e: F.struct(e["k"].alias("open"), e["close"].alias("close"))))
    return let(let(tags, by_level), partners)


def raw_attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute as written; the last one of equal names, '' without a value, null if it has none."""
    names = F.regexp_extract_all(tag, F.lit(P.ATTRIBUTE_JAVA), 1)
    values = F.regexp_extract_all(tag, F.lit(P.ATTRIBUTE_JAVA), 2)
    own = F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda a: F.lower(a["n"]) == name)
    return F.regexp_replace(F.try_element_at(own, F.lit(-1))["v"], "(?s)^([\"'])(.*)\\1$", "$2")


def text_lines(c: Column) -> Column:
    """Split into lines and double-space phrases, strip, drop empties, join with newline."""
    parts = F.transform(F.split(c, P.LINE_OR_PHRASE_BREAK.java, -1), strip)
    return F.array_join(F.filter(parts, lambda x: x != F.lit("")), "\n")


def html_to_text(c: Column) -> Column:
    """Markup out, references decoded, lines and phrases."""
    return text_lines(decode_entities(strip_markup(c)))


def html_to_text_strict(c: Column) -> Column:
    """Tags dropped, whitespace squeezed, characters outside a whitelist dropped."""
    c = rx_sub(c, P.ANY_TAG)
    c = rx_sub(c, P.WS_RUN, " ")
    return rx_sub(c, P.NOT_WHITELISTED)


# ---------------------------------------------------------------------------
# T15 regex HTML clean
# ---------------------------------------------------------------------------
def clean_html_regex(c: Column) -> Column:
    c = rx_sub_if(c, ["<ix:"], P.IX_OPEN)
    c = rx_sub_if(c, ["</ix:"], P.IX_CLOSE)
    c = rx_sub_if(c, ["xmlns:"], P.XMLNS_ATTR)
    c = rx_sub_if(c, ['style="'], P.STYLE_ATTR)
    c = rx_sub_if(c, ['class="'], P.CLASS_ATTR)
    c = rx_sub_if(c, ['id="'], P.ID_ATTR)
    c = rx_sub_if(c, ["<"], P.SCRIPT_BLOCK_I)
    c = rx_sub_if(c, ["<!--"], P.COMMENT)
    c = squeeze_newlines_and_spaces(c)
    return strip(c)


# ---------------------------------------------------------------------------
# T16 chapter titles
# ---------------------------------------------------------------------------
def is_chapter_title(line: Column) -> Column:
    return line.rlike(P.CHAPTER_TITLE_JAVA) | line.isin(P.LISTED_TITLES)


def title_kind(line: Column) -> Column:
    return (F.when(line.rlike(P.PART_OR_ITEM.java) & line.rlike("(?iu)^Part"), "part")
            .when(line.rlike(P.PART_OR_ITEM.java) | line.rlike(P.ITEM_TITLE.java), "item")
            .when(line.isin(P.LISTED_TITLES), "listed")
            .when(line.rlike(P.TWO_CAPITALISED.java), "capitalised"))


def title_number(line: Column, kind: Column) -> Column:
    """The part (roman) or item (``7A``) number of a title line, else NULL."""
    return (F.when(kind == "part", F.regexp_extract(line, P.PART_NUMBER.java, 1))
            .when(kind == "item", F.regexp_extract(line, P.ITEM_NUMBER.java, 1)))


def stripped_lines(c: Column) -> Column:
    return F.transform(F.split(c, "\n", -1), strip)


def mark_titles(c: Column) -> Column:
    lines = stripped_lines(c)
    marked = F.transform(lines, lambda s: F.when(s == F.lit(""), s)
                         .when(is_chapter_title(s), F.concat(F.lit("<strong>"), s, F.lit("</strong>")))
                         .otherwise(s))
    return F.array_join(marked, "\n")


# ---------------------------------------------------------------------------
# W5 paragraphs (shuffle-free)
# ---------------------------------------------------------------------------
def is_header_line(line: Column) -> Column:
    return (line.startswith("Item ")
            | ((F.length(line) > P.HEADER_MIN_CHARS) & is_upper(line)))


def paragraph_array(c: Column) -> Column:
    """array<struct<kind,text>>: header lines stand alone, blank lines end paragraphs.

    Header lines are surrounded by blank lines, the lines are re-joined and the
    text split at blank-line runs; each chunk is one paragraph.
    """
    lines = stripped_lines(c)
    spaced = F.flatten(F.transform(
        lines, lambda x: F.when(is_header_line(x), F.array(F.lit(""), x, F.lit("")))
        .otherwise(F.array(x))))
    chunks = F.transform(F.split(F.array_join(spaced, "\n"), "\n\n+", -1),
                         lambda x: F.trim(x, F.lit("\n")))
    chunks = F.filter(chunks, lambda x: x != F.lit(""))
    return F.transform(chunks, lambda x: F.struct(
        F.when(~x.contains("\n") & is_header_line(x), F.lit("header"))
        .otherwise(F.lit("paragraph")).alias("kind"),
        F.replace(x, F.lit("\n"), F.lit(" ")).alias("text")))


# ---------------------------------------------------------------------------
# T2-T4 header fields
# ---------------------------------------------------------------------------
def field_or_null(content: Column, rx: P.Rx, stripped: bool = False) -> Column:
    """First match of group 1; NULL when the pattern does not match.

    ``regexp_substr`` finds the first whole match (NULL on a miss) in one pass
    over the content; group 1 is then taken from that short match.
    """
    value = F.regexp_extract(F.regexp_substr(content, F.lit(rx.java)), rx.java, 1)
    return strip(value) if stripped else value


def dash_date(d: Column) -> Column:
    """``yyyymmdd`` -> ``yyyy-mm-dd`` when the text has 8 characters, else as is."""
    return let(d, lambda x: F.when(F.length(x) == 8, F.concat(
        x.substr(1, 4), F.lit("-"), x.substr(5, 2), F.lit("-"), x.substr(7, 2))).otherwise(x))
