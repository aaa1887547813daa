"""The text rules as DuckDB SQL expressions (oracle side of ``queries()``).

Same pattern bodies as ``functions.text``; only the dialect prefix differs.
"""

from __future__ import annotations

from ..functions import patterns as P

NL = "chr(10)"
NL2 = "chr(10) || chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, rx: P.Rx, repl: str = "''") -> str:
    return f"regexp_replace({x}, {q(rx.re2)}, {repl}, 'g')"


def has(x: str, rx: P.Rx) -> str:
    return f"regexp_matches({x}, {q(rx.re2)})"


def first(x: str, rx: P.Rx, group: int = 1) -> str:
    return f"regexp_extract({x}, {q(rx.re2)}, {group})"


def strip(x: str) -> str:
    chars = "".join(f" || chr({ord(c)})" for c in P.WHITESPACE_CHARS)[4:]
    return f"trim({x}, {chars})"


def is_upper(x: str) -> str:
    return has(x, P.ALL_UPPER)


def squeeze(x: str) -> str:
    return sub(sub(x, P.THREE_NEWLINES, NL2), P.SPACE_RUN, "' '")


def clean_sgml_text(x: str) -> str:
    x = squeeze(sub(x, P.ANY_TAG))
    x = sub(x, P.SYMBOL_LINE)
    return strip(sub(x, P.TWO_NEWLINES, NL2))


def clean_ixbrl_text(x: str) -> str:
    for rx, rep in [(P.IX_OPEN, "''"), (P.IX_CLOSE, "''"), (P.STYLE_BLOCK, "''"), (P.STYLE_ATTR, "''"),
                    (P.BR_TAG, NL), (P.P_OPEN, NL2), (P.P_CLOSE, "''"), (P.DIV_OPEN, NL),
                    (P.DIV_CLOSE, "''"), (P.ANY_TAG, "''")]:
        x = sub(x, rx, rep)
    x = sub(squeeze(x), P.SYMBOL_LINE)
    return strip(x)


def _dropped_line(v: str) -> str:
    parts = [has(v, P.TECHNICAL_LINE)]
    parts += [f"starts_with({v}, {q(p)})" for p in P.DROPPED_LINE_PREFIXES]
    return "(" + " OR ".join(parts) + ")"


def clean_section_text(x: str) -> str:
    for rx, rep in [(P.STYLE_ATTR, "''"), (P.CLASS_ATTR, "''"), (P.ID_ATTR, "''"), (P.BR_TAG_I, NL),
                    (P.P_TAG_I, NL), (P.DIV_TAG_I, NL), (P.SPAN_TAG_I, "''"), (P.SCRIPT_BLOCK_I, "''"),
                    (P.JS_VAR, "''"), (P.JS_FUNCTION, "''"), (P.COMMENT, "''"), (P.ANY_TAG, "''")]:
        x = sub(x, rx, rep)
    x = sub(squeeze(x), P.NEWLINE_SPACE, NL)
    lines = f"list_transform(string_split({x}, {NL}), lambda l: {strip('l')})"
    kept = f"list_filter({lines}, lambda v: v = '' OR NOT {_dropped_line('v')})"
    return strip(f"array_to_string({kept}, {NL})")


def decode_entities(x: str) -> str:
    for ent, ch in P.NAMED_ENTITIES:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def html_to_text(x: str) -> str:
    x = decode_entities(sub(x, P.HTML_MARKUP))
    parts = f"list_transform(regexp_split_to_array({x}, {q(P.LINE_OR_PHRASE_BREAK.re2)}), lambda p: {strip('p')})"
    return f"array_to_string(list_filter({parts}, lambda p: p <> ''), {NL})"


def clean_html_regex(x: str) -> str:
    for rx in [P.IX_OPEN, P.IX_CLOSE, P.XMLNS_ATTR, P.STYLE_ATTR, P.CLASS_ATTR, P.ID_ATTR,
               P.SCRIPT_BLOCK_I, P.COMMENT]:
        x = sub(x, rx)
    return strip(squeeze(x))


def is_chapter_title(v: str) -> str:
    titles = "[" + ", ".join(q(t) for t in P.LISTED_TITLES) + "]"
    return f"(regexp_matches({v}, {q(P.CHAPTER_TITLE_RE2)}) OR list_contains({titles}, {v}))"


def title_kind(v: str) -> str:
    titles = "[" + ", ".join(q(t) for t in P.LISTED_TITLES) + "]"
    return (f"CASE WHEN {has(v, P.PART_OR_ITEM)} AND regexp_matches({v}, '(?i)^Part') THEN 'part' "
            f"WHEN {has(v, P.PART_OR_ITEM)} OR {has(v, P.ITEM_TITLE)} THEN 'item' "
            f"WHEN list_contains({titles}, {v}) THEN 'listed' "
            f"WHEN {has(v, P.TWO_CAPITALISED)} THEN 'capitalised' END")


def title_number(v: str, kind: str) -> str:
    return (f"CASE WHEN {kind} = 'part' THEN {first(v, P.PART_NUMBER)} "
            f"WHEN {kind} = 'item' THEN {first(v, P.ITEM_NUMBER)} END")


def stripped_lines(x: str) -> str:
    return f"list_transform(string_split({x}, {NL}), lambda l: {strip('l')})"


def mark_titles(x: str) -> str:
    marked = (f"list_transform({stripped_lines(x)}, lambda s: CASE WHEN s = '' THEN s "
              f"WHEN {is_chapter_title('s')} THEN '<strong>' || s || '</strong>' ELSE s END)")
    return f"array_to_string({marked}, {NL})"


def is_header_line(v: str) -> str:
    return f"(({is_upper(v)} AND length({v}) > {P.HEADER_MIN_CHARS}) OR starts_with({v}, 'Item '))"


def paragraph_chunks(x: str) -> str:
    spaced = (f"flatten(list_transform({stripped_lines(x)}, lambda l: CASE WHEN {is_header_line('l')} "
              f"THEN ['', l, ''] ELSE [l] END))")
    chunks = (f"list_transform(regexp_split_to_array(array_to_string({spaced}, {NL}), '\\n\\n+'), "
              f"lambda c: trim(c, chr(10)))")
    return f"list_filter({chunks}, lambda c: c <> '')"


def field_or_null(x: str, rx: P.Rx, stripped: bool = False) -> str:
    whole = first(x, rx, 0)
    val = first(whole, rx, 1)
    if stripped:
        val = strip(val)
    return f"CASE WHEN {whole} <> '' THEN {val} END"


def dash_date(d: str) -> str:
    return (f"CASE WHEN length({d}) = 8 THEN substring({d}, 1, 4) || '-' || substring({d}, 5, 2) || '-' || "
            f"substring({d}, 7, 2) ELSE {d} END")
