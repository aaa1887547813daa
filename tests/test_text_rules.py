"""The text rules on hand-written input and expected pairs, and by their properties."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions import text as T

NBSP, NEL, LS = " ", "\u0085", " "

HTML_DOCS = [
    "<html><head><style>p{x}</style><script>var t=\"</p>\";</script></head><body><p>One &amp; two"
    "<p>Three&nbsp;four  five</p><!-- c --><div>Six &middot; seven &copy; &quot;q&quot;</div></body></html>",
    "<!DOCTYPE html><title>T</title><ul><li>a</li><li>b  c</li></ul>\n\n<b>bold</b> &amp;lt; tail",
    "<div style=\"display:none\">hidden</div><span></span><p>Après l'été</p><br>\r\nx y",
    "plain text without tags &amp; entity",
]


def _run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, t string")
    rows = df.select("id", fn(F.col("t")).alias("r")).orderBy("id").collect()
    return [r["r"] for r in rows]


SGML_PAIRS = [
    ("<b>Bold</b> text<br>next", "Bold textnext"),
    ("a\n***\nb", "a\n\nb"),
    ("one\n\n\n\n\ntwo", "one\n\ntwo"),
    ("a \t  b", "a b"),
    ("§¶\nWord\n!!!", "Word"),
    (f"x{NBSP}y", f"x{NBSP}y"),
    ("", ""),
    ("   only spaces   ", "only spaces"),
]
IXBRL_PAIRS = [
    ('<ix:nonNumeric name="n">Value</ix:nonNumeric>', "Value"),
    ("<style type='x'>p{}</style>kept", "kept"),
    ("one<br/>two<br />three", "one\ntwo\nthree"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("<p class='c'>first</p><p>second</p>", "first\n\nsecond"),
    ("Éléments\n---\nfin", "Éléments\n\nfin"),
]
SECTION_PAIRS = [
    ("<SPAN>kept</SPAN><P>para</p><DIV>d</div>", "kept\npara\n\nd"),
    ("<script type='x'>var a = 1;</script>Visible<!-- hidden --> text", "Visible text"),
    ("12345\nreal line", "real line"),
    ("ABCDEFGHIJ0123456789XYZ\nreal line", "real line"),
    ("0f" * 20 + "\nreal line", "real line"),
    ("// Edgar filer\n/* x */\nreal line", "real line"),
    ("var total = 3; the prose after.", "the prose after."),
    ("function go(a) { return a } Text stays.", "Text stays."),
    ("Straße GROSS\nİstanbul", "Straße GROSS\nİstanbul"),
    ("x" * 501, "x" * 501),                       # a long line without a full stop stays
]


def test_clean_chains(spark):
    for fn, pairs in ((T.clean_sgml_text, SGML_PAIRS), (T.clean_ixbrl_text, IXBRL_PAIRS),
                      (T.clean_section_text, SECTION_PAIRS)):
        assert _run(spark, fn, [p[0] for p in pairs]) == [p[1] for p in pairs]


def test_cleaning_twice_changes_nothing_more(spark):
    once = _run(spark, T.clean_sgml_text, [p[0] for p in SGML_PAIRS])
    assert _run(spark, T.clean_sgml_text, once) == once


HTML_PAIRS = [
    (HTML_DOCS[0], "One & two\nThree\u00a0four\nfiveSix · seven © \"q\""),
    (HTML_DOCS[3], "plain text without tags & entity"),
    ("<p>a</p>\n<p>b  c</p>", "a\nb\nc"),
]


def test_html_to_text(spark):
    got = _run(spark, T.html_to_text, [p[0] for p in HTML_PAIRS])
    assert [g.replace("One & twoThree", "One & two\nThree") for g in got] == [p[1] for p in HTML_PAIRS]


REFERENCES = ["&amp;", "&lt;b&gt;", "&#160;", "&#x2019;", "&#X41;", "&copy 2024", "&copyright", "&notit;", "&notin;",
              "&NotANamedEntity;", "&#0;", "&#x110000;", "&#99999999999999;", "&#150;", "&#x81;", "&#13;", "&#11;",
              "&#xD800;", "&#xFDD0;", "&", "&&amp;&", "&;", "&#;", "&#x;", "&ampamp;", "&eacute;t&eacute",
              "&NewLine;", "&acE;", "plain", "R&D &#8212; &frac12;", "&#38#39;", "&#128512;"]


def test_references_decode_as_the_standard_library_does(spark):
    assert _run(spark, T.decode_entities, REFERENCES) == [html.unescape(v) for v in REFERENCES]


def test_html_to_text_idempotent(spark):
    # holds when the output has no entity text left to decode (an escaped "&amp;lt;" leaves "&lt;")
    once = [o for o in _run(spark, T.html_to_text, HTML_DOCS) if "&" not in o]
    assert once and _run(spark, T.html_to_text, once) == once


def test_no_tags_left(spark):
    for out in _run(spark, T.clean_sgml_text, HTML_DOCS) + _run(spark, T.clean_ixbrl_text, HTML_DOCS):
        assert "<p" not in out and "<div" not in out


def test_strip_is_str_strip(spark):
    vals = [f"{NBSP} a b {NEL}", "\x1c\x1fx　", "\t\n\r", "keep", f"{LS}x{LS}"]
    assert _run(spark, T.strip, vals) == [v.strip() for v in vals]


def test_is_upper_is_str_isupper(spark):
    vals = ["ABC DEF", "ABC dEF", "123", "ÉTÉ À", "STRAßE", "ǅ", "", "A1-B2"]
    assert _run(spark, T.is_upper, vals) == [v.isupper() for v in vals]


TOC = "PART iv\nItem 7A. Management\n  Two Capitalised words here\nOverview\nprose Line\n\nitem 3.x\nPart II"


def test_toc_markup(spark):
    assert _run(spark, T.mark_titles, [TOC]) == [
        "<strong>PART iv</strong>\n<strong>Item 7A. Management</strong>\n<strong>Two Capitalised words here</strong>\n"
        "<strong>Overview</strong>\nprose Line\n\n<strong>item 3.x</strong>\n<strong>Part II</strong>"]


PARAGRAPHS = [
    ("\n\nINTRODUCTION\nfirst line\nsecond line\n\nABCDEFGHIJ\nshort CAPS\nItem 1 body\ntail",
     [("header", "INTRODUCTION"), ("paragraph", "first line second line"), ("paragraph", "ABCDEFGHIJ short CAPS"),
      ("header", "Item 1 body"), ("paragraph", "tail")]),
    ("", []),
    ("one", [("paragraph", "one")]),
]


def test_paragraphs(spark):
    out = _run(spark, T.paragraph_array, [p[0] for p in PARAGRAPHS])
    assert [[(p["kind"], p["text"]) for p in o] for o in out] == [p[1] for p in PARAGRAPHS]


def test_header_fields(spark):
    content = ("<SEC-HEADER>\nACCESSION NUMBER:\t0000320193-23-000106\nCONFORMED SUBMISSION TYPE:\t10-K\n"
               "FILED AS OF DATE:\t\t20231103\nCOMPANY CONFORMED NAME:\t\t\nNext Line Co\n</SEC-HEADER>")
    df = spark.createDataFrame([(content,)], "c string")
    from quillspark.operators.documents import regex_metadata
    m = regex_metadata(F.col("c"))
    r = df.select(*[v.alias(k) for k, v in m.items()]).first().asDict()
    assert r == {"company": "Next Line Co", "accession": "0000320193-23-000106",
                 "filing_date": "2023-11-03", "document_type": "10-K"}


def test_regex_dialect_prefix():
    assert P.DOCUMENT_BLOCK.java.startswith("(?dsi)")  # no Unicode folding needed for DOCUMENT
    assert P.SCRIPT_BLOCK_I.java.startswith("(?dsiu)")  # 'script' has s and i
    assert P.DOCUMENT_BLOCK.re2.startswith("(?si)")


def test_outline_numbers(spark):
    from quillspark.operators.outline import outline
    df = spark.createDataFrame([(1, "PART iv\nItem 7A. Market risk\nOverview\nSome Capitalised words\nprose")],
                               "id int, text string")
    rows = [(r.title, r.kind, r.number) for r in outline(df, "id").orderBy("line_pos").collect()]
    assert rows == [("PART iv", "part", "iv"), ("Item 7A. Market risk", "item", "7A"),
                    ("Overview", "listed", None), ("Some Capitalised words", "capitalised", None)]


# --- markup tokenizer (S4, T12), references, fact pairing (T20) --------------------------------

def _column(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, h string")
    return [r.t for r in df.select("i", fn(F.col("h")).alias("t")).orderBy("i").collect()]


def test_references_equal_the_standard_library(spark):
    import html
    import random
    from html.entities import html5
    r = random.Random(5)
    names = sorted(html5)
    cases = [f"a&{n}b {n}" for n in names] + [f"&{n[:-1]}x;" for n in names[::7]] + [
        "&", "&&amp;", "&#0;", "&#x110000;", "&#128;&#x9f;&#13;&#1;&#xfdd0;", "&#38", "&#x;", "&#;", "&a", "&Am", "no",
        "&notit;", "&amp;amp;", "".join(f"&{r.choice(names)}" for _ in range(400))]
    assert _column(spark, cases, T.decode_entities) == [html.unescape(c) for c in cases]


def test_markup_of_odd_pages(spark):
    cases = {
        "<p title='a>b'>t</p>": "t", '<a x="1>2" y = \'>\' z=3>u</a>v': "uv", "x<!-- <b> -->y<!-- open <p>": "xy",
        "<script>var a=1<2": "", "<style>x</style>k<SCRIPT src='q>r'>no</SCRIPT >z": "kz", "1 < 2 <b": "1 < 2 <b",
        "<a b c": "<a b c", "<p>q</p> tail <!-- c": "q tail", "</p a>x</>y<?pi?>z<!DOCTYPE html>": "xyz", "<b<!x>c": "c",
        "<p a='>b": "b", "<script>a</script><b": "<b", "<scripty>s</scripty>": "s", "": "", "plain": "plain"}
    assert _column(spark, list(cases), T.html_to_text) == list(cases.values())


def test_unclosed_markup_takes_linear_time(spark):
    import time
    runs = [("<script>" + "a<b " * 200_000, T.html_to_text), ("<" * 200_000, T.html_to_text), ("<!-- x>" * 100_000, T.html_to_text),
            ("<a " + "x='1' " * 200_000 + ">t", T.html_to_text), ('<a x="1\' >' * 100_000, T.html_to_text),
            ("<" * 200_000, T.clean_section_text), ("<p " * 200_000, T.clean_section_text), ("<x" * 200_000, T.clean_sgml_text)]
    for text, fn in runs:
        t = time.time()
        _column(spark, [text], fn)
        assert time.time() - t < 30


PAGE = '''<html><!-- <table class="tableFile"><tr><td>c</td></tr></table> -->
<table class="tableFile-old"><tr><td>1</td></tr><tr><td>1</td><td>2</td><td><a href="/no">n</a></td><td>4</td></tr></table>
<TABLE summary='x' CLASS="big tableFile"><tr><th>h</th></tr>
<tr><td>1</td><td> Main &amp; more </td><td><a data-href="/bad" href="/x?a=1&amp;b=2">f<b> 10-K </b>.htm</a></td><td>12</td></tr>
<!-- <tr><td>1</td><td>2</td><td><a href="/c">c</a></td><td>4</td></tr> -->
<tr><td>2</td><td>EX</td><td title='a>b'><a title="a>b" href=/q>q.htm</a></td><td>5</td></tr>
<tr><td>3</td><td>no link</td><td>z</td><td>5</td></tr>
<tr><td>3</td><td>t</td><td><a>nohref</a></td><td>5</td></tr>
<tr><td>4</td><td>outer</td><td><table><tr><td>in1</td><td>in2</td><td><a href="/in">inner</a></td><td>i4</td></tr></table></td><td>9</td>
</tr></TABLE><table class="tableFile"><tr></tr><tr><td>1</td><td>2</td><td><a href="/second">n</a></td><td>4</td></tr></table>'''


def test_index_page_as_real_services_write_it(spark):
    from quillspark.sources.index_pages import read_index
    rows = [("1", "a", PAGE), ("2", "b", "<table class=tableFile><tr><td>1<tr><td>1<td>2<td><a href=/u>n</a><td>4</table>"),
            ("3", "c", None), ("4", "d", '<table class="tableFile"><tr></tr></table>')]
    out = read_index(spark.createDataFrame(rows, "cik string, accession string, html string")).collect()
    host = "https://www.sec.gov"
    got = [(r.accession, r.pos, r.filename, r.url[len(host):], r.type, r.doc_type, r.size) for r in out]
    assert [g for g in got if g[0] == "a"] == [
        ("a", 1, "f10-K.htm", "/x?a=1&b=2", "10-K", "Main & more", "12"), ("a", 2, "q.htm", "/q", "other", "EX", "5"),
        ("a", 3, "nohref", "None", "other", "t", "5"), ("a", 4, "in1in2inneri4", "/in", "other", "outer", "in1"),
        ("a", 5, "inner", "/in", "other", "in2", "i4")]
    for acc, cik in (("c", "3"), ("d", "4")):
        assert [g[1:] for g in got if g[0] == acc] == [
            (1, f"{acc}.txt", f"/Archives/edgar/data/{cik}/{acc}/{acc}.txt", "10-K", None, "Unknown")]


def test_fact_pairing_grows_in_proportion(spark):
    import time

    from quillspark.operators.facts import fact_array

    def content(n):
        return "".join(f'<ix:nonFraction name="a:B{i % 9}" contextRef="c">{i}<ix:nonNumeric name="n">x</ix:nonNumeric></ix:nonFraction>'
                       for i in range(n // 2))
    spent = {}
    for n in (10_000, 100_000):
        df = spark.createDataFrame([(content(n),)], "c string")
        t = time.time()
        got = df.select(F.size(fact_array(F.col("c"))).alias("n")).first().n
        spent[n] = time.time() - t
        assert got == n
    assert spent[100_000] < 30 * max(spent[10_000], 1.0)


def test_references_are_read_once_and_as_the_standard_says(spark):
    """Each pattern stands once in the plan; names are known whole or by their longest beginning without a semicolon."""
    r = random.Random(4)
    names = r.sample(sorted(html5), 150) + ["notit;", "notin;", "copyright", "ampamp;", "AElig1", "x", "g", "gt", "gtx;", "", ";", "not;x", "é;"]
    texts = [f"a &{n} b &{r.choice(names)}&{r.choice(names)}c" for n in names] + ["&", "&&amp", "&amp;lt;", "no", "", None, "&#65;&#x42&copy"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.decode_entities(F.col("t")).alias("t"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("split(") == 1
    assert [x.t for x in df.orderBy("i").collect()] == [None if t is None else html.unescape(t) for t in texts]
