"""Bridge views: reference tables derived from the driver's TPC-H-style tables.

Each view is written twice, as a Spark DataFrame and as a DuckDB CTE, with the
same rules so that ``queries()`` and ``oracle_sql()`` see the same inputs.
All rules are per-row projections or key joins, so the views grow with the
tables they come from.

| view            | from                    | rule                                                        |
|-----------------|-------------------------|-------------------------------------------------------------|
| companies_raw   | customer                | ticker 'T'||(custkey % 500) (forces repeated tickers)       |
| companies       | customer                | ticker 'C'||custkey, cik = zero-filled custkey               |
| requested       | customer                | by segment: known ticker, wrong case, or unknown ticker      |
| filings         | orders                  | form from priority, accession from (cust, year, order)       |
| index_documents | lineitem x orders       | file name / type from l_linenumber                          |
| submissions     | documents               | one submission per document, one <DOCUMENT> per text line   |
| html_docs       | pages                   | html as is                                                  |
| concept_facts   | events                  | concept = event_type, val = value, filed = ts, end = date   |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import zero_fill

# --- fixed values of the bridge (ours) ----------------------------------------
FORM_BY_PRIORITY = {"1": "10-K", "2": "10-Q", "3": "8-K", "4": "10-K/A", "5": "4"}
SECTION_TYPES = ["10-K", "EX-21.1", "GRAPHIC", "EX-99.1", "XML", "10-Q", "EX-31.1", "EX-101.SCH"]
INDEX_FILES = {  # l_linenumber -> (file-name template, document type); {k}=partkey, {a}=accession
    1: ("{a}.txt", "Complete submission text file"),
    2: ("r{k}-10-k.htm", "10-K"),
    3: ("ex-{k}.htm", "EX-21.1"),
    4: ("report-{k}.html", "Report"),
    5: ("cover-{k}.htm", "Cover"),
    6: ("img-{k}.jpg", "GRAPHIC"),
    7: ("q-{k}-10-q.htm", "10-Q"),
}
ARCHIVE_ROOT = "https://www.sec.gov/Archives/edgar/data"
POS_DATE_BASE = "2100-01-01"
POS_SHIFT = 1 << 40
NAME_DATE_BASE = "2015-01-01"
# heading put before text line i of document d, chosen by (d + i) % 7 ('' = none)
SECTION_HEADINGS = ["PART I", "Item 1. Business", "Item 1A. Risk Factors", "PART IV", "Exhibit 21",
                    "SIGNATURES", ""]
# -------------------------------------------------------------------------------

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """The caller's choice for inputs stored as one row group (``quillspark.input.partitions``); unset: as read."""
    n = df.sparkSession.conf.get("quillspark.input.partitions", None)
    return df.repartition(int(n), key) if n else df


def _zero_fill_sql(x: str) -> str:
    s = f"CAST({x} AS VARCHAR)"
    return f"CASE WHEN length({s}) >= 10 THEN {s} ELSE lpad({s}, 10, '0') END"


# ===============================================================================
# Spark side
# ===============================================================================
def companies_raw(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("T"), (F.col("c_custkey") % 500).cast("string")).alias("ticker"),
        F.col("c_custkey").alias("cik_str"),
        F.col("c_name").alias("title"),
        F.col("c_custkey").alias("src_pos"))


def companies(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"),
        zero_fill(F.col("c_custkey")).alias("cik"),
        F.col("c_name").alias("title"))


def requested(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    ticker = (F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("c"), key))
              .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("Z"), key))
              .otherwise(F.concat(F.lit("C"), key)))
    return c.select(F.col("c_custkey").alias("req_pos"), ticker.alias("ticker"))


def _form(c):
    first = F.substring(c, 1, 1)
    expr = None
    for k, v in FORM_BY_PRIORITY.items():
        expr = F.when(first == k, v) if expr is None else expr.when(first == k, v)
    return expr


def _pad(c, width):
    """``%0{width}d`` for a non-negative integer: zero-pad, never truncate."""
    s = c.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def _accession(cust, ts, order):
    """``printf('%010d-%02d-%06d', cust, year % 100, order)`` without a per-row String.format."""
    return F.concat(_pad(cust, 10), F.lit("-"), _pad(F.year(ts) % 100, 2), F.lit("-"), _pad(order, 6))


def filings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    pos = (F.datediff(F.lit(POS_DATE_BASE).cast("date"), day).cast("long") * F.lit(POS_SHIFT)
           + F.col("o_orderkey"))
    return o.select(
        zero_fill(F.col("o_custkey")).alias("cik"),
        _form(F.col("o_orderpriority")).alias("form"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("filingDate"),
        _accession(F.col("o_custkey"), F.col("o_orderdate"), F.col("o_orderkey")).alias("accession"),
        pos.alias("pos"),
        F.col("o_orderkey").alias("order_key"))


def index_documents(spark, sf_dir):
    li = _spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    j = j.withColumn("_acc", _accession(F.col("o_custkey"), F.col("o_orderdate"), F.col("o_orderkey")))
    acc = F.col("_acc")
    k = F.col("l_partkey").cast("string")
    name = None
    dtype = None
    for n, (tmpl, t) in INDEX_FILES.items():
        pre, _, post = tmpl.partition("{k}") if "{k}" in tmpl else ("", "", "")
        if "{a}" in tmpl:
            nm = F.concat(acc, F.lit(tmpl.replace("{a}", "")))
        else:
            nm = F.concat(F.lit(pre), k, F.lit(post))
        cond = F.col("l_linenumber") == n
        name = F.when(cond, nm) if name is None else name.when(cond, nm)
        dtype = F.when(cond, t) if dtype is None else dtype.when(cond, t)
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    named = j.select(acc.alias("accession"), zero_fill(F.col("o_custkey")).alias("cik"),
                     dtype.alias("doc_type"), name.alias("filename"),
                     F.col("l_suppkey").cast("string").alias("size"), *order)
    # accession identifies the order one-to-one; partitioning the window by it lets
    # per-filing operators downstream (W2, A4, O2) reuse this shuffle
    w = Window.partitionBy("accession").orderBy(*order)
    out = named.select("accession", "cik", F.row_number().over(w).alias("pos"), "doc_type", "filename", "size")
    return out.withColumn("url", F.concat_ws(
        "/", F.lit(ARCHIVE_ROOT), F.col("cik").cast("long").cast("string"),
        F.regexp_replace("accession", "-", ""), F.col("filename")))


def _section_block(doc_id, line, i):
    """One <DOCUMENT> block for text line ``i`` (0-based) of document ``doc_id``."""
    style = (doc_id + i) % 4
    ix = (doc_id % 4 == 1) | (doc_id % 4 == 2)
    heading = F.element_at(F.array(*[F.lit(h + "\n" if h else "") for h in SECTION_HEADINGS]),
                           ((doc_id + i) % len(SECTION_HEADINGS) + 1).cast("int"))
    line = F.concat(heading, line)
    # every sixth line nests facts of its own and of another kind inside its text fact
    inner = F.when(i % 6 == 0, F.concat(
        F.lit('<ix:nonFraction name="us-gaap:Cash" contextRef="n" unitRef="usd">'), i.cast("string"),
        F.lit('</ix:nonFraction> of <ix:nonNumeric name="dei:Inner" contextRef="n">part</ix:nonNumeric> tail'))) \
        .otherwise(F.lit(""))
    body = F.when(ix & (i % 3 == 0), F.concat(
        F.lit('<ix:nonNumeric name="dei:Text'), i.cast("string"), F.lit('" contextRef="c'),
        doc_id.cast("string"), F.lit('">'), line, inner, F.lit("</ix:nonNumeric>"))).otherwise(line)
    body = F.when(ix & (i % 6 == 2), F.concat(
        body, F.lit('<ix:numeric name="old:Empty" contextRef="e"></ix:numeric>'))).otherwise(body)
    body = F.when(ix & (i % 3 == 1), F.concat(
        body, F.lit('<ix:nonFraction name="us-gaap:Assets" contextRef="c'), doc_id.cast("string"),
        F.lit('" unitRef="usd">'), F.length(line).cast("string"), F.lit("</ix:nonFraction>"))
    ).otherwise(body)
    body = (F.when(style == 0, F.concat(F.lit('<p style="margin:0">'), body, F.lit("</p>")))
            .when(style == 1, F.concat(F.lit('<div class="row">'), body, F.lit("<br/></div>")))
            .when(style == 2, F.concat(F.lit("<script>var t"), i.cast("string"),
                                       F.lit(" = 1;</script>"), body, F.lit("\n***<!-- c"),
                                       i.cast("string"), F.lit(" -->")))
            .otherwise(F.concat(F.lit('<span id="s'), i.cast("string"), F.lit('">'), body,
                                F.lit("</span>\n----"))))
    dtype = F.element_at(F.array(*[F.lit(t) for t in SECTION_TYPES]),
                         ((doc_id + i) % 8 + 1).cast("int"))
    head = F.concat(F.lit("<DOCUMENT>\n<TYPE>"), dtype, F.lit("\n<SEQUENCE>"),
                    (i + 1).cast("string"), F.lit("\n"))
    no_text = (doc_id + i) % 11 == 10
    return F.when(no_text, F.concat(head, F.lit("<FILENAME>part"), (i + 1).cast("string"),
                                    F.lit(".txt\n</DOCUMENT>\n"))) \
        .otherwise(F.concat(head, F.lit("<TEXT>\n"), body, F.lit("\n</TEXT>\n</DOCUMENT>\n")))


def submissions(spark, sf_dir):
    d = _spread(table(spark, sf_dir, "documents"), "doc_id")
    doc = F.col("doc_id")
    acc = F.format_string("%010d-%02d-%06d", F.lit(100000) + doc % 9973, doc % 100, doc)
    name_day = F.date_add(F.lit(NAME_DATE_BASE).cast("date"), (doc % 3650).cast("int"))
    filed = F.date_format(F.date_add(name_day, 30), "yyyyMMdd")
    ext = F.when(doc % 10 == 9, ".htm").when(doc % 10 == 8, ".html").otherwise(".txt")
    file_name = F.concat(F.lit("D"), doc.cast("string"), F.lit("_"),
                         F.date_format(name_day, "yyyy-MM-dd"),
                         F.when(doc % 2 == 0, F.concat(F.lit("_"), acc)).otherwise(F.lit("")),
                         F.lit("_10K"), ext)
    company = F.concat(F.upper("source"), F.lit(" CORP"))
    form = F.when(doc % 5 == 4, "10-K/A").otherwise("10-K")
    header = F.concat(
        F.lit("<SEC-DOCUMENT>"), acc, F.lit(".txt : "), filed,
        F.lit("\n<SEC-HEADER>"), acc, F.lit(".hdr.sgml : "), filed,
        F.lit("\nACCESSION NUMBER:\t\t"), acc,
        F.lit("\nCONFORMED SUBMISSION TYPE:\t"), form,
        F.lit("\nFILED AS OF DATE:\t\t"), filed,
        F.lit("\n\nFILER:\n\n\tCOMPANY DATA:\t\n\t\tCOMPANY CONFORMED NAME:\t\t\t"), company,
        F.lit("\n\t\tCENTRAL INDEX KEY:\t\t\t"), zero_fill(doc % 9973 + 100000),
        F.when(doc % 8 == 0, F.concat(
            F.lit("\n\nFILER:\n\n\tCOMPANY DATA:\t\n\t\tCOMPANY CONFORMED NAME:\t\t\t"),
            company, F.lit(" HOLDINGS"))).otherwise(F.lit("")),
        F.lit("\n</SEC-HEADER>\n"))
    blocks = F.array_join(F.transform(F.split("text", "\n", -1),
                                      lambda line, i: _section_block(doc, line, i)), "")
    has_header = doc % 4 <= 1
    content = F.when(has_header, F.concat(header, blocks, F.lit("</SEC-DOCUMENT>\n"))).otherwise(blocks)
    return d.select(doc.alias("submission_id"), file_name.alias("file_name"), content.alias("content"))


def html_docs(spark, sf_dir):
    return _spread(table(spark, sf_dir, "pages"), "page_id").select("page_id", "html")


def concept_facts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("accn"),
                    F.col("event_type").alias("concept"),
                    F.col("value").alias("val"), F.col("ts").alias("filed"),
                    F.to_date("ts").alias("end"))


# rows of an index page by pos % 5: what stands around the link and its name, in the page and in the parsed row
INDEX_MARKUP = [  # (link attributes, name before, query, size before) as written; the same as read
    (("", "", "", ""), ("", "", "", "")),
    (("title=\"a>b\" ", "", "", ""), ("", "", "", "")),
    (("data-href='/no' ", "&rarr;<b> &NotEqualTilde; </b>", "", ""), ("", "\u2192\u2242\u0338", "", "")),
    (("", "<i></i>", "?a=1&amp;b=2", ""), ("", "", "?a=1&b=2", "")),
    (("class=x ", "&copy", "", "<table><tr><td title='>'>n</td></tr></table>"), ("", "\u00a9", "", "n")),
]


def index_markup(part: int, read: bool, pos="pos"):
    """Column of one part of :data:`INDEX_MARKUP` by the row's place."""
    return F.element_at(F.array(*[F.lit(m[read][part]) for m in INDEX_MARKUP]), F.col(pos) % len(INDEX_MARKUP) + 1)


def index_markup_sql(part: int, pos="pos") -> str:
    values = ", ".join("'" + m[1][part].replace("'", "''") + "'" for m in INDEX_MARKUP)
    return f"[{values}][{pos} % {len(INDEX_MARKUP)} + 1]"


def index_pages(spark, sf_dir):
    """One landed index page per filing, rendered from ``index_documents``.

    Pages hold what real ones do: quoted ``>``, references, comments with rows, a table of a similar class, nested tables.
    A page lists one order's lines (at most 7 in these tables), so the grouped
    list is bounded; rows are placed in page order by ``pos``.
    """
    docs = index_documents(spark, sf_dir)
    attributes, before, query, nested = (index_markup(i, False) for i in range(4))
    row = F.concat(F.lit("<tr><td>"), F.col("pos").cast("string"), F.lit("</td><td>"), F.col("doc_type"),
                   F.lit("</td><td><a "), attributes, F.lit("href=\""), F.regexp_replace("url", "^https://www\\.sec\\.gov", ""),
                   query, F.lit("\">"), before, F.col("filename"), F.lit("</a></td><td>"), nested, F.col("doc_type"),
                   F.lit("</td><td>"), F.col("size"), F.lit("</td></tr>\n"),
                   F.when(F.col("pos") % 2 == 0, "<!-- <tr><td>0</td><td>x</td><td><a href='/c'>c</a></td><td>y</td></tr> -->\n")
                   .otherwise(""))
    rows = F.sort_array(F.collect_list(F.struct("pos", row.alias("r"))))
    page = F.concat(F.lit("<html><body><table class=\"tableFile-old\"><tr><td></td></tr><tr><td>1</td><td>2</td><td>"
                          "<a href='/old'>old</a></td><td>4</td></tr></table>\n"
                          "<table class=\"wide tableFile\" summary=\"Files > 0\">\n"
                          "<tr><th>Seq</th><th>Description</th><th>Document</th><th>Type</th><th>Size</th></tr>\n"),
                    F.array_join(F.transform(rows, lambda x: x["r"]), ""), F.lit("</table></body></html>"))
    return _spread(docs.groupBy("cik", "accession").agg(page.alias("html")), "accession")


# markup put behind a page by page_id % 4, and the lines of text it gives
ODD_MARKUP = [
    ("\n<p title='a>b'>one</p>\n", ["one"]),
    ("\n<!-- <p>no</p> -->&rarr; two &hellip;&NotEqualTilde;\n<script src=\"x>y\">if (a<b) c();</script>\n", ["\u2192 two \u2026\u2242\u0338"]),
    ("\n<a b=\"1>2\" c='>'>three</a>  four &#x80;&unknown;\n<style>never closed <b>", ["three", "four \u20ac&unknown;"]),
    ("\n&notit; <td nowrap data-x = '>>'>five</td> 1 < 2\n<!-- never closed <p>six</p>", ["\u00acit; five 1 < 2"]),
]


def odd_pages(spark, sf_dir):
    """Pages with markup behind them that only a tokenizer reads right."""
    odd = F.element_at(F.array(*[F.lit(m) for m, _ in ODD_MARKUP]), (F.col("page_id") % len(ODD_MARKUP) + 1).cast("int"))
    return html_docs(spark, sf_dir).withColumn("html", F.concat("html", odd))


def landed(spark, sf_dir):
    """Landed submission texts under the keys of the filing list: order ``order_key`` is document ``submission_id``."""
    f = filings(spark, sf_dir).select("cik", "accession", "order_key")
    s = submissions(spark, sf_dir).select(F.col("submission_id").alias("order_key"), "content")
    return f.join(s, "order_key").select("cik", "accession", "content")


VIEWS = {
    "landed": landed,
    "companies_raw": companies_raw, "companies": companies, "requested": requested,
    "filings": filings, "index_documents": index_documents, "submissions": submissions,
    "html_docs": html_docs, "concept_facts": concept_facts,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name](spark, sf_dir)


# ===============================================================================
# DuckDB side (oracle): the same rules as CTEs over the pre-registered tables
# ===============================================================================
def _form_sql(c: str) -> str:
    arms = " ".join(f"WHEN substr({c}, 1, 1) = '{k}' THEN '{v}'" for k, v in FORM_BY_PRIORITY.items())
    return f"CASE {arms} END"


def _acc_sql(cust: str, ts: str, order: str) -> str:
    return f"printf('%010d-%02d-%06d', {cust}, year({ts}) % 100, {order})"


def _index_name_sql() -> str:
    arms = []
    for n, (tmpl, _) in INDEX_FILES.items():
        if "{a}" in tmpl:
            e = f"acc || '{tmpl.replace('{a}', '')}'"
        else:
            pre, _, post = tmpl.partition("{k}")
            e = f"'{pre}' || CAST(l_partkey AS VARCHAR) || '{post}'"
        arms.append(f"WHEN l_linenumber = {n} THEN {e}")
    return "CASE " + " ".join(arms) + " END"


def _index_type_sql() -> str:
    return "CASE " + " ".join(f"WHEN l_linenumber = {n} THEN '{t}'"
                              for n, (_, t) in INDEX_FILES.items()) + " END"


def _section_block_sql() -> str:
    # lambda index j is 1-based in DuckDB; i = j - 1
    i = "(j - 1)"
    ix = "(doc_id % 4 = 1 OR doc_id % 4 = 2)"
    headings = "[" + ", ".join((f"'{h}' || chr(10)" if h else "''") for h in SECTION_HEADINGS) + "]"
    line = f"({headings}[((doc_id + {i}) % {len(SECTION_HEADINGS)}) + 1] || line)"
    inner = (f"CASE WHEN {i} % 6 = 0 THEN '<ix:nonFraction name=\"us-gaap:Cash\" contextRef=\"n\" unitRef=\"usd\">' || "
             f"{i} || '</ix:nonFraction> of <ix:nonNumeric name=\"dei:Inner\" contextRef=\"n\">part</ix:nonNumeric> tail' "
             "ELSE '' END")
    body = (f"CASE WHEN {ix} AND {i} % 3 = 0 THEN '<ix:nonNumeric name=\"dei:Text' || {i} || "
            f"'\" contextRef=\"c' || doc_id || '\">' || {line} || {inner} || '</ix:nonNumeric>' ELSE {line} END")
    body = (f"CASE WHEN {ix} AND {i} % 6 = 2 THEN ({body}) || "
            "'<ix:numeric name=\"old:Empty\" contextRef=\"e\"></ix:numeric>' ELSE (" + body + ") END")
    body = (f"CASE WHEN {ix} AND {i} % 3 = 1 THEN ({body}) || '<ix:nonFraction name=\"us-gaap:Assets\" "
            f"contextRef=\"c' || doc_id || '\" unitRef=\"usd\">' || length({line}) || '</ix:nonFraction>' "
            f"ELSE ({body}) END")
    style = f"((doc_id + {i}) % 4)"
    body = (f"CASE WHEN {style} = 0 THEN '<p style=\"margin:0\">' || ({body}) || '</p>' "
            f"WHEN {style} = 1 THEN '<div class=\"row\">' || ({body}) || '<br/></div>' "
            f"WHEN {style} = 2 THEN '<script>var t' || {i} || ' = 1;</script>' || ({body}) || "
            f"chr(10) || '***<!-- c' || {i} || ' -->' "
            f"ELSE '<span id=\"s' || {i} || '\">' || ({body}) || '</span>' || chr(10) || '----' END")
    types = "[" + ", ".join(f"'{t}'" for t in SECTION_TYPES) + "]"
    head = (f"'<DOCUMENT>' || chr(10) || '<TYPE>' || {types}[((doc_id + {i}) % 8) + 1] || chr(10) || "
            f"'<SEQUENCE>' || ({i} + 1) || chr(10)")
    return (f"CASE WHEN (doc_id + {i}) % 11 = 10 THEN {head} || '<FILENAME>part' || ({i} + 1) || "
            f"'.txt' || chr(10) || '</DOCUMENT>' || chr(10) "
            f"ELSE {head} || '<TEXT>' || chr(10) || ({body}) || chr(10) || '</TEXT>' || chr(10) || "
            f"'</DOCUMENT>' || chr(10) END")


def _cte_sql() -> dict[str, str]:
    nl = "chr(10)"
    acc = "printf('%010d-%02d-%06d', 100000 + doc_id % 9973, doc_id % 100, doc_id)"
    name_day = f"(DATE '{NAME_DATE_BASE}' + CAST(doc_id % 3650 AS INTEGER))"
    filed = f"strftime({name_day} + 30, '%Y%m%d')"
    company = "upper(source) || ' CORP'"
    form = "CASE WHEN doc_id % 5 = 4 THEN '10-K/A' ELSE '10-K' END"
    header = (
        f"'<SEC-DOCUMENT>' || {acc} || '.txt : ' || {filed} || {nl} || "
        f"'<SEC-HEADER>' || {acc} || '.hdr.sgml : ' || {filed} || {nl} || "
        f"'ACCESSION NUMBER:' || chr(9) || chr(9) || {acc} || {nl} || "
        f"'CONFORMED SUBMISSION TYPE:' || chr(9) || {form} || {nl} || "
        f"'FILED AS OF DATE:' || chr(9) || chr(9) || {filed} || {nl} || {nl} || "
        f"'FILER:' || {nl} || {nl} || chr(9) || 'COMPANY DATA:' || chr(9) || {nl} || chr(9) || chr(9) || "
        f"'COMPANY CONFORMED NAME:' || chr(9) || chr(9) || chr(9) || {company} || {nl} || chr(9) || chr(9) || "
        f"'CENTRAL INDEX KEY:' || chr(9) || chr(9) || chr(9) || {_zero_fill_sql('doc_id % 9973 + 100000')} || "
        f"CASE WHEN doc_id % 8 = 0 THEN {nl} || {nl} || 'FILER:' || {nl} || {nl} || chr(9) || "
        f"'COMPANY DATA:' || chr(9) || {nl} || chr(9) || chr(9) || 'COMPANY CONFORMED NAME:' || "
        f"chr(9) || chr(9) || chr(9) || {company} || ' HOLDINGS' ELSE '' END || "
        f"{nl} || '</SEC-HEADER>' || {nl}")
    blocks = (f"array_to_string(list_transform(string_split(text, {nl}), "
              f"lambda line, j: {_section_block_sql()}), '')")
    file_name = (f"'D' || doc_id || '_' || strftime({name_day}, '%Y-%m-%d') || "
                 f"CASE WHEN doc_id % 2 = 0 THEN '_' || {acc} ELSE '' END || '_10K' || "
                 f"CASE WHEN doc_id % 10 = 9 THEN '.htm' WHEN doc_id % 10 = 8 THEN '.html' ELSE '.txt' END")
    pos = (f"CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '{POS_DATE_BASE}') AS BIGINT) * "
           f"{POS_SHIFT} + o_orderkey")
    order = ("l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, "
             "l_tax, l_returnflag, l_linestatus, l_shipdate")
    return {
        "companies_raw": ("SELECT 'T' || CAST(c_custkey % 500 AS VARCHAR) AS ticker, c_custkey AS cik_str, "
                          "c_name AS title, c_custkey AS src_pos FROM customer"),
        "companies": (f"SELECT 'C' || CAST(c_custkey AS VARCHAR) AS ticker, {_zero_fill_sql('c_custkey')} AS cik, "
                      "c_name AS title FROM customer"),
        "requested": ("SELECT c_custkey AS req_pos, CASE WHEN c_mktsegment = 'BUILDING' THEN 'c' || c_custkey "
                      "WHEN c_mktsegment = 'MACHINERY' THEN 'Z' || c_custkey ELSE 'C' || c_custkey END AS ticker "
                      "FROM customer"),
        "filings": (f"SELECT {_zero_fill_sql('o_custkey')} AS cik, {_form_sql('o_orderpriority')} AS form, "
                    "strftime(o_orderdate, '%Y-%m-%d') AS filingDate, "
                    f"{_acc_sql('o_custkey', 'o_orderdate', 'o_orderkey')} AS accession, {pos} AS pos, "
                    "o_orderkey AS order_key FROM orders"),
        "index_documents": (
            "SELECT accession, cik, pos, doc_type, filename, size, "
            f"'{ARCHIVE_ROOT}' || '/' || CAST(CAST(cik AS BIGINT) AS VARCHAR) || '/' || "
            "replace(accession, '-', '') || '/' || filename AS url FROM ("
            f"SELECT acc AS accession, {_zero_fill_sql('o_custkey')} AS cik, "
            f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS INTEGER) AS pos, "
            f"{_index_type_sql()} AS doc_type, {_index_name_sql()} AS filename, "
            "CAST(l_suppkey AS VARCHAR) AS size FROM ("
            f"SELECT *, {_acc_sql('o_custkey', 'o_orderdate', 'o_orderkey')} AS acc "
            "FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"),
        "submissions": (f"SELECT doc_id AS submission_id, {file_name} AS file_name, "
                        f"CASE WHEN doc_id % 4 <= 1 THEN {header} || {blocks} || '</SEC-DOCUMENT>' || {nl} "
                        f"ELSE {blocks} END AS content FROM documents"),
        "html_docs": "SELECT page_id, html FROM pages",
        "concept_facts": ("SELECT 'a' || event_id AS accn, event_type AS concept, value AS val, ts AS filed, "
                          "CAST(ts AS DATE) AS \"end\" FROM events"),
    }


CTE_SQL = _cte_sql()


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it uses."""
    ctes = ",\n".join(f"{n} AS ({CTE_SQL[n]})" for n in names)
    return f"WITH {ctes}\n{body}" if names else body
