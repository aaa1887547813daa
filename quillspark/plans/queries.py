"""Registered queries: one per operator of the inventory, each with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``.
Every query reads the driver's tables through the bridge views and runs over
all of their rows.  Column names and types agree between the two sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import companies as C
from ..operators import documents as D
from ..operators import filings as FL
from ..operators import sections as S
from . import bridge as B
from . import sql_text as Q
from .bridge import with_views as V

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _zf(x):
    return B._zero_fill_sql(x)


# ---------------------------------------------------------------------------
# Companies
# ---------------------------------------------------------------------------
@register("company_dedup", V(
    f"SELECT ticker, {_zf('cik_str')} AS cik, coalesce(title, '{P.UNKNOWN_COMPANY}') AS title, first_pos FROM ("
    "SELECT ticker, cik_str, title, min(src_pos) OVER (PARTITION BY ticker) AS first_pos, "
    "row_number() OVER (PARTITION BY ticker ORDER BY src_pos DESC) AS rn FROM companies_raw "
    "WHERE ticker IS NOT NULL AND cik_str IS NOT NULL) WHERE rn = 1", "companies_raw"))
def company_dedup(spark, sf):
    """A1 + P1 + P2 + P11: last-wins company master."""
    return C.dedup_companies(B.view(spark, sf, "companies_raw"))


@register("company_source", V(
    "SELECT ticker, " + _zf("cik_str") + " AS cik, coalesce(title, 'Unknown Company') AS title, first_pos FROM ("
    "SELECT ticker, cik_str, title, min(src_pos) OVER (PARTITION BY ticker) AS first_pos, "
    "row_number() OVER (PARTITION BY ticker ORDER BY src_pos DESC) AS rn FROM ("
    "SELECT src_pos, json_extract_string(value, '$.ticker') AS ticker, "
    "CAST(json_extract(value, '$.cik_str') AS BIGINT) AS cik_str, json_extract_string(value, '$.title') AS title "
    "FROM (SELECT c_custkey AS src_pos, CASE WHEN c_custkey % 97 = 0 THEN '[1, 2]' "
    "WHEN c_custkey % 89 = 0 THEN json_object('ticker', 'T' || (c_custkey % 500), 'title', c_name) "
    "WHEN c_custkey % 83 = 0 THEN json_object('ticker', 'T' || (c_custkey % 500), 'cik_str', c_custkey) "
    "ELSE json_object('ticker', 'T' || (c_custkey % 500), 'cik_str', c_custkey, 'title', c_name) END AS value "
    "FROM customer)) WHERE ticker IS NOT NULL AND cik_str IS NOT NULL) WHERE rn = 1"))
def company_source(spark, sf):
    """S1 + P11 + A1: company items landed as JSON text (some malformed or incomplete)."""
    from ..sources.companies import company_items_from_json
    c = B.table(spark, sf, "customer")
    t = F.concat(F.lit("T"), (F.col("c_custkey") % 500).cast("string"))
    full = F.to_json(F.struct(t.alias("ticker"), F.col("c_custkey").alias("cik_str"), F.col("c_name").alias("title")))
    value = (F.when(F.col("c_custkey") % 97 == 0, F.lit("[1, 2]"))
             .when(F.col("c_custkey") % 89 == 0, F.to_json(F.struct(t.alias("ticker"), F.col("c_name").alias("title"))))
             .when(F.col("c_custkey") % 83 == 0,
                   F.to_json(F.struct(t.alias("ticker"), F.col("c_custkey").alias("cik_str"))))
             .otherwise(full))
    items = company_items_from_json(c.select(F.col("c_custkey").alias("src_pos"), value.alias("value")))
    return C.dedup_companies(items)


@register("cik_normalise", V(
    f"SELECT c_custkey, {_zf('c_custkey')} AS cik, {_zf('c_custkey * 10000000')} AS cik_wide FROM customer"))
def cik_normalise(spark, sf):
    """Zero-filled registrant ids, never truncated."""
    c = B.table(spark, sf, "customer")
    return c.select("c_custkey", B.zero_fill(F.col("c_custkey")).alias("cik"),
                    B.zero_fill(F.col("c_custkey") * 10000000).alias("cik_wide"))


SEARCH_TERM = "ER#0000001"


@register("company_search", V(
    f"SELECT ticker, cik, title FROM companies WHERE contains(lower(ticker), lower('{SEARCH_TERM}')) "
    f"OR contains(lower(title), lower('{SEARCH_TERM}')) ORDER BY ticker LIMIT 50", "companies"))
def company_search(spark, sf):
    """P6 + O1: case-insensitive search, sorted by ticker, first 50 (the --limit feature)."""
    return C.search_companies(B.view(spark, sf, "companies"), SEARCH_TERM, limit=50)


@register("requested_known", V(
    "SELECT r.ticker, r.req_pos, c.cik, c.title FROM requested r JOIN companies c ON r.ticker = c.ticker",
    "requested", "companies"))
def requested_known(spark, sf):
    """Requested tickers found in the master."""
    return C.resolve_tickers(B.view(spark, sf, "requested"), B.view(spark, sf, "companies"))


@register("requested_unknown", V(
    "SELECT r.ticker, r.req_pos FROM requested r ANTI JOIN companies c ON r.ticker = c.ticker",
    "requested", "companies"))
def requested_unknown(spark, sf):
    """Requested tickers missing from the master."""
    return C.unknown_tickers(B.view(spark, sf, "requested"), B.view(spark, sf, "companies"))


SELECT_TERMS = ["00001", "0001", "001", "12", "21", "#0000000", "no such name"]


def _term_select_sql():
    terms = ", ".join(f"({i}, {Q.q(t.lower())})" for i, t in enumerate(SELECT_TERMS))
    dedup = (f"SELECT ticker, coalesce(title, '{P.UNKNOWN_COMPANY}') AS title, first_pos FROM ("
             "SELECT ticker, title, min(src_pos) OVER (PARTITION BY ticker) AS first_pos, "
             "row_number() OVER (PARTITION BY ticker ORDER BY src_pos DESC) AS rn FROM companies_raw "
             "WHERE ticker IS NOT NULL AND cik_str IS NOT NULL) WHERE rn = 1")
    return (
        f"WITH RECURSIVE companies_raw AS ({B.CTE_SQL['companies_raw']}), "
        f"terms(term_pos, term) AS (VALUES {terms}), dedup AS ({dedup}), "
        "cand AS (SELECT t.term_pos, t.term, d.ticker, d.title, row_number() OVER "
        "(PARTITION BY t.term_pos ORDER BY d.first_pos, d.ticker) AS cand_rank "
        "FROM terms t JOIN dedup d ON contains(lower(d.title), t.term)), "
        "steps(term_pos, used, picked) AS (SELECT -1, CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR) UNION ALL "
        "SELECT s.term_pos + 1, CASE WHEN x.t IS NULL THEN s.used ELSE list_append(s.used, x.t) END, x.t "
        "FROM steps s, LATERAL (SELECT (SELECT c.ticker FROM cand c WHERE c.term_pos = s.term_pos + 1 "
        "AND NOT list_contains(s.used, c.ticker) ORDER BY c.cand_rank LIMIT 1) AS t) x "
        f"WHERE s.term_pos + 1 < {len(SELECT_TERMS)}) "
        "SELECT CAST(s.term_pos AS INTEGER) AS term_pos, c.term, s.picked AS ticker, c.title "
        "FROM steps s JOIN cand c ON c.term_pos = s.term_pos AND c.ticker = s.picked")


@register("term_select", _term_select_sql())
def term_select(spark, sf):
    """J4 + W4: greedy first-unused pick per term (oracle: recursive CTE)."""
    return C.select_companies(C.dedup_companies(B.view(spark, sf, "companies_raw")), SELECT_TERMS)


# ---------------------------------------------------------------------------
# Filings
# ---------------------------------------------------------------------------
_LATEST_SQL = ("SELECT *, CAST(row_number() OVER (PARTITION BY cik ORDER BY pos) AS INTEGER) AS rank "
               "FROM filings WHERE form = '{form}' QUALIFY rank <= {n}")


@register("latest_filings", V(_LATEST_SQL.format(form="10-K", n=3), "filings"))
def latest_filings(spark, sf):
    """P5 + W1: first three 10-K filings per company in list order."""
    return FL.latest_filings(B.view(spark, sf, "filings"), "10-K", 3)


AS_OF = "1998-08-02"


@register("form_list_lookback", V(
    "SELECT cik, form, filingDate, accession FROM filings WHERE form IN ('10-K', '10-Q') "
    f"AND try_cast(filingDate AS DATE) >= DATE '{AS_OF}' - INTERVAL 60 MONTH", "filings"))
def form_list_lookback(spark, sf):
    """P5b + P5c: form list and five-year look-back from a fixed date."""
    return FL.filter_forms(B.view(spark, sf, "filings"), ["10-K", "10-Q"], 5, AS_OF) \
        .select("cik", "form", "filingDate", "accession")


@register("fetch_manifest", V(
    "SELECT cik, accession, 'https://data.sec.gov/submissions/CIK' || cik || '.json' AS submissions_url, "
    "'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accession, '-', '') || '/' || "
    "accession || '.txt' AS text_url, 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || accession || "
    "'/' || accession || '-index.html' AS index_url FROM (" + _LATEST_SQL.format(form="10-K", n=5) + ")",
    "filings"))
def fetch_manifest(spark, sf):
    """URLs for the latest five 10-K filings per company."""
    return FL.fetch_manifest(FL.latest_filings(B.view(spark, sf, "filings"), "10-K", 5))


def _kind_sql(f):
    lf = f"lower({f})"
    return (f"CASE WHEN contains({lf}, '10-k') THEN '10-K' WHEN contains({lf}, '10-q') THEN '10-Q' "
            f"WHEN contains({lf}, '8-k') THEN '8-K' ELSE 'other' END")


def _role_sql(f, t):
    lf, lt = f"lower({f})", f"lower(coalesce({t}, ''))"

    def anyc(xs):
        return "(" + " OR ".join(f"contains({lf}, '{x}')" for x in xs) + ")"
    exhibit = f"({anyc(['exhibit', 'ex-'])} OR starts_with({lt}, 'ex-'))"
    main_txt = (f"(contains({lt}, 'complete submission text file') OR "
                f"(ends_with({lf}, '.txt') AND NOT {anyc(['exhibit', 'ex-', 'cert', 'cover'])}))")
    clean = f"NOT {anyc(['exhibit', 'ex-', 'cert', 'cover', 'xbrl'])}"
    main_htm = f"((contains({lf}, '10-k') OR {lt} = '10-k' OR ends_with({lf}, '.htm')) AND {clean})"
    other = f"(ends_with({lf}, '.htm') OR ends_with({lf}, '.html') OR ends_with({lf}, '.txt'))"
    return (f"CASE WHEN {exhibit} THEN 'exhibit' WHEN {main_txt} THEN 'main' WHEN {main_htm} THEN 'main' "
            f"WHEN {other} THEN 'other' ELSE 'exhibit' END")


_ROLES_SQL = (f"SELECT *, {_role_sql('filename', 'doc_type')} AS role FROM index_documents")
_RANKED_SQL = (f"SELECT *, CASE role WHEN 'main' THEN 0 WHEN 'other' THEN 1 ELSE 2 END AS role_rank "
               f"FROM ({_ROLES_SQL})")


@register("doc_kind", V(f"SELECT accession, pos, filename, {_kind_sql('filename')} AS kind FROM index_documents",
                        "index_documents"))
def doc_kind(spark, sf):
    """Form kind from the file name."""
    d = B.view(spark, sf, "index_documents")
    return d.select("accession", "pos", "filename", FL.document_kind(F.col("filename")).alias("kind"))


@register("doc_role", V(f"SELECT accession, pos, filename, doc_type, role FROM ({_ROLES_SQL})", "index_documents"))
def doc_role(spark, sf):
    """Main / other / exhibit role of each index document."""
    return FL.classify_documents(B.view(spark, sf, "index_documents")) \
        .select("accession", "pos", "filename", "doc_type", "role")


@register("role_counts", V(
    "SELECT accession, count(CASE WHEN role = 'main' THEN 1 END) AS n_main, "
    "count(CASE WHEN role = 'other' THEN 1 END) AS n_other, count(CASE WHEN role = 'exhibit' THEN 1 END) AS n_exhibit, "
    f"count(*) AS n_documents FROM ({_ROLES_SQL}) GROUP BY accession",
    "index_documents"))
def role_counts(spark, sf):
    """A4: documents per role per filing."""
    return FL.role_counts(B.view(spark, sf, "index_documents"))


_MAIN_SQL = (f"SELECT accession, filename, url, doc_type, role, pos FROM ({_RANKED_SQL}) "
             "QUALIFY row_number() OVER (PARTITION BY accession ORDER BY role_rank, pos) = 1")


@register("main_document", V(_MAIN_SQL, "index_documents"))
def main_document(spark, sf):
    """Main document per filing."""
    return FL.main_documents(B.view(spark, sf, "index_documents"))


def _ctype_sql():
    return "CASE doc_type WHEN 'GRAPHIC' THEN 'image/jpeg' WHEN 'Report' THEN 'text/html; charset=utf-8' ELSE '' END"


@register("content_ext", V(
    f"SELECT accession, pos, CASE WHEN contains(lower({_ctype_sql()}), 'html') OR ends_with(url, '.htm') "
    f"OR ends_with(url, '.html') THEN '.html' WHEN contains(lower({_ctype_sql()}), 'pdf') OR ends_with(url, '.pdf') "
    "THEN '.pdf' ELSE '.txt' END AS ext FROM index_documents", "index_documents"))
def content_ext(spark, sf):
    """Saved-file extension from content type or URL."""
    d = B.view(spark, sf, "index_documents")
    ctype = (F.when(F.col("doc_type") == "GRAPHIC", "image/jpeg")
             .when(F.col("doc_type") == "Report", "text/html; charset=utf-8").otherwise(""))
    return d.select("accession", "pos", FL.content_extension(ctype, F.col("url")).alias("ext"))


def _reports(spark, sf, n=5):
    """C1 core: requested -> companies -> latest n 10-K -> landed text or index fallback."""
    from .jobs import corpus_build
    companies, requested = B.view(spark, sf, "companies"), B.view(spark, sf, "requested")
    known = C.resolve_tickers(requested, companies)
    return known, corpus_build(requested, companies, B.view(spark, sf, "filings"), B.view(spark, sf, "landed"),
                               B.view(spark, sf, "index_documents"), n)


_REPORTS_SQL = (
    "SELECT k.ticker, k.cik, k.req_pos, f.accession, f.filingDate, f.rank, s.content, "
    "CASE WHEN s.submission_id IS NOT NULL THEN 'submission' ELSE 'index' END AS source, "
    "CASE WHEN s.submission_id IS NOT NULL THEN f.accession || '.txt' "
    "ELSE coalesce(m.filename, f.accession || '.txt') END AS document, "
    "CASE WHEN s.submission_id IS NOT NULL THEN 'https://www.sec.gov/Archives/edgar/data/' || k.cik || '/' || "
    "replace(f.accession, '-', '') || '/' || f.accession || '.txt' "
    "ELSE coalesce(m.url, 'https://www.sec.gov/Archives/edgar/data/' || k.cik || '/' || f.accession || '/' || "
    "f.accession || '.txt') END AS url, "
    "k.ticker || '_' || f.filingDate || '_10K.txt' AS file_name "
    "FROM (SELECT r.ticker, r.req_pos, c.cik FROM requested r JOIN companies c ON r.ticker = c.ticker) k "
    f"JOIN ({_LATEST_SQL.format(form='10-K', n=5)}) f ON k.cik = f.cik "
    "LEFT JOIN submissions s ON s.submission_id = f.order_key "
    f"LEFT JOIN ({_MAIN_SQL}) m ON m.accession = f.accession")


@register("filing_text_fallback", V(
    f"SELECT ticker, cik, accession, filingDate, source, document, url, file_name FROM ({_REPORTS_SQL})",
    "requested", "companies", "filings", "submissions", "index_documents"))
def filing_text_fallback(spark, sf):
    """C1 core, J2 + J3: latest 10-Ks with landed text or the main index document."""
    return _reports(spark, sf)[1].drop("content", "rank", "req_pos")


@register("corpus_build", V(
    "SELECT ticker, cik, req_pos, accession, rank, source, document, file_name, md5(content) AS content_md5, "
    f"CAST(length(content) AS INTEGER) AS n_chars FROM ({_REPORTS_SQL})",
    "requested", "companies", "filings", "submissions", "index_documents"))
def corpus_build(spark, sf):
    """The whole chain with the text of every report (md5 and length)."""
    return _reports(spark, sf)[1].select("ticker", "cik", "req_pos", "accession", "rank", "source", "document",
                                         "file_name", F.md5("content").alias("content_md5"),
                                         F.length("content").alias("n_chars"))


def _term_corpus_sql(n):
    """The greedy picks of :func:`term_select`, their latest 10-Ks and the run summary."""
    picks = _term_select_sql()
    head, body = picks.split("SELECT CAST(s.term_pos AS INTEGER) AS term_pos", 1)
    return (
        head.rstrip() + ", picked AS (SELECT CAST(s.term_pos AS INTEGER) AS term_pos" + body + "), "
        f"filings AS ({B.CTE_SQL['filings']}), latest AS ({_LATEST_SQL.format(form='10-K', n=n)}), "
        f"master AS (SELECT ticker, {_zf('cik_str')} AS cik FROM (SELECT ticker, cik_str, row_number() OVER "
        "(PARTITION BY ticker ORDER BY src_pos DESC) AS rn FROM companies_raw "
        "WHERE ticker IS NOT NULL AND cik_str IS NOT NULL) WHERE rn = 1), "
        "per AS (SELECT p.ticker, count(l.accession) AS n_reports FROM picked p JOIN master m USING (ticker) "
        "LEFT JOIN latest l ON l.cik = m.cik GROUP BY p.ticker) "
        "SELECT ticker, n_reports, CASE WHEN n_reports = 0 THEN 'no reports downloaded' ELSE 'reports' END AS status FROM per "
        "UNION ALL SELECT NULL, CAST(sum(n_reports) AS BIGINT), 'total' FROM per")


@register("term_corpus", _term_corpus_sql(3))
def term_corpus(spark, sf):
    """Companies picked by search terms (J4, W4), their latest annual reports with text (C1), and the run summary."""
    from .jobs import selection_summary
    return selection_summary(C.dedup_companies(B.view(spark, sf, "companies_raw")), SELECT_TERMS, B.view(spark, sf, "filings"),
                             B.view(spark, sf, "landed"), B.view(spark, sf, "index_documents"), 3)


@register("report_names", V(
    "SELECT ticker, file_name, rank, ticker || '/' || file_name AS relative_path, "
    "rank <> max(rank) OVER (PARTITION BY ticker, file_name) AS overwritten FROM "
    f"({_REPORTS_SQL})", "requested", "companies", "filings", "submissions", "index_documents"))
def report_names(spark, sf):
    """K1: paths of reports and which of them a later one overwrites."""
    from ..sinks import report_names as names
    return names(_reports(spark, sf)[1].select("ticker", "file_name", "rank"))


@register("reports_per_ticker", V(
    "SELECT k.ticker, k.req_pos, coalesce(array_to_string(list(x.file_name ORDER BY x.rank), ','), '') AS files, "
    "count(x.file_name) AS n_reports FROM (SELECT r.ticker, r.req_pos FROM requested r JOIN companies c "
    f"ON r.ticker = c.ticker) k LEFT JOIN ({_REPORTS_SQL}) x ON k.ticker = x.ticker GROUP BY k.ticker, k.req_pos",
    "requested", "companies", "filings", "submissions", "index_documents"))
def reports_per_ticker(spark, sf):
    """A3: ordered report list and count per known ticker."""
    a3 = FL.reports_per_ticker(*_reports(spark, sf))
    return a3.select("ticker", "req_pos", F.array_join("files", ",").alias("files"), "n_reports")


@register("run_summary", V(
    "SELECT ticker, n_reports, CASE WHEN ticker IS NULL THEN 'total' WHEN n_reports = 0 THEN 'no reports downloaded' "
    "ELSE 'reports' END AS status FROM (SELECT k.ticker, count(x.file_name) AS n_reports FROM "
    "(SELECT r.ticker FROM requested r JOIN companies c ON r.ticker = c.ticker) k "
    f"LEFT JOIN ({_REPORTS_SQL}) x ON k.ticker = x.ticker GROUP BY ROLLUP (k.ticker))",
    "requested", "companies", "filings", "submissions", "index_documents"))
def run_summary(spark, sf):
    """Reports per ticker plus the grand total."""
    return FL.run_summary(*_reports(spark, sf))


# ---------------------------------------------------------------------------
# Submissions: routing, header, metadata
# ---------------------------------------------------------------------------
def _contains_any_sql(x, markers):
    return "(" + " OR ".join(f"contains({x}, {Q.q(m)})" for m in markers) + ")"


_FORMAT_SQL = (f"CASE WHEN {_contains_any_sql('content', P.IXBRL_MARKERS)} THEN 'ixbrl' "
               f"WHEN {_contains_any_sql('content', P.SGML_MARKERS)} THEN 'sgml' ELSE 'text' END")


@register("format_route", V(f"SELECT submission_id, {_FORMAT_SQL} AS doc_format FROM submissions", "submissions"))
def format_route(spark, sf):
    """P10: ixbrl / sgml / text routing."""
    return D.route(B.view(spark, sf, "submissions")).select("submission_id", "doc_format")


_HEADER_ROWS_SQL = (
    "SELECT submission_id, key, value FROM ("
    f"SELECT submission_id, {Q.strip('split_part(l, chr(58), 1)')} AS key, "
    f"{Q.strip('substring(l, instr(l, chr(58)) + 1)')} AS value, "
    f"row_number() OVER (PARTITION BY submission_id, {Q.strip('split_part(l, chr(58), 1)')} ORDER BY idx DESC) AS rn "
    "FROM (SELECT submission_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS idx FROM ("
    f"SELECT submission_id, list_filter(string_split({Q.first('content', P.HEADER_BLOCK)}, chr(10)), "
    "lambda l: contains(l, chr(58))) AS ls FROM submissions))) WHERE rn = 1")


@register("header_map", V(_HEADER_ROWS_SQL, "submissions"))
def header_map(spark, sf):
    """T1 + A8: SGML header key/value rows, last repeated key wins."""
    return D.header_rows(B.view(spark, sf, "submissions"))


def _regex_meta_sql(c, fname=None):
    company = f"'{P.UNKNOWN_COMPANY}'"
    acc = f"'{P.UNKNOWN}'"
    filed = f"'{P.UNKNOWN}'"
    if fname is not None:
        for k, v in D.NAME_OVERRIDES.items():
            company = f"CASE WHEN contains({fname}, {Q.q(k)}) THEN {Q.q(v)} ELSE {company} END"
        an = Q.first(fname, P.ACCESSION_IN_NAME)
        acc = f"CASE WHEN {an} <> '' THEN {an} ELSE {acc} END"
        dn = Q.first(fname, P.DATE_IN_NAME)
        filed = f"CASE WHEN {dn} <> '' THEN {dn} ELSE {filed} END"
    company = f"coalesce({Q.field_or_null(c, P.COMPANY_FIELD, True)}, {company})"
    ac = Q.first(c, P.ACCESSION_FIELD)
    acc = f"CASE WHEN {ac} <> '' THEN {ac} ELSE {acc} END"
    fc = Q.first(c, P.FILED_FIELD)
    filed = f"CASE WHEN {fc} <> '' THEN {Q.dash_date(fc)} ELSE {filed} END"
    dtype = f"coalesce({Q.field_or_null(c, P.TYPE_FIELD, True)}, '{P.DEFAULT_REGEX_DOC_TYPE}')"
    return {"company": company, "accession": acc, "filing_date": filed, "document_type": dtype}


@register("header_fields", V(
    "SELECT submission_id, " + ", ".join(f"{v} AS {k}" for k, v in _regex_meta_sql("content", "file_name").items())
    + " FROM submissions", "submissions"))
def header_fields(spark, sf):
    """Header fields by regex with file-name fallbacks."""
    return D.metadata(B.view(spark, sf, "submissions"), use_file_name=True)


# ---------------------------------------------------------------------------
# Sections and reports
# ---------------------------------------------------------------------------
def _type_sql(v):
    return (f"CASE WHEN {Q.has(v, P.TYPE_VALUE)} THEN {Q.strip(Q.first(v, P.TYPE_VALUE))} "
            f"ELSE '{P.UNKNOWN}' END")


def _raw_text_sql(v):
    whole = Q.first(v, P.TEXT_BODY, 0)
    return (f"{whole} <> '' AS has_text, CASE WHEN {whole} <> '' THEN substring({whole}, 7, length({whole}) - 13) "
            "ELSE '' END AS raw_text")


_SECTIONS_SQL = (
    f"SELECT submission_id, CAST(s.pos AS INTEGER) AS section_pos, {_type_sql('s.b')} AS doc_type, "
    f"{_raw_text_sql('s.b')} FROM ("
    f"SELECT submission_id, unnest(list_transform(regexp_extract_all(content, {Q.q(P.DOCUMENT_BLOCK.re2)}, 0), "
    "lambda b, i: struct_pack(pos := i - 1, b := b))) AS s FROM submissions)")
_EXCLUDED_SQL = "upper(doc_type) IN (" + ", ".join(Q.q(t) for t in P.EXCLUDED_TYPES) + ")"
_RANK_SQL = "CASE WHEN upper(doc_type) IN (" + ", ".join(Q.q(t) for t in P.MAIN_TYPES) + ") THEN 0 ELSE 1 END"
_CLEAN_SECTIONS_SQL = (
    f"SELECT submission_id, section_pos, doc_type, has_text, clean_text, length(clean_text) > {P.SUBSTANTIAL_CHARS} "
    f"AS substantial, {_RANK_SQL} AS rank FROM (SELECT submission_id, section_pos, doc_type, has_text, "
    f"{Q.clean_section_text('raw_text')} AS clean_text FROM ({_SECTIONS_SQL}) WHERE has_text AND NOT {_EXCLUDED_SQL})")
_REPORT_SQL = (
    "SELECT u.submission_id, u.content, coalesce(r.report, '') AS report FROM submissions u LEFT JOIN ("
    "SELECT submission_id, string_agg('=== ' || doc_type || ' ===' || chr(10) || clean_text || chr(10), "
    "chr(10) || chr(10) ORDER BY rank, section_pos) AS report "
    f"FROM ({_CLEAN_SECTIONS_SQL}) WHERE clean_text <> '' GROUP BY submission_id) r ON u.submission_id = r.submission_id")
_ASSEMBLED_SQL = (
    "SELECT submission_id, CASE WHEN report = '' THEN content ELSE report END AS report, report = '' AS used_fallback FROM (" + _REPORT_SQL + ")")


def _truncated_sql(x):
    return f"({Q.has(x, P.EXHIBIT_MARKERS)} AND NOT {Q.has(x, P.MAIN_MARKERS)})"


@register("split_sections", V(_SECTIONS_SQL, "submissions"))
def split_sections(spark, sf):
    """One row per <DOCUMENT> block."""
    return S.split_sections(B.view(spark, sf, "submissions"))


@register("clean_section", V(_CLEAN_SECTIONS_SQL.replace("has_text, clean_text", "clean_text", 1), "submissions"))
def clean_section(spark, sf):
    """P13-P15 + T11: cleaned, ranked sections."""
    return S.clean_sections(S.split_sections(B.view(spark, sf, "submissions"))).drop("has_text")


@register("assemble_report", V(
    f"SELECT submission_id, report, used_fallback, {_truncated_sql('report')} AS truncated FROM ({_ASSEMBLED_SQL})",
    "submissions"))
def assemble_report(spark, sf):
    """A5 + P16: assembled report with fallback and truncated flags."""
    return S.assemble_reports(B.view(spark, sf, "submissions"))


@register("truncated_flag", V(
    f"SELECT submission_id, {Q.has('report', P.EXHIBIT_MARKERS)} AS has_exhibit_markers, "
    f"{Q.has('report', P.MAIN_MARKERS)} AS has_main_markers, CAST(length(report) AS INTEGER) AS n_chars, "
    f"{_truncated_sql('report')} AS truncated FROM ({_ASSEMBLED_SQL})", "submissions"))
def truncated_flag(spark, sf):
    """Truncated-report markers and flag."""
    r = S.assemble_reports(B.view(spark, sf, "submissions"))
    return r.select("submission_id", F.col("report").rlike(P.EXHIBIT_MARKERS.java).alias("has_exhibit_markers"),
                    F.col("report").rlike(P.MAIN_MARKERS.java).alias("has_main_markers"),
                    F.length("report").alias("n_chars"), "truncated")


@register("section_stats", V(
    "SELECT doc_type, count(*) AS n_sections, count(CASE WHEN excluded THEN 1 END) AS n_skipped, "
    f"count(CASE WHEN n > 0 THEN 1 END) AS n_kept, count(CASE WHEN n > {P.SUBSTANTIAL_CHARS} THEN 1 END) "
    "AS n_substantial, CAST(coalesce(sum(n), 0) AS BIGINT) AS chars_kept FROM ("
    f"SELECT doc_type, {_EXCLUDED_SQL} AS excluded, CASE WHEN has_text AND NOT {_EXCLUDED_SQL} THEN "
    f"length({Q.clean_section_text('raw_text')}) END AS n FROM ({_SECTIONS_SQL})) GROUP BY doc_type",
    "submissions"))
def section_stats(spark, sf):
    """Section counts and kept characters per type."""
    return S.section_stats(B.view(spark, sf, "submissions"))


@register("clean_sgml", V(
    "SELECT submission_id, " + Q.clean_sgml_text(
        f"CASE WHEN {Q.first('content', P.FIRST_DOCUMENT_BODY, 0)} <> '' THEN "
        f"substring({Q.first('content', P.FIRST_DOCUMENT_BODY, 0)}, 11, "
        f"length({Q.first('content', P.FIRST_DOCUMENT_BODY, 0)}) - 21) "
        "WHEN instr(content, '</SEC-HEADER>') > 0 THEN substring(content, instr(content, '</SEC-HEADER>') + 13) "
        "ELSE content END") + " AS clean_text FROM submissions", "submissions"))
def clean_sgml(spark, sf):
    """T8 + T9: cleaned SGML body."""
    return D.clean_sgml(B.view(spark, sf, "submissions"))


@register("clean_ixbrl", V(f"SELECT submission_id, {Q.clean_ixbrl_text('report')} AS clean_text "
                           f"FROM ({_ASSEMBLED_SQL})", "submissions"))
def clean_ixbrl(spark, sf):
    """T10 on the assembled report (the iXBRL path of the HTML job)."""
    r = S.assemble_reports(B.view(spark, sf, "submissions"))
    return D.clean_ixbrl(r, "report").select("submission_id", "clean_text")


# ---------------------------------------------------------------------------
# HTML pages
# ---------------------------------------------------------------------------
def _odd_lines_sql():
    lists = ", ".join("[" + ", ".join(Q.q(x) for x in lines) + "]" for _, lines in B.ODD_MARKUP)
    return f"[{lists}][page_id % {len(B.ODD_MARKUP)} + 1]"


@register("html_to_text_odd", V(
    f"SELECT page_id, array_to_string(list_concat(list_filter([{Q.html_to_text('html')}], lambda x: x <> ''), "
    f"{_odd_lines_sql()}), chr(10)) AS text FROM html_docs", "html_docs"))
def html_to_text_odd(spark, sf):
    """T12 on pages with quoted ``>``, rare and unknown references, and elements and comments that are never closed."""
    return D.html_to_text(B.odd_pages(spark, sf)).select("page_id", "text")


@register("html_to_text", V(f"SELECT page_id, {Q.html_to_text('html')} AS text FROM html_docs", "html_docs"))
def html_to_text(spark, sf):
    """Page text (all HTML5 entities decoded)."""
    return D.html_to_text(B.view(spark, sf, "html_docs")).select("page_id", "text")


@register("html_regex_clean", V(f"SELECT page_id, {Q.clean_html_regex('html')} AS clean_html FROM html_docs",
                                "html_docs"))
def html_regex_clean(spark, sf):
    """Regex HTML clean."""
    return D.clean_html_regex(B.view(spark, sf, "html_docs")).select("page_id", "clean_html")


@register("paragraphs", V(
    f"SELECT submission_id, CAST(p.i - 1 AS INTEGER) AS para_pos, CASE WHEN NOT contains(p.c, chr(10)) AND "
    f"{Q.is_header_line('p.c')} THEN 'header' ELSE 'paragraph' END AS kind, replace(p.c, chr(10), ' ') AS text "
    f"FROM (SELECT submission_id, unnest(list_transform({Q.paragraph_chunks(Q.html_to_text('report'))}, "
    f"lambda c, i: struct_pack(i := i, c := c))) AS p FROM ({_ASSEMBLED_SQL}))", "submissions"))
def paragraphs(spark, sf):
    """W5 on the text of assembled reports (the data half of the PDF job, C4)."""
    from ..operators.outline import paragraphs as para
    r = S.assemble_reports(B.view(spark, sf, "submissions"))
    return para(D.html_to_text(r, "report"), "submission_id", "text")


_REPORT_TEXT_SQL = f"SELECT submission_id, {Q.clean_ixbrl_text('report')} AS text FROM ({_ASSEMBLED_SQL})"


def _report_text(spark, sf):
    """The iXBRL path's text: assembled report after the T10 clean."""
    r = S.assemble_reports(B.view(spark, sf, "submissions"))
    return D.clean_ixbrl(r, "report").select("submission_id", F.col("clean_text").alias("text"))


@register("toc_markup", V(f"SELECT submission_id, {Q.mark_titles('text')} AS marked FROM ({_REPORT_TEXT_SQL})",
                          "submissions"))
def toc_markup(spark, sf):
    """T16 on the cleaned report text, as the HTML job applies it."""
    return _report_text(spark, sf).select("submission_id", T.mark_titles(F.col("text")).alias("marked"))


@register("outline", V(
    f"SELECT submission_id, line_pos, title, kind, {Q.title_number('title', 'kind')} AS number FROM ("
    f"SELECT submission_id, line_pos, title, {Q.title_kind('title')} AS kind FROM ("
    "SELECT submission_id, CAST(s.i - 1 AS INTEGER) AS line_pos, s.t AS title FROM ("
    f"SELECT submission_id, unnest(list_transform({Q.stripped_lines('text')}, lambda t, i: struct_pack(i := i, t := t))) "
    f"AS s FROM ({_REPORT_TEXT_SQL}))) WHERE title <> '' AND {Q.is_chapter_title('title')})", "submissions"))
def outline(spark, sf):
    """T16b on the cleaned report text."""
    from ..operators.outline import outline as ol
    return ol(_report_text(spark, sf), "submission_id", "text")


# ---------------------------------------------------------------------------
# Facts
# ---------------------------------------------------------------------------
@register("concept_series", V(
    "SELECT concept, \"end\", val, CAST(filed AS DATE) AS filed_date, accn FROM concept_facts "
    "ORDER BY concept, \"end\", filed, accn", "concept_facts"))
def concept_series(spark, sf):
    """O3 + C7: concept values ordered by period end with tie-breakers."""
    from ..operators.facts import concept_series as cs
    return cs(B.view(spark, sf, "concept_facts"))


# ---------------------------------------------------------------------------
# Extraction, rendering, outcomes, facts
# ---------------------------------------------------------------------------
GENERATED_AT = "2024-01-01 00:00:00"


def _suffix_sql(x):
    return f"lower(regexp_extract({x}, '(\\.[^./]*)$', 1))"


def _w3_status_sql():
    from .jobs import ANY_HTML_TEXT, MAIN_10K
    return (f"CASE WHEN NOT ends_with(file_name, '.txt') THEN 'skipped' "
            f"WHEN {Q.first('content', MAIN_10K, 0)} = '' AND {Q.first('content', ANY_HTML_TEXT, 0)} = '' "
            "THEN 'no_html' ELSE 'extracted' END")


@register("batch_outcome", V(
    f"SELECT status, count(*) AS n_files FROM (SELECT {_w3_status_sql()} AS status FROM submissions) GROUP BY status",
    "submissions"))
def batch_outcome(spark, sf):
    """A7 over the pure-HTML extraction job."""
    from .jobs import extract_html, outcome_counts
    return outcome_counts(extract_html(B.view(spark, sf, "submissions"), GENERATED_AT))


@register("main_slice")
def main_slice(spark, sf):
    """T17 (uses a look-ahead RE2 lacks); rows-only check, compared to Python ``re`` in tests."""
    from .jobs import main_slices
    return main_slices(B.view(spark, sf, "submissions"))


# tags one by one, depths by a running sum, partners by the next tag of the same kind and depth, values by a join
_IX_FACTS_SQL = (
    "WITH tags AS (SELECT submission_id, unnest(range(1, len(t) + 1)) AS k, unnest(t) AS tag, unnest(p[2:]) AS gap FROM ("
    "SELECT submission_id, regexp_extract_all(content, '(?i)</?ix:(?:nonfraction|nonnumeric|numeric)(?:\\s[^>]*)?>') AS t, "
    "regexp_split_to_array(content, '(?i)</?ix:(?:nonfraction|nonnumeric|numeric)(?:\\s[^>]*)?>') AS p "
    "FROM submissions)), depth AS (SELECT *, lower(regexp_extract(tag, '(?i)ix:([a-z]+)', 1)) AS kind, "
    "tag NOT LIKE '</%' AS opens FROM tags), level AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER "
    "(PARTITION BY submission_id, kind ORDER BY k) + CASE WHEN opens THEN 0 ELSE 1 END AS lvl FROM depth), "
    "pair AS (SELECT *, lead(k) OVER w AS close_k, lead(opens) OVER w AS next_opens FROM level "
    "WINDOW w AS (PARTITION BY submission_id, kind, lvl ORDER BY k)), "
    "fact AS (SELECT f.submission_id, f.k, f.kind, f.tag, regexp_replace(string_agg(g.gap, '' ORDER BY g.k), "
    "'<[^>]+>', '', 'g') AS v FROM pair f JOIN tags g ON g.submission_id = f.submission_id AND g.k >= f.k "
    "AND g.k < f.close_k WHERE f.opens AND NOT f.next_opens GROUP BY ALL) "
    "SELECT submission_id, CAST(row_number() OVER (PARTITION BY submission_id ORDER BY k) - 1 AS INTEGER) AS fact_pos, "
    "kind AS tag, regexp_extract(tag, ' name=\"([^\"]*)\"', 1) AS name, "
    "regexp_extract(tag, ' contextRef=\"([^\"]*)\"', 1) AS context, "
    "regexp_extract(tag, ' unitRef=\"([^\"]*)\"', 1) AS unit, CASE WHEN v = '' THEN 'N/A' ELSE v END AS value FROM fact")


@register("ix_facts", f"WITH submissions AS ({B.CTE_SQL['submissions']}), " + _IX_FACTS_SQL[len("WITH "):])
def ix_facts(spark, sf):
    """Inline-XBRL facts per submission."""
    from ..operators.facts import ix_facts as facts
    return facts(B.view(spark, sf, "submissions"))


def _page_sql(title, header, body):
    parts = ["'<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || "
             "'<meta charset=\"UTF-8\">' || chr(10) || '<title>'", title,
             "'</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '<div class=\"header\">' || chr(10)"]
    for h in header:
        parts += ["'<div>'", h, "'</div>' || chr(10)"]
    parts += ["'</div>' || chr(10)", body, "chr(10) || '</body>' || chr(10) || '</html>' || chr(10)"]
    return "(" + " || ".join(f"({p})" for p in parts) + ")"


def _filing_page_sql(meta, body, notice=None):
    from ..operators.render import NOTICE
    header = [meta["company"], meta["document_type"], f"'Accession Number: ' || {meta['accession']}",
              f"'Filing Date: ' || {meta['filing_date']}", Q.q(f"Generated: {GENERATED_AT}")]
    content = f"'<div class=\"content\">' || {body} || '</div>'"
    if notice is not None:
        content = f"CASE WHEN {notice} THEN {Q.q(NOTICE)} || chr(10) ELSE '' END || {content}"
    return _page_sql(meta["company"], header, content)


def _render_sql():
    hdr = ("SELECT submission_id, max(CASE WHEN key = 'COMPANY CONFORMED NAME' THEN value END) AS h_company, "
           "max(CASE WHEN key = 'ACCESSION NUMBER' THEN value END) AS h_accession, "
           "max(CASE WHEN key = 'FILED AS OF DATE' THEN value END) AS h_filed, "
           "max(CASE WHEN key = 'CONFORMED SUBMISSION TYPE' THEN value END) AS h_type "
           f"FROM ({_HEADER_ROWS_SQL}) GROUP BY submission_id")
    filed = f"coalesce(h.h_filed, '{P.UNKNOWN}')"
    sgml_meta = {"company": f"coalesce(h.h_company, '{P.UNKNOWN_COMPANY}')",
                 "accession": f"coalesce(h.h_accession, '{P.UNKNOWN}')",
                 "filing_date": f"CASE WHEN {filed} <> '{P.UNKNOWN}' THEN {Q.dash_date(filed)} ELSE {filed} END",
                 "document_type": f"coalesce(h.h_type, '{P.UNKNOWN}')"}
    first_doc = Q.first("u.content", P.FIRST_DOCUMENT_BODY, 0)
    sgml_body = Q.clean_sgml_text(
        f"CASE WHEN {first_doc} <> '' THEN substring({first_doc}, 11, length({first_doc}) - 21) "
        "WHEN instr(u.content, '</SEC-HEADER>') > 0 THEN substring(u.content, instr(u.content, '</SEC-HEADER>') + 13) "
        "ELSE u.content END")
    ix_meta = _regex_meta_sql("u.content", "u.file_name")
    ix_body = Q.mark_titles(Q.clean_ixbrl_text("a.report"))
    text_page = _page_sql("u.file_name", ["'Filing document'", "u.file_name", Q.q(f"Generated on {GENERATED_AT}")],
                          "'<div class=\"content\">' || u.content || '</div>'")
    fmt = _FORMAT_SQL.replace("content", "u.content")
    return (
        f"SELECT submission_id, file_name, doc_format, CASE WHEN doc_format = 'ixbrl' THEN ix_page "
        "WHEN doc_format = 'sgml' THEN sgml_page WHEN doc_format = 'text' THEN text_page END AS html, "
        "CASE WHEN doc_format IS NULL THEN 'skipped' ELSE 'converted' END AS status FROM ("
        f"SELECT u.submission_id, u.file_name, CASE WHEN {_suffix_sql('u.file_name')} IN ('.txt', '.html') "
        f"THEN {fmt} END AS doc_format, {_filing_page_sql(ix_meta, ix_body, _truncated_sql('a.report'))} AS ix_page, "
        f"{_filing_page_sql(sgml_meta, sgml_body)} AS sgml_page, {text_page} AS text_page "
        f"FROM submissions u LEFT JOIN ({hdr}) h ON u.submission_id = h.submission_id "
        f"LEFT JOIN ({_ASSEMBLED_SQL}) a ON u.submission_id = a.submission_id)")


@register("render_html", V(_render_sql(), "submissions"))
def render_html(spark, sf):
    """Routed HTML pages with a fixed generation time."""
    from .jobs import convert_to_html
    return convert_to_html(B.view(spark, sf, "submissions"), GENERATED_AT)


# ---------------------------------------------------------------------------
# Counts, ordering, sizes, strict text, PDF data half
# ---------------------------------------------------------------------------
@register("filings_per_company", V("SELECT cik, count(*) AS n_filings FROM filings GROUP BY cik", "filings"))
def filings_per_company(spark, sf):
    """A2."""
    return FL.filings_per_company(B.view(spark, sf, "filings"))


@register("ordered_documents", V(
    "SELECT accession, pos, filename, role, CAST(row_number() OVER (PARTITION BY accession ORDER BY role_rank, pos) "
    f"AS INTEGER) AS order_pos FROM ({_RANKED_SQL})", "index_documents"))
def ordered_documents(spark, sf):
    """O2."""
    return FL.ordered_documents(B.view(spark, sf, "index_documents")) \
        .select("accession", "pos", "filename", "role", "order_pos")


@register("document_sizes", V(
    "SELECT submission_id, CAST(length(content) AS BIGINT) AS n_chars, CAST(strlen(content) AS BIGINT) AS n_bytes, "
    f"strlen(content) / 1024.0 / 1024.0 AS size_mb, strlen(content) > {P.RENDER_SIZE_GATE_BYTES} AS too_large "
    "FROM submissions", "submissions"))
def document_sizes(spark, sf):
    """P17 + P18."""
    return B.view(spark, sf, "submissions").select("submission_id", *D.size_columns(F.col("content")))


@register("html_to_text_strict", V(
    "SELECT page_id, " + Q.sub(Q.sub(Q.sub("html", P.ANY_TAG), P.WS_RUN, "' '"), P.NOT_WHITELISTED)
    + " AS text FROM html_docs", "html_docs"))
def html_to_text_strict(spark, sf):
    """T13 (the regex fallback of T12)."""
    return D.html_to_text(B.view(spark, sf, "html_docs"), mode="strict").select("page_id", "text")


@register("pdf_paragraphs", V(
    f"SELECT submission_id, CAST(p.i - 1 AS INTEGER) AS para_pos, CASE WHEN NOT contains(p.c, chr(10)) AND "
    f"{Q.is_header_line('p.c')} THEN 'header' ELSE 'paragraph' END AS kind, replace(p.c, chr(10), ' ') AS text "
    f"FROM (SELECT submission_id, unnest(list_transform({Q.paragraph_chunks(Q.html_to_text('html'))}, "
    f"lambda c, i: struct_pack(i := i, c := c))) AS p FROM ({_render_sql()}) WHERE html IS NOT NULL)", "submissions"))
def pdf_paragraphs(spark, sf):
    """C4 data half: routed page (C2) -> T12 -> W5."""
    from .jobs import convert_to_html
    from .jobs import pdf_paragraphs as pp
    return pp(convert_to_html(B.view(spark, sf, "submissions"), GENERATED_AT))


# The page has the five columns Seq, Description, Document, Type, Size; the scan reads
# the fourth cell (Type) as "size", as the reference does, so size equals the type here.
@register("index_parse", V(
    "SELECT cik, accession, pos, filename, url, CASE WHEN contains(lower(filename), '10-k') THEN '10-K' "
    "WHEN contains(lower(filename), '10-q') THEN '10-Q' WHEN contains(lower(filename), '8-k') THEN '8-K' ELSE 'other' END "
    "AS type, doc_type, size FROM (SELECT cik, accession, pos, "
    f"{B.index_markup_sql(1)} || filename AS filename, url || {B.index_markup_sql(2)} AS url, doc_type, "
    f"{B.index_markup_sql(3)} || doc_type AS size FROM index_documents)", "index_documents"))
def index_parse(spark, sf):
    """Landed index pages (rendered from the index bridge) parsed back into document rows."""
    from ..sources.index_pages import read_index
    return read_index(B.index_pages(spark, sf))


# Filing-list payloads (parallel arrays) built per company and order-key block, so a
# payload holds at most 1000 filings however many one company has; the primary-document
# array is half as long as the others (padding with '' on parse)
_PAYLOAD_BLOCK = 1000


@register("filing_source", V(
    "SELECT cik, CAST(rn - 1 AS BIGINT) AS pos, form, filingDate, filingDate AS reportDate, accession, "
    "CASE WHEN rn <= n // 2 THEN accession || '.htm' ELSE '' END AS primaryDocument, '' AS fileNumber, "
    "CAST(0 AS BIGINT) AS size FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER w AS n FROM filings "
    f"WINDOW w AS (PARTITION BY cik, order_key // {_PAYLOAD_BLOCK} ORDER BY pos "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))", "filings"))
def filing_source(spark, sf):
    """Submissions JSON (parallel arrays) -> filing rows with their array position."""
    from ..sources.filings import filings_from_json
    f = B.view(spark, sf, "filings")
    rows = F.sort_array(F.collect_list(F.struct("pos", "form", "filingDate", "accession")))
    g = f.groupBy("cik", F.floor(F.col("order_key") / _PAYLOAD_BLOCK).alias("block")).agg(rows.alias("l"))
    half = F.floor(F.size("l") / 2).cast("int")
    recent = F.struct(
        F.transform("l", lambda x: x["form"]).alias("form"),
        F.transform("l", lambda x: x["filingDate"]).alias("filingDate"),
        F.transform("l", lambda x: x["accession"]).alias("accessionNumber"),
        F.slice(F.transform("l", lambda x: F.concat(x["accession"], F.lit(".htm"))), 1, half)
        .alias("primaryDocument"))
    payload = F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings")))
    return filings_from_json(g.select("cik", payload.alias("value")))


# Company-concept payloads ({units: {unit: [records]}}) built per concept and 1000-event
# block from events; every tenth record is in 'shares', every third has no frame
def _concept_record_cols():
    e = F.col("event_id")
    return [F.when(e % 10 == 0, "shares").otherwise("USD").alias("unit"),
            F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("end"), F.col("value").alias("val"),
            F.concat(F.lit("a"), e.cast("string")).alias("accn"), F.year("ts").cast("long").alias("fy"),
            F.lit("FY").alias("fp"), F.lit("10-K").alias("form"),
            F.date_format(F.date_add(F.to_date("ts"), 30), "yyyy-MM-dd").alias("filed"),
            F.when(e % 3 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("CY"), F.year("ts").cast("string"))).alias("frame")]


@register("concept_source", V(
    "SELECT CAST(320193 AS BIGINT) AS cik, 'us-gaap' AS taxonomy, event_type AS concept, "
    "CASE WHEN event_id % 10 = 0 THEN 'shares' ELSE 'USD' END AS unit, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS \"end\", "
    "value AS val, 'a' || event_id AS accn, CAST(year(ts) AS BIGINT) AS fy, 'FY' AS fp, '10-K' AS form, "
    "strftime(CAST(ts AS DATE) + 30, '%Y-%m-%d') AS filed, "
    "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'CY' || year(ts) END AS frame FROM events"))
def concept_source(spark, sf):
    """Concept payloads -> one row per (unit, record)."""
    return _concepts(spark, sf)


@register("concept_trend", (
    "SELECT event_type AS concept, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS \"end\", value AS val, "
    "CAST(ts AS DATE) + 30 AS filed_date, 'a' || event_id AS accn FROM events "
    "WHERE event_id % 10 <> 0 ORDER BY 1, 2, 4, 5"))
def concept_trend(spark, sf):
    """S5 payloads -> the USD values of every concept over time (O3)."""
    from ..operators.facts import concept_series as cs
    return cs(_concepts(spark, sf), unit="USD")


def _concepts(spark, sf):
    from ..operators.facts import read_concepts
    ev = B.table(spark, sf, "events")
    recs = ev.select("event_type", (F.col("event_id") / 1000).cast("long").alias("block"), *_concept_record_cols())
    fields = ["end", "val", "accn", "fy", "fp", "form", "filed", "frame"]
    grouped = recs.groupBy("event_type", "block").agg(F.collect_list(F.struct("unit", *fields)).alias("l"))

    def unit_list(u):
        return F.transform(F.filter("l", lambda x: x["unit"] == u), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    payload = F.to_json(F.struct(F.lit(320193).cast("long").alias("cik"), F.lit("us-gaap").alias("taxonomy"),
                                 F.col("event_type").alias("tag"),
                                 F.create_map(F.lit("USD"), unit_list("USD"), F.lit("shares"), unit_list("shares"))
                                 .alias("units")))
    return read_concepts(grouped.select(payload.alias("value")))


# Landed fetch results (url, content type, raw body) from pages; the content type
# follows page_id % 3: html, none (the URL decides), pdf
@register("fetched_documents", V(
    "SELECT url, content_type, CASE WHEN contains(lower(coalesce(content_type, '')), 'html') OR ends_with(url, '.htm') "
    "OR ends_with(url, '.html') THEN '.html' WHEN contains(lower(coalesce(content_type, '')), 'pdf') "
    "OR ends_with(url, '.pdf') THEN '.pdf' ELSE '.txt' END AS ext, html AS text, "
    "CAST(strlen(html) AS BIGINT) AS n_bytes FROM (SELECT url, html, CASE page_id % 3 WHEN 0 THEN "
    "'text/html; charset=UTF-8' WHEN 2 THEN 'application/pdf' END AS content_type FROM pages)"))
def fetched_documents(spark, sf):
    """S6 + P9: typed, decoded landed fetches."""
    from ..sources.submissions import typed_documents
    p = B.table(spark, sf, "pages")
    ctype = (F.when(F.col("page_id") % 3 == 0, "text/html; charset=UTF-8")
             .when(F.col("page_id") % 3 == 2, "application/pdf"))
    fetched = p.select("url", ctype.alias("content_type"), F.encode("html", "UTF-8").alias("body"))
    return typed_documents(fetched)


# K2 + K5: output paths for landed files laid out as /landed/<source>/<doc>/R<doc % 997>.txt
_LANDED_ROOT = "/landed"


def _with_suffix_sql(x, suf):
    return (f"CASE WHEN regexp_matches({x}, '\\.[^./]*$') THEN regexp_replace({x}, '\\.[^./]*$', '{suf}') "
            f"ELSE {x} || '{suf}' END")


@register("output_paths", V(
    f"SELECT submission_id, path, sibling, html_subdir, mirror, pdf_path, count(*) OVER (PARTITION BY pdf_path) > 1 "
    f"AS collides FROM (SELECT submission_id, path, {_with_suffix_sql('path', '.html')} AS sibling, "
    "regexp_extract(path, '^(.*)/[^/]*$', 1) || '/html/' || regexp_extract(path, '([^/]*?)(\\.[^./]*)?$', 1) || "
    f"'.html' AS html_subdir, '/html/' || {_with_suffix_sql(f'substring(path, {len(_LANDED_ROOT) + 2})', '.html')} "
    "AS mirror, '/out/pdf/' || regexp_extract(path, '([^/]*?)(\\.[^./]*)?$', 1) || '.pdf' AS pdf_path FROM ("
    f"SELECT doc_id AS submission_id, '{_LANDED_ROOT}/' || source || '/' || doc_id || '/R' || (doc_id % 997) || "
    "'.txt' AS path FROM documents))"))
def output_paths(spark, sf):
    """K2 (three layouts) and K5 (flattened PDF paths with collision flags)."""
    from .. import sinks as K
    d = B.table(spark, sf, "documents")
    # one folder per document; file stems repeat across folders, so flattened PDF paths collide
    files = d.select(F.col("doc_id").alias("submission_id"), F.concat(
        F.lit(f"{_LANDED_ROOT}/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("/R"),
        (F.col("doc_id") % 997).cast("string"), F.lit(".txt")).alias("path"))
    p = F.col("path")
    laid = files.select("submission_id", "path", K.html_path(p, "sibling").alias("sibling"),
                        K.html_path(p, "html_subdir").alias("html_subdir"),
                        K.html_path(p, "mirror", _LANDED_ROOT, "/html").alias("mirror"))
    return K.pdf_paths(laid, "/out/pdf")


def _extract_page_sql(meta, body, source):
    header = [meta["company"], meta["document_type"], f"'Accession Number: ' || {meta['accession']}",
              f"'Filing Date: ' || {meta['filing_date']}", Q.q(f"Generated: {GENERATED_AT}"), f"'Source: ' || {source}"]
    title = f"{meta['company']} || ' - ' || {meta['document_type']}"
    return _page_sql(title, header, f"'<div class=\"content\">' || {body} || '</div>'")


def _w3_body_sql(c):
    """The 10-K body, else a body holding a whole page; NULL when neither matches."""
    from .jobs import ANY_HTML_TEXT, MAIN_10K

    def body(rx):
        whole = Q.first(c, rx, 0)
        return f"CASE WHEN {whole} <> '' THEN {Q.first(whole, rx)} END"
    return f"coalesce({body(MAIN_10K)}, {body(ANY_HTML_TEXT)})"


@register("pure_html", V(
    "SELECT submission_id, file_name, CASE WHEN NOT ends_with(file_name, '.txt') THEN 'skipped' "
    "WHEN body IS NULL THEN 'no_html' ELSE 'extracted' END AS status, "
    f"CASE WHEN body IS NOT NULL THEN {_extract_page_sql({k: k for k in D.METADATA_FIELDS}, Q.clean_html_regex('body'), 'file_name')} "
    "END AS html FROM (SELECT submission_id, file_name, "
    + ", ".join(f"{v} AS {k}" for k, v in _regex_meta_sql("content").items())
    + f", CASE WHEN ends_with(file_name, '.txt') THEN {_w3_body_sql('content')} END AS body FROM submissions)",
    "submissions"))
def pure_html(spark, sf):
    """T18 with the regex clean (T15), the reference's fallback path: W3 -> T15 -> T19d."""
    from .jobs import extract_html
    return extract_html(B.view(spark, sf, "submissions"), GENERATED_AT)


# T17 oracle: the look-ahead and Unicode word boundaries rewritten for RE2.
# "\bX" = X at the start or after a non-word char; "X\b" = X at the end or before one;
# "(?!\s*[,V])" = end, or whitespace then (end or a char that is neither space nor , V v),
# or directly one non-word char other than ",".
_NW = "[^\\pL\\pN_]"
_SP = f"[{P.S_CLASS}]"
_PART1_TAIL = f"(?:\\z|{_SP}+(?:\\z|[^{P.S_CLASS},Vv])|[^\\pL\\pN_{P.S_CLASS},])"


def _pos_sql(s, core, tail="", word_start=True):
    """1-based start of the first ``core`` (with the boundary rules above), 0 when none."""
    lead = f"(?:^|{_NW})" if word_start else ""
    pat = f"(?s)^(.*?{lead})(?i:{core}){tail}" if word_start else f"(?s)^(.*?)(?i:{core}){tail}"
    find = f"(?s)(?:^|{_NW})(?i:{core}){tail}" if word_start else f"(?si){core}{tail}"
    return f"CASE WHEN regexp_matches({s}, {Q.q(find)}) THEN length(regexp_extract({s}, {Q.q(pat)}, 1)) + 1 ELSE 0 END"


def _slice_sql(s, start, end):
    return (f"CASE WHEN {end} > 0 THEN CASE WHEN {end} > {start} THEN substring({s}, {start}, {end} - {start}) "
            f"ELSE '' END ELSE substring({s}, {start}) END")


def _main_slice_sql():
    business = f"Item 1\\.{_SP}*Business"
    part1 = ("Part I", _PART1_TAIL)
    word_end = f"(?:\\z|{_NW})"
    exhibit_n = "(?si)Exhibit" + _SP + "+\\p{Nd}"
    sec_ok = (f"(regexp_matches(b, {Q.q('(?si)' + business)}) OR regexp_matches(b, "
              f"{Q.q('(?s)(?:^|' + _NW + ')(?i:Part I)' + _PART1_TAIL)})) "
              f"AND NOT regexp_matches(b, '(?si)<TYPE>EX-') AND NOT regexp_matches(b, {Q.q(exhibit_n)})")
    s = "s"
    p1 = _pos_sql(s, *part1)
    i1 = _pos_sql(s, "Item 1\\.")
    p4 = _pos_sql(s, "Part IV", word_end)
    inner = (
        "SELECT submission_id, CASE WHEN p1 > 0 THEN CASE WHEN bm > 0 THEN "
        f"{_slice_sql('fp', 'bm', 'p3')} ELSE fp END WHEN i1 > 0 THEN {_slice_sql('s', 'i1', 'p4')} ELSE s END "
        "AS main_text FROM (SELECT *, "
        f"{_pos_sql('fp', business, word_start=False)} AS bm, {_pos_sql('fp', 'Part III', word_end)} AS p3 FROM ("
        f"SELECT *, {_slice_sql('s', 'p1', 'p4')} AS fp FROM (SELECT *, {p1} AS p1, {i1} AS i1, {p4} AS p4 FROM ("
        f"SELECT submission_id, coalesce(list_filter(regexp_extract_all(content, {Q.q(P.DOCUMENT_BLOCK.re2)}, 0), "
        f"lambda b: {sec_ok})[1], content) AS s FROM submissions))))")
    return f"SELECT submission_id, main_text, CAST(length(main_text) AS INTEGER) AS n_chars FROM ({inner})"


ORACLE["main_slice"] = V(_main_slice_sql(), "submissions")
