"""Filing and index-document operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pruning import prune_to_keys

ARCHIVE_HOST = "https://www.sec.gov"
DATA_HOST = "https://data.sec.gov"

_EXHIBIT_HINTS = ["exhibit", "ex-"]
_NOT_MAIN_TXT = ["exhibit", "ex-", "cert", "cover"]
_NOT_MAIN_HTML = ["exhibit", "ex-", "cert", "cover", "xbrl"]
ROLE_RANK = {"main": 0, "other": 1, "exhibit": 2}


# ---------------------------------------------------------------------------
# P5, P5b, P5c, W1
# ---------------------------------------------------------------------------
def latest_filings(filings: DataFrame, form: str = "10-K", n: int = 5) -> DataFrame:
    """P5 + W1: the first ``n`` filings of exactly ``form`` per company in list order.

    ``row_number() <= n`` is planned as a WindowGroupLimit, so each map task
    keeps at most ``n`` rows per company before the shuffle, however many
    filings one company has.
    """
    w = Window.partitionBy("cik").orderBy("pos")
    return (filings.where(F.col("form") == form)
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n))


def filter_forms(filings: DataFrame, forms: Sequence[str] | None = None, years_back: int | None = None,
                 as_of: str | None = None) -> DataFrame:
    """Form list and look-back window (``as_of`` is explicit, no clock)."""
    df = filings
    if forms:
        df = df.where(F.col("form").isin(list(forms)))
    if years_back is not None:
        if as_of is None:
            raise ValueError("years_back needs as_of")
        start = F.add_months(F.lit(as_of).cast("date"), -12 * years_back)
        df = df.where(F.try_to_date(F.col("filingDate")) >= start)
    return df


# ---------------------------------------------------------------------------
# P3 / P4 fetch manifest and file naming
# ---------------------------------------------------------------------------
def cik_number(cik: Column) -> Column:
    return cik.cast("long").cast("string")


def fetch_manifest(filings: DataFrame) -> DataFrame:
    """The URLs the reference would request for each filing (fetching is not built)."""
    acc = F.col("accession")
    nodash = F.regexp_replace(acc, "-", "")
    return filings.select(
        "cik", "accession",
        F.concat(F.lit(f"{DATA_HOST}/submissions/CIK"), F.col("cik"), F.lit(".json")).alias("submissions_url"),
        F.concat_ws("/", F.lit(f"{ARCHIVE_HOST}/Archives/edgar/data"), F.col("cik"), nodash,
                    F.concat(acc, F.lit(".txt"))).alias("text_url"),
        F.concat_ws("/", F.lit(f"{ARCHIVE_HOST}/Archives/edgar/data"), F.col("cik"), acc,
                    F.concat(acc, F.lit("-index.html"))).alias("index_url"))


def report_file_name(ticker: Column, filing_date: Column) -> Column:
    """``<ticker>_<filingDate>_10K.txt``."""
    return F.concat(ticker, F.lit("_"), filing_date, F.lit("_10K.txt"))


# ---------------------------------------------------------------------------
# P7, P8, P9 document classification
# ---------------------------------------------------------------------------
def _any(c: Column, subs: Sequence[str]) -> Column:
    cond = F.lit(False)
    for s in subs:
        cond = cond | c.contains(s)
    return cond


def document_kind(filename: Column) -> Column:
    """Form kind from the file name (hyphen required)."""
    f = F.lower(filename)
    return (F.when(f.contains("10-k"), "10-K").when(f.contains("10-q"), "10-Q")
            .when(f.contains("8-k"), "8-K").otherwise("other"))


def document_role(filename: Column, doc_type: Column) -> Column:
    """Main / other / exhibit, first matching rule wins."""
    f = F.lower(filename)
    t = F.lower(F.coalesce(doc_type, F.lit("")))
    exhibit = _any(f, _EXHIBIT_HINTS) | t.startswith("ex-")
    main_txt = t.contains("complete submission text file") | (f.endswith(".txt") & ~_any(f, _NOT_MAIN_TXT))
    clean_html = ~_any(f, _NOT_MAIN_HTML)
    main_htm = (f.contains("10-k") | (t == "10-k") | f.endswith(".htm")) & clean_html
    other = f.endswith(".htm") | f.endswith(".html") | f.endswith(".txt")
    return (F.when(exhibit, "exhibit").when(main_txt, "main").when(main_htm, "main")
            .when(other, "other").otherwise("exhibit"))


def role_rank(role: Column) -> Column:
    return F.when(role == "main", 0).when(role == "other", 1).otherwise(2)


def classify_documents(docs: DataFrame) -> DataFrame:
    """P7 + P8 on an index-document table (``filename``, ``doc_type``)."""
    role = document_role(F.col("filename"), F.col("doc_type"))
    return (docs.withColumn("kind", document_kind(F.col("filename")))
            .withColumn("role", role)
            .withColumn("role_rank", role_rank(F.col("role"))))


def content_extension(content_type: Column, url: Column) -> Column:
    """Saved-file extension from the content type or the URL."""
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    return (F.when(ct.contains("html") | url.endswith(".htm") | url.endswith(".html"), ".html")
            .when(ct.contains("pdf") | url.endswith(".pdf"), ".pdf")
            .otherwise(".txt"))


# ---------------------------------------------------------------------------
# W2, J3a, A4
# ---------------------------------------------------------------------------
def main_documents(docs: DataFrame) -> DataFrame:
    """Per accession the first document by (role main<other<exhibit, page order).

    ``min_by`` over a struct is a partial aggregate, so it is combined
    map-side and never buffers a whole accession in one task.
    """
    c = classify_documents(docs)
    pick = F.min_by(F.struct("filename", "url", "doc_type", "role", "pos"), F.struct("role_rank", "pos"))
    return (c.groupBy("accession").agg(pick.alias("m"))
            .select("accession", "m.filename", "m.url", "m.doc_type", "m.role", F.col("m.pos").alias("pos")))


def default_document(accession: Column, cik: Column) -> tuple[Column, Column]:
    """File name and URL of the row used when an index page lists nothing usable."""
    name = F.concat(accession, F.lit(".txt"))
    url = F.concat_ws("/", F.lit(f"{ARCHIVE_HOST}/Archives/edgar/data"), cik, accession, name)
    return name, url


def ordered_documents(docs: DataFrame) -> DataFrame:
    """O2: main, then other, then exhibit documents, page order kept inside each role.

    ``order_pos`` numbers the documents of one filing; a filing's index page is
    small, so the per-accession window is bounded.
    """
    c = classify_documents(docs)
    w = Window.partitionBy("accession").orderBy("role_rank", "pos")
    return c.withColumn("order_pos", F.row_number().over(w))


def filings_per_company(filings: DataFrame, form: str | None = None) -> DataFrame:
    """A2: number of listed filings per company (optionally of one form)."""
    df = filings if form is None else filings.where(F.col("form") == form)
    return df.groupBy("cik").agg(F.count(F.lit(1)).alias("n_filings"))


def role_counts(docs: DataFrame) -> DataFrame:
    """A4: documents per role per filing."""
    c = classify_documents(docs)
    return c.groupBy("accession").agg(
        F.count_if(F.col("role") == "main").alias("n_main"),
        F.count_if(F.col("role") == "other").alias("n_other"),
        F.count_if(F.col("role") == "exhibit").alias("n_exhibit"),
        F.count(F.lit(1)).alias("n_documents"))


# ---------------------------------------------------------------------------
# J2, J3, A3, A6
# ---------------------------------------------------------------------------
def company_filings(companies: DataFrame, filings: DataFrame, form: str = "10-K", n: int = 5) -> DataFrame:
    """J2 + W1: the latest ``n`` filings of ``form`` for each company; only the companies asked for are ranked."""
    wanted = filings.join(companies.select("cik").distinct(), "cik", "left_semi")
    return companies.join(latest_filings(wanted, form, n), "cik", "inner")


def attach_text(chosen: DataFrame, landed: DataFrame, docs: DataFrame) -> DataFrame:
    """The landed submission text where there is one, else the filing's main index document.

    ``chosen`` has ``ticker, cik, accession, filingDate`` and any other columns (``rank``, ``req_pos``), which stay;
    ``landed`` has ``cik, accession, content``, one row per filing; ``docs`` is the index-document table.  Only documents of
    chosen filings without landed text are classified and grouped.  A filing with neither gets the J3a default row,
    and ``content`` is null wherever nothing has landed.

    Everything but the text is resolved on keys alone.  ``landed`` is pruned to the chosen keys where it is read, and one
    join then brings the text: ``content`` crosses one exchange, and only that of chosen filings.
    """
    key = ["cik", "accession"]
    keys = chosen.select(*key).distinct()
    held = prune_to_keys(landed, keys, key)
    bare = keys.join(held.select(*key), key, "left_anti")
    mains = main_documents(docs.join(bare.select("accession").distinct(), "accession", "left_semi")).select(
        "accession", F.col("filename").alias("doc_file"), F.col("url").alias("doc_url"))
    resolved = chosen.join(mains, "accession", "left")
    j = resolved.join(held.select(*key, "content", F.lit(True).alias("landed")), key, "left")
    dflt_name, dflt_url = default_document(F.col("accession"), F.col("cik"))
    here = F.col("landed").isNotNull()
    more = [c for c in chosen.columns if c not in ("ticker", "cik", "accession", "filingDate")]
    return j.select(
        "ticker", "cik", "accession", "filingDate",
        F.when(here, "submission").otherwise("index").alias("source"),
        F.when(here, F.concat(F.col("accession"), F.lit(".txt")))
        .otherwise(F.coalesce("doc_file", dflt_name)).alias("document"),
        F.when(here, F.concat_ws("/", F.lit(f"{ARCHIVE_HOST}/Archives/edgar/data"), F.col("cik"),
                                 F.regexp_replace("accession", "-", ""),
                                 F.concat(F.col("accession"), F.lit(".txt"))))
        .otherwise(F.coalesce("doc_url", dflt_url)).alias("url"),
        report_file_name(F.col("ticker"), F.col("filingDate")).alias("file_name"), "content", *more)


def reports_per_ticker(requested_known: DataFrame, reports: DataFrame) -> DataFrame:
    """A3: ordered report list and count per requested ticker; zero allowed."""
    per = reports.groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.struct("rank", "file_name"))).alias("l"))
    return (requested_known.select("ticker", "req_pos").join(per, "ticker", "left")
            .select("ticker", "req_pos",
                    F.coalesce(F.transform("l", lambda x: x["file_name"]), F.array().cast("array<string>"))
                    .alias("files"),
                    F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n_reports")))


def run_summary(requested_known: DataFrame, reports: DataFrame) -> DataFrame:
    """Per-ticker count plus the grand total (``ticker`` NULL), with a 'none' marker."""
    counts = (requested_known.select("ticker").join(reports.select("ticker", "file_name"), "ticker", "left")
              .rollup("ticker").agg(F.count("file_name").alias("n_reports")))
    return counts.select(
        "ticker", "n_reports",
        F.when(F.col("ticker").isNull(), "total")
        .when(F.col("n_reports") == 0, "no reports downloaded").otherwise("reports").alias("status"))
