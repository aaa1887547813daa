"""Sources S1/S2/S4 and the company/filing operators on hand-written fixtures."""

import json

from pyspark.sql import functions as F

from quillspark.operators import companies as C
from quillspark.operators import filings as FL
from quillspark.sources.companies import company_items_from_payload, read_companies
from quillspark.sources.filings import filings_from_json
from quillspark.sources.index_pages import read_index


def test_company_payload_last_wins(spark):
    payload = json.dumps({
        "0": {"ticker": "AAA", "cik_str": 320193, "title": "First Co"},
        "1": {"ticker": "BBB", "cik_str": 12345678901},          # missing title -> default
        "2": {"ticker": "CCC", "title": "No id"},                 # missing cik_str -> dropped
        "3": [1, 2],                                              # not an object -> dropped
        "4": {"ticker": "AAA", "cik_str": 789, "title": "Second Co"},  # repeated ticker: last wins
    })
    raw = spark.createDataFrame([(payload,)], "value string")
    out = {r["ticker"]: r.asDict() for r in C.dedup_companies(company_items_from_payload(raw)).collect()}
    assert set(out) == {"AAA", "BBB"}
    assert out["AAA"]["cik"] == "0000000789" and out["AAA"]["title"] == "Second Co"
    assert out["AAA"]["first_pos"] == 0  # keeps its first position, as a dict does
    assert out["BBB"]["cik"] == "12345678901" and out["BBB"]["title"] == "Unknown Company"


def _companies(spark):
    rows = [("AAPL", "0000320193", "Apple Inc.", 0), ("MSFT", "0000789019", "Microsoft Corp", 1),
            ("APLE", "0001418121", "Apple Hospitality REIT", 2), ("GOOG", "0001652044", "Alphabet Inc.", 3),
            ("AMZN", "0001018724", "Amazon.com Inc", 4)]
    return spark.createDataFrame(rows, "ticker string, cik string, title string, first_pos long")


def test_search_and_limit(spark):
    co = _companies(spark)
    assert [r.ticker for r in C.search_companies(co, "APPLE", 0).collect()] == ["AAPL", "APLE"]
    assert [r.ticker for r in C.search_companies(co, "a", 2).collect()] == ["AAPL", "AMZN"]
    assert C.search_companies(co, None, None).count() == 5


def test_resolve_and_unknown(spark):
    co = _companies(spark)
    req = spark.createDataFrame([(0, "MSFT"), (1, "aapl"), (2, "NOPE"), (3, "AAPL")], "req_pos int, ticker string")
    assert sorted(r.ticker for r in C.resolve_tickers(req, co).collect()) == ["AAPL", "MSFT"]
    assert sorted(r.ticker for r in C.unknown_tickers(req, co).collect()) == ["NOPE", "aapl"]


def _greedy(companies, terms):
    used, out = set(), []
    for t in terms:
        for tk, title in companies:
            if t.lower() in title.lower() and tk not in used:
                used.add(tk)
                out.append((t.lower(), tk))
                break
    return out


def test_term_selection_is_greedy(spark):
    co = _companies(spark)
    terms = ["apple", "apple", "apple", "inc", "zzz", "corp"]
    got = [(r.term, r.ticker) for r in C.select_companies(co, terms).orderBy("term_pos").collect()]
    ordered = [(r.ticker, r.title) for r in co.orderBy("first_pos").collect()]
    assert got == _greedy(ordered, terms)


def test_filings_payload(spark):
    ok = json.dumps({"filings": {"recent": {
        "form": ["10-K", "10-Q", "10-K/A", "10-K", "10-K", "10-K"],
        "filingDate": ["2024-11-01", "2024-08-01", "2024-02-01", "2023-11-03", "2022-10-28"],
        "accessionNumber": ["a1", "a2", "a3", "a4", "a5", "a6"],
        "primaryDocument": ["d1"]}}})
    rows = [("320193", ok), ("1", json.dumps({"filings": {"recent": {}}})), ("2", json.dumps({"x": 1}))]
    raw = spark.createDataFrame(rows, "cik string, value string")
    f = filings_from_json(raw)
    assert f.count() == 6
    latest = FL.latest_filings(f, "10-K", 3).orderBy("rank").collect()
    assert [r.accession for r in latest] == ["a1", "a4", "a5"]  # 10-K/A is not a 10-K; list order, not date
    assert latest[0].reportDate == latest[0].filingDate and latest[0].size == 0
    last = f.where("accession = 'a6'").first()
    assert last.filingDate == "" and last.primaryDocument == "" and last.cik == "0000320193"


def test_latest_bounded_per_company(spark):
    rows = [("c1", "10-K", i, f"x{i}") for i in range(50)] + [("c2", "10-K", 0, "y")]
    f = spark.createDataFrame(rows, "cik string, form string, pos long, accession string")
    counts = {r.cik: r["count"] for r in FL.latest_filings(f, "10-K", 5).groupBy("cik").count().collect()}
    assert counts == {"c1": 5, "c2": 1}


INDEX_HTML = """<html><body><table class="tableFile" summary="Document Format Files">
<tr><th>Seq</th><th>Description</th><th>Document</th><th>Type</th><th>Size</th></tr>
<tr><td>1</td><td>10-K</td><td><a href="/Archives/edgar/data/1/x/aapl-20230930.htm">aapl-20230930.htm</a></td><td>10-K</td><td>1000</td></tr>
<tr><td>2</td><td>EX-21.1</td><td><a href="/a/ex21.htm">a-ex211.htm</a></td><td>EX-21.1</td><td>50</td></tr>
<tr><td>3</td><td>no link</td><td>plain.htm</td><td>x</td></tr>
<tr><td>only</td><td>three</td><td>cells</td></tr>
<tr><td>4</td><td>Complete submission text file</td><td><a href="/a/0001-23.txt">0001-23.txt</a></td><td></td><td>9</td></tr>
</table></body></html>"""


def test_index_page_rows(spark):
    pages = spark.createDataFrame([("1", "acc", INDEX_HTML)], "cik string, accession string, html string")
    rows = read_index(pages).orderBy("pos").collect()
    assert [r.filename for r in rows] == ["aapl-20230930.htm", "a-ex211.htm", "0001-23.txt"]
    assert rows[0].url == "https://www.sec.gov/Archives/edgar/data/1/x/aapl-20230930.htm"
    assert rows[0].doc_type == "10-K" and rows[0].size == "10-K"  # cell 2 is the type, cell 4 the size column


def test_read_index_roles_and_default(spark):
    pages = spark.createDataFrame([("1", "acc-1", INDEX_HTML), ("2", "acc-2", "<p>no table</p>")],
                                  "cik string, accession string, html string")
    docs = read_index(pages)
    mains = {r.accession: r.filename for r in FL.main_documents(docs).collect()}
    assert mains == {"acc-1": "aapl-20230930.htm", "acc-2": "acc-2.txt"}
    roles = {r.filename: r.role for r in FL.classify_documents(docs).collect()}
    assert roles["a-ex211.htm"] == "exhibit" and roles["0001-23.txt"] == "main"


def test_document_role_rules(spark):
    cases = [("r-10-k.htm", "10-K", "main"), ("ex-21.htm", "EX-21", "exhibit"), ("a.txt", None, "main"),
             ("cover.txt", None, "other"), ("report.html", "Report", "other"), ("pic.jpg", "GRAPHIC", "exhibit"),
             ("x.htm", "EX-99", "exhibit"), ("cert.htm", "x", "other"), ("xbrl-10-k.htm", "x", "other"),
             ("full.dat", "Complete Submission Text File", "main")]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "filename string, doc_type string")
    got = [r.role for r in df.select(FL.document_role(F.col("filename"), F.col("doc_type")).alias("role")).collect()]
    assert got == [c[2] for c in cases]


def test_document_kind(spark):
    names = ["aapl-10k-2023.htm", "x-10-K.htm", "q-10-q.htm", "f-8-k.htm", "other.txt"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    assert [r.k for r in df.select(FL.document_kind(F.col("f")).alias("k")).collect()] == \
        ["other", "10-K", "10-Q", "8-K", "other"]


def test_concept_payload_and_series(spark):
    from quillspark.operators.facts import concept_series, read_concepts
    payload = json.dumps({"cik": 320193, "taxonomy": "us-gaap", "tag": "Assets", "units": {
        "USD": [{"end": "2023-09-30", "val": 3.5e11, "accn": "a2", "fy": 2023, "fp": "FY", "form": "10-K",
                 "filed": "2023-11-03", "frame": "CY2023Q3I"},
                {"end": "2022-09-24", "val": 3.5e11, "accn": "a1", "fy": 2022, "fp": "FY", "form": "10-K",
                 "filed": "2022-10-28"},
                {"end": "2022-09-24", "val": 3.4e11, "accn": "a0", "fy": 2022, "fp": "Q4", "form": "10-Q",
                 "filed": "2022-08-01"}],
        "shares": [{"end": "2023-09-30", "val": 1.0, "filed": "2023-11-03"}]}})
    recs = read_concepts(spark.createDataFrame([(payload,)], "value string"))
    assert recs.count() == 4 and recs.where("frame IS NULL").count() == 3
    out = concept_series(recs, "Assets", "USD").collect()
    assert [(r.end, str(r.filed_date)) for r in out] == [("2022-09-24", "2022-08-01"), ("2022-09-24", "2022-10-28"),
                                                          ("2023-09-30", "2023-11-03")]  # ties broken by filing date


def test_typed_fetches(spark):
    from quillspark.sources.submissions import typed_documents
    rows = [("https://x/a.htm", "text/html; charset=utf-8", b"<p>x</p>"), ("https://x/b", "application/pdf", b"%PDF"),
            ("https://x/c.html", None, b"\xff ok"), ("https://x/d.txt", "text/plain", b"t\r\nu")]
    df = spark.createDataFrame(rows, "url string, content_type string, body binary")
    out = {r.url: (r.ext, r.text) for r in typed_documents(df).collect()}
    assert out["https://x/a.htm"][0] == ".html" and out["https://x/b"][0] == ".pdf"
    assert out["https://x/c.html"] == (".html", " ok") and out["https://x/d.txt"] == (".txt", "t\nu")


def test_selection_summary_job(spark):
    from quillspark.plans.jobs import selection_summary
    co = _companies(spark)
    filings = spark.createDataFrame(
        [("0000320193", "10-K", 0, "2023-11-03", "acc-1", 1), ("0000320193", "10-K", 1, "2022-10-28", "acc-2", 2),
         ("0000789019", "10-Q", 0, "2023-10-24", "acc-3", 3)],
        "cik string, form string, pos long, filingDate string, accession string, order_key long")
    landed = spark.createDataFrame([("0000320193", "acc-1", "text")], "cik string, accession string, content string")
    docs = spark.createDataFrame([("acc-2", 1, "a-10-k.htm", "10-K", "u2")],
                                 "accession string, pos int, filename string, doc_type string, url string")
    out = {r.ticker: (r.n_reports, r.status) for r in selection_summary(
        co, ["apple", "microsoft"], filings, landed, docs).collect()}
    assert out == {"AAPL": (2, "reports"), "MSFT": (0, "no reports downloaded"), None: (2, "total")}


def test_cik_key_variant_is_opt_in(spark):
    payload = json.dumps({"0": {"ticker": "AAPL", "cik": 320193, "title": "Apple Inc."},
                          "1": {"ticker": "MSFT", "cik_str": 789019, "title": "Microsoft Corp"}})
    raw = spark.createDataFrame([(payload,)], "value string")
    strict = {r.ticker for r in C.dedup_companies(company_items_from_payload(raw)).collect()}
    loose = {r.ticker: r.cik for r in C.dedup_companies(company_items_from_payload(raw, accept_cik_key=True)).collect()}
    assert strict == {"MSFT"} and loose == {"AAPL": "0000320193", "MSFT": "0000789019"}


def test_corpus_build_end_to_end(spark):
    from quillspark.plans.jobs import corpus_build
    companies = spark.createDataFrame([("AAPL", "0000320193", "Apple Inc.")], "ticker string, cik string, title string")
    requested = spark.createDataFrame([(0, "AAPL"), (1, "NOPE")], "req_pos int, ticker string")
    filings = spark.createDataFrame([("0000320193", "10-K", 0, "2023-12-31", "0000320193-23-000106", 7)],
                                    "cik string, form string, pos long, filingDate string, accession string, order_key long")
    landed = spark.createDataFrame([("0000320193", "0000320193-23-000106", "body")],
                                   "cik string, accession string, content string")
    docs = spark.createDataFrame([], "accession string, pos int, filename string, doc_type string, url string")
    out = corpus_build(requested, companies, filings, landed, docs).collect()
    assert [(r.ticker, r.file_name, r.source, r.content) for r in out] == [
        ("AAPL", "AAPL_2023-12-31_10K.txt", "submission", "body")]
    assert out[0].url == ("https://www.sec.gov/Archives/edgar/data/0000320193/000032019323000106/"
                          "0000320193-23-000106.txt")


def test_corpus_build_of_share_classes_and_payload_rows(spark, scratch):
    """Two tickers of one company, filings as S2 makes them, texts as S3 reads them: one row per ticker and filing."""
    import os

    from quillspark.plans.jobs import corpus_build
    from quillspark.sources.submissions import read_submissions
    companies = spark.createDataFrame([("GOOG", "0001652044", "Alphabet"), ("GOOGL", "0001652044", "Alphabet")],
                                      "ticker string, cik string, title string")
    requested = spark.createDataFrame([(0, "GOOG"), (1, "GOOGL")], "req_pos int, ticker string")
    payload = json.dumps({"filings": {"recent": {"form": ["10-K", "10-K"], "filingDate": ["2024-01-31", "2023-02-03"],
                                                 "accessionNumber": ["0001652044-24-000022", "0001652044-23-000016"]}}})
    filings = filings_from_json(spark.createDataFrame([("1652044", payload)], "cik string, value string"))
    os.makedirs(f"{scratch}/in")
    with open(f"{scratch}/in/one.txt", "w") as f:
        f.write("<SEC-HEADER>\nACCESSION NUMBER:\t0001652044-24-000022\nCENTRAL INDEX KEY:\t1652044\n</SEC-HEADER>\nBody")
    landed = read_submissions(spark, f"{scratch}/in")
    docs = spark.createDataFrame([], "accession string, pos int, filename string, doc_type string, url string")
    out = corpus_build(requested, companies, filings, landed, docs).collect()
    assert sorted((r.ticker, r.req_pos, r.rank, r.source) for r in out) == [
        ("GOOG", 0, 1, "submission"), ("GOOG", 0, 2, "index"), ("GOOGL", 1, 1, "submission"), ("GOOGL", 1, 2, "index")]
    assert all(r.content.endswith("Body") == (r.source == "submission") for r in out if r.content)


def test_master_files_count_in_path_order(spark, tmp_path):
    import json
    files = {"2024-01.json": [("A", 1, "Old A"), ("B", 2, "B one"), ("C", 3, "C")],
             "2024-02.json": [("D", 4, "D"), ("B", 5, "B two"), ("B", 6, "B three")],
             "2024-10.json": [("A", 7, "New A"), ("E", 8, "E")]}
    for name, items in files.items():
        body = {str(i): {"ticker": t, "cik_str": c, "title": title} for i, (t, c, title) in enumerate(items)}
        (tmp_path / name).write_text(json.dumps({**body, "x": [1, 2]}))
    raw = read_companies(spark, str(tmp_path)).repartition(5)
    out = C.dedup_companies(raw)
    assert {r.ticker: r.title for r in out.collect()} == {"A": "New A", "B": "B three", "C": "C", "D": "D", "E": "E"}
    assert [r.ticker for r in out.orderBy("first_pos").collect()] == ["A", "B", "C", "D", "E"]
    assert [(r.term, r.ticker) for r in C.select_companies(out, ["b", "", ""]).orderBy("term_pos").collect()] == \
        [("b", "B"), ("", "A"), ("", "C")]
