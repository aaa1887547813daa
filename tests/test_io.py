"""S3 decoding, R1 incremental streaming, sinks (K1-K5)."""

import os

from pyspark.sql import functions as F

from quillspark import sinks as K
from quillspark.plans import jobs as J
from quillspark.sources.submissions import read_submissions
from quillspark.streaming.incremental import read_results, run_incremental


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_decode_drops_bad_bytes(spark, scratch):
    _write(f"{scratch}/in/a/one.txt", b"caf\xc3\xa9 \xff\xfe bad\r\nnext\rlast")
    _write(f"{scratch}/in/b/two.txt", "genuine � kept".encode() + b"\xff")
    _write(f"{scratch}/in/b/skip.pdf", b"not text")
    _write(f"{scratch}/in/b/three.txt", b"\xe2\x82A \xf0\x80\x80B \xed\xa0\x80C \xf4\x90\x80\x80 ok \xc3")
    got = {r.file_name: r.content for r in read_submissions(spark, f"{scratch}/in").collect()}
    want_one = b"caf\xc3\xa9 \xff\xfe bad\r\nnext\rlast".decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
    assert set(got) == {"one.txt", "two.txt", "three.txt"} and got["one.txt"] == want_one
    assert got["two.txt"] == "genuine � kept"                     # a genuine U+FFFD stays
    assert got["three.txt"] == "A B C  ok "


def test_incremental_picks_only_new_files(spark, scratch):
    src, out = f"{scratch}/landed", f"{scratch}/out"
    doc = "<DOCUMENT>\n<TYPE>10-K\n<TEXT>\n<html><p>x</p></html>\n</TEXT>\n</DOCUMENT>"
    _write(f"{src}/AAPL/AAPL_2023-11-03_10K.txt", doc.encode())

    def job(df):
        return J.extract_html(df, "2024-01-01 00:00:00")
    assert run_incremental(spark, src, out, job, name="t1", checkpoint=f"{scratch}/ckpt") == 1
    _write(f"{src}/MSFT/MSFT_2023-07-27_10K.txt", doc.encode())
    assert run_incremental(spark, src, out, job, name="t1", checkpoint=f"{scratch}/ckpt") == 1
    assert run_incremental(spark, src, out, job, name="t1", checkpoint=f"{scratch}/ckpt") == 0
    res = read_results(spark, out)
    both = ["AAPL_2023-11-03_10K.txt", "MSFT_2023-07-27_10K.txt"]
    assert sorted(r.file_name for r in res.collect()) == both
    # a new checkpoint converts everything again, one file a batch, and replaces what is there
    assert run_incremental(spark, src, out, job, name="t2", checkpoint=f"{scratch}/ckpt2", max_files=1) == 2
    assert sorted(r.file_name for r in read_results(spark, out).collect()) == both


def test_output_paths(spark):
    df = spark.createDataFrame([("/d/in/AAPL/x.txt",), ("/d/in/y",)], "p string")
    rows = df.select(K.html_path(F.col("p"), "sibling").alias("a"), K.html_path(F.col("p"), "html_subdir").alias("b"),
                     K.html_path(F.col("p"), "mirror", "/d/in").alias("c")).collect()
    assert [tuple(r) for r in rows] == [("/d/in/AAPL/x.html", "/d/in/AAPL/html/x.html", "/d/html/AAPL/x.html"),
                                        ("/d/in/y.html", "/d/in/html/y.html", "/d/html/y.html")]
    pdf = {r.p: r.collides for r in K.pdf_paths(spark.createDataFrame(
        [("/a/r.txt",), ("/b/r.txt",), ("/a/s.txt",)], "p string"), "/out", "p").collect()}
    assert pdf == {"/a/r.txt": True, "/b/r.txt": True, "/a/s.txt": False}


def test_report_names_and_corpus_write(spark, scratch):
    rep = spark.createDataFrame([("AAPL", "AAPL_2023-11-03_10K.txt", 1, "c1"), ("AAPL", "AAPL_2023-11-03_10K.txt", 2, "c2"),
                                 ("MSFT", "MSFT_2023-07-27_10K.txt", 1, "c3")],
                                "ticker string, file_name string, rank int, content string")
    named = K.report_names(rep)
    assert {(r.content, r.overwritten) for r in named.collect()} == {("c1", True), ("c2", False), ("c3", False)}
    K.write_corpus(named.where(~F.col("overwritten")), f"{scratch}/corpus")
    back = spark.read.parquet(f"{scratch}/corpus").where("ticker = 'AAPL'")
    assert [r.content for r in back.collect()] == ["c2"]


def test_cut_lineage_uses_shared_checkpoint_dir(spark):
    from quillspark.session import cut_lineage
    df = spark.range(10).withColumn("y", F.col("id") * 2)
    cut = cut_lineage(df)
    assert cut.count() == 10 and spark.conf.get("spark.checkpoint.dir")
    assert "LogicalRDD" in cut._jdf.queryExecution().analyzed().toString()
