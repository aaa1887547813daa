"""Versioned output of the incremental job (R1), size-balanced corpus files (K1), sidecars and summary (K3, K4), stems (K5)."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark import sinks as K
from quillspark.streaming import incremental as R


def _batch(spark, files, rows):
    f = spark.createDataFrame([(x,) for x in files], "submission_id string")
    return f, spark.createDataFrame(rows, "submission_id string, n int")


def _got(spark, out):
    return sorted((r.submission_id, r.n) for r in R.read_results(spark, out).collect())


def test_replays_replace_rows_and_empty_results_remove_them(spark, scratch):
    out = f"{scratch}/out"
    R.commit_batch(*_batch(spark, ["a", "b"], [("a", 1), ("a", 2), ("b", 1)]), out, buckets=4)
    R.commit_batch(*_batch(spark, ["c"], [("c", 1)]), out, buckets=4)
    assert _got(spark, out) == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]
    R.commit_batch(*_batch(spark, ["a", "c"], [("a", 9)]), out, buckets=4)        # c yields nothing now
    assert _got(spark, out) == [("a", 9), ("b", 1)]
    R.compact(spark, out, buckets=4)
    assert _got(spark, out) == [("a", 9), ("b", 1)]
    assert [d for d in os.listdir(out) if d.startswith("generation")] == ["generation=1"]
    R.commit_batch(*_batch(spark, ["b"], []), out, buckets=4)
    assert _got(spark, out) == [("a", 9)]
    R.compact(spark, out, buckets=4)
    R.commit_batch(*_batch(spark, ["a", "d"], [("a", 3), ("d", 4)]), out, buckets=4)
    assert _got(spark, out) == [("a", 3), ("d", 4)]


def test_rows_of_an_attempt_that_was_cut_off_are_not_read(spark, scratch, monkeypatch):
    out = f"{scratch}/out"
    R.commit_batch(*_batch(spark, ["a"], [("a", 1)]), out)
    files, rows = _batch(spark, ["a", "b"], [("a", 2), ("b", 2)])

    class Stop(Exception):
        pass

    def broken(*_):
        raise Stop
    with monkeypatch.context() as m:                       # the list of files is the last write
        m.setattr(type(files), "distinct", lambda self: type("X", (), {"select": broken})())
        with pytest.raises(Stop):
            R.commit_batch(files, rows, out)
    assert _got(spark, out) == [("a", 1)]
    R.commit_batch(files, rows, out)                       # the replay
    assert _got(spark, out) == [("a", 2), ("b", 2)]
    # a compaction that was cut off before its list counts for nothing either
    with monkeypatch.context() as m:
        m.setattr(type(files), "distinct", lambda self: type("X", (), {"select": broken})())
        with pytest.raises(Stop):
            R.compact(spark, out)
    assert _got(spark, out) == [("a", 2), ("b", 2)]
    R.commit_batch(*_batch(spark, ["b"], [("b", 5)]), out)
    R.compact(spark, out)
    assert _got(spark, out) == [("a", 2), ("b", 5)]


def test_ten_thousand_files_make_few_folders(spark, scratch):
    out = f"{scratch}/out"
    ids = spark.range(10_000).select(F.concat(F.lit("/in/f"), F.col("id").cast("string")).alias("submission_id"))
    R.commit_batch(ids, ids.withColumn("n", F.lit(1)), out, buckets=16)
    folders = [d for d, _, _ in os.walk(out)]
    assert sum("bucket=" in d for d in folders) <= 16
    assert R.read_results(spark, out).count() == 10_000


def test_corpus_files_follow_measured_size(spark, scratch):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("T"), (F.col("id") % 40).cast("string"))).alias("ticker"),
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_name"),
        # texts that do not compress: sizes are measured on shuffled bytes
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.sha2(F.concat_ws("-", "id", k), 512)), "")
        .alias("content")).repartition(8)
    wanted = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "512k", "spark.sql.shuffle.partitions": "400"}
    held = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        K.write_corpus(rows, f"{scratch}/corpus")
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    files = {d: len([f for f in os.listdir(f"{scratch}/corpus/{d}") if f.endswith(".parquet")])
             for d in os.listdir(f"{scratch}/corpus") if d.startswith("ticker=")}
    assert files["ticker=HOT"] >= 3
    assert sum(n == 1 for d, n in files.items() if d != "ticker=HOT") >= 0.8 * (len(files) - 1)
    back = spark.read.parquet(f"{scratch}/corpus")
    assert back.count() == 3000 and back.filter("ticker = 'HOT'").count() == 1000


def test_sidecars_and_summary(spark, scratch):
    pages = spark.createDataFrame([("/o/a.html", "<p title='a>b'>x &rarr;</p>  y<script>z</script>"), ("/o/b", None)],
                                  "output_path string, html string")
    got = {r.text_path: r.text for r in K.text_sidecar(pages).collect()}
    assert got == {"/o/a.txt": "x →\ny", "/o/b.txt": None}
    summary = spark.createDataFrame([("AAPL", 2, "reports"), (None, 2, "total")], "ticker string, n_reports long, status string")
    K.write_summary(summary, f"{scratch}/summary")
    back = spark.read.option("header", "true").csv(f"{scratch}/summary")
    assert sorted(map(tuple, back.collect()), key=str) == [("AAPL", "2", "reports"), (None, "2", "total")]


@pytest.mark.parametrize("bits", [27, 15])
def test_stems_that_collide(spark, bits):
    paths = [f"/d{i}/f{i}.txt" for i in range(400)] + [f"/x{i}/hot.txt" for i in range(200)] + ["/a/f1.html", "/b/none", "/a/f1.txt"]
    files = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, k int")
    got = {r.k: (r.pdf_path, r.collides) for r in K.pdf_paths(files, "/out/", log2_bits=bits).collect()}
    stems = [p.rsplit("/", 1)[1].rsplit(".", 1)[0] for p in paths]
    assert got == {i: (f"/out/{s}.pdf", stems.count(s) > 1) for i, s in enumerate(stems)}
