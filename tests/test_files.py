"""One file per row (K1, K2, K3): exact names and texts, commit, abort, retried tasks, refused paths."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark import sinks as K
from quillspark.sinks import files as W


def _tree(root):
    out = {}
    for folder, _, names in os.walk(root):
        for n in names:
            with open(os.path.join(folder, n), encoding="utf-8", newline="") as f:
                out[os.path.relpath(os.path.join(folder, n), root)] = f.read()
    return out


def _kept(root):
    """Without temporary files: tasks may outlive a failed job."""
    return {p: t for p, t in _tree(root).items() if not p.startswith("_temporary/")}


def _rows(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_reports_get_the_names_of_their_ticker_and_date(spark, scratch):
    reports = spark.createDataFrame([("AB", "AB_2024-01-02_10K.txt", 1, "old"), ("AB", "AB_2024-01-02_10K.txt", 2, "new\r\n→"),
                                     ("AB", "AB_2023-01-02_10K.txt", 3, ""), ("C", "C_2024-05-05_10K.txt", 1, "c" * 3_000_000)],
                                    "ticker string, file_name string, rank int, content string").repartition(3)
    K.write_report_files(K.report_names(reports), f"{scratch}/out")
    got = _tree(f"{scratch}/out")
    assert json.loads(got.pop("_SUCCESS")) == {"files": 3, "bytes": len("new\r\n→".encode()) + 3_000_000}
    assert got == {"AB/AB_2024-01-02_10K.txt": "new\r\n→", "AB/AB_2023-01-02_10K.txt": "", "C/C_2024-05-05_10K.txt": "c" * 3_000_000}


def test_pages_and_sidecars_stand_side_by_side(spark, scratch):
    root = f"{scratch}/out"
    pages = spark.createDataFrame([("/in/x/a.txt", "<p title='a>b'>x &rarr;</p>"), ("/in/b.txt", "<b>y</b>"), ("/in/c.txt", None)],
                                  "path string, html string").withColumn(
        "output_path", K.html_path(F.col("path"), "mirror", "/in", root))
    K.write_page_files(pages, root)
    K.write_sidecar_files(pages, root)
    got = _tree(root)
    assert json.loads(got.pop("_SUCCESS"))["files"] == 2
    assert got == {"x/a.html": "<p title='a>b'>x &rarr;</p>", "b.html": "<b>y</b>", "x/a.txt": "x →", "b.txt": "y"}


def test_a_failed_job_leaves_whole_files_alone_and_the_next_run_replaces_them(spark, scratch):
    root = f"{scratch}/out"
    W.write_files(_rows(spark, [("a/1.txt", "first")]), root, "path", "text")
    texts = spark.range(40).repartition(8).select(
        F.concat(F.lit("a/"), "id", F.lit(".txt")).alias("path"), F.concat(F.lit("text "), "id").alias("text"),
        F.col("id").alias("n"))
    broken = texts.withColumn("text", F.when(F.col("n") == 17, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        spark.dataSource.register(W.TextFiles)
        os.remove(f"{root}/_SUCCESS")
        broken.select("path", "text").write.format("text_files").mode("append").option("root", root).option("job", "j").save()
    got = _kept(root)
    assert "_SUCCESS" not in got and "a/17.txt" not in got
    assert all(t == f"text {p[2:-4]}" or (p, t) == ("a/1.txt", "first") for p, t in got.items())
    W.write_files(texts, root, "path", "text")
    got = _kept(root)
    assert json.loads(got.pop("_SUCCESS"))["files"] == 40
    assert got == {f"a/{i}.txt": f"text {i}" for i in range(40)}


def test_a_task_that_dies_or_runs_twice_leaves_each_file_once(scratch):
    root = f"{scratch}/out"
    writer = W.TextFileWriter(root, "job")

    def dying():
        yield ("a.txt", "whole")
        raise RuntimeError("executor lost")
    with pytest.raises(RuntimeError):
        writer.write(dying())
    assert not os.path.exists(f"{root}/a.txt")
    first = writer.write(iter([("a.txt", "whole"), ("d/b.txt", None)]))
    writer.write(iter([("a.txt", "whole"), ("d/b.txt", None)]))              # a second attempt of the same task
    writer.commit([first])
    assert _tree(root) == {"_SUCCESS": '{"files": 1, "bytes": 5}', "a.txt": "whole"}
    writer.write(iter([("c.txt", "c")]))
    other = W.TextFileWriter(root, "other")
    os.makedirs(f"{root}/_temporary/other/x")
    writer.abort([None])
    assert os.listdir(f"{root}/_temporary") == ["other"]                      # another job's files stay
    other.abort([])
    assert not os.path.exists(f"{root}/_temporary")


@pytest.mark.parametrize("path", [None, "", "/etc/x", "../x", "a//b", "a/./b", "a/..", "_SUCCESS", "_temporary/x"])
def test_paths_outside_the_root_are_refused(scratch, path):
    with pytest.raises(ValueError, match="inside the root"):
        W.TextFileWriter(f"{scratch}/out", "job").write(iter([(path, "x")]))
    assert [p for p in _tree(scratch) if "_temporary" not in p] == []


def test_equal_paths_are_refused_and_empty_tables_are_done(spark, scratch):
    root = f"{scratch}/out"
    with pytest.raises(ValueError, match="2 rows"):
        W.write_files(_rows(spark, [("a", "1"), (f"{root}/a", "2"), ("b", "3")]), root, "path", "text")
    assert not os.path.exists(root)
    W.write_files(_rows(spark, [("a", "1"), ("b", None)]), root, "path", "text")
    assert _tree(root)["a"] == "1" and "b" not in _tree(root)
    clash = _rows(spark, []).withColumnRenamed("path", "p").withColumnRenamed("text", "t").withColumn("path", F.lit(1)).withColumn("text", F.lit(2))
    W.write_files(clash, f"{scratch}/none", "p", "t")
    assert _tree(f"{scratch}/none") == {"_SUCCESS": '{"files": 0, "bytes": 0}'}
