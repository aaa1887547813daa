"""One file per row (K1, K2, K3): a Spark data source writer with temporary files, commit and abort.

Each task writes its rows to a folder of its own under ``<root>/_temporary/<job>``; when all are written it moves them to their
places, one atomic rename a file.  So a file is there whole or not at all, and a task that is killed, retried or run twice
leaves each file once.  Only counts go to the driver.  The job's end removes the temporary folder, and last of all writes
``_SUCCESS``, which a failed job does not have: files that its finished tasks moved stay, and the next run replaces them.
A task that outlives the end of its failed job may leave temporary files, which nothing reads.

``root`` is a folder that driver and executors share: a path, or a URI that ``pyarrow.fs`` opens.  A move is atomic where
the file system's rename is (on object stores it is a copy).

Defined cases: a null text gives no file, an empty one an empty file; a path that is null or empty, leaves the root, or is one
of the writer's own names fails the job; paths that occur twice, with a text or not, raise ValueError before anything is written; texts are UTF-8;
an empty table writes ``_SUCCESS`` alone; other columns are not read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .._ship import ship_package

TEMPORARY, DONE = "_temporary", "_SUCCESS"


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class TextFiles(DataSource):
    """Write-only source ``text_files``: rows (path relative to option ``root``, text)."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def writer(self, schema, overwrite: bool) -> TextFileWriter:
        return TextFileWriter(self.options["root"], self.options["job"])


class TextFileWriter(DataSourceWriter):
    def __init__(self, root: str, job: str):
        self.root, self.job = root, job

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def write(self, iterator) -> Written:
        files, root = self._open()
        own = f"{root}/{TEMPORARY}/{self.job}/{uuid.uuid4().hex}"      # of this attempt alone
        files.create_dir(own, recursive=True)
        targets, size = [], 0
        for path, text in iterator:
            if text is None:
                continue
            _check(path)
            data = text.encode("utf-8")
            with files.open_output_stream(f"{own}/{len(targets)}", compression=None) as out:
                out.write(data)
            targets.append(path)
            size += len(data)
        for folder in sorted({p.rpartition("/")[0] for p in targets}):
            files.create_dir(f"{root}/{folder}" if folder else root, recursive=True)
        for k, path in enumerate(targets):
            files.move(f"{own}/{k}", f"{root}/{path}")
        files.delete_dir(own)
        return Written(len(targets), size)

    def commit(self, messages) -> None:
        files, root = self._clear()
        done = [m for m in messages if m is not None]
        with files.open_output_stream(f"{root}/{DONE}", compression=None) as out:
            out.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.size for m in done)}).encode())

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> tuple[fs.FileSystem, str]:
        """Removes this job's temporary files, and their parent when no other job's are in it."""
        files, root = self._open()
        files.create_dir(root, recursive=True)
        for folder in (f"{root}/{TEMPORARY}/{self.job}", f"{root}/{TEMPORARY}"):
            there = files.get_file_info(folder).type == fs.FileType.Directory
            if there and (folder.endswith(self.job) or not files.get_file_info(fs.FileSelector(folder))):
                files.delete_dir(folder)
        return files, root


def _check(path: str | None) -> None:
    parts = (path or "").split("/")
    if any(p in ("", ".", "..") for p in parts) or parts[0] in (TEMPORARY, DONE):
        raise ValueError(f"not a path inside the root: {path!r}")


def write_files(df: DataFrame, root: str, path: str, text: str) -> None:
    """A file for each row of ``df``: column ``path`` (below ``root``: relative, or starting with it) holds its place."""
    spark, base = df.sparkSession, root.rstrip("/")
    inside = F.when(F.startswith(F.col(path), F.lit(base + "/")), F.substring(F.col(path), F.lit(len(base) + 2), F.length(path))) \
        .otherwise(F.col(path))
    rows = df.select(inside.alias("path"), F.col(text).cast("string").alias("text"))
    # the paths alone, counted in partial sums
    twice = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
    if twice:
        raise ValueError(f"{twice['n']} rows have the path {twice['path']!r}")
    files, folder = fs.FileSystem.from_uri(base)
    if files.get_file_info(f"{folder}/{DONE}").type == fs.FileType.File:
        files.delete_file(f"{folder}/{DONE}")
    ship_package(spark)
    spark.dataSource.register(TextFiles)
    rows.write.format(TextFiles.name()).mode("append").option("root", base).option("job", uuid.uuid4().hex).save()
