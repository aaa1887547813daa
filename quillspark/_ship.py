"""Make the package importable in Python workers (Arrow UDF / mapInPandas tasks).

On a local master the package is zipped once per SparkContext and added with
``addPyFile``.  On a cluster nothing is written: deploy the package with the
job (``spark-submit --py-files quillspark.zip`` or an installed wheel), as
usual for PySpark code.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()


def ship_package(spark) -> None:
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _shipped or not sc.master.startswith("local"):
        return
    if "quillspark" in (sc.getConf().get("spark.submit.pyFiles", "") or ""):
        _shipped.add(key)
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="quillspark-"), "quillspark.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, dirs, files in os.walk(pkg_dir):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _shipped.add(key)
