"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set), BENCH_REPEAT (default 3).
Each query is executed in full with the ``noop`` sink (no collect); it runs
once unmeasured (JIT and codegen warm-up: a long job runs warm), then the
reported time is the best of BENCH_REPEAT runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["assemble_report", "clean_section", "split_sections", "html_to_text", "render_html",
            "paragraphs", "latest_filings", "main_document", "filing_text_fallback", "company_dedup",
            "main_slice", "index_parse", "pure_html"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))

    from quillspark.plans.queries import QUERIES
    from quillspark.session import build_session

    spark = build_session(f"local[{cpus}]", app="quillspark-bench", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g", "quillspark.input.partitions": cpus})
    # warm-up: JVM start, parquet footers, codegen caches
    QUERIES["latest_filings"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for n in names:
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[n] = round(best, 3)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n_docs = docs.count()
    mb = sum(os.path.getsize(os.path.join(sf_dir, f)) for f in os.listdir(sf_dir)
             if f.startswith("documents")) / 1e6
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total_sec", "value": total, "unit": "sec", "queries": times, "sf": sf,
           "cpus": int(cpus),
           "documents_per_sec_assemble": round(n_docs / times["assemble_report"], 1)
           if times.get("assemble_report") else None,
           "documents_parquet_mb": round(mb, 2)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
