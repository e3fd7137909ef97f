"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is executed completely with the ``noop`` sink (no driver
collect), after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quill.plans import catalog  # noqa: E402
from quill.session import get_spark  # noqa: E402

HEADLINE = [
    "clean_full", "tokenize_filtered", "text_stats", "batch_analyze", "extract_entities",
    "score_lexicon", "summary_stats", "agg_by_entity_type", "entity_cooccurrence",
    "chart_confidence_box", "auc_ovr", "metric_histograms", "alert_cooldown", "tfidf",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", app="quill-bench", shuffle_partitions=int(cpus) * 2,
                      **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    qs = catalog.queries()
    names = [n for n in HEADLINE if n in qs]
    # warm-up: JVM, Arrow Python workers and parquet footers (small benchmark table)
    from pyspark.sql import functions as F
    from quill.functions.text import clean_text
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").repartition(int(cpus)).select(
        clean_text(F.col("text"))).write.format("noop").mode("overwrite").save()
    qs["text_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
           "documents": docs,
           "clean_texts_per_sec": round(docs / times["clean_full"], 1) if times.get("clean_full") else None,
           "analyze_docs_per_sec": round(docs / times["batch_analyze"], 1) if times.get("batch_analyze") else None}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
