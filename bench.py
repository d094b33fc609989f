"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = ["tfidf_topk", "bm25_topk", "rrf_hybrid", "retrieval_metrics", "dense_topk", "length_num_strata", "downstream_aggregate", "ranker_eval", "typed_greedy", "bootstrap_ci", "stratified_split", "event_windows"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from gleaner import plans
    from gleaner.session import session

    spark = session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    found, times = plans.queries(), {}
    found["tfidf_topk"](spark, sf).write.format("noop").mode("overwrite").save()  # the session is warm from here on
    for name in HEADLINE:
        began = time.time()
        found[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    extra = {f"{k}_ms_per_query": round(1000 * times[k] / max(queries, 1), 2) for k in ("tfidf_topk", "bm25_topk")}
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "median": round(statistics.median(times.values()), 3), "sf": sf.rstrip("/").rpartition("sf")[2], **extra}))
    spark.stop()
    sys.stdout.flush()


if __name__ == "__main__":
    main()
