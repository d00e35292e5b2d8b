"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built from the raw parquet tables and executed completely (``noop`` sink: every row is
produced, nothing is collected to the driver). Queries run in one session in the order below, so the
first one builds the processed layer that later ones read (as the pipeline's later steps do).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "topk_products",        # flagship: clean, dedup, enrich, score, cap, label, top-k
    "dedup_keep_first",
    "rank_min_desc",
    "source_quality",
    "kpis",
    "stratified_split",
    "dbscan_anomalies",
    "union_rules",
    "binary_metrics",
    "clean_html",
    "route_agents",
    "chat_history_window",
    "cap_transactions",
    "stream_dedup",
    "label_encode",
    "isolation_forest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("VITRINE_MASTER", f"local[{cpus}]")
    os.environ.setdefault("VITRINE_SHUFFLE_PARTITIONS", str(max(8, int(cpus) * 2)))
    from vitrine import registry
    from vitrine.session import drop_tables, get_session

    spark = get_session(app_name="vitrine-bench")
    registry.load_all()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in registry.QUERIES]
    # warm-up (not timed): JVM start and JIT, Python workers, code generation, run on the smallest
    # table set next to $BENCH_SF_DIR when there is one. Layers are keyed by their input files, so
    # nothing computed here is reused by the timed runs.
    warm_dir = os.path.join(os.path.dirname(os.path.normpath(sf_dir)), "sf0.001")
    if os.path.isdir(warm_dir) and os.path.normpath(warm_dir) != os.path.normpath(sf_dir):
        for name in ("topk_products", "route_agents"):
            registry.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    registry.QUERIES["clean_html"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        df = registry.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    drop_tables(spark)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
