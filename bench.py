"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed completely into Spark's no-op sink (no driver
collection). Prints one JSON line: total seconds plus per-query seconds and
the batch throughput of the per-user / per-cart / per-query operators.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "kpis", "conversion_by_product", "user_profiles", "user_cf", "user_cf_big", "candidates", "recommend",
    "keyword_search", "bm25_search", "hybrid_search", "metadata_candidates", "cart_retrieval",
    "checkout_fallback_chain", "co_cart_weights", "blend_scores", "sequence_samples", "live_kpis",
]
# shown beside the headline total, not in it
MORE = ["semantic_search", "features", "checkout_recs", "nearest_users", "item_similarity_table"]
# what one output unit is, for throughput: query -> (unit, SQL-free counter on the input tables)
UNITS = {"user_cf_big": "users", "recommend": "users", "bm25_search": "queries", "keyword_search": "queries",
         "metadata_candidates": "carts"}


def calibration() -> float:
    """Seconds of a fixed piece of single-core work, so that runs on machines of other speed compare."""
    t0 = time.time()
    x = 1
    for i in range(5_000_000):
        x = (x * 1103515245 + i) % 2147483648
    return round(time.time() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE + MORE
    from shoplens.plans.registry import REGISTRY
    from shoplens.session import get_session
    spark = get_session(f"local[{cpus}]", int(cpus) * 2, app_name="shoplens-bench")
    # warm the JVM / Python workers once on a tiny query
    REGISTRY["kpis"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, outputs = {}, {}
    for name in names:
        t0 = time.time()
        df = REGISTRY[name].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        if name in UNITS:
            key = {"users": "user_id", "carts": "cart_id", "queries": "query_id"}[UNITS[name]]
            if key in df.columns:
                outputs[name] = df.select(key).distinct().count()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    throughput = {f"{n}_{UNITS[n]}_per_sec": round(outputs[n] / times[n], 2) for n in outputs if times[n] > 0}
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(t for n, t in times.items() if n not in MORE), 3), "unit": "sec",
                      "calibration_sec": calibration(),
                      "queries": times, "throughput": throughput, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
