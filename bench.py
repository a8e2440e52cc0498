"""Headline timings: prints one JSON line.

BENCH_SF_DIR picks the tables (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tenderlens.session import local_session  # noqa: E402
from tenderlens.workload.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "quality_report", "clean_pipeline", "dedup_contract", "peer_deviation", "anomaly_features",
    "isolation_forest", "lof", "tokenize", "bm25_search", "vector_topk", "vector_ann_topk",
    "rrf_fusion", "hybrid_search", "eval_hybrid", "prepare_training", "ridge", "random_forest",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    names = sys.argv[1:] or HEADLINE
    run(spark, "peer_deviation", sf_dir)  # warm up the JVM and the Python workers
    times = {name: round(run(spark, name, sf_dir), 3) for name in names}
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
