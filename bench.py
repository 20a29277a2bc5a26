"""Headline-query timings: prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is run to completion with a no-op sink (full evaluation, nothing collected):
once cold (reported under "cold") and once warm (reported under "queries"; JIT-compiled
code and started Python workers are reused, as in a long-running job).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["validate_and_repair", "exact_dedup", "near_dedup", "near_dedup_lsh", "chunk_text", "running_best",
            "reply_parse"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from chatloom.session import clear_scratch, get_spark
    from chatloom.plans.registry import QUERIES

    spark = get_spark(f"local[{cpus}]", app="chatloom-bench", partitions=int(cpus))
    names = sys.argv[1:] or HEADLINE
    # warm-up: JVM start, first parquet reads, Python workers
    spark.read.parquet(f"{sf_dir}/conversations.parquet").write.format("noop").mode("overwrite").save()
    cold, warm = {}, {}
    for name in names:
        for bucket in (cold, warm):
            t0 = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            bucket[name] = round(time.time() - t0, 3)
            clear_scratch(spark)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_warm", "value": round(sum(warm.values()), 3), "unit": "sec",
                      "queries": warm, "cold": cold, "cold_total": round(sum(cold.values()), 3),
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
