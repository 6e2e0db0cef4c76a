"""Time the headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR.

Each query runs to completion through the ``noop`` sink (every row computed,
nothing collected). Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from prefeval.plans.queries import QUERIES  # noqa: E402
from prefeval.session import get_session  # noqa: E402

HEADLINE = [
    "e5_accuracy", "e9_bias_severity", "e6_bootstrap_ci", "e7_seed_statistics", "e8_paired_ttest",
    "j2_render_default", "j7_fit_token_budget", "j10_limit_pairs",
    "p5_prepare_preferences", "p13_locate_span", "p18_prefilter_long",
    "l1_detect_language", "m1_length_ttr", "m2_token_nll", "m5_quantile_edges", "m8_proxy_labels",
    "m12_vector_moments", "m15_dependence_audit", "t3_label_tokens", "t6_pack_batches",
    "g1_ema", "g4_inverse_ema_weights", "r3_latest_status",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in HEADLINE if n in QUERIES]
    if len(sys.argv) > 1:
        names = [n for n in sys.argv[1:] if n in QUERIES]
    spark = get_session(f"local[{cpus}]", partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "16g"),
                               "spark.prefeval.read.partitions": cpus})      # files of one row group
    # JVM start, class loading and first code generation are paid once here
    # (a small scan + aggregate + Python worker start), not by the first query
    t0 = time.time()
    spark.read.parquet(f"{root}/region.parquet").groupBy("r_name").count() \
        .write.format("noop").mode("overwrite").save()
    spark.range(64).mapInPandas(lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    warmup = round(time.time() - t0, 3)
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", root)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else root, "warmup_sec": warmup}))
    spark.stop()


if __name__ == "__main__":
    main()
