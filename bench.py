"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import catalog
from tidemark.session import local_session

HEADLINE = (
    "t1_canonical_prices", "t5_dense_grid", "p7_bulk_as_of", "r3_rolling", "r14_flow_features",
    "f8_factor_panel", "x4_treatment", "x7_quintile_weights", "i2_rank_ic", "i5_ic_table",
    "i12_experiments", "b8_backtest_summary", "v8_overfitting_probability", "s2_composite",
    "s14_trades", "q7_all_checks", "m3_formula_values", "io15_keyed_upsert",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus))
    catalog.load_all()
    catalog.QUERIES["t1_canonical_prices"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
