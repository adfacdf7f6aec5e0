"""Warm seconds per headline query. One JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (default: the
headline list; "all" for every registered query), BENCH_RUNS (default 2; the last run counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

from holdfast.plans import catalogue
from holdfast.session import local_session

HEADLINE = """band_rollup band_top_holders band_composition holder_bands log_bin_rollup exact_value_rollup
interval_rollup ordinal_pairs gap_histogram top_pairs block_holdings naive_vs_one_area market_summary
entity_components entity_totals withheld_aggregate name_key rule_classify class_totals headline_concentration
lorenz_gini site_rollup modal_class class_pairs crowded_sites region_rollup point_in_polygon nearest_within
density_grid scalar_totals vintage_by_year key_overlap health_ratios leak_check recount checks_report
ordinal_in_year format_value""".split()


def run(fn, spark, folder) -> float:
    start = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    queries = catalogue.queries()
    names = list(queries) if chosen == "all" else chosen.split() or HEADLINE
    spark = local_session("bench", cpus=cpus, shuffle_partitions=cpus, memory="12g")
    seconds = {}
    for name in names:
        times = [run(queries[name], spark, folder) for _ in range(runs)]
        seconds[name] = round(times[-1], 3)
        print(f"{name} {' '.join(f'{t:.2f}' for t in times)}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
