"""Benchmark the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The company table (sites stay in long form) and the postcode directory are derived from the
driver's tables once per application and written to the shared folder (the counterparts of the
files the reference reads); that step is timed as ``prepare_tables`` (best of ``BENCH_REPEAT``
derive-and-write runs, each into new folders) and counted in the total. The queries run the one
plan that any size of directory gets. Each headline query is then built and
run to completion (``collect`` of the area table); the best of ``BENCH_REPEAT`` runs is
reported. Before timing, the same plans run once on the smallest tables (``BENCH_WARMUP_DIR``,
default sf0.001) so that JIT and code generation are warm; that run is not counted.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = [
    ("A1_national_totals", "national_totals"),
    ("A5_la_registered_totals", "la_registered_totals"),
    ("A15_la_sites_totals", "la_sites_totals"),
    ("A21_itl2_sites_totals", "itl2_sites_totals"),
    ("A25_la_code_totals", "la_code_totals"),
    ("M9_map_la_sites", "map_la_sites"),
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from areastats.plans.registry import QUERIES
    from areastats.session import local_session

    from areastats.sources.fixtures import fixtures

    spark = local_session(cpus=cpus)
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir) and warm_dir.rstrip("/") != sf_dir:
        for _, name in HEADLINE:                              # warm-up, not counted
            QUERIES[name](spark, warm_dir).collect()
    times: dict[str, float] = {}
    fx = fixtures(spark, sf_dir)
    best = float("inf")
    for _ in range(repeat):                                   # derive + write (best of N)
        t0 = time.perf_counter()
        fx.prepare()
        best = min(best, time.perf_counter() - t0)
    times["prepare_tables"] = round(best, 3)
    for label, name in HEADLINE:
        best = float("inf")
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).collect()
            best = min(best, time.perf_counter() - t0)
        times[label] = round(best, 3)
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
