"""Run the whole job and write every output table.

    python -m areastats --tables-dir /root/testdata/sf0.1 --out /shared/out
    python -m areastats --companies companies.csv --postcodes pcd.csv --wards wards23.csv \\
        --itl lad_itl.csv --lad-boundaries lad23.geojson --itl2-boundaries itl2.geojson \\
        [--wards21 wards21.csv --lad21-boundaries lad21.geojson] --out /shared/out
    python -m areastats --list

``--tables-dir`` runs on the driver's test tables through the fixture views; the file options
read the reference's input files. ``--only a,b`` restricts the outputs; ``--site-lists`` uses
the list strings of the test tables instead of the long-form sites. Intermediate tables go to
``--work-dir`` or ``spark.checkpoint.dir``, which must be set on a cluster.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m areastats")
    ap.add_argument("--tables-dir")
    ap.add_argument("--companies")
    ap.add_argument("--postcodes")
    ap.add_argument("--wards")
    ap.add_argument("--wards21")
    ap.add_argument("--itl")
    ap.add_argument("--lad-boundaries")
    ap.add_argument("--lad21-boundaries")
    ap.add_argument("--itl2-boundaries")
    ap.add_argument("--out")
    ap.add_argument("--only", default="")
    ap.add_argument("--site-lists", action="store_true")
    ap.add_argument("--work-dir", help="folder that all executors share (default: spark.checkpoint.dir)")
    ap.add_argument("--list", action="store_true")
    a = ap.parse_args(argv)

    from .plans.publish import load_inputs, missing_inputs, publish, tables
    if a.list:
        print("\n".join(tables()))
        return 0
    if not a.out or not (a.tables_dir or a.companies):
        ap.error("give --out and either --tables-dir or the input files")

    from pyspark.sql import SparkSession
    builder = SparkSession.builder.appName("areastats").config("spark.ui.enabled", "false")
    if a.work_dir:
        builder = builder.config("spark.checkpoint.dir", a.work_dir)
    spark = builder.getOrCreate()
    pairs = None
    if a.tables_dir:
        from .sources.fixtures import fixtures
        fx = fixtures(spark, a.tables_dir)
        fx.prepare()
        companies, geo = (fx.company() if a.site_lists else fx.company_long()), fx.geography
        pairs = None if a.site_lists else fx.site_pairs()
    else:
        companies, geo = load_inputs(spark, a.companies, a.postcodes, a.wards, a.itl,
                                     a.lad_boundaries, a.itl2_boundaries, a.wards21,
                                     a.lad21_boundaries)
    names = [n for n in a.only.split(",") if n] or None
    for name, lacking in ({} if names else missing_inputs(geo)).items():
        print(f"{name}\tleft out, needs {', '.join(lacking)}", file=sys.stderr)
    for name, path in publish(companies, geo, a.out, names, site_pairs=pairs).items():
        print(f"{name}\t{path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
