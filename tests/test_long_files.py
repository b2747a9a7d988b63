"""List cells, sectioned files and ordered parts of any length: no whole cell or file in one task."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from areastats import schemas as S
from areastats.operators import explode as X
from areastats.session import scratch_path
from areastats.sources import readers as R
from areastats.sources import sinks as W

CELLS = ["", ",", "A", "A,", ",A", "AB1,CD22,E3", ",,,,", "ABCDEFGHIJ,K", "K,ABCDEFGHIJ", "Ü1,é22,日本,z", "A,B,C,D,E,F,G,H,"]


@pytest.mark.parametrize("piece", [1, 2, 3, 4, 5, 100])
def test_pieces_hold_whole_elements_at_their_positions(spark, piece):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([*CELLS, None])], "id int, Postcodes string")
    got = X.explode_long_cells(df, "Postcodes", "Postcode", position="at", piece=piece)
    assert got.columns == ["id", "Postcode", "at"]
    want = [(i, v, k) for i, c in enumerate(CELLS) for k, v in enumerate(c.split(","))]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_million_sites_in_one_cell_are_spread_over_tasks(spark):
    n = 1_000_000
    cell = spark.range(n).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("id")), lambda x: F.concat(
        F.lit("P"), x.cast("string")))).alias("Postcodes")).select(F.lit(1).alias("id"), F.lit("x").alias("_text"), "Postcodes")
    rows = X.explode_long_cells(cell, "Postcodes", "Postcode", position="at")
    wrong = F.count_if(F.col("Postcode") != F.concat(F.lit("P"), F.col("at").cast("string")))
    got = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), wrong.alias("wrong")).collect()
    assert sum(r.n for r in got) == n and sum(r.wrong for r in got) == 0
    assert len(got) > 4 and max(r.n for r in got) < n / 2


def _sections(text: str, width: int) -> list[tuple]:
    out, section, inside = [], -1, False
    for line in text.splitlines():
        cells = line.split(",")
        if not any(c.strip() for c in cells):
            inside = False
        elif not inside:
            section, inside = section + 1, True
        else:
            out.append((section, cells[0] if cells[0] not in ("", "NA") else None,
                        *[float(c) if c else None for c in cells[1:width]]))
    return out


@pytest.mark.parametrize("chunk", ["24b", "61b", "200b", "128m"])
def test_sections_are_numbered_over_any_number_of_chunks(spark, chunk):
    parts = []
    for s in range(7):
        parts.append("Area,x,y")
        parts += [f"A{i},{i},{s}" for i in range(s * 3 % 8)]
        parts += [",,"] * (1 + s % 3)
    texts = ["\n".join([*[",,"] * lead, *parts]) + "\n" for lead in (0, 2)]
    path = scratch_path(spark, "sections").replace("file:", "")
    os.makedirs(path)
    for i, t in enumerate(texts):
        with open(f"{path}/t{i}.csv", "w") as f:
            f.write(t)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", chunk)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = R.read_formatted_sections(spark, path, ["k", "x", "y"])
        got = sorted(map(tuple, df.collect()), key=str)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert got == sorted((r for t in texts for r in _sections(t, 3)), key=str)
        lines = R.ordered_rows(R.numbered_csv(spark, path, 3)).where("_file like '%t1.csv'").orderBy("_line").collect()
        assert [",".join(v or "" for v in r[:3]) for r in sorted(lines, key=lambda r: r._line)] == texts[1].splitlines()
        assert [r._line for r in lines] == list(range(len(lines)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    rows_window = [l for l in plan.splitlines() if "Window [" in l and "_row" in l]
    assert rows_window and all("_chunk" in l for l in rows_window)   # rows are put in order inside a chunk only


def test_parts_are_in_order_one_after_another(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, None)
                                    .otherwise(F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(5000)).cast("string"))).alias("LAD23NM"),
                                    F.col("id").alias("n")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = W.write_area_table(df, scratch_path(spark, "parts"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    names = sorted(glob.glob(path.replace("file:", "") + "/part-*.csv"))
    sizes = [sum(1 for _ in open(n)) - 1 for n in names]
    assert len(names) > 4 and max(sizes) < 40_000 / 4              # also the hot value takes several parts
    got = [tuple(r) for r in R.read_ordered_parts(spark, path, [S.LAD23NM, "n"]).orderBy("line").collect()]
    assert [r[0] for r in got] == list(range(1, 40_001))
    keys = [(r[1] == "NA", r[1]) for r in got]
    assert keys == sorted(keys)
