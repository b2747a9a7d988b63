"""Readers and writers on real files in fresh folders under the shared folder."""

from __future__ import annotations

import glob
import os

from areastats import schemas as S
from areastats.session import scratch_path
from areastats.sources import readers as R
from areastats.sources import sinks as W
from areastats.sources.fixtures import fixtures


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def test_area_table_file_format(spark):
    t = spark.createDataFrame([("London", 3, 1.5), (None, 1, None)],
                              "RGN23NM string, No_Companies bigint, GVA double")
    path = W.write_area_table(t, scratch_path(spark, "fmt"), single_file=True)
    parts = glob.glob(os.path.join(_local(path), "part-*.csv"))
    assert len(parts) == 1                                   # one file for an area table
    raw = open(parts[0], encoding="utf-8").read()
    assert raw.startswith("﻿RGN23NM,No_Companies,GVA")   # BOM + header
    assert "NA,1,NA" in raw                                  # missing values as NA
    back = R.read_text_csv(spark, path)
    back = back.toDF(*[c.lstrip(W.BOM) for c in back.columns])
    rows = R.typed(back, {"No_Companies": "bigint", "GVA": "double"}).collect()
    assert sorted(rows, key=lambda r: r[1]) == [(None, 1, None), ("London", 3, 1.5)]


def test_company_csv_round_trip_keeps_every_value(spark, sf_dir):
    c = fixtures(spark, sf_dir).company()
    path = W.write_csv(c, scratch_path(spark, "companies"))
    back = R.scan_companies(spark, path, id_type="bigint")
    assert back.schema.simpleString() == c.schema.simpleString()
    assert back.exceptAll(c).count() == 0 and c.exceptAll(back).count() == 0


def test_geojson_sequence_and_collection(spark, sf_dir):
    b = fixtures(spark, sf_dir).lad_boundary()
    props = [S.LAD23CD, S.LAD23NM]
    seq = W.write_geojson(b, scratch_path(spark, "seq"), props, sequence=True)
    doc = W.write_geojson(b, scratch_path(spark, "doc"), props, sequence=False)
    a = R.scan_boundaries(spark, seq, props, sequence=True)
    d = R.scan_boundaries(spark, doc, props)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert d.exceptAll(b).count() == 0 and b.exceptAll(d).count() == 0


def test_itl_reader_raw_keeps_fan_out(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    path = W.write_csv(fx.itl_lookup(), scratch_path(spark, "itl"))
    raw = R.scan_itl_lookup(spark, path, raw=True)
    dedup = R.scan_itl_lookup(spark, path)
    assert raw.count() == fx.itl_lookup().count()
    assert dedup.count() == dedup.select(S.LAD23CD).distinct().count() < raw.count()
