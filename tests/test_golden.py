"""Report operators against rows transcribed from the published result tables.

The published tables are the only place where both the input and the output of a report
operator appear; a few of their rows are copied here as literals.
"""

from __future__ import annotations

import os
import tempfile

from areastats import schemas as S
from areastats.plans import report as RP
from areastats.sources import readers as R

# Published region totals over all trading sites (sites, GVA, jobs; rounded as published).
REGION_SITES = [
    ("East Midlands", 3212, 2987913611.0, 31841.0),
    ("East of England", 4796, 4602803423.0, 41950.0),
    ("London", 9529, 9698000355.0, 149610.0),
    ("North East", 2075, 2707152059.0, 24364.0),
    ("North West", 4517, 5221606682.0, 66233.0),
    ("Northern Ireland", 1261, 1263729879.0, 12596.0),
    ("Scotland", 5072, 4399968425.0, 78718.0),
    ("South East", 6850, 9470227703.0, 101375.0),
    ("South West", 5294, 7699966674.0, 76595.0),
    ("Wales", 1987, 1430324034.0, 20327.0),
    ("West Midlands", 3270, 2521136378.0, 33236.0),
    ("Yorkshire and The Humber", 3225, 3554439623.0, 48224.0),
    (None, 244, 149073749.0, 2490.0),
]
SCHEMA = "RGN23NM string, No_sites bigint, GVA double, Employees double"


def _table(spark):
    return spark.createDataFrame(REGION_SITES, SCHEMA)


def test_total_row_with_and_without_unmatched(spark):
    t = RP.add_total_row(_table(spark), S.RGN23NM, [S.NO_SITES, "GVA", "Employees"])
    rows = {r[S.RGN23NM]: r for r in t.collect()}
    assert rows["Total"][S.NO_SITES] == 51332          # published total, NA included
    assert None in rows                               # the unmatched area stays NULL
    t2 = RP.add_total_row(RP.drop_unmatched_area(_table(spark), S.RGN23NM), S.RGN23NM,
                          [S.NO_SITES, "Employees"])
    rows2 = {r[S.RGN23NM]: r for r in t2.collect()}
    assert rows2["Total"][S.NO_SITES] == 51088          # published total without NA
    # the published total sums unrounded values; the rows here are rounded (half a unit each)
    assert abs(rows2["Total"]["Employees"] - 685070.0) <= 0.5 * 12


def test_share_of_total(spark):
    t = RP.share_of_table(_table(spark), S.RGN23NM, [S.NO_SITES, "GVA", "Employees"])
    rows = {r[S.RGN23NM]: r for r in t.collect()}
    # published percentages (1 decimal)
    assert rows["London"][S.NO_SITES] == 18.7
    assert rows["London"]["GVA"] == 17.5
    assert rows["London"]["Employees"] == 21.8
    assert rows["Wales"][S.NO_SITES] == 3.9
    assert rows["Total"]["GVA"] == 100.0
    assert None not in rows


def test_coverage_ratio(spark):
    # fixed values: matched sites and all sites as published
    st = spark.createDataFrame([("matched", 51088), (None, 244)], "RGN23NM string, t_n bigint")
    r = RP.coverage_of(st).first()
    assert (r[S.NO_SITES], r["matched_sites"]) == (51332, 51088)
    assert round(r["coverage"], 8) == 0.99524663


def test_ratio_to_national(spark):
    la = spark.createDataFrame([("Hertsmere", 37, 225020.0)], "LAD23NM string, No_Companies bigint, GVAPerJob double")
    nat = spark.createDataFrame([(13005, 88100.04013952104)], "No_Companies bigint, GVAPerJob double")
    r = RP.ratio_to_national(la, nat).first()
    assert round(r["ratio_to_national"], 2) == 2.55


def test_read_formatted_table(spark):
    text = ("RGN23NM,No_Companies,GVA,InnovateFunding\n"
            'Barnsley, 41 ," 47,611,772 ", -   \n'
            'Blackburn with Darwen, 39 ," 23,494,929 "," 5,000 "\n'
            ",,,\n"
            'NA, 244 ," 149,073,749 "," 449,511 "\n')
    d = tempfile.mkdtemp(prefix="areastats-fmt-")
    p = os.path.join(d, "t.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("﻿" + text)
    t = R.read_formatted_table(spark, p, "RGN23NM")
    t = t.toDF(*[c.lstrip("﻿") for c in t.columns])
    rows = {r["RGN23NM"]: r for r in t.collect()}
    assert len(rows) == 3                               # blank row dropped
    assert rows["Barnsley"]["GVA"] == 47611772.0
    assert rows["Barnsley"]["InnovateFunding"] == 0.0   # " -   " is zero
    assert rows[None]["No_Companies"] == 244.0          # NA area


def test_read_formatted_sections(spark):
    # the layout of the published region table over all sites: totals, then totals without
    # the unmatched area plus a coverage line, then percentages (rows shortened here)
    text = ("RGN23NM,No_sites,GVA\n"
            'London," 9,529 "," 9,698,000,355 "\n'
            'NA, 244 ," 149,073,749 "\n'
            'Total," 51,332 "," 55,706,342,594 "\n'
            ",,\n,,\n,,\n"
            ",No_sites,GVA\n"
            'London," 9,529 "," 9,698,000,355 "\n'
            'Total," 51,088 "," 55,557,268,845 "\n'
            ",0.99524663,\n"
            ",,\n,,\n"
            "Percentage,No_sites,GVA\n"
            "London, 18.7 , 17.5 \n"
            "Total, 100 , 100 \n")
    d = tempfile.mkdtemp(prefix="areastats-sections-")
    p = os.path.join(d, "t.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("﻿" + text)
    t = R.read_formatted_sections(spark, p, ["RGN23NM", "No_sites", "GVA"])
    assert t.columns == ["section", "RGN23NM", "No_sites", "GVA"]
    rows = [tuple(r) for r in t.collect()]
    by = {(s, k): (n, g) for s, k, n, g in rows}
    assert by[(0, "London")] == (9529.0, 9698000355.0)
    assert by[(0, None)] == (244.0, 149073749.0)
    assert by[(1, "Total")] == (51088.0, 55557268845.0)
    assert by[(1, None)] == (0.99524663, None)           # the coverage line
    assert by[(2, "London")] == (18.7, 17.5)
    assert len(rows) == 8                               # 3 + 3 + 2 data rows
