"""Geography lookups at their key grain, and the uniqueness guard (S4, S5, D-1, J12).

No lookup carries a broadcast hint: the planner broadcasts by its size estimate in bytes and
AQE re-checks with real sizes at run time; beyond the threshold both sides are shuffled. The
area plans join lookups only to states that are already aggregated, so what is shuffled there
is at most one row per postcode or area.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S

# fixed values: region codes of the three northern regions
NORTH_REGION_CODES = ("E12000001", "E12000002", "E12000003")


def north_codes_generated() -> list[str]:
    """F3's spelling of the same list: ``paste0("E1200000", 1:3)``."""
    return [f"E1200000{i}" for i in range(1, 4)]


class Geography:
    """The lookup tables of one geography release.

    Each table is given as a DataFrame or as a zero-argument function returning one; a
    function is called (once) only when a query needs that table, so building a query never
    analyses lookups it does not use.

    postcodes       pcds, ladcd (and pcd7, pcd8, ladnm where the file has them)
    wards           ward grain, 2023: LAD23CD, LAD23NM, RGN23CD, RGN23NM
    wards21         ward grain, 2021: LAD21CD, LAD21NM, RGN21CD, RGN21NM
    itl             LAD23CD, ITL221CD, ITL221NM, finer than LA
    lad_boundary    LAD23CD, LAD23NM, geometry
    lad_boundary21  LAD21CD, LAD21NM, geometry
    itl2_boundary   ITL221CD, ITL221NM, geometry
    coordinates     pcds, oslaua, pcon, lat, long, lep1
    """

    TABLES = ("postcodes", "wards", "wards21", "itl", "lad_boundary", "lad_boundary21",
              "itl2_boundary", "coordinates")

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]) -> None:
        unknown = set(tables) - set(self.TABLES)
        if unknown:
            raise TypeError(f"unknown lookup tables: {sorted(unknown)}")
        self._sources = tables
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self.TABLES:
            raise AttributeError(name)
        if name not in self._built:
            src = self._sources.get(name)
            if src is None:
                raise AttributeError(f"lookup table {name!r} was not given")
            self._built[name] = src if isinstance(src, DataFrame) else src()
        return self._built[name]

    def _memo(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    # ---- key-grain views (built once per Geography) -----------------------------------
    def postcode_to_la(self) -> DataFrame:
        """pcds -> ladcd, NULL keys removed (a NULL key must not match a NULL postcode)."""
        return self._memo("_pc", lambda: self.postcodes.select(S.PCDS, S.LADCD)
                          .filter(F.col(S.PCDS).isNotNull()))

    def la_regions(self) -> DataFrame:
        """D-1: ward rows reduced to one row per LA (2023)."""
        return self._memo("_lr", lambda: distinct_lookup(
            self.wards, [S.LAD23CD, S.LAD23NM, S.RGN23CD, S.RGN23NM], S.LAD23CD))

    def la_regions21(self) -> DataFrame:
        """The 2021 LA -> region lookup at LA grain (T2 fixed: distinct before the join)."""
        return self._memo("_lr21", lambda: distinct_lookup(
            self.wards21, [S.LAD21CD, S.RGN21CD, S.RGN21NM], S.LAD21CD))

    def distinct_directory(self) -> DataFrame:
        """The directory with exact repeats removed: for D-3, where the reference drops
        repeated rows after its join to the directory."""
        return self._memo("_pc_d", lambda: self.postcodes.filter(F.col(S.PCDS).isNotNull())
                          .distinct().select(S.PCDS, S.LADCD))

    def la_itl2(self, raw: bool = False) -> DataFrame:
        """LA -> ITL2. ``raw=True`` keeps the finer grain, so joined rows multiply (T3, J3);
        the default is de-duplicated (J4)."""
        cols = [S.LAD23CD, S.ITL221CD, S.ITL221NM]
        if raw:
            return self._memo("_itl_raw", lambda: self.itl.select(*cols)
                              .filter(F.col(S.LAD23CD).isNotNull()))
        return self._memo("_itl", lambda: distinct_lookup(self.itl, cols, S.LAD23CD))

    def check_keys(self) -> None:
        """Raise if a lookup that is given has a key with several rows (the reference has no
        such guard and counts a company once per row). The ITL lookup is finer than LA by
        nature and is reduced before use."""
        for name, key in (("postcodes", S.PCDS), ("lad_boundary", S.LAD23NM), ("itl2_boundary", S.ITL221NM),
                          ("lad_boundary21", S.LAD21CD)):
            if self._sources.get(name) is not None:
                assert_unique(getattr(self, name), key, name)
        if self._sources.get("wards") is not None:
            assert_unique(self.la_regions(), S.LAD23CD, "wards")
        if self._sources.get("wards21") is not None:
            assert_unique(self.la_regions21(), S.LAD21CD, "wards21")
        if self._sources.get("itl") is not None:
            assert_unique(self.la_itl2(), S.LAD23CD, "itl")

    def has(self, name: str) -> bool:
        return self._sources.get(name) is not None


def distinct_lookup(df: DataFrame, columns: list[str], key: str | None = None) -> DataFrame:
    """``select(columns) %>% distinct()``; NULL keys dropped so they cannot match."""
    out = df.select(*columns).distinct()
    return out.filter(F.col(key).isNotNull()) if key else out


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys of a lookup with more than one row, and how many rows each has."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
            .filter(F.col("rows") > 1))


def uniqueness_report(lookups: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """J12 over several lookups: one row per lookup with its key and duplicate-key count.

    Each lookup is checked by its own distributed aggregation; the small per-lookup
    results are unioned.
    """
    parts = []
    for name, (df, key) in lookups.items():
        per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
        parts.append(per_key.agg(
            F.lit(name).alias("lookup"), F.lit(key).alias("key"),
            F.count(F.lit(1)).alias("keys"),
            F.count(F.when(F.col("rows") > 1, 1)).alias("duplicate_keys"),
            F.coalesce(F.sum(F.when(F.col("rows") > 1, F.col("rows") - 1)), F.lit(0))
            .cast("bigint").alias("extra_rows")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assert_unique(df: DataFrame, key: str, name: str = "lookup") -> None:
    """Raise if ``key`` is not unique in ``df`` (the guard the reference lacks). NULL keys
    match nothing and may repeat."""
    bad = duplicate_keys(df.filter(F.col(key).isNotNull()), key).limit(1).collect()
    if bad:
        raise ValueError(f"{name}: key {key!r} is not unique, e.g. {bad[0][0]!r} has {bad[0][1]} rows")
