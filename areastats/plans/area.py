"""Area tables: basis x level x scope x metric.

One plan shape, whatever the sizes:

    located rows ─ partial agg by location ─ shuffle ─ state per postcode
                 ─ join directory ─ agg by LA code ─ state per LA
                 ─ join LA lookups ─ [north filter] ─ merge by area

The fact side is aggregated by postcode (or LA code) before it meets any lookup. The
aggregation is partial on every task, so a postcode -- or a company -- holding a third of all
rows collapses into one state per task before any shuffle; the directory join sees at most
one row per distinct postcode and the LA lookups at most one per LA. Joins carry no hint: the
planner and AQE choose by size in bytes. Every state is decomposable (counts and exact sums),
so a fan-out lookup (raw ITL, T3) multiplies states exactly as it would multiply rows.

States come in kinds: ``t`` totals, ``p`` the companies with positive GVA and jobs, ``d``
totals over distinct site rows (D-3). ``location_states`` gives several kinds in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.measures import (UNITS_TYPE, Measure, final_value, merge_state, partial_state, safe_ratio,
                                  to_units)
from ..operators.company import SITE_COLUMNS, positive
from ..operators.locate import BASES, Basis
from ..operators.lookups import NORTH_REGION_CODES, Geography
from ..operators.site_pairs import WEIGHT, distinct_pairs, join_companies, site_companies

# level -> output key column
LEVELS = {"national": None, "region": S.RGN23NM, "la": S.LAD23NM, "itl2": S.ITL221NM,
          "la_code": S.LACODE, "region21": S.RGN21NM}


@dataclass(frozen=True)
class AreaQuery:
    basis: str = "registered"      # registered | sites | la_codes
    level: str = "la"              # national | region | la | itl2 | la_code | region21
    scope: str = "all"             # all | north (before any aggregation, at every level)
    metric: str = "totals"         # totals | gva_per_job | headline
    itl: str = "dedup"             # dedup (J4) | raw (J3)
    distinct_sites: bool = False   # D-3: drop repeated site rows first
    count_name: str | None = None  # override the name of n()

    def __post_init__(self) -> None:
        allowed = {"basis": ("registered", "sites", "la_codes"), "level": tuple(LEVELS),
                   "scope": ("all", "north"), "metric": ("totals", "gva_per_job", "headline"),
                   "itl": ("dedup", "raw")}
        for field_name, values in allowed.items():
            if getattr(self, field_name) not in values:
                raise ValueError(f"AreaQuery.{field_name} must be one of {values}, "
                                 f"not {getattr(self, field_name)!r}")
        if self.level == "la_code" and self.basis != "la_codes":
            raise ValueError("level 'la_code' needs basis 'la_codes'")
        if self.distinct_sites and (self.basis != "sites" or self.metric == "gva_per_job"):
            raise ValueError("distinct_sites applies to the totals of the sites basis")

    @property
    def kind(self) -> str:
        """The kind of state this query finishes."""
        return "p" if self.metric == "gva_per_job" else "d" if self.distinct_sites else "t"


def state_measures(basis: Basis, kind: str) -> list[Measure]:
    if kind == "p":
        # The ratio always uses whole-company GVA and jobs, once per located row
        return [Measure(S.OUT_GVA, S.GVA), Measure(S.OUT_EMPLOYEES, S.EMPLOYEES)]
    return basis.totals


def _count_name(q: AreaQuery) -> str:
    return q.count_name or (S.NO_COMPANIES if q.metric == "gva_per_job" else BASES[q.basis].count_name)


def _finalize(df: DataFrame, key: str | None, q: AreaQuery) -> DataFrame:
    keys = [key] if key else []
    kind, count_name = q.kind, _count_name(q)
    vals = [F.col(f"{kind}_n").alias(count_name)]
    vals += [final_value(m, kind) for m in state_measures(BASES[q.basis], kind)]
    out = df.select(*keys, *vals)
    if q.metric == "gva_per_job":
        out = out.select(*keys, count_name,
                         safe_ratio(F.col(S.OUT_GVA), F.col(S.OUT_EMPLOYEES)).alias(S.GVA_PER_JOB))
    elif q.metric == "headline":
        ratio = safe_ratio(F.col(S.OUT_GVA), F.col(S.OUT_EMPLOYEES)).alias(S.GVA_JOB)
        out = out.select(*keys, count_name, S.OUT_GVA, S.OUT_TURNOVER, S.OUT_EMPLOYEES, ratio,
                         S.OUT_INNOVATE, S.OUT_DEALROOM)
    return out


def _weighted_state(measures: list[Measure], prefix: str, weight, where=None) -> list:
    """As ``partial_state``, each row standing for ``weight`` equal rows."""
    only = (lambda c: c) if where is None else (lambda c: F.when(where, c))
    cols = [F.coalesce(F.sum(only(weight)), F.lit(0)).cast("bigint").alias(f"{prefix}_n")]
    for m in measures:
        u = to_units(F.col(m.source))
        cols.append(F.sum(only(weight.cast(UNITS_TYPE) * u)).cast(UNITS_TYPE).alias(f"{prefix}_s_{m.name}"))
        if m.strict:
            cols.append(F.coalesce(F.sum(only(F.when(u.isNotNull(), weight))), F.lit(0)).cast("bigint")
                        .alias(f"{prefix}_c_{m.name}"))
    return cols


def basis_rows(companies: DataFrame, basis: Basis, kinds: str) -> tuple[DataFrame, bool]:
    """(rows of the basis, whether they carry weights). With kind ``d`` equal site rows are one
    row with a weight; with kind ``p`` alone the others are filtered out (at the scan)."""
    weighted = "d" in kinds
    if weighted:
        kept = [c for c in SITE_COLUMNS if c in companies.columns]
        rows = basis.rows(companies.select(*kept))
        rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(WEIGHT))
    else:
        rows = basis.rows(companies)
    if kinds == "p":
        rows = rows.filter(positive())
    return rows, weighted


def _long_form_states(companies: DataFrame, basis: Basis, kinds: str, pairs: DataFrame) -> tuple[DataFrame, list]:
    """(site rows, state columns) from long-form sites: a measure's exact units are worked out
    once per company and only added up per site."""
    c = site_companies(companies, pairs)
    if kinds == "p":
        c = c.filter(positive())
    sources = sorted({m.source for kind in kinds for m in state_measures(basis, kind)})
    units = {m: f"_u_{m}" for m in sources}
    c = c.withColumns({u: to_units(F.col(m)) for m, u in units.items()} | {"_positive": positive()})
    value = [*units.values(), "_positive"]
    if "d" in kinds:
        rows = distinct_pairs(pairs, c, value)
    else:
        rows = join_companies(pairs, c.select(S.COMPANY_KEY, *value), pairs)
    cols = []
    for kind in kinds:
        only = (lambda x: F.when(F.col("_positive"), x)) if kind == "p" and kinds != "p" else (lambda x: x)
        weight = F.lit(1).cast("bigint") if kind == "d" or "d" not in kinds else F.col(WEIGHT)
        times = (lambda u: u) if kind == "d" or "d" not in kinds else (lambda u: F.col(WEIGHT).cast(UNITS_TYPE) * u)
        cols.append(F.coalesce(F.sum(only(weight)), F.lit(0)).cast("bigint").alias(f"{kind}_n"))
        for m in state_measures(basis, kind):
            u = F.col(units[m.source])
            cols.append(F.sum(only(times(u))).cast(UNITS_TYPE).alias(f"{kind}_s_{m.name}"))
            if m.strict:
                cols.append(F.coalesce(F.sum(only(F.when(u.isNotNull(), weight))), F.lit(0)).cast("bigint")
                            .alias(f"{kind}_c_{m.name}"))
    return rows, cols


def location_states(companies: DataFrame, basis_name: str, kinds: str,
                    site_pairs: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """Mergeable states of the given kinds by location key (postcode, or LA code for the
    ``la_codes`` basis), in one pass over the companies; ``whole``: one state of all rows.

    With ``site_pairs`` (long-form sites: company_key, Postcode) the ``sites`` basis is
    computed without list strings (``operators.site_pairs``); the states are identical.
    """
    basis = BASES[basis_name]
    if basis.name == "sites" and site_pairs is not None:
        rows, cols = _long_form_states(companies, basis, kinds, site_pairs)
        return rows.agg(*cols) if whole else rows.groupBy(basis.location).agg(*cols)
    rows, weighted = basis_rows(companies, basis, kinds)
    cols = []
    for kind in kinds:
        where = positive() if kind == "p" and kinds != "p" else None
        measures = state_measures(basis, kind)
        if weighted:
            weight = F.lit(1).cast("bigint") if kind == "d" else F.col(WEIGHT)
            cols += _weighted_state(measures, kind, weight, where)
        else:
            cols += partial_state(measures, kind, where)
    return rows.agg(*cols) if whole else rows.groupBy(basis.location).agg(*cols)


def area_states(companies: DataFrame, geo: Geography | None, q: AreaQuery,
                site_pairs: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """Located, scoped, mergeable states at LA grain with every lookup column attached.

    ``states`` gives the location states instead of computing them from the companies.
    """
    basis, kind = BASES[q.basis], q.kind
    merged = merge_state(state_measures(basis, kind), kind)
    if states is None:
        states = location_states(companies, q.basis, kind, site_pairs)
    elif kind == "p":
        states = states.filter(F.col("p_n") > 0)       # locations without such a company
    loc = basis.location
    if basis.located_by_la:
        located = states.withColumn(S.LADCD, F.col(loc))
        located = located.groupBy(loc, S.LADCD).agg(*merged)
    else:
        pc = geo.distinct_directory() if kind == "d" else geo.postcode_to_la()
        located = (states.join(pc, states[loc] == pc[S.PCDS], "left")
                   .groupBy(S.LADCD).agg(*merged))
    if q.level in ("region21", "la_code"):
        if q.level == "la_code" and q.scope == "all":
            return located
        lr = geo.la_regions21()
        located = located.join(lr, located[S.LADCD] == lr[S.LAD21CD], "inner").drop(lr[S.LAD21CD])
        return located.filter(F.col(S.RGN21CD).isin(*NORTH_REGION_CODES)) if q.scope == "north" else located
    if q.level in ("region", "la") or q.scope == "north":
        lr = geo.la_regions()
        located = located.join(lr, located[S.LADCD] == lr[S.LAD23CD], "left").drop(lr[S.LAD23CD])
    if q.level == "itl2":
        it = geo.la_itl2(raw=(q.itl == "raw"))
        located = located.join(it, located[S.LADCD] == it[S.LAD23CD], "left").drop(it[S.LAD23CD])
    if q.scope == "north":
        located = located.filter(F.col(S.RGN23CD).isin(*NORTH_REGION_CODES))
    return located


def states_by_area(companies: DataFrame, geo: Geography | None, q: AreaQuery,
                   site_pairs: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """One state per area of the query (the unmatched area under a NULL key)."""
    merged = merge_state(state_measures(BASES[q.basis], q.kind), q.kind)
    key = LEVELS[q.level]
    if key is None and q.scope == "all":
        if states is None:
            return location_states(companies, q.basis, q.kind, site_pairs, whole=True)
        return states.agg(*merged)
    located = area_states(companies, geo, q, site_pairs, states)
    if key is None:
        return located.agg(*merged)
    return located.groupBy(key).agg(*merged)


def area_table(companies: DataFrame, geo: Geography | None, q: AreaQuery,
               site_pairs: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """The area table of one query: one row per area, the unmatched area as a NULL key.

    The DataFrame is not ordered -- a global sort costs a sampling job and a shuffle and is
    presentation only; ``order_by_key`` (R7) gives the published order. ``site_pairs`` gives
    the sites in long form, ``states`` precomputed location states (see ``location_states``).
    """
    by_area = states_by_area(companies, geo, q, site_pairs, states)
    if LEVELS[q.level] is None:
        # no rows at all: n() is 0
        by_area = by_area.fillna(0, subset=[f"{q.kind}_n"])
    return _finalize(by_area, LEVELS[q.level], q)


def area_rollup(companies: DataFrame, geo: Geography | None, q: AreaQuery,
                total_label: str = "Total", matched_only: bool = False,
                site_pairs: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """The area table plus a total row. The facts are aggregated by area first; only those
    few states are rolled up. ``grouping()`` tells the total row from the unmatched (NULL)
    area; the total is labelled afterwards, so an area that is NULL stays NULL.
    """
    rolled = rolled_states(companies, geo, q, matched_only, site_pairs, states)
    key = LEVELS[q.level]
    return _finalize(rolled.withColumn(key, F.when(F.col("_total") == 1, F.lit(total_label))
                                       .otherwise(F.col(key))), key, q)


def rolled_states(companies: DataFrame, geo: Geography | None, q: AreaQuery, matched_only: bool,
                  site_pairs: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """The states of every area and of all together (``_total`` 1)."""
    key = LEVELS[q.level]
    by_area = states_by_area(companies, geo, q, site_pairs, states)
    if matched_only:
        by_area = by_area.filter(F.col(key).isNotNull())
    return by_area.rollup(key).agg(*merge_state(state_measures(BASES[q.basis], q.kind), q.kind),
                                   F.grouping(key).alias("_total"))


def order_by_key(df: DataFrame, key: str) -> DataFrame:
    """Default order, by key with NULL last."""
    return df.orderBy(F.asc_nulls_last(key))


def la_headline_frame(companies: DataFrame, geo: Geography, north: bool = False, geometry: bool = True,
                      states: DataFrame | None = None) -> DataFrame:
    """A25 joined to the 2021 region lookup and the 2021 boundaries (inner joins, by code).

    Aggregated before the joins (as the reference does), so the joins see one row per LA.
    Region lookup and boundaries are reduced to one row per LA before the join (T2, D-2), which
    is what the reference's later ``distinct`` achieves. Without ``geometry`` the boundary file
    gives only its names.
    """
    t = area_table(companies, geo, AreaQuery(basis="la_codes", level="la_code", metric="headline"), states=states)
    lr = geo.la_regions21()
    b = geo.lad_boundary21.select(S.LAD21CD, S.LAD21NM, *([S.GEOMETRY] if geometry else [])).distinct()
    g = (t.join(lr, t[S.LACODE] == lr[S.LAD21CD], "inner").drop(lr[S.LAD21CD])
         .join(b, t[S.LACODE] == b[S.LAD21CD], "inner").drop(b[S.LAD21CD]))
    if north:
        from ..operators.lookups import north_codes_generated
        g = g.filter(F.col(S.RGN21CD).isin(*north_codes_generated()))
    return g


def la_headlines(companies: DataFrame, geo: Geography, north: bool = False,
                 states: DataFrame | None = None, code: bool = False) -> DataFrame:
    """The LA headline table in its published column order (P13); ``code`` adds the
    LA code, in whose order it is published."""
    g = la_headline_frame(companies, geo, north, geometry=False, states=states)
    return g.select(*S.HEADLINE_COLUMNS, *([S.LACODE] if code else []))
