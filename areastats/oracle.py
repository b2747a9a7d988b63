"""Oracle SQL (DuckDB dialect) for every registered query.

Only the base tables are registered in the oracle database, so each statement repeats the
fixture views it needs as CTEs. Sums are plain DECIMAL(38,6) sums, turned into doubles only at
the end.
"""

from __future__ import annotations

# ---- fixture views as CTEs ---------------------------------------------------------------
FX = {
    "fx_site_fact": """fx_site_fact AS (
  SELECT l.l_orderkey, l.l_suppkey, printf('PC%06d', l.l_suppkey) AS pc,
         printf('E%08d', s.s_nationkey) AS la, l.l_extendedprice, l.l_quantity, l.l_discount,
         l.l_tax, l.l_returnflag, l.l_linestatus
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey)""",
    "fx_company": """fx_company AS (
  SELECT o.o_orderkey AS company_key,
         CASE WHEN o.o_orderkey % 97 = 13 THEN NULL WHEN o.o_orderkey % 89 = 7 THEN o.o_orderkey - 1
              ELSE o.o_orderkey END AS Companynumber,
         concat('Company ', CAST(o.o_orderkey AS VARCHAR)) AS Companyname, printf('RC%08d', o.o_custkey) AS Registeredpostcode,
         o.o_totalprice AS BestEstimateCurrentGVA,
         coalesce(f.turnover, 0.0) AS BestEstimateCurrentTurnover,
         coalesce(f.employees, 0.0) AS BestEstimateCurrentEmployees,
         f.innovate AS TotalInnovateUKFunding, f.dealroom_m AS TotalDealroomFundingMillionPounds,
         f.postcodes AS Postcodes,
         CASE WHEN o.o_orderkey % 211 = 5
              THEN (SELECT string_agg(printf('E%08d', n_nationkey), ',' ORDER BY n_nationkey) FROM nation)
              ELSE g.la_codes END AS Localauthoritycodes
  FROM orders o
  LEFT JOIN (SELECT l_orderkey,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS turnover,
      sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0.0 END) AS employees,
      CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) END) AS DOUBLE) AS innovate,
      CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) END) AS DOUBLE) / 1e6 AS dealroom_m,
      string_agg(pc, ',' ORDER BY pc) AS postcodes
    FROM fx_site_fact GROUP BY l_orderkey) f ON o.o_orderkey = f.l_orderkey
  LEFT JOIN (SELECT l_orderkey, string_agg(la, ',' ORDER BY la) AS la_codes
    FROM (SELECT DISTINCT l_orderkey, la FROM fx_site_fact) t GROUP BY l_orderkey) g
    ON o.o_orderkey = g.l_orderkey)""",
    "fx_postcode": """fx_postcode AS (
  SELECT pcds AS pcd7, concat(substr(pcds, 1, 2), ' ', substr(pcds, 3)) AS pcd8, pcds, ladcd, n_name AS ladnm
  FROM (
    SELECT printf('PC%06d', s_suppkey) AS pcds, printf('E%08d', s_nationkey) AS ladcd, s_nationkey AS k
    FROM supplier WHERE s_suppkey % 50 <> 7
    UNION ALL
    SELECT printf('RC%08d', c_custkey), printf('E%08d', c_nationkey), c_nationkey
    FROM customer WHERE c_custkey % 50 <> 7) p LEFT JOIN nation ON n_nationkey = k)""",
    "fx_ward_lookup": """fx_ward_lookup AS (
  SELECT concat('W', CAST(n.n_nationkey * 10 + w.r_regionkey AS VARCHAR)) AS WD23CD,
         printf('E%08d', n.n_nationkey) AS LAD23CD, n.n_name AS LAD23NM,
         concat('E1200000', CAST(r.r_regionkey + 1 AS VARCHAR)) AS RGN23CD, r.r_name AS RGN23NM
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN region w ON w.r_regionkey <= n.n_nationkey % 4)""",
    "fx_ward_lookup21": """fx_ward_lookup21 AS (
  SELECT WD23CD AS WD21CD, LAD23CD AS LAD21CD, LAD23NM AS LAD21NM, RGN23CD AS RGN21CD,
         RGN23NM AS RGN21NM
  FROM fx_ward_lookup WHERE LAD23CD < 'E00000022')""",
    "fx_itl_lookup": """fx_itl_lookup AS (
  SELECT printf('E%08d', n.n_nationkey) AS LAD23CD,
         concat('LAU', CAST(n.n_nationkey * 10 + w.r_regionkey AS VARCHAR)) AS LAU121CD,
         concat('TL', CAST(n.n_regionkey AS VARCHAR), CAST(CAST((n.n_nationkey - n.n_nationkey % 5) / 5 % 2 AS INTEGER) AS VARCHAR)) AS ITL221CD,
         concat('ITL2_', CAST(n.n_regionkey AS VARCHAR), '_', CAST(CAST((n.n_nationkey - n.n_nationkey % 5) / 5 % 2 AS INTEGER) AS VARCHAR)) AS ITL221NM
  FROM nation n JOIN region w ON w.r_regionkey <= n.n_nationkey % 3)""",
    "fx_lad_boundary": """fx_lad_boundary AS (
  SELECT printf('E%08d', n_nationkey) AS LAD23CD, n_name AS LAD23NM,
         concat('{"type":"Point","coordinates":[', CAST(n_nationkey AS VARCHAR), ',', CAST(n_regionkey AS VARCHAR), ']}') AS geometry
  FROM nation
  UNION ALL
  SELECT printf('E%08d', 90 + r_regionkey), concat('EMPTY_', CAST(r_regionkey AS VARCHAR)),
         '{"type":"Point","coordinates":[0,0]}'
  FROM region)""",
    "fx_itl2_boundary": """fx_itl2_boundary AS (
  SELECT DISTINCT ITL221CD, ITL221NM, concat('{"type":"Point","id":"', ITL221CD, '"}') AS geometry
  FROM fx_itl_lookup
  UNION ALL
  SELECT 'TL99', 'ITL2_EMPTY', '{"type":"Point","coordinates":[0,0]}')""",
    "fx_coord": """fx_coord AS (
  SELECT pcds, ladcd AS oslaua, concat('E14', substr(ladcd, 4)) AS pcon, CAST(length(pcds) AS DOUBLE) AS lat,
         CAST(0.5 AS DOUBLE) AS long, concat('E37', substr(ladcd, 4)) AS lep1
  FROM fx_postcode
  UNION ALL
  SELECT pcds, ladcd, concat('E14', substr(ladcd, 4)), CAST(99 AS DOUBLE), CAST(0.5 AS DOUBLE),
         concat('E37', substr(ladcd, 4))
  FROM fx_postcode WHERE pcds LIKE 'PC%3')""",
    # ---- derived views used by many queries --------------------------------------------
    "la_region": """la_region AS (
  SELECT DISTINCT LAD23CD, LAD23NM, RGN23CD, RGN23NM FROM fx_ward_lookup)""",
    "la_region21": """la_region21 AS (
  SELECT DISTINCT LAD21CD, RGN21CD, RGN21NM FROM fx_ward_lookup21)""",
    "itl_dedup": """itl_dedup AS (
  SELECT DISTINCT LAD23CD, ITL221CD, ITL221NM FROM fx_itl_lookup)""",
    "itl_raw": """itl_raw AS (
  SELECT LAD23CD, ITL221CD, ITL221NM FROM fx_itl_lookup)""",
    "lad_boundary21": """lad_boundary21 AS (
  SELECT LAD23CD AS LAD21CD, LAD23NM AS LAD21NM, geometry FROM fx_lad_boundary)""",
    "company_counts": """company_counts AS (
  SELECT *,
    CAST(floor(length(Localauthoritycodes) / 9) AS BIGINT) AS No_LAs,
    CAST(length(Postcodes) - length(replace(Postcodes, ',', '')) + 1 AS BIGINT) AS No_sites,
    coalesce(TotalInnovateUKFunding, 0.0) AS innovate0,
    coalesce(TotalDealroomFundingMillionPounds, 0.0) * 1e6 AS TotalDealroomFunding
  FROM fx_company)""",
    "sites": """sites AS (
  SELECT c.Companynumber, c.Companyname, c.BestEstimateCurrentGVA, c.BestEstimateCurrentEmployees,
    c.BestEstimateCurrentTurnover, c.Localauthoritycodes, c.innovate0, c.TotalDealroomFunding, c.No_LAs, c.No_sites,
    c.BestEstimateCurrentTurnover / c.No_sites AS turn_per_site,
    c.BestEstimateCurrentGVA / c.No_sites AS GVA_per_site,
    c.BestEstimateCurrentEmployees / c.No_sites AS empl_per_site,
    c.innovate0 / c.No_sites AS Innovate_per_site,
    c.TotalDealroomFunding / c.No_sites AS Dealroom_per_site,
    unnest(string_split(c.Postcodes, ',')) AS Postcode
  FROM company_counts c WHERE c.Postcodes IS NOT NULL)""",
    "la_rows": """la_rows AS (
  SELECT c.Companynumber, c.No_LAs,
    c.BestEstimateCurrentTurnover / nullif(c.No_LAs, 0) AS turn_per_LA,
    c.BestEstimateCurrentGVA / nullif(c.No_LAs, 0) AS GVA_per_LA,
    c.BestEstimateCurrentEmployees / nullif(c.No_LAs, 0) AS empl_per_LA,
    c.innovate0 / nullif(c.No_LAs, 0) AS Innovate_per_LA,
    c.TotalDealroomFunding / nullif(c.No_LAs, 0) AS Dealroom_per_LA,
    unnest(string_split(c.Localauthoritycodes, ',')) AS LAcode
  FROM company_counts c WHERE c.Localauthoritycodes IS NOT NULL)""",
    "reg_located": """reg_located AS (
  SELECT c.*, c.TotalDealroomFundingMillionPounds * 1e6 AS TotalDealroomFunding, p.ladcd,
         lr.LAD23NM, lr.RGN23CD, lr.RGN23NM
  FROM fx_company c
  LEFT JOIN fx_postcode p ON c.Registeredpostcode = p.pcds
  LEFT JOIN la_region lr ON p.ladcd = lr.LAD23CD)""",
    "sites_located": """sites_located AS (
  SELECT s.*, p.ladcd, lr.LAD23NM, lr.RGN23CD, lr.RGN23NM
  FROM sites s
  LEFT JOIN fx_postcode p ON s.Postcode = p.pcds
  LEFT JOIN la_region lr ON p.ladcd = lr.LAD23CD)""",
}

# dependencies between the CTEs above
DEPS = {
    "fx_company": ["fx_site_fact"],
    "fx_ward_lookup21": ["fx_ward_lookup"],
    "fx_itl2_boundary": ["fx_itl_lookup"],
    "fx_coord": ["fx_postcode"],
    "la_region": ["fx_ward_lookup"],
    "la_region21": ["fx_ward_lookup21"],
    "itl_dedup": ["fx_itl_lookup"],
    "itl_raw": ["fx_itl_lookup"],
    "lad_boundary21": ["fx_lad_boundary"],
    "company_counts": ["fx_company"],
    "sites": ["company_counts"],
    "la_rows": ["company_counts"],
    "reg_located": ["fx_company", "fx_postcode", "la_region"],
    "sites_located": ["sites", "fx_postcode", "la_region"],
}


def with_ctes(names: list[str], body: str) -> str:
    """``WITH`` clause holding ``names`` and everything they depend on, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(FX[n] for n in order) + "\n" + body


# ---- sums ----------------------------------------------------------------------------------
def pounds(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(38,6))"


def strict_sum(expr: str) -> str:
    return f"CASE WHEN count({expr}) = count(*) THEN CAST(sum({pounds(expr)}) AS DOUBLE) END"


def skip_sum(expr: str) -> str:
    return f"coalesce(CAST(sum({pounds(expr)}) AS DOUBLE), 0.0)"


def ratio(num: str, den: str) -> str:
    return f"({num}) / nullif({den}, 0)"
