"""Adapter views: drug-plan shaped tables derived from the driver's test tables.

Each view is one SQL text with ``{table}`` placeholders.  Spark runs it with
``spark.sql(text, table=DataFrame, ...)`` (no global temp views); the DuckDB
oracle runs the very same text as a leading CTE.  Using one text in both
engines is what makes the oracle comparison meaningful: the operators under
test are separate DataFrame code, the inputs are identical.

Rules that keep both engines equal: cast to ``string`` before ``lpad``,
``concat`` rather than ``||`` on numbers, integer ``%``, no ``round``, no
float keys.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _plan_ids(sk: str) -> str:
    """Plan identity columns computed from a supplier key expression."""
    contract = (f"concat(CASE WHEN {sk} % 5 = 0 THEN 'S' ELSE 'H' END, "
                f"lpad(cast(cast(floor({sk} / 1000) AS bigint) AS string), 4, '0'))")
    plan = f"lpad(cast({sk} % 1000 AS string), 3, '0')"
    return f"""
      {contract} AS contract_id,
      {plan} AS plan_id,
      '000' AS segment_id,
      concat({contract}, {plan}, '000') AS plan_key"""


# name -> (sql text, dependencies)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}


def _view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (sql, deps)


_view("plan_info", ("supplier", "nation"), f"""
SELECT {_plan_ids('s.s_suppkey')},
  s.s_name AS contract_name,
  concat(s.s_name, ' Rx Plan') AS plan_name,
  concat('F', lpad(cast(s.s_suppkey % 20 AS string), 3, '0')) AS formulary_id,
  CASE WHEN s.s_suppkey % 23 = 0 THEN NULL ELSE cast(s.s_suppkey % 97 AS double) * 1.25 END AS premium,
  cast(s.s_suppkey % 7 AS double) * 100.0 AS deductible,
  lpad(cast(n.n_regionkey AS string), 2, '0') AS ma_region_code,
  lpad(cast(n.n_regionkey AS string), 2, '0') AS pdp_region_code,
  concat('S', cast(n.n_regionkey AS string)) AS state,
  lpad(cast(n.n_nationkey AS string), 5, '0') AS county_code,
  CASE WHEN s.s_suppkey % 11 = 0 THEN 1 ELSE 0 END AS snp,
  CASE WHEN s.s_suppkey % 17 = 0 THEN 'Y' ELSE 'N' END AS plan_suppressed_yn,
  s.s_suppkey % 5 <> 0 AS is_ma_pd,
  s.s_suppkey % 5 = 0 AS is_pdp
FROM {{supplier}} s
JOIN {{nation}} h ON h.n_nationkey = s.s_nationkey
JOIN {{nation}} n ON n.n_regionkey = h.n_regionkey
WHERE s.s_suppkey % 5 = 0 OR n.n_nationkey = h.n_nationkey
""")

_view("formulary", ("lineitem", "part"), """
SELECT concat('F', lpad(cast(fp.fno AS string), 3, '0')) AS formulary_id,
  '00001' AS formulary_version,
  '2025' AS contract_year,
  cast(p.p_partkey % 500 AS string) AS rxcui,
  lpad(cast(p.p_partkey AS string), 11, '0') AS ndc,
  cast(p.p_size % 7 + 1 AS double) AS tier_level_value,
  CASE WHEN p.p_size % 3 = 0 THEN 'Y' ELSE 'N' END AS quantity_limit_yn,
  CASE WHEN p.p_size % 3 = 0 THEN cast(p.p_size AS double) END AS quantity_limit_amount,
  CASE WHEN p.p_size % 3 = 0 THEN 30 END AS quantity_limit_days,
  CASE WHEN p.p_size % 5 = 0 THEN 'Y' ELSE 'N' END AS prior_authorization_yn,
  CASE WHEN p.p_size % 7 = 0 THEN 'Y' ELSE 'N' END AS step_therapy_yn
FROM (SELECT DISTINCT l_suppkey % 20 AS fno, l_partkey FROM {lineitem}) fp
JOIN {part} p ON p.p_partkey = fp.l_partkey
""")

_view("insulin_ref", ("part",), """
SELECT lpad(cast(p_partkey AS string), 11, '0') AS ndc,
  cast(p_partkey % 500 AS string) AS rxcui,
  'ADAPTER' AS source, 2025 AS source_year, 1 AS is_insulin
FROM {part} WHERE p_partkey % 40 = 0
UNION ALL
SELECT CAST(NULL AS string) AS ndc,
  cast(p_partkey % 500 AS string) AS rxcui,
  'ADAPTER_RXCUI' AS source, 2025 AS source_year, 1 AS is_insulin
FROM {part} WHERE p_partkey % 400 = 20
""")

_view("beneficiary_cost", ("supplier",), f"""
SELECT {_plan_ids('c.sk')},
  c.lvl AS coverage_level,
  cast(c.tier AS double) AS tier,
  c.days AS days_supply,
  (c.sk + c.tier + 0) % 3 AS cost_type_pref,
  CASE (c.sk + c.tier + 0) % 3 WHEN 1 THEN cast((c.sk * 3 + c.tier * 7 + c.days) % 40 + 5 AS double)
       WHEN 2 THEN cast((c.sk + c.tier * 5) % 30 + 10 AS double) ELSE 0.0 END AS cost_amt_pref,
  CASE WHEN c.sk % 4 = 0 THEN NULL ELSE concat('$', cast(c.sk % 5 AS string), '.00') END AS cost_min_amt_pref,
  CASE WHEN (c.sk + c.tier + 0) % 3 = 2 THEN cast(100 + c.tier * 25 AS double) END AS cost_max_amt_pref,
  (c.sk + c.tier + 1) % 3 AS cost_type_nonpref,
  CASE (c.sk + c.tier + 1) % 3 WHEN 1 THEN cast((c.sk * 3 + c.tier * 7 + c.days) % 40 + 10 AS double)
       WHEN 2 THEN cast((c.sk + c.tier * 5) % 30 + 15 AS double) ELSE 0.0 END AS cost_amt_nonpref,
  CASE WHEN c.sk % 4 = 1 THEN NULL ELSE concat('$', cast(c.sk % 7 AS string), '.50') END AS cost_min_amt_nonpref,
  CASE WHEN (c.sk + c.tier + 1) % 3 = 2 THEN cast(150 + c.tier * 25 AS double) END AS cost_max_amt_nonpref,
  (c.sk + c.tier + 2) % 3 AS cost_type_mail_pref,
  CASE (c.sk + c.tier + 2) % 3 WHEN 1 THEN cast((c.sk * 3 + c.tier * 7 + c.days) % 40 + 2 AS double)
       WHEN 2 THEN cast((c.sk + c.tier * 5) % 30 + 8 AS double) ELSE 0.0 END AS cost_amt_mail_pref,
  CASE WHEN c.sk % 4 = 2 THEN NULL ELSE concat('$', cast(c.sk % 3 AS string), '.00') END AS cost_min_amt_mail_pref,
  CASE WHEN (c.sk + c.tier + 2) % 3 = 2 THEN cast(90 + c.tier * 25 AS double) END AS cost_max_amt_mail_pref,
  (c.sk + c.tier + 3) % 3 AS cost_type_mail_nonpref,
  CASE (c.sk + c.tier + 3) % 3 WHEN 1 THEN cast((c.sk * 3 + c.tier * 7 + c.days) % 40 + 12 AS double)
       WHEN 2 THEN cast((c.sk + c.tier * 5) % 30 + 18 AS double) ELSE 0.0 END AS cost_amt_mail_nonpref,
  CASE WHEN c.sk % 4 = 3 THEN NULL ELSE concat(' ', cast(c.sk % 9 AS string), '.25 ') END AS cost_min_amt_mail_nonpref,
  CASE WHEN (c.sk + c.tier + 3) % 3 = 2 THEN cast(160 + c.tier * 25 AS double) END AS cost_max_amt_mail_nonpref,
  CASE WHEN c.tier >= 6 THEN 'Y' ELSE 'N' END AS tier_specialty_yn,
  CASE WHEN (c.sk + c.tier) % 2 = 0 THEN 'Y' ELSE 'N' END AS ded_applies_yn,
  (c.sk + c.tier) % 2 = 0 AS deductible_applies
FROM (
  SELECT s.s_suppkey AS sk, t.tier, d.days, v.lvl
  FROM {{supplier}} s
  CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7)) AS t(tier)
  CROSS JOIN (VALUES (1), (2), (4)) AS d(days)
  CROSS JOIN (VALUES (0), (1), (3)) AS v(lvl)
) c
""")

_view("insulin_cost", ("supplier",), f"""
SELECT {_plan_ids('c.sk')},
  CASE WHEN c.sk % 6 = 0 THEN NULL WHEN c.sk % 6 = 3 THEN '.' ELSE cast(c.sk % 5 + 1 AS string) END AS tier,
  c.days AS days_supply,
  cast(20 + (c.sk + c.days * 7) % 41 AS double) AS copay_amt_pref_insln,
  cast(25 + (c.sk * 3 + c.days) % 36 AS double) AS copay_amt_nonpref_insln,
  CASE WHEN c.sk % 4 = 0 THEN NULL ELSE cast(20 + (c.sk * 5 + c.days) % 21 AS double) END AS copay_amt_mail_pref_insln,
  cast(30 + (c.sk * 7 + c.days) % 31 AS double) AS copay_amt_mail_nonpref_insln,
  least(cast(20 + (c.sk + c.days * 7) % 41 AS double), cast(25 + (c.sk * 3 + c.days) % 36 AS double),
        cast(30 + (c.sk * 7 + c.days) % 31 AS double)) AS min_insulin_copay,
  greatest(cast(20 + (c.sk + c.days * 7) % 41 AS double), cast(25 + (c.sk * 3 + c.days) % 36 AS double),
        cast(30 + (c.sk * 7 + c.days) % 31 AS double)) AS max_insulin_copay
FROM (
  SELECT s.s_suppkey AS sk, d.days
  FROM {{supplier}} s CROSS JOIN (VALUES (1), (2), (4)) AS d(days)
) c
""")

_view("excluded_drugs", ("supplier", "part"), f"""
SELECT {_plan_ids('x.sk')},
  concat('F', lpad(cast(x.sk % 20 AS string), 3, '0')) AS formulary_id,
  cast(x.r AS string) AS rxcui,
  CASE WHEN x.r % 3 = 0 THEN NULL ELSE cast(x.r % 5 + 1 AS double) END AS tier,
  CASE WHEN x.r % 4 = 0 THEN 'Y' ELSE 'N' END AS quantity_limit_yn,
  CASE WHEN x.r % 4 = 0 THEN cast(x.r % 60 AS double) END AS quantity_limit_amount,
  CASE WHEN x.r % 4 = 0 THEN 30 END AS quantity_limit_days,
  CASE WHEN x.r % 2 = 0 THEN 'Y' ELSE 'N' END AS prior_auth_yn,
  CASE WHEN x.r % 6 = 1 THEN 'Y' ELSE 'N' END AS step_therapy_yn,
  CASE WHEN x.r % 9 = 0 THEN 'Y' ELSE 'N' END AS capped_benefit_yn
FROM (
  SELECT s.s_suppkey AS sk, (37 - (s.s_suppkey * 7) % 37) % 37 + 37 * k.k AS r
  FROM {{supplier}} s CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13)) AS k(k)
) x
WHERE x.r IN (SELECT p_partkey % 500 FROM {{part}})
""")

_view("pricing", ("lineitem",), f"""
SELECT {_plan_ids('l.l_suppkey')},
  lpad(cast(l.l_partkey AS string), 11, '0') AS ndc,
  CASE WHEN l.l_quantity >= 40 THEN 90 WHEN l.l_quantity >= 25 THEN 60 ELSE 30 END AS days_supply,
  CASE WHEN l.l_quantity >= 40 THEN 2 WHEN l.l_quantity >= 25 THEN 4 ELSE 1 END AS days_supply_code,
  l.l_extendedprice / l.l_quantity / 100.0 AS unit_cost
FROM {{lineitem}} l
""")

_view("pharmacy_network", ("lineitem", "orders"), f"""
SELECT {_plan_ids('x.sk')},
  lpad(cast(x.ph AS string), 7, '0') AS pharmacy_number,
  lpad(cast(x.ph % 300 AS string), 5, '0') AS pharmacy_zipcode,
  CASE WHEN x.ph % 3 = 0 THEN 'Y' ELSE 'N' END AS preferred_status_retail,
  CASE WHEN x.ph % 7 = 0 THEN 'Y' ELSE 'N' END AS preferred_status_mail,
  CASE WHEN x.ph % 10 <> 9 THEN 'Y' ELSE 'N' END AS pharmacy_retail,
  CASE WHEN x.ph % 5 = 0 OR x.ph % 10 = 9 THEN 'Y' ELSE 'N' END AS pharmacy_mail,
  CASE WHEN x.ph % 4 = 0 THEN 0 ELSE 1 END AS in_area_flag,
  cast(x.ph % 13 AS double) / 4.0 AS floor_price,
  cast(x.ph % 9 AS double) / 4.0 AS brand_dispensing_fee_30,
  CASE WHEN x.ph % 8 = 0 THEN NULL ELSE cast(x.ph % 11 AS double) / 4.0 END AS brand_dispensing_fee_60,
  cast(x.ph % 15 AS double) / 4.0 AS brand_dispensing_fee_90,
  cast(x.ph % 5 AS double) / 4.0 AS generic_dispensing_fee_30,
  CASE WHEN x.ph % 8 = 1 THEN NULL ELSE cast(x.ph % 7 AS double) / 4.0 END AS generic_dispensing_fee_60,
  cast(x.ph % 9 AS double) / 4.0 AS generic_dispensing_fee_90
FROM (
  SELECT DISTINCT l.l_suppkey AS sk, o.o_custkey % 2000 AS ph
  FROM {{lineitem}} l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey
) x
""")

_view("zipcode", ("orders", "nation", "region"), """
SELECT lpad(cast(z.z AS string), 5, '0') AS zip_code,
  concat('CITY_', cast(z.z AS string)) AS city,
  concat('S', cast(n.n_regionkey AS string)) AS state,
  n.n_name AS county,
  25 + cast(z.z * 37 % 2400 AS double) / 100.0 AS lat,
  -125 + cast(z.z * 53 % 5800 AS double) / 100.0 AS lng,
  CASE WHEN z.z % 60 = 0 THEN 0 ELSE z.z * z.z * 13 % 50000 END AS population,
  z.z * 29 % 3000 AS density
FROM (SELECT DISTINCT o_orderkey % 300 AS z FROM {orders}) z
JOIN {nation} n ON n.n_nationkey = z.z % 25
""")

_view("geographic", ("nation", "region"), """
SELECT lpad(cast(n.n_nationkey AS string), 5, '0') AS county_code,
  r.r_name AS statename,
  n.n_name AS county,
  lpad(cast(n.n_regionkey AS string), 2, '0') AS ma_region_code,
  concat('MA REGION ', r.r_name) AS ma_region,
  lpad(cast(n.n_regionkey AS string), 2, '0') AS pdp_region_code,
  concat('PDP REGION ', r.r_name) AS pdp_region,
  CASE WHEN n.n_nationkey % 6 = 0 THEN NULL ELSE concat('S', cast(n.n_regionkey AS string)) END AS state_label
FROM {nation} n JOIN {region} r ON r.r_regionkey = n.n_regionkey
""")

_view("prescriptions", ("orders", "lineitem", "part"), """
SELECT concat('B', lpad(cast(o.o_custkey AS string), 8, '0')) AS bene_synth_id,
  lpad(cast(l.l_partkey AS string), 11, '0') AS ndc,
  cast(l.l_partkey % 500 AS string) AS rxcui,
  p.p_name AS drug_name,
  p.p_type AS drug_synonym,
  p.p_brand AS drug_tty,
  'part' AS drug_name_source,
  cast(count(*) * 4 AS int) AS fills_per_year,
  CASE WHEN max(l.l_quantity) >= 40 THEN 90 WHEN max(l.l_quantity) >= 25 THEN 60 ELSE 30 END AS days_supply_mode,
  avg(l.l_quantity) AS qty_per_fill,
  p.p_size % 7 + 1 AS tier_level,
  CASE WHEN p.p_size % 5 = 0 THEN 1 ELSE 0 END AS has_prior_auth,
  CASE WHEN p.p_size % 7 = 0 THEN 1 ELSE 0 END AS has_step_therapy,
  CASE WHEN p.p_size % 3 = 0 THEN 1 ELSE 0 END AS has_quantity_limit,
  CASE WHEN l.l_partkey % 40 = 0 THEN 1 ELSE 0 END AS is_insulin,
  cast(sum(cast(l.l_extendedprice AS decimal(18,2))) AS double) / 175.0 AS estimated_annual_drug_cost,
  'orders' AS source_mode
FROM {orders} o
JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
JOIN {part} p ON p.p_partkey = l.l_partkey
GROUP BY o.o_custkey, l.l_partkey, p.p_name, p.p_type, p.p_brand, p.p_size
""")

_view("beneficiary", ("customer", "nation", "prescriptions"), """
SELECT concat('B', lpad(cast(c.c_custkey AS string), 8, '0')) AS bene_synth_id,
  concat('S', cast(n.n_regionkey AS string)) AS state,
  lpad(cast(c.c_nationkey AS string), 5, '0') AS county_code,
  lpad(cast((c.c_custkey % 12) * 25 + c.c_nationkey AS string), 5, '0') AS zip_code,
  25 + cast(((c.c_custkey % 12) * 25 + c.c_nationkey) * 37 % 2400 AS double) / 100.0 AS lat,
  -125 + cast(((c.c_custkey % 12) * 25 + c.c_nationkey) * 53 % 5800 AS double) / 100.0 AS lng,
  cast(((c.c_custkey % 12) * 25 + c.c_nationkey) * 29 % 3000 AS double) AS density,
  CASE WHEN rx.total IS NULL THEN NULL WHEN rx.total <= 2000 THEN 'LOW'
       WHEN rx.total <= 5000 THEN 'MED' ELSE 'HIGH' END AS risk_segment,
  cast(rx.n AS int) AS unique_drugs,
  cast(rx.fills AS int) AS fills_target,
  rx.total AS total_rx_cost_est,
  cast(rx.ins AS int) AS insulin_user_flag
FROM {customer} c
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
LEFT JOIN (
  SELECT bene_synth_id, count(*) AS n, sum(fills_per_year) AS fills,
         sum(estimated_annual_drug_cost) AS total, max(is_insulin) AS ins
  FROM {prescriptions} GROUP BY bene_synth_id
) rx ON rx.bene_synth_id = concat('B', lpad(cast(c.c_custkey AS string), 8, '0'))
""")

_view("drug_names", ("part",), """
SELECT cast(p_partkey % 500 AS string) AS rxcui,
  lpad(cast(p_partkey AS string), 11, '0') AS ndc,
  p_name AS drug_name, p_type AS drug_synonym, p_brand AS tty
FROM {part}
""")

# PDE-like claim events: one per line item, dated by ship date.
_view("pde_events", ("orders", "lineitem"), """
SELECT concat('B', lpad(cast(o.o_custkey AS string), 8, '0')) AS bene_id,
  lpad(cast(l.l_partkey AS string), 11, '0') AS prod_srvc_id,
  cast(l.l_shipdate AS date) AS srvc_dt,
  CASE WHEN l.l_quantity >= 40 THEN 90 WHEN l.l_quantity >= 25 THEN 60 ELSE 30 END AS days_suply_num,
  l.l_quantity AS qty_dspnsd_num,
  l.l_linenumber AS fill_num,
  l.l_extendedprice / 25.0 AS tot_rx_cst_amt,
  l.l_extendedprice * l.l_discount / 25.0 AS ptnt_pay_amt,
  CASE WHEN l.l_returnflag = 'R' THEN 'B' ELSE 'G' END AS brnd_gnrc_cd,
  CASE WHEN l.l_linestatus = 'O' THEN '01' ELSE '07' END AS phrmcy_srvc_type_cd,
  concat(cast(l.l_orderkey AS string), '-', cast(l.l_linenumber AS string)) AS claim_id
FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
""")

# Decision-support requests: every customer asks for a recommendation;
# preferences come from keyed arithmetic on the customer key.
_view("requests", ("customer", "nation"), """
SELECT concat('R', lpad(cast(c.c_custkey AS string), 8, '0')) AS request_id,
  concat('B', lpad(cast(c.c_custkey AS string), 8, '0')) AS bene_synth_id,
  concat('S', cast(n.n_regionkey AS string)) AS state,
  lpad(cast(c.c_nationkey AS string), 5, '0') AS county_code,
  lpad(cast((c.c_custkey % 12) * 25 + c.c_nationkey AS string), 5, '0') AS zip_code,
  cast(c.c_custkey % 4 * 25 AS double) AS min_drug_coverage_pct,
  cast(c.c_custkey % 5 * 10 + 20 AS double) AS ml_influence_pct,
  cast(c.c_custkey % 5 + 1 AS double) AS cost_priority,
  cast(c.c_custkey % 3 + 1 AS double) AS access_priority,
  cast(c.c_custkey % 4 + 1 AS double) AS coverage_priority,
  cast(c.c_custkey % 4 * 25 AS double) AS distance_penalty_rate,
  c.c_custkey % 7 = 0 AS local_only,
  cast(25 + c.c_custkey % 4 * 25 AS double) AS max_distance
FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey
""")

# Request medications: each request's prescriptions (whole list, no cap).
_view("request_medications", ("requests", "prescriptions"), """
SELECT r.request_id, p.ndc, p.drug_name, p.fills_per_year, p.days_supply_mode,
  p.tier_level, p.is_insulin, p.estimated_annual_drug_cost AS annual_cost_est
FROM {requests} r JOIN {prescriptions} p ON p.bene_synth_id = r.bene_synth_id
""")


# Indication-based coverage: plan x rxcui x disease (the part type) for every
# (supplier, part) pair that appears in the line items.
_view("indication_coverage", ("lineitem", "part"), f"""
SELECT {_plan_ids('x.sk')},
  cast(x.pk % 500 AS string) AS rxcui,
  x.disease
FROM (
  SELECT DISTINCT l.l_suppkey AS sk, p.p_partkey AS pk, p.p_type AS disease
  FROM {{lineitem}} l JOIN {{part}} p ON p.p_partkey = l.l_partkey
) x
""")

# Drug search queries: each distinct second word of a part name (name search)
# and each distinct 5-digit NDC fragment of a prescribed drug (number search).
_view("drug_queries", ("part", "prescriptions"), """
SELECT DISTINCT split_part(p_name, ' ', 2) AS query_text FROM {part}
UNION ALL
SELECT DISTINCT substring(ndc, 7, 5) AS query_text FROM {prescriptions}
""")


def _order(names: tuple[str, ...] | list[str]) -> list[str]:
    """Views needed for ``names`` in dependency order."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out or n in BASE_TABLES:
            return
        for d in VIEWS[n][1]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def oracle_cte(*names: str) -> str:
    """``WITH v1 AS (...), v2 AS (...)`` prefix for a DuckDB oracle query."""
    parts = []
    for n in _order(names):
        sql, deps = VIEWS[n]
        parts.append(f"{n} AS ({sql.format(**{d: d for d in deps})})")
    return "WITH " + ",\n".join(parts) + "\n"


@dataclass
class Adapter:
    """Lazily built adapter DataFrames for one test-data directory."""

    spark: SparkSession
    sf_dir: str
    _cache: dict[str, DataFrame] = field(default_factory=dict)

    def base(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def over(self, **tables: DataFrame) -> Adapter:
        """The same views, made from the given tables where a view reads them."""
        return Adapter(self.spark, self.sf_dir, {**{n: self.base(n) for n in BASE_TABLES if n in self._cache}, **tables})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS and name not in BASE_TABLES:
            raise AttributeError(name)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        if name not in self._cache:
            sql, deps = VIEWS[name]
            self._cache[name] = self.spark.sql(sql, **{d: self.table(d) for d in deps})
        return self._cache[name]


@functools.lru_cache(maxsize=None)
def view_names() -> tuple[str, ...]:
    return tuple(VIEWS)
