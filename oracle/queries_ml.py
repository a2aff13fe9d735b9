"""Oracle SQL for the ML-feature and legacy-label queries."""

from oracle import gold  # noqa: F401
from oracle.queries_layers import r2  # noqa: F401  (registers o_friendly, o_cost_metrics, o_dim_plan)
from oracle.queries_misc import sf  # noqa: F401
from oracle.registry import cte, register

cte("o_bene_year", ("pde_events", "insulin_ref"), """
SELECT bene_id, count(*) AS fills, count(DISTINCT prod_srvc_id) AS unique_drugs, sum(tot_rx_cst_amt) AS total_rx_cost,
  sum(CASE WHEN ins = 1 THEN 1 ELSE 0 END) AS insulin_fills, sum(CASE WHEN ins = 1 THEN tot_rx_cst_amt ELSE 0.0 END) AS insulin_rx_cost
FROM (SELECT e.*, coalesce(i.ins, 0) AS ins FROM pde_events e
      LEFT JOIN (SELECT DISTINCT ndc, 1 AS ins FROM insulin_ref WHERE ndc IS NOT NULL) i ON i.ndc = e.prod_srvc_id)
GROUP BY 1
""")
# One row per plan with all plan aggregates; numbers are doubles with 0 for nothing, categories UNKNOWN.
cte("o_plan_summary", ("o_dim_plan", "o_formulary_nb", "o_network_nb", "o_pricing_metrics", "o_cost_metrics", "o_friendly"), """
SELECT plan_key, coalesce(contract_type, 'UNKNOWN') AS contract_type, coalesce(state, 'UNKNOWN') AS state,
  coalesce(county_code, 'UNKNOWN') AS county_code, coalesce(snp, 'UNKNOWN') AS snp,
  coalesce(CAST(COLUMNS(* EXCLUDE (plan_key, contract_type, state, county_code, snp)) AS double), 0.0)
FROM (
  SELECT p.plan_key, CASE WHEN p.is_ma_pd THEN 'MA' WHEN p.is_pdp THEN 'PDP' END AS contract_type, p.state, p.county_code,
    CAST(p.snp AS varchar) AS snp, p.premium, p.deductible, f.* EXCLUDE (plan_key), n.* EXCLUDE (plan_key), u.* EXCLUDE (plan_key),
    c.* EXCLUDE (plan_key), i.* EXCLUDE (plan_key)
  FROM o_dim_plan p LEFT JOIN o_formulary_nb f ON f.plan_key = p.plan_key LEFT JOIN o_network_nb n ON n.plan_key = p.plan_key
  LEFT JOIN o_pricing_metrics u ON u.plan_key = p.plan_key LEFT JOIN o_cost_metrics c ON c.plan_key = p.plan_key
  LEFT JOIN o_friendly i ON i.plan_key = p.plan_key
)
""")

INDEX_FEATURES = ("premium", "deductible", "pref_avg_copay_amt", "pref_median_copay_amt", "pref_avg_coins_rate",
                  "nonpref_avg_copay_amt", "ded_applies_rate", "specialty_row_share")
LABEL_FEATURES = ("premium", "deductible", "pref_avg_copay_amt", "pref_p90_copay_amt", "pref_avg_coins_rate", "pref_p90_coins_rate",
                  "ded_applies_rate")


def _z(c, std):
    return f"CASE WHEN coalesce({std}({c}) OVER (), 0) = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER ()) / {std}({c}) OVER () END"


def pca_sql(source, cols, std):
    """(plan_key, affordability_index): the scores on the first principal component of the z-scores.

    The covariance matrix, squared over and over with its trace kept at 1, turns into v v' for the leading
    eigenvector v; the column of the largest diagonal entry gives v with its largest loading positive.
    """
    n = len(cols)
    cov = ", ".join(f"covar_samp(z[{i + 1}], z[{j + 1}])" for i in range(n) for j in range(n))
    return f"""
WITH RECURSIVE zs AS (SELECT plan_key, [{', '.join(_z(f'coalesce(CAST({c} AS double), 0.0)', std) for c in cols)}] AS z FROM {source}),
power AS (
  SELECT 0 AS k, m FROM (SELECT [{cov}] AS m FROM zs)
  UNION ALL
  SELECT k + 1, list_transform(p, lambda x: x / t) FROM (
    SELECT k, p, list_sum(list_transform(range({n}), lambda i: p[i * {n + 1} + 1])) AS t FROM (
      SELECT k, list_transform(range({n * n}), lambda i: list_sum(list_transform(range({n}),
        lambda j: m[(i // {n}) * {n} + j + 1] * m[j * {n} + i % {n} + 1]))) AS p FROM power WHERE k < 40))
),
top AS (
  SELECT m, list_position(d, list_max(d)) AS b FROM (
    SELECT m, list_transform(range({n}), lambda i: m[i * {n + 1} + 1]) AS d FROM power WHERE k = 40)
),
v AS (SELECT list_transform(range({n}), lambda i: m[i * {n} + b] / sqrt(m[(b - 1) * {n + 1} + 1])) AS v FROM top)
SELECT plan_key, list_sum(list_transform(range({n}), lambda i: z[i + 1] * v[i + 1])) AS affordability_index FROM zs, v
"""


cte("o_index", ("o_cost_metrics", "o_dim_plan"), pca_sql(
    "(SELECT c.*, p.premium, p.deductible FROM o_cost_metrics c LEFT JOIN o_dim_plan p ON p.plan_key = c.plan_key)", INDEX_FEATURES, "stddev_pop"))
register("I3_affordability_index", ["o_index"], """
SELECT plan_key, affordability_index,
  CASE WHEN affordability_index <= q[1] THEN 0 WHEN affordability_index <= q[2] THEN 1 WHEN affordability_index <= q[3] THEN 2 ELSE 3 END
    AS affordability_class
FROM o_index, (SELECT quantile_cont(affordability_index, [0.25, 0.5, 0.75]) AS q FROM o_index)
""")
cte("o_label_index", ("o_plan_summary",), pca_sql("o_plan_summary", LABEL_FEATURES, "stddev_samp"))


def _third(c, q):
    return f"CASE WHEN {c} <= {q}[1] THEN 0 WHEN {c} <= {q}[2] THEN 1 ELSE 2 END"


cte("o_plan_labels", ("o_plan_summary", "o_label_index"), f"""
SELECT s.*, x.affordability_index, {_third('x.affordability_index', 'qa')} AS affordability_class,
  {_third('restrictiveness_index', 'qr')} AS restrictiveness_class,
  {_third('insulin_friendliness_score', 'qi')} AS insulin_friendliness_class,
  CASE WHEN preferred_retail_share < 0.20 OR in_area_share < 0.60 THEN 1 ELSE 0 END AS network_adequacy_flag,
  CASE WHEN insulin_exceeds_cap_any_flag = 1 OR insulin_exceeds_cap_rate > 0.05 THEN 1 ELSE 0 END AS insulin_cap_violation_flag,
  CASE WHEN insulin_restrictiveness_index > 20 OR insulin_pa_rate > 0.20 THEN 1 ELSE 0 END AS access_risk,
  {', '.join(_z(c, 'stddev_samp') + f' AS {c}_z' for c in LABEL_FEATURES)}
FROM o_plan_summary s JOIN o_label_index x ON x.plan_key = s.plan_key,
  (SELECT quantile_cont(affordability_index, [0.33, 0.66]) AS qa FROM o_label_index),
  (SELECT quantile_cont(restrictiveness_index, [0.33, 0.66]) AS qr, quantile_cont(insulin_friendliness_score, [0.33, 0.66]) AS qi
   FROM o_plan_summary)
""")
register("I4_affordability_terciles", ["o_plan_labels"], "SELECT plan_key, affordability_index, affordability_class FROM o_plan_labels")
register("I2_label_classes", ["o_plan_labels"], """
SELECT plan_key, restrictiveness_index, restrictiveness_class, insulin_friendliness_score, insulin_friendliness_class FROM o_plan_labels
""")
register("I5_plan_feature_summary", ["o_plan_summary"], "SELECT * FROM o_plan_summary")
register("I1_plan_zscores", ["o_plan_labels"], "SELECT plan_key, " + ", ".join(f"{c}_z" for c in LABEL_FEATURES) + " FROM o_plan_labels")
cte("o_legacy", ("o_bene_year", "beneficiary", "o_active_plans", "o_plan_labels"), """
SELECT *, annual_premium + oop_deductible_component + oop_copay_component + oop_coins_component - oop_insulin_raw
  + oop_insulin_capped + insulin_access_penalty + network_penalty AS y_annual_oop
FROM (
  SELECT *, CASE WHEN insulin_user_flag = 1 AND coalesce(insulin_risk_flag, 0) = 0 THEN least(oop_insulin_raw, 420.0)
                 ELSE oop_insulin_raw END AS oop_insulin_capped,
    CASE WHEN insulin_user_flag = 1 AND coalesce(insulin_access_risk_flag, 0) = 1 THEN 150.0 ELSE 0.0 END AS insulin_access_penalty,
    CASE WHEN coalesce(network_adequacy_flag, 0) = 1 THEN 100.0 ELSE 0.0 END AS network_penalty
  FROM (
    SELECT y.bene_id, p.plan_key, p.county_code, b.risk_segment, l.restrictiveness_class, l.network_adequacy_flag,
      l.insulin_risk_flag, l.access_risk AS insulin_access_risk_flag, l.insulin_cap_violation_flag,
      coalesce(CAST(p.premium AS double), 0.0) * 12.0 AS annual_premium,
      y.fills * coalesce(l.pref_copay_share, 0.0) * coalesce(l.pref_avg_copay_amt, 0.0) AS oop_copay_component,
      y.total_rx_cost * coalesce(l.pref_coinsurance_share, 0.0) * coalesce(l.pref_avg_coins_rate, 0.0) AS oop_coins_component,
      coalesce(l.ded_applies_rate, 0.0) * least(coalesce(CAST(p.deductible AS double), 0.0), y.total_rx_cost) AS oop_deductible_component,
      CASE WHEN y.insulin_fills > 0 THEN 1 ELSE 0 END AS insulin_user_flag,
      y.insulin_rx_cost * coalesce(l.pref_avg_coins_rate, 0.0) + y.insulin_fills * coalesce(l.pref_avg_copay_amt, 0.0) * 0.1
        AS oop_insulin_raw
    FROM o_bene_year y
    JOIN beneficiary b ON b.bene_synth_id = y.bene_id
    JOIN o_active_plans p ON p.state = b.state AND p.county_code = b.county_code
    LEFT JOIN o_plan_labels l ON l.plan_key = p.plan_key
  )
)
""")
register("G18_legacy_pair_cost", ["o_legacy"], """
SELECT bene_id, plan_key, county_code, annual_premium, oop_copay_component, oop_coins_component, oop_deductible_component,
  oop_insulin_raw, oop_insulin_capped, insulin_access_penalty, network_penalty, y_annual_oop FROM o_legacy
""")
register("G19_suitability_labels", ["o_legacy"], """
SELECT bene_id, plan_key, county_code, oop_band, warn_network, warn_insulin_cap, warn_insulin_access, warn_restrict,
  warning_score, suitability_class,
  CASE WHEN warn_network = 1 THEN 'Limited network coverage in your area' END AS explain_network,
  CASE WHEN warn_insulin_cap = 1 THEN 'Insulin cost cap may not apply / potential violation' END AS explain_insulin_cap,
  CASE WHEN warn_insulin_access = 1 THEN 'Insulin access may require restrictions (PA/ST/QL)' END AS explain_insulin_access,
  CASE WHEN warn_restrict = 1 THEN 'High formulary restrictiveness for high-utilization profile' END AS explain_restrict
FROM (
  SELECT *, warn_network + warn_insulin_cap + warn_insulin_access + warn_restrict AS warning_score,
    CASE WHEN oop_band = 0 AND warn_network + warn_insulin_cap + warn_insulin_access + warn_restrict = 0 THEN 0
         WHEN oop_band = 2 OR warn_network + warn_insulin_cap + warn_insulin_access + warn_restrict >= 2 THEN 2 ELSE 1 END
      AS suitability_class
  FROM (
    SELECT l.*, CASE WHEN y_annual_oop <= q.q1 THEN 0 WHEN y_annual_oop <= q.q2 THEN 1 ELSE 2 END AS oop_band,
      CASE WHEN coalesce(network_adequacy_flag, 0) = 1 THEN 1 ELSE 0 END AS warn_network,
      CASE WHEN insulin_user_flag = 1 AND coalesce(insulin_cap_violation_flag, 0) = 1 THEN 1 ELSE 0 END AS warn_insulin_cap,
      CASE WHEN insulin_user_flag = 1 AND coalesce(insulin_access_risk_flag, 0) = 1 THEN 1 ELSE 0 END AS warn_insulin_access,
      CASE WHEN risk_segment = 'HIGH' AND coalesce(restrictiveness_class, 1) = 2 THEN 1 ELSE 0 END AS warn_restrict
    FROM o_legacy l, (SELECT quantile_cont(y_annual_oop, 0.33) AS q1, quantile_cont(y_annual_oop, 0.66) AS q2 FROM o_legacy) q
  )
)
""")
register("I2_premium_terciles", ["o_dim_plan"], """
SELECT plan_key, premium, CASE WHEN premium <= q1 THEN 0 WHEN premium <= q2 THEN 1 ELSE 2 END AS premium_band
FROM (SELECT plan_key, premium FROM o_dim_plan WHERE premium IS NOT NULL) d,
  (SELECT quantile_cont(premium, 0.33) AS q1, quantile_cont(premium, 0.66) AS q2 FROM o_dim_plan WHERE premium IS NOT NULL) q
""")


def _fp(table, cols):
    row = "sha256(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS varchar), '')" for c in cols) + "))"
    return (f"SELECT '{table}' AS table_name, count(*) AS rows, bit_xor(CAST(('0x' || substr({row}, 1, 15)) AS BIGINT)) AS xor_hash "
            f"FROM {table}")


register("I14_data_fingerprint", ["plan_info", "formulary", "prescriptions"], "SELECT *, sha256(concat_ws('|', table_name, "
         "CAST(rows AS varchar), CAST(xor_hash AS varchar))) AS fingerprint FROM (" + " UNION ALL ".join([
             _fp("plan_info", ["plan_key", "county_code", "formulary_id"]),
             _fp("formulary", ["formulary_id", "ndc", "rxcui"]),
             _fp("prescriptions", ["bene_synth_id", "ndc", "fills_per_year"])]) + ")")

# Whole tables: every cell, and every row as its cells' digests in order of column names; sums of 32-bit words.
def _whole_table(table):
    col = "COLUMNS('^([^_].*)$')"
    number = f"TRY_CAST({col} AS DOUBLE)"
    bits = f"CAST(CAST(CAST(CASE WHEN {number} = 0 THEN 0.0 ELSE {number} END AS BIT) AS BIGINT) AS varchar)"
    text = f"CASE WHEN typeof({col}) = 'DOUBLE' THEN {bits} ELSE CAST({col} AS varchar) END"
    every = "* REPLACE (round(total_rx_cost_est, 6) AS total_rx_cost_est)" if table == "beneficiary" else "*"
    return f"""SELECT '{table}' AS table_name, _r, column_name, md5(column_name || '=' || txt) AS digest FROM (
  UNPIVOT (SELECT _r, coalesce('v' || {text}, 'n') AS "\\1" FROM (SELECT {every}, row_number() OVER () AS _r FROM {table}) x)
  ON COLUMNS('^[^_]') INTO NAME column_name VALUE txt) u"""


WHOLE_TABLES = ["plan_info", "formulary", "insulin_ref", "beneficiary_cost", "insulin_cost", "excluded_drugs", "pricing",
                "pharmacy_network", "zipcode", "geographic", "prescriptions", "beneficiary", "drug_names", "pde_events",
                "requests", "request_medications", "indication_coverage", "drug_queries"]
_WORD_SUMS = ", ".join(f"CAST(sum(CAST(('0x' || substr(digest, {8 * i + 1}, 8)) AS BIGINT)) AS varchar)" for i in range(4))
register("I14_table_fingerprints", WHOLE_TABLES, f"""
SELECT table_name, column_name, count(*) AS rows,
  sha256(concat_ws('|', table_name, column_name, CAST(count(*) AS varchar), {_WORD_SUMS})) AS fingerprint
FROM (WITH cell AS ({" UNION ALL ".join(_whole_table(t) for t in WHOLE_TABLES)})
  SELECT table_name, column_name, digest FROM cell
  UNION ALL SELECT table_name, '*', md5(string_agg(digest, '' ORDER BY column_name)) FROM cell GROUP BY table_name, _r) d
GROUP BY table_name, column_name
""")

# Gradients of the first tree: equal scores leave every list in plan order, and each pair is wrong by a half.
register("I11_lambda_gradients", ["o_labels"], """
SELECT * FROM (WITH place AS (
  SELECT bene_synth_id AS b, plan_key, pow(2.0, relevance_label) - 1 AS gain,
    1 / log2(row_number() OVER (PARTITION BY bene_synth_id ORDER BY plan_key) + 1) AS discount,
    row_number() OVER (PARTITION BY bene_synth_id ORDER BY plan_key) AS pos,
    1 / log2(row_number() OVER (PARTITION BY bene_synth_id ORDER BY relevance_label DESC) + 1) AS best
  FROM o_labels
),
ideal AS (SELECT b, sum(gain * best) AS ideal FROM place GROUP BY b),
pair AS (
  SELECT x.b, x.plan_key AS first, y.plan_key AS second, sign(x.gain - y.gain) AS side,
    0.5 * abs(x.gain - y.gain) * abs(x.discount - y.discount) / ideal AS pull
  FROM place x JOIN place y ON x.b = y.b AND x.pos <= 30 AND y.pos > x.pos JOIN ideal i ON i.b = x.b WHERE ideal > 0
),
total AS (SELECT b, 2 * sum(pull) AS t FROM pair GROUP BY b),
part AS (
  SELECT b, first AS plan_key, -side * pull AS g, 0.5 * pull AS h FROM pair
  UNION ALL SELECT b, second, side * pull, 0.5 * pull FROM pair
),
scale AS (SELECT b, CASE WHEN t > 0 THEN log2(1 + t) / t ELSE 1.0 END AS f FROM total)
SELECT p.b AS bene_synth_id, p.plan_key, coalesce(sum(x.g) * any_value(f), 0.0) AS gradient, coalesce(sum(x.h) * any_value(f), 0.0) AS curvature
FROM place p LEFT JOIN part x ON x.b = p.b AND x.plan_key = p.plan_key LEFT JOIN scale s ON s.b = p.b
GROUP BY p.b, p.plan_key)
""")
