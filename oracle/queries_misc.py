"""Oracle SQL for draws / sampling, drug catalogue and research evaluation (DuckDB)."""

from oracle import gold, pairs  # noqa: F401
from oracle.queries_decision import norm
from oracle.registry import cte, register


def sf(key: str, seed: int = 42) -> str:
    return f"(CAST(('0x' || substr(sha256(concat('{seed}|', {key})), 1, 16)) AS UBIGINT) / 18446744073709551615.0)"


def c5(x: str) -> str:
    n = f"CAST(TRY_CAST(trim(CAST({x} AS varchar)) AS double) AS bigint)"
    return (f"CASE WHEN {x} IS NULL OR trim(CAST({x} AS varchar)) = '' THEN '' WHEN {n} IS NULL THEN '' "
            f"WHEN length(CAST({n} AS varchar)) > 5 THEN CAST({n} AS varchar) ELSE lpad(CAST({n} AS varchar), 5, '0') END")


register("F2_keyed_draws", ["beneficiary"], f"""
SELECT bene_synth_id, {sf('bene_synth_id')} AS fraction, 2.0 + 23.0 * {sf('bene_synth_id')} AS uniform_2_25,
  {sf('bene_synth_id', 7)} AS fraction_seed7
FROM beneficiary
""")

cte("o_f_modal", ("o_zip_county",), f"""
SELECT cc AS county_code, st AS state FROM (
  SELECT cc, st, row_number() OVER (PARTITION BY cc ORDER BY count(*) DESC, st) AS rn
  FROM (SELECT {c5('county_code')} AS cc, upper(trim(state)) AS st FROM o_zip_county) z
  WHERE cc <> '' AND st IS NOT NULL AND st <> '' GROUP BY cc, st
) WHERE rn = 1
""")
cte("o_f_weights", ("geographic", "o_f_modal"), f"""
SELECT g.cc AS county_code, coalesce(g.st, m.state) AS state, count(*) AS weight
FROM (SELECT {c5('county_code')} AS cc,
        CASE WHEN upper(trim(CAST(state_label AS varchar))) IN ('', 'NONE', 'NAN') THEN NULL
             ELSE upper(trim(CAST(state_label AS varchar))) END AS st FROM geographic) g
LEFT JOIN o_f_modal m ON m.county_code = g.cc
WHERE coalesce(g.st, m.state) IS NOT NULL AND g.cc <> '' AND g.cc IN (SELECT county_code FROM o_f_modal)
GROUP BY 1, 2
""")
register("F3_county_weights", ["o_f_weights"], "SELECT * FROM o_f_weights")

cte("o_f_zip_iv", ("o_zip_county",), f"""
SELECT *, (cum - w) / tot AS lo, CASE WHEN idx = n THEN 'inf'::double ELSE cum / tot END AS hi FROM (
  SELECT *, sum(w) OVER (PARTITION BY cc ORDER BY pop DESC, zip ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
    sum(w) OVER (PARTITION BY cc) AS tot,
    row_number() OVER (PARTITION BY cc ORDER BY pop DESC, zip) AS idx, count(*) OVER (PARTITION BY cc) AS n
  FROM (
    SELECT *, CASE WHEN sum(pop) OVER (PARTITION BY cc) <= 0 THEN 1.0 ELSE pop END AS w FROM (
      SELECT {c5('county_code')} AS cc, trim(CAST(zip_code AS varchar)) AS zip,
        greatest(coalesce(CAST(population AS double), 0.0), 0.0) AS pop, upper(trim(state)) AS st, lat, lng,
        CAST(density AS double) AS density
      FROM o_zip_county
    ) WHERE cc <> '' AND zip <> '' AND st <> ''
  )
)
""")
cte("o_f_zip_assigned", ("beneficiary", "o_f_zip_iv"), f"""
SELECT b.bene_synth_id, b.cc AS county_code, i.st AS state, i.zip AS zip_code, i.lat, i.lng, i.density
FROM (SELECT bene_synth_id, {c5('county_code')} AS cc FROM beneficiary) b
JOIN o_f_zip_iv i ON i.cc = b.cc
WHERE i.lo <= {sf("concat_ws('|', b.cc, b.bene_synth_id)", 17)} AND {sf("concat_ws('|', b.cc, b.bene_synth_id)", 17)} < i.hi
""")
register("F4_zip_assignment", ["o_f_zip_assigned"], "SELECT * FROM o_f_zip_assigned")
register("F4_zip_assignment_audit", ["o_f_zip_assigned", "beneficiary", "o_f_zip_iv"], f"""
SELECT bene_synth_id, county_code, 'assigned' AS assignment_status, NULL::varchar AS exclusion_reason,
  zip_code AS assigned_zip, state AS assigned_state FROM o_f_zip_assigned
UNION ALL
SELECT bene_synth_id, cc, 'excluded', 'No ZIP candidates available for county', NULL, NULL
FROM (SELECT bene_synth_id, {c5('county_code')} AS cc FROM beneficiary) b
WHERE b.cc NOT IN (SELECT cc FROM o_f_zip_iv)
""")
register("F5_county_assignment", ["beneficiary", "o_f_weights"], f"""
SELECT b.bene_synth_id, i.county_code, i.state FROM beneficiary b
JOIN (
  SELECT *, (cum - weight) / tot AS lo, CASE WHEN idx = n THEN 'inf'::double ELSE cum / tot END AS hi FROM (
    SELECT county_code, state, CAST(weight AS double) AS weight,
      sum(CAST(weight AS double)) OVER (ORDER BY weight DESC, county_code ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
      sum(CAST(weight AS double)) OVER () AS tot, row_number() OVER (ORDER BY weight DESC, county_code) AS idx,
      count(*) OVER () AS n
    FROM o_f_weights)
) i ON i.lo <= {sf('b.bene_synth_id')} AND {sf('b.bene_synth_id')} < i.hi
WHERE i.state IS NOT NULL
""")

cte("o_pool", ("formulary", "insulin_ref"), """
SELECT p.*, coalesce(i.is_insulin, 0) AS is_insulin FROM (
  SELECT ndc, min(CAST(tier_level_value AS integer)) AS tier_level,
    max(CASE WHEN upper(trim(prior_authorization_yn)) = 'Y' THEN 1 ELSE 0 END) AS has_prior_auth,
    max(CASE WHEN upper(trim(step_therapy_yn)) = 'Y' THEN 1 ELSE 0 END) AS has_step_therapy,
    max(CASE WHEN upper(trim(quantity_limit_yn)) = 'Y' THEN 1 ELSE 0 END) AS has_quantity_limit,
    min(rxcui) AS rxcui, count(DISTINCT formulary_id) AS formulary_coverage
  FROM formulary WHERE ndc IS NOT NULL GROUP BY ndc
) p LEFT JOIN (SELECT DISTINCT ndc, 1 AS is_insulin FROM insulin_ref WHERE ndc IS NOT NULL) i ON i.ndc = p.ndc
""")
register("D13_formulary_drug_pool", ["o_pool"], "SELECT * FROM o_pool")

register("F8_fill_allocation", ["prescriptions", "beneficiary"], f"""
SELECT bene_synth_id, ndc, fills_target,
  CAST(1 + fl + CASE WHEN rk <= rem THEN 1 ELSE 0 END AS integer) AS fills_allocated
FROM (
  SELECT *, t - n - sum(fl) OVER (PARTITION BY bene_synth_id) AS rem,
    row_number() OVER (PARTITION BY bene_synth_id ORDER BY q - fl DESC, ndc) AS rk
  FROM (
    SELECT *, floor(q) AS fl FROM (
      SELECT *, e / sum(e) OVER (PARTITION BY bene_synth_id) * (t - n) AS q FROM (
        SELECT p.bene_synth_id, p.ndc, b.fills_target,
          -ln(greatest({sf("concat_ws('|', p.bene_synth_id, p.ndc)")}, 1e-300)) AS e,
          count(*) OVER (PARTITION BY p.bene_synth_id) AS n,
          greatest(CAST(b.fills_target AS bigint), count(*) OVER (PARTITION BY p.bene_synth_id)) AS t
        FROM prescriptions p JOIN beneficiary b ON b.bene_synth_id = p.bene_synth_id
      )
    )
  )
)
""")
register("F11_best_rxcui_names", ["drug_names"], """
SELECT rxcui, drug_name, drug_synonym, tty FROM (
  SELECT rxcui, drug_name, drug_synonym, tty, row_number() OVER (PARTITION BY rxcui ORDER BY
    CASE upper(tty) WHEN 'IN' THEN 1 WHEN 'PIN' THEN 2 WHEN 'MIN' THEN 3 WHEN 'SCD' THEN 4 WHEN 'SBD' THEN 5
      WHEN 'GPCK' THEN 6 WHEN 'BPCK' THEN 7 ELSE 99 END, coalesce(length(drug_name), 9999), drug_name, drug_synonym, tty) AS rn
  FROM drug_names WHERE rxcui <> ''
) WHERE rn = 1
""")
register("F12_drug_name_resolution", ["prescriptions"], """
SELECT bene_synth_id, ndc, coalesce(nullif(trim(drug_name), ''), nullif(trim(drug_synonym), ''), 'NDC ' || ndc) AS resolved_name,
  CASE WHEN nullif(trim(drug_name), '') IS NOT NULL THEN 'rxcui_name'
       WHEN nullif(trim(drug_synonym), '') IS NOT NULL THEN 'rxcui_synonym' ELSE 'ndc_fallback' END AS name_source
FROM prescriptions
""")
register("F13_research_sample", ["beneficiary"], """
SELECT bene_synth_id FROM (SELECT DISTINCT bene_synth_id FROM beneficiary WHERE upper(risk_segment) IN ('HIGH', 'LOW', 'MED'))
ORDER BY sha256(bene_synth_id || '42'), bene_synth_id LIMIT 100
""")
register("F14_keyed_downsample", ["pde_events"], f"""
SELECT claim_id, bene_id, prod_srvc_id FROM pde_events WHERE {sf('claim_id')} < 0.10
""")

# --- L -----------------------------------------------------------------------
register("B26_ndc_from_text", ["documents", "conversations"], r"""
SELECT DISTINCT doc_id, lpad(split_part(raw, '-', 1), 5, '0') || lpad(split_part(raw, '-', 2), 4, '0')
    || lpad(split_part(raw, '-', 3), 2, '0') AS ndc11
FROM (
  SELECT CAST(doc_id AS varchar) AS doc_id, unnest(regexp_extract_all(text, '\b\d{4,5}-\d{3,4}-\d{1,2}\b')) AS raw FROM documents
  UNION ALL
  SELECT concat_ws('-', conv_id, turn), unnest(regexp_extract_all(text, '\b\d{4,5}-\d{3,4}-\d{1,2}\b')) FROM conversations
)
""")
register("L3_parse_ndc_text", ["conversations"], r"""
SELECT msg_id, ndc, row_number() OVER (PARTITION BY msg_id ORDER BY tpos, cpos) AS position FROM (
  SELECT msg_id, ndc, arg_min(tpos, tpos * 10 + cpos) AS tpos, arg_min(cpos, tpos * 10 + cpos) AS cpos FROM (
    SELECT msg_id, tpos, 0 AS cpos, d AS ndc FROM (
      SELECT msg_id, tpos, regexp_replace(coalesce(tok, ''), '[^0-9]', '', 'g') AS d FROM (
        SELECT msg_id, generate_subscripts(toks, 1) - 1 AS tpos, unnest(toks) AS tok FROM (
          SELECT concat_ws('-', conv_id, turn) AS msg_id, string_split_regex(coalesce(text, ''), '[\s,;\n\r\t]+') AS toks
          FROM conversations)))
    WHERE d <> ''
    UNION ALL
    SELECT msg_id, tpos, 1, lpad(d, 11, '0') FROM (
      SELECT msg_id, tpos, regexp_replace(coalesce(tok, ''), '[^0-9]', '', 'g') AS d FROM (
        SELECT msg_id, generate_subscripts(toks, 1) - 1 AS tpos, unnest(toks) AS tok FROM (
          SELECT concat_ws('-', conv_id, turn) AS msg_id, string_split_regex(coalesce(text, ''), '[\s,;\n\r\t]+') AS toks
          FROM conversations)))
    WHERE d <> '' AND length(d) < 11
  ) GROUP BY msg_id, ndc
)
""")
cte("o_l_norm", ("request_medications",), """
SELECT request_id,
  CASE WHEN trim(coalesce(CAST(drug_name AS varchar), '')) <> '' THEN trim(CAST(drug_name AS varchar)) ELSE 'NDC ' || n END AS drug_name,
  n AS ndc,
  greatest(1.0, coalesce(TRY_CAST(CAST(fills_per_year AS varchar) AS double), 12.0)) AS fills_per_year,
  CASE WHEN d IN (30, 60, 90) THEN d WHEN d < 45 THEN 30 WHEN d < 75 THEN 60 ELSE 90 END AS days_supply_mode,
  least(7, greatest(1, t)) AS tier_level,
  lower(trim(CAST(is_insulin AS varchar))) IN ('1', 'true', 't', 'yes', 'y')
    OR TRY_CAST(lower(trim(CAST(is_insulin AS varchar))) AS double) <> 0 AS is_insulin,
  greatest(0.0, coalesce(TRY_CAST(CAST(annual_cost_est AS varchar) AS double), 0.0)) AS annual_cost_est
FROM (
  SELECT *, CASE WHEN length(dg) < 11 THEN lpad(dg, 11, '0') ELSE dg END AS n,
    CAST(round_even(coalesce(TRY_CAST(CAST(days_supply_mode AS varchar) AS double), 30.0), 0) AS integer) AS d,
    CAST(round_even(coalesce(TRY_CAST(CAST(tier_level AS varchar) AS double), 1.0), 0) AS integer) AS t
  FROM (SELECT *, regexp_replace(coalesce(CAST(ndc AS varchar), ''), '[^0-9]', '', 'g') AS dg FROM request_medications)
  WHERE dg <> ''
)
""")
register("L4_normalize_medications", ["o_l_norm"], "SELECT * FROM o_l_norm")
register("L5_medication_summary", ["o_l_norm"], """
SELECT request_id, count(*) AS num_drugs, avg(fills) AS avg_fills_per_year, max(ins) AS is_insulin_user,
  sum(cost) AS total_annual_drug_cost
FROM (SELECT request_id, ndc, max(fills_per_year) AS fills, max(CAST(is_insulin AS integer)) AS ins, max(annual_cost_est) AS cost
      FROM o_l_norm GROUP BY 1, 2) GROUP BY 1
""")
register("L1_drug_search", ["drug_queries", "prescriptions"], """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY drug_name, ndc) AS rank FROM (
    SELECT q.query_text, m.drug_name, m.ndc,
      CAST(coalesce(min(m.tier_level), 1) AS integer) AS tier_level,
      CASE WHEN coalesce(round(avg(m.days_supply_mode)), 30) >= 75 THEN 90
           WHEN coalesce(round(avg(m.days_supply_mode)), 30) >= 45 THEN 60 ELSE 30 END AS days_supply_mode,
      coalesce(round(CAST(avg(m.fills_per_year) AS decimal(24,6)), 1)::double, 12.0) AS fills_per_year,
      CAST(coalesce(max(m.is_insulin), 0) AS integer) AS is_insulin,
      coalesce(round(CAST(avg(m.annual_cost_est) AS decimal(24,6)), 2)::double, 0.0) AS annual_cost_est
    FROM (SELECT DISTINCT query_text, lower(trim(query_text)) AS lq, regexp_replace(query_text, '[^0-9]', '', 'g') AS dq
          FROM drug_queries) q
    JOIN (
      SELECT CAST(coalesce(nullif(drug_name, ''), nullif(drug_synonym, ''), 'NDC ' || ndc) AS varchar) AS drug_name,
        coalesce(drug_synonym, '') AS drug_synonym, CAST(ndc AS varchar) AS ndc,
        TRY_CAST(tier_level AS integer) AS tier_level, TRY_CAST(days_supply_mode AS integer) AS days_supply_mode,
        TRY_CAST(fills_per_year AS double) AS fills_per_year, TRY_CAST(is_insulin AS integer) AS is_insulin,
        TRY_CAST(estimated_annual_drug_cost AS double) AS annual_cost_est
      FROM prescriptions WHERE ndc IS NOT NULL
    ) m ON (length(q.lq) >= 2 AND (contains(lower(m.drug_name), q.lq) OR contains(lower(m.drug_synonym), q.lq)))
        OR (length(q.dq) >= 4 AND contains(m.ndc, q.dq))
    GROUP BY q.query_text, m.drug_name, m.ndc
  )
) WHERE rank <= 20
""")
register("L6_name_dictionary_search", ["drug_queries", "drug_names"], """
SELECT query_text, drug_name, ndc, score, prefix, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY score DESC, prefix DESC, drug_name, ndc) AS rank FROM (
    SELECT DISTINCT q.query_text, n.drug_name, n.ndc, CASE WHEN lower(n.drug_name) = q.lq THEN 1.0 ELSE 0.5 END AS score,
      starts_with(lower(n.drug_name), q.lq) AS prefix
    FROM (SELECT DISTINCT query_text, lower(trim(query_text)) AS lq FROM drug_queries WHERE length(lower(trim(query_text))) >= 2) q
    JOIN (SELECT DISTINCT drug_name, ndc FROM drug_names) n ON contains(lower(n.drug_name), q.lq)
  )
) WHERE rank <= 10
""")

# --- K -----------------------------------------------------------------------
cte("o_research", ("o_training_pairs",), f"""
SELECT *, 100.0 * (0.55 * {norm('total_cost_with_distance', False, 'bene_synth_id')}
  + 0.20 * {norm('distance_miles', False, 'bene_synth_id')} + 0.25 * {norm('formulary_generic_pct', True, 'bene_synth_id')}) AS heuristic_score
FROM (
  SELECT *, -(plan_premium * 12 + estimated_annual_oop) AS ml_score,
    CASE WHEN covered_drug_count + uncovered_drug_count > 0
         THEN 100.0 * covered_drug_count / (covered_drug_count + uncovered_drug_count) ELSE 0.0 END AS coverage_pct_requested,
    CASE WHEN network_total_pharmacies > 0 THEN 1 ELSE 0 END AS has_network_metrics,
    CASE WHEN formulary_total_drugs > 0 THEN 1 ELSE 0 END AS has_formulary_metrics
  FROM o_training_pairs WHERE ranking_cost_objective IS NOT NULL
)
""")


def _details(score: str, label: str) -> str:
    return f"""
SELECT '{label}' AS method, t.*, b.group_best_cost, t3.top3_best_cost,
  coalesce(t.ranking_cost_objective, 0.0) - coalesce(b.group_best_cost, 0.0) AS cost_regret,
  coalesce(t3.top3_best_cost, 0.0) - coalesce(b.group_best_cost, 0.0) AS top3_regret
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bene_synth_id ORDER BY {score} DESC,
        ranking_cost_objective ASC, plan_key) AS selection_rank FROM o_research) WHERE selection_rank = 1) t
LEFT JOIN (SELECT bene_synth_id, min(ranking_cost_objective) AS group_best_cost FROM o_research GROUP BY 1) b
  ON b.bene_synth_id = t.bene_synth_id
LEFT JOIN (SELECT bene_synth_id, min(ranking_cost_objective) AS top3_best_cost FROM (
    SELECT *, row_number() OVER (PARTITION BY bene_synth_id ORDER BY {score} DESC, ranking_cost_objective ASC, plan_key) AS r
    FROM o_research) WHERE r <= 3 GROUP BY 1) t3 ON t3.bene_synth_id = t.bene_synth_id
"""


cte("o_details", ("o_research",), _details("ml_score", "ML model") + " UNION ALL " +
    _details("heuristic_score", "Transparent baseline"))


def _r2(x: str) -> str:
    return f"round(CAST({x} AS decimal(24,6)), 2)::double"


cte("o_regret", ("o_details",), f"""
SELECT method, count(DISTINCT bene_synth_id) AS beneficiaries, {_r2('avg(cost_regret)')} AS avg_top1_cost_regret,
  {_r2('quantile_cont(cost_regret, 0.5)')} AS median_top1_cost_regret, {_r2('avg(top3_regret)')} AS avg_top3_cost_regret,
  {_r2('avg(coalesce(coverage_pct_requested, 0.0))')} AS avg_requested_drug_coverage,
  {_r2('avg(coalesce(distance_miles, 0.0))')} AS avg_access_burden_miles,
  {_r2('avg(CASE WHEN cost_regret <= 1e-9 THEN 1.0 ELSE 0.0 END) * 100.0')} AS best_plan_hit_rate
FROM o_details GROUP BY method
""")
register("K1_top_choice", ["o_research"], """
SELECT bene_synth_id, plan_key, selection_rank FROM (SELECT *, row_number() OVER (PARTITION BY bene_synth_id
  ORDER BY ml_score DESC, ranking_cost_objective ASC, plan_key) AS selection_rank FROM o_research) WHERE selection_rank <= 3
""")
register("K2_regret_summary", ["o_regret"], "SELECT * FROM o_regret")
register("K3_model_vs_baseline_detail", ["o_details"], """
SELECT method, bene_synth_id, plan_key, ranking_cost_objective, group_best_cost, top3_best_cost, cost_regret FROM o_details
""")

_sc = {"default_mix": (0.35, 0.30, 0.15, 0.20), "cost_focused": (0.20, 0.55, 0.10, 0.15),
       "access_focused": (0.20, 0.25, 0.40, 0.15), "coverage_focused": (0.20, 0.20, 0.10, 0.50)}
_tops = []
for _n, (_m, _c, _a, _v) in _sc.items():
    _tops.append(f"""(SELECT bene_synth_id, plan_key AS {_n} FROM (SELECT bene_synth_id, plan_key, row_number() OVER (
      PARTITION BY bene_synth_id ORDER BY {_m} * (100.0 - ml_rank) + {_c} * (100.0 - cost_rank) + {_a} * (100.0 - access_rank)
      + {_v} * (100.0 - coverage_rank) DESC, ranking_cost_objective ASC, plan_key) AS rn FROM o_k4_ranks) WHERE rn = 1) {_n}""")
cte("o_k4_ranks", ("o_research",), """
SELECT *, row_number() OVER (PARTITION BY bene_synth_id ORDER BY total_cost_with_distance ASC, plan_key) AS cost_rank,
  row_number() OVER (PARTITION BY bene_synth_id ORDER BY distance_miles ASC, plan_key) AS access_rank,
  row_number() OVER (PARTITION BY bene_synth_id ORDER BY coverage_pct_requested DESC, plan_key) AS coverage_rank,
  row_number() OVER (PARTITION BY bene_synth_id ORDER BY ml_score DESC, plan_key) AS ml_rank
FROM o_research
""")
cte("o_k4_tops", ("o_k4_ranks",), "SELECT default_mix.bene_synth_id, default_mix.default_mix, cost_focused.cost_focused, "
    "access_focused.access_focused, coverage_focused.coverage_focused FROM " + _tops[0] + " "
    + " ".join(f"LEFT JOIN {t} USING (bene_synth_id)" for t in _tops[1:]))
register("K4_preference_stability", ["o_k4_tops"], " UNION ALL ".join(
    f"""SELECT '{s}' AS scenario, count(*) AS beneficiaries,
      {_r2(f"avg(CASE WHEN coalesce({s}, '') <> coalesce(default_mix, '') THEN 1.0 ELSE 0.0 END) * 100.0")} AS changed_top_plan_pct
    FROM o_k4_tops""" for s in ("cost_focused", "access_focused", "coverage_focused")))

cte("o_k5_base", ("o_details",), """
SELECT *, CASE WHEN dens <= e1 THEN 'Q1' WHEN dens <= e2 THEN 'Q2' WHEN dens <= e3 THEN 'Q3' WHEN dens <= e4 THEN 'Q4' ELSE 'Q5' END
  AS density_bucket
FROM (
  SELECT d.*, q.e1, q.e2, q.e3, q.e4 FROM (
    SELECT *, coalesce(CAST(bene_density AS double), (SELECT quantile_cont(CAST(bene_density AS double), 0.5) FROM o_details)) AS dens
    FROM o_details) d,
  (SELECT quantile_cont(dens, 0.2) AS e1, quantile_cont(dens, 0.4) AS e2, quantile_cont(dens, 0.6) AS e3,
          quantile_cont(dens, 0.8) AS e4
   FROM (SELECT coalesce(CAST(bene_density AS double), (SELECT quantile_cont(CAST(bene_density AS double), 0.5)
          FROM o_details)) AS dens FROM o_details)) q
)
""")
register("K5_fairness_tables", ["o_k5_base"], """
SELECT method, dimension, value, count(DISTINCT bene_synth_id) AS beneficiaries, avg(cost_regret) AS avg_cost_regret,
  avg(coverage_pct_requested) AS avg_coverage_pct, avg(distance_miles) AS avg_distance_miles
FROM (
  SELECT method, bene_synth_id, cost_regret, coverage_pct_requested, distance_miles, 'insulin' AS dimension,
    CAST(bene_insulin_user AS varchar) AS value FROM o_k5_base
  UNION ALL SELECT method, bene_synth_id, cost_regret, coverage_pct_requested, distance_miles, 'risk_segment', risk_segment FROM o_k5_base
  UNION ALL SELECT method, bene_synth_id, cost_regret, coverage_pct_requested, distance_miles, 'density', density_bucket FROM o_k5_base
  UNION ALL SELECT method, bene_synth_id, cost_regret, coverage_pct_requested, distance_miles, 'state', bene_state FROM o_k5_base
    WHERE bene_state IN (SELECT bene_state FROM o_k5_base GROUP BY 1 ORDER BY count(*) DESC, bene_state LIMIT 10)
  UNION ALL SELECT method, bene_synth_id, cost_regret, coverage_pct_requested, distance_miles, 'county', bene_county FROM o_k5_base
    WHERE bene_county IN (SELECT bene_county FROM o_k5_base GROUP BY 1 ORDER BY count(*) DESC, bene_county LIMIT 10)
) GROUP BY 1, 2, 3
""")
register("K6_data_coverage", ["o_research"], f"""
SELECT 'Beneficiaries' AS metric, CAST(count(DISTINCT bene_synth_id) AS double) AS value FROM o_research
UNION ALL SELECT 'Plan rows', CAST(count(*) AS double) FROM o_research
UNION ALL SELECT 'Rows with network metrics (%)', {_r2('100.0 * avg(coalesce(has_network_metrics, 0))')} FROM o_research
UNION ALL SELECT 'Rows with formulary metrics (%)', {_r2('100.0 * avg(coalesce(has_formulary_metrics, 0))')} FROM o_research
UNION ALL SELECT 'Rows with density populated (%)', {_r2('100.0 * avg(CASE WHEN bene_density IS NOT NULL THEN 1.0 ELSE 0.0 END)')} FROM o_research
UNION ALL SELECT 'Average requested-drug coverage (%)', {_r2('avg(coalesce(coverage_pct_requested, 0.0))')} FROM o_research
""")
register("K7_summary_long", ["o_regret"], """
UNPIVOT (SELECT method, CAST(beneficiaries AS double) AS beneficiaries, avg_top1_cost_regret, median_top1_cost_regret,
  avg_top3_cost_regret, avg_requested_drug_coverage, avg_access_burden_miles, best_plan_hit_rate FROM o_regret)
ON beneficiaries, avg_top1_cost_regret, median_top1_cost_regret, avg_top3_cost_regret, avg_requested_drug_coverage,
  avg_access_burden_miles, best_plan_hit_rate INTO NAME metric VALUE value
""")
register("K8_research_states", ["beneficiary"], "SELECT DISTINCT state FROM beneficiary WHERE state IS NOT NULL")
