"""Oracle SQL for the intermediate pipeline steps."""

from oracle import gold, pairs  # noqa: F401
from oracle.queries_decision import norm  # noqa: F401  (registers o_j_* CTEs)
from oracle.registry import cte, register

register("G2_normalized_prescriptions", ["o_bene_rx"], "SELECT * FROM o_bene_rx")
register("G3_formulary_map", ["o_formulary_map"], "SELECT * FROM o_formulary_map")
register("G4_excluded_map", ["o_excluded_map"], "SELECT * FROM o_excluded_map")
register("G5_pricing_bounds", ["o_pricing_bounds"], "SELECT * FROM o_pricing_bounds")
register("G6_pricing_map", ["o_pricing_map", "o_pricing_any"], """
SELECT a.plan_key, a.ndc, m.u1 AS unit_cost_1, m.u2 AS unit_cost_2, m.u4 AS unit_cost_4, a.unit_cost AS unit_cost_any
FROM o_pricing_any a JOIN (SELECT plan_key, ndc, max(CASE WHEN days_supply_code = 1 THEN unit_cost END) AS u1,
    max(CASE WHEN days_supply_code = 2 THEN unit_cost END) AS u2, max(CASE WHEN days_supply_code = 4 THEN unit_cost END) AS u4
  FROM o_pricing_map GROUP BY 1, 2) m ON m.plan_key = a.plan_key AND m.ndc = a.ndc
""")
register("G7_cost_rules", ["o_cost_rules"], "SELECT * FROM o_cost_rules")
register("G8_insulin_rules", ["o_insulin_rules"], "SELECT * FROM o_insulin_rules")
register("G10_calibrated_gross_cost", ["o_pair_drug"], """
SELECT bene_synth_id, plan_key, ndc, units_per_fill, unit_cost_resolved, annual_pricing_raw, annual_gross_cost, in_formulary,
  effective_rxcui FROM o_pair_drug
""")
register("G12_per_fill_cost", ["o_pair_drug"], """
SELECT bene_synth_id, plan_key, ndc, effective_tier, is_covered, cost_type_pref, deductible_applies, insulin_copay_pref,
  per_fill_post_ded_cost FROM o_pair_drug
""")
register("G15_pair_cost_aggregate", ["o_pair_cost_agg"], """
SELECT bene_synth_id, plan_key, estimated_annual_oop, oop_copay_component, oop_coinsurance_component, oop_deductible_component,
  oop_insulin_component, oop_uncovered_component, covered_drug_count, uncovered_drug_count FROM o_pair_cost_agg
""")


def _ratio(x):
    v = f"coalesce(CAST({x} AS double), 0.0)"
    return f"least(greatest(CASE WHEN {v} > 1 THEN {v} / 100.0 ELSE {v} END, 0.0), 1.0)"


register("J7_legacy_oop_estimate", ["o_j_cands", "o_j_profile"], f"""
SELECT request_id, plan_key, greatest(50.0, est + least(coalesce(deductible, 0.0), 800.0) * 0.35) AS estimated_annual_oop
FROM (
  SELECT c.request_id, c.plan_key, c.deductible,
    coalesce(CAST(p.total_rx_cost_est AS double), 0.0)
    * (0.20 + least(0.25, 0.01 * (greatest(coalesce(p.num_drugs, 1), 1) - 1))
       + least(0.15, 0.002 * greatest(greatest(coalesce(CAST(p.avg_fills_per_year AS double), 1.0), 1.0) - 12, 0.0)))
    * (1.0 - 0.22 * {_ratio('c.formulary_generic_pct')}) * (1.0 + 0.25 * {_ratio('c.formulary_specialty_pct')})
    * (1.0 + 0.18 * {_ratio('c.formulary_pa_rate')} + 0.12 * {_ratio('c.formulary_st_rate')} + 0.08 * {_ratio('c.formulary_ql_rate')})
    * (1.0 + least(coalesce(c.deductible, 0.0), 1000.0) / 3500.0)
    * CASE WHEN c.network_adequacy_flag = 1 THEN 1.08 ELSE 1.0 END
    * CASE WHEN p.is_insulin_user = 1 THEN 0.92 ELSE 1.0 END AS est
  FROM o_j_cands c JOIN o_j_profile p ON p.request_id = c.request_id
)
""")
register("J10_decision_weights", ["requests"], """
SELECT request_id, least(greatest(ml_influence_pct, 0.0), 100.0) / 100.0 AS w_ml,
  (1 - least(greatest(ml_influence_pct, 0.0), 100.0) / 100.0) * cost_priority
    / greatest(1.0, cost_priority + access_priority + coverage_priority) AS w_cost,
  (1 - least(greatest(ml_influence_pct, 0.0), 100.0) / 100.0) * access_priority
    / greatest(1.0, cost_priority + access_priority + coverage_priority) AS w_access,
  (1 - least(greatest(ml_influence_pct, 0.0), 100.0) / 100.0) * coverage_priority
    / greatest(1.0, cost_priority + access_priority + coverage_priority) AS w_coverage
FROM requests
""")
register("E4_zip_pharmacy_distances", ["o_j_gated", "o_j_profile", "o_network", "o_zip_county"], """
SELECT o.zip_code, o.plan_key, n.pharmacy_zipcode AS p_zip, n.n_pharmacies, n.n_preferred,
  round(CAST(6371.0 * acos(least(1.0, greatest(-1.0, cos(radians(oz.lat)) * cos(radians(pz.lat)) * cos(radians(pz.lng)
    - radians(oz.lng)) + sin(radians(oz.lat)) * sin(radians(pz.lat))))) * 0.621371 AS decimal(24,6)), 2)::double AS distance_miles
FROM (SELECT DISTINCT p.zip_code, g.plan_key FROM o_j_gated g JOIN o_j_profile p ON p.request_id = g.request_id) o
JOIN o_zip_county oz ON oz.zip_code = o.zip_code
JOIN (SELECT plan_key, pharmacy_zipcode, count(*) AS n_pharmacies, sum(CASE WHEN is_preferred_retail THEN 1 ELSE 0 END) AS n_preferred
      FROM o_network WHERE offers_retail GROUP BY 1, 2) n ON n.plan_key = o.plan_key
JOIN o_zip_county pz ON pz.zip_code = n.pharmacy_zipcode
""")
register("L2_ndc_token_candidates", ["request_medications"], """
SELECT request_id, ndc, token,
  CASE WHEN d = '' THEN []::varchar[] WHEN length(d) < 11 THEN [d, lpad(d, 11, '0')] ELSE [d] END AS candidates
FROM (SELECT request_id, ndc, substring(ndc, 3, 5) || '-' || substring(ndc, 8, 4) AS token,
        regexp_replace(substring(ndc, 3, 5) || '-' || substring(ndc, 8, 4), '[^0-9]', '', 'g') AS d FROM request_medications)
""")
register("M3_gold_validation", ["o_formulary_metrics", "o_network_metrics", "o_distance_features"], """
SELECT 'agg_plan_formulary_metrics' AS table_name, count(*) AS rows, avg(total_drugs) AS avg_metric,
  sum(CASE WHEN restrictiveness_class = 2 THEN 1 ELSE 0 END) AS flagged FROM o_formulary_metrics
UNION ALL SELECT 'agg_plan_network_metrics', count(*), avg(total_pharmacies), sum(network_adequacy_flag) FROM o_network_metrics
UNION ALL SELECT 'plan_distance_features', count(*), avg(simulated_distance_miles),
  sum(CASE WHEN distance_category = 'far' THEN 1 ELSE 0 END) FROM o_distance_features
""")

register("F10_fill_events", ["prescriptions"], """
SELECT bene_synth_id, ndc, fill_num,
  CAST(DATE '2025-01-01' + CAST(floor((fill_num - 1) * 365.0 / greatest(CAST(fills_per_year AS integer), 1))
    + floor((CAST(('0x' || substr(sha256(concat('42|', concat_ws('|', bene_synth_id, ndc, CAST(fill_num AS varchar)))), 1, 16))
      AS UBIGINT) / 18446744073709551615.0) * 7) AS integer) AS DATE) AS srvc_dt
FROM (SELECT bene_synth_id, ndc, fills_per_year,
        unnest(generate_series(1, greatest(CAST(fills_per_year AS integer), 1))) AS fill_num FROM prescriptions)
""")

register("I6_rule_labels", ["o_dim_plan", "pharmacy_network", "o_friendly"], """
SELECT d.plan_key,
  CASE WHEN coalesce(n.pref, 0.0) < 0.20 OR coalesce(n.in_area, 0.0) < 0.60 THEN 1 ELSE 0 END AS network_adequacy_flag,
  CASE WHEN coalesce(f.insulin_exceeds_cap_any_flag, 0) = 1 OR coalesce(f.insulin_exceeds_cap_rate, 0.0) > 0.05 THEN 1 ELSE 0 END
    AS insulin_cap_violation_flag,
  CASE WHEN coalesce(f.insulin_restrictiveness_index, 0.0) > 20 OR coalesce(f.insulin_pa_rate, 0.0) > 0.20 THEN 1 ELSE 0 END
    AS insulin_access_risk_flag
FROM o_dim_plan d
LEFT JOIN (SELECT upper(trim(contract_id)) || lpad(upper(trim(CAST(plan_id AS varchar))), 3, '0')
             || lpad(upper(trim(CAST(segment_id AS varchar))), 3, '0') AS plan_key,
             avg(CASE WHEN upper(trim(preferred_status_retail)) = 'Y' THEN 1.0 WHEN upper(trim(preferred_status_retail)) = 'N'
                      THEN 0.0 END) AS pref,
             avg(CASE CAST(in_area_flag AS integer) WHEN 1 THEN 1.0 WHEN 0 THEN 0.0 END) AS in_area
           FROM pharmacy_network GROUP BY 1) n ON n.plan_key = d.plan_key
LEFT JOIN o_friendly f ON f.plan_key = d.plan_key
""")
