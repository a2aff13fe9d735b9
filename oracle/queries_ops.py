"""Oracle SQL for source / sink, streaming and data-quality queries."""

from oracle import pairs  # noqa: F401
from oracle.queries_core import _m  # noqa: F401
from oracle.queries_misc import sf  # noqa: F401  (registers the F CTEs)
from oracle.registry import register

_pi = ("contract_id, plan_id, segment_id, contract_name, plan_name, formulary_id, premium, deductible, ma_region_code, "
       "pdp_region_code, state, county_code, snp, plan_suppressed_yn")
register("A1_delimited_roundtrip", ["plan_info"], f"SELECT {_pi} FROM plan_info")
register("A3_migrate_table", ["pricing"], """
SELECT plan_key, ndc, days_supply, unit_cost, concat_ws('|', plan_key, ndc, CAST(days_supply AS varchar)) AS pricing_key FROM pricing
""")
register("A6_shard_union", ["drug_names"], """
SELECT rxcui, drug_name, tty, NULL::varchar AS drug_synonym, NULL::varchar AS ndc FROM drug_names
UNION ALL SELECT rxcui, NULL, NULL, drug_synonym, ndc FROM drug_names
""")
register("A7_claims_file", ["pde_events"], """
SELECT bene_id, prod_srvc_id, srvc_dt, CAST(days_suply_num AS double) AS days_suply_num, qty_dspnsd_num, tot_rx_cst_amt
FROM pde_events
""")
register("A9_insert_only_merge", [], "SELECT DISTINCT event_id, ts, user_id, event_type, value, props FROM events")
register("A10_enrich_in_place", ["beneficiary", "o_f_zip_assigned"], """
SELECT b.bene_synth_id, b.state, b.county_code, coalesce(a.zip_code, b.zip_code) AS zip_code, coalesce(a.lat, b.lat) AS lat,
  a.lng, a.density
FROM beneficiary b LEFT JOIN o_f_zip_assigned a ON a.bene_synth_id = b.bene_synth_id
""")
register("A12_table_info", ["plan_info", "formulary", "pricing", "pharmacy_network", "beneficiary", "prescriptions"], """
SELECT 'plan_info' AS table_name, count(*) AS rows, 17 AS columns FROM plan_info
UNION ALL SELECT 'formulary', count(*), 11 FROM formulary
UNION ALL SELECT 'pricing', count(*), 8 FROM pricing
UNION ALL SELECT 'pharmacy_network', count(*), 18 FROM pharmacy_network
UNION ALL SELECT 'beneficiary', count(*), 12 FROM beneficiary
UNION ALL SELECT 'prescriptions', count(*), 17 FROM prescriptions
""")
register("P1_incremental_insert_only", [], "SELECT DISTINCT event_id, ts, user_id, event_type, value, props FROM events")
register("P2_incremental_daily_summary", [], """
SELECT user_id, date_trunc('day', ts) AS day_start, count(*) AS events, sum(value) AS value_sum FROM events GROUP BY 1, 2
""")
register("M1_beneficiary_profile_stats", ["beneficiary"], """
SELECT count(*) AS rows, sum(CASE WHEN state IS NULL THEN 1 ELSE 0 END) AS null_state,
  sum(CASE WHEN county_code IS NULL THEN 1 ELSE 0 END) AS null_county, sum(CASE WHEN zip_code IS NULL THEN 1 ELSE 0 END) AS null_zip,
  sum(CASE WHEN lat IS NULL THEN 1 ELSE 0 END) AS null_lat, avg(unique_drugs) AS avg_unique_drugs,
  avg(fills_target) AS avg_fills_target, avg(total_rx_cost_est) AS avg_total_rx_cost, sum(insulin_user_flag) AS insulin_users,
  sum(CASE WHEN risk_segment = 'LOW' THEN 1 ELSE 0 END) AS risk_low, sum(CASE WHEN risk_segment = 'MED' THEN 1 ELSE 0 END) AS risk_med,
  sum(CASE WHEN risk_segment = 'HIGH' THEN 1 ELSE 0 END) AS risk_high
FROM beneficiary
""")


def _r2(x):
    return f"round(CAST({x} AS decimal(24,6)), 2)::double"


register("G17_pair_statistics", ["o_training_pairs"], f"""
SELECT count(*) AS total_pairs, count(DISTINCT bene_synth_id) AS unique_benes, count(DISTINCT plan_key) AS unique_plans,
  {_r2('avg(estimated_annual_oop)')} AS avg_oop, {_r2('avg(oop_copay_component)')} AS avg_oop_copay,
  {_r2('avg(oop_coinsurance_component)')} AS avg_oop_coins, {_r2('avg(oop_deductible_component)')} AS avg_oop_deductible,
  {_r2('avg(oop_uncovered_component)')} AS avg_oop_uncovered,
  {_r2('100.0 * sum(CASE WHEN estimated_annual_oop > 20000 THEN 1 ELSE 0 END) / count(*)')} AS pct_oop_gt_20k,
  {_r2('avg(distance_miles)')} AS avg_distance, sum(CASE WHEN has_distance_tradeoff THEN 1 ELSE 0 END) AS tradeoff_pairs,
  {_r2('100.0 * sum(CASE WHEN has_distance_tradeoff THEN 1 ELSE 0 END) / count(*)')} AS tradeoff_pct,
  {_r2('quantile_cont(estimated_annual_oop, 0.5)')} AS p50_oop, {_r2('quantile_cont(estimated_annual_oop, 0.9)')} AS p90_oop,
  {_r2('quantile_cont(estimated_annual_oop, 0.99)')} AS p99_oop
FROM o_training_pairs
""")
register("M4_source_rule_violations", ["beneficiary_cost", "pricing", "pharmacy_network", "plan_info"], """
SELECT 'beneficiary_cost' AS table_name, concat_ws('|', plan_key, tier, days_supply, coverage_level) AS row_key, 'days_supply_domain' AS rule
  FROM beneficiary_cost WHERE days_supply NOT IN (1, 2, 3, 4)
UNION ALL SELECT 'beneficiary_cost', concat_ws('|', plan_key, tier, days_supply, coverage_level), 'coverage_level_domain'
  FROM beneficiary_cost WHERE coverage_level NOT IN (0, 1, 3)
UNION ALL SELECT 'beneficiary_cost', concat_ws('|', plan_key, tier, days_supply, coverage_level), 'cost_type_domain'
  FROM beneficiary_cost WHERE cost_type_pref NOT IN (0, 1, 2)
UNION ALL SELECT 'pricing', concat_ws('|', plan_key, ndc, days_supply), 'non_positive_unit_cost' FROM pricing WHERE unit_cost <= 0
UNION ALL SELECT 'pharmacy_network', concat_ws('|', plan_key, pharmacy_number), 'floor_below_fee' FROM pharmacy_network
  WHERE floor_price < least(brand_dispensing_fee_30, brand_dispensing_fee_60, brand_dispensing_fee_90,
                            generic_dispensing_fee_30, generic_dispensing_fee_60, generic_dispensing_fee_90)
UNION ALL SELECT 'pharmacy_network', concat_ws('|', plan_key, pharmacy_number), 'neither_retail_nor_mail' FROM pharmacy_network
  WHERE upper(pharmacy_retail) <> 'Y' AND upper(pharmacy_mail) <> 'Y'
UNION ALL SELECT 'beneficiary_cost', plan_key, 'unknown_plan_key' FROM (
  SELECT DISTINCT plan_key FROM beneficiary_cost WHERE plan_key NOT IN (SELECT plan_key FROM plan_info))
""")
register("M5_risk_distribution", ["beneficiary"], """
SELECT risk_segment, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM beneficiary GROUP BY 1
""")
register("M6_tradeoff_top_plans", ["o_training_pairs"], """
SELECT plan_key, count(DISTINCT bene_synth_id) AS beneficiaries FROM o_training_pairs WHERE has_distance_tradeoff
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
""")
register("M6_rates_by_restrictiveness", ["o_formulary_metrics"], """
SELECT restrictiveness_class, count(*) AS plans, avg(pa_rate) AS avg_pa_rate, avg(st_rate) AS avg_st_rate,
  avg(ql_rate) AS avg_ql_rate FROM o_formulary_metrics GROUP BY 1
""")
register("M6_formulary_network_by_plan", ["o_formulary_metrics", "o_network_metrics"], """
SELECT f.plan_key, f.total_drugs, f.restrictiveness_class, n.total_pharmacies, n.preferred_pharmacies, n.network_adequacy_flag
FROM o_formulary_metrics f JOIN o_network_metrics n ON n.plan_key = f.plan_key
""")
register("M7_pair_geography_mismatches", ["o_training_pairs", "plan_info"], """
SELECT bene_synth_id, plan_key, county_code FROM o_training_pairs t
WHERE NOT EXISTS (SELECT 1 FROM plan_info p WHERE p.plan_key = t.plan_key AND p.county_code = t.county_code)
""")
