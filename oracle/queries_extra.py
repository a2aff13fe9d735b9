"""Oracle SQL for the remaining expression-level and projection operators."""

from oracle import gold  # noqa: F401
from oracle.queries_decision import norm  # noqa: F401
from oracle.queries_geo_claims import acos_sql  # noqa: F401  (registers o_nearby, o_comp)
from oracle.registry import register

register("A4_zip_csv_ingest", ["o_zip_county"], "SELECT zip_code, city, state, county, lat, lng, CAST(population AS double) AS population, "
         "CAST(density AS double) AS density, county_code FROM o_zip_county")
register("A5_insulin_ref_ingest", ["insulin_ref"], """
SELECT ndc, rxcui, source, CAST(source_year AS varchar) AS source_year, CAST(is_insulin AS varchar) AS is_insulin
FROM insulin_ref WHERE is_insulin = 1
""")
register("A13_layout_by_key", ["formulary"], "SELECT formulary_id, ndc, rxcui, tier_level_value FROM formulary")
register("B6_region_codes_numeric", ["plan_info"], """
SELECT plan_key, county_code, TRY_CAST(nullif(trim(ma_region_code), '') AS integer) AS ma_region_code,
  TRY_CAST(nullif(trim(pdp_region_code), '') AS integer) AS pdp_region_code FROM plan_info
""")
register("B18_slv_geography", ["geographic"], """
SELECT lpad(upper(trim(county_code)), 5, '0') AS county_code, upper(trim(statename)) AS statename, upper(trim(county)) AS county,
  lpad(upper(trim(ma_region_code)), 2, '0') AS ma_region_code, lpad(upper(trim(pdp_region_code)), 2, '0') AS pdp_region_code
FROM geographic
""")
register("B25_ndc11_from_formatted", ["prescriptions"], """
SELECT ndc, formatted, lpad(split_part(formatted, '-', 1), 5, '0') || lpad(split_part(formatted, '-', 2), 4, '0')
  || lpad(split_part(formatted, '-', 3), 2, '0') AS ndc11
FROM (SELECT DISTINCT ndc, substring(ndc, 2, 4) || '-' || substring(ndc, 6, 4) || '-' || substring(ndc, 10, 2) AS formatted
      FROM prescriptions)
""")
register("B27_insulin_drug_ref", ["insulin_ref", "formulary"], """
SELECT i.ndc, f.rxcui FROM (SELECT DISTINCT ndc FROM insulin_ref WHERE ndc IS NOT NULL) i
LEFT JOIN (SELECT DISTINCT ndc, rxcui FROM formulary) f ON f.ndc = i.ndc
""")
register("B28_B30_clean_keys", ["pharmacy_network", "plan_info"], """
SELECT n.plan_key, replace(replace(trim(n.pharmacy_zipcode || '-' || ' 01'), '-', ''), ' ', '') AS cleaned,
  CASE WHEN p.is_ma_pd THEN 'MA' WHEN p.is_pdp THEN 'PDP' END AS contract_type,
  CASE WHEN p.is_ma_pd THEN 'MA' WHEN p.is_pdp THEN 'PDP' ELSE 'Other' END AS contract_type_other
FROM (SELECT DISTINCT plan_key, pharmacy_zipcode FROM pharmacy_network) n
JOIN (SELECT DISTINCT plan_key, is_ma_pd, is_pdp FROM plan_info) p ON p.plan_key = n.plan_key
""")
register("C8_fact_beneficiary_cost", ["beneficiary_cost"], """
SELECT plan_key, coverage_level, tier, days_supply, cost_type_pref, cost_amt_pref, ded_applies_yn FROM beneficiary_cost
""")
register("C10_fact_pharmacy_network", ["pharmacy_network"], """
SELECT plan_key, pharmacy_number, pharmacy_zipcode, preferred_status_retail, in_area_flag, floor_price FROM pharmacy_network
""")
register("C11_fact_formulary_drug", ["formulary"], """
SELECT formulary_id, ndc, rxcui, tier_level_value, prior_authorization_yn, step_therapy_yn, quantity_limit_yn FROM formulary
""")
register("J22_county_plans_by_premium", ["plan_info"], """
SELECT state, county_code, plan_key, plan_name, premium, deductible,
  row_number() OVER (PARTITION BY state, county_code ORDER BY premium ASC NULLS LAST, plan_key) AS premium_rank
FROM plan_info WHERE plan_suppressed_yn <> 'Y'
""")

register("A13_curve_layout", ["pharmacy_network"], "SELECT plan_key, pharmacy_number, pharmacy_zipcode, floor_price FROM pharmacy_network")
