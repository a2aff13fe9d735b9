"""Oracle CTEs: gold metrics, geography, distance features (DuckDB SQL)."""

from oracle.registry import cte

R2 = "round(cast({x} AS decimal(24,6)), 2)::double"


def r2(x: str) -> str:
    return R2.format(x=x)


cte("o_active_plans", ("plan_info",), """
SELECT * FROM plan_info WHERE plan_suppressed_yn IS NULL OR plan_suppressed_yn <> 'Y'
""")

# D1 - literal OR-join against the insulin reference, as the pipeline states it
cte("o_formulary_stats", ("o_active_plans", "formulary", "insulin_ref"), """
SELECT pf.plan_key,
  count(DISTINCT f.ndc) AS total_drugs,
  avg(f.tier_level_value) AS avg_tier_raw,
  sum(CASE WHEN f.tier_level_value <= 2 THEN 1 ELSE 0 END) AS generic_tier_count,
  sum(CASE WHEN f.tier_level_value >= 3 AND f.tier_level_value < 5 THEN 1 ELSE 0 END) AS brand_tier_count,
  sum(CASE WHEN f.tier_level_value >= 5 THEN 1 ELSE 0 END) AS specialty_tier_count,
  100.0 * sum(CASE WHEN upper(f.prior_authorization_yn) = 'Y' THEN 1 ELSE 0 END) / nullif(count(*), 0) AS pa_raw,
  100.0 * sum(CASE WHEN upper(f.step_therapy_yn) = 'Y' THEN 1 ELSE 0 END) / nullif(count(*), 0) AS st_raw,
  100.0 * sum(CASE WHEN upper(f.quantity_limit_yn) = 'Y' THEN 1 ELSE 0 END) / nullif(count(*), 0) AS ql_raw,
  avg(CAST(CASE WHEN upper(f.prior_authorization_yn) = 'Y' THEN 1 ELSE 0 END AS double)
    + CAST(CASE WHEN upper(f.step_therapy_yn) = 'Y' THEN 1 ELSE 0 END AS double)
    + CAST(CASE WHEN upper(f.quantity_limit_yn) = 'Y' THEN 1 ELSE 0 END AS double)) AS rc_raw,
  count(DISTINCT CASE WHEN ir.ndc IS NOT NULL THEN f.ndc
                      WHEN ir.rxcui IS NOT NULL AND f.rxcui IS NOT NULL THEN f.rxcui END) AS insulin_drug_count
FROM (SELECT DISTINCT plan_key, formulary_id FROM o_active_plans WHERE formulary_id IS NOT NULL) pf
JOIN formulary f ON f.formulary_id = pf.formulary_id
LEFT JOIN insulin_ref ir ON f.ndc = ir.ndc OR f.rxcui = ir.rxcui
GROUP BY pf.plan_key
""")

cte("o_formulary_metrics", ("o_formulary_stats",), f"""
SELECT plan_key, total_drugs,
  {r2('least(100.0, total_drugs / 20.0)')} AS formulary_breadth_pct,
  generic_tier_count, brand_tier_count, specialty_tier_count,
  {r2('100.0 * generic_tier_count / nullif(total_drugs, 0)')} AS generic_tier_pct,
  {r2('100.0 * specialty_tier_count / nullif(total_drugs, 0)')} AS specialty_tier_pct,
  {r2('avg_tier_raw')} AS avg_tier,
  {r2('pa_raw')} AS pa_rate,
  {r2('st_raw')} AS st_rate,
  {r2('ql_raw')} AS ql_rate,
  {r2('rc_raw')} AS avg_restriction_count,
  ntile(3) OVER (ORDER BY {r2('rc_raw')} ASC NULLS FIRST, plan_key) - 1 AS restrictiveness_class,
  insulin_drug_count,
  {r2('100.0 * insulin_drug_count / nullif(total_drugs, 0)')} AS insulin_coverage_pct
FROM o_formulary_stats
""")

# B11 flags + D2
cte("o_network", ("pharmacy_network",), """
SELECT *,
  upper(trim(preferred_status_retail)) = 'Y' AS is_preferred_retail,
  upper(trim(preferred_status_mail)) = 'Y' AS is_preferred_mail,
  upper(trim(pharmacy_retail)) = 'Y' AS offers_retail,
  upper(trim(pharmacy_mail)) = 'Y' AS offers_mail,
  CAST(in_area_flag AS int) = 1 AS is_in_area,
  (brand_dispensing_fee_30 + brand_dispensing_fee_60 + brand_dispensing_fee_90) / 3 AS avg_brand_fee,
  (generic_dispensing_fee_30 + generic_dispensing_fee_60 + generic_dispensing_fee_90) / 3 AS avg_generic_fee
FROM pharmacy_network
""")

cte("o_network_metrics", ("o_network",), f"""
SELECT plan_key,
  count(DISTINCT pharmacy_number) AS total_pharmacies,
  sum(CASE WHEN is_preferred_retail THEN 1 ELSE 0 END) AS preferred_pharmacies_retail,
  sum(CASE WHEN is_preferred_mail THEN 1 ELSE 0 END) AS preferred_pharmacies_mail,
  sum(CASE WHEN is_preferred_retail OR is_preferred_mail THEN 1 ELSE 0 END) AS preferred_pharmacies,
  {r2("100.0 * sum(CASE WHEN is_preferred_retail OR is_preferred_mail THEN 1 ELSE 0 END) / nullif(count(DISTINCT pharmacy_number), 0)")} AS pref_pharmacy_pct,
  sum(CASE WHEN offers_retail THEN 1 ELSE 0 END) AS retail_pharmacies,
  sum(CASE WHEN offers_mail THEN 1 ELSE 0 END) AS mail_pharmacies,
  sum(CASE WHEN is_in_area THEN 1 ELSE 0 END) AS in_area_pharmacies,
  {r2("100.0 * sum(CASE WHEN is_in_area THEN 1 ELSE 0 END) / nullif(count(DISTINCT pharmacy_number), 0)")} AS in_area_pct,
  CASE WHEN sum(CASE WHEN is_preferred_retail OR is_preferred_mail THEN 1 ELSE 0 END) < 10 THEN 1 ELSE 0 END AS network_adequacy_flag,
  max(CASE WHEN offers_mail THEN 1 ELSE 0 END) AS mail_order_available,
  avg(avg_brand_fee) AS avg_brand_dispensing_fee,
  avg(avg_generic_fee) AS avg_generic_dispensing_fee,
  avg(floor_price) AS avg_floor_price
FROM o_network GROUP BY plan_key
""")

# County code of each ZIP from (state, county name)
cte("o_zip_county", ("zipcode", "geographic"), """
SELECT zip_code, city, state, county, lat, lng, population, density, county_code FROM (
  SELECT z.*, g.county_code,
    row_number() OVER (PARTITION BY z.zip_code
                       ORDER BY CASE WHEN g.state_label = z.state THEN 0 ELSE 1 END, g.county_code NULLS LAST) AS rn
  FROM zipcode z
  LEFT JOIN geographic g
    ON upper(trim(g.county)) = upper(trim(z.county)) AND (g.state_label IS NULL OR g.state_label = z.state)
) WHERE rn = 1
""")

# D12
cte("o_county_density", ("o_zip_county",), """
SELECT CAST(county_code AS varchar) AS county_code, avg(coalesce(CAST(density AS double), 0)) AS avg_density,
  count(*) AS zip_count
FROM o_zip_county WHERE county_code IS NOT NULL GROUP BY county_code
""")

# E9
cte("o_distance_base", ("o_active_plans", "o_county_density", "o_network_metrics"), """
SELECT pc.plan_key, pc.contract_type, pc.state, pc.county_code,
  coalesce(cd.avg_density, 100.0) AS county_avg_density,
  coalesce(CAST(cd.zip_count AS int), 1) AS county_zip_count,
  greatest(coalesce(CAST(nm.preferred_pharmacies AS double),
    CASE pc.contract_type WHEN 'PDP' THEN 25.0 WHEN 'MA' THEN 15.0 ELSE 20.0 END), 0.0) AS preferred_pharmacies,
  greatest(coalesce(CAST(nm.total_pharmacies AS double), 30.0), 0.0) AS total_pharmacies,
  coalesce(CAST(nm.pref_pharmacy_pct AS double), 50.0) AS pref_pharmacy_pct,
  coalesce(CAST(nm.in_area_pharmacies AS double), 20.0) AS in_area_pharmacies
FROM (
  SELECT DISTINCT plan_key,
    CASE WHEN is_ma_pd THEN 'MA' WHEN is_pdp THEN 'PDP' END AS contract_type,
    CAST(state AS varchar) AS state, lpad(CAST(CAST(CAST(county_code AS double) AS bigint) AS varchar), 5, '0') AS county_code
  FROM o_active_plans WHERE state IS NOT NULL AND county_code IS NOT NULL
) pc
LEFT JOIN o_county_density cd ON cd.county_code = pc.county_code
LEFT JOIN o_network_metrics nm ON nm.plan_key = pc.plan_key
""")

cte("o_distance_features", ("o_distance_base",), """
SELECT plan_key, contract_type, state, county_code, county_avg_density, county_zip_count, preferred_pharmacies,
  total_pharmacies, pref_pharmacy_pct, in_area_pharmacies, miles AS simulated_distance_miles,
  CASE WHEN miles < 3 THEN 'very_close' WHEN miles < 8 THEN 'nearby' WHEN miles < 15 THEN 'moderate' ELSE 'far' END
    AS distance_category
FROM (
  SELECT *, round(CASE WHEN hi <= lo THEN lo ELSE lo + (hi - lo) *
      (CAST(('0x' || substr(sha256(concat('42|', plan_key, '|', county_code)), 1, 16)) AS UBIGINT)
       / 18446744073709551615.0) END, 6) AS miles
  FROM (
    SELECT *,
      CASE WHEN county_avg_density >= 1000 AND preferred_pharmacies >= 20 THEN 0.5
           WHEN county_avg_density >= 250 AND county_avg_density < 1000 AND preferred_pharmacies >= 10 THEN 2.0
           WHEN county_avg_density < 250 OR preferred_pharmacies < 10 THEN 8.0 ELSE 5.0 END AS lo,
      CASE WHEN county_avg_density >= 1000 AND preferred_pharmacies >= 20 THEN 2.0
           WHEN county_avg_density >= 250 AND county_avg_density < 1000 AND preferred_pharmacies >= 10 THEN 8.0
           WHEN county_avg_density < 250 OR preferred_pharmacies < 10 THEN 25.0 ELSE 15.0 END AS hi
    FROM o_distance_base
  )
)
""")
