"""Oracle SQL for geography / access and claims queries."""

from oracle import gold  # noqa: F401
from oracle.queries_decision import norm  # noqa: F401  (registers o_j_cands)
from oracle.queries_misc import sf  # noqa: F401  (registers o_pool)
from oracle.registry import cte, register


def acos_sql(a1, o1, a2, o2):
    return (f"6371.0 * acos(least(1.0, greatest(-1.0, cos(radians({a1})) * cos(radians({a2})) * cos(radians({o2}) - radians({o1}))"
            f" + sin(radians({a1})) * sin(radians({a2}))))) * 0.621371")


cte("o_centroids", ("o_zip_county",), """
SELECT county_code, county, state, avg(lat) AS c_lat, avg(lng) AS c_lng FROM o_zip_county
WHERE county_code IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL GROUP BY 1, 2, 3
""")
register("E1_E2_distances", ["beneficiary", "o_centroids"], f"""
SELECT b.bene_synth_id, c.county_code,
  3959.0 * 2 * atan2(sqrt(pow(sin(radians(c.c_lat - b.lat) / 2), 2) + cos(radians(b.lat)) * cos(radians(c.c_lat))
    * pow(sin(radians(c.c_lng - b.lng) / 2), 2)), sqrt(1 - (pow(sin(radians(c.c_lat - b.lat) / 2), 2)
    + cos(radians(b.lat)) * cos(radians(c.c_lat)) * pow(sin(radians(c.c_lng - b.lng) / 2), 2)))) AS haversine_miles,
  {acos_sql('b.lat', 'b.lng', 'c.c_lat', 'c.c_lng')} AS acos_miles
FROM beneficiary b JOIN o_centroids c ON c.state = b.state
""")
register("E7_E8_distance_classes", ["o_distance_features"], """
SELECT plan_key, county_code,
  CASE WHEN m < 3 THEN 'very_close' WHEN m < 8 THEN 'nearby' WHEN m < 15 THEN 'moderate' ELSE 'far' END AS training_category,
  CASE WHEN m < 0.5 THEN 'Local' WHEN m <= 10 THEN 'Nearby' WHEN m <= 25 THEN 'Moderate' ELSE 'Distant' END AS display_category,
  CASE WHEN m > 15 THEN 200.0 WHEN m > 8 THEN 100.0 ELSE 0.0 END AS penalty,
  CASE WHEN m > 15 THEN 200.0 WHEN m > 8 THEN 100.0 ELSE 0.0 END * (75.0 / 50.0) AS penalty_weight_75
FROM (SELECT plan_key, county_code, simulated_distance_miles AS m FROM o_distance_features)
""")
cte("o_nearby", ("requests", "o_zip_county", "o_centroids"), f"""
SELECT * FROM (
  SELECT r.request_id AS origin_id, c.county_code, c.county, c.state,
    round(CAST({acos_sql('z.lat', 'z.lng', 'c.c_lat', 'c.c_lng')} AS decimal(24,6)), 1)::double AS distance_miles
  FROM requests r JOIN o_zip_county z ON z.zip_code = r.zip_code JOIN o_centroids c ON c.state = z.state
) WHERE distance_miles <= 50.0
""")
register("E3_nearby_counties", ["o_nearby"], "SELECT * FROM o_nearby")
cte("o_links", ("o_network", "o_zip_county", "plan_info"), """
SELECT p.county_code, n.plan_key, n.pharmacy_number, n.pharmacy_zipcode, p.premium, p.plan_name, n.is_preferred_retail,
  n.is_preferred_mail, z.city, z.state AS z_state, z.county, z.lat, z.lng
FROM o_network n
JOIN o_zip_county z ON z.zip_code = n.pharmacy_zipcode AND z.lat IS NOT NULL AND z.lng IS NOT NULL
JOIN plan_info p ON p.plan_key = n.plan_key AND z.county_code = p.county_code
""")
register("E6_county_pharmacy_links", ["o_links"], """
SELECT county_code, plan_key, pharmacy_number, pharmacy_zipcode, premium, is_preferred_retail FROM o_links
""")
cte("o_d19", ("o_links",), """
SELECT *, row_number() OVER (PARTITION BY county_code ORDER BY plans_served DESC, preferred_plan_links DESC, pharmacy_number) AS rank
FROM (
  SELECT county_code, pharmacy_number, count(DISTINCT plan_key) AS plans_served,
    sum(CAST(coalesce(is_preferred_retail, false) OR coalesce(is_preferred_mail, false) AS integer)) AS preferred_plan_links,
    avg(premium) AS avg_premium,
    array_to_string(list_slice(list_sort(list_distinct(list(plan_name))), 1, 6), ', ') AS sample_plan_names
  FROM o_links GROUP BY county_code, pharmacy_number, pharmacy_zipcode, city, z_state, county, lat, lng
)
""")
register("D19_county_pharmacy_summary", ["o_d19"], "SELECT * FROM o_d19")
register("D20_county_access_headline", ["o_d19"], """
SELECT county_code, count(*) AS pharmacies, sum(CASE WHEN preferred_plan_links > 0 THEN 1 ELSE 0 END) AS pharmacies_with_preferred,
  max(plans_served) AS max_plans_served FROM o_d19 GROUP BY 1
""")
register("E10_representative_zip", ["o_zip_county"], """
SELECT county_code, zip_code, city, state FROM (SELECT *, row_number() OVER (PARTITION BY county_code
  ORDER BY population DESC NULLS LAST, zip_code) AS rn FROM o_zip_county WHERE county_code IS NOT NULL) WHERE rn = 1
""")
cte("o_comp", ("o_nearby", "requests", "plan_info"), """
SELECT request_id, plan_key, distance_miles, eligibility_status, location_county FROM (
  SELECT n.origin_id AS request_id, p.plan_key, n.distance_miles, 'Comparison only - outside selected service area' AS eligibility_status,
    n.county AS location_county,
    row_number() OVER (PARTITION BY n.origin_id, p.plan_key ORDER BY n.distance_miles, CAST(p.premium AS double), p.plan_key) AS rn
  FROM o_nearby n JOIN requests r ON r.request_id = n.origin_id AND n.county_code <> r.county_code
  JOIN plan_info p ON p.county_code = n.county_code AND p.state = n.state AND p.premium IS NOT NULL
    AND (p.plan_suppressed_yn IS NULL OR p.plan_suppressed_yn <> 'Y')
) WHERE rn = 1
""")
register("E12_nearby_comparison_plans", ["o_comp"], "SELECT * FROM o_comp")
register("E11_plans_with_fallback", ["o_j_cands", "o_comp"], """
SELECT request_id, plan_key, true AS is_local, 0.0 AS distance_miles FROM o_j_cands
UNION ALL SELECT request_id, plan_key, false, distance_miles FROM o_comp
WHERE request_id NOT IN (SELECT request_id FROM o_j_cands)
""")
register("D14_pde_drug_stats", ["pde_events"], """
SELECT prod_srvc_id, count(*) AS fills, avg(tot_rx_cst_amt) AS mean_cost,
  coalesce(stddev_samp(tot_rx_cst_amt), avg(tot_rx_cst_amt) * 0.30) AS std_cost,
  avg(CASE WHEN brnd_gnrc_cd = 'B' THEN 1.0 ELSE 0.0 END) AS brand_share,
  quantile_cont(CAST(days_suply_num AS double), 0.5) AS p50_days_supply
FROM pde_events GROUP BY 1
""")
cte("o_d15", ("pde_events",), """
SELECT a.bene_id, a.prod_srvc_id, a.fills_per_year, m.d AS days_supply_mode, a.qty_per_fill, a.estimated_annual_drug_cost
FROM (SELECT bene_id, prod_srvc_id, count(*) AS fills_per_year, avg(qty_dspnsd_num) AS qty_per_fill,
        sum(tot_rx_cst_amt) AS estimated_annual_drug_cost FROM pde_events GROUP BY 1, 2) a
JOIN (SELECT bene_id, prod_srvc_id, d FROM (SELECT bene_id, prod_srvc_id, days_suply_num AS d, row_number() OVER (
        PARTITION BY bene_id, prod_srvc_id ORDER BY count(*) DESC, days_suply_num) AS rn FROM pde_events GROUP BY 1, 2, 3)
      WHERE rn = 1) m ON m.bene_id = a.bene_id AND m.prod_srvc_id = a.prod_srvc_id
""")
register("D15_bene_drug_profile", ["o_d15"], "SELECT * FROM o_d15")
register("D16_prescriptions_from_claims", ["o_d15", "o_pool", "drug_names"], """
SELECT d.bene_id AS bene_synth_id, d.prod_srvc_id AS ndc, p.rxcui,
  coalesce(nullif(trim(n.drug_name), ''), nullif(trim(n.drug_synonym), ''), 'NDC ' || d.prod_srvc_id) AS drug_name,
  CASE WHEN nullif(trim(n.drug_name), '') IS NOT NULL THEN 'rxcui_name' WHEN nullif(trim(n.drug_synonym), '') IS NOT NULL
       THEN 'rxcui_synonym' ELSE 'ndc_fallback' END AS drug_name_source,
  d.fills_per_year, d.days_supply_mode, d.qty_per_fill, p.tier_level, p.has_prior_auth, p.has_step_therapy,
  p.has_quantity_limit, p.is_insulin, d.estimated_annual_drug_cost, 'pde' AS source_mode
FROM o_d15 d JOIN o_pool p ON p.ndc = d.prod_srvc_id
LEFT JOIN (SELECT rxcui, drug_name, drug_synonym FROM (SELECT *, row_number() OVER (PARTITION BY rxcui ORDER BY
    CASE upper(tty) WHEN 'IN' THEN 1 WHEN 'PIN' THEN 2 WHEN 'MIN' THEN 3 WHEN 'SCD' THEN 4 WHEN 'SBD' THEN 5
      WHEN 'GPCK' THEN 6 WHEN 'BPCK' THEN 7 ELSE 99 END, coalesce(length(drug_name), 9999), drug_name, drug_synonym, tty) AS rn
    FROM drug_names WHERE rxcui <> '') WHERE rn = 1) n ON n.rxcui = p.rxcui
""")
register("D17_bene_year_summary", ["pde_events", "insulin_ref"], """
SELECT bene_id, count(*) AS fills, count(DISTINCT prod_srvc_id) AS unique_drugs, sum(tot_rx_cst_amt) AS total_rx_cost,
  sum(CASE WHEN ins = 1 THEN 1 ELSE 0 END) AS insulin_fills, sum(CASE WHEN ins = 1 THEN tot_rx_cst_amt ELSE 0.0 END) AS insulin_rx_cost,
  CASE WHEN sum(tot_rx_cst_amt) > 0 THEN sum(CASE WHEN ins = 1 THEN tot_rx_cst_amt ELSE 0.0 END) / sum(tot_rx_cst_amt) ELSE 0.0 END
    AS insulin_cost_share
FROM (SELECT e.*, coalesce(i.ins, 0) AS ins FROM pde_events e
      LEFT JOIN (SELECT DISTINCT ndc, 1 AS ins FROM insulin_ref WHERE ndc IS NOT NULL) i ON i.ndc = e.prod_srvc_id)
GROUP BY 1
""")
register("D18_aligned_beneficiaries", ["beneficiary", "prescriptions"], """
SELECT b.bene_synth_id, s.unique_drugs, s.fills_target, s.total_rx_cost_est, s.insulin_user_flag,
  CASE WHEN coalesce(s.total_rx_cost_est, 0) <= 2000 THEN 'LOW' WHEN coalesce(s.total_rx_cost_est, 0) <= 5000 THEN 'MED'
       ELSE 'HIGH' END AS risk_segment
FROM beneficiary b JOIN (SELECT bene_synth_id, count(DISTINCT ndc) AS unique_drugs, CAST(sum(fills_per_year) AS integer) AS fills_target,
    sum(estimated_annual_drug_cost) AS total_rx_cost_est, max(CAST(is_insulin AS integer)) AS insulin_user_flag
    FROM prescriptions GROUP BY 1) s ON s.bene_synth_id = b.bene_synth_id
""")
