"""Oracle SQL for bronze / silver / dimension / gold-extra queries (DuckDB)."""

from oracle import gold  # noqa: F401
from oracle.registry import cte, register

CH = ("pref", "nonpref", "mail_pref", "mail_nonpref")


def r2(x: str, s: int = 2) -> str:
    return f"round(CAST({x} AS decimal(24,6)), {s})::double"


register("B1_plan_key_with_segment", ["beneficiary_cost"], """
SELECT upper(trim(contract_id)) AS contract_id, trim(plan_id) AS plan_id, coalesce(trim(segment_id), '000') AS segment_id,
  upper(trim(contract_id)) || trim(plan_id) || coalesce(trim(segment_id), '000') AS plan_key, tier, days_supply, coverage_level
FROM beneficiary_cost
""")
register("B2_plan_key_no_segment", ["excluded_drugs"], """
SELECT upper(trim(contract_id)) AS contract_id, trim(plan_id) AS plan_id,
  upper(trim(contract_id)) || trim(plan_id) || '000' AS plan_key, rxcui
FROM excluded_drugs
""")
register("B3_formulary_id_surrogate", ["excluded_drugs"], """
SELECT plan_key, rxcui, trim(contract_id) || trim(plan_id) AS formulary_id FROM excluded_drugs
""")
register("B5_record_hash", ["plan_info"], """
SELECT plan_key, county_code, sha256(concat_ws('||',
  coalesce(CAST(contract_id AS varchar), '∅'), coalesce(CAST(plan_id AS varchar), '∅'),
  coalesce(CAST(segment_id AS varchar), '∅'), coalesce(CAST(plan_key AS varchar), '∅'),
  coalesce(CAST(formulary_id AS varchar), '∅'), coalesce(CAST(state AS varchar), '∅'),
  coalesce(CAST(county_code AS varchar), '∅'), coalesce(CAST(plan_suppressed_yn AS varchar), '∅'),
  coalesce(CAST(snp AS varchar), '∅'))) AS record_hash
FROM plan_info
""")
register("B7_formulary_derive", ["formulary"], """
SELECT trim(formulary_id) AS formulary_id, trim(ndc) AS ndc, trim(formulary_id) || '_' || trim(ndc) AS form_drug_key,
  upper(trim(quantity_limit_yn)) = 'Y' AS has_quantity_limit, upper(trim(prior_authorization_yn)) = 'Y' AS has_prior_auth,
  upper(trim(step_therapy_yn)) = 'Y' AS has_step_therapy,
  CAST(upper(trim(quantity_limit_yn)) = 'Y' AS integer) + CAST(upper(trim(prior_authorization_yn)) = 'Y' AS integer)
    + CAST(upper(trim(step_therapy_yn)) = 'Y' AS integer) AS restriction_count,
  tier_level_value <= 2 AS is_generic_tier, tier_level_value >= 3 AND tier_level_value < 5 AS is_brand_tier,
  tier_level_value >= 5 AS is_specialty_tier
FROM formulary
""")
register("B8_excluded_derive", ["excluded_drugs"], """
SELECT upper(trim(contract_id)) || trim(plan_id) || '000' AS plan_key, trim(rxcui) AS rxcui, CAST(tier AS double) AS tier,
  trim(quantity_limit_yn) IN ('1', 'Y') AS has_quantity_limit, upper(trim(prior_auth_yn)) = 'Y' AS has_prior_auth,
  upper(trim(step_therapy_yn)) = 'Y' AS has_step_therapy, upper(trim(capped_benefit_yn)) = 'Y' AS has_capped_benefit,
  tier IS NULL AS completely_excluded, tier IS NOT NULL AS conditionally_covered
FROM excluded_drugs
""")
register("B9_indication_coverage", ["indication_coverage"], """
SELECT plan_key, rxcui, disease, concat_ws('_', plan_key, rxcui, disease) AS indication_key,
  count(*) OVER (PARTITION BY plan_key, rxcui) AS indications_per_drug
FROM (SELECT upper(trim(contract_id)) || trim(plan_id) || '000' AS plan_key, trim(rxcui) AS rxcui, trim(disease) AS disease
      FROM indication_coverage)
""")

_best = "CASE " + " ".join(
    f"WHEN CAST(cost_amt_{c} AS double) = least(cost_amt_pref, cost_amt_nonpref, cost_amt_mail_pref, cost_amt_mail_nonpref) "
    f"THEN '{c.upper()}'" for c in CH) + " END"


def _ctl(c: str) -> str:
    return (f"CASE WHEN cost_type_{c} = 0 THEN 'not_offered' WHEN cost_type_{c} = 1 THEN 'copay' "
            f"WHEN cost_type_{c} = 2 THEN 'coinsurance' END")


register("B10_cost_derive", ["beneficiary_cost"], f"""
SELECT upper(trim(contract_id)) || trim(plan_id) || coalesce(trim(segment_id), '000') || '_T' || CAST(CAST(tier AS double) AS varchar)
    || '_C' || CAST(CAST(coverage_level AS integer) AS varchar) || '_D' || CAST(CAST(days_supply AS integer) AS varchar) AS cost_key,
  TRY_CAST(trim(cost_min_amt_pref) AS double) AS cost_min_amt_pref,
  TRY_CAST(trim(cost_min_amt_mail_nonpref) AS double) AS cost_min_amt_mail_nonpref,
  upper(trim(tier_specialty_yn)) = 'Y' AS is_specialty_tier, upper(trim(ded_applies_yn)) = 'Y' AS deductible_applies,
  CASE WHEN days_supply = 1 THEN '30_days' WHEN days_supply = 2 THEN '90_days' WHEN days_supply = 4 THEN '60_days' ELSE 'other' END AS days_supply_label,
  CASE WHEN coverage_level = 0 THEN 'pre_deductible' WHEN coverage_level = 1 THEN 'initial_coverage'
       WHEN coverage_level = 3 THEN 'catastrophic' ELSE 'other' END AS coverage_level_label,
  {_ctl('pref')} AS cost_type_pref_label, {_ctl('mail_nonpref')} AS cost_type_mail_nonpref_label,
  least(cost_amt_pref, cost_amt_nonpref, cost_amt_mail_pref, cost_amt_mail_nonpref) AS min_cost,
  greatest(cost_amt_pref, cost_amt_nonpref, cost_amt_mail_pref, cost_amt_mail_nonpref) AS max_cost,
  {_best} AS best_pharmacy_type
FROM beneficiary_cost
""")
register("B11_network_derive", ["o_network"], """
SELECT concat_ws('_', plan_key, trim(pharmacy_number)) AS network_key, is_preferred_retail, is_preferred_mail,
  offers_retail, offers_mail, is_in_area, avg_brand_fee, avg_generic_fee,
  CASE WHEN is_preferred_mail AND offers_mail THEN 'preferred_mail' WHEN is_preferred_retail THEN 'preferred_retail'
       ELSE 'standard' END AS pharmacy_type
FROM o_network
""")

cte("o_slv_plan", ("plan_info",), """
SELECT plan_key, lpad(upper(trim(CAST(county_code AS varchar))), 5, '0') AS county_code, upper(trim(contract_id)) AS contract_id,
  lpad(upper(trim(CAST(plan_id AS varchar))), 3, '0') AS plan_id, lpad(upper(trim(CAST(segment_id AS varchar))), 3, '0') AS segment_id,
  lpad(upper(trim(CAST(state AS varchar))), 2, '0') AS state,
  TRY_CAST(trim(CAST(premium AS varchar)) AS decimal(12,2)) AS premium,
  TRY_CAST(trim(CAST(deductible AS varchar)) AS decimal(12,2)) AS deductible,
  substring(upper(trim(contract_id)), 1, 1) AS contract_type,
  concat_ws('|', upper(trim(contract_id)), lpad(upper(trim(CAST(plan_id AS varchar))), 3, '0'),
            lpad(upper(trim(CAST(segment_id AS varchar))), 3, '0')) AS plan_bk
FROM plan_info
""")
register("B17_slv_plan", ["o_slv_plan"], "SELECT * FROM o_slv_plan")

cte("o_plan_keys", ("o_slv_plan",), "SELECT plan_bk, min(plan_key) AS plan_key FROM o_slv_plan GROUP BY 1")

register("B19_slv_beneficiary_cost", ["beneficiary_cost", "o_plan_keys"], """
SELECT k.plan_key, b.coverage_level, b.tier, b.days_supply, b.days_supply_label, b.cost_amt_pref, b.cost_min_amt_pref,
  b.cost_min_amt_mail_nonpref, b.tier_specialty, b.deductible_applies,
  sha256(concat_ws('|', k.plan_key, CAST(b.coverage_level AS varchar), CAST(b.tier AS varchar), CAST(b.days_supply AS varchar))) AS cost_key
FROM (
  SELECT concat_ws('|', upper(trim(contract_id)), lpad(upper(trim(CAST(plan_id AS varchar))), 3, '0'),
                   lpad(upper(trim(CAST(segment_id AS varchar))), 3, '0')) AS plan_bk,
    CAST(coverage_level AS integer) AS coverage_level, CAST(tier AS integer) AS tier, CAST(days_supply AS integer) AS days_supply,
    CASE CAST(days_supply AS integer) WHEN 1 THEN '30_DAYS' WHEN 2 THEN '90_DAYS' WHEN 3 THEN 'OTHER' WHEN 4 THEN '60_DAYS' END AS days_supply_label,
    CAST(cost_amt_pref AS decimal(12,4)) AS cost_amt_pref,
    TRY_CAST(regexp_replace(CAST(cost_min_amt_pref AS varchar), '[^0-9.\\-]', '', 'g') AS decimal(12,4)) AS cost_min_amt_pref,
    TRY_CAST(regexp_replace(CAST(cost_min_amt_mail_nonpref AS varchar), '[^0-9.\\-]', '', 'g') AS decimal(12,4)) AS cost_min_amt_mail_nonpref,
    CASE WHEN upper(trim(tier_specialty_yn)) = 'Y' THEN true WHEN upper(trim(tier_specialty_yn)) = 'N' THEN false END AS tier_specialty,
    CASE WHEN upper(trim(ded_applies_yn)) = 'Y' THEN true WHEN upper(trim(ded_applies_yn)) = 'N' THEN false END AS deductible_applies
  FROM beneficiary_cost
) b LEFT JOIN o_plan_keys k ON k.plan_bk = b.plan_bk
""")
register("B20_slv_pricing", ["pricing", "o_plan_keys"], """
SELECT k.plan_key, p.ndc, p.days_supply, p.unit_cost, concat_ws('|', k.plan_key, p.ndc, CAST(p.days_supply AS varchar)) AS pricing_key
FROM (
  SELECT concat_ws('|', upper(trim(contract_id)), lpad(upper(trim(CAST(plan_id AS varchar))), 3, '0'),
                   lpad(upper(trim(CAST(segment_id AS varchar))), 3, '0')) AS plan_bk,
    lpad(upper(trim(CAST(ndc AS varchar))), 11, '0') AS ndc, CAST(days_supply AS integer) AS days_supply,
    CAST(CAST(unit_cost AS decimal(24,6)) AS decimal(12,4)) AS unit_cost
  FROM pricing
) p LEFT JOIN o_plan_keys k ON k.plan_bk = p.plan_bk
""")


def _yn(c: str) -> str:
    return f"CASE WHEN upper(trim({c})) = 'Y' THEN true WHEN upper(trim({c})) = 'N' THEN false END"


register("B21_slv_pharmacy_network", ["pharmacy_network"], f"""
SELECT concat_ws('|', upper(trim(contract_id)), lpad(upper(trim(CAST(plan_id AS varchar))), 3, '0'),
                 lpad(upper(trim(CAST(segment_id AS varchar))), 3, '0')) AS plan_bk,
  upper(trim(pharmacy_number)) AS pharmacy_number, lpad(upper(trim(CAST(pharmacy_zipcode AS varchar))), 5, '0') AS pharmacy_zipcode,
  {_yn('preferred_status_retail')} AS preferred_status_retail,
  CASE WHEN CAST(in_area_flag AS integer) = 1 THEN true WHEN CAST(in_area_flag AS integer) = 0 THEN false END AS is_in_area,
  CAST(brand_dispensing_fee_60 AS decimal(8,4)) AS brand_dispensing_fee_60,
  (coalesce(CAST(brand_dispensing_fee_30 AS decimal(8,4)), 0) + coalesce(CAST(brand_dispensing_fee_60 AS decimal(8,4)), 0)
   + coalesce(CAST(brand_dispensing_fee_90 AS decimal(8,4)), 0)) / 3 AS avg_brand_fee,
  (coalesce(CAST(generic_dispensing_fee_30 AS decimal(8,4)), 0) + coalesce(CAST(generic_dispensing_fee_60 AS decimal(8,4)), 0)
   + coalesce(CAST(generic_dispensing_fee_90 AS decimal(8,4)), 0)) / 3 AS avg_generic_fee
FROM pharmacy_network
""")


def _flag(c: str) -> str:
    s = f"upper(trim(CAST({c} AS varchar)))"
    return (f"CASE WHEN {s} IN ('Y', 'YES', 'T', 'TRUE', '1') THEN 1 WHEN {s} IN ('N', 'NO', 'F', 'FALSE', '0') THEN 0 "
            f"ELSE TRY_CAST({s} AS integer) END")


cte("o_slv_formulary", ("formulary", "insulin_ref"), f"""
SELECT f.*, coalesce(i.is_insulin, 0) AS is_insulin FROM (
  SELECT upper(trim(formulary_id)) AS formulary_id, lpad(upper(trim(CAST(ndc AS varchar))), 11, '0') AS ndc,
    lpad(upper(trim(CAST(rxcui AS varchar))), 8, '0') AS rxcui, lpad(upper(trim(CAST(contract_year AS varchar))), 4, '0') AS contract_year,
    upper(trim(formulary_version)) AS formulary_version,
    CAST(tier_level_value AS integer) AS tier_level_value,
    {_flag('quantity_limit_yn')} AS quantity_limit_flag, {_flag('prior_authorization_yn')} AS prior_auth_flag,
    {_flag('step_therapy_yn')} AS step_therapy_flag,
    coalesce({_flag('quantity_limit_yn')}, 0) + coalesce({_flag('prior_authorization_yn')}, 0)
      + coalesce({_flag('step_therapy_yn')}, 0) AS restriction_count
  FROM formulary
) f LEFT JOIN (SELECT DISTINCT lpad(upper(trim(CAST(ndc AS varchar))), 11, '0') AS ndc, 1 AS is_insulin
               FROM insulin_ref WHERE ndc IS NOT NULL) i ON i.ndc = f.ndc
""")
register("B22_slv_basic_formulary", ["o_slv_formulary"], """
SELECT formulary_id, ndc, rxcui, contract_year, tier_level_value, quantity_limit_flag, prior_auth_flag, step_therapy_flag,
  restriction_count, sha256(concat_ws('|', formulary_id, formulary_version, contract_year, rxcui, ndc)) AS formulary_drug_key,
  is_insulin
FROM o_slv_formulary
""")

cte("o_slv_insulin", ("insulin_cost",), """
SELECT *, CASE WHEN insulin_max_copay_all_channels > 35.0 * CASE WHEN days_supply = 2 THEN 3 WHEN days_supply = 4 THEN 2 ELSE 1 END
               THEN 1 ELSE 0 END AS exceeds_cap_flag
FROM (
  SELECT concat_ws('', contract_id, plan_id, segment_id) AS plan_key, days_supply, trim(CAST(tier AS varchar)) AS tier_raw,
    CASE WHEN tier IS NULL OR trim(tier) IN ('.', '') THEN NULL ELSE TRY_CAST(trim(tier) AS integer) END AS tier_int,
    CASE WHEN tier IS NULL OR trim(tier) IN ('.', '') THEN 'ALL' ELSE 'TIER_' || trim(tier) END AS tier_scope,
    least(copay_amt_pref_insln, copay_amt_nonpref_insln, copay_amt_mail_pref_insln, copay_amt_mail_nonpref_insln) AS insulin_min_copay_all_channels,
    greatest(copay_amt_pref_insln, copay_amt_nonpref_insln, copay_amt_mail_pref_insln, copay_amt_mail_nonpref_insln) AS insulin_max_copay_all_channels,
    CASE WHEN days_supply = 1 THEN '30_days' WHEN days_supply = 2 THEN '90_days' WHEN days_supply = 4 THEN '60_days' ELSE 'other' END AS days_supply_label
  FROM insulin_cost
)
""")
register("B23_slv_insulin_cost", ["o_slv_insulin"], "SELECT * FROM o_slv_insulin")
register("B24_drug_access_rules", ["excluded_drugs"], """
SELECT plan_key, lpad(upper(trim(CAST(rxcui AS varchar))), 8, '0') AS rxcui_norm,
  CAST(upper(trim(prior_auth_yn)) = 'Y' AS integer) AS pa, CAST(upper(trim(step_therapy_yn)) = 'Y' AS integer) AS st,
  CAST(upper(trim(quantity_limit_yn)) = 'Y' AS integer) AS ql, CAST(upper(trim(capped_benefit_yn)) = 'Y' AS integer) AS cap_benefit,
  CASE WHEN tier IS NULL THEN 'EXCLUDED' ELSE 'CONDITIONAL' END AS drug_access_status,
  CAST(upper(trim(prior_auth_yn)) = 'Y' AS integer) + CAST(upper(trim(step_therapy_yn)) = 'Y' AS integer)
    + CAST(upper(trim(quantity_limit_yn)) = 'Y' AS integer) + CAST(upper(trim(capped_benefit_yn)) = 'Y' AS integer) AS restriction_score
FROM excluded_drugs
""")


def _c5(x: str) -> str:
    n = f"CAST(TRY_CAST(trim({x}) AS double) AS bigint)"
    return (f"CASE WHEN {x} IS NULL OR trim({x}) = '' THEN '' WHEN {n} IS NULL THEN '' "
            f"WHEN length(CAST({n} AS varchar)) > 5 THEN CAST({n} AS varchar) ELSE lpad(CAST({n} AS varchar), 5, '0') END")


register("B29_county_code_normalize", ["zipcode"], f"""
SELECT zip_code, {_c5('zip_code')} AS county5,
  {_c5("(CAST(CAST(zip_code AS integer) AS varchar) || '.0')")} AS county5_float
FROM zipcode
""")
register("B32_dim_zipcode", ["o_zip_county"], """
SELECT zip_code, city, state, county, county_code, lat, lng, CAST(coalesce(population, 0) AS bigint) AS population,
  coalesce(CAST(density AS double), 0.0) AS density,
  CASE WHEN coalesce(CAST(density AS double), 0.0) >= 1000 THEN 'urban'
       WHEN coalesce(CAST(density AS double), 0.0) >= 250 THEN 'suburban' ELSE 'rural' END AS density_category
FROM o_zip_county
""")
register("B35_days_supply_buckets", ["prescriptions"], """
SELECT bene_synth_id, ndc,
  CASE WHEN days_supply_mode >= 75 THEN 2 WHEN days_supply_mode >= 45 THEN 4 ELSE 1 END AS days_supply_code,
  CASE WHEN days_supply_mode >= 75 THEN 3.0 WHEN days_supply_mode >= 45 THEN 2.0 ELSE 1.0 END AS days_supply_months,
  CASE WHEN days_supply_mode >= 75 THEN 90.0 WHEN days_supply_mode >= 45 THEN 60.0 ELSE 30.0 END AS assumed_units_per_fill
FROM prescriptions
""")

cte("o_dim_plan", ("plan_info",), """
SELECT plan_key, contract_id, plan_id, segment_id, contract_name, plan_name, formulary_id, premium, deductible, snp,
  is_ma_pd, is_pdp, state, county_code
FROM (SELECT *, row_number() OVER (PARTITION BY plan_key ORDER BY county_code ASC NULLS LAST, state ASC NULLS LAST) AS rn
      FROM plan_info) WHERE rn = 1
""")
register("C1_dim_plan", ["o_dim_plan"], "SELECT * FROM o_dim_plan")
register("C2_dim_geography", ["geographic"], """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY county_code ORDER BY statename NULLS LAST, county NULLS LAST) AS rn
  FROM geographic) WHERE rn = 1
""")
register("C3_dim_drug", ["formulary", "pricing"], """
SELECT ndc, min(rxcui) AS rxcui FROM (
  SELECT ndc, CAST(rxcui AS varchar) AS rxcui FROM formulary UNION ALL SELECT ndc, NULL FROM pricing
) WHERE ndc IS NOT NULL GROUP BY ndc
""")
register("C4_dim_days_supply", ["beneficiary_cost", "pricing"], """
SELECT DISTINCT days_supply, kind FROM (
  SELECT CAST(days_supply AS varchar) AS days_supply, 'coded' AS kind FROM beneficiary_cost
  UNION ALL SELECT CAST(days_supply AS varchar), 'days' FROM pricing
) WHERE days_supply IS NOT NULL
""")
register("C5_dim_tier", ["beneficiary_cost"],
         "SELECT DISTINCT CAST(tier AS integer) AS tier FROM beneficiary_cost WHERE tier IS NOT NULL")
register("C6_dim_coverage_level", ["beneficiary_cost"],
         "SELECT DISTINCT CAST(coverage_level AS integer) AS coverage_level FROM beneficiary_cost WHERE coverage_level IS NOT NULL")
register("C7_dim_pharmacy", ["pharmacy_network"], """
SELECT pharmacy_number, pharmacy_zipcode, pharmacy_retail, pharmacy_mail FROM (
  SELECT *, row_number() OVER (PARTITION BY pharmacy_number ORDER BY pharmacy_zipcode NULLS LAST, plan_key NULLS LAST) AS rn
  FROM pharmacy_network) WHERE rn = 1
""")
register("C9_fact_pricing_unit_cost", ["pricing"], "SELECT plan_key, ndc, days_supply, unit_cost FROM pricing")

_d3 = [
    "avg(CASE WHEN upper(ded_applies_yn) = 'Y' THEN 1.0 ELSE 0.0 END) AS ded_applies_rate",
    "avg(CASE WHEN upper(tier_specialty_yn) = 'Y' THEN 1.0 ELSE 0.0 END) AS specialty_row_share",
]
for c in CH:
    t, a = f"CAST(cost_type_{c} AS integer)", f"CAST(cost_amt_{c} AS double)"
    cp, co = f"CASE WHEN {t} = 1 THEN {a} END", f"CASE WHEN {t} = 2 THEN {a} / 100.0 END"
    _d3 += [
        f"avg(CASE WHEN {t} = 0 THEN 1.0 ELSE 0.0 END) AS {c}_not_offered_share",
        f"avg(CASE WHEN {t} = 1 THEN 1.0 ELSE 0.0 END) AS {c}_copay_share",
        f"avg(CASE WHEN {t} = 2 THEN 1.0 ELSE 0.0 END) AS {c}_coinsurance_share",
        f"avg({cp}) AS {c}_avg_copay_amt", f"median({cp}) AS {c}_median_copay_amt",
        f"quantile_cont({cp}, 0.9) AS {c}_p90_copay_amt",
        f"avg({co}) AS {c}_avg_coins_rate", f"median({co}) AS {c}_median_coins_rate",
        f"quantile_cont({co}, 0.9) AS {c}_p90_coins_rate",
    ]
for k in range(1, 8):
    _d3.append(f"avg(CASE WHEN CAST(tier AS integer) = {k} AND cost_type_pref = 1 THEN cost_amt_pref END) AS pref_avg_copay_tier_{k}")
for k in range(1, 8):
    _d3.append(f"avg(CASE WHEN CAST(tier AS integer) = {k} AND cost_type_pref = 2 THEN cost_amt_pref / 100.0 END) "
               f"AS pref_avg_coins_rate_tier_{k}")
register("D3_cost_metrics", ["beneficiary_cost"],
         "SELECT plan_key, " + ",\n  ".join(_d3) + "\nFROM beneficiary_cost WHERE plan_key IS NOT NULL GROUP BY plan_key")

cte("o_formulary_nb", ("o_dim_plan", "o_slv_formulary"), """
SELECT p.plan_key, count(DISTINCT f.ndc) AS formulary_breadth_ndc, count(DISTINCT f.rxcui) AS formulary_breadth_rxcui,
  avg(CAST(f.tier_level_value AS double)) AS avg_tier_level,
  avg(coalesce(CAST(f.quantity_limit_flag AS double), 0.0)) AS ql_rate,
  avg(coalesce(CAST(f.prior_auth_flag AS double), 0.0)) AS pa_rate,
  avg(coalesce(CAST(f.step_therapy_flag AS double), 0.0)) AS st_rate,
  avg(coalesce(CAST(f.restriction_count AS double), 0.0)) AS avg_restriction_count,
  100.0 * (0.4 * avg(coalesce(CAST(f.prior_auth_flag AS double), 0.0)) + 0.3 * avg(coalesce(CAST(f.step_therapy_flag AS double), 0.0))
    + 0.2 * avg(coalesce(CAST(f.quantity_limit_flag AS double), 0.0)) + 0.1 * CASE WHEN count(*) > 0 THEN 1.0 ELSE 0.0 END)
    AS restrictiveness_index
FROM o_dim_plan p LEFT JOIN o_slv_formulary f ON f.formulary_id = p.formulary_id
GROUP BY p.plan_key
""")
register("D6_formulary_metrics_nb", ["o_formulary_nb"], "SELECT * FROM o_formulary_nb")
cte("o_network_nb", ("pharmacy_network",), f"""
SELECT plan_key, count(DISTINCT upper(trim(pharmacy_number))) AS network_size,
  avg(CAST({_yn('preferred_status_retail')} AS double)) AS preferred_retail_share,
  avg(CAST({_yn('preferred_status_mail')} AS double)) AS preferred_mail_share,
  avg(CASE WHEN in_area_flag = 1 THEN 1.0 WHEN in_area_flag = 0 THEN 0.0 END) AS in_area_share,
  avg(CAST(floor_price AS double)) AS avg_floor_price,
  avg((coalesce(brand_dispensing_fee_30, 0) + coalesce(brand_dispensing_fee_60, 0) + coalesce(brand_dispensing_fee_90, 0)) / 3) AS avg_brand_fee,
  avg((coalesce(generic_dispensing_fee_30, 0) + coalesce(generic_dispensing_fee_60, 0) + coalesce(generic_dispensing_fee_90, 0)) / 3) AS avg_generic_fee
FROM (SELECT *, upper(trim(contract_id)) || lpad(upper(trim(CAST(plan_id AS varchar))), 3, '0')
                || lpad(upper(trim(CAST(segment_id AS varchar))), 3, '0') AS pk FROM pharmacy_network) x
GROUP BY plan_key
""")
register("D7_network_metrics_nb", ["o_network_nb"], "SELECT * FROM o_network_nb")
cte("o_pricing_metrics", ("pricing",), """
SELECT plan_key, avg(CAST(unit_cost AS double)) AS avg_unit_cost, count(DISTINCT ndc) AS priced_ndc_count,
  quantile_cont(CAST(unit_cost AS double), 0.9) AS p90_unit_cost, quantile_cont(CAST(unit_cost AS double), 0.1) AS p10_unit_cost,
  quantile_cont(CAST(unit_cost AS double), 0.9) - quantile_cont(CAST(unit_cost AS double), 0.1) AS p90_p10_spread_unit_cost
FROM pricing WHERE plan_key IS NOT NULL GROUP BY plan_key
""")
register("D8_pricing_metrics", ["o_pricing_metrics"], "SELECT * FROM o_pricing_metrics")
cte("o_ins_cost_metrics", ("o_slv_insulin",), """
SELECT plan_key, min(insulin_min_copay_all_channels) AS insulin_min_copay_plan,
  max(insulin_max_copay_all_channels) AS insulin_max_copay_plan,
  avg(CAST(exceeds_cap_flag AS double)) AS insulin_exceeds_cap_rate, max(exceeds_cap_flag) AS insulin_exceeds_cap_any_flag,
  count(*) AS insulin_cost_rows,
  min(CASE WHEN lower(days_supply_label) LIKE '%30%' THEN insulin_min_copay_all_channels END) AS insulin_min_copay_30d,
  max(CASE WHEN lower(days_supply_label) LIKE '%30%' THEN insulin_max_copay_all_channels END) AS insulin_max_copay_30d,
  max(CASE WHEN lower(days_supply_label) LIKE '%30%' THEN exceeds_cap_flag END) AS insulin_exceeds_cap_30d_flag,
  min(CASE WHEN lower(days_supply_label) LIKE '%90%' THEN insulin_min_copay_all_channels END) AS insulin_min_copay_90d,
  max(CASE WHEN lower(days_supply_label) LIKE '%90%' THEN insulin_max_copay_all_channels END) AS insulin_max_copay_90d,
  max(CASE WHEN lower(days_supply_label) LIKE '%90%' THEN exceeds_cap_flag END) AS insulin_exceeds_cap_90d_flag
FROM o_slv_insulin GROUP BY plan_key
""")
register("D9_insulin_cost_metrics", ["o_ins_cost_metrics"], "SELECT * FROM o_ins_cost_metrics")
cte("o_ins_access", ("o_dim_plan", "o_slv_formulary"), f"""
SELECT *, {r2('100 * (0.5 * insulin_pa_rate + 0.3 * insulin_st_rate + 0.2 * insulin_ql_rate)')} AS insulin_restrictiveness_index
FROM (
  SELECT p.plan_key, count(DISTINCT f.ndc) AS insulin_ndc_count, avg(CAST(f.tier_level_value AS double)) AS insulin_avg_tier_level,
    avg(coalesce(CAST(f.quantity_limit_flag AS double), 0.0)) AS insulin_ql_rate,
    avg(coalesce(CAST(f.prior_auth_flag AS double), 0.0)) AS insulin_pa_rate,
    avg(coalesce(CAST(f.step_therapy_flag AS double), 0.0)) AS insulin_st_rate,
    avg(CAST(f.prior_auth_flag + f.step_therapy_flag + f.quantity_limit_flag AS double)) AS insulin_avg_restriction_count
  FROM o_dim_plan p JOIN o_slv_formulary f ON f.formulary_id = p.formulary_id AND f.is_insulin = 1
  GROUP BY p.plan_key
)
""")
register("D10_insulin_access_metrics", ["o_ins_access"], "SELECT * FROM o_ins_access")
cte("o_friendly", ("o_ins_cost_metrics", "o_ins_access"), f"""
SELECT * EXCLUDE (cost_risk, access_risk, cs, acs), CASE WHEN cost_risk THEN 1 ELSE 0 END AS insulin_cost_risk_flag,
  CASE WHEN access_risk THEN 1 ELSE 0 END AS insulin_access_risk_flag,
  CASE WHEN cost_risk OR access_risk THEN 1 ELSE 0 END AS insulin_risk_flag,
  {r2('cs')} AS insulin_cost_score, {r2('acs')} AS insulin_access_score, {r2('0.5 * cs + 0.5 * acs')} AS insulin_friendliness_score
FROM (
  SELECT *, insulin_exceeds_cap_any_flag = 1 OR insulin_exceeds_cap_rate > 0.05 AS cost_risk,
    insulin_restrictiveness_index > 20 OR insulin_pa_rate > 0.20 AS access_risk,
    greatest(0.0, least(100.0, (1.0 - insulin_exceeds_cap_rate) * 100.0)) AS cs,
    greatest(0.0, least(100.0, (1.0 - insulin_restrictiveness_index / 100.0) * 100.0)) AS acs
  FROM (
    SELECT c.*, a.insulin_avg_tier_level, a.insulin_avg_restriction_count,
      coalesce(a.insulin_ndc_count, 0) AS insulin_ndc_count, coalesce(a.insulin_ql_rate, 0.0) AS insulin_ql_rate,
      coalesce(a.insulin_pa_rate, 0.0) AS insulin_pa_rate, coalesce(a.insulin_st_rate, 0.0) AS insulin_st_rate,
      coalesce(a.insulin_restrictiveness_index, 0.0) AS insulin_restrictiveness_index
    FROM o_ins_cost_metrics c LEFT JOIN o_ins_access a ON a.plan_key = c.plan_key
  )
)
""")

register("D11_insulin_friendliness", ["o_friendly"], "SELECT * FROM o_friendly")
cte("o_cost_metrics", ("beneficiary_cost",),
    "SELECT plan_key, " + ",\n  ".join(_d3) + "\nFROM beneficiary_cost WHERE plan_key IS NOT NULL GROUP BY plan_key")
