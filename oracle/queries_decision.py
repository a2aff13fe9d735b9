"""Oracle SQL for the decision-support queries (DuckDB)."""

from oracle import gold  # noqa: F401
from oracle.registry import cte, register


def norm(x: str, higher: bool = True, part: str = "request_id") -> str:
    """min-max within the request; 0.5 when flat (isclose) - inputs are never null here."""
    w = f"OVER (PARTITION BY {part})"
    e = (f"(CASE WHEN min({x}) {w} IS NULL OR abs(min({x}) {w} - max({x}) {w}) <= 1e-8 + 1e-5 * abs(max({x}) {w}) "
         f"THEN 0.5 ELSE ({x} - min({x}) {w}) / (max({x}) {w} - min({x}) {w}) END)")
    return e if higher else f"(1.0 - {e})"


cte("o_j_cands", ("requests", "o_active_plans", "o_formulary_metrics", "o_network_metrics"), """
SELECT r.request_id, p.state, p.county_code, p.plan_key, p.plan_name, p.contract_name, p.formulary_id,
  CASE WHEN p.is_ma_pd THEN 'MA' WHEN p.is_pdp THEN 'PDP' ELSE 'Other' END AS contract_type,
  CAST(p.premium AS double) AS premium, CAST(p.deductible AS double) AS deductible,
  CAST(coalesce(fm.total_drugs, 0) AS bigint) AS formulary_total_drugs,
  CAST(coalesce(fm.generic_tier_pct, 0) AS double) AS formulary_generic_pct,
  CAST(coalesce(fm.specialty_tier_pct, 0) AS double) AS formulary_specialty_pct,
  CAST(coalesce(fm.pa_rate, 0) AS double) AS formulary_pa_rate,
  CAST(coalesce(fm.st_rate, 0) AS double) AS formulary_st_rate,
  CAST(coalesce(fm.ql_rate, 0) AS double) AS formulary_ql_rate,
  CAST(coalesce(fm.restrictiveness_class, 0) AS integer) AS formulary_restrictiveness,
  CAST(coalesce(nm.preferred_pharmacies, 0) AS integer) AS network_preferred_pharmacies,
  CAST(coalesce(nm.total_pharmacies, 0) AS integer) AS network_total_pharmacies,
  CAST(coalesce(nm.network_adequacy_flag, 0) AS integer) AS network_adequacy_flag,
  CASE WHEN fm.plan_key IS NOT NULL THEN 1 ELSE 0 END AS has_formulary_metrics,
  CASE WHEN nm.plan_key IS NOT NULL THEN 1 ELSE 0 END AS has_network_metrics,
  'Eligible' AS eligibility_status
FROM requests r
JOIN o_active_plans p ON p.state = r.state AND p.county_code = r.county_code AND p.premium IS NOT NULL
LEFT JOIN o_formulary_metrics fm ON fm.plan_key = p.plan_key
LEFT JOIN o_network_metrics nm ON nm.plan_key = p.plan_key
""")

cte("o_j_cov", ("o_j_cands", "request_medications", "formulary", "excluded_drugs"), """
SELECT request_id, plan_key, count(*) AS requested_drugs,
  sum(CASE WHEN fndc IS NOT NULL AND xr IS NULL THEN 1 ELSE 0 END) AS covered_drugs,
  sum(CASE WHEN fndc IS NOT NULL THEN 1 ELSE 0 END) AS in_formulary_drugs,
  sum(CASE WHEN xr IS NOT NULL THEN 1 ELSE 0 END) AS excluded_drugs,
  string_agg(CASE WHEN NOT (fndc IS NOT NULL AND xr IS NULL) THEN ndc END, ', ' ORDER BY ndc) AS uncovered_ndcs,
  CASE WHEN count(*) > 0 THEN 100.0 * sum(CASE WHEN fndc IS NOT NULL AND xr IS NULL THEN 1 ELSE 0 END) / count(*)
       ELSE 0.0 END AS drug_coverage_pct,
  sum(CASE WHEN NOT (fndc IS NOT NULL AND xr IS NULL) THEN cost ELSE 0.0 END) AS uncovered_requested_cost
FROM (
  SELECT c.request_id, c.plan_key, m.ndc, m.cost, f.ndc AS fndc, x.rxcui AS xr
  FROM o_j_cands c
  JOIN (SELECT request_id, ndc, max(CAST(annual_cost_est AS double)) AS cost FROM request_medications GROUP BY 1, 2) m
    ON m.request_id = c.request_id
  LEFT JOIN formulary f ON f.formulary_id = c.formulary_id AND f.ndc = m.ndc
  LEFT JOIN (SELECT DISTINCT formulary_id, rxcui FROM excluded_drugs) x ON x.formulary_id = c.formulary_id AND x.rxcui = f.rxcui
)
GROUP BY 1, 2
""")

cte("o_j_gated", ("o_j_cands", "o_j_cov", "request_medications", "requests"), """
SELECT * EXCLUDE (meets, any_meets, min_drug_coverage_pct),
  CASE WHEN any_meets = 1 THEN 'decision_support' ELSE 'comparison_only' END AS results_mode
FROM (
  SELECT *, max(CAST(meets AS integer)) OVER (PARTITION BY request_id) AS any_meets FROM (
    SELECT e.*, r.min_drug_coverage_pct,
      (e.n_requested_ndcs <= 0 OR e.drug_coverage_pct >= r.min_drug_coverage_pct) AS meets
    FROM (
      SELECT c.*, coalesce(n.n, 0) AS n_requested_ndcs,
        coalesce(v.requested_drugs, coalesce(n.n, 0)) AS requested_drugs,
        coalesce(v.covered_drugs, 0) AS covered_drugs,
        coalesce(v.in_formulary_drugs, 0) AS in_formulary_drugs,
        coalesce(v.excluded_drugs, 0) AS excluded_drugs,
        coalesce(v.drug_coverage_pct, 0.0) AS drug_coverage_pct,
        coalesce(v.uncovered_ndcs, '') AS uncovered_ndcs,
        coalesce(v.uncovered_requested_cost, 0.0) AS uncovered_requested_cost,
        CASE WHEN coalesce(n.n, 0) <= 0 THEN 'Not evaluated'
             WHEN coalesce(v.drug_coverage_pct, 0.0) >= 90 THEN 'Good fit'
             WHEN coalesce(v.drug_coverage_pct, 0.0) >= 50 THEN 'Partial fit' ELSE 'Poor fit' END AS coverage_status
      FROM o_j_cands c
      LEFT JOIN o_j_cov v ON v.request_id = c.request_id AND v.plan_key = c.plan_key
      LEFT JOIN (SELECT request_id, count(DISTINCT ndc) AS n FROM request_medications GROUP BY 1) n
        ON n.request_id = c.request_id
    ) e JOIN requests r ON r.request_id = e.request_id
  )
) WHERE meets OR any_meets = 0
""")

cte("o_j_profile", ("requests", "beneficiary", "request_medications"), """
SELECT r.request_id, r.bene_synth_id, r.state, r.county_code, r.zip_code,
  coalesce(b.risk_segment, 'MED') AS risk_segment,
  CAST(CASE WHEN coalesce(m.n, 0) > 0 THEN m.n ELSE coalesce(b.unique_drugs, 0) END AS integer) AS num_drugs,
  CASE WHEN coalesce(m.n, 0) > 0 THEN m.fills ELSE CAST(coalesce(b.fills_target, 0) AS double) END AS avg_fills_per_year,
  CASE WHEN coalesce(m.cost, 0.0) > 0 THEN m.cost ELSE coalesce(b.total_rx_cost_est, 0.0) END AS total_rx_cost_est,
  CAST(CASE WHEN coalesce(m.n, 0) > 0 THEN m.ins ELSE coalesce(b.insulin_user_flag, 0) END AS integer) AS is_insulin_user,
  coalesce(m.cost, 0.0) AS medication_cost_total,
  coalesce(m.n, 0) AS medication_count
FROM requests r
LEFT JOIN beneficiary b ON b.bene_synth_id = r.bene_synth_id
LEFT JOIN (SELECT request_id, count(DISTINCT ndc) AS n, avg(CAST(fills_per_year AS double)) AS fills,
                  sum(CAST(annual_cost_est AS double)) AS cost, max(CAST(is_insulin AS integer)) AS ins
           FROM request_medications GROUP BY 1) m ON m.request_id = r.request_id
""")

cte("o_j_access", ("o_j_gated", "o_j_profile", "o_network", "o_zip_county"), """
SELECT zip_code, plan_key,
  coalesce(min(CASE WHEN n_preferred > 0 THEN d END), 999.0) AS nearest_preferred_miles,
  sum(CASE WHEN d <= 5 THEN n_preferred ELSE 0 END) AS preferred_within_5mi,
  sum(CASE WHEN d <= 10 THEN n_preferred ELSE 0 END) AS preferred_within_10mi,
  sum(CASE WHEN d <= 10 THEN n_pharmacies ELSE 0 END) AS total_within_10mi,
  coalesce(sum(n_preferred * d) / nullif(sum(n_preferred), 0), 999.0) AS avg_preferred_distance,
  least(100.0, 100.0 / (1 + coalesce(min(CASE WHEN n_preferred > 0 THEN d END), 999.0) / 5.0)
        + least(50.0, 5.0 * sum(CASE WHEN d <= 10 THEN n_preferred ELSE 0 END))) AS network_accessibility_score
FROM (
  SELECT o.zip_code, o.plan_key, n.n_pharmacies, n.n_preferred,
    round(CAST(6371.0 * acos(least(1.0, greatest(-1.0,
        cos(radians(oz.lat)) * cos(radians(pz.lat)) * cos(radians(pz.lng) - radians(oz.lng))
        + sin(radians(oz.lat)) * sin(radians(pz.lat))))) * 0.621371 AS decimal(24,6)), 2)::double AS d
  FROM (SELECT DISTINCT p.zip_code, g.plan_key FROM o_j_gated g JOIN o_j_profile p ON p.request_id = g.request_id) o
  JOIN o_zip_county oz ON oz.zip_code = o.zip_code
  JOIN (SELECT plan_key, pharmacy_zipcode, count(*) AS n_pharmacies,
               sum(CASE WHEN is_preferred_retail THEN 1 ELSE 0 END) AS n_preferred
        FROM o_network WHERE offers_retail GROUP BY 1, 2) n ON n.plan_key = o.plan_key
  JOIN o_zip_county pz ON pz.zip_code = n.pharmacy_zipcode
)
GROUP BY 1, 2
""")


def _ratio(x: str) -> str:
    v = f"coalesce(CAST({x} AS double), 0.0)"
    return f"least(greatest(CASE WHEN {v} > 1 THEN {v} / 100.0 ELSE {v} END, 0.0), 1.0)"


_base = ("CASE WHEN medication_count > 0 THEN greatest(coalesce(total_rx_cost_est, 0.0), medication_cost_total) "
         "ELSE coalesce(total_rx_cost_est, 0.0) END")
_num = "greatest(coalesce(num_drugs, 1), 1)"
_fills = "greatest(coalesce(nullif(avg_fills_per_year, 0), 12.0), 1.0)"
_unc = (f"CASE WHEN coalesce(uncovered_requested_cost, 0.0) <= 0 AND coalesce(requested_drugs, 0) > 0 "
        f"AND coalesce(requested_drugs, 0) - coalesce(covered_drugs, 0) > 0 "
        f"THEN ({_base}) * (CAST(coalesce(requested_drugs, 0) - coalesce(covered_drugs, 0) AS double) / coalesce(requested_drugs, 0)) "
        f"ELSE coalesce(uncovered_requested_cost, 0.0) END")
_covered = (f"greatest(({_base}) - ({_unc}), 0.0) * (0.20 + least(0.25, 0.01 * ({_num} - 1)) "
            f"+ least(0.15, 0.002 * greatest({_fills} - 12, 0.0))) * (1.0 - 0.22 * {_ratio('formulary_generic_pct')}) "
            f"* (1.0 + 0.25 * {_ratio('formulary_specialty_pct')}) * (1.0 + 0.18 * {_ratio('formulary_pa_rate')} "
            f"+ 0.12 * {_ratio('formulary_st_rate')} + 0.08 * {_ratio('formulary_ql_rate')}) "
            f"* CASE WHEN is_insulin_user = 1 THEN 0.92 ELSE 1.0 END")

cte("o_j_costed", ("o_j_gated", "o_j_profile", "o_j_access", "requests"), f"""
SELECT *, premium * 12 + estimated_annual_oop AS total_annual_cost,
  premium * 12 + estimated_annual_oop + distance_penalty AS total_cost_with_distance,
  -(premium * 12 + estimated_annual_oop + distance_penalty) AS score
FROM (
  SELECT *, greatest(50.0, oop_covered_component + oop_uncovered_component + oop_deductible_component
                     + oop_network_component) AS estimated_annual_oop,
    CASE WHEN nearest_preferred_miles > 15 THEN 200.0 WHEN nearest_preferred_miles > 8 THEN 100.0 ELSE 0.0 END
      * (distance_penalty_rate / 50.0) AS distance_penalty
  FROM (
    SELECT *, {_covered} AS oop_covered_component, {_unc} AS oop_uncovered_component,
      least(coalesce(deductible, 0.0), 800.0) * 0.35 AS oop_deductible_component,
      ({_covered}) * CASE WHEN network_adequacy_flag = 1 THEN 0.08 ELSE 0.0 END AS oop_network_component
    FROM (
      SELECT g.* EXCLUDE (state, county_code), p.* EXCLUDE (request_id),
        CASE WHEN a.nearest_preferred_miles IS NOT NULL THEN 1 ELSE 0 END AS has_pharmacy_distance_data,
        coalesce(a.nearest_preferred_miles, 10.0) AS nearest_preferred_miles,
        coalesce(a.preferred_within_10mi, 0) AS preferred_within_10mi,
        coalesce(a.network_accessibility_score, 50.0) AS network_accessibility_score,
        least(greatest(r.ml_influence_pct, 0.0), 100.0) / 100.0 AS w_ml,
        (1 - least(greatest(r.ml_influence_pct, 0.0), 100.0) / 100.0) * r.cost_priority
          / greatest(1.0, r.cost_priority + r.access_priority + r.coverage_priority) AS w_cost,
        (1 - least(greatest(r.ml_influence_pct, 0.0), 100.0) / 100.0) * r.access_priority
          / greatest(1.0, r.cost_priority + r.access_priority + r.coverage_priority) AS w_access,
        (1 - least(greatest(r.ml_influence_pct, 0.0), 100.0) / 100.0) * r.coverage_priority
          / greatest(1.0, r.cost_priority + r.access_priority + r.coverage_priority) AS w_coverage,
        r.distance_penalty_rate
      FROM o_j_gated g
      JOIN o_j_profile p ON p.request_id = g.request_id
      LEFT JOIN o_j_access a ON a.zip_code = p.zip_code AND a.plan_key = g.plan_key
      JOIN requests r ON r.request_id = g.request_id
    )
  )
)
""")

cte("o_j_comp", ("o_j_costed",), f"""
SELECT *,
  {norm('score')} AS ml_component,
  {norm('total_cost_with_distance', False)} AS cost_component,
  0.5 * {norm('nearest_preferred_miles', False)} + 0.3 * {norm('preferred_within_10mi')}
    + 0.2 * {norm('network_accessibility_score')} AS access_component,
  0.55 * {norm('drug_coverage_pct')} + 0.45 * (0.35 * {norm('formulary_generic_pct')}
    + 0.25 * {norm('formulary_restrictiveness', False)} + 0.20 * {norm('formulary_pa_rate', False)}
    + 0.10 * {norm('formulary_st_rate', False)} + 0.10 * {norm('formulary_ql_rate', False)}) AS coverage_component,
  100.0 * (0.55 * {norm('total_cost_with_distance', False)} + 0.20 * {norm('nearest_preferred_miles', False)}
    + 0.25 * {norm('drug_coverage_pct')}) AS heuristic_score
FROM o_j_costed
""")

cte("o_j_ranked", ("o_j_comp",), """
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY decision_score DESC, score DESC, plan_key) AS rank
FROM (
  SELECT *,
    100.0 * (w_ml * ml_component + w_cost * cost_component + w_access * access_component
             + w_coverage * coverage_component) AS decision_score,
    coalesce(nullif(array_to_string(list_slice(list_filter([
        CASE WHEN cost_component >= 0.70 THEN 'strong total cost' END,
        CASE WHEN access_component >= 0.70 THEN 'good pharmacy access' END,
        CASE WHEN coverage_component >= 0.70 THEN 'favorable formulary profile' END,
        CASE WHEN drug_coverage_pct >= 90 THEN 'high requested-drug coverage' END,
        CASE WHEN ml_component >= 0.70 THEN 'high ML suitability' END], lambda x: x IS NOT NULL), 1, 2), ', '), ''),
      'balanced across factors') AS decision_reason
  FROM o_j_comp
)
""")

cte("o_j_flags", ("o_j_ranked",), """
SELECT *,
  CASE WHEN coverage_status = 'Poor fit' OR len(gaps) >= 3 THEN 'Low'
       WHEN coverage_status = 'Partial fit' OR len(gaps) >= 1 THEN 'Medium' ELSE 'High' END AS confidence_band
FROM (
  SELECT *,
    list_filter([
      CASE WHEN coverage_status = 'Poor fit' THEN 'Low requested-drug coverage'
           WHEN coverage_status = 'Partial fit' THEN 'Only part of the requested medication list is covered' END,
      CASE WHEN network_adequacy_flag <> 0 THEN 'Limited preferred pharmacy network' END,
      CASE WHEN nearest_preferred_miles > 10 THEN 'Nearest preferred pharmacy is over 10 miles away' END,
      CASE WHEN coalesce(deductible, 0.0) >= 400.0 THEN 'Higher deductible than many alternatives' END,
      CASE WHEN coalesce(formulary_restrictiveness, 0) >= 2 THEN 'Restrictive formulary may require extra approvals' END
    ], lambda x: x IS NOT NULL) AS warns,
    list_filter([
      CASE WHEN has_formulary_metrics = 0 THEN 'No plan-level formulary aggregate available' END,
      CASE WHEN has_network_metrics = 0 THEN 'No plan-level pharmacy network aggregate available' END,
      CASE WHEN has_pharmacy_distance_data = 0 THEN 'No pharmacy-level distance evidence for this run' END,
      CASE WHEN n_requested_ndcs <= 0 THEN 'No requested medication list supplied' END
    ], lambda x: x IS NOT NULL) AS gaps
  FROM o_j_ranked
)
""")

register("J2_candidate_plans", ["o_j_cands"], """
SELECT request_id, plan_key, plan_name, contract_type, premium, deductible, formulary_total_drugs,
  network_preferred_pharmacies, has_formulary_metrics, has_network_metrics, eligibility_status
FROM o_j_cands
""")
register("J3_requested_drug_coverage", ["o_j_cov"], "SELECT * FROM o_j_cov")
register("J5_coverage_gate", ["o_j_gated"], """
SELECT request_id, plan_key, requested_drugs, covered_drugs, drug_coverage_pct, uncovered_ndcs, coverage_status,
  results_mode FROM o_j_gated
""")
register("J23_effective_profile", ["o_j_profile"], "SELECT * FROM o_j_profile")
register("E5_network_accessibility", ["o_j_access"], "SELECT * FROM o_j_access")
register("J8_oop_estimate", ["o_j_costed"], """
SELECT request_id, plan_key, oop_covered_component, oop_uncovered_component, oop_deductible_component,
  oop_network_component, estimated_annual_oop, distance_penalty, total_cost_with_distance FROM o_j_costed
""")
register("J13_ranked_plans", ["o_j_ranked"], """
SELECT request_id, plan_key, rank, ml_component, cost_component, access_component, coverage_component,
  decision_score, heuristic_score, decision_reason FROM o_j_ranked
""")
register("J16_flags_confidence", ["o_j_flags"], """
SELECT request_id, plan_key, array_to_string(warns, ' | ') AS warning_flags, array_to_string(gaps, ' | ') AS evidence_gaps,
  confidence_band FROM o_j_flags
""")
register("J17_feature_coverage", ["o_j_ranked"], """
SELECT request_id, count(*) AS candidate_plans, count(*) AS eligible_plans, sum(has_network_metrics) AS plans_with_network_metrics,
  sum(has_pharmacy_distance_data) AS plans_with_pharmacy_distance_data,
  sum(has_formulary_metrics) AS plans_with_formulary_metrics
FROM o_j_ranked GROUP BY 1
""")
register("J21_top5_report", ["o_j_flags"], """
SELECT request_id, rank, plan_key AS plan, plan_name, total_cost_with_distance AS estimated_annual_total,
  coverage_status AS coverage_fit, confidence_band AS confidence
FROM o_j_flags WHERE rank <= 5
""")
register("J25_uncovered_names", ["o_j_ranked", "request_medications"], """
SELECT request_id, plan_key,
  string_agg(CASE WHEN coalesce(drug_name, '') <> '' THEN drug_name || ' (NDC ' || ndc || ')' ELSE 'NDC ' || ndc END,
             ', ' ORDER BY ndc) AS uncovered_display
FROM (
  SELECT u.request_id, u.plan_key, u.ndc, n.drug_name FROM (
    SELECT request_id, plan_key, trim(unnest(string_split(uncovered_ndcs, ','))) AS ndc FROM o_j_ranked
  ) u
  LEFT JOIN (SELECT request_id, ndc, max(drug_name) AS drug_name FROM request_medications GROUP BY 1, 2) n
    ON n.request_id = u.request_id AND n.ndc = u.ndc
  WHERE u.ndc <> ''
) GROUP BY 1, 2
""")
