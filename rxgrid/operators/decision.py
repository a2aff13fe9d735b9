"""Decision support as batch operators over a table of requests.

The reference ranks plans for one person per web session; here every step is
keyed by ``request_id`` so one job serves all requests: candidate retrieval
is an equi-join on (state, county) against size-checked broadcast plans, the
requested-drug grid is an equi-join on ``request_id``, scores normalise
within a window partitioned by request (never across requests) and the
ranked output is a per-request ``row_number``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxgrid.functions.geo import distance_category_display, distance_penalty
from rxgrid.functions.joins import broadcast_if_small
from rxgrid.operators.metrics import active_plans
from rxgrid.session import shared_table

REQ = "request_id"

# Warning, evidence-gap and reason texts of the recommendation
# contract, in the order they are emitted.
WARN_OUTSIDE = "Outside the selected service area"
WARN_LOW_COVERAGE = "Low requested-drug coverage"
WARN_PARTIAL = "Only part of the requested medication list is covered"
WARN_NETWORK = "Limited preferred pharmacy network"
WARN_FAR = "Nearest preferred pharmacy is over 10 miles away"
WARN_DEDUCTIBLE = "Higher deductible than many alternatives"
WARN_RESTRICTIVE = "Restrictive formulary may require extra approvals"
GAP_FORMULARY = "No plan-level formulary aggregate available"
GAP_NETWORK = "No plan-level pharmacy network aggregate available"
GAP_DISTANCE = "No pharmacy-level distance evidence for this run"
GAP_NO_MEDS = "No requested medication list supplied"
GAP_COMPARISON = "Shown for comparison only outside the selected service area"
REASON_COST = "strong total cost"
REASON_ACCESS = "good pharmacy access"
REASON_FORMULARY = "favorable formulary profile"
REASON_COVERAGE = "high requested-drug coverage"
REASON_ML = "high ML suitability"
REASON_BALANCED = "balanced across factors"


# ---------------------------------------------------------------------------
# J1 / J2 candidates


def offered_plans(plan_info: DataFrame, formulary_metrics: DataFrame, network_metrics: DataFrame) -> DataFrame:
    """J1, plan side: the plans offered with a premium and not suppressed, with formulary / network metrics and evidence flags."""
    fm = formulary_metrics.select(
        F.col("plan_key").alias("_fm_key"), "total_drugs", "generic_tier_pct", "specialty_tier_pct", "pa_rate",
        "st_rate", "ql_rate", "restrictiveness_class",
    )
    nm = network_metrics.select(
        F.col("plan_key").alias("_nm_key"), "preferred_pharmacies", "total_pharmacies", "network_adequacy_flag"
    )
    p = active_plans(plan_info).where(F.col("premium").isNotNull())
    p = p.join(broadcast_if_small(fm), p["plan_key"] == fm["_fm_key"], "left")
    p = p.join(broadcast_if_small(nm), p["plan_key"] == nm["_nm_key"], "left")
    return p.select(
        "state", "county_code", "plan_key", "plan_name", "contract_name", "formulary_id",
        F.when(F.col("is_ma_pd"), "MA").when(F.col("is_pdp"), "PDP").otherwise("Other").alias("contract_type"),
        F.col("premium").cast("double").alias("premium"),
        F.col("deductible").cast("double").alias("deductible"),
        F.coalesce("total_drugs", F.lit(0)).cast("long").alias("formulary_total_drugs"),
        F.coalesce("generic_tier_pct", F.lit(0.0)).cast("double").alias("formulary_generic_pct"),
        F.coalesce("specialty_tier_pct", F.lit(0.0)).cast("double").alias("formulary_specialty_pct"),
        F.coalesce("pa_rate", F.lit(0.0)).cast("double").alias("formulary_pa_rate"),
        F.coalesce("st_rate", F.lit(0.0)).cast("double").alias("formulary_st_rate"),
        F.coalesce("ql_rate", F.lit(0.0)).cast("double").alias("formulary_ql_rate"),
        F.coalesce("restrictiveness_class", F.lit(0)).cast("int").alias("formulary_restrictiveness"),
        F.coalesce("preferred_pharmacies", F.lit(0)).cast("int").alias("network_preferred_pharmacies"),
        F.coalesce("total_pharmacies", F.lit(0)).cast("int").alias("network_total_pharmacies"),
        F.coalesce("network_adequacy_flag", F.lit(0)).cast("int").alias("network_adequacy_flag"),
        F.when(F.col("_fm_key").isNotNull(), 1).otherwise(0).alias("has_formulary_metrics"),
        F.when(F.col("_nm_key").isNotNull(), 1).otherwise(0).alias("has_network_metrics"),
    )


COUNTY = ["state", "county_code"]
# A task of requests expands into about this many candidates.
CANDIDATES_PER_PARTITION = 250_000


def _repeated(requests: DataFrame) -> bool:
    """Whether a request comes in several rows."""
    return not requests.groupBy(REQ).count().where("count > 1").isEmpty()


def _per_plan(plans: DataFrame) -> DataFrame:
    """J2 before the requests: what `dedupe_candidates` keeps of a county's plan that comes in several rows."""
    w = Window.partitionBy(*COUNTY, "plan_key").orderBy(F.coalesce("premium", F.lit(float("inf"))).asc())
    return plans.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _candidates(requests: DataFrame, plans: DataFrame) -> DataFrame:
    return _local(requests.join(broadcast_if_small(plans), COUNTY))


def _local(c: DataFrame) -> DataFrame:
    return c.withColumns(
        {
            "distance_miles": F.lit(0.0),
            "has_distance_tradeoff": F.lit(0),
            "is_local": F.lit(True),
            "service_area_eligible": F.lit(True),
            "comparison_only": F.lit(False),
            "eligibility_status": F.lit("Eligible"),
            "distance_category": F.lit("Local"),
            "location_county": F.lit(""),
        }
    )


def _partitions(requests: DataFrame, plans: DataFrame) -> int:
    """Partitions of requests that expand into the plans of their county: enough for the candidates, and at least the shuffle setting."""
    n = requests.groupBy(*COUNTY).agg(F.count(F.lit(1)).alias("_requests")).join(plans.groupBy(*COUNTY).agg(F.count(F.lit(1)).alias("_plans")), COUNTY)
    rows = n.agg(F.sum(F.col("_requests").cast("double") * F.col("_plans"))).first()[0] or 0.0
    least = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(rows / CANDIDATES_PER_PARTITION))


def candidate_plans(requests: DataFrame, plan_info: DataFrame, formulary_metrics: DataFrame,
                    network_metrics: DataFrame) -> DataFrame:
    """Plans offered in each request's county with a premium, not suppressed, with
    formulary / network metrics and evidence flags; J2 keeps one row per plan.

    Where a request comes once, its rows of one plan differ by the plan's rows only: these are settled before they are
    expanded, and no candidate is shuffled or sorted."""
    plans = offered_plans(plan_info, formulary_metrics, network_metrics)
    r = requests.select(REQ, *COUNTY)
    if _repeated(requests):
        return dedupe_candidates(_candidates(r, plans))
    # dealt by request: what is joined or summed by request meets the candidates where they are made
    return _candidates(r.repartition(_partitions(r, active_plans(plan_info)), REQ), _per_plan(plans))


def _one_per_formulary(plans: DataFrame) -> DataFrame:
    """One plan for all of a county's plans with the same formulary (a plan without a key finds no coverage: it stands for itself)."""
    w = Window.partitionBy(*COUNTY, "formulary_id", F.col("plan_key").isNull()).orderBy("plan_key")
    return plans.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _of_formulary(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows of a county and formulary for each of the county's plans with that formulary; with `_unknown` for those with (or
    without) a key."""
    rows = rows.withColumnsRenamed({c: f"_{c}" for c in [*COUNTY, "formulary_id"]})
    on = [F.col(f"_{c}") == F.col(c) for c in COUNTY] + [F.col("_formulary_id").eqNullSafe(F.col("formulary_id"))]
    if "_unknown" in rows.columns:
        on.append(F.col("_unknown") == F.col("plan_key").isNull())
    out = rows.join(broadcast_if_small(plans), on)
    return out.drop("_formulary_id", "_unknown", *[f"_{c}" for c in COUNTY])


#: What a candidate has of its formulary's coverage.
COVERAGE = ["n_requested_ndcs", "requested_drugs", "covered_drugs", "in_formulary_drugs", "excluded_drugs", "uncovered_ndcs",
            "drug_coverage_pct", "uncovered_requested_cost", "coverage_status", "results_mode"]


@dataclass
class Gate:
    """J1 - J6 of a table of requests.

    Coverage and gate depend on a plan's formulary only.  Where a request comes once, they are found with one plan of each
    formulary and county, and are expanded to the other plans last."""

    requests: DataFrame
    plan_info: DataFrame
    formulary_metrics: DataFrame
    network_metrics: DataFrame
    meds: DataFrame
    formulary: DataFrame
    excluded: DataFrame

    @cached_property
    def repeated(self) -> bool:
        return _repeated(self.requests)

    @cached_property
    def plans(self) -> DataFrame:
        return shared_table(_per_plan(offered_plans(self.plan_info, self.formulary_metrics, self.network_metrics)), "offered")

    @cached_property
    def formularies(self) -> DataFrame:
        """The candidates of one plan per formulary."""
        one, r = _one_per_formulary(self.plans), self.requests.select(REQ, *COUNTY)
        return _candidates(r.repartition(_partitions(r, one), REQ), one)

    def _expanded(self, rows: DataFrame, plans: DataFrame) -> DataFrame:
        return _of_formulary(rows.repartition(_partitions(self.requests, self.plans), REQ), plans)

    def _gated(self, cands: DataFrame) -> DataFrame:
        cov = requested_drug_coverage(cands, self.meds, self.formulary, self.excluded)
        return coverage_gate(enrich_coverage(cands, cov, self.meds), self.requests)

    def _candidates(self) -> DataFrame:
        return candidate_plans(self.requests, self.plan_info, self.formulary_metrics, self.network_metrics)

    def coverage(self) -> DataFrame:
        """J3 of every candidate."""
        if self.repeated:
            return requested_drug_coverage(self._candidates(), self.meds, self.formulary, self.excluded)
        found = formulary_coverage(self.formularies.select(REQ, "formulary_id"), self.meds, self.formulary, self.excluded)
        found = found.join(self.requests.select(REQ, *COUNTY), REQ)
        return self._expanded(found, self.plans.select(*COUNTY, "plan_key", "formulary_id")).select(REQ, "plan_key", *FOUND)

    def gated(self) -> DataFrame:
        """The candidates that pass the gate, with their coverage."""
        if self.repeated:
            return self._gated(self._candidates())
        rows = self._gated(self.formularies).select(REQ, *COUNTY, "formulary_id", F.col("plan_key").isNull().alias("_unknown"), *COVERAGE)
        return _local(self._expanded(rows, self.plans))

    def origins(self, profile: DataFrame) -> DataFrame:
        """The (ZIP, plan) pairs of the candidates that pass the gate."""
        at = profile.select(REQ, "zip_code")
        if self.repeated:
            return self._gated(self._candidates()).join(at, REQ).select("zip_code", "plan_key").distinct()
        unknown = F.col("plan_key").isNull().alias("_unknown")
        rows = self._gated(self.formularies).join(at, REQ).select("zip_code", *COUNTY, "formulary_id", unknown).distinct()
        return _of_formulary(rows, self.plans.select(*COUNTY, "plan_key", "formulary_id")).select("zip_code", "plan_key").distinct()


def dedupe_candidates(c: DataFrame, coverage_col: str | None = None) -> DataFrame:
    """One row per (request, plan): eligible, local, not comparison-only, higher
    coverage, nearer, cheaper, then plan key."""
    cov = F.coalesce(F.col(coverage_col).cast("double"), F.lit(0.0)) if coverage_col else F.lit(0.0)
    w = Window.partitionBy(REQ, "plan_key").orderBy(
        F.col("service_area_eligible").desc(), F.col("is_local").desc(), F.col("comparison_only").asc(),
        cov.desc(), F.coalesce(F.col("distance_miles").cast("double"), F.lit(9999.0)).asc(),
        F.coalesce(F.col("premium").cast("double"), F.lit(float("inf"))).asc(), F.col("plan_key").asc(),
    )
    return c.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


# ---------------------------------------------------------------------------
# J3 / J4 requested-drug coverage


def requested_drug_coverage(candidates: DataFrame, request_meds: DataFrame, formulary: DataFrame,
                            excluded: DataFrame) -> DataFrame:
    """Per (request, plan) requested / covered / in-formulary / excluded counts, the
    ordered uncovered NDC list, the coverage percentage and the cost of uncovered drugs.

    Coverage depends on the formulary only: drugs are looked up once per (request, formulary) offered, and each plan
    takes the result of its formulary."""
    plans = candidates.select(REQ, "plan_key", "formulary_id")
    agg = formulary_coverage(plans.select(REQ, "formulary_id"), request_meds, formulary, excluded)
    agg = agg.withColumnRenamed(REQ, "_req").withColumnRenamed("formulary_id", "_form")
    agg = plans.join(agg, (F.col(REQ) == F.col("_req")) & F.col("formulary_id").eqNullSafe(F.col("_form")))
    return agg.select(REQ, "plan_key", *FOUND)


#: What J3 finds.
FOUND = ["requested_drugs", "covered_drugs", "in_formulary_drugs", "excluded_drugs", "uncovered_ndcs", "drug_coverage_pct",
         "uncovered_requested_cost"]


def formulary_coverage(offered: DataFrame, request_meds: DataFrame, formulary: DataFrame, excluded: DataFrame) -> DataFrame:
    """J3 per (request, formulary) of ``offered``.  Exclusions are matched on distinct (formulary, rxcui) so a duplicated
    exclusion row does not count a drug twice (T10, chosen on purpose)."""
    meds = request_meds.groupBy(REQ, "ndc").agg(F.max(F.col("annual_cost_est").cast("double")).alias("_cost"))
    grid = offered.select(REQ, "formulary_id").distinct().join(meds, REQ)
    f = formulary.select(F.col("formulary_id").alias("_f_form"), F.col("ndc").alias("_f_ndc"),
                         F.col("rxcui").alias("_f_rxcui"))
    f = broadcast_if_small(f, bound_from=formulary)
    g = grid.join(f, (grid["formulary_id"] == f["_f_form"]) & (grid["ndc"] == f["_f_ndc"]), "left")
    ex = broadcast_if_small(
        excluded.select(F.col("formulary_id").alias("_x_form"), F.col("rxcui").alias("_x_rxcui")).distinct()
    )
    g = g.join(ex, (g["formulary_id"] == ex["_x_form"]) & (g["_f_rxcui"] == ex["_x_rxcui"]), "left")
    in_f = F.col("_f_ndc").isNotNull()
    is_ex = F.col("_x_rxcui").isNotNull()
    covered = in_f & ~is_ex
    agg = g.groupBy(REQ, "formulary_id").agg(
        F.count(F.lit(1)).alias("requested_drugs"),
        F.sum(F.when(covered, 1).otherwise(0)).alias("covered_drugs"),
        F.sum(F.when(in_f, 1).otherwise(0)).alias("in_formulary_drugs"),
        F.sum(F.when(is_ex, 1).otherwise(0)).alias("excluded_drugs"),
        F.array_sort(F.collect_list(F.when(~covered, F.col("ndc")))).alias("_unc"),
        F.sum(F.when(~covered, F.col("_cost")).otherwise(0.0)).alias("uncovered_requested_cost"),
    )
    return agg.select(
        REQ, "formulary_id",
        F.col("requested_drugs").cast("long").alias("requested_drugs"),
        F.col("covered_drugs").cast("long").alias("covered_drugs"),
        F.col("in_formulary_drugs").cast("long").alias("in_formulary_drugs"),
        F.col("excluded_drugs").cast("long").alias("excluded_drugs"),
        F.when(F.size("_unc") > 0, F.array_join("_unc", ", ")).alias("uncovered_ndcs"),
        F.when(F.col("requested_drugs") > 0, 100.0 * F.col("covered_drugs") / F.col("requested_drugs"))
        .otherwise(0.0).alias("drug_coverage_pct"),
        "uncovered_requested_cost",
    )


def coverage_status(pct: Column, requested: Column) -> Column:
    """Not evaluated without requested drugs, Good fit >= 90, Partial fit >= 50, else Poor fit."""
    p = F.coalesce(pct.cast("double"), F.lit(0.0))
    return (
        F.when(F.coalesce(requested, F.lit(0)) <= 0, "Not evaluated")
        .when(p >= 90.0, "Good fit")
        .when(p >= 50.0, "Partial fit")
        .otherwise("Poor fit")
    )


def enrich_coverage(candidates: DataFrame, coverage: DataFrame, request_meds: DataFrame) -> DataFrame:
    """Coverage merged onto candidates; requests without medications get zeros and
    'Not evaluated'."""
    n_req = request_meds.groupBy(REQ).agg(F.count_distinct("ndc").alias("n_requested_ndcs"))
    e = candidates.join(coverage, [REQ, "plan_key"], "left").join(n_req, REQ, "left")
    n = F.coalesce(F.col("n_requested_ndcs"), F.lit(0))
    e = e.withColumns(
        {
            "n_requested_ndcs": n,
            "requested_drugs": F.coalesce(F.col("requested_drugs"), n),
            "covered_drugs": F.coalesce(F.col("covered_drugs"), F.lit(0)),
            "in_formulary_drugs": F.coalesce(F.col("in_formulary_drugs"), F.lit(0)),
            "excluded_drugs": F.coalesce(F.col("excluded_drugs"), F.lit(0)),
            "drug_coverage_pct": F.coalesce(F.col("drug_coverage_pct"), F.lit(0.0)),
            "uncovered_ndcs": F.coalesce(F.col("uncovered_ndcs"), F.lit("")),
            "uncovered_requested_cost": F.coalesce(F.col("uncovered_requested_cost"), F.lit(0.0)),
        }
    )
    return e.withColumn("coverage_status", coverage_status(F.col("drug_coverage_pct"), F.col("n_requested_ndcs")))


def coverage_gate(enriched: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request keep the candidates meeting the minimum requested-drug coverage;
    when none does, keep every local candidate in comparison mode."""
    r = requests.select(REQ, "min_drug_coverage_pct")
    e = enriched.join(r, REQ)
    meets = (F.col("n_requested_ndcs") <= 0) | (F.col("drug_coverage_pct") >= F.col("min_drug_coverage_pct"))
    e = e.withColumn("_meets", meets)
    any_meets = F.max(F.col("_meets").cast("int")).over(Window.partitionBy(REQ))
    e = e.withColumn("_any", any_meets)
    out = e.where(F.col("_meets") | (F.col("_any") == 0)).withColumn(
        "results_mode", F.when(F.col("_any") == 1, "decision_support").otherwise("comparison_only")
    )
    return out.drop("_meets", "_any", "min_drug_coverage_pct")


# ---------------------------------------------------------------------------
# J23 effective profile and J8 OOP estimate


def _medication_totals() -> list[Column]:
    return [
        F.avg(F.col("fills_per_year").cast("double")).alias("_m_fills"),
        F.sum(F.col("annual_cost_est").cast("double")).alias("_m_cost"),
        F.max(F.col("is_insulin").cast("int")).alias("_m_ins"),
    ]


MEDICATION_FIELDS = ["ndc", "drug_name", "fills_per_year", "days_supply_mode", "tier_level", "is_insulin", "annual_cost_est"]


def medication_lists(request_meds: DataFrame) -> DataFrame:
    """One row per request: its medications in order, and what the profile takes from them.

    The drugs are counted in the list, so that list and totals come from one exchange of the medications."""
    lists = request_meds.groupBy(REQ).agg(F.array_sort(F.collect_list(F.struct(*MEDICATION_FIELDS))).alias("medication_list"), *_medication_totals())
    named = F.filter(F.col("medication_list.ndc"), lambda x: x.isNotNull())
    return lists.withColumn("_m_drugs", F.size(F.array_distinct(named)).cast("long"))


def effective_profile(requests: DataFrame, beneficiary: DataFrame, request_meds: DataFrame,
                      zip_default: DataFrame | None = None) -> DataFrame:
    """Medication-list values override the profile when the list is not empty.

    ``request_meds`` may be ``medication_lists``: their lists are then kept."""
    listed = "medication_list" in request_meds.columns
    meds = request_meds if listed else request_meds.groupBy(REQ).agg(F.count_distinct("ndc").alias("_m_drugs"), *_medication_totals())
    b = beneficiary.select(
        "bene_synth_id", "risk_segment", F.col("unique_drugs").alias("_b_drugs"),
        F.col("fills_target").alias("_b_fills"), F.col("total_rx_cost_est").alias("_b_cost"),
        F.col("insulin_user_flag").alias("_b_ins"),
    )
    p = requests.join(b, "bene_synth_id", "left").join(meds, REQ, "left")
    has = F.coalesce(F.col("_m_drugs"), F.lit(0)) > 0
    zip_col = F.col("zip_code")
    if zip_default is not None:
        p = p.join(zip_default.select("county_code", F.col("zip_code").alias("_rep_zip")), "county_code", "left")
        zip_col = F.coalesce(F.col("zip_code"), F.col("_rep_zip"))
    return p.select(
        REQ, "bene_synth_id", "state", "county_code", zip_col.alias("zip_code"),
        F.coalesce("risk_segment", F.lit("MED")).alias("risk_segment"),
        F.when(has, F.col("_m_drugs")).otherwise(F.coalesce(F.col("_b_drugs"), F.lit(0))).cast("int").alias("num_drugs"),
        F.when(has, F.col("_m_fills")).otherwise(F.coalesce(F.col("_b_fills"), F.lit(0)).cast("double"))
        .alias("avg_fills_per_year"),
        F.when(F.coalesce(F.col("_m_cost"), F.lit(0.0)) > 0, F.col("_m_cost"))
        .otherwise(F.coalesce(F.col("_b_cost"), F.lit(0.0))).alias("total_rx_cost_est"),
        F.when(has, F.col("_m_ins")).otherwise(F.coalesce(F.col("_b_ins"), F.lit(0))).cast("int").alias("is_insulin_user"),
        F.coalesce(F.col("_m_cost"), F.lit(0.0)).alias("medication_cost_total"),
        F.coalesce(F.col("_m_drugs"), F.lit(0)).alias("medication_count"),
        *(["medication_list"] if listed else []),
    )


def _ratio(c: Column) -> Column:
    x = F.coalesce(c.cast("double"), F.lit(0.0))
    return F.least(F.greatest(F.when(x > 1, x / 100.0).otherwise(x), F.lit(0.0)), F.lit(1.0))


def oop_estimate_columns() -> dict[str, Column]:
    """App-side OOP estimate with its four components (covered, uncovered,
    deductible 35 % of at most 800, network 8 % on inadequate networks), at least 50."""
    base = F.coalesce(F.col("total_rx_cost_est"), F.lit(0.0))
    base = F.when(F.col("medication_count") > 0, F.greatest(base, F.col("medication_cost_total"))).otherwise(base)
    num = F.greatest(F.coalesce(F.col("num_drugs"), F.lit(1)), F.lit(1))
    num = F.when(num == 0, 1).otherwise(num)
    fills = F.greatest(F.coalesce(F.when(F.col("avg_fills_per_year") != 0, F.col("avg_fills_per_year")), F.lit(12.0)), F.lit(1.0))
    req = F.coalesce(F.col("requested_drugs"), F.lit(0))
    unc_n = req - F.coalesce(F.col("covered_drugs"), F.lit(0))
    unc_cost = F.coalesce(F.col("uncovered_requested_cost"), F.lit(0.0))
    unc_cost = F.when((unc_cost <= 0) & (req > 0) & (unc_n > 0), base * (unc_n.cast("double") / req)).otherwise(unc_cost)
    covered_base = F.greatest(base - unc_cost, F.lit(0.0))
    intensity = (
        F.lit(0.20)
        + F.least(F.lit(0.25), 0.01 * (num - 1))
        + F.least(F.lit(0.15), 0.002 * F.greatest(fills - 12, F.lit(0.0)))
    )
    covered = (
        covered_base * intensity
        * (1.0 - 0.22 * _ratio(F.col("formulary_generic_pct")))
        * (1.0 + 0.25 * _ratio(F.col("formulary_specialty_pct")))
        * (1.0 + 0.18 * _ratio(F.col("formulary_pa_rate")) + 0.12 * _ratio(F.col("formulary_st_rate"))
           + 0.08 * _ratio(F.col("formulary_ql_rate")))
        * F.when(F.col("is_insulin_user") == 1, 0.92).otherwise(1.0)
    )
    ded = F.least(F.coalesce(F.col("deductible"), F.lit(0.0)), F.lit(800.0)) * 0.35
    net = covered * F.when(F.col("network_adequacy_flag") == 1, 0.08).otherwise(0.0)
    return {
        "oop_covered_component": covered,
        "oop_uncovered_component": unc_cost,
        "oop_deductible_component": ded,
        "oop_network_component": net,
        "estimated_annual_oop": F.greatest(F.lit(50.0), covered + unc_cost + ded + net),
    }


def legacy_oop_estimate() -> Column:
    """The earlier multiplicative estimate - base cost x intensity x generic discount x
    specialty / restriction / deductible (min(ded, 1000) / 3500) / network (x1.08)
    penalties x insulin adjustment, plus 35 % of the deductible up to 800, at least 50."""
    base = F.coalesce(F.col("total_rx_cost_est").cast("double"), F.lit(0.0))
    num = F.greatest(F.coalesce(F.col("num_drugs"), F.lit(1)), F.lit(1))
    fills = F.greatest(F.coalesce(F.col("avg_fills_per_year").cast("double"), F.lit(1.0)), F.lit(1.0))
    intensity = (F.lit(0.20) + F.least(F.lit(0.25), 0.01 * (num - 1))
                 + F.least(F.lit(0.15), 0.002 * F.greatest(fills - 12, F.lit(0.0))))
    ded = F.coalesce(F.col("deductible"), F.lit(0.0))
    est = (base * intensity * (1.0 - 0.22 * _ratio(F.col("formulary_generic_pct")))
           * (1.0 + 0.25 * _ratio(F.col("formulary_specialty_pct")))
           * (1.0 + 0.18 * _ratio(F.col("formulary_pa_rate")) + 0.12 * _ratio(F.col("formulary_st_rate"))
              + 0.08 * _ratio(F.col("formulary_ql_rate")))
           * (1.0 + F.least(ded, F.lit(1000.0)) / 3500.0)
           * F.when(F.col("network_adequacy_flag") == 1, 1.08).otherwise(1.0)
           * F.when(F.col("is_insulin_user") == 1, 0.92).otherwise(1.0))
    return F.greatest(F.lit(50.0), est + F.least(ded, F.lit(800.0)) * 0.35)


# ---------------------------------------------------------------------------
# J9 - J13 scores and ranking


def normalized(c: str, higher_is_better: bool = True, part: str = REQ) -> Column:
    """Min-max within the request; 0.5 when flat (np.isclose) or all null; nulls take
    the median of the normalised values."""
    w = Window.partitionBy(part)
    x = F.col(c).cast("double")
    x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    flat = F.abs(lo - hi) <= (1e-8 + 1e-5 * F.abs(hi))
    norm = F.when(lo.isNull() | flat, F.lit(0.5)).otherwise((x - lo) / (hi - lo))
    med = F.median(F.when(lo.isNull() | flat, F.lit(0.5)).otherwise((x - lo) / (hi - lo))).over(w)
    v = F.coalesce(norm, med, F.lit(0.5))
    return v if higher_is_better else (1.0 - v)


def decision_weights(requests: DataFrame) -> DataFrame:
    """ML share from the ML-influence setting, the rest split by the three priorities."""
    ml = F.least(F.greatest(F.col("ml_influence_pct"), F.lit(0.0)), F.lit(100.0)) / 100.0
    total = F.greatest(F.lit(1.0), F.col("cost_priority") + F.col("access_priority") + F.col("coverage_priority"))
    return requests.select(
        REQ,
        ml.alias("w_ml"),
        ((1 - ml) * F.col("cost_priority") / total).alias("w_cost"),
        ((1 - ml) * F.col("access_priority") / total).alias("w_access"),
        ((1 - ml) * F.col("coverage_priority") / total).alias("w_coverage"),
        F.col("distance_penalty_rate"),
    )


def score_and_rank(c: DataFrame) -> DataFrame:
    """J11 + J12 + J13: component scores, decision score, reason, heuristic score, rank."""
    d = c.withColumns(
        {
            "ml_component": normalized("score", True),
            "cost_component": normalized("total_cost_with_distance", False),
            "access_component": 0.5 * normalized("nearest_preferred_miles", False)
            + 0.3 * normalized("preferred_within_10mi", True)
            + 0.2 * normalized("network_accessibility_score", True),
            "_baseline_cov": 0.35 * normalized("formulary_generic_pct", True)
            + 0.25 * normalized("formulary_restrictiveness", False)
            + 0.20 * normalized("formulary_pa_rate", False)
            + 0.10 * normalized("formulary_st_rate", False)
            + 0.10 * normalized("formulary_ql_rate", False),
            "_req_cov": normalized("drug_coverage_pct", True),
        }
    )
    d = d.withColumn("coverage_component", 0.55 * F.col("_req_cov") + 0.45 * F.col("_baseline_cov"))
    d = d.withColumn(
        "decision_score",
        100.0 * (F.col("w_ml") * F.col("ml_component") + F.col("w_cost") * F.col("cost_component")
                 + F.col("w_access") * F.col("access_component") + F.col("w_coverage") * F.col("coverage_component")),
    )
    signals = F.array_compact(
        F.array(
            F.when(F.col("cost_component") >= 0.70, REASON_COST),
            F.when(F.col("access_component") >= 0.70, REASON_ACCESS),
            F.when(F.col("coverage_component") >= 0.70, REASON_FORMULARY),
            F.when(F.col("drug_coverage_pct") >= 90, REASON_COVERAGE),
            F.when(F.col("ml_component") >= 0.70, REASON_ML),
        )
    )
    d = d.withColumn(
        "decision_reason",
        F.when(F.size(signals) > 0, F.array_join(F.slice(signals, 1, 2), ", ")).otherwise(REASON_BALANCED),
    )
    d = d.withColumn(
        "heuristic_score",
        100.0 * (0.55 * normalized("total_cost_with_distance", False)
                 + 0.20 * normalized("nearest_preferred_miles", False)
                 + 0.25 * normalized("drug_coverage_pct", True)),
    )
    w = Window.partitionBy(REQ).orderBy(F.col("decision_score").desc(), F.col("score").desc(), F.col("plan_key"))
    return d.withColumn("rank", F.row_number().over(w)).drop("_baseline_cov", "_req_cov")


# ---------------------------------------------------------------------------
# J14 - J17 flags, gaps, confidence, coverage summary


def warning_flags() -> Column:
    """Ordered warning labels."""
    status = F.col("coverage_status")
    nearest = F.coalesce(F.col("nearest_preferred_miles"), F.col("distance_miles"), F.lit(0.0))
    return F.array_compact(
        F.array(
            F.when(~F.col("service_area_eligible"), WARN_OUTSIDE),
            F.when(status == "Poor fit", WARN_LOW_COVERAGE).when(status == "Partial fit", WARN_PARTIAL),
            F.when(F.col("network_adequacy_flag") != 0, WARN_NETWORK),
            F.when(nearest > 10, WARN_FAR),
            F.when(F.coalesce(F.col("deductible"), F.lit(0.0)) >= 400.0, WARN_DEDUCTIBLE),
            F.when(F.coalesce(F.col("formulary_restrictiveness"), F.lit(0)) >= 2, WARN_RESTRICTIVE),
        )
    )


def evidence_gaps() -> Column:
    """Ordered evidence gaps."""
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("has_formulary_metrics"), F.lit(0)) == 0, GAP_FORMULARY),
            F.when(F.coalesce(F.col("has_network_metrics"), F.lit(0)) == 0, GAP_NETWORK),
            F.when(F.coalesce(F.col("has_pharmacy_distance_data"), F.lit(0)) == 0, GAP_DISTANCE),
            F.when(F.coalesce(F.col("n_requested_ndcs"), F.lit(0)) <= 0, GAP_NO_MEDS),
            F.when(~F.col("service_area_eligible"), GAP_COMPARISON),
        )
    )


def confidence_band() -> Column:
    """Exploratory outside the area; Low for poor fit or >= 3 gaps; Medium for partial
    fit or any gap; else High."""
    gaps = F.size(F.col("evidence_gaps"))
    status = F.col("coverage_status")
    return (
        F.when(~F.col("service_area_eligible"), "Exploratory")
        .when((status == "Poor fit") | (gaps >= 3), "Low")
        .when((status == "Partial fit") | (gaps >= 1), "Medium")
        .otherwise("High")
    )


def feature_coverage(ranked: DataFrame) -> DataFrame:
    """Per request, candidate count and evidence coverage counts."""
    return ranked.groupBy(REQ).agg(
        F.count(F.lit(1)).alias("candidate_plans"),
        F.sum(F.col("service_area_eligible").cast("int")).alias("eligible_plans"),
        F.sum("has_network_metrics").alias("plans_with_network_metrics"),
        F.sum("has_pharmacy_distance_data").alias("plans_with_pharmacy_distance_data"),
        F.sum("has_formulary_metrics").alias("plans_with_formulary_metrics"),
    )


def recommendation_schema(ranked: DataFrame) -> DataFrame:
    """Stable recommendation contract with nested cost / access records."""
    r2 = lambda c: F.bround(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 2)
    d = ranked.withColumns(
        {
            "warning_flags": warning_flags(),
            "evidence_gaps": evidence_gaps(),
        }
    ).withColumn("confidence_band", confidence_band())
    return d.select(
        F.substring(F.sha2(F.col(REQ), 256), 1, 12).alias("run_id"),
        REQ, "rank", "plan_key", "plan_name", "contract_type", "eligibility_status", "coverage_status",
        F.col("drug_coverage_pct").alias("coverage_pct_requested"),
        F.coalesce(F.col("total_cost_with_distance"), F.lit(0.0)).alias("estimated_total_annual_cost"),
        F.struct(
            F.bround(F.coalesce(F.col("premium"), F.lit(0.0)) * 12.0, 2).alias("annual_premium"),
            r2("estimated_annual_oop").alias("estimated_oop"),
            r2("distance_penalty").alias("distance_penalty"),
            r2("total_cost_with_distance").alias("estimated_total_annual_cost"),
            F.col("oop_breakdown").alias("oop_components"),
        ).alias("cost_breakdown"),
        F.struct(
            F.col("is_local").alias("local_plan"),
            F.col("comparison_only").alias("comparison_only"),
            r2("distance_miles").alias("distance_miles"),
            F.bround(F.coalesce(F.col("nearest_preferred_miles"), F.col("distance_miles"), F.lit(0.0)), 2)
            .alias("nearest_preferred_miles"),
            F.coalesce(F.col("preferred_within_10mi"), F.lit(0)).cast("int").alias("preferred_within_10mi"),
            F.bround(F.coalesce(F.col("network_accessibility_score"), F.lit(0.0)), 1).alias("network_accessibility_score"),
            F.coalesce(F.col("location_county"), F.lit("")).alias("location_county"),
        ).alias("access_summary"),
        "warning_flags", "decision_score",
        F.coalesce(F.col("score"), F.lit(0.0)).alias("ml_score"),
        F.coalesce(F.col("heuristic_score"), F.lit(0.0)).alias("heuristic_score"),
        "confidence_band", "evidence_gaps", "decision_reason", "results_mode",
    )


def run_audit(schema: DataFrame, k: int = 5) -> DataFrame:
    """One audit record per request: the top-k outputs as JSON and the trust flag
    (top plan eligible, not a poor fit, Medium/High confidence, not comparison mode).
    Only k rows per request are collected, so the record is bounded."""
    top = schema.where(F.col("rank") <= k)
    rec = F.struct("rank", "plan_key", "plan_name", "eligibility_status", "coverage_status", "coverage_pct_requested",
                   "estimated_total_annual_cost", "decision_score", "ml_score", "confidence_band")
    first = schema.where(F.col("rank") == 1).select(
        REQ,
        ((F.col("eligibility_status") == "Eligible") & (F.col("coverage_status") != "Poor fit")
         & F.col("confidence_band").isin("Medium", "High") & (F.col("results_mode") != "comparison_only"))
        .alias("trusted_recommendation"),
        "results_mode",
    )
    agg = top.groupBy(REQ, "run_id").agg(F.array_sort(F.collect_list(rec)).alias("_top"))
    return agg.join(first, REQ).select(
        REQ, "run_id", "results_mode", "trusted_recommendation", F.to_json("_top").alias("top_k_outputs")
    )


def reader_texts(schema: DataFrame) -> DataFrame:
    """J24: 'why it surfaced' (first four lines) and 'what would change' lines per
    recommendation row of ``recommendation_schema`` output."""
    reason = F.trim(F.coalesce(F.col("decision_reason"), F.lit("")))
    cap = F.concat(F.upper(F.substring(reason, 1, 1)), F.lower(F.substring(reason, 2, 100000)))
    pct = F.coalesce(F.col("coverage_pct_requested"), F.lit(0.0))
    near = F.coalesce(F.col("access_summary.nearest_preferred_miles"), F.lit(0.0))
    prem = F.coalesce(F.col("cost_breakdown.annual_premium"), F.lit(0.0))
    why = F.slice(
        F.array_compact(
            F.array(
                F.when(reason != "", cap),
                F.when(pct > 0, F.format_string("Requested-drug coverage is %.1f%%.", pct)),
                F.when(near > 0, F.format_string("Nearest preferred pharmacy estimate: %.1f miles.", near)),
                F.when(prem > 0, F.format_string("Annual premium estimate: $%,.0f.", prem)),
            )
        ),
        1,
        4,
    )
    unc = F.coalesce(F.col("cost_breakdown.oop_components.uncovered_component"), F.lit(0.0))
    changes = F.array_compact(
        F.array(
            F.when(unc > 0, "This plan is sensitive to the requested medications that are not currently covered."),
            F.when(F.coalesce(F.col("access_summary.distance_miles"), F.lit(0.0)) > 0,
                   "Changing the preferred ZIP or pharmacy distance tolerance could reorder this plan."),
            F.when(F.size("evidence_gaps") > 0,
                   "Better network or formulary evidence could change confidence more than rank."),
        )
    )
    changes = F.when(F.size(changes) > 0, changes).otherwise(
        F.array(F.lit("This plan looks relatively stable under the current assumptions."))
    )
    return schema.select(REQ, "plan_key", "rank", why.alias("why_surfaced"), changes.alias("what_would_change"))


def uncovered_with_names(ranked: DataFrame, request_meds: DataFrame) -> DataFrame:
    """The uncovered requested NDCs of each recommendation as 'name (NDC x)' (or 'NDC x'
    without a name), in NDC order."""
    names = request_meds.groupBy(REQ, "ndc").agg(F.max("drug_name").alias("drug_name"))
    u = ranked.select(REQ, "plan_key", F.explode(F.split(F.col("uncovered_ndcs"), ",")).alias("ndc"))
    u = u.withColumn("ndc", F.trim("ndc")).where(F.col("ndc") != "")
    u = u.join(names, [REQ, "ndc"], "left")
    label = F.when(F.coalesce(F.col("drug_name"), F.lit("")) != "",
                   F.concat(F.col("drug_name"), F.lit(" (NDC "), F.col("ndc"), F.lit(")"))).otherwise(
        F.concat(F.lit("NDC "), F.col("ndc")))
    return u.groupBy(REQ, "plan_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ndc", label.alias("l")))), lambda x: x["l"]), ", ")
        .alias("uncovered_display")
    )


def _all(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


__all__ = [
    "candidate_plans", "dedupe_candidates", "requested_drug_coverage", "enrich_coverage", "coverage_gate",
    "effective_profile", "oop_estimate_columns", "normalized", "decision_weights", "score_and_rank",
    "warning_flags", "evidence_gaps", "confidence_band", "feature_coverage", "recommendation_schema", "run_audit",
    "coverage_status", "distance_category_display", "distance_penalty",
]
