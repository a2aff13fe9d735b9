"""Registered decision-support queries (J, E4/E5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxgrid.operators import decision as J
from rxgrid.plans import recommend
from rxgrid.plans.registry import q


@q("J2_candidate_plans")
def j2(ctx):
    cands = J.candidate_plans(ctx.t("requests"), ctx.t("plan_info"), ctx.formulary_metrics, ctx.network_metrics)
    return cands.select(J.REQ, "plan_key", "plan_name", "contract_type", "premium", "deductible",
                        "formulary_total_drugs", "network_preferred_pharmacies", "has_formulary_metrics",
                        "has_network_metrics", "eligibility_status")


@q("J3_requested_drug_coverage")
def j3(ctx):
    return ctx.gate.coverage()


@q("J5_coverage_gate")
def j5(ctx):
    return ctx.gate.gated().select(J.REQ, "plan_key", "requested_drugs", "covered_drugs", "drug_coverage_pct",
                        "uncovered_ndcs", "coverage_status", "results_mode")


@q("J23_effective_profile")
def j23(ctx):
    return J.effective_profile(ctx.t("requests"), ctx.t("beneficiary"), ctx.t("request_medications"))


@q("E5_network_accessibility")
def e5(ctx):
    prof = J.effective_profile(ctx.t("requests"), ctx.t("beneficiary"), ctx.t("request_medications"))
    return recommend.access_metrics(ctx, prof, mean=True)


def _scored(ctx):
    key = "_scored"
    if key not in ctx.__dict__:
        ctx.__dict__[key] = recommend.scored_candidates(ctx)
    return ctx.__dict__[key]


@q("J8_oop_estimate")
def j8(ctx):
    return _scored(ctx).select(J.REQ, "plan_key", "oop_covered_component", "oop_uncovered_component",
                               "oop_deductible_component", "oop_network_component", "estimated_annual_oop",
                               "distance_penalty", "total_cost_with_distance")


@q("J13_ranked_plans")
def j13(ctx):
    return _scored(ctx).select(J.REQ, "plan_key", "rank", "ml_component", "cost_component", "access_component",
                               "coverage_component", "decision_score", "heuristic_score", "decision_reason")


@q("J16_flags_confidence")
def j16(ctx):
    s = J.recommendation_schema(_scored(ctx))
    return s.select(J.REQ, "plan_key", F.array_join("warning_flags", " | ").alias("warning_flags"),
                    F.array_join("evidence_gaps", " | ").alias("evidence_gaps"), "confidence_band")


@q("J17_feature_coverage")
def j17(ctx):
    return J.feature_coverage(_scored(ctx))


@q("J18_recommendation_schema")
def j18(ctx):
    s = J.recommendation_schema(_scored(ctx))
    return s.select(
        "run_id", J.REQ, "rank", "plan_key", "plan_name", "contract_type", "eligibility_status", "coverage_status",
        "coverage_pct_requested", "estimated_total_annual_cost",
        F.col("cost_breakdown.annual_premium").alias("annual_premium"),
        F.col("cost_breakdown.estimated_oop").alias("estimated_oop"),
        F.col("cost_breakdown.oop_components.uncovered_component").alias("oop_uncovered_component"),
        F.col("access_summary.nearest_preferred_miles").alias("nearest_preferred_miles"),
        F.col("access_summary.preferred_within_10mi").alias("preferred_within_10mi"),
        "decision_score", "ml_score", "heuristic_score", "confidence_band", "results_mode",
    )


@q("J19_run_audit")
def j19(ctx):
    return J.run_audit(J.recommendation_schema(_scored(ctx)))


@q("J21_top5_report")
def j21(ctx):
    s = J.recommendation_schema(_scored(ctx))
    return s.where(F.col("rank") <= 5).select(
        J.REQ, "rank", F.col("plan_key").alias("plan"), F.col("plan_name").alias("plan_name"),
        F.col("estimated_total_annual_cost").alias("estimated_annual_total"),
        F.col("coverage_status").alias("coverage_fit"), F.col("confidence_band").alias("confidence"),
    )


@q("J24_reader_texts")
def j24(ctx):
    t = J.reader_texts(J.recommendation_schema(_scored(ctx)))
    return t.select(J.REQ, "plan_key", "rank", F.array_join("why_surfaced", " | ").alias("why_surfaced"),
                    F.array_join("what_would_change", " | ").alias("what_would_change"))


@q("J25_uncovered_names")
def j25(ctx):
    return J.uncovered_with_names(_scored(ctx), ctx.t("request_medications"))
