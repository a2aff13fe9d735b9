"""Registered intermediate steps of the composite pipelines, one key per SURVEY id
(G2-G8, G10, G12, G15, J7, J10, E4, L2, M3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxgrid.operators import costmodel as G
from rxgrid.operators import decision as J
from rxgrid.operators import drugs as L
from rxgrid.operators import geo
from rxgrid.plans import pairs
from rxgrid.plans.registry import q


@q("G2_normalized_prescriptions")
def g2(ctx):
    return G.normalize_prescriptions(ctx.t("prescriptions"))


@q("G3_formulary_map")
def g3(ctx):
    return G.formulary_map(ctx.t("formulary"))


@q("G4_excluded_map")
def g4(ctx):
    return G.excluded_map(ctx.t("excluded_drugs"))


@q("G5_pricing_bounds")
def g5(ctx):
    return G.pricing_bounds(G.pricing_raw(ctx.t("pricing")))


@q("G6_pricing_map")
def g6(ctx):
    return G.pricing_map(ctx.t("pricing"))


@q("G7_cost_rules")
def g7(ctx):
    return G.cost_rules(ctx.t("beneficiary_cost"))


@q("G8_insulin_rules")
def g8(ctx):
    return G.insulin_rules(ctx.t("insulin_cost"))


def _rows(ctx):
    key = "_pair_drug_rows"
    if key not in ctx.__dict__:
        ctx.__dict__[key] = pairs.pair_drug_rows(ctx.pair_inputs(), keep_empty=False)
    return ctx.__dict__[key]


@q("G10_calibrated_gross_cost")
def g10(ctx):
    return _rows(ctx).select("bene_synth_id", "plan_key", "ndc", "units_per_fill", "unit_cost_resolved",
                             "annual_pricing_raw", "annual_gross_cost", "in_formulary", "effective_rxcui")


@q("G12_per_fill_cost")
def g12(ctx):
    return _rows(ctx).select("bene_synth_id", "plan_key", "ndc", "effective_tier", "is_covered", "cost_type_pref",
                             "deductible_applies", "insulin_copay_pref", "per_fill_post_ded_cost")


@q("G15_pair_cost_aggregate")
def g15(ctx):
    return ctx.training_pairs.where(F.col("covered_drug_count") + F.col("uncovered_drug_count") > 0).select(
        "bene_synth_id", "plan_key", "estimated_annual_oop", "oop_copay_component", "oop_coinsurance_component",
        "oop_deductible_component", "oop_insulin_component", "oop_uncovered_component", "covered_drug_count",
        "uncovered_drug_count")


@q("J7_legacy_oop_estimate")
def j7(ctx):
    req, meds = ctx.t("requests"), ctx.t("request_medications")
    cands = J.candidate_plans(req, ctx.t("plan_info"), ctx.formulary_metrics, ctx.network_metrics)
    prof = J.effective_profile(req, ctx.t("beneficiary"), meds)
    # the profiles are hashed where the candidates of a request are
    c = cands.drop("state", "county_code").join(prof.hint("shuffle_hash"), J.REQ)
    return c.select(J.REQ, "plan_key", J.legacy_oop_estimate().alias("estimated_annual_oop"))


@q("J10_decision_weights")
def j10(ctx):
    return J.decision_weights(ctx.t("requests")).drop("distance_penalty_rate")


@q("E4_zip_pharmacy_distances")
def e4(ctx):
    prof = J.effective_profile(ctx.t("requests"), ctx.t("beneficiary"), ctx.t("request_medications"))
    return geo.zip_pharmacy_distances(ctx.gate.origins(prof), ctx.t("pharmacy_network"), ctx.zip_county)


@q("L2_ndc_token_candidates")
def l2(ctx):
    m = ctx.t("request_medications").select("request_id", "ndc")
    fmt = F.concat(F.substring("ndc", 3, 5), F.lit("-"), F.substring("ndc", 8, 4))  # a shortened, dashed form
    return m.select("request_id", "ndc", fmt.alias("token"), L.ndc_candidates(fmt).alias("candidates"))


@q("M3_gold_validation")
def m3(ctx):
    fm, nm = ctx.formulary_metrics, ctx.network_metrics
    a = fm.agg(F.lit("agg_plan_formulary_metrics").alias("table_name"), F.count(F.lit(1)).alias("rows"),
               F.avg("total_drugs").alias("avg_metric"), F.sum(F.when(F.col("restrictiveness_class") == 2, 1).otherwise(0))
               .alias("flagged"))
    b = nm.agg(F.lit("agg_plan_network_metrics").alias("table_name"), F.count(F.lit(1)).alias("rows"),
               F.avg("total_pharmacies").alias("avg_metric"), F.sum("network_adequacy_flag").alias("flagged"))
    d = ctx.distance_features.agg(F.lit("plan_distance_features").alias("table_name"), F.count(F.lit(1)).alias("rows"),
                                  F.avg("simulated_distance_miles").alias("avg_metric"),
                                  F.sum(F.when(F.col("distance_category") == "far", 1).otherwise(0)).alias("flagged"))
    return a.unionByName(b).unionByName(d)
