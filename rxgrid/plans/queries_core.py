"""Core registered queries: gold metrics, distance features, pairs and cost model."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxgrid.plans import pairs
from rxgrid.plans.registry import q


@q("D1_formulary_metrics")
def d1(ctx):
    return ctx.formulary_metrics


@q("D2_network_metrics")
def d2(ctx):
    return ctx.network_metrics


@q("B31_zip_county")
def b31(ctx):
    return ctx.zip_county


@q("D12_county_density")
def d12(ctx):
    return ctx.county_density


@q("E9_distance_features")
def e9(ctx):
    return ctx.distance_features


@q("G1_service_pairs")
def g1(ctx):
    return pairs.service_pairs(ctx.pair_inputs()).select(
        "bene_synth_id", "plan_key", "state", "county_code", "contract_type", "plan_premium", "plan_deductible",
        "formulary_total_drugs", "network_total_pharmacies", "distance_miles", "distance_category", "distance_penalty",
    )


@q("G13_pair_drug_costs")
def g13(ctx):
    rows = pairs.pair_drug_rows(ctx.pair_inputs(), keep_empty=False)
    return rows.select(
        "bene_synth_id", "plan_key", "ndc", "effective_tier", "in_formulary", "is_excluded", "is_covered",
        "unit_cost_resolved", "annual_pricing_raw", "annual_gross_cost", "gross_per_fill", "cost_type_pref",
        "insulin_copay_pref", "per_fill_post_ded_cost", "annual_post_ded_cost", "effective_share_rate",
        "ded_eligible_gross",
    )


@q("G16_training_pairs")
def g16(ctx):
    return ctx.training_pairs


# --- H ranking and explanations --------------------------------------------
from rxgrid.operators import features as I  # noqa: E402
from rxgrid.operators import ranking as H  # noqa: E402


@q("H1_top5_plans")
def h1(ctx):
    return H.top_plans(ctx.pairs_once, 5)


@q("H3_explanations")
def h3(ctx):
    return H.explain(H.top_plans(ctx.pairs_once, 5))


@q("H4_explanation_stats")
def h4(ctx):
    return H.explanation_stats(H.explain(H.top_plans(ctx.training_pairs, 5)))


@q("H4_explanation_sample")
def h4s(ctx):
    return H.explanation_sample(H.explain(H.top_plans(ctx.training_pairs, 5)))


# --- I ranking features, labels, split, NDCG ---------------------------------


@q("I8_ranking_matrix")
def i8(ctx):
    return I.ranking_matrix(ctx.pairs_once)


@q("I9_relevance_labels")
def i9(ctx):
    m = I.ranking_matrix(ctx.pairs_once)
    return I.relevance_labels(m).select("bene_synth_id", "plan_key", "ranking_cost_objective", "relevance_label")


@q("I10_group_split")
def i10(ctx):
    m = I.group_split(I.ranking_matrix(ctx.pairs_once))
    return I.split_overlap(m)


@q("I12_ndcg_baseline")
def i12(ctx):
    m = I.relevance_labels(I.ranking_matrix(ctx.pairs_once))
    m = m.withColumn("score", -(F.col("annual_premium") + F.col("total_drug_oop")))
    return I.mean_ndcg(I.ndcg_at_k(m, "score", "relevance_label"))
