"""Registered draws / sampling, drug catalogue and research-evaluation queries (F, L, K, D13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxgrid.functions.draws import stable_fraction, stable_uniform
from rxgrid.operators import drugs as L
from rxgrid.operators import evaluate as K
from rxgrid.operators import sampling as S
from rxgrid.plans.registry import q


@q("F2_keyed_draws")
def f2(ctx):
    b = ctx.t("beneficiary")
    return b.select("bene_synth_id", stable_fraction(F.col("bene_synth_id")).alias("fraction"),
                    stable_uniform(F.col("bene_synth_id"), 2.0, 25.0).alias("uniform_2_25"),
                    stable_fraction(F.col("bene_synth_id"), seed=7).alias("fraction_seed7"))


@q("F3_county_weights")
def f3(ctx):
    return S.county_weights(ctx.t("geographic"), ctx.zip_county)


@q("F4_zip_assignment")
def f4(ctx):
    assigned, _ = S.assign_population_weighted_zips(ctx.t("beneficiary"), ctx.zip_county, seed=17)
    return assigned


@q("F4_zip_assignment_audit")
def f4a(ctx):
    _, audit = S.assign_population_weighted_zips(ctx.t("beneficiary"), ctx.zip_county, seed=17)
    return audit


@q("F5_county_assignment")
def f5(ctx):
    w = S.county_weights(ctx.t("geographic"), ctx.zip_county)
    return S.assign_counties(ctx.t("beneficiary").select("bene_synth_id", "county_code", "state"), w, seed=42)


def _pool(ctx):
    return L.formulary_drug_pool(ctx.t("formulary"), ctx.t("insulin_ref"))


@q("D13_formulary_drug_pool")
def d13(ctx):
    return _pool(ctx)


def _sampled(ctx):
    key = "_sampled"
    if key not in ctx.__dict__:
        groups = ctx.t("beneficiary").where(F.col("unique_drugs").isNotNull())
        ctx.__dict__[key] = S.sample_without_replacement(groups, _pool(ctx), "unique_drugs", "formulary_coverage", "ndc")
    return ctx.__dict__[key]


@q("F6_weighted_drug_sample")
def f6(ctx):
    return _sampled(ctx)


@q("F7_forced_insulin")
def f7(ctx):
    return S.force_inclusion(_sampled(ctx), ctx.t("beneficiary"), _pool(ctx), "insulin_user_flag", "is_insulin", "ndc")


@q("F8_fill_allocation")
def f8(ctx):
    items = ctx.t("prescriptions").select("bene_synth_id", "ndc").join(
        ctx.t("beneficiary").select("bene_synth_id", "fills_target"), "bene_synth_id")
    return S.allocate_fills(items, "fills_target", "bene_synth_id", "ndc").select(
        "bene_synth_id", "ndc", "fills_target", "fills_allocated")


@q("F9_replicated_pool")
def f9(ctx):
    return S.replicated_pool(_pool(ctx), "formulary_coverage").select("ndc", "copy")


@q("F10_fill_events")
def f10(ctx):
    return S.fill_events(ctx.t("prescriptions").select("bene_synth_id", "ndc", "fills_per_year")).select(
        "bene_synth_id", "ndc", "fill_num", "srvc_dt")


@q("F11_best_rxcui_names")
def f11(ctx):
    ref = ctx.t("drug_names").select("rxcui", F.col("drug_name").alias("name"), F.col("drug_synonym").alias("synonym"),
                                     "tty")
    return S.best_rxcui_names(ref)


@q("F12_drug_name_resolution")
def f12(ctx):
    rx = ctx.t("prescriptions")
    name, src = S.resolve_drug_name(F.col("drug_name"), F.col("drug_synonym"), F.col("ndc"))
    return rx.select("bene_synth_id", "ndc", name.alias("resolved_name"), src.alias("name_source"))


@q("F13_research_sample")
def f13(ctx):
    return S.research_sample(ctx.t("beneficiary"), 100, seed=42, risk=["Low", "Medium", "High"])


@q("F14_keyed_downsample")
def f14(ctx):
    return S.keyed_downsample(ctx.t("pde_events"), F.col("claim_id"), 0.10).select("claim_id", "bene_id", "prod_srvc_id")


# --- L ------------------------------------------------------------------------


@q("B26_ndc_from_text")
def b26(ctx):
    docs = L.extract_ndcs(ctx.t("documents"), "doc_id")
    conv = L.extract_ndcs(ctx.t("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text"), "doc_id")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "ndc11").unionByName(conv)


@q("L3_parse_ndc_text")
def l3(ctx):
    return L.parse_ndc_text(ctx.t("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("msg_id"), "text"),
                            "msg_id")


@q("L4_normalize_medications")
def l4(ctx):
    return L.normalize_medications(ctx.t("request_medications"))


@q("L5_medication_summary")
def l5(ctx):
    return L.summarize_medications(L.merge_medications(L.normalize_medications(ctx.t("request_medications"))))


@q("L1_drug_search")
def l1(ctx):
    return L.search_catalog(ctx.t("drug_queries"), L.drug_catalog(ctx.t("prescriptions")), limit=20)


@q("L6_name_dictionary_search")
def l6(ctx):
    return L.name_dictionary_search(ctx.t("drug_queries"), ctx.t("drug_names"), limit=10)


# --- K ------------------------------------------------------------------------


def _research(ctx):
    key = "_research"
    if key not in ctx.__dict__:
        ctx.__dict__[key] = K.research_frame(ctx.training_pairs)
    return ctx.__dict__[key]


@q("K1_top_choice")
def k1(ctx):
    return K.top_choice(_research(ctx), "ml_score", 3).select("bene_synth_id", "plan_key", "selection_rank")


@q("K2_regret_summary")
def k2(ctx):
    return K.regret_summary(K.model_vs_baseline(_research(ctx)))


@q("K3_model_vs_baseline_detail")
def k3(ctx):
    return K.model_vs_baseline(_research(ctx)).select("method", "bene_synth_id", "plan_key", "ranking_cost_objective",
                                                       "group_best_cost", "top3_best_cost", "cost_regret")


@q("K4_preference_stability")
def k4(ctx):
    return K.preference_stability(_research(ctx))


@q("K5_fairness_tables")
def k5(ctx):
    return K.fairness_tables(K.model_vs_baseline(_research(ctx)))


@q("K6_data_coverage")
def k6(ctx):
    return K.data_coverage(_research(ctx))


@q("K7_summary_long")
def k7(ctx):
    return K.melt_summary(K.regret_summary(K.model_vs_baseline(_research(ctx))))


@q("K8_research_states")
def k8(ctx):
    return K.research_states(ctx.t("beneficiary"))
