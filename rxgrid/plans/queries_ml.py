"""Registered ML-feature, model and legacy-label queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rxgrid.functions.columns import contract_type
from rxgrid.functions.draws import stable_fraction
from rxgrid.functions.joins import broadcast_if_small
from rxgrid.operators import claims as D
from rxgrid.operators import features as I
from rxgrid.operators import fingerprint
from rxgrid.operators import gold as GD
from rxgrid.operators import lambdamart as LM
from rxgrid.operators import metrics
from rxgrid.operators import ml
from rxgrid.operators import silver as S
from rxgrid.plans.pairs import pair_partitions
from rxgrid.plans.registry import q
from rxgrid.session import shared_table
from rxgrid.sources.adapter import view_names


def _plan_level(ctx):
    key = "_plan_level"
    if key not in ctx.__dict__:
        slv_form = S.formulary(ctx.t("formulary"), ctx.t("insulin_ref"))
        cost = GD.cost_metrics(ctx.t("beneficiary_cost"))
        ins = GD.insulin_friendliness(GD.insulin_cost_metrics(S.insulin_cost(ctx.t("insulin_cost"))),
                                      GD.insulin_access_metrics(ctx.t("plan_info"), slv_form))
        net = GD.network_metrics_nb(S.network(ctx.t("pharmacy_network")).withColumn(
            "plan_key", F.concat("contract_id", "plan_id", "segment_id")))
        ctx.__dict__[key] = (cost, ins, net)
    return ctx.__dict__[key]


def _summary(ctx):
    """The plan dimension with all plan aggregates, one row per plan."""
    key = "_summary"
    if key not in ctx.__dict__:
        cost, ins, net = _plan_level(ctx)
        form = GD.formulary_metrics_nb(ctx.t("plan_info"), S.formulary(ctx.t("formulary"), ctx.t("insulin_ref")))
        plans = GD.dim_plan(ctx.t("plan_info")).select(
            "plan_key", contract_type("is_ma_pd", "is_pdp").alias("contract_type"), "state", "county_code",
            F.col("snp").cast("string").alias("snp"), "premium", "deductible")
        out = ml.plan_feature_summary(plans, form, net, GD.pricing_metrics(ctx.t("pricing")), cost, ins)
        ctx.__dict__[key] = shared_table(out, "plan-summary")
    return ctx.__dict__[key]


def _labels(ctx):
    key = "_plan_labels"
    if key not in ctx.__dict__:
        ctx.__dict__[key] = shared_table(ml.plan_labels(_summary(ctx)), "plan-labels")
    return ctx.__dict__[key]


#: What the legacy pair cost reads of the label table.
LEGACY_COLUMNS = ["pref_copay_share", "pref_avg_copay_amt", "pref_coinsurance_share", "pref_avg_coins_rate", "ded_applies_rate",
                  "insulin_risk_flag", "insulin_access_risk_flag", "insulin_cap_violation_flag", "network_adequacy_flag",
                  "restrictiveness_class"]


def _legacy(ctx):
    key = "_legacy"
    if key in ctx.__dict__:
        return ctx.__dict__[key]
    plans = metrics.active_plans(ctx.t("plan_info")).select("plan_key", "state", "county_code", "premium", "deductible")
    plans = plans.join(_labels(ctx).select("plan_key", *LEGACY_COLUMNS), "plan_key", "left")
    by = D.bene_year_summary(ctx.t("pde_events"), ctx.t("insulin_ref").where(F.col("ndc").isNotNull()))
    bene = ctx.t("beneficiary").select(F.col("bene_synth_id").alias("bene_id"), "state", "county_code", "risk_segment")
    # the plans are a size-checked broadcast and the beneficiaries dealt by the pairs they expand into, so no pair is
    # shuffled and no county's plans are buffered for each of its beneficiaries
    year = by.join(bene, "bene_id").repartition(pair_partitions(ctx.t("beneficiary"), ctx.t("plan_info")), "bene_id")
    pairs = year.join(broadcast_if_small(plans), ["state", "county_code"])
    ctx.__dict__[key] = ml.legacy_pair_cost(pairs)
    return ctx.__dict__[key]


@q("G18_legacy_pair_cost")
def g18(ctx):
    return _legacy(ctx).select("bene_id", "plan_key", "county_code", "annual_premium", "oop_copay_component",
                               "oop_coins_component", "oop_deductible_component", "oop_insulin_raw", "oop_insulin_capped",
                               "insulin_access_penalty", "network_penalty", "y_annual_oop")


@q("G19_suitability_labels")
def g19(ctx):
    return ml.suitability(_legacy(ctx)).select(
        "bene_id", "plan_key", "county_code", "oop_band", "warn_network", "warn_insulin_cap", "warn_insulin_access",
        "warn_restrict", "warning_score", "suitability_class", "explain_network", "explain_insulin_cap",
        "explain_insulin_access", "explain_restrict")


@q("I1_plan_zscores")
def i1(ctx):
    return _labels(ctx).select("plan_key", *[f"{c}_z" for c in ml.LABEL_FEATURES])


@q("I2_premium_terciles")
def i2(ctx):
    plans = GD.dim_plan(ctx.t("plan_info")).select("plan_key", "premium").where(F.col("premium").isNotNull())
    return ml.quantile_class(plans, "premium", "premium_band")


@q("I2_label_classes")
def i2_labels(ctx):
    return _labels(ctx).select("plan_key", "restrictiveness_index", "restrictiveness_class", "insulin_friendliness_score",
                               "insulin_friendliness_class")


@q("I5_plan_feature_summary")
def i5(ctx):
    return _summary(ctx)


@q("I6_rule_labels")
def i6(ctx):
    return _labels(ctx).select("plan_key", "network_adequacy_flag", "insulin_cap_violation_flag", "insulin_access_risk_flag")


@q("I3_affordability_index")
def i3(ctx):
    plans = GD.dim_plan(ctx.t("plan_info")).select("plan_key", "premium", "deductible")
    costed = GD.cost_metrics(ctx.t("beneficiary_cost")).join(plans, "plan_key", "left")
    return ml.affordability_index(costed).select("plan_key", "affordability_index", "affordability_class")


@q("I4_affordability_terciles")
def i4(ctx):
    return _labels(ctx).select("plan_key", "affordability_index", "affordability_class")


@q("I7_suitability_classifier")
def i7(ctx):
    _, pred, f1, acc = ml.label_classifier(_labels(ctx))
    return pred.agg(F.count(F.lit(1)).alias("test_rows")).select(
        "test_rows", F.lit(f1).alias("f1"), F.lit(acc).alias("accuracy"))


def _split_labels(pairs):
    """Labelled pairs: a fifth of the beneficiaries is for testing, an eighth of the others decides when to stop."""
    lab = I.group_split(I.relevance_labels(I.ranking_matrix(pairs)))
    held = stable_fraction(F.concat(F.lit("stop|"), "bene_synth_id"), 42) < 0.125
    return lab.withColumn("split", F.when((F.col("split") == "train") & held, "stop").otherwise(F.col("split")))


def _labeled(ctx):
    key = "_labeled_pairs"
    if key not in ctx.__dict__:
        ctx.__dict__[key] = shared_table(_split_labels(ctx.training_pairs), "labeled")
    return ctx.__dict__[key]


def _lambdamart(ctx):
    key = "_lambdamart"
    if key not in ctx.__dict__:
        if "_labeled_pairs" in ctx.__dict__:
            lab = _labeled(ctx)
        else:  # alone, it stores what it reads
            lab = shared_table(_split_labels(ctx.pairs_once).select("bene_synth_id", "plan_key", "relevance_label", "split", *I.RANK_FEATURES), "ranked")
        ctx.__dict__[key] = LM.fit(lab.where("split <> 'test'"), I.RANK_FEATURES, F.col("split") == "stop")
    return ctx.__dict__[key]


def _ranked(ctx):
    key = "_ranked_models"
    if key not in ctx.__dict__:
        lab = _labeled(ctx)
        lr_m, gbt_m = ml.fit_rankers(lab.where(F.col("split") == "train"))
        ctx.__dict__[key] = LM.score(ml.score_pairs(lab, lr_m, gbt_m), _lambdamart(ctx))
    return ctx.__dict__[key]


@q("I11_ranker_ndcg")
def i11(ctx):
    scored = _ranked(ctx).where(F.col("split") == "test")
    models = {"pairwise_logistic": "linear_score", "gbt_regressor": "gbt_score", "lambdamart": "lambdamart_score"}
    rows = [I.mean_ndcg(I.ndcg_at_k(scored, c, "relevance_label")).withColumn("model", F.lit(m)) for m, c in models.items()]
    return reduce(lambda x, y: x.unionByName(y), rows)


@q("I11_ranker_importances")
def i11_importances(ctx):
    return LM.importances(ctx.spark, _lambdamart(ctx))


@q("I11_lambda_gradients")
def i11_gradients(ctx):
    """Gradients of the first tree: all scores equal, so lists are in plan order."""
    # the labels of one pass over the pairs, unless they are stored: dealt by beneficiary, they need no exchange
    labels = _labeled(ctx) if "_labeled_pairs" in ctx.__dict__ else I.relevance_labels(I.ranking_matrix(ctx.pairs_once))
    return LM.list_gradients(labels.withColumn("score", F.lit(0.0)), "score")


@q("I13_batch_scores")
def i13(ctx):
    return _ranked(ctx).select("bene_synth_id", "plan_key", "split", "linear_score", "gbt_score", "lambdamart_score")


@q("I14_data_fingerprint")
def i14(ctx):
    a = ml.table_fingerprint(ctx.t("plan_info"), "plan_info", ["plan_key", "county_code", "formulary_id"])
    b = ml.table_fingerprint(ctx.t("formulary"), "formulary", ["formulary_id", "ndc", "rxcui"])
    c = ml.table_fingerprint(ctx.t("prescriptions"), "prescriptions", ["bene_synth_id", "ndc", "fills_per_year"])
    return a.unionByName(b).unionByName(c)


@q("I14_table_fingerprints")
def i14_whole(ctx):
    """All source tables: each column, and the rows as a whole."""
    sums = {"beneficiary": {"total_rx_cost_est": 6}}  # added up by the view, in any order
    tables = {name: ctx.t(name) for name in view_names() if not name.startswith("_")}
    return fingerprint.fingerprints(fingerprint.states(tables, sums))
