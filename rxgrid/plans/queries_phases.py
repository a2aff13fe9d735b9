"""Registered per-fill cost logic queries (N1-N8) over the claim events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rxgrid.functions.columns import days_supply_code
from rxgrid.functions.joins import broadcast_if_small
from rxgrid.operators import costmodel as G
from rxgrid.operators import phases as N
from rxgrid.operators.ranking import top_plans
from rxgrid.plans.registry import q

CHANNELS = ("pref", "nonpref", "mail_pref", "mail_nonpref")


def fills_under_top_plan(ctx):
    """Each claim of a beneficiary priced under its top-ranked plan (H1 rank 1)."""
    key = "_fills"
    if key in ctx.__dict__:
        return ctx.__dict__[key]
    top = top_plans(ctx.training_pairs, 1).select("bene_synth_id", "plan_key", "plan_deductible")
    pi = ctx.t("plan_info").select("plan_key", "formulary_id").distinct()
    claims = ctx.t("pde_events").select(
        F.col("bene_id").alias("bene_synth_id"), F.col("prod_srvc_id").alias("ndc"), "srvc_dt", "claim_id",
        F.col("days_suply_num").alias("days"), F.col("qty_dspnsd_num").alias("qty"),
        (F.col("brnd_gnrc_cd") == "B").alias("is_brand"))
    f = claims.join(top, "bene_synth_id").join(broadcast_if_small(pi), "plan_key")
    f = f.withColumn("days_supply_code", days_supply_code(F.col("days")))
    price = ctx.t("pricing").groupBy("plan_key", "ndc", "days_supply_code").agg(F.avg("unit_cost").alias("unit_cost"))
    f = f.join(price, ["plan_key", "ndc", "days_supply_code"], "left")
    net = ctx.t("pharmacy_network").where(F.upper("preferred_status_retail") == "Y")
    w = Window.partitionBy("plan_key").orderBy("pharmacy_number")
    rep = net.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(
        "plan_key", "floor_price", *[f"{k}_dispensing_fee_{d}" for k in ("brand", "generic") for d in (30, 60, 90)])
    f = f.join(broadcast_if_small(rep), "plan_key", "left")
    fm = G.formulary_map(ctx.t("formulary"))
    f = f.join(fm, ["formulary_id", "ndc"], "left").withColumn("tier", F.coalesce("formulary_tier", F.lit(1)))
    bc = ctx.t("beneficiary_cost").where(F.col("coverage_level") == 1).select(
        "plan_key", F.col("tier").cast("int").alias("tier"), F.col("days_supply").alias("days_supply_code"),
        *[F.col(f"cost_type_{c}").cast("int").alias(f"t_{c}") for c in CHANNELS],
        *[F.col(f"cost_amt_{c}").alias(f"a_{c}") for c in CHANNELS],
        F.when(F.col("ded_applies_yn") == "Y", 1).otherwise(0).alias("_ded"))
    f = f.join(broadcast_if_small(bc), ["plan_key", "tier", "days_supply_code"], "left")
    ir = G.insulin_rules(ctx.t("insulin_cost")).where(F.col("tier").isNull()).select(
        "plan_key", "days_supply_code", F.col("pref_insulin_copay").alias("insulin_copay"))
    f = f.join(broadcast_if_small(ir), ["plan_key", "days_supply_code"], "left")
    ins = ctx.t("insulin_ref").where(F.col("ndc").isNotNull()).select("ndc").distinct().withColumn("is_insulin", F.lit(1))
    f = f.join(broadcast_if_small(ins), "ndc", "left")
    f = f.withColumns({
        "is_insulin": F.coalesce(F.col("is_insulin"), F.lit(0)),
        "fee": N.dispensing_fee(F.col("is_brand"), F.col("days")),
    })
    f = f.withColumn("price", N.negotiated_price(F.coalesce(F.col("unit_cost"), F.lit(0.0)), F.col("qty"),
                                                   F.col("fee"), F.col("floor_price").cast("double")))
    f = f.withColumns({
        "cost_type": F.coalesce(F.col("t_pref"), F.lit(0)), "cost_amt": F.coalesce(F.col("a_pref"), F.lit(0.0)),
        "ded_applies": F.when(F.col("is_insulin") == 1, 0).otherwise(F.coalesce(F.col("_ded"), F.lit(0))),
    })
    ctx.__dict__[key] = f
    return f


@q("N1_negotiated_price")
def n1(ctx):
    f = fills_under_top_plan(ctx)
    return f.select("claim_id", "plan_key", "unit_cost", "fee", "price",
                    N.channel_cost(F.col("price"), F.col("cost_type"), F.col("cost_amt")).alias("pref_channel_cost"),
                    N.insulin_cost(F.col("price"), F.col("insulin_copay")).alias("insulin_member_cost"))


@q("N4_annual_progression")
def n4(ctx):
    f = fills_under_top_plan(ctx)
    # claim ids can repeat in the source, so the drug and price complete the fill order
    a = N.annual_progression(f, ["bene_synth_id", "plan_key"], ["srvc_dt", "claim_id", "ndc", "price"],
                             deductible="plan_deductible")
    return a.select("claim_id", "bene_synth_id", "plan_key", "price", "ded_used", "initial_share", "member_paid",
                    "oop_to_date")


@q("N5_best_channel")
def n5(ctx):
    f = fills_under_top_plan(ctx)
    opts = f.select("claim_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("channel"),
                 N.channel_cost(F.col("price"), F.col(f"t_{c}"), F.col(f"a_{c}")).alias("channel_cost"))
        for c in CHANNELS])).alias("_o")).select("claim_id", "_o.channel", "_o.channel_cost")
    return N.best_channel(opts, ["claim_id"], "auto")


@q("N6_lis_capped")
def n6(ctx):
    f = fills_under_top_plan(ctx)
    paid = F.coalesce(N.channel_cost(F.col("price"), F.col("cost_type"), F.col("cost_amt")), F.col("price"))
    return f.select("claim_id", N.lis_cap(paid, F.col("is_brand")).alias("lis_member_cost"))


@q("N7_rule_rank")
def n7(ctx):
    return N.rank_by_rules(ctx.training_pairs).select("bene_synth_id", "plan_key", "rule_rank")


@q("N8_claim_defaults")
def n8(ctx):
    return N.claim_defaults(ctx.t("pde_events"))
