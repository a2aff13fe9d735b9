"""Gold aggregates: plan formulary, network, cost, pricing and insulin metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxgrid.functions.joins import broadcast_if_small
from rxgrid.functions.stats import exact_quantiles, ntile
from rxgrid.operators import bronze


def round_half_up(c: Column | str, scale: int = 2) -> Column:
    """ROUND through a decimal so half-way cases round the same in every engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("decimal(24,6)"), scale).cast("double")


def pct(num: Column, den: Column) -> Column:
    """100 * num / nullif(den, 0), in double."""
    return F.lit(100.0) * num.cast("double") / F.nullif(den, F.lit(0)).cast("double")


def active_plans(plan_info: DataFrame) -> DataFrame:
    """Plan rows that are not suppressed."""
    return plan_info.where(F.col("plan_suppressed_yn").isNull() | (F.col("plan_suppressed_yn") != "Y"))


# ---------------------------------------------------------------------------
# D1 plan formulary metrics


def _insulin_match(formulary: DataFrame, insulin_ref: DataFrame) -> DataFrame:
    """Per formulary row: how many reference rows the OR-join ``ndc = ndc OR rxcui = rxcui``
    matches (``_w``, at least 1 for the unmatched row) and which insulin id it contributes.

    The OR condition becomes three equi-joins against small aggregates of the
    reference (by ndc, by rxcui, by both) so no nested-loop join is planned and
    the fan-out never materialises: |A u B| = |A| + |B| - |A n B|.
    """
    ir = insulin_ref.select(F.col("ndc").alias("ir_ndc"), F.col("rxcui").alias("ir_rxcui"))
    by_ndc = ir.where(F.col("ir_ndc").isNotNull()).groupBy("ir_ndc").agg(F.count(F.lit(1)).alias("_c_ndc"))
    by_rx = (
        ir.where(F.col("ir_rxcui").isNotNull())
        .groupBy("ir_rxcui")
        .agg(
            F.count(F.lit(1)).alias("_c_rx"),
            F.count(F.when(F.col("ir_ndc").isNull(), 1)).alias("_c_rx_nondc"),
        )
    )
    by_both = (
        ir.where(F.col("ir_ndc").isNotNull() & F.col("ir_rxcui").isNotNull())
        .groupBy("ir_ndc", "ir_rxcui")
        .agg(F.count(F.lit(1)).alias("_c_both"))
    )
    f = formulary
    f = f.join(broadcast_if_small(by_ndc), f["ndc"] == by_ndc["ir_ndc"], "left").drop("ir_ndc")
    f = f.join(broadcast_if_small(by_rx), f["rxcui"] == by_rx["ir_rxcui"], "left").drop("ir_rxcui")
    f = f.join(
        broadcast_if_small(by_both),
        (f["ndc"] == by_both["ir_ndc"]) & (f["rxcui"] == by_both["ir_rxcui"]),
        "left",
    ).drop("ir_ndc", "ir_rxcui")
    c_ndc = F.coalesce("_c_ndc", F.lit(0))
    c_rx = F.coalesce("_c_rx", F.lit(0))
    c_rx_nondc = F.coalesce("_c_rx_nondc", F.lit(0))
    c_both = F.coalesce("_c_both", F.lit(0))
    m = c_ndc + c_rx - c_both
    return f.withColumns(
        {
            "_w": F.greatest(m, F.lit(1)).cast("double"),
            # a matched reference row with an ndc contributes the formulary ndc
            "_ins_ndc": F.when((c_ndc > 0) | (c_rx - c_rx_nondc > 0), F.col("ndc")),
            # a matched rxcui-only reference row contributes the formulary rxcui
            "_ins_rx": F.when((c_rx_nondc > 0) & F.col("rxcui").isNotNull(), F.col("rxcui")),
        }
    ).drop("_c_ndc", "_c_rx", "_c_rx_nondc", "_c_both")


def _formulary_sums() -> list[Column]:
    """Additive parts of D1 over weighted formulary rows."""
    w = F.col("_w")
    t = F.col("tier_level_value")
    yes = lambda c: F.when(F.upper(F.col(c)) == "Y", 1.0).otherwise(0.0)
    return [
        F.count_distinct("ndc").alias("total_drugs"),
        F.sum(F.when(t.isNotNull(), w * t)).alias("_tier_sum"),
        F.sum(F.when(t.isNotNull(), w)).alias("_tier_w"),
        F.sum(F.when(t <= 2, w).otherwise(0.0)).alias("generic_tier_count"),
        F.sum(F.when((t >= 3) & (t < 5), w).otherwise(0.0)).alias("brand_tier_count"),
        F.sum(F.when(t >= 5, w).otherwise(0.0)).alias("specialty_tier_count"),
        F.sum(w * yes("prior_authorization_yn")).alias("_pa"),
        F.sum(w * yes("step_therapy_yn")).alias("_st"),
        F.sum(w * yes("quantity_limit_yn")).alias("_ql"),
        F.sum(w * (yes("prior_authorization_yn") + yes("step_therapy_yn") + yes("quantity_limit_yn"))).alias("_rc"),
        F.sum(w).alias("_rows"),
        # NDC (11 digits) and RXCUI texts never coincide, so the distinct union
        # is the sum of the two distinct counts
        (F.count_distinct("_ins_ndc") + F.count_distinct("_ins_rx")).alias("insulin_drug_count"),
    ]


def formulary_metrics(plan_info: DataFrame, formulary: DataFrame, insulin_ref: DataFrame) -> DataFrame:
    """Per-plan formulary metrics with a tercile restrictiveness class.

    Aggregates once per formulary (hundreds) instead of once per plan
    (thousands) and joins the result to the plans.  Plans that carry more
    than one formulary id (none in CMS files, but possible) are aggregated
    from the formulary rows directly so distinct counts stay exact.
    """
    pf = (
        active_plans(plan_info)
        .where(F.col("formulary_id").isNotNull())
        .select("plan_key", "formulary_id")
        .distinct()
    )
    n_form = pf.groupBy("plan_key").agg(F.count(F.lit(1)).alias("_nf"))
    pf = pf.join(n_form, "plan_key")
    rows = _insulin_match(
        formulary.select("formulary_id", "ndc", "rxcui", "tier_level_value", "prior_authorization_yn",
                         "step_therapy_yn", "quantity_limit_yn"),
        insulin_ref,
    )
    per_form = rows.groupBy("formulary_id").agg(*_formulary_sums())
    single = (
        pf.where(F.col("_nf") == 1)
        .join(per_form, "formulary_id")
        .drop("formulary_id", "_nf")
    )
    multi_plans = pf.where(F.col("_nf") > 1).select("plan_key", "formulary_id")
    stats = single
    if multi_plans.limit(1).count() > 0:  # plan-grain check; CMS plans carry one formulary
        multi = multi_plans.join(rows, "formulary_id").groupBy("plan_key").agg(*_formulary_sums())
        stats = single.unionByName(multi)

    total = F.col("total_drugs")
    out = stats.select(
        "plan_key",
        total.alias("total_drugs"),
        round_half_up(F.least(F.lit(100.0), total / 20.0)).alias("formulary_breadth_pct"),
        F.col("generic_tier_count").cast("long").alias("generic_tier_count"),
        F.col("brand_tier_count").cast("long").alias("brand_tier_count"),
        F.col("specialty_tier_count").cast("long").alias("specialty_tier_count"),
        round_half_up(pct(F.col("generic_tier_count"), total)).alias("generic_tier_pct"),
        round_half_up(pct(F.col("specialty_tier_count"), total)).alias("specialty_tier_pct"),
        round_half_up(F.col("_tier_sum") / F.col("_tier_w")).alias("avg_tier"),
        round_half_up(pct(F.col("_pa"), F.col("_rows"))).alias("pa_rate"),
        round_half_up(pct(F.col("_st"), F.col("_rows"))).alias("st_rate"),
        round_half_up(pct(F.col("_ql"), F.col("_rows"))).alias("ql_rate"),
        round_half_up(F.col("_rc") / F.col("_rows")).alias("avg_restriction_count"),
        F.col("insulin_drug_count"),
        round_half_up(pct(F.col("insulin_drug_count"), total)).alias("insulin_coverage_pct"),
    )
    # NTILE(3) over the restriction average, plan_key breaking ties (T4)
    out = ntile(out, 3, "avg_restriction_count", "plan_key", out_col="_tile")
    return out.withColumn("restrictiveness_class", F.col("_tile") - 1).drop("_tile")


# ---------------------------------------------------------------------------
# D2 plan network metrics


def network_metrics(pharmacy_network: DataFrame) -> DataFrame:
    """Per-plan network size, preferred counts and shares, adequacy, fees."""
    n = bronze.network(pharmacy_network)
    pref_any = F.col("is_preferred_retail") | F.col("is_preferred_mail")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    agg = n.groupBy("plan_key").agg(
        F.count_distinct("pharmacy_number").alias("total_pharmacies"),
        one(F.col("is_preferred_retail")).alias("preferred_pharmacies_retail"),
        one(F.col("is_preferred_mail")).alias("preferred_pharmacies_mail"),
        one(pref_any).alias("preferred_pharmacies"),
        one(F.col("offers_retail")).alias("retail_pharmacies"),
        one(F.col("offers_mail")).alias("mail_pharmacies"),
        one(F.col("is_in_area")).alias("in_area_pharmacies"),
        F.max(F.when(F.col("offers_mail"), 1).otherwise(0)).alias("mail_order_available"),
        F.avg("avg_brand_fee").alias("avg_brand_dispensing_fee"),
        F.avg("avg_generic_fee").alias("avg_generic_dispensing_fee"),
        F.avg(F.col("floor_price").cast("double")).alias("avg_floor_price"),
    )
    return agg.select(
        "plan_key",
        "total_pharmacies",
        "preferred_pharmacies_retail",
        "preferred_pharmacies_mail",
        "preferred_pharmacies",
        round_half_up(pct(F.col("preferred_pharmacies"), F.col("total_pharmacies"))).alias("pref_pharmacy_pct"),
        "retail_pharmacies",
        "mail_pharmacies",
        "in_area_pharmacies",
        round_half_up(pct(F.col("in_area_pharmacies"), F.col("total_pharmacies"))).alias("in_area_pct"),
        F.when(F.col("preferred_pharmacies") < 10, 1).otherwise(0).alias("network_adequacy_flag"),
        "mail_order_available",
        "avg_brand_dispensing_fee",
        "avg_generic_dispensing_fee",
        "avg_floor_price",
    )


__all__ = ["formulary_metrics", "network_metrics", "round_half_up", "pct", "active_plans", "exact_quantiles"]
