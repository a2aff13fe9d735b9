"""Annual out-of-pocket cost model for beneficiary x plan pairs.

Building blocks are small maps keyed like the lookups they serve (formulary,
exclusions, winsorised prices, tier cost rules, insulin rules) and per-row
cost expressions.  ``plans.pairs`` composes them into the pair table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxgrid.config import COST, PRICING, CostPolicy, PricingPolicy
from rxgrid.functions.columns import (
    blank_to_null,
    clean_ndc,
    days_supply_code,
    days_supply_months,
    days_supply_units,
    try_double,
    try_int,
)
from rxgrid.functions.joins import broadcast_fixed
from rxgrid.functions.stats import exact_quantiles

# ---------------------------------------------------------------------------
# G2 - G8 lookup maps


def normalize_prescriptions(prescriptions: DataFrame) -> DataFrame:
    """Cleaned NDC, tier (default 1), fills >= 1, days bucket, units, fallback cost."""
    days = F.coalesce(try_int("days_supply_mode"), F.lit(30))
    return prescriptions.where(F.col("ndc").isNotNull()).select(
        "bene_synth_id",
        clean_ndc("ndc").alias("ndc"),
        blank_to_null("rxcui").alias("rxcui"),
        F.coalesce(try_int("tier_level"), F.lit(1)).alias("rx_tier"),
        F.greatest(F.coalesce(try_double("fills_per_year"), F.lit(1.0)), F.lit(1.0)).alias("fills_per_year"),
        days.alias("days_supply_mode"),
        days_supply_code(days).alias("days_supply_code"),
        days_supply_months(days).alias("days_supply_months"),
        days_supply_units(days).alias("assumed_units_per_fill"),
        F.greatest(F.coalesce(try_double("qty_per_fill"), F.lit(0.0)), F.lit(0.0)).alias("qty_per_fill"),
        F.greatest(F.coalesce(F.col("estimated_annual_drug_cost").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(
            "annual_gross_cost_fallback"
        ),
        F.coalesce(try_int("is_insulin"), F.lit(0)).alias("is_insulin"),
    )


def formulary_map(formulary: DataFrame) -> DataFrame:
    """Per (formulary, ndc) the lowest tier (99 when unknown) and one rxcui (the smallest)."""
    return (
        formulary.where(F.col("ndc").isNotNull())
        .groupBy("formulary_id", clean_ndc("ndc").alias("ndc"))
        .agg(
            F.min(F.coalesce(try_int("tier_level_value"), F.lit(99))).alias("formulary_tier"),
            F.min(blank_to_null("rxcui")).alias("formulary_rxcui"),
        )
    )


def excluded_map(excluded: DataFrame) -> DataFrame:
    """Distinct excluded (formulary, rxcui)."""
    return (
        excluded.where(F.col("formulary_id").isNotNull() & F.col("rxcui").isNotNull())
        .select("formulary_id", blank_to_null("rxcui").alias("rxcui"))
        .distinct()
    )


def pricing_raw(pricing: DataFrame) -> DataFrame:
    code = F.coalesce(
        try_int("days_supply_code") if "days_supply_code" in pricing.columns else F.lit(None).cast("int"),
        days_supply_code(F.coalesce(try_int("days_supply"), F.lit(30))),
    )
    return pricing.where(F.col("plan_key").isNotNull() & F.col("ndc").isNotNull()).select(
        "plan_key",
        clean_ndc("ndc").alias("ndc"),
        code.alias("days_supply_code"),
        F.greatest(F.coalesce(try_double("unit_cost"), F.lit(0.0)), F.lit(0.0)).alias("unit_cost"),
    )


def pricing_bounds(raw: DataFrame, policy: PricingPolicy = PRICING) -> DataFrame:
    """G5 bounds: exact 1 % / 95 % unit-cost quantiles per days code (range-partitioned, no
    single-task percentile)."""
    return exact_quantiles(
        raw, "unit_cost", {"unit_cost_low": policy.winsor_low_q, "unit_cost_high": policy.winsor_high_q},
        ["days_supply_code"],
    )


# Days codes of the prescriptions, each with a price column of its own.
PRICED_CODES = (1, 2, 4)
# A task of the price map aggregates about this many prices.
PRICES_PER_PARTITION = 500_000


def pricing_map(pricing: DataFrame, policy: PricingPolicy = PRICING) -> DataFrame:
    """G5 + G6: winsorised unit cost per (plan, ndc, days code) pivoted to one row per
    (plan, ndc): ``unit_cost_1/2/4`` for the exact codes the prescriptions use and
    ``unit_cost_any`` = mean over all codes.

    The input is hash-partitioned by (plan, ndc) once; both aggregations and
    the later lookup join reuse that partitioning.
    """
    raw = pricing_raw(pricing)
    bounds = broadcast_fixed(pricing_bounds(raw, policy))  # one row per days code
    u = F.col("unit_cost")
    clamped = raw.join(bounds, "days_supply_code", "left").withColumn(
        "unit_cost",
        F.least(F.greatest(u, F.coalesce(F.col("unit_cost_low"), u)), F.coalesce(F.col("unit_cost_high"), u)),
    )
    # partitions sized by the rows: a task holds a bounded part of the map at any scale
    spark = pricing.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(pricing.count() / PRICES_PER_PARTITION))
    per_code = (
        clamped.repartition(n, "plan_key", "ndc")
        .groupBy("plan_key", "ndc", "days_supply_code")
        .agg(F.avg("unit_cost").alias("unit_cost"))
    )
    c = F.col("days_supply_code")
    return per_code.groupBy("plan_key", "ndc").agg(
        F.max(F.when(c == 1, F.col("unit_cost"))).alias("unit_cost_1"),
        F.max(F.when(c == 2, F.col("unit_cost"))).alias("unit_cost_2"),
        F.max(F.when(c == 4, F.col("unit_cost"))).alias("unit_cost_4"),
        F.avg("unit_cost").alias("unit_cost_any"),
    )


def cost_rules(beneficiary_cost: DataFrame) -> DataFrame:
    """Preferred-retail rule per (plan, tier, days code) in the initial coverage phase."""
    bc = beneficiary_cost.where(
        F.col("plan_key").isNotNull() & (F.coalesce(try_int("coverage_level"), F.lit(1)) == 1)
    )
    ded = F.when(F.coalesce(F.col("deductible_applies").cast("boolean"), F.lit(False)), 1).when(
        F.upper(F.coalesce(F.col("ded_applies_yn").cast("string"), F.lit("N"))) == "Y", 1
    ).otherwise(0)
    ctype = F.coalesce(try_int("cost_type_pref"), F.lit(0))
    amt = F.coalesce(try_double("cost_amt_pref"), F.lit(0.0))
    # one coherent (type, amount) rule per key: the lowest type and its amount
    # (fixed-width buffers keep this a HashAggregate)
    return bc.groupBy(
        "plan_key",
        F.coalesce(try_int("tier"), F.lit(0)).alias("tier"),
        F.coalesce(try_int("days_supply"), F.lit(1)).alias("days_supply_code"),
    ).agg(
        F.min(ctype).alias("cost_type_pref"),
        F.min_by(amt, ctype * F.lit(1e12) + amt).alias("cost_amt_pref"),
        F.max(ded).alias("deductible_applies"),
    )


def insulin_rules(insulin_cost: DataFrame) -> DataFrame:
    """Mean preferred insulin copay per (plan, tier or null, days code)."""
    return (
        insulin_cost.where(F.col("plan_key").isNotNull())
        .groupBy(
            "plan_key",
            try_int("tier").alias("tier"),
            F.coalesce(try_int("days_supply"), F.lit(1)).alias("days_supply_code"),
        )
        .agg(
            F.avg(F.coalesce("copay_amt_pref_insln", "min_insulin_copay", "max_insulin_copay")).alias(
                "pref_insulin_copay"
            )
        )
    )


# ---------------------------------------------------------------------------
# G9 - G13 per pair x drug expressions


def gross_cost_columns(policy: PricingPolicy = PRICING) -> dict[str, Column]:
    """G9 + G10 columns, given exact/any unit costs and prescription fields."""
    code = F.col("days_supply_code")
    exact = F.when(code == 1, F.col("unit_cost_1")).when(code == 2, F.col("unit_cost_2")).when(
        code == 4, F.col("unit_cost_4")
    )
    unit = F.coalesce(exact, F.col("unit_cost_any"))
    units = F.greatest(F.coalesce(F.nullif(F.col("qty_per_fill"), F.lit(0.0)), F.col("assumed_units_per_fill")), F.lit(1.0))
    raw = F.when(
        F.coalesce(unit, F.lit(0.0)) > 0, F.greatest(F.col("fills_per_year") * units * unit, F.lit(0.0))
    )
    fb = F.col("annual_gross_cost_fallback")
    bounded = F.when(
        fb > 0,
        F.least(F.greatest(raw, fb * policy.ratio_min), fb * policy.ratio_max, F.lit(policy.annual_abs_max)),
    ).otherwise(F.least(raw, F.lit(policy.annual_abs_max)))
    gross = F.when(raw.isNull(), fb).otherwise(
        F.greatest(F.lit(policy.blend_weight) * bounded + F.lit(1.0 - policy.blend_weight) * fb, F.lit(0.0))
    )
    return {"units_per_fill": units, "unit_cost_resolved": unit, "annual_pricing_raw": raw, "annual_gross_cost": gross}


def per_fill_cost(policy: CostPolicy = COST) -> Column:
    """Member cost per fill after the deductible."""
    g = F.col("gross_per_fill")
    ins = F.col("insulin_copay_pref")
    ctype = F.coalesce(F.col("cost_type_pref"), F.lit(0))
    amt = F.coalesce(F.col("cost_amt_pref"), F.lit(0.0))
    rate = F.when(amt > 1.0, amt / 100.0).otherwise(amt)
    return (
        F.when(F.col("annual_gross_cost") <= 0, F.lit(0.0))
        .when(F.col("is_covered") == 0, g)
        .when(
            (F.col("is_insulin") == 1) & ins.isNotNull(),
            F.least(g, F.least(ins, F.lit(policy.insulin_cap_per_month) * F.col("days_supply_months"))),
        )
        .when(ctype == 1, F.least(g, F.greatest(amt, F.lit(0.0))))
        .when(ctype == 2, F.least(g, g * rate))
        .otherwise(g)
    )


def annual_cost_columns() -> dict[str, Column]:
    """Annual post-deductible cost, share rate, deductible-eligible gross."""
    fills, pf, gross = F.col("fills_per_year"), F.col("per_fill_post_ded_cost"), F.col("annual_gross_cost")
    return {
        "annual_post_ded_cost": F.greatest(fills * pf, F.lit(0.0)),
        "effective_share_rate": F.when(
            gross > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (fills * pf) / gross))
        ).otherwise(1.0),
        "ded_eligible_gross": F.when(
            (F.col("is_covered") == 1) & (F.col("deductible_applies") == 1), gross
        ).otherwise(0.0),
    }


# ---------------------------------------------------------------------------
# G14 + G15 pair aggregate


def pair_cost_aggregates() -> list[Column]:
    """Sums over a pair's drug rows; the proportional deductible allocation of G14 is folded
    into one pass: sum_i pool * d_i / D * (1 - s_i) = pool / D * sum_i d_i (1 - s_i)."""
    has = F.col("ndc").isNotNull()
    post = F.col("annual_post_ded_cost")
    cov = F.col("is_covered") == 1
    ctype = F.coalesce(F.col("cost_type_pref"), F.lit(0))
    z = F.lit(0.0)
    return [
        F.count(F.when(has, 1)).alias("_n_drugs"),
        F.sum(F.when(has, post)).alias("_post_sum"),
        F.sum(F.when(has, F.col("ded_eligible_gross"))).alias("_ded_total"),
        F.sum(F.when(has, F.col("ded_eligible_gross") * (1.0 - F.coalesce(F.col("effective_share_rate"), F.lit(1.0))))).alias(
            "_ded_weighted"
        ),
        F.sum(F.when(has & cov & (ctype == 1), post).otherwise(z)).alias("oop_copay_component"),
        F.sum(F.when(has & cov & (ctype == 2), post).otherwise(z)).alias("oop_coinsurance_component"),
        F.sum(F.when(has & cov & (F.col("is_insulin") == 1), post).otherwise(z)).alias("oop_insulin_component"),
        F.sum(F.when(has & ~cov, post).otherwise(z)).alias("oop_uncovered_component"),
        F.sum(F.when(has & cov, 1).otherwise(0)).alias("covered_drug_count"),
        F.sum(F.when(has & ~cov, 1).otherwise(0)).alias("uncovered_drug_count"),
    ]


def deductible_component(plan_deductible: Column) -> Column:
    pool = F.least(F.coalesce(plan_deductible, F.lit(0.0)), F.col("_ded_total"))
    return F.when(F.col("_ded_total") > 0, pool * F.col("_ded_weighted") / F.col("_ded_total")).otherwise(0.0)
