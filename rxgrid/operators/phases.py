"""Documented per-fill cost logic (N1-N8): negotiated price, channel rules, insulin
override, annual deductible -> initial -> catastrophic progression, LIS caps.

The annual progression is a closed form over running sums inside one window
partitioned by (beneficiary, plan) and ordered by fill date - no per-fill loop:

* S_i = cumulative deductible-eligible price; deductible used by fill i is
  min(S_i, D) - min(S_{i-1}, D);
* the initial-phase share of fill i is computed on the price left after it;
* C_i = cumulative (deductible part + initial share); the member pays
  min(C_i, cap) - min(C_{i-1}, cap).  Deductible dollars count toward the cap,
  as in the documented worked case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# 2025 annual out-of-pocket cap and full-LIS per-fill copay caps.
OOP_CAP = 2000.0
LIS_GENERIC_CAP = 4.90
LIS_BRAND_CAP = 12.15


def negotiated_price(unit_cost: Column, qty: Column, fee: Column, floor: Column) -> Column:
    """max(unit cost x quantity + dispensing fee, floor price)."""
    calc = unit_cost * qty + F.coalesce(fee, F.lit(0.0))
    return F.greatest(calc, F.coalesce(floor, F.lit(0.0)))


def dispensing_fee(is_brand: Column, days: Column, prefix: str = "") -> Column:
    """Brand / generic fee for 30, 60 or 90 days."""
    def fee(kind: str, d: int) -> Column:
        return F.col(f"{prefix}{kind}_dispensing_fee_{d}").cast("double")
    g = F.when(days >= 75, fee("generic", 90)).when(days >= 45, fee("generic", 60)).otherwise(fee("generic", 30))
    b = F.when(days >= 75, fee("brand", 90)).when(days >= 45, fee("brand", 60)).otherwise(fee("brand", 30))
    return F.when(is_brand, b).otherwise(g)


def channel_cost(price: Column, cost_type: Column, amount: Column, min_amt: Column | None = None,
                 max_amt: Column | None = None) -> Column:
    """Copay (dollars) or coinsurance (fraction; > 1 read as percent) on the negotiated
    price, clamped to [min, max] when given, never above the price; null when the
    channel is not offered (type 0)."""
    rate = F.when(amount > 1.0, amount / 100.0).otherwise(amount)
    raw = F.when(cost_type == 1, amount).when(cost_type == 2, price * rate)
    if min_amt is not None:
        raw = F.when(min_amt.isNotNull(), F.greatest(raw, min_amt)).otherwise(raw)
    if max_amt is not None:
        raw = F.when(max_amt.isNotNull(), F.least(raw, max_amt)).otherwise(raw)
    return F.least(raw, price)


def insulin_cost(price: Column, copay: Column) -> Column:
    """Covered insulin pays the lesser of its copay and the price; deductible exempt."""
    return F.least(copay, price)


def annual_progression(fills: DataFrame, keys: list[str], order: list[str], deductible: str = "deductible",
                       cap: float = OOP_CAP, prior_paid: str | None = None) -> DataFrame:
    """Per fill ``ded_used``, ``initial_share``, ``member_paid`` and ``oop_to_date``.

    Expects per fill: ``price``, ``ded_applies`` (0/1; 0 for insulin, which is
    deductible exempt), ``is_insulin`` with ``insulin_copay``, and the initial
    coverage rule ``cost_type`` / ``cost_amt`` applied to the price left after the
    deductible.  ``prior_paid`` optionally names a column of OOP already paid this year."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    D = F.coalesce(F.col(deductible).cast("double"), F.lit(0.0))
    elig = F.when(F.col("ded_applies") == 1, F.col("price")).otherwise(0.0)
    d = fills.withColumn("_elig", elig).withColumn("_S", F.sum("_elig").over(w))
    d = d.withColumn("ded_used", F.least(F.col("_S"), D) - F.least(F.col("_S") - F.col("_elig"), D))
    left = F.col("price") - F.col("ded_used")
    ins = F.col("insulin_copay")
    init = F.when(F.col("is_insulin") == 1, F.least(F.coalesce(ins, left), left)).otherwise(
        F.coalesce(channel_cost(left, F.col("cost_type"), F.col("cost_amt")), left))
    d = d.withColumn("initial_share", F.when(left > 0, init).otherwise(0.0))
    d = d.withColumn("_part", F.col("ded_used") + F.col("initial_share"))
    base = F.coalesce(F.col(prior_paid), F.lit(0.0)) if prior_paid else F.lit(0.0)
    d = d.withColumn("_C", base + F.sum("_part").over(w))
    capped = F.least(F.col("_C"), F.lit(cap)) - F.least(F.col("_C") - F.col("_part"), F.lit(cap))
    return d.withColumn("member_paid", F.greatest(capped, F.lit(0.0))).withColumn(
        "oop_to_date", F.least(F.col("_C"), F.lit(cap))).drop("_elig", "_S", "_part", "_C")


def best_channel(options: DataFrame, keys: list[str], allowed: str = "auto") -> DataFrame:
    """The cheapest offered channel per fill among the allowed ones (auto / retail / mail)."""
    o = options.where(F.col("channel_cost").isNotNull())
    if allowed == "retail":
        o = o.where(F.col("channel").isin("pref", "nonpref"))
    elif allowed == "mail":
        o = o.where(F.col("channel").isin("mail_pref", "mail_nonpref"))
    return o.groupBy(*keys).agg(
        F.min_by("channel", F.struct("channel_cost", "channel")).alias("best_channel"),
        F.min("channel_cost").alias("best_channel_cost"),
    )


def lis_cap(paid: Column, is_brand: Column) -> Column:
    """Full-LIS per-fill cap ($4.90 generic, $12.15 brand)."""
    return F.least(paid, F.when(is_brand, F.lit(LIS_BRAND_CAP)).otherwise(F.lit(LIS_GENERIC_CAP)))


def rank_by_rules(pairs: DataFrame) -> DataFrame:
    """Plans per beneficiary - full coverage first, then annual cost, uncovered drugs,
    network risk, plan key."""
    w = Window.partitionBy("bene_synth_id").orderBy(
        F.when(F.col("uncovered_drug_count") == 0, 0).otherwise(1), F.col("total_annual_cost").asc_nulls_last(),
        F.col("uncovered_drug_count"), F.col("network_adequacy_flag"), F.col("plan_key"))
    return pairs.withColumn("rule_rank", F.row_number().over(w))


def claim_defaults(claims: DataFrame) -> DataFrame:
    """Default quantity per fill, fills per beneficiary-year and typical days supply per drug."""
    per_bene = claims.groupBy("prod_srvc_id", "bene_id", F.year("srvc_dt").alias("yr")).agg(
        F.count(F.lit(1)).alias("_fills"))
    f = per_bene.groupBy("prod_srvc_id").agg(F.avg("_fills").alias("avg_fills_per_bene_year"))
    q = claims.groupBy("prod_srvc_id").agg(
        F.avg("qty_dspnsd_num").alias("avg_qty_per_fill"),
        F.mode("days_suply_num", deterministic=True).alias("typical_days_supply"),
        F.count(F.lit(1)).alias("claims"),
    )
    return q.join(f, "prod_srvc_id")
