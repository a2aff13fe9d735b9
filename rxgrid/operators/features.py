"""Ranking features, relevance labels, group split and NDCG."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxgrid.config import MAX_RELEVANCE_LABEL
from rxgrid.functions.draws import stable_fraction

RANK_FEATURES = [
    "premium", "deductible", "is_ma_pd", "is_pdp", "num_drugs", "is_insulin_user", "avg_fills_per_year",
    "formulary_generic_pct", "formulary_specialty_pct", "formulary_pa_rate", "formulary_st_rate",
    "formulary_ql_rate", "formulary_restrictiveness", "network_preferred_pharmacies", "network_total_pharmacies",
    "network_adequacy_flag", "distance_miles", "has_distance_tradeoff", "total_drug_oop",
    "annual_premium", "cost_per_drug", "premium_to_oop_ratio",
]


def ranking_matrix(pairs: DataFrame) -> DataFrame:
    """I8: 19 pair features + annual premium, cost per drug and premium-to-OOP ratio; pairs
    without a premium or OOP are left out."""
    p = pairs.where(F.col("plan_premium").isNotNull() & F.col("estimated_annual_oop").isNotNull())
    oop = F.col("estimated_annual_oop").cast("double")
    x = p.select(
        "bene_synth_id",
        "plan_key",
        F.col("plan_premium").cast("double").alias("premium"),
        F.col("plan_deductible").cast("double").alias("deductible"),
        F.when(F.col("contract_type") == "MA", 1).otherwise(0).alias("is_ma_pd"),
        F.when(F.col("contract_type") == "PDP", 1).otherwise(0).alias("is_pdp"),
        F.col("unique_drugs").cast("int").alias("num_drugs"),
        F.col("bene_insulin_user").cast("int").alias("is_insulin_user"),
        F.col("fills_target").cast("double").alias("avg_fills_per_year"),
        F.coalesce(F.col("formulary_generic_pct").cast("double"), F.lit(0.0)).alias("formulary_generic_pct"),
        F.coalesce(F.col("formulary_specialty_pct").cast("double"), F.lit(0.0)).alias("formulary_specialty_pct"),
        F.coalesce(F.col("formulary_pa_rate").cast("double"), F.lit(0.0)).alias("formulary_pa_rate"),
        F.coalesce(F.col("formulary_st_rate").cast("double"), F.lit(0.0)).alias("formulary_st_rate"),
        F.coalesce(F.col("formulary_ql_rate").cast("double"), F.lit(0.0)).alias("formulary_ql_rate"),
        F.col("formulary_restrictiveness").cast("int").alias("formulary_restrictiveness"),
        F.coalesce(F.col("network_preferred_pharmacies"), F.lit(0)).cast("int").alias("network_preferred_pharmacies"),
        F.coalesce(F.col("network_total_pharmacies"), F.lit(0)).cast("int").alias("network_total_pharmacies"),
        F.coalesce(F.col("network_adequacy_flag"), F.lit(0)).cast("int").alias("network_adequacy_flag"),
        F.coalesce(F.col("distance_miles").cast("double"), F.lit(10.0)).alias("distance_miles"),
        "distance_category",
        F.col("has_distance_tradeoff").cast("int").alias("has_distance_tradeoff"),
        oop.alias("total_drug_oop"),
        F.coalesce(F.col("total_annual_cost"), F.col("plan_premium") * 12 + oop).cast("double").alias("total_annual_cost"),
        F.coalesce(
            F.col("ranking_cost_objective"), F.col("total_cost_with_distance"),
            F.col("plan_premium") * 12 + oop + F.coalesce(F.col("distance_penalty"), F.lit(0.0)),
        ).cast("double").alias("ranking_cost_objective"),
    )
    return x.withColumns(
        {
            "annual_premium": F.col("premium") * 12,
            "cost_per_drug": F.col("total_drug_oop") / F.greatest(F.col("num_drugs"), F.lit(1)),
            "premium_to_oop_ratio": (F.col("premium") * 12) / F.greatest(F.col("total_drug_oop"), F.lit(1.0)),
        }
    )


def relevance_labels(df: DataFrame, cost_col: str = "ranking_cost_objective", group: str = "bene_synth_id",
                     max_label: int = MAX_RELEVANCE_LABEL, out_col: str = "relevance_label") -> DataFrame:
    """Inverted dense rank of cost within the group, rescaled to at most ``max_label``
    with half-even rounding.  Costs are compared at 6 decimals so the label does not
    depend on floating summation order."""
    cost = F.col(cost_col).cast("decimal(24,6)")
    w = Window.partitionBy(group).orderBy(cost)
    d = df.withColumn("_l", F.dense_rank().over(w) - 1)
    d = d.withColumn("_m", F.max("_l").over(Window.partitionBy(group)))
    inv = (F.col("_m") - F.col("_l")).cast("double")
    scaled = F.when(F.col("_m") > max_label, F.bround(inv * max_label / F.col("_m"), 0)).otherwise(inv)
    label = F.least(F.greatest(scaled, F.lit(0.0)), F.lit(float(max_label))).cast("int")
    return d.withColumn(out_col, label).drop("_l", "_m")


def group_split(df: DataFrame, group: str = "bene_synth_id", test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Keyed group split - a whole group goes to test when its F1 draw is below the
    test fraction, so no group straddles the split and the split never depends on
    partitioning."""
    return df.withColumn(
        "split", F.when(stable_fraction(F.col(group).cast("string"), seed) < test_fraction, "test").otherwise("train")
    )


def split_overlap(split_df: DataFrame, group: str = "bene_synth_id") -> DataFrame:
    """I10 check: groups found on both sides (must be empty) and group sizes per side."""
    return split_df.groupBy(group).agg(
        F.count_distinct("split").alias("n_sides"), F.count(F.lit(1)).alias("group_size")
    )


def ndcg_at_k(df: DataFrame, score_col: str, label_col: str, ks=(3, 5, 10), group: str = "bene_synth_id",
              tie_col: str = "plan_key") -> DataFrame:
    """Per-group NDCG@k with gain (2^l - 1) / log2(1 + position); the ideal ordering
    sorts by label.  Ties in score are broken by ``tie_col``."""
    gain = (F.pow(F.lit(2.0), F.col(label_col)) - 1) / F.log2(F.col("_pos") + 1)
    ideal_gain = (F.pow(F.lit(2.0), F.col(label_col)) - 1) / F.log2(F.col("_ipos") + 1)
    d = df.withColumn(
        "_pos", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score_col).desc(), F.col(tie_col)))
    ).withColumn(
        "_ipos", F.row_number().over(Window.partitionBy(group).orderBy(F.col(label_col).desc(), F.col(tie_col)))
    )
    aggs = []
    for k in ks:
        dcg = F.sum(F.when(F.col("_pos") <= k, gain).otherwise(0.0))
        idcg = F.sum(F.when(F.col("_ipos") <= k, ideal_gain).otherwise(0.0))
        aggs.append(F.when(idcg > 0, dcg / idcg).otherwise(1.0).alias(f"ndcg_at_{k}"))
    return d.groupBy(group).agg(*aggs)


def mean_ndcg(per_group: DataFrame, ks=(3, 5, 10)) -> DataFrame:
    return per_group.agg(*[F.avg(f"ndcg_at_{k}").alias(f"ndcg_at_{k}") for k in ks],
                         F.count(F.lit(1)).alias("n_groups"))


def zscore(df: DataFrame, cols: list[str], suffix: str = "_z", sample: bool = True) -> DataFrame:
    """Z-score columns from one aggregate (sample or population std); 0 when std is 0 or null."""
    std = F.stddev_samp if sample else F.stddev_pop
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[std(c).alias(f"_s_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(stats))  # one row of statistics
    out = {}
    for c in cols:
        s = F.col(f"_s_{c}")
        out[f"{c}{suffix}"] = F.when(s.isNull() | (s == 0), F.lit(0.0)).otherwise((F.col(c) - F.col(f"_m_{c}")) / s)
    return j.withColumns(out).drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)
