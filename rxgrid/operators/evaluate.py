"""Research-mode evaluation of rankings (K1-K8): regret, stability, subgroups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxgrid.functions.stats import exact_quantiles
from rxgrid.operators.decision import normalized

G = "bene_synth_id"

# Preference scenarios as (ml, cost, access, coverage) weights.
SCENARIOS = {
    "default_mix": (0.35, 0.30, 0.15, 0.20),
    "cost_focused": (0.20, 0.55, 0.10, 0.15),
    "access_focused": (0.20, 0.25, 0.40, 0.15),
    "coverage_focused": (0.20, 0.20, 0.10, 0.50),
}


def research_frame(pairs: DataFrame, ml_score: Column | None = None) -> DataFrame:
    """Pairs with the columns research mode reads: ML score (default: the negated annual
    cost without distance), heuristic score (J12 on the pair, generic share standing in
    for requested coverage as in the reference), requested-drug coverage and evidence flags."""
    d = pairs.withColumns(
        {
            "ml_score": ml_score if ml_score is not None else -(F.col("plan_premium") * 12 + F.col("estimated_annual_oop")),
            "coverage_pct_requested": F.when(
                F.col("covered_drug_count") + F.col("uncovered_drug_count") > 0,
                100.0 * F.col("covered_drug_count") / (F.col("covered_drug_count") + F.col("uncovered_drug_count")),
            ).otherwise(0.0),
            "has_network_metrics": F.when(F.col("network_total_pharmacies") > 0, 1).otherwise(0),
            "has_formulary_metrics": F.when(F.col("formulary_total_drugs") > 0, 1).otherwise(0),
        }
    ).where(F.col("ranking_cost_objective").isNotNull())
    return d.withColumn(
        "heuristic_score",
        100.0 * (0.55 * normalized("total_cost_with_distance", False, G) + 0.20 * normalized("distance_miles", False, G)
                 + 0.25 * normalized("formulary_generic_pct", True, G)),
    )


def top_choice(df: DataFrame, score_col: str, k: int = 1) -> DataFrame:
    """K1: top-k per beneficiary by score desc, then objective asc, then plan key."""
    w = Window.partitionBy(G).orderBy(F.col(score_col).desc(), F.col("ranking_cost_objective").asc(), F.col("plan_key"))
    return df.withColumn("selection_rank", F.row_number().over(w)).where(F.col("selection_rank") <= k)


def choice_details(df: DataFrame, score_col: str, label: str) -> DataFrame:
    """Top-1 rows with the beneficiary's best cost, the best of the top 3, and the regret."""
    best = df.groupBy(G).agg(F.min("ranking_cost_objective").alias("group_best_cost"))
    top3 = top_choice(df, score_col, 3).groupBy(G).agg(F.min("ranking_cost_objective").alias("top3_best_cost"))
    t1 = top_choice(df, score_col, 1).join(best, G, "left").join(top3, G, "left")
    return t1.withColumns(
        {
            "cost_regret": F.coalesce("ranking_cost_objective", F.lit(0.0)) - F.coalesce("group_best_cost", F.lit(0.0)),
            "top3_regret": F.coalesce("top3_best_cost", F.lit(0.0)) - F.coalesce("group_best_cost", F.lit(0.0)),
            "method": F.lit(label),
        }
    )


def regret_summary(details: DataFrame) -> DataFrame:
    """K2 / K3: per method - beneficiaries, mean / median top-1 regret, mean top-3 regret,
    mean requested coverage, mean distance and the best-plan hit rate."""
    r2 = lambda c: F.round(c.cast("decimal(24,6)"), 2).cast("double")
    # the median is over every beneficiary of a method: an exact range-partitioned
    # quantile, not an in-memory percentile buffer per method
    med = exact_quantiles(details, "cost_regret", {"_med": 0.5}, ["method"])
    agg = details.groupBy("method").agg(
        F.count_distinct(G).alias("beneficiaries"),
        r2(F.avg("cost_regret")).alias("avg_top1_cost_regret"),
        r2(F.avg("top3_regret")).alias("avg_top3_cost_regret"),
        r2(F.avg(F.coalesce("coverage_pct_requested", F.lit(0.0)))).alias("avg_requested_drug_coverage"),
        r2(F.avg(F.coalesce("distance_miles", F.lit(0.0)))).alias("avg_access_burden_miles"),
        r2(F.avg(F.when(F.col("cost_regret") <= 1e-9, 1.0).otherwise(0.0)) * 100.0).alias("best_plan_hit_rate"),
    )
    out = agg.join(F.broadcast(med), "method", "left").withColumn("median_top1_cost_regret", r2(F.col("_med")))
    return out.select("method", "beneficiaries", "avg_top1_cost_regret", "median_top1_cost_regret",
                      "avg_top3_cost_regret", "avg_requested_drug_coverage", "avg_access_burden_miles",
                      "best_plan_hit_rate")


def model_vs_baseline(df: DataFrame) -> DataFrame:
    """K3: details of both methods stacked (ML model, transparent baseline)."""
    return choice_details(df, "ml_score", "ML model").unionByName(
        choice_details(df, "heuristic_score", "Transparent baseline"))


def preference_stability(df: DataFrame) -> DataFrame:
    """K4: share of beneficiaries whose top plan changes under each alternative weighting,
    versus the default mix.  Ranks are 'first' ranks (plan key breaks ties)."""
    def rk(c: str, asc: bool) -> Column:
        o = F.col(c).asc() if asc else F.col(c).desc()
        return F.row_number().over(Window.partitionBy(G).orderBy(o, F.col("plan_key")))

    d = df.withColumns({
        "cost_rank": rk("total_cost_with_distance", True), "access_rank": rk("distance_miles", True),
        "coverage_rank": rk("coverage_pct_requested", False), "ml_rank": rk("ml_score", False),
    })
    for name, (mw, cw, aw, vw) in SCENARIOS.items():
        # weights in hundredths: integer arithmetic keeps equal scores exactly equal, so
        # ties fall to the objective / plan key instead of to floating-point noise
        m, c, a, v = (round(x * 100) for x in (mw, cw, aw, vw))
        d = d.withColumn(f"{name}_score", m * (100 - F.col("ml_rank")) + c * (100 - F.col("cost_rank"))
                         + a * (100 - F.col("access_rank")) + v * (100 - F.col("coverage_rank")))
    # one scenario array exploded: every scenario's top plan comes from the same window pass
    st = d.select(G, "plan_key", "ranking_cost_objective", F.explode(F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.col(f"{n}_score").alias("s")) for n in SCENARIOS])).alias("_x"))
    st = st.select(G, "plan_key", "ranking_cost_objective", "_x.scenario", "_x.s")
    w = Window.partitionBy(G, "scenario").orderBy(F.col("s").desc(), F.col("ranking_cost_objective").asc(), F.col("plan_key"))
    top = st.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    piv = top.groupBy(G).agg(*[F.max(F.when(F.col("scenario") == n, F.col("plan_key"))).alias(n) for n in SCENARIOS])
    rows = [F.struct(F.lit(n).alias("scenario"),
                     F.when(F.coalesce(F.col(n), F.lit("")) != F.coalesce(F.col("default_mix"), F.lit("")), 1.0)
                     .otherwise(0.0).alias("chg")) for n in SCENARIOS if n != "default_mix"]
    ex = piv.select(F.explode(F.array(*rows)).alias("_r")).select("_r.scenario", "_r.chg")
    n_b = piv.count()
    return ex.groupBy("scenario").agg(
        F.lit(n_b).alias("beneficiaries"),
        F.round((F.avg("chg") * 100.0).cast("decimal(24,6)"), 2).cast("double").alias("changed_top_plan_pct"),
    )


def fairness_tables(details: DataFrame) -> DataFrame:
    """K5: per method and subgroup - beneficiaries, mean regret, coverage and distance.
    Subgroups: insulin use, risk segment, density quintile (exact quantile edges, nulls
    at the median) and the 10 largest states and counties; one explode of
    (dimension, value) then one aggregate."""
    d = details
    med = exact_quantiles(d, "bene_density", {"_med": 0.5})
    d = d.crossJoin(F.broadcast(med)).withColumn("_dens", F.coalesce(F.col("bene_density").cast("double"), F.col("_med")))
    edges = exact_quantiles(d, "_dens", {f"_e{i}": i / 5 for i in range(1, 5)})
    d = d.crossJoin(F.broadcast(edges))
    bucket = (F.when(F.col("_dens") <= F.col("_e1"), "Q1").when(F.col("_dens") <= F.col("_e2"), "Q2")
              .when(F.col("_dens") <= F.col("_e3"), "Q3").when(F.col("_dens") <= F.col("_e4"), "Q4").otherwise("Q5"))
    d = d.withColumn("density_bucket", bucket)
    top_states = d.groupBy("bene_state").agg(F.count(F.lit(1)).alias("_c")).orderBy(F.col("_c").desc(), "bene_state").limit(10)
    top_counties = d.groupBy("bene_county").agg(F.count(F.lit(1)).alias("_c")).orderBy(F.col("_c").desc(), "bene_county").limit(10)
    d = d.join(F.broadcast(top_states.select("bene_state", F.lit(1).alias("_ts"))), "bene_state", "left")
    d = d.join(F.broadcast(top_counties.select("bene_county", F.lit(1).alias("_tc"))), "bene_county", "left")
    dims = F.array(
        F.struct(F.lit("insulin").alias("dimension"), F.col("bene_insulin_user").cast("string").alias("value")),
        F.struct(F.lit("risk_segment").alias("dimension"), F.col("risk_segment").cast("string").alias("value")),
        F.struct(F.lit("density").alias("dimension"), F.col("density_bucket").alias("value")),
        F.when(F.col("_ts") == 1, F.struct(F.lit("state").alias("dimension"), F.col("bene_state").alias("value"))),
        F.when(F.col("_tc") == 1, F.struct(F.lit("county").alias("dimension"), F.col("bene_county").alias("value"))),
    )
    x = d.withColumn("_d", F.explode(F.array_compact(dims))).select("method", G, "cost_regret", "coverage_pct_requested",
                                                                     "distance_miles", "_d.dimension", "_d.value")
    return x.groupBy("method", "dimension", "value").agg(
        F.count_distinct(G).alias("beneficiaries"), F.avg("cost_regret").alias("avg_cost_regret"),
        F.avg("coverage_pct_requested").alias("avg_coverage_pct"), F.avg("distance_miles").alias("avg_distance_miles"),
    )


def data_coverage(df: DataFrame) -> DataFrame:
    """K6: (metric, value) evidence-coverage diagnostics from one aggregate and a stack."""
    r2 = lambda c: F.round(c.cast("decimal(24,6)"), 2).cast("double")
    a = df.agg(
        F.count_distinct(G).cast("double").alias("m1"), F.count(F.lit(1)).cast("double").alias("m2"),
        r2(100.0 * F.avg(F.coalesce("has_network_metrics", F.lit(0)))).alias("m3"),
        r2(100.0 * F.avg(F.coalesce("has_formulary_metrics", F.lit(0)))).alias("m4"),
        r2(100.0 * F.avg(F.when(F.col("bene_density").isNotNull(), 1.0).otherwise(0.0))).alias("m5"),
        r2(F.avg(F.coalesce("coverage_pct_requested", F.lit(0.0)))).alias("m6"),
    )
    return a.selectExpr(
        "stack(6, 'Beneficiaries', m1, 'Plan rows', m2, 'Rows with network metrics (%)', m3, "
        "'Rows with formulary metrics (%)', m4, 'Rows with density populated (%)', m5, "
        "'Average requested-drug coverage (%)', m6) AS (metric, value)")


def melt_summary(summary: DataFrame) -> DataFrame:
    """K7: long form of the regret summary for charting."""
    vals = [c for c in summary.columns if c != "method"]
    return summary.select("method", *[F.col(c).cast("double") for c in vals]).unpivot(
        "method", vals, "metric", "value")


def research_states(beneficiary: DataFrame) -> DataFrame:
    """K8: distinct states available for sampling."""
    return beneficiary.where(F.col("state").isNotNull()).select("state").distinct()
