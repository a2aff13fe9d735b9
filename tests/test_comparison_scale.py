"""Comparison plans are expanded in partitions sized by them, and not shuffled."""

from pyspark.sql import functions as F

from rxgrid.operators import geo


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if " Exchange " in line]


def test_comparison_plans_meet_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(geo, "PLANS_PER_PARTITION", 2)
    requests = spark.createDataFrame([(f"R{i}", "S1", "00001") for i in range(9)], "request_id string, state string, county_code string")
    nearby = requests.select(F.col("request_id").alias("origin_id"), F.explode(F.array(F.lit("00001"), F.lit("00002"), F.lit("00003"))).alias("county_code"),
                             F.lit("c").alias("county"), "state").withColumn("distance_miles", F.col("county_code").cast("double"))
    plans = spark.createDataFrame([("P1", "S1", "00002"), ("P1", "S1", "00003"), ("P2", "S1", "00003"), ("P3", "S1", "00001")], "plan_key string, state string, county_code string").select(
        "*", F.lit("n").alias("plan_name"), F.lit(1.0).alias("premium"), F.lit("N").alias("plan_suppressed_yn"))
    assert geo.comparison_partitions(nearby, plans) == 18
    out = geo.nearby_comparison_plans(requests, nearby, plans)
    assert not any("plan_key" in x for x in _exchanges(out))
    assert sorted((r.plan_key, r.distance_miles) for r in out.collect()) == [("P1", 2.0)] * 9 + [("P2", 3.0)] * 9
