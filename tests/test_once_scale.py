"""Steps that were made several times, or with an exchange in each of many rounds, are made once."""

import random
import re

from pyspark.sql import functions as F

from rxgrid.functions import stats
from rxgrid.operators import decision as J
from rxgrid.plans import queries_extra  # noqa: F401
from rxgrid.plans.registry import QUERIES
from rxgrid.sources import layout


def _quantile(values, q):
    values = sorted(values)
    h = (len(values) - 1) * q
    lo, hi = values[int(h)], values[-int(-h // 1)]
    return lo if lo == hi else lo + (h - int(h)) * (hi - lo)


def test_small_groups_need_no_digit_rounds(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, float("nan"), rng.uniform(-9, 9), 1.0])) for g in ("a", "b", None) for _ in range(90)]
    rows += [("large", rng.uniform(0, 5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, v double")
    fractions = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    held = {}
    for g, v in rows:
        if v is not None and v == v:
            held.setdefault(g, []).append(v)
    want = {g: tuple(_quantile(vs, q) for q in fractions.values()) for g, vs in held.items()}
    by_digit = stats._selected
    met = []

    def selected(rows, *more):
        met.append(sorted(str(r.g) for r in rows.select("g").distinct().collect()))
        return by_digit(rows, *more)

    monkeypatch.setattr(stats, "_selected", selected)
    got = {r.g: (r.p10, r.p50, r.p90) for r in stats.exact_quantiles(df, "v", fractions, ["g"]).collect()}
    assert got == want and not met
    monkeypatch.setattr(stats, "SORTED_ROWS", 100)
    got = {r.g: (r.p10, r.p50, r.p90) for r in stats.exact_quantiles(df, "v", fractions, ["g"]).collect()}
    assert got == want and met == [["large"]]


def test_clustered_rows_are_made_once(spark, monkeypatch, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    df = spark.range(500).select((F.col("id") * 7 % 500).alias("a"), F.udf(count, "long")(F.col("id") % 50).alias("b"))
    monkeypatch.setattr(layout, "FILE_ROWS", 20)
    stored = layout.write_clustered(df, f"{tmp_path}/curve", ["a", "b"], 4)
    assert made.value == 500
    assert sorted(r.a for r in stored.collect()) == list(range(500))
    assert stored.select(F.col("_metadata.file_path")).distinct().count() > 12  # 25 files, not 4 of any size


def test_medication_lists_tell_the_totals(spark):
    meds = [("r1", "n1", 4, 2.5, 0), ("r1", "n1", 8, 1.0, 1), ("r1", None, 2, None, 0), ("r2", None, None, None, None), ("r3", "n2", 4, 7.0, 0)]
    fields = "request_id string, ndc string, fills_per_year int, annual_cost_est double, is_insulin int"
    meds = spark.createDataFrame(meds, fields).withColumns({"drug_name": F.lit("x"), "days_supply_mode": F.lit(30), "tier_level": F.lit(1)})
    req = spark.createDataFrame([(f"r{i}", f"b{i}") for i in (1, 1, 2, 3, 4)], "request_id string, bene_synth_id string")
    req = req.withColumns({c: F.lit(c) for c in ("state", "county_code", "zip_code")})
    bene = spark.createDataFrame([(f"b{i}", "LOW", 3, 12, 90.0, 1) for i in (1, 2, 4)],
                                 "bene_synth_id string, risk_segment string, unique_drugs int, fills_target int, total_rx_cost_est double, insulin_user_flag int")
    plain = J.effective_profile(req, bene, meds)
    listed = J.effective_profile(req, bene, J.medication_lists(meds))
    assert sorted(map(repr, listed.drop("medication_list").collect())) == sorted(map(repr, plain.collect()))
    assert {r.request_id: r.medication_list and len(r.medication_list) for r in listed.collect()} == {"r1": 3, "r2": 1, "r3": 1, "r4": None}


def test_request_bundle_makes_prescriptions_once(spark, tmp_path):
    spark.createDataFrame([(0, "N0", 0), (1, "N1", 1)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(c, c % 2) for c in (1, 2, 2, 3)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(p, f"name {p}", f"type {p}", f"brand {p}", p) for p in (5, 6)],
                          "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 5, 10.0, 100.0), (2, 6, 50.0, 70.0), (3, 5, 30.0, 35.0), (3, 6, 1.0, 7.0)],
                          "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES["J20_request_bundle"](spark, str(tmp_path))
    bundles = sorted((r.request_id, r.bundle) for r in df.collect())
    # the request that is there twice meets itself, its beneficiary that is there twice, and its preferences
    assert [i for i, _ in bundles] == ["R00000001"] + ["R00000002"] * 8 + ["R00000003"]
    assert bundles[1][1].count('"ndc":"00000000006"') == 2 and "medication_list" not in bundles[-1][1]
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == 1
