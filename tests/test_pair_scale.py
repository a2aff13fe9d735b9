"""Pairs at scale: what larger tables do to the plan of the pair cost model, on rows of the tests' own."""

import pyspark.sql.functions as F
from pyspark.sql import Row

from rxgrid.operators import costmodel as G
from rxgrid.operators import ranking as H
from rxgrid.plans import pairs


def _inputs(spark, benes=60, plans=12, drugs=30):
    county = lambda i: {"state": f"S{i % 2}", "county_code": f"0000{i % 3}"}
    ben = [Row(bene_synth_id=f"B{i:03d}", **county(i), zip_code="00001", density=1.0, risk_segment="LOW" if i % 4 else None,
               unique_drugs=i % 5 if i % 6 else None, fills_target=12, total_rx_cost_est=1000.0 + i, insulin_user_flag=i % 2)
           for i in range(benes)]
    pl = [Row(plan_key=f"P{k:02d}", formulary_id=None if k == 5 else f"F{k % 4}", **county(c), premium=10.0 + k, deductible=100.0 * (k % 3),
              snp=0, plan_suppressed_yn="N", is_ma_pd=k % 2 == 0, is_pdp=k % 2 == 1) for k in range(plans) for c in range(6)]
    rx = [Row(bene_synth_id=f"B{i:03d}", ndc=f"{(i * 7 + j) % drugs:011d}", rxcui=str(j) if j % 2 else None, tier_level=j % 7 + 1,
              fills_per_year=4 + j, days_supply_mode=(30, 60, 90)[j % 3], qty_per_fill=float(10 + j),
              estimated_annual_drug_cost=100.0 + 3 * j, is_insulin=int(j == 4)) for i in range(benes) if i % 9 for j in range(6)]
    form = [Row(formulary_id=f"F{f}", ndc=f"{d:011d}", tier_level_value=float(d % 6 + 1), rxcui=str(d % 8)) for f in range(4) for d in range(drugs) if (f + d) % 4]
    price = [Row(plan_key=f"P{k:02d}", ndc=f"{d:011d}", days_supply=(30, 60, 90)[r], unit_cost=1.0 + d / 7 + k / 3 + r)
             for k in range(plans) for d in range(drugs) for r in range(3) if (k * d + r) % 3]
    cost = [Row(plan_key=f"P{k:02d}", coverage_level=1, tier=float(t), days_supply=d, cost_type_pref=(k + t) % 3, cost_amt_pref=5.0 + t,
                deductible_applies=(k + t) % 2 == 0, ded_applies_yn="N") for k in range(plans) for t in range(1, 7) for d in (1, 2, 4)]
    ins = [Row(plan_key=f"P{k:02d}", tier=None if k % 3 else "2", days_supply=d, copay_amt_pref_insln=20.0 + k, min_insulin_copay=1.0,
               max_insulin_copay=90.0) for k in range(plans) for d in (1, 2, 4)]
    ex = [Row(formulary_id=f"F{f}", rxcui=str(f + 1)) for f in range(4)]
    df = spark.createDataFrame
    return pairs.PairInputs(
        df(ben, "bene_synth_id string, state string, county_code string, zip_code string, density double, risk_segment string, unique_drugs int, fills_target int, total_rx_cost_est double, insulin_user_flag int"),
        df(pl, "plan_key string, formulary_id string, state string, county_code string, premium double, deductible double, snp int, plan_suppressed_yn string, is_ma_pd boolean, is_pdp boolean"),
        df(rx, "bene_synth_id string, ndc string, rxcui string, tier_level int, fills_per_year int, days_supply_mode int, qty_per_fill double, estimated_annual_drug_cost double, is_insulin int"),
        df(form), df(ex), df(price), df(cost), df(ins, "plan_key string, tier string, days_supply int, copay_amt_pref_insln double, min_insulin_copay double, max_insulin_copay double"))


def _rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_large_maps_do_not_shuffle_pair_rows(spark, monkeypatch):
    """Above the broadcast bound the maps meet the drug rows in cells: same rows, no exchange above the expansion."""
    inp = _inputs(spark)
    want, want_drugs = _rows(pairs.training_pairs(inp)), _rows(pairs.pair_drug_rows(inp))
    small = pairs.broadcast_if_small
    big = {"formulary_tier", "unit_cost_any"}
    monkeypatch.setattr(pairs, "broadcast_if_small", lambda d, *a, **k: d if big & set(d.columns) else small(d, *a, **k))
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    try:
        rows = pairs.pair_drug_rows(inp)
        assert "_cell" in rows.columns
        got, got_drugs = _rows(pairs.training_pairs(inp)), _rows(rows.drop("_cell"))
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert len(want) > 300 and got == want and got_drugs == want_drugs
    # the joins that look prices up read the expanded rows where they are
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin [_cell" not in plan and "ENSURE_REQUIREMENTS" not in "".join(
        line for line in plan.split("\n") if "hashpartitioning(_cell" in line)


def test_partitions_follow_the_pairs(spark, monkeypatch):
    inp = _inputs(spark)
    least = pairs.pair_partitions(inp.beneficiary, inp.plan_info)
    monkeypatch.setattr(pairs, "PAIRS_PER_PARTITION", 2)
    assert pairs.pair_partitions(inp.beneficiary, inp.plan_info) == 360 > least  # 60 beneficiaries x 12 plans
    assert pairs.service_pairs(inp).count() == 720


def test_price_map_partitions_follow_the_prices(spark, monkeypatch):
    inp = _inputs(spark)
    want = _rows(G.pricing_map(inp.pricing))
    monkeypatch.setattr(G, "PRICES_PER_PARTITION", 10)
    got = G.pricing_map(inp.pricing)
    assert got.rdd.getNumPartitions() >= inp.pricing.count() // 10
    assert _rows(got) == want


def test_explanation_sample_reads_the_explanations_once(spark):
    cols = ["cost_explanation", "distance_explanation", "recommendation_label"]
    rows = [(b, f"P{r}", r, *cols) for b, n in (("B2", 5), ("B1", 2), (None, 1)) for r in range(n, 0, -1)]
    expl = spark.createDataFrame(rows, ["bene_synth_id", "plan_key", "recommendation_rank", *cols])
    sample = H.explanation_sample(expl)
    assert [(r.bene_synth_id, r.recommendation_rank) for r in sample.collect()] == [("B1", 1), ("B1", 2)]
    assert sample._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
