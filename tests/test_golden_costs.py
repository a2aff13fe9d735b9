"""Worked cost scenarios from the documented cost logic."""

import pyspark.sql.functions as F
import pytest

from rxgrid.operators import phases as N


def _one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} double" for k in cols))
    return df.select(expr).first()[0]


def test_floor_binds(spark):
    price = _one(spark, N.negotiated_price(F.col("u"), F.col("q"), F.col("f"), F.col("fl")), u=0.02, q=30.0, f=1.5, fl=3.0)
    assert price == pytest.approx(3.00)
    paid = _one(spark, N.channel_cost(F.lit(3.0), F.lit(1), F.col("c")), c=10.0)
    assert paid == pytest.approx(3.00)


def test_coinsurance(spark):
    price = _one(spark, N.negotiated_price(F.col("u"), F.col("q"), F.col("f"), F.col("fl")), u=5.0, q=90.0, f=3.0, fl=3.0)
    assert price == pytest.approx(453.00)
    assert _one(spark, N.channel_cost(F.col("p"), F.lit(2), F.lit(0.25)), p=price) == pytest.approx(113.25)


def test_brand_fee(spark):
    price = _one(spark, N.negotiated_price(F.col("u"), F.col("q"), F.col("f"), F.col("fl")), u=5.0, q=10.0, f=1.0, fl=0.0)
    assert price == pytest.approx(51.00)
    assert _one(spark, N.channel_cost(F.col("p"), F.lit(2), F.lit(0.25)), p=price) == pytest.approx(12.75)


def _progress(spark, rows, deductible, prior=0.0):
    df = spark.createDataFrame(
        [("B", "P", i, p, d, ins, ic, t, a, deductible, prior) for i, (p, d, ins, ic, t, a) in enumerate(rows)],
        "bene string, plan string, n int, price double, ded_applies int, is_insulin int, insulin_copay double, "
        "cost_type int, cost_amt double, deductible double, prior double")
    out = N.annual_progression(df, ["bene", "plan"], ["n"], prior_paid="prior").orderBy("n").collect()
    return [r.member_paid for r in out]


def test_deductible_split(spark):
    assert _progress(spark, [(180.0, 1, 0, None, 2, 0.25)], 100.0) == [pytest.approx(120.0)]


def test_insulin_deductible_exempt(spark):
    assert _progress(spark, [(250.0, 0, 1, 35.0, 1, 47.0)], 400.0) == [pytest.approx(35.0)]


def test_cap_then_zero(spark):
    price = 200.0 * 30 + 2.0
    paid = _progress(spark, [(price, 0, 0, None, 2, 0.25), (price, 0, 0, None, 2, 0.25)], 0.0, prior=600.0)
    assert paid == [pytest.approx(1400.0), pytest.approx(0.0)]


def test_suppressed_plan_never_paired(spark):
    from tests.conftest import SMALL
    from rxgrid.plans.context import Context
    from rxgrid.plans.pairs import service_pairs

    ctx = Context(spark, SMALL)
    sup = ctx.t("plan_info").where("plan_suppressed_yn = 'Y'").select("plan_key").distinct()
    pairs = service_pairs(ctx.pair_inputs(with_metrics=False))
    assert pairs.join(sup, "plan_key", "left_semi").count() == 0
