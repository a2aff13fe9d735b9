"""Property checks: closed forms equal their loops, exact statistics equal numpy,
keyed results do not depend on partitioning."""

import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from rxgrid.functions.stats import exact_quantiles, ntile
from rxgrid.operators import phases as N


def _loop(fills, deductible, cap=2000.0):
    ded_rem, paid_to_cap, out = deductible, 0.0, []
    for price, ded_applies, rate in fills:
        if paid_to_cap >= cap:
            out.append(0.0)
            continue
        d = min(price, ded_rem) if ded_applies else 0.0
        ded_rem -= d
        left = price - d
        init = min(left * rate, left) if left > 0 else 0.0
        part = d + init
        pay = min(part, cap - paid_to_cap)
        paid_to_cap += pay
        out.append(pay)
    return out


def test_phase_closed_form_equals_loop(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for s in range(200):
        n = rng.randint(1, 25)
        ded = rng.choice([0.0, 100.0, 545.0])
        fills = [(round(rng.uniform(1, 900), 2), rng.random() < 0.6, rng.choice([0.1, 0.25, 0.5])) for _ in range(n)]
        expected[s] = _loop(fills, ded)
        rows += [(str(s), i, p, int(d), 0, None, 2, r, ded) for i, (p, d, r) in enumerate(fills)]
    df = spark.createDataFrame(rows, "bene string, n int, price double, ded_applies int, is_insulin int, "
                                     "insulin_copay double, cost_type int, cost_amt double, deductible double")
    got = {}
    for r in N.annual_progression(df.withColumn("plan", F.lit("P")), ["bene", "plan"], ["n"]).orderBy("bene", "n").collect():
        got.setdefault(r.bene, []).append(r.member_paid)
    for s, exp in expected.items():
        assert got[str(s)] == pytest.approx(exp, abs=1e-6)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = rng.lognormal(size=5000)
    groups = rng.integers(0, 4, size=5000)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, vals)], "g int, v double")
    q = {r.g: r for r in exact_quantiles(df, "v", {"p10": 0.1, "p50": 0.5, "p95": 0.95}, ["g"]).collect()}
    for g in range(4):
        x = vals[groups == g]
        assert q[g].p10 == pytest.approx(np.quantile(x, 0.1))
        assert q[g].p50 == pytest.approx(np.quantile(x, 0.5))
        assert q[g].p95 == pytest.approx(np.quantile(x, 0.95))


def test_exact_quantiles_with_mostly_equal_values_and_extremes(spark):
    rng = np.random.default_rng(8)
    odd = [float("inf"), float("-inf"), 5e-324, -5e-324, 0.0, -0.0, 1.7e308, -1.7e308, 1 + 2**-52]
    vals = np.where(rng.random(4000) < 0.9, 7.25, rng.normal(size=4000) * 1e3).tolist() + odd
    rows = [(None if i % 3 == 0 else f"g{i % 3}", v) for i, v in enumerate(vals)] + [("nothing", None), ("nan", float("nan")), ("one", -2.5)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    fractions = {"p0": 0.0, "p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in exact_quantiles(df, "v", fractions, ["g"]).collect()}
    assert set(got) == {None, "g1", "g2", "one"}
    for g, r in got.items():
        x = np.array([v for k, v in rows if k == g])
        for name, q in fractions.items():
            assert r[name] == pytest.approx(np.quantile(x, q, method="lower") if q in (0.0, 1.0) else np.quantile(x, q)), (g, name)
    whole = exact_quantiles(df, "v", {"m": 0.5}).first()
    assert whole.m == 7.25
    assert exact_quantiles(df.limit(0), "v", {"m": 0.5}).collect() == []


def test_quantile_plan_has_no_sort_of_rows(spark):
    import inspect

    from rxgrid.functions import stats

    source = inspect.getsource(stats)
    assert "repartitionByRange" not in source and "monotonically_increasing_id" not in source and "percentile(" not in source


@pytest.mark.parametrize("rows, n", [(0, 3), (1, 3), (2, 3), (7, 3), (500, 4), (1000, 3)])
def test_ntile_matches_window(spark, rows, n):
    from pyspark.sql import Window

    df = spark.range(rows).select(
        F.when(F.col("id") % 10 != 0, (F.col("id") * 7919 % 13) / 4 - 1).alias("v"), F.concat(F.lit("Pé"), (F.col("id") * 31 % 1009).cast("string")).alias("k")
    )
    want = {r.k: r.t for r in df.withColumn("t", F.ntile(n).over(Window.orderBy(F.col("v").asc_nulls_first(), "k"))).collect()}
    assert {r.k: r.t for r in ntile(df, n, "v", "k", "t").collect()} == want


def test_sampling_is_partition_invariant(spark):
    from rxgrid.operators import sampling as S

    pool = spark.createDataFrame([(f"D{i}", float(1 + i % 5)) for i in range(40)], "ndc string, w double")
    groups = spark.createDataFrame([(f"B{i}", 1 + i % 6) for i in range(60)], "bene_synth_id string, k int")
    a = S.sample_without_replacement(groups, pool, "k", "w", "ndc").collect()
    b = S.sample_without_replacement(groups.repartition(1), pool.repartition(7), "k", "w", "ndc").collect()
    assert sorted(a) == sorted(b)
    per = {}
    for r in a:
        per.setdefault(r.bene_synth_id, set()).add(r.ndc)
    assert all(len(v) == 1 + int(k[1:]) % 6 for k, v in per.items())


def test_pairs_do_not_depend_on_shuffle_partitions(spark):
    """The pair cost model gives the same rows with 1 and 8 shuffle partitions."""
    from rxgrid.plans.context import Context
    from rxgrid.plans.pairs import training_pairs
    from rxgrid.testing import normalise_rows
    from tests.conftest import SMALL

    old = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = training_pairs(Context(spark, SMALL).pair_inputs())
            out.append(normalise_rows(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(out[0]) == len(out[1])
    for a, b in zip(*out):
        assert all((x == y) or (isinstance(x, float) and abs(x - y) <= 1e-6 * max(1.0, abs(x))) for x, y in zip(a, b))
