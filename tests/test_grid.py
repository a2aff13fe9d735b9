"""Grid index: radius search and growing rings equal brute force, near poles and the date line too."""

import random

import pytest
from pyspark.sql import functions as F

from rxgrid.functions import grid
from rxgrid.functions.geo import acos_miles


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(4)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)]
    spots += [(lat + rng.uniform(-0.4, 0.4), lng + rng.uniform(-0.4, 0.4)) for lat, lng in [(40, -75)] * 60 + [(0, 179.9)] * 20 + [(0, -179.9)] * 20]
    spots += [(lat, rng.uniform(-180, 180)) for lat in (89.7, 89.9, -89.8, 90.0, -90.0) for _ in range(6)] + [(12.0, -180.0), (12.0, 180.0), (12.0, 180.3)]
    rows = [(i, f"k{i % 3}", lat, lng) for i, (lat, lng) in enumerate(spots)]
    left = spark.createDataFrame(rows + [(9000, "k0", None, 1.0)], "a int, key string, lat double, lng double")
    right = spark.createDataFrame([(i, k, x, y) for i, k, x, y in rows[::2]], "b int, key string, p_lat double, p_lng double")
    both = left.join(right, "key").where("lat is not null").withColumn("d", acos_miles(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng")))
    return left, right, [(r.a, r.b, r.d) for r in both.select("a", "b", "d").collect()]


@pytest.mark.parametrize("miles", [3.0, 25.0, 400.0, 7000.0, 12_500.0])
def test_within_matches_brute_force(points, miles):
    left, right, pairs = points
    got = {(r.a, r.b): r.distance_miles for r in grid.within(left, right, miles, ["key"]).collect()}
    assert got == pytest.approx({(a, b): d for a, b, d in pairs if d <= miles})


def test_within_compares_rounded_distances(points):
    left, right, pairs = points
    got = {(r.a, r.b) for r in grid.within(left, right, 40.0, ["key"], digits=0).collect()}
    assert got == {(a, b) for a, b, d in pairs if round(d + 1e-9) <= 40}


@pytest.mark.parametrize("k", [1, 4, 500])
def test_growing_rings_match_brute_force(points, k):
    left, right, pairs = points
    near = {}
    for a, b, d in pairs:
        near.setdefault(a, []).append((d, b))
    want = {(a, rank): d for a, x in near.items() for rank, (d, _) in enumerate(sorted(x)[:k], 1)}
    got = {(r.a, r["rank"]): r.distance_miles for r in grid.nearest(left, right, ["a"], ["b"], k, ["key"], first_miles=5.0).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_rings_over_nothing(points):
    left, right, _ = points
    assert grid.nearest(left.limit(0), right, ["a"], ["b"], 1, ["key"]).collect() == []
    assert grid.nearest(left, right.limit(0), ["a"], ["b"], 1, ["key"]).collect() == []
    one = grid.nearest(left.where("a = 1"), right.drop("key"), ["a"], ["b"], 2)
    assert [r["rank"] for r in one.orderBy("rank").collect()] == [1, 2]


def test_all_pairs_of_a_key(points):
    left, right, pairs = points
    got = {(r.a, r.b): r.distance_miles for r in grid.all_pairs(left.where("lat is not null"), right, "key").collect()}
    assert got == pytest.approx({(a, b): d for a, b, d in pairs})


def test_searches_join_on_cells(points):
    left, right, _ = points
    plan = grid.within(left, right, 10.0, ["key"])._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert "_y" in join and "_x" in join and "CartesianProduct" not in plan
