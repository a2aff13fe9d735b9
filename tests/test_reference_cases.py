"""The reference's own unit cases, replayed on inline DataFrames."""

import pyspark.sql.functions as F

from rxgrid.operators import decision as J
from rxgrid.operators import drugs as L
from rxgrid.operators import features as I
from rxgrid.operators import sampling as S


def test_coverage_status_buckets(spark):
    df = spark.createDataFrame([(0.0, 0), (95.0, 4), (60.0, 4), (25.0, 4)], "pct double, requested int")
    got = [r[0] for r in df.select(J.coverage_status(F.col("pct"), F.col("requested"))).collect()]
    assert got == ["Not evaluated", "Good fit", "Partial fit", "Poor fit"]


def test_candidate_dedupe_prefers_eligible_local(spark):
    rows = [
        ("R1", "P1", 30.0, False, False, True, 95.0, 40.0),
        ("R1", "P1", 30.0, True, True, False, 95.0, 0.0),
        ("R1", "P1", 30.0, True, False, False, 50.0, 10.0),
    ]
    df = spark.createDataFrame(rows, "request_id string, plan_key string, premium double, service_area_eligible boolean, "
                                     "is_local boolean, comparison_only boolean, drug_coverage_pct double, distance_miles double")
    out = J.dedupe_candidates(df, "drug_coverage_pct").collect()
    assert len(out) == 1
    r = out[0]
    assert r.service_area_eligible and r.is_local and r.drug_coverage_pct == 95.0


def test_heuristic_score_orders_cheaper_nearer_plan_first(spark):
    df = spark.createDataFrame(
        [("R1", "A", 900.0, 2.0, 100.0), ("R1", "B", 2200.0, 12.0, 40.0)],
        "request_id string, plan_key string, total_cost_with_distance double, nearest_preferred_miles double, "
        "drug_coverage_pct double")
    h = df.withColumn("h", 100.0 * (0.55 * J.normalized("total_cost_with_distance", False)
                                    + 0.20 * J.normalized("nearest_preferred_miles", False)
                                    + 0.25 * J.normalized("drug_coverage_pct", True)))
    s = {r.plan_key: r.h for r in h.collect()}
    assert s["A"] > s["B"]


def test_county_weights_repair_state_and_drop_unmatched(spark):
    geo = spark.createDataFrame([("1001", None), ("01003", "AL"), ("99999", None)], "county_code string, state_label string")
    z = spark.createDataFrame([("01001", "AL"), ("01003", "AL")], "county_code string, state string")
    w = S.county_weights(geo, z).collect()
    assert {r.county_code for r in w} == {"01001", "01003"}
    assert {r.state for r in w} == {"AL"}


def test_zip_assignment_deterministic_and_audited(spark):
    bene = spark.createDataFrame([("BENE_1", "01001"), ("BENE_2", "01001"), ("BENE_3", "01001"), ("BENE_4", "99999")],
                                 "bene_synth_id string, county_code string")
    zips = spark.createDataFrame(
        [("01001", "AL", "36003", 1000, 32.53, -86.64, 90), ("01001", "AL", "36066", 200, 32.48, -86.47, 140)],
        "county_code string, state string, zip_code string, population int, lat double, lng double, density int")
    a1, au1 = S.assign_population_weighted_zips(bene, zips, seed=17)
    a2, au2 = S.assign_population_weighted_zips(bene, zips, seed=17)
    assert sorted(a1.collect()) == sorted(a2.collect())
    assert sorted(au1.collect()) == sorted(au2.collect())
    ex = [r for r in au1.collect() if r.assignment_status == "excluded"]
    assert len(ex) == 1 and ex[0].bene_synth_id == "BENE_4"
    assert ex[0].exclusion_reason == "No ZIP candidates available for county"
    assert {r.zip_code for r in a1.collect()} <= {"36003", "36066"}


def test_ndc_token_and_text(spark):
    df = spark.createDataFrame([("00002-8715-01",)], "t string")
    assert df.select(L.ndc_candidates(F.col("t"))).first()[0][-1] == "00002871501"
    txt = spark.createDataFrame([("m1", "00002871501, 00002-8715-01\n68992301001")], "id string, text string")
    got = [r.ndc for r in L.parse_ndc_text(txt, "id").orderBy("position").collect()]
    assert got[0] == "00002871501"
    assert got.count("00002871501") == 1
    assert "68992301001" in got


def test_normalize_medication_rows(spark):
    rows = spark.createDataFrame(
        [("R1", "Drug A", "00002-8715-01", "9", "90", "3", "1", "1200.50"), ("R1", "Invalid", "", "5", None, None, None, None)],
        "request_id string, drug_name string, ndc string, fills_per_year string, days_supply_mode string, "
        "tier_level string, is_insulin string, annual_cost_est string")
    out = L.normalize_medications(rows).collect()
    assert len(out) == 1
    r = out[0]
    assert r.ndc == "00002871501" and r.days_supply_mode == 90 and r.tier_level == 3
    assert r.is_insulin is True and r.annual_cost_est == 1200.5


def test_summarize_medications(spark):
    rows = spark.createDataFrame(
        [("R1", "Drug A", "00002871501", 10, 30, 2, 0, 400.0, 0), ("R1", "Drug A alt", "00002-8715-01", 12, 90, 3, 1, 500.0, 1),
         ("R1", "Drug B", "68992301001", 6, 60, 4, 0, 800.0, 2)],
        "request_id string, drug_name string, ndc string, fills_per_year int, days_supply_mode int, tier_level int, "
        "is_insulin int, annual_cost_est double, row_pos int")
    merged = L.merge_medications(L.normalize_medications(rows))
    s = L.summarize_medications(merged).first()
    assert s.num_drugs == 2 and s.is_insulin_user == 1
    assert round(s.avg_fills_per_year, 2) == 9.0 and s.total_annual_drug_cost == 1300.0
    order = [r.ndc for r in merged.orderBy("first_pos").collect()]
    assert order == ["00002871501", "68992301001"]


def test_fill_allocation_sums_and_minimum(spark):
    items = spark.createDataFrame([("B1", f"N{i}", 12) for i in range(4)], "bene_synth_id string, ndc string, target int")
    out = S.allocate_fills(items, "target", "bene_synth_id", "ndc").collect()
    assert sum(r.fills_allocated for r in out) == 12
    assert all(r.fills_allocated >= 1 for r in out)


def test_relevance_labels(spark):
    df = spark.createDataFrame([("B", "p0", 500.0), ("B", "p1", 1200.0), ("B", "p2", 1200.0), ("B", "p3", 2500.0)],
                               "bene_synth_id string, plan_key string, ranking_cost_objective double")
    got = {r.plan_key: r.relevance_label for r in I.relevance_labels(df).collect()}
    assert got == {"p0": 2, "p1": 1, "p2": 1, "p3": 0}


def test_relevance_labels_rescale_to_30(spark):
    df = spark.createDataFrame([("B", f"p{i:02d}", float(i)) for i in range(40)],
                               "bene_synth_id string, plan_key string, ranking_cost_objective double")
    labels = [r.relevance_label for r in I.relevance_labels(df).collect()]
    assert max(labels) == 30 and min(labels) == 0
