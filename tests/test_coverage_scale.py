"""Requested drugs are looked up once per formulary, and each plan takes the result of its formulary."""

from rxgrid.operators import decision as J


def test_coverage_is_counted_per_formulary(spark):
    plans = spark.createDataFrame([("R1", f"P{i}", "F1") for i in range(5)] + [("R1", "P8", "F2"), ("R1", "P9", None), ("R2", "P8", "F2"), ("R3", "P8", "F2")],
                                  "request_id string, plan_key string, formulary_id string")
    meds = spark.createDataFrame([("R1", "n1", 10.0), ("R1", "n1", 12.0), ("R1", "n2", 5.0), ("R1", "n3", 1.0), ("R2", "n2", None), ("R9", "n1", 1.0)],
                                 "request_id string, ndc string, annual_cost_est double")
    form = spark.createDataFrame([("F1", "n1", "x1"), ("F1", "n2", "x2"), ("F2", "n2", "x2")], "formulary_id string, ndc string, rxcui string")
    gone = spark.createDataFrame([("F1", "x2"), ("F1", "x2"), ("F3", "x1")], "formulary_id string, rxcui string")
    out = J.requested_drug_coverage(plans, meds, form, gone)
    lists = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "collect_list" in x]
    assert lists and not any("plan_key" in x.split("functions=")[0] for x in lists)
    got = {(r.request_id, r.plan_key): (r.requested_drugs, r.covered_drugs, r.in_formulary_drugs, r.excluded_drugs, r.uncovered_ndcs, r.uncovered_requested_cost)
           for r in out.collect()}
    assert got == {**{("R1", f"P{i}"): (3, 1, 2, 1, "n2, n3", 6.0) for i in range(5)}, ("R1", "P8"): (3, 1, 1, 0, "n1, n3", 13.0),
                   ("R1", "P9"): (3, 0, 0, 0, "n1, n2, n3", 18.0), ("R2", "P8"): (1, 1, 1, 0, None, 0.0)}
