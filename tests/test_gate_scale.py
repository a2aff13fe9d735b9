"""Candidates are settled before they are expanded; coverage and gate are found once per formulary: the same rows."""

import pytest
from pyspark.sql import functions as F

from rxgrid.operators import decision as J


def _gate(spark, twice):
    county = lambda i: (f"S{i % 2}", f"0000{i % 3}")
    req = [(f"R{i:02d}", *county(i), 25.0 * (i % 5)) for i in range(18)] + [(None, *county(0), 50.0), ("R98", None, "00000", 0.0)]
    req += [("R03", *county(3), 75.0), ("R05", *county(4), 0.0)] if twice else []
    plans = [(f"P{k:02d}", f"Plan {k}", f"Contract {k}", None if k == 4 else f"F{k % 3}", *county(c), None if k == 7 else 10.0 + k % 5,
              100.0, "Y" if k == 8 else "N", k % 2 == 0, k % 2 == 1) for k in range(12) for c in range(6)]
    plans += [(p[0], p[1], p[2], "F2", *p[4:6], 1.0, *p[7:]) for p in plans if p[0] == "P03"] + [(None, *plans[0][1:])]
    meds = [(f"R{i:02d}", f"{(i * 5 + j) % 12:011d}", 10.0 * j) for i in range(18) if i % 4 for j in range(5)]
    form = [(f"F{f}", f"{d:011d}", str(d % 4)) for f in range(3) for d in range(12) if (f + d) % 3]
    df = spark.createDataFrame
    keys = [r.plan_key for r in df(plans, "plan_key string, a string, b string, c string, d string, e string, f double, g double, h string, i boolean, j boolean").select("plan_key").distinct().collect()]
    fm = df([(k, 10, 0.5, 0.1, 0.2, 0.1, 0.3, 1) for k in keys if k], "plan_key string, total_drugs long, generic_tier_pct double, specialty_tier_pct double, "
            "pa_rate double, st_rate double, ql_rate double, restrictiveness_class int")
    nm = df([(k, 3, 9, 1) for k in keys if k], "plan_key string, preferred_pharmacies long, total_pharmacies long, network_adequacy_flag int")
    return J.Gate(
        df(req, "request_id string, state string, county_code string, min_drug_coverage_pct double"),
        df(plans, "plan_key string, plan_name string, contract_name string, formulary_id string, state string, county_code string, premium double, "
           "deductible double, plan_suppressed_yn string, is_ma_pd boolean, is_pdp boolean"),
        fm, nm, df(meds, "request_id string, ndc string, annual_cost_est double"), df(form, "formulary_id string, ndc string, rxcui string"),
        df([("F1", "1"), ("F2", "2")], "formulary_id string, rxcui string"))


def _rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("twice", [False, True])
def test_gate_per_formulary_gives_the_rows_of_every_candidate(spark, monkeypatch, twice):
    g = _gate(spark, twice)
    every = J.dedupe_candidates(J._candidates(g.requests.select(J.REQ, *J.COUNTY), J.offered_plans(g.plan_info, g.formulary_metrics, g.network_metrics)))
    cov = J.requested_drug_coverage(every, g.meds, g.formulary, g.excluded)
    gated = J.coverage_gate(J.enrich_coverage(every, cov, g.meds), g.requests)
    profile = g.requests.select(J.REQ, F.concat(F.lit("Z"), "county_code").alias("zip_code")).distinct()
    origins = gated.join(profile, J.REQ).select("zip_code", "plan_key").distinct()
    want = [_rows(x) for x in (every, cov, gated, origins)]
    assert all(len(w) > 10 for w in want)
    monkeypatch.setattr(J, "CANDIDATES_PER_PARTITION", 5)
    mine = J.candidate_plans(g.requests, g.plan_info, g.formulary_metrics, g.network_metrics)
    got = [_rows(x) for x in (mine, g.coverage(), g.gated(), g.origins(profile))]
    assert got == want


def test_candidates_are_not_sorted_where_requests_come_once(spark):
    g = _gate(spark, False)
    plan = J.candidate_plans(g.requests, g.plan_info, g.formulary_metrics, g.network_metrics)._jdf.queryExecution().optimizedPlan().toString()
    assert "request_id" in plan and not [x for x in plan.split("\n") if "Window" in x and "request_id" in x]
