"""The cost sums of pairs are made in cells, never from pair x drug rows: the same sums, also with odd rows."""

import pytest
from pyspark.sql import functions as F
from test_pair_scale import _inputs, _rows

from rxgrid.operators import costmodel as G
from rxgrid.plans import pairs

KEYS = ["bene_synth_id", "plan_key", "state", "county_code"]


def _odd(inp):
    """Beneficiaries, plans and prescriptions that come twice, and nulls in keys and values."""
    twice = lambda df, some: df.unionByName(df.where(some))
    none = lambda df, some, *cols: df.withColumns({c: F.when(~some, F.col(c)) for c in cols})
    pmod = lambda c, n: F.pmod(F.hash(*c), F.lit(n)) == 0
    inp.beneficiary = none(twice(inp.beneficiary, "bene_synth_id < 'B010'"), F.col("bene_synth_id") == "B020", "bene_synth_id")
    inp.plan_info = none(twice(inp.plan_info, "plan_key in ('P03', 'P07')"), F.col("plan_key") == "P09", "deductible", "premium")
    rx = twice(inp.prescriptions, pmod(["bene_synth_id", "ndc"], 7))
    for i, c in enumerate(("fills_per_year", "qty_per_fill", "days_supply_mode", "estimated_annual_drug_cost", "is_insulin", "ndc")):
        rx = none(rx, pmod(["bene_synth_id", "ndc", F.lit(i)], 9), c)
    inp.prescriptions = rx
    inp.formulary = none(inp.formulary, pmod(["formulary_id", "ndc"], 8), "rxcui")
    inp.formulary = none(inp.formulary, pmod(["ndc", "formulary_id"], 11), "tier_level_value")
    inp.pricing = none(twice(inp.pricing, "plan_key = 'P02'"), pmod(["plan_key", "ndc"], 10), "unit_cost")
    inp.beneficiary_cost = none(inp.beneficiary_cost, pmod(["plan_key", "tier"], 6), "cost_amt_pref")
    inp.insulin_cost = none(inp.insulin_cost, pmod(["plan_key", "days_supply"], 5), "copay_amt_pref_insln")
    return inp


@pytest.mark.parametrize("odd", [False, True])
def test_cost_sums_are_made_without_pair_drug_rows(spark, monkeypatch, odd):
    inp = _odd(_inputs(spark)) if odd else _inputs(spark)
    rows = pairs.pair_drug_rows(inp).where(F.col("bene_synth_id").isNotNull())
    old = rows.groupBy(*KEYS).agg(*G.pair_cost_aggregates()).na.fill(0.0)
    bene = inp.beneficiary.select("bene_synth_id")
    want = _rows(old.join(bene, "bene_synth_id"))
    monkeypatch.setattr(pairs, "pair_drug_rows", None)
    got = pairs.pair_costs(inp)
    assert _rows(got.select(old.columns)) == want and len(want) > 500
    # many cells, and beneficiaries that are too many to send
    monkeypatch.setattr(pairs, "PAIRS_PER_CELL", 20)
    monkeypatch.setattr(pairs, "broadcast_if_small", lambda d, *a, **k: d)
    assert _rows(pairs.pair_costs(inp).select(old.columns)) == want


def test_cells_have_keys_of_their_own(spark):
    for n in (1, 7, 300):
        assert len(set(pairs._partition_keys(spark, n))) == n
