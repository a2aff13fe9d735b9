"""G9-G15 over a cell: the cost sums of all pairs of a block of one county's beneficiaries with a block of its plans.

A cell holds the drug rows of its beneficiaries and, for its plans, their rules and prices.  The pair x drug rows are never
made: a plan's costs are arrays over the drug rows (the same expressions as `costmodel`, by numpy), summed per beneficiary.

Nulls and NaN as in Spark: `least` skips NaN (fmin), `greatest` keeps it (maximum); a drug without a price counts
with unit cost 0, which means the same to G9; an uncovered drug has rule 0, which leaves its cost as it is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rxgrid.config import CostPolicy, PricingPolicy
from rxgrid.operators.costmodel import PRICED_CODES

CODES = PRICED_CODES
SUMS = ("_post_sum", "_ded_total", "_ded_weighted", "oop_copay_component", "oop_coinsurance_component", "oop_insulin_component",
        "oop_uncovered_component")
COUNTS = ("_n_drugs", "covered_drug_count", "uncovered_drug_count")
COST_SCHEMA = ("bene_synth_id string, plan_key string, state string, county_code string, _n_drugs bigint, "
               + ", ".join(f"{c} double" for c in SUMS) + ", covered_drug_count bigint, uncovered_drug_count bigint")
# Drug rows of whole beneficiaries that are worked on at once (their arrays fit a core's cache).
ROWS_AT_ONCE = 16_384


def _codes(values: pa.ChunkedArray, known: pa.Array) -> np.ndarray:
    """Places in `known` (-1: not there, or null)."""
    return pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy().astype(np.int64)


def _known(values: pa.ChunkedArray) -> pa.Array:
    """The values, each once."""
    return pc.unique(values.drop_null())


def _numbers(values: pa.ChunkedArray) -> np.ndarray:
    """Doubles; nulls are NaN (where a column has none of its own)."""
    return values.cast(pa.float64()).to_numpy()


def _lists(values: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(row, element) of a column of lists."""
    lists = values.combine_chunks()
    return pc.list_parent_indices(lists).to_numpy().astype(np.int64), lists.flatten()


def _code_place(codes: np.ndarray) -> np.ndarray:
    """Place of a days code in CODES (-1: another code)."""
    out = np.full(len(codes), -1)
    for i, c in enumerate(CODES):
        out[codes == c] = i
    return out


def _slots(tier: np.ndarray, code: np.ndarray, tiers: np.ndarray) -> np.ndarray:
    """Place of (tier, days code) in a plan's rule table, 1 and up (-1: no drug has it)."""
    if not len(tiers):
        return np.full(len(tier), -1)
    at = np.minimum(np.searchsorted(tiers, tier), len(tiers) - 1)
    return np.where((tiers[at] == tier) & (code >= 0), 1 + at * len(CODES) + code, -1)


def _rule_tables(plans: pa.Table, tiers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per plan row and (tier, days code): cost type, factor and cap of the cost per fill, whether the deductible applies."""
    shape = (plans.num_rows, 1 + len(tiers) * len(CODES))
    ctype, factor, cap, ded = np.zeros(shape, np.int8), np.ones(shape), np.full(shape, np.inf), np.zeros(shape, bool)
    row, rule = _lists(plans["rules"])
    slot = _slots(rule.field("tier").to_numpy(zero_copy_only=False), _code_place(rule.field("code").to_numpy(zero_copy_only=False)), tiers)
    kind = rule.field("type").to_numpy(zero_copy_only=False)
    amount, applies = rule.field("amount").to_numpy(zero_copy_only=False), rule.field("ded").to_numpy(zero_copy_only=False) == 1
    for own, some in ((1, kind == 1), (2, kind == 2)):
        some = some & (slot >= 0)
        at = row[some], slot[some]
        ctype[at] = own
        if own == 1:
            cap[at] = np.maximum(amount[some], 0.0)
        else:
            factor[at] = np.where(~(amount[some] <= 1.0), amount[some] / 100.0, amount[some])
    there = (slot >= 0) & applies
    ded[row[there], slot[there]] = True
    return ctype, factor, cap, ded


def _insulin_tables(plans: pa.Table, tiers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per plan row and (tier, days code): insulin copay and whether there is one; the tier's own before the plan's."""
    shape = (plans.num_rows, 1 + len(tiers) * len(CODES))
    copay, there = np.zeros(shape), np.zeros(shape, bool)
    row, rule = _lists(plans["insulin"])
    code = _code_place(rule.field("code").to_numpy(zero_copy_only=False))
    any_tier = rule.field("tier").is_null().to_numpy(zero_copy_only=False)
    tier = pc.fill_null(rule.field("tier"), 0).to_numpy(zero_copy_only=False)
    value = rule.field("copay")
    known = value.is_valid().to_numpy(zero_copy_only=False)
    value = pc.fill_null(value, 0.0).to_numpy(zero_copy_only=False)
    some = any_tier & known & (code >= 0)
    for t in range(len(tiers)):
        at = row[some], 1 + t * len(CODES) + code[some]
        copay[at], there[at] = value[some], True
    slot = _slots(tier, code, tiers)
    own = ~any_tier & known & (slot >= 0)
    copay[row[own], slot[own]], there[row[own], slot[own]] = value[own], True
    return copay, there


def _coverage(drugs: pa.Table, formularies: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tier, covered) per formulary and drug row, and the tiers met (G11): in the formulary, and not excluded by the drug's
    rxcui or, where it has none, by the formulary's."""
    n = drugs.num_rows
    tier, covered = np.zeros((len(formularies), n), np.int64), np.zeros((len(formularies), n), bool)
    row, form = _lists(drugs["listed_form"])
    at = _codes(form, formularies)
    some = at >= 0
    row, at = row[some], at[some]
    tiers = _lists(drugs["listed_tier"])[1].to_numpy()[some].astype(np.int64)
    excluded = _lists(drugs["listed_excluded"])[1].to_numpy(zero_copy_only=False)[some]
    x_row, x_form = _lists(drugs["excluded_from"])
    x_at = _codes(x_form, formularies)
    by_rxcui = np.zeros((len(formularies), n), bool)
    by_rxcui[x_at[x_at >= 0], x_row[x_at >= 0]] = True
    named = drugs["rxcui"].is_valid().to_numpy()
    tier[at, row] = tiers
    covered[at, row] = ~np.where(named[row], by_rxcui[at, row], excluded)
    return tier, covered, np.unique(tiers)


def cell_costs(drugs: pa.Table, reference: pa.Table, pricing: PricingPolicy, policy: CostPolicy) -> pa.Table:
    """Sums of one cell.  `drugs`: a beneficiary's drugs (one row without ndc where it has none), with the formularies that list the
    drug and those that exclude its rxcui.  `reference`: rows of plans (with their rules) and, where `ndc` is given, of prices."""
    plans, prices = reference.filter(pc.invert(reference["is_price"])), reference.filter(reference["is_price"])
    if not drugs.num_rows or not plans.num_rows:
        return _table(pa.array([], pa.string()), pa.array([], pa.string()), None, None, np.zeros((len(SUMS), 0, 0)), np.zeros((len(COUNTS), 0, 0)))
    bene_ids, plan_ids, forms = _known(drugs["bene_synth_id"]), _known(plans["plan_key"]), _known(plans["form"])
    bene = _codes(drugs["bene_synth_id"], bene_ids)
    drugs = drugs.take(pa.array(np.argsort(bene, kind="stable")))
    bene = np.sort(bene)
    state, county = drugs["state"][0].as_py(), drugs["county_code"][0].as_py()
    first = np.searchsorted(bene, np.arange(len(bene_ids)))  # a beneficiary's first row
    has = drugs["ndc"].is_valid().to_numpy()
    ndcs = _known(drugs["ndc"])
    ndc, code = _codes(drugs["ndc"], ndcs), _code_place(_numbers(drugs["days_supply_code"]))
    fills, amount, fallback = (np.where(has, _numbers(drugs[c]), one) for c, one in (("fills_per_year", 1.0), ("annual_units", 0.0), ("annual_gross_cost_fallback", 0.0)))
    insulin_cap = policy.insulin_cap_per_month * _numbers(drugs["days_supply_months"])
    is_insulin = has & (_numbers(drugs["is_insulin"]) == 1)
    tier, covered, tiers = _coverage(drugs, forms)
    ctype, factor, cap, ded = _rule_tables(plans, tiers)
    copay, has_copay = _insulin_tables(plans, tiers)
    plan, form = _codes(plans["plan_key"], plan_ids), _codes(plans["form"], forms)
    price_plan, price_ndc = _codes(prices["plan_key"], plan_ids), _codes(prices["ndc"], ndcs)
    price_order = np.argsort(price_plan, kind="stable")
    price_order = price_order[(price_plan[price_order] >= 0) & (price_ndc[price_order] >= 0)]
    price_first = np.searchsorted(price_plan[price_order], np.arange(len(plan_ids) + 1))
    price_unit = np.stack([_numbers(prices[f"unit_{c}"]) for c in CODES]) if prices.num_rows else np.zeros((len(CODES), 0))
    sums = np.zeros((len(SUMS), len(plan_ids), len(bene_ids)))
    counts = np.zeros((len(COUNTS), len(plan_ids), len(bene_ids)), np.int64)
    by_form = [np.flatnonzero(form == f) for f in range(-1, len(forms))]
    unit_of = np.zeros((len(CODES), len(ndcs) + 1))  # of one plan; the last place is of rows without a drug
    gross_0, spans = fallback, _spans(first, len(bene))
    with np.errstate(all="ignore"):
        per_fill_0 = np.maximum(gross_0 / fills, 0.0)
        for f, members in zip(range(-1, len(forms)), by_form):
            if not len(members):
                continue
            cov = covered[f] & has if f >= 0 else np.zeros(len(bene), bool)
            rule = np.where(cov, _slots(tier[f], code, tiers), 0) if f >= 0 else np.zeros(len(bene), np.int64)
            unc = has & ~cov
            ins_at = np.flatnonzero(is_insulin & cov)
            n_all, n_cov = (np.add.reduceat(x.astype(np.int64), first) for x in (has, cov))
            unc_at = unc.astype(float)
            for p in members:
                own = price_order[price_first[plan[p]]:price_first[plan[p] + 1]]
                priced = np.zeros(0, np.int64)
                if len(own):
                    unit_of[:, price_ndc[own]] = price_unit[:, own]
                    unit = unit_of[code, ndc]
                    priced = np.flatnonzero(has & ~(unit <= 0.0))
                    unit_of[:, price_ndc[own]] = 0.0
                gross, per_fill = gross_0, per_fill_0
                if len(priced):
                    gross, per_fill = gross_0.copy(), per_fill_0.copy()
                    gross[priced] = _gross(amount[priced], unit[priced], fallback[priced], pricing)
                    per_fill[priced] = np.maximum(gross[priced] / fills[priced], 0.0)
                for start, end, b0, b1 in spans:
                    s = slice(start, end)
                    _add(sums[:, plan[p], b0:b1], gross[s], per_fill[s], fills[s], rule[s], unc_at[s], first[b0:b1] - start,
                         ctype[p], factor[p], cap[p], ded[p],
                         ins_at[np.searchsorted(ins_at, start):np.searchsorted(ins_at, end)] - start,
                         insulin_cap[s], copay[p], has_copay[p])
                counts[0, plan[p]] += n_all
                counts[1, plan[p]] += n_cov
                counts[2, plan[p]] += n_all - n_cov
    return _table(bene_ids, plan_ids, state, county, sums, counts)


def _spans(first: np.ndarray, rows: int) -> list[tuple[int, int, int, int]]:
    """(first row, end, first beneficiary, end) of runs of whole beneficiaries of about ROWS_AT_ONCE rows."""
    out, b = [], 0
    while b < len(first):
        end = max(b + 1, int(np.searchsorted(first, first[b] + ROWS_AT_ONCE)))
        out.append((int(first[b]), int(first[end]) if end < len(first) else rows, b, end))
        b = end
    return out


def _gross(amount: np.ndarray, unit: np.ndarray, fallback: np.ndarray, p: PricingPolicy) -> np.ndarray:
    """G9 + G10 of drugs that have a price."""
    raw = np.maximum(amount * unit, 0.0)
    bounded = np.where(fallback > 0, np.fmin(np.fmin(np.maximum(raw, fallback * p.ratio_min), fallback * p.ratio_max), p.annual_abs_max),
                       np.fmin(raw, p.annual_abs_max))
    return np.maximum(p.blend_weight * bounded + (1.0 - p.blend_weight) * fallback, 0.0)


def _add(out, gross, g, fills, rule, uncovered, starts, ctype, factor, cap, ded, insulin, insulin_cap, copay, has_copay) -> None:
    """G12 + G13 of one plan over a run of drug rows, and G14 + G15: their sums per beneficiary, added to `out`."""
    per_fill = np.fmin(np.fmin(g, g * factor[rule]), cap[rule])
    if len(insulin):
        at = insulin[has_copay[rule[insulin]]]
        per_fill[at] = np.fmin(g[at], np.fmin(copay[rule[at]], insulin_cap[at]))
        per_fill[at[gross[at] <= 0]] = 0.0
    paid = fills * per_fill
    post = np.maximum(paid, 0.0)
    eligible = np.where(ded[rule], gross, 0.0)
    share = np.ones(len(paid))
    np.divide(paid, gross, out=share, where=~(gross <= 0))
    share = np.fmin(np.maximum(share, 0.0), 1.0)
    kind = ctype[rule]
    for i, x in enumerate((post, eligible, eligible * (1.0 - share), post * (kind == 1), post * (kind == 2), None, post * uncovered)):
        if x is not None:
            out[i] += np.add.reduceat(x, starts)
    if len(insulin):
        of = np.searchsorted(starts, insulin, side="right") - 1
        out[5] += np.bincount(of, post[insulin], len(starts))


def _table(bene_ids, plan_ids, state, county, sums, counts) -> pa.Table:
    n_plans, n_benes = sums.shape[1:]
    n = n_plans * n_benes
    columns = {
        "bene_synth_id": bene_ids.take(pa.array(np.tile(np.arange(n_benes), n_plans))),
        "plan_key": plan_ids.take(pa.array(np.repeat(np.arange(n_plans), n_benes))),
        "state": pa.repeat(pa.scalar(state, pa.string()), n), "county_code": pa.repeat(pa.scalar(county, pa.string()), n),
        "_n_drugs": pa.array(counts[0].ravel().astype(np.int64)),
        **{c: pa.array(sums[i].ravel()) for i, c in enumerate(SUMS)},
        **{c: pa.array(counts[i].ravel().astype(np.int64)) for i, c in enumerate(COUNTS) if i},
    }
    return pa.table(columns)


def cell_function(pricing: PricingPolicy, policy: CostPolicy) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda drugs, reference: cell_costs(drugs, reference, pricing, policy)
