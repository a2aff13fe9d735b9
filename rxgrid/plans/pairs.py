"""Beneficiary x plan pairs with the annual cost objective.

Physical shape (the point of this module):

* beneficiaries and their prescriptions are shuffled **once**, by
  ``bene_synth_id`` (a beneficiary with no prescription keeps one empty row);
* the partitions are sized by the pairs their beneficiaries expand into, so
  that a task sorts and aggregates a bounded number of pairs at any scale;
* plans (plan x county rows with their metrics and distance features) are a
  size-checked broadcast: the pair x drug rows are expanded map-side by an
  equi-join on (state, county), so no pair-level data is ever shuffled and a
  county holding a third of all beneficiaries costs no more than any other;
* coverage is looked up once per drug and formulary of the county, before the
  plans of that formulary are expanded;
* formulary, exclusion, cost-rule and insulin maps are size-checked
  broadcasts; where the formulary or the price map is larger, drug rows and
  maps are dealt in cells (block of beneficiaries x block of formularies) and
  meet there before the expansion, so the pair rows still need no shuffle;
* the cost sums of pairs (G14 + G15) need no pair x drug row: drugs, rules and
  prices are dealt to cells of a county's beneficiaries x its plans, and a
  cell's sums are arrays (``operators.paircells``); the rows themselves (G10,
  G12, G13) are made where they are the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxgrid.config import COST, PRICING, CostPolicy, PricingPolicy
from rxgrid.functions.columns import contract_type
from rxgrid.functions.geo import distance_penalty
from rxgrid.functions.joins import broadcast_if_small
from rxgrid.operators import costmodel as G
from rxgrid.operators import paircells
from rxgrid.operators.metrics import active_plans
from rxgrid.session import shared_table

BENE_ATTRS = [
    "bene_state", "bene_county", "bene_zip", "bene_density", "state", "county_code", "zip_code", "risk_segment",
    "unique_drugs", "fills_target", "total_rx_cost_est", "bene_insulin_user",
]
PLAN_ATTRS = [
    "contract_type", "plan_premium", "plan_deductible", "plan_snp", "formulary_total_drugs", "formulary_generic_pct",
    "formulary_specialty_pct", "formulary_pa_rate", "formulary_st_rate", "formulary_ql_rate",
    "formulary_restrictiveness", "network_total_pharmacies", "network_preferred_pharmacies", "network_adequacy_flag",
    "distance_miles", "distance_category", "distance_penalty",
]
OUTPUT_COLUMNS = [
    "bene_synth_id", "bene_state", "bene_county", "bene_zip", "bene_density", "state", "county_code", "zip_code",
    "risk_segment", "unique_drugs", "fills_target", "total_rx_cost_est", "bene_insulin_user", "plan_key",
    "contract_type", "plan_premium", "plan_deductible", "plan_snp", "estimated_annual_oop", "oop_copay_component",
    "oop_coinsurance_component", "oop_deductible_component", "oop_insulin_component", "oop_uncovered_component",
    "covered_drug_count", "uncovered_drug_count", "formulary_total_drugs", "formulary_generic_pct",
    "formulary_specialty_pct", "formulary_pa_rate", "formulary_st_rate", "formulary_ql_rate",
    "formulary_restrictiveness", "network_total_pharmacies", "network_preferred_pharmacies", "network_adequacy_flag",
    "distance_miles", "distance_category", "distance_penalty", "total_annual_cost", "total_cost_with_distance",
    "ranking_cost_objective", "has_distance_tradeoff",
]


@dataclass
class PairInputs:
    beneficiary: DataFrame
    plan_info: DataFrame
    prescriptions: DataFrame
    formulary: DataFrame
    excluded_drugs: DataFrame
    pricing: DataFrame | None
    beneficiary_cost: DataFrame
    insulin_cost: DataFrame
    formulary_metrics: DataFrame | None = None
    network_metrics: DataFrame | None = None
    distance_features: DataFrame | None = None


def beneficiaries(beneficiary: DataFrame, policy: CostPolicy = COST) -> DataFrame:
    """G1 beneficiary side with the documented defaults."""
    return beneficiary.select(
        "bene_synth_id",
        F.col("state").alias("bene_state"),
        F.col("county_code").alias("bene_county"),
        F.col("zip_code").alias("bene_zip"),
        F.col("density").alias("bene_density"),
        "state",
        "county_code",
        "zip_code",
        F.coalesce("risk_segment", F.lit(policy.default_risk)).alias("risk_segment"),
        F.coalesce("unique_drugs", F.lit(policy.default_unique_drugs)).alias("unique_drugs"),
        F.coalesce("fills_target", F.lit(policy.default_fills_target)).alias("fills_target"),
        F.coalesce(F.col("total_rx_cost_est").cast("double"), F.lit(policy.default_total_rx_cost)).alias(
            "total_rx_cost_est"
        ),
        F.coalesce("insulin_user_flag", F.lit(0)).alias("bene_insulin_user"),
    )


def plan_side(inp: PairInputs, policy: CostPolicy = COST) -> DataFrame:
    """G1 plan side: active plan x county rows with formulary / network metrics and the
    distance feature of that county, defaults applied."""
    p = active_plans(inp.plan_info).select(
        "plan_key", "formulary_id", "state", "county_code",
        contract_type("is_ma_pd", "is_pdp").alias("contract_type"),
        F.col("premium").cast("double").alias("plan_premium"),
        F.col("deductible").cast("double").alias("plan_deductible"),
        F.coalesce("snp", F.lit(0)).alias("plan_snp"),
    )
    if inp.formulary_metrics is not None:
        fm = inp.formulary_metrics.select(
            "plan_key", "total_drugs", "generic_tier_pct", "specialty_tier_pct", "pa_rate", "st_rate", "ql_rate",
            "restrictiveness_class",
        )
        p = p.join(broadcast_if_small(fm, bound_from=inp.formulary_metrics), "plan_key", "left")
    else:
        for c in ("total_drugs", "generic_tier_pct", "specialty_tier_pct", "pa_rate", "st_rate", "ql_rate",
                  "restrictiveness_class"):
            p = p.withColumn(c, F.lit(None).cast("double"))
    if inp.network_metrics is not None:
        nm = inp.network_metrics.select("plan_key", "total_pharmacies", "preferred_pharmacies", "network_adequacy_flag")
        p = p.join(broadcast_if_small(nm, bound_from=inp.network_metrics), "plan_key", "left")
    else:
        for c in ("total_pharmacies", "preferred_pharmacies", "network_adequacy_flag"):
            p = p.withColumn(c, F.lit(None).cast("long"))
    if inp.distance_features is not None:
        df = inp.distance_features.select(
            "plan_key", F.col("county_code").alias("_dcounty"), "simulated_distance_miles",
            F.col("distance_category").alias("_dcat"),
        )
        p = p.join(
            broadcast_if_small(df, bound_from=inp.distance_features),
            (p["plan_key"] == df["plan_key"]) & (p["county_code"] == df["_dcounty"]), "left"
        ).drop(df["plan_key"]).drop("_dcounty")
    else:
        p = p.withColumn("simulated_distance_miles", F.lit(None).cast("double")).withColumn(
            "_dcat", F.lit(None).cast("string")
        )
    miles = F.coalesce(F.col("simulated_distance_miles"), F.lit(policy.default_distance_miles))
    return p.select(
        "plan_key", "formulary_id", "state", "county_code", "contract_type", "plan_premium", "plan_deductible",
        "plan_snp",
        F.coalesce(F.col("total_drugs"), F.lit(0)).alias("formulary_total_drugs"),
        F.coalesce(F.col("generic_tier_pct"), F.lit(0)).alias("formulary_generic_pct"),
        F.coalesce(F.col("specialty_tier_pct"), F.lit(0)).alias("formulary_specialty_pct"),
        F.coalesce(F.col("pa_rate"), F.lit(0)).alias("formulary_pa_rate"),
        F.coalesce(F.col("st_rate"), F.lit(0)).alias("formulary_st_rate"),
        F.coalesce(F.col("ql_rate"), F.lit(0)).alias("formulary_ql_rate"),
        F.coalesce(F.col("restrictiveness_class"), F.lit(0)).alias("formulary_restrictiveness"),
        F.coalesce(F.col("total_pharmacies"), F.lit(0)).alias("network_total_pharmacies"),
        F.coalesce(F.col("preferred_pharmacies"), F.lit(0)).alias("network_preferred_pharmacies"),
        F.coalesce(F.col("network_adequacy_flag"), F.lit(0)).alias("network_adequacy_flag"),
        miles.alias("distance_miles"),
        F.coalesce(F.col("_dcat"), F.lit(policy.default_distance_category)).alias("distance_category"),
        distance_penalty(miles).alias("distance_penalty"),
    )


def service_pairs(inp: PairInputs, policy: CostPolicy = COST) -> DataFrame:
    """G1: one row per beneficiary x plan offered (not suppressed) in the beneficiary's county."""
    b = beneficiaries(inp.beneficiary, policy)
    b = b.repartition(pair_partitions(inp.beneficiary, inp.plan_info), "bene_synth_id")
    p = broadcast_if_small(plan_side(inp, policy))
    return b.join(p, ["state", "county_code"])


# A task of anything dealt by beneficiary expands into about this many pairs.
PAIRS_PER_PARTITION = 250_000


def pair_partitions(beneficiary: DataFrame, plan_info: DataFrame) -> int:
    """Partitions of everything dealt by beneficiary: enough for the pairs the beneficiaries expand into, and
    at least the shuffle setting and two a core."""
    spark = beneficiary.sparkSession
    county = ["state", "county_code"]
    b = beneficiary.groupBy(*county).agg(F.count(F.lit(1)).alias("_benes"))
    p = active_plans(plan_info).groupBy(*county).agg(F.count(F.lit(1)).alias("_plans"))
    pairs = b.join(p, county).agg(F.sum(F.col("_benes").cast("double") * F.col("_plans"))).first()[0] or 0.0
    least = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, math.ceil(pairs / PAIRS_PER_PARTITION))


def _partition_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` keys, of which the i-th is hashed to partition i of ``n``; no key comes twice."""
    ids = spark.range(n * (20 + n.bit_length())).select(F.col("id").cast("int").alias("id"))
    keys = dict(ids.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id")).collect())
    # (a partition that no id reached takes another key: its cell shares a partition)
    return [keys.get(i, -1 - i) for i in range(n)]


def _cell_keys(spark: SparkSession, n: int) -> Column:
    """An array of ``n`` keys, of which the i-th is hashed to partition i of ``n``."""
    return F.array(*[F.lit(k) for k in _partition_keys(spark, n)])


@dataclass
class Cells:
    """Cells of (block of beneficiaries, block of formularies), each dealt to a partition of its own.

    Every beneficiary x plan pair belongs to one cell: drug rows are repeated over the formulary blocks and the
    maps over the beneficiary blocks, about the square root of the cells each, and never the pairs."""

    keys: Column
    bene_blocks: int
    form_blocks: int

    @classmethod
    def of(cls, spark: SparkSession, n: int) -> Cells:
        forms = max(1, round(math.sqrt(n)))
        benes = math.ceil(n / forms)
        # planned as what it is: sides dealt by cell are joined on cell and key without another exchange
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        return cls(_cell_keys(spark, benes * forms), benes, forms)

    def form_block(self, formulary_id: Column) -> Column:
        return F.pmod(F.xxhash64(formulary_id), F.lit(self.form_blocks)).cast("int")

    def deal(self, df: DataFrame, bene_block: Column, form_block: Column) -> DataFrame:
        df = df.withColumn("_bb", bene_block).withColumn("_fb", form_block)
        df = df.withColumn("_cell", F.get(self.keys, F.col("_bb") * self.form_blocks + F.col("_fb")))
        return df.drop("_bb").repartition(self.bene_blocks * self.form_blocks, "_cell")

    def deal_drugs(self, drugs: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("bene_synth_id"), F.lit(self.bene_blocks)).cast("int")
        return self.deal(drugs, block, F.explode(F.sequence(F.lit(0), F.lit(self.form_blocks - 1))))

    def deal_map(self, df: DataFrame, form_block: Column) -> DataFrame:
        blocks = F.explode(F.sequence(F.lit(0), F.lit(self.bene_blocks - 1)))
        return self.deal(df, blocks, form_block).drop("_fb").hint("shuffle_hash")


def pair_drug_rows(inp: PairInputs, pricing_policy: PricingPolicy = PRICING, policy: CostPolicy = COST,
                   keep_empty: bool = True, partitions: int | None = None) -> DataFrame:
    """Pair x drug rows with gross cost, coverage, per-fill and annual member cost.

    With ``keep_empty`` every pair of a beneficiary without prescriptions keeps
    one row with a null ndc (so the pair aggregate sees every pair).
    """
    n = partitions or pair_partitions(inp.beneficiary, inp.plan_info)
    b = inp.beneficiary.select("bene_synth_id", "state", "county_code")
    rx = G.normalize_prescriptions(inp.prescriptions)
    drugs = b.join(rx, "bene_synth_id", "left" if keep_empty else "inner")
    # The drug rows are small next to what they expand into (x plans in the
    # county): the partitions are sized by the pairs, and AQE does not coalesce
    # the CPU-heavy expansion and cost expressions into a few tasks.
    fm, pm = G.formulary_map(inp.formulary), None
    fm_small = broadcast_if_small(fm, bound_from=inp.formulary)
    if inp.pricing is not None:
        pm = G.pricing_map(inp.pricing, pricing_policy)
    pm_small = pm if pm is None else broadcast_if_small(pm, bound_from=inp.pricing)
    cells = Cells.of(drugs.sparkSession, n) if fm_small is fm or (pm is not None and pm_small is pm) else None
    drugs = drugs.repartition(n, "bene_synth_id") if cells is None else cells.deal_drugs(drugs)
    by_cell = [] if cells is None else ["_cell"]
    # only what the cost needs travels with the pair x drug rows; the pair
    # attributes are attached after the aggregate (narrow shuffles)
    plans = plan_side(inp, policy).select("plan_key", "formulary_id", "state", "county_code", "plan_deductible")

    # coverage depends on the formulary only: looked up per drug and formulary
    # offered in the county, before the plans of that formulary are expanded
    offered = active_plans(inp.plan_info).select("state", "county_code", "formulary_id").distinct()
    if cells is None:
        rows = drugs.join(broadcast_if_small(offered, bound_from=inp.plan_info), ["state", "county_code"])
    else:
        offered = offered.withColumn("_fb", cells.form_block(F.col("formulary_id")))
        rows = drugs.join(broadcast_if_small(offered, bound_from=inp.plan_info), ["state", "county_code", "_fb"]).drop("_fb")
        fm_small = cells.deal_map(fm, cells.form_block(F.col("formulary_id")))
    rows = rows.join(fm_small, [*by_cell, "formulary_id", "ndc"], "left").withColumn(
        "in_formulary", F.when(F.col("formulary_tier").isNotNull(), 1).otherwise(0)
    ).withColumn("effective_rxcui", F.coalesce("rxcui", "formulary_rxcui"))
    ex = broadcast_if_small(G.excluded_map(inp.excluded_drugs).withColumnRenamed("rxcui", "_ex_rxcui")
                            .withColumnRenamed("formulary_id", "_ex_form"), bound_from=inp.excluded_drugs)
    rows = rows.join(
        ex, (rows["formulary_id"] == ex["_ex_form"]) & (rows["effective_rxcui"] == ex["_ex_rxcui"]), "left"
    )
    rows = rows.withColumns(
        {
            "effective_tier": F.coalesce("formulary_tier", "rx_tier", F.lit(1)),
            "is_excluded": F.when(F.col("_ex_rxcui").isNotNull(), 1).otherwise(0),
            "is_covered": F.when((F.col("in_formulary") == 1) & F.col("_ex_rxcui").isNull(), 1).otherwise(0),
        }
    ).drop("_ex_form", "_ex_rxcui")
    # (plans without a formulary keep their pairs: compared null-safe)
    p = broadcast_if_small(plans.withColumnRenamed("formulary_id", "_form").withColumnRenamed("state", "_state")
                           .withColumnRenamed("county_code", "_county"), bound_from=inp.plan_info)
    rows = rows.join(
        p, (rows["state"] == p["_state"]) & (rows["county_code"] == p["_county"])
        & rows["formulary_id"].eqNullSafe(p["_form"])
    ).drop("_form", "_state", "_county")

    if inp.pricing is not None:
        if cells is not None:
            blocks = plans.select("plan_key", cells.form_block(F.col("formulary_id")).alias("_pfb")).distinct()
            pm = pm.join(broadcast_if_small(blocks, bound_from=inp.plan_info), "plan_key")
            pm_small = cells.deal_map(pm, F.col("_pfb")).drop("_pfb")
        rows = rows.join(pm_small, [*by_cell, "plan_key", "ndc"], "left")
    else:
        for c in ("unit_cost_1", "unit_cost_2", "unit_cost_4", "unit_cost_any"):
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    rows = rows.withColumns(G.gross_cost_columns(pricing_policy)).withColumn(
        "gross_per_fill",
        F.when(
            F.col("fills_per_year") > 0, F.greatest(F.col("annual_gross_cost") / F.col("fills_per_year"), F.lit(0.0))
        ).otherwise(0.0),
    )

    cr = broadcast_if_small(G.cost_rules(inp.beneficiary_cost).withColumnRenamed("tier", "effective_tier"),
                            bound_from=inp.beneficiary_cost)
    rows = rows.join(cr, ["plan_key", "effective_tier", "days_supply_code"], "left")
    ir = G.insulin_rules(inp.insulin_cost)
    ir_exact = broadcast_if_small(
        ir.where(F.col("tier").isNotNull()).select(
            "plan_key", F.col("tier").alias("effective_tier"), "days_supply_code",
            F.col("pref_insulin_copay").alias("_ins_exact"),
        ),
        bound_from=inp.insulin_cost,
    )
    ir_any = broadcast_if_small(
        ir.where(F.col("tier").isNull()).select(
            "plan_key", "days_supply_code", F.col("pref_insulin_copay").alias("_ins_any")
        ),
        bound_from=inp.insulin_cost,
    )
    rows = rows.join(ir_exact, ["plan_key", "effective_tier", "days_supply_code"], "left").join(
        ir_any, ["plan_key", "days_supply_code"], "left"
    )
    rows = rows.withColumns(
        {
            "deductible_applies": F.coalesce("deductible_applies", F.lit(0)),
            "insulin_copay_pref": F.coalesce("_ins_exact", "_ins_any"),
        }
    ).withColumn("per_fill_post_ded_cost", G.per_fill_cost(policy))
    return rows.withColumns(G.annual_cost_columns()).drop("_ins_exact", "_ins_any")


# A cell of the cost sums holds about this many pairs.
PAIRS_PER_CELL = 500_000


def _cost_cells(inp: PairInputs, plans: DataFrame) -> tuple[DataFrame, int]:
    """(state, county_code, bene_blocks, plan_blocks, keys) of every county with plans, and the number of cells.

    A county's pairs are cut into blocks of beneficiaries x blocks of plans, each a cell with a key that is hashed to a
    partition of its own; one short row per county meets the driver, as many as there are counties."""
    county = ["state", "county_code"]
    b = inp.beneficiary.groupBy(*county).agg(F.count(F.lit(1)).alias("benes"))
    p = plans.groupBy(*county).agg(F.count(F.lit(1)).alias("plans"))
    counted = b.join(p, county).collect()
    blocks = []
    for r in counted:
        n = math.ceil(r.benes * r.plans / PAIRS_PER_CELL)
        of_plans = max(1, math.isqrt(n))
        blocks.append((r.state, r.county_code, math.ceil(n / of_plans), of_plans))
    spark = inp.beneficiary.sparkSession
    total = sum(b * p for _, _, b, p in blocks)
    keys = _partition_keys(spark, total) if total else []
    rows, at = [], 0
    for state, code, b, p in blocks:
        rows.append((state, code, b, p, keys[at:at + b * p]))
        at += b * p
    schema = "state string, county_code string, bene_blocks int, plan_blocks int, keys array<int>"
    return F.broadcast(spark.createDataFrame(rows, schema)), max(1, total)


def _in_cells(df: DataFrame, bene_block: Column, plan_block: Column) -> DataFrame:
    df = df.withColumn("_bb", bene_block).withColumn("_pb", plan_block)
    return df.withColumn("_cell", F.get("keys", F.col("_bb") * F.col("plan_blocks") + F.col("_pb")))


def _block(key: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col(blocks)).cast("int")


def _all_blocks(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def _numbered_formularies(plans: DataFrame) -> DataFrame:
    """(formulary_id, form): a number for each formulary of the plans (one short row each, no more than there are formularies)."""
    ids = [r.formulary_id for r in plans.where(F.col("formulary_id").isNotNull()).select("formulary_id").distinct().collect()]
    return broadcast_if_small(plans.sparkSession.createDataFrame(list(zip(sorted(ids), range(len(ids)))), "formulary_id string, form int"))


def _cell_drugs(inp: PairInputs, cells: DataFrame, forms: DataFrame) -> DataFrame:
    """G2, G3 + G4 for the cells: every beneficiary's drugs with the formularies that list the drug (and whether they exclude it
    by their own rxcui) and those that exclude the drug's rxcui."""
    bene = inp.beneficiary.where(F.col("bene_synth_id").isNotNull()).select("bene_synth_id", "state", "county_code")
    rx = G.normalize_prescriptions(inp.prescriptions)
    units = F.greatest(F.coalesce(F.nullif(F.col("qty_per_fill"), F.lit(0.0)), F.col("assumed_units_per_fill")), F.lit(1.0))
    drugs = bene.join(cells, ["state", "county_code"]).join(rx, "bene_synth_id", "left").withColumn(
        "annual_units", F.col("fills_per_year") * units)
    ex = G.excluded_map(inp.excluded_drugs).where(F.col("rxcui").isNotNull()).join(forms, "formulary_id")
    own = ex.select("formulary_id", F.col("rxcui").alias("formulary_rxcui"), F.lit(True).alias("excluded"))
    listed = G.formulary_map(inp.formulary).join(forms, "formulary_id").join(
        broadcast_if_small(own, bound_from=inp.excluded_drugs), ["formulary_id", "formulary_rxcui"], "left")
    entry = F.struct("form", F.col("formulary_tier").alias("tier"), F.coalesce("excluded", F.lit(False)).alias("excluded"))
    listed = listed.groupBy("ndc").agg(F.collect_list(entry).alias("_listed"))
    listed = listed.select("ndc", *[F.col(f"_listed.{c}").alias(f"listed_{c}") for c in ("form", "tier", "excluded")])
    barred = ex.groupBy("rxcui").agg(F.collect_list("form").alias("excluded_from"))
    drugs = drugs.join(listed, "ndc", "left").join(broadcast_if_small(barred, bound_from=inp.excluded_drugs), "rxcui", "left")
    return _in_cells(drugs, _block("bene_synth_id", "bene_blocks"), _all_blocks("plan_blocks")).select(
        "_cell", "bene_synth_id", "state", "county_code", "ndc", "rxcui", "days_supply_code", "days_supply_months", "fills_per_year",
        "annual_units", "annual_gross_cost_fallback", "is_insulin",
        *[_or_empty(drugs, c) for c in ("listed_form", "listed_tier", "listed_excluded", "excluded_from")])


def _or_empty(df: DataFrame, name: str) -> Column:
    """An empty list for none: Arrow's writer goes over a run of null lists again for each of its rows."""
    return F.coalesce(name, F.array().cast(df.schema[name].dataType)).alias(name)


def _cell_reference(inp: PairInputs, plans: DataFrame, cells: DataFrame, forms: DataFrame, pricing_policy: PricingPolicy) -> DataFrame:
    """G5 to G8 for the cells: the plans with their cost and insulin rules, and the prices of each plan."""
    rules = G.cost_rules(inp.beneficiary_cost).groupBy("plan_key").agg(F.collect_list(F.struct(
        "tier", F.col("days_supply_code").alias("code"), F.col("cost_type_pref").alias("type"), F.col("cost_amt_pref").alias("amount"),
        F.col("deductible_applies").alias("ded"))).alias("rules"))
    insulin = G.insulin_rules(inp.insulin_cost).groupBy("plan_key").agg(F.collect_list(F.struct(
        "tier", F.col("days_supply_code").alias("code"), F.col("pref_insulin_copay").alias("copay"))).alias("insulin"))
    placed = plans.join(forms, "formulary_id", "left")
    placed = _in_cells(placed.join(cells, ["state", "county_code"]), _all_blocks("bene_blocks"), _block("plan_key", "plan_blocks"))
    out = placed.join(rules, "plan_key", "left").join(insulin, "plan_key", "left")
    lists = ("rules", "insulin")
    out = out.select(
        "_cell", "plan_key", F.lit(False).alias("is_price"), "form", *[_or_empty(out, c) for c in lists],
        F.lit(None).cast("string").alias("ndc"), *[F.lit(None).cast("double").alias(f"unit_{c}") for c in G.PRICED_CODES])
    if inp.pricing is None:
        return out
    # the unit cost of each days code as the prescriptions take it (0: no price)
    price = G.pricing_map(inp.pricing, pricing_policy)
    unit = [F.coalesce(f"unit_cost_{c}", "unit_cost_any", F.lit(0.0)).alias(f"unit_{c}") for c in G.PRICED_CODES]
    at = placed.select("plan_key", "_cell").distinct()
    price = price.join(broadcast_if_small(at), "plan_key").select(
        "_cell", "plan_key", F.lit(True).alias("is_price"), F.lit(None).cast("int").alias("form"),
        *[F.array().cast(out.schema[c].dataType).alias(c) for c in lists], "ndc", *unit)
    return out.unionByName(price)


def pair_costs(inp: PairInputs, pricing_policy: PricingPolicy = PRICING, policy: CostPolicy = COST,
               partitions: int | None = None, plans: DataFrame | None = None) -> DataFrame:
    """The cost sums of every pair with the beneficiary's attributes.

    The sums are made in cells of a county's beneficiaries x its plans (`operators.paircells`): drugs, rules and prices are dealt
    to the cells, and no pair x drug row is ever made.  ``plans`` is a stored ``plan_side``, where the caller has it."""
    plans = (plan_side(inp, policy) if plans is None else plans).select("plan_key", "formulary_id", "state", "county_code")
    plans = plans.where(F.col("plan_key").isNotNull())
    cells, n = _cost_cells(inp, plans)
    forms = _numbered_formularies(plans)
    # (partitions by number are not put together by their bytes: a cell's work is in its pairs)
    drugs = _cell_drugs(inp, cells, forms).repartition(n, "_cell")
    reference = _cell_reference(inp, plans, cells, forms, pricing_policy).repartition(n, "_cell")
    agg = drugs.groupBy("_cell").cogroup(reference.groupBy("_cell")).applyInArrow(
        paircells.cell_function(pricing_policy, policy), paircells.COST_SCHEMA)
    bene = beneficiaries(inp.beneficiary, policy).drop("state", "county_code")
    small = broadcast_if_small(bene, bound_from=inp.beneficiary)
    if small is not bene:
        return agg.join(small, "bene_synth_id")
    # too many beneficiaries to send: both sides are dealt by beneficiary and hashed per task, unsorted
    n = partitions or pair_partitions(inp.beneficiary, inp.plan_info)
    return agg.repartition(n, "bene_synth_id").join(bene.repartition(n, "bene_synth_id").hint("shuffle_hash"), "bene_synth_id")


def training_pairs(inp: PairInputs, pricing_policy: PricingPolicy = PRICING, policy: CostPolicy = COST,
                   costs: DataFrame | None = None, partitions: int | None = None,
                   plans: DataFrame | None = None) -> DataFrame:
    """The pair table with OOP parts, annual cost, objective and trade-off flag.

    ``costs`` are stored ``pair_costs``, and ``plans`` a stored ``plan_side``, where the caller has them; the plan attributes (a size-checked broadcast)
    are attached where the pairs are read."""
    plans = shared_table(plan_side(inp, policy), "plans") if plans is None else plans
    if costs is None:
        costs = pair_costs(inp, pricing_policy, policy, partitions, plans)
    plans = broadcast_if_small(plans.drop("formulary_id"), bound_from=inp.plan_info)
    agg = costs.join(plans, ["plan_key", "state", "county_code"])
    has_drugs = F.col("_n_drugs") > 0
    fallback = F.least(
        F.col("total_rx_cost_est"),
        F.coalesce(F.col("plan_deductible"), F.lit(0.0)) + F.col("fills_target") * F.lit(policy.fallback_per_fill),
    )
    ded = G.deductible_component(F.col("plan_deductible"))
    oop = F.when(has_drugs, F.col("_post_sum") + ded).otherwise(fallback).cast("double")
    out = agg.withColumns(
        {
            "estimated_annual_oop": oop,
            "oop_deductible_component": F.when(has_drugs, ded).otherwise(0.0),
        }
    )
    for c in ("oop_copay_component", "oop_coinsurance_component", "oop_insulin_component", "oop_uncovered_component"):
        out = out.withColumn(c, F.when(has_drugs, F.col(c)).otherwise(0.0).cast("double"))
    for c in ("covered_drug_count", "uncovered_drug_count"):
        out = out.withColumn(c, F.when(has_drugs, F.col(c)).otherwise(0).cast("int"))
    annual = F.col("plan_premium") * 12.0 + F.col("estimated_annual_oop")
    out = out.withColumns(
        {
            "total_annual_cost": annual.cast("double"),
            "total_cost_with_distance": (annual + F.col("distance_penalty")).cast("double"),
            "ranking_cost_objective": (annual + F.col("distance_penalty")).cast("double"),
            "has_distance_tradeoff": F.coalesce(
                (F.col("estimated_annual_oop") < policy.tradeoff_oop_below)
                & (F.col("distance_miles") > policy.tradeoff_miles_above),
                F.lit(False),
            ),
        }
    )
    return out.select(*OUTPUT_COLUMNS)
