"""Registered source / sink, streaming and data-quality queries (A, P, M, G17)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from rxgrid.operators import quality as M
from rxgrid.operators import sampling as S
from rxgrid.plans.registry import q
from rxgrid.sources import io
from rxgrid.sources import ledger
from rxgrid.sources import schemas
from rxgrid.streaming import incremental as P

EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@q("A1_delimited_roundtrip")
def a1(ctx):
    path = io.write_delimited(ctx.t("plan_info").select(*schemas.PLAN_INFO.fieldNames()),
                              io.scratch_path(ctx.spark, "plan-info-txt"))
    return io.read_source(ctx.spark, path, schemas.PLAN_INFO)


@q("A3_migrate_table")
def a3(ctx):
    src = io.scratch_path(ctx.spark, "pricing-src")
    ctx.t("pricing").write.parquet(src)
    out = io.migrate_table(ctx.spark, src, io.scratch_path(ctx.spark, "pricing-bronze"),
                           transform=lambda d: d.withColumn("pricing_key", F.concat_ws("|", "plan_key", "ndc", "days_supply")),
                           sort_keys=["plan_key", "ndc"])
    return out.select("plan_key", "ndc", "days_supply", "unit_cost", "pricing_key")


@q("A6_shard_union")
def a6(ctx):
    names = ctx.t("drug_names")
    parts = [names.select("rxcui", "drug_name", "tty"), names.select("rxcui", "drug_synonym", "ndc"), names.select("drug_name", "tty")]
    paths = [io.write_delimited(p, io.scratch_path(ctx.spark, "shard")) for p in parts]
    table, _ = io.read_shards(ctx.spark, [*paths, io.scratch_path(ctx.spark, "no-shard")])
    return table.select("rxcui", "drug_name", "tty", "drug_synonym", "ndc")


@q("A7_claims_file")
def a7(ctx):
    ev = ctx.t("pde_events").select("bene_id", "prod_srvc_id", F.date_format("srvc_dt", "dd-MMM-yyyy").alias("srvc_dt"),
                                    "days_suply_num", "qty_dspnsd_num", "tot_rx_cst_amt")
    path = io.write_delimited(ev, io.scratch_path(ctx.spark, "pde-txt"), encoding="utf-8")
    return io.read_claims(ctx.spark, path)


@q("A9_insert_only_merge")
def a9(ctx):
    ev = ctx.t("events").select(*EVENT_COLS)
    # first delivery: the first half of the time range; then the whole table is re-delivered
    mid = ev.agg(((F.unix_timestamp(F.min("ts")) + F.unix_timestamp(F.max("ts"))) / 2).alias("m")).first()["m"]
    first = io.with_meta_and_hash(ev.where(F.unix_timestamp("ts") < F.lit(mid)), "events_part1")
    target = io.scratch_path(ctx.spark, "events-target")
    ledger.append(first, target, "part1")
    ledger.append(io.with_meta_and_hash(ev, "events_full"), target, "full")  # re-delivery of everything
    ledger.append(io.with_meta_and_hash(ev, "events_full"), target, "full")  # the same load, run again
    return ledger.read(ctx.spark, target).select(*EVENT_COLS)


@q("A10_enrich_in_place")
def a10(ctx):
    assigned, _ = S.assign_population_weighted_zips(ctx.t("beneficiary"), ctx.zip_county, seed=17)
    base = ctx.t("beneficiary").select("bene_synth_id", "state", "county_code", "zip_code", "lat")
    return io.enrich_in_place(base, assigned, "bene_synth_id", ["zip_code", "lat", "lng", "density"])


@q("A11_export_nested")
def a11(ctx):
    from rxgrid.operators import decision as J
    from rxgrid.plans.queries_decision import _scored

    s = J.recommendation_schema(_scored(ctx)).select("request_id", "plan_key", "cost_breakdown", "warning_flags")
    path = io.export_csv(s, io.scratch_path(ctx.spark, "reco-csv"))
    return ctx.spark.read.option("header", True).csv(path)


@q("A12_table_info")
def a12(ctx):
    out = None
    for name in ("plan_info", "formulary", "pricing", "pharmacy_network", "beneficiary", "prescriptions"):
        t = io.table_info(ctx.spark, ctx.t(name), name)
        out = t if out is None else out.unionByName(t)
    return out


def _feed(ctx):
    key = "_feed"
    if key not in ctx.__dict__:
        src = io.scratch_path(ctx.spark, "events-feed")
        P.split_by_day(ctx.t("events").select(*EVENT_COLS), "ts", src)
        schema = StructType(ctx.t("events").select(*EVENT_COLS).schema.fields + [StructField("day", DateType())])
        ctx.__dict__[key] = (src, schema)
    return ctx.__dict__[key]


@q("P1_incremental_insert_only")
def p1(ctx):
    src, schema = _feed(ctx)
    base = io.scratch_path(ctx.spark, "p1")
    P.incremental_insert_only(ctx.spark, src, schema, os.path.join(base, "target"), os.path.join(base, "ckpt"))
    # a second run over the same feed appends nothing
    P.incremental_insert_only(ctx.spark, src, schema, os.path.join(base, "target"), os.path.join(base, "ckpt"))
    return ledger.read(ctx.spark, os.path.join(base, "target")).select(*EVENT_COLS)


@q("P2_incremental_daily_summary")
def p2(ctx):
    src, schema = _feed(ctx)
    base = io.scratch_path(ctx.spark, "p2")
    P.incremental_daily_summary(ctx.spark, src, schema, os.path.join(base, "target"), os.path.join(base, "ckpt"))
    return P.daily_summary(ctx.spark, os.path.join(base, "target"))


@q("M1_beneficiary_profile_stats")
def m1(ctx):
    return M.beneficiary_profile_stats(ctx.t("beneficiary"))


@q("M2_required_columns")
def m2(ctx):
    return M.required_columns(ctx.spark, ctx.t("beneficiary"), "beneficiary")


@q("G17_pair_statistics")
def g17(ctx):
    return M.pair_statistics(ctx.training_pairs)


@q("M4_source_rule_violations")
def m4(ctx):
    return M.source_rule_violations(ctx.t("beneficiary_cost"), ctx.t("pricing"), ctx.t("pharmacy_network"),
                                    ctx.t("plan_info"))


@q("M5_risk_distribution")
def m5(ctx):
    return M.distribution_checks(ctx.t("beneficiary"), "risk_segment")


@q("M6_tradeoff_top_plans")
def m6(ctx):
    return M.tradeoff_top_plans(ctx.training_pairs, 10)


@q("M6_rates_by_restrictiveness")
def m6b(ctx):
    return M.rates_by_restrictiveness(ctx.formulary_metrics)


@q("M6_formulary_network_by_plan")
def m6c(ctx):
    return M.formulary_network_by_plan(ctx.formulary_metrics, ctx.network_metrics)


@q("M7_pair_geography_mismatches")
def m7(ctx):
    return M.pair_geography_mismatches(ctx.training_pairs, ctx.t("plan_info"))
