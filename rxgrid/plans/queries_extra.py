"""Registered remaining expression-level and projection operators (A4, A5, A13, B6, B18, B25,
B27, B28, B30, C8, C10, C11, J20, J22, J26)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rxgrid.functions.columns import clean_ndc, contract_type
from rxgrid.operators import bronze as B
from rxgrid.operators import decision as J
from rxgrid.operators import drugs as L
from rxgrid.operators import geo
from rxgrid.operators import gold as GD
from rxgrid.operators import silver as S
from rxgrid.plans.registry import q
from rxgrid.sources import io, layout, schemas


@q("A4_zip_csv_ingest")
def a4(ctx):
    path = io.write_delimited(ctx.t("zipcode"), io.scratch_path(ctx.spark, "zip-csv"), sep=",", encoding="utf-8")
    raw = ctx.spark.read.schema(schemas.ZIPCODE).option("header", True).csv(path)
    # the raw ZIP file carries no county code; it is resolved by (state, county name)
    return geo.resolve_zip_county(raw.withColumn("county_code", F.lit(None).cast("string")), ctx.t("geographic"))


@q("A5_insulin_ref_ingest")
def a5(ctx):
    ref = ctx.t("insulin_ref").withColumn("row_index", F.monotonically_increasing_id())
    path = io.write_delimited(ref, io.scratch_path(ctx.spark, "insulin-csv"), sep=",", encoding="utf-8")
    raw = ctx.spark.read.option("header", True).csv(path)  # every column as text
    return raw.drop("row_index").where(F.col("is_insulin") == "1").select("ndc", "rxcui", "source", "source_year", "is_insulin")


@q("A13_layout_by_key")
def a13(ctx):
    out = io.migrate_table(ctx.spark, _land(ctx, "formulary"), io.scratch_path(ctx.spark, "formulary-z"),
                           sort_keys=["formulary_id", "ndc"])
    return out.select("formulary_id", "ndc", "rxcui", "tier_level_value")


@q("A13_curve_layout")
def a13_curve(ctx):
    """The network clustered along a space-filling curve over three of its columns: the content does not change."""
    return _curve(ctx).select("plan_key", "pharmacy_number", "pharmacy_zipcode", "floor_price")


@q("A13_files_per_lookup")
def a13_files(ctx):
    return layout.files_per_lookup(_curve(ctx), ["plan_key", "pharmacy_number", "pharmacy_zipcode"])


def _curve(ctx):
    key = "_curve"
    if key not in ctx.__dict__:
        at = io.scratch_path(ctx.spark, "network-curve")
        ctx.__dict__[key] = layout.write_clustered(ctx.t("pharmacy_network"), at, ["plan_key", "pharmacy_number", "pharmacy_zipcode"], 64)
    return ctx.__dict__[key]


def _land(ctx, name):
    p = io.scratch_path(ctx.spark, f"{name}-src")
    ctx.t(name).write.parquet(p)
    return p


@q("B6_region_codes_numeric")
def b6(ctx):
    return B.numeric_codes(ctx.t("plan_info").select("plan_key", "county_code", "ma_region_code", "pdp_region_code"))


@q("B18_slv_geography")
def b18(ctx):
    return S.geography(ctx.t("geographic")).select("county_code", "statename", "county", "ma_region_code", "pdp_region_code")


@q("B25_ndc11_from_formatted")
def b25(ctx):
    rx = ctx.t("prescriptions").select("ndc").distinct()
    fmt = F.concat(F.expr("substring(ndc, 2, 4)"), F.lit("-"), F.expr("substring(ndc, 6, 4)"), F.lit("-"),
                   F.expr("substring(ndc, 10, 2)"))
    return rx.select("ndc", fmt.alias("formatted"), L.ndc11(fmt).alias("ndc11"))


@q("B27_insulin_drug_ref")
def b27(ctx):
    ins = ctx.t("insulin_ref").where(F.col("ndc").isNotNull()).select("ndc").dropDuplicates()
    pairs_ = ctx.t("formulary").select("ndc", "rxcui").dropDuplicates()
    return ins.join(pairs_, "ndc", "left")


@q("B28_B30_clean_keys")
def b28(ctx):
    p = ctx.t("pharmacy_network").select("plan_key", "pharmacy_zipcode").distinct()
    pi = ctx.t("plan_info").select("plan_key", "is_ma_pd", "is_pdp").distinct()
    return p.join(pi, "plan_key").select(
        "plan_key", clean_ndc(F.concat(F.col("pharmacy_zipcode"), F.lit("-"), F.lit(" 01"))).alias("cleaned"),
        contract_type("is_ma_pd", "is_pdp").alias("contract_type"),
        contract_type("is_ma_pd", "is_pdp", "Other").alias("contract_type_other"))


@q("C8_fact_beneficiary_cost")
def c8(ctx):
    return GD.safe_select(ctx.t("beneficiary_cost"), ["plan_key", "coverage_level", "tier", "days_supply",
                                                      "cost_type_pref", "cost_amt_pref", "ded_applies_yn", "missing_col"])


@q("C10_fact_pharmacy_network")
def c10(ctx):
    return GD.safe_select(ctx.t("pharmacy_network"), ["plan_key", "pharmacy_number", "pharmacy_zipcode",
                                                      "preferred_status_retail", "in_area_flag", "floor_price"])


@q("C11_fact_formulary_drug")
def c11(ctx):
    return GD.safe_select(ctx.t("formulary"), ["formulary_id", "ndc", "rxcui", "tier_level_value",
                                               "prior_authorization_yn", "step_therapy_yn", "quantity_limit_yn"])


@q("J20_request_bundle")
def j20(ctx):
    req = ctx.t("requests")
    views = ctx.by_beneficiary()
    prof = J.effective_profile(req, views("beneficiary"), J.medication_lists(views("request_medications")))
    pref = req.select("request_id", F.struct("ml_influence_pct", "cost_priority", "access_priority", "coverage_priority",
                                              "distance_penalty_rate", "min_drug_coverage_pct", "local_only")
                      .alias("preference_weights"))
    fields = [c for c in prof.columns if c not in ("request_id", "medication_list")]
    p = prof.select("request_id", F.struct(*fields).alias("profile"), "medication_list")
    return p.join(pref, "request_id").select(
        "request_id", F.to_json(F.struct("profile", "medication_list", "preference_weights")).alias("bundle"))


@q("J22_county_plans_by_premium")
def j22(ctx):
    p = ctx.t("plan_info").where(F.col("plan_suppressed_yn") != "Y").select(
        "state", "county_code", "plan_key", "plan_name", "premium", "deductible")
    w = Window.partitionBy("state", "county_code").orderBy(F.col("premium").asc_nulls_last(), "plan_key")
    return p.withColumn("premium_rank", F.row_number().over(w))


@q("J26_side_by_side_top5")
def j26(ctx):
    from rxgrid.plans.queries_decision import _scored
    from rxgrid.plans.queries_geo_claims import _nearby

    local = J.recommendation_schema(_scored(ctx)).where(F.col("rank") <= 5).select(
        "request_id", F.col("rank").alias("Rank"), F.col("plan_key").alias("Plan"),
        F.col("estimated_total_annual_cost").alias("Estimated annual total"), F.lit("local").alias("Source"))
    comp = geo.nearby_comparison_plans(ctx.t("requests"), _nearby(ctx), ctx.t("plan_info"))
    w = Window.partitionBy("request_id").orderBy(F.col("distance_miles"), F.col("premium"), F.col("plan_key"))
    near = comp.withColumn("Rank", F.row_number().over(w)).where(F.col("Rank") <= 5).select(
        "request_id", "Rank", F.col("plan_key").alias("Plan"), (F.col("premium") * 12).alias("Estimated annual total"),
        F.lit("nearby").alias("Source"))
    return local.unionByName(near)


@q("B4_B5_ingest_metadata")
def b4(ctx):
    """Load metadata (B4: timestamps, so rows only) and the business-column record hash."""
    return B.hashed(B.stamped(ctx.t("pricing"), "pricing", 2025, "Q3")).select(
        "plan_key", "ndc", "days_supply", "contract_year", "contract_quarter", "source_filename", "ingestion_ts",
        "record_hash")


@q("B12_snake_case_columns")
def b12(ctx):
    """CMS-style upper / camel-case headers renamed in one projection."""
    raw = ctx.t("plan_info").toDF(*[c.upper() if i % 2 else "".join(w.title() for w in c.split("_"))
                                    for i, c in enumerate(ctx.t("plan_info").columns)])
    return S.snake_columns(raw)
