"""Registered bronze / silver / dimension / gold-extra queries (B, C, D3-D11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxgrid.functions import columns as X
from rxgrid.operators import bronze as B
from rxgrid.operators import geo
from rxgrid.operators import gold as GD
from rxgrid.operators import silver as S
from rxgrid.plans.registry import q


@q("B1_plan_key_with_segment")
def b1(ctx):
    return B.with_plan_key(ctx.t("beneficiary_cost")).select(
        "contract_id", "plan_id", "segment_id", "plan_key", "tier", "days_supply", "coverage_level")


@q("B2_plan_key_no_segment")
def b2(ctx):
    return B.with_plan_key(ctx.t("excluded_drugs"), segment=False).select("contract_id", "plan_id", "plan_key", "rxcui")


@q("B3_formulary_id_surrogate")
def b3(ctx):
    return B.with_formulary_id(ctx.t("excluded_drugs").drop("formulary_id")).select("plan_key", "rxcui", "formulary_id")


@q("B5_record_hash")
def b5(ctx):
    cols = ["contract_id", "plan_id", "segment_id", "plan_key", "formulary_id", "state", "county_code",
            "plan_suppressed_yn", "snp"]
    return B.hashed(ctx.t("plan_info").select(*cols)).select("plan_key", "county_code", "record_hash")


@q("B7_formulary_derive")
def b7(ctx):
    return B.formulary(ctx.t("formulary")).select(
        "formulary_id", "ndc", "form_drug_key", "has_quantity_limit", "has_prior_auth", "has_step_therapy",
        "restriction_count", "is_generic_tier", "is_brand_tier", "is_specialty_tier")


@q("B8_excluded_derive")
def b8(ctx):
    return B.excluded_drugs(ctx.t("excluded_drugs")).select(
        "plan_key", "rxcui", "tier", "has_quantity_limit", "has_prior_auth", "has_step_therapy", "has_capped_benefit",
        "completely_excluded", "conditionally_covered")


@q("B9_indication_coverage")
def b9(ctx):
    return B.indications(ctx.t("indication_coverage")).select(
        "plan_key", "rxcui", "disease", "indication_key", "indications_per_drug")


@q("B10_cost_derive")
def b10(ctx):
    return B.beneficiary_cost(ctx.t("beneficiary_cost")).select(
        "cost_key", "cost_min_amt_pref", "cost_min_amt_mail_nonpref", "is_specialty_tier", "deductible_applies",
        "days_supply_label", "coverage_level_label", "cost_type_pref_label", "cost_type_mail_nonpref_label",
        "min_cost", "max_cost", "best_pharmacy_type")


@q("B11_network_derive")
def b11(ctx):
    return B.network(ctx.t("pharmacy_network")).select(
        "network_key", "is_preferred_retail", "is_preferred_mail", "offers_retail", "offers_mail", "is_in_area",
        "avg_brand_fee", "avg_generic_fee", "pharmacy_type")


@q("B17_slv_plan")
def b17(ctx):
    return S.plan(ctx.t("plan_info")).select(
        "plan_key", "county_code", "contract_id", "plan_id", "segment_id", "state", "premium", "deductible",
        "contract_type", "plan_bk")


@q("B19_slv_beneficiary_cost")
def b19(ctx):
    plans = S.plan(ctx.t("plan_info"))
    return S.beneficiary_cost(ctx.t("beneficiary_cost"), plans).select(
        "plan_key", "coverage_level", "tier", "days_supply", "days_supply_label", "cost_amt_pref",
        "cost_min_amt_pref", "cost_min_amt_mail_nonpref", "tier_specialty", "deductible_applies", "cost_key")


@q("B20_slv_pricing")
def b20(ctx):
    plans = S.plan(ctx.t("plan_info"))
    return S.pricing(ctx.t("pricing"), plans).select("plan_key", "ndc", "days_supply", "unit_cost", "pricing_key")


@q("B21_slv_pharmacy_network")
def b21(ctx):
    return S.network(ctx.t("pharmacy_network")).select(
        "plan_bk", "pharmacy_number", "pharmacy_zipcode", "preferred_status_retail", "is_in_area",
        "brand_dispensing_fee_60", "avg_brand_fee", "avg_generic_fee")


@q("B22_slv_basic_formulary")
def b22(ctx):
    return S.formulary(ctx.t("formulary"), ctx.t("insulin_ref")).select(
        "formulary_id", "ndc", "rxcui", "contract_year", "tier_level_value", "quantity_limit_flag", "prior_auth_flag",
        "step_therapy_flag", "restriction_count", "formulary_drug_key", "is_insulin")


@q("B23_slv_insulin_cost")
def b23(ctx):
    return S.insulin_cost(ctx.t("insulin_cost")).select(
        "plan_key", "days_supply", "tier_raw", "tier_int", "tier_scope", "insulin_min_copay_all_channels",
        "insulin_max_copay_all_channels", "days_supply_label", "exceeds_cap_flag")


@q("B24_drug_access_rules")
def b24(ctx):
    return S.access_rules(ctx.t("excluded_drugs")).select(
        "plan_key", "rxcui_norm", "pa", "st", "ql", "cap_benefit", "drug_access_status", "restriction_score")


@q("B29_county_code_normalize")
def b29(ctx):
    z = ctx.t("zipcode")
    return z.select("zip_code", X.county_code5(F.col("zip_code")).alias("county5"),
                    X.county_code5(F.concat(F.col("zip_code").cast("int").cast("string"), F.lit(".0"))).alias("county5_float"))


@q("B32_dim_zipcode")
def b32(ctx):
    return geo.dim_zipcode(ctx.zip_county)


@q("B35_days_supply_buckets")
def b35(ctx):
    rx = ctx.t("prescriptions")
    d = F.col("days_supply_mode")
    return rx.select("bene_synth_id", "ndc", X.days_supply_code(d).alias("days_supply_code"),
                     X.days_supply_months(d).alias("days_supply_months"),
                     X.days_supply_units(d).alias("assumed_units_per_fill"))


@q("C1_dim_plan")
def c1(ctx):
    return GD.dim_plan(ctx.t("plan_info"))


@q("C2_dim_geography")
def c2(ctx):
    return GD.dim_geography(ctx.t("geographic"))


@q("C3_dim_drug")
def c3(ctx):
    return GD.dim_drug(ctx.t("formulary"), ctx.t("pricing"))


@q("C4_dim_days_supply")
def c4(ctx):
    return GD.dim_days_supply(ctx.t("beneficiary_cost"), ctx.t("pricing"))


@q("C5_dim_tier")
def c5(ctx):
    return GD.dim_codes(ctx.t("beneficiary_cost"), "tier", "tier")


@q("C6_dim_coverage_level")
def c6(ctx):
    return GD.dim_codes(ctx.t("beneficiary_cost"), "coverage_level", "coverage_level")


@q("C7_dim_pharmacy")
def c7(ctx):
    return GD.dim_pharmacy(ctx.t("pharmacy_network"))


@q("C9_fact_pricing_unit_cost")
def c9(ctx):
    return GD.safe_select(ctx.t("pricing"), ["plan_key", "ndc", "days_supply", "unit_cost", "not_a_column"])


@q("D3_cost_metrics")
def d3(ctx):
    return GD.cost_metrics(ctx.t("beneficiary_cost"))


@q("D5_cost_metrics_approx")
def d5(ctx):
    return GD.cost_metrics_approx(ctx.t("beneficiary_cost"))


def _slv_form(ctx):
    return S.formulary(ctx.t("formulary"), ctx.t("insulin_ref"))


@q("D6_formulary_metrics_nb")
def d6(ctx):
    return GD.formulary_metrics_nb(ctx.t("plan_info"), _slv_form(ctx))


@q("D7_network_metrics_nb")
def d7(ctx):
    return GD.network_metrics_nb(
        S.network(ctx.t("pharmacy_network")).withColumn(
            "plan_key", F.concat("contract_id", "plan_id", "segment_id")))


@q("D8_pricing_metrics")
def d8(ctx):
    return GD.pricing_metrics(ctx.t("pricing"))


@q("D9_insulin_cost_metrics")
def d9(ctx):
    return GD.insulin_cost_metrics(S.insulin_cost(ctx.t("insulin_cost")))


@q("D10_insulin_access_metrics")
def d10(ctx):
    return GD.insulin_access_metrics(ctx.t("plan_info"), _slv_form(ctx))


@q("D11_insulin_friendliness")
def d11(ctx):
    cost = GD.insulin_cost_metrics(S.insulin_cost(ctx.t("insulin_cost")))
    return GD.insulin_friendliness(cost, GD.insulin_access_metrics(ctx.t("plan_info"), _slv_form(ctx)))
