"""Registered geography / access and claims queries (E, D14-D20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxgrid.functions.geo import (acos_miles, distance_category_display, distance_category_training,
                                  distance_penalty, haversine_miles)
from rxgrid.operators import claims as D
from rxgrid.operators import decision as J
from rxgrid.operators import drugs as L
from rxgrid.operators import geo
from rxgrid.operators import sampling as S
from rxgrid.plans.registry import q
from rxgrid.session import shared_table


def _bene_pharmacy(ctx):
    """Each beneficiary's ZIP against each pharmacy ZIP of its plans' networks is too wide;
    the distance expressions are exercised on beneficiary ZIP -> county centroid pairs."""
    b = ctx.t("beneficiary").select("bene_synth_id", "zip_code", "lat", "lng", "state")
    cent = geo.county_centroids(ctx.zip_county)
    return b.join(F.broadcast(cent), "state")


@q("E1_E2_distances")
def e1(ctx):
    j = _bene_pharmacy(ctx)
    return j.select("bene_synth_id", "county_code",
                    haversine_miles(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng")).alias("haversine_miles"),
                    acos_miles(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng")).alias("acos_miles"))


@q("E7_E8_distance_classes")
def e7(ctx):
    d = ctx.distance_features.select("plan_key", "county_code", F.col("simulated_distance_miles").alias("m"))
    return d.select("plan_key", "county_code", distance_category_training(F.col("m")).alias("training_category"),
                    distance_category_display(F.col("m")).alias("display_category"),
                    distance_penalty(F.col("m")).alias("penalty"),
                    distance_penalty(F.col("m"), 75.0).alias("penalty_weight_75"))


def _nearby(ctx):
    key = "_nearby"
    if key not in ctx.__dict__:
        origins = ctx.t("requests").select(F.col("request_id").alias("origin_id"), "zip_code")
        ctx.__dict__[key] = shared_table(geo.nearby_counties(ctx.zip_county, origins, 50.0), "nearby")
    return ctx.__dict__[key]


@q("E3_nearby_counties")
def e3(ctx):
    return _nearby(ctx)


@q("E6_county_pharmacy_links")
def e6(ctx):
    return geo.county_pharmacy_links(ctx.t("plan_info"), ctx.t("pharmacy_network"), ctx.zip_county).select(
        "county_code", "plan_key", "pharmacy_number", "pharmacy_zipcode", "premium", "is_preferred_retail")


@q("D19_county_pharmacy_summary")
def d19(ctx):
    links = geo.county_pharmacy_links(ctx.t("plan_info"), ctx.t("pharmacy_network"), ctx.zip_county)
    return geo.county_pharmacy_summary(links).select("county_code", "pharmacy_number", "plans_served",
                                                      "preferred_plan_links", "avg_premium", "sample_plan_names", "rank")


@q("D20_county_access_headline")
def d20(ctx):
    links = geo.county_pharmacy_links(ctx.t("plan_info"), ctx.t("pharmacy_network"), ctx.zip_county)
    return geo.county_access_headline(geo.county_pharmacy_summary(links))


@q("E10_representative_zip")
def e10(ctx):
    return geo.representative_zip(ctx.zip_county)


@q("E12_nearby_comparison_plans")
def e12(ctx):
    return geo.nearby_comparison_plans(ctx.t("requests"), _nearby(ctx), ctx.t("plan_info")).select(
        "request_id", "plan_key", "distance_miles", "eligibility_status", "location_county")


@q("E11_plans_with_fallback")
def e11(ctx):
    local = J.candidate_plans(ctx.t("requests"), ctx.t("plan_info"), ctx.formulary_metrics, ctx.network_metrics)
    comp = geo.nearby_comparison_plans(ctx.t("requests"), _nearby(ctx), ctx.t("plan_info"))
    return geo.plans_with_fallback(local, comp).select("request_id", "plan_key", "is_local", "distance_miles")


def _claims(ctx):
    return ctx.t("pde_events")


@q("D14_pde_drug_stats")
def d14(ctx):
    return D.drug_stats(_claims(ctx))


@q("D15_bene_drug_profile")
def d15(ctx):
    return D.bene_drug_profile(_claims(ctx))


@q("D16_prescriptions_from_claims")
def d16(ctx):
    names = S.best_rxcui_names(ctx.t("drug_names").select(
        "rxcui", F.col("drug_name").alias("name"), F.col("drug_synonym").alias("synonym"), "tty"))
    pool = L.formulary_drug_pool(ctx.t("formulary"), ctx.t("insulin_ref"))
    return D.prescriptions_from_claims(D.bene_drug_profile(_claims(ctx)), pool, names.drop("tty"))


@q("D17_bene_year_summary")
def d17(ctx):
    return D.bene_year_summary(_claims(ctx), ctx.t("insulin_ref").where(F.col("ndc").isNotNull()))


@q("D18_aligned_beneficiaries")
def d18(ctx):
    return D.align_beneficiaries(ctx.t("beneficiary"), ctx.t("prescriptions")).select(
        "bene_synth_id", "unique_drugs", "fills_target", "total_rx_cost_est", "insulin_user_flag", "risk_segment")
