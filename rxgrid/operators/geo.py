"""Geography and access operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxgrid.functions.columns import contract_type, county_code5
from rxgrid.functions.draws import stable_uniform
from rxgrid.functions import grid
from rxgrid.functions.geo import distance_category_training, haversine_miles
from rxgrid.functions.joins import broadcast_if_small
from rxgrid.operators.metrics import active_plans
from rxgrid.session import shared_table

DEFAULT_DISTANCE_SEED = 42


def resolve_zip_county(zipcode: DataFrame, geographic: DataFrame) -> DataFrame:
    """Give every ZIP row the county code of its (state, county name).

    Equi-join on the cleaned county name with the state as a residual
    condition (a county without a state label matches on name alone); when a
    name still matches several counties the smallest code wins.
    """
    g = broadcast_if_small(
        geographic.select(
            F.upper(F.trim("county")).alias("_cname"),
            F.col("state_label").alias("_gstate"),
            F.col("county_code").alias("_gcode"),
        )
    )
    z = zipcode.withColumn("_cname", F.upper(F.trim("county")))
    on = (z["_cname"] == g["_cname"]) & (g["_gstate"].isNull() | (g["_gstate"] == z["state"]))
    j = z.join(g, on, "left").drop(g["_cname"])
    w = Window.partitionBy("zip_code").orderBy(
        F.when(F.col("_gstate") == F.col("state"), 0).otherwise(1), F.col("_gcode").asc_nulls_last()
    )
    j = j.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    base_cols = [c for c in zipcode.columns if c != "county_code"]
    return j.select(*base_cols, F.col("_gcode").alias("county_code"))


def dim_zipcode(zipcode: DataFrame) -> DataFrame:
    """ZIP dimension with density category (urban >= 1000, suburban >= 250, else rural)."""
    d = F.coalesce(F.col("density").cast("double"), F.lit(0.0))
    return zipcode.select(
        "zip_code", "city", "state", "county", "county_code", "lat", "lng",
        F.coalesce(F.col("population").cast("long"), F.lit(0)).alias("population"),
        d.alias("density"),
        F.when(d >= 1000, "urban").when(d >= 250, "suburban").otherwise("rural").alias("density_category"),
    )


def county_density(zip_with_county: DataFrame) -> DataFrame:
    """Average density (null as 0) and ZIP count per county."""
    return (
        zip_with_county.where(F.col("county_code").isNotNull())
        .groupBy(F.col("county_code").cast("string").alias("county_code"))
        .agg(
            F.avg(F.coalesce(F.col("density").cast("double"), F.lit(0.0))).alias("avg_density"),
            F.count(F.lit(1)).alias("zip_count"),
        )
    )


def plan_counties(plan_info: DataFrame) -> DataFrame:
    return (
        active_plans(plan_info)
        .where(F.col("state").isNotNull() & F.col("county_code").isNotNull())
        .select(
            "plan_key",
            contract_type("is_ma_pd", "is_pdp").alias("contract_type"),
            F.col("state").cast("string").alias("state"),
            F.col("county_code").cast("string").alias("county_code"),
        )
        .distinct()
    )


def plan_distance_features(
    plan_info: DataFrame, county_dens: DataFrame, network_metrics: DataFrame, seed: int = DEFAULT_DISTANCE_SEED
) -> DataFrame:
    """Keyed distance proxy per (plan, county) from density and network size.

    Defaults: preferred pharmacies PDP 25 / MA 15 / else 20, total 30,
    preferred share 50, in-area 20, density 100, ZIP count 1.  The draw is
    F2 keyed by ``plan_key|county_code`` and rounded to 6 places.
    """
    pc = plan_counties(plan_info).withColumn("county_code", county_code5("county_code")).where(
        F.col("county_code") != ""
    )
    cd = county_dens.withColumn("county_code", county_code5("county_code")).dropDuplicates(["county_code"])
    nm = network_metrics.select(
        "plan_key", "preferred_pharmacies", "total_pharmacies", "pref_pharmacy_pct", "in_area_pharmacies"
    ).dropDuplicates(["plan_key"])
    m = pc.join(broadcast_if_small(cd), "county_code", "left").join(broadcast_if_small(nm), "plan_key", "left")
    default_pref = F.when(F.col("contract_type") == "PDP", 25.0).when(F.col("contract_type") == "MA", 15.0).otherwise(20.0)
    m = m.withColumns(
        {
            "county_avg_density": F.coalesce(F.col("avg_density").cast("double"), F.lit(100.0)),
            "county_zip_count": F.coalesce(F.col("zip_count").cast("int"), F.lit(1)),
            "preferred_pharmacies": F.greatest(
                F.coalesce(F.col("preferred_pharmacies").cast("double"), default_pref), F.lit(0.0)
            ),
            "total_pharmacies": F.greatest(F.coalesce(F.col("total_pharmacies").cast("double"), F.lit(30.0)), F.lit(0.0)),
            "pref_pharmacy_pct": F.coalesce(F.col("pref_pharmacy_pct").cast("double"), F.lit(50.0)),
            "in_area_pharmacies": F.coalesce(F.col("in_area_pharmacies").cast("double"), F.lit(20.0)),
        }
    )
    dens, pref = F.col("county_avg_density"), F.col("preferred_pharmacies")
    low = (
        F.when((dens >= 1000.0) & (pref >= 20.0), 0.5)
        .when((dens >= 250.0) & (dens < 1000.0) & (pref >= 10.0), 2.0)
        .when((dens < 250.0) | (pref < 10.0), 8.0)
        .otherwise(5.0)
    )
    high = (
        F.when((dens >= 1000.0) & (pref >= 20.0), 2.0)
        .when((dens >= 250.0) & (dens < 1000.0) & (pref >= 10.0), 8.0)
        .when((dens < 250.0) | (pref < 10.0), 25.0)
        .otherwise(15.0)
    )
    key = F.concat_ws("|", "plan_key", "county_code")
    miles = F.bround(stable_uniform(key, low, high, seed), 6)
    m = m.withColumn("simulated_distance_miles", miles)
    return m.select(
        "plan_key", "contract_type", "state", "county_code", "county_avg_density", "county_zip_count",
        "preferred_pharmacies", "total_pharmacies", "pref_pharmacy_pct", "in_area_pharmacies",
        "simulated_distance_miles",
        distance_category_training(F.col("simulated_distance_miles")).alias("distance_category"),
    )


def county_centroids(zip_with_county: DataFrame) -> DataFrame:
    """County centroid = average ZIP latitude / longitude."""
    return (
        zip_with_county.where(F.col("county_code").isNotNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .groupBy("county_code", "county", "state")
        .agg(F.avg("lat").alias("c_lat"), F.avg("lng").alias("c_lng"))
    )


def nearby_counties(zip_with_county: DataFrame, origins: DataFrame, radius_miles: float = 50.0, digits: int | None = 1) -> DataFrame:
    """For many origin ZIPs at once, counties of the same state whose centroid is within
    ``radius_miles`` (acos distance in miles, rounded as published before the comparison).

    ``origins`` has (origin_id, zip_code).  Origins meet the centroids of near grid cells only.
    """
    at = zip_with_county.select("zip_code", "state", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    o = origins.select("origin_id", "zip_code").join(at, "zip_code").drop("zip_code")
    near = grid.within(o, county_centroids(zip_with_county), radius_miles, ["state"], digits, ("_lat", "_lng"), ("c_lat", "c_lng"))
    return near.select("origin_id", "county_code", "county", "state", "distance_miles")


def pharmacies_by_zip(pharmacy_network: DataFrame, zipcode: DataFrame, pharmacy_type: str | None = None, retail_only: bool = True) -> DataFrame:
    """(plan_key, p_zip, n_pharmacies, n_preferred, p_lat, p_lng): a plan's pharmacies counted per ZIP.

    ``pharmacy_type`` filters on the derived type (T7); by default every retail-offering pharmacy counts.
    """
    from rxgrid.operators import bronze

    net = bronze.network(pharmacy_network)
    if pharmacy_type:
        net = net.where(F.col("pharmacy_type") == pharmacy_type)
    elif retail_only:
        net = net.where(F.col("offers_retail"))
    per_zip = net.groupBy("plan_key", F.col("pharmacy_zipcode").alias("p_zip")).agg(
        F.count(F.lit(1)).alias("n_pharmacies"),
        F.sum(F.when(F.col("is_preferred_retail"), 1).otherwise(0)).alias("n_preferred"),
    )
    at = zipcode.select(F.col("zip_code").alias("p_zip"), F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    return per_zip.join(at, "p_zip")


def _origins(origins: DataFrame, zipcode: DataFrame) -> DataFrame:
    return origins.select("zip_code", "plan_key").distinct().join(zipcode.select("zip_code", "lat", "lng"), "zip_code")


def zip_pharmacy_distances(origins: DataFrame, pharmacy_network: DataFrame, zipcode: DataFrame,
                           pharmacy_type: str | None = None, retail_only: bool = True) -> DataFrame:
    """Distance from each origin ZIP to every in-network pharmacy ZIP of its candidate plans.

    ``origins`` has (zip_code, plan_key), one row per distinct pair (requests sharing a ZIP share the
    work); distances are between ZIP centroids, rounded to cents of a mile as published.  The result is
    all pairs by definition: a plan's share of them is dealt by the cells of its pharmacies.
    """
    per_zip = pharmacies_by_zip(pharmacy_network, zipcode, pharmacy_type, retail_only)
    return grid.all_pairs(_origins(origins, zipcode), per_zip, "plan_key", digits=2).select(
        "zip_code", "plan_key", "p_zip", "n_pharmacies", "n_preferred", "distance_miles"
    )


def plan_access(origins: DataFrame, pharmacy_network: DataFrame, zipcode: DataFrame) -> DataFrame:
    """E5 without the mean: per (origin ZIP, plan) the nearest preferred pharmacy (999 when none; rings
    that grow until it is found), preferred within 5 / 10 miles, all within 10 miles, and the
    accessibility score min(100, 100 / (1 + nearest / 5) + min(50, 5 * preferred within 10))."""
    keys = ["zip_code", "plan_key"]
    per_zip = shared_table(pharmacies_by_zip(pharmacy_network, zipcode), "pharmacies")
    o = shared_table(_origins(origins, zipcode).join(per_zip.select("plan_key").distinct(), "plan_key", "left_semi"), "origins")
    d, pref = F.col("distance_miles"), F.col("n_preferred")
    near = grid.within(o, per_zip, 10.0, ["plan_key"], digits=2).groupBy(*keys).agg(
        F.sum(F.when(d <= 5, pref).otherwise(0)).alias("p5"), F.sum(pref).alias("p10"), F.sum("n_pharmacies").alias("t10"))
    first = grid.nearest(o, per_zip.where(pref > 0), keys, ["p_zip"], 1, ["plan_key"], digits=2)
    j = o.join(near, keys, "left").join(first.select(*keys, d.alias("_nearest")), keys, "left")
    nearest = F.coalesce(F.col("_nearest"), F.lit(999.0))
    count = {c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("p5", "p10", "t10")}
    score = F.least(F.lit(100.0), F.lit(100.0) / (1 + nearest / 5.0) + F.least(F.lit(50.0), 5.0 * count["p10"]))
    return j.select(
        *keys, nearest.alias("nearest_preferred_miles"), count["p5"].alias("preferred_within_5mi"),
        count["p10"].alias("preferred_within_10mi"), count["t10"].alias("total_within_10mi"), score.alias("network_accessibility_score"))


def plan_network_accessibility(origins: DataFrame, pharmacy_network: DataFrame, zipcode: DataFrame) -> DataFrame:
    """E5: `plan_access` and the mean distance over all preferred pharmacies of the plan (999 when none)."""
    pref = F.col("n_preferred")
    mean = zip_pharmacy_distances(origins, pharmacy_network, zipcode).groupBy("zip_code", "plan_key").agg(
        (F.sum(pref * F.col("distance_miles")) / F.nullif(F.sum(pref), F.lit(0))).alias("_mean"))
    out = plan_access(origins, pharmacy_network, zipcode).join(mean, ["zip_code", "plan_key"], "left")
    return out.withColumn("avg_preferred_distance", F.coalesce("_mean", F.lit(999.0))).select(
        "zip_code", "plan_key", "nearest_preferred_miles", "preferred_within_5mi", "preferred_within_10mi", "total_within_10mi",
        "avg_preferred_distance", "network_accessibility_score")


def representative_zip(zip_with_county: DataFrame) -> DataFrame:
    """Per county the ZIP with the largest population (unknown last), then the smallest ZIP."""
    w = Window.partitionBy("county_code").orderBy(F.col("population").desc_nulls_last(), F.col("zip_code"))
    return zip_with_county.where(F.col("county_code").isNotNull()).withColumn("_rn", F.row_number().over(w)).where(
        "_rn = 1").select("county_code", "zip_code", "city", "state")


def county_pharmacy_links(plan_info: DataFrame, pharmacy_network: DataFrame, zip_with_county: DataFrame) -> DataFrame:
    """One row per (county, plan, pharmacy) where the pharmacy's ZIP lies in the county
    the plan row serves (three equi-joins)."""
    from rxgrid.operators import bronze

    z = broadcast_if_small(zip_with_county.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        F.col("zip_code").alias("pharmacy_zipcode"), "city", F.col("state").alias("z_state"), "county",
        F.col("county_code").alias("z_county"), "lat", "lng"))
    p = broadcast_if_small(plan_info.select("plan_key", "plan_name", "contract_name", "premium", "deductible",
                                            "state", "county_code"))
    n = bronze.network(pharmacy_network).select("plan_key", "pharmacy_number", "pharmacy_zipcode",
                                                     "is_preferred_retail", "is_preferred_mail", "is_in_area")
    j = n.join(z, "pharmacy_zipcode").join(p, "plan_key").where(F.col("z_county") == F.col("county_code"))
    return j.drop("z_county")


def county_pharmacy_summary(links: DataFrame) -> DataFrame:
    """Per county and pharmacy: plans served, preferred links, mean premium, the first six
    plan names in order; ranked within the county by plans served then preferred links."""
    pref = (F.coalesce("is_preferred_retail", F.lit(False)) | F.coalesce("is_preferred_mail", F.lit(False))).cast("int")
    g = links.groupBy("county_code", "pharmacy_number", "pharmacy_zipcode", "city", "z_state", "county", "lat", "lng").agg(
        F.count_distinct("plan_key").alias("plans_served"), F.sum(pref).alias("preferred_plan_links"),
        F.avg("premium").alias("avg_premium"),
        F.array_join(F.slice(F.array_sort(F.collect_set("plan_name")), 1, 6), ", ").alias("sample_plan_names"))
    w = Window.partitionBy("county_code").orderBy(F.col("plans_served").desc(), F.col("preferred_plan_links").desc(),
                                                  F.col("pharmacy_number"))
    return g.withColumnRenamed("z_state", "state").withColumn("rank", F.row_number().over(w))


def county_access_headline(summary: DataFrame) -> DataFrame:
    """Per county pharmacies, pharmacies with a preferred link, plans served at most."""
    return summary.groupBy("county_code").agg(
        F.count(F.lit(1)).alias("pharmacies"),
        F.sum(F.when(F.col("preferred_plan_links") > 0, 1).otherwise(0)).alias("pharmacies_with_preferred"),
        F.max("plans_served").alias("max_plans_served"))


# A task of comparison plans expands into about this many rows.
PLANS_PER_PARTITION = 250_000


def comparison_partitions(nearby: DataFrame, plan_info: DataFrame) -> int:
    """Partitions of nearby counties dealt by request: enough for the plans they expand into, and at least the shuffle setting."""
    at = ["state", "county_code"]
    n = nearby.groupBy(*at).agg(F.count(F.lit(1)).alias("_near")).join(plan_info.groupBy(*at).agg(F.count(F.lit(1)).alias("_plans")), at)
    rows = n.agg(F.sum(F.col("_near").cast("double") * F.col("_plans"))).first()[0] or 0.0
    least = int(nearby.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(rows / PLANS_PER_PARTITION))


def nearby_comparison_plans(requests: DataFrame, nearby: DataFrame, plan_info: DataFrame) -> DataFrame:
    """Plans (with a premium) of the nearby counties other than the request's own, as
    comparison-only rows tagged with the county distance; one row per (request, plan)
    keeping the nearest (J2)."""
    from rxgrid.operators.decision import dedupe_candidates

    p = broadcast_if_small(plan_info.where(F.col("premium").isNotNull() & (
        F.col("plan_suppressed_yn").isNull() | (F.col("plan_suppressed_yn") != "Y"))).select(
        "plan_key", "plan_name", F.col("state").alias("p_state"), F.col("county_code").alias("n_county"),
        F.col("premium").cast("double").alias("premium")))
    r = requests.select("request_id", F.col("county_code").alias("own_county"))
    nb = nearby.withColumnRenamed("origin_id", "request_id").join(r, "request_id").where(
        F.col("county_code") != F.col("own_county"))
    # dealt by request over partitions sized by the plans they expand into: the rows of a request and plan meet where
    # they are made, unshuffled, and a task's memory does not grow with the input
    nb = nb.repartition(comparison_partitions(nearby, plan_info), "request_id")
    comp = nb.join(p, (nb["county_code"] == p["n_county"]) & (nb["state"] == p["p_state"])).select(
        "request_id", "plan_key", "plan_name", "premium", "distance_miles",
        F.lit(False).alias("is_local"), F.lit(False).alias("service_area_eligible"), F.lit(True).alias("comparison_only"),
        F.lit("Comparison only - outside selected service area").alias("eligibility_status"),
        F.col("county").alias("location_county"))
    return dedupe_candidates(comp)


def plans_with_fallback(local: DataFrame, comparison: DataFrame) -> DataFrame:
    """The local candidates, and for requests without any local plan the nearby ones."""
    cols = ["request_id", "plan_key", "plan_name", "premium", "distance_miles", "is_local", "service_area_eligible",
            "comparison_only", "eligibility_status", "location_county"]
    loc = local.select(*cols)
    fb = comparison.select(*cols).join(loc.select("request_id").distinct(), "request_id", "left_anti")
    return loc.unionByName(fb)


__all__ = [
    "resolve_zip_county", "dim_zipcode", "county_density", "plan_distance_features", "nearby_counties",
    "zip_pharmacy_distances", "plan_network_accessibility", "haversine_miles", "county_centroids",
]
