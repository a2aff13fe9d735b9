"""Silver normalisation (B12-B24): padded ids, typed flags, decimals, keys.

Each source is a rule table (``rules``); what needs several columns or another table follows it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxgrid.functions.columns import normalize_id
from rxgrid.functions.joins import broadcast_if_small
from rxgrid.operators.bronze import CHANNELS, COST_TYPES, DAYS_SUPPLY, FILL_DAYS, applied_fee
from rxgrid.operators.rules import applied, coded, joined, total

PLAN_IDS = {"contract_id": "text", "plan_id": "id:3", "segment_id": "id:3"}
PLAN = {
    **PLAN_IDS, "formulary_id": "text", "state": "id:2", "county_code": "id:5", "premium": "amount:12:2", "deductible": "amount:12:2",
}
GEOGRAPHY = {"county_code": "id:5", "statename": "text", "county": "text", "ma_region_code": "id:2", "pdp_region_code": "id:2"}
COST = {
    **PLAN_IDS, "coverage_level": "int", "tier": "int", "days_supply": "int",
    "tier_specialty": "tier_specialty_yn > yn", "deductible_applies": "ded_applies_yn > yn",
    **{f"cost_type_{c}": "int" for c in CHANNELS},
    **{f"cost_{end}amt_{c}": "decimal:12:4" for c in CHANNELS for end in ("", "max_")},
    **{f"cost_min_amt_{c}": "digits:12:4" for c in CHANNELS},
}
PRICING = {**PLAN_IDS, "ndc": "id:11", "days_supply": "int", "unit_cost": "price:12:4"}
NETWORK = {
    **PLAN_IDS, "pharmacy_number": "text", "pharmacy_zipcode": "id:5", "in_area_flag": "int", "floor_price": "decimal:8:4",
    **dict.fromkeys(("preferred_status_retail", "preferred_status_mail", "pharmacy_retail", "pharmacy_mail"), "yn"),
    **{f"{k}_dispensing_fee_{d}": "decimal:8:4" for k in ("brand", "generic") for d in FILL_DAYS},
}
FORMULARY = {
    "formulary_id": "text", "formulary_version": "text", "contract_year": "id:4", "rxcui": "id:8", "ndc": "id:11",
    "tier_level_value": "int", "quantity_limit_amount": "quantity_limit_amount > plain", "quantity_limit_days": "int",
    "quantity_limit_flag": "quantity_limit_yn > bit",
    "prior_auth_flag": "prior_authorization_yn > bit",
    "step_therapy_flag": "step_therapy_yn > bit",
}
ACCESS = {
    "rxcui_norm": "rxcui > id:8", "completely_excluded": "tier > null", "conditionally_covered": "tier > given",
    "pa": "prior_auth_yn > yes01", "st": "step_therapy_yn > yes01", "ql": "quantity_limit_yn > yes01", "cap_benefit": "capped_benefit_yn > yes01",
}
INSULIN = {
    **{f"copay_{c}": f"copay_amt_{c}_insln > double" for c in CHANNELS},
    "tier_raw": "tier > plain",
}
# Days-supply labels of the silver cost table, months of a days code, and the monthly insulin cap.
DAYS_LABELS = {1: "30_DAYS", 2: "90_DAYS", 3: "OTHER", 4: "60_DAYS"}
MONTHS = {2: "3", 4: "2"}
INSULIN_CAP = 35.0


def snake(name: str) -> str:
    """A header in snake case: words part at capitals after a lower-case letter or digit, and at anything else."""
    words = re.split(r"\W+|_+|(?<=[a-z0-9])(?=[A-Z])", name.strip())
    edge = ("_" if re.match(r"\W|_", name.strip()) else "", "_" if re.search(r"(\W|_)$", name.strip()) else "")
    return edge[0] + "_".join(w for w in words if w).lower() + edge[1]


def snake_columns(df: DataFrame) -> DataFrame:
    """All columns renamed in one projection."""
    return df.toDF(*map(snake, df.columns))


def with_load_times(df: DataFrame) -> DataFrame:
    """Load times where the table has none yet."""
    missing = [c for c in ("ingestion_ts", "updated_at") if c not in df.columns]
    return df.withColumns({c: F.current_timestamp() for c in missing}) if missing else df


def _business_key() -> Column:
    return joined("|", *PLAN_IDS)


def _with_plan_of(df: DataFrame, plans: DataFrame) -> DataFrame:
    """The plan key that the plan table has for a row's ids."""
    keys = broadcast_if_small(plans.select("plan_bk", "plan_key").dropDuplicates(["plan_bk"]))
    return df.withColumn("plan_bk", _business_key()).drop("plan_key").join(keys, "plan_bk", "left")


def plan(plan_info: DataFrame) -> DataFrame:
    """Typed plans with their contract letter and business key; a hash of it where there is no plan key."""
    d = applied(snake_columns(plan_info), PLAN)
    d = d.withColumns({"contract_type": F.left("contract_id", F.lit(1)), "plan_bk": _business_key()})
    return d if "plan_key" in d.columns else d.withColumn("plan_key", F.xxhash64("plan_bk").cast("string"))


def geography(geographic: DataFrame) -> DataFrame:
    """Padded codes, upper-case names."""
    return applied(snake_columns(geographic), GEOGRAPHY)


def beneficiary_cost(costs: DataFrame, plans: DataFrame) -> DataFrame:
    """Typed codes, their labels and amounts, plan key and hashed cost key."""
    d = _with_plan_of(applied(snake_columns(costs), COST), plans)
    return d.withColumns({
        "days_supply_label": coded(F.col("days_supply"), DAYS_LABELS),
        **{f"cost_type_{c}_label": coded(F.col(f"cost_type_{c}"), COST_TYPES) for c in CHANNELS},
        "cost_key": F.sha2(joined("|", "plan_key", "coverage_level", "tier", "days_supply"), 256),
    })


def pricing(prices: DataFrame, plans: DataFrame) -> DataFrame:
    """Typed prices with plan key and pricing key."""
    return _with_plan_of(applied(snake_columns(prices), PRICING), plans).withColumn("pricing_key", joined("|", "plan_key", "ndc", "days_supply"))


def network(pharmacies: DataFrame) -> DataFrame:
    """Flags that may be unknown, decimal fees and their means with 0 for a missing one."""
    area = F.col("in_area_flag")
    return applied(snake_columns(pharmacies), NETWORK).withColumns({
        "is_in_area": F.when(area.isin(0, 1), area == 1),
        "plan_bk": _business_key(),
        **{f"avg_{k}_fee": applied_fee(k, missing=0) for k in ("brand", "generic")},
    })


def formulary(drugs: DataFrame, insulin: DataFrame) -> DataFrame:
    """Typed drugs with their restriction count, hashed key and the insulin tag."""
    d = applied(snake_columns(drugs), FORMULARY).withColumns({
        "restriction_count": total(["quantity_limit_flag", "prior_auth_flag", "step_therapy_flag"], missing=0),
        "formulary_drug_key": F.sha2(joined("|", "formulary_id", "formulary_version", "contract_year", "rxcui", "ndc"), 256),
    })
    tagged = insulin.select(normalize_id("ndc", 11).alias("ndc")).where("ndc IS NOT NULL").distinct().withColumn("is_insulin", F.lit(1))
    return d.join(broadcast_if_small(tagged), "ndc", "left").fillna({"is_insulin": 0})


def insulin_cost(costs: DataFrame) -> DataFrame:
    """Copays of all channels with the lowest and highest, the tier they are for (none: ALL), and
    whether the highest exceeds the monthly cap."""
    d = applied(costs, INSULIN)
    none = F.coalesce(F.col("tier_raw"), F.lit("")).isin("", ".")
    days = F.col("days_supply").cast("int")
    copays = [f"copay_{c}" for c in CHANNELS]
    d = d.withColumns({
        "plan_key": joined("", *PLAN_IDS),
        "tier_int": F.when(~none, F.col("tier_raw").try_cast("int")),
        "tier_scope": F.when(none, "ALL").otherwise(F.concat(F.lit("TIER_"), "tier_raw")),
        "insulin_min_copay_all_channels": F.least(*copays),
        "insulin_max_copay_all_channels": F.greatest(*copays),
        "days_supply_label": coded(days, DAYS_SUPPLY, "other"),
    })
    cap = INSULIN_CAP * coded(days, MONTHS, "1").cast("int")
    return d.withColumn("exceeds_cap_flag", F.coalesce(F.col("insulin_max_copay_all_channels") > cap, F.lit(False)).cast("int"))


def access_rules(excluded: DataFrame) -> DataFrame:
    """Restriction bits and their sum, and the access status."""
    status = F.when(F.col("completely_excluded"), "EXCLUDED").otherwise("CONDITIONAL")
    return applied(excluded, ACCESS).withColumns({"drug_access_status": status, "restriction_score": total(["pa", "st", "ql", "cap_benefit"])})
