"""Deterministic draws and weighted sampling as joins.

Every random choice is a keyed draw (F1) so results do not depend on
partitioning, retries or task order.  Weighted choices are inverse-CDF lookups
done as an equi-join on (group, bin) plus a range filter: each interval
[lo, hi) is listed under every one of ``BINS`` equal-width bins it overlaps,
so a draw meets one or two candidate intervals instead of the whole group,
and a group holding a third of all rows is split across ``BINS`` keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxgrid.functions.columns import county_code5
from rxgrid.functions.draws import hash_order_key, stable_fraction
from rxgrid.functions.joins import broadcast_if_small

BINS = 256


def cdf_intervals(items: DataFrame, group_cols: list[str], weight_col: str, order_cols: list[Column]) -> DataFrame:
    """Half-open CDF intervals [lo, hi) per group, in ``order_cols`` order.  Integer weights
    are accumulated exactly; an all-zero group falls back to equal weights; the last
    interval is open above (a draw of exactly 1.0 still lands, T13)."""
    w_run = Window.partitionBy(*group_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    w_all = Window.partitionBy(*group_cols)
    d = items.withColumn("_w", F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)))
    d = d.withColumn("_tot", F.sum("_w").over(w_all))
    d = d.withColumn("_w", F.when(F.col("_tot") <= 0, F.lit(1.0)).otherwise(F.col("_w")))
    d = d.withColumn("_tot", F.sum("_w").over(w_all)).withColumn("_cum", F.sum("_w").over(w_run))
    d = d.withColumn("_idx", F.row_number().over(Window.partitionBy(*group_cols).orderBy(*order_cols)))
    d = d.withColumn("_n", F.count(F.lit(1)).over(w_all))
    return d.withColumns(
        {
            "_lo": (F.col("_cum") - F.col("_w")) / F.col("_tot"),
            "_hi": F.when(F.col("_idx") == F.col("_n"), F.lit(float("inf"))).otherwise(F.col("_cum") / F.col("_tot")),
        }
    )


def binned(intervals: DataFrame) -> DataFrame:
    """List each interval under every bin it overlaps (at most its width x BINS + 1 bins)."""
    lo_bin = F.least(F.floor(F.col("_lo") * BINS), F.lit(BINS - 1)).cast("int")
    hi_bin = F.least(F.floor(F.least(F.col("_hi"), F.lit(1.0)) * BINS), F.lit(BINS - 1)).cast("int")
    return intervals.withColumn("_bin", F.explode(F.sequence(lo_bin, F.greatest(hi_bin, lo_bin))))


def draw_bin(draw: Column) -> Column:
    return F.least(F.floor(draw * BINS), F.lit(BINS - 1)).cast("int")


# ---------------------------------------------------------------------------
# F3 county weights, F4 ZIP assignment, F5 county assignment


def county_weights(geographic: DataFrame, zip_with_county: DataFrame) -> DataFrame:
    """county state from its label, else the modal ZIP state (ties: smaller state);
    counties without ZIPs dropped; weight = geography rows per (county, state)."""
    z = zip_with_county.select(county_code5("county_code").alias("county_code"), F.upper(F.trim("state")).alias("state"))
    z = z.where((F.col("county_code") != "") & F.col("state").isNotNull() & (F.col("state") != ""))
    modal = z.groupBy("county_code", "state").agg(F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy("county_code").orderBy(F.col("_rows").desc(), F.col("state").asc())
    modal = modal.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(
        "county_code", F.col("state").alias("_zip_state"))
    g = geographic.select(county_code5("county_code").alias("county_code"),
                          F.upper(F.trim(F.col("state_label").cast("string"))).alias("state"))
    g = g.withColumn("state", F.when(F.col("state").isin("", "NONE", "NAN"), F.lit(None)).otherwise(F.col("state")))
    g = g.join(broadcast_if_small(modal), "county_code", "left").withColumn(
        "state", F.coalesce("state", "_zip_state")).drop("_zip_state")
    g = g.where(F.col("state").isNotNull() & (F.col("county_code") != "")).join(
        modal.select("county_code"), "county_code", "left_semi")
    return g.groupBy("county_code", "state").agg(F.count(F.lit(1)).alias("weight"))


def assign_population_weighted_zips(bene: DataFrame, zips: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """each beneficiary gets a ZIP of its county with probability proportional to
    population (ZIPs ordered by population desc, ZIP asc; draw keyed by
    ``county|bene``).  Returns (assignments, audit) - beneficiaries of counties
    without candidates are audited as excluded."""
    b = bene.select("bene_synth_id", county_code5("county_code").alias("county_code"))
    c = zips.select(
        county_code5("county_code").alias("county_code"), F.trim(F.col("zip_code").cast("string")).alias("zip_code"),
        F.greatest(F.coalesce(F.col("population").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("population"),
        F.upper(F.trim("state")).alias("state"), "lat", "lng", F.col("density").cast("double").alias("density"),
    ).where((F.col("county_code") != "") & (F.col("zip_code") != "") & (F.col("state") != ""))
    iv = binned(cdf_intervals(c, ["county_code"], "population", [F.col("population").desc(), F.col("zip_code").asc()]))
    iv = iv.select("county_code", "_bin", "_lo", "_hi", F.col("zip_code").alias("assigned_zip"),
                   F.col("state").alias("assigned_state"), "lat", "lng", "density")
    draw = stable_fraction(F.concat_ws("|", "county_code", "bene_synth_id"), seed)
    bd = b.withColumn("_draw", draw).withColumn("_bin", draw_bin(F.col("_draw")))
    iv = broadcast_if_small(iv)
    j = bd.join(iv, ["county_code", "_bin"]).where((F.col("_lo") <= F.col("_draw")) & (F.col("_draw") < F.col("_hi")))
    assigned = j.select("bene_synth_id", "county_code", F.col("assigned_state").alias("state"),
                        F.col("assigned_zip").alias("zip_code"), "lat", "lng", "density")
    excluded = b.join(c.select("county_code").distinct(), "county_code", "left_anti")
    audit = assigned.select(
        "bene_synth_id", "county_code", F.lit("assigned").alias("assignment_status"),
        F.lit(None).cast("string").alias("exclusion_reason"), F.col("zip_code").alias("assigned_zip"),
        F.col("state").alias("assigned_state"),
    ).unionByName(excluded.select(
        "bene_synth_id", "county_code", F.lit("excluded").alias("assignment_status"),
        F.lit("No ZIP candidates available for county").alias("exclusion_reason"),
        F.lit(None).cast("string").alias("assigned_zip"), F.lit(None).cast("string").alias("assigned_state"),
    ))
    return assigned, audit


def assign_counties(bene: DataFrame, weights: DataFrame, seed: int = 42) -> DataFrame:
    """weighted county (and its state) per beneficiary from one global CDF (weights
    desc, county asc), keyed by the beneficiary id; unmapped rows dropped."""
    w = weights.withColumn("_g", F.lit(1))
    iv = binned(cdf_intervals(w, ["_g"], "weight", [F.col("weight").desc(), F.col("county_code").asc()]))
    iv = broadcast_if_small(iv.select("_bin", "_lo", "_hi", "county_code", "state"))
    draw = stable_fraction(F.col("bene_synth_id"), seed)
    bd = bene.drop("county_code", "state").withColumn("_draw", draw).withColumn("_bin", draw_bin(F.col("_draw")))
    j = bd.join(iv, "_bin").where((F.col("_lo") <= F.col("_draw")) & (F.col("_draw") < F.col("_hi")))
    return j.drop("_bin", "_lo", "_hi", "_draw").where(F.col("state").isNotNull())


# ---------------------------------------------------------------------------
# F6 / F7 weighted sampling without replacement, F8 fill allocation


def sample_without_replacement(groups: DataFrame, pool: DataFrame, k_col: str, weight_col: str, item_col: str,
                               group_col: str = "bene_synth_id", seed: int = 42, first_round: int = 4,
                               max_rounds: int = 64) -> DataFrame:
    """k distinct items per group, weighted, without replacement (successive sampling).

    Draws are i.i.d. inverse-CDF lookups into the broadcast pool (keyed by
    ``group|round|j``); keeping the first occurrence of each item in draw order
    is exactly successive sampling without replacement.  Groups still short of
    min(k, pool size) after a round draw again (only those groups, with twice as
    many draws), so no group is capped.  Never forms the group x pool product."""
    p = pool.select(F.col(item_col).alias("_item"), F.col(weight_col).alias("_wt")).withColumn("_g", F.lit(1))
    n_pool = p.count()
    iv = binned(cdf_intervals(p, ["_g"], "_wt", [F.col("_wt").desc(), F.col("_item").asc()]))
    iv = broadcast_if_small(iv.select("_bin", "_lo", "_hi", "_item"))
    g = groups.select(F.col(group_col).alias("_grp"),
                      F.least(F.col(k_col).cast("int"), F.lit(n_pool)).alias("_k")).where(F.col("_k") > 0)
    todo = g
    picked = None
    m = first_round
    for rnd in range(max_rounds):
        draws = todo.withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_k") * m))).withColumn("_round", F.lit(rnd))
        key = F.concat_ws("|", F.col("_grp"), F.lit(str(rnd)), F.col("_j").cast("string"))
        draws = draws.withColumn("_draw", stable_fraction(key, seed)).withColumn("_bin", draw_bin(F.col("_draw")))
        hit = draws.join(iv, "_bin").where((F.col("_lo") <= F.col("_draw")) & (F.col("_draw") < F.col("_hi")))
        hit = hit.select("_grp", "_k", "_item", (F.col("_round") * F.lit(1 << 32) + F.col("_j")).alias("_ord"))
        allh = hit if picked is None else picked.select("_grp", "_k", "_item", "_ord").unionByName(hit)
        first = allh.groupBy("_grp", "_k", "_item").agg(F.min("_ord").alias("_ord"))
        w = Window.partitionBy("_grp").orderBy("_ord")
        # reliable checkpoint: each round builds on the last without growing lineage
        picked = first.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= F.col("_k")).checkpoint()
        short = picked.groupBy("_grp", "_k").agg(F.count(F.lit(1)).alias("_got")).where(F.col("_got") < F.col("_k"))
        todo = todo.join(short.select("_grp"), "_grp", "left_semi")
        if todo.limit(1).count() == 0:
            break
        m *= 2
    if picked is None:
        return groups.sparkSession.createDataFrame([], f"{group_col} string, {item_col} string, draw_order int")
    return picked.select(F.col("_grp").alias(group_col), F.col("_item").alias(item_col), F.col("_pos").alias("draw_order"))


def force_inclusion(sampled: DataFrame, groups: DataFrame, pool: DataFrame, flag_col: str, class_col: str,
                    item_col: str, group_col: str = "bene_synth_id", seed: int = 42) -> DataFrame:
    """a flagged group must hold at least one item of the class; when it holds none,
    its last pick is replaced by a keyed uniform pick from the class (an equi-join on
    the drawn class index, no group x class product).  The group held no class item,
    so the replacement is new and k stays the same with distinct items."""
    cls = pool.where(F.col(class_col) == 1).select(F.col(item_col).alias("_ci"))
    cls = cls.withColumn("_cidx", F.row_number().over(Window.orderBy("_ci")) - 1)  # class list: a bounded reference
    n_cls = cls.count()
    s = sampled.join(pool.select(item_col, class_col), item_col, "left")
    has = s.groupBy(group_col).agg(F.max(F.coalesce(F.col(class_col), F.lit(0))).alias("_has"),
                                   F.max("draw_order").alias("_last"))
    if n_cls == 0:
        return sampled
    need = groups.where(F.col(flag_col) == 1).select(group_col).join(has.where("_has = 0"), group_col)
    need = need.withColumn("_cidx", F.floor(stable_fraction(F.col(group_col).cast("string"), seed) * n_cls).cast("int"))
    need = need.withColumn("_cidx", F.least(F.col("_cidx"), F.lit(n_cls - 1)))
    repl = need.join(broadcast_if_small(cls), "_cidx").select(group_col, "_ci", "_last")
    keep = sampled.join(repl.select(group_col, "_last"), group_col, "left").where(
        F.col("_last").isNull() | (F.col("draw_order") != F.col("_last"))).drop("_last")
    add = repl.select(group_col, F.col("_ci").alias(item_col), F.col("_last").alias("draw_order"))
    return keep.unionByName(add)


def allocate_fills(items: DataFrame, target_col: str, group_col: str, item_col: str, seed: int = 42) -> DataFrame:
    """F8: split an integer total over a group's items, each at least 1, by largest
    remainder of keyed Dirichlet(1) shares (normalised -ln u); the sum equals
    max(target, item count) exactly."""
    w = Window.partitionBy(group_col)
    e = -F.log(F.greatest(stable_fraction(F.concat_ws("|", F.col(group_col), F.col(item_col)), seed), F.lit(1e-300)))
    d = items.withColumn("_e", e).withColumn("_n", F.count(F.lit(1)).over(w))
    d = d.withColumn("_t", F.greatest(F.col(target_col).cast("long"), F.col("_n")))
    d = d.withColumn("_q", F.col("_e") / F.sum("_e").over(w) * (F.col("_t") - F.col("_n")))
    d = d.withColumn("_fl", F.floor("_q")).withColumn("_fr", F.col("_q") - F.col("_fl"))
    d = d.withColumn("_rem", F.col("_t") - F.col("_n") - F.sum("_fl").over(w))
    d = d.withColumn("_rk", F.row_number().over(Window.partitionBy(group_col).orderBy(F.col("_fr").desc(), F.col(item_col))))
    fills = 1 + F.col("_fl") + F.when(F.col("_rk") <= F.col("_rem"), 1).otherwise(0)
    return d.withColumn("fills_allocated", fills.cast("int")).drop("_e", "_n", "_t", "_q", "_fl", "_fr", "_rem", "_rk")


# ---------------------------------------------------------------------------
# F9 / F10 replication and fill events, F11 / F12 names, F13 / F14 samples


def replicated_pool(pool: DataFrame, weight_col: str, max_copies: int = 100) -> DataFrame:
    """each item repeated 1..max_copies times in proportion to its weight."""
    mx = pool.agg(F.max(weight_col).alias("_mx"))  # one row: attach the scalar by broadcast
    d = pool.crossJoin(F.broadcast(mx))
    copies = F.greatest(F.lit(1), F.least(F.lit(max_copies), F.ceil(F.col(weight_col) / F.col("_mx") * max_copies)))
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_mx")


def fill_events(basket: DataFrame, year_start: str = "2025-01-01", seed: int = 42) -> DataFrame:
    """one dated fill event per fill: fills spread evenly over the year with a keyed
    0-6 day jitter."""
    d = basket.withColumn("fill_num", F.explode(F.sequence(F.lit(1), F.greatest(F.col("fills_per_year").cast("int"), F.lit(1)))))
    step = F.floor((F.col("fill_num") - 1) * 365.0 / F.greatest(F.col("fills_per_year").cast("int"), F.lit(1)))
    jitter = F.floor(stable_fraction(F.concat_ws("|", "bene_synth_id", "ndc", F.col("fill_num").cast("string")), seed) * 7)
    return d.withColumn("srvc_dt", F.date_add(F.lit(year_start).cast("date"), (step + jitter).cast("int")))


# RXCUI term-type priority (lower is preferred).
TTY_PRIORITY = {"IN": 1, "PIN": 2, "MIN": 3, "SCD": 4, "SBD": 5, "GPCK": 6, "BPCK": 7}


def best_rxcui_names(ref: DataFrame) -> DataFrame:
    """per rxcui the active English row with the best term type, then the shorter
    name, then the name."""
    lang = F.coalesce(F.col("language"), F.lit("")) if "language" in ref.columns else F.lit("")
    sup = F.coalesce(F.col("suppress"), F.lit("")) if "suppress" in ref.columns else F.lit("")
    r = ref.where((F.col("rxcui") != "") & ((lang == "") | (F.upper(lang) == "ENG")) & (F.upper(sup) != "Y"))
    prio = F.lit(99)
    for k, v in reversed(list(TTY_PRIORITY.items())):
        prio = F.when(F.upper(F.col("tty")) == k, F.lit(v)).otherwise(prio)
    w = Window.partitionBy("rxcui").orderBy(prio, F.coalesce(F.length("name"), F.lit(9999)), F.col("name"),
                                            F.col("synonym"), F.col("tty"))
    return r.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(
        "rxcui", F.col("name").alias("drug_name"), F.col("synonym").alias("drug_synonym"), "tty")


def resolve_drug_name(name: Column, synonym: Column, ndc: Column) -> tuple[Column, Column]:
    """name, else synonym, else 'NDC x', with the source tag."""
    n, s = F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(synonym), F.lit(""))
    resolved = F.coalesce(n, s, F.concat(F.lit("NDC "), ndc))
    source = F.when(n.isNotNull(), "rxcui_name").when(s.isNotNull(), "rxcui_synonym").otherwise("ndc_fallback")
    return resolved, source


# Risk filter spellings accepted (the UI sends Low/Medium/High, data hold LOW/MED/HIGH).
RISK_ALIASES = {"LOW": "LOW", "MED": "MED", "MEDIUM": "MED", "HIGH": "HIGH"}


def research_sample(bene: DataFrame, n: int, seed: int = 42, risk: list[str] | None = None,
                    insulin_only: bool = False, states: list[str] | None = None) -> DataFrame:
    """deterministic sample of n beneficiaries in sha256(id || seed) order after the
    filters (a top-n, planned as a per-partition take-ordered + merge)."""
    b = bene
    if risk:
        wanted = sorted({RISK_ALIASES.get(r.upper(), r.upper()) for r in risk})
        b = b.where(F.upper("risk_segment").isin(wanted))
    if insulin_only:
        b = b.where(F.col("insulin_user_flag") == 1)
    if states:
        b = b.where(F.col("state").isin(states))
    ids = b.select("bene_synth_id").distinct().withColumn("_h", hash_order_key(F.col("bene_synth_id"), seed))
    return ids.orderBy("_h", "bene_synth_id").limit(n).drop("_h")


def keyed_downsample(df: DataFrame, key: Column, fraction: float, seed: int = 42) -> DataFrame:
    """reproducible Bernoulli sample: keep rows whose keyed draw is below the fraction."""
    return df.where(stable_fraction(key, seed) < fraction)
