"""Drug catalogue and medication lists as column jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxgrid.functions.joins import broadcast_if_small

# Formatted-NDC pattern found in free text (10/11-digit NDCs with dashes)
# and the token separators of user-typed NDC lists.
NDC_TEXT_PATTERN = r"\b\d{4,5}-\d{3,4}-\d{1,2}\b"
TOKEN_SEPARATORS = r"[\s,;\n\r\t]+"


def ndc11(formatted: Column) -> Column:
    """B25: '4-4-2' / '5-3-2' / '5-4-1' formatted NDC -> 11 digits (segments padded 5-4-2)."""
    parts = F.split(formatted, "-")
    return F.when(
        F.size(parts) == 3,
        F.concat(F.lpad(parts.getItem(0), 5, "0"), F.lpad(parts.getItem(1), 4, "0"), F.lpad(parts.getItem(2), 2, "0")),
    )


def extract_ndcs(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Every formatted NDC in each whole text, normalised to 11 digits, distinct per text."""
    m = texts.select(id_col, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(NDC_TEXT_PATTERN), 0)).alias("raw"))
    return m.select(id_col, ndc11(F.col("raw")).alias("ndc11")).dropDuplicates([id_col, "ndc11"])


def ndc_candidates(token: Column) -> Column:
    """L2: digits only; a shorter-than-11 value also yields its 11-digit zero-padded form."""
    d = F.regexp_replace(F.coalesce(token.cast("string"), F.lit("")), "[^0-9]", "")
    return F.when(d == "", F.array().cast("array<string>")).when(
        F.length(d) < 11, F.array_distinct(F.array(d, F.lpad(d, 11, "0")))
    ).otherwise(F.array(d))


def parse_ndc_text(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """L3: whole texts -> (id, position, ndc) in first-seen order, duplicates removed.
    Emits rows, not per-text lists, so a long text is never gathered in one record."""
    tok = texts.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), TOKEN_SEPARATORS))
                       .alias("tpos", "token"))
    cand = tok.select(id_col, "tpos", F.posexplode(ndc_candidates(F.col("token"))).alias("cpos", "ndc"))
    first = cand.groupBy(id_col, "ndc").agg(F.min(F.struct("tpos", "cpos")).alias("_p"))
    w = Window.partitionBy(id_col).orderBy(F.col("_p.tpos"), F.col("_p.cpos"))
    return first.select(id_col, "ndc", F.row_number().over(w).alias("position"), F.col("_p.tpos").alias("_tp"),
                        F.col("_p.cpos").alias("_cp")).drop("_tp", "_cp")


def normalize_medications(rows: DataFrame, key: str = "request_id") -> DataFrame:
    """L4: NDC = last candidate, default name 'NDC x', fills >= 1 (default 12), days snapped to
    30/60/90 (half-even integer first), tier clamped 1-7, insulin as boolean, cost >= 0."""
    cands = ndc_candidates(F.col("ndc"))
    days_i = F.bround(F.coalesce(F.col("days_supply_mode").cast("string").try_cast("double"), F.lit(30.0)), 0).cast("int")
    tier_i = F.bround(F.coalesce(F.col("tier_level").cast("string").try_cast("double"), F.lit(1.0)), 0).cast("int")
    ins_t = F.lower(F.trim(F.col("is_insulin").cast("string")))
    d = rows.withColumn("_c", cands).where(F.size("_c") > 0).withColumn("ndc_norm", F.element_at("_c", -1))
    name = F.trim(F.coalesce(F.col("drug_name").cast("string"), F.lit("")))
    return d.select(
        key,
        F.when(name != "", name).otherwise(F.concat(F.lit("NDC "), F.col("ndc_norm"))).alias("drug_name"),
        F.col("ndc_norm").alias("ndc"),
        F.greatest(F.lit(1.0), F.coalesce(F.col("fills_per_year").cast("string").try_cast("double"), F.lit(12.0)))
        .alias("fills_per_year"),
        F.when(days_i.isin(30, 60, 90), days_i).when(days_i < 45, 30).when(days_i < 75, 60).otherwise(90)
        .alias("days_supply_mode"),
        F.least(F.lit(7), F.greatest(F.lit(1), tier_i)).alias("tier_level"),
        (ins_t.isin("1", "true", "t", "yes", "y") | (ins_t.try_cast("double") != 0)).alias("is_insulin"),
        F.greatest(F.lit(0.0), F.coalesce(F.col("annual_cost_est").cast("string").try_cast("double"), F.lit(0.0)))
        .alias("annual_cost_est"),
        *([F.col("row_pos")] if "row_pos" in rows.columns else []),
    )


def merge_medications(norm: DataFrame, key: str = "request_id") -> DataFrame:
    """L5 (rows): duplicate NDCs merged - max fills and days, min tier, any insulin, max cost,
    the first real name (else the 'NDC x' name)."""
    pos = F.col("row_pos") if "row_pos" in norm.columns else F.lit(0)
    real = ~F.col("drug_name").startswith("NDC ")
    return norm.withColumn("_pos", pos).groupBy(key, "ndc").agg(
        F.max("fills_per_year").alias("fills_per_year"),
        F.max("days_supply_mode").alias("days_supply_mode"),
        F.min("tier_level").alias("tier_level"),
        F.max(F.col("is_insulin").cast("int")).cast("boolean").alias("is_insulin"),
        F.max("annual_cost_est").alias("annual_cost_est"),
        F.coalesce(F.min_by(F.when(real, F.col("drug_name")), F.when(real, F.col("_pos"))),
                   F.min_by("drug_name", "_pos")).alias("drug_name"),
        F.min("_pos").alias("first_pos"),
    )


def summarize_medications(merged: DataFrame, key: str = "request_id") -> DataFrame:
    """L5 (summary): drug count, mean fills, insulin user, total annual cost."""
    return merged.groupBy(key).agg(
        F.count(F.lit(1)).alias("num_drugs"),
        F.avg("fills_per_year").alias("avg_fills_per_year"),
        F.max(F.col("is_insulin").cast("int")).alias("is_insulin_user"),
        F.sum("annual_cost_est").alias("total_annual_drug_cost"),
    )


def _grams(c: Column, n: int) -> Column:
    """All distinct length-n substrings of a string (empty for shorter strings)."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))),
                                        lambda i: F.substring(c, i, n)))


def drug_catalog(prescriptions: DataFrame) -> DataFrame:
    """L1 catalogue: partial sums per (name, synonym, ndc) so matching happens on a small
    table and the per-query averages stay exact."""
    rx = prescriptions.where(F.col("ndc").isNotNull())
    name = F.coalesce(F.nullif(F.col("drug_name"), F.lit("")), F.nullif(F.col("drug_synonym"), F.lit("")),
                      F.concat(F.lit("NDC "), F.col("ndc"))).cast("string")
    return rx.groupBy(name.alias("drug_name"), F.coalesce(F.col("drug_synonym"), F.lit("")).alias("drug_synonym"),
                      F.col("ndc").cast("string").alias("ndc")).agg(
        F.min(F.col("tier_level").cast("string").try_cast("int")).alias("_tier"),
        F.sum(F.col("days_supply_mode").cast("string").try_cast("int")).alias("_days_sum"),
        F.count(F.col("days_supply_mode").cast("string").try_cast("int")).alias("_days_n"),
        F.sum(F.col("fills_per_year").cast("string").try_cast("double")).alias("_fills_sum"),
        F.count(F.col("fills_per_year").cast("string").try_cast("double")).alias("_fills_n"),
        F.max(F.col("is_insulin").cast("string").try_cast("int")).alias("_ins"),
        F.sum(F.col("estimated_annual_drug_cost").cast("string").try_cast("double")).alias("_cost_sum"),
        F.count(F.col("estimated_annual_drug_cost").cast("string").try_cast("double")).alias("_cost_n"),
    )


def search_catalog(queries: DataFrame, catalog: DataFrame, limit: int = 20) -> DataFrame:
    """L1: for every query text, catalogue rows whose lower-case name or synonym contains it
    (queries of >= 2 characters) or whose NDC contains its digits (>= 4 digits), aggregated
    per (name, ndc), the first ``limit`` by name then NDC.

    Exact substring search without a nested loop: catalogue rows are indexed by
    the distinct trigrams and bigrams of name and synonym and the 4-grams of the
    NDC; a query looks up the rows holding one of its own grams (its first
    trigram, the whole 2-character query, or its last four digits) by an
    equi-join and only those are checked with ``contains``.  A row containing
    the query necessarily holds that gram, so nothing is missed.  The queries are the (size-checked) broadcast side:
    grams are made and checked where the catalogue rows are, and only hits are shuffled."""
    q = queries.select(F.col("query_text"), F.lower(F.trim("query_text")).alias("_q"),
                       F.regexp_replace(F.col("query_text"), "[^0-9]", "").alias("_d")).distinct()
    q = q.where((F.length("_q") >= 2) | (F.length("_d") >= 4))
    keys = ["drug_name", "drug_synonym", "ndc"]
    cat = catalog.dropna(subset=keys).dropDuplicates(keys).withColumn("_lname", F.lower("drug_name")).withColumn("_lsyn", F.lower("drug_synonym"))
    grams = {"t3": F.concat(_grams(F.col("_lname"), 3), _grams(F.col("_lsyn"), 3)),
             "t2": F.concat(_grams(F.col("_lname"), 2), _grams(F.col("_lsyn"), 2)), "n4": _grams(F.col("ndc"), 4)}
    tagged = [F.arrays_zip(F.array_repeat(F.lit(k), F.size(c)).alias("_kind"), c.alias("_gram")) for k, c in ((k, F.array_distinct(c)) for k, c in grams.items())]
    idx = cat.select("*", F.inline(F.concat(*tagged)).alias("_kind", "_gram"))
    text_q = q.where(F.length("_q") >= 2).select(
        "query_text", "_q", "_d", F.when(F.length("_q") >= 3, "t3").otherwise("t2").alias("_kind"),
        F.when(F.length("_q") >= 3, F.substring("_q", 1, 3)).otherwise(F.col("_q")).alias("_gram"))
    num_q = q.where(F.length("_d") >= 4).select(
        "query_text", "_q", "_d", F.lit("n4").alias("_kind"), F.substring("_d", -4, 4).alias("_gram"))
    # (never the index: its size is underestimated before the grams are made)
    hits = idx.hint("merge").join(broadcast_if_small(text_q.unionByName(num_q)), ["_kind", "_gram"])
    by_text = (F.length("_q") >= 2) & (F.col("_lname").contains(F.col("_q")) | F.col("_lsyn").contains(F.col("_q")))
    by_ndc = (F.length("_d") >= 4) & F.col("ndc").contains(F.col("_d"))
    # a row found by text and by NDC counts once, by its text
    hits = hits.where(F.when(F.col("_kind") == "n4", by_ndc & ~by_text).otherwise(by_text))
    g = hits.groupBy("query_text", "drug_name", "ndc").agg(
        F.min("_tier").alias("_tier"), F.sum("_days_sum").alias("_ds"), F.sum("_days_n").alias("_dn"),
        F.sum("_fills_sum").alias("_fs"), F.sum("_fills_n").alias("_fn"), F.max("_ins").alias("_ins"),
        F.sum("_cost_sum").alias("_cs"), F.sum("_cost_n").alias("_cn"),
    )
    avg_days = F.coalesce(F.round(F.col("_ds") / F.nullif(F.col("_dn"), F.lit(0))), F.lit(30.0))
    out = g.select(
        "query_text", "drug_name", "ndc",
        F.coalesce(F.col("_tier"), F.lit(1)).cast("int").alias("tier_level"),
        F.when(avg_days >= 75, 90).when(avg_days >= 45, 60).otherwise(30).alias("days_supply_mode"),
        F.coalesce(F.round((F.col("_fs") / F.nullif(F.col("_fn"), F.lit(0))).cast("decimal(24,6)"), 1).cast("double"),
                   F.lit(12.0)).alias("fills_per_year"),
        F.coalesce(F.col("_ins"), F.lit(0)).cast("int").alias("is_insulin"),
        F.coalesce(F.round((F.col("_cs") / F.nullif(F.col("_cn"), F.lit(0))).cast("decimal(24,6)"), 2).cast("double"),
                   F.lit(0.0)).alias("annual_cost_est"),
    )
    w = Window.partitionBy("query_text").orderBy("drug_name", "ndc")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def name_dictionary_search(queries: DataFrame, names: DataFrame, limit: int = 10) -> DataFrame:
    """Exact (1.0) or contains (0.5) match of the query against drug names, ranked by
    score then name; prefix matches first for autocomplete (``prefix`` flag).  The queries are the (size-checked)
    broadcast side: grams are made and checked where the names are, and only hits are shuffled."""
    q = queries.select("query_text", F.lower(F.trim("query_text")).alias("_q")).where(F.length("_q") >= 2).distinct()
    n = names.select(F.col("drug_name"), F.lower("drug_name").alias("_n"), "ndc")
    idx = n.select("drug_name", "_n", "ndc", F.explode(_grams(F.col("_n"), 2)).alias("_gram"))
    # (never the index: its size is underestimated before the grams are made)
    q = broadcast_if_small(q.withColumn("_gram", F.substring("_q", 1, 2)))
    j = idx.hint("merge").join(q, "_gram").where(F.col("_n").contains(F.col("_q")))
    j = j.dropDuplicates(["query_text", "drug_name", "ndc"])
    scored = j.withColumns({
        "score": F.when(F.col("_n") == F.col("_q"), 1.0).otherwise(0.5),
        "prefix": F.col("_n").startswith(F.col("_q")),
    })
    w = Window.partitionBy("query_text").orderBy(F.col("score").desc(), F.col("prefix").desc(), "drug_name", "ndc")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(
        "query_text", "drug_name", "ndc", "score", "prefix", "rank")


def formulary_drug_pool(formulary: DataFrame, insulin_ref: DataFrame, max_drugs: int | None = None) -> DataFrame:
    """Per NDC the lowest tier, any restriction flags, one rxcui, the number of
    formularies listing it and the insulin flag; ordered by coverage then NDC
    (``max_drugs`` keeps the top of that order when a pool size is asked for)."""
    y = lambda c: F.max(F.when(F.upper(F.trim(c)) == "Y", 1).otherwise(0))
    pool = formulary.where(F.col("ndc").isNotNull()).groupBy("ndc").agg(
        F.min(F.col("tier_level_value").cast("int")).alias("tier_level"),
        y(F.col("prior_authorization_yn")).alias("has_prior_auth"),
        y(F.col("step_therapy_yn")).alias("has_step_therapy"),
        y(F.col("quantity_limit_yn")).alias("has_quantity_limit"),
        F.min("rxcui").alias("rxcui"),
        F.count_distinct("formulary_id").alias("formulary_coverage"),
    )
    ins = broadcast_if_small(insulin_ref.where(F.col("ndc").isNotNull()).select("ndc").distinct()
                             .withColumn("is_insulin", F.lit(1)))
    pool = pool.join(ins, "ndc", "left").withColumn("is_insulin", F.coalesce("is_insulin", F.lit(0)))
    if max_drugs is not None:
        pool = pool.orderBy(F.col("formulary_coverage").desc(), "ndc").limit(max_drugs)
    return pool
