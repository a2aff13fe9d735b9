"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

`judge` takes the labels (1: unwanted, 0: wanted, null: unknown) as a column over host, path and url.  The
default is weak supervision: 1 where a word of the host is in a short list of seed words, else 0.  The
rules are policy and no labels: learning from them would only repeat their suffixes.  Features: length, host length, depth, digit ratio,
character entropy, hyphens, subdomains, parameters, and statistics of the host's last label and of its
last two over all labelled URLs of the table (smoothed share blocked, number).  Trees are
trained by Spark ML on at most `fit_rows` labelled URLs, chosen by hash: of the rarer label up to half of them, of the
other up to the rest, each weighted back to its number in the table.

Defined results: a null URL or one without `://` has empty host and path; where there is nothing to
learn from (no labelled URL, or one label only) that label's verdict, or `allow`, is given; ties between rules
go to the longest, then to the first in order; repeated rows and null ids are judged like others;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxgrid.llm.common import stored

#: Fixed values of the contract: (verdict, rule).
RULES: tuple[tuple[str, str], ...] = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Host words that label a URL as unwanted.
SEED_WORDS = (
    "ads", "adult", "bet", "bets", "betting", "casino", "lottery", "malware", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "track",
    "tracker", "viagra", "warez", "xxx",
)
FEATURES = (
    "length", "host_length", "depth", "digit_ratio", "entropy", "n_hyphens", "n_labels", "n_params",
    "suffix_share", "suffix_seen", "suffix2_share", "suffix2_seen",
)


@dataclass(frozen=True)
class UrlFilter:
    fit_rows: int = 20_000
    trees: int = 12
    depth: int = 3
    prior_rows: float = 20.0


def _upper_to_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return urls.withColumns({
        "host": _upper_to_lower(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)),
        "path": F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1),
    })


def judged_by_rules(urls: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Adds `rule` (null: none fits) and `rule_verdict` to rows with host and path."""
    rule = verdict = F.lit(None).cast("string")
    for judged, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a longer rule overrides
        host, slash, path = text.partition("/")
        on_host = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
        fits = on_host & F.startswith(F.col("path"), F.lit(slash + path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(judged)).otherwise(verdict)
    return urls.withColumns({"rule": rule, "rule_verdict": verdict})


def weak_label() -> Column:
    words = F.split("host", "[^a-z]+")
    return F.when(F.col("host") == "", F.lit(None)).otherwise(F.arrays_overlap(words, F.array(*map(F.lit, SEED_WORDS))).cast("int"))


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features and the host's suffixes."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    n = F.char_length(u).cast("double")
    share = lambda c: (n - F.char_length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0), lambda acc, c: F.when(c == "", acc).otherwise(acc - share(c) * F.log2(share(c))))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return urls.withColumns({
        "length": n,
        "host_length": F.char_length("host").cast("double"),
        "depth": F.regexp_count("path", F.lit("/+[^/]+")).cast("double"),
        "digit_ratio": F.when(n > 0, F.regexp_count(u, F.lit("[0-9]")) / n).otherwise(0.0),
        "entropy": entropy,
        "n_hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
        "n_labels": F.size(labels).cast("double"),
        "n_params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "[&;]")).cast("double")),
        "suffix": F.element_at(labels, -1),
        "suffix2": F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2))),
    })


def _with_suffix_statistics(rows: DataFrame, cfg: UrlFilter) -> DataFrame:
    for c in ("suffix", "suffix2"):
        found = rows.filter("label IS NOT NULL").groupBy(c).agg(F.sum("label").alias("b"), F.count("*").alias("n"))
        found = found.select(c, ((F.col("b") + cfg.prior_rows / 2) / (F.col("n") + cfg.prior_rows)).alias(f"{c}_share"), F.log1p("n").alias(f"{c}_seen"))
        rows = rows.join(found, c, "left").fillna({f"{c}_share": 0.5, f"{c}_seen": 0.0})
    return rows


def judge(
    urls: DataFrame, cfg: UrlFilter = UrlFilter(), rules: tuple[tuple[str, str], ...] = RULES, label: Column | None = None, url: str = "url", page_id: str = "page_id"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) for every row; a rule's verdict comes before the trees'."""
    src = urls.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = lexical(judged_by_rules(parts(src), rules)).withColumn("label", (weak_label() if label is None else label).cast("double"))
    rows = stored(_with_suffix_statistics(rows, cfg), "urls")
    labelled = rows.filter("label IS NOT NULL")
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    out = ["page_id", "host", "path", "rule"]
    if len(counts) < 2:
        verdict = "block" if list(counts) == [1.0] else "allow"
        return rows.select(*out, F.coalesce("rule_verdict", F.lit(verdict)).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    rare = min(counts, key=lambda y: (counts[y], y))
    taken = {rare: min(counts[rare], cfg.fit_rows // 2)}
    taken |= {y: min(n, cfg.fit_rows - taken[rare]) for y, n in counts.items() if y != rare}
    drawn = [
        labelled.filter(F.col("label") == y).orderBy(F.xxhash64("url", "page_id")).limit(k).withColumn("weight", F.lit(counts[y] / k)) for y, k in taken.items()
    ]
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = stored(drawn[0].union(drawn[1]).select(*FEATURES, "label", "weight"), "url-sample")
    model = GBTClassifier(maxIter=cfg.trees, maxDepth=cfg.depth, seed=2, weightCol="weight").fit(assemble.transform(train))
    scored = model.transform(assemble.transform(rows)).withColumn("block_score", vector_to_array("probability")[1])
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select(*out, verdict.alias("verdict"), "block_score")
