"""Rule bitmask ledger: every rule is evaluated once per document, policies are applied later.

`ledger(docs)` adds the measurements and one `failed` bit mask (bit i = RULES[i] fails).
`apply_policy(ledger, policy)` turns the mask into a verdict with one bitwise AND, so a new policy
version never reads the texts again.  `ablations(ledger, policy)` counts, from the histogram of
masks, what each rule alone rejects.  Only built-in SQL functions are used.

Defined results: null or blank text has no words, all counts 0, and fails `few_words`; null ids pass
through; repeated rows are judged separately; extra columns are kept unless their name is one of the
ledger's own columns, which replace them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs")
_EDGE = " \t\n\x0b\f\r"

#: Rules in bit order; a rule's bit never moves, new rules are appended.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines AND n_lines > 3",
    "short_mean_word": "word_chars < 2 * n_words",
    "long_mean_word": "word_chars > 25 * n_words",
    "shouting": "2 * n_bangs > n_words",
}
#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(RULES),
}


def _bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def policy_mask(policy: str) -> int:
    return sum(_bit(r) for r in POLICIES[policy])


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    The windows' hashes are sorted with their positions, so equal windows are neighbours; the positions
    of repeated ones, sorted again, cover min(3, gap to the next) words each.
    """
    n = F.size(words)
    hashed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )

    def repeated(rows: Column) -> Column:
        last = F.size(rows) - 1
        same = F.filter(
            rows,
            lambda x, k: ((k > 0) & (F.get(rows, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(rows, k + 1)["h"] == x["h"])),
        )
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gaps = F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, p: F.struct(
                (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")
            ),
        )
        return gaps["n"]

    # let-bindings: transform over a one-element array evaluates the inner array once
    rows = F.get(F.transform(F.array(F.sort_array(hashed)), repeated), F.lit(0))
    return F.when(n >= 3, covered(rows)).otherwise(F.lit(0)).cast("long")


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns through a one-row generator: filters on them are not pushed below it, so each is evaluated once."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the measurements and the `failed` bit mask."""
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(F.col("_body"), F.lit(_EDGE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))
    own = {*MEASURES, "failed", "base_failed", "kept", "_words", "_lines", "_body"}
    base = docs.select(*[c for c in docs.columns if c not in own], body.alias("_body"))
    out = _once(base, {"_words": words, "_lines": F.filter(F.split(F.col("_body"), "\n"), lambda x: F.btrim(x, F.lit(_EDGE)) != "")})
    out = _once(out, {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.char_length("_body") - F.char_length(F.regexp_replace("_body", "[#*$%&|<>]", ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_bangs": (F.char_length("_body") - F.char_length(F.replace("_body", F.lit("!"), F.lit("")))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_words")),
    }).drop("_words", "_lines", "_body")
    bits = [F.when(F.expr(sql), F.lit(_bit(name))).otherwise(F.lit(0)) for name, sql in RULES.items()]
    return _once(out, {"failed": reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")})


def apply_policy(ledger_: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds `base_failed` and `kept` from the stored mask."""
    failed = F.col("failed")
    return ledger_.withColumns({
        "base_failed": failed.bitwiseAND(F.lit(policy_mask("base"))) != 0,
        "kept": failed.bitwiseAND(F.lit(policy_mask("base") | policy_mask(policy))) == 0,
    })


def ablations(ledger_: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents it fails, fails alone, and rejections left without it."""
    mask = policy_mask(policy)
    masks = ledger_.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(_bit(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    rows = masks.select("m", "n", rules.alias("r")).select("m", "n", "r.rule", "r.bit")
    hit, rest = F.col("m").bitwiseAND(F.col("bit")) != 0, F.col("m").bitwiseAND(F.bitwise_not("bit"))
    return rows.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & (rest == 0), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(rest != 0, F.col("n")).otherwise(0)).alias("n_rejected_without"),
    )
