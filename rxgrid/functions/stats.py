"""Exact order statistics by digit selection: quantiles and NTILE without a sort.

A double becomes a 64-bit code of the same order.  To find the value of a given rank, the codes between the
smallest and the largest are cut into 65,536 digits and rows are counted per digit; the digit whose running
count reaches the rank is kept, and the codes that it really holds are cut again, until all of its rows are
equal: four rounds at most for any distribution of doubles, mostly one or two.  Equal values share one count,
each task sends at most 65,536 counts per group and open interval, and no group is ever sorted or held in a
task, however many rows or equal values it has.  (Quantiles of groups of at most SORTED_ROWS rows need no digits:
such a group is sorted whole, for one exchange of the values instead of some in each round.)  Rounds read the stored codes and write the open intervals
(at most one per wanted rank) to the shared folder, so that Spark knows their size when it joins.
NTILE finds the first row of every tile the same way and compares each row with these few rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxgrid.functions.joins import broadcast_if_small
from rxgrid.session import shared_table

_ALL = "_all"
DIGITS = 1 << 16
#: Groups of at most so many values are sorted whole; rows of a task that sorts them.
SORTED_ROWS, ROWS_PER_PARTITION = 100_000, 500_000
_BELOW = -(1 << 63) + 1


def _code(value: Column) -> Column:
    """64-bit integer that orders like the double (both zeros alike)."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.when(value == 0, F.lit(0.0)).otherwise(value))
    return bits.cast("long")


def _ordered(bits: Column) -> Column:
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(_BELOW * -1)))


def _digit(code: Column, lo: Column, hi: Column) -> Column:
    """Which of the 65,536 parts of [lo, hi] holds the code; never decreases with it."""
    half = F.shiftright(hi, 1) - F.shiftright(lo, 1)  # the whole span may exceed 64 bits
    narrow = F.call_function("div", code - lo, F.call_function("div", hi - lo, F.lit(DIGITS)) + 1)
    wide = F.call_function("div", F.shiftright(code, 1) - F.shiftright(lo, 1), F.call_function("div", half, F.lit(DIGITS)) + 1)
    return F.when(half >= (1 << 61), wide).otherwise(narrow).cast("int")


def _selected(rows: DataFrame, group: list[str], asks: DataFrame, payload: str) -> DataFrame:
    """(group, k, part, rest, n, code, payload): the wanted ranks' code is the same on n rows, `rest` of them come before.

    `rows` has the group, `_code` and the payload (a function of the code); `asks` has (group, lo, hi, k, rest,
    part): the k-th wanted rank is the 0-based rank `rest` among the group's codes from lo to hi.
    """
    found = []
    while True:
        interval = [*group, "lo", "hi"]
        opened = asks.select(*[F.col(c).alias(f"_g_{c}") for c in group], "lo", "hi").distinct()
        same = reduce(lambda x, y: x & y, [rows[c].eqNullSafe(opened[f"_g_{c}"]) for c in group])
        inside = rows.join(opened, same & rows["_code"].between(opened["lo"], opened["hi"]))
        counts = inside.groupBy(*interval, _digit(F.col("_code"), F.col("lo"), F.col("hi")).alias("_digit")).agg(
            F.count(F.lit(1)).alias("n"), F.min("_code").alias("_lo"), F.max("_code").alias("_hi"), F.min(payload).alias(payload))
        before = Window.partitionBy(*interval).orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        a = asks.select(*[F.col(c).alias(f"_a_{c}") for c in interval], "k", "rest", "part")
        mine = reduce(lambda x, y: x & y, [counts[c].eqNullSafe(a[f"_a_{c}"]) for c in interval])
        hit = counts.join(a, mine & (a["rest"] >= counts["_before"]) & (a["rest"] < counts["_before"] + counts["n"]))
        hit = hit.select(*group, F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "n", payload, "k", "part", (F.col("rest") - F.col("_before")).alias("rest"))
        hit = shared_table(hit, "ranks")
        found.append(hit.where("lo = hi").select(*group, "k", "part", "rest", "n", F.col("lo").alias("code"), payload))
        asks = hit.where("lo <> hi")
        if asks.isEmpty():
            return reduce(lambda x, y: x.unionByName(y), found)


def _asks(rows: DataFrame, group: list[str], wanted: list[Column]) -> DataFrame:
    """Wanted ranks of each group over all of its codes; `wanted` are structs (k, rest, part) that may use the row count `_n`."""
    ends = rows.groupBy(*group).agg(F.min("_code").alias("lo"), F.max("_code").alias("hi"), F.count(F.lit(1)).alias("_n"))
    return shared_table(ends.select(*group, "lo", "hi", F.inline(F.array(*wanted))), "ranks")


def _ask(k, rest: Column, part: Column) -> Column:
    return F.struct(F.lit(k).cast("int").alias("k"), rest.cast("long").alias("rest"), part.cast("double").alias("part"))


def exact_quantiles(
    df: DataFrame,
    value_col: str,
    fractions: dict[str, float],
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Exact linear-interpolated quantiles per group: one output column per name.

    Groups whose values are all null or NaN are absent (join to the group list
    when they are needed).  Equals ``percentile`` / ``quantile_cont``.
    """
    x = df.select(F.lit(0).alias(_ALL), *group_cols, F.col(value_col).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    # only the values are stored: a code is as wide as its value and made again on each pass
    rows = shared_table(x, "values")
    if not group_cols:
        return _quantiles_by_digit(rows, fractions, group_cols)
    sizes = rows.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"))
    large = shared_table(sizes.where(F.col("_n") > SORTED_ROWS).drop("_n"), "large-groups")  # one per SORTED_ROWS rows at most
    if large.isEmpty():
        return _quantiles_by_sorting(rows, fractions, group_cols)
    marked = broadcast_if_small(large.toDF(*[f"_l_{c}" for c in group_cols]))
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(marked[f"_l_{c}"]) for c in group_cols])
    small = _quantiles_by_sorting(rows.join(marked, same, "left_anti"), fractions, group_cols)
    return small.unionByName(_quantiles_by_digit(rows.join(marked, same, "left_semi"), fractions, group_cols))


def _quantiles_by_sorting(rows: DataFrame, fractions: dict[str, float], group_cols: Sequence[str]) -> DataFrame:
    """Quantiles of groups of at most SORTED_ROWS rows: one exchange, and each group's values sorted."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / ROWS_PER_PARTITION))
    dealt = rows.select(*group_cols, "_v").repartition(n, *group_cols)
    lists = dealt.groupBy(*group_cols).agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
    out = []
    for name, q in fractions.items():
        h = (F.size("_vs") - 1) * F.lit(float(q))
        lo, hi = (F.get("_vs", f(h).cast("int")) for f in (F.floor, F.ceil))
        out.append(F.when(lo == hi, lo).otherwise(lo + (h - F.floor(h)) * (hi - lo)).alias(name))
    return lists.select(*group_cols, *out)


def _quantiles_by_digit(rows: DataFrame, fractions: dict[str, float], group_cols: Sequence[str]) -> DataFrame:
    group = [_ALL, *group_cols]
    rows = rows.withColumn("_bits", _code(F.col("_v"))).select(*group, "_v", _ordered(F.col("_bits")).alias("_code"))
    asks = []
    for i, q in enumerate(fractions.values()):
        h = (F.col("_n") - 1) * F.lit(float(q))
        asks += [_ask(2 * i, F.floor(h), h - F.floor(h)), _ask(2 * i + 1, F.ceil(h), h - F.floor(h))]
    hits = _selected(rows, group, _asks(rows, group, asks), "_v")
    aggs = []
    for i, name in enumerate(fractions):
        lo, hi = (F.max(F.when(F.col("k") == 2 * i + s, F.col("_v"))) for s in (0, 1))
        part = F.max(F.when(F.col("k") == 2 * i, F.col("part")))
        # equal ends are taken as they are: infinite ones have no difference
        aggs.append(F.when(lo == hi, lo).otherwise(lo + part * (hi - lo)).alias(name))
    return hits.groupBy(*group).agg(*aggs).drop(_ALL)


def ntile(df: DataFrame, n: int, value_col: str, tie_col: str, out_col: str = "ntile") -> DataFrame:
    """``NTILE(n) OVER (ORDER BY value ASC NULLS FIRST, tie)`` of a table of one row per (value, tie), e.g. of plans.

    The value that starts each tile comes from digit selection; only the rows of these n - 1 values are put in
    order by the tie-breaking key.
    """
    v, tie = F.col(value_col).cast("double"), F.col(tie_col)
    # a null is below all doubles, whose codes do not reach the smallest long
    bits = F.when(v.isNull(), F.lit(0).cast("long")).otherwise(_code(F.coalesce(v, F.lit(0.0))))
    code = F.when(v.isNull(), F.lit(_BELOW)).otherwise(_ordered(F.col("_bits")))
    rows = df.select(F.lit(0).alias(_ALL), tie.alias("_tie"), v.alias(value_col), bits.alias("_bits"))
    rows = shared_table(rows.select(_ALL, "_tie", code.alias("_code")), "codes")
    size, more = F.floor(F.col("_n") / n), F.col("_n") % n
    wanted = [_ask(j, j * size + F.least(F.lit(j), more), F.lit(0.0)) for j in range(1, n)]  # a rank that no row has is not found
    hits = _selected(rows, [_ALL], _asks(rows, [_ALL], wanted), "_code")
    asked = hits.select("k", "rest", F.col("code").alias("_code"))
    place = F.row_number().over(Window.partitionBy("k").orderBy("_tie")) - 1
    first = rows.join(asked, "_code").withColumn("_at", place).where("_at = rest")
    firsts = first.groupBy().agg(F.collect_list(F.struct("_code", "_tie")).alias("_firsts"))  # one row of at most n - 1 places
    out = df.withColumn("_bits", bits).withColumn("_place", F.struct(code.alias("_code"), tie.alias("_tie")))
    reached = F.size(F.filter("_firsts", lambda x: x <= F.col("_place")))
    out = out.crossJoin(F.broadcast(firsts)).withColumn(out_col, (reached + 1).cast("int"))
    return out.drop("_firsts", "_bits", "_place")
