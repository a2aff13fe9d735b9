"""Multi-column physical clustering along a space-filling curve.

Each column's values become range numbers (quantile ranges, so skewed values spread evenly); the bits of the
numbers are interleaved, and rows are dealt to files by ranges of the result.  Every file then holds a small
box of each column instead of a slice of the first one, so a lookup by any of the columns skips most files
by their min/max statistics.  Only the order of rows depends on the cut points, never the content: they come
from a sample of at most ``SAMPLE`` rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxgrid.session import shared_table

#: Rows whose values choose the cut points, and bits of a column's range number.
SAMPLE, BITS = 20_000, 6
#: A file's rows are sorted by one task.
FILE_ROWS = 1_000_000


def cut_points(df: DataFrame, cols: list[str], bits: int = BITS, sample: int = SAMPLE) -> dict[str, list]:
    """At most 2^bits - 1 values per column that part its values into ranges of about equal size."""
    # the rows with the smallest hashes: the same for any partitioning, and each task keeps `sample` of them at most
    rows = df.select(*cols).orderBy(F.xxhash64(*[F.col(c).cast("string") for c in cols])).limit(sample).collect()
    cuts = {}
    for c in cols:
        values = sorted(r[c] for r in rows if r[c] is not None)
        picked = {values[len(values) * i >> bits] for i in range(1, 1 << bits)} if values else set()
        cuts[c] = sorted(picked)
    return cuts


def range_number(col: Column, cuts: list) -> Column:
    """How many cut points are at most the value (null: 0)."""
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x <= col)), F.lit(0))


def interleaved(numbers: list[Column], bits: int = BITS) -> Column:
    """The numbers' bits in turn, highest first."""
    parts = [
        F.shiftleft(F.shiftright(n, b).bitwiseAND(F.lit(1)).cast("long"), b * len(numbers) + len(numbers) - 1 - i)
        for i, n in enumerate(numbers) for b in range(bits)
    ]
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def write_clustered(df: DataFrame, path: str, cols: list[str], files: int, bits: int = BITS) -> DataFrame:
    """Full-refresh write of `df`, clustered by all of `cols`, in about `files` files, or more where they would be large.

    The rows are made once: cut points, the sampling of ranges and the write read them stored."""
    df = shared_table(df, "unclustered")
    files = max(files, math.ceil(df.count() / FILE_ROWS))
    cuts = cut_points(df, cols, bits)
    place = interleaved([range_number(F.col(c), cuts[c]) for c in cols], bits)
    ordered = df.withColumn("_place", place).repartitionByRange(files, "_place", *cols).sortWithinPartitions("_place", *cols)
    ordered.drop("_place").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def file_ranges(stored: DataFrame, cols: list[str]) -> DataFrame:
    """One row per file: rows, and min_<col>, max_<col> of every column."""
    ends = [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))]
    return stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *ends)


def files_per_lookup(stored: DataFrame, cols: list[str]) -> DataFrame:
    """(column, files, touched_share): the mean share of files whose range holds a value of the column, over its distinct values."""
    ranges = file_ranges(stored, cols)
    total = ranges.agg(F.count(F.lit(1)).alias("files"))
    out = []
    for c in cols:
        values = stored.where(F.col(c).isNotNull()).select(F.col(c).alias("v")).distinct()
        boxes = ranges.agg(F.collect_list(F.struct(F.col(f"min_{c}").alias("lo"), F.col(f"max_{c}").alias("hi"))).alias("boxes"))  # one row, a pair per file
        held = values.crossJoin(F.broadcast(boxes)).select(F.size(F.filter("boxes", lambda b: (b["lo"] <= F.col("v")) & (F.col("v") <= b["hi"]))).alias("n"))
        mean = held.agg(F.avg("n").alias("n"))
        out.append(mean.crossJoin(total).select(F.lit(c).alias("column"), "files", (F.col("n") / F.col("files")).alias("touched_share")))
    return reduce(lambda x, y: x.unionByName(y), out)
