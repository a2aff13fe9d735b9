"""Insert-only ledger of rows known by their record hash.

Rows lie in ``epoch=<name>/prefix=<first digits of the hash>``.  A load reads the hashes of the prefixes it
touches only, and of other epochs only: its own epoch is written as a whole and replaces what an earlier,
interrupted attempt left, so a replayed micro-batch appends nothing.  Files carry a Bloom filter of their
hashes, by which a lookup of single records skips them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxgrid.session import path_exists, shared_table

#: Digits of the hash that name a partition: 16 partitions for one; more for larger ledgers.
PREFIX_DIGITS = 1
HASH = "record_hash"


def _prefix(hash_col: str):
    return F.substring(hash_col, 1, PREFIX_DIGITS)


def read(spark: SparkSession, target: str, schema=None) -> DataFrame | None:
    """All rows of the ledger with `epoch` and `prefix`; None where nothing was loaded yet."""
    if not path_exists(spark, target):
        return None
    reader = spark.read.option("basePath", target)
    return (reader.schema(schema) if schema is not None else reader).parquet(target)


def fresh_rows(new: DataFrame, target: str, epoch: str, hash_col: str = HASH) -> DataFrame:
    """Rows of `new`, one per hash, that no other epoch holds."""
    spark = new.sparkSession
    rows = new.dropDuplicates([hash_col]).withColumn("prefix", _prefix(hash_col))
    held = read(spark, target, f"{hash_col} string, epoch string, prefix string")
    if held is None:
        return rows
    touched = [r["prefix"] for r in rows.select("prefix").distinct().collect()]  # at most 16 ** PREFIX_DIGITS
    held = held.where((F.col("epoch") != epoch) & F.col("prefix").isin(touched)).select("prefix", hash_col)
    return rows.join(held, ["prefix", hash_col], "left_anti")


def append(new: DataFrame, target: str, epoch: str, hash_col: str = HASH) -> int:
    """Loads one delivery; returns the rows it added.  The same epoch again gives the same ledger."""
    spark = new.sparkSession
    rows = shared_table(new, "delivery")  # read for its prefixes and for its rows
    fresh = fresh_rows(rows, target, epoch, hash_col).repartition("prefix").sortWithinPartitions("prefix", hash_col)
    at = f"{target}/epoch={epoch}"
    (fresh.write.mode("overwrite").partitionBy("prefix")
     .option(f"parquet.bloom.filter.enabled#{hash_col}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(at))
    # an empty delivery leaves a folder without files and so without a schema
    return spark.read.schema(f"{hash_col} string").parquet(at).count()


def lookup(spark: SparkSession, target: str, record_hash: str, hash_col: str = HASH) -> DataFrame:
    """One record: its prefix alone is read, and Bloom filters skip the files without it."""
    return read(spark, target).where((F.col("prefix") == record_hash[:PREFIX_DIGITS]) & (F.col(hash_col) == record_hash))
