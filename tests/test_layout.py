"""Multi-column clustering: content unchanged, a lookup by any column skips most files."""

from pyspark.sql import functions as F

from rxgrid.sources import layout


def test_clustered_files_are_narrow_in_every_column(spark, tmp_path):
    df = spark.range(40_000).select(
        (F.xxhash64("id") % 1000).alias("a"), F.concat(F.lit("k"), F.lpad((F.abs(F.xxhash64("id", F.lit(1))) % 5000).cast("string"), 4, "0")).alias("b"),
        F.pow(F.rand(3), 8).alias("c"), F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id")).alias("id"),
    ).cache()
    stored = layout.write_clustered(df, str(tmp_path / "z"), ["a", "b"], 64)
    assert stored.count() == 40_000 and stored.exceptAll(df).isEmpty()
    shares = {r.column: r for r in layout.files_per_lookup(stored, ["a", "b"]).collect()}
    assert all(r.files == 64 and r.touched_share < 0.3 for r in shares.values()), shares
    by_one = df.repartitionByRange(64, "a", "b")
    by_one.write.parquet(str(tmp_path / "one"))
    worst = {r.column: r.touched_share for r in layout.files_per_lookup(spark.read.parquet(str(tmp_path / "one")), ["a", "b"]).collect()}
    assert worst["b"] > 0.9  # a sort by one column leaves the other everywhere


def test_nulls_one_value_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, "x"), (1, "x"), (2, "x"), (None, None)], "a int, b string")
    stored = layout.write_clustered(df, str(tmp_path / "n"), ["a", "b"], 4)
    assert sorted(map(str, stored.collect())) == sorted(map(str, df.collect()))
    assert layout.write_clustered(df.limit(0), str(tmp_path / "e"), ["a", "b"], 4).count() == 0


def test_interleaved_bits(spark):
    row = spark.range(1).select(layout.interleaved([F.lit(0b101), F.lit(0b011)], 3).alias("z")).first()
    assert row.z == 0b100111
