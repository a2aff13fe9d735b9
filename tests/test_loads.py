"""Shard scan, insert-only ledger and incremental summaries."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rxgrid.operators.bronze import hashed
from rxgrid.sources import io, ledger
from rxgrid.streaming import incremental as P


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_a_thousand_shards_of_three_headers_make_three_scans(spark, tmp_path):
    headers = ["rxcui|name", "rxcui|tty|ndc", "ndc|rxcui"]
    for i in range(1000):
        h = headers[i % 3]
        _write(tmp_path / f"s{i:04d}.txt", h + "\n" + "|".join(f"{c}{i}" for c in h.split("|")) + "\n")
    _write(tmp_path / "bad1.txt", "name|tty\nx|y\n")
    _write(tmp_path / "bad2.txt", "rxcui|rxcui\n1|2\n")
    paths = [str(p) for p in sorted(tmp_path.iterdir())] + [str(tmp_path / "none.txt")]
    table, rejected = io.read_shards(spark, paths)
    assert table.count() == 1000 and set(table.columns) == {"rxcui", "name", "tty", "ndc"}
    assert table._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3
    assert table.where("rxcui = 'rxcui2'").first().ndc == "ndc2"
    got = {os.path.basename(r.path): r.reason for r in rejected.collect()}
    assert got == {"bad1.txt": "no column rxcui", "bad2.txt": "repeated column", "none.txt": "missing"}


def _rows(spark, ids):
    return hashed(spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string"))


def test_ledger_appends_once_and_replays_add_nothing(spark, tmp_path):
    target = str(tmp_path / "ledger")
    assert ledger.read(spark, target) is None
    assert ledger.append(_rows(spark, [*range(100), 5, 5]), target, "a") == 100
    assert ledger.append(_rows(spark, range(50, 150)), target, "b") == 50
    assert ledger.append(_rows(spark, range(50, 150)), target, "b") == 50  # the same delivery again replaces itself
    assert ledger.append(_rows(spark, range(150)), target, "c") == 0
    assert ledger.append(_rows(spark, []), target, "d") == 0
    got = ledger.read(spark, target)
    assert sorted(r.id for r in got.collect()) == list(range(150))
    one = got.where("id = 77").first().record_hash
    hit = ledger.lookup(spark, target, one)
    assert [r.id for r in hit.collect()] == [77]
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "prefix" in plan


def test_a_broken_attempt_is_replaced(spark, tmp_path):
    target = str(tmp_path / "ledger")
    ledger.append(_rows(spark, range(10)), target, "a")
    # an attempt at the next epoch left a part of its rows behind
    part = _rows(spark, range(5, 15)).withColumn("prefix", F.substring("record_hash", 1, ledger.PREFIX_DIGITS)).where("id = 12")
    part.write.partitionBy("prefix").parquet(f"{target}/epoch=b")
    assert ledger.append(_rows(spark, range(5, 15)), target, "b") == 5
    assert sorted(r.id for r in ledger.read(spark, target).collect()) == list(range(15))


def _feed(spark, path, day, ids, days):
    rows = [(i, dt.datetime(2024, 1, d, 3), i % 4, float(i)) for i, d in zip(ids, days, strict=True)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.mode("append").parquet(f"{path}/day=2024-01-{day:02d}")


def test_late_rows_count_and_a_restart_changes_nothing(spark, tmp_path):
    src, target, ckpt = (str(tmp_path / x) for x in ("src", "target", "ckpt"))
    _feed(spark, src, 1, range(20), [1] * 20)
    schema = spark.read.parquet(src).schema
    P.incremental_daily_summary(spark, src, schema, target, ckpt)
    _feed(spark, src, 28, range(20, 40), [28] * 20)
    P.incremental_daily_summary(spark, src, schema, target, ckpt)
    _feed(spark, src, 29, range(40, 50), [1] * 10)  # four weeks late
    P.incremental_daily_summary(spark, src, schema, target, ckpt)
    P.incremental_daily_summary(spark, src, schema, target, ckpt)  # nothing new
    got = {(r.user_id, r.day_start.day): (r.events, r.value_sum) for r in P.daily_summary(spark, target).collect()}
    want: dict = {}
    for i in range(50):
        k = (i % 4, 28 if 20 <= i < 40 else 1)
        n, v = want.get(k, (0, 0.0))
        want[k] = (n + 1, v + i)
    assert got == want


def test_a_replayed_stream_appends_nothing(spark, tmp_path):
    src, target = str(tmp_path / "src"), str(tmp_path / "target")
    _feed(spark, src, 1, range(20), [1] * 20)
    _feed(spark, src, 2, [*range(15, 30)], [1] * 5 + [2] * 10)  # five rows delivered twice
    schema = spark.read.parquet(src).schema
    P.incremental_insert_only(spark, src, schema, target, str(tmp_path / "c1"))
    P.incremental_insert_only(spark, src, schema, target, str(tmp_path / "c2"))  # the stream's checkpoint was lost: all batches run again
    assert sorted(r.event_id for r in ledger.read(spark, target).collect()) == list(range(30))


def test_permission_errors_are_not_taken_for_an_empty_target(spark):
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        ledger.read(spark, "nosuchscheme://x/y")
