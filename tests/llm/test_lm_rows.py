"""Columns on their way between buckets."""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from rxgrid.llm import lm
from .test_llm_operators import brute_kneser_ney


def test_fine_buckets_share_a_row():
    rng = np.random.default_rng(5)
    bucket, key = rng.integers(0, 64, 500), rng.integers(0, 2**63, 500, dtype=np.uint64)
    count = rng.integers(1, 9, 500).astype(np.uint32)
    batch = lm._bundled(lm._rows_by(bucket, key, count, 64), 16)
    assert batch.column(0).to_pylist() == [0, 1, 2, 3]  # not one for each of the 64
    totals = []
    found = lm._received([batch, lm._told([(b"x", b"y")])], totals)
    assert totals == [(b"x", b"y")]
    for b, parts in found.items():
        k, n = lm._merged(parts)
        here = np.argsort(key[bucket == b], kind="stable")
        assert (k == key[bucket == b][here]).all() and (n == count[bucket == b][here]).all()
    assert sorted(found) == sorted(set(bucket.tolist()))


def test_buckets_follow_the_text(spark):
    texts = spark.range(0, 3000, 1, 16).selectExpr("concat_ws(' ', 'a', id % 7, id % 13, id) AS text")
    assert lm.train(texts).buckets == 1  # not one for each shuffle partition


def test_files_of_order_3_send_few_rows(tmp_path):
    """Whatever the fine buckets of a task, it sends at most a row of each kind to each bucket."""
    rng = np.random.default_rng(3)
    model = lm.Model(str(tmp_path), 8, (0, 2000), (3, 5, 7, 11, 2001), 1, 20_000, order=3)
    token = np.minimum(rng.zipf(1.2, 20_002) - 1, 1999)
    pair = lm._key(token[:-2], token[1:-1])
    h = lm._trigram_hash(pair, token[2:].astype(np.uint32))
    more = np.stack([token[2:], np.ones(20_000, int)], 1).astype(np.uint32)
    sent = lm._bundled(lm._rows_by(lm._trigram_bucket(pair, h, model), lm._swapped(pair), more, model.fine), model.fine // 8)
    rows = 0
    for b in range(8):
        own = sent.filter(pa.compute.equal(sent.column(0), b))
        told = list(lm._trigram_files(model)(iter([own])))
        told += list(lm._hot_files(model)(iter(told)))
        rows = max(rows, sum(x.num_rows for x in told))
    assert rows <= 3 * 8 + 2 + 8 + 3


@pytest.mark.parametrize("n", [100, 1 << 17])
def test_hashes_are_found_by_all_their_bits(tmp_path, n):
    rng = np.random.default_rng(n)
    h = rng.integers(0, 2**63, n, dtype=np.uint64) << np.uint64(1)
    h[: n // 2] = h[0] ^ np.arange(n // 2).astype(np.uint64)  # equal first bits
    h = np.unique(h)
    held, other = h[::2], h[1::2]
    count = rng.integers(1, 400, len(held))
    model = lm.Model(str(tmp_path), 1, (0, 10), (), 1, 10, order=3)
    lm._write_hashes(model, 0, [(held, count)])
    found = lm._looked_up(np.concatenate([held, other]), np.zeros(len(h), int), model, "trigrams", lm._found_hashes, np.uint8)[:, 0]
    assert (found[: len(held)] == count).all() and not found[len(held) :].any()


@pytest.mark.parametrize("order", [2, 3])
def test_many_buckets_and_frequent_words(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BUCKET_BYTES", 64)
    rng = np.random.default_rng(order)
    texts = ["", "a", None, *[" ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.5, int(rng.integers(1, 40))), 60)) for _ in range(120)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    model = lm.train(docs, order=order)
    assert model.buckets == 8 and 1 < len(model.hot)
    got = {r.doc_id: r.score for r in lm.score(docs, model).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(brute_kneser_ney([t or "" for t in texts], order))
