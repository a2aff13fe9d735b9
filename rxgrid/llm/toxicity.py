"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the distinct terms of the whole text (lower
case, ASCII punctuation separates): words, and the stems that longer words begin with, so inflected
forms of one insult share evidence.  The factors let two terms weigh more, or less, together than apart,
such as an insult next to the name of a group.  Linear weights are trained by FTRL with an L1 penalty,
so terms without evidence weigh exactly nothing however long the text; factors are kept only for terms
with `min_rows` occurrences.  Training uses at most `fit_rows` labelled rows, chosen by a hash of the id.

Defined results: null and empty texts score the bias alone; without labelled rows of both kinds every
score is the smoothed share of label 1; several labels of one id count as toxic if one is; null ids are
scored but never learned from; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxgrid.llm.common import BASE, U64, Words, mix, packed, slices, text_bytes


@dataclass(frozen=True)
class Toxicity:
    bits: int = 18
    stems: tuple[int, ...] = (4, 5)
    factors: int = 4
    fit_rows: int = 20_000
    epochs: int = 6
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    factor_rate: float = 0.05
    factor_l2: float = 0.02
    min_rows: int = 5


@dataclass(frozen=True)
class FactorModel:
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def terms(texts: list[bytes], cfg: Toxicity, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, bucket) pairs; only buckets that are active, if given."""
    words = Words(texts, lower=True, letters=True)
    of = np.repeat(np.arange(len(texts)), np.diff(words.at))
    hashes, docs = [words.hashes], [of]
    letters = np.frombuffer(words.data.lower(), np.uint8)
    for k in cfg.stems:
        long_one = words.ends - words.starts > k
        own = np.full(int(long_one.sum()), k, np.uint64)
        for j in range(k):
            own = own * BASE + letters[words.starts[long_one] + j]
        hashes.append(mix(own))
        docs.append(of[long_one])
    bucket = (np.concatenate(hashes) >> U64(64 - cfg.bits)).astype(np.int64)
    doc = np.concatenate(docs)
    if active is not None:
        here = np.flatnonzero(active[bucket])
        bucket, doc = bucket[here], doc[here]
    both = np.unique(doc << cfg.bits | bucket)
    return both >> cfg.bits, both & ((1 << cfg.bits) - 1)


def _term_batches(cfg: Toxicity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, y = text_bytes(batch.column(0)), batch.column(1)
            for lo, hi in slices(texts):
                doc, bucket = terms(texts[lo:hi], cfg)
                edge = np.searchsorted(doc, np.arange(hi - lo + 1))
                rows = [packed(bucket[a:b].astype(np.int32)) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([y.slice(lo, hi - lo), pa.array(rows, pa.binary())], names=["y", "terms"])

    return run


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[np.ndarray, int]], cfg: Toxicity) -> FactorModel:
    """Factorization machine from (distinct buckets, label) examples."""
    size = 1 << cfg.bits
    y = np.array([r[1] for r in rows], float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    z, g2 = np.zeros(size), np.zeros(size)
    v = np.zeros((size, cfg.factors))
    v2 = np.full((size, cfg.factors), 1e-6)
    if not 0 < y.sum() < len(y):
        return FactorModel(bias, z, v)
    seen = np.zeros(size, np.int64)
    for at, _ in rows:
        seen[at] += 1
    often = seen >= cfg.min_rows
    v[often] = np.random.default_rng(7).normal(0, 0.01, (int(often.sum()), cfg.factors))
    rows = [(at[often[at]], t) for at, t in rows]

    def weights(at):
        own = z[at]
        return -np.sign(own) * np.maximum(np.abs(own) - cfg.l1, 0) / ((cfg.beta + np.sqrt(g2[at])) / cfg.alpha + cfg.l2)

    bias_g2 = 1.0
    for turn in range(cfg.epochs):
        for k in np.random.default_rng(turn).permutation(len(rows)).tolist():
            at, t = rows[k]
            w = weights(at)
            on = np.flatnonzero(w)  # factors join in once the term itself weighs something
            own = v[at[on]]
            total = own.sum(0)
            g = _sigmoid(bias + w.sum() + 0.5 * (total @ total - (own * own).sum())) - t
            bias_g2 += g * g
            bias -= 0.1 * g / np.sqrt(bias_g2)
            new = g2[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(g2[at])) / cfg.alpha * w
            g2[at] = new
            if len(on) > 1:
                gv = g * (total - own) + cfg.factor_l2 * own
                v2[at[on]] += gv * gv
                v[at[on]] -= cfg.factor_rate * gv / np.sqrt(v2[at[on]] + 1e-2)
    w = weights(np.arange(size))
    v[w == 0] = 0
    return FactorModel(bias, w, v)


def fit(docs: DataFrame, labels: DataFrame, cfg: Toxicity = Toxicity()) -> FactorModel:
    """Learns from documents(doc_id, text) and labels(doc_id, toxic)."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.fit_rows)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most fit_rows rows of two numbers
    rows = src.join(F.broadcast(own), "doc_id").select("text", "y").mapInArrow(_term_batches(cfg), "y int, terms binary").collect()
    examples = [(np.frombuffer(r.terms, np.int32), r.y) for r in rows]
    examples.sort(key=lambda r: (len(r[0]), r[0][:8].tolist(), r[1]))
    return train(examples, cfg)


def _score_batches(sent, cfg: Toxicity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        active = model.weights != 0
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for lo, hi in slices(texts):
                doc, bucket = terms(texts[lo:hi], cfg, active)
                n = hi - lo
                linear = np.bincount(doc, model.weights[bucket], n)
                pairs = np.zeros(n)
                for f in range(model.factors.shape[1]):
                    x = model.factors[bucket, f]
                    pairs += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(_sigmoid(model.bias + linear + pairs))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: FactorModel, cfg: Toxicity = Toxicity()) -> DataFrame:
    """(doc_id, score) for every row."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_score_batches(docs.sparkSession.sparkContext.broadcast(model), cfg), "doc_id long, score double")


def train_and_score(docs: DataFrame, labels: DataFrame, held_out: Column, cfg: Toxicity = Toxicity()) -> DataFrame:
    return score(docs, fit(docs, labels.filter(~held_out), cfg), cfg)
