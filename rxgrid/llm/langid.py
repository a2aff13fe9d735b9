"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams (1-3 characters, lower case) of the whole text, log(1 + count) * idf, unit
length.  Document frequencies cover all training rows; weights are trained by follow-the-regularised-
leader (per-coordinate rates, L1 and L2 penalties) on at most `fit_rows` labelled rows, balanced over
languages and chosen by hash; a fifth of them fits the temperature that calibrates the probabilities.

Defined results: null texts and texts without a letter are `und` with score 0; without labelled rows
every text is; ties go to the first language in alphabetical order; rows without a language are not
learned from; null ids are scored, and learned from like others; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxgrid.llm.common import U64, mix, packed

_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LangId:
    dims: int = 1 << 15
    sizes: tuple[int, ...] = (1, 2, 3)
    fit_rows: int = 4000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05


@dataclass(frozen=True)
class LangModel:
    langs: tuple[str, ...]
    weights: np.ndarray  # (dims, languages), idf folded in
    idf: np.ndarray
    bias: np.ndarray
    temperature: float


def ngram_counts(text: str, cfg: LangId) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    total = np.zeros(cfg.dims, np.int64)
    for lo in range(0, max(len(codes), 1), 1 << 20):
        for n in cfg.sizes:
            part = codes[lo : lo + (1 << 20) + n - 1]
            if len(part) < n:
                continue
            key = part[: len(part) - n + 1].copy()
            for k in range(1, n):
                key = key * U64(0x110003) + part[k : len(part) - n + 1 + k]
            h = (key + U64(n << 56)) * U64(0x9E3779B97F4A7C15)
            total += np.bincount((h >> U64(64 - 15) if cfg.dims == 1 << 15 else mix(h) % U64(cfg.dims)).astype(np.int64), minlength=cfg.dims)
    at = np.flatnonzero(total)
    return at, total[at]


def vector(text: str, idf: np.ndarray, cfg: LangId) -> tuple[np.ndarray, np.ndarray]:
    at, n = ngram_counts(text, cfg)
    x = np.log1p(n) * idf[at]
    norm = np.sqrt(x @ x)
    return at, x / norm if norm else x


def _frequency_batches(cfg: LangId):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(cfg.dims, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[ngram_counts(text, cfg)[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *df[at].tolist()], pa.int64())], names=["bucket", "n"])

    return run


def _vector_batches(cfg: LangId, idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, x = vector(text, idf.value, cfg)
                row = [pa.array([lang]), pa.array([packed(at.astype(np.int32))]), pa.array([packed(x.astype(np.float32))])]
                yield pa.RecordBatch.from_arrays(row, names=["lang", "at", "x"])

    return run


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, cfg: LangId) -> np.ndarray:
    """FTRL-proximal over examples (buckets, values, class); the last row of the result is the bias."""
    z = np.zeros((cfg.dims + 1, n_langs))
    g2 = np.zeros((cfg.dims + 1, n_langs))

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return -np.sign(own) * np.maximum(np.abs(own) - cfg.l1, 0) / ((cfg.beta + np.sqrt(g2[at])) / cfg.alpha + cfg.l2)

    for turn in range(cfg.epochs):
        for k in np.random.default_rng(turn).permutation(len(rows)).tolist():
            at, x, y = rows[k]
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            new = g2[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(g2[at])) / cfg.alpha * w
            g2[at] = new
    return weights(np.arange(cfg.dims + 1))


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    lo, hi, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _lowest_batches(k: int):
    """The k smallest distinct hashes of each language that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[str, np.ndarray] = {}
        for batch in batches:
            lang, order = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            for x in set(lang.tolist()):
                low[x] = np.unique(np.concatenate([low.get(x, order[:0]), order[lang == x]]))[:k]
        langs = [x for x, own in low.items() for _ in range(len(own))]
        orders = np.concatenate([*low.values(), np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(orders, pa.int64())], names=["lang", "o"])

    return run


def sample(src: DataFrame, langs: tuple[str, ...], cfg: LangId) -> DataFrame:
    """From (text, lang), an equal share of `fit_rows` distinct texts of every language: those of smallest hash."""
    keyed = src.withColumn("o", F.xxhash64("text", F.lit(4)))
    lowest = _lowest_batches(max(1, cfg.fit_rows // len(langs)))
    low = keyed.select("lang", "o").mapInArrow(lowest, "lang string, o long").repartition("lang").mapInArrow(lowest, "lang string, o long")
    bound = {r.lang: r.o for r in low.groupBy("lang").agg(F.max("o").alias("o")).collect()}
    at_most = F.coalesce(*[F.when(F.col("lang") == x, F.lit(bound[x])) for x in langs])
    return keyed.filter(F.col("o") <= at_most).select("text", "lang").distinct()


def fit(rows: DataFrame, cfg: LangId = LangId()) -> LangModel | None:
    """Learns from (text, lang)."""
    spark = rows.sparkSession
    src = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    src = src.filter("text IS NOT NULL AND lang IS NOT NULL AND lang <> 'und'")
    langs = tuple(sorted(r.lang for r in src.select("lang").distinct().collect()))
    if not langs:
        return None
    freq = src.select("text").mapInArrow(_frequency_batches(cfg), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = {r.bucket: r.n for r in freq.collect()}  # at most dims + 1 rows
    seen = np.zeros(cfg.dims)
    for b, n in df.items():
        if b >= 0:
            seen[b] = n
    idf = np.log((1 + df.get(-1, 0)) / (1 + seen)) + 1
    chosen = sample(src, langs, cfg)
    sent = spark.sparkContext.broadcast(idf)
    examples = [
        (np.append(np.frombuffer(r.at, np.int32), cfg.dims), np.append(np.frombuffer(r.x, np.float32), 1.0), langs.index(r.lang))
        for r in chosen.repartition(16).mapInArrow(_vector_batches(cfg, sent), "lang string, at binary, x binary").collect()
    ]
    examples.sort(key=lambda r: (r[2], len(r[0]), float(r[1].sum())))
    held, used = examples[::5], [r for i, r in enumerate(examples) if i % 5]
    w = ftrl(used, len(langs), cfg)
    logits = np.array([x @ w[at] for at, x, _ in held])
    t = _temperature(logits, np.array([y for *_, y in held])) if len(held) else 1.0
    return LangModel(langs, w[:-1].astype(np.float32), idf, w[-1], t)


def _predict_batches(sent, cfg: LangId):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            lang, score = [], []
            for text in batch.column(1).to_pylist():
                if model is None or text is None or not _LETTER.search(text):
                    lang.append("und")
                    score.append(0.0)
                    continue
                at, x = vector(text, model.idf, cfg)
                p = _softmax((x @ model.weights[at] + model.bias) / model.temperature)
                lang.append(model.langs[int(p.argmax())])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: LangModel | None, cfg: LangId = LangId()) -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return src.mapInArrow(_predict_batches(sent, cfg), "doc_id long, lang_pred string, score double")


def train_and_predict(docs: DataFrame, held_out: Column, cfg: LangId = LangId()) -> DataFrame:
    return predict(docs, fit(docs.filter(~F.coalesce(held_out, F.lit(False))), cfg), cfg)
