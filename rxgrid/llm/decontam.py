"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

A test item of tens of words inside a document of thousands has almost no Jaccard similarity with the
document, so both sides are partitioned by size.  Items fall into classes by their number of shingles,
(u/2, u] for u a power of two; for class u each document is cut into windows of 2u shingles that start
every u, so an item lies wholly inside one window whose size is near its own, and one MinHash value of
the window agrees with the item's with probability >= 1/4 of the containment.  With `hashes` values a
side, a contained item is missed with probability below (1 - containment/4)^hashes.  Windows of all classes come
from the minima of blocks of `BLOCK` shingles: the hashing work does not grow with the classes.

Candidate (document, item) pairs are verified exactly on the document's whole shingle set.

Items are processed in blocks of at most `item_block` rows, each with one pass over the documents, so
what is broadcast has a fixed bound however large the benchmark is.

Defined results: null or blank documents and items match nothing; an item under `width` words is one
shingle of its own length and is searched exactly among the documents' windows of that length; an item of
fewer than `BLOCK` shingles is searched exactly by each of its shingles; repeated items match separately; extra columns are ignored (`decontaminate` keeps those of the documents).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxgrid.llm.common import U64, Words, mix, slices, stored, text_bytes, windows_hash

BLOCK = 4


@dataclass(frozen=True)
class Decontam:
    width: int = 5
    percent: int = 75
    hashes: int = 48
    item_block: int = 20_000


def _family(cfg: Decontam) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(808)
    return rng.integers(0, 2**63, cfg.hashes, dtype=np.uint64), rng.integers(0, 2**63, cfg.hashes, dtype=np.uint64) * U64(2) + U64(1)


class _Index:
    """Items of one block: distinct shingles, and per size class the MinHash table (value -> items)."""

    def __init__(self, items: list[tuple[int, bytes]], cfg: Decontam):
        self.ids = [i for i, _ in items]
        words = Words([t for _, t in items], lower=True)
        n_words = np.diff(words.at)
        h, off = windows_hash(words.hashes, words.at, cfg.width)
        self.sets = [np.unique(h[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        self.short: dict[int, dict[int, list[int]]] = {}
        self.few: dict[int, list[int]] = {}  # shingles of items too small for the smallest window
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        xor, mul = _family(cfg)
        by_class: dict[int, list[int]] = {}
        for k, (s, n) in enumerate(zip(self.sets, n_words.tolist(), strict=True)):
            if 0 < n < cfg.width:
                self.short.setdefault(n, {}).setdefault(int(s[0]), []).append(k)
            elif n and len(s) < BLOCK:
                for x in s.tolist():
                    self.few.setdefault(x, []).append(k)
            elif n:
                by_class.setdefault(1 << (len(s) - 1).bit_length(), []).append(k)
        for u, members in by_class.items():
            value = np.concatenate([[mix(((s ^ xor[j]) * mul[j]).min()[None] ^ U64(j))[0] for j in range(cfg.hashes)] for s in (self.sets[k] for k in members)])
            item = np.repeat(np.array(members), cfg.hashes)
            order = np.argsort(value, kind="stable")
            value, item = value[order], item[order]
            bits = np.zeros(1 << 20, bool)
            bits[(value >> U64(44)).astype(np.int64)] = True
            self.classes[u] = (value, item, bits)

    def candidates(self, h: np.ndarray, off: np.ndarray, words: Words, cfg: Decontam) -> list[tuple[int, int]]:
        """(text, item) pairs to verify: those that agree in a MinHash value of some window."""
        found: set[tuple[int, int]] = set()
        n = np.diff(off)
        blocks = -(-n // BLOCK)
        at = np.cumsum(blocks) - blocks
        if self.classes and blocks.sum():
            doc = np.repeat(np.arange(len(n)), blocks)
            start = np.repeat(off[:-1], blocks) + BLOCK * (np.arange(len(doc)) - np.repeat(at, blocks))
            last = np.repeat(at + blocks, blocks)  # past the last block of the text
            here = np.arange(len(doc))
            xor, mul = _family(cfg)
            for j in range(cfg.hashes):
                low = np.minimum.reduceat((h ^ xor[j]) * mul[j], start)
                size = BLOCK
                for u in sorted(self.classes):
                    while size < u:  # low[b] becomes the minimum of blocks b .. b + size/BLOCK - 1
                        low = np.minimum(low, low[np.minimum(here + size // BLOCK, last - 1)])
                        size *= 2
                    pick = np.flatnonzero((here - np.repeat(at, blocks)) % (u // BLOCK) == 0)
                    two = mix(np.minimum(low[pick], low[np.minimum(pick + u // BLOCK, last[pick] - 1)]) ^ U64(j))
                    value, item, bits = self.classes[u]
                    hit = np.flatnonzero(bits[(two >> U64(44)).astype(np.int64)])
                    lo, hi = np.searchsorted(value, two[hit], "left"), np.searchsorted(value, two[hit], "right")
                    for w in np.flatnonzero(hi > lo).tolist():
                        d = int(doc[pick[hit[w]]])
                        found.update((d, int(k)) for k in item[lo[w] : hi[w]])
        if self.few:
            for w in np.flatnonzero(np.isin(h, np.fromiter(self.few, np.uint64, len(self.few)))).tolist():
                d = int(np.searchsorted(off, w, "right") - 1)
                found.update((d, k) for k in self.few[int(h[w])])
        for width, table in self.short.items():
            g, o = windows_hash(words.hashes, words.at, width)
            keys = np.fromiter(table, np.uint64, len(table))
            for w in np.flatnonzero(np.isin(g, keys)).tolist():
                d = int(np.searchsorted(o, w, "right") - 1)
                if words.at[d + 1] - words.at[d] >= width:
                    found.update((d, k) for k in table[int(g[w])])
        return sorted(found)


def _match_batches(index_rows, cfg: Decontam):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_shingles", pa.int64()), ("shared", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(index_rows.value, cfg)
        for batch in batches:
            texts, ids = text_bytes(batch.column(1)), batch.column(0)
            for lo, hi in slices(texts):
                words = Words(texts[lo:hi], lower=True)
                h, off = windows_hash(words.hashes, words.at, cfg.width)
                rows = []
                for d, k in index.candidates(h, off, words, cfg):
                    own = index.sets[k]
                    n_words = int(words.at[d + 1] - words.at[d])
                    short = next((w for w, t in index.short.items() if k in t.get(int(own[0]), ())), 0) if len(own) == 1 else 0
                    both = 1 if short else (int(np.isin(own, h[off[d] : off[d + 1]]).sum()) if n_words >= cfg.width else 0)
                    if 100 * both >= cfg.percent * len(own):
                        rows.append((ids[lo + d].as_py(), index.ids[k], len(own), both))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return run


def contained_items(
    docs: DataFrame, items: DataFrame, cfg: Decontam = Decontam(), text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared) for items at least `percent` contained in a document."""
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    own = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    own = own.filter(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r")) != "")
    rows = own.toLocalIterator()
    out = spark.createDataFrame([], "doc_id long, item_id long, item_shingles long, shared long")
    block = [(r.item_id, r.text.encode()) for r in islice(rows, cfg.item_block)]
    while block:
        following = [(r.item_id, r.text.encode()) for r in islice(rows, cfg.item_block)]
        sent = spark.sparkContext.broadcast(block)
        found = src.mapInArrow(_match_batches(sent, cfg), out.schema)
        if not following and out.isEmpty():
            return found
        out = out.union(stored(found))
        sent.destroy()
        block = following
    return out


def decontaminate(docs: DataFrame, items: DataFrame, cfg: Decontam = Decontam(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that contain no test item; rows without an id go by the hash of their own text."""

    def clean(rows: DataFrame, key: str) -> DataFrame:
        hit = stored(contained_items(rows, items, cfg, text, key).select(F.col("doc_id").alias(key)).distinct())
        return rows.join(hit, key, "left_anti").select(*docs.columns)

    unnamed = docs.filter(F.col(doc_id).isNull()).withColumn("_text_hash", F.xxhash64(text))
    return clean(docs.filter(F.col(doc_id).isNotNull()), doc_id).union(clean(unnamed, "_text_hash"))
