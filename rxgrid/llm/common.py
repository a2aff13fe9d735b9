"""Shared helpers: table access, shared scratch folder, vectorised words and 64-bit hashing.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, found for a whole
Arrow slice at once.  A word's 64-bit hash is a polynomial over a fixed random
byte table, so equal words hash alike on every executor and in every run.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text bytes handled by one vectorised step inside a task (a longer text makes a step of its own).
SLICE_BYTES = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="rxgrid-llm-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back.

    A checkpoint would keep the constraints of the plan before it, which grow without end in loops.
    """
    at = new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_of(doc_id, modulus: int):
    """crc32 of the id's text, modulo `modulus` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = powers(4096)


class Words:
    """Words of a slice of texts: `hashes`, byte `starts`/`ends` in `data`, and `at` (word offsets per text)."""

    __slots__ = ("data", "starts", "ends", "hashes", "at")

    def __init__(self, texts: list[bytes], lower: bool, letters: bool = False):
        self.data = b"\n".join(texts) + b"\n"
        a = np.frombuffer(self.data, np.uint8)
        word = ~(_NOT_LETTER if letters else _SPACE)[a]  # letters: ASCII punctuation separates too
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate([np.zeros(1, edge.dtype), edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.at = np.concatenate([np.zeros(1, np.int64), np.searchsorted(self.starts, ends)])
        n = len(self.starts)
        if not n:
            self.hashes = np.zeros(0, np.uint64)
            return
        size = self.ends - self.starts
        flat = np.flatnonzero(word)
        first = np.cumsum(size) - size
        k = np.arange(len(flat)) - np.repeat(first, size)
        pw = _POW if size.max() <= len(_POW) else powers(int(size.max()))
        letters = _LOWER[a[flat]] if lower else a[flat]
        self.hashes = mix(np.add.reduceat(_BYTE[letters] * pw[k], first) + size.astype(np.uint64) * BASE)

    def texts(self, at: int) -> list[bytes]:
        """Words of one text, as bytes."""
        lo, hi = self.at[at], self.at[at + 1]
        return [self.data[s:e] for s, e in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist(), strict=True)]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about `limit` bytes."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def text_bytes(column) -> list[bytes]:
    """Texts of an Arrow column as bytes (null: empty)."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def windows_hash(h: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `width`-word windows inside each text, and the windows' offsets per text.

    A text with fewer words than `width`, but at least one, gives its whole sequence as one window.
    """
    n = np.diff(at)
    short = (n > 0) & (n < width)
    count = np.where(short, 1, np.maximum(n - width + 1, 0))
    off = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    if not off[-1]:
        return np.zeros(0, np.uint64), off
    out = np.zeros(off[-1], np.uint64)
    start = np.repeat(at[:-1] - off[:-1], count) + np.arange(off[-1])
    full = np.repeat(~short, count)
    s = start[full]
    if len(s):
        acc = np.zeros(len(s), np.uint64)
        for k in range(width):
            acc = acc * BASE + h[s + k]
        out[full] = mix(acc + U64(width))
    for i in np.flatnonzero(short):
        acc = 0
        for x in h[at[i] : at[i + 1]].tolist():
            acc = (acc * int(BASE) + x) % 2**64
        out[off[i]] = mix(np.array([(acc + int(n[i])) % 2**64], np.uint64))[0]
    return out, off


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
