r"""Line dedup: a line found in several documents stays in the first of them only.

1. Every text is split at \n; a line's key is the line without `[\x20\x09-\x0D]` at both ends, A-Z lowered.
   Keys of at least `min_chars` code points go on as (128-bit hash, doc_id), once per text.
2. Per hash: smallest and largest doc_id.  They differ where a key is found in two documents or more; the
   partial sums of each task go first, so a line that a third of all documents hold costs one row a task.
3. The lines of such hashes meet their verdict again and return, per document, the hashes that it loses.
4. Each text drops its lines of these hashes and is put together by position.

Defined results: null and empty texts are one empty line, which stays; rows that share a doc_id are one
document; rows with a null id are one document that comes after all others; a document that holds a key
several times keeps all of them if it is the first to hold it, else loses all; extra columns pass through
unless they are named n_lines or n_dropped, which the operator's own columns replace; an empty table gives
no rows; very long texts are handled line by line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxgrid.llm.common import stored

_EDGE = b" \t\n\x0b\f\r"
MIN_CHARS = 10


def line_hash(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of a line's key; None where the key is too short."""
    key = line.strip(_EDGE).lower()  # bytes.lower: A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _hash_batches(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                own = {line_hash(line, min_chars) for line in (text.as_py() or b"").split(b"\n")} - {None}
                hashes += own
                ids += [doc_id] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.int64())], names=["hash", "id"])

    return run


def _kept_batches(min_chars: int, n_extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, lost in zip(batch.column(0).cast(pa.binary()), batch.column(1), strict=True):
                lines = (text.as_py() or b"").split(b"\n")
                n_lines.append(len(lines))
                if lost.is_valid:
                    gone = set(lost.as_py())
                    lines = [x for x in lines if line_hash(x, min_chars) not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(b"\n".join(lines))
            own = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                own + [batch.column(2 + i) for i in range(n_extra)], names=["kept_text", "n_lines", "n_dropped", *[f"c{i}" for i in range(n_extra)]]
            )

    return run


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(hash, id), one row per text and key."""
    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(_hash_batches(min_chars), "hash binary, id long")


def shared_lines(lines: DataFrame) -> DataFrame:
    """(hash, first) for the hashes found in two documents or more; `first` is the document that keeps them."""
    seen = lines.groupBy("hash").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("unnamed")
    )
    return seen.filter("first <> last OR (unnamed AND first IS NOT NULL)").select("hash", "first")


def lost_lines(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, lost): for each document that is not the first to hold a shared line, the hashes of such lines."""
    found = lines.join(shared, "hash").filter("id IS NULL OR id <> first")
    return found.groupBy("id").agg(F.collect_set("hash").alias("lost"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of `docs`, the text without its lost lines, and n_lines (before) and n_dropped."""
    lines = stored(line_hashes(docs, min_chars, text, doc_id), "lines")
    lost = lost_lines(lines, stored(shared_lines(lines), "lines-shared"))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped", text)]
    own = [f"c{i}" for i in range(len(rest))]
    src = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("id"), *[F.col(c).alias(n) for c, n in zip(rest, own, strict=True)])
    joined = src.join(lost.withColumnRenamed("id", "lost_id"), F.col("id").eqNullSafe(F.col("lost_id")), "left").select("text", "lost", *own)
    types = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(rest, own, strict=True))
    out = joined.mapInArrow(_kept_batches(min_chars, len(rest)), f"kept_text string, n_lines long, n_dropped long{types}")
    named = {**dict(zip(rest, own, strict=True)), text: "kept_text"}
    return out.select(*[F.col(named[c]).alias(c) for c in docs.columns if c in named], "n_lines", "n_dropped")
