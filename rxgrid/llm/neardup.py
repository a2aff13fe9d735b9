"""MinHash near-duplicate classes with tensored banding.

Each document gets two small collections of half keys (`side` keys a side, each hashing `rows` MinHash
values).  A table key is a pair (left half i, right half j), so 2*side*rows MinHash values serve
side*side tables of 2*rows rows each: square-root work compared with separate bands.

1. `signatures`: set size, 128-bit digest of the 5-word shingle set, half keys (one pass, vectorised).
2. Equal sets collapse to one class (smallest id), so thousands of exact copies cost one row.
3. Half keys held by a single class are dropped before tables are formed: two classes share a table
   only if they share a half on each side.
4. In each table bucket the most central class (the one whose half keys are shared by most classes) is
   the hub; each other class is paired with it alone: no group is ever expanded into all its pairs.
5. Pairs are verified on full shingle sets; verified links become components (minimum label).
6. A bucket that holds classes apart from its hub's component goes on without that hub: its next most
   central class is the hub, and pairs not in one component yet are verified again (`hub_rounds` times).
7. Classes of buckets still open after these rounds meet by left half.  A task compares the classes of one
   half, in blocks of at most `2 * block` rows: a pair is taken at its first shared left half only, if it also
   shares a right half (so it meets in a table), is in different components, and if sizes and bit sets allow
   the similarity.  (A class's bit set marks the hashes of its shingles modulo `bits`; each bit of one class
   that the other lacks is a shingle the other lacks, so the bound never rejects a link.)  The pairs left over
   are verified.  So every pair of classes that meets in a table ends in one component or is ruled out
   exactly; nothing is capped, and no pair that is ruled out becomes a row.
   A pair of similarity s shares no table with probability 2q - q^2, q = (1 - s^rows)^side, which is
   `miss`: 3.6e-6 at 0.75.

Defined results: null or blank texts have size 0, link with nothing and are their own component; rows
repeated with one id are copies of each other; null ids never link; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxgrid.llm.common import U64, Words, mix, packed, partitions, slices, stored, text_bytes, windows_hash


@dataclass(frozen=True)
class NearDup:
    width: int = 5
    percent: int = 75
    side: int = 16
    rows: int = 2
    hub_rounds: int = 2
    #: Rows of a block of one half's classes, and length of a class's bit set.
    block: int = 2048
    bits: int = 1024


def miss(cfg: NearDup, similarity: float) -> float:
    """Probability that a pair shares no half on one of the sides, so meets in no table."""
    q = (1 - similarity**cfg.rows) ** cfg.side
    return 2 * q - q * q


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and their offsets."""
    words = Words(texts, lower=True)
    h, off = windows_hash(words.hashes, words.at, width)
    own = [np.unique(h[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in own])]).astype(np.int64)
    return (np.concatenate(own) if own else h), at


def _signature_batches(cfg: NearDup):
    n_hash = 2 * cfg.side * cfg.rows
    rng = np.random.default_rng(75)
    xor = rng.integers(0, 2**63, n_hash, dtype=np.uint64)
    mul = rng.integers(0, 2**63, n_hash, dtype=np.uint64) * U64(2) + U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for lo, hi in slices(texts):
                sets, at = shingle_sets(texts[lo:hi], cfg.width)
                size = np.diff(at)
                full = np.flatnonzero(size)
                start = at[:-1][full]
                digest = np.zeros((2, hi - lo), np.uint64)
                halves = np.zeros((2 * cfg.side, hi - lo), np.uint64)
                if len(full):
                    digest[0, full] = np.add.reduceat(mix(sets), start)
                    digest[1, full] = np.add.reduceat(mix(sets ^ U64(0xA5A5A5A5A5A5A5A5)), start)
                    for k in range(2 * cfg.side):
                        key = np.full(len(full), k + 1, np.uint64)
                        for r in range(cfg.rows):
                            j = k * cfg.rows + r
                            key = mix(key ^ np.minimum.reduceat((sets ^ xor[j]) * mul[j], start))
                        halves[k, full] = key
                flat = pa.array(halves.T.reshape(-1).view(np.int64))
                offsets = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * (2 * cfg.side))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).cast(pa.int64()),
                        pa.array(size.astype(np.int64)),
                        pa.array(digest[0].view(np.int64)),
                        pa.array(digest[1].view(np.int64)),
                        pa.ListArray.from_arrays(offsets, flat),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "halves"],
                )

    return run


def signatures(docs: DataFrame, cfg: NearDup = NearDup(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    schema = "doc_id long, n_shingles long, d1 long, d2 long, halves array<long>"
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(_signature_batches(cfg), schema)


def _bit_set(shingles: np.ndarray, bits: int) -> bytes:
    marks = np.zeros(bits, bool)
    marks[(mix(shingles) % U64(bits)).astype(np.int64)] = True
    return np.packbits(marks).tobytes()


def _set_batches(cfg: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for lo, hi in slices(texts):
                sets, at = shingle_sets(texts[lo:hi], cfg.width)
                own = [sets[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([packed(x) for x in own], pa.binary()),
                        pa.array([_bit_set(x, cfg.bits) for x in own], pa.binary()),
                    ],
                    names=["id", "shingles", "bits"],
                )

    return run


def _verified_batches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are at least `percent` similar."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_verified_batches(percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id with an edge: label = smallest id reachable.

    Each round takes the smallest label among an id and its neighbours, then jumps to the label's own
    label, so star-shaped groups settle in two rounds and chains in a logarithmic number.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        hop = step.select(F.col("id").alias("label"), F.col("label").alias("hop"))
        new = stored(step.join(hop, "label", "left").select("id", "old", F.least("label", F.coalesce("hop", "label")).alias("label")))
        if new.filter("label <> old").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")


def _hub_pairs(keys: DataFrame) -> DataFrame:
    """keys(key, a, weight) -> the same with b: the hub of the bucket, for each other class in it."""
    hubs = keys.groupBy("key").agg(F.max(F.struct("weight", (-F.col("a")).alias("neg"))).alias("hub"), F.count("*").alias("n"))
    hubs = stored(hubs.filter("n > 1").select("key", (-F.col("hub.neg")).alias("b")))
    return keys.join(hubs, "key").filter("a <> b").select("key", "a", "weight", "b")


def _possible(i: np.ndarray, j: np.ndarray, size: np.ndarray, words: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and bit sets allow the similarity of rows i and j."""
    a, b = words[i], words[j]
    both = np.minimum(size[i] - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), size[j] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
    return 100 * both >= percent * (size[i] + size[j] - both)


def _half_pairs(cfg: NearDup, slot: int, first: int, second: int, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the possible links between the blocks `first` and `second` of one left half's classes."""
    ids, labels, size, block = (np.array([r[k] for r in rows], np.int64) for k in range(4))
    halves = np.array([r[4] for r in rows], np.int64)
    words = np.frombuffer(b"".join(r[5] for r in rows), np.uint64).reshape(len(rows), -1)
    left, right = halves[:, : cfg.side], halves[:, cfg.side :]
    found = []
    others = np.flatnonzero(block == second)
    for at in np.flatnonzero(block == first):
        j = others[(labels[others] != labels[at]) & ((ids[others] > ids[at]) if first == second else True)]
        j = j[100 * np.minimum(size[j], size[at]) >= cfg.percent * np.maximum(size[j], size[at])]
        j = j[(right[j] == right[at]).any(axis=1)]
        j = j[(left[j] == left[at]).argmax(axis=1) == slot]
        if len(j):
            i = np.full(len(j), at)
            ok = _possible(i, j, size, words, cfg.percent)
            found.append((i[ok], j[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])


def _half_batches(cfg: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def pairs() -> pa.RecordBatch:
            a, b = _half_pairs(cfg, at[0], at[2], at[3], rows)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for key in zip(*(batch.column(k).to_pylist() for k in range(10)), strict=True):
                if rows and key[:4] != at:
                    yield pairs()
                    rows = []
                at = key[:4]
                rows.append(key[4:])
        if rows:
            yield pairs()

    return run


def _outsider_pairs(keys: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, cfg: NearDup) -> DataFrame:
    """keys(key, a, ...) -> possible links (a < b) between classes of different components that meet in a table."""
    member = keys.select("key", F.col("a").alias("id")).join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    apart = member.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    member = member.join(apart, "key", "left_semi").select("id", "label").distinct()
    member = stored(member.join(classes.select("id", "n_shingles", "halves"), "id").join(sets.dropDuplicates(["id"]).select("id", "bits"), "id"))
    row = member.select("id", "label", "n_shingles", F.posexplode(F.slice("halves", 1, cfg.side)).alias("slot", "half"))
    groups = row.groupBy("slot", "half").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y"))
    groups = groups.filter("x <> y").select("slot", "half", F.ceil(F.col("n") / cfg.block).cast("int").alias("blocks"))
    row = row.join(groups, ["slot", "half"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a row meets every block of its half: unordered pairs of blocks
    row = row.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    row = row.select("slot", "half", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "id", "label", "n_shingles", "block")
    row = row.join(member.select("id", "halves", "bits"), "id")
    row = row.select("slot", "half", "first", "second", "id", "label", "n_shingles", "block", "halves", "bits")
    order = ["slot", "half", "first", "second"]
    dealt = row.repartition(partitions(row.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_half_batches(cfg), "a long, b long")


def classes_and_labels(docs: DataFrame, cfg: NearDup, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Signatures of all documents, and (d1, d2, n_shingles, component_id) for every class."""
    sig = stored(signatures(docs, cfg, text, doc_id), "neardup-signatures")
    # smallest id of each set; ids tie-break on the value alone, copies have equal half keys
    classes = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n_shingles").agg(
        F.min("doc_id").alias("id"), F.first("halves").alias("halves")
    )
    classes = stored(classes, "neardup-classes")

    halves = classes.select("id", F.posexplode("halves").alias("slot", "half"))
    shared = stored(halves.groupBy("slot", "half").agg(F.count("*").alias("n")).filter("n > 1"))
    live = halves.join(shared, ["slot", "half"]).groupBy("id").agg(
        F.sum("n").alias("weight"), F.collect_list(F.struct("slot", "half")).alias("live")
    )
    left, right = F.filter("live", lambda x: x["slot"] < cfg.side), F.filter("live", lambda x: x["slot"] >= cfg.side)
    live = stored(live.filter((F.size(left) > 0) & (F.size(right) > 0)))
    keys = stored(
        live.select(F.col("id").alias("a"), "weight", left.alias("l"), right.alias("r"))
        .select("a", "weight", F.explode("l").alias("l"), "r")
        .select("a", "weight", "l", F.explode("r").alias("r"))
        .select(F.xxhash64("l.slot", "l.half", "r.slot", "r.half").alias("key"), "a", "weight")
    )
    hubbed = stored(_hub_pairs(keys))
    pairs = hubbed.select("a", "b").distinct()

    size = classes.select("id", "n_shingles")

    def plausible(p: DataFrame) -> DataFrame:
        """Pairs whose sizes allow the similarity."""
        sized = p.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
        return sized.filter(100 * F.least("na", "nb") >= cfg.percent * F.greatest("na", "nb")).select("a", "b")

    pairs = stored(plausible(pairs))
    members = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    members = stored(members.union(hubbed.select("a")).distinct())
    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    # rows of one id are copies of each other: any of its texts stands for it
    sets = stored(src.join(members, "id", "left_semi").mapInArrow(_set_batches(cfg), "id long, shingles binary, bits binary"), "neardup-sets")
    edges = stored(verified(pairs, sets, cfg.percent).distinct())
    labels = components(edges)
    tested = pairs
    left_over = hubbed
    for _ in range(cfg.hub_rounds):

        def apart(p: DataFrame, labels: DataFrame = labels) -> DataFrame:
            """Pairs that are not in one component yet."""
            la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
            both = p.join(la, "a", "left").join(lb, "b", "left")
            return both.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select(*p.columns)

        # buckets that hold a class apart from the hub go on without that hub
        open_keys = stored(apart(left_over.select("key", "a", "b")).select("key").distinct())
        left_over = stored(_hub_pairs(left_over.join(open_keys, "key", "left_semi").drop("b")))
        fresh = apart(left_over.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        fresh = stored(plausible(fresh))
        if fresh.isEmpty():
            continue
        edges = stored(edges.union(verified(fresh, sets, cfg.percent)).distinct())
        tested = stored(tested.union(fresh))
        labels = components(edges)
    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(_outsider_pairs(left_over, labels, classes, sets, cfg).join(known, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        labels = components(stored(edges.union(verified(rest, sets, cfg.percent)).distinct()))
    out = classes.join(labels, "id", "left").select("d1", "d2", "n_shingles", F.coalesce("label", "id").alias("component_id"))
    return sig, stored(out)


def near_duplicates(docs: DataFrame, cfg: NearDup = NearDup(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest linked id), kept."""
    sig, labels = classes_and_labels(docs, cfg, text, doc_id)
    full = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL").join(labels, ["d1", "d2", "n_shingles"])
    rest = sig.filter("n_shingles = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    out = full.select("doc_id", "n_shingles", "component_id").union(rest.select("doc_id", "n_shingles", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, cfg: NearDup = NearDup(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents of which one of each component stays: the one with the smallest id."""
    gone = near_duplicates(docs, cfg, text, doc_id).filter(~F.col("kept")).select(F.col("doc_id").alias(doc_id))
    return docs.join(gone, doc_id, "left_anti")
