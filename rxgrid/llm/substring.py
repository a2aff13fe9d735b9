"""Substring dedup by recompression: locally consistent names reveal repeated windows.

Naming.  Every word starts as a symbol.  A round renames maximal runs of one symbol (a, k), or the
pairs (a, b) whose hashes put a left and b right, by a 64-bit name of the parts; names are therefore
global: equal text gets equal symbols on every executor without any exchange.  With each symbol goes
the interval of words that its existence depends on.  A symbol whose interval lies inside a window is an
interior symbol of it: any equal window has the same one at the same place, whatever surrounds it.

Search.  Each `window`-word window picks one interior symbol (of the highest round that has one, the
smallest name; a bare word always qualifies), and its anchor is the name of the words in that symbol's
interval.  Equal windows pick equal anchors, so
  round trip 1: anchors go to hash buckets; those met twice or more are returned to their documents,
  round trip 2: only windows with a shared anchor go, with their own 96-bit hash, to hash buckets,
    which keep the earliest occurrence (doc_id, start) and return every other one to its document.
Tasks drop repeats of their own before sending, so a passage that a third of all documents share costs
one entry per task.  Entries travel as packed columns per bucket, not as rows.

Defined results: null text has no words and yields an empty text; texts under `window` words are
unchanged but for white space; rows repeating id and text are one document twice (same result, neither
removes the other); a null id sorts after all others; extra columns pass through `dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxgrid.llm.common import BASE, BASE_INV, U64, Words, mix, packed, partitions, powers, slices, stored, text_bytes

WINDOW = 20
#: Rounds of renaming: each starts with pairs; those listed rename runs first.
ROUNDS, RUN_ROUNDS = 3, (0, 2)
#: Windows kept in a task before they are sent on.
FLUSH = 500_000
_FAR = 1 << 60


class _Level:
    """Symbols of one round: names, intervals of words they depend on, and the text they belong to."""

    __slots__ = ("name", "lo", "hi", "doc")

    def __init__(self, name, lo, hi, doc):
        self.name, self.lo, self.hi, self.doc = name, lo, hi, doc


def _neighbours(level: _Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals with the left and with the right neighbour's (outside a text: unbounded); `joined`: i and i+1 share a text."""
    joined = level.doc[1:] == level.doc[:-1]
    left = np.full(len(level.name), -_FAR)
    right = np.full(len(level.name), _FAR)
    left[1:][joined] = level.lo[:-1][joined]
    right[:-1][joined] = level.hi[1:][joined]
    return left, right, joined


def _runs(level: _Level) -> _Level:
    left, right, joined = _neighbours(level)
    same = joined & (level.name[1:] == level.name[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    last = np.concatenate([first[1:], [len(level.name)]]) - 1
    k = (last - first + 1).astype(np.uint64)
    name = np.where(k > 1, mix(level.name[first] + k * BASE), level.name[first])
    return _Level(name, left[first], right[last], level.doc[first])


def _pairs(level: _Level, turn: int) -> _Level:
    left, right, joined = _neighbours(level)
    side = (mix(level.name ^ U64(turn * 0x51ED2701 + 7)) >> U64(63)).astype(bool)
    opens = np.zeros(len(side), bool)
    opens[:-1] = joined & ~side[:-1] & side[1:]
    closes = np.zeros(len(side), bool)
    closes[1:] = opens[:-1]
    nxt = np.flatnonzero(opens) + 1
    name, lo, hi = level.name.copy(), level.lo.copy(), level.hi.copy()
    name[opens] = mix(level.name[opens] * BASE + level.name[nxt])
    hi[opens] = level.hi[nxt]
    alone = ~opens & ~closes
    hi = np.where(alone & ~side, np.maximum(hi, right), hi)  # it is alone because the next one is no right half
    lo = np.where(alone & side, np.minimum(lo, left), lo)  # or because the one before is no left half
    keep = ~closes
    return _Level(name[keep], lo[keep], hi[keep], level.doc[keep])


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every full window: text, first word (in the slice), anchor, and the anchor's first word."""
    n = np.diff(words.at)
    count = np.maximum(n - window + 1, 0)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    off = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(n)), count)
    start = np.arange(total) - np.repeat(off - words.at[:-1], count)
    i = np.arange(len(words.hashes))
    levels = [_Level(words.hashes, i, i, np.repeat(np.arange(len(n)), n))]
    for turn in range(ROUNDS):
        level = levels[-1]
        if turn in RUN_ROUNDS:
            level = _runs(level)
        levels.append(_pairs(level, turn))
    lo, hi = np.full(total, -1), np.full(total, -1)
    todo = np.arange(total)
    for level in reversed(levels):
        rank = mix(level.name)
        left = np.searchsorted(np.maximum.accumulate(level.lo), start[todo], "left")
        stop = np.searchsorted(np.minimum.accumulate(level.hi[::-1])[::-1], start[todo] + window - 1, "right")
        best = np.full(len(todo), -1)
        smallest = np.full(len(todo), ~U64(0))
        at = left.copy()
        live = np.flatnonzero(at < stop)
        while len(live):
            a = at[live]
            fits = (level.lo[a] >= start[todo[live]]) & (level.hi[a] < start[todo[live]] + window)
            better = fits & ((rank[a] < smallest[live]) | (best[live] < 0))
            best[live[better]] = a[better]
            smallest[live[better]] = rank[a[better]]
            at[live] += 1
            live = live[at[live] < stop[live]]
        found = best >= 0
        lo[todo[found]], hi[todo[found]] = level.lo[best[found]], level.hi[best[found]]
        todo = todo[~found]
        if not len(todo):
            break
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hashes * powers(len(i)), dtype=np.uint64)])
    back = powers(len(i), BASE_INV)
    anchor = mix((prefix[hi + 1] - prefix[lo]) * back[lo] + (hi - lo).astype(np.uint64))
    return doc, start, anchor, lo


def _window_hashes(words: Words, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.zeros(len(start), np.uint64)
    b = np.zeros(len(start), np.uint64)
    second = mix(words.hashes ^ U64(0x5DEECE66D))
    for k in range(window):
        a = a * BASE + words.hashes[start + k]
        b = b * BASE_INV + second[start + k]
    return mix(a), (mix(b) >> U64(32)).astype(np.uint32)


_SENT = pa.schema([("bucket", pa.int32()), ("told", pa.bool_()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_SENT_SQL = "bucket int, told boolean, a binary, b binary, c binary, d binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_SENT)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SENT, strict=True)], schema=_SENT)


def _bucketed(h: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    """Rows (bucket, False, columns…) with the entries of each bucket."""
    b = ((h >> U64(32)) % U64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    edges = np.searchsorted(b[order], np.arange(buckets + 1))
    columns = [x[order] for x in columns]
    for k in np.flatnonzero(np.diff(edges)).tolist():
        part = [packed(x[edges[k] : edges[k + 1]]) for x in columns]
        yield (k, False, *part, *[None] * (4 - len(part)))


def _told(key: np.ndarray, values: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows (any bucket, True, keys, values): what a task already knows about its own documents."""
    for lo in range(0, len(key), 50_000):
        yield (lo // 50_000 % buckets, True, packed(key[lo : lo + 50_000]), packed(values[lo : lo + 50_000]), None, None)


def _anchor_batches(window: int, buckets: int):
    def flush(anchor: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(anchor, kind="stable")
        edge = np.concatenate([[True], anchor[order[1:]] != anchor[order[:-1]]])
        first, many = np.zeros(len(order), bool), np.zeros(len(order), bool)
        first[order] = edge
        many[order] = ~edge | np.concatenate([~edge[1:], [False]])
        rows = list(_bucketed(anchor[first], [anchor[first], key[first]], buckets))
        return _rows(rows + list(_told(key[many], anchor[many], buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), text_bytes(batch.column(2))
            for a, b in slices(texts):
                doc, _, anchor, at = anchors(Words(texts[a:b], lower=False), window)
                if not len(doc):
                    continue
                # neighbouring windows share an anchor: one entry for each place that is one
                new = np.concatenate([[True], (at[1:] != at[:-1]) | (anchor[1:] != anchor[:-1])])
                kept.append((anchor[new], keys[a:b][doc[new]]))
                n += int(new.sum())
                if n > FLUSH:
                    yield flush(*map(np.concatenate, zip(*kept, strict=True)))
                    kept, n = [], 0
        if kept:
            yield flush(*map(np.concatenate, zip(*kept, strict=True)))

    return run


_REPLY = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("found", pa.binary())])
_REPLY_SQL = "bucket int, keys binary, found binary"


def _replies(key: np.ndarray, values: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed (key, value) entries for each bucket of documents."""
    b = (mix(key.view(np.uint64)) % U64(buckets)).astype(np.int64)
    order = np.lexsort((values, key, b))
    key, values = key[order], values[order]
    edges = np.searchsorted(b[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(edges)).tolist()
    cols = [full, [packed(key[edges[k] : edges[k + 1]]) for k in full], [packed(values[edges[k] : edges[k + 1]]) for k in full]]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _REPLY, strict=True)], schema=_REPLY)


def _per_document(kind):
    """One row (key, found) per document of a partition's buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0, kind)]
        for batch in batches:
            keys += [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            values += [np.frombuffer(x, kind) for x in batch.column(2).to_pylist()]
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        last = np.append(first[1:], len(key))
        for lo in range(0, len(first), 5_000):
            part = [packed(value[a:b]) for a, b in zip(first[lo : lo + 5_000], last[lo : lo + 5_000], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key[first[lo : lo + 5_000]]), pa.array(part, pa.binary())], names=["key", "found"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch], types: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """All packed entries of a partition: the buckets' columns, and what tasks told."""
    sent: list[list[np.ndarray]] = [[] for _ in types]
    told: tuple[list, list] = ([], [])
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(1, 6)], strict=True):
            if row[0]:
                told[0].append(np.frombuffer(row[1], np.int64))
                told[1].append(row[2])
            else:
                for k, t in enumerate(types):
                    sent[k].append(np.frombuffer(row[k + 1], t))
    return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(sent, types, strict=True)], told


def _shared_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (anchor, key), told = _gathered(batches, [np.uint64, np.int64])
        order = np.argsort(anchor, kind="stable")
        anchor, key = anchor[order], key[order]
        many = np.zeros(len(anchor), bool)
        same = anchor[1:] == anchor[:-1]
        many[1:] |= same
        many[:-1] |= same
        keys, values = [key[many], *told[0]], [anchor[many], *[np.frombuffer(x, np.uint64) for x in told[1]]]
        yield from _replies(np.concatenate(keys), np.concatenate(values), buckets)

    return run


def _order_of(doc_id: np.ndarray, null: np.ndarray) -> np.ndarray:
    return np.where(null, np.iinfo(np.int64).max, doc_id)


def _later(h: np.ndarray, h2: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the windows, and which of them repeat an earlier one (other place than the first)."""
    order = np.lexsort((pos, doc, h2, h))
    h, h2, doc, pos = h[order], h2[order], doc[order], pos[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
    group = np.flatnonzero(first)[np.cumsum(first) - 1]
    return order, (doc != doc[group]) | (pos != pos[group])


def _window_batches(window: int, buckets: int):
    def flush(h, h2, doc, key, pos) -> pa.RecordBatch:
        order, later_ = _later(h, h2, doc, pos)
        later = np.zeros(len(h), bool)
        later[order] = later_  # entries stay in document order, in which the columns compress well
        own = [h[~later], h2[~later], np.stack([doc[~later], key[~later]], 1), pos[~later]]
        rows = list(_bucketed(h[~later], own, buckets))
        return _rows(rows + list(_told(key[later], pos[later].astype(np.int32), buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        n = 0
        for batch in batches:
            keys, texts, found = batch.column(0).to_numpy(), _unpacked(batch.column(2), batch.column(3)), batch.column(4).to_pylist()
            ids = _order_of(batch.column(1).fill_null(0).to_numpy(), np.asarray(batch.column(1).is_null()))
            for a, b in slices(texts):
                words = Words(texts[a:b], lower=False)
                doc, start, anchor, _ = anchors(words, window)
                shared = np.zeros(len(doc), bool)
                edge = np.searchsorted(doc, np.arange(b - a + 1))
                for k in range(b - a):
                    lo, hi = edge[k], edge[k + 1]
                    if lo < hi:
                        mine = np.sort(np.frombuffer(found[a + k], np.uint64))
                        at = np.searchsorted(mine, anchor[lo:hi])
                        at[at == len(mine)] = 0
                        shared[lo:hi] = mine[at] == anchor[lo:hi]
                doc, start = doc[shared], start[shared]
                h, h2 = _window_hashes(words, start, window)
                kept.append((h, h2, ids[a:b][doc], keys[a:b][doc], (start - words.at[doc]).astype(np.int32)))
                n += len(h)
                if n > FLUSH:
                    yield flush(*map(np.concatenate, zip(*kept, strict=True)))
                    kept, n = [], 0
        if kept:
            yield flush(*map(np.concatenate, zip(*kept, strict=True)))

    return run


def _repeats(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (h, h2, both, pos), told = _gathered(batches, [np.uint64, np.uint32, np.int64, np.int32])
        doc, key = both.reshape(-1, 2).T
        order, later = _later(h, h2, doc, pos) if len(h) else (np.zeros(0, int), np.zeros(0, bool))
        keys = [key[order][later], *told[0]]
        values = [pos[order][later], *[np.frombuffer(x, np.int32) for x in told[1]]]
        yield from _replies(np.concatenate(keys), np.concatenate(values), buckets)

    return run


def _packed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first column's texts compressed, as they are to be shuffled; null stays null."""
    codec = pa.Codec("zstd", compression_level=3)
    for batch in batches:
        size, body = [], []
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            size.append(len(text or b""))
            body.append(codec.compress(text, asbytes=True) if text else None)
        names = ["body", "size", *batch.schema.names[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(body, pa.binary()), pa.array(size, pa.int64()), *batch.columns[1:]], names=names)


def _unpacked(body, size) -> list[bytes]:
    codec = pa.Codec("zstd")
    pairs = zip(body.to_pylist(), size.to_pylist(), strict=True)
    return [codec.decompress(b, n, asbytes=True) if b else b"" for b, n in pairs]


def _kept_batches(window: int, n_extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = _unpacked(batch.column(0), batch.column(1)), batch.column(2).to_pylist()
            n_words, n_removed, kept = [], [], []
            for text, parts in zip(texts, found, strict=True):
                words = text.split()
                n_words.append(len(words))
                if parts:
                    at = np.frombuffer(parts, np.int32)
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + window, -1)
                    stay = np.cumsum(step[:-1]) == 0
                    n_removed.append(len(words) - int(stay.sum()))
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words))
            new = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            names = ["kept_text", "n_words", "n_removed", *[f"c{i}" for i in range(n_extra)]]
            yield pa.RecordBatch.from_arrays(new + [batch.column(3 + i) for i in range(n_extra)], names=names)

    return run


def _key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def repeated_windows(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(key, found): for each document with repeats, packed int32 starts of windows that start earlier elsewhere."""
    spark = docs.sparkSession
    n = partitions(spark)
    buckets = 2 * n
    body, ident = F.col(text).cast("string"), F.col(doc_id).cast("long")
    src = docs.select(_key(ident, body).alias("key"), ident.alias("id"), body.alias("text"))
    def settled(sent: DataFrame, decide, kind) -> DataFrame:
        """Entries meet by hash bucket, decisions return by document."""
        decided = sent.repartition(n, "bucket").mapInArrow(decide, _REPLY_SQL)
        return decided.repartition(n, "bucket").mapInArrow(_per_document(kind), "key long, found binary")

    shared = settled(src.mapInArrow(_anchor_batches(window, buckets), _SENT_SQL), _shared_anchors(n), np.uint64)
    packed_ = src.select("text", "key", "id").mapInArrow(_packed_batches, "body binary, size long, key long, id long")
    doubted = packed_.join(shared, "key").select("key", "id", "body", "size", "found")
    return settled(doubted.mapInArrow(_window_batches(window, buckets), _SENT_SQL), _repeats(n), np.int32)


def dedup(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of `docs`, the text replaced by its kept words joined by one space, and n_words, n_removed."""
    repeats = stored(repeated_windows(docs, window, text, doc_id), "substring-repeats")
    rest = [c for c in docs.columns if c not in ("n_words", "n_removed", text)]
    body, ident = F.col(text).cast("string"), F.col(doc_id).cast("long")
    types = ", ".join(["", *[f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)]])
    own = [f"c{i}" for i in range(len(rest))]
    src = docs.select(body.alias("text"), _key(ident, body).alias("key"), *[F.col(c).alias(n) for c, n in zip(rest, own, strict=True)])
    small = src.mapInArrow(_packed_batches, f"body binary, size long, key long{types}")
    joined = small.join(repeats, "key", "left").select("body", "size", "found", *own)
    out = joined.mapInArrow(_kept_batches(window, len(rest)), f"kept_text string, n_words long, n_removed long{types}")
    named = {**dict(zip(rest, own, strict=True)), text: "kept_text"}
    return out.select(*[F.col(named[c]).alias(c) for c in docs.columns if c in named], "n_words", "n_removed")
