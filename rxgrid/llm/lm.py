"""Interpolated modified Kneser-Ney model of order 3 or 2: counted in Spark, stored as sorted arrays, memory-mapped by workers.

Training (two passes over the training texts, after one for their size, then a merge for each lower order):
1. words: tasks count their words' 64-bit hashes and send sorted (hash, count) columns by hash range;
   each range becomes one sorted file, a word's id is its rank over all ranges;
2. order 3: trigrams (id of context << 32 | id of context, id of word) are counted by tasks and sent by range of
   the middle word; a frequent one is spread by the context pair's hash, and a pair of two frequent words by
   the trigram's.  Each bucket is read in `fine` parts, so that one is small in memory, and becomes files: trigrams
   as sorted 64-bit hashes (the first 16 bits by place), the bigrams that begin with a middle word, and the pairs that
   end with one and are no context met once.  A bigram's value is in how many contexts it occurs (one that begins
   a text keeps its plain count), a context's its total and followers.  Only bigrams that begin with a frequent word
   and contexts of two of them are whole in no bucket; their parts are sent once more by hash;
   order 2: keys (id of context << 32 | id of word) are counted by tasks and sent by range of the
   context; contexts so frequent that a range would grow large are spread by the key's hash instead;
   each bucket becomes one sorted file of keys and counts;
3. per id: how many followers it has with count 1, 2 and 3+, and in how many contexts it occurs.
There are as many buckets as shuffle partitions, fewer where there is little text: each task sends a row to each.
Columns travel as differences and byte planes, compressed; the steps of 2 and 3 follow each other without a stored table.
The driver sees only a few numbers for each bucket.  Nothing is pruned: the model grows with the corpus.

Scoring maps the files (a folder that is not local is copied once per worker) and needs no shuffle.
Every text starts in its own context (its first token has no longer one) and closes with one end token.  Words never met have the share
1/(V+1) of the lowest order.  Discounts come from counts of counts at every order.

Defined results: null and empty texts are one end token; a null id counts as training text; repeated
rows count repeatedly; without training texts all scores are log10 of a uniform guess over the end
token's one class (0.0); extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxgrid.llm.common import SLICE_BYTES, U64, Words, mix, new_folder, packed, partitions, slices, text_bytes

FLUSH = 3_000_000
#: Text bytes whose tokens are looked up together.
CHUNK_BYTES = 6 * SLICE_BYTES
#: Text bytes a bucket holds at least (fewer buckets than shuffle partitions where there is little text).
BUCKET_BYTES = 4 << 20
_ROW = pa.schema([("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_ROW_SQL = "bucket int, a binary, b binary"


@dataclass(frozen=True)
class Model:
    """What every worker is told: where the files are, and a few numbers."""

    folder: str
    buckets: int
    offsets: tuple[int, ...]  # first id of each range of words
    hot: tuple[int, ...]  # ids of contexts spread over all buckets
    n_texts: int
    n_tokens: int
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    types: int = 0  # distinct bigrams
    low_backoff: float = 0.0
    order: int = 2
    top_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)  # of trigrams

    @property
    def n_words(self) -> int:
        return self.offsets[-1]

    @property
    def fine(self) -> int:
        """Buckets of trigrams and, at order 3, of bigrams."""
        return self.buckets * max(1, min(16, 4096 // self.buckets)) if self.order == 3 else self.buckets

    @property
    def end(self) -> int:
        return self.n_words

    @property
    def begin(self) -> int:
        return self.n_words + 1

    @property
    def vocabulary(self) -> int:
        return self.n_words + (self.n_texts > 0)


# files


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _write(folder: str, name: str, data: np.ndarray) -> None:
    """Whole or not at all: a task that runs again replaces the file by the same one."""
    system, at = _filesystem(folder)
    part = f"{at}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(packed(data))
    system.move(part, f"{at}/{name}")


_MAPPED: dict[tuple[str, str], np.ndarray] = {}


def _mapped(folder: str, name: str, kind) -> np.ndarray:
    if (folder, name) not in _MAPPED:
        system, at = _filesystem(folder)
        path = f"{at}/{name}"
        if not system.get_file_info(path).size:  # a range without entries has no file
            _MAPPED[folder, name] = np.zeros(0, kind)
            return _MAPPED[folder, name]
        if system.type_name != "local":
            own = os.path.join(tempfile.gettempdir(), uuid.uuid4().hex)
            with system.open_input_stream(path) as source, open(own, "wb") as copy:
                while block := source.read(1 << 22):
                    copy.write(block)
            path = own
        _MAPPED[folder, name] = np.memmap(path, kind, "r").view(np.ndarray)
    return _MAPPED[folder, name]


# tokens


def _word_range(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(40)) * U64(buckets) >> U64(24)).astype(np.int64)


def _sorted_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _squeezed(rows: np.ndarray) -> bytes:
    """Rows of numbers as planes of their bytes, compressed (small numbers leave planes of zeros)."""
    planes = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1).T
    return struct.pack("<QB", planes.size, len(planes)) + pa.compress(packed(planes), "zstd", asbytes=True)


def _unsqueezed(data: bytes, kind) -> np.ndarray:
    """The rows of `_squeezed`, in two dimensions."""
    size, width = struct.unpack_from("<QB", data)
    planes = np.frombuffer(pa.decompress(memoryview(data)[9:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind)


def _squeezed_keys(keys: np.ndarray) -> bytes:
    """Keys as differences modulo 2^64, which are small where keys are in order."""
    return _squeezed(np.diff(keys, prepend=U64(0)))


def _unsqueezed_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unsqueezed(data, np.uint64)[:, 0], dtype=np.uint64)


def _rows_by(bucket: np.ndarray, a: np.ndarray, b: np.ndarray, buckets: int) -> pa.RecordBatch:
    order = np.argsort(a)
    order = order[np.argsort(bucket[order].astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")]
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    a, b = a[order], b[order]
    full = np.flatnonzero(np.diff(edges)).tolist()
    parts = [slice(edges[k], edges[k + 1]) for k in full]
    cols = [full, [_squeezed_keys(a[x]) for x in parts], [_squeezed(b[x]) for x in parts]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROW, strict=True)], schema=_ROW)


def _bundled(sent: pa.RecordBatch, fine: int = 1, kind: int = 0) -> pa.RecordBatch:
    """A row for each `fine` buckets in turn: their numbers (and kind), sizes and `a` columns, and their `b` columns."""
    rows: dict[int, list[tuple[int, bytes, bytes]]] = {}
    for k, a, b in zip(*[c.to_pylist() for c in sent.columns], strict=True):
        rows.setdefault(k // fine, []).append((k, a, b))
    head = [packed(np.array([len(x), *[v for k, a, b in x for v in (kind << 32 | k, len(a), len(b))]], np.int64)) for x in rows.values()]
    cols = [list(rows), [h + b"".join(a for _, a, _ in x) for h, x in zip(head, rows.values(), strict=True)], [b"".join(b for _, _, b in x) for x in rows.values()]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROW, strict=True)], schema=_ROW)


def _counted(keys_of, bucket_of, buckets: int):
    """Tasks count the keys of their slices and send sorted columns by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for lo, hi in slices(texts):
                k, n = np.unique(keys_of(Words(texts[lo:hi], lower=True)), return_counts=True)
                keys.append(k)
                counts.append(n.astype(np.int64))
                size += len(k)
                if size > FLUSH:
                    k, n = _sorted_counts(keys, counts)
                    keys, counts, size = [k], [n], len(k)
                    if size > FLUSH // 2:
                        yield _bundled(_rows_by(bucket_of(k), k, n.astype(np.uint32), buckets))
                        keys, counts, size = [], [], 0
        if keys:
            k, n = _sorted_counts(keys, counts)
            yield _bundled(_rows_by(bucket_of(k), k, n.astype(np.uint32), buckets))

    return run


def _received(batches: Iterator[pa.RecordBatch], totals: list[tuple[bytes, bytes]]) -> dict[int, list[tuple[bytes, bytes]]]:
    """Columns by bucket; rows without a bucket carry totals."""
    found: dict[int, list[tuple[bytes, bytes]]] = {}
    for batch in batches:
        for row, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row < 0:
                totals.append((a, b))
                continue
            n = struct.unpack_from("<q", a)[0]
            at, from_b = 8 + 24 * n, 0
            for k, size_a, size_b in np.frombuffer(a, np.int64, 3 * n, 8).reshape(n, 3).tolist():
                found.setdefault(k, []).append((a[at : at + size_a], b[from_b : from_b + size_b]))
                at, from_b = at + size_a, from_b + size_b
    return found


def _merged(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their counts."""
    return _sorted_counts([_unsqueezed_keys(a) for a, _ in parts], [_unsqueezed(b, np.uint32)[:, 0].astype(np.int64) for _, b in parts])


def _told(totals: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    """Rows of totals on their way to the driver."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([[-1] * len(totals), *map(list, zip(*totals, strict=True))], _ROW, strict=True)], schema=_ROW)


def _coded(values: np.ndarray) -> np.ndarray:
    """A file of rows of counts: the most frequent rows are one byte each, the others stand behind their places."""
    flat = values[:, None] if values.ndim == 1 else values
    flat = np.ascontiguousarray(flat.astype(np.uint64 if flat.max(initial=0) >> 32 else np.uint32))
    whole = flat.view(np.dtype((np.void, flat.itemsize * flat.shape[1])))[:, 0]
    _, first, back, n = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    top = np.argsort(-n, kind="stable")[:255]
    code = np.full(len(n), 255, np.uint8)
    code[top] = np.arange(len(top))
    code = code[back]
    rest = np.flatnonzero(code == 255).astype(np.uint32)
    words = [np.array([len(top), len(rest), flat.itemsize], np.uint32), flat[first[top]], rest, flat[rest]]
    return np.concatenate([*[w.reshape(-1).view(np.uint8) for w in words], code])


def _decoded(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The rows of `_coded` at places `at`."""
    top, rest, size = data[:12].view(np.uint32).tolist()
    ends = np.cumsum([12, size * top * width, 4 * rest, size * rest * width]).tolist()
    table, place, rows = (data[lo:hi].view(f"u{n}") for lo, hi, n in zip(ends, ends[1:], (size, 4, size), strict=False))
    code = data[ends[-1] :][at]
    out = np.zeros((len(at), width), np.int64)
    usual = code < top
    out[usual] = table.reshape(-1, width)[code[usual]]
    out[~usual] = rows.reshape(-1, width)[np.searchsorted(place, at[~usual])]
    return out


def _word_files(folder: str):
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("top", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in _received(batches, []).items():
            k, n = _merged(parts)
            _write(folder, f"words-{bucket}", k)
            _write(folder, f"counts-{bucket}", _coded(n))
            top = np.argsort(-n, kind="stable")[:64]
            flat = np.stack([top, n[top]], 1).reshape(-1).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([bucket, len(k), int(n.sum()), flat], schema, strict=True)], schema=schema)

    return run


def _ids(u: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: never met) and counts of distinct words, given by their hashes in order."""
    ids, counts = np.full(len(u), -1), np.zeros(len(u), np.int64)
    edges = np.searchsorted(_word_range(u, model.buckets), np.arange(model.buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        part = u[edges[b] : edges[b + 1]]
        words = _mapped(model.folder, f"words-{b}", np.uint64)
        if not len(words):
            continue
        at = np.minimum(np.searchsorted(words, part), len(words) - 1)
        hit = np.flatnonzero(words[at] == part)
        ids[edges[b] + hit] = model.offsets[b] + at[hit]
        counts[edges[b] + hit] = _decoded(_mapped(model.folder, f"counts-{b}", np.uint8), at[hit], 1)[:, 0]
    return ids, counts


def _met(h: np.ndarray, model: Model) -> np.ndarray:
    """Ids of words that all were met."""
    u, back = np.unique(h, return_inverse=True)
    return _ids(u, model)[0][back]


class _Chunk:
    """Word hashes of consecutive texts and word offsets per text, as `Words` has them."""

    __slots__ = ("hashes", "at")

    def __init__(self, parts: list[Words]):
        self.hashes = np.concatenate([w.hashes for w in parts])
        self.at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(w.at) for w in parts]))])


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int, _Chunk]]:
    """Ranges of texts looked up together, read a slice at a time."""
    for lo, hi in slices(texts, CHUNK_BYTES):
        own = texts[lo:hi]
        yield lo, hi, _Chunk([Words(own[a:b], lower=True) for a, b in slices(own)])


def _sequences(words: Words | _Chunk, ids: np.ndarray, end: int, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words (with the end tokens) and offsets per text."""
    n = np.diff(words.at) + 1
    off = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    token = np.full(off[-1], end)
    token[np.arange(len(ids)) + np.repeat(np.arange(len(n)), np.diff(words.at))] = ids
    context = np.concatenate([[begin], token[:-1]])
    context[off[:-1]] = begin
    return context, token, off


def _key(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return (context.astype(np.uint64) << U64(32)) | token.astype(np.uint64)


def _bigram_bucket(key: np.ndarray, model: Model) -> np.ndarray:
    context = (key >> U64(32)).astype(np.int64)
    by_range = context * model.fine // (model.begin + 1)
    spread = (mix(key) % U64(model.fine)).astype(np.int64)
    return np.where(np.isin(context, np.array(model.hot, np.int64)), spread, by_range)


def _range_of(ids: np.ndarray, model: Model) -> np.ndarray:
    return ids.astype(np.int64) * model.buckets // (model.begin + 1)


def _range_start(bucket: int, model: Model) -> int:
    return -(-bucket * (model.begin + 1) // model.buckets)


def _bigram_files(model: Model):
    """Writes each bucket; sends, per id range, (id, kind) columns: kind 1, 2, 3 followers by count, 4 contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(4, np.int64)
        types = 0
        for bucket, parts in _received(batches, []).items():
            k, n = _merged(parts)
            _write(model.folder, f"bigrams-{bucket}", k)
            _write(model.folder, f"bigram-counts-{bucket}", _coded(n))
            types += len(k)
            tally += [int((n == c).sum()) for c in (1, 2, 3, 4)]
            code = (k >> U64(32)) << U64(3) | np.minimum(n, 3).astype(np.uint64)
            told = np.concatenate([code, (k & U64(0xFFFFFFFF)) << U64(3) | U64(4)])
            u, c = np.unique(told, return_counts=True)
            yield _bundled(_rows_by(_range_of((u >> U64(3)), model), u, c.astype(np.uint32), model.buckets))
        yield _told([(packed(np.concatenate([[types], tally]).astype(np.int64)), b"bigrams")])

    return run


# trigrams


def _trigram_hash(pair: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(pair) + token.astype(np.uint64))


def _swapped(pair: np.ndarray) -> np.ndarray:
    """Pairs by their second word first, as buckets hold them: their differences are small."""
    return pair << U64(32) | pair >> U64(32)


def _pairs(context: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The token before the context; -1 at the start of a text, whose context has no token before it."""
    before = np.concatenate([[-1], context[:-1]])
    before[off[:-1]] = -1
    return before


def _is_hot(ids: np.ndarray, model: Model) -> np.ndarray:
    return np.isin(ids.astype(np.int64), np.array(model.hot, np.int64))


def _trigram_bucket(pair: np.ndarray, h: np.ndarray, model: Model) -> np.ndarray:
    middle = (pair & U64(0xFFFFFFFF)).astype(np.int64)
    bucket = middle * model.fine // (model.begin + 1)
    hot = np.flatnonzero(_is_hot(middle, model))
    own = np.where(_is_hot(pair[hot] >> U64(32), model), mix(h[hot]), mix(pair[hot]))
    bucket[hot] = (own % U64(model.fine)).astype(np.int64)
    return bucket


def _spread(keys: np.ndarray, model: Model) -> np.ndarray:
    return (mix(keys) % U64(model.buckets)).astype(np.int64)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of the rows of `values`."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(values[order], first, axis=0) if len(first) else values


def _trigram_batches(model: Model):
    """Tasks count trigrams and send (pair) and (token, count) columns by bucket."""

    def counted(pair: np.ndarray, token: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _trigram_hash(pair, token)
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
        at = order[first]
        return pair[at], token[at], np.add.reduceat(n[order], first).astype(np.uint32) if len(first) else n

    def rows(pair: np.ndarray, token: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        bucket = _trigram_bucket(pair, _trigram_hash(pair, token), model)
        return _bundled(_rows_by(bucket, _swapped(pair), np.stack([token, n], 1), model.fine), model.fine // model.buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for _, _, words in _chunks(text_bytes(batch.column(0))):
                context, token, off = _sequences(words, _met(words.hashes, model), model.end, model.begin)
                before = _pairs(context, off)
                before[before < 0] = model.begin  # two begins: the first token of a text
                own.append((_key(before, context), token.astype(np.uint32), np.ones(len(token), np.uint32)))
                size += len(token)
                if size > FLUSH // 2:
                    own = [counted(*[np.concatenate(x) for x in zip(*own, strict=True)])]
                    size = len(own[0][0])
                    if size > FLUSH // 4:
                        yield rows(*own[0])
                        own, size = [], 0
        if own:
            yield rows(*counted(*[np.concatenate(x) for x in zip(*own, strict=True)]))

    return run


def _id_codes(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, kind) codes of bigrams and their sums: kind 1, 2, 3 followers by count, 4 contexts, 5 total."""
    context, token = keys >> U64(32) << U64(3), (keys & U64(0xFFFFFFFF)) << U64(3)
    code = np.concatenate([context | np.minimum(n, 3).astype(np.uint64), token | U64(4), context | U64(5)])
    return _sums(code, np.concatenate([np.ones(2 * len(n), np.int64), n]))


def _id_rows(own: list[tuple[np.ndarray, np.ndarray]], model: Model, kind: int = 0) -> pa.RecordBatch:
    """Rows of codes by id range."""
    code, n = _sums(*[np.concatenate(x) for x in zip(*own, strict=True)])
    return _bundled(_rows_by(_range_of(code >> U64(3), model), code, n.astype(np.uint32), model.buckets), kind=kind)


def _by_count(n: np.ndarray) -> list[int]:
    return [int((n == c).sum()) for c in (1, 2, 3, 4)]


#: A context met once: its total, and followers with count 1, 2 and 3+.  Only other contexts are stored.
_ONCE = np.array([1, 1, 0, 0])
#: Kinds of rows sent by `_trigram_files`: parts of a frequent word's bigrams, parts of contexts of two frequent words, id codes.
_LOW, _HIGH, _CODES = range(3)


def _trigram_files(model: Model):
    """Writes each bucket's trigrams, bigrams and contexts; sends what is whole in no bucket, and (id, kind) columns by id range."""

    def sent(own: list, kind: int) -> Iterator[pa.RecordBatch]:
        if own:
            key, value = (np.concatenate(x) for x in zip(*own, strict=True))
            if len(key):
                yield _bundled(_rows_by(_spread(key, model), key, value.astype(np.uint32), model.buckets), kind=kind)

    def one(parts: list[tuple[bytes, bytes]]):
        """Distinct trigrams (hashes, counts), and bigrams and contexts with their values."""
        pair, more = _swapped(np.concatenate([_unsqueezed_keys(a) for a, _ in parts])), np.concatenate([_unsqueezed(b, np.uint32) for _, b in parts])
        h = _trigram_hash(pair, more[:, 0])
        order = np.argsort(h)
        h, pair, more = h[order], pair[order], more[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.add.reduceat(more[:, 1].astype(np.int64), first)
        h, pair, token = h[first], pair[first], more[first, 0]
        start = pair == _key(np.array(model.begin), np.array(model.begin))
        low = _sums((pair & U64(0xFFFFFFFF)) << U64(32) | token.astype(np.uint64), np.where(start, n, 1))
        high = _sums(_swapped(pair[~start]), np.stack([n, n == 1, n == 2, n >= 3], 1)[~start])
        return (h[~start], n[~start]), low, high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _received(batches, [])
        top, types = np.zeros(4, np.int64), np.zeros(5, np.int64)
        each = model.fine // model.buckets
        for bucket in sorted({b // each for b in found}):
            grams, bigrams, contexts, spread, codes = [], [], [], [], []
            parts_low: list = []
            parts_high: list = []
            for b in range(bucket * each, (bucket + 1) * each):
                if b not in found:
                    continue
                gram, (key, n), (pair, values) = one(found.pop(b))
                top += _by_count(gram[1])
                grams.append(gram)
                hot = _is_hot(key >> U64(32), model)
                parts_low.append((key[hot], n[hot]))
                bigrams.append((key[~hot], n[~hot]))
                codes.append(_id_codes(*bigrams[-1]))
                hot, other = _is_hot(pair >> U64(32), model), (values != _ONCE).any(axis=1)
                both = hot & _is_hot(pair & U64(0xFFFFFFFF), model)  # a context of two frequent words is whole in no bucket
                parts_high.append((_swapped(pair[both]), values[both]))
                contexts.append((pair[other & ~hot], values[other & ~hot]))
                spread.append((_swapped(pair[other & hot & ~both]), values[other & hot & ~both]))
                if sum(len(k) for k, _ in (*parts_low, *parts_high)) > FLUSH // 4:
                    yield from sent(parts_low, _LOW)
                    yield from sent(parts_high, _HIGH)
                    parts_low, parts_high = [], []
            yield from sent(parts_low, _LOW)
            yield from sent(parts_high, _HIGH)
            yield _id_rows(codes, model, _CODES)
            n = _write_pairs(model, "bigrams", bucket, bigrams)
            types += [len(n), *_by_count(n)]
            _write_pairs(model, "contexts", bucket, contexts)
            _write_sorted(model, "spread-contexts", bucket, spread)
            _write_hashes(model, bucket, grams)
        yield _told([(packed(top), b"trigrams"), (packed(types), b"bigrams")])

    return run


def _hot_files(model: Model):
    """Writes the bigrams of frequent words and contexts of two of them; sends (id, kind) columns by id range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list[tuple[bytes, bytes]] = []
        types = np.zeros(5, np.int64)
        codes = []
        for name, parts in _received(batches, totals).items():
            kind, bucket = name >> 32, name & 0xFFFFFFFF
            if kind == _HIGH:
                pair, values = _sums(np.concatenate([_unsqueezed_keys(a) for a, _ in parts]), np.concatenate([_unsqueezed(b, np.uint32) for _, b in parts]).astype(np.int64))
                other = (values != _ONCE).any(axis=1)
                _write_sorted(model, "hot-contexts", bucket, [(pair[other], values[other])])
                continue
            key, n = _merged(parts)
            if kind == _LOW:
                _write_sorted(model, "hot-bigrams", bucket, [(key, n)])
                types += [len(n), *_by_count(n)]
                key, n = _id_codes(key, n)
            codes.append((key, n))
        if codes:
            yield _id_rows(codes, model)
        yield _told([*totals, (packed(types), b"bigrams")])

    return run


# files of order 3


def _write_pairs(model: Model, name: str, bucket: int, own: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Pairs of an id range, in order: where the pairs of each first id start, the second ids, and the values (returned)."""
    keys, values = (np.concatenate(x) for x in zip(*own, strict=True))
    lo, hi = _range_start(bucket, model), _range_start(bucket + 1, model)
    starts = np.searchsorted(keys, np.arange(lo, hi + 1).astype(np.uint64) << U64(32)).astype(np.uint32)
    _write(model.folder, f"{name}-{bucket}", np.concatenate([starts, (keys & U64(0xFFFFFFFF)).astype(np.uint32)]))
    _write(model.folder, f"{name}-values-{bucket}", _coded(values))
    return values


def _write_sorted(model: Model, name: str, bucket: int, own: list[tuple[np.ndarray, np.ndarray]]) -> None:
    keys, values = (np.concatenate(x) for x in zip(*own, strict=True))
    order = np.argsort(keys, kind="stable")
    _write(model.folder, f"{name}-{bucket}", keys[order])
    _write(model.folder, f"{name}-values-{bucket}", _coded(values[order]))


def _write_hashes(model: Model, bucket: int, own: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Sorted hashes: where each value of their first 16 bits starts, the next 32 bits, and the last 16."""
    h, n = (np.concatenate(x) for x in zip(*own, strict=True))
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    starts = np.searchsorted(h >> U64(48), np.arange(1 << 16).astype(np.uint64)).astype(np.uint32)
    parts = [np.append(starts, np.uint32(len(h))), (h >> U64(16)).astype(np.uint32), h.astype(np.uint16)]
    if len(h) < 1 << 15:  # the starts would be larger than what they save
        parts = [h]
    _write(model.folder, f"trigrams-{bucket}", np.concatenate([x.view(np.uint8) for x in parts]))
    _write(model.folder, f"trigrams-values-{bucket}", _coded(n))


def _places(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
    """First places in stretches lo to hi of `values`, each in order, that are not below the wanted values."""
    at = lo.copy()
    own = np.flatnonzero(lo < hi)
    lo, n, want = lo[own], (hi - lo)[own], want[own]
    while len(own):
        for _ in range(4):  # stretches that are through stay where they are
            half = n >> 1
            less = (n > 0) & (values[np.minimum(lo + half, len(values) - 1)] < want)
            lo += np.where(less, half + 1, 0)
            n = np.where(less, n - half - 1, half)
        at[own] = lo
        live = np.flatnonzero(n)
        own, lo, n, want = own[live], lo[live], n[live], want[live]
    return at


def _found_pairs(data: np.ndarray, keys: np.ndarray, bucket: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Which keys a file of `_write_pairs` holds, and at which places."""
    base, end = _range_start(bucket, model), _range_start(bucket + 1, model)
    starts, second = data[: end - base + 1], data[end - base + 1 :]
    first, want = (keys >> U64(32)).astype(np.int64) - base, (keys & U64(0xFFFFFFFF)).astype(np.uint32)
    hi = starts[first + 1].astype(np.int64)
    at = _places(second, starts[first].astype(np.int64), hi, want)
    hit = np.flatnonzero(at < hi)
    hit = hit[second[at[hit]] == want[hit]]
    return hit, at[hit]


def _found_sorted(data: np.ndarray, keys: np.ndarray, bucket: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(data, keys), len(data) - 1)
    hit = np.flatnonzero(data[at] == keys)
    return hit, at[hit]


def _found_hashes(data: np.ndarray, keys: np.ndarray, bucket: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    head = 4 * ((1 << 16) + 1)
    if len(data) < head + 6 * (1 << 15):
        return _found_sorted(data.view(np.uint64), keys, bucket, model)
    n = (len(data) - head) // 6
    starts, near, last = data[:head].view(np.uint32), data[head : head + 4 * n].view(np.uint32), data[head + 4 * n :].view(np.uint16)
    first, want, rest = (keys >> U64(48)).astype(np.int64), (keys >> U64(16)).astype(np.uint32), keys.astype(np.uint16)
    hi = starts[first + 1].astype(np.int64)
    at = _places(near, starts[first].astype(np.int64), hi, want)
    hits, own = [], np.flatnonzero(at < hi)
    while len(own := own[near[at[own]] == want[own]]):  # hashes of equal first 48 bits stand together
        same = last[at[own]] == rest[own]
        hits.append(own[same])
        own = own[~same]
        at[own] += 1
        own = own[at[own] < hi[own]]
    hit = np.concatenate([*hits, np.zeros(0, np.int64)])
    return hit, at[hit]


def _id_files(model: Model):
    """Writes each id range; sends all totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list[tuple[bytes, bytes]] = []
        for bucket, parts in _received(batches, totals).items():
            k, n = _merged(parts)
            lo, hi = _range_start(bucket, model), _range_start(bucket + 1, model)
            dense = np.zeros((hi - lo, 5), np.uint64)
            dense[(k >> U64(3)).astype(np.int64) - lo, (k & U64(7)).astype(np.int64) - 1] = n
            _write(model.folder, f"ids-{bucket}", _coded(dense))
            contexts = dense[:, 3]
            tally = [int((contexts == c).sum()) for c in (1, 2, 3, 4)] + [int((contexts >= 3).sum())]
            totals.append((packed(np.array(tally, np.int64)), b"ids"))
        if totals:
            yield _told(totals)

    return run


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3+; where counts of counts are missing, half a count."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return min(max(d1, 0.05), 1.0), min(max(d2, 0.05), 2.0), min(max(d3, 0.05), 3.0)


def train(texts: DataFrame, text: str = "text", order: int = 3) -> Model:
    """Counts a model of order 2 or 3 from the texts of a table."""
    if order not in (2, 3):
        raise ValueError("order 2 or 3")
    spark = texts.sparkSession
    src = texts.select(F.col(text).cast("string").alias("text"))
    n_texts, size = src.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, min(partitions(spark), -(-size // BUCKET_BYTES)))
    folder = new_folder(spark, "lm")
    system, at = _filesystem(folder)
    system.create_dir(at)
    sent = src.mapInArrow(_counted(lambda w: w.hashes, lambda k: _word_range(k, n), n), _ROW_SQL)
    words = sent.repartitionById(n, F.col("bucket")).mapInArrow(_word_files(folder), "bucket int, n long, total long, top array<long>").collect()
    size = {r.bucket: r.n for r in words}
    offsets = tuple(np.concatenate([[0], np.cumsum([size.get(b, 0) for b in range(n)])]).tolist())
    if offsets[-1] >= 2**32 - 2:
        raise ValueError("more than 2^32 distinct words")
    n_tokens = sum(r.total for r in words) + n_texts
    limit = n_tokens / (4 * n)
    hot = [offsets[r.bucket] + i for r in words for i, c in zip(r.top[::2], r.top[1::2], strict=True) if c > limit]
    model = Model(folder, n, offsets, (*sorted(hot), offsets[-1] + 1), n_texts, n_tokens, order=order)

    def keys(words: Words) -> np.ndarray:
        context, token, _ = _sequences(words, _met(words.hashes, model), model.end, model.begin)
        return _key(context, token)

    if order == 3:
        sent = src.mapInArrow(_trigram_batches(model), _ROW_SQL)
        sent = sent.repartitionById(n, F.col("bucket")).mapInArrow(_trigram_files(model), _ROW_SQL)
        files = _hot_files(model)
    else:
        sent, files = src.mapInArrow(_counted(keys, lambda k: _bigram_bucket(k, model), n), _ROW_SQL), _bigram_files(model)
    followers = sent.repartitionById(n, F.col("bucket")).mapInArrow(files, _ROW_SQL)
    totals = {"trigrams": np.zeros(4, np.int64), "bigrams": np.zeros(5, np.int64), "ids": np.zeros(5, np.int64)}
    for r in followers.repartitionById(n, F.col("bucket")).mapInArrow(_id_files(model), _ROW_SQL).collect():  # a few numbers a task
        totals[r.b.decode()] += np.frombuffer(r.a, np.int64)
    (types, *tally), low, top = (totals[x].tolist() for x in ("bigrams", "ids", "trigrams"))
    low_d = _discounts(*low[:4])
    backoff = (low_d[0] * low[0] + low_d[1] * low[1] + low_d[2] * low[4]) / types if types else 1.0
    return Model(folder, n, offsets, model.hot, n_texts, n_tokens, _discounts(*tally), low_d, types, backoff, order, _discounts(*top))


def _by_id(ids: np.ndarray, model: Model) -> np.ndarray:
    """(followers with count 1, 2, 3+, contexts, total at order 2 of a model of order 3) of ids; zeros for -1."""
    out = np.zeros((len(ids), 5), np.int64)
    bucket = np.where(ids >= 0, _range_of(ids, model), -1)
    for b in np.unique(bucket[bucket >= 0]).tolist():
        dense = _mapped(model.folder, f"ids-{b}", np.uint8)
        if len(dense):
            here = np.flatnonzero(bucket == b)
            out[here] = _decoded(dense, ids[here] - _range_start(b, model), 5)
    return out


def _found(key: np.ndarray, bucket: np.ndarray, model: Model, names: tuple[str, str], width: int) -> np.ndarray:
    """Rows of `width` values of keys in the files `names` of their buckets; zeros where a key is not there."""
    out = np.zeros((len(key), width), np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(model.fine + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        keys = _mapped(model.folder, f"{names[0]}-{b}", np.uint64)
        if len(keys):
            here = order[edges[b] : edges[b + 1]]
            at = np.minimum(np.searchsorted(keys, key[here]), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == key[here])
            out[here[hit]] = _decoded(_mapped(model.folder, f"{names[1]}-{b}", np.uint8), at[hit], width)
    return out


def _looked_up(keys: np.ndarray, bucket: np.ndarray, model: Model, name: str, find, kind, width: int = 1) -> np.ndarray:
    """Rows of `width` values of keys in the files `name` of their buckets; zeros where a key is not there."""
    out = np.zeros((len(keys), width), np.int64)
    order = np.argsort(bucket.astype(np.uint16 if model.buckets <= 1 << 16 else np.int64), kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(model.buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        data = _mapped(model.folder, f"{name}-{b}", kind)
        if len(data):
            here = order[edges[b] : edges[b + 1]]
            hit, at = find(data, keys[here], b, model)
            out[here[hit]] = _decoded(_mapped(model.folder, f"{name}-values-{b}", np.uint8), at, width)
    return out


def _bigram_counts(keys: np.ndarray, model: Model) -> np.ndarray:
    if model.order == 2:
        return _found(keys, _bigram_bucket(keys, model), model, ("bigrams", "bigram-counts"), 1)[:, 0]
    hot = _is_hot(keys >> U64(32), model)
    out = np.zeros(len(keys), np.int64)
    out[~hot] = _looked_up(keys[~hot], _range_of(keys[~hot] >> U64(32), model), model, "bigrams", _found_pairs, np.uint32)[:, 0]
    out[hot] = _looked_up(keys[hot], _spread(keys[hot], model), model, "hot-bigrams", _found_sorted, np.uint64)[:, 0]
    return out


def _context_values(pair: np.ndarray, model: Model) -> np.ndarray:
    """(total, followers with count 1, 2, 3+) of contexts that were met."""
    hot, first_hot = _is_hot(pair & U64(0xFFFFFFFF), model), _is_hot(pair >> U64(32), model)
    whole, both, own = hot & ~first_hot, hot & first_hot, _swapped(pair[~hot])
    out = np.zeros((len(pair), 4), np.int64)
    out[~hot] = _looked_up(own, _range_of(own >> U64(32), model), model, "contexts", _found_pairs, np.uint32, 4)
    bucket = _trigram_bucket(pair[whole], pair[whole], model) // (model.fine // model.buckets)
    out[whole] = _looked_up(pair[whole], bucket, model, "spread-contexts", _found_sorted, np.uint64, 4)
    out[both] = _looked_up(pair[both], _spread(pair[both], model), model, "hot-contexts", _found_sorted, np.uint64, 4)
    out[out[:, 0] == 0] = _ONCE
    return out


def _trigram_counts(pair: np.ndarray, token: np.ndarray, model: Model) -> np.ndarray:
    h = _trigram_hash(pair, token)
    bucket = _trigram_bucket(pair, h, model) // (model.fine // model.buckets)
    return _looked_up(h, bucket, model, "trigrams", _found_hashes, np.uint8)[:, 0]


def _discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return c - np.array([0.0, *d])[np.minimum(c, 3)]


def log10_probabilities(words: Words | _Chunk, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 p of every token, token counts, and offsets per text."""
    # distinct words first, with the end token and the begin after them
    u, back = np.unique(words.hashes, return_inverse=True)
    ids, counts = _ids(u, model)
    ids, counts = np.append(ids, [model.end, model.begin]), np.append(counts, [model.n_texts] * 2)
    by_id = _by_id(ids, model)
    lowest = _discounted(by_id[:, 3], model.low_discounts) / max(model.types, 1) + model.low_backoff / (model.vocabulary + 1)
    backoff = by_id[:, :3] @ np.array(model.discounts)
    totals = counts if model.order == 2 else np.append(by_id[:-1, 4], model.n_texts)
    before, own, off = _sequences(words, back, len(u), len(u) + 1)
    context, token, seen, p = ids[before], ids[own], totals[before], lowest[own]
    both = np.flatnonzero((context >= 0) & (token >= 0))
    keys, place = np.unique(_key(context[both], token[both]), return_inverse=True)
    n = _bigram_counts(keys, model)
    c = np.zeros(len(token), np.int64)
    c[both] = n[place]
    known = seen > 0
    p[known] = (_discounted(c, model.discounts)[known] + backoff[before[known]] * p[known]) / seen[known]
    if model.order == 3:
        # the pair before a token is the bigram that ends one token earlier; where it was met, it is a context
        wanted = np.flatnonzero((n > 0) & (keys & U64(0xFFFFFFFF) != U64(model.end)))
        values = np.zeros((len(keys), 4), np.int64)
        values[wanted] = _context_values(keys[wanted], model)
        backoff = values[:, 1:] @ np.array(model.top_discounts)
        ends = np.flatnonzero(values[place, 0] > 0)
        pairs, place = both[ends] + 1, place[ends]
        c = np.zeros(len(pairs), np.int64)
        met = np.flatnonzero(token[pairs] >= 0)
        c[met] = _trigram_counts(keys[place[met]], token[pairs[met]], model)
        p[pairs] = (_discounted(c, model.top_discounts) + backoff[place] * p[pairs]) / values[place, 0]
    count = counts[own]
    return np.log10(p), count, off


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for lo, hi, words in _chunks(texts):
                logp, count, off = log10_probabilities(words, model)
                base = np.log10((count + 1.0) / (model.n_tokens + model.vocabulary + 1.0))
                start = off[:-1]
                cols = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(np.diff(off)),
                    pa.array(np.add.reduceat((count > 0).astype(np.int64), start)),
                    pa.array(np.add.reduceat(base, start)),
                    pa.array(np.add.reduceat(logp, start)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, perplexity) for every row."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = src.mapInArrow(_score_batches(model), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def train_and_score(docs: DataFrame, held_out: Column, order: int = 3) -> DataFrame:
    model = train(docs.filter(~F.coalesce(held_out, F.lit(False))), order=order)
    return score(docs, model).withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))
