"""BPE encoding and decoding of whole texts, long unsplit text by tree concatenation.

ASCII white space always separates pre-tokens, so a text is encoded word by word and a task keeps a
bounded table of the words it has met.  A document with an unsplit run over `leaf` characters goes
another way: its text becomes pieces (rows), pre-tokens over `leaf` symbols are halved until the
halves fit, all pieces are encoded in parallel, and the pieces of a document are joined pairwise up
the tree.  At a join a window of tokens around the seam is encoded again and grows until its ends
agree with the tokens already there on both sides; a BPE encoding is fixed by its adjacent token
pairs, so the joined result is the encoding of the whole.

The vocabulary file is a parameter (path on every node); nothing is trained here.

Defined results: null and empty texts have no tokens and decode to an empty text; repeated rows give
repeated results; a null id passes through; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxgrid.llm.common import partitions, slices, text_bytes

LEAF = 8192
#: Words, and lower-case stems, that a worker remembers before it starts anew.
REMEMBERED = 300_000
AGREE = 4
#: Letters that neither Unicode normalisation nor lower-casing joins with others, then closing marks:
#: two pre-tokens whose encodings can be remembered apart.
_SIMPLE = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")


class Codec:
    """The tokenizer of a file, its vocabulary, and its bare BPE models for parts of a pre-token."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path = path
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        added = self.tok.get_added_tokens_decoder().values()
        self.special = sorted((t.content for t in added), key=len, reverse=True)
        self.token = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.token_bytes = [t.encode() for t in self.token]
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        self.stems: dict[str, tuple[bytes, bytes]] = {}

    @cached_property
    def models(self) -> tuple:
        """Bare BPE models for parts of a pre-token: inside it and at its end; and the suffix of an end."""
        from tokenizers import Tokenizer, models

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model.get("end_of_word_suffix") or None
        inner = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges))
        final = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=suffix))
        return inner, final, suffix or ""

    def forget(self) -> None:
        self.known, self.stems = {}, {}

    def _library(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        out = []
        for e in self.tok.encode_batch_fast(words, add_special_tokens=False):
            ids = e.ids
            out.append((array("I", ids).tobytes(), b" ".join([self.token_bytes[i] for i in ids])))
        return out

    def words(self, words: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """For each word: its ids (little-endian uint32) and its decoded text."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        if len(self.stems) > REMEMBERED:
            self.stems = {}
        known, stems = self.known, self.stems
        simple: list[tuple[bytes, str, str]] = []
        other: list[bytes] = []
        for w in set(words).difference(known):
            m = _SIMPLE.fullmatch(w.decode())
            if m:
                simple.append((w, m[1].lower(), m[2]))
            else:
                other.append(w)
        new = list({p for _, a, b in simple for p in (a, b) if p and p not in stems})
        stems.update(zip(new, self._library(new), strict=True))
        for w, a, b in simple:
            x = stems[a]
            if b:
                y = stems[b]
                x = (x[0] + y[0], x[1] + b" " + y[1])
            known[w] = x
        known.update(zip(other, self._library([w.decode() for w in other]), strict=True))
        return known

    def encode(self, text: bytes) -> tuple[bytes, bytes]:
        words = text.split()
        known = self.words(words)
        parts = [known[w] for w in words]
        return b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts if p[1]])

    def decode(self, ids: bytes) -> bytes:
        token = self.token_bytes
        return b" ".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])

    # tree concatenation

    def part(self, symbols: str, last: bool) -> list[int]:
        """Ids of a part of a pre-token (byte symbols); `last`: the pre-token ends with it."""
        return self.models[last].encode(symbols, add_special_tokens=False).ids if symbols else []

    def _symbols(self, ids: list[int], last: bool) -> str:
        out = "".join([self.token[i] for i in ids])
        return out.removesuffix(self.models[2]) if last else out

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The encoding of the concatenation, from the encodings of both sides."""
        k = 2 * AGREE
        while True:
            a, b = left[-k:], right[:k]
            ends = last and len(b) == len(right)
            got = self.part(self._symbols(a, False) + self._symbols(b, ends), ends)
            on_left = len(a) == len(left) or got[:AGREE] == a[:AGREE]
            on_right = len(b) == len(right) or got[-AGREE:] == b[-AGREE:]
            if on_left and on_right and len(got) >= AGREE:
                return left[: len(left) - len(a)] + got + right[len(b) :]
            if len(a) == len(left) and len(b) == len(right):
                return got
            k *= 2

    def tree(self, parts: list[list[int]], last: bool = True) -> list[int]:
        """Joins neighbours until one encoding is left; only the rightmost part holds the pre-token's end."""
        while len(parts) > 1:
            end = len(parts) - len(parts) % 2
            joined = [self.join(parts[i], parts[i + 1], last and i + 2 == len(parts)) for i in range(0, end, 2)]
            parts = joined + parts[end:]
        return parts[0] if parts else []

    def pieces(self, text: str, leaf: int) -> Iterator[tuple[str, int]]:
        """Pieces of a text: (words, 0) for ordinary text, (symbols, 1) for a part of a long pre-token, 2 for its last part."""
        plain: list[str] = []
        for word in text.split(" "):
            if len(word) <= leaf:
                plain.append(word)
                if sum(map(len, plain[-64:])) > leaf or len(plain) > leaf:
                    yield " ".join(plain), 0
                    plain = []
                continue
            if plain:
                yield " ".join(plain), 0
                plain = []
            for part, is_special in self._specials(word):
                if is_special:
                    yield part, 0
                    continue
                normal = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                short: list[str] = []
                for symbols, _ in self.tok.pre_tokenizer.pre_tokenize_str(normal):
                    if len(symbols) <= leaf:
                        short.append(symbols)
                        continue
                    if short:
                        yield "\n".join(short), 3
                        short = []
                    halves = self._halved(symbols, leaf)
                    for h in halves[:-1]:
                        yield h, 1
                    yield halves[-1], 2
                if short:
                    yield "\n".join(short), 3
        if plain:
            yield " ".join(plain), 0

    def _specials(self, word: str) -> Iterator[tuple[str, bool]]:
        while word:
            at, found = min(((word.find(s), s) for s in self.special if s in word), default=(-1, ""))
            if at < 0:
                yield word, False
                return
            if at:
                yield word[:at], False
            yield found, True
            word = word[at + len(found) :]

    def _halved(self, symbols: str, leaf: int) -> list[str]:
        if len(symbols) <= leaf:
            return [symbols]
        half = len(symbols) // 2
        return self._halved(symbols[:half], leaf) + self._halved(symbols[half:], leaf)

    def piece_ids(self, text: str, kind: int) -> list[int]:
        if kind == 0:
            return np.frombuffer(self.encode(text.encode())[0], "<u4").tolist()
        if kind == 3:
            return [i for s in text.split("\n") for i in self.part(s, True)]
        return self.part(text, kind == 2)

    def joined(self, pieces: list[tuple[int, list[int]]]) -> list[int]:
        """Ids of a text from (kind, ids) of its pieces in order."""
        out: list[int] = []
        open_: list[list[int]] = []
        for kind, ids in pieces:
            if kind in (1, 2):
                open_.append(ids)
            if kind == 2:
                out += self.tree(open_)
                open_ = []
            elif kind in (0, 3):
                out += ids
        return out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for lo, hi in slices(texts):
                done = [own.encode(t) for t in texts[lo:hi]]
                ids = [d[0] for d in done]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([d[1] for d in done], pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )
        own.forget()

    return run


def _piece_batches(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(key, n, kind, part) for n, (part, kind) in enumerate(own.pieces(text or "", leaf))]
                for lo in range(0, len(rows), 256):
                    cols = zip(*rows[lo : lo + 256], strict=True)
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "seq", "kind", "part"])

    return run


def _piece_id_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [np.array(own.piece_ids(t, k), "<u4").tobytes() for t, k in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.binary())], names=["key", "seq", "kind", "ids"])

    return run


def _join_pieces(path: str):
    def run(group: pa.Table) -> pa.Table:
        own = codec(path)
        rows = sorted({s: (k, i) for s, k, i in zip(*[group.column(c).to_pylist() for c in ("seq", "kind", "ids")], strict=True)}.items())
        ids = np.array(own.joined([(k, np.frombuffer(i, "<u4").tolist()) for _, (k, i) in rows]), "<u4").tobytes()
        return pa.table({"key": group.column("key")[:1], "ids": pa.array([ids], pa.binary()), "decoded": pa.array([own.decode(ids).decode()], pa.string())})

    return run


def encode(docs: DataFrame, path: str, leaf: int = LEAF, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids as little-endian uint32, decoded) for every row."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    run = f"[^ \\t-\\r]{{{leaf + 1}}}"
    long_one = F.coalesce((F.octet_length("text") > leaf) & F.col("text").rlike(run), F.lit(False))
    id_type = src.schema["doc_id"].dataType.simpleString()
    out = src.filter(~long_one).mapInArrow(_encode_batches(path), f"doc_id {id_type}, n_tokens long, ids binary, decoded string")
    # documents with a long unsplit run, by rows of pieces; their rows are found again by id and text
    far = src.filter(long_one).withColumn("key", F.xxhash64("doc_id", "text"))
    n = partitions(docs.sparkSession)
    joined = (
        far.select("key", "text")
        .mapInArrow(_piece_batches(path, leaf), "key long, seq long, kind int, part string")
        .repartition(n, "key", "seq")
        .mapInArrow(_piece_id_batches(path), "key long, seq long, kind int, ids binary")
        .groupBy("key")
        .applyInArrow(_join_pieces(path), "key long, ids binary, decoded string")
    )
    rest = far.select("doc_id", "key").join(joined, "key")
    return out.union(rest.select("doc_id", (F.octet_length("ids") / 4).cast("long"), "ids", "decoded"))


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """`tokens` with the column `decoded`, from packed ids (null: empty)."""

    @F.pandas_udf("string")
    def decoded(x: pd.Series) -> pd.Series:
        own = codec(path)
        return x.map(lambda b: own.decode(b or b"").decode())

    return tokens.withColumn("decoded", decoded(F.col(ids)))
