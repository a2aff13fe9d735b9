"""Source divergence audit: which sources of a language use other words than its other sources, and which words.

Tokenizer: one `bytes.translate` lowers A-Z and blanks every other ASCII character, `bytes.split` cuts the
terms, a Counter per document gives its counts.  A task adds its documents up per (lang, source, term)
before anything is shuffled; Spark adds the tasks' sums, keeps each language's terms found in enough of
its documents, and compares smoothed frequencies in whole numbers:

    p = 1 + floor(SCALE * (count + 1) / (N + V)),   f = floor((p - q)^2 / q)

* `pair`: a group against each other source of its language, f summed over all kept terms.  Terms are dealt
  to blocks by hash; a block compares all groups on its own terms and sends one sum per pair, so neither a
  frequent term nor a large source is met in one task and no pair is sent once per term.
* `term`: a group against its language, the terms it overuses, most divergent first.

Defined results: null text, lang and source read as ''; a group without a kept term has N = 0 and still
meets every other source; a language without kept terms has pairs of value 0; a language with one source
has no pairs; repeated rows count as documents of their own; equal values rank by the item's UTF-8 bytes;
an empty table gives no rows; very long texts are cut at separators and counted piece by piece; ids and
extra columns are not read, so their names may clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxgrid.llm.common import partitions, stored

SCALE = 1_000_000_000
#: Documents of a language that must hold a term.
MIN_DOCS = 3
#: Ranks of overused terms that the report shows.
TOP_TERMS = 200
#: Entries (group, term) that a task adds up before it sends them on.
FLUSH = 400_000
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Rows (group, term) of one block of terms, on average, and cells compared at once inside it.
BLOCK_ROWS, CELLS = 250_000, 1 << 21

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A translated text cut at blanks into pieces of about PIECE bytes."""
    lo = 0
    while len(text) - lo > PIECE:
        cut = text.find(b" ", lo + PIECE)
        if cut < 0:
            break
        yield text[lo:cut]
        lo = cut
    yield text[lo:] if lo else text


def term_counts(text: bytes) -> Counter:
    """Occurrences of every term of one text."""
    out: Counter = Counter()
    for piece in _pieces(text.translate(_TABLE)):
        out.update(piece.split())
    return out


_COUNTS_SQL = "lang string, source string, term string, n long, docs long"


def _sent(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        if n:
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n)), pa.array([source] * len(n)), terms, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    size = 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary()), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            own = term_counts(text.as_py())
            size -= len(n)
            n.update(own)
            docs.update(own.keys())
            size += len(n)
            if size > FLUSH:
                yield from _sent(held)
                held, size = {}, 0
    yield from _sent(held)


def _share(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + vocabulary)) in whole numbers."""
    scaled = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", scaled, (total + vocabulary).cast("decimal(20,0)")) + 1


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) for every kept term of a group; `first` marks one row of each (lang, term)."""
    sent = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    sent = sent.mapInArrow(_count_batches, _COUNTS_SQL)
    # dealt by (lang, term) once: the sums and the windows below need no other exchange
    dealt = sent.repartition(partitions(docs.sparkSession), "lang", "term")
    sums = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    out = sums.withColumns({
        "lang_n": F.sum("n").over(whole),
        "lang_docs": F.sum("docs").over(whole),
        "first": F.col("source") == F.min("source").over(whole),
    })
    return out.filter(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "first")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, vocabulary) for every occurring group."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = docs.select(*names).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("vocabulary"))
    out = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    return out.fillna(0, ["total", "lang_total", "vocabulary"])


def _pair_sums(key: tuple, terms: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums of f over one block's terms for every ordered pair of a language's sources."""
    sources = groups["source"].sort_values().to_numpy()
    at = {s: i for i, s in enumerate(sources)}
    groups = groups.set_index("source").loc[sources]
    divisor = (groups["total"] + groups["vocabulary"]).to_numpy(np.int64)
    out = np.zeros((len(sources), len(sources)), np.int64)
    if len(terms):
        row, names = pd.factorize(terms["term"])
        column = terms["source"].map(at).to_numpy(np.int64)
        order = np.argsort(row, kind="stable")
        row, column, n = row[order], column[order], terms["n"].to_numpy(np.int64)[order]
        step = max(1, CELLS // len(sources))
        zero = 1 + SCALE // divisor
        for lo in range(0, len(names), step):
            hi = min(lo + step, len(names))
            a, b = np.searchsorted(row, [lo, hi])
            p = np.repeat(zero[:, None], hi - lo, axis=1)
            some = n[a:b].astype(object) if len(n) and n.max() > 2**32 else n[a:b]  # SCALE * n must stay exact
            p[column[a:b], row[a:b] - lo] = 1 + (some + 1) * SCALE // divisor[column[a:b]]
            for s in range(len(sources)):
                out[s] += ((p[s] - p) ** 2 // p).sum(axis=1)
    s, t = np.nonzero(~np.eye(len(sources), dtype=bool))
    return pd.DataFrame({"lang": key[0], "source": sources[s], "item": sources[t], "value": out[s, t]})


def pairs(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each group and each other source of its language."""
    blocks = max(1, -(-kept.count() // BLOCK_ROWS))
    terms = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), "term", "source", "n")
    groups = totals.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "source", "total", "vocabulary")
    sums = terms.groupBy("lang", "block").cogroup(groups.groupBy("lang", "block")).applyInPandas(
        _pair_sums, "lang string, source string, item string, value long"
    )
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def overused(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value) for the terms that a group uses more than its language."""
    rows = kept.join(totals, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"),
        _share(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary")).alias("q"),
    )
    return rows.filter("p > q").select("lang", "source", "item", _divergence(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank for every (lang, source) group."""
    kept = stored(kept_counts(docs, min_docs), "divergence-kept")
    totals = stored(group_totals(docs, kept), "divergence-totals")
    ranks = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pair = pairs(kept, totals).withColumn("rank", F.row_number().over(ranks)).withColumn("part", F.lit("pair"))
    # the filter on row_number lets each task keep its own first ranks before the exchange
    term = overused(kept, totals).withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= top_terms)
    return pair.select(columns).union(term.withColumn("part", F.lit("term")).select(columns))
