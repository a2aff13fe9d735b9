"""Registered queries of the subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rxgrid.llm import bpe, decontam, divergence, html, langid, linededup, lm, neardup, quality, repair, substring, toxicity, urls
from rxgrid.llm.common import split_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


@query("op1_html_main_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query("op2_url_filter")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


_WORD = r"[^\x20\x09-\x0D]+"

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
win AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
        FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 3)),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(rep.n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines, (length(text) - length(replace(text, '!', '')))::BIGINT AS n_bangs
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
             + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
             + (CASE WHEN 2 * n_dup_lines > n_lines AND n_lines > 3 THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
             + (CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END)
             + (CASE WHEN 2 * n_bangs > n_words THEN 64 ELSE 0 END) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, failed = 0 AS kept,
       failed::BIGINT AS failed, n_lines, n_bangs
FROM f
"""


@query("op3_quality_rules", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.apply_policy(quality.ledger(docs))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "n_lines", "n_bangs"
    )


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(split_of(F.col("doc_id"), 4) == 2, F.lit(False))
    out = langid.train_and_predict(docs, held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op5_minhash_neardup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), corpus_pipeline.bpe_path())
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(split_of(F.col("doc_id"), 5) == 0, F.lit(False))
    out = toxicity.train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


OP8_SQL = rf"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM benchmark),
isg AS (SELECT DISTINCT item_id, list_slice(w, k, k + least(len(w), 5) - 1) AS s, least(len(w), 5) AS width
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM i WHERE len(w) > 0)),
isz AS (SELECT item_id, count(*) AS item_shingles FROM isg GROUP BY item_id),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
widths AS (SELECT DISTINCT width FROM isg),
dsg AS (SELECT DISTINCT doc_id, list_slice(w, k, k + width - 1) AS s
        FROM (SELECT doc_id, w, width, unnest(generate_series(1, len(w) - width + 1)) AS k FROM d, widths WHERE len(w) >= width)
        WHERE list_slice(w, k, k + width - 1) IN (SELECT s FROM isg)),
hit AS (SELECT doc_id, item_id, count(*) AS shared FROM dsg JOIN isg USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles::BIGINT AS item_shingles, shared::BIGINT AS shared
FROM hit JOIN isz USING (item_id) WHERE 100 * shared >= 75 * item_shingles
"""


@query("op8_decontamination", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_substring_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op10_kneser_ney")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(split_of(F.col("doc_id"), 7) == 2, F.lit(False))
    out = lm.train_and_score(table(spark, sf_dir, "documents"), held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q
      FROM c GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item,
                coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // y.p) FROM p x JOIN p y USING (lang, term)
                          WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM z WHERE part = 'pair' OR rank <= 200
"""


@query("op11_source_divergence", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT r, doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_AZ}) AS key FROM l),
s AS (SELECT key, min(doc_id) AS first, count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) AS docs FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, coalesce(s.docs, 0) >= 2 AND doc_id IS DISTINCT FROM s.first AS gone FROM k LEFT JOIN s USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""


@query("op12_line_dedup", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def _op13_sql() -> str:
    """One recursion step per row; a way is [cost and audit, repaired rows], so that least() takes cost, then audit."""

    def add(way: str, cost: str, initial: str, line: str = "''") -> str:
        return (
            f"CASE WHEN {way} IS NOT NULL THEN [printf('%09d', left({way}[1], 9)::BIGINT + {cost}) || substr({way}[1], 10) || {initial}, {way}[2] || {line}] END"
        )

    def least(*ways: str) -> str:
        return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"

    nl = "chr(10) || "
    inserted = {
        0: "w0", 1: "w1",
        2: least("w2", *[add(f"w{k}", "5", "'I'", nl + "'user:'") for k in (0, 1, 3)]),
        3: least("w3", add("w2", "5", "'I'", nl + "'assistant:'")),
    }

    def onto(state: int, before: tuple[int, ...], initial: str, role: str) -> str:
        edits = [add(f"w{state}", "2", "'D'")]
        for k in before:
            edits.append(f"CASE WHEN NOT gone AND ini = '{initial}' THEN {add(f'w{k}', 'extra', chr(39) + 'K' + chr(39), nl + 'role || chr(58) || text')} END")
            if role:
                edits.append(f"CASE WHEN NOT gone THEN {add(f'w{k}', '1 + extra', chr(39) + 'R' + chr(39), nl + chr(39) + role + ':' + chr(39) + ' || text')} END")
        return least(*edits)

    return rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT o.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault FROM o, crc),
a AS (SELECT row_number() OVER () AS id, conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM h, range(2) AS copy(c) WHERE fault <> 0 AND (c = 0 OR fault = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, id) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id) > 1 AS again,
             regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body FROM a),
f AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS ini, body = '' AS blank, body <> '' AND again AS duplicate,
             body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS last FROM n),
s AS (SELECT conv_id, i, role, text, ini, blank OR duplicate AS gone, CASE WHEN truncated THEN 5 ELSE 0 END AS extra FROM f),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, ['000000000', ''] AS w0, NULL::VARCHAR[] AS w1, NULL::VARCHAR[] AS w2, NULL::VARCHAR[] AS w3 FROM s
  UNION ALL
  SELECT conv_id, i, {onto(0, (), '', '')}, {onto(1, (0,), 's', '')}, {onto(2, (0, 1, 3), 'u', 'user')}, {onto(3, (2,), 'a', 'assistant')}
  FROM (SELECT s.*, {inserted[0]} AS w0, {inserted[1]} AS w1, {inserted[2]} AS w2, {inserted[3]} AS w3
        FROM walk JOIN s ON s.conv_id IS NOT DISTINCT FROM walk.conv_id AND s.i = walk.i + 1)),
ends AS (SELECT conv_id, {least('w0', inserted[3])} AS w FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
m AS (SELECT conv_id, count(DISTINCT turn) AS turns, max(turn) - min(turn) + 1 AS span, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
             count(*) FILTER (truncated) AS truncated, count(*) FILTER (i > 1 AND (last || '-' || ini) NOT IN ('s-u', 'u-a', 'a-u')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(span - turns, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(w[1], 9)::BIGINT, 0) AS cost,
       coalesce(substr(w[1], 10), '') AS audit, sha256(coalesce(substr(w[2], 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op13_conversation_repair", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
