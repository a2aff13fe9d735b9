"""Operators against brute force, and their defined results on odd inputs."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rxgrid.llm import bpe, decontam, html, langid, lm, neardup, quality, substring, toxicity, urls
from rxgrid.llm.common import split_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def shingles(text, width=5):
    w = words(text, True)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(label[a], label[b])
            moved |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def brute_substring(rows, window=20):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w, gone = words(t), set()
        for p in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[p : p + window]), (i, p)) != (i, p):
                gone.update(range(p, p + window))
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def test_quality_ledger(sample, odd, none):
    for docs in (sample, odd):
        for r in quality.apply_policy(quality.ledger(docs)).collect():
            w = words(r.text)
            at = collections.defaultdict(list)
            for i in range(len(w) - 2):
                at[tuple(w[i : i + 3])].append(i)
            repeat = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
            lines = [x for x in (r.text or "").split("\n") if words(x)]
            assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(repeat), len(lines) - len(set(lines)))
            assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))
            assert not (r.base_failed and r.kept)
    assert quality.ledger(none).count() == 0
    judged = quality.ledger(sample)
    total = judged.count()
    for r in quality.ablations(judged).collect():
        bit = 1 << list(quality.RULES).index(r.rule)
        assert r.n_rejected_without == judged.filter(F.col("failed").bitwiseAND(F.lit(~bit)) != 0).count() <= total


def test_near_duplicates_match_brute_force(spark, sample):
    rows = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]
    w = words(max((t for _, t in rows), key=len))[:200]
    near = [(10_000 + k, " ".join(w[:k] + ["edit"] + w[k + 1 :])) for k in range(0, 200, 10)]
    docs = spark.createDataFrame(rows + near, "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    want = brute_components(rows + near)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(shingles(t)) and got[i].kept == (want[i] == i) for i, t in rows for r in [got[i]])


def test_near_duplicates_odd(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (1, 2, 3, 5, 6, 9)} == {1: 1, 2: 2, 3: 3, 5: 5, 6: 5, 9: 5}
    assert neardup.near_duplicates(none).count() == 0


def test_substring_dedup(spark, sample, odd, none):
    rows = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring.dedup(sample).collect()}
    assert got == brute_substring(rows)
    out = substring.dedup(odd)
    assert out.columns == [*odd.columns, "n_words", "n_removed"]
    by_id = collections.defaultdict(list)
    for r in out.collect():
        by_id[r.doc_id].append((r.n_words, r.n_removed))
    assert by_id[5] == [(60, 0)] and by_id[6] == [(62, 60)] * 2 and by_id[None] == [(60, 60)] and by_id[2] == [(0, 0)] and by_id[7] == [(300, 299)]
    assert substring.dedup(none).count() == 0


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame(
        [(1, " ".join(f"passage{i}" for i in range(20, 50))), (2, "w1x1 w2x2"), (3, ""), (4, None), (5, "nothing of the sort is in there"), (None, "w1x1 w2x2")],
        "item_id long, text string",
    )
    got = {(r.doc_id, r.item_id) for r in decontam.contained_items(odd, items).collect()}
    assert got == {(5, 1), (6, 1), (None, 1), (9, 1), (4, 2), (4, None)}
    blocks = decontam.contained_items(odd, items, decontam.Decontam(item_block=1))
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == got
    assert decontam.contained_items(none, items).count() == 0 and decontam.contained_items(odd, items.limit(0)).count() == 0


def test_bpe_equals_library(sample, odd, none):
    from tokenizers import Tokenizer

    path = corpus_pipeline.bpe_path()
    tok = Tokenizer.from_file(path)
    for docs in (sample, odd):
        want = collections.Counter()
        for r in docs.collect():
            ids = tok.encode(r.text or "", add_special_tokens=False).ids
            want[r.doc_id, tuple(ids), tok.decode(ids, skip_special_tokens=False)] += 1
        got = bpe.encode(docs, path)
        assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in got.collect()) == want
        assert bpe.decode(got.withColumnRenamed("decoded", "was"), path).filter("decoded <> was").count() == 0
    assert bpe.encode(none, path).count() == 0


@pytest.mark.parametrize("leaf", [3, 16, 50])
def test_bpe_tree(leaf):
    own = bpe.Codec(corpus_pipeline.bpe_path())
    texts = ["thethethe" * 40, "=" * 333 + "ing" * 90, "don't" * 50 + "<|endoftext|>" + "é" * 99, "a" * 1000]
    for t in texts:
        want = own.tok.encode(t, add_special_tokens=False).ids
        assert own.joined([(k, own.piece_ids(x, k)) for x, k in own.pieces(t, leaf)]) == want


def test_decontamination_finds_every_item_of_one_shingle():
    cfg = decontam.Decontam()
    items = [(i, b" ".join(b"i%dx%d" % (i, k) for k in range(5))) for i in range(4000)]
    docs = [t + b" " + b" ".join(b"d%dx%d" % (i, k) for k in range(10)) for i, t in items]
    docs_words = decontam.Words(docs, lower=True)
    h, off = decontam.windows_hash(docs_words.hashes, docs_words.at, cfg.width)
    got = decontam._Index(items, cfg).candidates(h, off, docs_words, cfg)
    assert set(got) >= {(i, i) for i, _ in items}


def test_decontaminate_drops_texts_without_an_id(spark):
    item = " ".join(f"item{i}" for i in range(30))
    docs = spark.createDataFrame([(None, item), (None, "clean text"), (None, None), (1, "before " + item), (2, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontam.decontaminate(docs, items)
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == [("2", "clean"), ("None", "None"), ("None", "clean text")]


def test_language_id(spark, sample, odd, none):
    held = split_of(F.col("doc_id"), 4) == 2
    lang = {r.doc_id: r.lang for r in sample.collect()}
    got = langid.train_and_predict(sample, held).collect()
    test = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(lang[r.doc_id] == r.lang_pred for r in test) >= 0.95 * len(test)
    out = {r.doc_id: r for r in langid.train_and_predict(odd, held).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[3].lang_pred == "und" and all(0 <= r.score <= 1 for r in out.values())
    assert langid.train_and_predict(none, held).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


def test_language_sample_is_of_distinct_texts_per_language(spark):
    rows = [(f"copy {i % 3}", "en") for i in range(900)] + [(f"text {x} {i}", x) for x in ("de", "en", "fr") for i in range(100)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    cfg = langid.LangId(fit_rows=60)
    got = [tuple(r) for r in langid.sample(docs, ("de", "en", "fr"), cfg).collect()]
    assert len(set(got)) == len(got) and collections.Counter(x for _, x in got) == {"de": 20, "en": 20, "fr": 20}


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(3)
    rows, marks = [], []
    for i in range(600):
        w = [f"w{x}" for x in rng.integers(0, 500, 60)]
        if i % 4 == 0:
            w[int(rng.integers(0, 60))] = "idiot!"
        rows.append((i, " ".join(w)))
        marks.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    held = split_of(F.col("doc_id"), 5) == 0
    got = {r.doc_id: r.score for r in toxicity.train_and_score(docs, labels, held).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, y in marks) >= 0.97 * len(marks)
    assert toxicity.train_and_score(none, labels.limit(0), held).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.train_and_score(odd, labels, held).collect())


def test_factorization_machine_learns_an_interaction():
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(4000):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([10 * x + k for k, x in enumerate((a, b), 1)]), int(a != b)))
    model = toxicity.train(rows, toxicity.Toxicity(l1=0.0, epochs=20, factor_l2=0.0, factor_rate=0.1))

    def score(a, b):
        at = np.array([10 * a + 1, 10 * b + 2])
        v = model.factors[at]
        return model.bias + model.weights[at].sum() + v[0] @ v[1]

    assert min(score(0, 1), score(1, 0)) > max(score(0, 0), score(1, 1))


def test_kneser_ney(spark, sample, odd, none):
    model = lm.train(sample)
    got = {r.doc_id: r for r in lm.score(sample, model).collect()}
    counts = collections.Counter()
    for r in sample.collect():
        counts.update([*words(r.text, True), "</s>"])
    total = sum(counts.values())
    for r in sample.collect():
        t = [*words(r.text, True), "</s>"]
        base = sum(np.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in t)
        assert got[r.doc_id].n_tokens == got[r.doc_id].n_known == len(t)
        assert got[r.doc_id].base_score == pytest.approx(base) and got[r.doc_id].score > base
    # the distribution after one context sums to one over the vocabulary and the unknown word
    every = sorted({w.encode() for r in sample.collect() for w in words(r.text, True)})
    first = every[len(every) // 2]
    texts = [first + b" " + w for w in every] + [first, first + b" never-met-before"]
    logp, _, off = lm.log10_probabilities(lm.Words(texts, lower=True), model)
    second = logp[off[:-1] + 1]
    assert (10.0**second).sum() == pytest.approx(1.0, abs=1e-6)
    assert lm.score(odd, lm.train(odd)).filter("score is null or score > 0").count() == 0
    assert lm.score(odd, lm.train(none)).count() == odd.count()


def brute_kneser_ney(texts, order):
    """log10 p of every token of every text, by counts in dictionaries."""
    seqs = [["<s>", *words(t, True), "</s>"] for t in texts]
    grams = {k: collections.Counter(tuple(q[i - k + 1 : i + 1]) for q in seqs for i in range(k - 1, len(q))) for k in range(2, order + 1)}
    grams[1] = None
    for k in range(order - 1, 0, -1):
        left = collections.Counter(g[1:] for g in grams[k + 1])
        if k > 1:
            left.update({g: n for g, n in grams[k].items() if g[0] == "<s>"})
        grams[k] = left
    cut = {}
    for k, own in grams.items():
        n = collections.Counter(own.values())
        cut[k] = (0.0, *lm._discounts(n[1], n[2], n[3], n[4]))
    by = {k: collections.defaultdict(list) for k in grams}
    for k, own in grams.items():
        for g, n in own.items():
            by[k][g[:-1]].append(n)
    size = len(grams[1])

    def p(h, w):
        k = len(h) + 1
        low = p(h[1:], w) if h else 1 / (size + 1)
        near = by[k].get(h)
        if not near:
            return low
        n = grams[k].get((*h, w), 0)
        return (n - cut[k][min(n, 3)] + sum(cut[k][min(x, 3)] for x in near) * low) / sum(near)

    return [sum(np.log10(p(tuple(q[max(0, i - order + 1) : i]), q[i])) for i in range(1, len(q))) for q in seqs]


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_orders(spark, order):
    rng = np.random.default_rng(order)
    texts = ["", "a", *[" ".join("abcdef"[int(x)] for x in rng.integers(0, 6, int(rng.integers(1, 30)))) for _ in range(40)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(docs, lm.train(docs, order=order)).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(brute_kneser_ney(texts, order))
    assert lm.train(docs.limit(0)).order == 3


def test_kneser_ney_columns_travel_compressed():
    rng = np.random.default_rng(7)
    middle, first, token = (np.minimum(rng.zipf(1.3, 20_000), 50_000).astype(np.uint64) for _ in range(3))
    pair, more = first << np.uint64(32) | middle, np.stack([token, np.ones(20_000, np.uint64)], 1).astype(np.uint32)
    bucket = (middle % np.uint64(3)).astype(np.int64)
    sent = lm._rows_by(bucket, pair, more, 4).to_pylist()
    assert sum(len(r["a"]) + len(r["b"]) for r in sent) < 8 * len(pair)  # 16 bytes a row as they are
    for r in sent:
        own = bucket == r["bucket"]
        got = zip(lm._unsqueezed_keys(r["a"]).tolist(), *lm._unsqueezed(r["b"], np.uint32).T.tolist(), strict=True)
        assert sorted(got) == sorted(zip(pair[own].tolist(), *more[own].T.tolist(), strict=True))
    values = np.concatenate([np.stack([np.ones(20_000, int), token.astype(int) % 3], 1), [[300, 70_000]], np.arange(800).reshape(-1, 2)])
    data, at = lm._coded(values), rng.permutation(len(values))
    assert (lm._decoded(data, at, 2) == values[at]).all() and len(data) < 2 * len(values)  # 8 bytes a row as they are
    assert lm._decoded(lm._coded(values << 20), at, 2)[:, 1].max() == 70_000 << 20 and len(lm._coded(values[:0])) == 12


PAGE = (
    '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href="#">Home {0}</a></nav><div class="cookie-notice">We use</div>'
    "<div id='c{0}'><article><h1>Head {0}</h1><p>One &amp;  two<br>three <b>bo</b>ld {0}<p>Four</article></div><div class=comments><p>Nice {0}</div>"
    "<aside>More {0}</aside><footer>&copy; {0}</footer></body></html>"
)


def test_html_main_text(spark, none):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i)) for i in range(6)]
    rows += [(10, None, "<p>Only</p> text <!-- no -->"), (11, "http://b.example/", None), (12, "x", ""), (None, "http://b.example/", "<main>M<script>x"), (0, rows[0][1], rows[0][2])]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[i] == f"Head {i} One & two three bold {i} Four" for i in range(6))
    assert (text[10], text[11], text[12], text[None]) == ("Only text", "", "", "M")
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_near_duplicates_of_every_table(spark):
    """Documents 1 and 2 are linked and meet in table (0, 3) alone, whose hub 0 is linked to neither."""
    rng = np.random.default_rng(451)
    rows = []
    for i, at in enumerate((rng.choice(np.arange(5, 75, 10), 3, replace=False), (), rng.choice(np.arange(10, 75, 10), 2, replace=False))):
        rows.append((i, " ".join(f"new{k}y{len(at)}" if k in at else f"w451x{k}" for k in range(80))))
    want = brute_components(rows)
    assert want == {0: 0, 1: 1, 2: 1}
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.NearDup(side=4)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert neardup.miss(neardup.NearDup(), 0.75) < 1e-5


def test_html_main_slot_keeps_the_whole_article(spark):
    page = "<html><body><article><h1>Title {0}</h1><div class=lead>Lead {0}</div><div class=body>{1}</div></article></body></html>"
    rows = [(i, f"http://a.example/{i}", page.format(i, f"long{i} " * 20)) for i in range(6)]
    rows += [(6, "http://a.example/6", page.format(6, "short"))]
    rows += [(7, "http://b.example/", "<html><body><p>x</p><article id=a>One</article><article id=b>Two</article></body></html>")]
    text = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[i] == f"Title {i} Lead {i} " + " ".join([f"long{i}"] * 20) for i in range(6))
    assert text[6] == "Title 6 Lead 6 short" and html.main_text(rows[7][2], frozenset(), frozenset())[0] == "One Two"


def test_html_template_text_and_marks_of_every_element(spark):
    page = (
        "<html><body><ol class=breadcrumb><li>Up<li>{0}</ol><article><h1 class=header>Title {0}</h1><p class=advert>Buy {0}<p>Own {0} "
        + "text{0} " * 20 + "<p>Share this story<ul class=comments><li>Nice {0}</ul><table class=sidebar><tr><td>Side {0}</table></article></body></html>"
    )
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(6)] + [(6, "http://a.example/x", "<html><body><p>No article</body></html>")]
    rows += [(7 + i, f"http://b.example/{i}", f"<html><body><p>One copy of a text<p>{i}</body></html>") for i in range(4)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == f"Title {i} Own {i} " + " ".join([f"text{i}"] * 20) for i in range(6))
    assert all(got[i].main_slot == "html/body/article" for i in range(6)) and got[6].text == "No article"
    assert all(got[7 + i].text == f"One copy of a text {i}" for i in range(4))


def test_url_filter(spark):
    rows = [
        (1, "HTTP://Example.COM/en/x?q=1"), (2, "https://www.example.com/en/1"), (3, "http://a.net/es/1"), (4, "http://a.net/de/1"), (5, None), (6, "nothing"),
        (7, "http://notexample.com/en/1"), (8, "http://com"), (8, "http://com"), (None, "http://x.org/?a=1&b=2"),
    ]
    rows += [(100 + i, f"http://{'casino-win' if i % 3 == 0 else 'news'}{i}.example.org/{i}") for i in range(90)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert [(by[i].rule, by[i].verdict) for i in (1, 2, 3, 7)] == [
        ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("com/", "allow")
    ]
    assert by[4].rule is by[8].rule is None and (by[5].host, by[5].path, by[6].host) == ("", "", "")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    spam = urls.judge(spark.createDataFrame([(i, f"http://{h}.org/{i}") for i in range(60) for h in ("cheap-pills", "weather")], "page_id long, url string"))
    assert spam.filter("(verdict = 'block') <> (host = 'cheap-pills.org')").count() == 0


def test_url_filter_fits_a_rare_label(spark):
    rows = [(i, f"http://weather{i}.org/") for i in range(400)] + [(400 + i, f"http://cheap-pills-{i}{i}{i}.biz/") for i in range(2)]
    label = F.when(F.col("host").contains("pills"), 1).otherwise(0)
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.UrlFilter(fit_rows=20), rules=(), label=label).collect()
    assert all((r.verdict == "block") == (r.page_id >= 400) and r.block_score is not None for r in got)


def test_pipeline_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    judged = quality.apply_policy(quality.ledger(docs)).filter("kept").collect()
    left = {r.doc_id: r.text for r in judged}
    label = brute_components(list(left.items()))
    left = {i: t for i, t in left.items() if label[i] == i}
    left = {i: x[2] for i, x in brute_substring(list(left.items())).items()}
    items = [shingles(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(s and 100 * len(s & shingles(t)) >= 75 * len(s) for s in items)}
    own = bpe.codec(corpus_pipeline.bpe_path())
    want = {i: hashlib.sha256(own.encode(t.encode())[0]).hexdigest() for i, t in left.items()}
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {r.doc_id: r.ids_sha256 for r in got.collect()} == want
    assert 0 < len(want) < len(rows) and len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages_on_odd_tables(spark, odd, none):
    sf = "/root/testdata/sf0.001"
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
