"""Source divergence, line dedup and conversation repair against brute force, and on odd inputs."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from rxgrid.llm import divergence, linededup, repair
from rxgrid.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
EDGE = " \t\n\x0b\f\r"


def brute_audit(rows):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    count, docs = collections.Counter(), collections.Counter()
    for lang, source, text in rows:
        own = collections.Counter(TERM.findall(text.translate(LOWER)))
        for t, n in own.items():
            count[lang, source, t] += n
            docs[lang, t] += 1
    out = set()
    for lang in {r[0] for r in rows}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= 3]
        groups = sorted({s for x, s, _ in rows if x == lang})

        def shares(of):
            n = [sum(count[lang, s, t] for s in of) for t in kept]
            return n, [1 + 10**9 * (x + 1) // (sum(n) + len(kept)) for x in n]

        whole = shares(groups)[1]
        for s in groups:
            n, p = shares([s])
            found = {"pair": [(sum((a - b) ** 2 // b for a, b in zip(p, shares([t])[1], strict=True)), t) for t in groups if t != s]}
            found["term"] = [((a - b) ** 2 // b, t) for t, x, a, b in zip(kept, n, p, whole, strict=True) if x > 0 and a > b]
            for part, items in found.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, t, v, k) for k, (v, t) in enumerate(items[: 200 if part == "term" else None], 1)}
    return out


def got_audit(docs, **kw):
    return {tuple(r) for r in divergence.audit(docs, **kw).collect()}


def test_divergence_matches_brute_force(sample, odd, none, monkeypatch):
    for docs in (sample.limit(60), odd):
        want = brute_audit([(r.lang, r.source, r.text) for r in docs.collect()])
        assert got_audit(docs) == want
    assert divergence.audit(none).collect() == []
    monkeypatch.setattr(divergence, "BLOCK_ROWS", 50)  # many blocks give the same sums
    assert got_audit(sample.limit(60)) == brute_audit([(r.lang, r.source, r.text) for r in sample.limit(60).collect()])


def test_divergence_tokenizer(monkeypatch):
    text = "Straße ÉCOLE école-x_y\x7fz\x00A1b日本 " * 50
    want = collections.Counter(t.encode() for t in TERM.findall(text.translate(LOWER)))
    assert divergence.term_counts(text.encode()) == want
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert divergence.term_counts(text.encode()) == want
    assert divergence.term_counts(b"x" * 100) == {b"x" * 100: 1}


def test_divergence_ties_and_groups_without_terms(spark):
    rows = [("en", s, "b a c") for s in ("s1", "s2", "s3")] + [("en", "s4", "..."), ("xx", "s1", "one"), ("xx", "s2", None), (None, None, "a a a")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = got_audit(docs)
    assert got == brute_audit(rows)
    assert ("xx", "s2", "pair", "s1", 0, 1) in got


def brute_lines(rows):
    def key(line):
        return line.strip(EDGE).translate(LOWER)

    late = (1, 0)
    order = {i: late if i is None else (0, i) for i, _ in rows}
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                held[key(line)].add(order[i])
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < 2 or min(held[key(x)]) == order[i]]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_line_dedup_matches_brute_force(spark, sample, odd, none):
    cases = [(r.doc_id, r.text) for r in sample.collect()], [(r.doc_id, r.text) for r in odd.collect()], [
        (5, "A line that is shared\n\nother\n a LINE that is shared\x0b"), (3, "a line that is shared \nÀ line that is shared"), (None, "a line that is shared"),
        (None, "only in rows without id"), (9, "à line that is shared\nshort\nninechars"), (9, "short\nninechars\nonly in rows WITHOUT id"), (7, None), (8, ""),
        (11, "日本語日本語日本語日\nééééééééé"), (12, "日本語日本語日本語日\nééééééééé"), (13, "x" * 200_000 + "\n" + "y" * 11), (14, "X" * 200_000),
    ]
    for rows in cases:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in linededup.dedup(docs).collect()]
        assert order(got) == order(brute_lines(rows))
    assert linededup.dedup(none).collect() == []


def test_line_dedup_keeps_extra_columns(spark):
    docs = spark.createDataFrame([(1, "the same line here", "h", 5), (2, "the same line here", None, 6)], "doc_id long, text string, hash string, n_lines long")
    out = linededup.dedup(docs)
    assert out.columns == ["doc_id", "text", "hash", "n_lines", "n_dropped"]
    assert {tuple(r) for r in out.collect()} == {(1, "the same line here", "h", 1, 0), (2, "", None, 1, 1)}


def brute_repair(steps):
    """All audits of a few steps: least (cost, audit) that gives s?(ua)+ or nothing."""
    best = None

    def go(i, out, cost, audit, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(steps):
            if re.fullmatch(r"(s?(ua)+)?", out):
                best = min(best, (cost, audit)) if best else (cost, audit)
        if inserts:
            for r in "ua":
                go(i, out + r, cost + 5, audit + "I", inserts - 1)
        if i == len(steps):
            return
        if isinstance(steps[i], int):
            return go(i + 1, out, cost + 2 * steps[i], audit + "D" * steps[i], inserts)
        initial, truncated = steps[i]
        extra = 5 * truncated
        go(i + 1, out, cost + 2, audit + "D", inserts)
        if initial:
            go(i + 1, out + initial, cost + extra, audit + "K", inserts)
        for r in "ua":
            go(i + 1, out + r, cost + 1 + extra, audit + "R", inserts)

    go(0, "", 0, "", 3)
    return best


def test_bidirectional_search_matches_brute_force(monkeypatch):
    kinds = [("u", False), ("a", False), ("s", False), ("u", True), ("a", True), ("t", False), ("", True), 1, 2]
    rng = random.Random(5)
    cases = [list(c) for n in range(3) for c in itertools.product(kinds, repeat=n)] + [[rng.choice(kinds) for _ in range(rng.randint(3, 6))] for _ in range(150)]
    for steps in cases:
        assert repair.cheapest(steps) == brute_repair(steps), steps
    monkeypatch.setattr(repair, "BLOCK", 3)  # blocks joined give the same ways
    for _ in range(60):
        steps = [rng.choice(kinds) for _ in range(rng.randint(4, 40))]
        assert repair.whole(steps) == repair.cheapest(steps)


def brute_conversation(rows):
    """rows: (turn, role, text) of one conversation after damage -> all result columns but conv_id."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    seen, steps, n = set(), [], collections.Counter()
    for _, role, text in rows:
        body = text.strip(EDGE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        n[fault] += 1
        steps.append(1 if fault in ("blank", "duplicate") else (role[:1], fault == "truncated"))
    cost, audit = repair.cheapest(steps)
    at, out, state = 0, [], "a"
    for edit in audit:
        turn = {"a": "user", "u": "assistant", "s": "user"}[state]
        if edit == "I":
            out.append(f"{turn}:")
        else:
            _, role, text = rows[at]
            at += 1
            if edit == "D":
                continue
            out.append(f"{role if edit == 'K' else turn}:{text}")
        state = out[-1][0]
    turns = {t for t, _, _ in rows} - {None}
    illegal = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


CONV = "conv_id long, turn long, role string, text string, kind string, audit string"


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [] if fault == 0 else [(c, t, role, text)] * (2 if fault == 3 else 1)
    return out


def brute_all(rows, every):
    groups = collections.defaultdict(list)
    for c, *row in rows:
        groups[c].append(row)
    return {c: brute_conversation(groups[c]) if groups[c] else (0,) * 6 + ("", hashlib.sha256().hexdigest()) for c in every}


def got_repair(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_repair_matches_brute_force_on_long_and_odd_conversations(spark):
    rng = random.Random(11)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", "Well then!", " ", None, "", "What?\n", "é.", "…"]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in [*range(40), None] for _ in range(rng.randint(1, 12))]
    rows += [(1000, t, rng.choice(roles[:3]), f"text {t % 2500}{rng.choice(['.', ''])}") for t in range(4000)]  # one conversation over all tasks
    rows += [(1001, 5, "user", "same.")] * 3000 + [(1001, 6, "assistant", "same.")]
    docs = spark.createDataFrame([(*r, "row", "x") for r in rows], CONV).repartition(7)
    assert got_repair(repair.repair(docs)) == brute_all(rows, {r[0] for r in rows})
    assert got_repair(repair.repair_damaged(docs)) == brute_all(brute_damage(rows), {r[0] for r in rows})
    assert repair.repair_damaged(docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_line_dedup", "op13_conversation_repair"])
def test_registered_queries(spark, name):
    sf = "/root/testdata/sf0.001"
    got = QUERIES[name](spark, sf)
    if name.startswith("op11"):
        rows = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source", "text").collect()
        assert {tuple(r) for r in got.collect()} == brute_audit([tuple(r) for r in rows])
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    elif name.startswith("op12"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines(rows)]
        assert order(tuple(r) for r in got.collect()) == order(want)
        assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    else:
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert got_repair(got) == brute_all(brute_damage(rows), {r[0] for r in rows})
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_bit_sets_never_reject_a_link():
    import numpy as np

    from rxgrid.llm import neardup

    rng = np.random.default_rng(2)
    for bits in (64, 1024):
        base = [rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64) for _ in range(30)]
        sets = [np.unique(np.concatenate([b[rng.random(len(b)) < keep], rng.integers(0, 2**63, extra, dtype=np.uint64)]))
                for b in base for keep, extra in ((1.0, 0), (0.95, 3), (0.85, 10), (0.7, 0))]
        sets = [x for x in sets if len(x)]
        size = np.array([len(x) for x in sets])
        words = np.frombuffer(b"".join(neardup._bit_set(x, bits) for x in sets), np.uint64).reshape(len(sets), -1)
        i, j = np.triu_indices(len(sets), 1)
        both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
        link = 100 * both >= 75 * (size[i] + size[j] - both)
        ok = neardup._possible(i, j, size, words, 75)
        assert link.sum() > 20 and ok[link].all() and (bits < 1024 or ok.mean() < 0.2)


def test_settlement_of_open_buckets_matches_brute_force(spark):
    """A dense family with links that no hub sees, in blocks of a few rows."""
    from rxgrid.llm import neardup

    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t in rows}
    label = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a, b in itertools.combinations(sets, 2):
            if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    for cfg in (neardup.NearDup(), neardup.NearDup(hub_rounds=0, block=16)):
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, cfg).collect()}
        assert got == label
