r"""Conversation structure repair: the cheapest edits that make the turns alternate, by bidirectional Dijkstra.

A conversation's rows, by turn, are a line of steps; the edit lattice has one node per (rows read, last role
written).  Keep costs 0 (5 for a truncated row), Rerole 1 more, Delete 2, Insert 5; blank and repeated rows
can only be deleted.  A forward heap starts before the first row, a reverse heap behind the last one, in
every state that ends a legal dialogue.  Nodes settle by (cost, rows passed), which grows along each edge, so
a settled node holds its cheapest cost and the least audit of that cost.  Once the heaps meet, both go on
until no path as cheap as the best can be open; each edge from a node settled forward to one settled in
reverse is a crossing, and the least concatenated audit among the cheapest crossings wins.  (Of two audits of
equal cost between the same nodes neither is a prefix of the other, as what follows it would cost something,
so least parts make the least whole.)

Spark: copies of a row are counted before they are shuffled, first occurrences are found by a sum per
(conversation, role, text), and rows are dealt by range over (conversation, turn, role, text), so that a
conversation of any length spreads over tasks.  Only the first and last conversation of a task can reach
into another: such segments leave a table of cheapest ways between any two states, which are joined up per
conversation afterwards.  Its SHA-256 is the one thing that reads a conversation in one place, as a stream.

Defined results: nulls are one space in roles, texts and keys; a null conv_id is a conversation of its own; rows
of one turn are ordered by role and text (UTF-8); null turns come first; roles are known by their first
character (an empty role has none and can only be changed or deleted); an empty table gives no rows; a
conversation without rows after damage has zeros, an empty audit and the hash of the empty text; very long
texts and conversations have no limit; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxgrid.llm.common import partitions, stored

KEEP_TRUNCATED, REROLE, DELETE, INSERT = 5, 1, 2, 5
#: What was written last: nothing, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: Steps of one search; longer conversations are searched block by block between all states.
BLOCK = 128
_EDGE = " \t\n\x0b\f\r"

Way = tuple[int, str]  # cost, audit


def _edges(steps: list, i: int, state: int) -> Iterator[tuple[int, str, tuple[int, int]]]:
    """(cost, initial, node) of every edit at a node.  A step is a number of rows to delete, or (initial, truncated)."""
    after = NEXT[state]
    yield INSERT, "I", (i, after)
    if i == len(steps):
        return
    step = steps[i]
    if isinstance(step, int):
        yield DELETE * step, "D" * step, (i + 1, state)
        return
    initial, truncated = step
    extra = KEEP_TRUNCATED if truncated else 0
    yield DELETE, "D", (i + 1, state)
    yield REROLE + extra, "R", (i + 1, after)
    if initial == ROLE[after][0]:
        yield extra, "K", (i + 1, after)
    elif initial == "s" and state == START:
        yield extra, "K", (i + 1, SYSTEM)


def cheapest(steps: list, start: int = START, ends: Iterable[int] = ENDS) -> Way | None:
    """Cheapest edits from `start` to one of `ends` over all steps, with the least audit; None if there are none."""
    n = len(steps)
    out: dict = {(i, s): list(_edges(steps, i, s)) for i in range(n + 1) for s in range(4)}
    into: dict = {v: [] for v in out}
    for v, edges in out.items():
        for cost, label, w in edges:
            into[w].append((cost, label, v))
    ahead, behind = {(0, start): (0, "")}, {(n, s): (0, "") for s in ends}
    heap_a, heap_b = [(0, 0, (0, start))], [(0, 0, v) for v in behind]
    done_a, done_b = set(), set()
    best: Way | None = None
    while heap_a and heap_b and (best is None or heap_a[0][0] + heap_b[0][0] <= best[0]):
        reverse = heap_b[0][0] <= heap_a[0][0]
        heap, own, done, other, reached = (heap_b, behind, done_b, done_a, ahead) if reverse else (heap_a, ahead, done_a, done_b, behind)
        v = heapq.heappop(heap)[2]
        if v in done:
            continue
        done.add(v)
        cost, audit = own[v]
        found = [(cost, audit, v)] if v in other else []  # both searches end here
        for c, label, w in into[v] if reverse else out[v]:
            way = (cost + c, label + audit if reverse else audit + label)
            if w in other:
                found.append((*way, w))
            if w not in own or way < own[w]:
                own[w] = way
                heapq.heappush(heap, (way[0], n - w[0] if reverse else w[0], w))
        for c, a, w in found:
            rest_cost, rest = reached[w]
            whole = (c + rest_cost, rest + a if reverse else a + rest)
            best = whole if best is None else min(best, whole)
    return best


def ways(steps: list) -> dict[tuple[int, int], Way]:
    """Cheapest ways between any two states: blocks are searched, halves are joined."""
    if len(steps) > BLOCK:
        half = BLOCK * -(-len(steps) // (2 * BLOCK))
        return joined(ways(steps[:half]), ways(steps[half:]))
    return {(p, q): w for p in range(4) for q in range(4) if (w := cheapest(steps, p, (q,)))}


def joined(first: dict, second: dict) -> dict:
    """Cheapest ways through one segment and then another."""
    out: dict = {}
    for (p, m), (c1, a1) in first.items():
        for (m2, q), (c2, a2) in second.items():
            if m == m2 and ((p, q) not in out or (c1 + c2, a1 + a2) < out[p, q]):
                out[p, q] = (c1 + c2, a1 + a2)
    return out


def whole(steps: list) -> Way:
    """Cheapest repair of a whole conversation (deleting everything always is one)."""
    if len(steps) <= BLOCK:
        return cheapest(steps)
    table = ways(steps)
    return min(table[START, q] for q in ENDS if (START, q) in table)


class Writer:
    """Hashes the repaired rows of one conversation as they come."""

    def __init__(self):
        self.state, self.audit, self.at, self.some, self.sha = START, "", 0, False, hashlib.sha256()

    def _write(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.some else "") + role + ":" + text).encode())
        self.some = True

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = NEXT[self.state]
            self._write(ROLE[self.state], "")
            self.at += 1

    def row(self, role: str, text: str, deleted: bool, n: int) -> None:
        self.inserts()
        edit = self.audit[self.at]
        if not deleted and edit != "D":
            self.state = SYSTEM if edit == "K" and role[:1] == "s" else NEXT[self.state]
            self._write(role if edit == "K" else ROLE[self.state], text)
        if not deleted:
            self.at += 1
            n -= 1
            if n:
                self.inserts()
        self.at += n


def damaged(conversations: DataFrame) -> DataFrame:
    """The test damage of a conversation table, by crc32 of `conv_id:turn` modulo 20."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("fault"),
    ).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 3, F.lit(2)).otherwise(F.lit(1))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("n")))).drop("col")


def _digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def judged(rows: DataFrame) -> DataFrame:
    """One row per different (conversation, turn, role, text): n copies and the first fault of the first copy."""
    space = F.lit(" ")
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = stored(rows.withColumn("digest", _digest(F.col("role"), F.col("text"))), "repair-rows")
    # only the earliest turn of a (role, text) is no repetition; null turns are the earliest
    first = rows.groupBy("conv_id", "digest").agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("unnumbered"))
    first = first.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first", "unnumbered")
    both = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    earlier = F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("turn") > F.col("first")))
    body = F.btrim("text", F.lit(_EDGE))
    fault = F.when(body == "", "blank").when(earlier, "duplicate").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated")
    return both.select("conv_id", "turn", "role", "text", "n", F.coalesce(fault, F.lit("")).alias("fault"))


_WAY = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
#: Rows of three kinds: `done` conversations, `open` segments, and the `row`s of open segments.
_OUT = pa.schema([
    ("kind", pa.string()), ("conv_id", pa.int64()), ("segment", pa.int64()), ("pos", pa.int64()),
    ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string()),
    ("ways", pa.list_(_WAY)), ("role", pa.string()), ("text", pa.string()), ("deleted", pa.bool_()), ("n", pa.int64()),
])
_OUT_SQL = (
    "kind string, conv_id long, segment long, pos long, low long, high long, turns long, blank long, duplicate long, truncated long, "
    "illegal long, head string, tail string, cost long, audit string, sha string, "
    "ways array<struct<p int, q int, cost long, audit string>>, role string, text string, deleted boolean, n long"
)


def _counts(rows: list) -> tuple[dict, list]:
    """Counts of a conversation's consecutive rows (turn, role, text, n, fault), and its steps."""
    out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    steps: list = []
    before = None
    for _, role, _, n, fault in rows:
        if fault in ("blank", "duplicate"):
            out[fault] += n
            steps.append(n)
        else:
            out["truncated"] += fault == "truncated"
            out["duplicate"] += n - 1
            steps.append((role[:1], fault == "truncated"))
            if n > 1:
                steps.append(n - 1)
        out["illegal"] += n - 1 + (before is not None and (before, role[:1]) not in LEGAL)
        before = role[:1]
    turns = {t for t, *_ in rows} - {None}
    out |= {"low": min(turns, default=None), "high": max(turns, default=None), "turns": len(turns), "head": rows[0][1][:1], "tail": before}
    return out, steps


def _segment(conv_id, rows: list, open_at: int | None) -> Iterator[dict]:
    counts, steps = _counts(rows)
    if open_at is None:
        cost, audit = whole(steps)
        writer = Writer()
        writer.audit = audit
        for _, role, text, n, fault in rows:
            writer.row(role, text, fault in ("blank", "duplicate"), n)
        writer.inserts()
        yield {"kind": "done", "conv_id": conv_id, "cost": cost, "audit": audit, "sha": writer.sha.hexdigest(), **counts}
        return
    table = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in ways(steps).items()]
    yield {"kind": "open", "conv_id": conv_id, "segment": open_at, "ways": table, **counts}
    for pos, (_, role, text, n, fault) in enumerate(rows):
        yield {
            "kind": "row", "conv_id": conv_id, "segment": open_at, "pos": pos, "role": role, "text": text, "n": n,
            "deleted": fault in ("blank", "duplicate"),
        }


def _sent(rows: list) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_pylist(rows[lo : lo + 2000], _OUT)


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range -> its conversations; the first and the last may reach into other ranges."""
    me = TaskContext.get().partitionId()
    run: list = []
    at = None
    first = True
    for batch in batches:
        out: list = []
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for conv_id, *row in zip(*columns, strict=True):
            if run and conv_id != at:
                out += _segment(at, run, me if first else None)
                run, first = [], False
            at = conv_id
            run.append(row)
        yield from _sent(out)
    if run:
        yield from _sent(list(_segment(at, run, me)))


_JOINED = pa.schema([*[_OUT.field(f) for f in ("kind", "conv_id", "segment", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit")], ("state", pa.int32())])
_JOINED_SQL = (
    "kind string, conv_id long, segment long, low long, high long, turns long, blank long, duplicate long, truncated long, "
    "illegal long, cost long, audit string, state int"
)


def _join_segments(segments: pa.Table) -> pa.Table:
    """Segments of one conversation -> its result and, per segment, the state it starts in and its audit."""
    parts = sorted(segments.to_pylist(), key=lambda x: x["segment"])
    total = {k: sum(x[k] for x in parts) for k in ("turns", "blank", "duplicate", "truncated", "illegal")}
    for x, y in zip(parts, parts[1:], strict=False):
        total["illegal"] += (x["tail"], y["head"]) not in LEGAL
    turns = [x for x in parts if x["turns"]]
    total["turns"] -= sum(x["high"] == y["low"] for x, y in zip(turns, turns[1:], strict=False))
    total |= {"low": min((x["low"] for x in turns), default=None), "high": max((x["high"] for x in turns), default=None)}
    tables = [{(w["p"], w["q"]): (w["cost"], w["audit"]) for w in x["ways"]} for x in parts]
    # cheapest ways from the start to each state, with the states passed between the segments
    here = {START: (0, "", (START,))}
    for table in tables:
        step: dict = {}
        for (p, q), (c, a) in table.items():
            if p in here:
                cost, audit, path = here[p]
                step[q] = min(step.get(q, (1 << 62, "", ())), (cost + c, audit + a, (*path, q)))
        here = step
    cost, audit, path = min(here[q] for q in ENDS if q in here)
    conv_id = parts[0]["conv_id"]
    out = [{"kind": "done", "conv_id": conv_id, "cost": cost, "audit": audit, **total}]
    for x, table, p, q in zip(parts, tables, path, path[1:], strict=False):
        out.append({"kind": "piece", "conv_id": conv_id, "segment": x["segment"], "state": p, "audit": table[p, q][1]})
    return pa.Table.from_pylist(out, _JOINED)


def _sha_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, role, text, deleted, n, audit) in order, each segment's audit first -> (conv_id, sha)."""
    writer, at = None, None

    def result() -> pa.RecordBatch:
        writer.inserts()
        return pa.RecordBatch.from_pydict({"conv_id": pa.array([at], pa.int64()), "sha": [writer.sha.hexdigest()]})

    for batch in batches:
        for conv_id, role, text, deleted, n, audit in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
            if writer is not None and conv_id != at:
                yield result()
                writer = None
            if writer is None:
                writer, at = Writer(), conv_id
            if audit is not None:
                writer.inserts()
                writer.audit, writer.at = audit, 0
            else:
                writer.row(role, text, deleted, n)
    if writer is not None:
        yield result()


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 per conversation with rows.

    `rows` has conv_id, turn, role and text.
    """
    n = partitions(rows.sparkSession)
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    dealt = judged(rows).repartitionByRange(n, *order).sortWithinPartitions(*order)
    segments = stored(dealt.mapInArrow(_segment_batches, _OUT_SQL), "repair-segments")
    opened = segments.filter("kind = 'open'").select("conv_id", "segment", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "head", "tail", "ways")
    joined_ = stored(opened.groupBy("conv_id").applyInArrow(_join_segments, _JOINED_SQL), "repair-joined")
    pieces = joined_.filter("kind = 'piece'")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("deleted", "boolean"), ("n", "long"))]
    stream = pieces.select("conv_id", "segment", F.lit(-1).cast("long").alias("pos"), *nothing, "audit").union(
        segments.filter("kind = 'row'").select("conv_id", "segment", "pos", "role", "text", "deleted", "n", F.lit(None).cast("string").alias("audit"))
    )
    stream = stream.repartition(n, "conv_id").sortWithinPartitions("conv_id", "segment", "pos")
    sha = stream.select("conv_id", "role", "text", "deleted", "n", "audit").mapInArrow(_sha_batches, "conv_id long, sha string")
    own = ["conv_id", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha"]
    split = joined_.filter("kind = 'done'").drop("sha").join(sha.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    out = segments.filter("kind = 'done'").select(own).union(split.select(own))
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(F.lit(0))
    return out.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """`repair` after the test damage: one row for every conv_id of the table, also those that lost all rows."""
    done = repair(damaged(conversations)).withColumnRenamed("conv_id", "c")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(done, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    nothing = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
    return out.fillna({**nothing, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}).select("conv_id", *done.columns[1:])
