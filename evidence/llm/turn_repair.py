"""Repair of conversations: the cheapest edits that give roles the grammar (s?(ua)+)?, found by a recursive query.

Turns are damaged, put in order and judged; then DuckDB walks a hash-partitioned batch of conversations: each recursion
advances one turn of all of them and keeps, for each state of the grammar, the least cost and of the audits with that cost
the least. Two audits of one cost and state are never prefixes of each other (an insertion costs, and every other edit uses
up a turn), so keeping the least one loses nothing.

A conversation of more than SEGMENT turns is cut: its rows are dealt by range of their order, so that many tasks share it,
each task walks its segments from every state, and one pass over the segments of a conversation joins what they cost from
state to state. That pass streams; it holds an audit and a running digest for each state, not the turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from evidence.llm.common import batch_of, bounded_batches, materialise, rows, small
from evidence.workers import on_workers

#: Turns of a conversation that are walked at once, and turns of a batch.
SEGMENT, BATCH = 256, 8192
SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, OPEN = 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role leads from each state; others are not allowed there.
_NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What may be put in or made of a turn in each state, and where it leads.
_WANTED = {START: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER), USER: ("assistant", ASSISTANT)}
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ORDER = ("known", "cid", "turn", "role", "h", "text")
_ARROW = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _moves() -> list[tuple[int, str, int, str, int]]:
    """(state, letters, cost, initial that a kept turn must have or D or R, state after): insertions, then the turn's own edit.

    A third insertion in one place leads where one insertion does.
    """
    out = []
    for state in _WANTED:
        at, letters = state, ""
        for _ in range(3):
            cost = INSERT * len(letters)
            out += [(state, letters + "D", cost + DELETE, "D", at), (state, letters + "R", cost + 1, "R", _WANTED[at][1])]
            out += [(state, letters + "K", cost, role, leads[at]) for role, leads in _NEXT.items() if at in leads]
            at, letters = _WANTED[at][1], letters + "I"
    return out


_WALK = f"""WITH RECURSIVE walk AS (
  SELECT seg, start, 0 AS pos, start AS state, 0::BIGINT AS cost, '' AS audit FROM starts
  UNION ALL
  SELECT seg, start, pos + 1, state, best.cost, best.audit FROM (
    SELECT w.seg, w.start, w.pos, m.after AS state, min({{'cost': w.cost + m.cost + CASE WHEN t.open AND m.needs <> 'D' THEN {OPEN} ELSE 0 END, 'audit': w.audit || m.letters}}) AS best
    FROM walk w JOIN turns t ON t.seg = w.seg AND t.pos = w.pos JOIN moves m ON m.state = w.state AND (m.needs = 'D' OR NOT t.must AND (m.needs = 'R' OR m.needs = t.initial))
    GROUP BY ALL))
SELECT w.seg, w.start, w.state, w.cost, w.audit FROM walk w JOIN lengths n ON n.seg = w.seg AND n.turns = w.pos"""


@dataclass
class Segment:
    """Neighbouring turns of a conversation, judged: roles, texts, what each must bear, and counts."""

    conv: tuple
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    must: list[bool] = field(default_factory=list)
    open: list[bool] = field(default_factory=list)
    faults: list[int] = field(default_factory=lambda: [0, 0, 0])
    turns: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=list)

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        bare = text.rstrip(SPACE)
        fault = 0 if not bare else 1 if seen else 2 if bare[-1] not in ".!?" else None
        if fault is not None:
            self.faults[fault] += 1
        self.roles.append(role)
        self.texts.append(text)
        self.must.append(fault in (0, 1))
        self.open.append(fault == 2)
        if turn is not None and self.ends[1:] != [turn]:
            self.turns[0] += 1
            self.ends = [self.ends[0] if self.ends else turn, turn]

    def illegal(self) -> int:
        return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(self.roles, self.roles[1:], strict=False))

    def lines(self, audit: str, state: int) -> Iterator[str]:
        """The repaired turns that an audit from a state leaves; letters beyond the turns are insertions at the end."""
        at = 0
        for letter in audit:
            if letter == "I":
                role, state = _WANTED[state]
                yield f"{role}:"
                continue
            if letter == "R":
                role, state = _WANTED[state]
                yield f"{role}:{self.texts[at]}"
            elif letter == "K":
                state = _NEXT[self.roles[at][:1]][state]
                yield f"{self.roles[at]}:{self.texts[at]}"
            at += 1


def _connect() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    con.execute("CREATE TABLE moves (state INT, letters VARCHAR, cost INT, needs VARCHAR, after INT)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", _moves())
    return con


def walk(con: duckdb.DuckDBPyConnection, segments: list[Segment], starts: tuple[int, ...]) -> list[dict[tuple[int, int], tuple[int, str]]]:
    """For each segment, from each start to each state after it: least cost, and the least audit of that cost."""
    of = [(k, p) for k, s in enumerate(segments) for p in range(len(s.roles))]
    turns = pa.table({
        "seg": pa.array([k for k, _ in of], pa.int32()), "pos": pa.array([p for _, p in of], pa.int32()), "initial": pa.array([segments[k].roles[p][:1] for k, p in of], pa.string()),
        "must": pa.array([segments[k].must[p] for k, p in of], pa.bool_()), "open": pa.array([segments[k].open[p] for k, p in of], pa.bool_()),
    })
    numbers = range(len(segments))
    tables = {"turns": turns, "lengths": pa.table({"seg": pa.array(numbers, pa.int32()), "turns": pa.array([len(s.roles) for s in segments], pa.int32())}),
              "starts": pa.table({"seg": pa.array([k for k in numbers for _ in starts], pa.int32()), "start": pa.array([s for _ in numbers for s in starts], pa.int32())})}
    for name, t in tables.items():
        con.register(name, t)
    out: list[dict] = [{} for _ in segments]
    for seg, start, state, cost, audit in con.execute(_WALK).fetchall():
        out[seg][start, state] = (cost, audit)
    for name in tables:
        con.unregister(name)
    return out


def _ended(state: int, cost: int, audit: str) -> tuple[int, str]:
    """With the insertions that lead to an end: none at the start or after an assistant, else one or two."""
    more = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}[state]
    return cost + INSERT * len(more), audit + more


def _whole(con: duckdb.DuckDBPyConnection, held: list[Segment]) -> pa.RecordBatch:
    """The results of whole conversations."""
    out = []
    for s, reached in zip(held, walk(con, held, (START,)), strict=True):
        cost, audit = min(_ended(state, *found) for (_, state), found in reached.items())
        text = "\n".join(s.lines(audit, START))
        gaps = s.ends[1] - s.ends[0] + 1 - s.turns[0] if s.ends else 0
        out.append((s.conv[1], gaps, *s.faults, s.illegal(), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return batch_of(out, _ARROW)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (known, conv_id, turn, role, text, times) in order, conversations of at most SEGMENT turns each."""
    con, held, seen, size = _connect(), [], set(), 0
    for part in rows(batches):
        for known, conv, turn, role, text, times in part:
            if not held or held[-1].conv != (known, conv):
                if size >= BATCH:
                    yield _whole(con, held)
                    held, size = [], 0
                held.append(Segment((known, conv)))
                seen = set()
            for _ in range(times):
                held[-1].add(turn, role, text, (role, text) in seen)
                seen.add((role, text))
            size += 1 + times
    if held:
        yield _whole(con, held)


_CUT = "known boolean, cid long, part int, seq long, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, turns long, ends array<long>, reached array<struct<start: int, state: int, cost: long, audit: string>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (known, conv_id, turn, role, text, times, first) in order, of long conversations, as segments from every state."""
    con, number = _connect(), TaskContext.get().partitionId()
    schema = pa.schema([("known", pa.bool_()), ("cid", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
                        *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns")), ("ends", pa.list_(pa.int64())),
                        ("reached", pa.list_(pa.struct([("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
    held: list[Segment] = []
    seq = 0

    def done() -> pa.RecordBatch:
        out = []
        for k, (s, reached) in enumerate(zip(held, walk(con, held, tuple(_WANTED)), strict=True)):
            told = [{"start": a, "state": b, "cost": cost, "audit": audit} for (a, b), (cost, audit) in sorted(reached.items())]
            out.append((*s.conv, number, seq + k, s.roles, s.texts, *s.faults, s.illegal(), s.turns[0], s.ends, told))
        return batch_of(out, schema)

    for part in rows(batches):
        for known, conv, turn, role, text, times, first in part:
            for copy in range(times):
                if not held or held[-1].conv != (known, conv) or len(held[-1].roles) == SEGMENT:
                    if len(held) >= BATCH // SEGMENT:
                        yield done()
                        held, seq = [], seq + len(held)
                    held.append(Segment((known, conv)))
                held[-1].add(turn, role, text, copy > 0 or not first)
    if held:
        yield done()


class _Joined:
    """The segments of one conversation so far: for each state, cost, audit and the digest of the repaired text."""

    def __init__(self, known: bool, cid: int):
        self.conv = cid if known else None
        self.reached: dict[int, tuple[int, str, object, bool]] = {START: (0, "", hashlib.sha256(), False)}
        self.counts, self.turns, self.ends, self.last = [0] * 4, 0, [], None

    def add(self, roles: list[str], texts: list[str], counts: list[int], turns: int, ends: list[int], reached: list[dict]) -> None:
        if self.last is not None:
            self.counts[3] += self.last[:1] + roles[0][:1] not in ("su", "ua", "au")
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        self.turns += turns - (bool(ends) and self.ends[1:] == ends[:1])
        self.ends = [(self.ends or ends)[0], ends[1]] if ends else self.ends
        self.last = roles[-1]
        best: dict[int, tuple] = {}
        for r in reached:
            if r["start"] in self.reached:
                cost, audit, *_ = self.reached[r["start"]]
                found = (cost + r["cost"], audit + r["audit"], r["start"], r["audit"])
                best[r["state"]] = min(best.get(r["state"], found), found)
        own = Segment((), roles, texts)
        after = {}
        for state, (cost, audit, start, letters) in best.items():
            digest, begun = self.reached[start][2].copy(), self.reached[start][3]
            for line in own.lines(letters, start):
                digest.update(("\n" * begun + line).encode())
                begun = True
            after[state] = (cost, audit, digest, begun)
        self.reached = after

    def result(self) -> tuple:
        _, state = min((_ended(state, cost, audit), state) for state, (cost, audit, *_) in self.reached.items())
        cost, audit, digest, begun = self.reached[state]
        cost, whole = _ended(state, cost, audit)
        for line in Segment(()).lines(whole[len(audit) :], state):
            digest.update(("\n" * begun + line).encode())
            begun = True
        gaps = self.ends[1] - self.ends[0] + 1 - self.turns if self.ends else 0
        return (self.conv, gaps, *self.counts, cost, whole, digest.hexdigest())


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order (columns of _CUT) to results."""
    held, key = None, None
    for batch in batches:
        for at in range(batch.num_rows):
            known, cid, _, _, roles, texts, *counts, turns, ends, reached = (c[at].as_py() for c in batch.columns)
            if key != (known, cid):
                if held:
                    yield batch_of([held.result()], _ARROW)
                held, key = _Joined(known, cid), (known, cid)
            held.add(roles, texts, counts, turns, ends, reached)
    if held:
        yield batch_of([held.result()], _ARROW)


def damaged(conversations: DataFrame) -> DataFrame:
    """known, cid, conv_id, turn, role, text, times: rows as they are after the damage; times is 0 for a dropped row.

    A null role or text is one space, and so is a null conv_id or turn where the damage is dealt.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    return conversations.select(
        F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("cid"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(named("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )


def _long(turns: DataFrame) -> DataFrame:
    """Results of long conversations. Copies of a row are counted, not carried; a text seen earlier is told by an aggregate."""
    own = turns.where("times > 0").groupBy("known", "cid", "turn", "role", "text").agg(F.sum("times").alias("times"))
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    firsts = own.groupBy("known", "cid", "role", "text").agg(F.min(place).alias("least"))
    marked = own.join(firsts, ["known", "cid", "role", "text"]).withColumn("first", F.col("least").eqNullSafe(place)).withColumn("h", F.xxhash64("text"))
    dealt = marked.repartitionByRange(*_ORDER[:-1]).sortWithinPartitions(*_ORDER)
    segments = materialise(dealt.select("known", "cid", "turn", "role", "text", "times", "first").mapInArrow(_cut, _CUT))
    return segments.repartition("known", "cid").sortWithinPartitions("known", "cid", "part", "seq").mapInArrow(_join, OUT)


def turn_repair(conversations: DataFrame) -> DataFrame:
    """Damage, judge and repair every conversation: one row for each conv_id, null being one too.

    conversations: conv_id, turn, role, text; other columns are left alone. Turns are in order of turn, nulls first; rows of
    one turn in order of role, then of a hash of the text. Rows that repeat are turns of their own. An initial is a role's
    first character, whatever the role. A conversation without rows after the damage has zeros, an empty audit and the digest
    of the empty string. An empty table gives no rows.
    """
    spark = conversations.sparkSession
    on_workers(spark)
    bounded_batches(spark)
    turns = damaged(conversations)
    counted = turns.groupBy("known", "cid").agg(F.sum("times").alias("n")).where(F.col("n") > SEGMENT).select("known", "cid")
    many = materialise(counted)
    n = many.count()
    few = turns.join(small(many, n), ["known", "cid"], "left_anti") if n else turns
    ordered = few.withColumn("h", F.xxhash64("text")).repartition("known", "cid").sortWithinPartitions(*_ORDER)
    repaired = ordered.select("known", "conv_id", "turn", "role", "text", "times").mapInArrow(_repair, OUT)
    return repaired.unionByName(_long(turns.join(small(many, n), ["known", "cid"], "left_semi"))) if n else repaired
