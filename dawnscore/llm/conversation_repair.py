"""Conversation structure repair: weighted CYK over spans of turns, minimum (cost, audit) cells.

A sound conversation has the roles (s?(ua)+)?: an optional system turn, then user and assistant in
turn. The grammar is in Chomsky normal form over intervals of the states of that rule: T[p,q] stands
for everything that leads from state p to state q, with the rules T[p,q] -> T[p,r] T[r,q]; a turn is a
terminal that is kept (0), given another role (3) or deleted (4); an unfinished turn that stays costs 3
more; blank and repeated turns have to go. Insertions (3 each) are the closure of the empty span, added
on both sides of every terminal. A cell holds the cheapest (cost, audit) of its span, the audit being
the initials of the edits (K, R, D, I) in order; of equal costs the audit that is least in ASCII wins.

Equal costs over one span never give an audit that begins another (the rest would be insertions, which
cost), so the order of audits survives whatever follows, and every split of a span gives the same cell:
cells are combined bottom-up, spans of one turn, two, four and so on, first inside a task, then in Spark
over what is left of conversations that run through many tasks. Nothing of a conversation's length but
its audit and a block of 64 turns is held at once.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnscore.llm.common import arrow_rows, small_batches, staged

BLOCK = 64                        # turns, later spans, that are combined at a time
# Costs of the edits, and the states of the rule (0 start, 1 after s, 2 after u, 3 after a).
RETITLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
GOALS = (0, 3)
STATES = range(4)
LEGAL = {"su", "ua", "au"}
SPACES = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}

Cells = list[dict[int, tuple[int, str]]]  # [p][q] -> (cost, audit)

_FACTS = ["n", "blank", "duplicate", "truncated", "illegal", "turns"]
_BLOCK_SCHEMA = ("part int, seq long, " + ", ".join(f"{c} long" for c in _FACTS)
                 + ", first string, last string, low long, high long, costs array<long>, audits array<string>")


def joined(x: Cells, y: Cells) -> Cells:
    """T[p,q] -> T[p,r] T[r,q] over two neighbouring spans."""
    out: Cells = []
    for row in x:
        best: dict[int, tuple[int, str]] = {}
        for r, (cost, audit) in row.items():
            for q, (more, rest) in y[r].items():
                total = cost + more
                held = best.get(q)
                if held is None or total < held[0] or total == held[0] and audit + rest < held[1]:
                    best[q] = (total, audit + rest)
        out.append(best)
    return out


@cache
def inserted() -> Cells:
    """The empty span: nothing, or insertions of user and assistant turns."""
    cells: Cells = [{p: (0, "")} for p in STATES]
    step: Cells = [{p: (0, "")} for p in STATES]
    for role in NAMES:
        for p, q in MOVES[role].items():
            step[p][q] = (INSERT, "I")
    for _ in STATES:
        cells = joined(cells, step)
    return cells


@cache
def terminal(initial: str, unfinished: bool, must_go: bool) -> Cells:
    """One turn with insertions on both sides."""
    cells: Cells = [{p: (DELETE, "D")} for p in STATES]
    if not must_go:
        extra = UNFINISHED if unfinished else 0
        edits = [(role, RETITLE + extra, "R") for role in NAMES] + [(initial, extra, "K")]
        for role, cost, letter in edits:
            for p, q in MOVES.get(role, {}).items():
                cells[p][q] = min(cells[p].get(q, (cost, letter)), (cost, letter))
    return joined(joined(inserted(), cells), inserted())


def combined(spans: list[Cells]) -> Cells:
    """Neighbouring spans, bottom-up by length."""
    while len(spans) > 1:
        spans = [joined(*spans[k:k + 2]) if k + 1 < len(spans) else spans[k] for k in range(0, len(spans), 2)]
    return spans[0]


def cheapest(cells: Cells) -> tuple[int, str]:
    return min(cells[0][q] for q in GOALS if q in cells[0])


def _flat(cells: Cells) -> tuple[list, list]:
    every = [row.get(q, (None, None)) for row in cells for q in STATES]
    return [x[0] for x in every], [x[1] for x in every]


def _cells(costs: list, audits: list) -> Cells:
    return [{q: (costs[4 * p + q], audits[4 * p + q]) for q in STATES if costs[4 * p + q] is not None} for p in STATES]


class _Span:
    """Facts and cells of a stretch of neighbouring turns of one conversation."""

    def __init__(self, facts: list[int], first: str, last: str, low: int | None, high: int | None, cells: Cells):
        self.facts, self.first, self.last, self.low, self.high, self.cells = facts, first, last, low, high, cells

    @classmethod
    def of_turn(cls, turn: int | None, initial: str, blank: bool, again: bool, unfinished: bool) -> _Span:
        again, unfinished = again and not blank, unfinished and not blank and not again
        return cls([1, blank, again, unfinished, 0, turn is not None], initial, initial, turn, turn,
                   terminal(initial if initial in MOVES else "", unfinished, blank or again))

    @classmethod
    def of(cls, spans: list[_Span]) -> _Span:
        facts = [sum(column) for column in zip(*(s.facts for s in spans), strict=True)]
        highest = None
        for k, span in enumerate(spans):
            facts[4] += k > 0 and spans[k - 1].last + span.first not in LEGAL
            facts[5] -= highest is not None and span.low == highest   # a turn number on both sides counts once
            highest = span.high if span.high is not None else highest
        lows = [s.low for s in spans if s.low is not None]
        return cls(facts, spans[0].first, spans[-1].last, lows[0] if lows else None, highest,
                   combined([s.cells for s in spans]))

    def row(self) -> list:
        return [*map(int, self.facts), self.first, self.last, self.low, self.high, *_flat(self.cells)]


def _place(turn: str) -> list[Column]:
    """Order of turns, null ones first; turns with the same number by role, then by a digest of the text."""
    return [F.col(turn).asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def _prepared(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text (null: one space), digest."""
    arrow_rows(turns.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(" "))
    return turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"),
                        F.unhex(F.md5(text)).alias("digest"))


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(df.schema)


def _spans(rows: DataFrame) -> DataFrame:
    """Blocks of up to BLOCK neighbouring turns, with the task and number that give their order."""
    kept = F.rtrim(F.col("text"), F.lit(SPACES))
    facts = rows.select("conv", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"),
                        (kept == "").alias("blank"), (~F.substring(kept, -1, 1).isin(".", "!", "?")).alias("open"))
    seen = (facts.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
            .agg(F.count("*").alias("k"), F.min("turn").alias("earliest"), F.bool_or(F.col("turn").isNull()).alias("null_first"))
            .filter("k > 1"))
    on = facts["conv"].eqNullSafe(seen["c"]) & (facts["role"] == seen["r"]) & (facts["digest"] == seen["d"])
    # later than the first of its kind; those with the same turn number stand side by side and are told apart below
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("null_first") | (F.col("turn") > F.col("earliest"))), F.lit(False))
    marked = facts.join(seen, on, "left").select("conv", "turn", "role", "digest", "initial", "blank", "open", later.alias("later"))
    ordered = (marked.repartitionByRange(F.col("conv").asc_nulls_first(), *_place("turn"))
               .sortWithinPartitions(F.col("conv").asc_nulls_first(), *_place("turn")))
    conv = rows.schema["conv"]
    schema = f"conv {conv.dataType.simpleString()}, {_BLOCK_SCHEMA}"
    arrow = _arrow(rows.sparkSession.createDataFrame([], schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        spans: list[_Span] = []
        out: list[list] = []
        current, seq, before = object(), 0, None

        def closed() -> None:
            if spans:
                out.append([current, part, seq, *_Span.of(spans).row()])
                spans.clear()
        for batch in batches:
            for conv, turn, role, digest, initial, blank, unfinished, later in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != current or type(conv) is not type(current):
                    closed()
                    current, seq, before = conv, 0, None
                elif len(spans) == BLOCK:
                    closed()
                    seq += 1
                spans.append(_Span.of_turn(turn, initial, blank, later or before == (turn, role, digest), unfinished))
                before = (turn, role, digest)
            if out:
                yield _batch(list(zip(*out, strict=True)), arrow)
                out.clear()
        closed()
        if out:
            yield _batch(list(zip(*out, strict=True)), arrow)
    return staged(ordered.mapInArrow(run, schema), "turn-spans")


def _merged(spans: DataFrame, part: Column, seq: Column) -> DataFrame:
    """One span for the up to BLOCK spans that get the same part and seq."""
    names = [c for c in spans.columns if c != "conv"]
    grouped = (spans.groupBy("conv", part.alias("new_part"), seq.alias("new_seq"))
               .agg(F.sort_array(F.collect_list(F.struct(*names))).alias("spans")))
    arrow = _arrow(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "spans"):
            out = []
            for conv, part, seq, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = _Span.of([_Span([s[c] for c in _FACTS], s["first"], s["last"], s["low"], s["high"],
                                        _cells(s["costs"], s["audits"])) for s in found])
                out.append([conv, part, seq, *whole.row()])
            if out:
                yield _batch(list(zip(*out, strict=True)), arrow)
    return staged(grouped.mapInArrow(run, spans.schema), "turn-spans")


def verdicts(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row per conversation of turns.

    turns: conv_id, turn, role, text, in any order; other columns are not read. Null roles and texts are
    one space; a null conv_id is a conversation of its own; null turns come first. Turns that share a
    number stand in the order of role and text digest. A turn counts by its first fault: blank, repeated
    (role and text seen earlier in the conversation), unfinished (the last character that is no space is
    not one of . ! ?). A role that begins with none of s, u, a (an empty one too) cannot be kept. An empty
    table gives no rows.
    """
    spans = _spans(_prepared(turns))
    while True:
        state = spans.groupBy("conv").agg(F.count("*").alias("n"), F.max("seq").alias("s")).agg(
            F.max("n").alias("n"), F.max("s").alias("s")).first()
        if (state.n or 0) <= 1:
            break
        if state.s:     # first what lies in one task, then across tasks
            spans = _merged(spans, F.col("part"), F.expr(f"seq div {BLOCK}"))
        else:
            spans = _merged(spans, F.expr(f"cast(part div {BLOCK} as int)"), F.lit(0).cast("long"))
    arrow_names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    schema = f"conv_id {spans.schema['conv'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    arrow = _arrow(spans.sparkSession.createDataFrame([], schema))
    columns = ["conv", "low", "high", *_FACTS, "costs", "audits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in arrow_names]
            for conv, low, high, _, blank, again, unfinished, illegal, numbers, costs, audits in zip(
                    *(c.to_pylist() for c in batch.columns), strict=True):
                gaps = 0 if low is None else high - low + 1 - numbers
                for column, value in zip(out, [conv, gaps, blank, again, unfinished, illegal, *cheapest(_cells(costs, audits))], strict=True):
                    column.append(value)
            yield _batch(out, arrow)
    return spans.select(*columns).mapInArrow(run, schema)


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role, text: the turns of every repaired conversation, in order inside
    each partition. found: what verdicts() returned for the same turns. Conversations that are deleted
    whole have no rows.
    """
    rows = _prepared(turns)
    edits = found.select(F.col("conv_id").alias("conv"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
                         F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(b"").alias("digest"))
    both = edits.unionByName(rows.withColumn("kind", F.lit(1))).select("conv", "kind", "turn", "role", "digest", "text")
    ordered = both.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "kind", *_place("turn")).select(
        "conv", "kind", "role", "text")
    schema = f"conv_id {rows.schema['conv'].dataType.simpleString()}, place long, edit string, role string, text string"
    arrow = _arrow(rows.sparkSession.createDataFrame([], schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place = "", 0, 0, 0
        current = None
        for batch in small_batches(batches):
            out: list[list] = [[] for _ in range(5)]

            def emit(edit: str, role: str, text: str) -> None:
                nonlocal state, place
                for column, value in zip(out, [current, place, edit, role, text], strict=True):  # noqa: B023
                    column.append(value)
                state, place = MOVES[role[0]][state], place + 1

            def insertions() -> None:
                nonlocal at
                while audit[at:at + 1] == "I":
                    emit("I", NAMES["a" if state == 2 else "u"], "")  # noqa: B023
                    at += 1
            for conv, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    current, audit, at, state, place = conv, text, 0, 0, 0
                    insertions()
                    continue
                edit = audit[at]
                at += 1
                if edit != "D":
                    emit(edit, role if edit == "K" else NAMES["a" if state == 2 else "u"], text)
                insertions()
            yield _batch(out, arrow)
    return ordered.mapInArrow(run, schema)


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the lines role:text of what repaired() returned, from its own order."""
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    arrow = _arrow(rows.sparkSession.createDataFrame([], schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, None
        for batch in batches:
            out: list[list] = [[], []]
            for conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    if state:
                        out[0].append(current)
                        out[1].append(state.hexdigest())
                    current, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield _batch(out, arrow)
        if state:
            yield _batch([[current], [state.hexdigest()]], arrow)
    return rows.select("conv_id", "place", "role", "text").mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the faults of the check: a hash of conv_id and turn drops a turn,
    empties it, takes its sentence marks, repeats it or makes it a user's."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(F.encode(key, "UTF-8")) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    role = F.coalesce(F.col("role"), F.lit(" "))
    faulty = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).filter("fault <> 0")
    return faulty.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.expr("array_repeat(1, if(fault = 3, 2, 1))")).alias("_copy")).drop("_copy")


def repair_report(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of conversations: verdict on its damaged turns and the digest of their repair.

    Conversations without a turn after the damage have zeros, an empty audit and the digest of nothing.
    """
    turns = damaged(conversations)
    found = staged(verdicts(turns), "turn-verdicts")
    sha = digests(repaired(turns, found))
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    out = (every.join(found, every["id"].eqNullSafe(found["conv_id"]), "left").drop("conv_id")
           .join(sha, F.col("id").eqNullSafe(sha["conv_id"]), "left"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(F.col("id").alias("conv_id"), *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
