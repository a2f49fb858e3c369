"""Operator 12: repair the structure of conversations with the cheapest edits, found by iterative-deepening A*."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.shared import in_batches, settled

# What edits cost, and the white space and sentence ends that tell faults.
DELETE, INSERT, KEEP, REROLE, UNFINISHED = 2, 5, 0, 1, 5
SPACE, SENTENCE_END = " \t\n\x0b\x0c\r", ".!?"

#: A row to the search is one letter: 3 times its class (the place in CLASSES, another role: 3) plus 0 as it is, 1 to be deleted,
#: 2 unfinished.
CLASSES = "sua"
LETTERS = "ABCDEFGHIJKL"
#: The automaton of `(s?(ua)+)?`: at the start, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
#: Where a turn of a class leads from each state, and what has to come next where a user's or an assistant's turn is put.
STEP = ({0: SYSTEM, 1: USER}, {1: USER}, {2: ASSISTANT}, {1: USER})
NEXT = ((1, USER), (1, USER), (2, ASSISTANT), (1, USER))
#: Rows of a conversation that travel together are 2**PIECE_BITS at most.
PIECE_BITS = 6


def least_rest(rows: bytes) -> array:
    """For every row, what it and all later ones cost at least, in whichever state the automaton is: never too much."""
    least = array("q", bytes(8 * (len(rows) + 1)))
    after = [0 if state in FINAL else None for state in range(4)]
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            kind, fault = divmod(rows[i] - ord("A"), 3)
            late, now = UNFINISHED * (fault == 2), []
            for state in range(4):
                own = DELETE + after[state]
                if fault != 1:
                    own = min(own, REROLE + late + after[NEXT[state][1]])
                    if kind in STEP[state]:
                        own = min(own, KEEP + late + after[STEP[state][kind]])
                now.append(own)
            after = now
        for state in (ASSISTANT, USER, SYSTEM, START, ASSISTANT):  # turns put in before row i
            put = after[NEXT[state][1]]
            if put is not None and (after[state] is None or put + INSERT < after[state]):
                after[state] = put + INSERT
        least[i] = min(after)
    return least


def cheapest(rows: bytes) -> tuple[int, str]:
    """Cost and edits (D, I, K, R) of the cheapest repair; of equally cheap ones the first in ASCII order.

    Depth first in ASCII order, under a bound that rises until a path is accepted; the first path accepted is the answer. A state
    (row, automaton) that has failed with as much left to spend is not entered again, within a bound or under a later one."""
    n, least, failed = len(rows), least_rest(rows), {}
    bound = least[0]

    def moves(i: int, state: int):
        if i < n:
            kind, fault = divmod(rows[i] - ord("A"), 3)
            late = UNFINISHED * (fault == 2)
            yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, NEXT[state][1]
        if i < n and fault != 1:
            if kind in STEP[state]:
                yield "K", KEEP + late, i + 1, STEP[state][kind]
            yield "R", REROLE + late, i + 1, NEXT[state][1]

    while True:
        path, stack = [], [(0, START, 0, moves(0, START))]
        while stack:
            i, state, spent, rest = stack[-1]
            if i == n and state in FINAL:
                return spent, "".join(path)
            for edit, cost, j, following in rest:
                left = bound - spent - cost
                if least[j] <= left and failed.get((j, following), -1) < left:
                    path.append(edit)
                    stack.append((j, following, spent + cost, moves(j, following)))
                    break
            else:
                failed[i, state] = bound - spent
                stack.pop()
                if path:
                    path.pop()
        bound += 1


def told(rows: bytes, edits: str) -> list[str]:
    """What the edits do at each row: turns put before it (u, a), then `-` deleted, `=` kept, `U` or `A` given that role; after the
    last row also turns put behind it."""
    out, before, state = [], "", START
    for edit in edits:
        if edit == "I":
            kind, state = NEXT[state]
            before += CLASSES[kind]
            continue
        if edit == "D":
            mark = "-"
        elif edit == "K":
            mark, state = "=", STEP[state][(rows[len(out)] - ord("A")) // 3]
        else:
            kind, state = NEXT[state]
            mark = CLASSES[kind].upper()
        out.append(before + mark)
        before = ""
    if before:
        out[-1] += before
    return out


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs, audits, illegal, edits = [], [], [], []
        for pieces in batch.column(1).to_pylist():
            rows = "".join(pieces).encode()
            cost, audit = cheapest(rows)
            kinds = [(letter - ord("A")) // 3 for letter in rows]
            marks, at, parts = told(rows, audit), 0, []
            for piece in pieces:
                parts.append(",".join(marks[at:at + len(piece)]))
                at += len(piece)
            costs.append(cost)
            audits.append(audit)
            illegal.append(sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(kinds, kinds[1:])))
            edits.append(parts)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.large_string()).cast(pa.string()),
                                          pa.array(illegal, pa.int64()), pa.array(edits, pa.list_(pa.string()))],
                                         ["conv_id", "cost", "audit", "illegal", "edits"])


class Repair(NamedTuple):
    """`report`: one row per conversation. `turns`: the repaired turns (conv_id, piece, pos, part, role, text), in this order."""

    report: DataFrame
    turns: DataFrame


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with `pos`, ascending within a conversation: by turn (null first), role, a digest of role and
    text. Conversations are dealt by ranges of that order, so that a long one is spread over tasks."""
    digest = F.md5(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")))
    keyed = rows.select("conv_id", "turn", "role", "text", digest.alias("digest"), F.monotonically_increasing_id().alias("n"))
    order = ["conv_id", "turn", "role", "digest", "n"]
    return settled(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()).drop("n"))


def repair(rows: DataFrame) -> Repair:
    """The cheapest repair of every conversation in `rows` (conv_id, turn, role, text).

    A row's first fault counts: blank (nothing but ASCII white space), duplicate (an earlier row of the conversation has its role
    and text), truncated (its last other character ends no sentence). Edits: keep (0), rerole to user or assistant (1), delete
    (2; blank and duplicate rows have to go), insert a user's or an assistant's turn with empty text (5); truncated rows that stay
    cost 5 more. The initials of the roles are then `(s?(ua)+)?`; of equally cheap repairs the first in ASCII order of their
    edits' initials counts.

    `report` has conv_id, gaps (turns missing between the first and the last), blank, duplicate, truncated, illegal (neighbours
    whose initials are not su, ua, au), cost, audit (the edits). Null roles and texts are one space. Rows are in order of turn,
    null first, then role, then a digest; repeated rows are duplicates. A role without characters has no initial: it is reroled or
    deleted. Rows without id are one conversation. An empty table gives empty tables; further columns are ignored.

    What is searched is a letter per row: texts stay where they are, and those of a long conversation are spread over tasks. The
    search holds some hundred bytes per row of one conversation."""
    rows = ordered(rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]))
    first = rows.groupBy("conv_id", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("times")).filter("times > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    fault = (F.when(last == "", 1).when(F.col("first") < F.col("pos"), 1).when(F.instr(F.lit(SENTENCE_END), last) == 0, 2).otherwise(0))
    kind = F.instr(F.lit(CLASSES), F.substring("role", 1, 1))
    kind = F.when((F.col("role") == "") | (kind == 0), 3).otherwise(kind - 1)
    judged = rows.join(first, rows["conv_id"].eqNullSafe(first["c"]) & (rows["digest"] == first["d"]), "left").select(
        "conv_id", "turn", "pos", F.shiftright("pos", PIECE_BITS).alias("piece"), (last == "").alias("blank"), fault.alias("fault"),
        F.substring(F.lit(LETTERS), kind * 3 + fault + 1, F.lit(1)).alias("letter"))
    number = lambda when: F.sum(when.cast("long"))
    pieces = judged.groupBy("conv_id", "piece").agg(
        F.min("pos").alias("begin"), F.sort_array(F.collect_list(F.struct("pos", "letter"))).alias("letters"),
        number(F.col("blank")).alias("blank"), number((F.col("fault") == 1) & ~F.col("blank")).alias("duplicate"),
        number(F.col("fault") == 2).alias("truncated"))
    pieces = pieces.withColumn("letters", F.array_join(F.transform("letters", lambda x: x["letter"]), ""))
    whole = pieces.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("piece", "begin", "letters"))).alias("pieces"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    whole = settled(whole)
    searched = settled(in_batches(whole.select("conv_id", F.transform("pieces", lambda p: p["letters"]).alias("rows"))).mapInArrow(
        _searched, f"conv_id {whole.schema['conv_id'].dataType.simpleString()}, cost long, audit string, illegal long, edits array<string>"))
    turns_held = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))

    def same(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnRenamed("conv_id", "c")
        return a.join(b, a["conv_id"].eqNullSafe(b["c"])).drop("c")

    both = same(whole, searched)
    report = same(both, turns_held).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    marks = both.select("conv_id", F.explode(F.arrays_zip("pieces", "edits")).alias("e")).select(
        F.col("conv_id").alias("c"), F.col("e.pieces.piece").alias("p"), F.col("e.pieces.begin").alias("begin"), F.split("e.edits", ",").alias("marks"))
    rows = rows.withColumn("piece", F.shiftright("pos", PIECE_BITS))
    mark = F.get("marks", (F.col("pos") - F.col("begin")).cast("int"))
    edited = rows.join(marks, rows["conv_id"].eqNullSafe(marks["c"]) & (rows["piece"] == marks["p"])).select(
        "conv_id", "piece", "pos", "role", "text", F.posexplode(F.split(mark, "")).alias("part", "mark"))

    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), text.alias("text"))

    result = (F.when(F.col("mark") == "=", turn(F.col("role"), F.col("text")))
              .when(F.col("mark") == "U", turn(F.lit("user"), F.col("text"))).when(F.col("mark") == "A", turn(F.lit("assistant"), F.col("text")))
              .when(F.col("mark") == "u", turn(F.lit("user"), F.lit(""))).when(F.col("mark") == "a", turn(F.lit("assistant"), F.lit(""))))
    turns = edited.select("conv_id", "piece", "pos", "part", result.alias("t")).filter("t IS NOT NULL").select("conv_id", "piece", "pos", "part", "t.*")
    return Repair(report, turns)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, kind, ids, digests = None, None, [], []
    for batch in batches:
        kind = batch.column(0).type
        for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and held[0] == conv:
                held[1].update(b"\n")
            else:
                if held:
                    ids.append(held[0])
                    digests.append(held[1].hexdigest())
                held = conv, hashlib.sha256()
            held[1].update(text.encode())
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([*ids, held[0]], kind), pa.array([*digests, held[1].hexdigest()])], ["conv_id", "repaired_sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the conversations in `turns` (see Repair): SHA-256 of `role:text` lines joined by line feeds.
    The lines of a piece are joined where the piece is; a conversation's pieces stream through one task, which holds the hash."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", "part", "role", "text"))), lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    pieces = turns.groupBy("conv_id", "piece").agg(F.array_join(lines, "\n").alias("lines"))
    streams = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "lines")
    return in_batches(streams).mapInArrow(_hashed, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text; nulls: one space) with faults chosen by crc32(`conv_id:turn`) modulo 20: 0 drops a row, 1 empties
    its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    harm = (F.crc32(key.cast("binary")) % 20).alias("harm")
    rows = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], harm).filter("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("harm") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(times).alias("copy")).drop("copy")
