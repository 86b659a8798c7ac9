"""Conversations repaired into an optional system turn and then turns of user and assistant, by the cheapest edits.

A conversation's rows stand in the order of turn (nulls first), role and text. A row's fault is the first of: blank (no byte other than 0x20
and 0x09-0x0D), duplicate (its role and text stood in an earlier row), truncated (the last such byte is not one of . ! ?). Edits: keep a row
(0), give it the role user or assistant (3), delete it (4; a blank or duplicate row must go), insert an empty turn of user or assistant (3); a
truncated row that stays costs 3 more. The initials of the roles must then be (s?(ua)+)?. Of the cheapest ways the one whose audit, the
initials K, R, D, I of its edits in order, is the least as ASCII is taken.

The grammar has four states: nothing yet, after s, after u, after a; a letter leads from a state to one state at most, so the audit tells what
every edit does. Forward Viterbi: each row turns the best (cost, audit) of the states into the next ones, and closes them by at most two insertions (a
third would lead back). Rows are dealt out by ranges of their order, so a conversation of any length is spread: what a stretch of at most STRETCH rows does
is a table of (from, to) -> (cost, audit), found without knowing the state it begins in, and the tables of a conversation are composed in order. Two audits
of one cost between the same states are never prefixes of each other (a longer one would hold an insertion more), so the least part gives the least whole.

Cases: null role and text are one space, so a null text is blank; a null conv_id is a conversation, a null turn comes first; rows that are wholly the same are
duplicates of the first of them; a role is known by its first character, whatever follows; an unknown or empty one needs a new role; an empty
table gives an empty one; extra columns are not read. A conversation whose rows all go is empty, which the grammar allows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing, after s, after u, after a. What a new or changed turn is called in a state, and where it leads.
NOTHING, S, USER, ASSISTANT = range(4)
NEXT = {NOTHING: {"s": S, "u": USER}, S: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
TURN = {NOTHING: "user", S: "user", USER: "assistant", ASSISTANT: "user"}
ACCEPTING = (NOTHING, ASSISTANT)
#: Rows of one table.
STRETCH = 2048
LEGAL = ("su", "ua", "au")
WHITE = " \t\n\x0b\x0c\r"
_ONE = "conv_id {t}, n bigint, first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"

Layer = list  # the best (cost, audit) by state, None where the state is not reached


def closed(layer: Layer) -> Layer:
    """The layer with what insertions lead to: one to a user's turn, and one from there to an assistant's."""
    out = list(layer)
    for state in (NOTHING, S, ASSISTANT, USER):
        if out[state] is not None:
            to, way = NEXT[state][TURN[state][0]], (out[state][0] + INSERT, out[state][1] + "I")
            if out[to] is None or way < out[to]:
                out[to] = way
    return out


def stepped(layer: Layer, initial: str, fault: str) -> Layer:
    """The closed layer after one more row."""
    out: Layer = [None] * 4
    for state, way in enumerate(layer):
        if way is None:
            continue
        ways = [(state, way[0] + DELETE, "D")]
        if fault not in ("b", "d"):
            more = TRUNCATED if fault == "t" else 0
            ways.append((NEXT[state][TURN[state][0]], way[0] + REROLE + more, "R"))
            if initial in NEXT[state]:
                ways.append((NEXT[state][initial], way[0] + KEEP + more, "K"))
        for to, cost, letter in ways:
            new = (cost, way[1] + letter)
            if out[to] is None or new < out[to]:
                out[to] = new
    return closed(out)


def started(state: int) -> Layer:
    out: Layer = [None] * 4
    out[state] = (0, "")
    return closed(out)


def composed(layer: Layer, table: list[Layer | None]) -> Layer:
    """The layer after a stretch whose table has a layer for each state that it may begin in."""
    out: Layer = [None] * 4
    for state, way in enumerate(layer):
        if way is not None and table[state] is not None:
            for to, part in enumerate(table[state]):
                if part is not None:
                    new = (way[0] + part[0], way[1] + part[1])
                    if out[to] is None or new < out[to]:
                        out[to] = new
    return out


def told(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def checked(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest (of the text), row, fault (b, d, t or none) of every row; texts are read once and not carried along."""
    text = told("text")
    core = F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1)
    rows = convs.select("conv_id", F.col("turn").cast("bigint").alias("turn"), told("role").alias("role"), F.unhex(F.md5(text)).alias("digest"), core.alias("core"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "conv-rows")
    # The first of its kind by an aggregate, which combines before the shuffle; the join back can be split where it is skewed.
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("turn", "row"))["row"].alias("first"))
    both = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    fault = F.when(F.col("core") == "", "b").when(F.col("row") != F.col("first"), "d").when(~F.col("core").isin(".", "!", "?"), "t").otherwise("")
    return both.select("conv_id", "turn", "role", "digest", "row", fault.alias("fault"))


class Stretch:
    """What is told of up to STRETCH rows of one conversation."""

    def __init__(self, conv_id, whole: bool) -> None:
        self.conv_id, self.n = conv_id, 0
        self.turn_first = self.turn_last = None
        self.turns = self.illegal = 0
        self.faults = {"b": 0, "d": 0, "t": 0, "": 0}
        self.first = self.last = ""
        # The first stretch begins with nothing; any other may begin in all states.
        self.table: list[Layer | None] = [started(s) if s == NOTHING or not whole else None for s in range(4)]

    def add(self, turn, initial: str, fault: str) -> None:
        if turn is not None and turn != self.turn_last:
            self.turns += 1
            self.turn_first, self.turn_last = turn if self.turn_first is None else self.turn_first, turn
        if self.n and self.last + initial not in LEGAL:
            self.illegal += 1
        self.first, self.last = self.first if self.n else initial, initial
        self.n += 1
        self.faults[fault] += 1
        self.table = [layer if layer is None else stepped(layer, initial, fault) for layer in self.table]

    def row(self, part: int, k: int) -> tuple:
        costs = [way[0] if way else -1 for layer in self.table for way in (layer or [None] * 4)]
        audits = [way[1] if way else "" for layer in self.table for way in (layer or [None] * 4)]
        return (self.conv_id, self.n, self.turn_first, self.turn_last, self.turns, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, part, k, self.first, self.last, costs, audits)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 5000) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _one_fields(kind: pa.DataType) -> list[pa.Field]:
    return [pa.field("conv_id", kind), *(pa.field(c, pa.int64()) for c in ("n", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal"))]


def audited(convs: DataFrame) -> DataFrame:
    """One row a conversation that has rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    one = _ONE.format(t=dict(convs.dtypes)["conv_id"])
    order = ["conv_id", "turn", "role", "digest", "row"]
    ranged = checked(convs).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, schema = TaskContext.get().partitionId(), None

        def rows() -> Iterator[tuple]:
            nonlocal schema
            now, k = None, 0
            for batch in batches:
                schema = schema or pa.schema([*_one_fields(batch.schema.field(0).type), pa.field("part", pa.int32()), pa.field("k", pa.int32()), pa.field("first", pa.string()), pa.field("last", pa.string()), pa.field("costs", pa.list_(pa.int64())), pa.field("audits", pa.list_(pa.string()))])
                for conv_id, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if now is None or now.conv_id != conv_id or now.n >= STRETCH:
                        if now is not None:
                            yield now.row(part, k)
                            k += 1
                        # Only a conversation that began in this task is known to begin here.
                        now = Stretch(conv_id, whole=now is not None and now.conv_id != conv_id)
                    now.add(turn, initial, fault)
            if now is not None:
                yield now.row(part, k)

        found = rows()
        first = next(found, None)
        if first is not None:
            yield from _batches((x for some in ([first], found) for x in some), schema)

    parts = ranged.mapInArrow(tables, f"{one}, part int, k int, first string, last string, costs array<bigint>, audits array<string>")
    in_order = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "k")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def result(x: dict, layer: Layer) -> tuple:
            cost, audit = min(layer[s] for s in ACCEPTING if layer[s] is not None)
            gaps = min(x["last_turn"] - x["first_turn"] + 1 - x["turns"], (1 << 63) - 1) if x["turns"] else 0
            return (x["conv_id"], gaps, x["blank"], x["duplicate"], x["truncated"], x["illegal"], cost, audit)

        def rows() -> Iterator[tuple]:
            nonlocal schema
            x, layer = None, None
            for batch in batches:
                schema = schema or pa.schema([pa.field("conv_id", batch.schema.field(0).type), *(pa.field(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), pa.field("audit", pa.string())])
                for y in batch.to_pylist():
                    ways = [(c, a) if c >= 0 else None for c, a in zip(y["costs"], y["audits"], strict=True)]
                    table = [ways[4 * s : 4 * s + 4] for s in range(4)]
                    if x is None or x["conv_id"] != y["conv_id"]:
                        if x is not None:
                            yield result(x, layer)
                        x, layer = y, table[NOTHING]
                        continue
                    layer = composed(layer, table)
                    x["illegal"] += y["illegal"] + (x["last"] + y["first"] not in LEGAL)
                    x["last"] = y["last"]
                    x["turns"] += y["turns"] - (y["turns"] > 0 and x["last_turn"] == y["first_turn"])
                    if y["turns"]:
                        x["first_turn"], x["last_turn"] = y["first_turn"] if x["first_turn"] is None else x["first_turn"], y["last_turn"]
                    for c in ("blank", "duplicate", "truncated"):
                        x[c] += y[c]
            if x is not None:
                yield result(x, layer)

        found = rows()
        first = next(found, None)
        if first is not None:
            yield from _batches((z for some in ([first], found) for z in some), schema, 1000)

    return in_order.mapInArrow(joined, f"conv_id {dict(convs.dtypes)['conv_id']}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, place, edit, turn, role, text) of what stays or is new; place None: the conversation's end. Its audit comes as its first row."""
    now, audit, at, state, place = None, "", 0, NOTHING, 0
    begun = False

    def inserted() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            yield now, place, "I", None, TURN[state], ""
            state, place, at = NEXT[state][TURN[state][0]], place + 1, at + 1

    for batch in batches:
        for conv_id, is_row, turn, role, text, given in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "is_row", "turn", "role", "text", "audit")), strict=True):
            if not is_row:
                if begun:
                    yield from inserted()
                    yield now, None, "", None, "", ""
                now, audit, at, state, place, begun = conv_id, given, 0, NOTHING, 0, True
                continue
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit != "D":
                to = TURN[state] if edit == "R" else role
                yield now, place, edit, turn, to, text
                state, place = NEXT[state][to[0]], place + 1
    if begun:
        yield from inserted()
        yield now, None, "", None, "", ""


def _with_audits(convs: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows in order, by task: a task streams them and holds one batch."""
    rows = convs.select("conv_id", F.lit(True).alias("is_row"), F.col("turn").cast("bigint").alias("turn"), told("role").alias("role"), told("text").alias("text"), F.lit(None).cast("string").alias("audit"))
    head = audits.select("conv_id", F.lit(False).alias("is_row"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    both = head.unionByName(rows).repartition("conv_id")
    return both.withColumn("digest", F.unhex(F.md5("text"))).sortWithinPartitions("conv_id", "is_row", "turn", "role", "digest").drop("digest")


def repaired(convs: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), edit (K, R or I), turn (as it was; null where new), role, text. audits: what audited(convs) gave, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([pa.field("conv_id", first.schema.field("conv_id").type), pa.field("place", pa.int64()), pa.field("edit", pa.string()), pa.field("turn", pa.int64()), pa.field("role", pa.string()), pa.field("text", pa.string())])
        yield from _batches((e for e in _edits(b for some in ([first], batches) for b in some) if e[1] is not None), schema, 500)

    return _with_audits(convs, audited(convs) if audits is None else audits).mapInArrow(run, f"conv_id {dict(convs.dtypes)['conv_id']}, place bigint, edit string, turn bigint, role string, text string")


def digests(convs: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of the repaired turns, role:text joined by newlines. A digest needs a conversation's turns one after the other, so one task streams them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([pa.field("conv_id", first.schema.field("conv_id").type), pa.field("repaired_sha256", pa.string())])

        def rows() -> Iterator[tuple]:
            digest = hashlib.sha256()
            for conv_id, place, _, _, role, text in _edits(b for some in ([first], batches) for b in some):
                if place is None:
                    yield conv_id, digest.hexdigest()
                    digest = hashlib.sha256()
                else:
                    digest.update(("\n" if place else "").encode() + f"{role}:{text}".encode())

        yield from _batches(rows(), schema)

    return _with_audits(convs, audits).mapInArrow(run, f"conv_id {dict(convs.dtypes)['conv_id']}, repaired_sha256 string")


def damaged(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows damaged by crc32 of conv_id:turn (nulls: one space) modulo 20: 0 drops the row, 1 empties its text, 2 takes its . ! ? away, 3 repeats it, 4 makes it the user's."""
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    rows = convs.select("conv_id", F.col("turn").cast("bigint").alias("turn"), told("role").alias("role"), told("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")
