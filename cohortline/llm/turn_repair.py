"""Repair of the structure of conversations by a square-root checkpointed dynamic programme.

A conversation should read system?, then user and assistant in turn, ending with an assistant, or be empty. Rows are kept, given the other role or
deleted and empty ones inserted, at the least cost; of all cheapest lists of edits the one that is least as a string is taken.

The programme has four states (nothing yet, after a system, a user, an assistant row). Backward, each row turns the vector of costs to the end
into the one before it. Only the vectors at every sqrt(n)-th row are stored; walking forward, a block's vectors are made again from the one at its
end, and each edit is the least that keeps to the cheapest cost. So a conversation takes sqrt(n) vectors of memory, beside its rows.

Conversations stream through tasks by key, one at a time. One with more than HOT_TURNS rows or HOT_CHARS characters is cut into segments by range
partitioning: what a segment does to cost vectors is a 4 by 4 matrix of sums and minima, the driver chains these few matrices backward (they are the
checkpoints) and the segments' end states forward, and the segments then walk on their own. Its rows meet in one task only as a stream in order, for the
digest, which can't be had otherwise; that task holds a row and an edit string at a time.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators import skew
from ..operators.durable import durable
from .words import slices

HOT_TURNS = 50_000
HOT_CHARS = 50_000_000
#: Rows of a segment of a long conversation.
SEGMENT = 50_000

#: Costs of the edits; a row that is kept though it is cut off costs CUT_OFF more.
DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5
#: The state that a row of the role a state asks for leads to, and the role of the row that leads to a state.
_NEXT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
#: States that a kept row leads to, by the class of its role (system, user, assistant, other) and the state before.
_KEPT = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)
_CLASS = {"s": 0, "u": 1, "a": 2}
#: Costs of the rows still to be inserted after the last row, by state.
END = (0, 2 * INSERT, INSERT, 0)
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def kind(initial: str, cut_off: bool, must_go: bool) -> int:
    """What the programme has to know of a row, as a small number."""
    return _CLASS.get(initial, 3) + 4 * (2 if must_go else int(cut_off))


def _choices(row: int, state: int, after: Sequence[float]) -> Iterator[tuple[str, float, int]]:
    """(edit, cost to the end, next state) of what may happen to a row, in the order of the edits' letters."""
    yield "D", DELETE + after[state], state
    if row < 8:
        more = CUT_OFF if row >= 4 else 0
        kept = _KEPT[row % 4][state]
        if kept is not None:
            yield "K", more + after[kept], kept
        yield "R", REROLE + more + after[_NEXT[state]], _NEXT[state]


@lru_cache(maxsize=200_000)
def _shifted(row: int, after: tuple[float, ...]) -> tuple[float, ...]:
    taken = [min(c for _, c, _ in _choices(row, q, after)) for q in range(4)]
    # Two inserted rows before it are the most that can help: a third would lead back.
    return tuple(min(taken[q], INSERT + taken[_NEXT[q]], 2 * INSERT + taken[_NEXT[_NEXT[q]]]) for q in range(4))


def before(row: int, after: tuple[float, ...]) -> tuple[float, ...]:
    """Costs to the end before a row, from those after it. Vectors that differ by a constant share one calculation."""
    least = min(after)
    if least == inf:
        return after
    return tuple(c + least for c in _shifted(row, tuple(c - least for c in after)))


@lru_cache(maxsize=200_000)
def _edits_of(row: int, state: int, after: tuple[float, ...]) -> tuple[str, int]:
    """(edits at a row and just before it, next state)."""
    made, here = "", _shifted(row, after)
    while True:
        for edit, cost, to in _choices(row, state, after):
            if edit > "I" and here[state] == INSERT + here[_NEXT[state]]:
                break
            if cost == here[state]:
                return made + edit, to
        made, state = made + "I", _NEXT[state]


def costs(rows: Sequence[int], end: tuple[float, ...] = END) -> tuple[float, ...]:
    """Costs to the end before the first of `rows`, by state."""
    for row in reversed(rows):
        end = before(row, end)
    return end


def walk(rows: Sequence[int], state: int = 0, end: tuple[float, ...] = END, last: bool = True) -> tuple[list[str], int]:
    """(edits of each row, last state): the least string of the cheapest edits. `last`: the rows still missing at the end are inserted there."""
    block = isqrt(len(rows)) + 1
    checkpoints = [end]
    for at in range((len(rows) - 1) // block * block, 0, -block):
        checkpoints.append(costs(rows[at : at + block], checkpoints[-1]))
    made = []
    for at in range(0, len(rows), block):
        part = rows[at : at + block]
        vectors = [checkpoints.pop()]
        for row in reversed(part[1:]):
            vectors.append(before(row, vectors[-1]))
        for row in part:
            after = vectors.pop()
            least = min(after)
            edit, state = _edits_of(row, state, tuple(c - least for c in after))
            made.append(edit)
    if last and made:
        while END[state]:
            made[-1] += "I"
            state = _NEXT[state]
    return made, state


def transfer(rows: Sequence[int]) -> list[list[float]]:
    """The cost from each state before the rows to each state after them."""
    columns = [costs(rows, tuple(0 if q == to else inf for q in range(4))) for to in range(4)]
    return [[columns[to][q] for to in range(4)] for q in range(4)]


def render(edits: str, state: int, role: str, text: str) -> tuple[list[tuple[str, str]], int]:
    """(repaired rows, next state) of a row and its edits."""
    out = []
    for edit in edits:
        if edit == "K":
            state = _KEPT[_CLASS[role[:1]]][state]
            out.append((role, text))
        elif edit != "D":
            state = _NEXT[state]
            out.append((_ROLE[state], text if edit == "R" else ""))
    return out, state


class _Digest:
    """SHA-256 of lines role:text, joined by line feeds."""

    def __init__(self) -> None:
        self._hash, self._any = hashlib.sha256(), False

    def add(self, rows: list[tuple[str, str]]) -> None:
        for role, text in rows:
            self._hash.update((("\n" if self._any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self._any = True

    def hex(self) -> str:
        return self._hash.hexdigest()


def _repair_one(turns: list, roles: list[str], texts: list[str]) -> tuple[tuple, list[tuple[str, str]]]:
    """(report, repaired rows) of a conversation's rows in order."""
    seen, rows, faults = set(), [], [0, 0, 0]
    for role, text in zip(roles, texts):
        shown = text.rstrip(BLANKS)
        fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in STOPS else None
        seen.add((role, text))
        if fault is not None:
            faults[fault] += 1
        rows.append(kind(role[:1], fault == 2, fault in (0, 1)))
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))
    edits, state, repaired = walk(rows)[0], 0, []
    for edit, role, text in zip(edits, roles, texts):
        made, state = render(edit, state, role, text)
        repaired += made
    digest = _Digest()
    digest.add(repaired)
    return (gaps, *faults, illegal, int(costs(rows)[0]), "".join(edits), digest.hex()), repaired


def _fields(schema: str) -> list[str]:
    return [part.split(" ")[0] for part in schema.split(", ")]


def _streamed(rows: DataFrame, key: str, report: bool) -> DataFrame:
    """Conversations that fit in a task, one at a time out of sorted partitions."""
    key_type = rows.schema["_key"].dataType.simpleString()
    schema = REPORT if report else "place long, role string, text string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None

        def finish(out: list[list]) -> None:
            facts, repaired = _repair_one(*held)
            for values in [facts] if report else [(i, *r) for i, r in enumerate(repaired)]:
                out[0].append(current)
                for column, value in zip(out[1:], values):
                    column.append(value)

        def table(out: list[list], types: Sequence[pa.DataType]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], names=["_key", *_fields(schema)])

        types = None
        for batch in slices(batches):
            names = batch.schema.names
            if types is None:
                kinds = {"long": pa.int64(), "string": pa.string()}
                types = [batch.schema.field("_key").type, *[kinds[part.split(" ")[1]] for part in schema.split(", ")]]
            out: list[list] = [[] for _ in types]
            columns = [batch.column(names.index(n)).to_pylist() for n in ("_key", "turn", "role", "text")]
            for k, *row in zip(*columns):
                if held is None or k != current:
                    if held is not None:
                        finish(out)
                    current, held = k, ([], [], [])
                for column, value in zip(held, row):
                    column.append(value)
            yield table(out, types)
        if held is not None:
            out = [[] for _ in types]
            finish(out)
            yield table(out, types)

    placed = rows.repartition("_key").sortWithinPartitions("_key", *_order())
    return placed.mapInArrow(work, f"_key {key_type}, {schema}").withColumnRenamed("_key", key)


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _features(rows: DataFrame) -> DataFrame:
    """(_key, _part, _row, initial, fault, kind) of the rows of long conversations; fault 0 is blank, 1 duplicate, 2 truncated."""
    shown = F.rtrim("text", F.lit(BLANKS))
    marked = rows.select("_key", "_part", "_row", "role", F.sha2("text", 256).alias("_text"), shown.alias("_shown"))
    marked = marked.select(
        "_key", "_part", "_row", "role", "_text", F.substring("role", 1, 1).alias("initial"),
        (F.col("_shown") == "").alias("_blank"), (~F.right("_shown", F.lit(1)).isin(*STOPS)).alias("_cut"),
    )
    names = ["_key", "role", "_text"]
    several = marked.groupBy(*names).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    several = several.toDF("_key2", "_role2", "_text2", "_first", "_n")
    same = F.col("_key").eqNullSafe(F.col("_key2")) & (F.col("role") == F.col("_role2")) & (F.col("_text") == F.col("_text2"))
    marked = marked.join(several, same, "left")
    fault = F.when(F.col("_blank"), 0).when(F.col("_row") > F.col("_first"), 1).when(F.col("_cut"), 2)
    role = F.coalesce(*[F.when(F.col("initial") == k, v) for k, v in _CLASS.items()], F.lit(3))
    code = role + F.when(fault < 2, 8).when(fault == 2, 4).otherwise(0)
    return durable(marked.select("_key", "_part", "_row", "initial", fault.alias("fault"), code.alias("kind")))


def _by_segment(features: DataFrame, schema: str, work: Callable[[tuple, pa.Table], pa.Table]) -> DataFrame:
    """What `work` makes of ((key, part), rows in order) of each segment."""

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return work((key[0].as_py(), key[1].as_py()), table.sort_by("_row"))

    return features.groupBy("_key", "_part").applyInArrow(one, schema)


def _segmented(rows: DataFrame, key: str, report: bool) -> DataFrame:
    """Long conversations, cut into segments by ranges of their order."""
    spark, key_type = rows.sparkSession, rows.schema["_key"].dataType.simpleString()
    parts = -(-rows.count() // SEGMENT)
    ranged = rows.repartitionByRange(parts, "_key", *_order()).sortWithinPartitions("_key", *_order())
    ranged = durable(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    features = _features(ranged)

    def sum_up(at: tuple, table: pa.Table) -> pa.Table:
        initials = table.column("initial").to_pylist()
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        cells = [-1 if c == inf else int(c) for line in transfer(table.column("kind").to_pylist()) for c in line]
        columns = [[at[0]], [at[1]], [initials[0]], [initials[-1]], [illegal], [cells]]
        types = [table.schema.field("_key").type, pa.int32(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["_key", "_part", "head", "tail", "illegal", "cells"])

    chains = defaultdict(list)
    schema = f"_key {key_type}, _part int, head string, tail string, illegal long, cells array<long>"
    for r in sorted(_by_segment(features, schema, sum_up).collect(), key=lambda r: r["_part"]):
        chains[r["_key"]].append(r)
    ends: dict[tuple, tuple] = {}
    totals = []
    for name, chain in chains.items():
        vector = END
        for r in reversed(chain):
            ends[name, r["_part"]] = vector
            cells = [inf if c < 0 else c for c in r["cells"]]
            vector = tuple(min(cells[4 * q + to] + vector[to] for to in range(4)) for q in range(4))
        crossing = sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(chain, chain[1:]))
        totals.append((name, sum(r["illegal"] for r in chain) + crossing, int(vector[0])))

    def leave(at: tuple, table: pa.Table) -> pa.Table:
        codes = table.column("kind").to_pylist()
        states = [walk(codes, q, ends[at], last=False)[1] for q in range(4)]
        types = [table.schema.field("_key").type, pa.int32(), pa.list_(pa.int32())]
        return pa.table([pa.array(c, t) for c, t in zip([[at[0]], [at[1]], [states]], types)], names=["_key", "_part", "states"])

    found = _by_segment(features, f"_key {key_type}, _part int, states array<int>", leave).collect()
    leaving = {(r["_key"], r["_part"]): r["states"] for r in found}
    starts: dict[tuple, int] = {}
    finals = set()
    for name, chain in chains.items():
        state = 0
        for r in chain:
            starts[name, r["_part"]] = state
            state = leaving[name, r["_part"]][state]
        finals.add((name, chain[-1]["_part"]))

    def edit(at: tuple, table: pa.Table) -> pa.Table:
        made, _ = walk(table.column("kind").to_pylist(), starts[at], ends[at], last=at in finals)
        return pa.table([table.column("_row"), pa.array(made, pa.string())], names=["_row", "edits"])

    edits = _by_segment(features, "_row long, edits string", edit)
    lines = ranged.join(edits, "_row").select("_key", "_row", "role", "text", "edits")
    lines = lines.repartition("_key").sortWithinPartitions("_key", "_row")
    if not report:
        return lines.mapInArrow(_rendered, f"_key {key_type}, place long, role string, text string").withColumnRenamed("_key", key)

    counted = features.groupBy("_key").agg(*[F.count(F.when(F.col("fault") == i, 1)).alias(n) for i, n in enumerate(("blank", "duplicate", "truncated"))])
    days = ranged.groupBy("_key", "turn").agg(F.lit(1).alias("one")).groupBy("_key")
    days = days.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    digests = lines.mapInArrow(_digested, f"_key {key_type}, audit string, repaired_sha256 string")
    sums = spark.createDataFrame(totals, f"_key {key_type}, illegal long, cost long")
    out = digests
    for i, side in enumerate((counted, days, sums)):
        side = side.withColumnRenamed("_key", f"_key{i}")
        out = out.join(F.broadcast(side) if side is sums else side, F.col("_key").eqNullSafe(F.col(f"_key{i}"))).drop(f"_key{i}")
    return out.select(F.col("_key").alias(key), *_fields(REPORT))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, list[tuple]]]:
    """(type of the key, (key, edits, repaired rows, whether the conversation begins) of each row) for each batch."""
    current, state, opened = None, 0, False
    for batch in slices(batches):
        out = []
        for k, role, text, edits in zip(*[batch.column(batch.schema.names.index(n)).to_pylist() for n in ("_key", "role", "text", "edits")]):
            begins = not opened or k != current
            if begins:
                current, state, opened = k, 0, True
            made, state = render(edits, state, role, text)
            out.append((k, edits, made, begins))
        yield batch.schema.field("_key").type, out


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = 0
    for kind_of_key, rows in _lines(batches):
        out: list[tuple] = []
        for k, _, made, begins in rows:
            place = 0 if begins else place
            for role, text in made:
                out.append((k, place, role, text))
                place += 1
        columns = list(zip(*out)) or [[]] * 4
        types = [kind_of_key, pa.int64(), pa.string(), pa.string()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["_key", "place", "role", "text"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_key", "audit", "repaired_sha256"]
    held = None

    def closed(types: list[pa.DataType]) -> pa.RecordBatch:
        values = [held[0], "".join(held[1]), held[2].hex()]
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, types)], names=names)

    types: list[pa.DataType] = []
    for kind_of_key, rows in _lines(batches):
        types = [kind_of_key, pa.string(), pa.string()]
        for k, edits, made, begins in rows:
            if begins:
                if held is not None:
                    yield closed(types)
                held = (k, [], _Digest())
            held[1].append(edits)
            held[2].add(made)
    if held is not None:
        yield closed(types)


def _whole(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(
        F.col(key).alias("_key"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )


def repair(rows: DataFrame, key: str = "conv_id", report: bool = True) -> DataFrame:
    """What is wrong with each conversation of (`key`, turn, role, text), and its cheapest repair.

    `report`: (`key`, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation. Otherwise its
    repaired rows (`key`, place, role, text). Rows are ordered by turn, missing ones first, then role and text. A missing role or text is one
    space, a missing key is a conversation of its own, and repeated rows are duplicates. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = _whole(rows, key)
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))
    hot = durable(sizes.where((F.col("n") > HOT_TURNS) | (F.col("chars") > HOT_CHARS)).select("_key"))
    if hot.isEmpty():
        return _streamed(rows, key, report)
    ordinary, heavy = skew.split_hot(rows, ["_key"], hot)
    return _streamed(ordinary, key, report).unionByName(_segmented(heavy, key, report))


def damage(rows: DataFrame) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text) with faults chosen by a checksum of id and turn; missing values are one space."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat_ws(":", *part)) % 20).alias("_fault"),
    )
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_fault") == 3, 2).otherwise(1)
    kept = rows.where("_fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("_copy"))
    return kept.drop("_copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The report on every conversation of the table after `damage`; one without rows left has zeros, no edits and the digest of an empty text."""
    found = repair(damage(conversations)).withColumnRenamed("conv_id", "_found")
    ids = conversations.select("conv_id").distinct()
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    values = [F.coalesce(F.col(n), F.lit(empty[n]) if n in empty else F.lit(0).cast("long")).alias(n) for n in _fields(REPORT)]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left").select("conv_id", *values)
