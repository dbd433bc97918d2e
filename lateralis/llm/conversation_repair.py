"""Conversation structure repair: the cheapest edits after which turns alternate, by a checkpointed DP.

A conversation is legal when the initials of its roles are ``(s?(ua)+)?``. Rows are kept, given another
role or deleted, and empty turns are inserted. The cost to the end, a vector over the four states of the
grammar, is made from the last row backwards, and only the vectors at every square root of n-th row are
stored. The walk forward reads one block of rows at a time, makes the vectors of that block again from
the checkpoint behind it, and takes at each step the ASCII-least edit that is still on a cheapest path.

Rows are dealt out by conversation and stream through sorted; a task holds one block of one conversation.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateralis.llm.shared import named, scratch, smaller_batches, stage

#: Costs of the edits; a row that is left truncated adds one.
RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the grammar: nothing yet, after s, after u, after a. A new or retyped turn leads to ``NEXT``.
NEXT = (2, 2, 3, 2)
ROLE_INTO = ("", "system", "user", "assistant")
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FAR = 1 << 60
#: Costs to the end behind the last row: only inserts are left.
AT_END = (0, INSERT * 2, INSERT, 0)
WHITE = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]


def row_costs(initial: str, fault: str, after: Vector, state: int) -> dict[str, int]:
    """Cost to the end by the edit of this row, in ASCII order; ``after`` holds the costs behind it."""
    out = {"D": DELETE + after[state]}
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        kept = KEEPS.get((state, initial))
        if kept is not None:
            out["K"] = more + after[kept]
        out["R"] = RETYPE + more + after[NEXT[state]]
    return out


def before(initial: str, fault: str, after: Vector) -> Vector:
    """The costs to the end in front of a row, inserts there included."""
    w = [min(row_costs(initial, fault, after, q).values()) for q in range(4)]
    u, a = min(w[2], INSERT + w[3]), min(w[3], INSERT + w[2])
    return min(w[0], INSERT + u), min(w[1], INSERT + u), u, a


def block_size(n: int) -> int:
    return max(1, math.isqrt(max(n - 1, 0)) + 1)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by ``crc32(conv_id:turn) % 20``: 0 drops the row, 1 empties
    its text, 2 takes out its ``[.!?]``, 3 repeats it, 4 makes its role user. Nulls there are one space."""
    whole = [F.coalesce(named(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    cut = rows.select(
        named("conv_id").cast("long").alias("conv_id"), named("turn").cast("long").alias("turn"),
        F.coalesce(named("role"), F.lit(" ")).alias("role"), F.coalesce(named("text"), F.lit(" ")).alias("text"),
        (F.crc32(F.concat(whole[0], F.lit(":"), whole[1])) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return cut.filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


CODED_TYPE = "conv_id long, at long, initial string, fault string, illegal boolean, role string, text string"
CODED = pa.schema([
    ("conv_id", pa.int64()), ("at", pa.int64()), ("initial", pa.string()), ("fault", pa.string()), ("illegal", pa.bool_()),
    ("role", pa.string()), ("text", pa.string())])


def coded(rows: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` numbered by turn (nulls first, then role and text), each with the initial of
    its role, its first fault, and whether the initials of the row before and its own are illegal side by side.

    Whether role and text were seen earlier is a grouping by their digest, joined back; only equal rows of
    one turn, which lie side by side, are told apart in the stream.
    """
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    keyed = rows.select("conv_id", "turn", "role", "text", F.unhex(same).alias("same"))
    turn = F.struct(F.col("turn").isNotNull().alias("given"), "turn")  # a null turn is the smallest
    first = keyed.groupBy(F.col("conv_id").alias("c"), F.col("same").alias("s")).agg(F.min(turn).alias("first"))
    met = keyed.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")))
    met = met.select("conv_id", "turn", "role", "text", (~turn.eqNullSafe(F.col("first"))).alias("seen"))
    ordered = met.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            conv, last, at, initial = object(), None, 0, None
            for row in _rows(batches):
                if row["conv_id"] != conv:
                    conv, last, at, initial = row["conv_id"], None, 0, None
                own, stripped = (row["turn"], row["role"], row["text"]), row["text"].rstrip(WHITE)
                if not stripped:
                    fault = "blank"
                elif row["seen"] or own == last:
                    fault = "duplicate"
                else:
                    fault = "" if stripped[-1] in ".!?" else "truncated"
                pair, initial = initial, row["role"][:1]
                illegal = pair is not None and pair + initial not in ("su", "ua", "au")
                yield {"conv_id": conv, "at": at, "initial": initial, "fault": fault, "illegal": illegal, "role": row["role"], "text": row["text"]}
                last, at = own, at + 1

        return _batches(made(), CODED)

    return ordered.mapInArrow(code, CODED_TYPE)


def checkpoints(rows: DataFrame) -> DataFrame:
    """(conv_id, at, ahead): for the block of rows that starts at ``at``, the costs to the end behind its last row.

    Reads ``coded`` rows from the last one backwards, without their texts; one vector is held.
    """
    back = rows.select("conv_id", "at", "initial", "fault").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("at"))
    schema = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("ahead", pa.list_(pa.int64()))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            conv, size, costs, ahead = object(), 1, AT_END, AT_END
            for row in _rows(batches):
                if row["conv_id"] != conv:
                    conv, size, costs, ahead = row["conv_id"], block_size(row["at"] + 1), AT_END, AT_END
                costs = before(row["initial"], row["fault"], costs)
                if row["at"] % size == 0:
                    yield {"conv_id": conv, "at": row["at"], "ahead": list(ahead)}
                    ahead = costs

        return _batches(made(), schema)

    return back.mapInArrow(walk, "conv_id long, at long, ahead array<long>")


EDITS_TYPE = "conv_id long, step long, edit string, cost long, fault string, illegal boolean, role string, text string"
EDITS = pa.schema([
    ("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("cost", pa.int64()), ("fault", pa.string()),
    ("illegal", pa.bool_()), ("role", pa.string()), ("text", pa.string())])


def block_edits(rows: list[dict], ahead: Vector, state: int) -> Iterator[tuple[str, int, dict | None, int]]:
    """(edit, cost, row, next state) of the ASCII-least cheapest path over a block; ``ahead``: the costs behind it."""
    costs = [ahead]
    for row in reversed(rows):
        costs.append(before(row["initial"], row["fault"], costs[-1]))
    costs.reverse()
    for i, row in enumerate(rows):
        while True:
            best = costs[i][state]
            ways = row_costs(row["initial"], row["fault"], costs[i + 1], state)
            new = NEXT[state]
            ways["I"] = INSERT + costs[i][new]
            edit = min(x for x, cost in ways.items() if cost == best)
            if edit == "I":
                yield "I", INSERT, None, new
                state = new
                continue
            state = {"D": state, "K": KEEPS.get((state, row["initial"]), -1), "R": new}[edit]
            yield edit, best - costs[i + 1][state], row, state
            break


def edited(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """One row per edit, in order within its conversation: D, I, K or R, its cost, the fault of the row, and role and
    text of the turn that comes out (of the one that goes, for D). ``rows`` are ``coded``, ``marks`` their ``checkpoints``."""
    none = F.lit(None)
    starts = marks.select(
        "conv_id", "at", F.lit(0).alias("kind"), none.cast("string").alias("initial"), none.cast("string").alias("fault"),
        none.cast("boolean").alias("illegal"), none.cast("string").alias("role"), none.cast("string").alias("text"), "ahead")
    body = rows.select("conv_id", "at", F.lit(1).alias("kind"), "initial", "fault", "illegal", "role", "text", none.cast("array<bigint>").alias("ahead"))
    stream = body.unionByName(starts).repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            conv, state, step, block, ahead = object(), 0, 0, [], AT_END

            def flushed(last: bool) -> Iterator[dict]:
                nonlocal state, step
                for edit, cost, row, state in block_edits(block, ahead, state):  # noqa: B020  the state goes on
                    yield put(edit, cost, row)
                while last and AT_END[state]:
                    state = NEXT[state]
                    yield put("I", INSERT, None)

            def put(edit: str, cost: int, row: dict | None) -> dict:
                nonlocal step
                step += 1
                role = row["role"] if edit in "DK" else ROLE_INTO[state]
                return {"conv_id": conv, "step": step, "edit": edit, "cost": cost, "fault": row["fault"] if row else "",
                        "illegal": bool(row and row["illegal"]), "role": role, "text": row["text"] if row else ""}

            for row in _rows(batches):
                if row["kind"] == 0:
                    if row["at"] == 0:
                        if block:
                            yield from flushed(True)
                        conv, state, step = row["conv_id"], 0, 0
                    else:
                        yield from flushed(False)
                    block, ahead = [], tuple(row["ahead"])
                else:
                    block.append(row)
            if block:
                yield from flushed(True)

        return _batches(made(), EDITS)

    return stream.mapInArrow(walk, EDITS_TYPE)


def repair(rows: DataFrame) -> DataFrame:
    """The ``edited`` rows of conversations (conv_id, turn, role, text); the last column set of the operator.

    Null role or text is one space. A null conv_id is a conversation of its own. Rows go by turn, nulls
    first, rows of one turn by role and text; repeated rows are rows of their own, of which all but the first are
    duplicates. Other columns are ignored; an empty table gives no rows. Of cheapest edits the ASCII-least by their initials.
    """
    smaller_batches(rows.sparkSession)
    plain = rows.select(
        named("conv_id").cast("long").alias("conv_id"), named("turn").cast("long").alias("turn"),
        F.coalesce(named("role"), F.lit(" ")).alias("role"), F.coalesce(named("text"), F.lit(" ")).alias("text"))
    ready = stage(coded(plain), "repair-rows")
    return edited(ready, stage(checkpoints(ready), "repair-checkpoints"))


SUMMARY_TYPE = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SUMMARY = pa.schema([
    *[(c, pa.int64()) for c in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def summaries(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``, in its order (no shuffle is added): faults, cost, audit, digest of the repaired turns."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            out, sha, audit, turns = None, None, [], 0
            for row in _rows(batches):
                if row["step"] == 1:
                    if out:
                        yield out | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
                    out = {"conv_id": row["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
                    sha, audit, turns = hashlib.sha256(), [], 0
                audit.append(row["edit"])
                out["cost"] += row["cost"]
                out["illegal"] += row["illegal"]
                if row["fault"]:
                    out[row["fault"]] += 1
                if row["edit"] != "D":
                    sha.update(f"{chr(10) if turns else ''}{row['role']}:{row['text']}".encode())
                    turns += 1
            if out:
                yield out | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

        return _batches(made(), SUMMARY)

    return edits.mapInArrow(fold, SUMMARY_TYPE)


def repaired_summary(rows: DataFrame, every: DataFrame) -> DataFrame:
    """``summaries`` and the gaps of turns for each conv_id of ``every``; zeros and empty texts for those without rows. Staged."""
    span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    with scratch(rows.sparkSession):
        done = stage(summaries(repair(rows)), "repair-summaries")
        gaps = rows.groupBy(F.col("conv_id").alias("g")).agg(F.coalesce(span, F.lit(0)).alias("gaps"))
        ids = every.select(named("conv_id").cast("long").alias("conv_id")).distinct()
        out = ids.join(done.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left")
        out = out.join(gaps, F.col("conv_id").eqNullSafe(F.col("g")), "left")
        zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        return stage(out.select(
            "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")), "repair-result", keep=True)
