"""Repair of conversation structure: the cheapest edits that make roles alternate, found in linear space.

Roles must read ``(s?(ua)+)?`` by their initials: an optional system turn, then pairs of user and assistant. Edits
are Keep (0), Rerole to user or assistant (2), Delete (3) and Insert of an empty user or assistant turn (2); blank
and duplicate rows must be deleted, and a truncated row that stays adds 1. The optimum over a conversation is found
by Hirschberg's divide and conquer on four automaton states (start, after s, after u, after a): forward cost vectors
from the left end and backward vectors from the right end meet at the middle row, the crossing state of least total
cost is fixed (of equal cost, the one whose best left audit is least), and both halves are solved again the same way.
Memory is linear in the rows, whatever the length of the conversation.

The audit is one letter per edit in order: K, R, D, or I for an insert placed before the row it precedes. Among
edit sequences of least cost the one whose audit is ASCII-least is chosen.

Rows of a conversation are ordered by turn (nulls first), then role, then text; identical rows are interchangeable.
Identical copies are combined in Spark before the shuffle, so a group of copies travels as one row with a count.
Conversations are hash-partitioned and sorted by Spark, and a task walks its sorted rows conversation by
conversation; one conversation is still read by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.shared import crc_mod

INF = float("inf")
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Edit costs, the penalty of a kept truncated row, and the turn pairs that are legal.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL_PAIRS = ("su", "ua", "au")
#: Ranges shorter than this are solved directly with their edit strings; longer ones are split.
DIRECT_ROWS = 32

#: ``\z``, not ``$``: Java's ``$`` also matches before a final line separator such as U+2028.
BLANK = r"^[\x20\x09-\x0D]*\z"
LAST_MARK = r"[.!?][\x20\x09-\x0D]*\z"

OUTPUT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string, n_rows long, n_repaired long"
)


def _step(state: int, initial: str) -> int | None:
    """The automaton of ``(s?(ua)+)?``; an empty initial leaves the state as it is."""
    if initial == "":
        return state
    if initial == "s":
        return AFTER_S if state == START else None
    if initial == "u":
        return AFTER_U if state != AFTER_U else None
    if initial == "a":
        return AFTER_A if state == AFTER_U else None
    return None


def _inserted(state: int) -> int:
    """An inserted turn is the one the automaton allows: assistant after a user, else user."""
    return AFTER_A if state == AFTER_U else AFTER_U


#: Cost and letters of ending in each state: accepting states end as they are, others insert what is missing.
END = {START: (0, ""), AFTER_S: (2 * INSERT, "II"), AFTER_U: (INSERT, "I"), AFTER_A: (0, "")}


class Row:
    """One row after damage, or a run of its identical copies: ``forced`` rows must be deleted."""

    __slots__ = ("initial", "forced", "truncated", "copies")

    def __init__(self, initial: str, forced: bool, truncated: bool, copies: int = 1):
        self.initial, self.forced, self.truncated, self.copies = initial, forced, truncated, copies

    def segments(self, state: int) -> list[tuple[int, int, str]]:
        """(next state, cost, letters) of each way through this row from ``state``: up to two inserts, then an edit.

        A run of forced copies is deleted as a whole; inserts before it are allowed but never least, as D < I.
        """
        out = []
        cost, letters = 0, ""
        for _ in range(3):
            out.append((state, cost + DELETE * self.copies, letters + "D" * self.copies))
            if not self.forced:
                extra = TRUNCATED if self.truncated else 0
                if (kept := _step(state, self.initial)) is not None:
                    out.append((kept, cost + KEEP + extra, letters + "K"))
                out.append((_inserted(state), cost + REROLE + extra, letters + "R"))
            state, cost, letters = _inserted(state), cost + INSERT, letters + "I"
        return out


def _forward(rows: list[Row], lo: int, hi: int, entry: int) -> tuple[list[float], list[int]]:
    """Least costs of reaching each state after rows [lo, hi) from ``entry``, and the order of their least audits."""
    cost = [INF] * 4
    cost[entry] = 0
    rank = [0] * 4
    for i in range(lo, hi):
        best: list[tuple | None] = [None] * 4
        for state in range(4):
            if cost[state] == INF:
                continue
            for nxt, c, letters in rows[i].segments(state):
                candidate = (cost[state] + c, rank[state], letters)
                if best[nxt] is None or candidate < best[nxt]:
                    best[nxt] = candidate
        cost = [b[0] if b else INF for b in best]
        # Audits of different states differ before either ends, so (rank before, letters) orders them.
        order = sorted((b[1], b[2], s) for s, b in enumerate(best) if b)
        rank = [0] * 4
        for place, (_, _, s) in enumerate(order):
            rank[s] = place
    return cost, rank


def _exit_costs(exit_state: int | None) -> list[float]:
    if exit_state is None:
        return [END[s][0] for s in range(4)]
    return [0 if s == exit_state else INF for s in range(4)]


def _backward(rows: list[Row], lo: int, hi: int, exit_state: int | None) -> list[float]:
    """Least costs from each state before row ``lo`` to the exit after row ``hi``."""
    cost = _exit_costs(exit_state)
    for i in range(hi - 1, lo - 1, -1):
        before = [INF] * 4
        for state in range(4):
            for nxt, c, _ in rows[i].segments(state):
                before[state] = min(before[state], c + cost[nxt])
        cost = before
    return cost


def _direct(rows: list[Row], lo: int, hi: int, entry: int, exit_state: int | None) -> str:
    """The least audit of a short range, by a forward pass that keeps whole edit strings."""
    best: list[tuple | None] = [None] * 4
    best[entry] = (0, "")
    for i in range(lo, hi):
        after: list[tuple | None] = [None] * 4
        for state, b in enumerate(best):
            if b is None:
                continue
            for nxt, c, letters in rows[i].segments(state):
                candidate = (b[0] + c, b[1] + letters)
                if after[nxt] is None or candidate < after[nxt]:
                    after[nxt] = candidate
        best = after
    if exit_state is not None:
        return best[exit_state][1]
    ends = [(b[0] + END[s][0], b[1] + END[s][1]) for s, b in enumerate(best) if b]
    return min(ends)[1]


def _solve(rows: list[Row], lo: int, hi: int, entry: int, exit_state: int | None, out: list[str]) -> None:
    if hi - lo <= DIRECT_ROWS:
        out.append(_direct(rows, lo, hi, entry, exit_state))
        return
    mid = (lo + hi) // 2
    forward, rank = _forward(rows, lo, mid, entry)
    backward = _backward(rows, mid, hi, exit_state)
    total = min(f + b for f, b in zip(forward, backward))
    crossing = min((rank[s], s) for s in range(4) if forward[s] + backward[s] == total)[1]
    _solve(rows, lo, mid, entry, crossing, out)
    _solve(rows, mid, hi, crossing, exit_state, out)


def cheapest_audit(rows: list[Row]) -> str:
    """The ASCII-least audit among edit sequences of least cost; all rows are consumed, trailing inserts last."""
    out: list[str] = []
    _solve(rows, 0, len(rows), START, None, out)
    return "".join(out)


def replay(audit: str, rows: list[tuple[str, str, bool]]) -> tuple[int, list[str]]:
    """Apply an audit to (role, text, truncated) rows in order: cost and the repaired ``role:text`` lines.

    ``rows`` lists every copy; a forced row's copies each take one D of the audit. A truncated row that stays adds
    its penalty.
    """
    state, cost, lines, i = START, 0, [], 0
    for letter in audit:
        if letter == "I":
            state = _inserted(state)
            lines.append(("assistant" if state == AFTER_A else "user") + ":")
            cost += INSERT
            continue
        role, text, truncated = rows[i]
        i += 1
        if letter == "D":
            cost += DELETE
            continue
        if letter == "K":
            state = _step(state, role[:1])
            lines.append(f"{role}:{text}")
        else:
            state = _inserted(state)
            lines.append(("assistant" if state == AFTER_A else "user") + f":{text}")
            cost += REROLE
        cost += TRUNCATED if truncated else 0
    return cost, lines


FIELDS = ("turn", "role", "text", "copies", "is_blank", "first", "is_truncated")


def repair_group(rows: list[tuple]) -> dict:
    """Counts, audit and repaired hash of one conversation from its combined rows (see ``damaged``), in order.

    Each row is (turn, role, text, copies, is_blank, first, is_truncated). An empty conversation has zeros, an empty
    audit and the hash of the empty string.
    """
    runs: list[Row] = []
    expanded: list[tuple[str, str, bool]] = []
    blank = duplicate = truncated = illegal = 0
    previous = None
    turns = set()
    for turn, role, text, copies, is_blank, first, is_truncated in rows:
        if turn is not None:
            turns.add(turn)
        initial = role[:1]
        if previous is not None and previous + initial not in LEGAL_PAIRS:
            illegal += 1
        if initial + initial not in LEGAL_PAIRS:
            illegal += copies - 1
        previous = initial
        if is_blank:
            blank += copies
            runs.append(Row(initial, True, False, copies))
            expanded.extend([(role, text, False)] * copies)
            continue
        live = bool(first)
        duplicate += copies - live
        if live:
            truncated += bool(is_truncated)
            runs.append(Row(initial, False, bool(is_truncated)))
            expanded.append((role, text, bool(is_truncated)))
        if copies - live:
            runs.append(Row(initial, True, False, copies - live))
            expanded.extend([(role, text, False)] * (copies - live))
    audit = cheapest_audit(runs) if runs else ""
    cost, lines = replay(audit, expanded)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal,
        "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode("utf-8")).hexdigest(),
        "n_rows": len(expanded), "n_repaired": len(lines),
    }


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations arrive sorted and whole inside a partition; one may run on across batches."""
    key, rows, out = None, None, []

    def close():
        out.append(repair_group(rows) | {"conv_id": key})

    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("conv_id", *FIELDS)]
        for conv_id, *row in zip(*columns):
            if rows is None or conv_id != key:
                if rows is not None:
                    close()
                key, rows = conv_id, []
            if row[3] > 0:
                rows.append(tuple(row))
        if len(out) >= 1024:
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
            out = []
    if rows is not None:
        close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)


_SCHEMA = pa.schema(
    [("conv_id", pa.int64())]
    + [(name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string()), ("n_rows", pa.int64()), ("n_repaired", pa.int64())]
)


def damage_code(conv_id: Column, turn: Column) -> Column:
    """crc32 of ``conv_id:turn`` modulo 20, nulls written as one space."""
    key = F.concat(F.coalesce(conv_id.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    return crc_mod(key, 20)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage, identical copies combined into one row with their number.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it with the same turn, 4 makes its role
    user. Null role and text are one space. Every original conv_id keeps a row with ``copies`` 0, so conversations
    that lose all rows still appear. ``first`` tells whether no earlier row of the conversation has the same role
    and text; ``is_blank`` and ``is_truncated`` are the faults of the text.
    """
    code = damage_code(F.col("conv_id"), F.col("turn"))
    text = F.coalesce(F.col("text"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(code == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
        F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("n"),
    )
    combined = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("copies"))
    order = F.struct(F.col("turn").isNotNull().alias("has_turn"), F.col("turn").alias("turn"))
    live = combined.filter("copies > 0")
    firsts = live.groupBy(F.col("conv_id").alias("_cid"), F.col("role").alias("_role"), F.col("text").alias("_text")).agg(
        F.min(order).alias("first_order")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_cid")) & (F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text"))
    flagged = live.join(firsts, same, "left").select(
        "conv_id", "turn", "role", "text", "copies",
        F.col("turn").isNotNull().alias("has_turn"),
        (order == F.col("first_order")).alias("first"),
        F.col("text").rlike(BLANK).alias("is_blank"),
        (~F.col("text").rlike(LAST_MARK)).alias("is_truncated"),
    )
    kept = flagged.select(F.col("conv_id").alias("_cid")).distinct()
    lost = (
        combined.select("conv_id").distinct().join(kept, F.col("conv_id").eqNullSafe(F.col("_cid")), "left_anti")
        .select(
            "conv_id", F.lit(None).cast("long").alias("turn"), F.lit(" ").alias("role"), F.lit(" ").alias("text"),
            F.lit(0).cast("long").alias("copies"), F.lit(False).alias("has_turn"), F.lit(True).alias("first"),
            F.lit(True).alias("is_blank"), F.lit(False).alias("is_truncated"),
        )
    )
    return flagged.unionByName(lost)


def repair(conversations: DataFrame) -> DataFrame:
    """One row per original conv_id (a null id is one conversation): fault counts, cost, audit and repaired hash.

    ``gaps`` counts turns missing between the least and greatest turn after damage (all null: 0); ``illegal`` counts
    adjacent rows whose role initials are not su, ua or au. The columns of the input besides conv_id, turn, role and
    text are ignored.
    """
    ordered = damaged(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "has_turn", "turn", "role", "text")
    return ordered.mapInArrow(_repair, OUTPUT)
