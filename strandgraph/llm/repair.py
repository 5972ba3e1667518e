"""Conversation structure repair by lazy weighted determinisation.

A conversation is a word over its rows' symbols, and the legal shape ``(s?(ua)+)?`` an automaton of
four states. Repair is a cheapest path through it, whose edits are weighted arcs; insertions are arcs
that read no row. Read from the last row to the first, the vector of costs to the end from
each of the four states is normalised by its least entry, and such vectors are the states of a deterministic
automaton. It is built as rows ask for it: a transition is computed once and cached in a table, after which a
row costs one look-up. Their number is bounded, since no two of the four states differ by more than a few edits.

The scan gives the cost of the whole conversation. The trace goes back the other way, from the first row
to the last, along arcs that are tight, that is whose cost and remaining cost add up; taking the
smallest letter at each step gives the smallest of all cheapest audits, since in every state each letter leads to one arc. The choices
depend on the scan's state, the symbol and the state reached, so they are cached too.

Spark orders the rows by ranges of (conversation, turn), so a long conversation is sorted by several
tasks. Faults are found by columns and a grouping by text digests. Two streams over rows sorted by
conversation follow: the first holds some ten bytes a row of a conversation and no text, the second hashes the
repaired lines as they pass and holds the audit, a letter a row. A conversation's digest is one chain over its lines, and so
one task's work, but its texts are never held.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.common import col, discard, stored

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after s, after u, after a. The role that each state takes next, and where it leads.
WANTED = "uuau"
AFTER = (2, 2, 3, 2)
INITIALS = "usa"
ROLE = {"u": "user", "a": "assistant"}
#: Spaces, and characters that end a complete text.
GAP, STOPS = r"[^\x20\x09-\x0D]", "[.!?]"
FAULTS = (None, "blank", "duplicate", "truncated")
EMPTY = hashlib.sha256(b"").hexdigest()


def keep(state: int, initial: str) -> int | None:
    """The state after keeping a row of this role initial; None where the shape does not allow it."""
    if initial == "s":
        return 1 if state == 0 else None
    return AFTER[state] if initial == WANTED[state] else None


def symbol(initial: str, fault: str | None) -> int:
    """0 for a row that has to go; else 1 + 2 x its initial + 1 if it is truncated."""
    if fault in ("blank", "duplicate"):
        return 0
    return 1 + 2 * (INITIALS.find(initial) if initial else -1) + 2 + (fault == "truncated")


class Determinised:
    """The deterministic automaton as far as it has been asked for."""

    def __init__(self) -> None:
        self.vectors = [self._closed([0, 4, 2, 0])]
        self.number = {self.vectors[0]: 0}
        self.next: list[list[tuple[int, int] | None]] = [[None] * 10]
        self.steps: dict[tuple[int, int, int], tuple[str, int]] = {}

    @staticmethod
    def _closed(costs: list[int]) -> tuple[int, ...]:
        for _ in range(2):
            costs = [min(c, INSERT + costs[AFTER[q]]) for q, c in enumerate(costs)]
        return tuple(costs)

    def arcs(self, after: tuple[int, ...], sym: int, state: int) -> list[tuple[str, int, int]]:
        """``(letter, next state, cost to the end)`` of the edits of a row in ``state``; ``after`` has the costs behind it."""
        out = [("D", state, DELETE + after[state])]
        if sym:
            initial, extra = ("", *INITIALS)[(sym - 1) // 2], (sym - 1) % 2
            kept = keep(state, initial)
            if kept is not None:
                out.append(("K", kept, extra * TRUNCATED + after[kept]))
            out.append(("R", AFTER[state], REROLE + extra * TRUNCATED + after[AFTER[state]]))
        return out

    def step(self, vector: int, sym: int) -> tuple[int, int]:
        """``(vector before the row, cost taken out of it)`` for the vector behind it; kept in the table."""
        known = self.next[vector][sym]
        if known is None:
            after = self.vectors[vector]
            costs = self._closed([min(c for _, _, c in self.arcs(after, sym, q)) for q in range(4)])
            least = min(costs)
            costs = tuple(c - least for c in costs)
            if costs not in self.number:
                self.number[costs] = len(self.vectors)
                self.vectors.append(costs)
                self.next.append([None] * 10)
            known = self.next[vector][sym] = (self.number[costs], least)
        return known

    def choice(self, vector: int, sym: int, state: int) -> tuple[str, int]:
        """``(insertions and the row's letter, state behind it)``: the tight arcs of the smallest letters."""
        known = self.steps.get((vector, sym, state))
        if known is None:
            after, here, letters = self.vectors[vector], state, ""
            costs = self._closed([min(c for _, _, c in self.arcs(after, sym, q)) for q in range(4)])
            while True:
                tight = [(letter, to) for letter, to, c in self.arcs(after, sym, here) if c == costs[here]]
                if INSERT + costs[AFTER[here]] == costs[here]:
                    tight.append(("I", AFTER[here]))
                letter, here = min(tight)
                letters += letter
                if letter != "I":
                    break
            known = self.steps[vector, sym, state] = (letters, here)
        return known

    def repair(self, symbols: bytes) -> tuple[int, Iterator[tuple[int, str]]]:
        """The cost of the rows ``symbols``, and per row ``(state before, its letters)``, at last ``(state, closing insertions)``."""
        vector, cost, behind = 0, 0, array("H", bytes(2 * len(symbols)))
        table = self.next
        for k in range(len(symbols) - 1, -1, -1):
            behind[k] = vector
            vector, least = table[vector][symbols[k]] or self.step(vector, symbols[k])
            cost += least

        def trace() -> Iterator[tuple[int, str]]:
            state = 0
            for at, sym in zip(behind, symbols, strict=True):
                letters, to = self.choice(at, sym, state)
                yield state, letters
                state = to
            yield state, "I" * (0, 2, 1, 0)[state]

        return cost + self.vectors[vector][0], trace()


def damaged(conversations: DataFrame, conv: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """``(conv, turn, role, text, copy)``: rows dropped, emptied, robbed of their stops, repeated or given to the user, by a checksum."""
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat_ws(":", space(conv), space(turn)).cast("binary")) % 20).alias("kind")
    rows = conversations.select(conv.alias("conv"), turn.alias("turn"), space(role).alias("role"), space(text).alias("text"), kind).filter("kind <> 0")
    new = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", STOPS, "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 3, 1).otherwise(0))).alias("copy")
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), new.alias("text"), copies)


def faults(rows: DataFrame) -> DataFrame:
    """``(conv, pos, turn, initial, fault)`` of the rows ``(conv, pos, turn, role, text)``."""
    last = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), -1, 1)
    digest = F.sha2(F.encode("text", "utf-8"), 256)
    first = rows.groupBy("conv", "role", digest.alias("digest")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(~F.col("text").rlike(GAP), "blank").when(F.col("first").isNull(), "duplicate").when(~last.rlike(STOPS), "truncated")
    return rows.join(first, "pos", "left").select("conv", "pos", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(pos, fault, state, letters, closing, cost)`` of each row; closing and cost stand with the last row of a conversation."""
    machine, out = Determinised(), []
    for _, rows in groupby(_rows(batches), itemgetter(0)):
        positions, symbols, kinds = array("q"), bytearray(), bytearray()
        for _, pos, initial, fault in rows:
            positions.append(pos)
            symbols.append(symbol(initial, fault))
            kinds.append(FAULTS.index(fault))
        cost, trace = machine.repair(bytes(symbols))
        for k, pos in enumerate(positions):
            state, letters = next(trace)
            end = (next(trace)[1], cost) if k == len(positions) - 1 else (None, None)
            out.append((pos, FAULTS[kinds[k]], state, letters, *end))
            if len(out) == 10_000:
                yield _decisions(out)
                out = []
    if out:
        yield _decisions(out)


def _decisions(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["pos", "fault", "state", "letters", "closing", "cost"])


def _inserted(state: int, n: int) -> tuple[list[str], int]:
    roles = []
    for _ in range(n):
        roles.append(ROLE[WANTED[state]])
        state = AFTER[state]
    return roles, state


def repaired_lines(state: int, letters: str, role: str, text: str) -> tuple[list[str], int]:
    """The lines ``role:text`` that a row's letters leave, insertions before it and the row itself unless deleted, and the state behind it."""
    roles, state = _inserted(state, len(letters) - 1)
    lines = [f"{r}:" for r in roles]
    if letters[-1] == "K":
        return [*lines, f"{role}:{text}"], keep(state, role[:1])
    if letters[-1] == "R":
        return [*lines, f"{ROLE[WANTED[state]]}:{text}"], AFTER[state]
    return lines, state


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation; rows come in order with their fault and decision."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds, out = [None, *[pa.int64()] * 6, pa.string(), pa.string()], []

    def typed() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds[0] = batch.column(0).type
            yield batch

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for conv, rows in groupby(_rows(typed()), itemgetter(0)):
        counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        turns, low, high, illegal, before, cost = 0, None, None, 0, None, 0
        audit, digest, begun = bytearray(), hashlib.sha256(), False
        for _, turn, role, text, fault, state, letters, closing, own in rows:
            if fault:
                counts[fault] += 1
            if turn is not None:
                low = turn if low is None else low
                turns += turn != high
                high = turn
            illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
            lines, end = repaired_lines(state, letters, role, text)
            if closing is not None:
                lines += [f"{r}:" for r in _inserted(end, len(closing))[0]]
                letters, cost = letters + closing, own
            for line in lines:
                digest.update(b"\n" * begun + line.encode())
                begun = True
            audit += letters.encode()
        gaps = 0 if low is None else high - low + 1 - turns
        out.append((conv, gaps, *counts.values(), illegal, cost, audit.decode(), digest.hexdigest()))
        if len(out) == 1000:
            yield packed()
            out = []
    if out:
        yield packed()


def repair_decisions(rows: DataFrame) -> DataFrame:
    """``rows(conv, pos, turn, role, text)`` with fault, state, letters, closing and cost: every edit of the cheapest repair.

    pos: the rows' order. state: of the shape before the row; letters: insertions before the row and its own edit; closing:
    insertions after the last row of a conversation, which has the cost of all.
    """
    ordered = faults(rows).select("conv", "pos", "initial", "fault").repartition("conv").sortWithinPartitions("conv", "pos")
    decided = ordered.mapInArrow(_decide, "pos long, fault string, state int, letters string, closing string, cost long")
    return rows.join(decided, "pos")


def repair_conversations(
    conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = True
) -> DataFrame:
    """One row per id: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows are taken by turn, nulls first, those of one turn by role and text. Null roles and texts
    count as one space, a null id is a conversation of its own. A role without letters can not be kept. A conversation
    without rows (all were dropped) has zeros, an empty audit and the digest of nothing; an empty
    table gives no rows. Texts may be of any length, other columns and their names play no part. Ids may be of any simple
    type; turns are whole numbers. ``damage`` of False repairs the rows as they are.
    """
    conv, turn, role, text = col(id_col), col(turn_col).cast("long"), col(role_col), col(text_col)
    if damage:
        rows = damaged(conversations, conv, turn, role, text)
    else:
        space = lambda c, name: F.coalesce(c.cast("string"), F.lit(" ")).alias(name)
        rows = conversations.select(conv.alias("conv"), turn.alias("turn"), space(role, "role"), space(text, "text"), F.lit(0).alias("copy"))
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text", "copy"]
    ranged = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")), "ranged")
    decided = repair_decisions(ranged).select("conv", "turn", "role", "text", "fault", "state", "letters", "closing", "cost", "pos")
    kind = conversations.schema[id_col].dataType
    lines = decided.repartition("conv").sortWithinPartitions("conv", "pos").drop("pos")
    shape = f"conv {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    digests = stored(lines.mapInArrow(_digest, shape), "digests")
    discard(ranged)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = conversations.select(conv.alias("of")).distinct()
    joined = every.join(digests, F.col("of").eqNullSafe(F.col("conv")), "left")
    return joined.select(
        F.col("of").alias(id_col), *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256")
    )
