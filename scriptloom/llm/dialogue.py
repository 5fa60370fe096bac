"""Conversations repaired at least cost, by composed weighted machines.

Three machines describe a repair. The input acceptor reads a conversation row by row. The edit
transducer keeps a row, gives it another role, deletes it, or inserts a turn, at the costs in
``COSTS``. The grammar acceptor takes the roles that come out: (s?(ua)+)?, a system turn at most,
then user and assistant in turns. Their composition is made lazily: only arcs out of states that
a row has reached are ever built (``arcs``). The shortest path is taken in topological order, row
by row, over weights (cost, labels) that compare by cost and then by the string of labels; two
equally dear paths between the same states never have labels of which one begins the other, as
any further label costs something, so the smaller stays smaller whatever follows.

A long conversation is no task of its own. Rows are dealt by range of (conversation, turn), and a
part of a conversation becomes a table of the best paths from each grammar state to each. Such
tables are multiplied in order, inside a part ``ROWS_A_TABLE`` rows at a time and then over parts.
Only the digest of a repaired text, which is serial by definition, reads a long conversation in
one stream, which holds one row at a time.

Null conversations, roles and texts count as one space: rows of a null conversation are one
conversation. Rows go by turn, null turns first, then role, then text, so repeated rows are next to
each other. A conversation without rows has no row. Columns that are not named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import map_arrow
from .components import BROADCAST_ROWS, joined

#: States of the grammar: nothing yet, after a system, a user, an assistant turn; where it may end.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: The role that a changed or inserted turn takes in each state: only one of the two leads on.
ROLE = ("user", "user", "assistant", "user")
#: K keep, R give another role, D delete, I insert.
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
#: What a row that stays costs besides if its text breaks off.
TRUNCATED = 1
SPACE = " \t\n\v\f\r"

#: Rows of one table of paths before it is multiplied, and characters of a conversation that a task holds for its digest.
ROWS_A_TABLE, HELD_CHARS = 256, 4_000_000

Paths = dict[int, tuple[int, str]]


@dataclass(frozen=True)
class Row:
    """What the edit transducer sees of a row: the first letter of its role, whether it must go, whether it breaks off."""

    initial: str
    must_go: bool
    broken: bool


def arcs(row: Row, state: int) -> Iterator[tuple[str, int, int]]:
    """(label, cost, next state) of the arcs of the composition that consume a row in a grammar state."""
    yield "D", COSTS["D"], state
    if not row.must_go:
        more = TRUNCATED * row.broken
        if row.initial in GRAMMAR[state]:
            yield "K", COSTS["K"] + more, GRAMMAR[state][row.initial]
        yield "R", COSTS["R"] + more, GRAMMAR[state][ROLE[state][0]]


def _inserted(paths: Paths) -> Paths:
    """Paths with turns inserted after them. Two at most lead to every state; a third repeats a state."""
    paths = dict(paths)
    for _ in range(2):
        for state, (cost, labels) in list(paths.items()):
            to, found = GRAMMAR[state][ROLE[state][0]], (cost + COSTS["I"], labels + "I")
            if to not in paths or found < paths[to]:
                paths[to] = found
    return paths


def _over(paths: Paths, row: Row) -> Paths:
    """Best paths one row on."""
    out: Paths = {}
    for state, (cost, labels) in _inserted(paths).items():
        for label, more, to in arcs(row, state):
            found = cost + more, labels + label
            if to not in out or found < out[to]:
                out[to] = found
    return out


def table_of(rows: list[Row], entries: tuple[int, ...]) -> dict[int, Paths]:
    """The best paths over some rows, from each entry state to each state."""
    table = {}
    for entry in entries:
        paths: Paths = {entry: (0, "")}
        for row in rows:
            paths = _over(paths, row)
        table[entry] = _inserted(paths)
    return table


def times(first: dict[int, Paths], then: dict[int, Paths]) -> dict[int, Paths]:
    """The table over the rows of both; ``then`` has every state that ``first`` can reach."""
    out = {}
    for entry, paths in first.items():
        best: Paths = {}
        for middle, (cost, labels) in paths.items():
            for to, (more, further) in then[middle].items():
                found = cost + more, labels + further
                if to not in best or found < best[to]:
                    best[to] = found
        out[entry] = best
    return out


@dataclass
class Part:
    """Some rows of a conversation in order: counts, first and last letters and turns, tables of paths."""

    entries: tuple[int, ...] = (0,)
    rows_a_table: int = ROWS_A_TABLE
    n: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str = ""
    last: str = ""
    low: int | None = None
    high: int | None = None
    turns: int = 0
    rows: list[Row] = field(default_factory=list)
    stack: list[tuple[int, dict[int, Paths]]] = field(default_factory=list)

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        said = text.strip(SPACE)
        fault = "blank" if not said else "duplicate" if again else "truncated" if said[-1] not in ".!?" else ""
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        initial = role[:1]
        if self.n:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last = initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.n += 1
        self.rows.append(Row(initial, fault in ("blank", "duplicate"), fault == "truncated"))
        if len(self.rows) == self.rows_a_table:
            self._close()

    def _close(self) -> None:
        """Rows become a table; tables over as many rows are multiplied, so labels are copied a few times only."""
        entries = (0, 1, 2, 3) if self.stack else self.entries
        self.stack.append((1, table_of(self.rows, entries)))
        self.rows = []
        while len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
            (size, then), (_, first) = self.stack.pop(), self.stack.pop()
            self.stack.append((2 * size, times(first, then)))

    def table(self) -> dict[int, Paths]:
        if self.rows or not self.stack:
            self._close()
        *rest, (_, whole) = self.stack
        for _, first in reversed(rest):
            whole = times(first, whole)
        return whole


LEGAL = ("su", "ua", "au")


def best_of(table: dict[int, Paths]) -> tuple[int, str]:
    """The cheapest accepted path from the start; there is one, as all rows can be deleted."""
    return min(table[0][state] for state in FINAL if state in table[0])


class Repaired:
    """Takes the rows of a conversation in order, with its labels, and gives the turns that come out."""

    def __init__(self, labels: str):
        self.labels, self.at, self.state = labels, 0, 0

    def _turn(self, initial: str) -> None:
        self.state = GRAMMAR[self.state][initial]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """(label, role, text) of the turns that stand before the next row, or at the end."""
        while self.at < len(self.labels) and self.labels[self.at] == "I":
            role = ROLE[self.state]
            self.at += 1
            self._turn(role[0])
            yield "I", role, ""

    def take(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        label = self.labels[self.at]
        self.at += 1
        if label != "D":
            role = ROLE[self.state] if label == "R" else role
            self._turn(role[:1])
            yield label, role, text


class _Digest:
    """SHA-256 of lines role:text, joined by line feeds."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def add(self, turns: Iterator[tuple[str, str, str]]) -> None:
        for _, role, text in turns:
            self.hash.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "replace"))
            self.any = True


_FOUND = "ck string, part int, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, costs array<int>, labels array<string>, cost long, audit string, sha string"
_COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")


def _batch(rows: list[dict], kinds: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.record_batch({name: pa.array([r.get(name) for r in rows], types[kind]) for name, kind in (c.split(" ") for c in kinds.split(", "))})


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _summarise(rows_a_table: int, held_chars: int):
    """Ordered rows of one range to a row for each conversation in it.

    The first and the last may go on in other ranges: they have the tables from every state and
    no digest, and so has one whose texts are too long to hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        part, ck, held, size, before, opening, number = Part((0, 1, 2, 3), rows_a_table), None, [], 0, None, True, 0

        def close(ending: bool) -> None:
            table = part.table()
            row = {"ck": ck, "part": number} | {c: getattr(part, c) for c in _COUNTS}
            if opening or ending or held is None:
                entries = [(e, to) for e in range(4) for to in range(4)]
                cells = [table.get(e, {}).get(to, (-1, "")) for e, to in entries]
                row |= {"costs": [c for c, _ in cells], "labels": [x for _, x in cells]}
            else:
                cost, audit = best_of(table)
                digest, repaired = _Digest(), Repaired(audit)
                for role, text in held:
                    digest.add(repaired.take(role, text))
                digest.add(repaired.inserted())
                row |= {"cost": cost, "audit": audit, "sha": digest.hash.hexdigest()}
            out.append(row)

        for r in _rows_of(batches):
            if r["ck"] != ck:
                if ck is not None:
                    close(False)
                    opening = False
                    part, held, size, before = Part((0,), rows_a_table), [], 0, None
                    if len(out) >= 1000:
                        yield _batch(out, _FOUND)
                        out.clear()
                ck, number = r["ck"], r["part"]
            now = r["turn"], r["role"], r["text"]
            part.add(*now, r["later"] or now == before)
            before = now
            if held is not None:
                held.append(now[1:])
                size += len(now[2])
                if size > held_chars or opening:
                    held = None
        if ck is not None:
            close(True)
        if out:
            yield _batch(out, _FOUND)

    return run


def _joined_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations, ordered by (ck, part), to one row for each conversation, without its digest."""
    whole: dict | None = None

    def done(row: dict) -> pa.RecordBatch:
        row["cost"], row["audit"] = best_of({0: row["paths"]})
        return _batch([row], _FOUND)

    for r in _rows_of(batches):
        cells = [(c, x) if c >= 0 else None for c, x in zip(r["costs"], r["labels"])]
        table = {e: {to: cells[4 * e + to] for to in range(4) if cells[4 * e + to]} for e in range(4)}
        if whole is None or r["ck"] != whole["ck"]:
            if whole:
                yield done(whole)
            whole = r | {"paths": table[0], "costs": None, "labels": None}
            continue
        whole["illegal"] += whole["last"] + r["first"] not in LEGAL
        whole["turns"] -= r["low"] is not None and r["low"] == whole["high"]
        for c in ("n", "blank", "duplicate", "truncated", "illegal", "turns"):
            whole[c] += r[c]
        whole["last"], whole["low"] = r["last"], r["low"] if whole["low"] is None else whole["low"]
        whole["high"] = whole["high"] if r["high"] is None else r["high"]
        whole["paths"] = times({0: whole["paths"]}, table)[0]
    if whole:
        yield done(whole)


def _key(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def _with_key(rows: DataFrame, conv_col: str) -> DataFrame:
    return rows.select(_key(F.col(conv_col)).alias("ck"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))


def repaired_turns(rows: DataFrame, audits: DataFrame, conv_col: str = "conv_id", digest: bool = False) -> DataFrame:
    """(conversation, place, edit, role, text): the turns that come out, by the audits of ``audit``.

    Rows of conversations without an audit are left out. With ``digest``: (conversation, sha)
    instead, the SHA-256 of each repaired conversation's lines role:text. The rows of a
    conversation pass one task as a stream, of which one row and the audit are held.
    """
    keyed = _with_key(rows, conv_col).select("ck", F.lit(1).alias("kind"), "turn", "role", "text")
    known = audits.select(_key(F.col(conv_col)).alias("ck"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = keyed.unionByName(known).repartition("ck").sortWithinPartitions("ck", "kind", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ck, repaired, hashed, place, out = None, None, None, 0, []
        kinds = "ck string, sha string" if digest else "ck string, place long, edit string, role string, text string"

        def note(turns: Iterator[tuple[str, str, str]]) -> None:
            nonlocal place
            if digest:
                return hashed.add(turns)
            for edit, role, text in turns:
                out.append({"ck": ck, "place": place, "edit": edit, "role": role, "text": text})
                place += 1

        for r in _rows_of(batches):
            if r["kind"] == 0 or r["ck"] != ck:
                if repaired:
                    note(repaired.inserted())
                    if digest:
                        out.append({"ck": ck, "sha": hashed.hash.hexdigest()})
                ck, repaired, hashed, place = r["ck"], Repaired(r["text"]) if r["kind"] == 0 else None, _Digest(), 0
            elif repaired:
                note(repaired.take(r["role"], r["text"]))
            if len(out) >= 256:
                yield _batch(out, kinds)
                out = []
        if repaired:
            note(repaired.inserted())
            if digest:
                out.append({"ck": ck, "sha": hashed.hash.hexdigest()})
        yield _batch(out, kinds)

    type_of = dict(rows.dtypes)[conv_col]
    found = map_arrow(stream, run, "ck string, sha string" if digest else "ck string, place long, edit string, role string, text string")
    return found.select(F.expr(f"try_cast(ck AS {type_of})").alias(conv_col), *found.columns[1:])


def audit(rows: DataFrame, conv_col: str = "conv_id", limit: int = BROADCAST_ROWS, rows_a_table: int = ROWS_A_TABLE, held_chars: int = HELD_CHARS) -> DataFrame:
    """(conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each.

    rows: conversation, turn, role, text. The first fault of a row counts: blank; duplicate, its
    role and text seen in an earlier row; truncated, its text ends in no full stop, exclamation or
    question mark. illegal: neighbours whose initials are not su, ua or au. gaps: turns missing
    between the least and the greatest. audit: the labels of the cheapest repair, of equally cheap
    ones the least string.
    """
    type_of = dict(rows.dtypes)[conv_col]
    keyed = _with_key(rows, conv_col).withColumn("digest", F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256)))
    # texts that one conversation has in several turns; equal rows of one turn meet when they are sorted
    null = F.col("turn").isNull()
    seen = keyed.groupBy("ck", "digest").agg(F.max(null).alias("nulls"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    seen = durable(seen.where("low < high or (nulls and low is not null)"))
    marked = joined(keyed, seen, ["ck", "digest"], seen.count(), "left", limit=limit)
    later = F.coalesce(~null & (F.col("nulls") | (F.col("turn") > F.col("low"))), F.lit(False))
    order = ("ck", "turn", "role", "text")
    dealt = marked.select(*order, later.alias("later")).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = durable(map_arrow(dealt.withColumn("part", F.spark_partition_id()), _summarise(rows_a_table, held_chars), _FOUND))
    open_parts = parts.where("costs is not null").repartition("ck").sortWithinPartitions("ck", "part")
    several = durable(map_arrow(open_parts, _joined_parts, _FOUND))
    streamed = joined(keyed.select("ck", "turn", "role", "text"), several.select("ck"), "ck", several.count(), "left_semi", limit=limit)
    digests = repaired_turns(streamed, several.select("ck", "audit"), "ck", digest=True)
    several = several.drop("sha").join(digests, "ck")
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    found = parts.where("costs is null").unionByName(several)
    return found.select(F.expr(f"try_cast(ck AS {type_of})").alias(conv_col), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def damage(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conversation, turn, role, text): rows with faults made by crc32(conversation:turn) mod 20.

    0 drops a row, 1 empties its text, 2 takes full stops, exclamation and question marks out of
    it, 3 repeats it, 4 makes its role user. Nulls are one space, but for the conversation and turn that are given on.
    """
    code = F.crc32(F.concat(_key(F.col(conv_col)), F.lit(":"), _key(F.col("turn"))).cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(conv_col, "turn", role.alias("role"), text.alias("text"), code.alias("_code")).where("_code <> 0")
    changed = rows.withColumns({"text": F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")), "role": F.when(F.col("_code") == 4, "user").otherwise(F.col("role"))})
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_code") == 3, 2).otherwise(1)))
    return changed.select(conv_col, "turn", "role", "text", copies.alias("_copy")).drop("_copy")


def audit_damaged(conversations: DataFrame, conv_col: str = "conv_id", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``audit`` of ``damage``, with a row of zeros for each conversation of which no row is left."""
    type_of = dict(conversations.dtypes)[conv_col]
    found = audit(damage(conversations, conv_col), conv_col, limit)
    every = conversations.select(_key(F.col(conv_col)).alias("ck")).distinct()
    both = every.join(found.withColumn("ck", _key(F.col(conv_col))).drop(conv_col), "ck", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256))}
    return both.select(F.expr(f"try_cast(ck AS {type_of})").alias(conv_col), *(e.alias(c) for c, e in (zero | empty).items()))
