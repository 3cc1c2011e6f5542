"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``.

The lattice's nodes are (rows consumed, grammar state), its edges the edits Keep, Rerole, Delete and Insert. Dijkstra's
algorithm makes nodes as it meets them, takes them by (cost, audit), where an audit is the edits' initials so far, and stops
at the first accepting end node. Two audits of one node that cost the same are never the beginning of one another (what is
longer has more inserted turns, which cost), so the least audit of a node stays least with whatever follows.

A conversation's rows come in order, a block of them at a time. A block's edges from each state that can still win are
searched alike; what all of the states' best audits have in common is decided, written and forgotten, so that the memory
which a conversation takes doesn't grow with its length.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronlake.llm.common import ddl, map_rows

#: Costs of the edits, and of a truncated row that stays; white space; ends of sentences.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
WHITE, ENDS = " \t\n\v\f\r", ".!?"
#: Rows that are searched together; conversations of so many rows at most, whose answers a task remembers, and how many.
BLOCK, SHORT, KNOWN = 512, 32, 1 << 16
#: Grammar states: nothing yet, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a role's initial, and the role that can be made in a state.
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
MADE = ("user", "user", "assistant", "user")
#: A row's letter: its role's initial (other: o), in upper case if it is truncated; x if it has to be deleted.
GONE, OTHER = "x", "o"


def edges(state: int, row: str) -> Iterator[tuple[str, int, int, int]]:
    """(initial, cost, rows consumed, next state) of the edits in a state before a row; no row at the end."""
    made = AFTER[state][MADE[state][0]]
    yield "I", INSERT, 0, made
    if row:
        yield "D", DELETE, 1, state
        if row != GONE:
            more = TRUNCATED if row.isupper() else 0
            if (to := AFTER[state].get(row.lower())) is not None:
                yield "K", more, 1, to
            yield "R", REROLE + more, 1, made


def cheapest(rows: str, start: int, last: bool) -> tuple[tuple[int, int, str], ...]:
    """(state, cost, audit) at the end of some rows, from a state before them: of the first accepting end if these are the
    last rows, otherwise of every state that can be reached."""
    heap, done, out = [(0, "", 0, start)], set(), []
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows):
            if last and state in (START, ASSISTANT):
                return ((state, cost, audit),)
            if not last:
                out.append((state, cost, audit))
        for name, more, step, to in edges(state, rows[at : at + 1]):
            if (at + step, to) not in done:
                heapq.heappush(heap, (cost + more, audit + name, at + step, to))
    return tuple(out)


known = lru_cache(KNOWN)(cheapest)


class Repair:
    """One conversation: rows go in in order, edited turns come out as soon as they are decided."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, str]] = []  # (letter, role, text) that aren't decided
        self.paths: dict[int, tuple[int, str]] = {START: (0, "")}  # by state: cost, and the undecided part of the audit
        self.searched = 0
        self.state = START  # behind what is decided
        self.cost = 0

    def add(self, letter: str, role: str, text: str) -> Iterator[tuple[str, str | None, str | None]]:
        self.rows.append((letter, role, text))
        if len(self.rows) - self.searched >= 2 * BLOCK:
            yield from self._search(BLOCK, False)

    def end(self) -> Iterator[tuple[str, str | None, str | None]]:
        yield from self._search(len(self.rows) - self.searched, True)

    def _search(self, n: int, last: bool) -> Iterator[tuple[str, str | None, str | None]]:
        letters = "".join([x[0] for x in self.rows[self.searched : self.searched + n]])
        best: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in self.paths.items():
            for to, more, rest in (known if n <= SHORT else cheapest)(letters, state, last):
                best[to] = min(best.get(to, (cost + more, audit + rest)), (cost + more, audit + rest))
        self.searched += n
        if last:
            self.cost, audit = min(best.values())
            yield from self._decided(audit)
            return
        # a state loses if its end can be made from the assistant's at less than it costs: from there all rows can follow
        # that can follow it, but for a system's turn (to be deleted) and the assistant's (after a made user's turn)
        bound = best[ASSISTANT][0] + max(INSERT, DELETE)
        self.paths = {s: x for s, x in best.items() if s == ASSISTANT or x[0] <= bound}
        common = commonprefix([x[1] for x in self.paths.values()])
        yield from self._decided(common)
        self.paths = {s: (c, a[len(common) :]) for s, (c, a) in self.paths.items()}

    def _decided(self, audit: str) -> Iterator[tuple[str, str | None, str | None]]:
        """(edit, role, text) of decided edits; a deleted row has neither role nor text."""
        at = 0
        for name in audit:
            letter, role, text = ("", "", "") if name == "I" else self.rows[at]
            at += name != "I"
            if name == "D":
                yield name, None, None
                continue
            role = role if name == "K" else MADE[self.state]
            self.state = AFTER[self.state][role[0]]
            yield name, role, text
        del self.rows[:at]
        self.searched -= at


def faults(turns: DataFrame, conv: str, turn: str, role: str, text: str, gone: Column | None = None) -> DataFrame:
    """(conv, turn, role, text, fault): rows in order within a partition that holds whole conversations, by turn (nulls
    first), role and text. The fault is blank, duplicate, truncated, none or gone (a row that only names a conversation)."""
    key = F.coalesce(F.col(text), F.lit(" "))
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), key.alias("text"),
        (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    seen = F.row_number().over(W.partitionBy("conv", "gone", "role", "text").orderBy("turn")) > 1
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    cut = ~F.substring(bare, -1, 1).isin(*ENDS)
    fault = F.when(F.col("gone"), "gone").when(bare == "", "blank").when(seen, "duplicate").when(cut, "truncated").otherwise("none")
    rows = rows.repartition("conv").withColumn("fault", fault)
    return rows.sortWithinPartitions("conv", *order, F.col("fault") == "duplicate").select("conv", "turn", "role", "text", "fault")


def letter(role: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return GONE
    own = role[:1] if role[:1] in ("s", "u", "a") else OTHER
    return own.upper() if fault == "truncated" else own


def _walk(rows: DataFrame, schema: str, conversation: Callable) -> DataFrame:
    """The rows that one object for each conversation yields; rows of a conversation follow one another."""

    def make() -> Callable:
        now: list = []

        def some(convs: list, *columns: list):
            for c, *row in zip(convs, *columns, strict=True):
                if not now or now[0] != c:
                    if now:
                        yield from now[1].last()
                    now[:] = [c, conversation(c)]
                yield from now[1].row(*row)

        some.done = lambda: list(now[1].last()) if now else []
        return some

    return map_rows(rows, rows.columns, schema, make)


class _Edits:
    def __init__(self, conv) -> None:
        self.conv, self.repair, self.place, self.turns = conv, Repair(), 0, []

    def row(self, turn, role, text, fault):
        if fault != "gone":
            self.turns.append((turn, fault))
            yield from self._out(self.repair.add(letter(role, fault), role, text))

    def last(self):
        yield from self._out(self.repair.end())

    def _out(self, found):
        at = 0
        for edit, role, text in found:
            turn, fault = (None, None) if edit == "I" else self.turns[at]
            at += edit != "I"
            yield self.conv, self.place, edit, turn, fault, role, text
            self.place += 1
        del self.turns[:at]


class _Report:
    def __init__(self, conv) -> None:
        self.conv, self.repair = conv, Repair()
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first = self.was = self.before = None
        self.distinct = 0
        self.audit: list[str] = []
        self.hash, self.any = hashlib.sha256(), False

    def row(self, turn, role, text, fault):
        if fault == "gone":
            return ()
        if turn is not None and turn != self.was:
            self.first = turn if self.first is None else self.first
            self.was, self.distinct = turn, self.distinct + 1
        if fault in self.n:
            self.n[fault] += 1
        self.n["illegal"] += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self._take(self.repair.add(letter(role, fault), role, text))
        return ()

    def _take(self, found) -> None:
        for edit, role, text in found:
            self.audit.append(edit)
            if edit != "D":
                self.hash.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode())
                self.any = True

    def last(self):
        self._take(self.repair.end())
        gaps = 0 if self.first is None else min(self.was - self.first + 1 - self.distinct, 2**63 - 1)
        yield self.conv, gaps, *self.n.values(), self.repair.cost, "".join(self.audit), self.hash.hexdigest()


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """The edits of each conversation, in order: (conv, place long, edit, turn, fault, role, text).

    edit is K, R, D or I. role and text are those after the edit, null for a deleted row; turn and fault (blank, duplicate,
    truncated or none) are of the row that it concerns, null for an inserted turn. Rows are taken by turn, a null one first,
    then by role and text, so rows that tie have one order; repeated rows are duplicates. A null role or text is a space; the
    rows of the null conversation are one conversation. Rows that ``gone`` marks only name their conversation. Other columns
    are ignored, whatever they are called; no rows give none. A conversation's rows are shuffled and sorted together once,
    and streamed: neither rows nor edits of a whole conversation are held.
    """
    kinds = f"{ddl(turns.select(F.col(conv)), conv)}, place bigint, edit string, {ddl(turns.select(F.col(turn).alias('turn')), 'turn')}, fault string, role string, text string"
    return _walk(faults(turns, conv, turn, role, text, gone), kinds, _Edits)


def reports(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """One row for each conversation: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    Rows, ties and nulls as in :func:`repaired`. gaps are the whole turns missing between the least and the greatest (none
    without a turn, at most 2^63 - 1); illegal are neighbours whose roles can't follow one another; cost and audit are of the
    edits, and the hash of the repaired turns, ``role:text`` in lines. A conversation without rows has zeros, an empty audit
    and the hash of nothing.
    """
    counts = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return _walk(faults(turns, conv, turn, role, text, gone), f"{ddl(turns.select(F.col(conv)), conv)}, {counts}", _Report)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 marks a row as gone, 1 empties its text,
    2 takes the ends of sentences from it, 3 repeats it, 4 gives it to the user. Nulls are a space."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.encode(F.concat(shown[0], F.lit(":"), shown[1]), "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown[3], ENDS, "")).otherwise(shown[3])
    role = F.when(kind == 4, "user").otherwise(shown[2])
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), kind.alias("kind"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "copy")
