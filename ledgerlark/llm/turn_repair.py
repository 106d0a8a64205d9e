"""Repair of conversations: cheapest edits that give a legal order of roles.

Rows are dealt by hash of the conversation and sorted; a task reads them as a
stream and repairs a batch of conversations with one recursive DuckDB query.
Each recursion advances one turn of all conversations of the batch and keeps,
for each grammar state, the cheapest edits with the least audit. A conversation
that goes on in the next batch starts there from the states that it had reached,
with a running digest for each of them, so a task holds one batch of rows
whatever the length of a conversation. One conversation is read by one task,
since a SHA-256 digest of the whole can only be taken in order.

Grammar states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant;
legal ends are 0 and 3. Two edits that stay in one state at one cost after one
row never are prefixes of one another (inserts cost), so the least audit of the
whole is made of least audits of its beginnings.

Defined results: rows of a conversation are ordered by turn (null first), then
role, then text; null role or text is one space, so a null text is blank and a
null role no role; a null id is a conversation of its own; empty texts are
blank; repeated rows are duplicates of the first; very long texts are read
whole; an empty table gives an empty table; other columns are ignored; ids and
turns must be integers or null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import by_bytes

ROWS_AT_ONCE = 10_000
WORD = r"[^\x20\x09-\x0D]"
LAST_IS_NO_END = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
LEGAL_PAIRS = ("su", "ua", "au")
OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: state after the user or assistant turn that must come next
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def row_code(initial: str, fault: str) -> str:
    """One letter for what the grammar sees of a row: which role, and whether it must go or is truncated."""
    if fault in ("blank", "duplicate"):
        return "x"
    role = initial if initial in ("s", "u", "a") else "o"
    return role.upper() if fault == "truncated" else role


def moves() -> list[tuple[str, int, int, int, str]]:
    """(row code, state before, state after, cost, letters of the edits) of every way over one row; ``-`` is the end."""
    out = []
    for before in range(4):
        for mid, paid, audit in ((before, 0, ""), (_NEXT[before], 3, "I")):
            if mid in (0, 3):
                out.append(("-", before, mid, paid, audit))
            for code in "xsuaoSUAO":
                out.append((code, before, mid, paid + 4, audit + "D"))
                if code == "x":
                    continue
                more = 3 if code.isupper() else 0
                kept = _AFTER.get((mid, code.lower()))
                if kept is not None:
                    out.append((code, before, kept, paid + more, audit + "K"))
                out.append((code, before, _NEXT[mid], paid + 3 + more, audit + "R"))
    return out


REPAIR_SQL = """
    WITH RECURSIVE best AS (
        SELECT part, entry, 0 AS k, entry AS state, {'cost': 0, 'audit': ''} AS way FROM starts
        UNION ALL
        SELECT b.part, b.entry, b.k + 1, m.after, min({'cost': b.way.cost + m.cost, 'audit': b.way.audit || m.edits})
        FROM best b JOIN parts p ON p.part = b.part JOIN moves m ON m.before = b.state AND m.code = substr(p.codes, b.k + 1, 1)
        WHERE b.k < length(p.codes)
        GROUP BY b.part, b.entry, b.k, m.after
    )
    SELECT b.part, b.entry, b.state, b.way.cost AS cost, b.way.audit AS audit
    FROM best b JOIN parts p ON p.part = b.part AND b.k = length(p.codes)
"""


def cheapest(con: duckdb.DuckDBPyConnection, codes: list[str], entries: list[list[int]]) -> list[dict[int, dict[int, tuple[int, str]]]]:
    """For each part of a conversation, given as a word of row codes: entry state -> state after it -> (cost, audit)."""
    parts = pa.table({"part": pa.array(range(len(codes)), pa.int64()), "codes": pa.array(codes, pa.string())})  # noqa: F841
    flat = [(i, e) for i, found in enumerate(entries) for e in found]
    starts = pa.table({"part": pa.array([i for i, _ in flat], pa.int64()), "entry": pa.array([e for _, e in flat], pa.int64())})  # noqa: F841
    out: list[dict[int, dict[int, tuple[int, str]]]] = [{} for _ in codes]
    for part, entry, state, cost, audit in con.execute(REPAIR_SQL).fetchall():
        out[part].setdefault(entry, {})[state] = (cost, audit)
    return out


def connect() -> duckdb.DuckDBPyConnection:
    """A DuckDB in memory, of one thread, that knows the moves."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    con.execute("CREATE TABLE moves (code VARCHAR, before BIGINT, after BIGINT, cost BIGINT, edits VARCHAR)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", moves())
    return con


@dataclass
class Way:
    """Cheapest edits so far that end in one state, and the digest of what they leave."""

    cost: int = 0
    audit: str = ""
    digest: object = field(default_factory=hashlib.sha256)
    empty: bool = True

    def then(self, cost: int, audit: str, state: int, rows: list[tuple[str, str]]) -> Way:
        """This way from ``state`` over ``rows`` (role, text) by the edits of ``audit``."""
        way = Way(self.cost + cost, self.audit + audit, self.digest.copy(), self.empty)
        left = iter(rows)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(left)
            if edit == "D":
                continue
            state = _AFTER[state, role[:1]] if edit == "K" else _NEXT[state]
            if edit != "K":
                role = "assistant" if state == 3 else "user"
            way.digest.update(f"{'' if way.empty else chr(10)}{role}:{text}".encode())
            way.empty = False
        return way


@dataclass
class Conversation:
    """What is known of a conversation whose rows are not all read."""

    ways: dict[int, Way] = field(default_factory=lambda: {0: Way()})
    faults: dict[str, int] = field(default_factory=lambda: {"blank": 0, "duplicate": 0, "truncated": 0})
    illegal: int = 0
    least: int | None = None
    most: int | None = None
    distinct: int = 0
    initial: str | None = None

    def see(self, turn: int | None, role: str, fault: str) -> None:
        if fault:
            self.faults[fault] += 1
        if turn is not None:
            if turn != self.most:
                self.distinct += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LEGAL_PAIRS
        self.initial = role[:1]

    def advance(self, found: dict[int, dict[int, tuple[int, str]]], rows: list[tuple[str, str]]) -> None:
        """Over ``rows``, of which ``found`` gives the cheapest edits from each state."""
        best: dict[int, tuple[tuple[int, str], int, int, str]] = {}
        for entry, ends in found.items():
            way = self.ways[entry]
            for state, (cost, audit) in ends.items():
                rank = way.cost + cost, way.audit + audit
                if state not in best or rank < best[state][0]:
                    best[state] = rank, entry, cost, audit
        self.ways = {state: self.ways[entry].then(cost, audit, entry, rows) for state, (_, entry, cost, audit) in best.items()}

    def result(self, ends: list[tuple[int, int, int, str]]) -> tuple:
        """Counts, cost, audit and digest; ``ends`` are the moves over the end of a conversation."""
        cost, audit, before, last = min((w.cost + paid, w.audit + edits, s, edits) for s, w in self.ways.items() for b, _, paid, edits in ends if b == s)
        way = self.ways[before].then(0, last, before, [])
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, cost, audit, way.digest.hexdigest()


def rows_of(table: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, damage: bool) -> DataFrame:
    """(conv, turn, role, text, hit, there), nulls as one space.

    ``hit`` is the damage, by crc32 of ``conv:turn`` modulo 20, or null without
    damage: 0 drops the row, which stays with ``there`` false, 1 empties its text,
    2 removes its marks of sentence ends, 3 repeats it, 4 sets its role to user.
    """
    conv, turn = F.col(f"`{conv_col}`").cast("long"), F.col(f"`{turn_col}`").cast("long")
    one = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(one(conv), F.lit(":"), one(turn)).cast("binary")) % 20 if damage else F.lit(None).cast("long")
    rows = table.select(conv.alias("conv"), turn.alias("turn"), one(F.col(f"`{role_col}`")).alias("role"), one(F.col(f"`{text_col}`")).alias("text"), hit.alias("hit"))
    times = F.when(F.col("hit") == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.coalesce(F.col("hit") != 0, F.lit(True))))
    return rows.select("*", F.explode(times).alias("there"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation and in order, damaged, with their place and first fault; one exchange."""
    order = [F.col("there").desc(), F.col("turn").asc_nulls_first(), "role", "text"]
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv").orderBy(*order)))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    after = placed.select("conv", "place", "there", "turn", role.alias("role"), text.alias("text"))
    seen = F.row_number().over(Window.partitionBy("conv", "there", "role", "text").orderBy("place"))
    fault = F.when(~F.col("there"), "").when(~F.col("text").rlike(WORD), "blank").when(seen > 1, "duplicate").when(F.col("text").rlike(LAST_IS_NO_END), "truncated").otherwise("")
    return after.withColumn("fault", fault).sortWithinPartitions("conv", "place")


def repair(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = False, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text of every conversation, after the set damage if asked for."""
    names = [conv_col, *(x.split()[0] for x in OUT.split(", "))]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    ends = [(before, after, cost, edits) for code, before, after, cost, edits in moves() if code == "-"]

    def told(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        held: tuple[int | None, Conversation] | None = None
        for whole in batches:
            for batch in by_bytes(whole, 5, rows_at_once):
                convs, there, turns, roles, texts, faults = (batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6))
                cuts = [0, *(i for i in range(1, len(convs)) if convs[i] != convs[i - 1]), len(convs)]
                done, parts = [], []
                for a, b in zip(cuts, cuts[1:]):
                    if held is None or held[0] != convs[a]:
                        if held is not None:
                            done.append(held)
                        held = convs[a], Conversation()
                    some = [i for i in range(a, b) if there[i]]
                    for i in some:
                        held[1].see(turns[i], roles[i], faults[i])
                    parts.append((held[1], "".join(row_code(roles[i][:1], faults[i]) for i in some), [(roles[i], texts[i]) for i in some]))
                # only the first part of a batch can go on from other states than the first
                ways = cheapest(con, [codes for _, codes, _ in parts], [list(conv.ways) for conv, _, _ in parts])
                for (conv, _, some), found in zip(parts, ways):
                    conv.advance(found, some)
                if done:
                    yield told([(c, *conv.result(ends)) for c, conv in done])
        if held is not None:
            yield told([(held[0], *held[1].result(ends))])

    rows = with_faults(rows_of(table, conv_col, turn_col, role_col, text_col, damage))
    return rows.mapInArrow(run, f"`{conv_col}` long, {OUT}")
