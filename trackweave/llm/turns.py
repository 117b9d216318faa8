"""Repair of damaged conversations by the auction algorithm for shortest paths.

A row is blank, a repeat of an earlier one, truncated or sound.  Keeping it, giving it the other role, deleting it or inserting an
empty turn before it moves through a lattice of (rows read, role before); the cheapest way through it whose roles read
`(s?(ua)+)?` is the repair.  Each lattice node has a price, a lower bound of what is still to pay.  An auction extends a path along
arcs that cost no more than the prices differ by, and where it is stuck raises the last node's price and contracts.  Rows are taken in
blocks from the last to the first: once all four nodes of a block's first rows have been origins, their prices are exact and end the paths of the
block before, so work is linear in the rows.  At the end an arc lies on a cheapest way if and only if it is tight and leads on
by tight arcs; the way whose edits read first in ASCII order is traced.

Two ordered streams: the first reads a number and a digest per row and gives one row of edits per conversation; the second reads the
edits, then the texts one by one.  A task holds a few bytes per row of one conversation, never its texts.

Defined cases: null roles and texts count as one space; rows of one turn are ordered by a digest of role and text, so repeated rows
are adjacent; rows without a conversation id are one conversation; an empty table gives no rows; other columns are ignored, whatever
their names; texts of any length are read once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.streams import ordered_stream

BLANK, TRUNCATED = "[^\\x20\\x09-\\x0D]", "[.!?][\\x20\\x09-\\x0D]*\\z"
SYSTEM, USER, ASSISTANT, OTHER = range(4)
SOUND, DELETED, CUT = range(3)  # what a row is: as it should be, to be deleted, truncated
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_STAYS = 0, 1, 2, 5, 5
BLOCK = 16
REMEMBERED = 1 << 16
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def arcs(code: bytes, i: int, phase: int) -> list[tuple[str, int, int]]:
    """(edit, cost, node) of the ways on from (i, phase); a row's code is 4 * what it is + its role, a node 4 * rows read + phase.

    The last node, behind a complete conversation, is 4 * len(code) + 4.
    """
    ahead = AFTER_ASSISTANT if phase == AFTER_USER else AFTER_USER
    out = [("I", INSERT, 4 * i + ahead)]
    if i == len(code):
        return out + [("", 0, 4 * i + 4)] if phase in (START, AFTER_ASSISTANT) else out
    out.append(("D", DELETE, 4 * i + 4 + phase))
    fault, role = divmod(code[i], 4)
    if fault != DELETED:
        more = CUT_STAYS if fault == CUT else 0
        if role == SYSTEM and phase == START:
            out.append(("K", KEEP + more, 4 * i + 4 + AFTER_SYSTEM))
        elif role == (ASSISTANT if phase == AFTER_USER else USER):
            out.append(("K", KEEP + more, 4 * i + 4 + ahead))
        out.append(("R", REROLE + more, 4 * i + 4 + ahead))
    return out


def prices_by_auction(code: bytes, block: int = BLOCK) -> list[int]:
    """The price of every node: never above what is still to pay from it, exact for the origin and along all cheapest ways."""
    n = len(code)
    price = [0] * (4 * n + 5)
    exact = {4 * n + 4}
    stop = n + 1  # rows from here on have exact prices
    while stop:
        first = max(0, stop - block)
        # what each row costs at least is a feasible price to begin with
        bound = min(price[v] for v in exact)
        for i in range(stop - 1, first - 1, -1):
            if i < n:
                bound += KEEP if code[i] // 4 == SOUND else DELETE
            price[4 * i:4 * i + 4] = [bound] * 4
        origins = [4 * first + phase for phase in range(4 if first else 1)]
        for origin in origins:
            path = [origin]
            while path[-1] not in exact:
                at = path[-1]
                cost, ahead = min((cost + price[v], v) for _, cost, v in arcs(code, at // 4, at % 4))
                if price[at] < cost:
                    price[at] = cost
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(ahead)
        exact, stop = set(origins), first
    return price


def cheapest_edits(code: bytes, block: int = BLOCK) -> tuple[int, str]:
    """The cost of the repair and its edits; of several cheapest ones, those whose letters come first."""
    if not code:
        return 0, ""
    price = prices_by_auction(code, block)
    n, last = len(code), 4 * len(code) + 4
    leads = bytearray(last + 1)  # nodes from which tight arcs lead to the end
    leads[last] = 1

    def tight(at: int):
        return [(edit, v) for edit, cost, v in arcs(code, at // 4, at % 4) if price[at] == cost + price[v] and leads[v]]

    for i in range(n, -1, -1):
        for _ in range(2):  # an insertion stays in its row: from the start to user, from user to assistant
            for phase in (AFTER_ASSISTANT, AFTER_USER, AFTER_SYSTEM, START):
                leads[4 * i + phase] = leads[4 * i + phase] or bool(tight(4 * i + phase))
    edits, at = [], 0
    while at != last:
        edit, at = min(tight(at))
        edits.append(edit)
    return price[0], "".join(edits)


class Report:
    """What the rows of one conversation amount to, row by row."""

    def __init__(self, conv: int | None):
        self.conv, self.code, self.seen = conv, bytearray(), set()
        self.counts, self.illegal, self.last = [0, 0, 0], 0, None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, role: int, blank: bool, cut: bool, digest: bytes) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        repeat = digest in self.seen
        self.seen.add(digest)
        kind = 0 if blank else 1 if repeat else 2 if cut else None
        if kind is not None:
            self.counts[kind] += 1
        self.code.append(4 * (SOUND if kind is None else CUT if kind == 2 else DELETED) + role)
        if self.last is not None:
            self.illegal += (self.last, role) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
        self.last = role

    def row(self, known: dict[bytes, tuple[int, str]]) -> tuple:
        code = bytes(self.code)
        if (found := known.get(code)) is None:
            found = cheapest_edits(code)
            if len(known) < REMEMBERED and len(code) <= 64:
                known[code] = found
        gaps = self.high - self.low + 1 - self.turns if self.high is not None else 0
        return self.conv, gaps, *self.counts, self.illegal, *found


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in REPORT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]
    known: dict[bytes, tuple[int, str]] = {}
    report = None
    for batch in batches:
        done = []
        for conv, *row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "blank", "cut", "digest")]):
            if report is None or report.conv != conv:
                if report is not None:
                    done.append(report.row(known))
                report = Report(conv)
            report.add(*row)
        yield _table(done, names, kinds)
    if report is not None:
        yield _table([report.row(known)], names, kinds)


def rows_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text without nulls, and the digest that orders rows of one turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"))


def plan_repairs(conversations: DataFrame) -> DataFrame:
    """Per conversation: missing turns, rows by first fault, neighbours whose roles do not follow on each other, and the cheapest edits with their cost."""
    rows = rows_of(conversations)
    first = F.substring("role", 1, 1)
    role = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    read = rows.select("conv_id", "turn", role.alias("role"), (~F.col("text").rlike(BLANK)).alias("blank"), (~F.col("text").rlike(TRUNCATED)).alias("cut"), "digest")
    return ordered_stream(read, ["conv_id"], [F.asc_nulls_first("turn"), "digest"], _reports, REPORT)


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns; rows are read as the edits ask for them."""
    phase = START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            phase = AFTER_SYSTEM
        else:
            phase = AFTER_ASSISTANT if phase == AFTER_USER else AFTER_USER
            if edit != "K":
                role = "assistant" if phase == AFTER_ASSISTANT else "user"
        yield edit, role, text


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str, str]]]]:
    """Each conversation's id and repaired turns, which must be read to their end before the next one."""
    stream = _each(batches)
    row = next(stream, None)
    while row is not None:
        conv, audit, more = row[0], row[1], None

        def texts() -> Iterator[tuple[str, str]]:
            nonlocal more
            for more in stream:
                if more[1] is not None:
                    return
                yield more[2], more[3]
            more = None

        left = texts()
        yield conv, edited(audit, left)
        for _ in left:
            raise AssertionError("edits and rows differ in number")
        row = more


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["conv_id", "position", "edit", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    done, size = [], 0
    for conv, turns in _conversations(batches):
        for i, turn in enumerate(turns):
            done.append((conv, i, *turn))
            size += len(turn[2])
            if len(done) >= 4096 or size >= 1 << 22:
                yield _table(done, names, kinds)
                done, size = [], 0
    yield _table(done, names, kinds)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["conv_id", "repaired_sha256"], [pa.int64(), pa.string()]
    done = []
    for conv, turns in _conversations(batches):
        digest = hashlib.sha256()
        for i, (_, role, text) in enumerate(turns):
            digest.update(f"{chr(10) if i else ''}{role}:{text}".encode())
        done.append((conv, digest.hexdigest()))
        if len(done) >= 4096:
            yield _table(done, names, kinds)
            done = []
    yield _table(done, names, kinds)


def _with_edits(conversations: DataFrame, plans: DataFrame, run, schema: str) -> DataFrame:
    nothing = F.lit(None)
    rows = rows_of(conversations).select("conv_id", F.lit(1).alias("place"), "turn", "digest", nothing.cast("string").alias("audit"), "role", "text")
    heads = plans.select("conv_id", F.lit(0).alias("place"), nothing.cast(conversations.schema["turn"].dataType).alias("turn"), nothing.cast("binary").alias("digest"),
                         "audit", nothing.cast("string").alias("role"), nothing.cast("string").alias("text"))
    return ordered_stream(heads.unionByName(rows), ["conv_id"], ["place", F.asc_nulls_first("turn"), "digest"], run, schema)


def repaired_turns(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, edit, role, text.  `plans` is what `plan_repairs` gives for the same rows."""
    return _with_edits(conversations, plans, _turns, "conv_id long, position long, edit string, role string, text string")


def repaired_digests(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation's lines `role:text`."""
    return _with_edits(conversations, plans, _digests, "conv_id long, repaired_sha256 string")
