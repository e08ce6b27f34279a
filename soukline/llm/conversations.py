"""Conversation repair by a secondary-sorted stream with a dynamic program over the turns.

Conversations are dealt out once by conv_id. Inside each task Spark sorts the rows (its sorts spill), and three streams
read them: backwards, the cheapest way to finish is carried from row to row as one cost for each of four states (nothing
written, after system, after user, after assistant), and each row keeps one byte, the best edit in each state; forwards,
the byte of each row says what to do with it, and repaired rows leave; then repaired rows are digested. So Python holds
four costs, a position and one running digest at a time, never a conversation, and what a giant conversation needs
besides its rows is one byte a row, which Spark's sort spills together with the row. Every conversation goes this way,
whatever its size. A conversation passes one task, because its hash is a chain over its text in order; it is read there
as a stream.

Edits and costs: K keep 0, R set the role to user or assistant 2, D delete 3 (the only edit of a blank or repeated row), I
insert an empty turn of user or assistant 2; a row that stays and ends without ``.!?`` adds 1. The roles' first letters
must come out as ``(s?(ua)+)?``. Of equally cheap edits the ASCII-least sequence is taken; it fixes all roles.

Defined results: a null conv_id is a conversation of its own; a null turn comes first and counts in no gap; a null role or
text is one space (so a null text is blank). Rows of one turn are ordered by role and text, so repeated rows stand side by
side and any input order gives the same result. A role that begins with another letter can only be changed or deleted.
An empty table gives an empty result. Only conv_id, turn, role and text are read; other columns are ignored. Texts are
handled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
RE_ROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1

# States: 0 nothing written, 1 after system, 2 after user, 3 after assistant.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
# Where a turn of user or assistant leads; no state allows both.
_TURN = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_FINAL = (0, 3)
_LETTERS = "DIKR"  # in ASCII order; a letter's place is its code
# What each state costs behind the last row: the turns that are still missing.
_END = (0, 2 * INSERT, INSERT, 0)

ORDER = ["turn", "role", "text", "nth"]
REPAIRED = (
    "conv_id long, at long, edit string, role string, text string, turn long, fault string, was string, there boolean, cost long"
)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of op13 after damage (conv_id, turn, role, text, there); a dropped row stays as a mark with there false."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    base = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), fault.alias("kind"))
    kind = F.col("kind")
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    changed = base.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (kind != 0).alias("there"), copies.alias("copy"),
    )
    return changed.drop("copy")


def turns(rows: DataFrame, marks: str | None = None) -> DataFrame:
    """Rows with their first fault and nth (of equal rows), dealt out by conversation."""
    there = F.col(marks) if marks else F.lit(True)
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    dealt = rows.select("conv_id", "turn", role, text, there.alias("there")).repartition("conv_id")
    # no further shuffle: rows of one conversation are in one partition already
    same = Window.partitionBy("conv_id", "there", "role", "text").orderBy("turn")
    core = F.rtrim(F.col("text"), F.lit(SPACES))
    return dealt.withColumn("nth", F.row_number().over(same)).select(
        "conv_id", "turn", "role", "text", _fault(core, F.col("nth")).alias("fault"), "there", "nth"
    )


def _fault(core: Column, nth: Column) -> Column:
    open_end = ~F.substring(core, -1, 1).isin(*ENDS)
    return F.when(core == "", "blank").when(nth > 1, "duplicate").when(open_end, "truncated").otherwise("")


@cache
def _step(first: str, fault: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs in front of a row from those behind it, and its byte: two bits a state, the best edit there."""
    lost, tail = fault in ("blank", "duplicate"), CUT_OFF if fault == "truncated" else 0
    choice = [{"D": after[q] + DELETE} for q in range(4)]
    if not lost:
        for q in range(4):
            if (q, first) in _NEXT:
                choice[q]["K"] = after[_NEXT[q, first]] + tail
            choice[q]["R"] = after[_TURN[q]] + RE_ROLE + tail
    return _settled(choice)


def _settled(choice: list[dict[str, int]]) -> tuple[tuple[int, ...], int]:
    """Adds insertions, which stay before the same row; more than two in a row never pay."""
    costs = [min(c.values()) for c in choice]
    for _ in range(3):
        for q in range(4):
            choice[q]["I"] = costs[_TURN[q]] + INSERT
            costs[q] = min(choice[q].values())
    best = [min(x for x in choice[q] if choice[q][x] == costs[q]) for q in range(4)]
    return tuple(costs), sum(_LETTERS.index(x) << 2 * q for q, x in enumerate(best))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``best`` (the byte) and ``cost`` (of the rest in state 0) to rows that come last turn first."""
    conv, low, costs = None, 0, None
    for batch in batches:
        names = batch.schema.names
        best, cost = [], []
        columns = (batch.column(names.index(c)).to_pylist() for c in ("conv_id", "first", "fault", "there"))
        for c, first, fault, there in zip(*columns, strict=True):
            if costs is None or c != conv:
                conv, low, costs = c, 0, _END
            byte = 0
            if there:
                costs, byte = _step(first, fault, costs)
                # kept small, so that few different states are worked out
                least = min(costs)
                low, costs = low + least, tuple(x - least for x in costs)
            best.append(byte)
            cost.append(low + costs[0])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(best, pa.int16()), pa.array(cost, pa.int64())], names=[*names, "best", "cost"]
        )


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """REPAIRED rows from marked rows that come first turn first."""
    conv, state, at, seen = None, 0, 0, False
    schema = pa.schema([
        ("conv_id", pa.int64()), ("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()),
        ("turn", pa.int64()), ("fault", pa.string()), ("was", pa.string()), ("there", pa.bool_()), ("cost", pa.int64()),
    ])

    def inserted(out: list, c: int | None) -> None:
        nonlocal state, at
        state, at = _TURN[state], at + 1
        out.append((c, at, "I", _ROLE[state], "", None, None, None, True, None))

    def closed(out: list) -> None:
        while seen and state not in _FINAL:
            inserted(out, conv)

    for batch in batches:
        names, out = batch.schema.names, []
        wanted = ("conv_id", "turn", "role", "text", "first", "fault", "there", "best", "cost")
        for c, turn, role, text, first, fault, there, best, cost in zip(
            *(batch.column(names.index(x)).to_pylist() for x in wanted), strict=True
        ):
            if not seen or c != conv:
                closed(out)
                conv, state, at, seen = c, 0, 0, True
            if not there:
                out.append((c, None, None, None, None, None, None, None, False, None))
                continue
            total = cost if at == 0 else None
            while (letter := _LETTERS[best >> 2 * state & 3]) == "I":
                inserted(out, c)
            at += 1
            if letter == "K":
                state = _NEXT[state, first]
            elif letter == "R":
                state = _TURN[state]
                role_now = _ROLE[state]
            out.append((
                c, at, letter, role_now if letter == "R" else role, "" if letter == "D" else text, turn, fault, first,
                True, total,
            ))
        yield _batch(out, schema)
    out: list = []
    closed(out)
    yield _batch(out, schema)


def repaired(rows: DataFrame, marks: str | None = None) -> DataFrame:
    """REPAIRED: the edits of each conversation of ``rows`` (conv_id, turn, role, text), in order of ``at``.

    ``role`` and ``text`` are those after the edit (of a deleted row its role and no text), ``was`` the first letter of the
    role before it, ``turn`` and ``fault`` the row's own (null where a turn is inserted). The conversation's cost stands at
    its first row. ``marks`` names a boolean column: rows where it is false are gone, and leave a row that has only conv_id.
    Rows of a conversation are in one partition, in order.
    """
    found = turns(rows, marks).withColumn("first", F.substring("role", 1, 1))
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "there", *ORDER)]
    back = [F.col("conv_id").desc_nulls_last(), F.col("there").desc(), *[F.col(c).desc_nulls_last() for c in ORDER]]
    schema = found.select("*").schema.add("best", "short").add("cost", "long")
    marked = found.sortWithinPartitions(*back).mapInArrow(_marked, schema)
    return marked.sortWithinPartitions(*keys).mapInArrow(_repaired, REPAIRED)


class _Digest:
    """What op13 tells of one conversation."""

    def __init__(self, conv: int | None):
        self.conv, self.hash, self.any = conv, hashlib.sha256(), False
        self.turns, self.low, self.high, self.turn = 0, None, None, None
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before, self.cost, self.audit = 0, None, 0, []

    def add(self, edit: str, role: str, text: str, turn: int | None, fault: str | None, was: str | None, cost: int | None) -> None:
        self.audit.append(edit)
        if edit != "D":
            self.hash.update(("\n" * self.any + role + ":").encode())
            self.hash.update(text.encode())
            self.any = True
        if edit == "I":
            return
        self.cost = cost if self.before is None else self.cost
        if fault:
            self.count[fault] += 1
        self.illegal += self.before is not None and self.before + was not in ("su", "ua", "au")
        self.before = was
        if turn is not None and (self.low is None or turn != self.turn):
            self.low = turn if self.low is None else self.low
            self.high, self.turn, self.turns = turn, turn, self.turns + 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.count.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


DIGEST = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Digest | None = None
    names = [x.split()[0] for x in DIGEST.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int64()] * 7 + [pa.string()] * 2, strict=True)))
    for batch in batches:
        done, at = [], {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
        for conv, edit, role, text, turn, fault, was, there, cost in zip(
            *(at[x] for x in ("conv_id", "edit", "role", "text", "turn", "fault", "was", "there", "cost")), strict=True
        ):
            if now is None or conv != now.conv:
                if now is not None:
                    done.append(now.row())
                now = _Digest(conv)
            if there:
                now.add(edit, role, text, turn, fault, was, cost)
        yield _batch(done, schema)
    yield _batch([now.row()] if now is not None else [], schema)


def digests(edits: DataFrame) -> DataFrame:
    """DIGEST of every conversation of ``repaired``."""
    return edits.mapInArrow(_digests, DIGEST)


def op13(rows: DataFrame) -> DataFrame:
    return digests(repaired(damaged(rows), "there"))
