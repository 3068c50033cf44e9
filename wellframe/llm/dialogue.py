"""Repair of conversations by error-correcting Earley parsing.

A sound conversation is empty, or an optional system turn and then user and assistant turns by pairs.  The role grammar is
left-linear, so every chart item begins at origin 0 and a chart needs only the predictions made there and the current set:
turns are parsed as a stream, however many one conversation has.  Error productions delete a turn, give it another
role or insert one, each at a weight; every item keeps the least (cost, audit), the audit being the initials of the edits.  The best
completed item spells the repair.  Sets are closed best first, as inserting moves from item to item.

``parsed`` moves a few bytes of every turn and gives audits; ``repaired`` sorts the turns once more, whole, and applies them.
One conversation is one task in both, as an audit and a repair are sequences; the task streams it and holds a block of
codes, four audits at most and Arrow batches, never the conversation.  Repeated turns are found by aggregates, not in that task.

Edge cases: null roles and texts count as one space.  Turns with a null number come first; turns of one number follow by role,
then by a digest of role and text, so copies are adjacent.  A null conversation id is a conversation.  An
empty table gives no rows.  Other columns, whatever their names, are not read.  Long texts are not cut.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellframe.llm.staging import free_memory, small_batches

#: The role grammar: a left side and what it is made of.  A dialogue is whole when ``Whole`` is complete.
GRAMMAR = [
    ("Nothing", ()),
    ("Opened", ("Nothing", "s")),
    ("Asked", ("Nothing", "u")),
    ("Asked", ("Opened", "u")),
    ("Asked", ("Answered", "u")),
    ("Answered", ("Asked", "a")),
    ("Whole", ("Nothing",)),
    ("Whole", ("Answered",)),
]
#: Error productions: ``X -> X turn`` for every left side but the whole; ``t -> turn`` and ``t -> `` for these roles.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
GIVEN_ROLES = {"u": "user", "a": "assistant"}

#: A turn's code: three times its role's place here (or 3 for another role), plus what is wrong with it.
ROLES = "sua"
SOUND, GONE, CUT = 0, 1, 2
#: Codes parsed before audits are put aside.
BLOCK = 4096

Value = tuple[int, int, str]  # cost, rank of the audit before this block, audit in this block


def _waiting() -> dict[str, list[tuple[str, str | None]]]:
    """Set 0's predictions: what each left side, once complete, advances, and the role that item then waits for."""
    out: dict[str, list[tuple[str, str | None]]] = {}
    for left, right in GRAMMAR:
        if right:
            out.setdefault(right[0], []).append((left, right[1] if len(right) > 1 else None))
    return out


_WAITING = _waiting()


def complete(agenda: list[tuple[Value, str]]) -> dict[str, Value]:
    """Close a set: the least value of every left side complete here, with inserted turns; ``agenda`` is used up."""
    done: dict[str, Value] = {}
    heapq.heapify(agenda)
    while agenda:
        value, left = heapq.heappop(agenda)
        if left in done:
            continue
        done[left] = value
        cost, rank, audit = value
        for above, role in _WAITING.get(left, ()):
            if above in done:
                continue
            if role is None:
                heapq.heappush(agenda, (value, above))
            elif role in GIVEN_ROLES:
                heapq.heappush(agenda, ((cost + INSERT, rank, audit + "I"), above))
    return done


def scan(done: dict[str, Value], code: int) -> list[tuple[Value, str]]:
    """The next set's agenda: every item over a turn of this code, kept, with another role, or deleted."""
    role, fault = divmod(code, 3)
    role = ROLES[role] if role < len(ROLES) else ""
    extra = TRUNCATED if fault == CUT else 0
    out = []
    for left, (cost, rank, audit) in done.items():
        if left == "Whole":
            continue
        out.append(((cost + DELETE, rank, audit + "D"), left))
        if fault == GONE:
            continue
        for above, wanted in _WAITING[left]:
            if wanted == role:
                out.append(((cost + extra, rank, audit + "K"), above))
            elif wanted in GIVEN_ROLES:
                out.append(((cost + extra + REROLE, rank, audit + "R"), above))
    return out


class Chart:
    """The current set of one conversation's chart, and the audits before its block as linked pieces."""

    def __init__(self) -> None:
        self.pieces: list[tuple | None] = [None]
        self.done = complete([((0, 0, ""), left) for left, right in GRAMMAR if not right])

    def advance(self, codes: bytes) -> None:
        """Parse further turns.

        Audits of one set have equally many letters other than I.  Put aside without the Is they end with, two of them
        are equal or differ in a letter that both have, so ranks decide as the whole audits would.
        """
        done = self.done
        for code in codes:
            done = complete(scan(done, code))
        tails = {left: v[2].rstrip("I") for left, v in done.items()}
        heads = sorted({(v[1], tails[left]) for left, v in done.items()})
        place = {h: i for i, h in enumerate(heads)}
        self.pieces = [(self.pieces[rank], piece) for rank, piece in heads]
        self.done = {left: (v[0], place[v[1], tails[left]], v[2][len(tails[left]) :]) for left, v in done.items()}

    def result(self) -> tuple[int, str]:
        """Cost and audit of the whole."""
        cost, rank, tail = self.done["Whole"]
        out, piece = [tail], self.pieces[rank]
        while piece is not None:
            piece, text = piece
            out.append(text)
        return cost, "".join(reversed(out))


@lru_cache(maxsize=1 << 16)
def parse(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation: short ones recur, so they are remembered."""
    chart = Chart()
    chart.advance(codes)
    return chart.result()


class Report:
    """What is known of one conversation while its turns pass in order."""

    def __init__(self, conv: object) -> None:
        self.conv, self.chart, self.codes = conv, None, bytearray()
        self.faults, self.illegal, self.turns, self.distinct = [0, 0, 0], 0, None, 0
        self.role = self.before = None

    def add(self, turn: int | None, role: int, fault: int, later: bool, digest: bytes) -> None:
        """``fault`` is 1 for blank, 3 for truncated; ``later`` says that an equal turn has a smaller number."""
        if turn is not None and (self.turns is None or turn != self.turns[1]):
            self.turns = (self.turns[0] if self.turns else turn, turn)
            self.distinct += 1
        if fault != 1 and (later or self.before == digest):
            fault = 2
        if fault:
            self.faults[fault - 1] += 1
        self.before = digest
        if self.role is not None and (self.role, role) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.role = role
        self.codes.append(3 * role + (SOUND, GONE, GONE, CUT)[fault])
        if len(self.codes) == BLOCK:
            self.chart = self.chart or Chart()
            self.chart.advance(bytes(self.codes))
            self.codes.clear()

    def row(self) -> tuple:
        if self.chart:
            self.chart.advance(bytes(self.codes))
        cost, audit = self.chart.result() if self.chart else parse(bytes(self.codes)) if len(self.codes) <= 64 else _parsed_alone(bytes(self.codes))
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        return self.conv, gaps, *self.faults, self.illegal, cost, audit


def _parsed_alone(codes: bytes) -> tuple[int, str]:
    return parse.__wrapped__(codes)


_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def _turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, digest, without nulls in role and text."""
    whole = lambda c: F.coalesce(F.col(c), F.lit(" "))
    digest = F.unhex(F.md5(F.concat(F.length(whole(role)).cast("string"), F.lit(":"), whole(role), whole(text)).cast("binary")))
    return df.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), whole(role).alias("role"), whole(text).alias("text"), digest.alias("digest"))


def _order(turn: str = "turn") -> list[Column]:
    return [F.col("conv"), F.col(turn).asc_nulls_first(), F.col("role"), F.col("digest")]


def parsed(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost (longs), audit of every conversation.

    A turn is blank without a character other than white space, a duplicate if role and text were seen before in its
    conversation, truncated if its last such character is no full stop, exclamation or question mark; the first of these counts.
    """
    small_batches(df.sparkSession)
    initial = F.substring("role", 1, 1)
    end = F.substring(F.rtrim(F.col("text"), F.lit(_SPACES)), -1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    marks = _turns(df, conv, turn, role, text).select("conv", "turn", "role", "digest", place.alias("place"), F.when(end == "", 1).when(end.isin(".", "!", "?"), 0).otherwise(3).alias("fault"))
    number = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    repeats = marks.groupBy("conv", "digest").agg(F.min(number).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("c"), F.col("digest").alias("d"), "first")
    marks = marks.join(repeats, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    marks = marks.select("conv", "turn", "role", "digest", "place", "fault", F.coalesce(number > F.col("first"), F.lit(False)).alias("later"))
    kind = df.schema[conv].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready, kind_ = None, [], None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*ready, strict=True))
            ready.clear()
            return pa.record_batch([pa.array(columns[0], kind_), *[pa.array(c, pa.int64()) for c in columns[1:7]], pa.array(columns[7], pa.string())], ["conv", *names, "audit"])

        for b in batches:
            kind_ = b.column(0).type
            for conv_, turn_, place_, fault, later, digest in zip(*(b.column(n).to_pylist() for n in ("conv", "turn", "place", "fault", "later", "digest")), strict=True):
                if now is None or now.conv != conv_:
                    if now:
                        ready.append(now.row())
                    now = Report(conv_)
                now.add(turn_, place_, fault, later, digest)
            if len(ready) >= 1000:
                yield batch()
        if now:
            ready.append(now.row())
            yield batch()

    return marks.repartition("conv").sortWithinPartitions(*_order()).mapInArrow(run, f"conv {kind}, {', '.join(n + ' bigint' for n in names)}, audit string").withColumnRenamed("conv", conv)


def repaired(df: DataFrame, conv: str, turn: str, role: str, text: str, audits: DataFrame) -> DataFrame:
    """The repaired turns: conv, position (int, from 0), role, text, edit (initial); ``audits`` comes from ``parsed`` of the same rows.

    A conversation's turns are in one partition, next to each other and in order.
    """
    small_batches(df.sparkSession)
    kind = df.schema[conv].dataType.simpleString()
    turns = _turns(df, conv, turn, role, text).select("conv", F.lit(1).alias("part"), "turn", "role", "digest", "text")
    heads = audits.select(F.col(conv).alias("conv"), F.lit(0).alias("part"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.col("audit").alias("text"))
    rows = heads.unionByName(turns).repartition("conv").sortWithinPartitions("conv", "part", *_order()[1:]).select("conv", "part", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, position, last, out = "", 0, 0, None, []

        def place(role_: str, text_: str, edit: str) -> None:
            nonlocal position, last
            out.append((conv_, position, role_, text_, edit))
            position, last = position + 1, role_[:1]

        def expected() -> str:
            return GIVEN_ROLES["a" if last == "u" else "u"]

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                place(expected(), "", "I")

        for b in batches:
            for conv_, part, role_, text_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part == 0:
                    audit, at, position, last = text_, 0, 0, None
                else:
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        place(role_ if edit == "K" else expected(), text_, edit)
                inserted()
            if out:
                columns = list(zip(*out, strict=True))
                out.clear()
                yield pa.record_batch([pa.array(columns[0], b.column(0).type), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.string()) for c in columns[2:]]], ["conv", "position", "role", "text", "edit"])
        free_memory()

    return rows.mapInArrow(run, f"conv {kind}, position int, role string, text string, edit string").withColumnRenamed("conv", conv)


def digests(turns: DataFrame, conv: str) -> DataFrame:
    """conv, sha256 of the ``role:text`` of the turns that ``repaired`` gives, joined by line breaks; read as a stream, moved nowhere."""
    kind = turns.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, now, kind_ = None, None, None
        for b in batches:
            ready, kind_ = [], b.column(0).type
            for conv_, position, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if position == 0:
                    if h:
                        ready.append((now, h.hexdigest()))
                    h, now = hashlib.sha256(), conv_
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            yield pa.record_batch([pa.array([r[0] for r in ready], kind_), pa.array([r[1] for r in ready], pa.string())], ["conv", "sha256"])
        if h:
            yield pa.record_batch([pa.array([now], kind_), pa.array([h.hexdigest()])], ["conv", "sha256"])

    return turns.select(F.col(conv).alias("conv"), "position", "role", "text").mapInArrow(run, f"conv {kind}, sha256 string").withColumnRenamed("conv", conv)
