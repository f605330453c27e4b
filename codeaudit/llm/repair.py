"""Conversation structure repair by Knuth's lightest-derivation agenda.

Repairing rows `i..j` of a conversation takes the automaton of legal role sequences,
`(s?(ua)+)?`, from one state to another. Such an item is deduced from a shorter one and an edit,
or from two items that meet, at the weight (cost, audit) of both: costs add, audits join. Joining
is superior (a weight never falls) and monotone (derivations of the same item at one cost spell
the same number of rows, so neither audit begins with the other), hence the agenda pops items by
weight, each is final when it is popped, and the first goal is the cheapest repair with the
ASCII-least audit (`lightest`).

Rows are dealt out by ranges of conversation and turn, so a conversation of any length spreads
over tasks. Each task deduces the sixteen items of the rows that it holds, in blocks of `BLOCK`
rows that are joined in pairs; the items of a conversation's parts are joined afterwards. A last
pass streams the texts in order under the audit; it keeps one audit and one hash state, however
long the texts are. The digest of a whole conversation is sequential by nature: one conversation
is hashed by one task.

Defined cases: a null role or text counts as one space; rows of one turn are ordered by role, then
by digest of the text, repeated rows next to each other; null turns come first and count for no
gap; null conv_ids are one conversation; rows that are equal as given are damaged alike; an empty
role has the initial of a space; a gap beyond a long is null; other columns are not read; an empty
table gives no row.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
BLOCK = 64
SPACES = " \t\n\x0b\x0c\r"
# States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
LEGAL_ENDS = (START, ASSISTANT)
LEGAL_PAIRS = {"su", "ua", "au"}

Weight = tuple[int, str]
Items = tuple[Weight | None, ...]  # by state before and state after: 4 * before + after


# ---- deductions

def lightest(axioms: Iterable[tuple[object, Weight]], deduce: Callable[[object], Iterable[tuple[object, Weight]]]) -> dict:
    """The least weight of each item. `deduce(item)` gives what follows from it, and the edit's weight.

    Every popped item is final, as joining an edit never lowers a weight.
    """
    agenda = [(weight, item) for item, weight in axioms]
    heapq.heapify(agenda)
    final: dict = {}
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        for reached, (cost, audit) in deduce(item):
            if reached not in final:
                heapq.heappush(agenda, ((weight[0] + cost, weight[1] + audit), reached))
    return final


@functools.lru_cache(1 << 14)
def block_items(roles: str, faults: str) -> Items:
    """Items of a few rows, from their role initials and first faults (b, d, t or -)."""
    n = len(roles)

    def deduce(item: tuple[int, int, int]) -> Iterator[tuple[tuple[int, int, int], Weight]]:
        before, at, state = item
        said = [(role, to) for role, to in NEXT[state].items() if role != "s"]
        for _, to in said:
            yield (before, at, to), (INSERT, "I")
        if at == n:
            return
        yield (before, at + 1, state), (DELETE, "D")
        if faults[at] in "bd":
            return
        more = TRUNCATED if faults[at] == "t" else 0
        if roles[at] in NEXT[state]:
            yield (before, at + 1, NEXT[state][roles[at]]), (KEEP + more, "K")
        for _, to in said:
            yield (before, at + 1, to), (REROLE + more, "R")

    final = lightest([((q, 0, q), (0, "")) for q in range(4)], deduce)
    return tuple(final.get((q, n, r)) for q in range(4) for r in range(4))


def join_items(left: Items, right: Items) -> Items:
    """Items of two neighbouring stretches of rows: each left one with each right one that it meets."""

    def deduce(item: tuple[int, int, int]) -> Iterator[tuple[tuple[int, int, int], Weight]]:
        before, parts, state = item
        if parts < 2:
            for to, weight in enumerate((left, right)[parts][4 * state : 4 * state + 4]):
                if weight is not None:
                    yield (before, parts + 1, to), weight

    final = lightest([((q, 0, q), (0, "")) for q in range(4)], deduce)
    return tuple(final.get((q, 2, r)) for q in range(4) for r in range(4))


class Stretch:
    """Items of rows as they come: blocks of one size are joined in pairs, like digits that carry."""

    def __init__(self):
        self._stack: list[tuple[int, Items]] = []
        self._roles, self._faults = [], []

    def add(self, role: str, fault: str) -> None:
        self._roles.append(role)
        self._faults.append(fault)
        if len(self._roles) == BLOCK:
            self._close()

    def push(self, items: Items, level: int = 0) -> None:
        while self._stack and self._stack[-1][0] <= level:
            level, items = level + 1, join_items(self._stack.pop()[1], items)
        self._stack.append((level, items))

    def _close(self) -> None:
        self.push(block_items("".join(self._roles), "".join(self._faults)))
        self._roles, self._faults = [], []

    def items(self) -> Items:
        if self._roles:
            self._close()
        out = self._stack.pop()[1] if self._stack else block_items("", "")
        while self._stack:
            out = join_items(self._stack.pop()[1], out)
        return out


def goal(items: Items) -> Weight:
    """The cheapest repair of a whole conversation."""
    return min(items[q] for q in LEGAL_ENDS if items[q] is not None)


# ---- rows

def damage(conversations: DataFrame) -> DataFrame:
    """`(conv_id, turn, role, text, copy, dropped)`: the damaged rows, and those that damage drops."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), filled("role").alias("role"), filled("text").alias("text"),
        (F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20).alias("how"))
    how = F.col("how")
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy"), (how == 0).alias("dropped"))


def _ordered(rows: DataFrame) -> DataFrame:
    """With `digest`, the last of the columns that order rows within a turn."""
    return rows.where("not dropped").withColumn("digest", F.unhex(F.sha2("text", 256)))


def first_faults(rows: DataFrame) -> DataFrame:
    """`(conv_id, turn, role, digest, copy, initial, fault)` of the rows that are left."""
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    fault = F.when(end == "", "b").when(~end.isin(".", "!", "?"), "t").otherwise("-")
    known = _ordered(rows).select("conv_id", "turn", "role", "digest", "copy", fault.alias("own"))
    # Equal role and text share a window; what comes after its first row was seen earlier.
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("turn", "copy")) > 1
    initial = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1))
    return known.select(
        "conv_id", "turn", "role", "digest", "copy", initial.alias("initial"),
        F.when(again & (F.col("own") != "b"), "d").otherwise(F.col("own")).alias("fault"))


PART = (
    "struct<blank: long, duplicate: long, truncated: long, illegal: long, first: string, last: string, low: long, high: long, "
    "turns: long, costs: array<long>, audits: array<string>>")
_PART = pa.struct([
    *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string()),
    ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


class _Part:
    """What is known of consecutive rows of one conversation."""

    def __init__(self):
        self.faults = {"b": 0, "d": 0, "t": 0, "-": 0}
        self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None
        self.rows = Stretch()

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        self.faults[fault] += 1
        self._meet(initial)
        self.last = initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.rows.add(initial, fault)

    def _meet(self, initial: str) -> None:
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL_PAIRS:
            self.illegal += 1

    def join(self, part: dict) -> None:
        """Take the rows of a later part."""
        for name, fault in (("blank", "b"), ("duplicate", "d"), ("truncated", "t")):
            self.faults[fault] += part[name]
        self._meet(part["first"])
        self.illegal += part["illegal"]
        self.last = part["last"]
        if part["low"] is not None:
            self.turns += part["turns"] - (self.high == part["low"])
            self.low, self.high = part["low"] if self.low is None else self.low, part["high"]
        self.rows.push(tuple((c, a) if c >= 0 else None for c, a in zip(part["costs"], part["audits"])))

    def row(self) -> dict:
        items = self.rows.items()
        return {
            "blank": self.faults["b"], "duplicate": self.faults["d"], "truncated": self.faults["t"], "illegal": self.illegal,
            "first": self.first, "last": self.last, "low": self.low, "high": self.high, "turns": self.turns,
            "costs": [-1 if w is None else w[0] for w in items], "audits": ["" if w is None else w[1] for w in items]}


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of a task, from its rows in order."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId()  # ranges are in order
    at, part, started = None, None, False

    def out(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in done], pa.int64()), pa.array([number] * len(done), pa.int32()), pa.array([p for _, p in done], _PART)],
            ["conv_id", "number", "part"])

    for batch in batches:
        done = []
        for conv, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault"))):
            if not started or conv != at:
                if started:
                    done.append((at, part.row()))
                at, part, started = conv, _Part(), True
            part.add(turn, initial, fault)
        yield out(done)
    if started:
        yield out([(at, part.row())])


class _Repair:
    """Applies an audit to rows as they come and hashes what is left."""

    def __init__(self, audit: str):
        self._audit, self._at, self._state, self._sha, self._any = audit, 0, START, hashlib.sha256(), False

    def _say(self, role: str, text: str, initial: str) -> None:
        self._sha.update(f"{chr(10) if self._any else ''}{role}:{text}".encode())
        self._any, self._state = True, NEXT[self._state][initial]

    def _new(self, text: str) -> None:
        initial = "a" if self._state == USER else "u"
        self._say("assistant" if initial == "a" else "user", text, initial)

    def _inserts(self) -> None:
        while self._audit[self._at : self._at + 1] == "I":
            self._new("")
            self._at += 1

    def add(self, role: str, text: str) -> None:
        self._inserts()
        edit = self._audit[self._at]
        self._at += 1
        if edit == "K":
            self._say(role, text, role[:1])
        elif edit == "R":
            self._new(text)

    def digest(self) -> str:
        self._inserts()
        return self._sha.hexdigest()


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation, from its parts (side 0), its rows in order (1) and its dropped rows (2)."""
    names = [f.split()[0] for f in RESULT.split(", ")]
    at, started, part, repair, cost, audit = None, False, None, None, 0, ""

    def begin() -> None:
        nonlocal repair, cost, audit
        cost, audit = goal(part.rows.items()) if part else (0, "")
        repair = _Repair(audit)

    def close() -> tuple:
        if repair is None:
            begin()
        digest = repair.digest()
        if part is None:
            return (at, 0, 0, 0, 0, 0, 0, "", digest)
        gaps = 0 if part.low is None else part.high - part.low + 1 - part.turns
        faults = part.faults
        return (at, gaps if gaps < 1 << 63 else None, faults["b"], faults["d"], faults["t"], part.illegal, cost, audit, digest)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    for batch in batches:
        done = []
        for conv, side, found, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "side", "part", "role", "text"))):
            if not started or conv != at:
                if started:
                    done.append(close())
                at, started, part, repair = conv, True, None, None
            if side == 0:
                part = part or _Part()
                part.join(found)
            elif side == 1:
                if repair is None:
                    begin()
                repair.add(role, text)
        yield out(done)
    if started:
        yield out([close()])


def repair(conversations: DataFrame) -> DataFrame:
    """Per conversation: its faults after damage, and the cheapest repair."""
    return repair_damaged(damage(conversations))


def repair_damaged(rows: DataFrame) -> DataFrame:
    """As `repair`, of `(conv_id, turn, role, text, copy, dropped)`."""
    place = ["conv_id", "turn", "role", "digest"]
    # Equal rows stay in one range; ranges cut a conversation of any length.
    parts = (
        first_faults(rows).repartitionByRange(*place).sortWithinPartitions(*place, "copy")
        .select("conv_id", "turn", "initial", "fault").mapInArrow(_parts, f"conv_id long, number int, part {PART}"))
    none = lambda kind: F.lit(None).cast(kind)
    shape = ["conv_id", "side", "number", "part", "turn", "role", "digest", "copy", "text"]
    first = parts.select(
        "conv_id", F.lit(0).alias("side"), "number", "part", none("long").alias("turn"), none("string").alias("role"),
        none("binary").alias("digest"), none("int").alias("copy"), none("string").alias("text"))
    left = _ordered(rows).select(
        "conv_id", F.lit(1).alias("side"), none("int").alias("number"), none(PART).alias("part"), "turn", "role", "digest", "copy", "text")
    gone = rows.where("dropped").select("conv_id").distinct().select(
        "conv_id", F.lit(2).alias("side"), none("int").alias("number"), none(PART).alias("part"), none("long").alias("turn"),
        none("string").alias("role"), none("binary").alias("digest"), none("int").alias("copy"), none("string").alias("text"))
    return (
        first.select(*shape).unionByName(left).unionByName(gone).repartition("conv_id")
        .sortWithinPartitions("conv_id", "side", "number", "turn", "role", "digest", "copy")
        .select("conv_id", "side", "part", "role", "text").mapInArrow(_finish, RESULT))

