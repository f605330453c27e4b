"""The repair agenda against all edits of small conversations, the query against a plain version, and awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from codeaudit.llm import repair
from codeaudit.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?")


def spelled(roles, audit):
    """Role initials that an audit can lead to, of rows and edits in order."""
    out, at = [""], 0
    for edit in audit:
        if edit == "K":
            out = [o + roles[at] for o in out]
        elif edit in "RI":
            out = [o + c for o in out for c in "ua"]
        at += edit != "I"
    return out


def all_edits(roles, faults, most=14):
    """The cheapest (cost, audit) by trying every audit with up to four inserts."""
    best = None
    for inserts in range(5):
        for edits in itertools.product("KRD", repeat=len(roles)):
            if any(f in "bd" and e != "D" for f, e in zip(faults, edits)):
                continue
            cost = 3 * inserts + sum({"K": 0, "R": 3, "D": 4}[e] + 3 * (f == "t" and e != "D") for e, f in zip(edits, faults))
            if best and cost > best[0] or cost > most:
                continue
            for places in itertools.combinations(range(len(roles) + inserts), inserts):
                rest = iter(edits)
                audit = "".join("I" if k in places else next(rest) for k in range(len(roles) + inserts))
                if (best is None or (cost, audit) < best) and any(LEGAL.fullmatch(o) for o in spelled(roles, audit)):
                    best = (cost, audit)
    return best


def test_agenda_against_all_edits():
    rng = random.Random(13)
    for _ in range(250):
        n = rng.randrange(6)
        roles = "".join(rng.choice("suax") for _ in range(n))
        faults = "".join(rng.choice("----tbd") for _ in range(n))
        expected = all_edits(roles, faults, 4 * n)
        assert repair.goal(repair.block_items(roles, faults)) == expected


def test_joined_blocks_give_the_items_of_the_whole(monkeypatch):
    rng = random.Random(14)
    for _ in range(60):
        n = rng.randrange(1, 40)
        roles = "".join(rng.choice("suuaax") for _ in range(n))
        faults = "".join(rng.choice("-----tbd") for _ in range(n))
        monkeypatch.setattr(repair, "BLOCK", rng.choice((1, 2, 3, 64)))
        stretch = repair.Stretch()
        for role, fault in zip(roles, faults):
            stretch.add(role, fault)
        assert stretch.items() == repair.block_items(roles, faults)


def damaged(rows):
    """Damaged rows by conversation, as the contract says it."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 0:
            continue
        row = (turn, "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text)
        mine += [row] * (2 if how == 3 else 1)
    return out


def plain(conv, rows):
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2])))
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("b" if not end else "d" if (role, text) in seen else "t" if end not in ".!?" else "-")
        seen.add((role, text))
    initials = [role[:1] or " " for _, role, _ in rows]
    # The least (cost, audit) of each (rows, state), states by what they have spelled.
    best = {(0, 0): (0, "")}
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    for i in range(len(rows) + 1):
        for _ in range(4):
            for q in range(4):
                if (i, q) in best:
                    c, a = best[i, q]
                    for to in (t for r, t in step[q].items() if r != "s"):
                        best[i, to] = min(best.get((i, to), (10**9, "")), (c + 3, a + "I"))
        for q in range(4):
            if i < len(rows) and (i, q) in best:
                c, a = best[i, q]
                moves = [(q, 4, "D")]
                if faults[i] not in "bd":
                    more = 3 * (faults[i] == "t")
                    moves += [(t, more, "K") for r, t in step[q].items() if r == initials[i]]
                    moves += [(t, 3 + more, "R") for r, t in step[q].items() if r != "s"]
                for to, w, edit in moves:
                    best[i + 1, to] = min(best.get((i + 1, to), (10**9, "")), (c + w, a + edit))
    cost, audit = min(best[len(rows), q] for q in (0, 3) if (len(rows), q) in best)
    out, left = [], list(rows)
    for edit in audit:
        row = left.pop(0) if edit != "I" else None
        if edit == "K":
            out.append(row[1:])
        elif edit != "D":
            out.append(("assistant" if out and out[-1][0][0] == "u" else "user", row[2] if row else ""))
    turns = {t for t, *_ in rows if t is not None}
    return (
        conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"),
        sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def expected(rows):
    return sorted((plain(conv, mine) for conv, mine in damaged(rows).items()), key=str)


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_query_against_plain(spark, folder):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(f"{folder}/conversations.parquet").to_pylist()]
    assert result(QUERIES["op13_conversation_repair"](spark, folder)) == expected(rows)


SCHEMA = "conv_id long, turn long, role string, text string, copy string, cost string"


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_awkward_rows(spark):
    rng = random.Random(15)
    long = "word. " * 50_000
    rows = [
        (None, 1, "user", "a."), (None, None, "assistant", "b."), (None, None, None, None), (1, None, "user", "x"), (1, None, "user", "x"),
        (2, 5, "", ""), (2, 5, "user", long), (2, 9, "assistant", long + "end"), (2, -7, "tool", "call me!"), (3, 1, "User", "q?\x0b\n"), (3, 2, "user", "ü."),
        (4, -(1 << 63), "user", "a."), (4, (1 << 62), "assistant", "b.")]
    rows += [(rng.choice((5, 6, 7, None)), rng.choice((1, 2, 3, None)), rng.choice(("user", "assistant", "system", "x")), rng.choice("ab.?")) for _ in range(80)]
    # A gap that a long cannot hold is null.
    wanted = [(r[0], r[1] if r[1] < 1 << 63 else None, *r[2:]) for r in expected(rows)]
    assert result(repair.repair(made(spark, rows))) == sorted(wanted, key=str)
    nothing = made(spark, rows).where("false")
    assert repair.repair(nothing).count() == 0


def test_dropped_conversations_stay(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:1".encode()) % 20 == 0]
    got = result(repair.repair(made(spark, [(c, 1, "user", "a.") for c in gone])))
    assert [(r[0], r[7], r[8]) for r in got] == sorted(((c, "", hashlib.sha256().hexdigest()) for c in gone), key=str)
    assert {r[1:7] for r in got} == {(0,) * 6}


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(16)
    rows = [(1, t, rng.choice(("user", "assistant")), f"text {rng.randrange(500)}{rng.choice(('.', '', '?'))}") for t in range(3000) if t % 97]
    rows += [(2, 1, "user", "a."), (0, 4, "user", "a.")]
    frame = made(spark, rows).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = repair.first_faults(repair.damage(frame)).repartitionByRange("conv_id", "turn", "role", "digest")
        sizes = ranges.where("conv_id = 1").groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 2
        assert result(repair.repair(frame)) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
