"""Fingerprints and their components against plain versions, dense groups, and awkward rows."""

import re

import numpy as np
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from codeaudit.llm import simhash
from codeaudit.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(len(words) - 3, min(len(words), 1)))]
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in values) > len(values))


def plain_components(prints):
    """The smallest position reachable from each position."""
    group = list(range(len(prints)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.DISTANCE:
                x, y = sorted((root(i), root(j)))
                group[y] = x
    return [root(i) for i in range(len(prints))]


def test_xxh64_is_the_public_function(spark):
    rng = np.random.default_rng(3)
    buf = rng.integers(0, 256, 9000).astype(np.uint8)
    starts = np.concatenate([rng.integers(0, 5000, 300), [0, 0, 10]])
    ends = np.concatenate([starts[:300] + rng.integers(0, 200, 300), [9000, 0, 10]])
    expected = [xxhash.xxh64_intdigest(buf[a:b].tobytes(), 42) for a, b in zip(starts, ends)]
    assert simhash.xxh64(buf, starts, ends).tolist() == expected
    row = spark.range(1).select(F.xxhash64(F.lit("four words in all"))).first()[0]
    assert row % (1 << 64) == xxhash.xxh64_intdigest("four words in all", 42)


def test_majority_of_long_groups():
    rng = np.random.default_rng(4)
    counts = np.array([0, 1, 255, 256, 3000, 0, 2])
    values = rng.integers(0, 1 << 63, counts.sum(), dtype=np.uint64) | rng.integers(0, 2, counts.sum(), dtype=np.uint64) << np.uint64(63)
    ends = np.cumsum(counts)
    expected = [sum(1 << k for k in range(64) if 2 * sum(int(v) >> k & 1 for v in values[e - n : e]) > n) for e, n in zip(ends, counts)]
    assert simhash.majority(values, counts).tolist() == expected


def test_query_against_plain(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist())
    prints = [plain_print(t) for _, t in docs]
    expected = [(d, f"{p:016x}", docs[c][0]) for (d, _), p, c in zip(docs, prints, plain_components(prints))]
    got = QUERIES["op11_simhash_near_dedup"](spark, FOLDER).select("doc_id", "fingerprint", "component_id")
    assert sorted(map(tuple, got.collect())) == expected


def test_some_segment_is_within_its_ball():
    assert simhash.radii(4, 3) == [1, 1, 0] and simhash.radii(4, 4) == [1, 0, 0, 0] and simhash.radii(1, 3) == [0, 0, -1]


def chained(n, seed):
    """A dense group around one value, a chain of steps of four bits, and strangers."""
    rng = np.random.default_rng(seed)
    out, at = {int(rng.integers(1 << 62))}, int(rng.integers(1 << 62))
    centre = next(iter(out))
    while len(out) < n:
        out.add(centre ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 7))}))
    for _ in range(40):
        at ^= sum({1 << int(b) for b in rng.choice(64, 4, replace=False)})
        out.add(at)
    out.update(int(x) for x in rng.integers(0, 1 << 62, 60))
    return sorted(v if v < 1 << 63 else v - (1 << 64) for v in out)


def test_links_join_all_near_prints_and_no_others(spark):
    values = chained(500, 7)
    group = plain_components([v % (1 << 64) for v in values])
    prints = spark.createDataFrame([(v,) for v in values], "print long")
    for segments, block in (((21, 21, 22), 4096), ((21, 21, 22), 16), ((16, 16, 16, 16), 50)):
        rows = simhash.links(prints, segments=segments, block=block).collect()
        parent = {v: v for v in values}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in rows:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        assert [values.index(root(v)) for v in values] == group


def test_links_of_a_dense_group_grow_with_its_rows(spark):
    for n in (500, 2000):
        values = chained(n, 9)
        prints = spark.createDataFrame([(v,) for v in values], "print long")
        bits = np.array(values).view(np.uint64)
        near = (np.bitwise_count(bits[:, None] ^ bits[None]) <= simhash.DISTANCE).sum() // 2
        # A print asks in about 22 slots and is linked at most once in each batch of one.
        assert simhash.links(prints).count() < min(8 * len(values), near)


def test_awkward_rows(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    text = "One two  three\nFOUR five six"
    rows = [(1, long), (2, text), (2, text), (3, text.upper()), (None, text), (4, None), (5, ""), (6, " \t\n"), (None, None), (7, "one two"), (8, "ONE two"), (9, "x" * 5000), (10, "Ünïcode wörd   　 ß")]
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fingerprint string, print long")
    got = simhash.near_components(docs).collect()
    assert sorted((r.doc_id or 0, r.fingerprint) for r in got) == sorted((i or 0, f"{plain_print(t):016x}") for i, t in rows)
    low = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert low[3, f"{plain_print(text):016x}"] == 2 and low[None, f"{plain_print(text):016x}"] == 2
    assert {low[i, "0" * 16] for i in (4, 5, 6, None)} == {4} and low[8, f"{plain_print('one two'):016x}"] == 7
    assert simhash.near_components(docs.where("false")).count() == 0
    nameless = simhash.near_components(docs.where("doc_id is null and text is not null")).collect()
    assert [(r.doc_id, r.component_id) for r in nameless] == [(None, None)]
