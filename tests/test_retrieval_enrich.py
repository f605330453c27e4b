"""Chunk index, retrieval, prompts and replies."""

import itertools
import json
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeaudit import fixed
from codeaudit.operators import enrich, nearest, postings, retrieval
from codeaudit.schemas import TRIAGE_REPLY


def test_chunks(spark, tree):
    text = "\n".join(f"line {n}" for n in range(1, 8)) + "\n\n\n\n \n"
    files = tree(r={"b/x.py": text, "b.md": "only", "a.js": "no", "data/x.py": "no", "e.txt": ""})
    got = retrieval.chunk_index(files, ("rules.md", "rule one"), chunk_size=3).orderBy("ord").collect()
    assert [(r["ord"], r["source"]) for r in got] == [
        (0, "b/x.py:1"), (1, "b/x.py:4"), (2, "b/x.py:7"), (3, "b.md:1"), (4, "rules.md:1"),
    ]
    assert got[2]["text"] == "line 7"


def test_index_caps(spark, tree):
    files = tree(r={f"f{n:03}.txt": "w\n" * 4 for n in range(9)}, s={"a.txt": "x"})
    got = retrieval.chunk_index(files, ("z.md", "z"), chunk_size=1, max_files=3, max_chunks=10)
    rows = got.filter("repo = 'r'").orderBy("ord").collect()
    assert [r["source"] for r in rows] == [f"f{n:03}.txt:{i}" for n in range(3) for i in range(1, 5)][:10]
    assert [r["source"] for r in got.filter("repo = 's'").orderBy("ord").collect()] == ["a.txt:1", "z.md:1"]


def test_keyword_search(spark, tree):
    files = tree(r={
        "pay.py": "def charge_card(card): refund refund", "mail.py": "send the mail", "none.txt": "1 2 3",
    }, other={"pay.py": "charge card"})
    queries = spark.createDataFrame(
        [(1, "r", "Charge the CARD!"), (2, "r", "?? a"), (3, "r", "absent words")], "query_id int, repo string, query string"
    )
    chunks = retrieval.chunk_index(files)
    best = retrieval.keyword_topk(chunks, queries, k=2)
    got = [(r["query_id"], r["rank"], r["source"], round(r["score"], 4)) for r in best.orderBy("rank").collect()]
    # 7 words in the first chunk after splitting at underscores, 3 in the second.
    assert got == [(1, 1, "pay.py:1", round(3 / 6**0.5, 4)), (1, 2, "mail.py:1", round(1 / 3**0.5, 4))]
    context = retrieval.context_blocks(best, chunks).first()["context"]
    assert context == "[pay.py:1]\ndef charge_card(card): refund refund\n\n[mail.py:1]\nsend the mail"


@pytest.mark.parametrize("rows, cell, limit", [(16, 10, 60), (4096, 256, None), (7, 3, None)])
def test_nearest_vectors_against_brute_force(spark, monkeypatch, rows, cell, limit):
    monkeypatch.setattr(nearest, "ROWS", rows)
    monkeypatch.setattr(nearest.pivots, "__defaults__", (256, cell))
    rng = np.random.default_rng(3)
    vectors = [(f"r{n % 3 if n % 2 else 0}", n, rng.normal(size=8).round(2).tolist()) for n in range(200)]
    frame = spark.createDataFrame(vectors, "repo string, vec_id long, vector array<float>")
    index = retrieval.vector_index(frame, ["vec_id"], max_chunks=limit)
    queries = frame.withColumnRenamed("vec_id", "query_id")
    got = {}
    for row in retrieval.vector_topk(index, queries, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row["ord"])
    for repo, number, vector in vectors:
        held = [np.float32(v) for r, _, v in vectors if r == repo][:limit]
        distance = [round(float(np.square(v.astype("f8") - np.float32(vector).astype("f8")).sum()), 6) for v in held]
        assert got[number] == sorted(range(len(held)), key=lambda i: (distance[i], i))[:5]


def test_pivots_rule_cells_out(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8)) * 50
    vectors = [("hot", n, (centres[n % 20] + rng.normal(size=8)).tolist()) for n in range(2000)]
    frame = spark.createDataFrame(vectors, "repo string, ord long, vector array<double>")
    chosen = nearest.pivots(frame, cell=25)
    placed = nearest._blocks(nearest.assign(frame, chosen), ["repo", "cell"], "ord", nearest.ROWS)
    known = nearest.cells(placed, chosen)
    queries = frame.filter("ord < 100").withColumnRenamed("ord", "query_id").withColumn("limit", F.lit(20.0))
    asked = [nearest.cells_to_search(queries, known, 4, first).count() for first in (True, False)]
    assert known.count() == 80 and asked[0] < 200 and sum(asked) < 0.25 * 100 * 80
    # A repository of all rows is dealt to blocks of a bounded number of rows.
    spread = nearest._blocks(frame, ["repo"], "ord", 100)
    assert spread.groupBy("_block").count().agg(F.max("count")).first()[0] < 200


def test_a_vector_moves_once_for_a_tile(spark, monkeypatch):
    """A row for each query and cell grew with the square of the table."""
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame([("hot", n, rng.normal(size=8).tolist()) for n in range(600)], "repo string, ord long, vector array<double>")
    chosen = nearest.pivots(frame, cell=20)
    monkeypatch.setattr(nearest, "TILE", 200)
    placed = nearest._blocks(nearest.assign(frame, chosen), ["repo", "cell"], "ord", nearest.ROWS)
    known = nearest.cells(placed, chosen)
    queries = frame.withColumnRenamed("ord", "query_id").withColumn("limit", F.lit(1e6))
    rows = nearest.cells_to_search(queries, known, 4, False)
    tiles = {tile for row in known.collect() for tile in row["tiles"]}
    assert known.count() == 30 and len(tiles) in (3, 4) and rows.count() <= 600 * len(tiles)
    first = nearest.cells_to_search(queries, known, 4, True)
    asked = sum(f.select(F.sum(F.size("cells"))).first()[0] for f in (first, rows))
    assert asked == sum(600 * len(row["tiles"]) for row in known.collect())


def test_distances_take_bounded_memory():
    """Differences of a block and its pivots were held by pairs, whatever the length of a vector."""
    a, b = np.ones((4096, 64)), np.zeros((256, 64))
    tracemalloc.start()
    apart = nearest._squares(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (apart == 64).all() and peak < 40e6


def test_best_by_products_are_the_best_by_differences():
    rng = np.random.default_rng(6)
    held = np.repeat(rng.normal(size=(150, 6)) + 1000, 2, axis=0)
    cell, number = np.sort(rng.integers(0, 7, 300)), rng.permutation(300)
    number = np.concatenate([np.sort(number[cell == c]) for c in range(7)])
    asked = held[::3] + rng.normal(size=(100, 6)) * 1e-4
    cells = np.array([np.sort(rng.choice(7, rng.integers(1, 8), replace=False)) for _ in asked] + [None], object)[:-1]
    for limit in (np.inf, 5.0):
        row, distance, at = nearest._best(asked, cells, np.full(100, limit), held, cell, number, 4)
        for n in range(100):
            inside = np.isin(cell, cells[n])
            apart = np.square(asked[n] - held[inside]).sum(axis=1).round(6)
            wanted = sorted((d, i) for d, i in zip(apart, number[inside]))[:4]
            got = list(zip(distance[row == n], at[row == n]))
            near = [pair for pair in wanted if pair[0] <= limit]
            assert got[: len(near)] == near and (limit < np.inf or len(got) == len(wanted))


def plain_best(chunks, queries, k):
    out = {}
    for query, repo, text in queries:
        wanted = {w.lower() for w in re.findall("[A-Za-z]{3,}", text)}
        scored = []
        for r, at, body in chunks:
            found = [w.lower() for w in re.findall("[A-Za-z]{3,}", body)]
            hits = sum(w in wanted for w in found)
            if r == repo and hits:
                scored.append((-hits / len(found) ** 0.5, at))
        out[query] = [(at, round(-s, 9)) for s, at in sorted(scored)[:k]]
    return {q: best for q, best in out.items() if best}


@pytest.mark.parametrize("shard, block", [(4096, 128), (50, 4), (7, 1)])
def test_blocks_give_the_best_of_all_chunks(spark, shard, block):
    rng = random.Random(21)
    word = lambda: f"w{'abcdefgh'[min(7, int(rng.expovariate(0.5)))]}{'xyz'[rng.randrange(3)]}"
    chunks = [(rng.choice(("hot", "hot", "r")), n, " ".join(word() for _ in range(rng.randrange(1, 25)))) for n in range(600)]
    queries = [(n, rng.choice(("hot", "r", "none")), " ".join(word() for _ in range(rng.randrange(4)))) for n in range(30)]
    frame = spark.createDataFrame(chunks, "repo string, ord long, text string")
    asked = spark.createDataFrame(queries, "query_id int, repo string, query string")
    index = postings.build_index(frame, shard=shard, block=block)
    got = {}
    for r in postings.search(index, asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["ord"], round(r["score"], 9)))
    assert got == plain_best(chunks, queries, 5)


def test_counted_words_leave_in_bounded_parts(spark):
    """The words of 512 texts were held together, whatever their length."""

    class Chunks:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    text = " ".join(map("".join, itertools.islice(itertools.product("abcdefgh", repeat=4), 3000)))
    batch = pa.RecordBatch.from_pydict({"repo": ["r"] * 50, "ord": [*range(50)], "text": [text] * 48 + [None, "One one"]})
    parts = [*postings.word_counts(Chunks())(iter([batch]))]
    assert max(part.num_rows for part in parts) < postings.COUNTED + 3000
    rows = [row for part in parts for row in part.to_pylist()]
    assert len(rows) == 48 * 3000 + 1 and {(row["times"], row["n_words"]) for row in rows[:-1]} == {(1, 3000)}
    assert rows[-1] == {"repo": "r", "ord": 49, "word": "one", "times": 2, "n_words": 2}


def test_blocks_below_the_bound_are_skipped(spark):
    chunks = [("r", n, "common " * (40 if n < 6 else 1) + f"filler{'abcdefghij'[n % 10]} " * 10) for n in range(3000)]
    frame = spark.createDataFrame(chunks, "repo string, ord long, text string")
    asked = spark.createDataFrame([(1, "r", "common")], "query_id int, repo string, query string")
    index = postings.build_index(frame, block=32)
    read = postings.needed_blocks(index, postings.asked_words(asked), 4).count()
    assert read == 1 and index.filter("word = 'common'").count() > 90


def test_retrieve_falls_back_to_keywords(spark):
    chunks = spark.createDataFrame([("v", 0, "a:1", "alpha word"), ("v", 1, "a:2", "beta word"), ("k", 0, "b:1", "alpha word")], "repo string, ord long, source string, text string")
    queries = spark.createDataFrame([(1, "v", "alpha"), (2, "k", "alpha"), (3, "v", "beta"), (4, "v", " \t"), (5, "none", "alpha")], "query_id int, repo string, query string")
    vectors = spark.createDataFrame([("v", 0, [0.0, 1.0]), ("v", 1, [1.0, 0.0]), ("v", 9, [1.0, 0.0])], "repo string, ord long, vector array<double>")
    wanted = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 0.0])], "query_id int, vector array<double>")
    got = retrieval.retrieve(chunks, queries, vectors, wanted, k=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["ord"], r["backend"]) for r in got] == [
        (1, 1, "vector"), (1, 0, "vector"), (2, 0, "keyword"), (3, 1, "keyword"),
    ]
    assert {r["backend"] for r in retrieval.retrieve(chunks, queries).collect()} == {"keyword"}


def test_chunk_numbers_need_no_sort_of_texts(spark, tree):
    files = tree(hot={f"d{n % 7}/f{n:03}.md": "\n".join(f"line {i}" for i in range(n % 9)) for n in range(200)}, one={"a.md": "x"})
    index = retrieval.chunk_index(files, ("rules.md", "rule"), chunk_size=2)
    plain = retrieval.chunk_lines(retrieval.indexed_files(files), 2).collect()
    order = sorted((r["repo"], r["path"].split("/"), r["first_line"], r["path"]) for r in plain)
    expected = [(repo, f"{path}:{line}") for repo, _, line, path in order]
    got = [(r["repo"], r["source"]) for r in index.orderBy("repo", "ord").collect() if not r["source"].startswith("rules")]
    assert got == expected
    for repo, n in (("hot", None), ("one", None)):
        numbers = [r["ord"] for r in index.filter(F.col("repo") == repo).orderBy("ord").collect()]
        assert numbers == list(range(len(numbers)))
    plan = index._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange" in line or "Sort " in line]
    assert not any("text" in line for line in moved)


def test_retrieval_query_is_cut_and_distinct(spark, finding_rows):
    rows = [("r", "quality", 1, f"f{n:04}", 1) for n in range(900)]
    found = finding_rows(rows).withColumn("title", F.concat(F.lit("t"), (F.col("seq") / 2).cast("int")))
    full = " ".join(dict.fromkeys(f"R1 t{n // 2}" for n in range(900)))
    for chars in (600, None):
        text = retrieval.retrieval_queries(found, ["review_id"], ["seq"], chars).first()["query"]
        assert text == full[:chars]


def replies(spark, *texts):
    return spark.createDataFrame([("r", "quality", t) for t in texts], "review_id string, agent string, reply string")


def merged(spark, finding_rows, reply):
    found = finding_rows([("r", "quality", 1, f"f{n}", 1) for n in range(3)])
    rows = enrich.merge_triage(enrich.indexed_findings(found), replies(spark, reply)).orderBy("i").collect()
    assert len(rows) == 3
    return [(r["explanation"], r["fix_hint"]) for r in rows]


NONE = [("", "")] * 3


@pytest.mark.parametrize("reply, expected", [
    ('[{"i": 1, "explanation": "e", "fix": "f"}]', [("", ""), ("e", "f"), ("", "")]),
    ('  ```json\n[{"i": 0, "explanation": "e"}]\n``` ', [("e", ""), ("", ""), ("", "")]),
    ('[{"i": 2, "fix": "a"}, {"i": 2, "fix": "b"}, {"i": 77, "fix": "c"}]', [("", ""), ("", ""), ("", "b")]),
    ('[{"i": 0, "explanation": "e"}, {"explanation": "lost"}]', NONE),
    ('[{"i": 0, "explanation": "e"', NONE),
    ("sorry, no", NONE),
    ("", NONE),
])
def test_replies(spark, finding_rows, reply, expected):
    assert merged(spark, finding_rows, reply) == expected


@pytest.mark.parametrize("per_prompt", [2, 100])
def test_prompts(spark, finding_rows, per_prompt):
    found = finding_rows([("r", "quality", n % 5, f"f{n}.py", n) for n in range(5)])
    contexts = spark.createDataFrame([("r", "quality", "[a:1]\ntext")], "review_id string, agent string, context string")
    indexed = enrich.indexed_findings(found)
    rows = enrich.triage_prompts(indexed, contexts, per_prompt=per_prompt).orderBy("batch").collect()
    items = [item for row in rows for item in json.loads(row["payload"])]
    assert [(item["i"], item["severity"]) for item in items] == list(
        enumerate(["Info", "Low", "Medium", "High", "Critical"])
    )
    assert len(rows) == (3 if per_prompt == 2 else 1)
    assert fixed.AGENT_ROLES["quality"] in rows[0]["prompt"] and "[a:1]\ntext" in rows[0]["prompt"]


def test_list_order_puts_reports_first_and_paths_by_component(finding_rows):
    found = finding_rows([
        ("r", "quality", 1, "a-b.py", 1), ("r", "quality", 1, "a/b.py", 9), ("r", "quality", 1, ".", 0),
        ("r", "security", 1, "z.py", 1), ("r", "security", 1, "a.py", 1),
    ])
    rows = enrich.indexed_findings(found).orderBy("agent", "i").collect()
    assert [r["file"] for r in rows] == [".", "a/b.py", "a-b.py", "z.py", "a.py"]


@pytest.mark.parametrize("reply", [
    '[{"i": 0, "explanation": "x", "fix": "y"}] Hope this helps!', "[{'i': 0, 'explanation': 'x', 'fix': 'y'}]", '{"i": 0, "explanation": "x", "fix": "y"}',
    '[{"i": 0, "explanation": "x", "fix": "y"}], [1]'])
def test_reply_that_is_not_one_array_changes_nothing(spark, reply):
    replies = spark.createDataFrame([("r", "quality", reply)], "review_id string, agent string, reply string")
    assert enrich.reply_items(replies, TRIAGE_REPLY).count() == 0


def test_reply_indices(spark):
    """An index of another kind is ignored; an item without one voids its reply."""
    found = spark.createDataFrame(
        [(k, "quality", i, f"R{i}") for k in range(8) for i in range(2)], "review_id int, agent string, i int, rule string")
    replies = [
        '[{"i": 0, "explanation": "a"}, {"i": "one"}]', '[{"i": 0, "explanation": "a"}, {"explanation": "b"}]',
        '[{"i": 0, "explanation": "a"}, {"i": null, "explanation": "b"}]', '[{"i": "0", "explanation": "a"}, {"i": 1, "fix": "f"}]',
        '[{"i": 1.0, "explanation": "a"}, {"i": 0.5}]', '[{"i": 0, "explanation": "a"}, 5]', '[{"i": 0, "explanation": "a"}] x',
        '[{"i": true}, {"i": 99999999999, "explanation": "b"}, {"i": 0, "explanation": "a"}, {"i": 0, "explanation": "c"}]',
    ]
    replied = spark.createDataFrame([(k, "quality", r) for k, r in enumerate(replies)], "review_id int, agent string, reply string")
    got = {(r["review_id"], r["i"]): (r["explanation"], r["fix_hint"]) for r in enrich.merge_triage(found, replied).collect()}
    assert len(got) == 16
    assert {k: v for k, v in got.items() if v != ("", "")} == {
        (0, 0): ("a", ""), (2, 0): ("a", ""), (3, 1): ("", "f"), (4, 1): ("a", ""), (7, 0): ("c", ""),
    }


def test_an_index_is_read_once(spark):
    """Kind and number of each index were read up to three times."""
    replies = spark.createDataFrame(
        [(1, ' ```json\n[{"i":1},{"i":2.5},{"i":"3"},{"i":4.0},{"i":null},{"i":1e300},{"i":true}]\n``` '), (2, '[{"i":5}]'), (3, '[{"i":6},{"fix":"x"}]')],
        "review_id int, reply string")
    items = enrich.reply_items(replies.withColumn("agent", F.lit("a")), "ARRAY<STRUCT<i: VARIANT, fix: STRING>>")
    read = items.select("review_id", enrich.index_of(F.col("item")).alias("i"))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schema_of_variant") <= 2 and plan.count("from_json") == 1
    assert sorted((r[0], r[1]) for r in read.filter("i IS NOT NULL").collect()) == [(1, 1), (1, 4), (2, 5)]
