"""Safe paths, snippets, validation, application and the fix report."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from codeaudit.operators import enrich, patch, piecetable
from codeaudit.sources.corpus import write_bucketed


def test_safe_paths(spark, tree):
    files = tree(r={"in.py": "", "d/e.py": ""}, s={"other.py": ""})
    asked = spark.createDataFrame(
        [("r", p) for p in ("in.py", "../in.py", "d/../in.py", "missing.py", "/in.py", "d/e.py", "other.py")],
        "repo string, path string",
    )
    got = {r["path"]: r["safe_path"] for r in patch.safe_paths(asked, files).collect()}
    assert got == {"in.py": "in.py", "d/../in.py": "in.py", "d/e.py": "d/e.py"}


@pytest.mark.parametrize("line", [1, 5, 9, 10, 25, 30, 38, 39, 99])
def test_snippet(spark, line):
    lines = [f"l{n}" for n in range(1, 31)]
    frame = spark.createDataFrame([("\n".join(lines) + "\n", line)], "c string, l int")
    got = frame.select(patch.snippet(F.col("c"), F.col("l"))).first()[0]
    assert got == "\n".join(lines[max(0, line - 9):line + 8])


def apply(spark, tree, content, pairs, **options):
    files = tree(r={"m.py": content, "other.py": "x"})
    patches = spark.createDataFrame(
        [("r", "m.py", n, a, b) for n, (a, b) in enumerate(pairs)],
        "repo string, path string, ord int, original string, fixed string",
    )
    rows = patch.apply_patches(files, patches, **options).collect()
    assert [r["path"] for r in rows] == ["m.py"]
    return rows[0]["new_content"], rows[0]["n_applied"]


def test_apply(spark, tree):
    assert apply(spark, tree, "def f(x=[]):\n", [("x=[]", "x=None")]) == ("def f(x=None):\n", 1)
    assert apply(spark, tree, "a = 1\na = 1\n", [("a = 1", "a = 2")]) == ("a = 1\na = 1\n", 0)
    assert apply(spark, tree, "a\r\nb", [("a\nb", "c")]) == ("c", 1)
    assert apply(spark, tree, "ab", [("a", "aa"), ("aa", "c"), ("zz", "y"), ("", "q")]) == ("cb", 2)


def one_after_the_other(text, pairs):
    n = 0
    for old, new in pairs:
        if old and new is not None and text.count(old) == 1:
            text, n = text.replace(old, new, 1), n + 1
    return text, n


@pytest.mark.parametrize("size", [1, 2, 5, 4096])
def test_pieces_equal_one_after_the_other(size):
    rng = random.Random(11)
    for _ in range(400):
        text = "".join(rng.choice("abü") for _ in range(rng.randrange(40)))
        some = lambda n: "".join(rng.choices("abcü", k=rng.randrange(n)))
        pairs = [(some(5), some(6) if rng.random() < 0.9 else None) for _ in range(12)]
        pieces = piecetable.PieceText(text, size)
        pieces.apply(pairs[:7])
        pieces.apply(pairs[7:])
        assert (pieces.text(), pieces.applied) == one_after_the_other(text, pairs)


def test_apply_equals_one_after_the_other(spark, tree):
    rng = random.Random(12)
    text = "".join(rng.choice("abc") for _ in range(60))
    pairs = [("".join(rng.choices("abcd", k=3)), "".join(rng.choices("abcd", k=3))) for _ in range(40)]
    assert apply(spark, tree, text, pairs) == one_after_the_other(text, pairs)


def test_many_patches_on_one_file(spark, tree):
    lines = [f"value_{n} = {n}" for n in range(12_000)]
    pairs = [(f"value_{n} = {n}\n", f"value_{n} = {n} + 1\n") for n in range(0, 10_000)]
    pairs += [(f" = {n} + 1", f" = {n} + 2") for n in range(9_000, 9_500)] + [("value_1", "x"), ("absent", "y")]
    text = "\n".join(lines)
    start = time.perf_counter()
    got = apply(spark, tree, text, pairs)
    assert time.perf_counter() - start < 60
    assert got == one_after_the_other(text, pairs) and got[1] == 10_500


def test_spellings_of_a_path_are_one_file_and_refused_patches_show(spark, tree):
    files = tree(r={"a/b.py": "one"})
    patches = spark.createDataFrame(
        [("r", "a/./b.py", 0, "one", "two"), ("r", "a/x/../b.py", 1, "two", "six"), ("r", "../b.py", 2, "a", "b"),
         ("r", "c.py", 3, "a", "b")],
        "repo string, path string, ord int, original string, fixed string",
    )
    assert [tuple(r) for r in patch.apply_patches(files, patches).collect()] == [("r", "a/b.py", "six", 2)]
    refused = patch.refused_patches(files, patches).select("path", "reason").collect()
    assert {tuple(r) for r in refused} == {("../b.py", "outside"), ("c.py", "no file")}


def test_validate_and_report(spark, tree, finding_rows):
    files = tree(r={"m.py": "one\ntwo\ntwo\nlast\n", "n.py": "solo"})
    candidates = finding_rows([
        ("v", "quality", 2, "m.py", 1), ("v", "quality", 2, "../n.py", 1), ("v", "quality", 2, "n.py", 1),
    ]).withColumn("i", F.col("seq").cast("int"))
    items = [
        {"i": 0, "original": "one\n", "fixed": "1\n", "note": "better"}, {"i": 0, "original": "two", "fixed": "2"},
        {"i": 0, "original": "last", "fixed": "last"}, {"i": 0, "original": "last"}, {"i": 0, "original": "", "fixed": "x"},
        {"i": 1, "original": "solo", "fixed": "x"}, {"i": -1, "original": "solo", "fixed": "x"},
        {"i": 9, "original": "solo", "fixed": "x"}, {"i": 2, "original": "solo", "fixed": "x"},
    ]
    reply = spark.createDataFrame(
        [("v", "```json\n" + json.dumps(items) + "\n```"), ("w", "[broken")], "review_id string, reply string"
    )
    proposals = patch.validate_patches(enrich.fix_items(reply), candidates, files)
    rows = [(r["i"], r["file"], r["fixed"], r["note"]) for r in proposals.orderBy("pos").collect()]
    assert rows == [(0, "m.py", "1\n", "better"), (2, "n.py", "x", "")]
    made = patch.fix_report(proposals).first()
    assert [p["file"] for p in json.loads(made["fixes_json"])] == ["m.py", "n.py"]
    assert made["fixes_md"] == (
        "# Proposed fixes\n\n## 1. title 0 (`m.py:1`, `R2`)\nbetter\n\n```diff\n- one\n+ 1\n```\n\n"
        "## 2. title 2 (`n.py:1`, `R2`)\n\n```diff\n- solo\n+ x\n```\n"
    )
    parts = patch.fix_report(proposals, part_fixes=1).orderBy("part").collect()
    assert "\n".join(p["fixes_md"] for p in parts) == made["fixes_md"] and [p["part"] for p in parts] == [0, 1]
    prompts = enrich.fix_prompts(patch.fix_snippets(candidates, files)).first()
    assert [p["snippet"] for p in json.loads(prompts["payload"])] == ["one\ntwo\ntwo\nlast", "solo"]


def test_bucketed_corpora_keep_contents_in_place(spark, tree, finding_rows):
    files = tree(r={f"f{n}.py": f"line {n}\n" for n in range(50)})
    write_bucketed(files, "bucketed_corpus", 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        corpus = spark.table("bucketed_corpus")
        candidates = finding_rows([("r", "quality", 2, f"f{n}.py", 1) for n in range(50)]).withColumn("i", F.col("seq").cast("int"))
        items = candidates.select("review_id", F.col("seq").alias("pos"), "i", F.lit("line").alias("original"), F.lit("row").alias("fixed"), F.lit("").alias("note"))
        for found in (patch.fix_snippets(candidates, corpus), patch.validate_patches(items, candidates, corpus)):
            plan = found._jdf.queryExecution().executedPlan()
            text = plan.toString()
            assert "Bucketed: true" in text and "Exchange" in text
            scans = [part for part in text.split("Exchange")[1:] if "content" in part.split("Scan")[0]]
            assert not scans
            assert found.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE bucketed_corpus")
