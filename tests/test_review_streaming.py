"""Full reviews, plug-in detectors, trees on disk, deliveries and streams."""

import hashlib
import hmac
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codeaudit import fixed, storage
from codeaudit.fixtures import Views
from codeaudit.operators import history
from codeaudit.operators.history import read_history
from codeaudit.plans import review
from codeaudit.plans.catalog import QUERIES
from codeaudit.schemas import severity_dim
from codeaudit.sources import tree as source
from codeaudit.sources.corpus import read_corpus
from codeaudit.sources.reports import read_sast_reports
from codeaudit.sources.tree import scan_tree, write_tree
from codeaudit.storage import materialize, scratch_root
from codeaudit.streaming.deliveries import classify_deliveries
from codeaudit.streaming.runner import read_delivery_files, review_deliveries, write_classified

SF = "/root/testdata/sf0.001"
PLANTED = 'PASSWORD = "hunter22x"\n\n\ndef add(item, seen=[]):\n    return seen\n'


def test_planted_tree(spark, tree):
    files = tree(bad={"app.py": PLANTED}, good={"README.md": "# Good"}, img={"a.png": ""})
    done = review.run_review(files)
    found = {(r["repo"], r["agent"], r["rule"]) for r in done.findings.collect()}
    assert found == {
        ("bad", "security", "SECRET_GENERIC"), ("bad", "quality", "QUAL_MUTABLE_DEFAULT"),
        ("bad", "test-gap", "TEST_NO_TESTS"), ("bad", "documentation", "DOC_NO_README"),
        ("bad", "documentation", "DOC_NO_MODULE_DOC"), ("bad", "documentation", "DOC_MISSING_DOCSTRING"),
    }
    scores = {r["repo"]: r["health_score"] for r in done.scores().collect()}
    assert scores == {"bad": 100 - 10 - 4 - 4 - 1, "good": 100, "img": 100}
    status = {(r["repo"], r["agent"]): (r["error"], r["n_findings"]) for r in done.status().collect()}
    assert status[("bad", "documentation")] == (None, 3) and ("img", "security") not in status
    assert set(status) == {("bad", a) for a in review.fixed.AGENT_ORDER} | {("good", "documentation")}


def test_unrouted_repositories_get_no_findings(spark, tree):
    done = review.run_review(tree(notes={"a.txt": PLANTED}))
    assert done.findings.count() == 0
    assert [r["health_score"] for r in done.scores().collect()] == [100]


def test_partitioning_does_not_change_the_review(spark):
    files = Views(spark, SF).review_files()
    results = [
        sorted(map(tuple, review.run_review(files.repartition(n)).ranked().drop("seq").collect()), key=str)
        for n in (1, 64)
    ]
    assert results[0] == results[1] and results[0]


@pytest.fixture
def tables(spark, tmp_path):
    """Few documents, parts and line items, some values null."""
    lang, text = ["en", "de", "fr", None], ['token = "abcdefghij"', "Licence text", None]
    documents = [(n, text[n % 3], lang[n % 4], f"src{n % 3}") for n in range(60)]
    parts = [(n if n % 60 else None, n % 50) for n in range(300)]
    items = [(n % 120 if n % 11 else None, n % 40, n % 7 or None, n % 8) for n in range(400)]
    for name, rows, schema in (
        ("documents", documents, "doc_id long, text string, lang string, source string"),
        ("part", parts, "p_partkey long, p_size int"),
        ("lineitem", items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_reviews_write_no_copy_of_contents_and_reports(spark, tables, monkeypatch):
    """The copies of both, and the shuffles that made them, were most of the disk that a review took."""
    v, labels = Views(spark, tables), []
    limits = {"gap_limit": fixed.TEST_GAP_FINDINGS, "doc_limit": fixed.DOC_FINDINGS}
    written = review.run_review(
        materialize(v.review_files(), "corpus"), materialize(v.sast_reports(), "reports"), **limits).ranked()
    path = storage.scratch_path
    monkeypatch.setattr(storage, "scratch_path", lambda spark, label: labels.append(label) or path(spark, label))
    capped = QUERIES["review_capped"](spark, tables)
    assert labels == ["routes", "observed", "findings"]
    got, expected = (sorted(map(tuple, x.select(*capped.columns).collect()), key=str) for x in (capped, written))
    assert got == expected and len(got) > 300 and {r[2] for r in got} == set(fixed.AGENT_ORDER)


def test_shuffle_files_of_a_review_go_with_their_step(spark, tables, monkeypatch):
    held = []

    def seen(df, label):
        held.append((label, spark.conf.get(storage.DROP_SHUFFLES, None)))
        return materialize(df, label)

    monkeypatch.setattr(review, "materialize", seen)
    QUERIES["review_capped"](spark, tables)
    assert held == [("routes", "true"), ("observed", "true"), ("findings", "true")]
    assert spark.conf.get(storage.DROP_SHUFFLES, None) != "true"


def test_jobs_over_paths_read_no_texts(spark, tables):
    counts = review.file_census(Views(spark, tables).review_files())
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "Relation [" in line]
    projects = [line for line in plan.splitlines() if "Project [" in line]
    assert scans and projects and not any("text#" in line for line in projects)


def todo_detector(given):
    return given.files.filter(F.col("content").contains("TODO")).select(
        "repo", F.lit("TODO_LEFT").alias("rule"), F.lit(1).alias("severity"), F.lit("left over").alias("title"),
        F.col("path").alias("file"), F.lit(1).alias("line"), F.lit("").alias("detail"), F.lit(0).alias("seq"),
    )


def broken_udf(given):
    return todo_detector(given).withColumn("line", F.raise_error(F.lit("went wrong")).cast("int"))


@pytest.mark.parametrize("failing", [broken_udf, lambda given: given.files.select("nothing")])
def test_plugins_and_failing_plugins(spark, tree, failing):
    files = tree(a={"x.sh": "TODO", "y.py": PLANTED}, b={"x.md": "TODO"})
    review.register_detector("todo", [".sh"], todo_detector)
    review.register_detector("bad", [".sh"], failing)
    try:
        done = review.run_review(files)
        rules = {(r["repo"], r["rule"]) for r in done.findings.collect()}
        assert ("a", "TODO_LEFT") in rules and ("b", "TODO_LEFT") not in rules
        assert ("a", "SECRET_GENERIC") in rules
        errors = {(r["repo"], r["agent"]) for r in done.status().filter("error is not null").collect()}
        assert errors == {("a", "bad")}
    finally:
        review.unregister_detector("todo")
        review.unregister_detector("bad")


def test_unparsable_file_shows_in_status(spark, tree):
    done = review.run_review(tree(a={"deep.py": "x = " + "-" * 20000 + "1", "b.py": PLANTED}))
    errors = {r["agent"]: r["error"] for r in done.status().filter("error is not null").collect()}
    assert set(errors) == {"quality", "test-gap", "documentation"}
    assert errors["quality"].startswith("deep.py: ")
    assert done.findings.filter("rule = 'QUAL_MUTABLE_DEFAULT'").count() == 1


def test_tree_source(spark, tmp_path):
    content = {
        "a/__init__.py": b"x = 1\r\n", "a/_priv.py": b"\xff\xfeok", "a/.github/w.yml": b"", "a/b/c/d.py": "ü".encode(),
        "b/README": b"r",
    }
    for path, raw in content.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(raw)
    got = {(r["repo"], r["path"]): r["content"] for r in scan_tree(spark, str(tmp_path)).collect()}
    assert got == {
        ("a", "__init__.py"): "x = 1\n", ("a", "_priv.py"): "ok", ("a", ".github/w.yml"): "",
        ("a", "b/c/d.py"): "ü", ("b", "README"): "r",
    }
    one = scan_tree(spark, str(tmp_path / "a/_priv.py"), repo="z").collect()
    assert [tuple(r) for r in one] == [("z", "_priv.py", "ok")]
    assert scan_tree(spark, str(tmp_path / "missing"), repo="z").count() == 0


def test_tree_is_listed_by_several_tasks(spark, tmp_path):
    for n in range(60):
        folder = tmp_path / f"d{n % 4}" / f"e{n % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{n}").write_text("x" * n)
    deep = tmp_path / "/".join(["deep", *"abcdefghijklmnop"])
    deep.mkdir(parents=True)
    (deep / "end.py").write_text("y")
    expected = sorted([(f"d{n % 4}/e{n % 3}/f{n}", n) for n in range(60)] + [("/".join(["deep", *"abcdefghijklmnop", "end.py"]), 1)])
    for folders in (1, 3, 256):
        assert sorted(map(tuple, source.list_tree(spark, str(tmp_path), folders).collect())) == expected
    # With one folder a round and task, the twelve inner folders are opened by several tasks.
    plan = source.list_tree(spark, str(tmp_path), 1)
    assert plan.select(F.input_file_name().alias("f")).distinct().count() > 8
    assert source.list_tree(spark, str(tmp_path / "missing")).count() == 0


def test_write_tree_refuses_escapes(spark, tree, tmp_path):
    root = tmp_path / "out"
    assert write_tree(tree(r={"ok.py": "1", "../../bad.py": "2", "/abs.py": "3"}), str(root)) == 1
    assert [p.name for p in tmp_path.rglob("*.py")] == ["ok.py"]


def test_corpus_and_reports(spark, tmp_path):
    raw = spark.createDataFrame([("r", "a.py", b"x\r\n\xff")], "repo string, path string, content binary")
    raw.write.parquet(str(tmp_path / "corpus"))
    assert read_corpus(spark, str(tmp_path / "corpus")).first()["content"] == "x\n"
    (tmp_path / "sast").mkdir()
    (tmp_path / "sast" / "repo-1.json").write_text('{\n"results": []}')
    assert tuple(read_sast_reports(spark, str(tmp_path / "sast")).first()) == ("repo-1", '{\n"results": []}')
    assert severity_dim(spark).count() == 5


SECRET = "s3cret"


def delivery(number, action="opened", event="pull_request", sign=True, body=None, sha="s1"):
    body = body if body is not None else json.dumps({
        "action": action, "number": number, "repository": {"full_name": "o/r"},
        "pull_request": {"head": {"ref": "b", "sha": sha}},
    })
    mac = "sha256=" + hmac.new(SECRET.encode(), body.encode(), hashlib.sha256).hexdigest()
    return (number, event, bytearray(body.encode()), mac if sign is True else sign)


def deliveries(spark, rows):
    return spark.createDataFrame(rows, "event_id int, event string, body binary, signature string").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp")
    )


GOOD = '{"action": "opened", "number": 7, "repository": {"full_name": "o/r"}, "pull_request": {"head": {"sha": "s"}}}'
CASES = [
    delivery(1), delivery(2, sign=None), delivery(3, sign="sha256=00"), delivery(4, event="push", sign=None),
    delivery(5, event="push"), delivery(6, action="closed"), delivery(7, body="{nope"), delivery(8, body="{}"),
    delivery(9, body='{"action": "opened", "number": 9}'), delivery(10, action="reopened"), delivery(11, event="push", body="x"),
    delivery(12, body=GOOD + " and more"), delivery(13, body=f"[{GOOD}]"), delivery(14, body="[1]"),
    delivery(15, body=GOOD.replace('"number": 7', '"number": 3, "number": "15"')), delivery(16, body=GOOD.replace("7", '"x"')),
    delivery(17, body=f" \n{GOOD}\n"), delivery(18, body=f"{GOOD},{GOOD}"), delivery(19, body='{"action": {"a": 1}}'),
]


def test_dispositions(spark):
    got = {r["event_id"]: r["disposition"] for r in classify_deliveries(deliveries(spark, CASES), SECRET).collect()}
    assert got == {
        1: "accepted", 2: "rejected", 3: "rejected", 4: "rejected", 5: "skipped event", 6: "skipped action",
        7: "malformed", 8: "skipped action", 9: "malformed", 10: "accepted", 11: "skipped event",
        12: "malformed", 13: "malformed", 14: "malformed", 15: "accepted", 16: "malformed", 17: "accepted", 18: "malformed",
        19: "skipped action",
    }
    numbers = {r["event_id"]: r["pr_number"] for r in classify_deliveries(deliveries(spark, CASES), SECRET).collect()}
    assert (numbers[1], numbers[15], numbers[16], numbers[17]) == (1, 15, None, 7)
    open_mode = classify_deliveries(deliveries(spark, CASES[:3]), None).collect()
    assert {r["disposition"] for r in open_mode} == {"accepted"}


def test_stream_equals_batch(spark, tmp_path):
    frame = deliveries(spark, CASES)
    for n in range(3):
        frame.filter(F.col("event_id") % 3 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_delivery_files(spark, str(tmp_path / "in"), frame.schema)
    write_classified(stream, SECRET, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = classify_deliveries(frame, SECRET)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.select(streamed.columns).collect()))


def scratch_tables(spark):
    return sorted(p.name for p in Path(scratch_root(spark)).glob("codeaudit-*/*"))


def test_reviews_on_a_stream(spark, tree, tmp_path, monkeypatch):
    corpus = tree(x={"app.py": PLANTED}, y={"README.md": "# ok"}).select(
        F.lit("o/r").alias("repo"), F.when(F.col("repo") == "x", "s1").otherwise("s2").alias("sha"), "path", "content"
    )
    tables, checkpoint = str(tmp_path / "tables"), str(tmp_path / "cp")

    def arrive(rows):
        frame = deliveries(spark, rows)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = read_delivery_files(spark, str(tmp_path / "in"), frame.schema)
        review_deliveries(stream, lambda: corpus, SECRET, tables, checkpoint).awaitTermination()

    arrive([delivery(1), delivery(2, sha="s2"), delivery(3, sign=None)])
    arrive([delivery(4), delivery(5, sha="gone")])
    arrive([delivery(6, event="push")])
    results = {r["event_id"]: (r["pr"], r["findings"], r["health_score"]) for r in spark.read.parquet(f"{tables}/results").collect()}
    assert results == {1: (1, 6, 81), 2: (2, 0, 100), 4: (4, 6, 81), 5: (5, None, None)}
    rows = read_history(spark, f"{tables}/history").orderBy("id").collect()
    assert [(r["id"], r["event_id"], r["health_score"], r["source"]) for r in rows] == [
        (1, 1, 81, "webhook"), (2, 2, 100, "webhook"), (3, 4, 81, "webhook"),
    ]
    # A fourth batch cannot write its history: results are there, and the next batch makes up for it.
    root = scratch_root(spark)
    before = scratch_tables(spark)
    with monkeypatch.context() as broken:
        broken.setattr(history, "assign_ids", lambda *a: (_ for _ in ()).throw(OSError("disk full")))
        arrive([delivery(7), delivery(8, sha="s2")])
    assert spark.read.parquet(f"{tables}/results").count() == 6 and read_history(spark, f"{tables}/history").count() == 3
    arrive([delivery(9)])
    rows = read_history(spark, f"{tables}/history").orderBy("id").collect()
    assert sorted(r["event_id"] for r in rows) == [1, 2, 4, 7, 8, 9] and [r["id"] for r in rows] == [1, 2, 3, 4, 5, 6]
    # Scratch tables of finished batches are gone.
    assert scratch_tables(spark) == before and root
    comments = spark.read.parquet(f"{tables}/comments").collect()
    assert {r["event_id"] for r in comments} == {1, 2, 4, 7, 8, 9}
    assert all(r["body"].startswith("## Code Review\n") and not r["posted"] for r in comments)
