"""One pass over contents, the store of what they hold, many rules, and plug-ins that raise."""

import gc
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from codeaudit.fixtures import Views
from codeaudit.operators import contents, facts, secrets
from codeaudit.operators.contents import ContentStore
from codeaudit.operators.secrets import DEFAULT_RULES, RuleSet, SecretRule
from codeaudit.plans import review
from codeaudit.plans.webhook import review_heads
from codeaudit.storage import materialize

SF = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_a_review_reads_contents_once(spark, tmp_path, monkeypatch):
    Views(spark, SF).review_files().write.parquet(str(tmp_path / "corpus"))
    plans = {}

    def spy(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
        return materialize(df, label)

    monkeypatch.setattr(review, "materialize", spy)
    review.run_review(spark.read.parquet(str(tmp_path / "corpus"))).findings.count()
    reads = {label: len(re.findall(r"ReadSchema: [^\n]*content:string", plan)) for label, (_, plan) in plans.items()}
    assert reads == {"routes": 0, "observed": 1, "findings": 0}


def heads(spark, changed):
    """A corpus of one repository at two heads; the second differs in some files."""
    files = Views(spark, SF).review_files().withColumn("path", F.concat_ws("/", "repo", "path"))
    first = files.select(F.lit("o/r").alias("repo"), F.lit("s1").alias("sha"), "path", "content")
    number = F.pmod(F.xxhash64("path"), F.lit(100))
    text = F.when(number < changed, F.concat("content", F.lit("\n# changed "), "path")).otherwise(F.col("content"))
    return first.unionByName(first.withColumns({"sha": F.lit("s2"), "content": text}))


def test_a_second_head_parses_what_it_changes(spark, tmp_path):
    corpus = materialize(heads(spark, 2).withColumn("digest", F.sha2("content", 256)), "heads")
    reviews = {}
    for sha in ("s1", "s2"):
        asked = spark.createDataFrame([(1, "o/r", sha)], "event_id int, repo string, sha string")
        store = ContentStore(spark, str(tmp_path / "store"))
        reviews[sha] = review_heads(asked, corpus, store, sha).review
    own = contents.reviewed(corpus).select("sha", "path", "digest", *contents.KIND)
    before, after = own.filter("sha = 's1'"), own.filter("sha = 's2'")
    key = ["digest", *contents.KIND]
    added = store.added("s2").count()
    assert added == after.select(*key).distinct().join(before, key, "left_anti").count()
    assert 0 < added < 0.05 * after.count() and store.added("s1").count() > 20 * added
    for sha, done in reviews.items():
        plain = review.run_review(corpus.filter(F.col("sha") == sha).select(F.concat_ws("@", "repo", "sha").alias("repo"), "path", "content"))
        assert rows(done.ranked()) == rows(plain.ranked()) and done.findings.count() > 100


def test_a_repeated_run_replaces_its_addition(spark, tree, tmp_path):
    files = tree(a={"x.py": "def f(): pass\n", "y.py": "def f(): pass\n", "z.py": None}, b={"tests/x.py": "def f(): pass\n", "n.md": ""})
    store = ContentStore(spark, str(tmp_path))
    for run in ("one", "one", "two"):
        assert store.observed(files, run).count() == 5
    assert store.added("one").count() == 4 and store.added("two").count() == 0
    other = ContentStore(spark, str(tmp_path), rules=DEFAULT_RULES[:1])
    assert other.observed(files, "one").count() == 5 and store.added("one").count() == 4


def test_digests_spare_reading(spark, tree, tmp_path):
    files = tree(a={"x.py": "x = 1\n", "y.md": "text"}).withColumn("digest", F.md5("content"))
    store = ContentStore(spark, str(tmp_path))
    store.observed(files, "one").count()
    unread = files.withColumn("content", F.raise_error(F.lit("was read")).cast("string"))
    assert store.observed(unread, "two").count() == 2


def test_a_raising_scan_costs_its_repository_only(spark, tree):
    def scan(text):
        if "bad" in text:
            raise ValueError("cannot take it")
        for line, found in enumerate(text.splitlines(), 1):
            if "TODO" in found:
                yield "TODO_LEFT", 1, "left over", line, found

    files = tree(a={"x.sh": "TODO", "y.sh": "bad", "z.md": "TODO"}, b={"x.sh": "a\nTODO b", "y.md": "TODO bad"}, c={"k.py": "TODO"})
    review.register_detector("todo", [".sh"], scan=scan)
    try:
        done = review.run_review(files)
    finally:
        review.unregister_detector("todo")
    found = done.findings.filter("agent = 'todo'").select("repo", "rule", "file", "line", "detail", "agent_ord").collect()
    assert list(map(tuple, found)) == [("b", "TODO_LEFT", "x.sh", 2, "TODO b", 4)]
    status = {r["repo"]: (r["error"], r["n_findings"]) for r in done.status().filter("agent = 'todo'").collect()}
    assert status == {"a": ("y.sh: ValueError: cannot take it", 0), "b": (None, 1)}
    with pytest.raises(ValueError):
        review.register_detector("todo", [".sh"])


def plain_hits(rules, text):
    return [
        (rule.rule, n, at * 1000 + k) for n, line in enumerate(text.splitlines(), 1)
        for at, rule in enumerate(rules) for k, _ in enumerate(re.finditer(rule.pattern, line, re.ASCII))]


def test_automaton_finds_what_all_expressions_find():
    rng = random.Random(8)
    rules = [SecretRule(f"R{k}", 1, "", rf"(?i)k{k}\s*=\s*(\w+)", (f"K{k}",)) for k in range(60)]
    rules += [SecretRule("OPEN", 2, "", r"([0-9]{4})"), SecretRule("TWO", 2, "", r"((?:ab|cd)x)", ("abx", "cdx"))]
    known = RuleSet(rules)
    for _ in range(200):
        text = "".join(rng.choice(["k1", "K12", "k59", " = ", "=", "v", "İ", "ü", "\n", " ", "\r\n", "abx", "CDX", "cdx", "2024", " ", "\x85"]) for _ in range(40))
        got = [(h["rule"], h["line"], h["seq"] - secrets.SEQ_BASE) for h in known.hits(text)]
        assert got == plain_hits(rules, text)


def test_time_hardly_grows_with_the_rules():
    text = "\n".join(f"line {k} of plain prose with a token = 'abcdefgh{k}'" for k in range(400))

    def seconds(n):
        known = RuleSet([*DEFAULT_RULES, *(SecretRule(f"R{k}", 1, "", rf"key{k}x=(\w+)", (f"key{k}x=",)) for k in range(n))])
        start = time.perf_counter()
        for _ in range(5):
            assert len(known.hits(text)) == 400
        return time.perf_counter() - start

    seconds(0)
    assert seconds(2000) < 4 * min(seconds(0), seconds(0))


def test_rule_tables_have_a_bound(spark):
    table = Views(spark, SF).key_rules()
    rules = secrets.rules_of(table)
    assert len(rules) == len({r.rule for r in rules}) > 1000 and all(r.keywords for r in rules)
    with pytest.raises(ValueError):
        secrets.rules_of(table, 10)


def test_texts_are_parsed_without_a_search_for_cycles(spark, tree):
    """The collector walked the trees of a file over and over; it runs again after each batch."""

    def scan(text):
        yield "COLLECTS", 0, str(gc.isenabled()), 1, ""

    files = contents.reviewed(tree(r={"a.py": "def f():\n    return 1\n", "b.py": "x = 1\n"}))
    seen = contents.observe(files, ["repo", "path"], (), [contents.Scanner("gc", (".py",), scan)])
    assert {r["title"] for r in seen.select(F.inline("found")).collect()} == {"False"}
    with facts.no_cycles():
        assert not gc.isenabled()
    assert gc.isenabled()
