"""Row numbers with large groups, scores, summaries and Markdown."""

import random

import pytest
from pyspark.sql import functions as F

from codeaudit.operators import ranking, report
from codeaudit.operators.ranking import first_rows, number_rows
from codeaudit.storage import DROP_SHUFFLES, materialize


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, one NULL group, equal sort values."""
    rng = random.Random(5)
    rows = [("hot" if n % 3 == 0 else None if n % 3 == 1 and n % 7 == 0 else f"g{n % 40}", rng.randrange(50), n)
            for n in range(6000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, v int, n int").repartition(7).cache()


@pytest.mark.parametrize("limit", [10_000, 1_000, 50, 5])
def test_number_rows_does_not_depend_on_the_path_taken(skewed, limit):
    got = number_rows(skewed, ["g"], [F.desc("v"), F.asc("n")], "at", one_task_rows=limit).collect()
    by_group = {}
    for row in sorted(got, key=lambda r: (str(r["g"]), -r["v"], r["n"])):
        by_group.setdefault(row["g"], []).append(row["at"])
    assert len(got) == 6000
    assert all(ats == list(range(1, len(ats) + 1)) for ats in by_group.values())


@pytest.mark.parametrize("limit", [10_000, 100])
def test_number_rows_over_everything(skewed, limit):
    got = number_rows(skewed, [], [F.asc("n")], "at", one_task_rows=limit)
    assert got.filter(F.col("at") != F.col("n") + 1).count() == 0
    assert got.count() == 6000


def test_large_groups_are_shuffled_once_and_in_rounds(spark, skewed, monkeypatch):
    """They went through three shuffles, all at once, and the files of each stayed."""
    placed = []

    def seen(df, label):
        written = materialize(df, label)
        if label == "ranked":
            plan = df._jdf.queryExecution().executedPlan().toString()
            placed.append((written.count(), plan.count("rangepartitioning"), plan.count("hashpartitioning"), spark.conf.get(DROP_SHUFFLES, None)))
        return written

    monkeypatch.setattr(ranking, "materialize", seen)
    monkeypatch.setattr(ranking, "ROUND_TASKS", 4)
    got = number_rows(skewed, ["g"], [F.desc("v"), F.asc("n")], "at", one_task_rows=70)
    assert {x[1:] for x in placed} == {(1, 0, "true")}
    sizes = sorted(r["count"] for r in skewed.groupBy("g").count().collect())
    assert sum(x[0] for x in placed) == sum(n for n in sizes if n > 70)
    # Of a round, all groups but the last are in an eighth of the rows.
    assert 3 < len(placed) <= ranking.ROUNDS and max(x[0] for x in placed) < 6000 // ranking.ROUNDS + sizes[-1]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(g") <= 1 + 2 * len(placed)  # small groups; counts of pieces
    assert spark.conf.get(DROP_SHUFFLES, None) != "true"


@pytest.mark.parametrize("limit", [20, 100])
def test_large_groups_by_two_columns_with_nulls(spark, limit):
    rng = random.Random(9)
    some = lambda *values: rng.choice([None, *values])
    rows = [(some("a", "b"), some(1, 2), some(0, 1, 2, 3), some("x", "xy", ""), n // 2) for n in range(1200)]
    df = spark.createDataFrame(rows, "g string, h int, v int, t string, n int").repartition(5).cache()
    order = [F.desc("v"), F.asc("t"), F.asc("n")]
    first = lambda x: (x is not None, x if x is not None else 0)
    groups = {}
    for g, h, v, t, n in rows:
        groups.setdefault((g, h), []).append(((v is None, -(v or 0)), (t is not None, t or ""), first(n), (v, t, n)))
    expected = sorted(((*k, at, x[3]) for k, xs in groups.items() for at, x in enumerate(sorted(xs), 1)), key=str)
    got = number_rows(df, ["g", "h"], order, "at", one_task_rows=limit).collect()
    assert sorted(((r["g"], r["h"], r["at"], (r["v"], r["t"], r["n"])) for r in got), key=str) == expected


def test_first_rows_limits_before_the_shuffle(skewed):
    kept = first_rows(skewed, ["g"], [F.asc("n")], 3, "at")
    assert kept.groupBy("g").count().filter("count > 3").count() == 0
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def reviews(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "review_id string")


def test_scores(spark, finding_rows):
    found = finding_rows(
        [("each", "quality", s, "a.py", 1) for s in range(5)]
        + [("worst", "security", 4, "a.py", n) for n in range(10)]
        + [("two", "security", 3, "a.py", 1), ("two", "quality", 1, "a.py", 1)]
    )
    rows = report.health_score(reviews(spark, "clean", "each", "worst", "two"), found).collect()
    assert dict(rows) == {"clean": 100, "each": 60, "worst": 0, "two": 89}


def test_rank_is_worst_first_then_file_then_line(finding_rows):
    found = finding_rows([
        ("r", "quality", 1, "b.py", 1), ("r", "quality", 4, "z.py", 9), ("r", "quality", 1, "a.py", 10),
        ("r", "security", 1, "a.py", 10), ("r", "quality", 1, "a.py", 2),
    ])
    ranked = report.ranked_findings(found).orderBy("rank").collect()
    assert [(r["file"], r["line"], r["agent"]) for r in ranked] == [
        ("z.py", 9, "quality"), ("a.py", 2, "quality"), ("a.py", 10, "security"),
        ("a.py", 10, "quality"), ("b.py", 1, "quality"),
    ]


def test_counts_and_summary(spark, finding_rows):
    found = finding_rows([("r", "security", 4, "a", 1), ("r", "test-gap", 0, "a", 1), ("r", "security", 0, "a", 1)])
    assert report.severity_summary(found).first()["summary"] == "🔴 1 Critical · ⚪ 2 Info"
    assert report.agent_counts(found).first()["agents"] == {"security": 2, "test-gap": 1}
    wide = report.severity_pivot(reviews(spark, "r", "none"), found).orderBy("review_id").collect()
    assert [wide[0][c] for c in ("total", "critical", "info", "health_score")] == [0, 0, 0, 100]
    assert [wide[1][c] for c in ("total", "critical", "info", "health_score")] == [3, 1, 2, 75]


def test_fix_candidates_take_ten_with_a_line(finding_rows):
    rows = [("r", "quality", 1, f"f{n:02}.py", n) for n in range(15)] + [("r", "quality", 0, "a.py", 3)]
    assert report.fix_candidates(finding_rows(rows)).count() == 14
    got = report.fix_candidates(finding_rows(rows), limit=10).orderBy("i").collect()
    assert [(r["i"], r["line"]) for r in got] == [(n, n + 1) for n in range(10)]


MARKDOWN = """## Code Review

**Code-health score: 71/100** · 2 finding(s)

> ⚠️ `quality` agent failed: boom

🔴 1 Critical · 🟡 1 Medium

| Sev | Issue | Location | Rule |
|-----|-------|----------|------|
| 🔴 Critical | title 1 | `a.py` | `R4` |
| 🟡 Medium | title 0 | `b.py:3` | `R2` |

<details><summary>Details</summary>


**🔴 title 1** (`a.py:0`, `R4`)
- _Risk:_ why

**🟡 title 0** (`b.py:3`, `R2`)
- _Fix:_ how

</details>"""


def test_markdown(spark, finding_rows):
    found = finding_rows([("r", "quality", 2, "b.py", 3), ("r", "security", 4, "a.py", 0)])
    found = found.withColumns({
        "explanation": F.when(F.col("severity") == 4, "why").otherwise(""),
        "fix_hint": F.when(F.col("severity") == 2, "how").otherwise(""),
    })
    status = spark.createDataFrame(
        [("r", "quality", "boom", 1), ("r", "security", None, 1)],
        "review_id string, agent string, error string, n_findings int",
    )
    bodies = dict(
        report.markdown_report(reviews(spark, "r", "clean"), found, status).select("review_id", "body").collect()
    )
    assert bodies["r"] == MARKDOWN
    assert bodies["clean"] == (
        "## Code Review\n\n**Code-health score: 100/100** · 0 finding(s)\n\n✅ No issues found. Nice work.\n"
    )


@pytest.mark.parametrize("part_rows", [1, 7, 20])
def test_large_reports_come_in_parts_that_join_to_the_same_text(spark, finding_rows, part_rows):
    found = finding_rows(
        [("big", "quality", n % 5, f"f{n % 6}.py", n) for n in range(20)]
        + [("small", "quality", 1, "a.py", 1)]
    )
    listed = reviews(spark, "big", "small", "clean")
    whole = dict(report.markdown_report(listed, found).select("review_id", "body").collect())
    parts = report.markdown_report(listed, found, part_rows=part_rows).orderBy("review_id", "part").collect()
    joined = {}
    for row in parts:
        joined.setdefault(row["review_id"], []).append(row["body"])
    assert {k: "\n".join(v) for k, v in joined.items()} == whole
    assert len(joined["big"]) == (1 if part_rows >= 20 else 2 * -(-20 // part_rows))


def test_first_rows_in_shares_are_the_same(skewed):
    order = [F.desc("v"), F.asc("n")]
    plain = {tuple(r) for r in first_rows(skewed, ["g"], order, 30, "at").collect()}
    assert {tuple(r) for r in first_rows(skewed, ["g"], order, 30, "at", shares=8).collect()} == plain
