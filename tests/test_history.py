"""History: rows, ids, idempotent appends and series."""

import datetime as dt

from pyspark.sql import functions as F

from codeaudit.operators import history


def review_table(spark, n, repo="r"):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"v{i}", start + dt.timedelta(days=i), "api", repo, None) for i in range(n)]
    return spark.createDataFrame(
        rows, "review_id string, created_at timestamp, source string, repo string, pr_number long"
    )


def test_rows_and_summary(spark, finding_rows):
    found = finding_rows([("v0", "security", 3, "a.py", 1), ("v0", "quality", 1, "a.py", 1)]).drop("repo")
    rows = history.assign_ids(history.review_rows(review_table(spark, 2), found))
    first, clean = rows.orderBy("id").collect()
    assert (first["health_score"], first["total"], first["high"], first["low"]) == (89, 2, 1, 1)
    assert first["agents"] == {"security": 1, "quality": 1}
    assert (clean["id"], clean["health_score"], clean["total"], clean["agents"]) == (2, 100, 0, {})
    assert history.history_summary(rows).first().asDict() == {"reviews": 2, "findings": 2, "latest_health": 100}
    empty = history.history_summary(rows.filter("false")).first().asDict()
    assert empty == {"reviews": 0, "findings": 0, "latest_health": None}


def test_repo_falls_back_to_codebase(spark, finding_rows):
    found = finding_rows([("v0", "security", 3, "a.py", 1)]).drop("repo")
    table = review_table(spark, 3).withColumns({
        "repo": F.expr("case review_id when 'v0' then '' when 'v1' then null else repo end"),
        "codebase": F.lit("/code"),
    })
    rows = history.review_rows(table, found).orderBy("review_id").collect()
    assert [r["repo"] for r in rows] == ["/code", "/code", "r"]


def test_recent_is_oldest_first(spark, finding_rows):
    rows = history.assign_ids(history.review_rows(review_table(spark, 5), finding_rows([("x", "quality", 1, "a", 1)]).drop("repo")))
    assert [r["id"] for r in history.history_recent(rows, 3).collect()] == [3, 4, 5]
    assert [r["id"] for r in history.history_recent(rows, 0).collect()] == [5]


def test_append_twice_adds_once(spark, finding_rows, tmp_path):
    path = str(tmp_path / "history")
    assert history.read_history(spark, path) is None
    rows = history.review_rows(review_table(spark, 3), finding_rows([("v1", "quality", 2, "a", 1)]).drop("repo"))
    for run in ("007", "007", "2024-01-3"):
        history.append_history(rows, path, run)
    stored = history.read_history(spark, path)
    assert sorted(r["id"] for r in stored.select("id").collect()) == [1, 2, 3, 4, 5, 6]
    assert {r["severity"]: r["n"] for r in history.totals_by_severity(stored).collect()}["Medium"] == 2
    assert [tuple(r) for r in history.totals_by_agent(stored).collect()] == [("quality", 2)]
    trend = history.health_trend(stored).collect()
    assert [(r["repo"], r["reviews"], r["lowest_score"]) for r in trend] == [("r", 6, 96)]


def test_rows_without_a_commit_are_not_read(spark, finding_rows, tmp_path):
    path = str(tmp_path / "history")
    rows = history.review_rows(review_table(spark, 3), finding_rows([("v1", "quality", 2, "a", 1)]).drop("repo"))
    history.append_history(rows, path, "one")
    history.assign_ids(rows, 50).write.parquet(f"{path}/rows/run=broken")
    assert history.read_history(spark, path).count() == 3
    history.append_history(rows, path, "broken")
    assert sorted(r["id"] for r in history.read_history(spark, path).collect()) == [1, 2, 3, 4, 5, 6]


def test_a_failed_append_is_kept(spark, finding_rows, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    rows = history.review_rows(review_table(spark, 2), finding_rows([("v1", "quality", 2, "a", 1)]).drop("repo"))
    with monkeypatch.context() as broken:
        broken.setattr(history, "assign_ids", lambda *a: (_ for _ in ()).throw(OSError("disk full")))
        assert not history.append_or_keep(rows, path, "one") and not history.append_or_keep(rows, path, "two")
    assert history.read_history(spark, path) is None
    assert history.append_or_keep(rows, path, "three") and history.retry_appends(spark, path) == 2
    assert history.retry_appends(spark, path) == 0
    stored = history.read_history(spark, path)
    assert sorted((r["id"], r["run"]) for r in stored.collect()) == [(1, "three"), (2, "three"), (3, "one"), (4, "one"), (5, "two"), (6, "two")]


def test_ids_follow_ranges(spark, finding_rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = review_table(spark, 500).repartition(7)
        got = history.assign_ids(rows, 10, ["review_id"]).orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r["id"], r["review_id"]) for r in got] == [(n + 11, f"v{n}") for n in range(500)]
