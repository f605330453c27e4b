"""Review history: append, read back, headline numbers and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from codeaudit import fixed
from codeaudit.operators.ranking import running_totals
from codeaudit.operators.report import KEY, agent_counts, severity_pivot
from codeaudit.schemas import AGENT_COUNTS
from codeaudit.storage import any_path, delete_path


def review_rows(
    reviews: DataFrame, findings: DataFrame, key: Sequence[str] = KEY
) -> DataFrame:
    """One wide row per review `(key, created_at, source, repo, pr_number)`.

    `repo` falls back to `codebase` where it is missing or empty, if reviews carry that.
    """
    if "codebase" in reviews.columns:
        named = F.coalesce(F.nullif("repo", F.lit("")), "codebase")
        reviews = reviews.withColumn("repo", named).drop("codebase")
    wide = severity_pivot(reviews, findings, key)
    joined = wide.join(agent_counts(findings, key), list(key), "left")
    none = F.create_map().cast(AGENT_COUNTS)
    return joined.withColumn("agents", F.coalesce("agents", none))


def assign_ids(rows: DataFrame, last_id: int = 0, key: Sequence[str] = KEY) -> DataFrame:
    """Give rows the ids after `last_id` in the order of their time and key, by ranges: no task sorts all rows."""
    order = [F.col("created_at"), *[F.col(k) for k in key]]
    numbered = running_totals(rows.withColumn("_one", F.lit(1)), [], order, "_one", "_before")
    return numbered.select((F.col("_before") + 1 + last_id).alias("id"), *rows.columns)


def _runs(spark: SparkSession, path: str) -> DataFrame | None:
    """`(run, first_id, n)` of the committed runs."""
    if not any_path(spark, f"{path}/commits/run=*"):
        return None
    return spark.read.schema("first_id bigint, n bigint, run string").parquet(f"{path}/commits")


def append_history(rows: DataFrame, path: str, run: str, key: Sequence[str] = KEY) -> None:
    """Append rows to the history at `path` as run `run`; a run already there is skipped.

    The history is a log: a run's rows are written first, then its commit with the first id and the number
    of rows. Rows without a commit are not read, and the run's next attempt replaces them. The next id follows
    from the commits, one small row for each run. One writer at a time.
    """
    spark = rows.sparkSession
    known, last = _runs(spark, path), 0
    if known is not None:
        if not known.filter(F.col("run") == run).isEmpty():
            return
        last = known.agg(F.max(F.col("first_id") + F.col("n") - 1)).first()[0] or 0
    target = f"{path}/rows/run={run}"
    assign_ids(rows, last, key).write.mode("overwrite").parquet(target)
    commit = spark.read.parquet(target).agg(F.lit(last + 1).cast("long").alias("first_id"), F.count("*").alias("n"))
    commit.write.mode("overwrite").parquet(f"{path}/commits/run={run}")


def append_or_keep(rows: DataFrame, path: str, run: str, key: Sequence[str] = KEY) -> bool:
    """Append, but let no failure of it reach the caller: the rows are kept for `retry_appends` then.

    False if they were kept. `rows` should be a written table.
    """
    try:
        append_history(rows, path, run, key)
    except Exception:  # whatever the store raises; the rows are not lost
        rows.write.mode("overwrite").parquet(f"{path}/retry/run={run}")
        return False
    return True


def retry_appends(spark: SparkSession, path: str, key: Sequence[str] = KEY) -> int:
    """Append the kept rows of failed runs, in the order of their names; how many runs there were."""
    if not any_path(spark, f"{path}/retry/run=*"):
        return 0
    kept = spark.read.option("basePath", f"{path}/retry").schema("run string").parquet(f"{path}/retry")
    runs = sorted(r["run"] for r in kept.select("run").distinct().collect())
    for run in runs:
        folder = f"{path}/retry/run={run}"
        append_history(spark.read.parquet(folder), path, run, key)
        delete_path(spark, folder)
    return len(runs)


def read_history(spark: SparkSession, path: str) -> DataFrame | None:
    """The committed rows, or None when there is no run yet. Runs are text, as they were given."""
    runs = _runs(spark, path)
    if runs is None:
        return None
    found = spark.read.parquet(f"{path}/rows").schema
    typed = [StructField("run", StringType()) if f.name == "run" else f for f in found]
    rows = spark.read.schema(StructType(typed)).parquet(f"{path}/rows")
    return rows.join(runs.select("run"), "run", "left_semi").select(*found.names)


def history_recent(history: DataFrame, limit: int = fixed.HISTORY_LIMIT) -> DataFrame:
    """The latest `limit` reviews (at least one), oldest first."""
    return history.orderBy(F.desc("id")).limit(max(1, limit)).orderBy("id")


def history_summary(history: DataFrame) -> DataFrame:
    """Number of reviews and findings and the latest score; NULL score when empty."""
    return history.agg(
        F.count("*").alias("reviews"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("findings"),
        F.max_by("health_score", "id").alias("latest_health"),
    )


def health_trend(history: DataFrame, unit: str = "month") -> DataFrame:
    """Mean score, lowest score and number of reviews per repository and period."""
    period = F.date_trunc(unit, "created_at").alias("period")
    return history.groupBy("repo", period).agg(
        F.count("*").alias("reviews"),
        F.round(F.avg("health_score"), 4).alias("mean_score"),
        F.min("health_score").alias("lowest_score"),
    )


def totals_by_severity(history: DataFrame) -> DataFrame:
    """Findings per severity over the whole history."""
    levels = list(reversed(fixed.SEVERITIES))
    sums = history.agg(
        *[F.coalesce(F.sum(row[1].lower()), F.lit(0)).alias(row[1].lower()) for row in levels]
    )
    pair = [
        F.struct(F.lit(row[2]).alias("severity"), F.col(row[1].lower()).alias("n"))
        for row in levels
    ]
    return sums.select(F.inline(F.array(*pair)))


def totals_by_agent(history: DataFrame) -> DataFrame:
    """Findings per detector over the whole history."""
    return (
        history.select(F.explode("agents").alias("agent", "n"))
        .groupBy("agent").agg(F.sum("n").alias("n"))
    )


def agents_json(agents: Column) -> Column:
    return F.to_json(agents)
