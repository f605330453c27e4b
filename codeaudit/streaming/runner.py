"""Streaming jobs over deliveries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from codeaudit.operators.contents import ContentStore
from codeaudit.operators.history import append_or_keep, retry_appends
from codeaudit.plans.review import scanners
from codeaudit.plans.webhook import review_heads
from codeaudit.storage import materialize, scratch_scope
from codeaudit.streaming.deliveries import accepted_deliveries, classify_deliveries


def read_delivery_files(
    spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*.parquet"
) -> DataFrame:
    """A stream of Parquet files that arrive in `folder`."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    )


def write_classified(
    deliveries: DataFrame, secret: str | None, output: str, checkpoint: str
) -> StreamingQuery:
    """Classify what has arrived and append it to a table; the file sink writes a batch once."""
    return (
        classify_deliveries(deliveries, secret).writeStream.format("parquet")
        .option("path", output).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def review_batches(
    corpus: Callable[[], DataFrame], secret: str | None, tables: str, job: str
) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that reviews accepted heads and stores what came of it.

    It writes `history`, `comments` and `results` below `tables`, each under the run
    `<job>-<batch>`, so a batch that is run again replaces its own rows and adds none. What
    contents hold is kept in `contents`, so a head costs the parsing of what it changes. Scratch tables
    of a batch go when it ends.
    """

    def put(rows: DataFrame, table: str, run: str) -> None:
        rows.write.mode("overwrite").parquet(f"{tables}/{table}/run={run}")

    def process(batch: DataFrame, batch_id: int) -> None:
        run, spark = f"{job}-{batch_id}", batch.sparkSession
        with scratch_scope(spark):
            accepted = materialize(accepted_deliveries(classify_deliveries(batch, secret)), "accepted")
            store = ContentStore(spark, f"{tables}/contents", scanners=scanners())
            reviews = review_heads(accepted, corpus(), store, run)
            put(reviews.comments(), "comments", run)
            put(reviews.results(), "results", run)
            # A history that cannot be written breaks no review; its rows wait for a later batch.
            history = f"{tables}/history"
            if append_or_keep(materialize(reviews.history_rows(), "history"), history, run, ["event_id"]):
                retry_appends(spark, history, ["event_id"])

    return process


def review_deliveries(
    deliveries: DataFrame,
    corpus: Callable[[], DataFrame],
    secret: str | None,
    tables: str,
    checkpoint: str,
    job: str = "deliveries",
) -> StreamingQuery:
    """Review what has arrived; start again with the same checkpoint for what comes later."""
    return (
        deliveries.writeStream.foreachBatch(review_batches(corpus, secret, tables, job))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
