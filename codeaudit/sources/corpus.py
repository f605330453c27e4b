"""Corpus tables: one row per source file of many repositories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.functions.text import decode, unify_newlines


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet corpus `(repo, path, content)`; binary contents are decoded.

    Jobs that do not look into files never read the content column.
    """
    files = spread(spark.read.parquet(path))
    if dict(files.dtypes)["content"] == "binary":
        return files.withColumn("content", decode(F.col("content")))
    return files.withColumn("content", unify_newlines(F.col("content")))


def write_bucketed(files: DataFrame, table: str, buckets: int, key: Sequence[str] = ("repo", "path")) -> None:
    """Write a corpus as a table in buckets of its key, with the digest of each text.

    Joins on the key then move the other side only: snippets, patches and checks of proposals
    leave the contents where they are, and reviews with a `ContentStore` read only unknown ones.
    """
    known = files if "digest" in files.columns else files.withColumn("digest", F.sha2(F.coalesce("content", F.lit("")), 256))
    known.repartition(buckets, *key).write.bucketBy(buckets, *key).mode("overwrite").saveAsTable(table)


def spread(scan: DataFrame) -> DataFrame:
    """Share a scan with fewer splits than cores out over all cores; leave others alone.

    For inputs of work that is heavy per row, such as parsing. A large table has splits
    enough, so nothing is shuffled for it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
