"""Static-analysis report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sast_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row `(repo, json)` per report file; the file's stem names the repository."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(
        name.alias("repo"), F.col("value").alias("json")
    )
