"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, piece ids.

Each stage takes `(spark, docs, sf_dir)` and returns a frame that is written and reread before
the next. All but the last return the columns of `docs`. No SQL expresses the line, near
duplicate, contamination and piece stages, so tests hold them against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeaudit.llm import decontaminate, jaccard, linededup, pieces, quality
from codeaudit.llm.tables import table
from codeaudit.storage import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that copy, or nearly copy, an earlier one; documents left empty go."""
    return linededup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near duplicates."""
    return jaccard.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, with length and checksum of the text that they decode to."""
    return pieces.round_trip(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", piece_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
