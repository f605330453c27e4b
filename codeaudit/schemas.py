"""Row types shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeaudit import fixed

FILES = "repo STRING, path STRING, content STRING"

FINDINGS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("agent", T.StringType()),
    T.StructField("agent_ord", T.IntegerType()),
    T.StructField("rule", T.StringType()),
    T.StructField("severity", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("detail", T.StringType()),
    T.StructField("seq", T.LongType()),
])

SAST_REPORT = (
    "results ARRAY<STRUCT<test_id: STRING, test_name: STRING, issue_text: STRING, "
    "issue_severity: STRING, issue_confidence: STRING, filename: STRING, line_number: INT>>"
)

DELIVERY_BODY = (
    "STRUCT<action: STRING, number: STRING, repository: STRUCT<full_name: STRING>, "
    "pull_request: STRUCT<head: STRUCT<ref: STRING, sha: STRING>>>"
)

# Indices may be of any kind; `index_of` reads those that are whole numbers.
TRIAGE_REPLY = "ARRAY<STRUCT<i: VARIANT, explanation: STRING, fix: STRING>>"
FIX_REPLY = "ARRAY<STRUCT<i: VARIANT, original: STRING, fixed: STRING, note: STRING>>"
AGENT_COUNTS = "MAP<STRING, BIGINT>"


def severity_value(severity: Column, field: str) -> Column:
    """Look a severity up in the five-row dimension.

    The dimension is constant, so it is folded into the expression instead of joined.
    """
    at = ("level", "name", "label", "weight", "emoji").index(field)
    return F.element_at(F.array(*[F.lit(row[at]) for row in fixed.SEVERITIES]), severity + 1)


def severity_dim(spark: SparkSession) -> DataFrame:
    """The severity dimension as a table, for SQL users."""
    return spark.createDataFrame(
        list(fixed.SEVERITIES), "severity INT, name STRING, label STRING, weight INT, emoji STRING"
    )


def agent_position(agent: str) -> int:
    """Place of a detector in the report; plug-ins come after the built-in ones."""
    order = fixed.AGENT_ORDER
    return order.index(agent) if agent in order else len(order)


def as_findings(rows: DataFrame, agent: str) -> DataFrame:
    """Fill in the detector's name and cast to the findings row type."""
    filled = rows.withColumns(
        {"agent": F.lit(agent), "agent_ord": F.lit(agent_position(agent))}
    )
    return filled.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in FINDINGS.fields]
    )


def message(rule: str, *args: Column) -> tuple[Column, Column]:
    """Title and detail of a rule, with `args` filling the title's (else the detail's) blanks."""
    title, detail = fixed.MESSAGES[rule]

    def fill(text: str) -> Column:
        return F.format_string(text, *args) if "%" in text else F.lit(text)

    return fill(title), fill(detail)
