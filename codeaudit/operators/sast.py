"""Static-analysis reports (Bandit JSON) as findings of the security detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit import fixed
from codeaudit.functions.paths import is_test_file, relative_to
from codeaudit.functions.rows import posexplode_rows
from codeaudit.functions.text import strict_json
from codeaudit.schemas import SAST_REPORT, as_findings


def sast_results(reports: DataFrame) -> DataFrame:
    """Explode reports `(repo, json)` into raw results; blank or broken ones give no rows."""
    results = strict_json(F.col("json"), f"STRUCT<{SAST_REPORT}>")["results"]
    return posexplode_rows(reports, [c for c in reports.columns if c != "json"], results, "pos", "result")


def sast_findings(reports: DataFrame, root: Column | None = None) -> DataFrame:
    """Findings of reports `(repo, json)`; `root` is the prefix to take off file names.

    Asserts in test files are how tests are written and are left out.
    """
    result = sast_results(reports)
    scale = F.create_map(*[F.lit(v) for kv in fixed.SAST_SEVERITY.items() for v in kv])
    level = F.coalesce(F.try_element_at(scale, F.col("result.issue_severity")), F.lit(fixed.LOW))

    def filled(field: str, default: object) -> Column:
        return F.coalesce(F.col(f"result.{field}"), F.lit(default))

    rows = result.select(
        *[c for c in result.columns if c not in ("pos", "result")],
        filled("test_id", fixed.SAST_DEFAULT_RULE).alias("rule"),
        level.alias("severity"),
        filled("issue_text", fixed.SAST_DEFAULT_TITLE).alias("title"),
        relative_to(filled("filename", ""), root).alias("file"),
        filled("line_number", 0).alias("line"),
        F.concat(
            filled("test_name", ""), F.lit(" (confidence: "),
            filled("issue_confidence", "?"), F.lit(")"),
        ).alias("detail"),
        F.col("pos").cast("long").alias("seq"),
    )
    test_assert = (F.col("rule") == fixed.SAST_ASSERT_RULE) & is_test_file(F.col("file"))
    return as_findings(rows.filter(~test_assert), "security")
