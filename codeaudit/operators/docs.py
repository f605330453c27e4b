"""Documentation detector: README, module docstrings, public docstrings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit import fixed
from codeaudit.functions.paths import base_name, has_test_name, path_order
from codeaudit.functions.rows import inline_rows
from codeaudit.operators.ranking import SHARES, first_rows
from codeaudit.schemas import as_findings, message

_MISSING = "DOC_MISSING_DOCSTRING"


def no_readme(files: DataFrame, repos: DataFrame) -> DataFrame:
    """Repositories of `repos` without a root entry whose name starts with README."""
    with_readme = files.filter(F.col("path").startswith("README")).select("repo").distinct()
    title, detail = message("DOC_NO_README")
    return repos.select("repo").join(with_readme, "repo", "left_anti").select(
        "repo",
        F.lit("DOC_NO_README").alias("rule"), F.lit(fixed.LOW).alias("severity"),
        title.alias("title"), F.lit(".").alias("file"), F.lit(0).alias("line"),
        detail.alias("detail"), F.lit(0).cast("long").alias("seq"),
    )


def undocumented(facts: DataFrame) -> DataFrame:
    """Modules and public definitions (at any depth) without a docstring."""
    parsed = facts.filter(F.col("error").isNull() & ~has_test_name(F.col("path")))
    module_title, module_detail = message("DOC_NO_MODULE_DOC", F.col("path"))

    def row(rule, title, line, detail, seq):
        return F.struct(
            F.lit(rule).alias("rule"), title.alias("title"), line.alias("line"),
            detail.alias("detail"), seq.cast("long").alias("seq"),
        )

    def definition(d):
        title, detail = message(_MISSING, d["kind"], d["name"])
        return row(_MISSING, title, d["line"], detail, d["seq"] + 1)

    module = F.when(
        ~F.col("has_doc") & (base_name(F.col("path")) != "__init__.py"),
        F.array(row("DOC_NO_MODULE_DOC", module_title, F.lit(1), module_detail, F.lit(0))),
    ).otherwise(F.array())
    bare = F.filter("defs", lambda d: ~d["has_doc"] & ~d["name"].startswith("_"))
    found = F.concat(module, F.transform(bare, definition))
    rows = inline_rows(parsed, ["repo", F.col("path").alias("file")], found, "rule")
    return rows.withColumn("severity", F.lit(fixed.INFO))


def cut(candidates: DataFrame, limit: int = fixed.DOC_FINDINGS) -> DataFrame:
    """Keep each repository's rows up to its stopping row.

    The stopping row is the first missing-docstring row at position `limit` or later, so
    module rows may run past the limit. It takes the first `limit` rows (a group limit
    before the shuffle) and a minimum (pre-aggregated); no task orders a whole repository.
    """
    place = F.struct(F.when(F.col("file") == ".", "").otherwise(path_order(F.col("file"))), "seq")
    placed = candidates.withColumn("_place", place)
    places = placed.select("repo", "_place")
    head = first_rows(places, ["repo"], [F.col("_place")], limit, "_n", SHARES)
    full = head.filter(F.col("_n") == limit).select("repo", F.col("_place").alias("_limit"))
    stops = (
        placed.filter(F.col("rule") == _MISSING).select("repo", "_place")
        .join(full, "repo")
        .filter(F.col("_place") >= F.col("_limit"))
        .groupBy("repo").agg(F.min("_place").alias("_stop"))
    )
    inside = F.col("_stop").isNull() | (F.col("_place") <= F.col("_stop"))
    return placed.join(stops, "repo", "left").filter(inside).drop("_place", "_stop")


def docs_findings(
    facts: DataFrame, files: DataFrame, repos: DataFrame, limit: int | None = None
) -> DataFrame:
    """`repos` are the repositories routed to this detector; `limit` is the one of `cut`, None for all rows."""
    candidates = no_readme(files, repos).unionByName(undocumented(facts))
    return as_findings(candidates if limit is None else cut(candidates, limit), "documentation")
