"""Test-gap detector: public definitions that no test file mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit import fixed
from codeaudit.functions.paths import in_skipped_dir, is_python, is_test_file, path_order
from codeaudit.functions.rows import explode_rows
from codeaudit.functions.text import identifiers
from codeaudit.operators.ranking import SHARES, first_rows
from codeaudit.schemas import as_findings, message


def python_files(files: DataFrame) -> DataFrame:
    return files.filter(is_python(F.col("path")) & ~in_skipped_dir(F.col("path")))


def file_counts(files: DataFrame) -> DataFrame:
    """Source and test files per repository; reads no contents."""
    is_test = is_test_file(F.col("path"))
    return (
        python_files(files).groupBy("repo")
        .agg(F.count_if(~is_test).alias("n_sources"), F.count_if(is_test).alias("n_tests"))
    )


def test_identifiers(files: DataFrame) -> DataFrame:
    """Distinct identifiers over the test files of each repository, comments included.

    Repeats go in the row and again before the shuffle.
    """
    tests = python_files(files).filter(is_test_file(F.col("path")))
    found = F.array_distinct(identifiers(F.col("content")))
    return explode_rows(tests, ["repo"], found, "name").distinct()


def public_api(facts: DataFrame) -> DataFrame:
    """Public module-level functions and classes of source files."""
    return (
        facts.filter(~is_test_file(F.col("path")))
        .select("repo", "path", F.inline("defs"))
        .filter(F.col("top") & ~F.col("name").startswith("_"))
        .select("repo", "path", "name", "line", "kind", "seq")
    )


def named_in_tests(observed: DataFrame) -> DataFrame:
    """As `test_identifiers`, of `(repo, names)` that one pass over the contents has found."""
    return explode_rows(observed, ["repo"], F.col("names"), "name").distinct()


def untested(facts: DataFrame, files: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Every public definition without a mention, in repositories that have tests.

    `named` has the `(repo, name)` of test files; without it their contents are read.
    """
    named = test_identifiers(files) if named is None else named
    tested_repos = file_counts(files).filter(F.col("n_tests") > 0).select("repo")
    return (
        public_api(facts)
        .join(named, ["repo", "name"], "left_anti")
        .join(tested_repos, "repo", "left_semi")
    )


def no_tests(files: DataFrame) -> DataFrame:
    """One row per repository that has sources but not a single test file."""
    title, detail = message("TEST_NO_TESTS", F.col("n_sources"))
    bare = file_counts(files).filter((F.col("n_sources") > 0) & (F.col("n_tests") == 0))
    return bare.select(
        "repo",
        F.lit("TEST_NO_TESTS").alias("rule"), F.lit(fixed.MEDIUM).alias("severity"),
        title.alias("title"), F.lit(".").alias("file"), F.lit(0).alias("line"),
        detail.alias("detail"), F.lit(0).alias("seq"),
    )


def gaps(
    facts: DataFrame, files: DataFrame, limit: int | None = None, named: DataFrame | None = None
) -> DataFrame:
    """The gaps of each repository, or its first `limit` in path and definition order."""
    kept = untested(facts, files, named)
    if limit is not None:
        order = [path_order(F.col("path")), F.col("seq")]
        kept = first_rows(kept, ["repo"], order, limit, "_n", SHARES)
    title, detail = message("TEST_GAP", F.col("kind"), F.col("name"))
    return kept.select(
        "repo",
        F.lit("TEST_GAP").alias("rule"), F.lit(fixed.LOW).alias("severity"),
        title.alias("title"), F.col("path").alias("file"), "line",
        detail.alias("detail"), "seq",
    )


def test_gap_findings(
    facts: DataFrame, files: DataFrame, limit: int | None = None, named: DataFrame | None = None
) -> DataFrame:
    return as_findings(no_tests(files).unionByName(gaps(facts, files, limit, named)), "test-gap")


# Names of this module start like tests; keep pytest from collecting them.
test_identifiers.__test__ = False
test_gap_findings.__test__ = False
