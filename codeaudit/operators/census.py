"""File census and routing of repositories to detectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit import fixed
from codeaudit.functions.paths import in_skipped_dir, suffix_or_none
from codeaudit.functions.rows import inline_rows
from codeaudit.schemas import agent_position


def reviewed_files(files: DataFrame) -> DataFrame:
    """Files outside skipped folders."""
    return files.filter(~in_skipped_dir(F.col("path")))


def file_census(files: DataFrame) -> DataFrame:
    """Number of files per repository and suffix. Reads no contents."""
    return (
        reviewed_files(files)
        .groupBy("repo", suffix_or_none(F.col("path")).alias("suffix"))
        .agg(F.count("*").alias("n"))
    )


def census_map(census: DataFrame) -> DataFrame:
    """The census as one map per repository (as many entries as there are suffixes)."""
    entries = F.array_sort(F.collect_list(F.struct("suffix", "n")))
    return census.groupBy("repo").agg(F.map_from_entries(entries).alias("census"))


def route_agents(
    census: DataFrame, rules: Mapping[str, Sequence[str]] = fixed.AGENT_SUFFIXES
) -> DataFrame:
    """Detectors `(repo, agent, agent_ord)` each repository needs, given its suffixes.

    The rules are a constant, so each census row yields its detectors in place of a join.
    """
    wanted = F.array(*[
        F.when(
            F.col("suffix").isin(*suffixes),
            F.struct(F.lit(name).alias("agent"), F.lit(agent_position(name)).alias("agent_ord")),
        )
        for name, suffixes in rules.items()
    ])
    needed = F.filter(wanted, lambda agent: agent.isNotNull())
    return inline_rows(census, ["repo"], needed, "agent").distinct()


def routed_repos(routes: DataFrame, agent: str) -> DataFrame:
    return routes.filter(F.col("agent") == agent).select("repo")
