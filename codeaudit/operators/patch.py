"""Exact-match patches: snippets, validation, application and the fix report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit import fixed
from codeaudit.functions.paths import contained
from codeaudit.functions.text import occurrences, split_lines, unify_newlines
from codeaudit.operators.piecetable import patch_batches
from codeaudit.operators.ranking import running_totals

FILE = ("repo", "path")
# Proposals of one part of a fix report.
PART_FIXES = 1_000


def safe_paths(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requests `(repo, path, …)` with `safe_path`: inside the repository and an existing file."""
    inside = requests.withColumn("safe_path", contained(F.col("path")))
    known = files.select("repo", F.col("path").alias("safe_path"))
    return inside.join(known, ["repo", "safe_path"], "left_semi").select(
        *requests.columns, "safe_path"
    )


def snippet(content: Column, line: Column, radius: int = fixed.SNIPPET_RADIUS) -> Column:
    """The lines around `line`, joined; empty when it lies past the end."""
    lines = split_lines(unify_newlines(content))
    first = F.greatest(F.lit(1), line - radius)
    return F.array_join(F.slice(lines, first, line + radius - first + 1), "\n")


def _with_content(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Join rows `(repo, file, …)` to the contents of the files they name safely."""
    placed = rows.withColumn("path", contained(F.col("file")))
    return placed.join(files.select(*FILE, "content"), list(FILE))


def fix_snippets(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates `(repo, file, line, …)` with the code around their line."""
    joined = _with_content(candidates, files)
    return joined.select(*candidates.columns, snippet(F.col("content"), F.col("line")).alias("snippet"))


def validate_patches(
    items: DataFrame, candidates: DataFrame, files: DataFrame, key: Sequence[str] = ("review_id",)
) -> DataFrame:
    """Proposals: items that name a candidate and change text found exactly once in its file.

    Cheap tests come before the join to contents.
    """
    real = items.filter(
        F.col("original").isNotNull() & F.col("fixed").isNotNull()
        & (F.col("original") != F.col("fixed")) & (F.col("original") != "")
    )
    keys = [*key, "i"]
    named = real.join(
        candidates.select(*keys, "repo", "file", "line", "rule", "title"), keys
    )
    once = occurrences(unify_newlines(F.col("content")), F.col("original")) == 1
    return _with_content(named, files).filter(once).select(
        *key, "i", "pos", "repo", "file", "line", "rule", "title", "original", "fixed", "note"
    )


def apply_patches(files: DataFrame, patches: DataFrame) -> DataFrame:
    """Patched files `(repo, path, new_content, n_applied)` for `patches(repo, path, ord, original, fixed)`.

    Patches of a file apply in order, each only if its original occurs exactly once in the
    text as patched so far. Inputs stay as they are. Spellings of one path are one file;
    `refused_patches` has the patches that name none. A file and its patches are sorted next to each other
    and streamed through a piece table, so no row and no task holds the patches of a file.
    """
    patches = patches.withColumn("path", contained(F.col("path"))).filter("path IS NOT NULL")
    none = F.lit(None).cast("string")
    texts = files.join(patches.select(*FILE).distinct(), list(FILE), "left_semi").select(
        *FILE, F.lit(0).alias("_side"), F.lit(None).cast(patches.schema["ord"].dataType).alias("ord"),
        unify_newlines(F.coalesce("content", F.lit(""))).alias("text"), none.alias("original"), none.alias("fixed"))
    changes = patches.select(*FILE, F.lit(1).alias("_side"), "ord", none.alias("text"), "original", "fixed")
    rows = texts.unionByName(changes).repartition(*FILE).sortWithinPartitions(*FILE, "_side", "ord", "original", "fixed")
    return rows.select(*FILE, "text", "original", "fixed").mapInArrow(
        patch_batches, "repo string, path string, new_content string, n_applied int")


def apply_proposals(files: DataFrame, proposals: DataFrame) -> DataFrame:
    """Files as validated proposals leave them; a file's proposals apply in the order of review, index and place."""
    changes = proposals.select(
        "repo", F.col("file").alias("path"), F.struct("review_id", "i", "pos").alias("ord"), "original", "fixed")
    return apply_patches(files, changes)


def refused_patches(files: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches that no file takes, with the `reason`: outside the repository, or no such file."""
    inside = patches.withColumn("_inside", contained(F.col("path")))
    known = files.select("repo", F.col("path").alias("_inside"))
    reason = F.when(F.col("_inside").isNull(), "outside").otherwise("no file").alias("reason")
    return inside.join(known, ["repo", "_inside"], "left_anti").select(*patches.columns, reason)


def fix_report(
    proposals: DataFrame, key: Sequence[str] = ("review_id",), title: str = fixed.FIX_REPORT_TITLE,
    part_fixes: int = PART_FIXES,
) -> DataFrame:
    """Proposals of each review as JSON and as Markdown with diffs, `(key, part, fixes_json, fixes_md)`.

    A part has `part_fixes` proposals, so no row grows with the review; the title stands in part 0, and
    the parts in order, joined by a line break, are one document.
    """
    fields = ("file", "line", "rule", "title", "original", "fixed", "note")
    one = proposals.withColumn("_one", F.lit(1))
    numbered = running_totals(one, key, [F.col("pos"), *[F.col(f) for f in fields]], "_one", "_at")
    listed = F.array_sort(F.collect_list(F.struct("_at", *fields)))
    part = F.floor(F.col("_at") / part_fixes).cast("long").alias("part")
    grouped = numbered.groupBy(*key, part).agg(listed.alias("_listed"))

    def diff(text: Column, mark: str) -> Column:
        return F.transform(split_lines(text), lambda line: F.concat(F.lit(mark), line))

    def section(p: Column) -> Column:
        head = F.format_string(
            "## %d. %s (`%s:%d`, `%s`)", p["_at"] + 1, p["title"], p["file"], p["line"], p["rule"]
        )
        note = F.when(p["note"] != "", F.concat(p["note"], F.lit("\n"))).otherwise("")
        lines = F.concat(
            F.array(head, note, F.lit("```diff")), diff(p["original"], "- "), diff(p["fixed"], "+ "),
            F.array(F.lit("```\n")),
        )
        return F.array_join(lines, "\n")

    plain = F.transform("_listed", lambda p: F.struct(*[p[f].alias(f) for f in fields]))
    head = F.when(F.col("part") == 0, f"# {title}\n")
    body = F.concat_ws("\n", head, F.transform("_listed", section))
    return grouped.select(*key, "part", F.to_json(plain).alias("fixes_json"), body.alias("fixes_md"))
