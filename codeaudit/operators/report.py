"""Ranking, scores, breakdowns and the Markdown report of reviews.

`key` names the columns that identify a review; findings carry them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit import fixed
from codeaudit.operators.ranking import first_rows, number_rows
from codeaudit.schemas import severity_value

KEY = ("review_id",)
# Findings of one part of a report.
PART_ROWS = 10_000


def rank_order() -> list[Column]:
    """Worst first, then file and line as text and number, then list order of the detectors."""
    ties = ("file", "line", "agent_ord", "seq", "rule", "title", "detail")
    return [F.desc("severity"), *[F.asc(c) for c in ties]]


def ranked_findings(findings: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Findings with their position `rank` in the review, from 1."""
    return number_rows(findings, list(key), rank_order(), "rank")


def review_totals(findings: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Counts by severity, total and penalty of reviews that have findings."""
    severity = F.col("severity")
    counts = [
        F.count_if(severity == level).alias(name.lower())
        for level, name, *_ in reversed(fixed.SEVERITIES)
    ]
    return findings.groupBy(*key).agg(
        F.count("*").alias("total"),
        F.sum(severity_value(severity, "weight")).alias("penalty"),
        *counts,
    )


def severity_pivot(reviews: DataFrame, findings: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Score and counts of every review; clean ones score 100 with zeros.

    Findings are counted before the join, so only one row per review is joined.
    """
    totals = review_totals(findings, key)
    joined = reviews.join(totals, list(key), "left")
    score = F.greatest(
        F.lit(0), fixed.PERFECT_SCORE - F.coalesce("penalty", F.lit(0))
    ).cast("int")
    counts = {c: F.coalesce(c, F.lit(0)) for c in totals.columns if c not in (*key, "penalty")}
    return joined.withColumns({**counts, "health_score": score}).drop("penalty")


def health_score(reviews: DataFrame, findings: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return severity_pivot(reviews, findings, key).select(*reviews.columns, "health_score")


def summary_line(count: dict[int, Column]) -> Column:
    """Counts of the levels that occur, worst first."""
    parts = [
        F.when(
            count[level] > 0,
            F.concat(F.lit(f"{emoji} "), count[level].cast("string"), F.lit(f" {label}")),
        )
        for level, _, label, _, emoji in reversed(fixed.SEVERITIES)
    ]
    return F.concat_ws(" · ", *parts)


def severity_summary(findings: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    totals = review_totals(findings, key)
    levels = {row[0]: F.col(row[1].lower()) for row in fixed.SEVERITIES}
    return totals.select(*key, summary_line(levels).alias("summary"))


def agent_totals(findings: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return findings.groupBy(*key, "agent", "agent_ord").agg(F.count("*").alias("n"))


def agent_counts(findings: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Findings per detector as a map, in report order; detectors without any are absent.

    The second grouping sees one row per detector.
    """
    entries = F.array_sort(F.collect_list(F.struct("agent_ord", "agent", "n")))
    pairs = F.transform(entries, lambda e: F.struct(e["agent"], e["n"]))
    return agent_totals(findings, key).groupBy(*key).agg(F.map_from_entries(pairs).alias("agents"))


def agent_status(
    routes: DataFrame, findings: DataFrame, errors: DataFrame | None = None,
    key: Sequence[str] = KEY,
) -> DataFrame:
    """One row per review and routed detector: number of findings, and an error or NULL.

    `errors` has the key, `agent` and `error`; of several, the first in text order shows.
    """
    on = [*key, "agent"]
    counts = findings.groupBy(*on).agg(F.count("*").alias("n_findings"))
    status = routes.select(*on).join(counts, on, "left")
    if errors is None:
        status = status.withColumn("error", F.lit(None).cast("string"))
    else:
        first = errors.groupBy(*on).agg(
            F.min("error").alias("_first"), F.count("*").alias("_n")
        )
        more = F.when(F.col("_n") > 1, F.format_string(" (and %d more)", F.col("_n") - 1))
        shown = F.concat("_first", F.coalesce(more, F.lit("")))
        status = status.join(first, on, "left").withColumn("error", shown)
    return status.select(*on, "error", F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def fix_candidates(
    findings: DataFrame, key: Sequence[str] = KEY, limit: int | None = None
) -> DataFrame:
    """Ranked findings that have a line and are LOW or worse, indexed from 0; the first `limit` if given."""
    fixable = findings.filter((F.col("severity") >= fixed.LOW) & (F.col("line") > 0))
    if limit is None:
        kept = number_rows(fixable, list(key), rank_order(), "_n")
    else:
        kept = first_rows(fixable, list(key), rank_order(), limit, "_n")
    return kept.withColumn("i", (F.col("_n") - 1).cast("int")).drop("_n")


def _table_row() -> Column:
    level = F.col("severity")
    place = F.concat_ws(":", F.col("file"), F.col("line").cast("string"))
    return F.concat(
        F.lit("| "), severity_value(level, "emoji"), F.lit(" "), severity_value(level, "label"),
        F.lit(" | "), F.col("title"), F.lit(" | `"),
        F.when(F.col("line") != 0, place).otherwise(F.col("file")),
        F.lit("` | `"), F.col("rule"), F.lit("` |"),
    )


def _details() -> Column:
    def optional(lead: str, name: str) -> Column:
        return F.when(F.col(name) != "", F.concat(F.lit(lead), F.col(name)))

    head = F.concat(
        F.lit("\n**"), severity_value(F.col("severity"), "emoji"), F.lit(" "), F.col("title"),
        F.lit("** (`"), F.col("file"), F.lit(":"), F.col("line").cast("string"),
        F.lit("`, `"), F.col("rule"), F.lit("`)"),
    )
    return F.concat_ws(
        "\n", head, optional("- ", "detail"), optional("- _Risk:_ ", "explanation"),
        optional("- _Fix:_ ", "fix_hint"),
    )


def _with_prose(findings: DataFrame) -> DataFrame:
    missing = [c for c in ("explanation", "fix_hint") if c not in findings.columns]
    return findings.withColumns({c: F.lit("") for c in missing}) if missing else findings


def report_heads(
    reviews: DataFrame, findings: DataFrame, status: DataFrame | None,
    key: Sequence[str] = KEY, title: str = fixed.REPORT_TITLE,
) -> DataFrame:
    """`(key, total, head)`: everything of a report before its table rows."""
    key = list(key)
    wide = severity_pivot(reviews.select(*key), findings, key)
    if status is None:
        wide = wide.withColumn("_failed", F.lit(None).cast("string"))
    else:
        text = F.format_string("> ⚠️ `%s` agent failed: %s\n", "agent", "error")
        failed = status.filter(F.col("error") != "").groupBy(*key).agg(
            F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("_failed")
        )
        wide = wide.join(failed, key, "left")
    levels = {row[0]: F.col(row[1].lower()) for row in fixed.SEVERITIES}
    score = F.format_string(
        "**Code-health score: %d/100** · %d finding(s)\n", "health_score", "total"
    )
    table = F.concat_ws(
        "\n", F.concat(summary_line(levels), F.lit("\n")), F.lit("\n".join(fixed.REPORT_TABLE_HEAD))
    )
    rest = F.when(F.col("total") > 0, table).otherwise(f"{fixed.REPORT_CLEAN}\n")
    head = F.concat_ws("\n", F.lit(f"## {title}\n"), score, "_failed", rest)
    return wide.select(*key, "total", head.alias("head"))


_DETAILS_OPEN = f"\n{fixed.REPORT_DETAILS_OPEN}\n"
_DETAILS_CLOSE = f"\n{fixed.REPORT_DETAILS_CLOSE}"


def report_lines(heads: DataFrame, findings: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Reports as blocks `(key, block, pos, text)` for reviews of any size.

    A review's texts in the order of (block, pos), joined by line breaks, are its report.
    No row grows with the review.
    """

    def block(number: int, text: Column, pos: Column | None = None) -> Column:
        place = (F.lit(0) if pos is None else pos).cast("long")
        return F.struct(F.lit(number).alias("block"), place.alias("pos"), text.alias("text"))

    fixed_blocks = F.array(
        block(0, F.col("head")), block(2, F.lit(_DETAILS_OPEN)), block(4, F.lit(_DETAILS_CLOSE))
    )
    shown = F.filter(fixed_blocks, lambda b: (b["block"] == 0) | (F.col("total") > 0))
    ranked = ranked_findings(_with_prose(findings), key)
    at = F.col("rank")
    body = F.array(block(1, _table_row(), at), block(3, _details(), at))
    return heads.select(*key, F.inline(shown)).unionByName(ranked.select(*key, F.inline(body)))


def markdown_report(
    reviews: DataFrame,
    findings: DataFrame,
    status: DataFrame | None = None,
    key: Sequence[str] = KEY,
    title: str = fixed.REPORT_TITLE,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Markdown reports `(key, part, body)`; the parts of a review in order, joined by a line break, are its document.

    A part holds at most `part_rows` findings, so no row grows with the review: one part of table rows and
    one of details for each piece of that size, or a single part for a review of one piece.
    """
    key = list(key)
    heads = report_heads(reviews, findings, status, key, title)
    ranked = ranked_findings(_with_prose(findings), key)
    piece = F.floor((F.col("rank") - 1) / part_rows).cast("long").alias("_piece")
    # Lines are written after findings are placed, so only their fields are moved.
    line = F.struct("rank", _table_row().alias("row"), _details().alias("details"))
    pieces = ranked.groupBy(*key, piece).agg(F.array_sort(F.collect_list(line)).alias("_found"))
    placed = heads.join(pieces, key, "left")

    many = F.ceil(F.col("total") / part_rows).cast("long")
    first, last = F.col("_piece") == 0, F.col("_piece") == many - 1
    rows = F.concat_ws("\n", F.when(first, F.col("head")), F.array_join("_found.row", "\n"))
    details = F.concat_ws(
        "\n", F.when(first, F.lit(_DETAILS_OPEN)), F.array_join("_found.details", "\n"), F.when(last, F.lit(_DETAILS_CLOSE)))
    part = lambda n, body: F.struct(n.cast("long").alias("part"), body.alias("body"))
    parts = (
        F.when(F.col("_piece").isNull(), F.array(part(F.lit(0), F.col("head"))))
        .when(many == 1, F.array(part(F.lit(0), F.concat_ws("\n", rows, details))))
        .otherwise(F.array(part(F.col("_piece"), rows), part(many + F.col("_piece"), details))))
    return placed.select(*key, F.inline(parts))
