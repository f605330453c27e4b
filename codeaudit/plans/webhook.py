"""Reviews of pull-request heads, and what is stored about them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit.operators.contents import ContentStore
from codeaudit.operators.report import agent_counts, markdown_report
from codeaudit.plans.review import Review, run_review

HEAD = ("repo", "sha")


def _head_id() -> Column:
    return F.concat_ws("@", *HEAD)


@dataclass
class HeadReviews:
    """Each head is reviewed once, however many deliveries name it."""

    accepted: DataFrame
    review: Review

    def _with_head(self) -> DataFrame:
        return self.accepted.withColumn("_head", _head_id()).drop("event", "body", "signature")

    def _per_head(self, table: DataFrame) -> DataFrame:
        return table.withColumnRenamed("repo", "_head")

    def results(self) -> DataFrame:
        """`(event_id, repo, pr, findings, health_score, comment_posted)` per accepted delivery.

        Deliveries whose head is not in the corpus stay, with NULL findings and score.
        """
        scores = self._per_head(self.review.scores()).select("_head", "total", "health_score")
        return self._with_head().join(scores, "_head", "left").select(
            "event_id", "repo", F.col("pr_number").alias("pr"),
            F.col("total").alias("findings"), "health_score",
            F.lit(False).alias("comment_posted"),
        )

    def history_rows(self) -> DataFrame:
        """Wide rows for the history table, keyed by `event_id`."""
        counts = agent_counts(self.review.findings, ["repo"])
        heads = self.review.scores().join(counts, "repo", "left")
        none = F.create_map().cast("map<string,bigint>")
        return self._with_head().join(self._per_head(heads), "_head").select(
            "event_id", F.col("ts").alias("created_at"), F.lit("webhook").alias("source"),
            "repo", "pr_number", "health_score", "total",
            "critical", "high", "medium", "low", "info",
            F.coalesce("agents", none).alias("agents"),
        )

    def comments(self) -> DataFrame:
        """Outbox rows `(event_id, repo, pr, part, body, posted)`; sending them is another job's work."""
        bodies = markdown_report(
            self.review.repos(), self.review.findings, self.review.status(), ["repo"]
        )
        return self._with_head().join(self._per_head(bodies), "_head").select(
            "event_id", "repo", F.col("pr_number").alias("pr"), "part", "body",
            F.lit(False).alias("posted"),
        )


def review_heads(
    accepted: DataFrame, corpus: DataFrame, store: ContentStore | None = None, run: str | None = None
) -> HeadReviews:
    """Review the heads of accepted deliveries found in `corpus(repo, sha, path, content)`.

    With a `store`, only contents that no earlier head had are parsed; if the corpus has their
    `digest`, other contents are not even read.
    """
    heads = accepted.select(*HEAD).distinct()
    known = ["digest"] if "digest" in corpus.columns else []
    files = corpus.join(heads, list(HEAD), "left_semi").select(
        _head_id().alias("repo"), "path", "content", *known
    )
    return HeadReviews(accepted, run_review(files, store=store, run=run))
