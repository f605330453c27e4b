"""Pull-request deliveries, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit import fixed
from codeaudit.functions.text import hmac_sha256, strict_json
from codeaudit.schemas import DELIVERY_BODY


def signature_ok(body: Column, signature: Column, secret: str | None) -> Column:
    """True without a secret; otherwise the header must carry the body's HMAC-SHA256."""
    if not secret:
        return F.lit(True)
    expected = F.concat(F.lit("sha256="), hmac_sha256(body.cast("binary"), secret.encode()))
    return F.coalesce(expected == signature, F.lit(False))


def classify_deliveries(deliveries: DataFrame, secret: str | None) -> DataFrame:
    """Disposition of deliveries `(…, event, body, signature)`, with repo, PR and head if accepted.

    Tests come in this order: signature, event, body (one JSON object and nothing after it; of a
    repeated key the last counts), action, required fields.
    Stateless, so it runs unchanged on a stream.
    """
    parsed = deliveries.withColumn("_p", strict_json(F.col("body").cast("string"), DELIVERY_BODY))
    # A number may come as text; what is no number leaves the delivery incomplete.
    number = F.col("_p.number").try_cast("bigint")
    complete = F.col("_p.repository.full_name").isNotNull() & number.isNotNull()
    disposition = (
        F.when(~signature_ok(F.col("body"), F.col("signature"), secret), "rejected")
        .when(F.coalesce(F.col("event"), F.lit("")) != fixed.PR_EVENT, "skipped event")
        .when(F.col("_p").isNull(), "malformed")
        .when(
            ~F.coalesce(F.col("_p.action").isin(*fixed.PR_ACTIONS), F.lit(False)), "skipped action"
        )
        .when(~complete, "malformed")
        .otherwise("accepted")
    )
    accepted = F.col("disposition") == "accepted"
    return parsed.withColumn("disposition", disposition).select(
        *deliveries.columns,
        "disposition",
        F.when(accepted, F.col("_p.repository.full_name")).alias("repo"),
        F.when(accepted, number).alias("pr_number"),
        F.when(accepted, F.col("_p.pull_request.head.ref")).alias("ref"),
        F.when(accepted, F.col("_p.pull_request.head.sha")).alias("sha"),
    )


def accepted_deliveries(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("disposition") == "accepted")


def pr_snapshots(accepted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """`(repo, sha, path)` of the heads that deliveries name; without a snapshot, one row with NULL.

    Each head stands once, however many deliveries name it: `accepted` itself has the head of
    each delivery. `snapshots` is `(repo, sha, path)`.
    """
    heads = accepted.select("repo", "sha").distinct()
    return heads.join(snapshots.select("repo", "sha", "path"), ["repo", "sha"], "left")
