"""Prompts for findings and the merge of replies. Findings are never added or lost."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit import fixed
from codeaudit.functions.paths import path_order
from codeaudit.functions.rows import posexplode_rows
from codeaudit.functions.text import once, strict_json, strip_fence
from codeaudit.operators.ranking import number_rows
from codeaudit.schemas import FIX_REPLY, TRIAGE_REPLY, severity_value

KEY = ("review_id", "agent")
# Findings per prompt. Indices run on over the prompts of a detector.
PROMPT_FINDINGS = 2_000

# Each task states the schema of the reply that `reply_items` and `fix_items` read.
TRIAGE_TASK = (
    "below is a table of findings as JSON, numbered by i. For every i that you can judge, reply with an object of "
    "three keys: i (the same number), explanation (what can go wrong, one sentence) and fix (what to change, one "
    "sentence). The whole reply is one JSON array of such objects, without numbers that are not in the table."
)
FIX_TASK = (
    "Each numbered finding comes with the lines around it. For those with an obvious local repair, reply with an object "
    "of four keys: i (the number), original (lines as they stand, unchanged down to the spaces), fixed (the lines that "
    "replace them) and note (a few words). The whole reply is one JSON array of such objects; it may be empty."
)


def list_order() -> list[Column]:
    """Order of a detector's own list: reports as they came, files by path, then position."""
    reported = F.when(F.col("agent") == "security", F.col("seq")).otherwise(0)
    place = F.when(F.col("file") == ".", "").otherwise(path_order(F.col("file")))
    ties = [F.col(c) for c in ("seq", "line", "rule", "severity", "title", "detail")]
    return [reported, place, *ties]


def indexed_findings(findings: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Findings with their 0-based index `i` in the detector's list."""
    numbered = number_rows(findings, list(key), list_order(), "_n")
    return numbered.withColumn("i", (F.col("_n") - 1).cast("int")).drop("_n")


def _payload(fields: Sequence[str]) -> Column:
    """JSON array of the given fields, in the order of `i`."""
    items = F.array_sort(F.collect_list(F.struct(*fields)))
    return F.to_json(items)


def triage_prompts(
    indexed: DataFrame,
    contexts: DataFrame | None = None,
    roles: Mapping[str, str] = fixed.AGENT_ROLES,
    key: Sequence[str] = KEY,
    per_prompt: int = PROMPT_FINDINGS,
) -> DataFrame:
    """One prompt `(key, batch, payload, prompt)` per detector of a review.

    A detector with more than `per_prompt` findings gets several, split by index.
    `contexts` may give a `context` text per key.
    """
    batch = F.floor(F.col("i") / per_prompt).cast("int").alias("batch")
    rows = indexed.withColumn("severity", severity_value(F.col("severity"), "label"))
    fields = ("i", "rule", "title", "file", "line", "severity")
    prompts = rows.groupBy(*key, batch).agg(_payload(fields).alias("payload"))
    role_of = F.create_map(*[F.lit(v) for kv in roles.items() for v in kv])
    role = F.coalesce(F.try_element_at(role_of, F.col("agent")), F.lit("code reviewer"))
    context = F.lit("")
    if contexts is not None:
        prompts = prompts.join(contexts, list(key), "left")
        context = F.when(
            F.col("context") != "",
            F.concat(F.lit("From the same repository:\n"), "context", F.lit("\n\n")),
        ).otherwise("")
    text = F.concat(
        F.lit("As a "), role, F.lit(f", {TRIAGE_TASK}\n\n"), context, F.lit("Findings:\n"), "payload"
    )
    return prompts.select(*key, "batch", "payload", text.alias("prompt"))


def reply_items(replies: DataFrame, schema: str) -> DataFrame:
    """Items of model replies `(…, reply)` as `(…, pos, item)`.

    A reply that does not parse, or has an item without an index, gives no items. An index that
    is there but is no whole number names no finding: its item stays, with a NULL `i` by `index_of`.
    """
    rest = [c for c in replies.columns if c != "reply"]
    parsed = replies.select(*rest, strict_json(strip_fence(F.col("reply")), schema).alias("_items"))
    complete = F.forall("_items", lambda item: item["i"].isNotNull())
    return posexplode_rows(parsed, rest, F.when(complete, F.col("_items")), "pos", "item")


def index_of(item: Column) -> Column:
    """The index of a reply item; NULL unless it is a whole number (a number as text is none)."""
    numeric = F.schema_of_variant(item["i"]).rlike("^(BIGINT|DECIMAL|DOUBLE)")
    whole = once(F.try_variant_get(item["i"], "$", "double"), lambda number: F.when(number == F.floor(number), number.try_cast("int")))
    return F.when(numeric, whole)


def merge_triage(indexed: DataFrame, replies: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Findings with `explanation` and `fix_hint` of the matching reply item, else empty.

    Unknown indices are ignored; of several items with one index the last counts. Both sides
    are placed by (key, i), so the deduplicated items are not moved again for the join.
    """
    on = [*key, "i"]
    latest = (
        reply_items(replies, TRIAGE_REPLY)
        .select(*key, index_of(F.col("item")).alias("i"), "pos", F.struct("item.explanation", "item.fix").alias("item"))
        .filter("i IS NOT NULL").groupBy(*on).agg(F.max_by("item", "pos").alias("_item"))
    )
    merged = indexed.join(latest, on, "left")
    return merged.withColumns({
        "explanation": F.coalesce("_item.explanation", F.lit("")),
        "fix_hint": F.coalesce("_item.fix", F.lit("")),
    }).drop("_item")


def fix_prompts(snippets: DataFrame, key: Sequence[str] = ("review_id",)) -> DataFrame:
    """One prompt per review over its (at most ten) fix candidates with snippets."""
    fields = ("i", "rule", "title", "file", "line", "snippet")
    prompts = snippets.groupBy(*key).agg(_payload(fields).alias("payload"))
    text = F.concat(F.lit(f"{FIX_TASK}\n\nFindings with snippets:\n"), "payload")
    return prompts.select(*key, "payload", text.alias("prompt"))


def fix_items(replies: DataFrame) -> DataFrame:
    """Proposed changes of replies: `(…, pos, i, original, fixed, note)`."""
    items = strict_json(strip_fence(F.col("reply")), FIX_REPLY)
    rest = [c for c in replies.columns if c != "reply"]
    return posexplode_rows(replies, rest, items, "pos", "item").select(
        *rest, "pos", index_of(F.col("item")).alias("i"), "item.original", "item.fixed",
        F.coalesce("item.note", F.lit("")).alias("note"),
    )
