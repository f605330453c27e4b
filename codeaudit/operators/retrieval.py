"""Chunk index and retrieval of context for prompts. Everything is per repository."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit import fixed
from codeaudit.functions.paths import in_skipped_dir, path_order, suffix
from codeaudit.functions.rows import inline_rows
from codeaudit.functions.text import SPACES, split_lines, strip, unify_newlines
from codeaudit.operators.nearest import nearest
from codeaudit.operators.postings import asked_words, build_index, search
from codeaudit.operators.ranking import SHARES, first_rows, running_totals
from codeaudit.storage import materialize


def indexed_files(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """Indexable files, or those among the first `max_files` of each repository in path order.

    A limit is found on paths alone. Only repositories that reach it are joined back,
    with their last admitted path, so contents are not sorted and this join stays small.
    """
    path = F.col("path")
    eligible = files.filter(
        suffix(path).isin(*fixed.INDEX_SUFFIXES) & ~in_skipped_dir(path, fixed.INDEX_SKIP_DIRS)
    )
    if max_files is None:
        return eligible
    place = path_order(path)
    places = eligible.select("repo", place.alias("_place"))
    head = first_rows(places, ["repo"], [F.col("_place")], max_files, "_n", SHARES)
    last = head.filter(F.col("_n") == max_files).select("repo", F.col("_place").alias("_last"))
    admitted = F.col("_last").isNull() | (place <= F.col("_last"))
    return eligible.join(last, "repo", "left").filter(admitted).drop("_last")


def chunk_lines(files: DataFrame, size: int = fixed.CHUNK_LINES) -> DataFrame:
    """Non-empty chunks of `size` lines, in the row: `(…, first_line, text)`."""
    lines = files.withColumn("_lines", split_lines(unify_newlines(F.col("content"))))
    starts = F.when(
        F.size("_lines") > 0, F.sequence(F.lit(1), F.size("_lines"), F.lit(size))
    ).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(
        starts,
        lambda s: F.struct(
            s.alias("first_line"),
            strip(F.array_join(F.slice("_lines", s, size), "\n")).alias("text"),
        ),
    )
    kept = F.filter(chunks, lambda c: c["text"] != "")
    placed = F.transform(kept, lambda c, n: F.struct(n.alias("nth"), c["first_line"].alias("first_line"), c["text"].alias("text")))
    return inline_rows(lines, [c for c in files.columns if c != "content"], placed, "text")


def chunk_index(
    files: DataFrame,
    standards: tuple[str, str] | None = None,
    chunk_size: int = fixed.CHUNK_LINES,
    max_files: int | None = None,
    max_chunks: int | None = None,
) -> DataFrame:
    """Chunks `(repo, ord, source, text)` of each repository, `ord` from 0.

    `standards` is a `(name, text)` document that every repository gets after its files. The limits
    cut a repository's files and chunks. A chunk's number is the number of chunks in earlier
    files, by sums of counts, and its place in its own file: texts are never sorted.
    """
    chosen = indexed_files(files, max_files).select("repo", F.lit(0).alias("_last"), "path", "content")
    if standards is not None:
        name, text = standards
        everywhere = files.select("repo").distinct().select(
            "repo", F.lit(1).alias("_last"), F.lit(name).alias("path"), F.lit(text).alias("content")
        )
        chosen = chosen.unionByName(everywhere)
    rows = materialize(chunk_lines(chosen, chunk_size), "chunks")
    key = ["repo", "_last", "path"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    offsets = running_totals(counts, ["repo"], [F.col("_last"), path_order(F.col("path"))], "_n", "_before")
    placed = rows.join(offsets.drop("_n"), key).select(
        "repo",
        (F.col("_before") + F.col("nth")).alias("ord"),
        F.concat_ws(":", "path", F.col("first_line").cast("string")).alias("source"),
        "text",
    )
    return placed if max_chunks is None else placed.filter(F.col("ord") < max_chunks)


def keyword_topk(chunks: DataFrame, queries: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """Best `k` chunks for each query `(query_id, repo, query)` by keyword score, see `postings`.

    The index has the words of these queries only; to keep one for many, use `build_index` and `search`.
    """
    index = materialize(build_index(chunks, asked_words(queries)), "postings")
    found = search(index, queries, k)
    return found.join(chunks.select("repo", "ord", "source"), ["repo", "ord"]).select(
        "query_id", "repo", "rank", "ord", "source", "score")


def vector_topk(index: DataFrame, queries: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """Nearest `k` vectors of `(repo, ord, vector)` for each `(query_id, repo, vector)`, see `nearest`."""
    return nearest(index, queries, k)


def vector_index(vectors: DataFrame, order: Sequence[str], max_chunks: int | None = None) -> DataFrame:
    """Vectors `(repo, …, vector)` with their number in the repository, or the first `max_chunks` of each."""
    place = [F.col(c) for c in order]
    if max_chunks is None:
        return running_totals(vectors.withColumn("_one", F.lit(1)), ["repo"], place, "_one", "ord").drop("_one")
    kept = first_rows(vectors, ["repo"], place, max_chunks, "_n", SHARES)
    return kept.withColumn("ord", (F.col("_n") - 1).cast("long")).drop("_n")


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    k: int = fixed.TOP_K,
) -> DataFrame:
    """Context of each query `(query_id, repo, query)`: `(query_id, repo, rank, ord, source, text, backend)`.

    By vectors where the query's repository has some, of its chunks `(repo, ord, vector)`, and the query has
    one, `(query_id, vector)`; else, and where that finds nothing, by keywords. A blank query has no context.
    """
    asked = queries.filter(F.btrim("query", F.lit(SPACES)) != "")
    parts, rest = [], asked
    if vectors is not None and query_vectors is not None:
        held = vectors.join(chunks.select("repo", "ord"), ["repo", "ord"], "left_semi")
        near = asked.join(query_vectors, "query_id").filter("vector IS NOT NULL").select("query_id", "repo", "vector")
        by_vector = materialize(vector_topk(held, near, k), "retrieved")
        parts.append(by_vector.select("query_id", "repo", "rank", "ord", F.lit("vector").alias("backend")))
        rest = asked.join(by_vector.select("query_id").distinct(), "query_id", "left_anti")
    by_word = keyword_topk(chunks, rest, k)
    parts.append(by_word.select("query_id", "repo", "rank", "ord", F.lit("keyword").alias("backend")))
    best = reduce(DataFrame.unionByName, parts)
    return best.join(chunks.select("repo", "ord", "source", "text"), ["repo", "ord"]).select(
        "query_id", "repo", "rank", "ord", "source", "text", "backend")


def context_blocks(best: DataFrame, chunks: DataFrame) -> DataFrame:
    """Retrieved chunks of each query as one text, best first."""
    texts = best.join(chunks.select("repo", "ord", "text"), ["repo", "ord"])
    shown = F.struct("rank", F.concat(F.lit("["), "source", F.lit("]\n"), "text").alias("text"))
    ordered = F.array_sort(F.collect_list(shown))
    return texts.groupBy("query_id", "repo").agg(
        F.array_join(F.transform(ordered, lambda c: c["text"]), "\n\n").alias("context")
    )


def retrieval_queries(
    findings: DataFrame, key: Sequence[str], order: Sequence[str], chars: int | None = None
) -> DataFrame:
    """Query text of each review: distinct `rule title` strings in list order, cut to `chars` if given.

    Each string takes at least two characters with its separator, so only the first `chars` of
    them can show. Without a cut the text is as long as the review has different strings.
    """
    text = F.concat_ws(" ", "rule", "title")
    first = findings.groupBy(*key, text.alias("_text")).agg(F.min(F.struct(*order)).alias("_at"))
    if chars is not None:
        first = first_rows(first, list(key), [F.col("_at"), F.col("_text")], chars, "_n")
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda t: t["_text"]), " "
    )
    return first.groupBy(*key).agg((joined if chars is None else F.substring(joined, 1, chars)).alias("query"))
