"""Keyword retrieval over an inverted index in blocks.

Chunks of a repository are dealt to shards of `SHARD` numbers. For each repository, shard and
word the index lists the chunks with the word, best first, in blocks that know their best
score. A chunk's score is the sum of its words' parts, so a block whose best part, with the
best parts of the query's other words in that shard, stays below a score that `k` chunks are known to reach
cannot hold a result; its entries are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeaudit import fixed
from codeaudit.functions.rows import explode_rows
from codeaudit.functions.text import words
from codeaudit.operators.ranking import first_rows

SHARD = 4096
BLOCK = 128
COUNTED = 1 << 16  # words of chunks that are counted before they leave the task
# Bounds and scores are summed in different orders; scores that differ by less are not told apart by bounds.
SLACK = 1e-9
LIST = ("repo", "shard", "word")


def word_counts(chunks: DataFrame, most: int = COUNTED) -> DataFrame:
    """`(repo, ord, word, times, n_words)` of chunks `(repo, ord, text)`. Narrow: no shuffle.

    A task holds a batch of texts, and the counts of one text more than `most`.
    """
    kinds = {"repo": pa.string(), "ord": pa.int64(), "word": pa.string(), "times": pa.int32(), "n_words": pa.int32()}

    def made(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values())], [*kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in kinds]
            # Text by text; a list of all would hold a batch of long texts twice.
            for row in zip(*(batch.column(c) for c in ("repo", "ord", "text"))):
                repo, at, text = (value.as_py() for value in row)
                found = Counter(map(str.lower, re.findall(fixed.WORD, text or "")))
                n = sum(found.values())
                for column, values in zip(columns, ([repo] * len(found), [at] * len(found), found.keys(), found.values(), [n] * len(found))):
                    column.extend(values)
                if len(columns[0]) >= most:
                    yield made(columns)
                    columns = [[] for _ in kinds]
            yield made(columns)

    source = chunks.select("repo", F.col("ord").cast("long"), "text")
    return source.mapInArrow(run, "repo string, ord long, word string, times int, n_words int")


def asked_words(queries: DataFrame) -> DataFrame:
    """Distinct words of queries `(query_id, repo, query)`."""
    return explode_rows(queries, ["query_id", "repo"], F.array_distinct(words(F.col("query"))), "word")


def build_index(chunks: DataFrame, wanted: DataFrame | None = None, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Blocks `(repo, shard, word, block, top, entries)`; with `wanted` only of its `(repo, word)`.

    A list has at most `shard` entries, so no key grows with its repository.
    """
    counted = word_counts(chunks)
    if wanted is not None:
        counted = counted.join(wanted.select("repo", "word").distinct(), ["repo", "word"], "left_semi")
    part = F.col("times") / F.sqrt("n_words")
    placed = counted.select(
        "repo", F.floor(F.col("ord") / shard).cast("long").alias("shard"), "word", part.alias("part"), "ord", "times", "n_words")
    best_first = F.row_number().over(Window.partitionBy(*LIST).orderBy(F.desc("part"), "ord"))
    numbered = placed.withColumn("block", F.floor((best_first - 1) / block).cast("int"))
    return numbered.groupBy(*LIST, "block").agg(
        F.max("part").alias("top"), F.collect_list(F.struct("ord", "times", "n_words")).alias("entries"))


def _scores(blocks: DataFrame) -> DataFrame:
    """Score of each chunk over the entries of some blocks `(query_id, repo, entries)`."""
    rows = blocks.select("query_id", "repo", F.inline("entries"))
    return rows.groupBy("query_id", "repo", "ord").agg(
        F.sum("times").alias("_times"), F.first("n_words").alias("_n")
    ).select("query_id", "repo", "ord", (F.col("_times") / F.sqrt("_n")).alias("score"))


def needed_blocks(index: DataFrame, asked: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """`(query_id, repo, shard, word, block)` of the blocks that can hold one of a query's best `k`."""
    lists = index.select(*LIST, "block", "top")
    met = asked.join(lists, ["repo", "word"])
    heads = met.filter("block = 0")
    # Scores from the first blocks alone are bounds from below; the k-th of them is surely reached.
    reached = _scores(asked.join(index.filter("block = 0"), ["repo", "word"]))
    kth = first_rows(reached, ["query_id"], [F.desc("score"), F.col("ord")], k, "_n").filter(F.col("_n") == k)
    most = heads.groupBy("query_id", "repo", "shard").agg(F.sum("top").alias("_most"))
    own = heads.select("query_id", *LIST, F.col("top").alias("_own"))
    bounded = (
        met.join(own, ["query_id", *LIST]).join(most, ["query_id", "repo", "shard"])
        .join(kth.select("query_id", F.col("score").alias("_kth")), "query_id", "left"))
    bound = F.col("top") + F.col("_most") - F.col("_own")
    return bounded.filter(F.col("_kth").isNull() | (bound >= F.col("_kth") - SLACK)).select("query_id", *LIST, "block")


def search(index: DataFrame, queries: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """The best `k` chunks of each query `(query_id, repo, query)`: `(query_id, repo, rank, ord, score)`.

    Score: occurrences of query words over the square root of the chunk's word count; ties by `ord`.
    """
    asked = asked_words(queries)
    blocks = needed_blocks(index, asked, k).join(index.select(*LIST, "block", "entries"), [*LIST, "block"])
    best = first_rows(_scores(blocks), ["query_id"], [F.desc("score"), F.col("ord")], k, "rank")
    return best.select("query_id", "repo", "rank", "ord", "score")
