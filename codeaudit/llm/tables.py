"""Small helpers that the operators share: reading inputs, names, keys and components."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from codeaudit.storage import materialize

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An input table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(name: str, taken: Iterable[str]) -> str:
    """`name`, with underscores before it until no taken column has it (case aside)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def row_key(docs: DataFrame) -> Column:
    """A 64-bit key of a document's own columns; equal rows have equal keys."""
    cols = [c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    # A null is skipped by the hash, so its place is hashed as well.
    return F.xxhash64(*[F.col(c) for c in cols], *[F.col(c).isNull() for c in cols])


def record(columns: dict, schema: StructType) -> pa.RecordBatch:
    """A batch with the columns and types of `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in target], schema=target)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what `a - b` join: each node with the smallest of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[u], label[v]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(label, shorter := label[label]):
            label = shorter
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """`(id, component)` for every end of `links(a, b)`: the smallest id reachable.

    Large-star and small-star steps by turns until nothing changes: each step re-links
    every neighbour of a node to the smallest one it knows, so components shrink to stars
    in a few rounds, however long their chains are. A step's links are written to the
    shared folder before the next one; only a count comes to the driver.
    """
    edges = materialize(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), label)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # `v = m` keeps the node's own link to the smallest; the others hang below it.
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = materialize(small.where("u <> v").distinct(), label)
        changed = not small.exceptAll(edges).isEmpty()
        edges = small
        if not changed:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
