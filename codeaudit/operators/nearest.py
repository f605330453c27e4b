"""Exact nearest vectors by pivots and the triangle inequality.

Some vectors of each repository are pivots; every vector lies in the cell of its nearest one, and a
cell knows its radius. No vector of a cell is nearer to a query than the query's distance to
the pivot less that radius. Each query first searches its nearest cells; the distance of the
k-th vector found there rules most other cells out, and only those that remain are searched.

Queries are dealt out in blocks and cells in tiles, so a task holds at most a block, a tile and the pivots of one
repository; no pair of query and vector, and none of query and cell, becomes a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeaudit import fixed
from codeaudit.operators.ranking import SHARES, first_rows
from codeaudit.storage import materialize

PIVOTS = 256  # of a repository at most; larger cells go in more blocks
CELL = 256  # vectors that a cell should have
ROWS = 4096  # of a block
TILE = 16384  # vectors that a tile of cells, or a block of the queries that ask it, should have
# Distances are rounded to six places before they are compared, so bounds leave room for that.
SLACK = 1e-5
PAIRS = 1 << 18  # of a query and a vector that are looked at in one step
ENTRIES = 1 << 20  # of vectors that are subtracted in one step


def _blocks(df: DataFrame, by: list[str], key: str, rows: int) -> DataFrame:
    """Add the block of each row, of about `rows` rows of its group."""
    sizes = df.groupBy(*by).agg(F.ceil(F.count("*") / rows).cast("int").alias("_blocks"))
    return df.join(sizes, by).withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int")).drop("_blocks")


def _copies(df: DataFrame, of: DataFrame) -> DataFrame:
    """A copy of each row for every block that its repository has in `of`."""
    return _aside(df.join(of.select("repo", "_block").distinct(), "repo"), ["repo", "_block"])


def _aside(df: DataFrame, keys: list[str]) -> DataFrame:
    """New names for the keys keep both sides apart when they come from one table."""
    return df.select(*[F.col(c).alias(f"_of_{c}" if c in keys else c) for c in df.columns])


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype("float64")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each of `a` to each of `b`, by differences."""
    out = np.empty((len(a), len(b)))
    step = max(1, ENTRIES // max(1, b.size))
    for lo in range(0, len(a), step):
        out[lo : lo + step] = np.square(a[lo : lo + step, None] - b[None]).sum(axis=2)
    return out


def _empty(schema: str) -> pd.DataFrame:
    return pd.DataFrame(columns=[f.split()[0] for f in schema.split(", ")])


def pivots(index: DataFrame, most: int = PIVOTS, cell: int = CELL) -> DataFrame:
    """`(repo, cell, pivot)`: some vectors of each repository, by the hash of their number."""
    size = index.groupBy("repo").agg(F.least(F.lit(most), F.ceil(F.count("*") / cell)).cast("int").alias("_pivots"))
    first = first_rows(index.select("repo", "ord", "vector"), ["repo"], [F.xxhash64("ord"), F.col("ord")], most, "_n", SHARES)
    return first.join(size, "repo").filter(F.col("_n") <= F.col("_pivots")).select(
        "repo", F.col("_n").alias("cell"), F.col("vector").alias("pivot"))


def assign(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """`(repo, ord, vector, cell, far)`: the nearest pivot of every vector, and the distance to it."""
    schema = "repo string, ord bigint, vector array<double>, cell int, far double"

    def place(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or centres.empty:
            return _empty(schema)
        centres = centres.sort_values("cell")
        apart = _squares(_matrix(rows["vector"]), _matrix(centres["pivot"]))
        at = apart.argmin(axis=1)
        return pd.DataFrame({
            "repo": rows["repo"], "ord": rows["ord"], "vector": rows["vector"],
            "cell": centres["cell"].to_numpy()[at], "far": np.sqrt(apart[np.arange(len(at)), at])})

    spread = _blocks(index.select("repo", F.col("ord").cast("long"), F.col("vector").cast("array<double>")), ["repo"], "ord", ROWS)
    copies = _copies(chosen, spread)
    return spread.groupBy("repo", "_block").cogroup(copies.groupBy("_of_repo", "_of__block")).applyInPandas(place, schema)


def cells_to_search(queries: DataFrame, cells: DataFrame, k: int, first: bool) -> DataFrame:
    """`(query_id, repo, tile, cells, vector, limit)`: the nearest cells that hold `k` vectors (`first`), or all
    others that can hold one as near as the query's `limit`; a row for each tile that has some of them."""
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, repo string, tile int, cells array<int>, vector array<double>, limit double"

    def choose(asked: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or centres.empty:
            return _empty(schema)
        centres = centres.sort_values("cell")
        apart = np.sqrt(_squares(_matrix(asked["vector"]), _matrix(centres["pivot"])))
        order = np.argsort(apart, axis=1, kind="stable")
        held = np.cumsum(centres["n"].to_numpy()[order], axis=1)
        early = np.zeros(apart.shape, bool)
        np.put_along_axis(early, order, held - centres["n"].to_numpy()[order] < k, axis=1)
        wanted, limit = early, np.full(len(asked), np.inf)
        if not first:
            limit = asked["limit"].to_numpy(float)
            least = np.maximum(apart - centres["radius"].to_numpy(), 0)
            wanted = ~early & (np.square(least) <= limit[:, None] + SLACK)
        numbers, parts = centres["cell"].to_numpy(), [_empty(schema)]
        for tile in sorted({tile for tiles in centres["tiles"] for tile in tiles}):
            here = np.array([tile in tiles for tiles in centres["tiles"]])
            row = np.flatnonzero(wanted[:, here].any(axis=1))
            if len(row):
                parts.append(pd.DataFrame({
                    "query_id": asked["query_id"].to_numpy()[row], "repo": asked["repo"].to_numpy()[row], "tile": tile,
                    "cells": [numbers[here][chosen] for chosen in wanted[np.ix_(row, here)]],
                    "vector": asked["vector"].to_numpy()[row], "limit": limit[row]}))
        return pd.concat(parts[1:] or parts)

    spread = _blocks(queries, ["repo"], "query_id", ROWS)
    copies = _copies(cells, spread)
    return spread.groupBy("repo", "_block").cogroup(copies.groupBy("_of_repo", "_of__block")).applyInPandas(choose, schema)


def _search(asked: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """`(query_id, repo, ord, distance)`: the best `k` of each query in the cells it asks, within its limit.

    Blocks of the queries that ask a tile meet the tile, so a vector moves once for each tile it asks or
    block that asks it, not for each cell.
    """
    kind = asked.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, repo string, ord bigint, distance double"

    def nearest(wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if wanted.empty or held.empty:
            return _empty(schema)
        held = held.sort_values(["cell", "ord"])
        row, distance, number = _best(
            _matrix(wanted["vector"]), wanted["cells"].to_numpy(), wanted["limit"].to_numpy(float),
            _matrix(held["vector"]), held["cell"].to_numpy(), held["ord"].to_numpy(), k)
        return pd.DataFrame({
            "query_id": wanted["query_id"].to_numpy()[row], "repo": wanted["repo"].to_numpy()[row],
            "ord": number, "distance": distance})

    by, group = ["repo", "tile"], ["repo", "tile", "_asked"]
    # Blocks of the queries that ask a tile.
    asks = asked.groupBy(*by).agg(F.ceil(F.count("*") / TILE).cast("int").alias("_asks"))
    left = asked.join(asks, by).withColumn("_asked", F.pmod(F.xxhash64("query_id"), F.col("_asks")).cast("int")).drop("_asks")
    right = placed.join(asks, by).select(
        *by, F.explode(F.sequence(F.lit(0), F.col("_asks") - 1)).alias("_asked"), "cell", "ord", "vector")
    right = _aside(right, group)
    found = left.groupBy(*group).cogroup(right.groupBy(*[f"_of_{c}" for c in group])).applyInPandas(nearest, schema)
    return first_rows(found, ["query_id", "repo"], [F.col("distance"), F.col("ord")], k, "rank").select("query_id", "repo", "ord", "distance")


def _best(
    asked: np.ndarray, cells: np.ndarray, limit: np.ndarray, held: np.ndarray, cell: np.ndarray, number: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of `asked`, distances and numbers of the best `k` of `held` (in the order of `cell`) in each row's cells.

    A matrix product tells which pairs may count; their distances are then taken by differences.
    """
    near = np.full((len(asked), k), np.inf)
    at = np.full((len(asked), k), np.iinfo("int64").max)
    rows = np.repeat(np.arange(len(asked)), [len(c) for c in cells])
    wanted = np.concatenate(cells)
    order = np.argsort(wanted, kind="stable")
    rows, wanted = rows[order], wanted[order]
    own, lengths = np.square(asked).sum(axis=1), np.square(held).sum(axis=1)
    # The product's error is in proportion to the squares, far below this share of them.
    share = 1e-11
    for one in np.unique(cell):
        lo, hi = np.searchsorted(cell, [one, one + 1])
        asking = rows[slice(*np.searchsorted(wanted, [one, one + 1]))]
        step = max(1, PAIRS // (hi - lo))
        for some in (asking[n : n + step] for n in range(0, len(asking), step)):
            about = own[some, None] + lengths[None, lo:hi] - 2 * (asked[some] @ held[lo:hi].T)
            most = np.minimum(near[some, -1], limit[some])
            open_ = np.flatnonzero(np.isinf(most))
            if len(open_) and hi - lo >= k:
                most[open_] = np.partition(about[open_], k - 1, axis=1)[:, k - 1]
            room = SLACK + share * (own[some] + lengths[lo:hi].max())
            # Not `<=`, so that pairs without a number stay.
            left, right = np.nonzero(~(about > (most + 2 * room)[:, None]))
            for n in range(0, len(left), PAIRS):
                _merge(near, at, some[left[n : n + PAIRS]], right[n : n + PAIRS] + lo, asked, held, number)
    row, place = np.nonzero(at < np.iinfo("int64").max)
    return row, near[row, place], at[row, place]


def _merge(near: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, asked: np.ndarray, held: np.ndarray, number: np.ndarray) -> None:
    """Take pairs of rows of `asked` and `held` into the best of `asked`, ties by number."""
    apart = np.empty(len(left))
    step = max(1, ENTRIES // asked.shape[1])
    for lo in range(0, len(left), step):
        apart[lo : lo + step] = np.square(asked[left[lo : lo + step]] - held[right[lo : lo + step]]).sum(axis=1)
    k, some = near.shape[1], np.unique(left)
    row = np.concatenate([np.repeat(some, k), left])
    distance = np.concatenate([near[some].ravel(), apart.round(6)])
    numbers = np.concatenate([at[some].ravel(), number[right]])
    order = np.lexsort((numbers, distance, row))
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < k
    near[row[kept], place[kept]] = distance[order[kept]]
    at[row[kept], place[kept]] = numbers[order[kept]]


def _units(placed: DataFrame) -> DataFrame:
    """`(repo, cell, _block, n, far, tile)`: blocks of cells, dealt to tiles of about `TILE` vectors in the order of cells."""
    sizes = placed.groupBy("repo", "cell", "_block").agg(F.count("*").alias("n"), F.max("far").alias("far"))
    earlier = Window.partitionBy("repo").orderBy("cell", "_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    return sizes.withColumn("tile", F.floor(before / TILE).cast("int"))


def cells(placed: DataFrame, chosen: DataFrame) -> DataFrame:
    """`(repo, cell, pivot, n, radius, tiles)` of the cells that hold vectors."""
    sizes = _units(placed).groupBy("repo", "cell").agg(
        F.sum("n").alias("n"), F.max("far").alias("radius"), F.collect_set("tile").alias("tiles"))
    return sizes.join(chosen, ["repo", "cell"])


def nearest(index: DataFrame, queries: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """Nearest `k` vectors of `index(repo, ord, vector)` for each `(query_id, repo, vector)`:
    `(query_id, repo, rank, ord, distance)` by squared distance, ties by `ord`."""
    chosen = materialize(pivots(index), "pivots")
    placed = materialize(_blocks(assign(index, chosen), ["repo", "cell"], "ord", ROWS), "cells")
    known = materialize(cells(placed, chosen), "cell-sizes")
    tiled = placed.join(_units(placed).drop("n", "far"), ["repo", "cell", "_block"])
    asked = queries.select("query_id", "repo", F.col("vector").cast("array<double>"))

    def found(wanted: DataFrame) -> DataFrame:
        return _search(wanted, tiled, k)

    # A repository of one cell is searched as it is; only others have cells to choose from.
    count = known.groupBy("repo").count()
    lone = known.join(count.filter("count = 1"), "repo", "left_semi").select(
        "repo", F.explode("tiles").alias("tile"), F.array("cell").alias("cells"))
    wanted = asked.join(lone, "repo").select("query_id", "repo", "tile", "cells", "vector", F.lit(float("inf")).alias("limit"))
    several = count.filter("count > 1").select("repo")
    if several.isEmpty():
        return _ranked(found(wanted), k)
    among, centres = (t.join(several, "repo", "left_semi") for t in (asked, known))
    first = materialize(wanted.unionByName(cells_to_search(among, centres, k, True)), "nearest-first")
    early = materialize(found(first), "nearest-early")
    limits = early.groupBy("query_id", "repo").agg(F.max("distance").alias("limit"), F.count("*").alias("_n"))
    # With fewer than k vectors all cells were searched.
    open_ = among.join(limits.filter(F.col("_n") == k).drop("_n"), ["query_id", "repo"])
    late = found(materialize(cells_to_search(open_, centres, k, False), "nearest-more"))
    return _ranked(early.unionByName(late), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = first_rows(found, ["query_id", "repo"], [F.col("distance"), F.col("ord")], k, "rank")
    return best.select("query_id", "repo", "rank", "ord", "distance")
