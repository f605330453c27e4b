"""Row numbers that hold up when one group is most of the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeaudit.storage import materialize, shuffles_dropped

# Shares of groups that may be most of the data, see `first_rows`.
SHARES = 32
# A group up to this size is sorted within one task.
ONE_TASK_ROWS = 4_000_000
# Rows of larger groups that are shuffled at a time, as a multiple of that, and how often all rows are read for it.
ROUND_TASKS, ROUNDS = 32, 8
# Bits of `monotonically_increasing_id` that number the rows of a partition.
PLACE_BITS = 33


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    name: str,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Add the 1-based position of each row within its group as column `name`.

    Groups of up to `one_task_rows` rows go through an ordinary window. Larger ones are
    split by range over the full sort key, so no task ever holds such a group; see
    `_number_by_range`. They are taken in rounds of about `ROUND_TASKS` times as many rows (of
    one group at least, and of more where that would make over `ROUNDS` rounds), whose shuffle files go
    before the next: disk holds all rows as a table, but not all as shuffled rows.
    `order` should be total up to rows that are equal everywhere.

    Deciding this counts rows, and groups only if all rows together are more than a task
    should hold; pass a table, not an expensive derivation.
    """
    plain = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    n_rows = df.count()
    if n_rows <= one_task_rows:
        return df.withColumn(name, plain)
    if not by:
        return _number_by_range(df, by, order, name, 1 + 2 * n_rows // one_task_rows)
    sizes = df.groupBy(*by).agg(F.count("*").alias("_rows"))
    large = sizes.filter(F.col("_rows") > one_task_rows)
    earlier = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    round_rows = max(ROUND_TASKS * one_task_rows, -(-n_rows // ROUNDS))
    # At most one row for each `one_task_rows` rows of `df`.
    marks = materialize(large.withColumn("_round", F.floor(before / round_rows)), "marks")
    rounds = sorted(map(tuple, marks.groupBy("_round").agg(F.sum("_rows")).collect()))
    if not rounds:
        return df.withColumn(name, plain)

    marks = marks.select(*[F.col(c).alias(f"_large_{c}") for c in by], "_round")
    same_group = [F.col(c).eqNullSafe(F.col(f"_large_{c}")) for c in by]
    marked = df.join(F.broadcast(marks), same_group, "left").drop(*[f"_large_{c}" for c in by])
    parts = [
        _number_by_range(marked.filter(F.col("_round") == n).drop("_round"), by, order, name, 1 + 2 * rows // one_task_rows)
        for n, rows in rounds
    ]
    if sum(rows for _, rows in rounds) < n_rows:
        parts.insert(0, marked.filter(F.col("_round").isNull()).drop("_round").withColumn(name, plain))
    return reduce(DataFrame.unionByName, parts)


def _number_by_range(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, pieces: int
) -> DataFrame:
    """Number rows inside range pieces, then add the rows of the same group in earlier pieces.

    The placed rows are written before they are counted, because range bounds are sampled
    and a second evaluation could place rows differently. They move once: a piece is sorted where
    it lands, so a group's rows in it follow each other and their places in the piece need only be
    shifted. `shifts` has a row for each group and piece that meet, at most groups and `pieces` together.
    """
    keys = [F.col(c).asc() for c in by]
    placed = df.repartitionByRange(pieces, *keys, *order).sortWithinPartitions(*keys, *order)
    with shuffles_dropped(df.sparkSession):
        # The number of the piece, and in the lower bits the row's place in it.
        stored = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), "ranked")

    piece, place = F.shiftright("_at", PLACE_BITS), F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    counts = stored.groupBy(piece.alias("_piece"), *by).agg(F.count("*").alias("_rows"), F.min(place).alias("_first"))
    earlier = (
        Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = counts.select(
        F.col("_piece").alias("_shift_piece"),
        *[F.col(c).alias(f"_shift_{c}") for c in by],
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    same = [piece == F.col("_shift_piece")]
    same += [F.col(c).eqNullSafe(F.col(f"_shift_{c}")) for c in by]
    joined = stored.join(F.broadcast(shifts), same, "left")
    return joined.withColumn(name, place + F.col("_shift")).select(*df.columns, name)


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[Column], weight: str, name: str) -> DataFrame:
    """Add the sum of `weight` over the earlier rows of each group as column `name`.

    Two levels: rows are placed by range over group and order, summed within each piece, and the totals of
    a group's earlier pieces are added. No task holds a group, however large; at most one
    group runs on from a piece into the next, so `carried` has at most one row per piece.
    """
    ranges = [*[F.col(c).asc() for c in by], *order]
    placed = df.repartitionByRange(*ranges).withColumn("_piece", F.spark_partition_id())
    stored = materialize(placed, "placed")
    earlier = lambda keys, at: Window.partitionBy(*keys).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("_piece", *by).agg(F.sum(weight).alias("_total"))
    carried = totals.withColumn("_before", F.sum("_total").over(earlier(by, ["_piece"]))).filter("_before IS NOT NULL").select(
        F.col("_piece").alias("_carry_piece"), *[F.col(c).alias(f"_carry_{c}") for c in by], "_before")
    same = [F.col("_piece") == F.col("_carry_piece"), *[F.col(c).eqNullSafe(F.col(f"_carry_{c}")) for c in by]]
    within = F.coalesce(F.sum(weight).over(earlier(["_piece", *by], order)), F.lit(0))
    return stored.withColumn("_within", within).join(F.broadcast(carried), same, "left").withColumn(
        name, F.col("_within") + F.coalesce("_before", F.lit(0))).select(*df.columns, name)


def first_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    n: int,
    name: str,
    shares: int = 1,
) -> DataFrame:
    """The first `n` rows of each group, numbered from 1.

    Spark limits every group on the map side before the shuffle, so a group costs at most
    `n` rows per map task whatever its size. With very many map tasks that is still a lot for one
    task to merge: `shares` above 1 first limits hashed shares of each group on their own, so the last
    step sees `n` rows per share. Worth it where groups are few and large, such as repositories.
    """
    position = F.row_number()
    if shares > 1:
        share = F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(shares))
        within = Window.partitionBy(*by, "_share").orderBy(*order)
        df = (
            df.withColumn("_share", share).withColumn(name, position.over(within))
            .filter(F.col(name) <= n).drop("_share", name)
        )
    ranked = df.withColumn(name, position.over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)
