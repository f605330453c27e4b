"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection, components.

Texts become sets of 64-bit hashes of five-word shingles. Two sets that reach the similarity
share a shingle among the first quarter (plus one) of both, in any order that all sets agree
on; here shingles in few documents come first. Sets that share such a shingle meet
(of shingles that stand in the very same sets, under one of them):

1. `STARS` times, each set with one leader of another component: one pair per set, so groups of
   copies fall together at a cost that is linear in their number;
2. what still is in different components meets in tiles: at most `TILE` sets of one shingle,
   ordered by size, against a tile whose sizes are within the ratio. A set's parity bitmap
   bounds every overlap from above;
3. sets that open pairs join meet once more, now with their hashes, in tiles of their group: pairs are
   intersected exactly until one component holds them.

Rows go into tiles and links come out, at most one for a set in a batch: no pair ever becomes a row.

The result is exact up to hash equality: no bucket is cut and no pair that can reach the
similarity is left out unless a chain of links joins its sets already.

Defined cases: null and wordless texts have the empty set and link with nothing; under five
words the whole sequence is the one shingle; equal sets are one class, compared once; rows
without a doc_id have no component; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from codeaudit.llm.tables import components, forest, record
from codeaudit.llm.words import BASE, LOWER, Hasher, mix, texts, windows
from codeaudit.storage import materialize, shuffles_dropped

WORDS = 5
NUM, DEN = 3, 4  # similarity of 3/4
BYTES = 5  # of each hash that are stored; two sets of 1,000 have one false match in a million such pairs
TILE = 512
TILE_BYTES = 8 << 20  # of hashes on one side of a tile; longer sets make tiles of fewer
HOT_SETS = 100  # a shingle of so many sets is looked at last; this orders shingles and decides nothing
HOT_LIST = 65_536  # the most frequent of these that are sent to the tasks (8 bytes each)
STARS = 3
PAIR_BYTES = 8 << 20  # of bitmaps that are compared in one step
MAX_BITS = 1 << 17
SENT_IDS = 2_000_000  # ids of sets that are broadcast at most, so that only these sets are shuffled
SMALL = 512  # elements up to which bitmaps have four bits or more for each, as chance weighs more there

_U = np.uint64
SETS = StructType().add("doc_id", "long").add("copy", "long").add("n", "integer").add("set_id", "long").add("bits", "binary").add("hashes", "binary")


def pack(h: np.ndarray) -> bytes:
    """The high `BYTES` bytes of each hash."""
    return h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // BYTES, 8), np.uint8)
    wide[:, 8 - BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, BYTES)
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def bitmap(h: np.ndarray) -> bytes:
    """Parities of the elements that fall on each of a power of two of bits."""
    wanted = (4 if len(h) <= SMALL else 2) * len(h)
    size = min(max(64, 1 << int(wanted - 1).bit_length()), MAX_BITS)
    return np.packbits(np.bincount((h & _U(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """`SETS` of every document; bitmap and hashes stand once per batch and set, on rows that `copy` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = set()
            for chunk in texts(batch):
                n_out, ids, copies, bits, hashes = [], [], [], [], []
                starts, ends = chunk.spans()
                h = Hasher(LOWER[chunk.buf])(starts, ends)
                bounds, grams = chunk.per_row(starts), windows(h, WORDS)
                for number, a, z in zip(batch.column("copy").slice(chunk.lo).to_pylist(), bounds[:-1], bounds[1:]):
                    if z == a:
                        found = h[:0]
                    elif z - a < WORDS:
                        found = windows(h[a:z], int(z - a)) ^ _U(z - a)
                    else:
                        found = np.unique(grams[a : z - WORDS + 1])
                    n_out.append(len(found))
                    if not len(found):
                        ids.append(None)
                    else:
                        ids.append(int(mix(mix(found ^ _U(BASE)).sum(keepdims=True) + _U(len(found))).view(np.int64)[0]))
                    if ids[-1] is None or ids[-1] in known:
                        copies.append(None)
                        bits.append(None)
                        hashes.append(None)
                    else:
                        known.add(ids[-1])
                        copies.append(number)
                        bits.append(bitmap(found))
                        hashes.append(pack(found))
                rows = batch.column("doc_id").slice(chunk.lo, chunk.hi - chunk.lo)
                yield record({"doc_id": rows, "copy": copies, "n": n_out, "set_id": ids, "bits": bits, "hashes": hashes}, SETS)

    return docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("copy"), "text").mapInArrow(run, SETS)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces that are small when unpacked."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _frequent(sets: DataFrame) -> np.ndarray:
    """Shingles that stand in many sets, at most `HOT_LIST`, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            parts = [unpack(x) for x in part.column("hashes").to_pylist() if x]
            if parts:
                values, counts = np.unique(np.concatenate(parts), return_counts=True)
                often = counts >= 2
                yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["h", "k"])

    counts = sets.select("hashes").mapInArrow(run, "h long, k long").groupBy("h").agg(F.sum("k").alias("k"))
    rows = counts.where(F.col("k") >= HOT_SETS).orderBy(F.desc("k"), "h").limit(HOT_LIST).select("h").collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


def _first_shingles(sets: DataFrame, hot: np.ndarray) -> DataFrame:
    """`(h, set_id, n)`: the shingles by which a set can meet another."""
    screen = np.zeros(1 << 20, bool)
    screen[(hot & _U((1 << 20) - 1)).astype(np.int64)] = True

    def is_hot(h: np.ndarray) -> np.ndarray:
        out = screen[(h & _U((1 << 20) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        near = hot[np.minimum(np.searchsorted(hot, h[at]), len(hot) - 1)] if len(hot) else h[at]
        out[at] = near == h[at]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            ids, sizes, lists = (part.column(c).to_pylist() for c in ("set_id", "n", "hashes"))
            out, counts, kept = [], [], []
            for k, data in enumerate(lists):
                if data:
                    h, n = unpack(data), sizes[k]
                    flags = is_hot(h)
                    first = n - (NUM * n + DEN - 1) // DEN + 1
                    out.append(np.concatenate([h[~flags][:first], h[flags]])[:first] if flags.any() else h[:first])
                    counts.append(len(out[-1]))
                    kept.append(k)
            if out:
                kept = np.array(kept)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(np.array([ids[k] for k in kept], np.int64), counts)),
                    pa.array(np.repeat(np.array(sizes, np.int32)[kept], counts))], ["h", "set_id", "n"])

    return sets.select("set_id", "n", "hashes").mapInArrow(run, "h long, set_id long, n int")


def _meetings(first: DataFrame) -> DataFrame:
    """`(h, set_id, n)` of shingles that two different sets have, each set once."""
    group = Window.partitionBy("h")
    return (
        first.withColumns({
            "lo": F.min("set_id").over(group), "hi": F.max("set_id").over(group),
            "prev": F.lag("set_id").over(group.orderBy("set_id"))})
        .where((F.col("lo") != F.col("hi")) & (F.col("prev").isNull() | (F.col("prev") != F.col("set_id"))))
        .select("h", "set_id", "n"))


def _distinct_groups(met: DataFrame) -> DataFrame:
    """`(h, set_id, n, w)`: of the shingles that stand in the same sets one, with their number `w`.

    Sets that share a passage meet under each of its shingles; one such meeting is enough.
    """
    sums = [F.bit_xor(F.xxhash64("set_id", F.lit(seed))).alias(f"x{seed}") for seed in (0, 1)]
    groups = met.groupBy("h").agg(F.count("*").alias("k"), *sums)
    one = groups.groupBy("k", "x0", "x1").agg(F.min("h").alias("h"), F.count("*").alias("w")).select("h", "w")
    return met.join(one, "h")


def _stars(met: DataFrame, turn: int) -> DataFrame:
    """One pair `(a, b)` for each set: with the leader of another component that it meets most often.

    A shingle's leader is the set that comes first in a random order, the same for all
    shingles, so that a group of copies has few leaders.
    """
    order = F.struct(F.xxhash64("rep", F.lit(turn)).alias("place"), "rep", "component")
    leader = met.groupBy("h").agg(F.min(order).alias("l"))
    pairs = met.join(leader, "h").where("component <> l.component").groupBy("rep", F.col("l.rep").alias("leader")).agg(F.sum("w").alias("k"))
    best = pairs.groupBy("rep").agg(F.max_by("leader", F.struct("k", "leader")).alias("leader"))
    return best.select(F.greatest("rep", "leader").alias("a"), F.least("rep", "leader").alias("b")).distinct()


def _unsettled(met: DataFrame, links: DataFrame) -> DataFrame:
    """`(h, rep, n, component)` of the shingles under which different components meet."""
    joined = components(links).select(F.col("id").alias("rep"), "component")
    known = met.select("h", "rep", "n", "w").join(joined, "rep", "left").select("h", "rep", "n", "w", F.coalesce("component", "rep").alias("component"))
    group = Window.partitionBy("h")
    rest = known.withColumns({"least": F.min("component").over(group), "most": F.max("component").over(group)})
    return materialize(rest.where("least <> most").drop("least", "most"), "jaccard-unsettled")


def possible(na: np.ndarray, nb: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets whose bitmaps differ in so many bits can reach the similarity."""
    return (NUM + DEN) * ((na + nb - differ) // 2) >= NUM * (na + nb)


def _fold(bits: bytes, size: int) -> np.ndarray:
    b = np.frombuffer(bits, np.uint8)
    return np.bitwise_xor.reduce(b.reshape(-1, size), axis=0)


def linked(a: bytes, b: bytes, na: int, nb: int) -> bool:
    """Exact test of two packed sets."""
    shared = len(np.intersect1d(unpack(a), unpack(b), assume_unique=True))
    return (NUM + DEN) * shared >= NUM * (na + nb)


def open_pair(a: bytes, b: bytes, na: int, nb: int) -> bool:
    """Whether the bitmaps leave it open that two sets reach the similarity."""
    size = min(len(a), len(b))
    return bool(possible(na, nb, int(np.bitwise_count(_fold(a, size) ^ _fold(b, size)).sum())))


def _only(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets whose `doc_id` is in `ids(doc_id)`, before any shuffle; all of them if these are too many to send."""
    ids = ids.distinct()
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    return sets.join(F.broadcast(ids), "doc_id", "left_semi") if few else sets


def _tested(pairs: DataFrame, sets: DataFrame, column: str, test: Callable[[bytes, bytes, int, int], bool]) -> DataFrame:
    """The pairs whose `column` values and sizes pass `test`."""
    side = lambda x: sets.select(*[F.col(c).alias(x if c == "doc_id" else f"{c}_{x}") for c in ("doc_id", "n", column)])
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            values = zip(*(part.column(f"{c}_{x}").to_pylist() for c in (column, "n") for x in "ab"))
            good = pa.array([test(*v) for v in values], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(good)

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs `(a, b)` whose sets reach the similarity: bitmaps first, then only the sets that these leave."""
    pairs = materialize(_tested(pairs, sets, "bits", open_pair), "jaccard-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    return _tested(pairs, _only(sets, ids), "hashes", linked)


def _whole_tiles(batches: Iterator[pa.RecordBatch], compare: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`compare` of whole tiles `(h, c, d)`, which come sorted; an unfinished one waits for the next batch."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        key = [t.column(x).to_numpy() for x in ("h", "c", "d")]
        last = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield compare(t.slice(0, cut))
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield compare(rest)


def _open_pairs(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of different components that no bitmap rules out.

    `t(h, c, d, side, n, component, bits)` is sorted by tile and size.
    """
    h, c, d, side, n, comp = (t.column(x).to_numpy() for x in ("h", "c", "d", "side", "n", "component"))
    bits = t.column("bits").to_pylist()
    new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])]
    tile = np.cumsum(new)
    place = tile * (1 << 32) + n
    upto = np.searchsorted(place, tile * (1 << 32) + n * DEN // NUM, "right")
    width = np.array([len(b) for b in bits])
    matrix = {w: np.stack([np.frombuffer(bits[k], np.uint8) for k in at]) for w in np.unique(width) for at in [np.flatnonzero(width == w)]}
    row = np.zeros(len(n), np.int64)
    for w in matrix:
        row[width == w] = np.arange((width == w).sum())
    counts = upto - np.arange(len(n)) - 1
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(counts[lo:]), 200_000, "right")) + lo)
        i = np.repeat(np.arange(lo, hi), counts[lo:hi])
        j = np.arange(len(i)) - np.repeat(np.cumsum(counts[lo:hi]) - counts[lo:hi], counts[lo:hi]) + i + 1
        use = (comp[i] != comp[j]) & ((side[i] != side[j]) | (c[i] == d[i]))
        i, j = i[use], j[use]
        for wi, wj in set(zip(width[i].tolist(), width[j].tolist())):
            at = np.flatnonzero((width[i] == wi) & (width[j] == wj))
            x, y, size = i[at], j[at], min(wi, wj)
            step = max(1, PAIR_BYTES // (wi + wj))
            for k in range(0, len(at), step):
                p, q = x[k : k + step], y[k : k + step]
                left = np.bitwise_xor.reduce(matrix[wi][row[p]].reshape(len(p), -1, size), axis=1)
                right = np.bitwise_xor.reduce(matrix[wj][row[q]].reshape(len(p), -1, size), axis=1)
                differ = np.bitwise_count((left ^ right).view(np.uint64)).sum(axis=1, dtype=np.int64)
                can = possible(n[p].astype(np.int64), n[q].astype(np.int64), differ)
                yield p[can], q[can]
        lo = hi


def _open_links(rows: DataFrame) -> DataFrame:
    """`(a, b)` of sets that an open pair joins, or a chain of them: for a batch at most one for each set."""

    def compare(t: pa.Table) -> pa.RecordBatch:
        rep = t.column("rep").to_numpy()
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for p, q in _open_pairs(t):
            a, b = forest(np.concatenate([a, rep[p]]), np.concatenate([b, rep[q]]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.mapInArrow(lambda batches: _whole_tiles(batches, compare), "a long, b long")


def _tile_links(rows: DataFrame) -> DataFrame:
    """Links `(a, b)` of sets that reach the similarity, enough to join all that do in a tile.

    `rows` also have `hashes`. Pairs that one component already holds are not looked at, so a
    tile gives fewer links than it has rows.
    """

    def compare(t: pa.Table) -> pa.RecordBatch:
        rep, comp, n = (t.column(x).to_numpy() for x in ("rep", "component", "n"))
        sets, group, found = t.column("hashes"), {}, []

        def root(x: int) -> int:
            while (up := group.get(x, x)) != x:
                group[x] = x = group.get(up, up)
            return x

        for p, q in _open_pairs(t):
            for x, y in zip(p.tolist(), q.tolist()):
                a, b = root(int(comp[x])), root(int(comp[y]))
                if a != b and linked(sets[x].as_py(), sets[y].as_py(), int(n[x]), int(n[y])):
                    group[max(a, b)] = min(a, b)
                    found.append((max(rep[x], rep[y]), min(rep[x], rep[y])))
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(lambda batches: _whole_tiles(batches, compare), "a long, b long")


def _tiles(rest: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Rows of every tile, with columns of their sets: `rest(h, rep, n, component)` cut by size, with the
    tiles within the ratio, in the order of tiles and sizes."""
    order = Window.partitionBy("h").orderBy("n", "rep").rowsBetween(Window.unboundedPreceding, -1)
    # A tile is full at `TILE` sets or at `TILE_BYTES` of hashes.
    share = F.greatest(F.lit(TILE_BYTES // TILE), F.col("n") * BYTES)
    place = F.floor(F.coalesce(F.sum(share).over(order), F.lit(0)) / TILE_BYTES)
    cut = materialize(rest.withColumn("chunk", place.cast("int")), "jaccard-cut")
    span = cut.groupBy("h", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = span.alias("x"), span.alias("y")
    pairs = x.join(y, F.expr(f"x.h = y.h AND x.chunk <= y.chunk AND {DEN} * x.hi >= {NUM} * y.lo")).select(
        F.col("x.h").alias("h"), F.col("x.chunk").alias("c"), F.col("y.chunk").alias("d"))
    pairs = materialize(pairs, "jaccard-tiles")
    placed = pairs.withColumns({"chunk": F.col("c"), "side": F.lit(0)}).unionAll(
        pairs.where("c < d").withColumns({"chunk": F.col("d"), "side": F.lit(1)}))
    tile = ["h", "c", "d"]
    sets = _only(sets, cut.select(F.col("rep").alias("doc_id")))
    rows = cut.join(placed, ["h", "chunk"]).join(sets.select(F.col("doc_id").alias("rep"), *columns), "rep")
    return (
        rows.select(*tile, "side", "n", "rep", "component", *columns)
        .repartition(*tile).sortWithinPartitions(*tile, "n", "rep"))


def near_components(docs: DataFrame) -> DataFrame:
    """`(doc_id, n_shingles, component_id)` of every row of `docs`."""
    with shuffles_dropped(docs.sparkSession):
        sets = materialize(shingle_sets(docs), "jaccard-sets")
        # A set goes by one of its stored copies; its smallest doc_id may stand on a row without one.
        classes = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.min("copy").alias("rep"))
        classes = materialize(classes.where("least IS NOT NULL"), "jaccard-classes")
        one = sets.where("copy IS NOT NULL").withColumn("doc_id", F.col("copy"))
        first = _first_shingles(one, _frequent(one))
        met = _distinct_groups(materialize(_meetings(first), "jaccard-meetings")).join(classes, "set_id")
        met = met.select("h", "n", "w", "rep", F.col("rep").alias("component"))
        rest = materialize(met, "jaccard-met")
        # Sets with the same smallest doc_id are of one document and belong together.
        same = classes.groupBy("least").agg(F.min("rep").alias("b"), F.count("*").alias("k")).where("k > 1")
        links = materialize(classes.join(same, "least").where("rep <> b").select(F.col("rep").alias("a"), "b"), "jaccard-links")
        for turn in range(STARS):
            links = materialize(links.unionAll(_verified(_stars(rest, turn), one)), "jaccard-links")
            rest = _unsettled(rest, links)
        rest = rest.select("h", "rep", "n", "component")
        groups = components(_open_links(_tiles(rest, one, "bits"))).select(F.col("id").alias("rep"), F.col("component").alias("h"))
        again = rest.select("rep", "n", "component").distinct().join(groups, "rep").select("h", "rep", "n", "component")
        more = materialize(_tile_links(_tiles(again, one, "bits", "hashes")), "jaccard-links")
        final = components(links.unionAll(more))
        placed = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left")
        placed = materialize(placed.select("set_id", "least", F.coalesce("component", "rep").alias("component")), "jaccard-placed")
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = placed.join(smallest, "component").select("set_id", "component_id")
    members = sets.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "set_id")
    out = members.join(by_set, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its component; the rest go."""
    gone = near_components(docs).where("doc_id <> component_id").select(F.col("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
