"""Line dedup: segment-partition edit join over the words of lines.

A line is its sequence of words; lines without a word are left alone. Two lines link when their
edit distance in words is at most the tolerance of the longer one: 0 below 10 words, then one more
from each bound of `TIERS` on. Every line that links to an earlier line, in the order of doc_id and
line number, is dropped, as is every later copy of a line.

A line of the tolerance t is split into t + 1 even segments; with at most t edits one of them
stands unchanged in the other line, at a place that the edits left and right of it allow. So
each line indexes its segments under its length, and probes, for every length within t, the few
substrings that can be such a segment. Lines that meet are compared exactly by a banded
bit-parallel automaton, for all pairs of a batch at once: first each line with the earliest line
that it meets under a key, one pair a key, then those still undecided in tiles of bounded size.

Defined cases: a null text has no lines; rows equal in all columns are one document and lose
the same lines; a null doc_id comes before all others; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codeaudit.llm.tables import fresh, row_key
from codeaudit.llm.words import Chunk, Hasher, list_array, mix, span_hashes, texts
from codeaudit.storage import materialize

TIERS = (10, 20, 40)  # words from which one, two and three edits are allowed
assert len(TIERS) <= 3, "with more edits, lines of the same length need shifts down as well, see `_keys`"
TILE = 256
BROADCAST_LINES = 2_000_000

_U = np.uint64


def tolerance(words: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(TIERS), words, "right")


def _lines(chunk: Chunk) -> tuple[np.ndarray, ...]:
    """Word hashes, and of every line with a word: row, number, first and last word, hash; also lines per row."""
    buf, offsets = chunk.buf, chunk.offsets
    starts, ends = chunk.spans()
    h = span_hashes(buf, starts, ends)
    breaks = np.flatnonzero(buf == 10)
    before = np.searchsorted(breaks, offsets)  # line breaks before each text
    # The first word of a line is the first one after a break or the start of a text.
    first = np.unique(np.searchsorted(starts, np.concatenate([breaks, offsets])))
    first = first[first < len(starts)]
    last = np.append(first[1:], len(starts))
    row = np.searchsorted(offsets, starts[first], "right") - 1
    return h, row, np.searchsorted(breaks, starts[first]) - before[row], first, last, Hasher(h)(first, last), np.diff(before) + 1


def line_table(docs: DataFrame) -> DataFrame:
    """`(row_key, doc_id, n_lines, numbers, hashes)`, one row per document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            empty = np.array(batch.column("text").is_null())
            for chunk in texts(batch):
                _, row, number, _, _, lh, n = _lines(chunk)
                k = chunk.hi - chunk.lo
                counts = np.bincount(row, minlength=k)
                n[empty[chunk.lo : chunk.hi]] = 0
                yield pa.RecordBatch.from_arrays([
                    batch.column("row_key").slice(chunk.lo, k), batch.column("doc_id").slice(chunk.lo, k), pa.array(n),
                    list_array(number.astype(np.int32), counts, pa.int32()), list_array(lh.view(np.int64), counts, pa.int64())],
                    ["row_key", "doc_id", "n_lines", "numbers", "hashes"])

    rows = docs.select(row_key(docs).alias("row_key"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "row_key long, doc_id long, n_lines long, numbers array<int>, hashes array<long>")


def _keys(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | int]]:
    """(lines, keys, side): side 0 indexes a line's segments, side 1 probes other lines' segments, side 2 does both.

    A segment of a line of some length can be shifted by the edits before it, and by those that make the
    difference in length; within these bounds it never leaves the probing line. The segments where they stand
    probe for lines of the same length. Up to three edits of such a line hold at most one word added and one
    left out, so seen from one of the two lines nothing between them is shifted down: shifts up are enough.
    """
    span = Hasher(h)
    size = last - first
    lengths = np.arange(int(size.max(initial=0)) + 1, dtype=np.uint64) << _U(8)

    def segments(length: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Start, words and salt of each of the t + 1 segments."""
        base, extra = np.divmod(length, t + 1)
        for i in range(t + 1):
            longer = i - (t + 1 - extra)  # the last `extra` segments have one word more
            yield i * base + np.maximum(longer, 0), base + (longer >= 0), mix(_U(t * 8 + i) + lengths)[length]

    for t in range(1, len(TIERS) + 1):
        index = np.flatnonzero(np.any([tolerance(size + d) == t for d in range(t + 1)], axis=0))
        for start, long, salt in segments(size[index], t):
            begin = first[index] + start
            yield index, mix(span(begin, begin + long) + salt), np.where(tolerance(size[index]) == t, 2, 0)
        probe = np.flatnonzero(tolerance(size) == t)
        for d in range(t + 1):
            for i, (start, long, salt) in enumerate(segments(size[probe] - d, t)):
                for shift in range(max(-i, d - (t - i)) if d else 1, min(i, d + (t - i)) + 1):
                    begin = first[probe] + (start + shift)
                    yield probe, mix(span(begin, begin + long) + salt), 1


def _key_table(docs: DataFrame) -> DataFrame:
    """`(key, line, side)` of every line, once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.zeros(0, np.uint64)
            for chunk in texts(batch):
                h, _, _, first, last, lh, _ = _lines(chunk)
                lh, at = np.unique(lh, return_index=True)
                new = ~np.isin(lh, known)
                known = np.concatenate([known, lh[new]])
                lh, at = lh[new], at[new]
                rows = [(keys, lh[lines], np.broadcast_to(np.asarray(side, np.int8), len(lines))) for lines, keys, side in _keys(h, first[at], last[at])]
                keys, lines, sides = (np.concatenate(x) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(lines.view(np.int64)), pa.array(sides)], ["key", "line", "side"])

    return docs.select("text").mapInArrow(run, "key long, line long, side byte")


def _shared(keys: DataFrame) -> DataFrame:
    """`keys` without most of those that one line has, or that no line probes or none indexes.

    Rows come sorted by key. A batch's first and last key can go on in another batch, so they stay:
    what is left still has to be tested, but no group is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, line, side = (np.asarray(batch.column(c)) for c in ("key", "line", "side"))
            keep = (key == key[:1]) | (key == key[-1:])
            new = np.r_[True, key[1:] != key[:-1]][: len(key)]
            rows = np.flatnonzero(~(new & np.append(new[1:], True)))  # of keys with several rows
            if len(rows):
                key, line, side = key[rows], line[rows], side[rows]
                start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                lo, hi = np.minimum.reduceat(side, start), np.maximum.reduceat(side, start)
                good = (np.minimum.reduceat(line, start) != np.maximum.reduceat(line, start)) & ((lo != hi) | (hi == 2))
                keep[rows] |= np.repeat(good, np.diff(np.append(start, len(rows))))
            yield batch.filter(pa.array(keep))

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, keys.schema)


def _words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`(line, words)`: word hashes of the wanted lines."""
    few = wanted.count() <= BROADCAST_LINES
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow().column("line").to_numpy().view(np.uint64))) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = sent.value if few else None
        for batch in batches:
            for chunk in texts(batch):
                h, _, _, first, last, lh, _ = _lines(chunk)
                lh, at = np.unique(lh, return_index=True)
                if few:
                    use = ids[np.searchsorted(ids[:-1], lh)] == lh if len(ids) else np.zeros(len(lh), bool)
                    lh, at = lh[use], at[use]
                words = [h[a:z].tobytes() for a, z in zip(first[at], last[at])]
                yield pa.RecordBatch.from_arrays([pa.array(lh.view(np.int64)), pa.array(words, pa.binary())], ["line", "words"])

    found = docs.select("text").mapInArrow(run, "line long, words binary")
    if not few:
        found = found.join(wanted, "line", "left_semi")
    # One copy of each: copies of a line in other batches have the same words.
    return materialize(found.groupBy("line").agg(F.first("words").alias("words")), "lines-words")


def within(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """For each pair (the second not shorter): whether it keeps the tolerance of the second.

    Bit b of state d after j words of y: the first j + b - t words of x are within d edits.
    """
    nx, ny = np.array([len(v) for v in x]), np.array([len(v) for v in y])
    t = len(TIERS)
    wide = (1 << (2 * t + 1)) - 1
    out = np.zeros(len(x), bool)
    order = np.argsort(ny, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * ny[order[hi]] <= 1_000_000:
            hi += 1
        part = order[lo:hi]
        lo, most, m = hi, int(ny[part[-1]]), len(part)
        mx = np.zeros((most + 2 * t, m), np.uint64)  # x, `t` places down; one column a pair
        my = np.zeros((most, m), np.uint64)
        for k, p in enumerate(part):
            mx[t : t + nx[p], k] = x[p]
            my[: ny[p], k] = y[p]
        lx, ly = nx[part], ny[part]
        states = [np.full(m, sum(1 << (t + i) for i in range(d + 1)), np.int64) for d in range(t + 1)]
        final = np.zeros((t + 1, m), np.int64)
        for j in range(most):
            equal, valid = np.zeros(m, np.int64), np.zeros(m, np.int64)
            for b in range(2 * t + 1):
                i = j + b - t
                if i >= 0:
                    equal |= ((mx[i + t] == my[j]) & (i < lx)).astype(np.int64) << b
                if i + 1 >= 0:
                    valid |= (i + 1 <= lx).astype(np.int64) << b
            after = [states[0] & equal & valid]
            for d in range(1, t + 1):
                s = (states[d] & equal) | states[d - 1] | (states[d - 1] >> 1) | (after[d - 1] << 1)
                after.append(s & valid & wide)
            states = after
            done = ly == j + 1
            if done.any():
                for d in range(t + 1):
                    final[d, done] = states[d][done]
        place = lx - ly + t
        reached = np.stack([(final[d] >> np.maximum(place, 0)) & 1 for d in range(t + 1)]).astype(bool) & (place >= 0)
        out[part] = reached[tolerance(ly), np.arange(m)]
    return out


def _linked(a: list[bytes], b: list[bytes]) -> np.ndarray:
    x, y = ([np.frombuffer(v, np.uint64) for v in side] for side in (a, b))
    swap = [len(p) > len(q) for p, q in zip(x, y)]
    return within([q if s else p for p, q, s in zip(x, y, swap)], [p if s else q for p, q, s in zip(x, y, swap)])


def _pair_test(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Of `(earlier, line)`: the lines that link to the earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = _linked(batch.column("w_earlier").to_pylist(), batch.column("w_line").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("line")], ["line"]).filter(pa.array(good))

    both = pairs.join(words.select(F.col("line").alias("earlier"), F.col("words").alias("w_earlier")), "earlier").join(
        words.withColumnRenamed("words", "w_line"), "line").select("line", "w_earlier", "w_line")
    return both.mapInArrow(run, "line long")


def _tile_test(rows: DataFrame) -> DataFrame:
    """Undecided lines that link to an earlier line of their tile.

    `rows(key, c, d, side, line, rank, decided, words)` come sorted by tile; a tile holds at
    most `TILE` lines of either side, and its pairs are compared without leaving the task.
    """

    def compare(t: pa.Table) -> pa.RecordBatch:
        key, c, d, side, line, rank = (t.column(x).to_numpy() for x in ("key", "c", "d", "side", "line", "rank"))
        decided = t.column("decided").to_numpy(zero_copy_only=False)
        words = [np.frombuffer(w, np.uint64) for w in t.column("words").to_pylist()]
        n = np.array([len(w) for w in words])
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
        found, pairs, held = [], [], 0

        def test() -> None:
            if pairs:
                x, y = np.concatenate(pairs, axis=1)
                short, long = np.where(n[x] <= n[y], x, y), np.where(n[x] <= n[y], y, x)
                near = n[long] - n[short] <= tolerance(n[long])
                x, y, short, long = x[near], y[near], short[near], long[near]
                good = within([words[k] for k in short], [words[k] for k in long])
                found.append(line[np.where(rank[x] < rank[y], y, x)[good]])

        for a, z in zip(new, np.append(new[1:], len(key))):
            split = a + int(np.searchsorted(side[a:z], 1))
            x, y = np.repeat(np.arange(a, split), z - split), np.tile(np.arange(split, z), split - a)
            use = (line[x] != line[y]) & ~decided[np.where(rank[x] < rank[y], y, x)]
            pairs.append(np.stack([x[use], y[use]]))
            held += pairs[-1].shape[1]
            if held > 50_000:
                test()
                pairs, held = [], 0
        test()
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64))], ["line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            key = [t.column(x).to_numpy() for x in ("key", "c", "d")]
            last = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield compare(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield compare(rest)

    return rows.mapInArrow(run, "line long")


def near_lines(docs: DataFrame, first: DataFrame) -> DataFrame:
    """`line` hashes that link to an earlier line; `first(line, place)` has each line's first place."""
    group = Window.partitionBy("key")
    met = _shared(_key_table(docs)).withColumns({
        "lo": F.min("line").over(group), "hi": F.max("line").over(group), "from": F.min("side").over(group), "to": F.max("side").over(group)})
    both = F.when(F.col("side") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array("side")).cast("array<tinyint>")
    met = met.where("lo <> hi AND (`from` <> `to` OR `to` = 2)").select("key", "line", F.explode(both).alias("side")).distinct()
    met = materialize(materialize(met, "lines-met").join(first, "line"), "lines-placed")
    words = _words_of(docs, materialize(met.select("line").distinct(), "lines-wanted"))

    leader = met.groupBy("key").agg(F.min(F.struct("place", "line")).alias("leader"))
    pairs = met.join(leader, "key").where("line <> leader.line").select(F.col("leader.line").alias("earlier"), "line").distinct()
    near = materialize(_pair_test(pairs, words).distinct(), "lines-near")

    # What is left: groups with an undecided line that has other earlier lines than the leader.
    state = met.join(near.withColumn("decided", F.lit(True)), "line", "left").fillna(False, ["decided"])
    undecided = state.join(leader, "key").where("NOT decided AND line <> leader.line").select("key").distinct()
    rest = state.join(undecided, "key", "left_semi")
    order = Window.partitionBy("key", "side").orderBy("place", "line")
    rest = materialize(rest.select(
        "key", "line", "side", "decided", F.rank().over(Window.partitionBy("key").orderBy("place")).alias("rank"),
        F.floor((F.row_number().over(order) - 1) / TILE).cast("int").alias("chunk")), "lines-rest")
    chunks = rest.groupBy("key", "side").agg(F.max("chunk").alias("chunks"))
    grid = chunks.groupBy("key").agg(
        F.max(F.when(F.col("side") == 0, F.col("chunks"))).alias("cs"), F.max(F.when(F.col("side") == 1, F.col("chunks"))).alias("ds"))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("ds")).otherwise(F.col("cs"))))
    tiles = rest.join(grid.where("cs IS NOT NULL AND ds IS NOT NULL"), "key").withColumn("other", other).select(
        "key", F.when(F.col("side") == 0, F.col("chunk")).otherwise(F.col("other")).alias("c"),
        F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("chunk")).alias("d"), "side", "line", "rank", "decided")
    sorted_tiles = tiles.join(words, "line").repartition("key", "c", "d").sortWithinPartitions("key", "c", "d", "side", "line")
    return near.union(_tile_test(sorted_tiles)).distinct()


def drops(docs: DataFrame) -> DataFrame:
    """`(row_key, doc_id, n_lines, n_repeated, n_near, dropped)` per document row; dropped are line numbers from 0."""
    lines = materialize(line_table(docs), "lines")
    each = lines.select("row_key", "doc_id", F.explode(F.arrays_zip("numbers", "hashes")).alias("x")).select(
        "row_key", F.struct("doc_id", "row_key", F.col("x.numbers").alias("number")).alias("at"), F.col("x.hashes").alias("line"))
    known = each.groupBy("line").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    known = materialize(known, "lines-known")
    near = near_lines(docs, known.select("line", F.col("at").alias("place")))
    bad = known.join(near.withColumn("near", F.lit(True)), "line", "left").where("near OR n > 1").select(
        "line", F.col("at").alias("first_at"), F.coalesce("near", F.lit(False)).alias("near"))
    hits = each.join(bad, "line").withColumn("repeated", F.col("at") != F.col("first_at")).where("near OR repeated")
    per_row = hits.groupBy("row_key").agg(
        F.sort_array(F.collect_set("at.number")).alias("dropped"),
        F.countDistinct(F.when(F.col("repeated"), F.col("at.number"))).alias("n_repeated"),
        F.countDistinct(F.when(~F.col("repeated"), F.col("at.number"))).alias("n_near"))
    return lines.select("row_key", "doc_id", "n_lines").join(per_row, "row_key", "left").select(
        "row_key", "doc_id", "n_lines", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_repeated", "n_near")],
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """`docs` without dropped lines; a document that loses all its lines goes, others keep their columns."""
    key, gone = fresh("row_key", docs.columns), fresh("dropped", docs.columns)
    found = drops(docs).where(F.size("dropped") > 0).groupBy("row_key").agg(F.first("dropped").alias("dropped"))
    found = found.select(F.col("row_key").alias(key), F.col("dropped").alias(gone))
    joined = docs.withColumn(key, row_key(docs)).join(found, key, "left")
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(F.col(gone), i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    joined = joined.withColumn("text", text).where(F.col(gone).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return joined.select(*docs.columns)
