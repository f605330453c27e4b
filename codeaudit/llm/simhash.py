"""SimHash near duplicates by multi-index hashing.

A text's fingerprint has a bit where over half of the XXH64 values of its four-word shingles
have it. Two fingerprints link at `DISTANCE` or fewer differing bits. The 64 bits are cut into
segments; if two fingerprints are that close, then one of the first segments differs in at most
one bit or a later one in none (`radii`). So a table holds each fingerprint under the value of
each segment, and each fingerprint fetches the entries within its small Hamming balls. Of two
values that differ in one bit, only the one that has the bit asks for the other, so a pair meets
once in a segment. Full distances are verified where entries and questions meet.

A table slot of more than `BLOCK` fingerprints is dealt out to tiles of blocks. A task emits a
spanning forest of its links (at most one link for a fingerprint in a batch), never the pairs,
so dense groups of near copies stay linear in rows.

Defined cases: null, empty and wordless texts have fingerprint zero and link like any other;
under four words the whole sequence is the one shingle; equal texts share one fingerprint and
are compared once; rows without a doc_id keep a row, and the smallest id of their component is
taken over the others (null if none has an id); an empty table gives no row; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from codeaudit.llm.tables import components, forest
from codeaudit.llm.words import LOWER, SPACE, Chunk, texts
from codeaudit.storage import materialize

WORDS = 4
SEED = 42
DISTANCE = 4
SEGMENTS = (21, 21, 22)  # bits; beyond some hundred million texts take fewer, wider ones
BLOCK = 4096  # table entries of a tile
PAIRS = 1 << 20  # distances that are computed in one step
LONG_SPAN = 1024  # bytes from which a shingle is hashed by itself

_U = np.uint64
# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (_U(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many spans of one byte buffer."""
    out = np.zeros(len(starts), np.uint64)
    size = ends - starts
    for k in np.flatnonzero(size >= LONG_SPAN):
        out[k] = xxhash.xxh64_intdigest(buf[starts[k] : ends[k]].tobytes(), seed)
    rest = np.flatnonzero(size < LONG_SPAN)
    rest = rest[np.argsort(-(size[rest] >> 5), kind="stable")]  # most stripes first
    at, n = starts[rest], size[rest]
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes = np.ascontiguousarray(np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,)))
    s = int(seed)
    v = [np.full(len(rest), x % (1 << 64), np.uint64) for x in (s + int(_P1) + int(_P2), s + int(_P2), s, s - int(_P1))]
    stripes = n >> 5
    for k in range(int(stripes[0]) if len(rest) else 0):
        m = int(np.searchsorted(-stripes, -k, "left"))
        for j in range(4):
            v[j][:m] = _round(v[j][:m], lanes[at[:m] + 32 * k + 8 * j])
    wide = int(np.searchsorted(-stripes, 0, "left"))
    h = np.full(len(rest), (s + int(_P5)) % (1 << 64), np.uint64)
    h[:wide] = sum((_rotl(v[j][:wide], r) for j, r in ((1, 7), (2, 12), (3, 18))), _rotl(v[0][:wide], 1))
    for j in range(4):
        h[:wide] = (h[:wide] ^ _round(np.zeros(wide, np.uint64), v[j][:wide])) * _P1 + _P4
    h += n.astype(np.uint64)
    at, left = at + 32 * stripes, n & 31
    for _ in range(3):
        on = np.flatnonzero(left >= 8)
        h[on] = _rotl(h[on] ^ _round(np.zeros(len(on), np.uint64), lanes[at[on]]), 27) * _P1 + _P4
        at[on] += 8
        left[on] -= 8
    on = np.flatnonzero(left >= 4)
    h[on] = _rotl(h[on] ^ ((lanes[at[on]] & _U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at[on] += 4
    left[on] -= 4
    for _ in range(3):
        on = np.flatnonzero(left >= 1)
        h[on] = _rotl(h[on] ^ (buf[at[on]].astype(np.uint64) * _P5), 11) * _P1
        at[on] += 1
        left[on] -= 1
    h = (h ^ (h >> _U(33))) * _P2
    h = (h ^ (h >> _U(29))) * _P3
    out[rest] = h ^ (h >> _U(32))
    return out


# Each byte as eight one-byte counters, one for each of its bits.
_SPREAD = np.array([sum((b >> k & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive groups of values: the bits that over half of a group have. Empty groups: zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    size = counts[full]
    blocks = -(-size // 255)  # a counter holds 255
    first = np.cumsum(blocks) - blocks
    inner = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    starts = np.repeat(np.cumsum(size) - size, blocks) + 255 * inner
    octets = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    for b in range(8):
        sums = np.add.reduceat(_SPREAD[octets[b]], starts).astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        over = 2 * np.add.reduceat(sums, first, axis=0) > size[:, None]
        out[full] |= np.bitwise_or.reduce(over.astype(np.uint64) << np.arange(8 * b, 8 * b + 8, dtype=np.uint64), axis=1)
    return out


def chunk_prints(chunk: Chunk) -> np.ndarray:
    """The fingerprint of each text of a chunk."""
    starts, ends = chunk.spans()
    per = chunk.per_row(starts)
    words = np.diff(per)
    # Words of a text, lower-cased and joined by one space, as one buffer.
    joined = ~SPACE[chunk.buf]
    inner = np.ones(len(starts), bool)
    inner[per[:-1][words > 0]] = False
    joined[starts[inner] - 1] = True
    place = np.cumsum(joined) - 1
    flat = LOWER[chunk.buf]
    flat[SPACE[chunk.buf]] = 0x20
    flat = flat[joined]
    counts = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(len(words)), counts)
    first = per[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    last = np.minimum(first + WORDS, per[1:][row]) - 1
    if not len(row):
        return np.zeros(len(words), np.uint64)
    return majority(xxh64(flat, place[starts[first]], place[ends[last] - 1] + 1), counts)


def fingerprints(docs: DataFrame) -> DataFrame:
    """`(doc_id, print)` of every row; `print` has the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [chunk_prints(c) for c in texts(batch)]
            found = np.concatenate(got) if got else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, print long")


def radii(distance: int, segments: int) -> list[int]:
    """By segment, how many bits may differ there; some segment holds to it if the whole is within `distance`."""
    each, more = divmod(distance, segments)
    return [each if k <= more else each - 1 for k in range(segments)]


def _slots(print_: Column, distance: int, segments: tuple[int, ...]) -> tuple[list[Column], list[Column]]:
    """Table slots of a fingerprint, and slots that it asks for (null where a bit is not set)."""
    stored, asked, low = [], [], 0
    for k, (bits, radius) in enumerate(zip(segments, radii(distance, len(segments)), strict=True)):
        if radius > 1 or bits > 48:
            raise ValueError("take more segments")
        part = F.shiftrightunsigned(print_, low).bitwiseAND(F.lit((1 << bits) - 1))
        slot = part + F.lit(k << 48)
        if radius >= 0:
            stored.append(slot)
        if radius == 1:
            asked += [F.when(part.bitwiseAND(F.lit(1 << j)) != 0, slot - F.lit(1 << j)) for j in range(bits)]
        low += bits
    if low != 64:
        raise ValueError("segments need 64 bits in all")
    return stored, asked


def _meet(distance: int):
    """Links between entries and questions of each tile, from rows sorted by tile, entries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # entries of the tile that the last batch ended in: tile columns and prints
        for batch in batches:
            tile = np.stack([batch.column(c).to_numpy() for c in ("slot", "ti", "tj")], axis=1).astype(np.int64)
            asks, prints = batch.column("asks").to_numpy(zero_copy_only=False), batch.column("print").to_numpy()
            old = 0
            if kept is not None and len(tile) and np.array_equal(kept[0], tile[0]):
                old = len(kept[1])
                tile = np.concatenate([np.repeat(kept[0][None], old, axis=0), tile])
                asks = np.concatenate([np.zeros(old, bool), asks])
                prints = np.concatenate([kept[1], prints])
            if not len(tile):
                continue
            new_run = np.concatenate([[True], (tile[1:] != tile[:-1]).any(axis=1)])
            start = np.flatnonzero(new_run)
            run_of = np.cumsum(new_run) - 1
            entries = np.add.reduceat((~asks).astype(np.int64), start)
            # An entry meets those before it (in a tile of a block with itself), a question all entries.
            partners = np.where(asks, entries[run_of], np.where(tile[:, 1] == tile[:, 2], np.arange(len(tile)) - start[run_of], 0))
            partners[:old] = 0
            upto = np.cumsum(partners)
            a, b, lo = [], [], 0
            while lo < len(tile):
                done = upto[lo - 1] if lo else 0
                hi = max(int(np.searchsorted(upto, done + PAIRS, "right")), lo + 1)
                n = partners[lo:hi]
                who = np.repeat(np.arange(lo, hi), n)
                other = start[run_of[who]] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                apart = np.bitwise_count((prints[who] ^ prints[other]).view(np.uint64))
                near = (apart <= distance) & (apart > 0)
                a.append(prints[who[near]])
                b.append(prints[other[near]])
                if sum(map(len, a)) > PAIRS:
                    x, y = forest(np.concatenate(a), np.concatenate(b))
                    a, b = [x], [y]
                lo = hi
            last = start[-1]
            kept = tile[-1], prints[last : last + entries[-1]].copy()
            x, y = forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return run


def links(prints: DataFrame, distance: int = DISTANCE, segments: tuple[int, ...] = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """`(a, b)` between different values of the distinct column `print`; they join all that are near."""
    stored, asked = _slots(F.col("print"), distance, segments)
    entry = F.transform(F.array(*stored), lambda s: F.struct(s.alias("slot"), F.lit(False).alias("asks")))
    rows = entry
    if asked:
        rows = F.concat(entry, F.transform(F.array_compact(F.array(*asked)), lambda s: F.struct(s.alias("slot"), F.lit(True).alias("asks"))))
    rows = prints.select("print", F.inline(rows))
    # Slots above a block; hardly any, but their number is not bounded, so the join is left to Spark's size check.
    hot = materialize(
        prints.select(F.explode(F.array(*stored)).alias("slot")).groupBy("slot").count().where(F.col("count") > block)
        .select("slot", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "simhash-hot")
    n, own = F.col("blocks"), F.col("own")
    pair = lambda i, j, asks: F.struct(i.cast("int").alias("ti"), j.cast("int").alias("tj"), asks.alias("asks"))
    # A block of entries meets itself, each later block of entries and each block of questions.
    as_entry = F.transform(F.sequence(own, 2 * n - 1), lambda j: pair(own, j, F.lit(False)))
    as_other = F.filter(F.transform(F.sequence(F.lit(0), own), lambda i: pair(i, own, F.lit(True))), lambda t: t["ti"] < t["tj"])
    as_question = F.transform(F.sequence(F.lit(0), n - 1), lambda i: pair(i, n + own, F.lit(True)))
    alone = F.array(pair(F.lit(0), F.lit(0), F.col("asks")))
    tiles = F.when(n.isNull(), alone).when(F.col("asks"), as_question).otherwise(F.concat(as_entry, as_other))
    rows = (
        rows.join(hot, "slot", "left").withColumn("own", F.pmod(F.xxhash64("print"), n).cast("int"))
        .select("slot", "print", F.inline(tiles)))
    return (
        rows.repartition("slot", "ti", "tj").sortWithinPartitions("slot", "ti", "tj", "asks")
        .mapInArrow(_meet(distance), "a long, b long"))


def near_components(docs: DataFrame, distance: int = DISTANCE, segments: tuple[int, ...] = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """Per document `(doc_id, fingerprint, component_id)`."""
    rows = materialize(fingerprints(docs), "simhash-prints")
    classes = materialize(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-classes")
    joined = components(links(classes.select("print"), distance, segments, block), "simhash-components")
    joined = classes.join(joined.withColumnRenamed("id", "print"), "print")
    low = joined.groupBy("component").agg(F.min("first").alias("low"))
    low = joined.join(low, "component").select("print", "low")
    smallest = classes.join(low, "print", "left").select("print", F.coalesce("low", "first").alias("component_id"))
    return rows.join(smallest, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
