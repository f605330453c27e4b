"""Benchmark decontamination: CGK random walks, bit-sampling LSH, exact edit verification.

Symbols are words: runs of letters, digits and non-ASCII characters, lower-cased, so marks and
spacing do not count. An item of m words stands in a document when some span of the document is
within `RATE` of m word edits of it.

A CGK walk reads a window from its start; at every step a random bit of (walk, step, word) says
whether it moves on, so two windows a few edits apart soon walk in step again and edit distance
becomes Hamming distance of the words read. A table of the LSH is the words read at a few random
steps, spread over one of the walks. The windows' size follows the item's: the largest power of two up to
two thirds of it. All starts of an item are embedded, and every `STRIDE`-th start of each
document, so a passage meets its item at many aligned places, and each has all tables to hit.
Items of up to `SHORT` words have too few starts for that. With e allowed edits one of e + 1 runs of
their words stands unaltered, so their runs of the length of the longest that must stand are keys, met at
every start of each document; none within the distance is missed. Hits are verified by edit distance against the whole item.

The items come to the driver and go to the tasks in blocks of bounded size; each block is one
pass over the documents.

Defined cases: null, empty and wordless texts and items match nothing; a document within the
distance of several items has a row for each; equal documents have equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeaudit.llm.tables import fresh, row_key
from codeaudit.llm.words import BASE, LOWER, Hasher, mix, texts, windows

RATE = 0.2  # word edits for each word of the item
STRIDE = 3
SHORT = 11  # longer items have more starts than STRIDE
WALKS, TABLES, SYMBOLS = 6, 18, 4
BLOCK_CHARS = 4_000_000
SCREEN_BITS = 22
HITS = "doc_id long, item_id long, start long, n_words long, distance long"

_U = np.uint64
OTHER = np.ones(256, bool)
OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _lower(buf: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the capitals U+00C0-U+00DE."""
    out = LOWER[buf]
    after = np.flatnonzero(buf[:-1] == 0xC3) + 1
    capital = after[(buf[after] >= 0x80) & (buf[after] <= 0x9E) & (buf[after] != 0x97)]
    out[capital] += 0x20
    return out


def word_lists(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, word bounds of rows) of each chunk."""
    for chunk in texts(batch, name):
        starts, ends = chunk.spans(OTHER)
        yield chunk.lo, Hasher(_lower(chunk.buf))(starts, ends), chunk.per_row(starts)


def run_length(m: int) -> int:
    """Words of the longest run of an item that any allowed edits leave whole."""
    e = int(RATE * m)
    return -(-(m - e) // (e + 1))


def size_class(m: int) -> int:
    return 1 << max(2 * m // 3, 1).bit_length() - 1


class Walks:
    """The random choices; the same in every task."""

    def __init__(self, classes: list[int]):
        self.classes = classes
        self.salts = mix(np.arange(1, WALKS + 1, dtype=np.uint64) * _U(BASE))
        self.plan: list[dict[int, list[tuple[int, int]]]] = [{} for _ in range(WALKS)]  # walk: step: (class index, table)
        for c, size in enumerate(classes):
            rng = np.random.default_rng([7, size])
            for t in range(TABLES):
                # One step from each part of the walk, so that the words read differ.
                part = max(2 * size // SYMBOLS, 1)
                for step in np.arange(0, 2 * size, part) + rng.integers(0, part, -(-2 * size // part)):
                    self.plan[t % WALKS].setdefault(int(step), []).append((c, t))

    def keys(self, h: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Per (class, table): the key of the window at each position. `h` ends every text with a 0, where walks stay."""
        out = {}
        for walk, steps in enumerate(self.plan):
            if not steps:
                continue
            bits = mix(h ^ self.salts[walk])
            bits[h == 0] = 0
            pos = at.copy()
            for step in range(max(steps) + 1):
                if step and step % 64 == 0:
                    bits = np.where(h == 0, _U(0), mix(bits + _U(step)))
                for c, t in steps.get(step, ()):
                    known = out.get((c, t))
                    out[c, t] = h[pos] + _U(c * TABLES + t + 1) if known is None else mix(known * _U(BASE) + h[pos])
                pos += ((bits[pos] >> _U(step % 64)) & _U(1)).astype(np.int64)
        return {k: mix(v) for k, v in out.items()}


def padded(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with a 0 after every text, and where each text starts in them."""
    n = len(bounds) - 1
    out = np.zeros(len(h) + n, np.uint64)
    row = np.repeat(np.arange(n), np.diff(bounds))
    out[np.arange(len(h)) + row] = np.where(h == 0, _U(1), h)
    return out, bounds[:-1] + np.arange(n)


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to a span of the text, and where that span ends."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for k, word in enumerate(item, 1):
        best = np.empty_like(row)
        best[0] = k
        np.minimum(row[:-1] + (text != word), row[1:] + 1, out=best[1:])
        row = np.minimum.accumulate(best - steps) + steps
    end = int(np.argmin(row))
    return int(row[end]), end


@dataclass
class Index:
    """One block of items."""

    ids: list[int]
    words: list[np.ndarray]
    walks: Walks
    tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]  # sorted keys, item, start in the item
    screen: np.ndarray
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: sorted keys, item, start in the item

    @classmethod
    def build(cls, rows: list[tuple[int, str]]) -> Index:
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows], pa.string())], ["text"])
        words = []
        for _, h, bounds in word_lists(batch):
            words += [h[a:z] for a, z in zip(bounds[:-1], bounds[1:])]
        classes = sorted({size_class(len(w)) for w in words if len(w) > SHORT})
        walks, parts = Walks(classes), {}
        for c, size in enumerate(classes):
            own = [k for k, w in enumerate(words) if len(w) > SHORT and size_class(len(w)) == size]
            bounds = np.cumsum([0, *(len(words[k]) for k in own)])
            h, begin = padded(np.concatenate([words[k] for k in own]), bounds)
            starts = [np.arange(len(words[k]) - size + 1) for k in own]
            item = np.repeat(np.array(own, np.int32), [len(s) for s in starts])
            start = np.concatenate(starts).astype(np.int32)
            at = start + np.repeat(begin, [len(s) for s in starts])
            parts |= {k: (v, item, start) for k, v in walks.keys(h, at).items() if k[0] == c}
        screen = np.zeros(1 << SCREEN_BITS, bool)
        tables = {}
        for k, (v, item, start) in parts.items():
            order = np.argsort(v, kind="stable")
            tables[k] = v[order], item[order], start[order]
            screen[(v >> _U(64 - SCREEN_BITS)).astype(np.int64)] = True
        runs = {}
        for size in sorted({run_length(len(w)) for w in words if 0 < len(w) <= SHORT}):
            own = [k for k, w in enumerate(words) if 0 < len(w) <= SHORT and run_length(len(w)) == size]
            v = np.concatenate([windows(words[k], size) for k in own])
            starts = [np.arange(len(words[k]) - size + 1) for k in own]
            order = np.argsort(v, kind="stable")
            runs[size] = v[order], np.repeat(own, [len(x) for x in starts])[order], np.concatenate(starts)[order]
        return cls([i for i, _ in rows], words, walks, tables, screen, runs)

    def hits(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, start, words, distance) of every text and item within the distance."""
        text, begin = padded(h, bounds)
        n = np.diff(bounds)
        starts = (n + STRIDE - 1) // STRIDE
        row = np.repeat(np.arange(len(n)), starts)
        offset = (np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)) * STRIDE
        found = []
        for k, keys in self.walks.keys(text, begin[row] + offset).items():
            at = np.flatnonzero(self.screen[(keys >> _U(64 - SCREEN_BITS)).astype(np.int64)])
            known, item, start = self.tables[k]
            lo, hi = np.searchsorted(known, keys[at], "left"), np.searchsorted(known, keys[at], "right")
            many = hi - lo
            which = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            w = np.repeat(at, many)
            found.append(np.stack([row[w], item[which], offset[w] - start[which]]))
        whole = np.repeat(np.arange(len(n)), n)
        for size, (known, item, start) in self.runs.items():
            keys = windows(h, size)
            at = np.flatnonzero(whole[: len(keys)] == whole[size - 1 :][: len(keys)])
            lo, hi = np.searchsorted(known, keys[at], "left"), np.searchsorted(known, keys[at], "right")
            many = hi - lo
            which = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            w = np.repeat(at, many)
            found.append(np.stack([whole[w], item[which], w - bounds[whole[w]] - start[which]]))
        if not found:
            return
        found = np.unique(np.concatenate(found, axis=1), axis=1)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for r, i, place in found.T:
            item = self.words[i]
            m, most = len(item), int(RATE * len(item))
            a = max(int(place) - most, 0)
            part = h[bounds[r] : bounds[r + 1]][a : max(int(place), 0) + m + most]
            known = best.get((r, i))
            if known and known[1] == 0 or np.isin(item, part).sum() < m - most:
                continue
            d, end = distance(item, part)
            if d <= most and (known is None or d < known[1]):
                begin_back = distance(item[::-1], part[:end][::-1])[1]
                best[r, i] = (a + end - begin_back, d, m)
        for (r, i), (start, d, m) in best.items():
            yield int(r), int(i), start, m, d


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about `BLOCK_CHARS` characters, one on the driver at a time."""
    usable = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    chars = usable.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = int(chars) // BLOCK_CHARS + 1
    for b in range(n):
        rows = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        if rows:
            yield sorted((r.item_id, r.text) for r in rows)


def passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`(doc_id, item_id, start, n_words, distance)`: the item's best place in each document that has it."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")

    def search(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids = batch.column("doc_id")
                for lo, h, bounds in word_lists(batch):
                    out = list(index.hits(h, bounds))
                    if out:
                        at, item, start, m, d = zip(*out)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(np.array(at) + lo)), pa.array([index.ids[i] for i in item], pa.int64()),
                             *[pa.array(x, pa.int64()) for x in (start, m, d)]], ["doc_id", "item_id", "start", "n_words", "distance"])

        return rows.mapInArrow(run, HITS)

    found = [search(Index.build(block)) for block in _blocks(items)]
    empty = docs.sparkSession.createDataFrame([], HITS)
    return reduce(DataFrame.unionAll, found) if found else empty


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no item, unchanged; a row without a doc_id goes by its own text."""
    key = fresh("row_key", docs.columns)
    keyed = docs.withColumn(key, row_key(docs))
    hit = passages(keyed.select(F.col(key).alias("doc_id"), "text"), items).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(hit, key, "left_anti").select(*docs.columns)
