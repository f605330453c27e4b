"""LM scoring: cross-entropy difference of a target and a background n-gram model.

Both models are interpolated bigram models over the words of the corpus; no word and no bigram
is left out or shares a count. The background is counted over all documents, the target over
those that `labels` calls good. The background's counts are scaled to the target's total, so both
are smoothed alike: unigrams by one count each, bigrams by `PRIOR` counts of the unigram estimate.

Documents go into units of about `HELD_WORDS` words, one row each of a written table, with the
unit's words as ranks by frequency. Each unit counts its keys (bigrams, words, contexts: 64-bit
hashes, their last bit telling words from the rest) and sends them to buckets of the key space as
sorted, delta-coded blocks, about six bytes a key. A bucket adds its blocks up and answers each with the
totals of its keys, in the same order and without the keys. The unit joins its answers and scores its
documents. So no row is made for a bigram, a hot word or bigram stands once in a unit, and everything
grows with the corpus in tables only; results are exact up to equality of hashes. A bigram's two losses
are whole billionths of a nat, so sums have no order.

A document's score is the mean over its words of background loss minus target loss (nats):
the higher, the more it is like the target.

Defined cases: null and wordless texts have 0 words and score 0; A-Z count as lower case; without
good labels the target is the smoothed uniform model; labels of unknown documents count nothing;
repeated rows count as often as they stand and score alike; a text longer than a unit is a unit of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from codeaudit.llm.words import BASE, LOWER, Hasher, mix, texts
from codeaudit.storage import materialize

PRIOR = 50.0
UNIT = 1e9  # losses are stored in whole parts of a nat
HELD_WORDS = 1_500_000  # words of a unit
HELD_ROWS = 200_000  # rows of a unit at most
BUCKET_KEYS = 1_500_000  # keys of a bucket, counted in every unit that has them

SENT_IDS = 2_000_000  # ids of the target that are broadcast at most (about 140 MB as a hash table)

_U = np.uint64
START = _U(0x5EED)  # stands before a text's first word
UNITS = "unit long, doc_ids array<long>, counts array<long>, good array<boolean>, n_types int, n_words long, n_good long, words binary, ranks binary"
BLOCKS = "bucket int, unit long, size int, keys binary, n binary, good binary"
ANSWERS = "unit long, bucket int, size int, n binary, good binary, types long"


def pack(values: np.ndarray) -> bytes:
    """64-bit values by byte planes, compressed: planes of small values vanish."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpack(data: pa.Buffer, size: int) -> np.ndarray:
    if not size:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=8 * size), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, size).T).view("<u8").reshape(-1)


def pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * _U(BASE) + word)


class Keys:
    """The keys of a unit, sorted, and which of them each word has."""

    def __init__(self, words: np.ndarray, ranks: np.ndarray, lengths: np.ndarray):
        self._ranks, self._lengths = ranks, lengths
        ends = np.cumsum(lengths)
        some = lengths > 0
        first, self._last = (ends - lengths)[some], ends[some] - 1
        # The start of a text stands behind the words.
        self._before = np.empty_like(ranks)
        self._before[1:] = ranks[:-1]
        self._before[first] = len(words)
        h = np.append(words, START)
        pairs, at = np.unique(pair(h[self._before], words[ranks]) & ~_U(1), return_inverse=True)
        # Keys that are equal by chance are one key.
        self.keys, place = np.unique(np.concatenate([pairs, mix(words) | _U(1), mix(h ^ _U(0xC0)) & ~_U(1)]), return_inverse=True)
        self._place, self._at = place, at
        self._pair, self._word, self._context = place[: len(pairs)][at], place[len(pairs) : len(pairs) + len(words)], place[len(pairs) + len(words) :]

    def count(self, rows: np.ndarray) -> np.ndarray:
        """How often each key stands in the rows that are marked."""
        marked = np.repeat(rows, self._lengths)
        types = len(self._word)
        singles = np.bincount(self._ranks, marked, types)
        # A text's last word is no context, and its first one has the start as context.
        last = np.bincount(self._ranks[self._last], rows[self._lengths > 0], types)
        n = [np.bincount(self._at, marked, len(self._place) - 2 * types - 1), singles, singles - last, [last.sum()]]
        return np.bincount(self._place, np.concatenate(n), len(self.keys)).astype(np.int64)

    def losses(self, n: np.ndarray, by: float, total: int, size: int) -> np.ndarray:
        """Of every word in order, in parts of `UNIT`, under a model with the counts `n` of the keys times `by`."""
        word = (n[self._word] * by + 1) / (total * by + size)
        likely = (n[self._pair] * by + PRIOR * word[self._ranks]) / (n[self._context] * by + PRIOR)[self._before]
        return np.rint(-np.log(likely) * UNIT).astype(np.int64)


def units(docs: DataFrame, unit_words: int = HELD_WORDS) -> DataFrame:
    """The documents `(doc_id, text, good)` in units, as `UNITS`."""
    schema = pa.schema([("unit", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("good", pa.list_(pa.bool_())),
                        ("n_types", pa.int32()), ("n_words", pa.int64()), ("n_good", pa.int64()), ("words", pa.binary()), ("ranks", pa.binary())])

    def unit(k: int, doc_ids: list[pa.Array], good: list[pa.Array], counts: list[np.ndarray], held: list[np.ndarray]) -> pa.RecordBatch:
        lengths, good = np.concatenate(counts), pa.concat_arrays(good)
        words, ranks, n = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        # Ranks go by powers of two of the counts; words of one power stay in order, so their differences are small.
        order = np.argsort(-np.frexp(n)[1], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        n_good = int(lengths[good.to_numpy(zero_copy_only=False)].sum())
        row = (TaskContext.get().partitionId() << 32 | k, pa.concat_arrays(doc_ids), lengths, good, len(words), len(ranks), n_good,
               pack(np.diff(words[order], prepend=_U(0))), pack(rank[ranks]))
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size, rows, parts = 0, 0, 0, []
        for batch in batches:
            for chunk in texts(batch):
                starts, ends = chunk.spans()
                counts = np.diff(chunk.per_row(starts))
                own = (batch.column(c).slice(chunk.lo, len(counts)) for c in ("doc_id", "good"))
                parts.append((*own, counts, Hasher(LOWER[chunk.buf])(starts, ends)))
                size, rows = size + len(starts), rows + len(counts)
                if size >= unit_words or rows >= HELD_ROWS:
                    yield unit(k, *map(list, zip(*parts)))
                    k, size, rows, parts = k + 1, 0, 0, []
        if rows:
            yield unit(k, *map(list, zip(*parts)))

    return docs.select(F.col("doc_id").cast("long"), "text", "good").mapInArrow(run, UNITS)


def _keys(row: dict) -> Keys:
    words, ranks = (unpack(row[x].as_buffer(), row[n].as_py()) for x, n in (("words", "n_types"), ("ranks", "n_words")))
    return Keys(np.cumsum(words, dtype=np.uint64), ranks.astype(np.int64), row["counts"].values.to_numpy())


def _blocks(held: DataFrame, buckets: int) -> DataFrame:
    """The keys and counts of every unit, as `BLOCKS`."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in batch.schema.names}
                found = _keys(row)
                good = row["good"].values.to_numpy(zero_copy_only=False)
                n, of_target = found.count(np.ones_like(good)), found.count(good)
                cuts = [0, *np.searchsorted(found.keys, edges).tolist(), len(found.keys)]
                spans = [(b, slice(a, z)) for b, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])) if a < z]
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _ in spans], pa.int32()), pa.array([row["unit"].as_py()] * len(spans), pa.int64()),
                    pa.array([x.stop - x.start for _, x in spans], pa.int32()),
                    pa.array([pack(np.diff(found.keys[x], prepend=_U(0))) for _, x in spans], pa.binary()),
                    *[pa.array([pack(counts[x]) for _, x in spans], pa.binary()) for counts in (n, of_target)]],
                    ["bucket", "unit", "size", "keys", "n", "good"])

    return held.select("unit", "counts", "good", "n_types", "n_words", "words", "ranks").mapInArrow(run, BLOCKS)


def _answer(table: pa.Table) -> pa.Table:
    """For each block of a bucket, what other units add to its counts; and the bucket's number of words."""
    table = table.combine_chunks()
    sizes = table.column("size").to_pylist()
    binary = lambda name: [unpack(x.as_buffer(), n) for x, n in zip(table.column(name), sizes)]
    keys, at = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in binary("keys")]), return_inverse=True)
    spans = [slice(z - size, z) for size, z in zip(sizes, np.cumsum(sizes).tolist())]
    more = []
    for name in ("n", "good"):
        own = np.concatenate(binary(name)).astype(np.int64)
        others = np.bincount(at, own, len(keys)).astype(np.int64)[at] - own
        more.append(pa.array([*(pack(others[x]) for x in spans), b""], pa.binary()))
    rest = len(sizes)
    return pa.Table.from_arrays([
        pa.array([*table.column("unit").to_pylist(), None], pa.int64()), pa.array([table.column("bucket")[0].as_py()] * (rest + 1), pa.int32()),
        pa.array([*sizes, 0], pa.int32()), *more, pa.array([*[0] * rest, int((keys & _U(1)).sum())], pa.int64())],
        ["unit", "bucket", "size", "n", "good", "types"])


def score(docs: DataFrame, target: DataFrame, unit_words: int = HELD_WORDS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """`(doc_id, n_words, loss_target, loss_background, score)` of every row of `docs`, for a model of the documents whose ids `target` holds against one of all `docs`."""
    ids = materialize(target.select("doc_id").where("doc_id is not null").distinct(), "lm-target").withColumn("good", F.lit(True))
    # Counted ids go to the texts; more of them meet the texts by a shuffle.
    marked = docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "doc_id", "left")
    held = materialize(units(marked.withColumn("good", F.coalesce("good", F.lit(False))), unit_words), "lm-units")
    total = held.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(name) for name, x in (
        ("n", F.col("n_words")), ("good", F.col("n_good")), ("most", F.col("n_words") + 2 * F.col("n_types") + 1))]).first()
    n_all, n_good = int(total.n), int(total.good)
    blocks = _blocks(held, max(1, -(-int(total.most) // bucket_keys)))
    answers = materialize(blocks.groupBy("bucket").applyInArrow(_answer, ANSWERS), "lm-answers")
    size = int(answers.agg(F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first().types) + 2  # and a word that is not there, and the start of a text
    scale = n_good / max(n_all, 1)

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {name: left.column(name)[0] for name in left.column_names}
        right = right.sort_by("bucket")
        more = [np.concatenate([np.zeros(0, np.uint64), *(unpack(x.as_buffer(), k) for x, k in zip(right.column(name), right.column("size").to_pylist()))]).astype(np.int64)
                for name in ("good", "n")]
        found, counts, marks = _keys(row), row["counts"].values.to_numpy(), row["good"].values.to_numpy(zero_copy_only=False)
        ends = np.cumsum(counts)
        sums = []
        for other, rows, by, words in zip(more, (marks, np.ones_like(marks)), (1.0, scale), (n_good, n_all)):
            upto = np.concatenate([[0], np.cumsum(found.losses(found.count(rows) + other, by, words, size))])
            sums.append(pa.array(upto[ends] - upto[ends - counts]))
        return pa.Table.from_arrays([row["doc_ids"].values, pa.array(counts), *sums], ["doc_id", "n_words", "near", "wide"])

    own = held.select("unit", "doc_ids", "counts", "good", "n_types", "n_words", "words", "ranks")
    met = own.groupBy("unit").cogroup(answers.where("unit is not null").drop("types").groupBy("unit"))
    rows = met.applyInArrow(scores, "doc_id long, n_words long, near long, wide long")
    mean = lambda x: F.coalesce(F.round(F.col(x) / F.nullif(F.col("n_words"), F.lit(0)) / UNIT, 6), F.lit(0.0))
    rows = rows.select("doc_id", "n_words", mean("near").alias("loss_target"), mean("wide").alias("loss_background"))
    return rows.withColumn("score", F.round(F.col("loss_background") - F.col("loss_target"), 6))


def good_documents(labels: DataFrame) -> DataFrame:
    """Ids of the documents that a label calls good."""
    return labels.where("quality = 1").select("doc_id")
