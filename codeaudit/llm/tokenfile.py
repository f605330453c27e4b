"""Token-ID output: canonical length-limited Huffman files of ids, with independent blocks.

Documents are range-partitioned and sorted by doc_id (nulls first, repeated ids by text),
tokenized, and each gets the end id. Counts of all ids give code lengths of at most `LIMIT`
bits by package-merge; canonical codes follow from the lengths alone.

Files under a folder, both written by Spark:
- `codes`: `id, length`.
- `blocks`: `part, seq` (order of blocks), `first_token` (ids in all blocks before), `doc_ids`,
  `counts` (ids of each document, end id included), `payload` (codes, first bit highest, as
  big-endian 64-bit words with one spare word), `checkpoints` (bit offset of every
  `LANE`-th id). A block decodes by itself, and from any checkpoint on.

Decoding reads `LIMIT` bits at a table: all checkpoints of a block advance together.

Defined cases: null and empty texts have the end id alone; an empty table has no blocks; a
document longer than a block is a block of its own.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codeaudit.llm.pieces import Solved, ragged
from codeaudit.llm.words import LOWER, Chunk, Hasher, list_array, texts
from codeaudit.storage import materialize, scratch_path

LIMIT = 20
LANE = 256
BLOCK = 1 << 20
KEPT_WORDS = 700_000  # distinct words, or heads and tails of words, whose ids a worker keeps, in arrays
BREAKS = np.zeros(256, bool)  # what ends a word here
BREAKS[[0x20, 0x0A]] = True
TAILS = np.zeros(256, bool)  # what is cut off the end of a word
TAILS[[ord(c) for c in string.punctuation if c != "'"]] = True  # an apostrophe may begin a contraction
END_ID = 1
RAW = "part int, seq int, doc_ids array<long>, counts array<long>, ids binary"
BLOCKS = "part int, seq int, first_token long, doc_ids array<long>, counts array<long>, payload binary, checkpoints array<long>"

_U = np.uint64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts under the default tokenizer, each distinct word encoded once.

    It never looks across a space or a line break, lower-cases, splits runs of letters from
    punctuation and marks the last piece of a run. So a word is its head and a tail of
    punctuation, case does not tell heads apart, and the heads that are all letters are encoded
    in one call and told apart by their marks. A worker process keeps one encoder for all its tasks.
    """

    @classmethod
    @cache
    def load(cls, path: str) -> WordEncoder:
        return cls(path)

    def __init__(self, path: str):
        # Spark runs a task per core; threads within one would only add to it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The normalizer changes nothing in lower-case letters and single spaces.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[k for token, k in vocab.items() if token.endswith("</w>")]] = True
        self.met = Solved()  # heads, tails and words

    def _learn(self, h: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode the words at these places; `h` are their hashes."""
        raw = buf.tobytes()
        found = self.tokenizer.encode_batch_fast([raw[a:z].decode("utf-8", "surrogatepass") for a, z in zip(starts.tolist(), ends.tolist())], add_special_tokens=False)
        ids = [x.ids for x in found]
        counts = np.array([len(x) for x in ids], np.int64)
        self.met.add(h, counts, np.cumsum(counts) - counts, np.array([i for x in ids for i in x], np.int32))

    def _learn_letters(self, h: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """As `_learn`, for words of lower-case letters alone."""
        size = ends - starts + 1
        joined = buf[np.minimum(ragged(starts, size), len(buf) - 1)]
        joined[np.cumsum(size) - 1] = 0x20
        ids = np.array(self.plain.encode_batch_fast([joined.tobytes().decode()], add_special_tokens=False)[0].ids, np.int32)
        upto = np.flatnonzero(self.last[ids]) + 1
        if len(upto) != len(h):
            return self._learn(h, buf, starts, ends)
        counts = np.diff(upto, prepend=0)
        self.met.add(h, counts, upto - counts, ids)

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk in order, and where each text's start (one more at the end).

        Words are told apart by the hashes of their bytes; only those that the worker has not met go to the tokenizer.
        """
        buf, starts, ends, letters = parts(chunk)
        h, at, which = np.unique(Hasher(buf)(starts, ends), return_index=True, return_inverse=True)
        new = self.met.missing(h)
        if new.any():
            if len(self.met.keys) > KEPT_WORDS:  # start anew; what is met again is encoded again
                self.met = Solved()
                new[:] = True
            for learn, some in ((self._learn_letters, new & letters[at]), (self._learn, new & ~letters[at])):
                if some.any():
                    learn(h[some], buf, starts[at[some]], ends[at[some]])
        word = np.searchsorted(self.met.keys, h)[which]
        counts = self.met.count[word]
        ids = self.met.ids[ragged(self.met.place[word], counts)].astype("<u4")
        return ids, np.concatenate([[0], np.cumsum(counts)])[chunk.per_row(starts)]


def _before(flags: np.ndarray) -> np.ndarray:
    """How many are set before each place (one more at the end)."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


def parts(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Heads, tails and undivided words of a chunk: bytes, starts, ends, and which are lower-case letters alone.

    The ids of a text are those of its parts in order. Letters are ASCII's and those of U+00C0 to U+00FF,
    which no normal form joins; other words are encoded as they stand, in lower case if ASCII.
    """
    starts, ends = chunk.spans(BREAKS)
    if not len(starts):
        return chunk.buf, starts, ends, np.zeros(0, bool)
    buf = LOWER[chunk.buf]
    second = np.flatnonzero(buf[:-1] == 0xC3) + 1
    second = second[(buf[second] != 0x97) & (buf[second] != 0xB7)]  # signs of multiplication and division
    buf[second] |= np.where(buf[second] < 0x9F, 0x20, 0).astype(np.uint8)
    letter = (buf >= 0x61) & (buf <= 0x7A)
    letter[second] = letter[second - 1] = True
    n_letters, n_wide = _before(letter), _before(chunk.buf >= 0x80)
    special = np.flatnonzero((buf[:-1] == 0x3C) & (buf[1:] == 0x7C))  # "<|"
    whole = np.zeros(len(starts), bool)
    whole[np.searchsorted(starts, special, "right") - 1] = True

    inside = np.maximum.accumulate(np.where(TAILS[chunk.buf], 0, np.arange(1, len(buf) + 1, dtype=np.int32)))[ends - 1]
    split = (inside > starts) & (inside < ends) & letter[inside - 1] & ~whole
    first = np.arange(len(starts)) + np.cumsum(split) - split  # place of each word's first part
    n = len(starts) + int(split.sum())
    lo, hi, kept = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
    lo[first], hi[first], kept[first] = starts, np.where(split, inside, ends), whole
    lo[first[split] + 1], hi[first[split] + 1] = inside[split], ends[split]

    letters = (n_letters[hi] - n_letters[lo] == hi - lo) & ~kept
    raw = np.flatnonzero(~letters & (kept | (n_wide[hi] > n_wide[lo])))
    places = ragged(lo[raw], hi[raw] - lo[raw])
    buf[places] = chunk.buf[places]
    return buf, lo, hi, letters


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Blocks of ids in ascending doc_id order, as `RAW`."""
    path = path or default_path()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = WordEncoder.load(path), TaskContext.get().partitionId(), 0
        ids, doc_ids, counts, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            n = np.array([len(doc_ids)])
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())),
                list_array(np.array(counts, np.int64), n, pa.int64()), pa.array([b"".join(ids)], pa.binary())],
                ["part", "seq", "doc_ids", "counts", "ids"])

        for batch in batches:
            for chunk in texts(batch):
                found, bounds = encoder.encode(chunk)
                rows = batch.column("doc_id").slice(chunk.lo, chunk.hi - chunk.lo).to_pylist()
                for doc, x in zip(rows, (found[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:]))):
                    if held and held + len(x) // 4 + 1 > BLOCK:
                        yield block()
                        seq, ids, doc_ids, counts, held = seq + 1, [], [], [], 0
                    ids += [x, end]
                    doc_ids.append(doc)
                    counts.append(len(x) // 4 + 1)
                    held += counts[-1]
        if doc_ids:
            yield block()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, RAW)


def id_counts(raw: DataFrame) -> dict[int, int]:
    """Count of every id; as many entries as the vocabulary has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column("ids"):
                n = np.bincount(np.frombuffer(data.as_buffer(), "<u4"), minlength=len(total))
                n[: len(total)] += total
                total = n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return {r.id: r.n for r in raw.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal prefix code lengths of at most `limit`, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of the limit")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaf, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(leaf))
        merged = both[by]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(leaf) - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then by id, each one more than the last."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[order]
    # In units of the longest code, each code takes 2 ** (longest - its length) places.
    longest = int(size.max(initial=0))
    before = np.cumsum(1 << (longest - size)) - (1 << (longest - size))
    codes[order] = before >> (longest - size)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload and checkpoints."""
    size = lengths[ids]
    end = np.cumsum(size)
    at = end - size
    code = codes[ids].astype(np.uint64)
    words = np.zeros((int(end[-1]) >> 6) + 2 if len(ids) else 1, np.uint64)
    if len(ids):
        word, room = at >> 6, 64 - (at & 63)
        over = size - room  # bits that go on into the next word
        head = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[first]] = np.add.reduceat(head, first)
        split = over > 0
        words[word[split] + 1] |= code[split] << (64 - over[split]).astype(np.uint64)
    return words.astype(">u8").tobytes(), at[::LANE]


class Decoder:
    def __init__(self, lengths: np.ndarray):
        self.bits = max(int(lengths.max(initial=1)), 1)
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        places = 1 << (self.bits - lengths[order])
        full = np.repeat(order, places)
        self.symbol = np.zeros(1 << self.bits, np.int32)
        self.symbol[: len(full)] = full
        self.length = lengths[self.symbol].astype(np.int64)

    def unpack(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        words = np.frombuffer(payload, ">u8").astype(np.uint64)
        pos = checkpoints.astype(np.int64).copy()
        out = np.zeros((LANE, len(pos)), np.int32)
        down = _U(64 - self.bits)
        last = n - (len(pos) - 1) * LANE  # ids in the last lane
        for step in range(min(LANE, n)):
            live = pos if step < last else pos[:-1]
            word, bit = live >> 6, (live & 63).astype(np.uint64)
            window = ((words[word] << bit) | ((words[word + 1] >> _U(1)) >> (_U(63) - bit))) >> down
            out[step, : len(live)] = self.symbol[window.astype(np.int64)]
            live += self.length[window.astype(np.int64)]
        return out.T.reshape(-1)[:n]


def write(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Tokenize `docs` and write the files under `folder`."""
    spark = docs.sparkSession
    raw = materialize(tokenize(docs, path), "token-ids")
    counts = id_counts(raw)
    size = max(counts, default=0) + 1
    lengths = code_lengths(np.array([counts.get(i, 0) for i in range(size)], np.int64))
    codes = canonical(lengths)

    # First ids of blocks: sums within a part, then over the parts, of which there are as many as tasks.
    totals = raw.select("part", "seq", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    parts = {r.part: r.n for r in totals.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base = dict(zip(sorted(parts), np.cumsum([0, *(parts[p] for p in sorted(parts))]).tolist()))
    order = Window.partitionBy("part").orderBy("seq")
    bases = spark.createDataFrame(sorted(base.items()) if base else [], "part int, base long")
    starts = totals.withColumn("upto", F.sum("n").over(order)).join(bases, "part").select(
        "part", "seq", (F.col("base") + F.col("upto") - F.col("n")).alias("first_token"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                payload, marks = pack(np.frombuffer(batch.column("ids")[k].as_buffer(), "<u4"), lengths, codes)
                same = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays(
                    [*[same.column(c) for c in ("part", "seq", "first_token", "doc_ids", "counts")], pa.array([payload], pa.binary()),
                     pa.array([marks], pa.list_(pa.int64()))],
                    ["part", "seq", "first_token", "doc_ids", "counts", "payload", "checkpoints"])

    # Blocks are few and large; the batches are kept small in rows.
    raw.join(F.broadcast(starts) if len(base) < 100_000 else starts, ["part", "seq"]).mapInArrow(run, BLOCKS).write.parquet(f"{folder}/blocks")
    spark.createDataFrame(
        [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int").coalesce(1).write.parquet(f"{folder}/codes")


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """`(doc_id, start, n_tokens, ids_crc32[, ids])` from the files under `folder`."""
    rows = spark.read.parquet(f"{folder}/codes").collect()
    lengths = np.zeros(max([r.id for r in rows], default=0) + 1, np.int64)
    lengths[[r.id for r in rows]] = [r.length for r in rows]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                counts = batch.column("counts")[k].values.to_numpy()
                ids = decoder.unpack(batch.column("payload")[k].as_buffer(), batch.column("checkpoints")[k].values.to_numpy(), int(counts.sum()))
                ends = np.cumsum(counts)
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(ends - counts, ends)]
                out = [batch.column("doc_ids")[k].values, pa.array(batch.column("first_token")[k].as_py() + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [list_array(ids, counts, pa.int32())] * with_ids, names)

    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the files of `docs` to the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    write(docs, folder, path)
    return read(docs.sparkSession, folder)
