"""SentencePiece encoding and decoding: batched numpy Viterbi over a piece vocabulary.

As in SentencePiece, a text gets a space in front and spaces become U+2581; a text is cut
before each run of these, which no piece crosses, and around characters that no piece has,
which become byte pieces. Equal units of a chunk are segmented once, and all units of a
length advance together: at each end, hashes of the substrings that end there probe the
sorted piece keys, and the best sum of log probabilities keeps its piece as a backpointer.

The public vocabulary holds merge ranks, not probabilities, so a piece of rank r gets Zipf's
1 / (r + 2); the ids are the best segmentation under these, which need not be the one that
the merges give. Any ids decode to the same text by the library.

Defined cases: null and empty texts have no ids; a literal U+2581 decodes to a space; ids keep
the order of the text; a very long unit is segmented whole, in time in
proportion to its length; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeaudit.llm.words import Hasher, list_array, mix, texts

SPACE = 0x2581
SCREEN_BITS = 22
LONG = 512  # characters from which a unit is segmented by itself
KEPT_UNITS, KEPT_IDS = 1 << 20, 1 << 23  # of the units that a worker keeps segmented
_U = np.uint64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + _U(1))


@dataclass
class Vocabulary:
    keys: np.ndarray  # sorted hashes of the normal pieces
    ids: np.ndarray  # their ids
    logp: np.ndarray
    longest: int
    alphabet: np.ndarray  # sorted code points of the pieces
    byte_id: np.ndarray  # id of each byte piece
    data: np.ndarray  # bytes of all pieces by id, U+2581 as a space
    at: np.ndarray  # where each id's bytes start; one more at the end
    screen: np.ndarray

    @classmethod
    @cache
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        byte_id, out, normal = np.full(256, -1), [], []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_id[int(piece[1:-1], 16)] = i
                out.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                out.append(b"")
            else:
                normal.append((-sp.get_score(i), i, piece))
                out.append(piece.replace(chr(SPACE), " ").encode())
        normal.sort()
        for _, _, piece in normal:
            if chr(SPACE) in piece.lstrip(chr(SPACE)):
                raise ValueError(f"piece {piece!r} crosses a space")
        codes = np.frombuffer("".join(p for *_, p in normal).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for *_, p in normal])
        h = Hasher(_values(codes))(np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(h)
        screen = np.zeros(1 << SCREEN_BITS, bool)
        screen[(h >> _U(64 - SCREEN_BITS)).astype(np.int64)] = True
        logp = -np.log(np.arange(len(normal)) + 2.0)
        return cls(h[order], np.array([i for _, i, _ in normal])[order], logp[order], max(len(p) for *_, p in normal),
                   np.unique(codes), byte_id, np.frombuffer(b"".join(out), np.uint8), np.cumsum([0, *map(len, out)]), screen)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... counts[k] of them, for each k in turn."""
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(starts - before, counts)


def segment(v: Vocabulary, span: Hasher, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of units of one length: entries of `v.keys` (-1: no piece) from the first on, and how many."""
    n = len(starts)
    unknown = v.logp.min() - 10
    score = np.full((length + 1, n), -np.inf)
    score[0] = 0
    piece = np.full((length + 1, n), -1, np.int32)
    width = np.ones((length + 1, n), np.int32)
    for end in range(1, length + 1):
        score[end] = score[end - 1] + unknown
        best = np.full(n, -np.inf)
        for w in range(min(v.longest, end), 0, -1):
            h = span(starts + end - w, starts + end)
            at = np.flatnonzero(v.screen[(h >> _U(64 - SCREEN_BITS)).astype(np.int64)])
            k = np.minimum(np.searchsorted(v.keys, h[at]), len(v.keys) - 1)
            ok = v.keys[k] == h[at]
            at, k = at[ok], k[ok]
            new = score[end - w, at] + v.logp[k]
            more = new > best[at]
            at, k = at[more], k[more]
            best[at] = new[more]
            piece[end, at], width[end, at] = k, w
        found = best > score[end]
        score[end, found] = best[found]
        piece[end, ~found], width[end, ~found] = -1, 1
    back = np.full((length, n), -2, np.int32)
    place, lane = np.full(n, length), np.arange(n)
    for step in range(length - 1, -1, -1):
        live = np.flatnonzero(place > 0)
        if not len(live):
            break
        back[step, live] = piece[place[live], lane[live]]
        place[live] -= width[place[live], lane[live]]
    used = back.T != -2
    return back.T[used], used.sum(axis=1)


def segment_long(v: Vocabulary, span: Hasher, start: int, length: int) -> np.ndarray:
    """As `segment`, of one long unit: all pieces that occur are found at once, then joined from left to right."""
    ends, widths, pieces = [], [], []
    for w in range(min(v.longest, length), 0, -1):
        begin = np.arange(start, start + length - w + 1)
        h = span(begin, begin + w)
        at = np.flatnonzero(v.screen[(h >> _U(64 - SCREEN_BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(v.keys, h[at]), len(v.keys) - 1)
        ok = v.keys[k] == h[at]
        ends.append(at[ok] + w)
        widths.append(np.full(int(ok.sum()), w))
        pieces.append(k[ok])
    end, width, piece = (np.concatenate(x) for x in (ends, widths, pieces))
    order = np.argsort(end, kind="stable")  # at each end the longest first
    bounds = np.searchsorted(end[order], np.arange(length + 2)).tolist()
    width, piece, logp = width[order].tolist(), piece[order].tolist(), v.logp[piece[order]].tolist()
    unknown = float(v.logp.min() - 10)
    score, back = [0.0] * (length + 1), [-1] * (length + 1)
    for e in range(1, length + 1):
        best, chosen = -np.inf, -1
        for m in range(bounds[e], bounds[e + 1]):
            new = score[e - width[m]] + logp[m]
            if new > best:
                best, chosen = new, m
        plain = score[e - 1] + unknown
        score[e], back[e] = (best, chosen) if best > plain else (plain, -1)
    out, e = [], length
    while e > 0:
        m = back[e]
        out.append(piece[m] if m >= 0 else -1)
        e -= width[m] if m >= 0 else 1
    return np.array(out[::-1], np.int64)


class Solved:
    """Units that a worker has segmented: sorted hashes with the place and number of their ids."""

    def __init__(self):
        self.keys, self.place, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def full(self) -> bool:
        return len(self.keys) > KEPT_UNITS or len(self.ids) > KEPT_IDS

    def missing(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        return self.keys[at] != h if len(self.keys) else np.ones(len(h), bool)

    def add(self, h: np.ndarray, counts: np.ndarray, place: np.ndarray, ids: np.ndarray) -> None:
        keys = np.concatenate([self.keys, h])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.place = np.concatenate([self.place, place + len(self.ids)])[order]
        self.count = np.concatenate([self.count, counts])[order]
        self.ids = np.concatenate([self.ids, ids])


@cache
def _solved(path: str) -> Solved:
    return Solved()


def encode_texts(v: Vocabulary, data: bytes, offsets: np.ndarray, solved: Solved | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and the count of each; text r is data[offsets[r]:offsets[r + 1]].

    `solved` keeps segmented units from one call to the next.
    """
    solved = Solved() if solved is None else solved
    buf = np.frombuffer(data, np.uint8)
    chars_before = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
    plain = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.diff(chars_before)
    filled = (n > 0).astype(np.int64)
    first = chars_before[:-1] + np.cumsum(filled) - filled  # each filled text's place, with its space in front
    codes = np.full(len(plain) + int(filled.sum()), SPACE, np.uint32)
    codes[ragged(first + filled, n)] = plain
    codes[codes == 0x20] = SPACE
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(n), np.int64)

    known = v.alphabet[np.minimum(np.searchsorted(v.alphabet, codes), len(v.alphabet) - 1)] == codes
    space = codes == SPACE
    new = ~known
    new[0] = True
    new[1:] |= ~known[:-1] | (space[1:] & ~space[:-1])
    new[first[n > 0]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(codes))
    span = Hasher(_values(codes))
    h, at, which = np.unique(span(starts, ends), return_index=True, return_inverse=True)
    new = solved.missing(h)
    if new.any():
        if solved.full():  # start anew; what is met again is segmented again
            solved.__init__()
            new[:] = True
        solved.add(h[new], *_segment_units(v, span, codes, starts[at[new]], (ends - starts)[at[new]]))
    unit = np.searchsorted(solved.keys, h)[which]
    counts = solved.count[unit]
    out = solved.ids[ragged(solved.place[unit], counts)]
    per_unit = np.concatenate([[0], np.cumsum(counts)])
    text_start = np.searchsorted(starts, np.append(first, len(codes)))
    return out, np.diff(per_unit[text_start])


def _segment_units(
    v: Vocabulary, span: Hasher, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each unit the number of its ids and their place in the array of all."""
    counts, place, parts, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), [], 0
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        length = int(lengths[group[0]])
        # Lanes of a group are cut so that the tables stay small.
        size = 1 if length >= LONG else max(1, 4_000_000 // (length + 1))
        for part in (group[k : k + size] for k in range(0, len(group), size)):
            if length >= LONG:
                pieces = segment_long(v, span, int(starts[part[0]]), length)
                used = np.array([len(pieces)])
            else:
                pieces, used = segment(v, span, starts[part], length)
            if (pieces < 0).any():  # single characters without a piece, as their bytes
                ids = [[v.ids[k]] if k >= 0 else v.byte_id[list(chr(c).encode("utf-8", "surrogatepass"))]
                       for c, k in zip(codes[starts[part]].tolist(), pieces.tolist())]
                pieces, used = np.concatenate(ids), np.array([len(x) for x in ids])
            else:
                pieces = v.ids[pieces]
            parts.append(pieces)
            counts[part] = used
            place[part] = total + np.cumsum(used) - used
            total += len(pieces)
    return counts, place, np.concatenate(parts).astype(np.int32)


def decode_ids(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in order, without the space in front, and the start of each."""
    size = (v.at[1:] - v.at[:-1])[ids]
    data = v.data[ragged(v.at[ids], size)]
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    lead = ends[:-1][np.diff(ends) > 0]
    lead = lead[data[lead] == 0x20]
    keep = np.ones(len(data), bool)
    keep[lead] = False
    return data[keep], ends - np.searchsorted(lead, ends)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`(doc_id, n_pieces, ids)` of every row."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(path)
        for batch in batches:
            for chunk in texts(batch):
                ids, counts = encode_texts(v, chunk.buf.tobytes(), chunk.offsets, _solved(path))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(chunk.lo, chunk.hi - chunk.lo), pa.array(counts), list_array(ids, counts, pa.int32())],
                    ["doc_id", "n_pieces", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """`encoded` with `text`, the text of its `ids` (null: empty)."""
    path = path or default_path()
    schema = encoded.drop("text").schema.add("text", "string")
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                lists = part.column("ids")
                counts = np.array(lists.value_lengths().fill_null(0), np.int64)
                data, at = decode_ids(v, np.array(lists.flatten(), np.int64), counts)
                raw = data.tobytes()
                text = pa.array([raw[a:z].decode("utf-8", "replace") for a, z in zip(at[:-1], at[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], text], [*names, "text"])

    return encoded.select(*names).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`(doc_id, n_pieces, ids, n_chars, text_crc32)`: each text's ids, and length and crc of what they decode to.

    Ids are decoded where they are made, so only they leave the task.
    """
    path = path or default_path()
    names = ["doc_id", "n_pieces", "ids", "n_chars", "text_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(path)
        for batch in batches:
            for chunk in texts(batch):
                ids, counts = encode_texts(v, chunk.buf.tobytes(), chunk.offsets, _solved(path))
                data, at = decode_ids(v, ids.astype(np.int64), counts)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
                raw = memoryview(data.tobytes())
                crc = [zlib.crc32(raw[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(chunk.lo, chunk.hi - chunk.lo), pa.array(counts), list_array(ids, counts, pa.int32()),
                    pa.array(np.diff(chars)), pa.array(crc, pa.int64())], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_pieces long, ids array<int>, n_chars long, text_crc32 long")
