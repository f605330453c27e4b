"""Operators against plain versions, and on awkward rows."""

import os
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from codeaudit.llm import decontaminate, htmltext, jaccard, linededup, lmscore, pieces, quality, tokencounts, tokenfile, urlfilter
from codeaudit.llm.catalog import QUERIES
from codeaudit.llm.oracle import ORACLE
from codeaudit.llm.words import span_hashes, texts as chunks
from codeaudit.storage import DROP_SHUFFLES, materialize, scratch_path

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_key string, dropped string, component_id string, n_words string"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
PROSE = "\n".join(" ".join(f"w{k}{i}" for i in range(25)) for k in range(4))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, "en", "a"), (4, "", None, None),
        (5, " \n\t ", "en", None), (6, LONG, "en", "a"), (None, PROSE, None, "a"), (7, "one two", "en", "a"), (8, "one  two", "en", "a"), (None, None, None, None)]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z", "v") for r in rows], DOCS)


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.where("false")


def texts(folder=FOLDER):
    return sorted((r["doc_id"], r["text"] or "") for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    expected = duck.execute(ORACLE[name])
    columns = [c[0] for c in expected.description]
    got = sorted((tuple(r) for r in QUERIES[name](spark, FOLDER).select(*columns).collect()), key=str)
    assert got == sorted(expected.fetchall(), key=str)


def test_quality_awkward(awkward, nothing):
    rows = quality.judge(awkward).collect()
    assert len(rows) == 11 and quality.judge(nothing).count() == 0
    by = {(r.doc_id, r.lang): r for r in rows}
    assert by[3, "en"].n_words == 0 and by[3, "en"].base_failed and by[6, "en"].n_words == 30_000
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_banded_automaton():
    rng = np.random.default_rng(5)
    pairs = []
    for _ in range(400):
        x = list(rng.integers(1, 5 if rng.random() < 0.5 else 50, rng.integers(5, 60)))
        y = list(x)
        for _ in range(rng.integers(0, 5)):
            k = int(rng.integers(len(y)))
            y[k : k + int(rng.integers(2))] = list(rng.integers(1, 50, int(rng.integers(2))))
        pairs.append(sorted((x, y), key=len))
    got = linededup.within([np.array(x, np.uint64) for x, _ in pairs], [np.array(y, np.uint64) for _, y in pairs])
    tier = lambda n: 0 if n < 10 else 1 if n < 20 else 2 if n < 40 else 3
    assert got.tolist() == [edit_distance(x, y) <= tier(len(y)) for x, y in pairs]


def test_line_keys():
    """Lines within their tolerance meet under a key that one indexes and the other probes; a line of 60 words has 24 keys, not 30."""
    rng = np.random.default_rng(7)

    def keys(w):
        sides = [set(), set()]
        for _, found, side in linededup._keys(np.array(w, np.uint64), np.array([0]), np.array([len(w)])):
            for key, s in zip(found.tolist(), np.broadcast_to(side, len(found)).tolist()):
                for one in {0: [0], 1: [1], 2: [0, 1]}[s]:
                    sides[one].add(key)
        return sides

    for n in [*range(8, 24), *range(36, 44), 60] * 12:
        x = rng.integers(1, 2**40, n).tolist()
        y = list(x)
        for _ in range(int(linededup.tolerance(np.array([n]))[0])):
            k = int(rng.integers(len(y)))
            y[k : k + int(rng.integers(2))] = rng.integers(1, 2**40, int(rng.integers(2))).tolist()
        if x != y and linededup.within(*([np.array(v, np.uint64)] for v in sorted((x, y), key=len)))[0]:
            (ix, px), (iy, py) = keys(x), keys(y)
            assert ix & py or iy & px
    assert sum(len(k) for _, k, _ in linededup._keys(np.arange(60, dtype=np.uint64) + np.uint64(1), np.array([0]), np.array([60]))) == 24


def test_line_keys_shared(spark):
    """Keys of one line or one side go, in whatever batch they come; others stay whole."""
    rows = [(k, 10 * k + n, side) for k in range(40) for n, side in enumerate(((2, 2), (0, 0), (0, 1, 1), (2,), (1, 1), (0, 2))[k % 6])]
    rows += [(50, 7, side) for side in (0, 1, 2)]
    keys = spark.createDataFrame(rows, "key long, line long, side byte").repartition(3)
    got = {tuple(r) for r in linededup._shared(keys).coalesce(1).collect()}
    good = {r for r in rows if r[0] % 6 in (0, 2, 5) and r[0] < 50}
    assert good <= got and len(got - good) < len(set(rows) - good)
    assert linededup._shared(keys.where("false")).count() == 0
    docs = spark.createDataFrame([(1, PROSE)], "doc_id long, text string")
    assert linededup._words_of(docs, keys.select("line").where("false")).count() == 0


def test_span_hashes():
    """Spans of one length and content have one hash, all others have another."""
    parts = [b"a", b"a\0", b"12345678", b"12345678\0", b"123456781234567812345678", b"1234567812345678", b"a", b"12345678", "\u00e9\u4e16".encode()]
    buf, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    got = span_hashes(buf, ends - [len(p) for p in parts], ends)
    assert all((x == y) == (p == q) for x, p in zip(got, parts) for y, q in zip(got, parts))
    assert len(span_hashes(buf[:0], ends[:0], ends[:0])) == 0


def test_lines(spark):
    got = {r.doc_id: (r.n_lines, r.dropped) for r in QUERIES["op1_line_dedup"](spark, FOLDER).collect()}
    seen, tier = {}, lambda n: 0 if n < 10 else 1 if n < 20 else 2 if n < 40 else 3
    for doc, text in texts():
        gone = []
        for k, line in enumerate(text.split("\n")):
            w = tuple(words(line))
            if not w:
                continue
            near = w in seen or any(
                len(set(w) & set(v)) > len(set(v)) - 5 and edit_distance(w, v) <= tier(max(len(w), len(v)))
                for n in range(len(w) - 3, len(w) + 4) for v in seen.get(n, ()))
            if near:
                gone.append(k)
            seen.setdefault(len(w), []).append(w)
            seen[w] = True
        assert got[doc] == (len(text.split("\n")), gone)


def test_lines_planted(spark):
    """Short exact copies go; long lines with up to three edits go, with four they stay."""
    line = lambda k, n: [f"l{k}w{i}" for i in range(n)]
    rows, gone = [(0, "All rights reserved\n" + "\n".join(" ".join(line(k, 60)) for k in range(8)))], {}
    for k in range(8):
        w = line(k, 60)
        for at in range(k):
            w[7 * at + 2 : 7 * at + 2 + (at % 3 < 2)] = ([], ["new"], ["more"])[at % 3]
        rows.append((k + 1, " ".join(w) + "\nown words here " + str(k)))
        gone[k + 1] = [0] if k <= 3 else []
    rows.append((20, "something else\nAll rights reserved"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("a")})
    got = {r.doc_id: r.dropped for r in linededup.drops(docs).collect()}
    assert got == {0: [], 20: [1], **gone}


def test_lines_awkward(awkward, nothing):
    kept = linededup.drop_lines(awkward)
    assert kept.columns == awkward.columns and linededup.drop_lines(nothing).count() == 0
    # The null doc_id comes first; later copies lose all their lines and go, equal rows together.
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect() if r.text == PROSE) == [(0, PROSE)]
    # Lines are sequences of words, so document 8 copies the only line of document 7.
    assert {r.doc_id for r in kept.collect()} == {None, 3, 4, 5, 6, 7}


def test_jaccard(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op5_ngram_jaccard_join"](spark, FOLDER).collect()}
    sets, parent = {}, {}
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for doc, text in texts():
        w = words(text.translate(low))
        sets[doc] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}
        parent[doc] = doc

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert got == {d: (len(s), root(d)) for d, s in sets.items()}


def test_jaccard_awkward(awkward, nothing):
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_components(awkward).collect()]
    assert sorted(rows, key=str) == sorted([
        (1, 96, 1), (1, 96, 1), (2, 96, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 29_996, 6), (None, 96, None), (7, 1, 7), (8, 1, 7), (None, 0, None)], key=str)
    kept = jaccard.keep_first(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 1, 3, 4, 5, 6, 7]
    assert jaccard.near_components(nothing).count() == 0


def test_jaccard_row_order(spark):
    """The smallest doc_id leads, whichever row of a batch comes first; a first row without a doc_id hides no copy."""
    other = " ".join(f"o{i}" for i in range(60))
    near = f"{other} x"
    rows = [(10, PROSE), (5, PROSE), (7, PROSE), (None, other), (30, other), (20, other), (12, near), (40, "alone it stands here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard.near_components(docs).collect()}
    assert got == {10: 5, 5: 5, 7: 5, None: None, 30: 12, 20: 12, 12: 12, 40: 40}
    assert sorted((r.doc_id or 0) for r in jaccard.keep_first(docs).collect()) == [0, 5, 12, 40]


def test_tiles(spark):
    """Many sets under one shingle that no star joins all meet in tiles."""
    shared = " ".join(f"c{i}" for i in range(40))
    rows = [(i, f"{shared} " + " ".join(f"u{i}x{k}" for k in range(100)), "en", "a", 0) for i in range(1, 700)]
    rows += [(1000 + i, f"{shared} " + " ".join(f"u{i}x{k}" for k in range(97)), "en", "a", 0) for i in range(600, 700)]
    got = {r.doc_id: r.component_id for r in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got == {i: i % 1000 for i in got}


def test_tiles_hold_no_pairs(spark, monkeypatch):
    """Sets that share two thirds, or nearly three quarters, of a passage never link; rows stay in proportion to sets."""
    made = {}
    for each, own in ((64, 32), (64, 24)):
        for n in (100, 400):
            shared = " ".join(f"c{i}" for i in range(each + 4))
            rows = [(i, f"{shared} " + " ".join(f"u{i}x{k}" for k in range(own))) for i in range(n)]
            rows += [(10_000 + i, f"{rows[i][1]} tail") for i in range(0, n, 10)]
            kept = {}

            def spy(df, label):
                out = materialize(df, label)
                kept[label] = kept.get(label, 0) + out.count()
                return out

            monkeypatch.setattr(jaccard, "materialize", spy)
            got = {r.doc_id: r.component_id for r in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
            assert got == {i: i % 10_000 for i in got}
            made[each, own, n] = max(v for k, v in kept.items() if k != "jaccard-sets")
    for each, own in ((64, 32), (64, 24)):
        assert made[each, own, 400] <= 5 * made[each, own, 100] and made[each, own, 400] < 4000


def test_jaccard_leaves_no_shuffles(spark, monkeypatch):
    """Shuffle files go with their step, only sets in question are shuffled, and the session's settings come back."""
    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(60 + i % 2))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {name for d in manager.localDirs() for _, _, names in os.walk(d.getPath()) for name in names if name.startswith("shuffle_")}

    before = shuffles()
    result = jaccard.near_components(docs)
    deadline = time.time() + 10
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get(DROP_SHUFFLES, None) is None
    whole = sorted(map(tuple, result.collect()))
    assert {r[0]: r[2] for r in whole} == {i: i // 2 * 2 for i in range(200)}
    some = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, n string")
    ids = spark.createDataFrame([(2,), (2,)], "doc_id long")
    assert [tuple(r) for r in jaccard._only(some, ids).collect()] == [(2, "b")]
    monkeypatch.setattr(jaccard, "SENT_IDS", 0)
    assert jaccard._only(some, ids).count() == 2
    assert sorted(map(tuple, jaccard.near_components(docs).collect())) == whole


def test_tile_links_against_pairs(spark, monkeypatch):
    """Small tiles by number and by bytes find the links that all pairs have."""
    rng = np.random.default_rng(6)
    words_ = [[f"w{i}" for i in rng.integers(0, 40, 30)] for _ in range(4)]
    rows = []
    for i in range(150):
        w = list(words_[i % 4])
        for k in rng.integers(0, 30, rng.integers(0, 4)):
            w[k] = f"z{rng.integers(0, 30)}"
        rows.append((i, " ".join(w) + " end" * int(rng.integers(0, 3))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, jaccard.near_components(docs).collect()))
    monkeypatch.setattr(jaccard, "STARS", 0)
    for tile, size in ((512, 8 << 20), (7, 8 << 20), (512, 512 * 8)):
        monkeypatch.setattr(jaccard, "TILE", tile)
        monkeypatch.setattr(jaccard, "TILE_BYTES", size)
        assert sorted(map(tuple, jaccard.near_components(docs).collect())) == whole


def test_contamination(spark, awkward, nothing):
    docs, items = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.passages(docs, items).collect()}
    flat = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())) + " "
    exact = {(d, r.item_id) for r in items.collect() for d, t in texts() if flat(r.text) in flat(t)}
    assert exact and exact <= got and len(got) <= 1.1 * len(exact)
    own = spark.createDataFrame([(1, " ".join(f"w2{i}" for i in range(25))), (2, None), (3, ""), (None, "x y")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.distance) for r in decontaminate.passages(awkward, own).collect()} == {(1, 1, 0), (2, 1, 0), (None, 1, 0)}
    kept = decontaminate.drop_contaminated(awkward, own)
    assert kept.columns == awkward.columns and kept.count() == 7
    assert decontaminate.passages(nothing, own).count() == 0 and decontaminate.passages(awkward, own.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["changed", "added", "left out", "mixed"])
@pytest.mark.parametrize("shortest, longest", [(12, 15), (16, 30), (31, 70)])
def test_contamination_recall(kind, shortest, longest):
    """Items with a fifth of their words edited, by kind of edit and length, in random surroundings."""
    rng = np.random.default_rng(shortest)
    draw = lambda k: rng.integers(1, 2**62, k).astype(np.uint64)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(int(rng.integers(shortest, longest + 1))))) for i in range(150)]
    index = decontaminate.Index.build(items)
    edits = {"changed": (1, 1), "added": (0, 1), "left out": (1, 0)}
    hit = whole = 0
    for i, w in enumerate(index.words):
        v = list(w)
        for k in sorted(rng.choice(len(w), int(0.2 * len(w)), replace=False).tolist(), reverse=True):
            gone, new = edits[kind] if kind in edits else list(edits.values())[int(rng.integers(3))]
            v[k : k + gone] = draw(new)
        around = draw(int(rng.integers(50))), draw(int(rng.integers(50)))
        for n, part in enumerate((w, np.array(v, np.uint64))):
            text = np.concatenate([around[0], part, around[1]])
            found = any(x[1] == i for x in index.hits(text, np.array([0, len(text)])))
            whole, hit = whole + (n == 0 and found), hit + (n == 1 and found)
    print(f"recall, {kind}, {shortest} to {longest} words: {hit / len(items):.3f}")
    assert whole == len(items) and hit / len(items) >= 0.9


def test_contamination_short_items():
    """Every item of 1 to 11 words is found at each place, with as many edits of all three kinds as are allowed."""
    rng = np.random.default_rng(4)
    draw = lambda k: rng.integers(1, 2**62, k).astype(np.uint64)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(1 + i % 11))) for i in range(44)]
    index = decontaminate.Index.build(items)
    for i, w in enumerate(index.words):
        for lead in range(9):
            for edits in range(int(0.2 * len(w)) + 1):
                for kind in range(3):
                    v = list(w)
                    for k in sorted(rng.choice(len(v), edits, replace=False), reverse=True):
                        v[k : k + (kind != 1)] = [] if kind == 2 else draw(1)
                    text = np.concatenate([draw(lead), np.array(v, np.uint64), draw(12)])
                    bounds = np.array([0, 5, 5, 5 + len(text)])
                    got = [x for x in index.hits(np.concatenate([draw(5), text]), bounds)]
                    assert [(r, x) for r, x, *_ in got] == [(2, i)] and got[0][4] <= edits
    # A passage does not run from one text into the next.
    assert not list(index.hits(index.words[2], np.array([0, 2, 3])))


def test_pieces(spark, awkward, nothing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    rows = pieces.decode(pieces.encode(spark.read.parquet(f"{FOLDER}/documents.parquet"))).collect()
    by = dict(texts())
    assert len(rows) == len(by)
    for r in rows:
        assert r.text == by[r.doc_id] and sp.decode(list(r.ids)) == by[r.doc_id]
    assert sorted((r.doc_id or 0, r.n_pieces) for r in pieces.encode(awkward).collect() if (r.doc_id or 0) in (3, 4)) == [(3, 0), (4, 0)]
    assert pieces.round_trip(nothing).count() == 0


def test_units_that_are_kept_and_long_units(monkeypatch):
    """Ids do not depend on what a worker has kept, nor on the way that long units are segmented."""
    v = pieces.Vocabulary.load(pieces.default_path())
    rng = np.random.default_rng(9)
    some = ["the", "strasse", "naïve", "x" * 700, "abc" * 300, "日本語", "a\tb", "", "q\u2581z", "".join(chr(rng.integers(97, 123)) for _ in range(3000))]
    kept = pieces.Solved()
    for k in range(12):
        if k == 6:
            monkeypatch.setattr(pieces, "KEPT_UNITS", 5)
        docs = [" ".join(some[i] for i in rng.integers(0, len(some), 6)).encode() for _ in range(4)]
        at = np.cumsum([0, *map(len, docs)])
        with monkeypatch.context() as short:
            short.setattr(pieces, "LONG", 1 << 30)
            plain = pieces.encode_texts(v, b"".join(docs), at)
        for got in (pieces.encode_texts(v, b"".join(docs), at, kept), pieces.encode_texts(v, b"".join(docs), at)):
            assert all(np.array_equal(x, y) for x, y in zip(got, plain))


def test_a_word_of_a_megabyte(spark):
    import time

    word = "".join(chr(c) for c in np.random.default_rng(2).integers(97, 123, 1_000_000))
    start = time.perf_counter()
    row = pieces.round_trip(spark.createDataFrame([(1, word)], "doc_id long, text string")).first()
    assert (row.n_chars, row.text_crc32) == (len(word), zlib.crc32(word.encode())) and time.perf_counter() - start < 60


def test_pieces_awkward(spark, awkward):
    got = pieces.round_trip(awkward).collect()
    expected = [(r.doc_id, len(r.text or ""), zlib.crc32((r.text or "").encode())) for r in awkward.collect()]
    assert sorted(((r.doc_id, r.n_chars, r.text_crc32) for r in got), key=str) == sorted(expected, key=str)
    assert all(r.n_pieces == len(r.ids) for r in got)


def test_viterbi_is_best():
    v = pieces.Vocabulary.load(pieces.default_path())
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    cost = {sp.id_to_piece(int(i)): float(p) for i, p in zip(v.ids, v.logp)}
    for text in ("Hello  world", "naïve 日本 🙂\t ok", " lead", "x" * 40, "internationalisation\nof"):
        raw = text.encode()
        ids, _ = pieces.encode_texts(v, raw, np.array([0, len(raw)]))
        whole = "\u2581" + text.replace(" ", "\u2581")
        best = [0.0] + [-1e9] * len(whole)
        for end in range(1, len(whole) + 1):
            best[end] = max([best[end - 1] + float(v.logp.min()) - 10, *(best[s] + cost[whole[s:end]] for s in range(max(0, end - 16), end) if whole[s:end] in cost)])
        unknown = len([c for c in whole if c not in cost])
        got = sum(cost[sp.id_to_piece(i)] for i in ids.tolist() if not sp.is_byte(i)) + unknown * (float(v.logp.min()) - 10)
        assert got == pytest.approx(best[-1])


def test_token_files(spark, awkward, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenfile.default_path())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op7_token_id_output"](spark, FOLDER).collect()}
    at = 0
    for doc, text in texts():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert got[doc] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    rows = tokenfile.round_trip(awkward).orderBy("start").collect()
    assert len(rows) == 11 and [r.doc_id for r in rows] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert {r.doc_id: r.n_tokens for r in rows}[3] == 1
    assert tokenfile.round_trip(nothing).count() == 0


def test_word_encoder():
    """Words cut into letters and punctuation have the ids of their whole text."""
    encoder = tokenfile.WordEncoder(tokenfile.default_path())
    draw = np.random.default_rng(7)
    odd = ["a.<|endoftext|>b", "<|ENDOFTEXT|>", "İstanbul. x", "don't. can't's. a'.b. 'S 'Tx.", "H\u0331. KK, \u0338= é.", "٢a. ²a²..", "", " \n"]
    odd += ["".join(draw.choice(list("aB'.<|> \nİé\u0301sS9\xa0,\t!"), 40)) for _ in range(1000)]
    want = encoder.tokenizer.encode_batch(odd, add_special_tokens=False)
    for k in range(2):  # the second time words are known
        got = []
        for chunk in chunks(pa.RecordBatch.from_pydict({"text": odd})):
            ids, bounds = encoder.encode(chunk)
            got += [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:])]
        assert got == [x.ids for x in want]
        encoder.known = {"": b""}


def test_token_words_share_heads():
    """Case and closing punctuation make no new words; letters outside ASCII are encoded with the others."""
    text = "house HOUSE House, house. (house house!? Été été, ÉTÉ. ×é. don't DON'T, a<|b. ét, Straße,"
    encoder = tokenfile.WordEncoder(tokenfile.default_path())
    for chunk in chunks(pa.RecordBatch.from_pydict({"text": [text, None, "house."]})):
        ids, bounds = encoder.encode(chunk)
        want = encoder.tokenizer.encode_batch([text, "", "house."], add_special_tokens=False)
        assert [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:])] == [x.ids for x in want]
        # house , . (house !? été ×é don't a<|b. ét straße
        assert len(encoder.met.keys) == 11


def test_code_lengths():
    rng = np.random.default_rng(2)
    counts = (rng.pareto(0.6, 500) * 10 + 1).astype(np.int64)
    for limit in (9, 12, 20):
        lengths = tokenfile.code_lengths(counts, limit)
        assert lengths.max() <= limit and (0.5**lengths).sum() == pytest.approx(1)
        ids = rng.integers(0, 500, 3000)
        payload, marks = tokenfile.pack(ids, lengths, tokenfile.canonical(lengths))
        assert (tokenfile.Decoder(lengths).unpack(payload, marks, 3000) == ids).all()


def test_ledger(spark):
    root = scratch_path(spark, "test-ledger")
    schema = "doc_id long, source string, lang string, tokenizer string, n_tokens long"
    send = lambda name, rows: tokencounts.commit(spark, root, name, spark.createDataFrame(rows, schema))
    assert send("1", [(1, "a", "en", "t", 10), (1, "a", "en", "t", 10), (2, "a", None, "t", 5), (None, "a", "en", "t", 1)])
    assert send("2", [(1, "b", "en", "t", 7), (2, "a", None, "t", None), (9, "a", "en", "t", None)])
    assert not send("2", [(1, "b", "en", "t", 99)])
    assert send("3", [])
    assert sorted(tuple(r) for r in tokencounts.totals(spark, root).collect()) == [("a", "en", "t", 1, 1), ("b", "en", "t", 1, 7)]


def test_scores(spark, awkward, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    trained = lmscore.good_documents(labels.where("doc_id % 2 = 0"))
    score = {r.doc_id: r.score for r in lmscore.score(docs, trained).collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    good, bad = ([score[r.doc_id] for r in held if r.quality == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.9
    rows = lmscore.score(awkward, awkward.where("doc_id = 1")).collect()
    assert len(rows) == 11 and all(r.score == 0 and r.n_words == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert lmscore.score(nothing, nothing).count() == 0


def test_scores_are_exact(spark):
    """More words than any fixed vocabulary, and bigrams that share no count."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{i}x{k} " + " ".join(f"c{x}" for x in rng.integers(0, 400, 3)) for k in range(200))) for i in range(400)]
    rows += [(400, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.loss_target, r.loss_background) for r in lmscore.score(docs, docs.where("doc_id % 4 = 0"), unit_words=20_000, bucket_keys=30_000).collect()}
    models = []
    for use in (lambda d: d is not None and d % 4 == 0, lambda d: True):
        word, context, both = Counter(), Counter(), Counter()
        for d, t in rows:
            if use(d):
                w = words(t)
                word.update(w), context.update([None, *w[:-1]]), both.update(zip([None, *w[:-1]], w))
        models.append((word, context, both, sum(word.values())))
    types, scale = len(models[1][0]) + 2, models[0][3] / models[1][3]
    assert types > 65_538 and len(got) == len(rows)
    for d, t in rows[::40] + rows[-2:]:
        w, means = words(t), []
        for (word, context, both, n), s in zip(models, (1, scale)):
            likely = [(both[p] * s + 50 * (word[p[1]] * s + 1) / (n * s + types)) / (context[p[0]] * s + 50) for p in zip([None, *w[:-1]], w)]
            means.append(-float(np.log(likely).mean()))
        assert got[d] == (len(w), pytest.approx(means[0], abs=2e-6), pytest.approx(means[1], abs=2e-6))


PAGE = '<html><body><nav><a>Menu</a></nav><div id="top">Fixed words</div><div class="c"><p>{}</p><p>{}<ul><li>x<li>y</ul></div><div class="comments">No</div></body></html>'


def test_html(spark):
    blocks = htmltext.main_text(PAGE.format("One &amp; two", "br<br>eak"))
    assert blocks == "Fixed words\nOne & two\nbr eak\nx\ny"
    assert htmltext.main_text('<article><script>"</p>"</script><p> a\n b</p><aside>n</aside></article><p>out</p><foot') == "a b"
    rows = [(i, f"http://h.example/{i}", PAGE.format(f"own text {i}", f"more of the text {i}")) for i in range(6)]
    rows += [(7, None, None), (8, "", ""), (0, "http://h.example/0", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in htmltext.extract(pages).collect()))
    own = "own text 0\nmore of the text 0\nx\ny"
    assert [g[0] for g in got] == [0, 0, 1, 2, 3, 4, 5, 7, 8] and got[7:] == [(7, "", 0), (8, "", 0)]
    assert got[0] == got[1] and got[0][1].startswith(own.rsplit("\n", 2)[0]) and "Fixed" not in got[0][1]
    assert htmltext.extract(pages.where("false")).count() == 0


def test_html_whole_article(spark):
    """Headline and lead stand outside the element with most of the text, or every page has as many paragraphs."""
    text = lambda h, i: [f"Head {h} {i}", f"Lead of {h} {i}", *[f"Body {k} of {h} {i} " + "long " * 9 for k in range(3)]]
    shapes = {
        "body": "<article><h1>{}</h1><p>{}</p><div class='body w-1/2'><p>{}</p><p>{}</p><p>{}</p></div></article>",
        "flat": "<article><h1>{}</h1><h2>{}</h2><p>{}</p><p>{}</p><p>{}</p></article>",
        "plain": "<div class=post><h1>{}</h1><h2>{}</h2><p>{}</p><p>{}</p><p>{}</p></div>"}
    rows = [(10 * n + i, f"http://{h}.example/{i}", "<html><body><div id=top>Site</div>" + shape.format(*text(h, i)) + "</body></html>")
            for n, (h, shape) in enumerate(shapes.items()) for i in range(4)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {10 * n + i: "\n".join(x.strip() for x in text(h, i)) for n, h in enumerate(shapes) for i in range(4)}


def test_html_repeated_article(spark):
    """Copies of an article under other bylines, and pages with identical html, make no wording of its text."""
    page = "<html><body><div id=top>Site name</div><div class=c><p>By {}</p><p>{} one</p><p>{} two</p></div><div id=end>Imprint</div></body></html>"
    hosts = {"copied": ["shared", "shared", "shared", "own 3", "own 4"], "same": ["twin", "twin", "twin", "twin", "own 4", "own 5", "own 6"]}
    rows, want = [], {}
    for h, names in hosts.items():
        for i, name in enumerate(names):
            by = "them" if name == "twin" else f"{h} {i}"
            rows.append((len(rows), f"http://{h}.example/{i}", page.format(by, name, name)))
            want[rows[-1][0]] = f"By {by}\n{name} one\n{name} two"
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_urls(spark):
    urls = [
        "http://A.Example.org/es/1", "http://example.org/en/17?x", "https://x.org", "https://x.org/", "ftp://b.com/fr/2#f", "http://b.com/de/9", "http://com/de/",
        "no scheme", None, "", "http://notexample.org.net/es/", "x://?q", "http://b.com/fr/2#f"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).orderBy("page_id").collect()]
    assert got[:4] == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/17", "example.org/en/1", "block"), ("x.org", "", None, got[2][3]), ("x.org", "/", "org/", "allow")]
    assert [g[2] for g in got[4:]] == ["com/fr/", "com/de/", "com/de/", None, None, None, None, None, "com/fr/"]
    assert [g[:2] for g in got[7:10]] == [("", "")] * 3 and got[11][:2] == ("", "") and all(g[3] in ("allow", "block") for g in got)
    assert urlfilter.judge(pages.where("false")).count() == 0


def test_html_names_that_do_not_count():
    """Wrappers whose names speak of neighbours, pages in a form, parts of an article, teasers beside a story."""
    story = "<h1>Head</h1><p>First words.</p><p>More words.</p>"
    for wrapper in ('div class="content with-sidebar"', 'div class="share-enabled"', 'section id="research-search"', "form", 'div class="widget"'):
        page = f'<html><body><div class="banner">Site</div><{wrapper}>{story}</{wrapper.split()[0]}><div class="sidebar"><p>Else</p></div></body></html>'
        assert htmltext.main_text(page) == "Head\nFirst words.\nMore words.", wrapper
    inside = '<article><h1>H</h1><p class="notice-of-intent">Intent.</p><p class="notice">Cookies.</p></article>'
    assert htmltext.main_text(inside) == "H\nIntent."
    teasers = "".join(f"<article><h2>T{k}</h2><p>teaser {k}</p></article>" for k in range(3))
    assert htmltext.main_text(f'<body><div id="story">{story}</div>{teasers}</body>') == "Head\nFirst words.\nMore words."
    comments = '<article><h1>A</h1><p>b</p></article><div class="comments"><article><p>c1</p></article><article><p>c2</p></article></div>'
    assert htmltext.main_text(comments) == "A\nb"
    assert htmltext.main_text('<div class="comments"><p>only these</p></div>') == "only these"


def test_html_of_open_tags():
    """Unclosed tags cost memory in proportion to their number."""
    import tracemalloc

    page = '<div class="level">' * 50_000 + "<p>deep</p>" + "x" * 10
    tracemalloc.start()
    elements = Counter()
    blocks = htmltext.blocks_of(page, elements)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [b[1] for b in blocks] == ["deep", "x" * 10] and peak < 200 << 20 and sum(elements.values()) == 50_001


def test_counts_without_ids_or_texts(spark, tmp_path):
    """Rows without an id are documents of their own, as in the SQL, also when they are equal."""
    rows = [(None, "a b"), (None, "c d e"), (None, "a b"), (5, None), (6, None), (7, "x y\nx y"), (8, "x y\nx y"), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s" if i != 9 else None) for i, t in rows], "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = duck.execute(ORACLE["op2_token_counts"])
    columns = [c[0] for c in expected.description]
    got = tokencounts.rollup(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected.fetchall(), key=str)
    assert {(r.source, r.n_docs, r.n_tokens) for r in got if r.tokenizer == "words-1"} == {("s", 6, 9), (None, 1, 0)}
    root = scratch_path(spark, "ledger")
    change = spark.createDataFrame([(None, "s", "en", "v", 3), (None, "s", "en", "v", 3), (1, "s", "en", "v", 5)], "doc_id long, source string, lang string, tokenizer string, n_tokens long")
    for batch in ("a", "a", "b"):
        tokencounts.commit(spark, root, batch, change)
    assert [tuple(r) for r in tokencounts.totals(spark, root).select("n_docs", "n_tokens").collect()] == [(5, 17)]
