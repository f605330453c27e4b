"""The URL models and the pipeline's stages against plain versions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeaudit.llm import pieces, urlfilter
from codeaudit.llm.oracle import ORACLE
from codeaudit.storage import materialize

FOLDER = "/root/testdata/sf0.001"


def plain_ratios(urls):
    """Ratio of each url by its own dictionary models, and the threshold, from `(url, ruled verdict)`."""
    text = lambda u: re.sub(r"(?s)^.*?://", "", u or "", count=1).lower()
    counts = {c: defaultdict(Counter) for c in ("allow", "block")}

    def grams(t):
        whole = t + "\n"
        return [(whole[max(0, k - urlfilter.ORDER) : k], whole[k]) for k in range(len(whole))] if t else []

    for url, ruled in urls:
        if ruled:
            for context, char in grams(text(url)):
                for n in range(len(context) + 1):
                    counts[ruled][context[len(context) - n :]][char] += 1

    def chance(c, context, char):
        p = 1 / 256
        for n in range(len(context) + 1):
            seen = counts[c].get(context[len(context) - n :])
            if seen:
                p = (seen[char] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    usable = all(counts[c] for c in counts)
    ratios = []
    for url, _ in urls:
        found = grams(text(url)) if usable else []
        ratios.append(sum(math.log(chance("allow", *g)) - math.log(chance("block", *g)) for g in found) / len(found) if found else 0.0)
    if not usable:
        return ratios, 0.0
    ruled = [(math.floor(100 * round(r, 9)), v) for r, (_, v) in zip(ratios, urls) if v]
    share = Counter(v for _, v in ruled)
    wrong = lambda cut: sum((b < cut) / share[v] if v == "allow" else (b >= cut) / share[v] for b, v in ruled)
    return ratios, min(sorted({0, *(b for b, _ in ruled)}, key=abs), key=lambda c: round(wrong(c), 12)) / 100


@pytest.mark.parametrize("source", ["table", "made", "one class"])
def test_url_models_against_plain(spark, source):
    if source == "table":
        pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url")
    else:
        urls = [f"http://{h}/{p}/{n}" for n, (h, p) in enumerate([("a.org", "x"), ("b.com", "fr"), ("www.news.net", "story")] * 4)]
        urls += [None, "", "plain text", "HTTP://Shop.NET/Buy?now", "http://long.net/" + "ab/" * 3000, "http://long.net/" + "ab/" * 3000]
        urls += [f"http://{h}/{p}{n}" for n, (h, p) in enumerate([("shop.com", "de/buy-now"), ("example.org", "en/1"), ("cheap.com", "de/casino")] * 4)] if source == "made" else []
        pages = spark.createDataFrame([(n, u, "x", "y") for n, u in enumerate(urls)], "page_id long, url string, verdict string, text string")
    ruled = {r.page_id: r.ruled for r in urlfilter.with_rule(pages).collect()}
    rows = sorted(urlfilter.judge(pages).collect(), key=lambda r: r.page_id)
    urls = {r.page_id: r.url for r in pages.collect()}
    ratios, least = plain_ratios([(urls[r.page_id], ruled[r.page_id]) for r in rows])
    assert len(rows) == pages.count()
    for r, ratio in zip(rows, ratios):
        assert abs(r.ratio - ratio) < 1e-6, r
        expected = ruled[r.page_id] or ("allow" if round(ratio, 9) >= least else "block")
        assert r.verdict == expected or abs(ratio - least) < 1e-6


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def plain_lines(docs):
    """Texts without lines that copy or nearly copy an earlier one; documents that are left empty go."""
    tier = lambda n: 0 if n < 10 else 1 if n < 20 else 2 if n < 40 else 3
    seen, exact, out = defaultdict(list), set(), {}
    for doc in sorted(docs):
        kept = []
        for line in docs[doc].split("\n"):
            w = tuple(words(line))
            near = w in exact or any(
                len(set(w) & set(v)) > len(set(v)) - 5 and distance(w, v) <= tier(max(len(w), len(v)))
                for n in range(len(w) - 3, len(w) + 4) for v in seen.get(n, ()))
            if not w or not near:
                kept.append(line)
            if w and w not in exact:
                seen[len(w)].append(w)
                exact.add(w)
        if "\n".join(kept) == docs[doc] or words("\n".join(kept)):
            out[doc] = "\n".join(kept)
    return out


def plain_first(docs):
    """The smallest document of each group of near duplicates."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, group = {}, {}
    for doc, text in docs.items():
        w = words(text.translate(low))
        sets[doc] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}
        group[doc] = doc

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {doc for doc in docs if root(doc) == doc}


def test_pipeline_against_plain_stages(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, made = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        made.append(materialize(stage(spark, made[-1], FOLDER), f"test-{name}"))
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_duplicates", "benchmark_decontamination", "sentencepiece"]
    assert all(m.columns == columns for m in made[1:5])
    texts = [{r.doc_id: r.text or "" for r in m.select("doc_id", "text").collect()} for m in made[:5]]

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    kept = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({ORACLE['op8_quality_rules']}) WHERE kept").fetchall()}
    assert texts[1] == {d: t for d, t in texts[0].items() if d in kept}
    assert texts[2] == plain_lines(texts[1])
    assert all(r.n_chars == len(r.text) for r in made[2].collect())
    assert set(texts[3]) == plain_first(texts[2]) and all(texts[3][d] == texts[2][d] for d in texts[3])

    flat = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())) + " "
    items = [flat(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    holds = {d for d, t in texts[3].items() if any(i in flat(t) for i in items)}
    gone = set(texts[3]) - set(texts[4])
    # Passages with a few edits go as well; nothing else does.
    assert holds <= gone and len(gone) <= 1.2 * len(holds) + 2

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    rows = made[5].collect()
    assert {r.doc_id for r in rows} == set(texts[4])
    for r in rows:
        text = texts[4][r.doc_id]
        assert (r.n_pieces, r.n_chars, r.text_crc32) == (len(r.ids), len(text), zlib.crc32(text.encode())) and sp.decode(list(r.ids)) == text


def test_pipeline_awkward(spark):
    """Nulls, empty and repeated rows, and columns with other names go through every stage."""
    prose = "\n".join(" ".join(f"word{k}x{i}" for i in range(30)) + "." for k in range(4))
    rows = [(1, prose, "en", "a"), (1, prose, "en", "a"), (2, prose + " end", None, None), (None, prose, "en", "a"), (3, None, "en", "a"), (4, "", "de", "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "row", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row_key string, component_id int")
    for frame in (docs, docs.where("false")):
        at = frame
        for name, stage in corpus_pipeline.STAGES:
            at = materialize(stage(spark, at, FOLDER), f"awkward-{name}")
        found = at.select("doc_id").collect()
        assert {r.doc_id for r in found} <= {None, 1, 2} and (len(found) > 0) == (frame is docs)
    assert at.select(F.count("*")).first()[0] == 0
