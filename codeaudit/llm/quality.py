"""Quality rules: thresholds per language and source from mergeable quantile sketches.

A document's five rates are whole numbers. Per (language, source) their distribution is a
sketch: counts of bins with seven significant bits (relative error below 1/64), so sketches
of parts, sources or days merge by adding counts and never depend on how rows are placed.
A document is refused when a rate lies beyond the outer fence of its group: the upper
quartile plus three interquartile ranges, or plus the rate's own slack if that is more
(word length also below the lower fence). Groups under `min_group` documents take the
sketch of their language, the merged one of its sources.

Defined cases: a null text is the empty text and fails the base rules; null languages and
sources count as the empty name; repeated rows are judged alike; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from codeaudit.llm.tables import fresh, record, row_key
from codeaudit.llm.words import Chunk, Hasher, mix, texts, windows
from codeaudit.storage import materialize

#: Rate: numerator, denominator, scale, slack of the fence.
RATES = {
    "symbols": ("n_symbols", "n_words", 1000, 100),
    "length": ("word_chars", "n_words", 100, 150),
    "lines": ("n_dup_lines", "n_lines", 1000, 500),
    "repeats": ("n_repeat_words", "n_words", 1000, 300),
    "capitals": ("n_capitals", "word_chars", 1000, 150),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
MIN_WORDS = 50
MIN_GROUP = 200
BITS = 7

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    return out


def _counts(chunk: Chunk) -> dict[str, np.ndarray]:
    buf, offsets, n = chunk.buf, chunk.offsets, chunk.hi - chunk.lo

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[offsets])

    starts, ends = chunk.spans()
    bounds = chunk.per_row(starts)
    span_hash = Hasher(buf)
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    row = np.repeat(np.arange(n), np.diff(bounds))

    in_word = np.zeros(len(buf) + 1, np.int8)
    in_word[starts] = 1
    in_word[ends] -= 1
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)

    # Repeats: a window of three words of one text, seen twice, marks its three places.
    marked = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        key = windows(span_hash(starts, ends), 3) ^ salt[row[: len(row) - 2]]
        whole = np.flatnonzero(row[2:] == row[:-2])
        twice = whole[_repeated(key[whole])]
        for i in range(3):
            marked[twice + i] = True

    # Lines that hold a word; a text's end also ends its last line.
    breaks = np.flatnonzero(buf == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(buf)]
    line_end = np.concatenate([line_start[1:], [len(buf)]])[: len(line_start)]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.where((line_end > line_start) & (buf[line_end - 1] == 10), line_end - 1, line_end) if len(buf) else line_end
    filled = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_row = line_start[filled], line_end[filled], line_row[filled]
    again = _later(span_hash(line_start, line_end) ^ salt[line_row])
    return {
        "n_words": np.diff(bounds),
        "word_chars": per_text(in_word & ((buf & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOL[buf]),
        "n_dup_lines": np.bincount(line_row[again], minlength=n),
        "n_repeat_words": np.bincount(row[marked], minlength=n),
        "n_lines": np.bincount(line_row, minlength=n),
        "n_capitals": per_text(_CAPITAL[buf]),
    }


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """`keep` columns, the row key and the counts of every whole text, in one pass."""
    key = fresh("row_key", keep)
    rows = docs.select(*keep, row_key(docs).alias(key), "text")
    schema = rows.drop("text").schema
    for name in COUNTS:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_counts(c) for c in texts(batch)]
            if parts:
                found = {n: np.concatenate([p[n] for p in parts]) for n in COUNTS}
                yield record({c: batch.column(c) for c in [*keep, key]} | found, schema)

    return rows.mapInArrow(run, schema)


def base_failed(n_words: Column, repeats: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * repeats > 50 * n_words)


def with_rates(counts: DataFrame) -> DataFrame:
    """The counts with the base verdict, the rates and the group columns."""
    rates = {
        name: F.expr(f"coalesce(({scale} * {top}) div nullif({below}, 0), 0L)") for name, (top, below, scale, _) in RATES.items()}
    return counts.withColumns(rates | {
        "base_failed": base_failed(F.col("n_words"), F.col("n_repeat_words")),
        "group_lang": F.coalesce("lang", F.lit("")), "group_source": F.coalesce("source", F.lit("")),
    })


def sketch(rated: DataFrame) -> DataFrame:
    """Bin counts of each rate per language and source, over documents that pass the base rules."""
    value = F.col("value")
    low_bits = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return (
        rated.where(~F.col("base_failed")).select("group_lang", "group_source", *RATES)
        .unpivot(["group_lang", "group_source"], list(RATES), "rate", "value")
        .groupBy("group_lang", "group_source", "rate",
                 (value - value % F.pow(F.lit(2), low_bits).cast("long")).alias("bin"))
        .agg(F.count("*").alias("n")))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches summed over all groups that agree in `by`."""
    return sketches.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Per group and rate: document count, lower and upper fence."""
    group = Window.partitionBy(*by, "rate")
    ranked = sketches.withColumns({
        "upto": F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("n").over(group)})
    q1, q3 = (F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bin"))) for k in (1, 3))
    slack = F.lit(0)
    for name, (*_, least) in RATES.items():
        slack = F.when(F.col("rate") == name, least).otherwise(slack)
    reach = F.greatest(3 * (F.col("q3") - F.col("q1")), slack)
    return (
        ranked.groupBy(*by, "rate").agg(F.max("total").alias("n_docs"), q1.alias("q1"), q3.alias("q3"))
        .select(*by, "rate", "n_docs",
                F.when(F.col("rate") == "length", F.col("q1") - reach).otherwise(F.lit(-1)).alias("least"),
                (F.col("q3") + reach).alias("most")))


def thresholds(sketches: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per language and source with `<rate>_least` and `<rate>_most`."""
    own = fences(sketches, ["group_lang", "group_source"])
    wide = fences(merge(sketches, ["group_lang"]), ["group_lang"])
    wide = wide.select("group_lang", "rate", F.col("least").alias("wide_least"), F.col("most").alias("wide_most"))
    small = F.col("n_docs") < min_group
    both = own.join(wide, ["group_lang", "rate"]).withColumns({
        "least": F.when(small, F.col("wide_least")).otherwise(F.col("least")),
        "most": F.when(small, F.col("wide_most")).otherwise(F.col("most"))})
    return both.groupBy("group_lang", "group_source").agg(*[
        F.max(F.when(F.col("rate") == r, F.col(side))).alias(f"{r}_{side}") for r in RATES for side in ("least", "most")])


def judge(docs: DataFrame, min_group: int = MIN_GROUP, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Counts, rates, fences of the group and `kept` of every document."""
    rated = with_rates(materialize(measure(docs, keep), "quality"))
    fence = thresholds(sketch(rated), min_group)
    inside = F.lit(True)
    for r in RATES:
        inside &= F.col(r).between(F.col(f"{r}_least"), F.col(f"{r}_most"))
    return rated.join(fence, ["group_lang", "group_source"], "left").withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def keep_good(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of `docs` that pass, unchanged."""
    key = fresh("row_key", docs.columns)
    good = judge(docs, min_group).where("kept").select(F.col("row_key").alias(key))
    return docs.withColumn(key, row_key(docs)).join(good, key, "left_semi").drop(key)
