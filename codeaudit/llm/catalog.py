"""The numbered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeaudit.llm import decontaminate, htmltext, jaccard, linededup, lmscore, pieces, quality, repair, simhash, tokencounts, tokenfile, urlfilter, whitening
from codeaudit.llm.tables import table


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: lines, later copies, near copies of earlier lines, and the numbers of dropped lines."""
    return linededup.drops(table(spark, folder, "documents")).drop("row_key")


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals by source, language and tokenizer version after loads, deletes, revisions and replays."""
    return tokencounts.rollup(spark, folder)


def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return decontaminate.passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(table(spark, folder, "pages"))


def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard.near_components(table(spark, folder, "documents"))


def op6_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return urlfilter.judge(table(spark, folder, "pages"))


def op7_token_id_output(spark: SparkSession, folder: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the written files."""
    return tokenfile.round_trip(table(spark, folder, "documents"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality.judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Losses of every document under both models, and their difference."""
    return lmscore.score(table(spark, folder, "documents"), lmscore.good_documents(table(spark, folder, "labels")))


def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Piece ids of every document, with length and checksum of the text that they decode to."""
    return pieces.round_trip(table(spark, folder, "documents"))


def op11_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_components(table(spark, folder, "documents"))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened values of every vector along the four leading components."""
    return whitening.whiten(table(spark, folder, "embeddings"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    return repair.repair(table(spark, folder, "conversations"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_html_extraction": op4_html_extraction,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_url_filters": op6_url_filters,
    "op7_token_id_output": op7_token_id_output,
    "op8_quality_rules": op8_quality_rules,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_conversation_repair": op13_conversation_repair,
}
