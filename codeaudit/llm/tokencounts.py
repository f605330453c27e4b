"""Token counts: rollups by source, language and tokenizer version, kept up by signed deltas.

A batch is a set of changes: a document's count under a tokenizer version, new or revised, or
null to delete it. Its delta adds what the change brings and takes away what the document's
last committed count had brought, summed by (source, lang, tokenizer); totals are the sum of
the committed deltas and never read documents again.

Under a root folder: `changes/batch=B`, `deltas/batch=B` and, written last, `commits/batch=B`.
Readers take only batches with a commit, so a batch that broke off leaves nothing and is
written anew under its name; a committed batch that comes again is skipped.

Defined cases: every row with a null doc_id is a document of its own, which no later batch can revise or
delete; of several rows for one document and
version in a batch the largest count holds (a delete only if there is no count); null source and
language are groups; deleting what is not there changes nothing; an empty batch commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codeaudit.llm.tables import table
from codeaudit.storage import materialize, scratch_path

#: Version: pattern of one token.
TOKENIZERS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "marks-2": r"[0-9A-Za-z]+|[^\x00-\x7F]+|[!-/:-@\[-`{-~]",
}
CHANGES = "doc_key string, source string, lang string, tokenizer string, n_tokens long"
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
COMMITS = "position long, batch string"


def count_tokens(text: Column, tokenizer: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def _read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """All committed rows of one of the tables, with their batch and its position."""
    done = commits(spark, root)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not files.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(files):
        return spark.createDataFrame([], f"{schema}, batch string, position long")
    return spark.read.schema(f"{schema}, batch string").option("basePath", f"{root}/{name}").parquet(f"{root}/{name}").join(F.broadcast(done), "batch")


def commits(spark: SparkSession, root: str) -> DataFrame:
    """`(position, batch)` of the committed batches, one small row each."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/commits")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], COMMITS)
    return spark.read.schema(COMMITS).option("basePath", f"{root}/commits").parquet(f"{root}/commits")


def commit(spark: SparkSession, root: str, batch: str, changes: DataFrame) -> bool:
    """Apply `changes(doc_id, source, lang, tokenizer, n_tokens)` once; False if the batch was there."""
    done = commits(spark, root).collect()
    if any(r.batch == batch for r in done):
        return False
    # Rows without an id cannot be told apart, so equal ones are numbered; no later batch speaks of them.
    own = ["tokenizer", "source", "lang", "n_tokens"]
    nth = F.row_number().over(Window.partitionBy("doc_id", *own).orderBy(F.lit(1)))
    nameless = changes.where("doc_id IS NULL AND n_tokens IS NOT NULL").withColumn(
        "doc_key", F.concat_ws(":", F.lit("none"), F.lit(batch), F.xxhash64(*own), nth))
    named = changes.where("doc_id IS NOT NULL").withColumn("doc_key", F.col("doc_id").cast("string"))
    new = named.unionByName(nameless).select("doc_key", "source", "lang", "tokenizer", F.col("n_tokens").cast("long").alias("n_tokens"))
    # Deletes sort below counts.
    best = F.max_by(F.struct("source", "lang", "n_tokens"), F.struct(F.coalesce("n_tokens", F.lit(-1)), "source", "lang"))
    new = new.groupBy("doc_key", "tokenizer").agg(best.alias("c")).select("doc_key", "c.source", "c.lang", "tokenizer", "c.n_tokens")
    new.write.mode("overwrite").parquet(f"{root}/changes/batch={batch}")
    new = spark.read.schema(CHANGES).parquet(f"{root}/changes/batch={batch}")

    before = _read(spark, root, "changes", CHANGES).join(new.select("doc_key", "tokenizer"), ["doc_key", "tokenizer"], "left_semi")
    last = before.groupBy("doc_key", "tokenizer").agg(F.max_by(F.struct("source", "lang", "n_tokens"), "position").alias("c")).select(
        "c.source", "c.lang", "tokenizer", "c.n_tokens")
    signed = new.select("source", "lang", "tokenizer", "n_tokens", F.lit(1).alias("sign")).unionAll(last.withColumn("sign", F.lit(-1)))
    delta = signed.where("n_tokens IS NOT NULL").groupBy("source", "lang", "tokenizer").agg(
        F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
    delta.write.mode("overwrite").parquet(f"{root}/deltas/batch={batch}")
    position = max((r.position for r in done), default=0) + 1
    spark.range(1).select(F.lit(position).cast("long").alias("position")).write.mode("overwrite").parquet(f"{root}/commits/batch={batch}")
    return True


def totals(spark: SparkSession, root: str) -> DataFrame:
    """`(source, lang, tokenizer, n_docs, n_tokens)` after all committed batches."""
    sums = _read(spark, root, "deltas", DELTAS).groupBy("source", "lang", "tokenizer").agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where("n_docs <> 0")


def corpus_history(docs: DataFrame, root: str) -> None:
    """Three batches over a corpus, the later two sent twice: all counts under both versions; deletes
    of documents whose text an earlier one has; counts revised for repeated lines in a text.

    Documents without an id or a text are loaded and stay as they are."""
    spark = docs.sparkSession
    once = F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n")
    counts = materialize(docs.select(
        "doc_id", "source", "lang", F.xxhash64("text").alias("text_hash"), F.length("text").alias("size"),
        *[count_tokens(t, v).alias(f"{name}_{k}") for k, v in enumerate(TOKENIZERS) for name, t in (("all", F.col("text")), ("once", once))]), "token-counts")
    each = F.explode(F.array(*[
        F.struct(F.lit(v).alias("tokenizer"), F.col(f"all_{k}").alias("n_all"), F.col(f"once_{k}").alias("n_once")) for k, v in enumerate(TOKENIZERS)]))
    rows = counts.withColumn("t", each).select("doc_id", "source", "lang", "text_hash", "size", "t.*")
    first = counts.groupBy("text_hash", "size").agg(F.min("doc_id").alias("first_id"))
    later = rows.join(first, ["text_hash", "size"]).where("doc_id > first_id")
    kept = rows.join(first, ["text_hash", "size"]).where("doc_id = first_id AND n_once <> n_all")
    change = lambda df, n: df.select("doc_id", "source", "lang", "tokenizer", n.alias("n_tokens"))
    commit(spark, root, "load", change(rows, F.col("n_all")))
    for _ in range(2):
        commit(spark, root, "copies", change(later, F.lit(None)))
        commit(spark, root, "lines", change(kept, F.col("n_once")))


def rollup(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_path(spark, "token-ledger")
    corpus_history(table(spark, folder, "documents"), root)
    return totals(spark, root)
