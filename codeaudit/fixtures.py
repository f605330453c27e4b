"""Review inputs derived from the driver tables.

The tables hold orders, line items, documents and so on; these views read them as source
files, findings, reviews, deliveries and replies. Views over one table are row-wise and add no
shuffle. SQL texts are common to Spark and DuckDB and name their table in braces, so the
oracle shares them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.functions.text import hmac_sha256
from codeaudit.sources.corpus import read_table, spread

SECRET = "fixture-secret"
STANDARDS = (
    "standards.md",
    "# Standards\n\nKeep functions short and give them few parameters.\n"
    "Never use a mutable default argument or a bare except.\nWrite a test for public functions.\n",
)
CHUNK_LINES = 5
# Limits of the capped twins that cut something at every scale of the tables.
INDEX_FILES, INDEX_CHUNKS, PART_FIXES = 4, 10, 3
# Findings of a prompt: few, so that some detectors need several.
PROMPT_FINDINGS = 2
UNKNOWN_INDEX = 2_000_000_000

FILES_SQL = """
SELECT source AS repo,
 concat(CASE WHEN doc_id % 41 = 0 THEN '' WHEN doc_id % 23 = 0 THEN 'node_modules/'
             WHEN doc_id % 7 = 0 THEN 'tests/' WHEN doc_id % 11 = 0 THEN '' ELSE 'src/' END,
        CASE WHEN doc_id % 41 = 0 THEN concat('README_', doc_id)
             WHEN doc_id % 5 = 0 THEN concat('test_m', doc_id)
             WHEN doc_id % 13 = 0 THEN concat('m', doc_id, '_test') ELSE concat('m', doc_id) END,
        CASE WHEN doc_id % 31 = 0 THEN '' WHEN lang = 'en' THEN '.py' WHEN lang = 'de' THEN '.md'
             WHEN lang = 'fr' THEN '.js' ELSE '.txt' END) AS path,
 text AS content
FROM {documents}
"""

# Documents as files that are not Python, for full reviews (prose does not parse as Python).
PROSE_SQL = """
SELECT source AS repo,
 concat(CASE WHEN doc_id % 23 = 0 THEN 'node_modules/' WHEN doc_id % 7 = 0 THEN 'docs/' ELSE 'src/' END,
        'd', doc_id, CASE WHEN lang = 'en' THEN '.md' WHEN lang = 'de' THEN '.js'
                          WHEN lang = 'fr' THEN '.ts' ELSE '.txt' END) AS path,
 text AS content
FROM {documents}
"""

FINDINGS_SQL = """
SELECT l_orderkey AS review_id, concat('repo-', l_orderkey % 97) AS repo,
 CASE l_partkey % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'quality'
                    WHEN 2 THEN 'test-gap' ELSE 'documentation' END AS agent,
 CAST(l_partkey % 4 AS INT) AS agent_ord,
 concat('R_', l_returnflag, l_linestatus) AS rule,
 CASE CAST(l_quantity AS INT) % 10 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 2
   WHEN 4 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 1 WHEN 7 THEN 1 ELSE 0 END AS severity,
 concat('title ', l_partkey % 50) AS title,
 concat('src/f', l_partkey % 200, '.py') AS file,
 CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber * 10 END AS line,
 concat('supplier ', l_suppkey) AS detail,
 CAST(round(l_extendedprice * 100) AS BIGINT) AS seq
FROM {lineitem}
"""

REVIEWS_SQL = """
SELECT o_orderkey AS review_id, o_orderdate AS created_at,
 CASE o_orderstatus WHEN 'F' THEN 'webhook' WHEN 'O' THEN 'harness' ELSE 'api' END AS source,
 concat('repo-', o_orderkey % 97) AS repo,
 CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS pr_number
FROM {orders}
"""

# Detector failures shown in reports.
FAILURES_SQL = """
SELECT o_orderkey AS review_id, 'quality' AS agent, concat('timeout after ', o_custkey) AS error
FROM {orders} WHERE o_orderkey % 101 = 0
UNION ALL
SELECT o_orderkey AS review_id, 'security' AS agent, 'no report' AS error
FROM {orders} WHERE o_orderkey % 202 = 0
"""

# One finding per file, with lines past the end and unknown lines among them.
FILE_FINDINGS_SQL = """
SELECT source AS review_id, source AS repo, 'quality' AS agent, 1 AS agent_ord,
 concat('R_', doc_id % 9) AS rule, CAST(doc_id % 5 AS INT) AS severity,
 concat('title ', doc_id) AS title, path AS file,
 CAST(doc_id % 29 AS INT) AS line, '' AS detail, doc_id AS seq
FROM (SELECT d.*, concat('d', doc_id, CASE WHEN doc_id % 41 = 0 THEN '/../../m.txt' ELSE '/m.txt' END) AS path
      FROM {documents} d) f
"""

# Files those findings are about.
FLAT_FILES_SQL = """
SELECT source AS repo, concat('d', doc_id, '/m.txt') AS path, text AS content, doc_id
FROM {documents}
"""

PATHS_SQL = """
SELECT source AS repo, doc_id,
 CASE doc_id % 6 WHEN 0 THEN concat('../d', doc_id, '/m.txt')
   WHEN 1 THEN concat('src/../d', doc_id, '/./m.txt') WHEN 2 THEN concat('/d', doc_id, '/m.txt')
   WHEN 3 THEN concat('d', doc_id, '/m.txt') WHEN 4 THEN concat('d', doc_id, '/missing.txt')
   ELSE concat('a/b/../../d', doc_id, '//m.txt') END AS path
FROM {documents}
"""

QUERIES_SQL = """
SELECT item_id AS query_id, concat('src', item_id % 20) AS repo, text AS query FROM {benchmark}
"""

DELIVERIES_SQL = """
SELECT event_id, ts, CASE WHEN event_type = 'view' THEN 'push' ELSE 'pull_request' END AS event,
 CASE WHEN event_id % 19 = 0 THEN concat('not json ', event_id)
      WHEN event_id % 23 = 0 THEN concat('{{"action":"opened","number":', event_id, '}}')
      WHEN event_id % 29 = 0 THEN concat('[{{"action":"opened","number":', event_id, '}}]')
 ELSE concat('{{"action":"',
   CASE event_id % 5 WHEN 0 THEN 'opened' WHEN 1 THEN 'synchronize' WHEN 2 THEN 'reopened'
        WHEN 3 THEN 'closed' ELSE 'labeled' END,
   '","number":', CASE WHEN event_id % 41 = 0 THEN concat('"', event_id, '"') ELSE concat('', event_id) END, ',"repository":{{"full_name":"octo/r', user_id % 20,
   '"}},"pull_request":{{"head":{{"ref":"b', event_id % 7, '","sha":"s', user_id % 20, '"}}}}',
   CASE WHEN event_id % 31 = 0 THEN ',"number":99}} and more' WHEN event_id % 37 = 0 THEN ',"sender":null,"sender":{{}}}}' ELSE '}}' END) END AS body
FROM {events}
"""


class Views:
    """The views over the tables in one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def spread(self, name: str) -> DataFrame:
        """The table for work that is heavy per row."""
        return spread(self.table(name))

    def _sql(self, text: str, table: str) -> DataFrame:
        scan = self.spread(table) if table in ("documents", "events") else self.table(table)
        return self.spark.sql(text, **{table: scan})

    def files(self) -> DataFrame:
        return self._sql(FILES_SQL, "documents")

    def prose_files(self) -> DataFrame:
        return self._sql(PROSE_SQL, "documents")

    def flat_files(self) -> DataFrame:
        return self._sql(FLAT_FILES_SQL, "documents")

    def findings(self) -> DataFrame:
        return self._sql(FINDINGS_SQL, "lineitem")

    def reviews(self) -> DataFrame:
        return self._sql(REVIEWS_SQL, "orders")

    def failures(self) -> DataFrame:
        return self._sql(FAILURES_SQL, "orders")

    def file_findings(self) -> DataFrame:
        return self._sql(FILE_FINDINGS_SQL, "documents")

    def paths(self) -> DataFrame:
        return self._sql(PATHS_SQL, "documents")

    def key_rules(self) -> DataFrame:
        """Secret rules, one for each start of three hexadecimal digits that some order has."""
        start = F.lower(F.lpad(F.hex(F.col("o_orderkey") % 4096), 3, "0")).alias("start")
        opening = F.concat(F.lit('= "'), "start")
        return self.table("orders").select(start).distinct().select(
            F.concat(F.lit("KEY_"), F.upper("start")).alias("rule"), F.lit(3).alias("severity"),
            F.concat(F.lit("Key that starts "), "start").alias("title"),
            F.concat(F.lit('= "('), "start", F.lit('[0-9a-f]{37})"')).alias("pattern"), F.array(opening).alias("keywords"),
        )

    def chunk_queries(self) -> DataFrame:
        return self._sql(QUERIES_SQL, "benchmark")

    def parts(self) -> DataFrame:
        """The numbers that modules are generated from, dealt to all cores: a file of few row groups parses in few tasks."""
        return self.table("part").select("p_partkey", "p_size").repartition(self.spark.sparkContext.defaultParallelism)

    def py_modules(self, parts: DataFrame | None = None) -> DataFrame:
        """Generated Python modules, whose measures follow from the part's numbers."""
        k = F.col("p_partkey")
        name = F.concat(F.when(k % 10 == 0, "_f_").otherwise("f_"), k)
        n_args, nest = (k % 9).cast("int"), F.col("p_size") % 8
        args = F.transform(_numbers(n_args), lambda i: F.concat(F.lit("a"), i))
        given = F.concat_ws(", ", args, F.when(k % 4 == 0, F.lit("z=[]")))
        header = F.when(k % 37 == 5, F.concat(F.lit("def "), name, F.lit("(:\n"))).otherwise(
            F.concat(F.lit("def "), name, F.lit("("), given, F.lit("):\n"))
        )
        loops = F.transform(
            _numbers(nest), lambda i: F.concat(F.repeat(F.lit("    "), i), F.lit("while k:\n"))
        )
        inner = F.when(nest > 0, F.concat(F.repeat(F.lit("    "), nest + 1), F.lit("pass\n")))
        content = F.concat_ws(
            "",
            F.when(k % 7 == 0, F.concat(F.lit('"""Module '), k, F.lit('."""\n'))),
            header,
            F.when(k % 3 == 0, F.lit('    """Return nothing."""\n')),
            F.repeat(F.lit("    if k:\n        pass\n"), F.col("p_size") % 26),
            loops,
            inner,
            F.when(k % 6 == 0, F.lit("    try:\n        pass\n    except:\n        pass\n")),
            F.when(k % 5 == 0, F.lit("    k = 1\n" * 50)),
            F.lit("    return 0\n"),
        )
        return (self.spread("part") if parts is None else parts).select(
            F.concat(F.lit("pkg-"), k % 50).alias("repo"),
            F.concat(F.lit("src/f"), k, F.lit(".py")).alias("path"),
            content.alias("content"),
        )

    def py_tests(self, parts: DataFrame | None = None) -> DataFrame:
        """A test file for two of three modules, except in packages 0 to 4."""
        k = F.col("p_partkey")
        body = F.format_string(
            '"""Checks f_%d."""\n\n\ndef test_it():\n    assert f_%d\n', k, k
        )
        return (self.spread("part") if parts is None else parts).filter((k % 3 != 0) & (k % 50 >= 5)).select(
            F.concat(F.lit("pkg-"), k % 50).alias("repo"),
            F.concat(F.lit("tests/test_m"), k, F.lit(".py")).alias("path"),
            body.alias("content"),
        )

    def py_readmes(self) -> DataFrame:
        """A README in packages with an odd number."""
        k = F.col("p_partkey")
        return self.spread("part").filter((k < 50) & (k % 2 == 1)).select(
            F.concat(F.lit("pkg-"), k).alias("repo"), F.lit("README.md").alias("path"),
            F.concat(F.lit("# Package "), k, F.lit("\n")).alias("content"),
        )

    def py_files(self, parts: DataFrame | None = None) -> DataFrame:
        return self.py_modules(parts).unionByName(self.py_tests(parts)).unionByName(self.py_readmes())

    def review_files(self) -> DataFrame:
        return self.prose_files().unionByName(self.py_files(self.parts()))

    def sast_reports(self) -> DataFrame:
        """A report of two results per line item; blank or cut off for some orders."""
        order, line = F.col("l_orderkey"), F.col("l_linenumber")
        level = F.element_at(
            F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW"), F.lit(None)),
            (F.col("l_partkey") % 4 + 1).cast("int"),
        )

        def result(test_id: Column, folder: str) -> Column:
            name = F.concat(F.lit(f"{folder}/m"), F.coalesce(F.col("l_suppkey").cast("string"), F.lit("null")), F.lit(".py"))
            return F.struct(
                test_id.alias("test_id"),
                F.concat(F.lit("check_"), line).alias("test_name"),
                F.concat(F.lit("issue "), F.col("l_partkey") % 50).alias("issue_text"),
                level.alias("issue_severity"),
                F.when(F.col("l_suppkey") % 2 == 0, "HIGH").alias("issue_confidence"),
                F.concat(F.lit("./"), name).alias("filename"),
                F.when(line != 7, F.col("l_orderkey") % 90 + line).alias("line_number"),
            )

        results = F.array(
            result(F.lit("B101"), "tests"),
            result(F.when(line != 5, F.concat(F.lit("B60"), line)), "src"),
            result(F.lit("B101"), "src"),
        )
        text = F.to_json(F.struct(results.alias("results")))
        broken = F.when(order % 50 == 0, "  \n").when(order % 50 == 1, F.substring(text, 1, 60))
        return self.spread("lineitem").select(
            F.concat(F.lit("pkg-"), order % 50).alias("repo"),
            F.coalesce(broken, text).alias("json"),
        )

    def deliveries(self) -> DataFrame:
        return sign(self._sql(DELIVERIES_SQL, "events"))

    def snapshot_corpus(self) -> DataFrame:
        """Files at pull-request heads; repositories 15 to 19 have none."""
        number = F.regexp_extract("repo", "[0-9]+", 0).cast("int")
        return self.prose_files().filter(number < 15).select(
            F.concat(F.lit("octo/r"), number).alias("repo"), F.concat(F.lit("s"), number).alias("sha"),
            "path", "content",
        )

    def contexts(self) -> DataFrame:
        """Context of some prompts; an empty one counts as none."""
        return self.table("orders").filter(F.col("o_orderkey") % 3 < 2).select(
            F.col("o_orderkey").alias("review_id"), F.lit("quality").alias("agent"),
            F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("[notes.md:1]\nnote "), "o_orderkey")).otherwise("").alias("context"))

    def triage_replies(self, indexed: DataFrame) -> DataFrame:
        """A reply per prompt (a bounded batch of indices): items for even `i` and an unknown one."""
        items = F.array_sort(F.collect_list(F.when(F.col("i") % 2 == 0, F.struct(
            "i",
            F.concat(F.lit("why "), F.col("i").cast("string")).alias("explanation"),
            F.concat(F.lit("fix "), F.col("title")).alias("fix"),
        ))))
        unknown = F.struct(F.lit(UNKNOWN_INDEX).alias("i"), F.lit("x").alias("explanation"), F.lit("y").alias("fix"))
        batch = F.floor(F.col("i") / PROMPT_FINDINGS).alias("batch")
        grouped = indexed.groupBy("review_id", "agent", batch).agg(
            F.to_json(F.concat(items, F.array(unknown))).alias("text")
        )
        # Items with an index of another kind are ignored; one without an index voids its reply.
        text = F.when(F.col("review_id") % 13 == 0, F.regexp_replace("text", r"\]$", ',{"i":"0","fix":"z"},{"i":null}]')).when(
            F.col("review_id") % 19 == 0, F.regexp_replace("text", r"\]$", ',{"fix":"no index"}]')
        ).otherwise(F.col("text"))
        fenced = F.when(
            F.col("review_id") % 3 == 0, F.concat(F.lit(" ```json\n"), text, F.lit("\n```\n"))
        ).otherwise(text)
        reply = F.when(
            F.col("review_id") % 17 == 0, F.substring(fenced, F.lit(1), F.length(fenced) - 6)
        ).otherwise(fenced)
        return grouped.select("review_id", "agent", reply.alias("reply"))

    def fix_replies(self, candidates: DataFrame) -> DataFrame:
        """One reply per candidate: a change of its file's first 40 characters, an ambiguous or an absent text."""
        kind = F.col("seq") % 4
        joined = candidates.join(
            self.flat_files().select("repo", F.col("doc_id").alias("seq"), "content"), ["repo", "seq"]
        )
        first = F.substring("content", 1, 40)
        original = F.when(kind <= 1, first).when(kind == 2, "e").otherwise("ZZZZ-absent")
        fixed_text = F.when(kind == 1, F.concat(first, F.lit("\nadded"))).otherwise(
            F.concat(F.lit("<"), original, F.lit(">"))
        )
        item = F.struct(
            "i", original.alias("original"), fixed_text.alias("fixed"),
            F.when(F.col("seq") % 3 == 0, F.concat(F.lit("note "), "seq")).alias("note"),
        )
        text = F.concat(F.lit("```json\n"), F.to_json(F.array(item)), F.lit("\n```"))
        return joined.select("review_id", text.alias("reply"))

    def patches(self) -> DataFrame:
        """Three patches per file: the second fits only after the first, the third is ambiguous or absent."""
        first = F.substring("content", 1, 40)
        marked = F.concat(F.lit("<<"), first, F.lit(">>"))
        listed = F.array(
            F.struct(F.lit(1).alias("ord"), first.alias("original"), marked.alias("fixed")),
            F.struct(F.lit(2).alias("ord"), marked.alias("original"), F.lit("[[patched]]").alias("fixed")),
            F.struct(F.lit(3).alias("ord"), F.lit("e").alias("original"), F.lit("E").alias("fixed")),
        )
        return self.flat_files().select("repo", "path", F.inline(listed))

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            "vec_id", F.concat(F.lit("label-"), "label").alias("repo"),
            F.col("embedding").alias("vector"),
        )

    def chunk_vectors(self) -> DataFrame:
        """Vectors for the first chunks of seven repositories."""
        n = F.col("vec_id")
        return self.table("embeddings").select(
            F.concat(F.lit("src"), n % 7).alias("repo"), F.floor(n / 7).cast("long").alias("ord"), F.col("embedding").alias("vector"))

    def query_vectors(self) -> DataFrame:
        """A vector for the queries with an even number."""
        return self.table("embeddings").filter(F.col("vec_id") % 2 == 0).select(
            F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def sign(deliveries: DataFrame) -> DataFrame:
    """Add signatures: right ones, but wrong for ids ending in 3 and missing for those in 7."""
    right = F.concat(
        F.lit("sha256="), hmac_sha256(F.col("body").cast("binary"), SECRET.encode())
    )
    last = F.col("event_id") % 10
    signature = F.when(last == 3, "sha256=deadbeef").when(last != 7, right)
    return deliveries.withColumn("signature", signature)


def _numbers(n: Column) -> Column:
    """1 to n as an array, empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
