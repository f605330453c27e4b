"""Named queries over the driver tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit import fixed, fixtures
from codeaudit.fixtures import Views
from codeaudit.functions.paths import has_test_name, is_test_file
from codeaudit.functions.text import words
from codeaudit.operators import enrich, history, patch, quality, report, retrieval, testgap
from codeaudit.operators.census import file_census, reviewed_files, route_agents
from codeaudit.operators.docs import docs_findings, no_readme
from codeaudit.operators.facts import python_facts
from codeaudit.operators.sast import sast_findings
from codeaudit.operators.secrets import rules_of, secret_findings
from codeaudit.plans.review import BUILT_IN, Detector, run_review
from codeaudit.plans.webhook import review_heads
from codeaudit.sources.corpus import spread
from codeaudit.sources.tree import scan_tree, write_tree
from codeaudit.storage import materialize, scratch_path
from codeaudit.streaming.deliveries import (
    accepted_deliveries, classify_deliveries, pr_snapshots,
)
from codeaudit.streaming.runner import read_delivery_files, write_classified

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FINDING_COLUMNS = ("repo", "rule", "severity", "title", "file", "line", "detail")


def _query(name: str):
    def add(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        return build

    return add


# Sources and predicates


@_query("corpus_scan")
def _corpus_scan(v):
    return v.files().select("repo", "path", *_content_measures())


def _content_measures():
    return F.length("content").alias("n_chars"), F.md5("content").alias("digest")


@_query("dir_scan")
def _dir_scan(v):
    root = scratch_path(v.spark, "tree")
    write_tree(v.files(), root)
    return scan_tree(v.spark, root).select("repo", "path", *_content_measures())


@_query("skip_dir_filter")
def _skip_dir_filter(v):
    return reviewed_files(v.files()).select("repo", "path")


@_query("test_file_split")
def _test_file_split(v):
    path = F.col("path")
    return v.files().select(
        "repo", "path", is_test_file(path).alias("is_test"), has_test_name(path).alias("by_name")
    )


@_query("safe_path")
def _safe_path(v):
    return patch.safe_paths(v.paths(), v.flat_files().select("repo", "path")).select(
        "repo", "doc_id", "path", "safe_path"
    )


@_query("tokenize")
def _tokenize(v):
    found = words(F.col("content"))
    return v.files().select(
        "repo", "path", F.size(found).alias("n_words"), F.array_join(found, " ").alias("words")
    )


# Census and routing


@_query("file_census")
def _census(v):
    return file_census(v.files())


@_query("route_agents")
def _routes(v):
    return route_agents(file_census(v.files())).select("repo", "agent")


# Detectors


@_query("secret_scan")
def _secret_scan(v):
    return secret_findings(v.files()).select(*FINDING_COLUMNS)


@_query("secret_scan_rules")
def _secret_scan_rules(v):
    """A table of up to 4,096 rules, each with a keyword of its own."""
    return secret_findings(v.files(), rules_of(v.key_rules())).select(*FINDING_COLUMNS)


@_query("sast_ingest")
def _sast_ingest(v):
    return sast_findings(materialize(v.sast_reports(), "reports")).select(*FINDING_COLUMNS)


@_query("py_facts")
def _py_facts(v):
    return python_facts(v.py_files()).select(
        "repo", "path", "has_doc", F.col("error.kind").alias("error"),
        F.size("functions").alias("n_functions"), F.size("defs").alias("n_defs"),
        F.size("handlers").alias("n_handlers"),
        F.aggregate(
            F.flatten(F.transform("functions", lambda f: f["kinds"])), F.lit(0),
            lambda n, k: n + k["n"],
        ).alias("n_decisions"),
    )


def _functions(v, *columns):
    return quality.functions(python_facts(v.py_modules())).select("repo", "path", "name", *columns)


@_query("py_complexity")
def _py_complexity(v):
    return _functions(v, "complexity")


@_query("py_nesting")
def _py_nesting(v):
    return _functions(v, "nesting")


def _rule(findings, rule):
    return findings.filter(F.col("rule") == rule).select(*FINDING_COLUMNS)


@_query("py_long_func")
def _py_long_func(v):
    return _rule(quality.function_findings(python_facts(v.py_modules())), "QUAL_LONG_FUNC")


@_query("py_many_args")
def _py_many_args(v):
    return _rule(quality.function_findings(python_facts(v.py_modules())), "QUAL_MANY_ARGS")


@_query("py_mutable_default")
def _py_mutable_default(v):
    return _rule(quality.function_findings(python_facts(v.py_modules())), "QUAL_MUTABLE_DEFAULT")


@_query("py_bare_except")
def _py_bare_except(v):
    return quality.handler_findings(python_facts(v.py_modules())).select(*FINDING_COLUMNS)


@_query("py_syntax_errors")
def _py_syntax_errors(v):
    return quality.syntax_findings(python_facts(v.py_modules())).select(*FINDING_COLUMNS)


@_query("quality_findings")
def _quality_findings(v):
    facts = materialize(python_facts(v.py_files()), "facts")
    return quality.quality_findings(facts).select(*FINDING_COLUMNS)


@_query("test_identifiers")
def _test_identifiers(v):
    return testgap.test_identifiers(v.files())


@_query("no_tests")
def _no_tests(v):
    return testgap.no_tests(v.py_files()).select(*FINDING_COLUMNS)


@_query("test_gap")
def _test_gap(v):
    files = v.py_files()
    return testgap.untested(python_facts(files), files).select("repo", "path", "name", "line", "kind")


@_query("test_gap_capped")
def _test_gap_capped(v):
    files = v.py_files()
    return testgap.test_gap_findings(python_facts(files), files, fixed.TEST_GAP_FINDINGS).select(*FINDING_COLUMNS)


@_query("no_readme")
def _readme(v):
    files = v.review_files()
    return no_readme(files, files.select("repo").distinct()).select("repo", "rule", "severity", "title")


@_query("docs_findings")
def _docs(v, limit=fixed.DOC_FINDINGS):
    files = v.py_files()
    facts = materialize(python_facts(files), "facts")
    routed = route_agents(file_census(files)).filter(F.col("agent") == "documentation")
    return docs_findings(facts, files, routed, limit).select(*FINDING_COLUMNS)


@_query("docs_findings_all")
def _docs_all(v):
    return _docs(v, None)


# Reports over findings


@_query("ranked_findings")
def _ranked_findings(v):
    return report.ranked_findings(v.findings())


@_query("health_score")
def _health_score(v):
    return report.health_score(v.reviews().select("review_id", "repo"), v.findings().drop("repo"))


@_query("severity_pivot")
def _severity_pivot(v):
    return report.severity_pivot(v.reviews().select("review_id"), v.findings())


@_query("severity_summary")
def _severity_summary(v):
    return report.severity_summary(v.findings())


@_query("agent_counts")
def _agent_counts(v):
    counts = report.agent_counts(v.findings())
    return counts.select("review_id", history.agents_json(F.col("agents")).alias("agents_json"))


@_query("fix_candidates")
def _fix_candidates(v, limit=fixed.FIX_CANDIDATES):
    return report.fix_candidates(v.findings(), limit=limit).select(
        "review_id", "i", "severity", "file", "line", "rule", "title", "detail"
    )


@_query("fix_candidates_all")
def _fix_candidates_all(v):
    return _fix_candidates(v, None)


@_query("markdown_report")
def _markdown_report(v):
    status = v.failures()
    return report.markdown_report(v.reviews(), v.findings(), status)


@_query("comment_outbox")
def _comment_outbox(v):
    asked = v.reviews().filter(F.col("pr_number").isNotNull())
    findings = v.findings().join(asked.select("review_id"), "review_id", "left_semi")
    bodies = report.markdown_report(asked, findings)
    return asked.join(bodies, "review_id").select(
        "repo", F.col("pr_number").alias("pr"), "review_id", "part", "body",
        F.lit(False).alias("posted"),
    )


# History


def _history(v):
    """A written history of two runs: reviews with even numbers, then the others."""
    path = scratch_path(v.spark, "history")
    rows = materialize(history.review_rows(v.reviews(), v.findings().drop("repo")), "reviews")
    for at, run in enumerate(("even", "odd")):
        history.append_history(rows.filter(F.col("review_id") % 2 == at), path, run)
    return history.read_history(v.spark, path).drop("run")


def _history_view(rows):
    return rows.withColumns({
        "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
        "agents_json": history.agents_json(F.col("agents")),
    }).drop("agents")


@_query("history_rows")
def _history_rows(v):
    return _history_view(_history(v))


@_query("history_recent")
def _history_recent(v):
    return _history_view(history.history_recent(_history(v)))


@_query("history_summary")
def _history_summary(v):
    return history.history_summary(_history(v))


@_query("health_trend")
def _health_trend(v):
    trend = history.health_trend(_history(v))
    return trend.withColumn("period", F.date_format("period", "yyyy-MM"))


@_query("totals_by_severity")
def _totals_by_severity(v):
    return history.totals_by_severity(_history(v))


@_query("totals_by_agent")
def _totals_by_agent(v):
    return history.totals_by_agent(_history(v))


# Retrieval and enrichment


def _chunks(v, **limits):
    return retrieval.chunk_index(v.files(), fixtures.STANDARDS, fixtures.CHUNK_LINES, **limits)


@_query("chunk_index")
def _chunk_index(v):
    return _chunks(v)


@_query("chunk_index_capped")
def _chunk_index_capped(v):
    return _chunks(v, max_files=fixtures.INDEX_FILES, max_chunks=fixtures.INDEX_CHUNKS)


def _best(v):
    chunks = materialize(_chunks(v), "chunks")
    return retrieval.keyword_topk(chunks, v.chunk_queries()), chunks


@_query("keyword_topk")
def _keyword_topk(v):
    return _best(v)[0].withColumn("score", F.round("score", 6))


@_query("vector_topk")
def _vector_topk(v, limit=None):
    vectors = v.vectors()
    index = materialize(retrieval.vector_index(vectors, ["vec_id"], limit), "vector-index")
    queries = vectors.withColumnRenamed("vec_id", "query_id")
    best = retrieval.vector_topk(index, queries)
    named = best.join(index.select("repo", "ord", "vec_id"), ["repo", "ord"])
    return named.select("query_id", "rank", "vec_id", "distance")


@_query("vector_topk_capped")
def _vector_topk_capped(v):
    return _vector_topk(v, fixtures.INDEX_CHUNKS)


@_query("context_block")
def _context_block(v):
    return retrieval.context_blocks(*_best(v)).select("query_id", "context")


@_query("retrieve")
def _retrieve(v):
    """By vectors in the repositories that have some, else by keywords."""
    chunks = materialize(_chunks(v), "chunks")
    vectors, asked = v.chunk_vectors(), v.query_vectors()
    found = retrieval.retrieve(chunks, v.chunk_queries(), vectors, asked)
    return found.select("query_id", "repo", "rank", "ord", "source", "text", "backend")


@_query("retrieval_query")
def _retrieval_query(v, chars=None):
    return retrieval.retrieval_queries(v.findings(), ["repo"], ["file", "line", "rule"], chars)


@_query("retrieval_query_capped")
def _retrieval_query_capped(v):
    return _retrieval_query(v, fixed.QUERY_CHARS)


@_query("triage_prompt")
def _triage_prompt(v):
    """Whole prompts, with the role of the detector and context where there is some."""
    indexed = enrich.indexed_findings(v.findings())
    return enrich.triage_prompts(indexed, v.contexts(), per_prompt=fixtures.PROMPT_FINDINGS).select(
        "review_id", "agent", "batch", "payload", "prompt")


@_query("triage_enrich")
def _triage_enrich(v):
    indexed = materialize(enrich.indexed_findings(v.findings()), "indexed")
    merged = enrich.merge_triage(indexed, v.triage_replies(indexed))
    return merged.select("review_id", "agent", "i", "rule", "title", "explanation", "fix_hint")


@_query("explained_report")
def _explained_report(v):
    """Findings, prompts, replies and the report with the risk and the fix that the replies name."""
    indexed = materialize(enrich.indexed_findings(v.findings()), "indexed")
    explained = enrich.merge_triage(indexed, v.triage_replies(indexed))
    return report.markdown_report(v.reviews(), explained, v.failures())


# Patches


def _fixable(v, limit=None):
    return report.fix_candidates(v.file_findings(), limit=limit)


@_query("fix_prompts")
def _fix_prompts(v):
    snippets = patch.fix_snippets(_fixable(v, fixed.FIX_CANDIDATES), v.flat_files())
    return enrich.fix_prompts(snippets).select("review_id", "payload", "prompt")


@_query("fix_snippets")
def _fix_snippets(v):
    return patch.fix_snippets(_fixable(v), v.flat_files()).select("review_id", "i", "file", "line", "snippet")


def _proposals(v, limit=None):
    candidates = materialize(_fixable(v, limit), "candidates")
    items = enrich.fix_items(v.fix_replies(candidates))
    return patch.validate_patches(items, candidates, v.flat_files())


@_query("patch_validate")
def _patch_validate(v):
    return _proposals(v).select("review_id", "i", "file", "line", "rule", "title", "original", "fixed", "note")


@_query("fix_report")
def _fix_report(v):
    return patch.fix_report(_proposals(v).withColumn("pos", F.col("i")), part_fixes=fixtures.PART_FIXES)


@_query("fix_report_capped")
def _fix_report_capped(v):
    return patch.fix_report(_proposals(v, fixed.FIX_CANDIDATES).withColumn("pos", F.col("i")))


@_query("autofix")
def _autofix(v):
    """Findings, snippets, replies, proposals and the files as the proposals leave them."""
    proposals = materialize(_proposals(v), "proposals")
    return patch.apply_proposals(v.flat_files(), proposals).select("repo", "path", F.md5("new_content").alias("digest"), "n_applied")


@_query("patch_apply")
def _patch_apply(v):
    return patch.apply_patches(v.flat_files(), v.patches())


# Deliveries


@_query("deliveries_classified")
def _deliveries_classified(v):
    return _shown(classify_deliveries(v.deliveries(), fixtures.SECRET))


def _shown(classified):
    return classified.select("event_id", "event", "disposition", "repo", "pr_number", "ref", "sha")


@_query("deliveries_stream")
def _deliveries_stream(v):
    """The same through a file stream that ends when all is read."""
    events = read_delivery_files(
        v.spark, v.sf_dir, v.table("events").schema, "events.parquet"
    )
    deliveries = fixtures.sign(v.spark.sql(fixtures.DELIVERIES_SQL, events=events))
    output = scratch_path(v.spark, "deliveries")
    stream = write_classified(deliveries, fixtures.SECRET, output, scratch_path(v.spark, "stream"))
    stream.awaitTermination()
    return _shown(v.spark.read.parquet(output))


def _accepted(v):
    deliveries = materialize(v.deliveries(), "deliveries")
    return accepted_deliveries(classify_deliveries(deliveries, fixtures.SECRET))


@_query("pr_snapshot")
def _pr_snapshot(v):
    return pr_snapshots(_accepted(v), v.snapshot_corpus()).select("repo", "sha", "path")


@_query("webhook_reviews")
def _webhook_reviews(v):
    corpus = _corpus(v.snapshot_corpus())
    return review_heads(materialize(_accepted(v), "accepted"), corpus).results()


# Full review


def _review(v, **limits):
    """Contents and reports are read once each, so neither is written before; jobs that only need paths read no texts."""
    return run_review(v.review_files(), v.sast_reports(), **limits)


def _corpus(files):
    """A written corpus, as reviews read one in production; files of all kinds in every split."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return spread(materialize(files.repartition(cores), "corpus"))


@_query("review_all")
def _review_all(v, **limits):
    return _review(v, **limits).ranked().select(
        "repo", "rank", "agent", "rule", "severity", "title", "file", "line", "detail"
    )


@_query("review_capped")
def _review_capped(v):
    return _review_all(v, gap_limit=fixed.TEST_GAP_FINDINGS, doc_limit=fixed.DOC_FINDINGS)


@_query("review_scores")
def _review_scores(v):
    return _review(v).scores()


def _licences(text):
    """A plug-in's scan of one text; it cannot take tables."""
    if "|" in text:
        raise ValueError("table in prose")
    for line, words_ in enumerate(text.splitlines(), 1):
        if "Licen" in words_:
            yield "LICENCE", fixed.INFO, "Licence line", line, ""


@_query("agent_status")
def _agent_status(v):
    """With a plug-in that raises on some texts: it fails for their repositories only."""
    plug_in = Detector("licences", (".js", ".ts"), scan=_licences)
    return _review(v, detectors=[*BUILT_IN, plug_in]).status()
