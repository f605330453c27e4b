"""DuckDB SQL for the queries of the catalog, over the same tables.

Measures of the generated modules come from the part numbers they were generated from, not
from source text, so the parser side is checked against arithmetic.
"""

from __future__ import annotations

from codeaudit import fixed, fixtures
from codeaudit.operators import enrich

_TABLES = {t: t for t in ("documents", "lineitem", "orders", "benchmark", "events")}


def _view(text: str) -> str:
    return text.format(**_TABLES)


_IN = "('" + "', '".join(fixed.SKIP_DIRS) + "')"
_SKIPPED = f"len(list_filter(string_split(path, '/'), lambda p: p IN {_IN})) > 0"
_NAME = "regexp_extract(path, '[^/]*$')"
_SUFFIX = "regexp_extract(" + _NAME + ", '^.+([.][^.]+)$', 1)"
_STEM = f"left({_NAME}, length({_NAME}) - length({_SUFFIX}))"
_BY_NAME = f"(starts_with({_NAME}, 'test_') OR {_STEM} LIKE '%\\_test' ESCAPE '\\')"
_IS_TEST = f"({_BY_NAME} OR len(list_filter(string_split(path, '/'), lambda p: p IN ('tests', 'test'))) > 0)"
_ORDER = "replace(path, '/', chr(1))"
_PENALTY = "CASE severity WHEN 4 THEN 25 WHEN 3 THEN 10 WHEN 2 THEN 4 WHEN 1 THEN 1 ELSE 0 END"
_LABEL = "CASE severity WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE 'Info' END"
_EMOJI = "CASE severity WHEN 4 THEN '🔴' WHEN 3 THEN '🟠' WHEN 2 THEN '🟡' WHEN 1 THEN '🔵' ELSE '⚪' END"
_RANK_ORDER = "severity DESC, file, line, agent_ord, seq, rule, title, detail"
_NL = "chr(10)"

_FILES = f"files AS ({_view(fixtures.FILES_SQL)})"
_PROSE = f"prose AS ({_view(fixtures.PROSE_SQL)})"
_FLAT = f"flat AS ({_view(fixtures.FLAT_FILES_SQL)})"
_FINDINGS = f"findings AS ({_view(fixtures.FINDINGS_SQL)})"
_REVIEWS = f"reviews AS ({_view(fixtures.REVIEWS_SQL)})"
_FAILURES = f"failures AS ({_view(fixtures.FAILURES_SQL)})"
_FILE_FINDINGS = f"file_findings AS ({_view(fixtures.FILE_FINDINGS_SQL)})"
_PATHS = f"paths AS ({_view(fixtures.PATHS_SQL)})"
_CHUNK_QUERIES = f"asked AS ({_view(fixtures.QUERIES_SQL)})"
_DELIVERIES = f"deliveries AS ({_view(fixtures.DELIVERIES_SQL)})"


def _lines(text: str) -> str:
    """Lines of a text; a final break opens no further line."""
    return f"string_split(regexp_replace({text}, '\\n$', ''), {_NL})"


# Generated modules: measures from the numbers behind them.
_MODULES = """
mods AS (
 SELECT k, repo, path, name, broken, moddoc, doc, mut, bare, n_args, nest, n_if, pad, head,
  1 + n_if + nest + bare AS complexity,
  greatest(nest, CASE WHEN n_if > 0 THEN 1 ELSE 0 END, bare) AS nesting,
  1 + doc + 2 * n_if + CASE WHEN nest > 0 THEN nest + 1 ELSE 0 END + 4 * bare + pad + 1 AS n_lines,
  n_args + mut AS n_params,
  head + doc + 2 * n_if + CASE WHEN nest > 0 THEN nest + 1 ELSE 0 END + 3 AS except_line
 FROM (SELECT p_partkey AS k, concat('pkg-', p_partkey % 50) AS repo, concat('src/f', p_partkey, '.py') AS path,
   concat(CASE WHEN p_partkey % 10 = 0 THEN '_f_' ELSE 'f_' END, p_partkey) AS name,
   p_partkey % 37 = 5 AS broken,
   CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS moddoc,
   CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 1 END AS head,
   CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS doc,
   CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS mut,
   CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END AS bare,
   CASE WHEN p_partkey % 5 = 0 THEN 50 ELSE 0 END AS pad,
   CAST(p_partkey % 9 AS INT) AS n_args, p_size % 8 AS nest, p_size % 26 AS n_if
  FROM part) m),
tests AS (
 SELECT p_partkey AS k, concat('pkg-', p_partkey % 50) AS repo, concat('tests/test_m', p_partkey, '.py') AS path
 FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 50 >= 5)"""


def _rule(rule: str, severity: str, where: str, seq: int, args: str = "", line: str = "head") -> str:
    title, detail = fixed.MESSAGES[rule]
    detail_args = title_args = ""
    if args:
        if "%" in title:
            title_args = f", {args}"
        else:
            detail_args = f", {args}"

    def text(value: str, given: str) -> str:
        literal = "'" + value.replace("'", "''") + "'"
        return f"printf({literal}{given})" if given else literal

    return (
        f"SELECT repo, 'quality' AS agent, 1 AS agent_ord, '{rule}' AS rule, {severity} AS severity, "
        f"{text(title, title_args)} AS title, path AS file, CAST({line} AS INT) AS line, "
        f"{text(detail, detail_args)} AS detail, {seq} AS seq FROM mods WHERE {where}"
    )


_QUALITY_RULES = {
    "QUAL_SYNTAX_ERROR": _rule("QUAL_SYNTAX_ERROR", "1", "broken", 0, "'invalid syntax'"),
    "QUAL_COMPLEXITY": _rule(
        "QUAL_COMPLEXITY", "CASE WHEN complexity > 20 THEN 3 ELSE 2 END",
        "NOT broken AND complexity > 10", 1, "name, complexity"),
    "QUAL_LONG_FUNC": _rule("QUAL_LONG_FUNC", "1", "NOT broken AND n_lines > 60", 2, "name, n_lines"),
    "QUAL_MANY_ARGS": _rule("QUAL_MANY_ARGS", "1", "NOT broken AND n_params > 6", 3, "name, n_params"),
    "QUAL_DEEP_NESTING": _rule("QUAL_DEEP_NESTING", "2", "NOT broken AND nesting > 4", 4, "name, nesting"),
    "QUAL_MUTABLE_DEFAULT": _rule("QUAL_MUTABLE_DEFAULT", "2", "NOT broken AND mut = 1", 5, "name"),
    "QUAL_BARE_EXCEPT": _rule("QUAL_BARE_EXCEPT", "1", "NOT broken AND bare = 1", 6, "", "except_line"),
}
_QUALITY = "quality AS (" + "\nUNION ALL ".join(_QUALITY_RULES.values()) + ")"

_GAPS = """
bare_repos AS (
 SELECT repo, count(*) AS n FROM mods GROUP BY repo HAVING repo NOT IN (SELECT repo FROM tests)),
untested AS (
 SELECT repo, path, name, CAST(head AS INT) AS line, 'function' AS kind FROM mods m
 WHERE NOT broken AND k % 10 <> 0 AND repo NOT IN (SELECT repo FROM bare_repos)
  AND NOT EXISTS (SELECT 1 FROM tests t WHERE t.repo = m.repo AND t.k = m.k)),
gaps AS (
 SELECT repo, 'test-gap' AS agent, 2 AS agent_ord, 'TEST_NO_TESTS' AS rule, 2 AS severity,
  'Codebase contains no test files' AS title, '.' AS file, 0 AS line,
  printf('%d Python file(s) but no test_*.py / *_test.py. Untested code regresses silently.', n) AS detail, 0 AS seq
 FROM bare_repos
 UNION ALL
 SELECT repo, 'test-gap', 2, 'TEST_GAP', 1, printf('No test references %s `%s`', kind, name), path, line,
  'Nothing in the test suite mentions this name; it has no direct test.', 0
 FROM untested"""
_GAPS_ALL = _GAPS + ")"
_GAPS += """
 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY replace(path, '/', chr(1))) <= 15)"""

# Documentation findings of the generated packages and, with `prose`, of the document repositories.
_DOCS = """
doc_rows AS (
 SELECT repo, 'DOC_NO_README' AS rule, 1 AS severity, 'Repository has no README' AS title, '.' AS file, 0 AS line,
  'A README is the first thing reviewers and new contributors read.' AS detail, '' AS place, 0 AS seq
 FROM (SELECT DISTINCT repo, (k % 50) AS pkg FROM mods) WHERE pkg % 2 = 0
 UNION ALL
 SELECT repo, 'DOC_NO_MODULE_DOC', 0, printf('Module `%s` has no docstring', path), path, 1,
  'Open every module with one line saying what it''s for.', replace(path, '/', chr(1)), 0
 FROM mods WHERE NOT broken AND moddoc = 0
 UNION ALL
 SELECT repo, 'DOC_MISSING_DOCSTRING', 0, printf('Public function `%s` has no docstring', name), path, head,
  'Describe behavior and edge cases — especially what happens on failure.', replace(path, '/', chr(1)), 1
 FROM mods WHERE NOT broken AND doc = 0 AND k % 10 <> 0),
"""
_DOCS_ALL = _DOCS + """
docs AS (
 SELECT repo, 'documentation' AS agent, 3 AS agent_ord, rule, severity, title, file, CAST(line AS INT) AS line, detail, seq
 FROM doc_rows)"""
_DOCS += """
numbered_docs AS (
 SELECT *, row_number() OVER (PARTITION BY repo ORDER BY place, seq) AS rn FROM doc_rows),
docs AS (
 SELECT repo, 'documentation' AS agent, 3 AS agent_ord, rule, severity, title, file, CAST(line AS INT) AS line, detail, seq
 FROM (SELECT *, min(CASE WHEN rule = 'DOC_MISSING_DOCSTRING' AND rn >= 25 THEN rn END) OVER (PARTITION BY repo) AS stop
       FROM numbered_docs) d
 WHERE stop IS NULL OR rn <= stop)"""

# Three results per line item; reports of orders 0 and 1 modulo 50 cannot be read.
_SAST = """
sast AS (
 SELECT concat('pkg-', l_orderkey % 50) AS repo, 'security' AS agent, 0 AS agent_ord,
  CASE WHEN pos = 1 THEN CASE WHEN l_linenumber = 5 THEN 'BANDIT' ELSE concat('B60', l_linenumber) END ELSE 'B101' END AS rule,
  CASE l_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS severity,
  concat('issue ', l_partkey % 50) AS title, concat('src/m', l_suppkey, '.py') AS file,
  CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE l_orderkey % 90 + l_linenumber END AS INT) AS line,
  concat('check_', l_linenumber, ' (confidence: ', CASE WHEN l_suppkey % 2 = 0 THEN 'HIGH' ELSE '?' END, ')') AS detail,
  pos AS seq
 FROM lineitem, (VALUES (1), (2)) AS p(pos) WHERE l_orderkey % 50 > 1)"""


def _secrets(table: str) -> str:
    pattern = r"""(?i)(?:password|passwd|secret|token|api_?key)\s*[:=]\s*[\"']([^\"'\s]{8,})[\"']"""
    generic = "'" + pattern.replace("'", "''") + "'"
    aws = r"'\b(AKIA[0-9A-Z]{16})\b'"

    def hits(rule: str, severity: int, title: str, expression: str, at: int) -> str:
        return (
            f"SELECT repo, path, line, '{rule}' AS rule, {severity} AS severity, '{title}' AS title, "
            f"{1 << 40} + {at * 1000} AS base, unnest(regexp_extract_all(text, {expression}, 1)) AS value "
            f"FROM secret_lines"
        )

    return f"""
secret_lines AS (
 SELECT repo, path, unnest({_lines('content')}) AS text, generate_subscripts({_lines('content')}, 1) AS line
 FROM {table} WHERE NOT ({_SKIPPED})),
secret_hits AS (
 {hits('SECRET_AWS_KEY', 4, 'Hard-coded AWS access key', aws, 0)}
 UNION ALL
 {hits('SECRET_GENERIC', 3, 'Hard-coded credential', generic, 1)}),
secrets AS (
 SELECT repo, 'security' AS agent, 0 AS agent_ord, rule, severity, title, path AS file, CAST(line AS INT) AS line,
  printf('Value of %d characters starting `%s`; rotate it and load it at run time.', length(value), left(value, 4)) AS detail,
  base AS seq
 FROM secret_hits)"""


_SHOWN = "repo, rule, severity, title, file, line, detail"


def _wide(findings: str = "findings") -> str:
    """Counts and scores of every review."""
    return f"""
totals AS (
 SELECT review_id, count(*) AS total, sum({_PENALTY}) AS penalty,
  count(*) FILTER (severity = 4) AS critical, count(*) FILTER (severity = 3) AS high,
  count(*) FILTER (severity = 2) AS medium, count(*) FILTER (severity = 1) AS low,
  count(*) FILTER (severity = 0) AS info
 FROM {findings} GROUP BY review_id),
wide AS (
 SELECT r.*, coalesce(total, 0) AS total, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high,
  coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(info, 0) AS info,
  CAST(greatest(0, 100 - coalesce(penalty, 0)) AS INT) AS health_score
 FROM reviews r LEFT JOIN totals USING (review_id))"""


_AGENTS = f"""
agents AS (
 SELECT review_id, '{{' || string_agg('"' || agent || '":' || n, ',' ORDER BY agent_ord) || '}}' AS agents_json
 FROM (SELECT review_id, agent, agent_ord, count(*) AS n FROM findings GROUP BY ALL) a GROUP BY review_id)"""

_HISTORY = (
    f"WITH {_FINDINGS}, {_REVIEWS}, {_wide()}, {_AGENTS}, "
    "history AS (SELECT row_number() OVER (ORDER BY w.review_id % 2, w.created_at, w.review_id) AS id, w.*, "
    "coalesce(agents_json, '{}') AS agents_json FROM wide w LEFT JOIN agents USING (review_id))"
)
_HISTORY_COLUMNS = (
    "review_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') AS created_at, source, repo, "
    "pr_number, total, critical, high, medium, low, info, health_score, agents_json"
)
_SUMMARY = f"""string_agg({_EMOJI} || ' ' || n || ' ' || {_LABEL}, ' · ' ORDER BY severity DESC)"""


# Lines of the details that replies add, over findings with their index.
_REPLIED = "i % 2 = 0 AND review_id % 17 <> 0 AND (review_id % 19 <> 0 OR review_id % 13 = 0)"
_EXPLAINED = f"CASE WHEN {_REPLIED} THEN {_NL} || '- _Risk:_ why ' || i || {_NL} || '- _Fix:_ fix ' || title ELSE '' END"


def _markdown(failures: bool, more: str = "''") -> str:
    place = "'`' || file || CASE WHEN line <> 0 THEN ':' || line ELSE '' END || '`'"
    failed = (
        "(SELECT string_agg(printf('> ⚠️ `%s` agent failed: %s', agent, error) || chr(10), chr(10) "
        "ORDER BY agent, error) FROM failures f WHERE f.review_id = w.review_id)"
        if failures else "NULL"
    )
    return f"""
summaries AS (
 SELECT review_id, {_SUMMARY} AS summary
 FROM (SELECT review_id, severity, count(*) AS n FROM findings GROUP BY ALL) s GROUP BY review_id),
bodies AS (
 SELECT review_id,
  string_agg('| ' || {_EMOJI} || ' ' || {_LABEL} || ' | ' || title || ' | ' || {place} || ' | `' || rule || '` |',
   {_NL} ORDER BY {_RANK_ORDER}) AS table_rows,
  string_agg({_NL} || '**' || {_EMOJI} || ' ' || title || '** (`' || file || ':' || line || '`, `' || rule || '`)'
   || {_NL} || '- ' || detail || {more}, {_NL} ORDER BY {_RANK_ORDER}) AS details
 FROM {'findings' if more == "''" else 'indexed'} GROUP BY review_id),
documents_md AS (
 SELECT w.review_id, CAST(0 AS BIGINT) AS part,
  concat_ws({_NL}, '## {fixed.REPORT_TITLE}' || {_NL},
   '**Code-health score: ' || health_score || '/100** · ' || total || ' finding(s)' || {_NL},
   {failed},
   CASE WHEN total = 0 THEN '{fixed.REPORT_CLEAN}' || {_NL} ELSE concat_ws({_NL}, summary || {_NL},
    '| Sev | Issue | Location | Rule |', '|-----|-------|----------|------|', table_rows,
    {_NL} || '<details><summary>Details</summary>' || {_NL}, details, {_NL} || '</details>') END) AS body
 FROM wide w LEFT JOIN summaries USING (review_id) LEFT JOIN bodies USING (review_id))"""


def _chunks(where: str = "", less: str = "") -> str:
    return f"""
eligible AS (
 SELECT repo, path, content, row_number() OVER (PARTITION BY repo ORDER BY {_ORDER}) AS file_no
 FROM files WHERE {_SUFFIX} IN ('.py', '.md', '.rst', '.txt')
  AND len(list_filter(string_split(path, '/'), lambda p: p IN ('data', '.codeaudit', '{"', '".join(fixed.SKIP_DIRS)}'))) = 0),
chosen AS (
 SELECT repo, 0 AS last, path, content FROM eligible {where}
 UNION ALL
 SELECT DISTINCT repo, 1, '{fixtures.STANDARDS[0]}', '{fixtures.STANDARDS[1].replace(chr(10), "' || chr(10) || '")}' FROM files),
lined AS (SELECT *, {_lines('content')} AS ls FROM chosen),
started AS (SELECT *, unnest(range(1, len(ls) + 1, {fixtures.CHUNK_LINES})) AS first_line FROM lined),
bodies AS (
 SELECT *, regexp_replace(array_to_string(ls[first_line:first_line + {fixtures.CHUNK_LINES - 1}], {_NL}), '^\\s+|\\s+$', '', 'g') AS body
 FROM started),
numbered AS (
 SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY last, {_ORDER}, first_line) - 1 AS ord,
  path || ':' || first_line AS source, body AS text
 FROM bodies WHERE body <> ''),
chunks AS (SELECT repo, ord, source, text FROM numbered {less})"""


_CHUNKS = _chunks()

_TOPK = f"""
chunk_words AS (
 SELECT repo, ord, source, list_transform(regexp_extract_all(text, '{fixed.WORD}'), lambda w: lower(w)) AS ws FROM chunks),
query_words AS (
 SELECT query_id, repo, list_distinct(list_transform(regexp_extract_all(query, '{fixed.WORD}'), lambda w: lower(w))) AS qs FROM asked),
scored AS (
 SELECT query_id, c.repo, ord, source,
  len(list_filter(ws, lambda w: list_contains(qs, w))) / sqrt(len(ws)) AS score
 FROM query_words q JOIN chunk_words c ON q.repo = c.repo WHERE len(ws) > 0),
best AS (
 SELECT query_id, repo, CAST(rank AS INT) AS rank, ord, source, round(score, 6) AS score
 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM scored) s
 WHERE rank <= 4 AND score > 0)"""

def _distance(a: str, b: str) -> str:
    return f"round(list_sum(list_transform(list_zip({a}, {b}), lambda p: power(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))), 6)"


def _nearest(limit: str) -> str:
    return f"""WITH v AS (
 SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS ord FROM embeddings),
d AS (
 SELECT q.vec_id AS query_id, x.vec_id, {_distance('q.embedding', 'x.embedding')} AS distance
 FROM v q JOIN v x ON q.label = x.label {limit})
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank, vec_id, distance
FROM d QUALIFY rank <= 4"""


def _retrieval_query(text: str) -> str:
    return f"""WITH {_FINDINGS}, t AS (
 SELECT repo, rule || ' ' || title AS s, min(struct_pack(a := file, b := line, c := rule)) AS place FROM findings GROUP BY 1, 2)
SELECT repo, {text.format("string_agg(s, ' ' ORDER BY place, s)")} AS query FROM t GROUP BY repo"""


_LIST_ORDER = (
    "CASE WHEN agent = 'security' THEN seq ELSE 0 END, replace(file, '/', chr(1)), seq, line, rule, severity, title, detail"
)
_INDEXED = f"""
indexed AS (
 SELECT *, CAST(row_number() OVER (PARTITION BY review_id, agent ORDER BY {_LIST_ORDER}) - 1 AS INT) AS i FROM findings)"""


def _candidates(table: str, limit: str = "") -> str:
    return f"""
candidates AS (
 SELECT *, CAST(row_number() OVER (PARTITION BY review_id ORDER BY {_RANK_ORDER}) - 1 AS INT) AS i
 FROM {table} WHERE severity >= 1 AND line > 0
 {limit})"""


def _proposals(limit: str = "") -> str:
    return f"""{_candidates('file_findings', limit)},
replied AS (
 SELECT c.*, content, CASE WHEN c.seq % 4 <= 1 THEN left(content, 40) WHEN c.seq % 4 = 2 THEN 'e' ELSE 'ZZZZ-absent' END AS original,
  CASE WHEN c.seq % 3 = 0 THEN 'note ' || c.seq ELSE '' END AS note
 FROM candidates c JOIN flat f ON c.repo = f.repo AND c.file = f.path),
proposals AS (
 SELECT review_id, i, file, line, rule, title, original,
  CASE WHEN seq % 4 = 1 THEN original || {_NL} || 'added' ELSE '<' || original || '>' END AS fixed, note
 FROM replied
 WHERE (length(content) - length(replace(content, original, ''))) / length(original) = 1)"""


_TEN = "QUALIFY i < 10"


def _fix_report(limit: str, per_part: int) -> str:
    return f"""WITH {_FLAT}, {_FILE_FINDINGS}, {_proposals(limit)},
numbered AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY i) AS n FROM proposals)
SELECT review_id, (n - 1) // {per_part} AS part,
 '[' || string_agg('{{"file":"' || file || '","line":' || line || ',"rule":"' || rule || '","title":"' || title || '","original":'
  || CAST(to_json(original) AS VARCHAR) || ',"fixed":' || CAST(to_json(fixed) AS VARCHAR) || ',"note":"' || note || '"}}', ',' ORDER BY n) || ']' AS fixes_json,
 CASE WHEN (n - 1) // {per_part} = 0 THEN '# Proposed fixes' || {_NL} || {_NL} ELSE '' END || string_agg(
  '## ' || n || '. ' || title || ' (`' || file || ':' || line || '`, `' || rule || '`)' || {_NL}
  || CASE WHEN note <> '' THEN note || {_NL} ELSE '' END || {_NL} || '```diff' || {_NL}
  || array_to_string(list_transform({_lines('original')}, lambda l: '- ' || l), {_NL}) || {_NL}
  || array_to_string(list_transform({_lines('fixed')}, lambda l: '+ ' || l), {_NL}) || {_NL} || '```' || {_NL}, {_NL} ORDER BY n) AS fixes_md
FROM numbered GROUP BY review_id, part"""


def _count(text: str, part: str) -> str:
    return f"((length({text}) - length(replace({text}, {part}, ''))) // length({part}))"


_PATCHED = f"""
step1 AS (
 SELECT repo, path, left(content, 40) AS o1, content AS t0 FROM flat),
step2 AS (
 SELECT *, '<<' || o1 || '>>' AS o2, {_count('t0', 'o1')} = 1 AS a1 FROM step1),
step3 AS (
 SELECT *, CASE WHEN a1 THEN '<<' || o1 || '>>' || substr(t0, 41) ELSE t0 END AS t1 FROM step2),
step4 AS (
 SELECT *, {_count('t1', 'o2')} = 1 AS a2, strpos(t1, o2) AS p2 FROM step3),
step5 AS (
 SELECT *, CASE WHEN a2 THEN left(t1, p2 - 1) || '[[patched]]' || substr(t1, p2 + length(o2)) ELSE t1 END AS t2 FROM step4),
step6 AS (
 SELECT *, {_count('t2', "'e'")} = 1 AS a3, strpos(t2, 'e') AS p3 FROM step5)"""


def _hmac(body: str) -> str:
    key = fixtures.SECRET.encode().ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in key).hex()
    outer = bytes(b ^ 0x5C for b in key).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({body}))))"


_CLASSIFIED = f"""
signed AS (
 SELECT *, CASE WHEN event_id % 10 = 3 THEN 'sha256=deadbeef' WHEN event_id % 10 <> 7 THEN 'sha256=' || {_hmac('body')} END AS signature
 FROM deliveries),
judged AS (
 SELECT *, CASE
  WHEN coalesce(signature, '') <> 'sha256=' || {_hmac('body')} THEN 'rejected'
  WHEN event <> 'pull_request' THEN 'skipped event'
  WHEN NOT json_valid(body) OR json_type(body) <> 'OBJECT' THEN 'malformed'
  WHEN body->>'$.action' NOT IN ('opened', 'synchronize', 'reopened') THEN 'skipped action'
  WHEN body->>'$.repository.full_name' IS NULL OR body->>'$.number' IS NULL THEN 'malformed'
  ELSE 'accepted' END AS disposition
 FROM signed),
classified AS (
 SELECT event_id, event, disposition,
  CASE WHEN disposition = 'accepted' THEN body->>'$.repository.full_name' END AS repo,
  CASE WHEN disposition = 'accepted' THEN CAST(body->>'$.number' AS BIGINT) END AS pr_number,
  CASE WHEN disposition = 'accepted' THEN body->>'$.pull_request.head.ref' END AS ref,
  CASE WHEN disposition = 'accepted' THEN body->>'$.pull_request.head.sha' END AS sha
 FROM judged)"""

_CORPUS = """
corpus AS (
 SELECT 'octo/r' || substr(repo, 4) AS repo, 's' || substr(repo, 4) AS sha, repo AS source_repo, path
 FROM prose WHERE CAST(substr(repo, 4) AS INT) < 15)"""

# Findings of document repositories: secrets where there is code, and the README rule.
_PROSE_FINDINGS = f"""
prose_kept AS (SELECT repo, {_SUFFIX} AS suffix FROM prose WHERE NOT ({_SKIPPED})),
prose_docs AS (
 SELECT repo, 'documentation' AS agent, 3 AS agent_ord, 'DOC_NO_README' AS rule, 1 AS severity,
  'Repository has no README' AS title, '.' AS file, 0 AS line,
  'A README is the first thing reviewers and new contributors read.' AS detail, 0 AS seq
 FROM (SELECT DISTINCT repo FROM prose_kept WHERE suffix = '.md')),
prose_found AS (
 SELECT * FROM secrets WHERE repo IN (SELECT repo FROM prose_kept WHERE suffix IN ('.js', '.ts'))
 UNION ALL SELECT * FROM prose_docs)"""


def _review(gaps: str, docs: str) -> str:
    return (
        f"WITH {_PROSE}, {_MODULES}, {_QUALITY}, {gaps}, {docs}, {_SAST}, {_secrets('prose')}, {_PROSE_FINDINGS}, "
        """found AS (
 SELECT * FROM sast WHERE repo IN (SELECT repo FROM mods)
 UNION ALL SELECT * FROM quality UNION ALL SELECT * FROM gaps UNION ALL SELECT * FROM docs
 UNION ALL SELECT * FROM prose_found)"""
    )


_REVIEW = _review(_GAPS_ALL, _DOCS_ALL)
_RANKED = (
    f"SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY {_RANK_ORDER}) AS rank, agent, rule, severity, "
    "title, file, line, detail FROM found"
)

ORACLE: dict[str, str] = {
    "corpus_scan": f"WITH {_FILES} SELECT repo, path, CAST(length(content) AS INT) AS n_chars, md5(content) AS digest FROM files",
    "dir_scan": f"WITH {_FILES} SELECT repo, path, CAST(length(content) AS INT) AS n_chars, md5(content) AS digest FROM files",
    "skip_dir_filter": f"WITH {_FILES} SELECT repo, path FROM files WHERE NOT ({_SKIPPED})",
    "test_file_split": f"WITH {_FILES} SELECT repo, path, {_IS_TEST} AS is_test, {_BY_NAME} AS by_name FROM files",
    "safe_path": f"""WITH {_PATHS}
SELECT repo, doc_id, path, concat('d', doc_id, '/m.txt') AS safe_path FROM paths WHERE doc_id % 6 IN (1, 3, 5)""",
    "tokenize": f"""WITH {_FILES}, w AS (
 SELECT repo, path, list_transform(regexp_extract_all(content, '{fixed.WORD}'), lambda w: lower(w)) AS ws FROM files)
SELECT repo, path, CAST(len(ws) AS INT) AS n_words, array_to_string(ws, ' ') AS words FROM w""",
    "file_census": f"""WITH {_FILES}
SELECT repo, CASE WHEN {_SUFFIX} = '' THEN '<none>' ELSE {_SUFFIX} END AS suffix, count(*) AS n
FROM files WHERE NOT ({_SKIPPED}) GROUP BY 1, 2""",
    "route_agents": f"""WITH {_FILES}, s AS (SELECT DISTINCT repo, {_SUFFIX} AS suffix FROM files WHERE NOT ({_SKIPPED}))
SELECT DISTINCT repo, 'security' AS agent FROM s WHERE suffix IN ('.py', '.js', '.ts')
UNION ALL SELECT DISTINCT repo, unnest(['quality', 'test-gap']) FROM s WHERE suffix = '.py'
UNION ALL SELECT DISTINCT repo, 'documentation' FROM s WHERE suffix IN ('.py', '.md')""",
    "secret_scan": f"WITH {_FILES}, {_secrets('files')} SELECT {_SHOWN} FROM secrets",
    "secret_scan_rules": f"""WITH {_FILES},
rules AS (SELECT DISTINCT printf('%03x', o_orderkey % 4096) AS start FROM orders),
rule_lines AS (
 SELECT repo, path, unnest({_lines('content')}) AS text, generate_subscripts({_lines('content')}, 1) AS line FROM files WHERE NOT ({_SKIPPED})),
rule_hits AS (SELECT repo, path, line, unnest(regexp_extract_all(text, '= "([0-9a-f]{{40}})"', 1)) AS value FROM rule_lines)
SELECT repo, 'KEY_' || upper(start) AS rule, 3 AS severity, 'Key that starts ' || start AS title, path AS file, CAST(line AS INT) AS line,
 printf('Value of 40 characters starting `%s`; rotate it and load it at run time.', left(value, 4)) AS detail
FROM rule_hits JOIN rules ON start = left(value, 3)""",
    "sast_ingest": f"WITH {_SAST} SELECT {_SHOWN} FROM sast",
    "py_facts": f"""WITH {_MODULES}
SELECT repo, path, CASE WHEN NOT broken THEN moddoc = 1 END AS has_doc, CASE WHEN broken THEN 'SyntaxError' END AS error,
 CASE WHEN broken THEN 0 ELSE 1 END AS n_functions, CASE WHEN broken THEN 0 ELSE 1 END AS n_defs,
 CASE WHEN broken THEN 0 ELSE bare END AS n_handlers, CASE WHEN broken THEN 0 ELSE complexity - 1 END AS n_decisions
FROM mods
UNION ALL SELECT repo, path, true, NULL, 1, 1, 0, 1 FROM tests""",
    "py_complexity": f"WITH {_MODULES} SELECT repo, path, name, complexity FROM mods WHERE NOT broken",
    "py_nesting": f"WITH {_MODULES} SELECT repo, path, name, nesting FROM mods WHERE NOT broken",
    **{
        query: f"WITH {_MODULES}, q AS ({_QUALITY_RULES[rule]}) SELECT {_SHOWN} FROM q"
        for query, rule in {
            "py_long_func": "QUAL_LONG_FUNC", "py_many_args": "QUAL_MANY_ARGS",
            "py_mutable_default": "QUAL_MUTABLE_DEFAULT", "py_bare_except": "QUAL_BARE_EXCEPT",
            "py_syntax_errors": "QUAL_SYNTAX_ERROR",
        }.items()
    },
    "quality_findings": f"WITH {_MODULES}, {_QUALITY} SELECT {_SHOWN} FROM quality",
    "test_identifiers": f"""WITH {_FILES}
SELECT DISTINCT repo, unnest(regexp_extract_all(content, '{fixed.IDENTIFIER}')) AS name
FROM files WHERE {_SUFFIX} = '.py' AND NOT ({_SKIPPED}) AND {_IS_TEST}""",
    "no_tests": f"WITH {_MODULES}, {_GAPS} SELECT {_SHOWN} FROM gaps WHERE rule = 'TEST_NO_TESTS'",
    "test_gap": f"WITH {_MODULES}, {_GAPS} SELECT repo, path, name, line, kind FROM untested",
    "test_gap_capped": f"WITH {_MODULES}, {_GAPS} SELECT {_SHOWN} FROM gaps",
    "no_readme": f"""WITH {_PROSE}, {_MODULES}
SELECT DISTINCT repo, 'DOC_NO_README' AS rule, 1 AS severity, 'Repository has no README' AS title
FROM (SELECT repo FROM prose UNION ALL SELECT repo FROM mods WHERE k % 50 % 2 = 0) r""",
    "docs_findings": f"WITH {_MODULES}, {_DOCS} SELECT {_SHOWN} FROM docs",
    "docs_findings_all": f"WITH {_MODULES}, {_DOCS_ALL} SELECT {_SHOWN} FROM docs",
    "ranked_findings": f"""WITH {_FINDINGS}
SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY {_RANK_ORDER}) AS rank FROM findings""",
    "health_score": f"WITH {_FINDINGS}, {_REVIEWS}, {_wide()} SELECT review_id, repo, health_score FROM wide",
    "severity_pivot": f"""WITH {_FINDINGS}, {_REVIEWS}, {_wide()}
SELECT review_id, total, critical, high, medium, low, info, health_score FROM wide""",
    "severity_summary": f"""WITH {_FINDINGS}
SELECT review_id, {_SUMMARY} AS summary
FROM (SELECT review_id, severity, count(*) AS n FROM findings GROUP BY ALL) s GROUP BY review_id""",
    "agent_counts": f"WITH {_FINDINGS}, {_AGENTS} SELECT review_id, agents_json FROM agents",
    "fix_candidates": f"""WITH {_FINDINGS}, {_candidates('findings', _TEN)}
SELECT review_id, i, severity, file, line, rule, title, detail FROM candidates""",
    "fix_candidates_all": f"""WITH {_FINDINGS}, {_candidates('findings')}
SELECT review_id, i, severity, file, line, rule, title, detail FROM candidates""",
    "markdown_report": f"""WITH {_FINDINGS}, {_REVIEWS}, {_FAILURES}, {_wide()}, {_markdown(True)}
SELECT review_id, part, body FROM documents_md""",
    "comment_outbox": f"""WITH {_FINDINGS}, {_REVIEWS}, {_wide()}, {_markdown(False)}
SELECT repo, pr_number AS pr, review_id, part, body, false AS posted
FROM reviews JOIN documents_md USING (review_id) WHERE pr_number IS NOT NULL""",
    "history_rows": f"{_HISTORY} SELECT id, {_HISTORY_COLUMNS} FROM history h",
    "history_recent": f"{_HISTORY} SELECT id, {_HISTORY_COLUMNS} FROM history h ORDER BY id DESC LIMIT 100",
    "history_summary": f"""{_HISTORY}
SELECT count(*) AS reviews, CAST(coalesce(sum(total), 0) AS BIGINT) AS findings, max_by(health_score, id) AS latest_health FROM history""",
    "health_trend": f"""{_HISTORY}
SELECT repo, strftime(created_at, '%Y-%m') AS period, count(*) AS reviews, round(avg(health_score), 4) AS mean_score,
 min(health_score) AS lowest_score FROM history GROUP BY 1, 2""",
    "totals_by_severity": f"""WITH {_FINDINGS}, s(level, severity) AS (VALUES (4, 'Critical'), (3, 'High'), (2, 'Medium'), (1, 'Low'), (0, 'Info'))
SELECT s.severity, count(f.review_id) AS n FROM s
LEFT JOIN (SELECT * FROM findings WHERE review_id IN (SELECT o_orderkey FROM orders)) f ON f.severity = s.level GROUP BY 1""",
    "totals_by_agent": f"""WITH {_FINDINGS}
SELECT agent, count(*) AS n FROM findings WHERE review_id IN (SELECT o_orderkey FROM orders) GROUP BY agent""",
    "chunk_index": f"WITH {_FILES}, {_CHUNKS} SELECT repo, ord, source, text FROM chunks",
    "chunk_index_capped": f"WITH {_FILES}, {_chunks(f'WHERE file_no <= {fixtures.INDEX_FILES}', f'WHERE ord < {fixtures.INDEX_CHUNKS}')} SELECT repo, ord, source, text FROM chunks",
    "keyword_topk": f"WITH {_FILES}, {_CHUNKS}, {_CHUNK_QUERIES}, {_TOPK} SELECT query_id, repo, rank, ord, source, score FROM best",
    "vector_topk": _nearest(""),
    "vector_topk_capped": _nearest(f"AND x.ord <= {fixtures.INDEX_CHUNKS}"),
    "retrieve": f"""WITH {_FILES}, {_CHUNKS}, {_CHUNK_QUERIES}, {_TOPK},
held AS (
 SELECT c.*, e.embedding FROM chunks c JOIN embeddings e ON c.repo = 'src' || (e.vec_id % 7) AND c.ord = e.vec_id // 7),
near AS (
 SELECT query_id, h.repo, h.ord, source, text, {_distance('q.embedding', 'h.embedding')} AS distance
 FROM asked a JOIN embeddings q ON q.vec_id = a.query_id JOIN held h ON h.repo = a.repo WHERE a.query_id % 2 = 0 AND trim(a.query) <> ''),
by_vector AS (
 SELECT query_id, repo, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, ord) AS INT) AS rank, ord, source, text, 'vector' AS backend
 FROM near QUALIFY rank <= 4)
SELECT * FROM by_vector
UNION ALL
SELECT query_id, b.repo, rank, b.ord, b.source, c.text, 'keyword' FROM best b JOIN chunks c ON b.repo = c.repo AND b.ord = c.ord
WHERE query_id NOT IN (SELECT query_id FROM by_vector)""",
    "context_block": f"""WITH {_FILES}, {_CHUNKS}, {_CHUNK_QUERIES}, {_TOPK}
SELECT query_id, string_agg('[' || b.source || ']' || {_NL} || text, {_NL} || {_NL} ORDER BY rank) AS context
FROM best b JOIN chunks c ON b.repo = c.repo AND b.ord = c.ord GROUP BY query_id""",
    "retrieval_query": _retrieval_query("{}"),
    "retrieval_query_capped": _retrieval_query("left({}, 600)"),
    "triage_prompt": f"""WITH {_FINDINGS}, {_INDEXED},
payloads AS (
 SELECT review_id, agent, CAST(i // {fixtures.PROMPT_FINDINGS} AS INT) AS batch,
  '[' || string_agg(printf('{{"i":%d,"rule":"%s","title":"%s","file":"%s","line":%d,"severity":"%s"}}', i, rule, title, file, line, {_LABEL}),
   ',' ORDER BY i) || ']' AS payload
 FROM indexed GROUP BY 1, 2, 3)
SELECT review_id, agent, batch, payload,
 'As a ' || CASE agent {' '.join(f"WHEN '{a}' THEN '{r}'" for a, r in fixed.AGENT_ROLES.items())} ELSE 'code reviewer' END || ', {enrich.TRIAGE_TASK}' || {_NL} || {_NL}
 || CASE WHEN agent = 'quality' AND review_id % 3 = 0 AND review_id IN (SELECT o_orderkey FROM orders)
    THEN 'From the same repository:' || {_NL} || '[notes.md:1]' || {_NL} || 'note ' || review_id || {_NL} || {_NL} ELSE '' END
 || 'Findings:' || {_NL} || payload AS prompt
FROM payloads""",
    "explained_report": f"""WITH {_FINDINGS}, {_INDEXED}, {_REVIEWS}, {_FAILURES}, {_wide()}, {_markdown(True, _EXPLAINED)}
SELECT review_id, part, body FROM documents_md""",
    "fix_prompts": f"""WITH {_FLAT}, {_FILE_FINDINGS}, {_candidates('file_findings', _TEN)},
snippets AS (
 SELECT review_id, i, rule, title, file, line, array_to_string({_lines('content')}[greatest(1, line - 8):line + 8], {_NL}) AS snippet
 FROM candidates c JOIN flat f ON c.repo = f.repo AND c.file = f.path),
payloads AS (
 SELECT review_id, '[' || string_agg(printf('{{"i":%d,"rule":"%s","title":"%s","file":"%s","line":%d,"snippet":', i, rule, title, file, line)
  || CAST(to_json(snippet) AS VARCHAR) || '}}', ',' ORDER BY i) || ']' AS payload
 FROM snippets GROUP BY review_id)
SELECT review_id, payload, '{enrich.FIX_TASK}' || {_NL} || {_NL} || 'Findings with snippets:' || {_NL} || payload AS prompt FROM payloads""",
    "triage_enrich": f"""WITH {_FINDINGS}, {_INDEXED}
SELECT review_id, agent, i, rule, title,
 CASE WHEN i % 2 = 0 AND review_id % 17 <> 0 AND (review_id % 19 <> 0 OR review_id % 13 = 0) THEN 'why ' || i ELSE '' END AS explanation,
 CASE WHEN i % 2 = 0 AND review_id % 17 <> 0 AND (review_id % 19 <> 0 OR review_id % 13 = 0) THEN 'fix ' || title ELSE '' END AS fix_hint
FROM indexed""",
    "fix_snippets": f"""WITH {_FLAT}, {_FILE_FINDINGS}, {_candidates('file_findings')}
SELECT review_id, i, file, line, array_to_string({_lines('content')}[greatest(1, line - 8):line + 8], {_NL}) AS snippet
FROM candidates c JOIN flat f ON c.repo = f.repo AND c.file = f.path""",
    "patch_validate": f"""WITH {_FLAT}, {_FILE_FINDINGS}, {_proposals()}
SELECT review_id, i, file, line, rule, title, original, fixed, note FROM proposals""",
    "fix_report": _fix_report("", fixtures.PART_FIXES),
    "fix_report_capped": _fix_report(_TEN, 1000),
    "autofix": f"""WITH {_FLAT}, {_FILE_FINDINGS}, {_proposals()}
SELECT f.repo, f.path, md5(left(f.content, strpos(f.content, original) - 1) || fixed || substr(f.content, strpos(f.content, original) + length(original))) AS digest,
 CAST(1 AS INT) AS n_applied
FROM proposals p JOIN flat f ON p.review_id = f.repo AND p.file = f.path""",
    "patch_apply": f"""WITH {_FLAT}, {_PATCHED}
SELECT repo, path, CASE WHEN a3 THEN left(t2, p3 - 1) || 'E' || substr(t2, p3 + 1) ELSE t2 END AS new_content,
 a1::INT + a2::INT + a3::INT AS n_applied FROM step6""",
    "deliveries_classified": f"WITH {_DELIVERIES}, {_CLASSIFIED} SELECT * FROM classified",
    "deliveries_stream": f"WITH {_DELIVERIES}, {_CLASSIFIED} SELECT * FROM classified",
    "pr_snapshot": f"""WITH {_DELIVERIES}, {_CLASSIFIED}, {_PROSE}, {_CORPUS}
SELECT repo, sha, path FROM (SELECT DISTINCT repo, sha FROM classified WHERE disposition = 'accepted') LEFT JOIN corpus USING (repo, sha)""",
    "webhook_reviews": f"""WITH {_DELIVERIES}, {_CLASSIFIED}, {_PROSE}, {_CORPUS}, {_secrets('prose')}, {_PROSE_FINDINGS},
heads AS (
 SELECT h.repo, count(p.rule) AS findings, CAST(greatest(0, 100 - coalesce(sum({_PENALTY}), 0)) AS INT) AS health_score
 FROM (SELECT DISTINCT repo, source_repo FROM corpus) h LEFT JOIN prose_found p ON p.repo = h.source_repo
 GROUP BY h.repo)
SELECT event_id, c.repo, pr_number AS pr, findings, health_score, false AS comment_posted
FROM classified c LEFT JOIN heads USING (repo) WHERE disposition = 'accepted'""",
    "review_all": f"{_REVIEW} {_RANKED}",
    "review_capped": f"{_review(_GAPS, _DOCS)} {_RANKED}",
    "review_scores": f"""{_REVIEW}
SELECT repo, count(rule) AS total, count(*) FILTER (severity = 4) AS critical, count(*) FILTER (severity = 3) AS high,
 count(*) FILTER (severity = 2) AS medium, count(*) FILTER (severity = 1) AS low, count(*) FILTER (severity = 0) AS info,
 CAST(greatest(0, 100 - coalesce(sum({_PENALTY}), 0)) AS INT) AS health_score
FROM (SELECT repo FROM prose UNION SELECT repo FROM mods) r LEFT JOIN found USING (repo) GROUP BY repo""",
    "agent_status": f"""{_REVIEW},
scanned AS (SELECT repo, path, content FROM prose WHERE NOT ({_SKIPPED}) AND {_SUFFIX} IN ('.js', '.ts')),
raised AS (
 SELECT repo, 'licences' AS agent, min(path || ': ValueError: table in prose') || CASE WHEN count(*) > 1 THEN printf(' (and %d more)', count(*) - 1) ELSE '' END AS error
 FROM scanned WHERE content LIKE '%|%' GROUP BY repo),
status_found AS (
 SELECT repo, agent, rule FROM found
 UNION ALL SELECT repo, 'licences', 'LICENCE' FROM (SELECT repo, unnest({_lines('content')}) AS line FROM scanned) l
 WHERE line LIKE '%Licen%' AND repo NOT IN (SELECT repo FROM raised)),
routes AS (
 SELECT DISTINCT repo, unnest(['security', 'quality', 'test-gap', 'documentation']) AS agent FROM mods
 UNION ALL SELECT DISTINCT repo, 'security' FROM prose_kept WHERE suffix IN ('.js', '.ts')
 UNION ALL SELECT DISTINCT repo, 'licences' FROM prose_kept WHERE suffix IN ('.js', '.ts')
 UNION ALL SELECT DISTINCT repo, 'documentation' FROM prose_kept WHERE suffix = '.md')
SELECT repo, agent, any_value(error) AS error, count(rule) AS n_findings
FROM routes LEFT JOIN status_found USING (repo, agent) LEFT JOIN raised USING (repo, agent) GROUP BY repo, agent""",
}
