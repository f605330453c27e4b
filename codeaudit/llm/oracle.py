"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

from codeaudit.llm.quality import BITS, MIN_GROUP, MIN_WORDS, RATES
from codeaudit.llm.tokencounts import TOKENIZERS


def _quality(docs: str = "documents") -> str:
    """CTEs `counts` (with base verdict and rates) and `judged` (with `kept`) over a table."""
    rates = ", ".join(f"coalesce(({scale} * {top}) // nullif({below}, 0), 0) AS {name}" for name, (top, below, scale, _) in RATES.items())
    slack = "CASE rate " + " ".join(f"WHEN '{name}' THEN {s}" for name, (*_, s) in RATES.items()) + " END"
    fence = """
    (SELECT {by}, rate, max(total) AS n_docs, min(CASE WHEN 4 * upto >= total THEN bin END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN bin END) AS q3
     FROM (SELECT *, sum(n) OVER (PARTITION BY {by}, rate ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {by}, rate) AS total
           FROM (SELECT {by}, rate, bin, sum(n) AS n FROM bins GROUP BY ALL)) GROUP BY {by}, rate)"""
    ends = f"CASE WHEN rate = 'length' THEN q1 - greatest(3 * (q3 - q1), {slack}) ELSE -1 END AS least, q3 + greatest(3 * (q3 - q1), {slack}) AS most"
    inside = " AND ".join(f"bool_and(CASE WHEN rate = '{r}' THEN {r} BETWEEN least AND most END)" for r in RATES)
    return rf"""
worded AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM {docs}),
placed AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM worded),
triples AS (SELECT doc_id, i, w AS a, lead(w, 1) OVER p AS b, lead(w, 2) OVER p AS c FROM placed WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM triples WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
marked AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS again FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM worded) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
raw AS (SELECT doc_id, lang, source, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, coalesce(l.again, 0) AS n_dup_lines, coalesce(l.n, 0) AS n_lines, coalesce(m.n, 0) AS n_repeat_words
  FROM worded LEFT JOIN lines l USING (doc_id) LEFT JOIN marked m USING (doc_id)),
counts AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {rates} FROM raw),
bins AS (SELECT lang, source, rate, (v - v % (CAST(1 AS BIGINT) << greatest(length(bin(v)) - {BITS}, 0))) AS bin, count(*) AS n FROM
  (SELECT lang, source, rate, CAST(v AS BIGINT) AS v FROM (SELECT lang, source, base_failed, {', '.join(RATES)} FROM counts) UNPIVOT (v FOR rate IN ({', '.join(RATES)})) WHERE NOT base_failed) GROUP BY ALL),
fences AS (SELECT o.lang, o.source, o.rate, CASE WHEN o.n_docs < {MIN_GROUP} THEN w.least ELSE o.least END AS least, CASE WHEN o.n_docs < {MIN_GROUP} THEN w.most ELSE o.most END AS most
  FROM (SELECT lang, source, rate, n_docs, {ends} FROM {fence.format(by='lang, source')}) o
  JOIN (SELECT lang, rate, {ends} FROM {fence.format(by='lang')}) w USING (lang, rate)),
judged AS (SELECT c.doc_id, any_value(c.n_words) AS n_words, any_value(c.word_chars) AS word_chars, any_value(c.n_symbols) AS n_symbols, any_value(c.n_dup_lines) AS n_dup_lines,
  any_value(c.n_repeat_words) AS n_repeat_words, any_value(c.base_failed) AS base_failed, NOT any_value(c.base_failed) AND coalesce({inside}, false) AS kept
  FROM counts c LEFT JOIN fences f USING (lang, source) GROUP BY c.doc_id)"""


def _token_counts() -> str:
    """Totals of kept documents, counted over the distinct lines of their text."""
    each = " UNION ALL ".join(
        f"SELECT source, lang, '{v}' AS tokenizer, len(regexp_extract_all(once, '{pattern}')) AS n FROM kept" for v, pattern in TOKENIZERS.items())
    plain = " UNION ALL ".join(
        f"SELECT source, lang, '{v}' AS tokenizer, coalesce(len(regexp_extract_all(text, '{pattern}')), 0) AS n FROM documents WHERE doc_id IS NULL OR text IS NULL"
        for v, pattern in TOKENIZERS.items())
    return f"""WITH lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL)),
once AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS once FROM (SELECT doc_id, line, min(i) AS i FROM lines GROUP BY doc_id, line) GROUP BY doc_id),
kept AS (SELECT source, lang, once FROM documents JOIN once USING (doc_id) QUALIFY doc_id = min(doc_id) OVER (PARTITION BY text))
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM ({each} UNION ALL {plain}) GROUP BY ALL"""


ORACLE = {
    "op2_token_counts": _token_counts(),
    "op8_quality_rules": f"WITH {_quality()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged",
}
