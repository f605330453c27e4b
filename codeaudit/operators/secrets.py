"""Secret detector: many regular-expression rules over file lines.

A rule names keywords that each of its matches contains. All keywords of all rules are one
Aho-Corasick automaton, built once in a task, so a text is read once however many rules there
are; only the rules whose keywords a line holds are run on that line. Rules without keywords
run on every line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit import fixed
from codeaudit.functions.paths import in_skipped_dir
from codeaudit.functions.rows import inline_rows
from codeaudit.schemas import as_findings


class SecretRule(NamedTuple):
    """`pattern` has exactly one group, the secret value; it matches within a line.

    Classes such as `\\w` and letter case are those of ASCII. Each match contains one of
    `keywords`, in any case of its ASCII letters; without keywords every line is searched.
    """

    rule: str
    severity: int
    title: str
    pattern: str
    keywords: tuple[str, ...] = ()


# The default rules.
DEFAULT_RULES = (
    SecretRule(
        "SECRET_AWS_KEY", fixed.CRITICAL, "Hard-coded AWS access key", r"\b(AKIA[0-9A-Z]{16})\b", ("AKIA",)
    ),
    SecretRule(
        "SECRET_GENERIC", fixed.HIGH, "Hard-coded credential",
        r"(?i)(?:password|passwd|secret|token|api_?key)\s*[:=]\s*[\"']([^\"'\s]{8,})[\"']",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
)

# Secrets follow the static-analysis results in the security detector's list.
SEQ_BASE = 1 << 40
# Rules are sent to every task; a table with more of them is refused.
MOST_RULES = 100_000
HITS = pa.list_(pa.struct({
    "rule": pa.string(), "severity": pa.int32(), "title": pa.string(), "line": pa.int32(),
    "detail": pa.string(), "seq": pa.int64(),
}.items()))
OUTPUT_ROWS = 512


def rules_of(table: DataFrame, most: int = MOST_RULES) -> list[SecretRule]:
    """Rules of a table `(rule, severity, title, pattern, keywords)`, in the order of their names."""
    rows = table.select("rule", "severity", "title", "pattern", "keywords").orderBy("rule", "pattern").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return [SecretRule(r.rule, r.severity, r.title, r.pattern, tuple(r.keywords or ())) for r in rows]


def _folded(text: str) -> str:
    """One character per byte of the UTF-8 text, ASCII letters in lower case."""
    return text.encode("utf-8", "replace").lower().decode("latin-1")


class RuleSet:
    """The automaton over the keywords of all rules, and the compiled rules."""

    def __init__(self, rules: Sequence[SecretRule]):
        self._rules = [(rule, None) for rule in rules]
        self._always = [at for at, rule in enumerate(rules) if not rule.keywords]
        named: dict[str, list[int]] = {}
        for at, rule in enumerate(rules):
            for word in set(map(_folded, rule.keywords)):
                named.setdefault(word, []).append(at)
        self._automaton = None
        if named:
            self._automaton = ahocorasick.Automaton()
            for word, ats in named.items():
                self._automaton.add_word(word, tuple(ats))
            self._automaton.make_automaton()

    def _named(self, text: str) -> set[int]:
        if self._automaton is None:
            return set()
        return {at for _, ats in self._automaton.iter(_folded(text)) for at in ats}

    def _pattern(self, at: int) -> re.Pattern:
        rule, pattern = self._rules[at]
        if pattern is None:  # compiled when its keyword is first met
            pattern = re.compile(rule.pattern, re.ASCII)
            self._rules[at] = rule, pattern
        return pattern

    def hits(self, content: str | None) -> list[dict]:
        """A row of every match, with the value masked."""
        if not content or not (self._always or self._named(content)):
            return []
        rows = []
        for line, text in enumerate(content.splitlines(), 1):
            for at in sorted(self._named(text).union(self._always)):
                rule = self._rules[at][0]
                for n, match in enumerate(self._pattern(at).finditer(text)):
                    value = match.group(1) or ""
                    rows.append({
                        "rule": rule.rule, "severity": rule.severity, "title": rule.title, "line": line,
                        "detail": f"Value of {len(value)} characters starting `{value[:4]}`; rotate it and load it at run time.",
                        "seq": SEQ_BASE + at * 1000 + n,
                    })
        return rows


def hit_findings(observed: DataFrame) -> DataFrame:
    """Findings of `(repo, path, hits)`."""
    return as_findings(inline_rows(observed, ["repo", F.col("path").alias("file")], F.col("hits"), "rule"), "security")


def secret_findings(files: DataFrame, rules: Sequence[SecretRule] = DEFAULT_RULES) -> DataFrame:
    """One finding per match in files outside skipped folders. Narrow: no shuffle."""
    kept = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = RuleSet(kept)
        for batch in batches:
            for start in range(0, batch.num_rows, OUTPUT_ROWS):
                part = batch.slice(start, OUTPUT_ROWS)
                hits = pa.array([known.hits(text) for text in part.column("content").to_pylist()], HITS)
                yield pa.RecordBatch.from_arrays([part.column("repo"), part.column("path"), hits], ["repo", "path", "hits"])

    sources = files.filter(~in_skipped_dir(F.col("path"))).select("repo", "path", "content")
    found = "rule: string, severity: int, title: string, line: int, detail: string, seq: bigint"
    return hit_findings(sources.mapInArrow(run, f"repo string, path string, hits array<struct<{found}>>"))
