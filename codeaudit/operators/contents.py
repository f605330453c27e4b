"""One pass over file contents, and a table of what contents hold.

Everything that detectors read from a text - structure facts, secret matches, the names in test
files, findings of plug-in scans - is taken in one scan and written as one wide row; consumers
read the columns that they need. What is found depends on the text and its kind (suffix, test or
not), never on its place, so a `ContentStore` keeps it by digest: a text that is already there,
from whichever repository or head, is not parsed again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from codeaudit import fixed
from codeaudit.functions.paths import in_skipped_dir, is_test_file, suffix
from codeaudit.operators.facts import FACTS, file_facts, no_cycles
from codeaudit.operators.secrets import DEFAULT_RULES, HITS, RuleSet, SecretRule
from codeaudit.storage import any_path, materialize

PYTHON = ".py"
KIND = ("suffix", "is_test")
OUTPUT_ROWS = 512
# Part of a store's folder name; raise it when the rows or the way they are found change.
VERSION = 1
_FACT_FIELDS = [f for f in FACTS if f.name not in ("repo", "path")]
_FOUND = pa.list_(pa.struct({
    "agent": pa.string(), "rule": pa.string(), "severity": pa.int32(), "title": pa.string(), "line": pa.int32(),
    "detail": pa.string(), "seq": pa.int64(),
}.items()))
OBSERVED = pa.schema({
    "facts": pa.struct(_FACT_FIELDS), "names": pa.list_(pa.string()), "hits": HITS, "found": _FOUND,
    "failed": pa.list_(pa.struct({"agent": pa.string(), "error": pa.string()}.items())),
})

# Rows `(rule, severity, title, line, detail)` of a text.
Scan = Callable[[str], Iterable[tuple[str, int, str, int, str]]]


@dataclass(frozen=True)
class Scanner:
    """A plug-in that reads texts of some suffixes. Change `version` when `scan` changes."""

    agent: str
    suffixes: tuple[str, ...]
    scan: Scan
    version: int = 1


def reviewed(files: DataFrame) -> DataFrame:
    """Files outside skipped folders with their kind."""
    path = F.col("path")
    return files.filter(~in_skipped_dir(path)).withColumns({"suffix": suffix(path), "is_test": is_test_file(path)})


def observe(
    files: DataFrame, keep: Sequence[str], rules: Sequence[SecretRule] = DEFAULT_RULES, scanners: Sequence[Scanner] = ()
) -> DataFrame:
    """`keep` and what the text of each row `(suffix, is_test, content)` holds. Narrow: no shuffle."""
    rules, scanners = tuple(rules), tuple(scanners)
    source = files.select(*dict.fromkeys([*keep, *KIND, "content"]))
    kept = source.select(*keep).schema
    target = pa.schema([*to_arrow_schema(kept), *OBSERVED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = RuleSet(rules)
        for batch in batches:
            for start in range(0, batch.num_rows, OUTPUT_ROWS):
                part = batch.slice(start, OUTPUT_ROWS)
                kinds = zip(*(part.column(c).to_pylist() for c in (*KIND, "content")))
                with no_cycles():
                    found = [_observed(known, scanners, *kind) for kind in kinds]
                rows = pa.RecordBatch.from_pylist(found, OBSERVED)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).cast(target.field(c).type) for c in keep), *rows.columns], schema=target)

    return source.mapInArrow(run, from_arrow_schema(target))


def _observed(known: RuleSet, scanners: Sequence[Scanner], kind: str, is_test: bool, content: str | None) -> dict:
    text = content or ""
    row = {"hits": known.hits(text), "names": [], "found": [], "failed": [], "facts": None}
    if kind == PYTHON:
        row["facts"] = file_facts("", "", text)
        if is_test:
            row["names"] = sorted(set(re.findall(fixed.IDENTIFIER, text, re.ASCII)))
    for scanner in scanners:
        if kind in scanner.suffixes:
            try:
                row["found"] += [
                    {"agent": scanner.agent, "rule": rule, "severity": severity, "title": title, "line": line, "detail": detail, "seq": n}
                    for n, (rule, severity, title, line, detail) in enumerate(scanner.scan(text))
                ]
            except Exception as error:  # whatever a plug-in raises on a text costs its repository only
                row["failed"].append({"agent": scanner.agent, "error": f"{type(error).__name__}: {error}"})
    return row


class ContentStore:
    """What contents hold, by digest and kind, below a folder that all executors share.

    Rules and scanners are part of the folder's name. Contents that are not known yet are
    added under the run that asks for them; a run that is repeated replaces its own addition.
    One writer at a time.
    """

    def __init__(
        self, spark: SparkSession, root: str, rules: Sequence[SecretRule] = DEFAULT_RULES, scanners: Sequence[Scanner] = ()
    ):
        self.rules, self.scanners = tuple(rules), tuple(scanners)
        told = repr((VERSION, self.rules, [(s.agent, s.suffixes, s.version) for s in self.scanners]))
        self._spark = spark
        self._path = f"{root.rstrip('/')}/{hashlib.sha256(told.encode()).hexdigest()[:16]}"

    def _read(self) -> DataFrame | None:
        if not any_path(self._spark, f"{self._path}/run=*"):
            return None
        fields = pa.schema([("digest", pa.string()), ("suffix", pa.string()), ("is_test", pa.bool_()), *OBSERVED, ("run", pa.string())])
        return self._spark.read.schema(from_arrow_schema(fields)).parquet(self._path)

    def added(self, run: str) -> DataFrame:
        """The rows that a run has added."""
        return self._read().filter(F.col("run") == run).drop("run")

    def observed(self, files: DataFrame, run: str) -> DataFrame:
        """`(repo, path, …)` of every reviewed file; only unknown contents are read and parsed.

        With a `digest` column in `files`, contents of known files are not read at all.
        """
        key = ["digest", *KIND]
        digest = F.col("digest") if "digest" in files.columns else F.sha2(F.coalesce("content", F.lit("")), 256)
        places = materialize(reviewed(files).select("repo", "path", *KIND, digest.alias("digest")), "places")
        wanted = places.groupBy(*key).agg(F.min(F.struct("repo", "path")).alias("_at"))
        table = self._read()
        if table is not None:
            # Null-safe, as a text of no known digest is one as well.
            known = table.filter(F.col("run") != run).select(*key)
            wanted = wanted.join(known, key, "left_anti")
        at = wanted.select("_at.repo", "_at.path", *key)
        fresh = files.select("repo", "path", "content").join(at, ["repo", "path"])
        observe(fresh, key, self.rules, self.scanners).write.mode("overwrite").parquet(f"{self._path}/run={run}")
        return places.join(self._read().drop("run"), key)


def fact_rows(observed: DataFrame) -> DataFrame:
    """Structure facts of Python files, as `python_facts` has them."""
    return observed.filter("facts IS NOT NULL").select("repo", "path", "facts.*")


def scan_failures(observed: DataFrame) -> DataFrame:
    """`(repo, agent, error)` of plug-in scans that raised."""
    failed = observed.select("repo", "path", F.inline("failed"))
    return failed.select("repo", "agent", F.concat_ws(": ", "path", "error").alias("error"))


def scan_findings(observed: DataFrame, positions: Mapping[str, int]) -> DataFrame:
    """Findings of plug-in scans, but none of a scan for a repository in which it raised."""
    found = observed.select("repo", F.col("path").alias("file"), F.inline("found"))
    kept = found.join(scan_failures(observed).select("repo", "agent"), ["repo", "agent"], "left_anti")
    order = F.create_map(*[F.lit(v) for kv in positions.items() for v in kv])
    return kept.withColumn("agent_ord", F.try_element_at(order, F.col("agent")))
