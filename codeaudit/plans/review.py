"""The full review: census, routing, detectors, union, status."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from py4j.protocol import Py4JError
from pyspark.errors import (
    ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, NumberFormatException,
    PythonException, SparkRuntimeException, UnknownException,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit import fixed
from codeaudit.operators.census import file_census, route_agents, routed_repos
from codeaudit.operators.contents import (
    ContentStore, Scan, Scanner, fact_rows, observe, reviewed, scan_failures, scan_findings,
)
from codeaudit.operators.docs import docs_findings
from codeaudit.operators.facts import parse_failures
from codeaudit.operators.quality import quality_findings
from codeaudit.operators.report import agent_status, ranked_findings, severity_pivot
from codeaudit.operators.sast import sast_findings
from codeaudit.operators.secrets import DEFAULT_RULES, SecretRule, hit_findings
from codeaudit.operators.testgap import named_in_tests, test_gap_findings
from codeaudit.schemas import FINDINGS, agent_position, as_findings
from codeaudit.storage import materialize, shuffles_dropped


@dataclass
class ReviewInput:
    """What detectors read. `files` is `(repo, path, content)` with repository-relative paths.

    `observed` has what one pass over the contents found; the built-in detectors read no contents.
    """

    files: DataFrame
    routes: DataFrame
    observed: DataFrame
    sast_reports: DataFrame | None = None
    gap_limit: int | None = None
    doc_limit: int | None = None

    @cached_property
    def facts(self) -> DataFrame:
        """Structure facts of Python files."""
        return fact_rows(self.observed)

    def repos(self, agent: str) -> DataFrame:
        """Repositories routed to a detector."""
        return routed_repos(self.routes, agent)


@dataclass(frozen=True)
class Detector:
    """A repository needs a file with one of `suffixes` to get the detector.

    `find` returns findings; those of repositories that are not routed to the detector are
    dropped afterwards, so it may scan all files without joining contents to the routes first.
    `scan` returns rows of one text and is called in the pass that reads the contents; if
    it raises on a text, the detector fails for that text's repository and no other.
    """

    name: str
    suffixes: tuple[str, ...]
    find: Callable[[ReviewInput], DataFrame] | None = None
    scan: Scan | None = None
    version: int = 1


def _security(given: ReviewInput) -> DataFrame:
    secrets = hit_findings(given.observed)
    if given.sast_reports is None:
        return secrets
    return sast_findings(given.sast_reports).unionByName(secrets)


_FINDERS = {
    "security": _security,
    "quality": lambda given: quality_findings(given.facts),
    "test-gap": lambda given: test_gap_findings(
        given.facts, given.files, given.gap_limit, named_in_tests(given.observed)
    ),
    "documentation": lambda given: docs_findings(
        given.facts, given.files, given.repos("documentation"), given.doc_limit
    ),
}
BUILT_IN = tuple(
    Detector(name, fixed.AGENT_SUFFIXES[name], _FINDERS[name]) for name in fixed.AGENT_ORDER
)
# What a detector's expressions and functions raise on data, and what a failed job raises otherwise.
DATA_ERRORS = (
    PythonException, SparkRuntimeException, ArithmeticException, NumberFormatException,
    DateTimeException, ArrayIndexOutOfBoundsException,
)
JOB_ERRORS = (Py4JError, UnknownException)
_registry: dict[str, Detector] = {d.name: d for d in BUILT_IN}


def register_detector(
    name: str, suffixes: Sequence[str], find: Callable[[ReviewInput], DataFrame] | None = None,
    scan: Scan | None = None, version: int = 1,
) -> None:
    """Add a detector to every later review, or replace the one of that name."""
    if not name or not suffixes or not (callable(find) or callable(scan)):
        raise ValueError("a detector needs a name, suffixes and a function")
    _registry[name] = Detector(name, tuple(suffixes), find, scan, version)


def scanners(detectors: Sequence[Detector] | None = None) -> list[Scanner]:
    """The scans of some detectors, of all registered ones by default."""
    chosen = _registry.values() if detectors is None else detectors
    return [Scanner(d.name, d.suffixes, d.scan, d.version) for d in chosen if d.scan]


def unregister_detector(name: str) -> None:
    _registry.pop(name, None)


def registered_detectors() -> Mapping[str, Detector]:
    return dict(_registry)


@dataclass
class Review:
    """Findings of all detectors as a written table, with routes and errors beside them."""

    files: DataFrame
    routes: DataFrame
    findings: DataFrame
    errors: DataFrame = field(repr=False)

    def repos(self) -> DataFrame:
        return self.files.select("repo").distinct()

    def ranked(self) -> DataFrame:
        return ranked_findings(self.findings, ["repo"])

    def scores(self) -> DataFrame:
        """Score and counts of every repository, clean ones included."""
        return severity_pivot(self.repos(), self.findings, ["repo"])

    def status(self) -> DataFrame:
        return agent_status(self.routes, self.findings, self.errors, ["repo"])


def run_review(
    files: DataFrame,
    sast_reports: DataFrame | None = None,
    secret_rules: Sequence[SecretRule] = DEFAULT_RULES,
    detectors: Sequence[Detector] | None = None,
    gap_limit: int | None = None,
    doc_limit: int | None = None,
    store: ContentStore | None = None,
    run: str | None = None,
) -> Review:
    """Review every repository of `files`.

    `gap_limit` and `doc_limit` cut the test gaps and documentation findings of a repository.
    A detector whose own code fails on the data shows in the status and costs its own findings;
    lost executors, full disks and the like fail the review.

    Contents are read in one pass; what it finds, the routes and the findings are written
    tables, as several branches read them; the shuffle files of each go when it is written.
    A `store` keeps the findings of contents between reviews: texts that it knows are not parsed
    again, and what is new is added under `run`. The store's rules and scans hold then.
    """
    with shuffles_dropped(files.sparkSession):
        chosen = list(_registry.values()) if detectors is None else list(detectors)
        rules = {d.name: d.suffixes for d in chosen}
        routes = materialize(route_agents(file_census(files), rules), "routes")
        if store is None:
            observed = materialize(observe(reviewed(files), ["repo", "path"], secret_rules, scanners(chosen)), "observed")
        else:
            if store.scanners != tuple(scanners(chosen)):
                raise ValueError("the store was opened for other scans")
            observed = store.observed(files, run or uuid.uuid4().hex)
        given = ReviewInput(files, routes, observed, sast_reports, gap_limit, doc_limit)

        found, failed = _find(chosen, given)
        routed = found.join(routes.select("repo", "agent"), ["repo", "agent"], "left_semi")
        try:
            findings = materialize(routed, "findings")
        except DATA_ERRORS:
            # Some detector fails on the data: run them one by one to keep the others.
            found, more = _find(chosen, given, run=True)
            failed = {**failed, **more}
            findings = materialize(
                found.join(routes.select("repo", "agent"), ["repo", "agent"], "left_semi"), "findings"
            )
        return Review(files, routes, findings, _errors(given, failed))


def _find(
    detectors: Sequence[Detector], given: ReviewInput, run: bool = False
) -> tuple[DataFrame, dict[str, str]]:
    """Union of the detectors' findings, and the errors of those that fail."""
    parts, failed = [], {}
    for detector in detectors:
        if detector.find is None:
            continue
        try:
            found = as_findings(detector.find(given), detector.name)
        except Exception as exc:
            if isinstance(exc, JOB_ERRORS):
                raise
            failed[detector.name] = str(exc).strip().splitlines()[0] if str(exc) else repr(exc)
            continue
        try:
            parts.append(materialize(found, "found") if run else found)
        except DATA_ERRORS as exc:
            failed[detector.name] = str(exc).strip().splitlines()[0] if str(exc) else repr(exc)
    scans = [d.name for d in detectors if d.scan]
    if scans:
        found = scan_findings(given.observed, {name: agent_position(name) for name in scans})
        parts.append(found.filter(F.col("agent").isin(scans)).select(*[F.col(f.name).cast(f.dataType) for f in FINDINGS.fields]))
    empty = given.files.sparkSession.createDataFrame([], FINDINGS)
    return reduce(DataFrame.unionByName, parts, empty), failed


def _errors(given: ReviewInput, failed: Mapping[str, str]) -> DataFrame:
    """`(repo, agent, error)`: whole detectors that failed, and files no parser could take."""
    python_agents = F.array(*[F.lit(a) for a in ("quality", "test-gap", "documentation")])
    unparsed = parse_failures(given.facts).select(
        "repo", F.explode(python_agents).alias("agent"),
        F.concat_ws(": ", "path", "error").alias("error"),
    )
    unparsed = unparsed.unionByName(scan_failures(given.observed))
    if not failed:
        return unparsed
    text = F.create_map(*[F.lit(v) for kv in failed.items() for v in kv])
    whole = given.routes.select("repo", "agent", F.try_element_at(text, F.col("agent")).alias("error"))
    return unparsed.unionByName(whole.filter(F.col("error").isNotNull()))
