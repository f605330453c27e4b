"""Fixed values.

Everything in this module is a constant that results must agree on: severity
levels and weights, thresholds, name lists, rule ids, messages and formats.
"""

from __future__ import annotations

# level, name, label, weight in the health score, marker in reports
SEVERITIES = (
    (0, "INFO", "Info", 0, "⚪"),
    (1, "LOW", "Low", 1, "🔵"),
    (2, "MEDIUM", "Medium", 4, "🟡"),
    (3, "HIGH", "High", 10, "🟠"),
    (4, "CRITICAL", "Critical", 25, "🔴"),
)
INFO, LOW, MEDIUM, HIGH, CRITICAL = range(5)
PERFECT_SCORE = 100

# Order of the detectors in a report.
AGENT_ORDER = ("security", "quality", "test-gap", "documentation")
# Suffixes of which a repository needs at least one for the detector to run.
AGENT_SUFFIXES = {
    "security": (".py", ".js", ".ts"),
    "quality": (".py",),
    "test-gap": (".py",),
    "documentation": (".py", ".md"),
}
AGENT_ROLES = {
    "security": "person who triages scanner alerts",
    "quality": "maintainer who has to live with this code",
    "test-gap": "developer who plans the next tests",
    "documentation": "newcomer who reads the docs first",
}

# Folders that no detector looks into.
SKIP_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv")
# The retrieval index also leaves out data and this engine's own output.
INDEX_SKIP_DIRS = SKIP_DIRS + ("data", ".codeaudit")
INDEX_SUFFIXES = (".py", ".md", ".rst", ".txt")
TEST_DIRS = ("tests", "test")
NO_SUFFIX = "<none>"

# Caps that are part of what the reports promise.
INDEX_FILES = 200
INDEX_CHUNKS = 800
CHUNK_LINES = 40
TOP_K = 4
DOC_FINDINGS = 25
TEST_GAP_FINDINGS = 15
FIX_CANDIDATES = 10
SNIPPET_RADIUS = 8
QUERY_CHARS = 600
HISTORY_LIMIT = 100

# Quality thresholds.
MAX_COMPLEXITY = 10
MAX_FUNCTION_LINES = 60
MAX_PARAMETERS = 6
MAX_NESTING = 4

# Decision points: what one occurrence adds to cyclomatic complexity. "extra" is
# added on top: operands - 1 of a boolean chain, conditions of a comprehension.
COMPLEXITY_WEIGHTS = {
    "If": 1,
    "For": 1,
    "AsyncFor": 1,
    "While": 1,
    "ExceptHandler": 1,
    "Assert": 1,
    "IfExp": 1,
    "BoolOp": 0,
    "comprehension": 1,
    "match_case": 1,
}
# Statements that open a level of nesting.
NESTING_KINDS = ("If", "For", "AsyncFor", "While", "With", "AsyncWith", "Try")
MUTABLE_SHAPES = ("List", "Dict", "Set", "list()", "dict()", "set()")
IMPLICIT_PARAMETERS = ("self", "cls")

# Scale of static-analysis reports; anything else counts as LOW.
SAST_SEVERITY = {"HIGH": HIGH, "MEDIUM": MEDIUM, "LOW": LOW}
SAST_ASSERT_RULE = "B101"
SAST_DEFAULT_RULE = "BANDIT"
SAST_DEFAULT_TITLE = "Security issue"

# Text patterns.
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
WORD = "[A-Za-z]{3,}"

# Pull-request deliveries.
PR_EVENT = "pull_request"
PR_ACTIONS = ("opened", "synchronize", "reopened")

# rule -> (title, detail); printf style, arguments named by the detector.
MESSAGES = {
    "QUAL_SYNTAX_ERROR": (
        "File does not parse as Python",
        "SyntaxError: %s",
    ),
    "QUAL_BARE_EXCEPT": (
        "Bare `except:` catches everything",
        "Catch specific exceptions; bare except hides bugs and swallows KeyboardInterrupt.",
    ),
    "QUAL_COMPLEXITY": (
        "`%s` is too complex (cyclomatic complexity %d)",
        "Threshold is 10. Split the function into smaller, testable pieces.",
    ),
    "QUAL_LONG_FUNC": (
        "`%s` is %d lines long",
        "Functions over 60 lines are hard to test; extract helpers.",
    ),
    "QUAL_MANY_ARGS": (
        "`%s` takes %d parameters",
        "Group related parameters into a dataclass or config object.",
    ),
    "QUAL_DEEP_NESTING": (
        "`%s` nests control flow %d levels deep",
        "Use early returns or extract inner blocks to flatten the logic.",
    ),
    "QUAL_MUTABLE_DEFAULT": (
        "`%s` has a mutable default argument",
        "Default is shared across calls. Use `None` and create the object inside.",
    ),
    "TEST_NO_TESTS": (
        "Codebase contains no test files",
        "%d Python file(s) but no test_*.py / *_test.py. Untested code regresses silently.",
    ),
    "TEST_GAP": (
        "No test references %s `%s`",
        "Nothing in the test suite mentions this name; it has no direct test.",
    ),
    "DOC_NO_README": (
        "Repository has no README",
        "A README is the first thing reviewers and new contributors read.",
    ),
    "DOC_NO_MODULE_DOC": (
        "Module `%s` has no docstring",
        "Open every module with one line saying what it's for.",
    ),
    "DOC_MISSING_DOCSTRING": (
        "Public %s `%s` has no docstring",
        "Describe behavior and edge cases — especially what happens on failure.",
    ),
}

# Report layout.
REPORT_TITLE = "Code Review"
REPORT_CLEAN = "✅ No issues found. Nice work."
REPORT_TABLE_HEAD = ("| Sev | Issue | Location | Rule |", "|-----|-------|----------|------|")
REPORT_DETAILS_OPEN = "<details><summary>Details</summary>"
REPORT_DETAILS_CLOSE = "</details>"
FIX_REPORT_TITLE = "Proposed fixes"
