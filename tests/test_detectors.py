"""Test-gap, documentation, secret and static-analysis detectors; census and routing."""

import json
import random

import pytest

from codeaudit.operators.census import census_map, file_census, route_agents
from codeaudit.operators.docs import cut, docs_findings
from codeaudit.operators.facts import python_facts
from codeaudit.operators.sast import sast_findings
from codeaudit.operators.secrets import SecretRule, secret_findings
from codeaudit.operators.testgap import test_gap_findings as gap_findings

DOCUMENTED = '"""Module."""\n\n\ndef f():\n    """Do it."""\n'


def test_census_and_routes(spark, tree):
    files = tree(
        py={"a.py": "", "b/c.py": "", "README.md": ""}, md={"x.md": "", "venv/a.py": ""},
        js={"x.js": ""}, png={"x.png": "", "LICENSE": ""},
    )
    census = {r["repo"]: r["census"] for r in census_map(file_census(files)).collect()}
    assert census["py"] == {".py": 2, ".md": 1}
    assert census["png"] == {".png": 1, "<none>": 1}
    routes = {}
    for row in route_agents(file_census(files)).collect():
        routes.setdefault(row["repo"], set()).add(row["agent"])
    assert routes == {
        "py": {"security", "quality", "test-gap", "documentation"},
        "md": {"documentation"}, "js": {"security"},
    }


def gaps(files):
    rows = gap_findings(python_facts(files), files).collect()
    return {(r["repo"], r["rule"], r["title"]) for r in rows}


def test_gap_rules(spark, tree):
    used = "def used(): pass\ndef orphan(): pass\nclass Lost: pass\ndef _own(): pass\n"
    files = tree(
        bare={"a.py": "def f(): pass", "b.py": ""},
        mixed={"src/a.py": used, "tests/t.py": "# used only in a comment"},
        private={"a.py": "def _x(): pass", "test_a.py": ""},
        only_tests={"test_a.py": "x = 1"},
        nested={"a.py": "class A:\n    def m(self): pass\n", "a_test.py": "A"},
    )
    found = gaps(files)
    assert {r for r in found if r[0] == "bare"} == {("bare", "TEST_NO_TESTS", "Codebase contains no test files")}
    assert {r[2] for r in found if r[0] == "mixed"} == {
        "No test references function `orphan`", "No test references class `Lost`",
    }
    assert {r[0] for r in found} == {"bare", "mixed"}


def test_gap_cap_follows_path_order(spark, tree):
    many = {f"p{n:02}.py": f"def g{n}(): pass\ndef h{n}(): pass\n" for n in range(12)}
    files = tree(r={**many, "test_a.py": ""})
    assert gap_findings(python_facts(files), files).count() > 15
    rows = gap_findings(python_facts(files), files, 15).collect()
    assert len(rows) == 15
    assert sorted({r["file"] for r in rows}) == [f"p{n:02}.py" for n in range(8)]


def docs(files):
    repos = files.select("repo").distinct()
    rows = docs_findings(python_facts(files), files, repos).collect()
    return sorted((r["repo"], r["rule"], r["line"]) for r in rows)


def test_docs_rules(spark, tree):
    files = tree(
        bare={"a.py": "def f(): pass\nclass _P:\n    def m(self): pass\n"},
        good={"README": "", "a.py": DOCUMENTED, "test_a.py": "def f(): pass", "__init__.py": ""},
        broken={"README.md": "", "a.py": "def ("},
        folder={"README_dir/x.txt": "", "a.py": DOCUMENTED},
        deep={"docs/README.md": "", "a.py": DOCUMENTED},
    )
    assert docs(files) == [
        ("bare", "DOC_MISSING_DOCSTRING", 1), ("bare", "DOC_MISSING_DOCSTRING", 3),
        ("bare", "DOC_NO_MODULE_DOC", 1), ("bare", "DOC_NO_README", 0),
        ("deep", "DOC_NO_README", 0),
    ]


@pytest.mark.parametrize("seed", range(4))
def test_docs_cut_against_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], set()
    for repo in range(6):
        share = rng.choice([0.0, 0.1, 0.5, 1.0])
        listed = [
            (f"r{repo}", "DOC_MISSING_DOCSTRING" if rng.random() < share else "DOC_NO_MODULE_DOC", f"d/f{n // 3:03}.py", n % 3)
            for n in range(rng.choice([3, 24, 25, 26, 80]))
        ]
        rows += listed
        for at, row in enumerate(listed, 1):
            expected.add(row)
            if at >= 25 and row[1] == "DOC_MISSING_DOCSTRING":
                break
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "repo string, rule string, file string, seq int")
    assert {tuple(r) for r in cut(frame).collect()} == expected


def test_secrets(spark, tree):
    key = "AKIA" + "Q7" * 8
    files = tree(r={
        "a.py": f"x = 1\nkey = '{key}'\n", "b.yml": 'password: "hunter22x"\nPASSWORD = "short"\n',
        "venv/c.py": f"'{key}'", "d.js": "const API_KEY = 'abcdefgh1'; const token = \"zyxwvuts9\"\n",
    })
    rows = secret_findings(files).collect()
    assert sorted((r["file"], r["line"], r["rule"], r["severity"]) for r in rows) == [
        ("a.py", 2, "SECRET_AWS_KEY", 4), ("b.yml", 1, "SECRET_GENERIC", 3),
        ("d.js", 1, "SECRET_GENERIC", 3), ("d.js", 1, "SECRET_GENERIC", 3),
    ]
    assert not any(key in r["detail"] or "hunter22x" in r["detail"] for r in rows)
    own = [SecretRule("OWN", 2, "Own rule", r"(zzz[0-9]+)")]
    assert secret_findings(tree(r={"a": "zzz1 zzz22"}), own).count() == 2


def test_sast(spark):
    full = {
        "test_id": "B602", "test_name": "shell", "issue_text": "Shell", "issue_severity": "HIGH",
        "issue_confidence": "LOW", "filename": "./src/a.py", "line_number": 7,
    }
    report = {"results": [
        full, {"filename": "src\\b.py"}, {**full, "test_id": "B101", "filename": "tests/x.py"},
        {**full, "test_id": "B101", "issue_severity": "ODD"},
    ], "errors": []}
    rows = [("r", json.dumps(report)), ("r", "  \n"), ("r", json.dumps(report)[:80]), ("r", "[]"), ("r", "{}")]
    found = sast_findings(spark.createDataFrame(rows, "repo string, json string")).orderBy("seq").collect()
    assert [(f["rule"], f["severity"], f["title"], f["file"], f["line"], f["detail"]) for f in found] == [
        ("B602", 3, "Shell", "src/a.py", 7, "shell (confidence: LOW)"),
        ("BANDIT", 1, "Security issue", "src/b.py", 0, " (confidence: ?)"),
        ("B101", 1, "Shell", "src/a.py", 7, "shell (confidence: LOW)"),
    ]
