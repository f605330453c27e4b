"""Structure facts and quality rules on code with known measures."""

import textwrap

import pytest

from codeaudit.operators.facts import file_facts, parse_failures, python_facts
from codeaudit.operators.quality import functions, quality_findings


def measures(spark, tree, code, name):
    facts = python_facts(tree(r={"m.py": textwrap.dedent(code)}))
    rows = {r["name"]: r for r in functions(facts).collect()}
    return rows[name]


@pytest.mark.parametrize("body, expected", [
    ("pass", 1),
    ("if a: pass", 2),
    ("if a: pass\n    elif b: pass\n    else: pass", 3),
    ("return a and b and c or d", 4),
    ("return [x for x in a if x if not x]", 4),
    ("return {x: y for x in a for y in b}", 3),
    ("return 1 if a else 2", 2),
    ("assert a\n    for x in a: pass\n    while b: pass", 4),
    ("try: pass\n    except A: pass\n    except B: pass\n    finally: pass", 3),
    ("match a:\n        case 1: pass\n        case _: pass", 3),
    ("with a: pass", 1),
    ("def g():\n        if x: pass\n    return g", 2),
    ("return lambda: a if b else c", 2),
])
def test_complexity(spark, tree, body, expected):
    code = f"def f(a, b):\n    {body}\n"
    assert measures(spark, tree, code, "f")["complexity"] == expected


def test_async_kinds(spark, tree):
    code = """
    async def f(a):
        async for x in a:
            async with x:
                await x
    """
    row = measures(spark, tree, code, "f")
    assert (row["complexity"], row["nesting"]) == (2, 2)


def test_nesting_counts_else_if_and_leaves_out_inner_functions(spark, tree):
    chain = "if a: pass\n" + "".join("    elif a: pass\n" for _ in range(10))
    assert measures(spark, tree, f"def f(a):\n    {chain}", "f")["nesting"] == 11
    code = """
    def f(a):
        if a:
            def g():
                while a:
                    while a:
                        pass
            class C:
                with a:
                    pass
    """
    assert measures(spark, tree, code, "f")["nesting"] == 2
    assert measures(spark, tree, code, "g")["nesting"] == 2


@pytest.mark.parametrize("signature, expected", [
    ("", 0), ("self", 0), ("cls, a", 1), ("a, self", 2), ("a, /, b, *, c", 3), ("*a, **k", 2),
    ("self, *a, b=1, **k", 3),
])
def test_parameters(spark, tree, signature, expected):
    assert measures(spark, tree, f"def f({signature}): pass\n", "f")["n_params"] == expected


def rules(spark, tree, code):
    found = quality_findings(python_facts(tree(r={"m.py": code}))).orderBy("seq").collect()
    return [(f["rule"], f["line"], f["severity"]) for f in found]


def test_mutable_defaults(spark, tree):
    code = "def f(a=[], b={}, c={1}, d=list(), e=dict(x=1), g=set(), *, h=[], i=None, j=x.list()):\n    pass\n"
    found = rules(spark, tree, code)
    assert [f for f in found if f[0] == "QUAL_MUTABLE_DEFAULT"] == [("QUAL_MUTABLE_DEFAULT", 1, 2)] * 7
    assert ("QUAL_MANY_ARGS", 1, 1) in found


def test_bare_except_and_clean_file(spark, tree):
    assert rules(spark, tree, "try:\n    pass\nexcept:\n    pass\n") == [("QUAL_BARE_EXCEPT", 3, 1)]
    assert rules(spark, tree, '"""Doc."""\n\n\ndef f():\n    """Doc."""\n    return 1\n') == []


def test_thresholds(spark, tree):
    branches = "".join("    if a: pass\n" for _ in range(12))
    assert rules(spark, tree, f"def f(a):\n{branches}") == [("QUAL_COMPLEXITY", 1, 2)]
    branches = "".join("    if a: pass\n" for _ in range(21))
    assert rules(spark, tree, f"def f(a):\n{branches}") == [("QUAL_COMPLEXITY", 1, 3)]
    assert rules(spark, tree, "def f(a):\n" + "    a = 1\n" * 60) == [("QUAL_LONG_FUNC", 1, 1)]
    assert rules(spark, tree, "def f(a):\n" + "    a = 1\n" * 59) == []


def test_broken_file_gives_only_the_syntax_finding(spark, tree):
    assert rules(spark, tree, "x = 1\ndef broken(:\n    pass\n") == [("QUAL_SYNTAX_ERROR", 2, 1)]


def test_skipped_and_other_files_are_not_parsed(spark, tree):
    files = tree(r={"venv/m.py": "def f(x=[]): pass", "m.txt": "def f(x=[]): pass", "ok.py": "x = 1"})
    assert [r["path"] for r in python_facts(files).collect()] == ["ok.py"]


def test_parser_limits_cost_only_the_file(spark, tree):
    files = tree(r={"deep.py": "x = " + "-" * 20000 + "1", "ok.py": "def f(x=[]): pass\n", "empty.py": ""})
    facts = python_facts(files)
    assert [r["path"] for r in parse_failures(facts).collect()] == ["deep.py"]
    assert [f["file"] for f in quality_findings(facts).collect()] == ["ok.py"]


def test_definitions_come_breadth_first():
    code = 'class A:\n    def m(self): "doc"\ndef b():\n    def inner(): pass\n'
    row = file_facts("r", "m.py", code)
    assert [(d["name"], d["kind"], d["has_doc"], d["top"]) for d in row["defs"]] == [
        ("A", "class", False, True), ("b", "function", False, True),
        ("m", "function", True, False), ("inner", "function", False, False),
    ]
