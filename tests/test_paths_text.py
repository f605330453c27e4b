"""Path and text expressions against the standard library."""

import hashlib
import hmac
import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from codeaudit.functions import paths, text

PATHS = [
    "a.py", "src/a.py", "src/.hidden", ".gitignore", "a.b.c", "noext", "dir.d/file", "x/..foo",
    "trail.", "x/a_test.py", "a_test", "a.b_test", ".a_test", "test_x.py", "tests/helper.py",
    "src/test/util.py", "src/contest.py", "src/testing/a.py", "_test.py", "x/.py", "latest.py",
]


def values(spark, inputs, expression):
    rows = [(n, v) for n, v in enumerate(inputs)]
    kind = "binary" if isinstance(inputs[0], bytes) else "string"
    frame = spark.createDataFrame(rows, f"n int, v {kind}")
    return [r[0] for r in frame.orderBy("n").select(expression(F.col("v"))).collect()]


def test_suffix_and_stem(spark):
    assert values(spark, PATHS, paths.suffix) == [PurePosixPath(p).suffix for p in PATHS]
    assert values(spark, PATHS, paths.stem) == [PurePosixPath(p).stem for p in PATHS]
    assert values(spark, PATHS, paths.is_python) == [PurePosixPath(p).suffix == ".py" for p in PATHS]


def test_test_file_predicates(spark):
    def by_name(p):
        return PurePosixPath(p).name.startswith("test_") or PurePosixPath(p).stem.endswith("_test")

    def wide(p):
        return by_name(p) or bool({"tests", "test"} & set(PurePosixPath(p).parts))

    assert values(spark, PATHS, paths.has_test_name) == [by_name(p) for p in PATHS]
    assert values(spark, PATHS, paths.is_test_file) == [wide(p) for p in PATHS]


def test_skipped_dirs(spark):
    given = ["a/node_modules/x.js", "venv/a.py", "a/xvenv/b.py", ".git", "a/.gitx/b", "__pycache__/m.pyc"]
    assert values(spark, given, paths.in_skipped_dir) == [True, True, False, True, False, True]


def test_path_order_is_by_component(spark):
    given = ["a-b.py", "a/b.py", "a.py", "a/b/c.py", "b"]
    keys = dict(zip(values(spark, given, paths.path_order), given))
    assert [keys[k] for k in sorted(keys)] == sorted(given, key=lambda p: PurePosixPath(p).parts)


def test_contained(spark):
    given = ["a/b", "a/../b", "../b", "a/../../b", "/abs", "./a//b/.", "a/.."]
    assert values(spark, given, paths.contained) == ["a/b", "b", None, None, None, "a/b", ""]


def test_relative_to(spark):
    given = ["./src/a.py", "src\\b.py", "/work/repo/c.py", "/other/d.py"]
    got = values(spark, given, lambda c: paths.relative_to(c, F.lit("/work/repo/")))
    assert got == ["src/a.py", "src/b.py", "c.py", "/other/d.py"]


@pytest.mark.parametrize("sample", [
    "", "one", "one\n", "one\n\n", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e\u2028f\u2029g", " \n ",
])
def test_split_lines(spark, sample):
    assert values(spark, [sample], text.split_lines) == [sample.splitlines()]


def test_strip(spark):
    given = ["  x y \n", "\t\x0b\x1f\xa0\u3000z\u2003", "", "\n\n"]
    assert values(spark, given, text.strip) == [s.strip() for s in given]


def test_decode_drops_bad_bytes(spark):
    given = ["plain".encode(), b"a\xffb\xc3", "ü�x\r\ny\rz".encode()]
    assert values(spark, given, text.decode) == ["plain", "ab", "ü�x\ny\nz"]


def test_fences(spark):
    given = ["```json\n[1]\n```", "```\n[1]```", " [1] ", "```json[1]"]
    assert [v.strip() for v in values(spark, given, text.strip_fence)] == ["[1]"] * 4


def test_words_and_identifiers(spark):
    given = ["snake_case HTTPServer2x ab über_all"]
    assert values(spark, given, text.words) == [[w.lower() for w in re.findall("[A-Za-z]{3,}", given[0])]]
    assert values(spark, given, text.identifiers) == [re.findall("[A-Za-z_][A-Za-z0-9_]*", given[0])]


def test_occurrences_and_replace(spark):
    frame = spark.createDataFrame(
        [("aaaa", "aa", "b"), ("abc", "x", "y"), ("a.c", ".", "$1"), ("abc", "", "z")],
        "t string, o string, n string",
    )
    rows = frame.select(
        text.occurrences(F.col("t"), F.col("o")), text.replace_first(F.col("t"), F.col("o"), F.col("n"))
    ).collect()
    assert [r[0] for r in rows] == [2, 0, 1, 0]
    assert [r[1] for r in rows][:3] == ["baa", "abc", "a$1c"]


@pytest.mark.parametrize("key", [b"short", b"k" * 64, b"long" * 40])
def test_hmac(spark, key):
    bodies = [b"", b"{}", "ü".encode() * 100]
    expected = [hmac.new(key, b, hashlib.sha256).hexdigest() for b in bodies]
    assert values(spark, bodies, lambda c: text.hmac_sha256(c, key)) == expected


def test_strict_json_evaluates_its_text_and_parse_once(spark):
    """A parse that is named in a condition and in its branch was run for both, a cut-off fence as well."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(value):
        read.add(1)
        return value

    given = ["[1]", " [2, 3]", "[4] x", "{}", "", None, "\u2003[5]", "[6", "7"]
    frame = spark.createDataFrame([(v,) for v in given], "t string")
    got = [r[0] for r in frame.select(text.strict_json(told("t"), "ARRAY<INT>")).collect()]
    assert got[:2] == [[1], [2, 3]] and got[2:6] == [None] * 4 and got[7:] == [None, None]
    assert read.value == len(given)
    plan = frame.select(F.posexplode_outer(text.strict_json(F.col("t"), "ARRAY<INT>")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_paths_without_a_regular_expression(spark):
    given = ["./a.py", "././b.py", "././/c", ".", "", "./", "..//d", ".\\e.py", None, "./tests/x.py", "attest/contest.py", "test_", "x/tests"]
    assert values(spark, given, paths.relative_to) == [
        None if g is None else re.sub(r"^(\./)+", "", g.replace("\\", "/")) for g in given]
    assert values(spark, given, paths.is_test_file)[-4:] == [True, False, True, True]
