"""Python structure facts: one parse per file, one narrow row per file.

This is the one place where Python runs per file: the standard library parser turns
source text into plain facts (names, lines, kinds, counts). All rules over the facts are
Spark expressions in the detectors. Source text is only ever parsed, never run.
"""

from __future__ import annotations

import ast
import gc
import warnings
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from codeaudit import fixed
from codeaudit.functions.paths import in_skipped_dir, is_python

# seq numbers the nodes of a file breadth first. `kinds` counts decision points of a
# function with those of functions inside it; `nesting` is its own deepest nesting.
def _rows(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(fields.items()))


_INT, _TEXT, _BOOL = pa.int32(), pa.string(), pa.bool_()
FACTS = pa.schema({
    "repo": _TEXT,
    "path": _TEXT,
    "error": pa.struct({"kind": _TEXT, "line": _INT, "message": _TEXT}.items()),
    "has_doc": _BOOL,
    "handlers": _rows(seq=_INT, line=_INT, bare=_BOOL),
    "functions": _rows(
        seq=_INT, name=_TEXT, line=_INT, end_line=_INT,
        params=pa.list_(_TEXT), star_params=_INT, nesting=_INT,
        kinds=_rows(kind=_TEXT, n=_INT, extra=_INT),
        defaults=_rows(line=_INT, shape=_TEXT),
    ),
    "defs": _rows(seq=_INT, name=_TEXT, line=_INT, kind=_TEXT, has_doc=_BOOL, top=_BOOL),
})

OUTPUT_ROWS = 512


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of every Python file outside skipped folders. Narrow: no shuffle."""
    sources = files.filter(is_python(F.col("path")) & ~in_skipped_dir(F.col("path")))
    return sources.select("repo", "path", "content").mapInArrow(_parse_batches, from_arrow_schema(FACTS))


def parse_failures(facts: DataFrame) -> DataFrame:
    """Files the parser could not take for a reason other than their syntax."""
    return facts.filter(F.col("error.kind") != "SyntaxError").select(
        "repo", "path", F.concat_ws(": ", "error.kind", "error.message").alias("error")
    )


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    warnings.simplefilter("ignore")
    for batch in batches:
        for start in range(0, batch.num_rows, OUTPUT_ROWS):
            rows = batch.slice(start, OUTPUT_ROWS).to_pylist()
            with no_cycles():
                found = [file_facts(**row) for row in rows]
            yield pa.RecordBatch.from_pylist(found, FACTS)


@contextmanager
def no_cycles() -> Iterator[None]:
    """Trees of a few texts are freed by their counts; looking for cycles in them takes a fifth of a parse."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def file_facts(repo: str, path: str, content: str | None) -> dict:
    """Facts of one file; a file that cannot be parsed yields its error and nothing else."""
    row = {"repo": repo, "path": path, "handlers": [], "functions": [], "defs": []}
    try:
        module = ast.parse(content or "")
    except SyntaxError as exc:
        row["error"] = {"kind": "SyntaxError", "line": exc.lineno or 0, "message": exc.msg}
        return row
    except (ValueError, RecursionError, MemoryError) as exc:
        row["error"] = {"kind": type(exc).__name__, "line": 0, "message": str(exc)}
        return row
    row["has_doc"] = _documented(module)
    _collect(module, row)
    return row


def _collect(module: ast.Module, row: dict) -> None:
    """Visit the tree breadth first and fill in handlers, functions and definitions.

    Each queue entry knows the functions around its node (outermost first) and how many
    nesting statements lie between the innermost of them and the node.
    """
    queue = deque([(module, (), 0, None)])
    seq = 0
    while queue:
        node, around, depth, parent = queue.popleft()
        kind = type(node).__name__
        if isinstance(node, ast.ExceptHandler):
            row["handlers"].append({"seq": seq, "line": node.lineno, "bare": node.type is None})
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            row["defs"].append({
                "seq": seq, "name": node.name, "line": node.lineno,
                "kind": "class" if kind == "ClassDef" else "function",
                "has_doc": _documented(node), "top": parent is module,
            })
            if kind != "ClassDef":
                function = _function(node, seq)
                row["functions"].append(function)
                around, depth = (*around, function), 0
        if around:
            depth += kind in fixed.NESTING_KINDS
            around[-1]["nesting"] = max(around[-1]["nesting"], depth)
        if kind in fixed.COMPLEXITY_WEIGHTS:
            extra = _extra(node)
            for function in around:
                n, more = function["kinds"].get(kind, (0, 0))
                function["kinds"][kind] = (n + 1, more + extra)
        queue.extend([(child, around, depth, node) for child in _inner_nodes(node)])
        seq += 1
    for function in row["functions"]:
        function["kinds"] = [
            {"kind": k, "n": n, "extra": extra} for k, (n, extra) in function["kinds"].items()
        ]


# Nodes that hold no fact and have nothing below them; most nodes of a tree.
_PLAIN = (
    ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue,
    ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop,
)


def _inner_nodes(node: ast.AST) -> list[ast.AST]:
    """Children of a node without the plain ones."""
    found = []
    for name in node._fields:
        value = getattr(node, name, None)
        if value.__class__ is list:
            found += [v for v in value if isinstance(v, ast.AST) and not isinstance(v, _PLAIN)]
        elif isinstance(value, ast.AST) and not isinstance(value, _PLAIN):
            found.append(value)
    return found


def _function(node: ast.FunctionDef | ast.AsyncFunctionDef, seq: int) -> dict:
    spec = node.args
    given = [*spec.defaults, *filter(None, spec.kw_defaults)]
    return {
        "seq": seq, "name": node.name, "line": node.lineno, "end_line": node.end_lineno,
        "params": [p.arg for p in (*spec.posonlyargs, *spec.args, *spec.kwonlyargs)],
        "star_params": sum(p is not None for p in (spec.vararg, spec.kwarg)),
        "nesting": 0,
        "kinds": {},
        "defaults": [{"line": value.lineno, "shape": _shape(value)} for value in given],
    }


def _extra(node: ast.AST) -> int:
    match node:
        case ast.BoolOp(values=operands):
            return len(operands) - 1
        case ast.comprehension(ifs=conditions):
            return len(conditions)
    return 0


def _shape(value: ast.expr) -> str:
    """`List` for a literal, `list()` for a call of a bare name."""
    match value:
        case ast.Call(func=ast.Name(id=name)):
            return f"{name}()"
    return type(value).__name__


def _documented(node: ast.AST) -> bool:
    return ast.get_docstring(node, clean=False) is not None
