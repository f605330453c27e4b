"""Quality detector: rules over structure facts, all row-local."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit import fixed
from codeaudit.functions.rows import inline_rows
from codeaudit.schemas import as_findings, message

# Rules of one function keep this order among each other; defaults are numbered after it.
_RULE_STEP, _NODE_STEP = 1 << 16, 1 << 20


def functions(facts: DataFrame) -> DataFrame:
    """One row per function with its measures."""
    weights = F.create_map(*[F.lit(v) for kv in fixed.COMPLEXITY_WEIGHTS.items() for v in kv])
    flat = facts.select("repo", "path", F.inline("functions"))
    first_implicit = F.coalesce(
        F.try_element_at("params", F.lit(1)).isin(*fixed.IMPLICIT_PARAMETERS), F.lit(False)
    )
    return flat.withColumns({
        "complexity": F.aggregate(
            "kinds",
            F.lit(1),
            lambda total, k: total + F.element_at(weights, k["kind"]) * k["n"] + k["extra"],
        ),
        "n_lines": F.coalesce("end_line", "line") - F.col("line") + 1,
        "n_params": F.size("params") - first_implicit.cast("int") + F.col("star_params"),
    })


def _finding(rule: str, severity: Column | int, line: Column, seq: Column, *args: Column) -> Column:
    title, detail = message(rule, *args)
    return F.struct(
        F.lit(rule).alias("rule"),
        (F.lit(severity) if isinstance(severity, int) else severity).alias("severity"),
        title.alias("title"),
        line.alias("line"),
        detail.alias("detail"),
        seq.cast("long").alias("seq"),
    )


def function_findings(facts: DataFrame) -> DataFrame:
    """Complexity, length, parameters, nesting and mutable defaults."""
    name, line = F.col("name"), F.col("line")
    cc, length, nargs, nesting = (
        F.col(c) for c in ("complexity", "n_lines", "n_params", "nesting")
    )
    worse = F.when(cc > 2 * fixed.MAX_COMPLEXITY, fixed.HIGH).otherwise(fixed.MEDIUM)
    node = F.col("seq").cast("long") * _NODE_STEP
    checks = [
        (cc > fixed.MAX_COMPLEXITY, "QUAL_COMPLEXITY", worse, cc),
        (length > fixed.MAX_FUNCTION_LINES, "QUAL_LONG_FUNC", fixed.LOW, length),
        (nargs > fixed.MAX_PARAMETERS, "QUAL_MANY_ARGS", fixed.LOW, nargs),
        (nesting > fixed.MAX_NESTING, "QUAL_DEEP_NESTING", fixed.MEDIUM, nesting),
    ]
    hits = [
        F.when(broken, _finding(rule, severity, line, node + n * _RULE_STEP, name, value))
        for n, (broken, rule, severity, value) in enumerate(checks, 1)
    ]
    mutable = F.filter(
        F.transform(
            "defaults",
            lambda d, i: F.when(
                d["shape"].isin(*fixed.MUTABLE_SHAPES),
                _finding(
                    "QUAL_MUTABLE_DEFAULT", fixed.MEDIUM, d["line"],
                    node + 5 * _RULE_STEP + i, name,
                ),
            ),
        ),
        lambda hit: hit.isNotNull(),
    )
    found = F.concat(F.filter(F.array(*hits), lambda hit: hit.isNotNull()), mutable)
    return inline_rows(functions(facts), ["repo", F.col("path").alias("file")], found, "rule")


def handler_findings(facts: DataFrame) -> DataFrame:
    """Bare `except:` handlers."""
    found = F.transform(
        F.filter("handlers", lambda h: h["bare"]),
        lambda h: _finding(
            "QUAL_BARE_EXCEPT", fixed.LOW, h["line"], h["seq"].cast("long") * _NODE_STEP
        ),
    )
    return inline_rows(facts, ["repo", F.col("path").alias("file")], found, "rule")


def syntax_findings(facts: DataFrame) -> DataFrame:
    """Files that are not valid Python."""
    found = _finding(
        "QUAL_SYNTAX_ERROR", fixed.LOW, F.col("error.line"), F.lit(0), F.col("error.message")
    )
    broken = facts.filter(F.col("error.kind") == "SyntaxError")
    return broken.select("repo", F.col("path").alias("file"), F.inline(F.array(found)))


def quality_findings(facts: DataFrame) -> DataFrame:
    parts = [syntax_findings(facts), handler_findings(facts), function_findings(facts)]
    return as_findings(reduce(DataFrame.unionByName, parts), "quality")
