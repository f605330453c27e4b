"""Expressions over repository-relative paths with forward slashes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeaudit import fixed


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last dotted suffix with its dot; empty for none, a leading dot or a trailing dot."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def suffix_or_none(path: Column) -> Column:
    found = suffix(path)
    return F.when(found == "", fixed.NO_SUFFIX).otherwise(found)


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def _part_pattern(names: Sequence[str]) -> str:
    return "(^|/)(" + "|".join(re.escape(n) for n in names) + ")(/|$)"


def in_skipped_dir(path: Column, names: Sequence[str] = fixed.SKIP_DIRS) -> Column:
    """True when any component of the path, the name included, is one of `names`."""
    return path.rlike(_part_pattern(names))


# A name that starts `test_`, or whose part before the suffix ends `_test`.
_TEST_NAME = r"(^|/)(test_[^/]*|\.?[^./]*_test)$|_test\.[^./]+$"


def has_test_name(path: Column) -> Column:
    return path.rlike(_TEST_NAME)


def is_test_file(path: Column) -> Column:
    """By name, or by lying in a test folder."""
    return path.contains("test") & path.rlike(f"{_TEST_NAME}|{_part_pattern(fixed.TEST_DIRS)}")


def is_python(path: Column) -> Column:
    """Suffix `.py`; a file that is only called `.py` has no suffix."""
    return path.endswith(".py") & ~path.endswith("/.py") & (path != ".py")


def path_order(path: Column) -> Column:
    """A string that sorts paths component by component (`a/b` before `a-b`)."""
    return F.replace(path, F.lit("/"), F.lit("\x01"))


def _slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative_to(path: Column, root: Column | None = None) -> Column:
    """Forward slashes, without `./` and without the root prefix where it is there."""
    whole = _slashed(path)
    # Most paths need no regular expression.
    rest = F.substring(whole, F.lit(3), F.length(whole))
    more = F.when(F.startswith(rest, F.lit("./")), F.regexp_replace(rest, r"^(\./)+", "")).otherwise(rest)
    slashed = F.when(F.startswith(whole, F.lit("./")), more).otherwise(whole)
    if root is None:
        return slashed
    prefix = F.concat(F.rtrim(_slashed(root), F.lit("/")), F.lit("/"))
    return F.when(
        F.startswith(slashed, prefix), F.substring(slashed, F.length(prefix) + 1, F.length(slashed))
    ).otherwise(slashed)


def contained(path: Column) -> Column:
    """The path with `.` and `..` resolved; NULL when it is absolute or leaves the root."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("inside"))

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        depth = F.size(acc["kept"])
        kept = (
            F.when(part.isin("", "."), acc["kept"])
            .when(up, F.slice(acc["kept"], 1, F.greatest(depth - 1, F.lit(0))))
            .otherwise(F.array_append(acc["kept"], part))
        )
        return F.struct(
            kept.alias("kept"), (acc["inside"] & ~(up & (depth == 0))).alias("inside")
        )

    resolved = F.aggregate(F.split(path, "/"), start, step)
    refused = path.startswith("/") | ~resolved["inside"]
    return F.when(~refused, F.array_join(resolved["kept"], "/"))
