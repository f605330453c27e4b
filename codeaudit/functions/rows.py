"""Turning array columns into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inline_rows(
    df: DataFrame, keep: Sequence[str | Column], rows: Column, required: str
) -> DataFrame:
    """Rows of an array of structs beside `keep`; `required` names a field that is never NULL.

    For an inner explode of an expression the optimizer adds a filter on the array's size
    below it, which evaluates the expression (a parse, a regular expression) a second time.
    The outer form has no such filter.
    """
    return df.select(*keep, F.inline_outer(rows)).filter(F.col(required).isNotNull())


def explode_rows(
    df: DataFrame, keep: Sequence[str | Column], values: Column, name: str
) -> DataFrame:
    """Elements of an array without NULLs beside `keep`, evaluated once like `inline_rows`."""
    return df.select(*keep, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


def posexplode_rows(
    df: DataFrame, keep: Sequence[str | Column], values: Column, pos: str, name: str
) -> DataFrame:
    """Elements with their position from 0 beside `keep`, evaluated once like `inline_rows`."""
    return df.select(*keep, F.posexplode_outer(values).alias(pos, name)).filter(
        F.col(pos).isNotNull()
    )
