"""Expressions over file contents and replies."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeaudit import fixed

# What counts as a line break and as white space in text.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0" + "".join(
    chr(c) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
FENCE_OPEN = "^```(json)?"
FENCE_CLOSE = "```$"


def decode(raw: Column) -> Column:
    """UTF-8 text of a binary column without its invalid bytes, line breaks as `\\n`."""
    text = raw.cast("string")
    valid = F.when(F.is_valid_utf8(text), text).otherwise(
        F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    )
    return unify_newlines(valid)


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line break opens no further line."""
    lines = F.split(text, LINE_BREAK, -1)
    last_empty = (F.element_at(lines, -1) == "").cast("int")
    return F.slice(lines, 1, F.size(lines) - last_empty)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def strip_fence(reply: Column) -> Column:
    """Reply text without white space around it and without one code fence."""

    def bare(text: Column) -> Column:
        return F.when(text.contains("```"), F.regexp_replace(F.regexp_replace(text, FENCE_OPEN, ""), FENCE_CLOSE, "")).otherwise(text)

    return once(strip(reply), bare)


def strict_json(text: Column, schema: str) -> Column:
    """A JSON text as `schema`; NULL unless it is one value of the schema's kind and nothing else.

    The text is read as the only element of an array, so anything after the value breaks it.
    """
    opening = "[" if schema.upper().startswith("ARRAY") else "{"

    def value(raw: Column) -> Column:
        opens = F.startswith(F.ltrim(raw, F.lit(SPACES)), F.lit(opening))
        read = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), f"ARRAY<{schema}>", {"allowSingleQuotes": "false"})
        return once(read, lambda one: F.when((F.size(one) == 1) & opens, one[0]))

    return once(text, value)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once, however often `use` names it.

    An expression that is named in a condition and in its branches is otherwise evaluated for each of them.
    """
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Lower-cased runs of three or more ASCII letters, in order, with repeats."""
    runs = F.regexp_extract_all(text, F.lit(f"({fixed.WORD})"), 1)
    return F.transform(runs, F.lower)


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({fixed.IDENTIFIER})"), 1)


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty `part`; 0 for an empty one."""
    removed = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, (removed / F.length(part)).cast("int")).otherwise(0)


def replace_first(text: Column, part: Column, new: Column) -> Column:
    at = F.instr(text, part)
    before = F.substring(text, F.lit(1), at - 1)
    after = F.substring(text, at + F.length(part), F.length(text))
    return F.when(at > 0, F.concat(before, new, after)).otherwise(text)


def hmac_sha256(body: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 of a binary column, from the built-in digest."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    first = F.unhex(F.sha2(F.concat(inner, body), 256))
    return F.sha2(F.concat(outer, first), 256)
