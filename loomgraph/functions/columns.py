"""Scalar functions of the engine as Spark columns; none leaves the JVM."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sanitize(text: Column, length: int = 256) -> Column:
    """Drop control characters but tab and newline, then cut."""
    return F.substring(F.regexp_replace(text, "[\\x00-\\x08\\x0B-\\x1F]", ""), 1, length)


def base_name(path: Column) -> Column:
    """The last component of a path."""
    return F.element_at(F.split(path, "/"), -1)


def parent_dir(path: Column) -> Column:
    """A path without its last component; '.' for a bare name."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def suffix(path: Column) -> Column:
    """The lower-cased extension with its dot; empty for dotfiles such as '.py'."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def last_segment(key: Column) -> Column:
    """What follows the last '::'."""
    return F.element_at(F.split(key, "::"), -1)


def matches_any(path: Column, patterns: Sequence[str]) -> Column:
    """True where the whole path matches one of some shell patterns, in which '*' crosses '/'."""
    return reduce(lambda a, b: a | b, [path.rlike(_java(fnmatch.translate(p))) for p in patterns], F.lit(False))


def _java(regex: str) -> str:
    return regex.replace(r"\Z", r"\z").replace("(?>", "(?>")


def line_count(text: Column) -> Column:
    """Newlines and one."""
    return F.size(F.split(text, "\n", -1))


def lines(text: Column) -> Column:
    """The lines of a text as an array, without an empty one after the last line end."""
    return let(F.split(text, LINE_END, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def numbered(text: Column, limit: int) -> Column:
    """Up to ``limit`` lines as 'n: line', then a note on how many more there are."""

    def told(rows: Column) -> Column:
        shown = F.array_join(F.transform(F.slice(rows, 1, limit), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")
        rest = F.size(rows) - limit
        return F.when(rest > 0, F.concat(shown, F.lit("\n... ("), rest.cast("string"), F.lit(" more lines)"))).otherwise(shown)

    return let(lines(text), told)


def like_word(column: Column, word: str) -> Column:
    """Case-insensitive substring search in which % and _ of the word are wildcards and a backslash is itself."""
    return F.lower(column).like(f"%{word.lower()}%".replace("\\", "\\\\"))


def collapse_spaces(text: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def has_binary_mark(content: Column) -> Column:
    """True if the first 8192 bytes hold a zero byte."""
    return F.coalesce(F.contains(F.substring(content, 1, 8192), F.lit(bytearray(b"\x00"))), F.lit(True))


def decoded(content: Column) -> Column:
    """Bytes as text, with a replacement character for what isn't UTF-8."""
    return F.make_valid_utf8(content.cast("string"))
