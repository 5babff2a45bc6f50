"""Text functions: LIKE as embedded databases have it, snippets, and branch names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_pattern(query: str, literal: bool = False) -> str:
    """A Java regular expression for LIKE '%query%': only A-Z and a-z fold, ``%`` and ``_`` are wild unless
    ``literal``, and there is no escape character."""
    wild = {} if literal else {"%": ".*", "_": "."}
    out, plain = [], []
    for c in query:
        if c in wild:
            out.append(_quoted("".join(plain)) + wild[c])
            plain = []
        else:
            plain.append(c)
    return "(?is)" + "".join(out) + _quoted("".join(plain))


def _quoted(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z \u0080-\U0010ffff])", r"\\\1", text).replace("\\\n", "\\n") if text else ""


def matches(column: Column, query: str, literal: bool = False) -> Column:
    """Whether ``column`` contains ``query`` in the sense of like_pattern()."""
    return column.rlike(like_pattern(query, literal))


def lines_of(text: Column) -> Column:
    """The lines of a text as an array: CR LF and LF end a line, and a final line end starts no further one."""
    parts = F.split(F.regexp_replace(text, "\r?\n", "\n"), "\n", -1)
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(
        F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    )


def snippet(lines: Column, line_start: Column, line_end: Column, context: int = 2) -> Column:
    """Lines from ``line_start`` to ``line_end``, numbered from 1, with ``context`` lines around them, joined by line
    ends. Empty if there are no such lines."""
    first = F.greatest(F.lit(1), line_start - context)
    last = F.least(line_end + context, F.size(lines))
    taken = F.slice(lines, first, F.greatest(F.lit(0), last - first + 1))
    return F.when(F.size(lines) >= first, F.array_join(taken, "\n")).otherwise(F.lit(""))


def branch_folder(branch: str) -> str:
    """A branch's name as one path segment."""
    return branch.replace("/", "--")
