"""Annotations from outside the source text."""

from __future__ import annotations

import fnmatch
import subprocess
from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import ANNOTATIONS
from loomgraph.runtime import workers_can_import


class Enricher(Protocol):
    """Makes annotations (symbol_id, source, key, value) of symbols."""

    name: str

    def apply(self, symbols: DataFrame) -> DataFrame: ...


class CodeOwners:
    """Owners of files by patterns, of which the last that matches counts."""

    name = "codeowners"

    def __init__(self, lines: Iterable[str]):
        self.rules = [(p[0], " ".join(p[1:])) for p in (line.split("#")[0].split() for line in lines) if p]

    @staticmethod
    def _regex(pattern: str) -> str:
        anchored = pattern.startswith("/") or "/" in pattern.rstrip("/")
        body = pattern.strip("/")
        inner = fnmatch.translate(body.replace("**", "*")).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z")
        return ("^" if anchored else "(^|/)") + inner + ("/" if pattern.endswith("/") else "(/|$)")

    def apply(self, symbols: DataFrame) -> DataFrame:
        owner = F.lit(None).cast("string")
        for pattern, owners in self.rules:
            owner = F.when(F.col("file_path").rlike(self._regex(pattern)), F.lit(owners)).otherwise(owner)
        found = symbols.select(F.col("id").alias("symbol_id"), F.lit(self.name).alias("source"), F.lit("owner").alias("key"), owner.alias("value"))
        return found.where("value is not null and value <> ''")


def blamed_lines(root: str, path: str) -> list[tuple[str, int, str, int]]:
    """(path, line, author, time) of every line of a file in a checkout; nothing if git doesn't know it."""
    done = subprocess.run(["git", "-C", root, "blame", "--line-porcelain", "--", path], capture_output=True, text=True)
    out: list[tuple[str, int, str, int]] = []
    author, when = "", 0
    for line in done.stdout.split("\n"):
        if line.startswith("author "):
            author = line[7:]
        elif line.startswith("author-time "):
            when = int(line[12:])
        elif line.startswith("\t"):
            out.append((path, len(out) + 1, author, when))
    return out


class GitBlame:
    """The last author and time of each symbol's lines. Files are blamed in tasks, where the checkout is readable."""

    name = "git_blame"

    def __init__(self, root: str):
        self.root = root

    def apply(self, symbols: DataFrame) -> DataFrame:
        root = self.root

        def blame(frames):
            import pandas as pd

            for frame in frames:
                for path in frame["file_path"]:
                    yield pd.DataFrame(blamed_lines(root, path), columns=["file_path", "line", "author", "time"])

        workers_can_import(symbols.sparkSession)
        lines = symbols.select("file_path").distinct().mapInPandas(blame, "file_path string, line int, author string, time bigint")
        last = symbols.join(lines, "file_path").where("line >= line_start and line <= line_end").groupBy("id").agg(F.max(F.struct("time", "author")).alias("last"))
        entries = F.array(
            F.struct(F.lit("last_author").alias("key"), F.col("last.author").alias("value")),
            F.struct(F.lit("last_change").alias("key"), F.col("last.time").cast("string").alias("value")),
        )
        return last.select(F.col("id").alias("symbol_id"), F.lit(self.name).alias("source"), F.inline(entries))


def enriched(annotations: DataFrame, symbols: DataFrame, enricher: Enricher) -> DataFrame:
    """Annotations with those of ``enricher`` in place of what it said before."""
    fresh = enricher.apply(symbols).select(*ANNOTATIONS.names)
    return annotations.where(F.col("source") != enricher.name).select(*ANNOTATIONS.names).unionByName(fresh)
