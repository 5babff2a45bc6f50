"""Source files of a checkout: which belong to a repository, their texts and their hashes."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> re.Pattern:
    """A glob in the manner of ignore files as a regular expression over relative paths.

    ``*`` and ``?`` stop at slashes, ``**`` doesn't; a pattern with an inner or leading slash counts from the root,
    any other fits at every depth. A match of a folder covers what is in it.
    """
    anchored = "/" in pattern.rstrip("/")
    body = pattern.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inner = body[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(body[i]), i + 1
    tail = "/.*" if pattern.endswith("/") else "(?:/.*)?"
    return re.compile(("" if anchored else "(?:.*/)?") + out + tail, re.S)


class Ignored:
    """Rules of ignore files: the last that fits decides, deeper files after shallower ones."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, bool, re.Pattern]] = []

    def add(self, folder: str, lines: Iterable[str]) -> None:
        for line in lines:
            line = line.rstrip("\n\r")
            line = re.sub(r"(?<!\\) +$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep or line.startswith("\\") and line[1:2] in "!#" else line
            self.rules.append((folder, keep, glob_regex(line)))

    def __call__(self, path: str) -> bool:
        out = False
        for folder, keep, pattern in self.rules:
            if folder and not path.startswith(folder + "/"):
                continue
            if pattern.fullmatch(path[len(folder) + 1 :] if folder else path):
                out = not keep
        return out


def _lines(path: Path) -> list[str]:
    try:
        return path.read_text(errors="replace").split("\n")
    except OSError:
        return []


def collect_files(root: str, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> list[str]:
    """Relative paths of the files of a checkout, sorted by code point.

    Hidden files and folders are left out, and so is what ignore files name: .gitignore at any depth,
    .git/info/exclude and the user's own. With ``include`` only files that match are taken, even ignored ones; what
    matches ``exclude`` never is.
    """
    base = Path(root)
    ignored = Ignored()
    own = subprocess.run(["git", "-C", root, "config", "--path", "core.excludesFile"], capture_output=True, text=True)
    personal = own.stdout.strip() or os.path.expanduser("~/.config/git/ignore")
    ignored.add("", _lines(Path(personal)))
    ignored.add("", _lines(base / ".git/info/exclude"))
    wanted, unwanted = [glob_regex(p) for p in include], [glob_regex(p) for p in exclude]
    found = []
    for folder, folders, files in os.walk(base):
        relative = os.path.relpath(folder, base).replace(os.sep, "/")
        relative = "" if relative == "." else relative
        ignored.add(relative, _lines(Path(folder) / ".gitignore"))
        folders[:] = sorted(f for f in folders if not f.startswith("."))
        for name in files:
            path = f"{relative}/{name}" if relative else name
            if name.startswith(".") or not os.path.isfile(os.path.join(folder, name)):
                continue
            if any(p.fullmatch(path) for p in unwanted):
                continue
            if any(p.fullmatch(path) for p in wanted) if wanted else not ignored(path):
                found.append(path)
    return sorted(found)


def read_files(spark: SparkSession, root: str, paths: Iterable[str] | None = None) -> DataFrame:
    """(path, text, content_hash, mtime, status) of the files below ``root``, a folder in any store that Spark reads.

    Paths are relative to the root. The status of a file that isn't UTF-8 is ``unreadable``, and its text null; all
    others are ``ok``. mtime is in seconds. With ``paths`` only those files are returned; the list may be long, so it
    is joined.
    """
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    prefix = fs.makeQualified(base).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.\-]*:(//[^/]*)?", "")
    valid = F.try_validate_utf8(F.col("content").cast("string"))
    out = files.select(
        F.substring(path, len(prefix) + 1, 1 << 20).alias("path"),
        valid.alias("text"),
        F.sha2("content", 256).alias("content_hash"),
        F.unix_timestamp("modificationTime").alias("mtime"),
        F.when(valid.isNull(), "unreadable").otherwise("ok").alias("status"),
    )
    if paths is not None:
        out = out.join(spark.createDataFrame([(p,) for p in paths], "path string"), "path", "left_semi")
    return out


def as_sources(found: DataFrame) -> DataFrame:
    """(path, text) of readable files, for snippets."""
    return found.where("status = 'ok'").select("path", "text")
