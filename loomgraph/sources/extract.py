"""Symbols and raw edges of a source text.

Python is parsed by its own grammar. Other languages, and Python that doesn't parse, are read by patterns: comments
and strings are blanked out, definitions found by the language's patterns, and their extents by what closes a scope.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import workers_can_import
from loomgraph.sources.languages import Language, Registry

#: Words that look like calls but aren't, in most of the languages; each language may have more.
NOT_CALLS = frozenset(
    "if for while switch catch return function def fn func fun class sizeof typeof new delete throw else elif unless until do and or not in is with foreach using "
    "this case yield".split()
)


@dataclass
class Found:
    """What a text defines and uses; positions are offsets, lines count from 1."""

    classes: list[tuple[int, int, int, int, str, list[str]]] = field(default_factory=list)  # start, end, lines, name, bases
    functions: list[tuple[int, int, int, int, str]] = field(default_factory=list)
    calls: list[tuple[int, str, str]] = field(default_factory=list)  # position, receiver, callee
    imports: list[tuple[int, int, str]] = field(default_factory=list)  # position, line, module
    from_imports: list[tuple[int, int, str, list[str]]] = field(default_factory=list)


def make_id(path: str, name: str, kind: str) -> str:
    """symbol_id() of the model, outside Spark."""
    return hashlib.md5("\0".join((path, name, kind)).encode(), usedforsecurity=False).hexdigest()


class _Ranges:
    """Which of some ranges holds a position and begins last."""

    def __init__(self, ranges: list[tuple[int, int, object]]):
        self.ranges = sorted(ranges, key=lambda r: (r[0], -r[1]))
        self.starts = [r[0] for r in self.ranges]

    def innermost(self, at: int) -> object | None:
        i = bisect.bisect_right(self.starts, at) - 1
        while i >= 0:
            if at < self.ranges[i][1]:
                return self.ranges[i][2]
            i -= 1
        return None


def assemble(path: str, separator: str, found: Found) -> tuple[list[tuple], list[tuple]]:
    """Symbols (id, name, kind, line_start, line_end) in the order that decides between equal names, and raw edges
    (source, target_name, kind).

    A function that begins within a class is a method and bears the class's name; a call's source is the innermost
    function around it, else the file's own module symbol. ``self`` and ``cls`` stand for the class around them.
    """
    module = make_id(path, path, "module")
    classes = _Ranges([(s, e, name) for s, e, _, _, name, _ in found.classes])
    symbols, edges, scopes = [], [], []
    for start, _, first, last, name, bases in sorted(found.classes, key=lambda c: c[0]):
        id_ = make_id(path, name, "class")
        symbols.append((id_, name, "class", first, last))
        edges.extend((id_, base, "inherits") for base in bases)
    for start, end, first, last, name in found.functions:
        owner = classes.innermost(start)
        kind, full = ("function", name) if owner is None else ("method", f"{owner}.{name}")
        id_ = make_id(path, full, kind)
        symbols.append((id_, full, kind, first, last))
        scopes.append((start, end, id_))
    functions = _Ranges(scopes)
    symbols.append((module, path, "module", 1, 1))
    for at, receiver, callee in found.calls:
        if not callee:
            continue
        if receiver in ("self", "cls"):
            owner = classes.innermost(at)
            target = callee if owner is None else f"{owner}.{callee}"
        else:
            target = f"{receiver}.{callee}" if receiver else callee
        edges.append((functions.innermost(at) or module, target, "calls"))
    for _, line, name in found.imports:
        symbols.append((make_id(path, name, "module"), name, "module", line, line))
    for at, line, name, members in found.from_imports:
        for member in members:
            full = f"{name}{separator}{member}" if name else member
            symbols.append((make_id(path, full, "module"), full, "module", line, line))
            edges.append((functions.innermost(at) or module, full, "imports"))
    return symbols, edges


def read_python(text: str, lenient_imports: bool = False) -> Found:
    """What Python source defines and uses; SyntaxError if it doesn't parse.

    Names imported under another name, by a star or relatively are left out unless ``lenient_imports``."""
    tree = ast.parse(text)
    offsets = [0]
    for line in text.encode().splitlines(keepends=True):
        offsets.append(offsets[-1] + len(line))
    whole = text.encode()

    def at(node: ast.AST) -> int:
        return offsets[node.lineno - 1] + node.col_offset

    def end(node: ast.AST) -> int:
        return offsets[node.end_lineno - 1] + node.end_col_offset

    found = Found()
    nodes = sorted((n for n in ast.walk(tree) if hasattr(n, "lineno")), key=lambda n: (at(n), -end(n)))
    for node in nodes:
        if isinstance(node, ast.ClassDef):
            bases = [b.id for b in node.bases if isinstance(b, ast.Name)]
            found.classes.append((at(node), end(node), node.lineno, node.end_lineno, node.name, bases))
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            found.functions.append((at(node), end(node), node.lineno, node.end_lineno, node.name))
        elif isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name):
                found.calls.append((at(node), "", node.func.id))
            elif isinstance(node.func, ast.Attribute):
                value = node.func.value
                found.calls.append((at(node), whole[at(value) : end(value)].decode(), node.func.attr))
        elif isinstance(node, ast.Import):
            found.imports.extend((at(a), a.lineno, a.name) for a in node.names if lenient_imports or a.asname is None)
        elif isinstance(node, ast.ImportFrom):
            if node.level and not lenient_imports:
                continue
            members = [a.name for a in node.names if lenient_imports or (a.asname is None and a.name != "*")]
            found.from_imports.append((at(node), node.lineno, "." * node.level + (node.module or ""), members))
    return found


_STRING = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


def blanked(text: str, language: Language, strings: bool = True) -> str:
    """The text with comments, and strings if asked, as spaces; offsets and lines stay."""
    parts = [_STRING.pattern]
    if language.block:
        parts.append(re.escape(language.block[0]) + ".*?" + re.escape(language.block[1]))
    comments = "|".join(re.escape(c) if c != "#" else r"(?<![\w$])#(?!\s*include)" for c in language.comments)
    if comments:
        parts.append(f"(?:{comments})[^\n]*")
    if language.name in ("rust", "haskell"):  # an apostrophe there needn't open a string
        parts[0] = r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'"

    def blank(m: re.Match) -> str:
        is_string = m[0][0] in "\"'`" and not any(m[0].startswith(c) for c in (*language.comments, language.block[0] if language.block else "\0"))
        return m[0] if is_string and not strings else re.sub(r"[^\n]", " ", m[0])

    return re.compile("|".join(parts), re.S).sub(blank, text)


_OPENS = re.compile(r"\b(?:def|class|module|if|unless|while|until|for|case|begin|do|function|fn|repeat|defmodule|defp?|cond|with|try|receive|quote)\b|\bend\b|\bthen\b")


def _brace_end(text: str, start: int) -> int:
    """After the brace that closes the first one opened from ``start`` on; the line's end if none is opened before a
    semicolon."""
    depth, i = 0, start
    for m in re.compile(r"[{};]").finditer(text, start):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif not depth:
            return m.end()
        i = m.end()
    return len(text) if depth else max(i, text.find("\n", start) % (len(text) + 1))


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def _indent_end(text: str, start: int) -> int:
    """Before the first later line that isn't blank and not deeper than the one that begins at ``start``."""
    head = text.rfind("\n", 0, start) + 1
    own = _indent(text[head : text.find("\n", start) if "\n" in text[start:] else len(text)])
    at = text.find("\n", start)
    last = len(text) if at < 0 else at
    while 0 <= at < len(text):
        nxt = text.find("\n", at + 1)
        nxt = len(text) if nxt < 0 else nxt
        line = text[at + 1 : nxt]
        if line.strip():
            if _indent(line) <= own:
                return last
            last = nxt
        at = nxt
    return last


def _word_end(text: str, start: int, name: str) -> int:
    """After the ``end`` that closes the definition at ``start``."""
    depth = 0
    for line in re.compile(r"[^\n]+").finditer(text, start):
        body = line[0]
        inline = re.match(r"\s*(?:if|unless|while|until)\b", body) is None and name != "lua"
        for m in _OPENS.finditer(body):
            word = m[0]
            if word == "end":
                depth -= 1
                if depth <= 0:
                    return line.start() + m.end()
            elif name == "lua":
                depth += word in ("function", "if", "for", "while", "repeat") and not (word in ("for", "while") and False)
            elif name == "elixir":
                depth += word in ("do", "fn") and not body[m.end() :].startswith(":")
            elif word == "do":
                depth += not re.match(r"\s*(?:while|until|for)\b", body)
            elif word in ("if", "unless", "while", "until"):
                depth += not (inline and body[: m.start()].strip())
            elif word in ("def", "class", "module", "for", "case", "begin"):
                depth += body[: m.start()].rstrip()[-1:] != "."
    return len(text)


#: What follows the opening parenthesis of a declared member.
_DECLARED = re.compile(r"[^()]*\)\s*:")


def read_by_patterns(text: str, language: Language) -> Found:
    """What a text defines and uses, by the language's patterns."""
    code, with_strings = blanked(text, language), blanked(text, language, strings=False)
    lines = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(at: int) -> int:
        return bisect.bisect_right(lines, at)

    def extent(m: re.Match) -> tuple[int, int]:
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        if language.scope == "brace":
            # a pattern may have matched the brace itself
            end = _brace_end(code, m.end() - 1 if m[0][-1:] in "{;" else m.end())
        elif language.scope == "indent":
            end = _indent_end(code, start)
        else:
            end = _word_end(code, start, language.name)
        return start, max(end, m.end())

    found = Found()
    taken: set[int] = set()
    headers: list[tuple[int, int, object]] = []
    for pattern in language.classes:
        for m in re.finditer(pattern, code, re.M):
            at = m.start("name")
            if at in taken:
                continue
            taken.add(at)
            headers.append((m.start(), m.end(), True))
            start, end = extent(m)
            groups = m.groupdict()
            bases = [b for b in (re.sub(r"[<(\[].*", "", part).strip().split(" ")[-1] for part in re.split(r"[,+]|\bwith\b|\bimplements\b", groups.get("bases") or "")) if re.fullmatch(r"[\w.:\\$]+", b)]
            found.classes.append((start, end, line(start), line(end - 1), m["name"], bases))
    for pattern in language.functions:
        for m in re.finditer(pattern, code, re.M):
            groups = m.groupdict()
            which = "name" if groups.get("name") else "name2"
            if m.start(which) in taken or groups[which] in NOT_CALLS | language.words:
                continue
            taken.add(m.start(which))
            start, end = extent(m)
            found.functions.append((start, end, line(start), line(end - 1), m[which]))
    found.functions.sort()
    spans = []
    for pattern in language.imports:
        for m in re.finditer(pattern, with_strings, re.M):
            found.imports.append((m.start("module"), line(m.start("module")), m["module"]))
            spans.append((m.start(), m.end()))
    found.imports.sort()
    inside_import, inside_header = _Ranges([(a, b, True) for a, b in spans]), _Ranges(headers)
    inside_class, inside_function = (_Ranges([(f[0], f[1], True) for f in g]) for g in (found.classes, found.functions))

    def signature(m: re.Match) -> bool:
        """Whether a member is declared rather than called: parentheses and a type, in a class but no function."""
        if not inside_class.innermost(m.start()) or inside_function.innermost(m.start()):
            return False
        return _DECLARED.match(code, m.end()) is not None

    if language.bare:
        calls = re.finditer(r"(?:^|[;|&(]|\bthen\b|\bdo\b)[ \t]*(?P<callee>[A-Za-z_][\w-]*)(?![\w-]*\s*(?:=|\(\)))", code, re.M)
    else:
        calls = re.finditer(r"(?:(?P<receiver>[A-Za-z_$][\w$]*(?:(?:\.|::|->|\?\.)[A-Za-z_$][\w$]*)*)\s*(?:\.|::|->|\?\.|:)\s*)?(?P<callee>[A-Za-z_$][\w$]*[?!]?)\s*\(", code)
    for m in calls:
        callee, at = m["callee"], m.start("callee")
        if callee in NOT_CALLS or callee in language.words or at in taken or inside_import.innermost(at) or inside_header.innermost(at) or signature(m):
            continue
        receiver = (m.groupdict().get("receiver") or "").replace("this", "self") if language.receivers else ""
        if not receiver and not language.plain:
            continue
        found.calls.append((m.start() if receiver else at, receiver, callee))
    return found


def extract(path: str, text: str, language: Language, lenient_imports: bool = False, inherit_all: bool = True) -> tuple[list[tuple], list[tuple], str | None]:
    """(symbols, raw edges, error). Python that doesn't parse is read by patterns, and the error says so. Unless
    ``inherit_all``, only Python's classes have bases."""
    error = None
    if language.name == "python":
        try:
            found = read_python(text, lenient_imports)
        except (SyntaxError, ValueError, RecursionError) as e:
            found, error = read_by_patterns(text, language), f"{type(e).__name__}: {e}"
    else:
        found = read_by_patterns(text, language)
        if not inherit_all:
            found.classes = [(*c[:5], []) for c in found.classes]
    return *assemble(path, language.separator, found), error


PARSED = "path string, part string, id string, name string, kind string, line_start int, line_end int, target_name string, ord int, error string"


def parse_files(files: DataFrame, registry: Registry, lenient_imports: bool = False, inherit_all: bool = True) -> DataFrame:
    """Parse (path, text) in parallel. Rows of PARSED: symbols, edges, and errors, told apart by ``part``.

    Files of unknown extensions and null texts are left out. A file that cannot be read at all brings an error and
    nothing else; the others aren't affected."""
    workers_can_import(files.sparkSession)
    wanted = files.where("text is not null").select("path", "text")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        columns = [c.split()[0] for c in PARSED.split(", ")]
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"]):
                if not registry.supports(path):
                    continue
                try:
                    symbols, edges, error = extract(path, text, registry.language(path), lenient_imports, inherit_all)
                except Exception as e:  # noqa: BLE001  reported as a row
                    symbols, edges, error = [], [], f"{type(e).__name__}: {e}"
                rows += [(path, "symbol", id_, name, kind, a, b, None, i, None) for i, (id_, name, kind, a, b) in enumerate(symbols)]
                rows += [(path, "edge", source, None, kind, None, None, target, i, None) for i, (source, target, kind) in enumerate(edges)]
                if error:
                    rows.append((path, "error", None, None, None, None, None, None, 0, error))
            out = pd.DataFrame(rows, columns=columns)
            for c in ("line_start", "line_end", "ord"):
                out[c] = out[c].astype("Int32")
            yield out

    return wanted.mapInPandas(run, PARSED)


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """symbols, raw_edges and errors of parse_files()."""
    none = F.lit(None).cast("string").alias("metadata")
    return {
        "symbols": parsed.where("part = 'symbol'").select("id", "name", "kind", F.col("path").alias("file_path"), "line_start", "line_end", none, "ord"),
        "raw_edges": parsed.where("part = 'edge'").select(F.col("id").alias("source"), "target_name", "kind", F.col("path").alias("file_path"), "ord"),
        "errors": parsed.where("part = 'error'").select("path", "error"),
    }


def register_udtf(spark, registry: Registry, name: str = "extract_symbols") -> None:
    """Make ``name(path, text)`` available to SQL as a table function (part, id, name, kind, line_start, line_end,
    target_name)."""
    from pyspark.sql.functions import udtf

    workers_can_import(spark)

    class ExtractSymbols:
        def eval(self, path: str, text: str):
            if path is None or text is None or not registry.supports(path):
                return
            symbols, edges, _ = extract(path, text, registry.language(path))
            for id_, label, kind, a, b in symbols:
                yield "symbol", id_, label, kind, a, b, None
            for source, target, kind in edges:
                yield "edge", source, None, kind, None, None, target

    made = udtf(ExtractSymbols, returnType="part string, id string, name string, kind string, line_start int, line_end int, target_name string")
    spark.udtf.register(name, made)
