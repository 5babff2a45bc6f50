"""The languages that can be parsed, and how files are told apart."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loomgraph.errors import ParseError
from loomgraph.model import EXTENSIONS


@dataclass(frozen=True)
class Language:
    """A language's files, separator, and the patterns of its definitions, imports and scopes.

    Patterns have groups ``name`` and, for classes, ``bases``; imports have ``module``. ``scope`` says what ends a
    definition: a closing brace, the word ``end``, less indentation, or the line. ``receivers``: whether calls have
    them; ``plain``: whether calls without one are kept.
    """

    name: str
    extensions: tuple[str, ...]
    separator: str = "."
    scope: str = "brace"
    functions: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    comments: tuple[str, ...] = ("//",)
    block: tuple[str, str] | None = ("/*", "*/")
    receivers: bool = True
    plain: bool = True
    bare: bool = False  # every command is a call
    words: frozenset[str] = field(default_factory=frozenset)


_ID = r"[A-Za-z_$][\w$]*"
_JS_CLASS = rf"\bclass\s+(?P<name>{_ID})(?:\s+extends\s+(?P<bases>[\w$.]+))?"
_JS_FUNCTIONS = (
    rf"\bfunction\s*\*?\s*(?P<name>{_ID})\s*\(",
    rf"\b(?:const|let)\s+(?P<name>{_ID})\s*=\s*(?:async\s*)?(?:\([^()]*\)|{_ID})\s*=>",
    rf"^[ \t]+(?:(?:async|static|public|private|protected|get|set|readonly)\s+)*(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|new\b){_ID})\s*\([^()]*\)\s*(?::[^{{;=]+)?\{{",
)
_JS_IMPORTS = (r"\bimport\s+(?:[^'\";]*?\bfrom\s+)?(?P<module>['\"][^'\"]+['\"])", r"\brequire\s*\(\s*(?P<module>['\"][^'\"]+['\"])\s*\)")
_C_FUNCTION = r"^[ \t]*(?!return\b|else\b|if\b|while\b|for\b|switch\b|typedef\b|using\b|new\b|delete\b)(?:[\w:<>,&*~\[\]]+[\s*&]+)+\*?(?:\w+::)*(?P<name>~?\w+)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:const|noexcept|override|\s)*[{;]"
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|virtual|async|synchronized|native|default|partial|inline|suspend|data|extern|unsafe|readonly|new|fileprivate|mutating|lazy|implicit|case|companion|enum|annotation|inner)\s+)*"

#: The languages that come with the package. Extensions and separators are fixed values.
BUILT_IN: tuple[Language, ...] = (
    Language("python", ("py", "pyi"), scope="indent", comments=("#",), block=None,
             functions=(r"^[ \t]*(?:async\s+)?def\s+(?P<name>\w+)",), classes=(r"^[ \t]*class\s+(?P<name>\w+)(?:\s*\((?P<bases>[^()]*)\))?",),
             imports=(r"^[ \t]*import\s+(?P<module>[\w.]+)",)),
    Language("javascript", ("js", "jsx", "mjs"), functions=_JS_FUNCTIONS, classes=(_JS_CLASS,), imports=_JS_IMPORTS),
    Language("typescript", ("ts", "tsx"), functions=_JS_FUNCTIONS,
             classes=(_JS_CLASS, rf"\binterface\s+(?P<name>{_ID})(?:\s+extends\s+(?P<bases>[^{{]+))?", rf"\btype\s+(?P<name>{_ID})(?:<[^=]*>)?\s*="), imports=_JS_IMPORTS[:1]),
    Language("rust", ("rs",), "::", functions=(r"\bfn\s+(?P<name>\w+)",),
             classes=(r"\b(?:struct|enum|trait)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\s*:\s*(?P<bases>[^{;]+))?", r"\bimpl(?:<[^>]*>)?\s+(?:(?P<bases>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<name>\w+)"),
             imports=(r"\buse\s+(?P<module>[\w:]+(?:::\*)?)\s*;",), words=frozenset({"match", "loop"})),
    Language("go", ("go",), "/", functions=(r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)",), classes=(r"^\s*(?:type\s+)?(?P<name>[A-Za-z_]\w*)\s+(?:struct|interface)\b",),
             imports=(r"^\s*(?:import\s+)?(?:[\w.]+\s+)?(?P<module>\"[\w./\-]+\")\s*$",), words=frozenset({"go", "defer", "select"})),
    Language("java", ("java",), functions=(rf"^[ \t]*{_MODIFIERS}(?:<[^>]+>\s*)?(?!return\b|new\b|else\b|throw\b)(?:[\w<>\[\],.?]+\s+)?(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|synchronized\b)\w+)\s*\([^;{{}}()]*\)\s*(?:throws\s+[\w., ]+)?\s*[{{;]",),
             classes=(r"\b(?:class|interface|enum)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\s+(?:extends|implements)\s+(?P<bases>[^{]+))?",), imports=(r"^\s*import\s+(?:static\s+)?(?P<module>[\w.]+)",), plain=False),
    Language("c", ("c", "h"), functions=(_C_FUNCTION,), classes=(r"\b(?:struct|enum)\s+(?P<name>\w+)\s*\{", r"\btypedef\b[^;{}]*?(?P<name>\w+)\s*;"),
             imports=(r"^[ \t]*#\s*include\s+(?P<module>[<\"][^>\"]+[>\"])",), receivers=False),
    Language("cpp", ("cpp", "cc", "cxx", "hpp", "hxx"), "::", functions=(_C_FUNCTION,),
             classes=(r"\b(?:class|struct|enum(?:\s+class)?|namespace)\s+(?P<name>\w+)(?:\s*:\s*(?P<bases>[^{;]+))?\s*\{",),
             imports=(r"^[ \t]*#\s*include\s+(?P<module>[<\"][^>\"]+[>\"])", r"^\s*using\s+(?:namespace\s+)?(?P<module>[\w:]+)\s*;")),
    Language("c_sharp", ("cs",), functions=(rf"^[ \t]*{_MODIFIERS}(?!return\b|new\b|else\b|throw\b)(?:[\w<>\[\],.?]+\s+)?(?P<name>(?!if\b|for\b|foreach\b|while\b|switch\b|catch\b|using\b|lock\b)\w+)\s*(?:<[^>]+>)?\([^;{{}}()]*\)\s*(?:where[^{{;]+)?(?:[{{;]|=>)",),
             classes=(r"\b(?:class|interface|struct|enum)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\s*:\s*(?P<bases>[^{]+))?",), imports=(r"^\s*using\s+(?P<module>[\w.]+)\s*;",)),
    Language("swift", ("swift",), functions=(r"\bfunc\s+(?P<name>\w+)",), classes=(r"\b(?:class|struct|protocol|enum)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\s*:\s*(?P<bases>[^{]+))?\s*\{",), imports=(r"^\s*import\s+(?P<module>[\w.]+)",)),
    Language("kotlin", ("kt", "kts"), functions=(r"\bfun\s+(?:<[^>]+>\s*)?(?:[\w.]+\.)?(?P<name>\w+)\s*\(",),
             classes=(r"\b(?:class|interface|object)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\s*\([^)]*\))?(?:\s*:\s*(?P<bases>[^{\n]+))?",), imports=(r"^\s*import\s+(?P<module>[\w.]+)",)),
    Language("scala", ("scala", "sc"), functions=(r"\bdef\s+(?P<name>\w+)",), classes=(r"\b(?:class|object|trait)\s+(?P<name>\w+)(?:\[[^\]]*\])?(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<bases>[^{\n]+))?",), imports=(r"^\s*import\s+(?P<module>[\w.]+)",)),
    Language("php", ("php",), "\\", functions=(r"\bfunction\s+&?(?P<name>\w+)\s*\(",), classes=(r"\b(?:class|interface|trait)\s+(?P<name>\w+)(?:\s+(?:extends|implements)\s+(?P<bases>[^{]+))?",),
             imports=(r"^\s*use\s+(?:function\s+|const\s+)?(?P<module>[\w\\]+)",), comments=("//", "#")),
    Language("ruby", ("rb",), "::", scope="end", functions=(r"^[ \t]*def\s+(?:self\.)?(?P<name>[\w?!=]+)",), classes=(r"^[ \t]*(?:class|module)\s+(?P<name>[\w:]+)(?:\s*<\s*(?P<bases>[\w:]+))?",),
             imports=(r"^\s*require(?:_relative)?\s*\(?\s*(?P<module>['\"][^'\"]+['\"])",), comments=("#",), block=None, receivers=False),
    Language("lua", ("lua",), scope="end", functions=(r"\bfunction\s+(?:\w+[.:])*(?P<name>\w+)\s*\(",), imports=(r"\brequire\s*\(?\s*(?P<module>['\"][^'\"]+['\"])",), comments=("--",), block=("--[[", "]]")),
    Language("zig", ("zig",), functions=(r"\bfn\s+(?P<name>\w+)", r"^\s*(?:pub\s+)?const\s+(?P<name>\w+)\s*="), imports=(r"@import\s*\(\s*(?P<module>\"[^\"]+\")",), block=None, receivers=False),
    Language("haskell", ("hs",), scope="indent", functions=(r"^(?P<name>(?!module\b|import\b|data\b|type\b|newtype\b|class\b|instance\b|where\b|infix)[a-z_][\w']*)\b[^\n:]*=",),
             classes=(r"^(?:data|newtype|type|class|instance)\s+(?:[^\n=]*=>\s*)?(?P<name>[A-Z]\w*)",), imports=(r"^import\s+(?:qualified\s+)?(?P<module>[\w.]+)",), comments=("--",), block=("{-", "-}"), receivers=False),
    Language("elixir", ("ex", "exs"), scope="end", functions=(r"^\s*defp?\s+(?P<name>[\w?!]+)",), classes=(r"^\s*defmodule\s+(?P<name>[\w.]+)",), imports=(r"^\s*(?:alias|import|require|use)\s+(?P<module>[\w.]+)",), comments=("#",), block=None),
    Language("bash", ("sh", "bash"), functions=(r"^[ \t]*(?:function\s+(?P<name>[\w-]+)|(?P<name2>[\w-]+)\s*\(\))\s*(?:\(\))?\s*\{",), imports=(r"^\s*(?:source|\.)\s+(?P<module>\S+)",), comments=("#",), block=None, receivers=False, bare=True, words=frozenset({"then", "fi", "done", "esac", "local", "export", "set", "source"})),
)


class Registry:
    """Languages by extension."""

    def __init__(self, languages: tuple[Language, ...] = BUILT_IN):
        self.languages = {lang.name: lang for lang in languages}
        self.by_extension = {e: lang for lang in languages for e in lang.extensions}

    def supports(self, path: str) -> bool:
        return self.extension(path) in self.by_extension

    def language(self, path: str) -> Language:
        found = self.by_extension.get(self.extension(path))
        if found is None:
            raise ParseError(f"unsupported file type: {path}")
        return found

    @staticmethod
    def extension(path: str) -> str:
        name = path.rsplit("/", 1)[-1]
        return name.rsplit(".", 1)[1] if "." in name[1:] else ""

    def extensions(self) -> list[str]:
        return sorted(self.by_extension)

    def table(self, spark: SparkSession) -> DataFrame:
        """(ext, lang)."""
        return spark.createDataFrame([(e, lang.name) for e, lang in sorted(self.by_extension.items())], EXTENSIONS)


def load_registry(folder: str | Path, built_in: bool = True) -> tuple[Registry, list[str]]:
    """A registry with the languages that ``*.toml`` files of a folder define, over those built in, and warnings about
    files that define none. A folder that isn't there adds nothing."""
    languages = {lang.name: lang for lang in BUILT_IN} if built_in else {}
    warnings = []
    for path in sorted(Path(folder).glob("*.toml")):
        try:
            data = tomllib.loads(path.read_text())
            name = data.pop("name", path.stem)
            fields = {k: tuple(v) if isinstance(v, list) else v for k, v in data.items()}
            languages[name] = Language(name, tuple(fields.pop("extensions")), fields.pop("module_separator", "."), **fields)
        except (OSError, KeyError, TypeError, tomllib.TOMLDecodeError) as e:
            warnings.append(f"{path}: {e}")
    return Registry(tuple(languages.values())), warnings
