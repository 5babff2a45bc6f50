"""Configuration: which repositories there are, and how they depend on one another."""

from __future__ import annotations

import json
import os
import re
import subprocess
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from loomgraph.errors import ConfigError, RepoNotFound

#: Environment variables that name the configuration file and the folder of language definitions.
CONFIG_VARIABLE = "LOOMGRAPH_CONFIG"
LANGUAGES_VARIABLE = "LOOMGRAPH_LANGUAGES"


@dataclass
class Organization:
    name: str = ""


@dataclass
class Server:
    mode: str = "stdio"
    port: int = 3100


@dataclass
class GraphSettings:
    store: str = "parquet"
    max_hop_depth: int = 4
    branch_ttl: str = "30d"


@dataclass
class Embeddings:
    enabled: bool = False
    store: str | None = None
    model: str | None = None
    model_path: str | None = None


@dataclass
class Repo:
    name: str
    root: str
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)


@dataclass
class Dep:
    package: str
    repo: str


@dataclass
class Config:
    organization: Organization = field(default_factory=Organization)
    server: Server = field(default_factory=Server)
    graph: GraphSettings = field(default_factory=GraphSettings)
    embeddings: Embeddings = field(default_factory=Embeddings)
    repos: list[Repo] = field(default_factory=list)
    deps: list[Dep] = field(default_factory=list)

    def repo(self, name: str) -> Repo:
        for r in self.repos:
            if r.name == name:
                return r
        raise RepoNotFound(name)

    def repo_of(self, folder: str) -> Repo:
        """The first configured repository that holds a folder."""
        here = Path(folder).resolve()
        for r in self.repos:
            if here.is_relative_to(Path(r.root).resolve()):
                return r
        raise RepoNotFound(f"no configured repository holds {folder}")

    def pick(self, name: str | None, folder: str = ".") -> Repo:
        return self.repo(name) if name else self.repo_of(folder)


def _made(kind: type, table: dict, where: str):
    known = kind.__dataclass_fields__
    unknown = set(table) - set(known)
    if unknown:
        raise ConfigError(f"unknown settings in {where}: {', '.join(sorted(unknown))}")
    try:
        return kind(**table)
    except TypeError as e:
        raise ConfigError(f"{where}: {e}") from e


def parse(text: str) -> Config:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    if "name" not in data.get("organization", {}):
        raise ConfigError("organization.name is missing")
    return Config(
        _made(Organization, data["organization"], "organization"),
        _made(Server, data.get("server", {}), "server"),
        _made(GraphSettings, data.get("graph", {}), "graph"),
        _made(Embeddings, data.get("embeddings", {}), "embeddings"),
        [_made(Repo, r, "repos") for r in data.get("repos", [])],
        [_made(Dep, d, "deps") for d in data.get("deps", [])],
    )


def user_folder() -> Path:
    return Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "loomgraph"


def config_path(given: str | None = None) -> Path:
    """The configuration file: as given, else as the environment says, else the user's own."""
    return Path(given or os.environ.get(CONFIG_VARIABLE) or user_folder() / "config.toml")


def languages_folder(given: str | None = None) -> Path:
    return Path(given or os.environ.get(LANGUAGES_VARIABLE) or user_folder() / "languages")


def data_folder(given: str | None = None) -> Path:
    shared = os.environ.get("XDG_DATA_HOME")
    return Path(given) if given else (Path(shared) / "loomgraph" if shared else user_folder() / "data")


def load(given: str | None = None) -> Config:
    path = config_path(given)
    try:
        return parse(path.read_text())
    except OSError as e:
        raise ConfigError(f"{path}: {e}") from e


def dump(config: Config) -> str:
    """The configuration as TOML; parse() reads it back."""

    def value(v: object) -> str:
        return json.dumps(v, ensure_ascii=False)

    def table(head: str, item: object) -> str:
        lines = [f"{k} = {value(v)}" for k, v in vars(item).items() if v is not None]
        return "\n".join([head, *lines])

    parts = [table(f"[{name}]", getattr(config, name)) for name in ("organization", "server", "graph", "embeddings")]
    parts += [table("[[repos]]", r) for r in config.repos] + [table("[[deps]]", d) for d in config.deps]
    return "\n\n".join(parts) + "\n"


def init(organization: str, path: str | None = None) -> Path:
    """Create a configuration without repositories. An existing one is left alone, with an error."""
    to = config_path(path)
    if to.exists():
        raise ConfigError(f"{to} exists")
    to.parent.mkdir(parents=True, exist_ok=True)
    to.write_text(dump(Config(Organization(organization))))
    return to


def add_repo(config: Config, root: str, name: str | None = None, extensions: list[str] | None = None) -> Repo:
    """Add the git checkout at ``root``, including files with the given extensions."""
    name = name or Path(root).resolve().name
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ConfigError(f"{name!r}: a repository's name has letters, digits, - and _ only")
    if any(r.name == name for r in config.repos):
        raise ConfigError(f"there is a repository {name} already")
    if not (Path(root) / ".git").exists():
        raise ConfigError(f"{root} is no git checkout")
    repo = Repo(name, str(Path(root).resolve()), [f"**/*.{e}" for e in sorted(extensions or [])])
    config.repos.append(repo)
    return repo


def add_dep(config: Config, package: str, repo: str) -> None:
    config.repo(repo)
    remove_dep(config, package)
    config.deps.append(Dep(package, repo))


def remove_dep(config: Config, package: str) -> None:
    config.deps[:] = [d for d in config.deps if d.package != package]


def broken_deps(config: Config) -> list[Dep]:
    """Dependencies on repositories that aren't configured."""
    names = {r.name for r in config.repos}
    return [d for d in config.deps if d.repo not in names]


def seconds(ttl: str) -> int:
    """A duration such as 30d, 12h, 45m or 10s."""
    found = re.fullmatch(r"(\d+)([dhms])", ttl)
    if not found:
        raise ConfigError(f"{ttl!r} is no duration")
    return int(found[1]) * {"d": 86400, "h": 3600, "m": 60, "s": 1}[found[2]]


def current_branch(root: str) -> str:
    """The branch that is checked out, ``HEAD`` if none is, ``main`` outside git."""
    try:
        done = subprocess.run(["git", "-C", root, "rev-parse", "--abbrev-ref", "HEAD"], capture_output=True, text=True, check=True)
    except (OSError, subprocess.CalledProcessError):
        return "main"
    return done.stdout.strip() or "main"
