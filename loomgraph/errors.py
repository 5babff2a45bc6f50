"""What can go wrong, as exceptions."""


class GraphError(Exception):
    """Base of all errors of this package."""


class StoreError(GraphError):
    """A snapshot cannot be read or written."""


class ParseError(GraphError):
    """A source file cannot be parsed."""


class ConfigError(GraphError):
    """A configuration is missing or malformed."""


class SymbolNotFound(GraphError):
    """No symbol has the given name or id."""


class RepoNotFound(GraphError):
    """No configured repository has the given name or holds the given folder."""
