"""Errors of layouts, files and queries, each with a code."""

from __future__ import annotations

from collections.abc import Iterable


class LayoutError(ValueError):
    """A profile that cannot be used; ``problems`` lists everything found."""

    code = "SCHEMA_INVALID"

    def __init__(self, problems: Iterable[str]):
        self.problems = list(problems)
        super().__init__("; ".join(self.problems))


class QueryError(ValueError):
    """A query that names what is not there or compares what cannot be compared."""

    code = "QUERY_SEMANTIC"


class PatternError(QueryError):
    """A regular expression that cannot be read."""

    code = "QUERY_SYNTAX"


class SourceError(OSError):
    """A file that cannot be read."""

    code = "FILE_UNREADABLE"


class ExportError(OSError):
    """A result that cannot be written."""

    code = "EXPORT_FAILED"


#: Letters of a name that may be wrong, missing or too many for it to be suggested.
NEAR = 3


def nearest(name: str, known: Iterable[str]) -> str | None:
    """The known name that continues ``name`` or begins it, else the one with the fewest wrong letters, if few."""
    wanted = name.lower()
    names = [(k.lower(), k) for k in known]
    for low, k in names:
        if low.startswith(wanted) or wanted.startswith(low):
            return k
    wrong = [(abs(len(low) - len(wanted)) + sum(a != b for a, b in zip(low, wanted, strict=False)), k) for low, k in names]
    least, k = min(wrong, key=lambda x: x[0], default=(NEAR + 1, None))
    return k if least <= NEAR else None


def unknown_column(name: str, known: Iterable[str]) -> QueryError:
    """The error for a wrong column name, with the nearest known one."""
    near = nearest(name, known)
    return QueryError(f"Unknown column {name}" + (f". Did you mean {near}?" if near else ""))
