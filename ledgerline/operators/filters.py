"""Column filters: a small (column, operation, value) form of predicates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from ledgerline.errors import QueryError
from ledgerline.functions.js import js_number
from ledgerline.operators.predicates import Predicate, all_of, field

_TEXT = {"contains": "contains", "startsWith": "startswith", "endsWith": "endswith"}
_ORDER = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
OPERATIONS = (*_TEXT, "equals", "notEquals", *_ORDER, "regex", "empty", "notEmpty")


@dataclass(frozen=True)
class ColumnFilter:
    """A filter box: ``operation`` is one of OPERATIONS; an empty value filters nothing."""

    column: str
    operation: str
    value: str = ""

    def predicate(self) -> Predicate | None:
        f = field(self.column)
        if self.operation not in OPERATIONS:
            raise QueryError(f"unknown filter {self.operation}")
        if self.operation == "empty":
            return f.is_null()
        if self.operation == "notEmpty":
            return f.is_not_null()
        if not self.value:
            return None
        if self.operation in _TEXT:
            return f.same_text(_TEXT[self.operation], self.value)
        if self.operation == "regex":
            return f.matches(self.value, "i")
        if self.operation in ("equals", "notEquals"):
            return f == self.value if self.operation == "equals" else f != self.value
        number = js_number(self.value.replace(",", ".", 1))
        literal = number if abs(number) < float("inf") else self.value
        return f._compare(_ORDER[self.operation], literal)


def combined(filters: Sequence[ColumnFilter]) -> Predicate | None:
    """All filters together; none if no box has a value."""
    return all_of([p for f in filters if (p := f.predicate()) is not None])


def filters_to_sql(filters: Sequence[ColumnFilter]) -> str:
    """The same filters to read, as a statement."""
    found = [p.bracketed() for f in filters if (p := f.predicate()) is not None]
    return "SELECT *" + (f" WHERE {' AND '.join(found)}" if found else "")
