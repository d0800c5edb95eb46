"""Predicates on flat records, as Spark conditions that are never null.

``field("AMOUNT") > 5`` and the methods of :class:`Field` make predicates; ``&``, ``|``
and ``~`` combine them. Logic is two-valued: what is no number fails every numeric
comparison, and ``~`` then holds. A comparison is numeric if the column or the literal
is; else it compares trimmed text by code point.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.errors import PatternError, QueryError
from ledgerline.functions.cells import Cells
from ledgerline.functions.js import java_regex, js_number, js_string, like_regex

Literal = str | int | float | None
_OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


@dataclass(frozen=True)
class Predicate:
    """A condition: how to build it over cells, its relative cost, how it reads as SQL, the
    columns that it names, and a text that every record that satisfies it must hold."""

    build: Callable[[Cells], Column]
    cost: int
    sql: str
    columns: tuple[str, ...]
    needle: Callable[[Cells], str | None] = lambda cells: None
    parts: tuple[Predicate, ...] = ()

    def __and__(self, other: Predicate) -> Predicate:
        """Both, the cheaper first: predicates are total, so their order is free."""
        parts = sorted([p for x in (self, other) for p in (x.parts or (x,))], key=lambda p: p.cost)

        def build(cells: Cells) -> Column:
            first, *rest = (p.build(cells) for p in parts)
            for p in rest:
                first = first & p
            return first

        def needle(cells: Cells) -> str | None:
            # either will do: the longest one skips most
            return max((n for p in parts if (n := p.needle(cells))), key=len, default=None)

        return Predicate(build, sum(p.cost for p in parts), " AND ".join(p.bracketed() for p in parts), _merged(parts), needle, tuple(parts))

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate(lambda c: self.build(c) | other.build(c), self.cost + other.cost, f"({self.sql}) OR ({other.sql})", _merged((self, other)))

    def __invert__(self) -> Predicate:
        return Predicate(lambda c: ~self.build(c), self.cost + 1, f"NOT ({self.sql})", self.columns)

    def __bool__(self) -> bool:
        raise QueryError("combine predicates with &, | and ~")

    def bracketed(self) -> str:
        return f"({self.sql})" if " OR " in self.sql else self.sql


def _merged(parts: Sequence[Predicate]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(c for p in parts for c in p.columns))


def _quoted(value: Literal) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else js_string(value)


def _is_number(value: Literal) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


def _checked(value: Literal) -> Literal:
    if value is not None and not isinstance(value, str) and not _is_number(value):
        raise QueryError("a column is compared with text, a number or None")
    return value


class Field:
    """A named column of a layout."""

    def __init__(self, name: str):
        self.name = name

    @property
    def _sql(self) -> str:
        return self.name if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", self.name) else f'"{self.name}"'

    def _numeric(self, cells: Cells) -> bool:
        return cells.profile.column(self.name)[1].numeric

    def _number(self, cells: Cells) -> Column:
        return cells.number(self.name, as_declared=self._numeric(cells))

    def _told(self, build: Callable[[Cells], Column], cost: int, sql: str, needle: Callable[[Cells], str | None] = lambda cells: None) -> Predicate:
        return Predicate(build, cost, f"{self._sql} {sql}", (self.name,), needle)

    def _compare(self, op: str, value: Literal) -> Predicate:
        value = _checked(value)

        def build(cells: Cells) -> Column:
            if _is_number(value) or self._numeric(cells):
                number = js_number(value)
                if math.isnan(number):
                    raise QueryError(f"{self.name} is numeric and {value!r} is no number")
                return F.coalesce(_OPERATORS[op](self._number(cells), F.lit(number)), F.lit(False))
            if op in ("=", "<>"):
                same = cells.same_text(self.name, js_string(value))
                return same if op == "=" else ~same
            return _OPERATORS[op](cells.text(self.name), F.lit(js_string(value)))

        def needle(cells: Cells) -> str | None:
            return value if op == "=" and isinstance(value, str) and not self._numeric(cells) else None

        return self._told(build, 1 if op == "=" else 2, f"{op} {_quoted(value)}", needle)

    def __eq__(self, value: Literal) -> Predicate:  # type: ignore[override]
        return self._compare("=", value)

    def __ne__(self, value: Literal) -> Predicate:  # type: ignore[override]
        return self._compare("<>", value)

    def __lt__(self, value: Literal) -> Predicate:
        return self._compare("<", value)

    def __le__(self, value: Literal) -> Predicate:
        return self._compare("<=", value)

    def __gt__(self, value: Literal) -> Predicate:
        return self._compare(">", value)

    def __ge__(self, value: Literal) -> Predicate:
        return self._compare(">=", value)

    __hash__ = None  # type: ignore[assignment]

    def like(self, pattern: str) -> Predicate:
        """% and _ wildcards over the whole text, case-sensitive, without an escape."""
        literal = max(re.split("[%_]", pattern), key=len) or None
        cost = 20 if pattern.rstrip("%").count("%") == 0 else 40
        return self._told(lambda c: c.text(self.name).rlike(like_regex(pattern)), cost, f"LIKE {_quoted(pattern)}", lambda cells: literal)

    def ilike(self, pattern: str) -> Predicate:
        """LIKE that ignores case, beyond ASCII too."""
        return self._told(lambda c: c.text(self.name).rlike(like_regex(pattern, True)), 40, f"ILIKE {_quoted(pattern)}")

    def matches(self, pattern: str, flags: str = "") -> Predicate:
        """A regular expression somewhere in the text; flags are of i, m, s, u."""
        try:
            java = java_regex(pattern, flags)
            re.compile(pattern)
        except (re.error, ValueError) as why:
            raise PatternError(f"invalid pattern /{pattern}/{flags}: {why}") from why
        return self._told(lambda c: c.text(self.name).rlike(java), 100, f"MATCHES /{pattern}/{flags}")

    def isin(self, *values: Literal) -> Predicate:
        """One of the values; numeric if the column or every value is.

        On a numeric column a value that is no number stands for cells that are none, and
        such cells satisfy the negation of any other list.
        """
        if not values:
            raise QueryError("a list needs at least one value")
        values = tuple(map(_checked, values))

        def build(cells: Cells) -> Column:
            if self._numeric(cells) or all(map(_is_number, values)):
                numbers = [js_number(v) for v in values]
                real = [n for n in numbers if not math.isnan(n)]
                v = self._number(cells)
                found = v.isin(real) if real else F.when(v.isNotNull(), F.lit(False))
                return F.coalesce(found, F.lit(len(real) < len(numbers)))
            return cells.text(self.name).isin([js_string(v) for v in values])

        return self._told(build, 2 + len(values), f"IN ({', '.join(map(_quoted, values))})")

    def _between(self, low: Literal, high: Literal, negated: bool) -> Predicate:
        low, high = _checked(low), _checked(high)

        def build(cells: Cells) -> Column:
            if self._numeric(cells) or (_is_number(low) and _is_number(high)):
                a, b, v = js_number(low), js_number(high), self._number(cells)
                if math.isnan(a) or math.isnan(b):
                    return v.isNotNull() if negated else F.lit(False)
                inside = v.between(F.lit(a), F.lit(b))
                return F.coalesce(~inside if negated else inside, F.lit(False))
            inside = cells.text(self.name).between(F.lit(js_string(low)), F.lit(js_string(high)))
            return ~inside if negated else inside

        return self._told(build, 4, f"{'NOT ' * negated}BETWEEN {_quoted(low)} AND {_quoted(high)}")

    def between(self, low: Literal, high: Literal) -> Predicate:
        """Within bounds, both included; cells that are no number are neither in nor out."""
        return self._between(low, high, False)

    def not_between(self, low: Literal, high: Literal) -> Predicate:
        """Outside the bounds; unlike ``~between`` it fails for cells that are no number."""
        return self._between(low, high, True)

    def is_null(self) -> Predicate:
        """The cell is blank."""
        return self._told(lambda c: c.blank(self.name), 2, "IS NULL")

    def is_not_null(self) -> Predicate:
        return self._told(lambda c: ~c.blank(self.name), 2, "IS NOT NULL")

    def same_text(self, how: str, value: str) -> Predicate:
        """contains, startswith or endswith of literal text, ignoring case."""
        body = "".join(c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):x}}}" for c in value)
        pattern = {"contains": body, "startswith": rf"\A{body}", "endswith": rf"{body}\z"}[how]
        shown = {"contains": f"%{value}%", "startswith": f"{value}%", "endswith": f"%{value}"}[how]
        return self._told(lambda c: c.text(self.name).rlike(f"(?isu){pattern}"), 40, f"ILIKE {_quoted(shown)}")


def field(name: str) -> Field:
    return Field(name)


def all_of(predicates: Sequence[Predicate]) -> Predicate | None:
    """The conjunction, or none for no predicates."""
    out = None
    for p in predicates:
        out = p if out is None else out & p
    return out
