"""Layout profiles: how the bytes of a record become columns."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from ledgerline.errors import LayoutError, unknown_column
from ledgerline.functions.js import java_regex

ENCODINGS = ("utf8", "latin1", "ascii")
LINE_ENDINGS = ("auto", "lf", "crlf", "none")
MODES = ("fixed", "split", "match")
TYPES = ("string", "number", "decimal")
TRIMS = ("none", "left", "right", "both")
SIGNS = ("none", "leading", "trailing")
DEFAULT_PATTERN = r"\s{2,}"


@dataclass(frozen=True)
class ColumnDef:
    """A column: a byte range in fixed mode, the next field in the other modes.

    ``trim`` left out means none in fixed mode and both in the others; ``signed`` left
    out allows a sign on either side.
    """

    name: str
    start: int = 0
    length: int = 0
    type: str = "string"
    trim: str | None = None
    scale: int = 0
    signed: str | None = None

    @property
    def numeric(self) -> bool:
        return self.type != "string"


@dataclass(frozen=True)
class Profile:
    """Encoding, framing and columns of a flat file."""

    columns: tuple[ColumnDef, ...] = ()
    mode: str = "fixed"
    pattern: str = DEFAULT_PATTERN
    encoding: str = "latin1"
    line_ending: str = "auto"
    record_length: int = 0
    skip_records: int = 0
    version: int = field(default=1)

    @classmethod
    def default(cls) -> Profile:
        """What is assumed of an unknown file: fields apart by runs of white space."""
        return cls(mode="split")

    @classmethod
    def fixed(cls, *columns: ColumnDef, **options) -> Profile:
        return cls(columns=columns, mode="fixed", **options).checked()

    @classmethod
    def from_widths(cls, widths: Sequence[int], names: Sequence[str] | None = None, **options) -> Profile:
        return cls.fixed(*columns_from_widths(widths, names), **options)

    def column(self, name: str) -> tuple[int, ColumnDef]:
        """(position, definition) by name, in any case."""
        for k, c in enumerate(self.columns):
            if c.name.casefold() == name.casefold():
                return k, c
        raise unknown_column(name, (c.name for c in self.columns))

    @property
    def record_width(self) -> int:
        """Bytes of a record: as declared, or up to the last column's end."""
        return self.record_length or max((c.start + c.length for c in self.columns), default=0)

    def problems(self) -> list[str]:
        """Everything that keeps this profile from being used. Overlaps and gaps are fine."""
        found = []
        for value, allowed, what in (
            (self.encoding, ENCODINGS, "encoding"),
            (self.line_ending, LINE_ENDINGS, "line ending"),
            (self.mode, MODES, "mode"),
        ):
            if value not in allowed:
                found.append(f"unknown {what} {value!r}")
        if self.line_ending == "none" and self.record_length <= 0:
            found.append("records without a terminator need a record length above 0")
        if self.mode == "fixed" and not self.columns:
            found.append("a fixed layout needs at least one column")
        if self.mode in ("split", "match"):
            try:
                groups = re.compile(java_regex(self.pattern)).groups
            except (re.error, ValueError) as why:
                found.append(f"invalid pattern: {why}")
            else:
                if self.mode == "split" and groups:
                    found.append("a separator pattern must not have capturing groups; write (?:...)")
        seen = set()
        for c in self.columns:
            if c.name.casefold() in seen:
                found.append(f"column {c.name} is defined twice")
            seen.add(c.name.casefold())
            if not c.name:
                found.append("a column needs a name")
            if self.mode == "fixed" and c.length <= 0:
                found.append(f"column {c.name} needs a length above 0")
            if self.mode == "fixed" and c.start < 0:
                found.append(f"column {c.name} starts before the record")
            for value, allowed, what in ((c.type, TYPES, "type"), (c.trim, (None, *TRIMS), "trim"), (c.signed, (None, *SIGNS), "sign")):
                if value not in allowed:
                    found.append(f"column {c.name} has an unknown {what} {value!r}")
        return found

    def checked(self) -> Profile:
        if found := self.problems():
            raise LayoutError(found)
        return self

    def with_columns(self, *columns: ColumnDef) -> Profile:
        return replace(self, columns=columns)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, ensure_ascii=False) + "\n"

    @classmethod
    def from_json(cls, text: str) -> Profile:
        data = json.loads(text)
        columns = tuple(ColumnDef(**c) for c in data.pop("columns", ()))
        return cls(columns=columns, **data).checked()

    def save(self, path: str | Path) -> None:
        Path(path).write_text(self.to_json(), encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path) -> Profile:
        return cls.from_json(Path(path).read_text(encoding="utf-8"))


#: What a data file's name is followed by in that of the profile beside it.
BESIDE = ".layout.json"


def beside(path: str | Sequence[str]) -> Profile | None:
    """The profile saved beside a local file, if there is one and it can be used; a warning if it cannot."""
    if not isinstance(path, str) or "://" in path:
        return None
    found = Path(path.removeprefix("file:") + BESIDE)
    if not found.is_file():
        return None
    try:
        return Profile.load(found)
    except (ValueError, TypeError, OSError) as why:
        warnings.warn(f"the profile {found} is ignored: {why}", stacklevel=3)
        return None


def columns_from_widths(widths: Sequence[int], names: Sequence[str] | None = None) -> list[ColumnDef]:
    """Adjacent columns; widths of 0 or less are skipped but keep their number in names."""
    out, start = [], 0
    for k, width in enumerate(widths):
        if width > 0:
            name = names[k] if names and k < len(names) else f"col{k + 1}"
            out.append(ColumnDef(name, start, width))
            start += width
    return out


def widths_from_cuts(cuts: Iterable[int], width: int) -> list[int]:
    """Widths between cut positions inside a record of ``width`` bytes."""
    inside = sorted({c for c in cuts if 0 < c < width})
    edges = [0, *inside, width]
    return [b - a for a, b in zip(edges, edges[1:], strict=False)]


def infer_columns(sample: Iterable[str], pattern: str = DEFAULT_PATTERN, mode: str = "split") -> tuple[ColumnDef, ...]:
    """``col1..n`` for the most fields that a sample record has; none for a bad pattern."""
    try:
        compiled = re.compile(java_regex(pattern))
    except (re.error, ValueError):
        return ()
    fields = lambda line: len(compiled.split(line)) if mode == "split" else compiled.groups
    most = max((fields(line) for line in sample), default=0)
    return tuple(ColumnDef(f"col{k + 1}", trim="both") for k in range(most))
