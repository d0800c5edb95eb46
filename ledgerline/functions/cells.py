"""The text, number and blankness of each column of a record, as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.js import WHITE_SPACE, java_regex
from ledgerline.profile import ColumnDef, Profile

#: Blanks of fixed layouts.
BLANKS = " \t\0"
_TRIM = {"left": F.ltrim, "right": F.rtrim, "both": F.btrim}
_JS_DECIMAL = r"\A[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?)\z"


def decode(raw: Column, encoding: str) -> Column:
    """Bytes as text; malformed UTF-8 becomes U+FFFD, and a leading BOM is dropped."""
    if encoding != "utf8":
        return F.decode(raw, "ISO-8859-1")
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), r"\A\x{FEFF}", "")


def trimmed(text: Column, how: str, characters: str) -> Column:
    return text if how == "none" else _TRIM[how](text, F.lit(characters))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used.

    Written out, the uses of a number's text make methods of the generated code that are
    too long for the JVM to compile, and slow by a factor of ten.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fixed_number(text: Column, scale: int = 0, signed: str | None = None) -> Column:
    """A fixed-width amount, null where it is none.

    A sign may lead, and trail unless ``signed`` says leading or none; then digits with
    at most one point or comma. Without a point the scale divides. Whole numbers, and
    numbers with a point, are read by casts; patterns judge only what those refuse.
    """
    unit = F.lit(float(10**scale))

    def read(spaced: Column, body: Column) -> Column:
        # digits and signs at both ends: nothing that a cast would trim or read otherwise
        plain = F.ascii(spaced).between(43, 57) & F.ascii(F.substring(body, -1, 1)).between(43, 57) & ~F.contains(body, F.lit(",")) & (F.lower(body) == F.upper(body))
        quick = F.abs(F.when(plain, body.try_cast("double")))  # a cast to a whole number throws for each point
        if scale:
            quick = F.when(F.contains(body, F.lit(".")), quick).otherwise(quick / unit)
        size = F.coalesce(quick, _odd_number(spaced, scale, signed))
        return size * F.when(F.contains(spaced, F.lit("-")), -1.0).otherwise(1.0)

    def unsigned(spaced: Column) -> Column:
        if signed not in (None, "trailing"):
            return spaced
        return F.when(F.substring(spaced, -1, 1).isin("+", "-"), F.substring(spaced, 1, F.length(spaced) - 1)).otherwise(spaced)

    return let(F.trim(text), lambda spaced: F.when(spaced != "", let(unsigned(spaced), lambda body: read(spaced, body))))


def _odd_number(text: Column, scale: int, signed: str | None) -> Column:
    """The size of any amount, by patterns."""
    trail = "[+-]?" if signed in (None, "trailing") else ""

    def read(s: Column) -> Column:
        valid = s.rlike(rf"\A[+-]?(?=[0-9.,]*[0-9])[0-9]*[.,]?[0-9]*{trail}\z")
        digits = F.replace(F.regexp_replace(s, "[+-]", ""), F.lit(","), F.lit(".")).try_cast("double")
        value = F.when(s.rlike("[.,]"), digits).otherwise(digits / F.lit(float(10**scale))) if scale else digits
        return F.when(valid, value)

    return let(F.btrim(text, F.lit(BLANKS)), read)


def field_number(text: Column) -> Column:
    """A number of a separated field, null where it is none; a first comma is a point."""

    def read(s: Column) -> Column:
        # digits, a point and a sign need no pattern
        plain = F.ascii(s).between(43, 57) & F.ascii(F.substring(s, -1, 1)).between(43, 57) & ~F.contains(s, F.lit(",")) & (F.lower(s) == F.upper(s))
        value = F.coalesce(F.when(plain, s.try_cast("double")), let(F.regexp_replace(s, r"\A([^,]*),", "$1."), odd))
        return F.when(F.abs(value) < F.lit(float("inf")), value)

    def odd(s: Column) -> Column:
        radix = (F.when(s.rlike(rf"\A(?i:{p})[{d}]+\z"), F.conv(F.substring(s, 3, 1000), b, 10).cast("double")) for p, d, b in (("0x", "0-9a-fA-F", 16), ("0o", "0-7", 8), ("0b", "01", 2)))
        return F.coalesce(F.when(s.rlike(_JS_DECIMAL), s.try_cast("double")), *radix)

    return let(F.btrim(text, F.lit(WHITE_SPACE)), lambda s: F.when(s != "", read(s)))


class Cells:
    """Column expressions of one profile over a binary payload column."""

    def __init__(self, profile: Profile, payload: Column):
        self.profile = profile
        self._payload = payload

    def raw(self) -> Column:
        """The whole record as text."""
        return decode(self._payload, self.profile.encoding)

    def _slice(self, c: ColumnDef) -> Column:
        return F.substring(self._payload, c.start + 1, c.length)

    def _field(self, k: int, c: ColumnDef) -> Column:
        """Untrimmed text; fields that a record lacks are empty."""
        p = self.profile
        if p.mode == "fixed":
            return decode(self._slice(c), p.encoding)
        if p.mode == "split":
            return F.coalesce(F.get(F.split(self.raw(), java_regex(p.pattern), -1), F.lit(k)), F.lit(""))
        return F.regexp_extract(self.raw(), java_regex(p.pattern), k + 1)

    @property
    def _blanks(self) -> str:
        return BLANKS if self.profile.mode == "fixed" else WHITE_SPACE

    def text(self, name: str) -> Column:
        """What is shown and exported: trimmed text, never null."""
        k, c = self.profile.column(name)
        return trimmed(self._field(k, c), c.trim or ("none" if self.profile.mode == "fixed" else "both"), self._blanks)

    def number(self, name: str, as_declared: bool = True) -> Column:
        """The value as a double, null where there is none.

        A text column compared with a number has no declared scale or sign.
        """
        k, c = self.profile.column(name)
        if self.profile.mode != "fixed":
            return field_number(self._field(k, c))
        # numbers are ASCII, so single-byte encodings need no decoding
        text = self._field(k, c) if self.profile.encoding == "utf8" else self._slice(c).cast("string")
        return fixed_number(text, c.scale, c.signed) if as_declared else fixed_number(text)

    def same_text(self, name: str, text: str) -> Column:
        """Whether the shown text is this one; single-byte encodings compare bytes."""
        _, c = self.profile.column(name)
        if self.profile.mode != "fixed" or self.profile.encoding == "utf8":
            return self.text(name) == F.lit(text)
        try:
            wanted = F.lit(text.encode("latin-1"))
        except UnicodeEncodeError:
            return F.lit(False)
        how = c.trim or "none"
        return (self._slice(c) if how == "none" else _TRIM[how](self._slice(c), F.lit(BLANKS.encode()))) == wanted

    def blank(self, name: str) -> Column:
        k, c = self.profile.column(name)
        return F.length(F.btrim(self._field(k, c), F.lit(self._blanks))) == 0
