"""Text rules that flat-file profiles share with ECMAScript: numbers, white space, patterns."""

from __future__ import annotations

import math
import re

#: The characters that ECMAScript trims.
WHITE_SPACE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_IN_CLASS = r"\s\u000b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_DECIMAL = re.compile(r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)")
_RADIX = {"0x": 16, "0o": 8, "0b": 2}
FLAGS = {"i": "iu", "m": "m", "s": "s", "u": ""}


def js_number(value: str | float | None) -> float:
    """A literal as a number: blank text is 0, what is no number is NaN."""
    if value is None:
        return 0.0
    if not isinstance(value, str):
        return float(value)
    text = value.strip(WHITE_SPACE)
    if not text:
        return 0.0
    if text.lstrip("+-") == "Infinity" and len(text) <= 9:
        return -math.inf if text[0] == "-" else math.inf
    if (radix := _RADIX.get(text[:2].lower())) and text[2:].isalnum():
        try:
            return float(int(text[2:], radix))
        except ValueError:
            return math.nan
    return float(text) if _DECIMAL.fullmatch(text) else math.nan


def js_string(value: str | float | None) -> str:
    """A literal as text: whole numbers without a point, null as nothing."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    return str(int(value)) if float(value).is_integer() and abs(value) < 1e21 else repr(float(value))


def like_regex(pattern: str, ignore_case: bool = False) -> str:
    """A Java pattern for LIKE: % is any run, _ any character; there is no escape."""
    parts = {"%": ".*", "_": "."}
    body = "".join(parts.get(c) or (c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):x}}}") for c in pattern)
    return f"(?{'isu' if ignore_case else 's'})\\A{body}\\z"


def java_regex(pattern: str, flags: str = "") -> str:
    """The Java pattern that matches what the ECMAScript one does.

    ``\\s`` takes in Unicode spaces, ``$`` is the very end and ``.`` excludes only line
    ends, unless flags say otherwise; brackets inside a class are literal.
    """
    if unknown := set(flags) - set(FLAGS):
        raise ValueError(f"unknown flags {''.join(sorted(unknown))}")
    out, k, inside = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            pair = pattern[k : k + 2]
            k += 2
            if pair == "\\s":
                out.append(_IN_CLASS if inside else f"[{_IN_CLASS}]")
            elif pair == "\\S" and not inside:
                out.append(f"[^{_IN_CLASS}]")
            else:
                out.append(pair)
            continue
        k += 1
        if inside:
            if c == "]":
                inside = False
            out.append("\\" + c if c in "[&" else c)
        elif pattern.startswith("[^]", k - 1):
            out.append(r"[\s\S]")
            k += 2
        elif c == "[":
            inside = True
            out.append(c)
        elif c == "$" and "m" not in flags:
            out.append(r"\z")
        elif c == "." and "s" not in flags:
            out.append(r"[^\n\r\u2028\u2029]")
        else:
            out.append(c)
    options = "".join(FLAGS[f] for f in dict.fromkeys(flags))
    return (f"(?{options})" if options else "") + "".join(out)
