"""Fixed-width cells and predicates row by row in plain Python, to compare Spark with."""

import re

from ledgerline.operators.predicates import field

BLANKS = " \t\0"
_NUMBER = re.compile(r"([+-]?)([0-9]*)([.,]?)([0-9]*)([+-]?)")


def number(text, scale=0, signed=None):
    m = _NUMBER.fullmatch(text.strip(BLANKS))
    if not m or not (m[2] or m[4]) or (m[5] and signed not in (None, "trailing")):
        return None
    value = float(f"{m[2] or 0}.{m[4] or 0}")
    if scale and not m[3]:
        value /= 10**scale
    return -value if "-" in (m[1], m[5]) else value


def cells(record, profile):
    """{name: (text, number)} of a record of one byte per character."""
    raw = {c.name: (record[c.start : c.start + c.length], c) for c in profile.columns}
    return {n: (t.strip(BLANKS), number(t, c.scale, c.signed) if c.numeric else number(t)) for n, (t, c) in raw.items()}


def _leaf(rng):
    kind = rng.randrange(7)
    value = rng.choice([0, 5, 123.45, -3, 100])
    text = rng.choice(["OPEN", "SHUT", "C1", "", "é"])
    name = rng.choice(["CODE", "STATUS"])
    if kind == 0:
        op = rng.choice(["__gt__", "__le__", "__eq__", "__ne__"])
        return getattr(field("AMOUNT"), op)(value), lambda c: c["AMOUNT"][1] is not None and getattr(c["AMOUNT"][1], op)(float(value))
    if kind == 1:
        op = rng.choice(["__gt__", "__le__", "__eq__", "__ne__"])
        return getattr(field(name), op)(text), lambda c: getattr(c[name][0], op)(text)
    if kind == 2:
        low, high, negated = value - 50, value + 50, rng.random() < 0.5
        predicate = field("AMOUNT").not_between(low, high) if negated else field("AMOUNT").between(low, high)
        return predicate, lambda c: c["AMOUNT"][1] is not None and (low <= c["AMOUNT"][1] <= high) != negated
    if kind == 3:
        return field(name).isin(text, "open"), lambda c: c[name][0] in (text, "open")
    if kind == 4:
        return field("AMOUNT").isin(value, 0.5), lambda c: c["AMOUNT"][1] in (float(value), 0.5)
    if kind == 5:
        return field(name).is_null(), lambda c: not c[name][0]
    start = rng.choice(["C", "o", "é"])
    return field(name).ilike(f"{start}%"), lambda c: c[name][0].lower().startswith(start.lower())


def random_predicate(rng, depth=2):
    """(predicate, the same on oracle cells)."""
    if depth == 0 or rng.random() < 0.3:
        return _leaf(rng)
    a, fa = random_predicate(rng, depth - 1)
    if rng.random() < 0.25:
        return ~a, lambda c: not fa(c)
    b, fb = random_predicate(rng, depth - 1)
    if rng.random() < 0.5:
        return a & b, lambda c: fa(c) and fb(c)
    return a | b, lambda c: fa(c) or fb(c)
