"""Expressions and checks that several of the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# ASCII white space: space and the control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    An expression that a lambda names is computed again for every element; the variable of an
    outer lambda over a one-element array holds the result instead.
    """
    return F.transform(F.array(value), body)[0]


#: Numbers that are summed up one after the other; see ``sums_before``.
BLOCK = 256


def sums_before(sizes: Column) -> Column:
    """For each element the sum of those before it; in blocks, so that long lists take no quadratic time."""
    def running(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def of(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        parts = F.transform(starts, lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))

        def joined(ps: Column) -> Column:
            sums = F.transform(ps, lambda p: F.aggregate(p, F.lit(0), lambda acc, x: acc + x))
            return let(let(sums, running), lambda base: F.flatten(F.transform(
                ps, lambda p, b: let(F.slice(running(p), 1, F.size(p)), lambda inner: F.transform(inner, lambda x: x + F.get(base, b))))))

        return let(parts, joined)

    return let(sizes, of)


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; NULL has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with the frame's own, whatever their case."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
