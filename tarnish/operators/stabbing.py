"""Which of many windows hold a value: a segment tree kept in two literals.

The ends of all windows cut the order into elementary intervals.  A window is noted at the
few tree nodes that together cover its intervals, so n windows take n log n notes; a value
finds its interval by binary search and reads the notes on the way from there to the root.
The work per value is log n plus the windows found, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tarnish.operators.ranks import json_literal

PAIR = "struct<u:double,k:string>"


def _sort_key(end: dict, side: int) -> tuple:
    """The order of (missing last, value), draw, key, side; a NULL key comes before all others."""
    o, t = end["o"], end["t"]
    return (o["z"], 0 if o["v"] is None else o["v"], t["u"], t["k"] is not None, t["k"] or "", side)


class StabbingIndex:
    """Windows (id, lo, hi) with both ends inside; an end is {o: {z, v}, t: {u, k}}."""

    def __init__(self, windows: list[tuple[int, dict, dict]], kind: str):
        self.kind = kind
        ends = {_sort_key(end, side): end | {"s": side} for _, lo, hi in windows for side, end in enumerate((lo, hi))}
        order = sorted(ends)
        self.cuts = [ends[k] for k in order]
        at = {k: i for i, k in enumerate(order)}
        self.size = 1 << len(self.cuts).bit_length()  # intervals 0 .. len(cuts)
        self.notes: list[list[int]] = [[] for _ in range(2 * self.size)]
        for i, lo, hi in windows:
            self._note(i, at[_sort_key(lo, 0)] + 1 + self.size, at[_sort_key(hi, 1)] + 1 + self.size)

    def _note(self, i: int, first: int, stop: int) -> None:
        while first < stop:
            if first & 1:
                self.notes[first].append(i)
                first += 1
            if stop & 1:
                stop -= 1
                self.notes[stop].append(i)
            first, stop = first >> 1, stop >> 1

    def interval(self, here: Column) -> Column:
        """How many cuts lie at or before ``here``; the cut after an end lies beyond the end itself."""
        cuts = json_literal(self.cuts, f"array<struct<o:{self.kind},t:{PAIR},s:int>>")
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(self.cuts).bit_length()))])
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(cuts, n + step - 1) <= here, n + step).otherwise(n))

    def found(self, o: Column, t: Column) -> Column:
        """The ids of all windows that hold the value."""
        notes = json_literal(self.notes, "array<array<int>>")
        levels = F.array(*[F.lit(d) for d in range(self.size.bit_length())])
        # the variables of the outer lambdas hold what would be computed again for every step and level
        here = F.array(F.struct(o.alias("o"), t.alias("t"), F.lit(0).alias("s")))
        leaf = F.transform(here, lambda x: self.interval(x) + self.size)
        return F.flatten(F.flatten(F.transform(leaf, lambda n: F.transform(
            levels, lambda d: F.get(notes, F.call_function("shiftright", n, d))))))
