"""Which rows get damaged: completely at random, at random, not at random, coin, all."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from tarnish.functions.rand import (
    SALT_TYPE, Salt, key_string, row_base, scalar_uniform, uniform,
)
from tarnish.operators.ranks import dense_positions, draw_bounds, json_literal, order_struct, positions
from tarnish.operators.stabbing import PAIR, StabbingIndex
from tarnish.session import inherited

# Accepted mechanism names; the M names are synonyms.
CAR, AR, NAR = "CAR", "AR", "NAR"
MECHANISMS = {"CAR": CAR, "MCAR": CAR, "AR": AR, "MAR": AR, "NAR": NAR, "MNAR": NAR}

NONE, ALL, DRAW, WINDOW = 0, 1, 2, 3


@dataclass(frozen=True)
class Draw:
    """A request for rows.

    ``kind`` is a mechanism, ``COIN`` (independent coin per row) or ``RANKS`` (positions
    ``first`` .. ``first + count - 1`` in the order of column ``order``, where both numbers
    come from ``span(n)``).  ``order`` is the damaged column for NAR and the driver column
    for AR.
    """

    seed: str
    kind: str
    fraction: float
    order: str | None = None
    span: object = None


@dataclass(frozen=True)
class Rule:
    """A resolved request: a constant-sized description a row can be tested against."""

    mode: int
    order: int = -1
    salt: Salt | None = None
    bound: dict | None = None
    lo: dict | None = None
    hi: dict | None = None


def check_fraction(fraction: float) -> float:
    if not 0.0 <= fraction <= 1.0:
        raise ValueError(f"fraction must lie in 0..1, got {fraction}")
    return float(fraction)


def mechanism(name: str) -> str:
    if name not in MECHANISMS:
        raise ValueError(f"sampling mechanism {name!r} is not one of {sorted(MECHANISMS)}")
    return MECHANISMS[name]


def driver_column(features: list[str], column: str, seed: object) -> str:
    """The other column that row selection at random depends on."""
    others = [c for c in features if c != column]
    if not others:
        raise ValueError("sampling at random needs a second feature column")
    return min(others, key=lambda c: (scalar_uniform(seed, "dep", c), c))


class KeyedTable:
    """A table with its row key, the per-row hash of that key and its size.

    Adds ``_k`` (key text) and ``_v`` (60 hash bits); every draw that follows is plain
    integer arithmetic on ``_v``.
    """

    def __init__(self, df: DataFrame, key: list[str], seed: object, rows: int | None = None):
        missing = [c for c in key if c not in df.columns]
        if missing or not key:
            raise ValueError(f"key columns missing: {missing or 'none given'}")
        self.source, self.key, self.seed, self._rows = df, list(key), seed, rows
        stored = "_k" in df.columns and "_v" in df.columns  # a checkpointed task carries them
        self.df = df if stored else df.withColumn("_k", key_string(df, self.key)).withColumn(
            "_v", row_base(F.col("_k")))
        self.tie = Salt.of(seed, "tie")

    @cached_property
    def rows(self) -> int:
        return self.source.count() if self._rows is None else self._rows

    def order(self, column: str) -> Column:
        return order_struct(self.df, column)

    def order_type(self, column: str) -> str:
        return self.df.select(self.order(column)).schema[0].dataType.simpleString()


class RowRules:
    """Rules for a list of requests over one table, found in a few scans for all of them."""

    def __init__(self, table: KeyedTable, draws: list[Draw]):
        self.table = table
        self.columns: list[str] = []  # columns that some rule orders by
        self.rules: list[Rule | None] = [None] * len(draws)
        self._by_draw: list[tuple[int, str, int]] = []
        self._by_rank: dict[str, list[tuple[int, int, int]]] = {}
        for i, d in enumerate(draws):
            self._classify(i, d)
        self._resolve()

    def _classify(self, i: int, d: Draw) -> None:
        fraction = check_fraction(d.fraction)
        if d.kind == "COIN":
            self.rules[i] = Rule(DRAW, salt=Salt.of(d.seed, "coin"), bound={"u": fraction, "k": None})
            return
        if d.kind != "RANKS" and fraction == 1.0:
            self.rules[i] = Rule(ALL)
            return
        n = self.table.rows
        if d.kind == "RANKS":
            first, k = d.span(n)
        else:
            k = math.floor(n * fraction)
            first = math.floor(scalar_uniform(d.seed, "start") * (n - k))
        if k == 0:
            self.rules[i] = Rule(NONE)
        elif k == n:
            self.rules[i] = Rule(ALL)
        elif d.kind == CAR:
            self._by_draw.append((i, d.seed, k))
        else:
            self._by_rank.setdefault(d.order, []).append((i, first, first + k - 1))

    def _resolve(self) -> None:
        """Find all bounds: two scans for the ranks of all columns, one for all draws, then one for all ties."""
        if not self._by_draw and not self._by_rank:
            return
        table, n = self.table, self.table.rows
        self.columns = list(self._by_rank)
        data, plain = table.df, table.source
        with ThreadPoolExecutor(max_workers=2) as pool:
            ranked = pool.submit(inherited(positions), plain, {c: [r for s in spans for r in s[1:]] for c, spans in self._by_rank.items()})
            drawn = pool.submit(inherited(draw_bounds), data.select("_k", "_v"), [
                {"salt": Salt.of(seed, "row"), "need": k, "rows": n} for _, seed, k in self._by_draw])
            for (i, seed, _), bound in zip(self._by_draw, drawn.result()):
                self.rules[i] = Rule(DRAW, salt=Salt.of(seed, "row"), bound=bound)
            self._windows(ranked.result(), data)

    def _windows(self, at: dict[str, dict[int, dict]], data: DataFrame) -> None:
        """First and last (value, tie draw, key) of each span; draws only where ties are cut."""
        cut: dict[str, list[tuple[dict, int, int]]] = {}
        for j, (column, spans) in enumerate(self._by_rank.items()):
            for i, first, last in spans:
                lo, hi = at[column][first], at[column][last]
                lo_end = {"o": {"z": lo["z"], "v": lo["v"]}, "t": {"u": -1.0, "k": None}}
                hi_end = {"o": {"z": hi["z"], "v": hi["v"]}, "t": {"u": 2.0, "k": None}}
                if first > lo["below"]:
                    cut.setdefault(column, []).append((lo_end, first - lo["below"] + 1, lo["ties"]))
                if last < hi["below"] + hi["ties"] - 1:
                    cut.setdefault(column, []).append((hi_end, last - hi["below"] + 1, hi["ties"]))
                self.rules[i] = Rule(WINDOW, order=j, lo=lo_end, hi=hi_end)

        def settle(column: str) -> None:
            bounds = draw_bounds(
                data.select("_k", "_v", self.table.order(column).alias("o")),
                [{"salt": self.table.tie, "need": need, "rows": ties, "o": end["o"]} for end, need, ties in cut[column]],
                self.table.order_type(column))
            for (end, _, _), bound in zip(cut[column], bounds):
                end["t"] = bound

        with ThreadPoolExecutor(max_workers=8) as pool:
            list(pool.map(inherited(settle), cut))

    def paired(self, rows: DataFrame, into: str, only: set[int]) -> DataFrame:
        """Each row of the table once for every rule of ``only`` that hits it; ``into`` is the rule's number.

        A row looks up the windows that hold it and is copied for these alone.  Draws are
        independent, so each has to be made; that happens in generated code, on the way.
        """
        chosen = [(i, self.rules[i]) for i in sorted(only)]
        free = [i for i, r in chosen if r.mode in (ALL, DRAW)]
        parts = [F.array(*[F.lit(i) for i in free]).cast("array<int>")]
        tie = F.struct(uniform(F.col("_v"), self.table.tie).alias("u"), F.col("_k").alias("k"))
        for j, column in enumerate(self.columns):
            windows = [(i, r.lo, r.hi) for i, r in chosen if r.mode == WINDOW and r.order == j]
            if windows:
                index = StabbingIndex(windows, self.table.order_type(column))
                parts.append(index.found(self.table.order(column), tie))
        # the list is a column of its own, so that what follows the copying is generated code; without
        # the outer form the optimizer would compute it a second time, to drop empty ones
        out = rows.withColumn("_list", F.concat(*parts)).withColumn(into, F.explode_outer("_list")).drop("_list")
        out = out.where(F.col(into).isNotNull())
        if not any(r.mode == DRAW for _, r in chosen):
            return out
        records: list[dict | None] = [None] * len(self.rules)
        for i, r in chosen:
            if r.mode == DRAW:
                records[i] = {"salt": r.salt.record(), "bound": r.bound}
        draw = F.get(json_literal(records, f"array<struct<salt:{SALT_TYPE},bound:{PAIR}>>"), F.col(into))
        u = uniform(F.col("_v"), Salt.field(draw["salt"]))
        bound = draw["bound"]
        inside = (u <= bound["u"]) & ((u < bound["u"]) | (F.col("_k") <= bound["k"]))
        return out.where(draw.isNull() | F.coalesce(inside, F.lit(False)))

    def hit_one(self, i: int = 0) -> Column:
        """The test for one known rule.

        Written so that the row hash appears once: a filter on the result may be pushed
        below the projection that computes the hash, which copies the hash to every place
        that mentions it.  Hash and key are not computed at all where the value decides.
        """
        rule = self.rules[i]
        if rule.mode in (NONE, ALL):
            return F.lit(rule.mode == ALL)
        if rule.mode == DRAW:
            return _within(rule.salt, None, rule.bound)
        o = self.table.order(self.columns[rule.order])
        kind = self.table.order_type(self.columns[rule.order])
        lo, hi = (json_literal(end["o"], kind) for end in (rule.lo, rule.hi))
        low, high = (None if end["t"]["k"] is None else end["t"] for end in (rule.lo, rule.hi))
        inside = (o >= lo) & (o <= hi)
        if low is not None:
            inside = inside & ((o > lo) | _within(self.table.tie, low, None))
        if high is not None:
            inside = inside & ((o < hi) | _within(self.table.tie, None, high))
        return inside


def _within(salt: Salt, low: dict | None, high: dict | None) -> Column:
    """low <= (draw, key) <= high, with the draw bound to one name."""
    def test(u: Column) -> Column:
        checks = []
        if low is not None:
            edge = F.lit(low["u"])
            checks.append((u > edge) | ((u == edge) & (F.col("_k") >= F.lit(low["k"]))))
        if high is not None:
            edge = F.lit(high["u"])
            same = F.lit(False) if high["k"] is None else (u == edge) & (F.col("_k") <= F.lit(high["k"]))
            checks.append((u < edge) | same)
        return checks[0] if len(checks) == 1 else checks[0] & checks[1]

    return F.exists(F.array(F.col("_v")), lambda v: F.exists(F.array(uniform(v, salt)), test))


def mark(table: KeyedTable, draw: Draw, into: str = "_hit") -> DataFrame:
    """The table with a boolean column that says which rows are hit."""
    rules = RowRules(table, [draw])
    return table.df.withColumn(into, rules.hit_one())


def sample_rows(df: DataFrame, key: list[str], fraction: float, sampling: str = CAR, *,
                column: str | None = None, depends_on: str | None = None,
                features: list[str] | None = None, seed: object = 0, into: str = "hit") -> DataFrame:
    """Mark the rows a corruption of ``column`` would damage.

    ``CAR``: exactly floor(n * fraction) rows at random.  ``NAR``: a contiguous run of that
    many rows in the order of ``column``.  ``AR``: such a run in the order of another column
    (``depends_on``, or one drawn from ``features``).
    """
    kind = mechanism(sampling)
    order = column
    if kind == AR:
        features = features or [c for c in df.columns if c not in key]
        order = depends_on or driver_column(features, column, seed)
    if kind == NAR and column is None:
        raise ValueError("sampling not at random needs the damaged column")
    draw = Draw(str(seed), kind, fraction, order if kind != CAR else None)
    return mark(KeyedTable(df, key, seed), draw, into).drop("_k", "_v")


def coin(df: DataFrame, key: list[str], fraction: float, seed: object = 0, into: str = "hit") -> DataFrame:
    """An independent coin per row: a narrow map that also runs on a stream."""
    table = KeyedTable(df, key, seed, rows=0)
    return mark(table, Draw(str(seed), "COIN", fraction), into).drop("_k", "_v")


def bootstrap(df: DataFrame, key: list[str], m: int, seed: object = 0) -> DataFrame:
    """``m`` rows drawn with replacement, numbered by ``draw``."""
    table = KeyedTable(df, key, seed)
    n = table.rows
    if n == 0:
        raise ValueError("cannot sample from an empty table")
    ranked = dense_positions(
        table.df.withColumn("_u", uniform(F.col("_v"), Salt.of(seed, "position"))),
        "_u", "_k", n, into="_position",
    )
    draws = df.sparkSession.range(m).withColumnRenamed("id", "draw")
    base = row_base(F.col("draw").cast("string"))
    draws = draws.withColumn("_position", F.floor(uniform(base, Salt.of(seed, "boot")) * n).cast("bigint"))
    return draws.join(ranked, "_position").select("draw", *df.columns)


def random_split(df: DataFrame, key: list[str], test_size: float, seed: object = 0,
                 into: str = "is_test") -> DataFrame:
    """Mark exactly floor(n * test_size) rows as test rows."""
    return sample_rows(df, key, test_size, CAR, seed=f"{seed}/split", into=into)
