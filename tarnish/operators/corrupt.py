"""Tabular and text corruptions.

A corruption is an immutable description.  It says which rows it wants (``draw``), what
the hit rows' cells become (``values``) and which type the cells have afterwards
(``types``).  ``transform`` applies it to one table; the impact evaluator applies hundreds
of them in one job from the same three answers.
"""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tarnish.functions.rand import SALT_TYPE, Salt, normal, row_base, scalar_uniform, uniform
from tarnish.operators.ranks import dense_positions, json_literal
from tarnish.operators.sampling import AR, CAR, Draw, KeyedTable, RowRules, check_fraction, driver_column, mechanism
from tarnish.session import cut_lineage

# The eight letters a wrong encoding breaks, and what they turn into.
BROKEN_FROM = "aAeEoOuU"
BROKEN_TO = "áÁéÉớỚúÚ"

# Factors of a wrong scale.
SCALE_FACTORS = (10, 100, 1000)

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

# Fields every scenario struct carries for the value expressions.
PARAMETER_FIELDS = f"factor:double,n1:{SALT_TYPE},n2:{SALT_TYPE},stream:bigint"


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def numeric_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Column names split into numeric (booleans count as numbers) and the rest."""
    numeric = [f.name for f in df.schema.fields if is_number(f.dataType)]
    return numeric, [c for c in df.columns if c not in numeric]


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type both kinds of cell fit in: equal, numeric widening, else STRING."""
    if a == b:
        return a
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        both_whole = isinstance(a, INTEGRAL) and isinstance(b, INTEGRAL)
        return T.LongType() if both_whole else T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType))
    return T.StringType()


@dataclass(frozen=True)
class Corruption:
    column: str
    fraction: float
    sampling: str = CAR

    # set by subclasses that must know the spread of the column first
    needs_spread = False
    # tags of the two draws behind a normal deviate
    salts = ("n1", "n2")

    def __post_init__(self) -> None:
        check_fraction(self.fraction)
        mechanism(self.sampling)

    # -- what the evaluator and ``transform`` ask -------------------------------------

    def draw(self, seed: str, features: list[str]) -> Draw:
        kind = mechanism(self.sampling)
        order = None
        if kind != CAR and self.fraction < 1.0:
            order = driver_column(features, self.column, seed) if kind == AR else self.column
        return Draw(seed, kind, self.fraction, order)

    def bind(self, features: list[str], seed: object) -> "Corruption":
        """Fill in what the description leaves open; constant over repetitions."""
        return self

    def affected(self) -> list[str]:
        return [self.column]

    def types(self, schema: T.StructType) -> dict[str, T.DataType]:
        return {c: schema[c].dataType for c in self.affected()}

    def factor(self, seed: str, spread: float | None) -> float | None:
        """The number drawn once per application (noise width, scale)."""
        return None

    def values(self, schema: T.StructType, s: Column) -> dict[str, Column]:
        """New cells of a hit row, from its old cells and the scenario struct ``s``."""
        raise NotImplementedError

    def spec(self) -> dict:
        return {k: v for k, v in asdict(self).items() if isinstance(v, (str, int, float, bool, type(None)))}

    def describe(self) -> str:
        """Class name and parameters as JSON."""
        return json.dumps({"corruption": type(self).__name__, **self.spec()}, sort_keys=True)

    # -- one table --------------------------------------------------------------------

    def transform(self, df: DataFrame, key: list[str], seed: object = 0, *,
                  features: list[str] | None = None, hit: str | None = None) -> DataFrame:
        """A corrupted copy of ``df``; ``hit`` names an extra column marking damaged rows.

        ``features`` are the columns that random choices (driver column, swap partner) may
        fall on; by default all but the key.
        """
        features = features or [c for c in df.columns if c not in key]
        bound = self.bind(features, seed)
        absent = [c for c in bound.affected() if c not in df.columns]
        if absent:
            raise ValueError(f"no such column: {', '.join(absent)}")
        return bound._transform(KeyedTable(df, key, seed), str(seed), features, hit)

    def _transform(self, table: KeyedTable, seed: str, features: list[str], hit: str | None) -> DataFrame:
        test, s = self._resolved(table, seed, features)
        return rewrite(self, table.df.withColumn("_hit", test), s, table.source.columns, hit)

    def _resolved(self, table: KeyedTable, seed: str, features: list[str]) -> tuple[Column, Column]:
        """The test that says which rows are hit, and the parameters of one application."""
        rules = RowRules(table, [self.draw(seed, features)])
        spread = None
        if self.needs_spread and rules.rules[0].mode:
            spread = column_spread(table.source, [self.column])[self.column]
        return rules.hit_one(), json_literal(parameters(self, seed, spread), f"struct<{PARAMETER_FIELDS}>")

    def cell(self, table: KeyedTable, seed: str, features: list[str]) -> Column:
        """The damaged version of the column, over the rows of ``table.df``."""
        test, s = self._resolved(table, seed, features)
        schema = table.df.schema
        new, kind = self.values(schema, s)[self.column], self.types(schema)[self.column]
        return F.when(test, new.cast(kind)).otherwise(F.col(self.column).cast(kind))


def parameters(c: Corruption, seed: str, spread: float | None) -> dict:
    return {"factor": c.factor(seed, spread), "stream": Salt.of(seed, "image").a,
            **{name: Salt.of(seed, tag).record() for name, tag in zip(("n1", "n2"), c.salts)}}


def column_spread(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Population standard deviation of each column, missing cells left out."""
    if not columns:
        return {}
    clean = [F.stddev_pop(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c)
             for c in columns]
    return df.agg(*clean).first().asDict()


def rewrite(c: Corruption, marked: DataFrame, s: Column, columns: list[str], hit: str | None) -> DataFrame:
    """Replace the affected cells where ``_hit``; all new cells read the old row."""
    schema = marked.schema
    new, kinds = c.values(schema, s), c.types(schema)
    out = [
        F.when(F.col("_hit"), new[n].cast(kinds[n])).otherwise(F.col(n).cast(kinds[n])).alias(n)
        if n in new else F.col(n) for n in columns
    ]
    return marked.select(*out, *([F.col("_hit").alias(hit)] if hit else []))


@dataclass(frozen=True)
class MissingValues(Corruption):
    """Replace cells by a missing marker: NULL, or a sentinel such as -999 or ''.

    A sentinel of another type than the column is refused unless ``widen`` is set, which
    turns the column into STRING.
    """

    na_value: object = None
    widen: bool = False

    def types(self, schema: T.StructType) -> dict[str, T.DataType]:
        kind, na = schema[self.column].dataType, self.na_value
        if na is None or isinstance(na, float) and math.isnan(na):
            return {self.column: kind}
        if isinstance(kind, T.NumericType) and isinstance(na, (int, float)) and not isinstance(na, bool):
            whole = float(na).is_integer()
            return {self.column: kind if whole or not isinstance(kind, INTEGRAL) else T.DoubleType()}
        if isinstance(kind, T.StringType) and isinstance(na, str):
            return {self.column: kind}
        if isinstance(kind, T.BooleanType) and isinstance(na, bool):
            return {self.column: kind}
        if self.widen:
            return {self.column: T.StringType()}
        raise ValueError(f"sentinel {na!r} does not fit column {self.column!r} "
                         f"of type {kind.simpleString()}; set widen=True to get STRING")

    def values(self, schema: T.StructType, s: Column) -> dict[str, Column]:
        na = self.na_value
        if isinstance(na, float) and math.isnan(na):
            na = None
        return {self.column: F.lit(na).cast(self.types(schema)[self.column])}


@dataclass(frozen=True)
class MissingByConfidence(MissingValues):
    """Missing cells in the rows a scorer is most, or least, sure about.

    ``predict_on`` may hold another version of the rows to score, matched by key.  With
    ``compat`` the affected share is ``1 - fraction`` and the flag picks the other side.
    """

    most_confident: bool = True
    compat: bool = False
    scorer: object = field(default=None, compare=False)
    predict_on: object = field(default=None, compare=False)
    lane: str = field(default="_confidence", compare=False)  # the column that ranks the rows

    def draw(self, seed: str, features: list[str]) -> Draw:
        return Draw(seed, "RANKS", self.fraction, self.lane, span=self.span)

    def span(self, n: int) -> tuple[int, int]:
        """First position and number of positions by ascending confidence."""
        if not self.compat:
            k = math.floor(n * self.fraction)
            return (n - k, k) if self.most_confident else (0, k)
        k = math.floor(n * (1 - self.fraction))
        if self.most_confident:
            return 0, k
        return (n - k, k) if k else (0, n)

    def spec(self) -> dict:
        return {k: getattr(self, k) for k in ("column", "fraction", "na_value", "most_confident", "compat")}

    def _transform(self, table: KeyedTable, seed: str, features: list[str], hit: str | None) -> DataFrame:
        if self.scorer is None:
            raise ValueError("a scorer is needed to rank rows by confidence")
        df, key = table.source, table.key
        if self.predict_on is None:
            scored = self.scorer.score(df, "_score").withColumn(self.lane, self.scorer.confidence("_score")).drop("_score")
        else:
            scored = join_confidence(df, self.scorer, self.predict_on, key, self.lane)
        keyed = KeyedTable(scored, key, seed)
        out = MissingValues._transform(self, keyed, seed, features, hit)
        return out.select(*df.columns, *([hit] if hit else []))


def join_confidence(df: DataFrame, scorer: object, predict_on: DataFrame, key: list[str], into: str) -> DataFrame:
    """How sure the scorer is of the row with the same key in ``predict_on``; one it lacks fails the job."""
    ranked = scorer.score(predict_on, "_score")
    ranked = ranked.select(*key, scorer.confidence("_score").alias(into), F.lit(True).alias("_known"))
    absent = F.raise_error(F.lit("predict_on lacks a row of the table")).cast("double")
    return df.join(ranked, key, "left").withColumn(into, F.when(F.col("_known"), F.col(into)).otherwise(absent)).drop("_known")


@dataclass(frozen=True)
class SwappedValues(Corruption):
    """Exchange the cells of two columns; the partner is drawn once when not given.

    Columns of different types meet in a type that holds both (numbers widen, anything
    else becomes STRING).
    """

    swap_with: str | None = None

    def bind(self, features: list[str], seed: object) -> "SwappedValues":
        if self.swap_with:
            return self
        others = [c for c in features if c != self.column]
        if not others:
            raise ValueError("swapping needs a second feature column")
        return replace(self, swap_with=min(others, key=lambda c: (scalar_uniform(seed, "swap", c), c)))

    def affected(self) -> list[str]:
        return [self.column, self.swap_with]

    def types(self, schema: T.StructType) -> dict[str, T.DataType]:
        kind = wider(schema[self.column].dataType, schema[self.swap_with].dataType)
        return {self.column: kind, self.swap_with: kind}

    def values(self, schema: T.StructType, s: Column) -> dict[str, Column]:
        return {self.column: F.col(self.swap_with), self.swap_with: F.col(self.column)}


@dataclass(frozen=True)
class CategoricalShift(Corruption):
    """Permute the categories: each observed value is replaced by another one's name.

    The permutation is over the values of the whole column and may leave some in place;
    ``derange`` moves every value.  A numeric column is returned unchanged.
    """

    derange: bool = False

    def values(self, schema: T.StructType, s: Column) -> dict[str, Column]:
        if is_number(schema[self.column].dataType):
            return {}
        return {self.column: F.coalesce(F.col("_target"), F.col(self.column))}

    def _transform(self, table: KeyedTable, seed: str, features: list[str], hit: str | None) -> DataFrame:
        df, column = table.source, self.column
        if is_number(df.schema[column].dataType):
            warnings.warn(f"{column!r} is not categorical; table left unchanged", stacklevel=2)
            out = df
            return out.withColumn(hit, F.lit(False)) if hit else out
        rules = RowRules(table, [self.draw(seed, features)])
        s = json_literal(parameters(self, seed, None), f"struct<{PARAMETER_FIELDS}>")
        marked = table.df.withColumn("_hit", rules.hit_one())
        pairs = permutations(df, column, [(0, seed, self.derange)]).select(
            F.col("value").alias("_value"), F.col("target").alias("_target"))
        joined = with_target(marked, pairs, F.when(F.col("_hit"), F.col(column)), F.col("_k"))
        return rewrite(self, joined, s, df.columns, hit)


# Text of a permutation that may be broadcast, in bytes; larger ones are joined with salted keys.
BROADCAST_BYTES = 8 << 20
SALTS = 16


def with_target(rows: DataFrame, pairs: DataFrame, wanted: Column, spread: Column,
                on: list[tuple[Column, str]] = ()) -> DataFrame:
    """Add ``_target``, the partner of each wanted category; rows that want none keep their place.

    The pairs are broadcast when their exact size is within a bound.  Otherwise every pair is
    copied once per salt, so a hot category is spread over that many tasks, and rows that
    want no partner get keys of their own.
    """
    pairs = cut_lineage(pairs)
    size = F.sum(F.octet_length("_value") + F.octet_length("_target") + 32)
    small = (pairs.agg(size).first()[0] or 0) <= BROADCAST_BYTES
    rows = rows.withColumn("_wanted", wanted)
    same = [mine == F.col(theirs) for mine, theirs in on]
    if small:
        return rows.join(F.broadcast(pairs), _all([F.col("_wanted") == F.col("_value"), *same]), "left").drop("_wanted", "_value")
    lane = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    copies = pairs.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    apart = rows.withColumns({"_lane": F.when(F.col("_wanted").isNull(), -1 - F.abs(F.hash(spread).cast("bigint"))).otherwise(lane),
                              "_wanted": F.coalesce("_wanted", F.lit(""))})
    joined = apart.join(copies, _all([F.col("_wanted") == F.col("_value"), F.col("_lane") == F.col("_salt"), *same]), "left")
    return joined.drop("_wanted", "_value", "_lane", "_salt")


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def permutations(df: DataFrame, column: str, seeds: list[tuple[int, str, bool]]) -> DataFrame:
    """(id, value, target): one random permutation of the column's values per seed.

    Two independent random orders of the distinct values are paired by position, so a
    column with very many values is permuted without a global sort.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("_n")).drop("_n")
    d = values.count()
    items = [{"id": i, "f": Salt.of(seed, "from").record(), "t": Salt.of(seed, "to").record(),
              "shift": int(derange)} for i, seed, derange in seeds]
    s = json_literal(items, f"array<struct<id:int,f:{SALT_TYPE},t:{SALT_TYPE},shift:int>>")
    drawn = (
        values.withColumn("_base", row_base(F.col("value").cast("string")))
        .withColumn("s", F.explode(s))
        .select(F.col("s.id").alias("id"), "value", F.col("s.shift").alias("shift"),
                uniform(F.col("_base"), Salt.field(F.col("s.f"))).alias("f"),
                uniform(F.col("_base"), Salt.field(F.col("s.t"))).alias("t"))
    )
    here = dense_positions(drawn, "f", "value", d, by=("id",), into="p")
    # a derangement moves everyone one place on in the same order
    order = F.when(F.col("shift") == 1, F.col("f")).otherwise(F.col("t"))
    there = dense_positions(drawn.withColumn("g", order), "g", "value", d, by=("id",), into="q")
    there = there.withColumn("p", F.when(F.col("shift") == 1, F.pmod(F.col("q") - 1 + F.lit(d), F.lit(d)))
                             .otherwise(F.col("q")))
    return here.select("id", "p", "value").join(
        there.select("id", "p", F.col("value").alias("target")), ["id", "p"]).select("id", "value", "target")


@dataclass(frozen=True)
class GaussianNoise(Corruption):
    """Add N(0, (w * std)^2) with one w ~ U(1, 5) per application; the column turns DOUBLE."""

    needs_spread = True

    def types(self, schema: T.StructType) -> dict[str, T.DataType]:
        return {self.column: T.DoubleType()}

    def factor(self, seed: str, spread: float | None) -> float | None:
        return None if spread is None else (1 + 4 * scalar_uniform(seed, "scale")) * spread

    def values(self, schema: T.StructType, s: Column) -> dict[str, Column]:
        noise = normal(F.col("_v"), Salt.field(s["n1"]), Salt.field(s["n2"])) * s["factor"]
        return {self.column: F.col(self.column).cast("double") + noise}


@dataclass(frozen=True)
class Scaling(Corruption):
    """Multiply by 10, 100 or 1000, one factor per application.

    A whole number that no longer fits BIGINT becomes NULL instead of failing the job;
    smaller integer types are widened to BIGINT first.
    """

    def types(self, schema: T.StructType) -> dict[str, T.DataType]:
        kind = schema[self.column].dataType
        return {self.column: T.LongType() if isinstance(kind, INTEGRAL) else T.DoubleType()}

    def factor(self, seed: str, spread: float | None) -> float:
        return float(SCALE_FACTORS[math.floor(3 * scalar_uniform(seed, "factor"))])

    def values(self, schema: T.StructType, s: Column) -> dict[str, Column]:
        kind = self.types(schema)[self.column]
        return {self.column: F.try_multiply(F.col(self.column).cast(kind), s["factor"].cast(kind))}


@dataclass(frozen=True)
class BrokenCharacters(Corruption):
    """Text read with the wrong encoding: an independent coin decides each row.

    Needs no row count, so it also runs on a streaming DataFrame.  Missing text stays missing.
    """

    def draw(self, seed: str, features: list[str]) -> Draw:
        return Draw(seed, "COIN", self.fraction)

    def spec(self) -> dict:
        return {"column": self.column, "fraction": self.fraction}

    def types(self, schema: T.StructType) -> dict[str, T.DataType]:
        return {self.column: T.StringType()}

    def values(self, schema: T.StructType, s: Column) -> dict[str, Column]:
        return {self.column: F.translate(F.col(self.column).cast("string"), BROKEN_FROM, BROKEN_TO)}


@dataclass(frozen=True)
class CustomCorruption:
    """A user's own corruption: any function from DataFrame to DataFrame.

    In an evaluation it gets the whole test table and must keep its rows, key and label.
    """

    name: str
    function: Callable[..., DataFrame]
    options: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, key: list[str] | None = None, seed: object = 0, **_: object) -> DataFrame:
        return self.function(df, **self.options)

    def describe(self) -> str:
        return json.dumps({"corruption": self.name, **self.options}, sort_keys=True, default=str)
