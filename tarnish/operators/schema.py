"""Table profile, inferred schema and validation.

A schema is one small expectation per column.  Checking a table is one aggregate of
per-row flags (missing, outside the domain, outside the range) over all columns, so a
validation never shuffles the table, and the flags of damaged rows can be added to and
subtracted from the clean table's counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from tarnish.functions.rand import micros
from tarnish.operators.clean import present_text, unpivot_text
from tarnish.operators.corrupt import INTEGRAL
from tarnish.operators.distinct import capped_sets, heads
from tarnish.operators.ranks import literal_rows, positions

# Default of ``max_domain``: a string column with more distinct values has no closed domain.
MAX_DOMAIN = 100

ANOMALY_CODES = ("MISSING_COLUMN", "NEW_COLUMN", "TYPE_MISMATCH", "PRESENCE_BELOW_MIN",
                 "OUT_OF_DOMAIN", "OUT_OF_RANGE")


def type_class(kind: T.DataType) -> str:
    """INT, FLOAT, STRING, BOOLEAN, .. : widths of one class are the same to a schema."""
    if isinstance(kind, INTEGRAL):
        return "INT"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "FLOAT"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "TIME"
    return kind.typeName().upper()


def missing(kind: T.DataType, col: Column) -> Column:
    """NULL, or NaN in a floating column."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


QUARTERS = (0.25, 0.5, 0.75)


def exact_quartiles(df: DataFrame, columns: list[str]) -> dict[str, list[float | None]]:
    """Quartiles of numeric columns as values that occur; three scans for all of them."""
    parts = [F.count_if(~missing(df.schema[c].dataType, F.col(c))).alias(f"n{i}") for i, c in enumerate(columns)]
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *parts).first()
    ranks = {c: [max(0, math.ceil(q * counts[f"n{i}"]) - 1) for q in QUARTERS] for i, c in enumerate(columns) if counts[f"n{i}"]}
    found = positions(df, ranks)
    return {c: [float(found[c][r]["v"]) for r in ranks[c]] if c in ranks else [None] * len(QUARTERS) for c in columns}


def profile(df: DataFrame, columns: list[str] | None = None, accuracy: int = 10_000, exact: bool = True) -> DataFrame:
    """One row of statistics per column.

    Numbers: count, missing, zeros, min, max, mean, standard deviation, quartiles.  Dates and
    timestamps: min and max in seconds since 1970, distinct values and the commonest.  Strings:
    distinct values, commonest value and its count, shortest, longest and mean length.  The
    numeric side is one aggregate without any shuffle of rows; the string side shuffles
    128-bit hashes of the values, whatever their length.  Quartiles come from two more scans
    for all columns, or, without ``exact``, from a sketch of this ``accuracy``.
    """
    columns = columns or df.columns
    fields = {c: df.schema[c].dataType for c in columns}
    numbers = [c for c in columns if type_class(fields[c]) in ("INT", "FLOAT")]
    quartiles = exact_quartiles(df, numbers) if exact else {}
    strings = [c for c in columns if type_class(fields[c]) in ("STRING", "BOOLEAN")]
    times = [c for c in columns if type_class(fields[c]) == "TIME"]
    parts: list[Column] = []
    for i, c in enumerate(columns):
        gone = missing(fields[c], F.col(c))
        parts += [F.count_if(~gone).alias(f"n{i}"), F.count_if(gone).alias(f"m{i}")]
        if c in numbers:
            x = F.when(~gone, F.col(c).cast("double"))
            parts += [F.count_if(x == 0).alias(f"z{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                      F.avg(x).alias(f"avg{i}"), F.stddev_pop(x).alias(f"sd{i}"),
                      *([] if exact else [F.percentile_approx(x, list(QUARTERS), accuracy).alias(f"q{i}")])]
        elif c in times:
            at = micros(c, fields[c]) / F.lit(1e6)
            parts += [F.min(at).alias(f"lo{i}"), F.max(at).alias(f"hi{i}")]
        elif c in strings:
            size = F.length(F.col(c).cast("string"))
            parts += [F.min(size).alias(f"lmin{i}"), F.max(size).alias(f"lmax{i}"), F.avg(size).alias(f"lavg{i}")]
    double, whole = F.lit(None).cast("double"), F.lit(None).cast("bigint")

    def cell(i: int, name: str, none: Column, c: str, group: list[str]) -> Column:
        return F.col(f"{name}{i}") if c in group else none

    def quartile(i: int, c: str, j: int) -> Column:
        if c not in numbers:
            return double
        return F.lit(quartiles[c][j]).cast("double") if exact else F.col(f"q{i}")[j]

    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(type_class(fields[c])).alias("type"),
            F.col(f"n{i}").alias("present"), F.col(f"m{i}").alias("missing"),
            cell(i, "z", whole, c, numbers).alias("zeros"),
            cell(i, "lo", double, c, numbers + times).alias("min"), cell(i, "hi", double, c, numbers + times).alias("max"),
            cell(i, "avg", double, c, numbers).alias("mean"), cell(i, "sd", double, c, numbers).alias("std"),
            *[quartile(i, c, j).alias(f"q{p}") for j, p in enumerate((25, 50, 75))],
            cell(i, "lmin", whole, c, strings).cast("bigint").alias("min_length"),
            cell(i, "lmax", whole, c, strings).cast("bigint").alias("max_length"),
            cell(i, "lavg", double, c, strings).alias("mean_length"),
        ) for i, c in enumerate(columns)])
    scalars = df.agg(*parts).select(F.explode(rows).alias("r")).select("r.*")
    if not strings + times:
        return scalars.withColumns({"distinct": whole, "top_value": F.lit(None).cast("string"), "top_count": whole})
    texts = {c: present_text(df, c) for c in strings + times}
    return scalars.join(heads(df, texts), "column", "left")


def value_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for all given columns in one shuffle; NULL is left out."""
    return (
        unpivot_text(df, columns).where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )


@dataclass(frozen=True)
class Expectation:
    column: str
    type: str
    min_fraction: float = 0.0
    domain: tuple[str, ...] | None = None
    min_domain_mass: float = 1.0
    min: float | None = None
    max: float | None = None
    note: str | None = None


@dataclass(frozen=True)
class Schema:
    """Expectations of a table; ``relax`` edits one of them."""

    expectations: tuple[Expectation, ...] = field(default=())

    def __getitem__(self, column: str) -> Expectation:
        return {e.column: e for e in self.expectations}[column]

    def __contains__(self, column: str) -> bool:
        return any(e.column == column for e in self.expectations)

    def relax(self, column: str, **changes: object) -> "Schema":
        if column not in self:
            raise KeyError(column)
        return Schema(tuple(replace(e, **changes) if e.column == column else e for e in self.expectations))

    def to_df(self, spark: SparkSession) -> DataFrame:
        ddl = ("column string, type string, min_fraction double, domain array<string>, "
               "min_domain_mass double, min double, max double, note string")
        return spark.createDataFrame(
            [Row(e.column, e.type, e.min_fraction, list(e.domain) if e.domain is not None else None,
                 e.min_domain_mass, e.min, e.max, e.note) for e in self.expectations], ddl)


def infer_schema(df: DataFrame, columns: list[str] | None = None, max_domain: int = MAX_DOMAIN) -> Schema:
    """Type, required presence and, for strings with few values, the closed domain.

    ``max_domain`` is the largest number of distinct values a closed domain may have, counted
    exactly; a string column beyond it has none, and its ``note`` says so.
    """
    columns = columns or df.columns
    fields = {c: df.schema[c].dataType for c in columns}
    strings = [c for c in columns if type_class(fields[c]) == "STRING"]
    row = df.agg(*[F.count_if(missing(fields[c], F.col(c))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    sets = capped_sets(df, strings, max_domain)
    domains = {c: tuple(sorted(v)) for c, v in sets.items() if v}
    return Schema(tuple(
        Expectation(c, type_class(fields[c]), 1.0 if row[f"m{i}"] == 0 else 0.0, domains.get(c),
                    note=f"no domain: over {max_domain} values" if c in sets and sets[c] is None else None)
        for i, c in enumerate(columns)))


def outside_domain(e: Expectation, col: Column) -> Column:
    return F.coalesce(~col.cast("string").isin(*e.domain), F.lit(False)) if e.domain is not None else F.lit(False)


def outside_range(e: Expectation, col: Column) -> Column:
    test = F.lit(False)
    if e.min is not None:
        test = test | (col.cast("double") < F.lit(float(e.min)))
    if e.max is not None:
        test = test | (col.cast("double") > F.lit(float(e.max)))
    return F.coalesce(test, F.lit(False))


def cell_flags(e: Expectation, kind: T.DataType, col: Column) -> dict[str, Column]:
    """The three per-cell tests of an expectation."""
    return {"gone": missing(kind, col), "odd": outside_domain(e, col), "far": outside_range(e, col)}


def anomaly_array(e: Expectation, rows: Column, gone: Column, odd: Column, far: Column,
                  same_type: Column | bool = True) -> Column:
    """ARRAY of (column, code, observed, expected) for one column's counts."""
    present = F.when(rows > 0, (rows - gone) / rows.cast("double")).otherwise(F.lit(1.0))
    filled = rows - gone
    inside = F.when(filled > 0, (filled - odd) / filled.cast("double")).otherwise(F.lit(1.0))
    kinds = same_type if isinstance(same_type, Column) else F.lit(same_type)

    def item(code: str, observed: Column, expected: float) -> Column:
        return F.struct(F.lit(e.column).alias("column"), F.lit(code).alias("code"),
                        observed.cast("double").alias("observed"), F.lit(float(expected)).alias("expected"))

    found = [
        F.when(~kinds, item("TYPE_MISMATCH", F.lit(0.0), 1.0)),
        F.when(present < F.lit(float(e.min_fraction)), item("PRESENCE_BELOW_MIN", present, e.min_fraction)),
    ]
    if e.domain is not None:
        found.append(F.when(inside < F.lit(float(e.min_domain_mass)), item("OUT_OF_DOMAIN", inside, e.min_domain_mass)))
    if e.min is not None or e.max is not None:
        found.append(F.when(far > 0, item("OUT_OF_RANGE", far, 0.0)))
    return F.array_compact(F.array(*found))


ANOMALY_DDL = "column string, code string, observed double, expected double"


def validate(df: DataFrame, schema: Schema) -> DataFrame:
    """Anomalies of a table: (column, code, observed, expected), empty when it conforms."""
    known = [e for e in schema.expectations if e.column in df.columns]
    static = [(e.column, "MISSING_COLUMN", 0.0, 1.0) for e in schema.expectations if e.column not in df.columns]
    static += [(c, "NEW_COLUMN", 1.0, 0.0) for c in df.columns if c not in schema]
    names = [part.split()[0] for part in ANOMALY_DDL.split(", ")]
    fixed = literal_rows(df.sparkSession, [dict(zip(names, cells)) for cells in static], ANOMALY_DDL)
    if not known:
        return fixed
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, e in enumerate(known):
        flags = cell_flags(e, df.schema[e.column].dataType, F.col(e.column))
        parts += [F.count_if(flag).alias(f"{name}{i}") for name, flag in flags.items()]
    arrays = [
        anomaly_array(e, F.col("rows"), F.col(f"gone{i}"), F.col(f"odd{i}"), F.col(f"far{i}"),
                      type_class(df.schema[e.column].dataType) == e.type)
        for i, e in enumerate(known)]
    found = df.agg(*parts).select(F.explode(F.flatten(F.array(*arrays))).alias("a")).select("a.*")
    return found.unionByName(fixed) if static else found


def has_anomaly(anomalies: DataFrame) -> bool:
    return not anomalies.isEmpty()
