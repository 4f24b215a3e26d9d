"""Imputation and repair: fit on training data, apply as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tarnish.session import cut_lineage


def _present(df: DataFrame, column: str) -> Column:
    col = F.col(column)
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return F.nanvl(col, F.lit(None).cast(df.schema[column].dataType))
    return col


@dataclass(frozen=True)
class Imputer:
    """Fill missing cells of each column with one value."""

    fills: dict[str, object]

    @property
    def columns(self) -> list[str]:
        return list(self.fills)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.coalesce(_present(df, c).cast("double"), F.lit(v)) if isinstance(v, float)
            else F.coalesce(_present(df, c), F.lit(v).cast(df.schema[c].dataType))
            for c, v in self.fills.items() if v is not None
        })


def fit_mean(df: DataFrame, columns: list[str]) -> Imputer:
    """Mean of every column in one aggregate."""
    row = df.agg(*[F.avg(_present(df, c).cast("double")).alias(c) for c in columns]).first()
    return Imputer(row.asDict())


def fit_mode(df: DataFrame, columns: list[str]) -> Imputer:
    """Most frequent value of every column, the smallest one when several tie.

    All columns are counted in one shuffle of (column, value) pairs; a hot value is folded
    before the shuffle and a column with many values is spread over many tasks.
    """
    stacked = unpivot_text(df, columns).where(F.col("value").isNotNull())
    counts = stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    fills: dict[str, object] = {c: None for c in columns}
    for kind in sorted({df.schema[c].dataType.simpleString() for c in columns}):
        of_kind = [c for c in columns if df.schema[c].dataType.simpleString() == kind]
        best = F.min(F.struct(-F.col("n"), F.col("value").cast(kind).alias("value")))
        for r in (counts.where(F.col("column").isin(of_kind)).groupBy("column")
                  .agg(best.alias("best")).collect()):
            fills[r["column"]] = r["best"]["value"]
    return Imputer(fills)


def present_text(df: DataFrame, column: str) -> Column:
    """A cell as text; NaN is missing."""
    return _present(df, column).cast("string")


def unpivot_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) with one row per cell, values as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), present_text(df, c).alias("value"))
                      for c in columns])
    return df.select(F.explode(cells).alias("c")).select("c.column", "c.value")


def fill_constant(values: dict[str, object]) -> Imputer:
    return Imputer(dict(values))


def repair_sentinel(df: DataFrame, column: str, broken: Column, value: object) -> DataFrame:
    """Replace the cells that match a predicate, for example a negative age."""
    return df.withColumn(column, F.when(broken, F.lit(value)).otherwise(F.col(column)))


# Bytes of a table of modes that may be broadcast whole; combinations of over a HEAVY_SHARE-th of the
# training rows (and HEAVY_LEAST at least) are broadcast in any case; salts of the others.
BROADCAST_BYTES = 8 << 20
HEAVY_SHARE, HEAVY_LEAST = 2000, 64
SALTS = 16


@dataclass(frozen=True)
class ConditionalMode:
    """Fill a missing cell with the commonest value among rows that agree on other columns.

    Combinations never seen in training fall back to the overall mode.  Rows whose target is
    present take no part in a join.  A table of modes beyond the broadcast bound is split: its
    fewer than 2,000 heaviest combinations are broadcast, the others are shuffled, each copied
    per salt, so that no combination is one task's work, be it frequent in training or not.
    """

    target: str
    inputs: list[str]
    table: DataFrame = field(compare=False)
    fallback: object = None
    whole: bool = True
    heavy_rows: int = 0

    @property
    def columns(self) -> list[str]:
        return [self.target]

    def _known(self, table: DataFrame, tag: str) -> DataFrame:
        return table.select(*[F.col(c).alias(f"{tag}{i}") for i, c in enumerate(self.inputs)], F.col("_mode").alias(f"{tag}mode"), F.lit(True).alias(f"{tag}met"))

    def _joined(self, rows: DataFrame, known: DataFrame, tag: str, *more: Column) -> DataFrame:
        match = [F.col(c).eqNullSafe(F.col(f"{tag}{i}")) for i, c in enumerate(self.inputs)]
        return rows.join(known, reduce(and_, [*more, *match]), "left")

    def transform(self, df: DataFrame) -> DataFrame:
        present, tag = _present(df, self.target), "_m_"
        while any(c.lower().startswith(tag) for c in df.columns):
            tag = f"_{tag}"
        near_tag, far_tag, lane, salt = f"{tag}near_", f"{tag}far_", f"{tag}lane", f"{tag}salt"

        def filled(rows: DataFrame, mode: str) -> DataFrame:
            value = F.coalesce(present, F.col(mode), F.lit(self.fallback))
            return rows.select(*[value.alias(c) if c == self.target else F.col(c) for c in df.columns])

        if self.whole:
            return filled(self._joined(df, F.broadcast(self._known(self.table, near_tag)), near_tag, present.isNull()), f"{near_tag}mode")
        heavy = F.col("_n") > self.heavy_rows
        near = self._joined(df, F.broadcast(self._known(self.table.where(heavy), near_tag)), near_tag, present.isNull())
        settled = present.isNotNull() | F.col(f"{near_tag}met").isNotNull()
        rest = near.where(~settled).withColumn(lane, F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SALTS)).cast("int"))
        light = self._known(self.table.where(~heavy), far_tag).withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        # a compressed file looks small beside the copies made of it, so the choice is not left to its size
        far = self._joined(rest, light.hint("merge"), far_tag, F.col(lane) == F.col(salt))
        return filled(near.where(settled), f"{near_tag}mode").unionByName(filled(far, f"{far_tag}mode"))


def fit_conditional_mode(df: DataFrame, target: str, inputs: list[str], broadcast_bytes: int = BROADCAST_BYTES) -> ConditionalMode:
    """Count (inputs, target) pairs, then keep the largest count and smallest value per inputs."""
    counts = (
        df.where(_present(df, target).isNotNull()).groupBy(*inputs, target).agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.struct(-F.col("n"), F.col(target).alias("value")))
    table = cut_lineage(counts.groupBy(*inputs).agg(best.alias("_best"), F.sum("n").alias("_n")).select(
        *inputs, F.col("_best.value").alias("_mode"), "_n"))
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in [*inputs, "_mode"]), F.lit(0))
    rows, bytes_ = table.agg(F.sum("_n"), F.sum(size)).first()
    return ConditionalMode(target, list(inputs), table, fit_mode(df, [target]).fills[target], (bytes_ or 0) <= broadcast_bytes,
                           max(HEAVY_LEAST, (rows or 0) // HEAVY_SHARE))
