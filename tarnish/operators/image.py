"""Corruptions of image tables (key, height, width, pixels ARRAY<INT> in 0..255).

Noise, contrast and brightness are column expressions over the pixel array.  The filters
that need a neighbourhood run in Arrow batches; batches follow the table's partitions and
each image is independent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tarnish.functions import pixels as px
from tarnish.functions.rand import Salt, normal
from tarnish.operators.sampling import CAR, Draw, KeyedTable, RowRules, check_fraction
from tarnish.session import ship

EXPRESSIONS = ("gaussian_noise", "contrast", "brightness")


def _byte(x: Column) -> Column:
    """0..1 to a whole number in 0..255."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * F.lit(255.0)).cast("int")


def _unit(x: Column) -> Column:
    return x.cast("double") / F.lit(255.0)


def _expression(kind: str, severity: int, pixels: Column, one: Salt, two: Salt) -> Column:
    if kind == "gaussian_noise":
        sigma = F.lit(px.NOISE_SIGMA[severity - 1])
        return F.transform(pixels, lambda x, i: _byte(_unit(x) + sigma * normal(F.col("_v"), one, two, i)))
    if kind == "brightness":
        return F.transform(pixels, lambda x: _byte(_unit(x) + F.lit(px.BRIGHTNESS[severity - 1])))
    total = F.aggregate(pixels, F.lit(0).cast("bigint"), lambda a, x: a + x)
    mean = total.cast("double") / F.size(pixels) / F.lit(255.0)
    # the mean is bound once per image, not once per pixel
    share = F.lit(px.CONTRAST[severity - 1])
    per_image = F.transform(F.array(mean), lambda m: F.transform(
        pixels, lambda x: _byte((_unit(x) - m) * share + m)))
    return F.element_at(per_image, 1)


def _batches(kinds: tuple[str, ...], severity: int, column: str):
    """mapInPandas function: apply kernels to the marked images of every batch.

    ``_v`` is the hash of an image's key and ``_stream`` the number of its draws.
    """
    import numpy as np

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cells = frame[column].tolist()
            hit = frame["_hit"].to_numpy() & frame[column].notna().to_numpy()
            sizes = list(zip(frame["height"], frame["width"]))
            # images of one size go through a kernel together
            for size in {s for s, h in zip(sizes, hit) if h}:
                at = [i for i, s in enumerate(sizes) if hit[i] and s == size]
                stack = np.stack([np.asarray(cells[i], dtype=float) for i in at]).reshape(-1, *map(int, size))
                rngs = px.generators(frame["_v"].to_numpy()[at], frame["_stream"].to_numpy()[at])
                for kind in kinds:  # every kernel leaves whole bytes to the next
                    stack = (np.clip(px.KERNELS[kind](stack / 255.0, severity, rngs), 0, 1) * 255).astype(np.int32)
                for i, image in zip(at, stack.reshape(len(at), -1)):
                    cells[i] = image
            yield frame.drop(columns=["_hit", "_v", "_stream"]).assign(**{column: cells})

    return apply


@dataclass(frozen=True)
class ImageCorruption:
    """One kernel, or several in a row, on a share of the images chosen by a coin per image."""

    kinds: tuple[str, ...]
    severity: int = 1
    fraction: float = 1.0
    column: str = "pixels"

    def __post_init__(self) -> None:
        check_fraction(self.fraction)
        unknown = [k for k in self.kinds if k not in px.KERNELS]
        if unknown or not self.kinds:
            raise ValueError(f"unknown image corruption {unknown}; choose from {sorted(px.KERNELS)}")
        if self.severity not in range(1, 6):
            raise ValueError("severity must be 1..5")

    # -- what the evaluator asks, as of any corruption --------------------------------

    sampling = CAR
    needs_spread = False
    salts = ("z1", "z2")

    @property
    def by_expression(self) -> bool:
        return all(k in EXPRESSIONS for k in self.kinds)

    def draw(self, seed: str, features: list[str]) -> Draw:
        return Draw(seed, "COIN", self.fraction)

    def bind(self, features: list[str], seed: object) -> "ImageCorruption":
        return self

    def affected(self) -> list[str]:
        return [self.column]

    def types(self, schema: T.StructType) -> dict[str, T.DataType]:
        return {self.column: T.ArrayType(T.IntegerType())}

    def factor(self, seed: str, spread: float | None) -> float | None:
        return None

    def values(self, schema: T.StructType, s: Column) -> dict[str, Column]:
        """New pixels as an expression; nothing for kernels that run in batches."""
        if not self.by_expression:
            return {}
        return {self.column: self._cells(Salt.field(s["n1"]), Salt.field(s["n2"]))}

    def _cells(self, one: Salt, two: Salt) -> Column:
        cells = F.col(self.column)
        for kind in self.kinds:
            cells = _expression(kind, self.severity, cells, one, two)
        return cells

    def in_batches(self, marked: DataFrame, columns: list[str]) -> DataFrame:
        """The given columns, with the kernels applied where ``_hit``; needs ``_v`` and ``_stream``."""
        ready = marked.select(*columns, "_hit", "_v", "_stream")
        out = T.StructType([
            T.StructField(f.name, T.ArrayType(T.IntegerType()) if f.name == self.column else f.dataType)
            for f in ready.schema.fields[:len(columns)]])
        ship(marked.sparkSession)
        return ready.mapInPandas(_batches(self.kinds, self.severity, self.column), out)

    def spec(self) -> dict:
        return {"column": self.column, "fraction": self.fraction, "kinds": "+".join(self.kinds),
                "severity": self.severity}

    def describe(self) -> str:
        return json.dumps({"corruption": "ImageCorruption", "fraction": self.fraction,
                           "kinds": list(self.kinds), "severity": self.severity}, sort_keys=True)

    def transform(self, df: DataFrame, key: list[str], seed: object = 0) -> DataFrame:
        seed = str(seed)
        table = KeyedTable(df, key, seed, rows=0)
        hit = RowRules(table, [Draw(seed, "COIN", self.fraction)]).hit_one()
        marked = table.df.withColumn("_hit", hit)
        if self.by_expression:
            cells = self._cells(*(Salt.of(seed, tag) for tag in self.salts))
            return marked.withColumn(self.column, F.when(F.col("_hit"), cells).otherwise(F.col(self.column))).select(df.columns)
        return self.in_batches(marked.withColumn("_stream", F.lit(Salt.of(seed, "image").a).cast("bigint")), df.columns)


def normalise(df: DataFrame, column: str = "pixels", into: str = "unit_pixels") -> DataFrame:
    """0..255 to 0..1."""
    return df.withColumn(into, F.transform(column, _unit))


def _pick(column: str, size: int, index) -> Column:
    """A size x size array whose cell i is the old cell ``index(i)``, or 0 where that is NULL.

    The old array is bound to a name first, so an expression that made it runs once per
    image and not once per cell.
    """
    cells = F.sequence(F.lit(0), F.lit(size * size - 1))
    return F.element_at(F.transform(F.array(column), lambda old: F.transform(
        cells, lambda i: F.coalesce(F.get(old, index(i)), F.lit(0)))), 1)


def _resized(df: DataFrame, column: str, size: int, index) -> DataFrame:
    old = df.withColumns({"_h": F.col("height"), "_w": F.col("width")})
    new = {column: _pick(column, size, index), "height": F.lit(size), "width": F.lit(size)}
    return old.withColumns(new).drop("_h", "_w")


def pad(df: DataFrame, size: int, column: str = "pixels") -> DataFrame:
    """Centre every image in a black square of the given size."""
    h, w = F.col("_h"), F.col("_w")
    top, left = (F.floor((F.lit(size) - side) / 2).cast("int") for side in (h, w))

    def index(i: Column) -> Column:
        r, c = F.floor(i / size).cast("int") - top, i % size - left
        return F.when((r >= 0) & (r < h) & (c >= 0) & (c < w), r * w + c)

    return _resized(df, column, size, index)


def crop(df: DataFrame, size: int, column: str = "pixels") -> DataFrame:
    """The centre square of the given size."""
    h, w = F.col("_h"), F.col("_w")
    top, left = (F.floor((side - size) / 2).cast("int") for side in (h, w))

    def index(i: Column) -> Column:
        return (F.floor(i / size).cast("int") + top) * w + i % size + left

    return _resized(df, column, size, index)
