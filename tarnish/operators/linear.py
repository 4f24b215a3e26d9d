"""Least squares with an L2 penalty from sums that add up over folds.

One scan sums, for each fold, the products of all pairs of columns: the numbers and flags of
their missing cells, a column per category, the label and 1.  A fold's training rows are all
rows without its own, so their sums are a difference; filling gaps with a training mean or
mode, scaling and encoding are linear in these columns, so every fold and penalty is a small
linear system, and its squared error on the held-out rows a quadratic form.  No vector of
features is ever stored or cached.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tarnish.operators.clean import Imputer
from tarnish.operators.scoring import ChainedScorer, LinearScorer
from tarnish.session import ship

#: Columns of the sums, at most; their number of pairs goes to the driver.
MAX_WIDTH = 512
#: Rows that are spread out at once.
ROWS = 4096
SUMS_DDL = "fold int, i int, j int, v double"


@dataclass(frozen=True)
class Design:
    """Places of the columns: 1, then (number, its gaps) pairs, then categories and their gaps, then the label."""

    numerical: tuple[str, ...]
    levels: dict[str, tuple[str, ...]]
    shift: dict[str, float]

    @property
    def width(self) -> int:
        return 2 + 2 * len(self.numerical) + sum(len(v) + 1 for v in self.levels.values())

    def number(self, c: str) -> int:
        return 1 + 2 * self.numerical.index(c)

    def category(self, c: str) -> int:
        """The place of its first level; the flag of gaps comes after the last."""
        at = 1 + 2 * len(self.numerical)
        for name, values in self.levels.items():
            if name == c:
                return at
            at += len(values) + 1
        raise KeyError(c)

    @property
    def place_type(self) -> type:
        return np.uint16 if self.width < 1 << 16 else np.uint32

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shifted numbers (NaN: a gap) and places of the levels, a row of each array per column, and the shifted labels."""
        numbers = np.empty((len(self.numerical), batch.num_rows))
        for i, c in enumerate(self.numerical):
            numbers[i] = batch.column(c).to_numpy(zero_copy_only=False) - self.shift[c]
        places = np.empty((len(self.levels), batch.num_rows), self.place_type)
        for i, (c, values) in enumerate(self.levels.items()):
            at = pc.fill_null(pc.index_in(batch.column(c), value_set=pa.array(values, pa.string())), len(values))
            places[i] = self.category(c) + at.to_numpy(zero_copy_only=False)
        return numbers, places, batch.column("_label").to_numpy(zero_copy_only=False) - self.shift["_label"]

    def columns(self, numbers: np.ndarray, places: np.ndarray, label: np.ndarray) -> np.ndarray:
        """What was read spread out, a row of the result per column."""
        out = np.zeros((self.width, len(label)))
        out[0] = 1.0
        for i, x in enumerate(numbers):
            gone = np.isnan(x)
            if gone.any():
                out[1 + 2 * i] = np.where(gone, 0.0, x)
                out[2 + 2 * i] = gone
            else:
                out[1 + 2 * i] = x
        each = np.arange(len(label))
        for at in places:
            out[at, each] = 1.0
        out[-1] = label
        return out

    def rows(self, batch: pa.RecordBatch) -> np.ndarray:
        return np.ascontiguousarray(self.columns(*self.read(batch)).T)


def _sums(batches: Iterator[pa.RecordBatch], design: Design) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rows, folds = design.rows(part), part.column("_fold").to_numpy(zero_copy_only=False)
            for fold in np.unique(folds).tolist():
                z = rows[folds == fold]
                totals[fold] = totals.get(fold, 0.0) + z.T @ z
    yield from sum_rows(totals)


def sum_rows(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row per fold and pair of columns whose products do not add up to nothing."""
    for fold, total in totals.items():
        i, j = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), fold), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                          pa.array(total[i, j])], ["fold", "i", "j", "v"])


def design_cells(rows: DataFrame, design: Design, also: list[str] = ()) -> DataFrame:
    """What ``Design.rows`` reads, the fold, and other columns as they are."""
    numbers = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in design.numerical]
    return rows.select("_fold", F.col("_label").cast("double").alias("_label"), *numbers, *[F.col(c).cast("string").alias(c) for c in design.levels], *also)


def fold_sums(rows: DataFrame, design: Design, folds: int) -> np.ndarray:
    """(folds, width, width): sums of products; one scan, and a row per fold and pair to the driver."""
    ship(rows.sparkSession)
    return added_up(design_cells(rows, design).mapInArrow(partial(_sums, design=design), SUMS_DDL), design, folds)


def added_up(sums: DataFrame, design: Design, folds: int) -> np.ndarray:
    """(folds, width, width) of the sums that each task has of its own rows."""
    out = np.zeros((folds, design.width, design.width))
    found = sums.groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    fold, i, j, v = (found[c].to_numpy() for c in ("fold", "i", "j", "v"))
    out[fold, i, j] = v
    out[fold, j, i] = v
    return out


def design_of(rows: DataFrame, numerical: list[str], categorical: list[str], max_width: int = MAX_WIDTH) -> Design | None:
    """The columns of the sums; None if the categories make them more than ``max_width``.

    Counts about one mean each, so that large numbers lose no digits.
    """
    present = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in [*numerical, "_label"]}
    shift = rows.agg(*[F.avg(x).alias(c) for c, x in present.items()]).first().asDict()
    levels: dict[str, list[str]] = {c: [] for c in categorical}
    if categorical:
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categorical])
        known = rows.select(F.explode(cells).alias("x")).select("x.*").where(F.col("v").isNotNull()).distinct()
        for r in known.limit(max_width + 1).collect():
            levels[r["c"]].append(r["v"])
    design = Design(tuple(numerical), {c: tuple(sorted(v)) for c, v in levels.items()}, {c: v or 0.0 for c, v in shift.items()})
    return design if design.width <= max_width else None


@dataclass(frozen=True)
class Features:
    """Features of some training rows as combinations of the design's columns, and what they came from."""

    names: list
    columns: np.ndarray
    means: dict[str, float]
    deviations: dict[str, float]
    modes: dict[str, str | None]

    @staticmethod
    def of(sums: np.ndarray, design: Design) -> "Features":
        """Numbers filled with their mean and scaled, categories filled with their mode, a feature each."""
        n = sums[0, 0]
        names, columns = [], []
        means, deviations, modes = {}, {}, {}
        for c in design.numerical:
            x, gone = design.number(c), design.number(c) + 1
            filled = n - sums[0, gone]
            mean = sums[0, x] / filled if filled else 0.0
            spread = np.sqrt(max(0.0, (sums[x, x] - filled * mean * mean) / n)) if n else 0.0
            scale = spread if spread > 1e-12 * max(1.0, abs(mean)) else 1.0
            a = np.zeros(design.width)
            a[[x, gone, 0]] = 1 / scale, mean / scale, -mean / scale
            names.append(c)
            columns.append(a)
            means[c], deviations[c] = mean + design.shift[c], scale
        for c, values in design.levels.items():
            first = design.category(c)
            counts = [sums[first + k, first + k] for k in range(len(values))]
            mode = int(np.argmax(counts)) if values and max(counts) > 0 else None
            modes[c] = None if mode is None else values[mode]
            for k, value in enumerate(values):
                a = np.zeros(design.width)
                a[first + k] = 1.0
                if k == mode:
                    a[first + len(values)] = 1.0
                names.append((c, value))
                columns.append(a)
        a = np.stack(columns, axis=1) if columns else np.zeros((design.width, 0))
        return Features(names, a, means, deviations, modes)


@dataclass(frozen=True)
class RidgeFit:
    """Weights of the scaled numbers and of the categories, and what training rows they came from."""

    design: Design
    weights: dict
    intercept: float
    means: dict[str, float]
    deviations: dict[str, float]
    modes: dict[str, str | None]
    residual: np.ndarray

    @staticmethod
    def of(sums: np.ndarray, design: Design, alpha: float) -> "RidgeFit":
        """Minimises mean squared error / 2 + alpha / 2 * squared weights, the intercept left out."""
        n, label = sums[0, 0], design.width - 1
        features = Features.of(sums, design)
        a = features.columns
        centre, target = a.T @ sums[:, 0] / n, sums[0, label] / n
        cov = a.T @ sums @ a / n - np.outer(centre, centre)
        w = np.linalg.solve(cov + alpha * np.eye(len(features.names)), a.T @ sums[:, label] / n - centre * target)
        residual = np.zeros(design.width)
        residual[label] = 1.0
        residual[0] -= target - centre @ w
        residual -= a @ w
        return RidgeFit(design, dict(zip(features.names, w.tolist())), float(target - centre @ w + design.shift["_label"]), features.means,
                        features.deviations, features.modes, residual)

    def squared_error(self, sums: np.ndarray) -> float | None:
        """Mean over the rows behind these sums."""
        return float(self.residual @ sums @ self.residual / sums[0, 0]) if sums[0, 0] else None

    def scorer(self) -> ChainedScorer:
        """The fit as column expressions over raw rows, gaps filled as in training."""
        numeric = {c: (self.weights[c] / self.deviations[c], self.means[c]) for c in self.design.numerical}
        moved = sum(w * self.means[c] for c, (w, _) in numeric.items())
        categories = {c: {v: self.weights[c, v] for v in values} for c, values in self.design.levels.items()}
        return ChainedScorer(LinearScorer(self.intercept - moved, numeric, categories), (Imputer(dict(self.modes)),) if self.modes else ())


def fit_ridge(rows: DataFrame, design: Design, folds: int, alphas: tuple[float, ...],
              sums: np.ndarray | None = None) -> tuple[list[list[RidgeFit]], list[RidgeFit], list[list[float | None]]]:
    """Fits without each fold, fits on all rows, and held-out squared errors, each by penalty; without ``sums`` the rows are scanned."""
    sums = fold_sums(rows, design, folds) if sums is None else sums
    whole = sums.sum(axis=0)
    without = [[RidgeFit.of(whole - own, design, a) for a in alphas] if (whole - own)[0, 0] > 0 else [] for own in sums]
    errors = [[fit.squared_error(own) for fit in fits] or [None] * len(alphas) for fits, own in zip(without, sums)]
    return without, [RidgeFit.of(whole, design, a) for a in alphas], errors
