"""Logistic regressions over hashed texts, all folds and penalties fitted side by side.

As in ``logistic``, one scan gives loss and gradient of every fit at its own point.  The hashed
counts of a text depend on its row only, so they are made once for all folds, and kept on the
executors' disks in bytes, a few documents to a block: four bytes a term, not twelve a term and
fold, and nothing of a scan but one block at a time is held in memory.  Numbers and categories
are the columns of a ``Design``; texts, whose products are too many to sum, are scaled by the
sums and sums of squares of each fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import Normalizer, StringIndexerModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnish.operators.features import TEXT_DIMENSIONS, hashed_text_stages
from tarnish.operators.linear import Design, Features, design_cells
from tarnish.operators.logistic import minimise, probability, side_by_side, standardised
from tarnish.operators.metrics import task_metric
from tarnish.session import ship

#: Rows that go to Python at once when they are packed, and blocks of them in a scan.
DOCUMENTS, BLOCKS = 256, 16
PACKED_DDL = "fold int, n int, fits boolean, wide boolean, block binary"
TOTALS_DDL = "k int, total binary"


@contextmanager
def _few_at_once(spark: SparkSession, records: int) -> Iterator[None]:
    """What is planned and run inside hands at most so many rows to Python at once, as they are long, and leaves no shuffled
    totals behind on the disks."""
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(records), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def counted(rows: DataFrame, design: Design, text: list[str]) -> DataFrame:
    """The cells of the design beside the hashed counts of each text."""
    stages, names = [], []
    for i, c in enumerate(text):
        stages += [s for s in hashed_text_stages(f"_text{i}", f"_vector{i}") if not isinstance(s, Normalizer)]
        names.append(f"_text{i}_tf")
    filled = [F.coalesce(F.col(c), F.lit("")).alias(f"_text{i}") for i, c in enumerate(text)]
    cells = design_cells(rows, design, filled)
    return PipelineModel(stages).transform(cells).select(*cells.columns[:-len(text)], *names)


def _packed(batches: Iterator[pa.RecordBatch], design: Design, texts: int) -> Iterator[pa.RecordBatch]:
    """The rows as blocks of one fold each, in bytes; ``wide`` counts are no 16-bit numbers, ``fits`` says that all labels are 0 or 1."""
    place = np.uint16 if texts * TEXT_DIMENSIONS <= 1 << 16 else np.uint32
    for batch in batches:
        numbers, places, label = design.read(batch)
        folds, blocks = batch.column("_fold").to_numpy(zero_copy_only=False), []
        fits, ones = bool(((label == 0) | (label == 1)).all()), (label == 1).astype(np.uint8)
        ends, at, counts = [], [], []
        for i in range(texts):
            column = batch.column(f"_text{i}_tf")
            found = column.field("indices")
            ends.append(found.offsets.to_numpy())
            at.append(found.values.to_numpy().astype(place) + place(i * TEXT_DIMENSIONS))
            counts.append(column.field("values").values.to_numpy())
        for fold in np.unique(folds).tolist():
            own = np.flatnonzero(folds == fold)
            terms = np.stack([(e[own + 1] - e[own]).astype(np.uint32) for e in ends])
            # row by row, its texts side by side
            pieces = [(i, slice(ends[i][r], ends[i][r + 1])) for r in own.tolist() for i in range(texts)]
            of_fold = np.concatenate([counts[i][s] for i, s in pieces])
            wide = bool(len(of_fold) and of_fold.max() >= 1 << 16)
            parts = (numbers[:, own], of_fold.astype(np.float64 if wide else np.uint16), terms.T, places[:, own],
                     np.concatenate([at[i][s] for i, s in pieces]), ones[own])
            blocks.append((fold, len(own), fits, wide, b"".join(np.ascontiguousarray(x).tobytes() for x in parts)))
        types = (pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*blocks), types)], ["fold", "n", "fits", "wide", "block"])


@dataclass(frozen=True)
class Block:
    """Rows of one fold: the design's columns, and the terms of each row with their weights in texts of length 1."""

    fold: int
    fits: bool
    columns: np.ndarray
    terms: np.ndarray
    places: np.ndarray
    values: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch], design: Design, texts: int) -> Iterator[Block]:
    place = np.uint16 if texts * TEXT_DIMENSIONS <= 1 << 16 else np.uint32
    for batch in batches:
        for fold, n, fits, wide, block in zip(*(batch.column(c) for c in ("fold", "n", "fits", "wide", "block"))):
            n, data, at = n.as_py(), block.as_buffer(), 0

            def read(kind: type, size: int) -> np.ndarray:
                nonlocal at
                out = np.frombuffer(data, kind, size, at) if size else np.zeros(0, kind)
                at += out.nbytes
                return out

            count = np.float64 if wide.as_py() else np.uint16
            inner = n * (len(design.numerical) * 8 + texts * 4 + len(design.levels) * np.dtype(design.place_type).itemsize + 1)
            size = (data.size - inner) // (np.dtype(count).itemsize + np.dtype(place).itemsize)
            numbers = read(np.float64, n * len(design.numerical)).reshape(len(design.numerical), n)
            counts = read(count, size).astype(np.float64)
            terms = read(np.uint32, n * texts).astype(np.int64)
            levels = read(design.place_type, n * len(design.levels)).reshape(len(design.levels), n)
            places, ones = read(place, size).astype(np.int64), read(np.uint8, n)
            lengths = np.sqrt(_by_row(counts * counts, terms))
            values = counts / np.repeat(lengths, terms)
            yield Block(fold.as_py(), fits.as_py(), design.columns(numbers, levels, ones), terms.reshape(n, texts).sum(axis=1), places, values)


def _by_row(values: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Sums of the values of each row, equal for equal rows."""
    out = np.zeros((len(terms), *values.shape[1:]))
    some = np.flatnonzero(terms)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(terms) - terms)[some], axis=0)
    return out


def _as_totals(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, total in parts.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())], ["k", "total"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column("k").to_pylist(), batch.column("total")):
            totals[k] = totals.get(k, 0.0) + np.frombuffer(part.as_buffer())
    yield from _as_totals(totals)


def _scanned(packed: DataFrame, scan: Callable, parts: int) -> dict[int, np.ndarray]:
    """By number the sums over all tasks, which are added up by as many tasks as there are numbers."""
    tasks = 2 * packed.sparkSession.sparkContext.defaultParallelism
    found = packed.coalesce(tasks).mapInArrow(scan, TOTALS_DDL).repartition(parts, "k").mapInArrow(_added, TOTALS_DDL)
    return {r["k"]: np.frombuffer(bytes(r["total"])) for r in found.collect()}


def _moments(batches: Iterator[pa.RecordBatch], design: Design, texts: int) -> Iterator[pa.RecordBatch]:
    """By fold sums of products of the design's columns, then sums and sums of squares of the terms' weights."""
    width, wide, totals = design.width, texts * TEXT_DIMENSIONS, {}
    for b in _blocks(batches, design, texts):
        total = totals.setdefault(b.fold, np.zeros(width * width + 2 * wide))
        total[:width * width] += (b.columns @ b.columns.T).ravel() if b.fits else np.nan
        total[width * width:-wide] += np.bincount(b.places, b.values, wide)
        total[-wide:] += np.bincount(b.places, b.values * b.values, wide)
    yield from _as_totals(totals)


def _losses(batches: Iterator[pa.RecordBatch], design: Design, texts: int, weights: np.ndarray, left_out: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of the gradients and losses of all fits, each over the rows that it does not leave out; see ``logistic._losses``.

    ``weights`` are those of the design's columns, then of the terms.
    """
    width, wide, by_fold, spread = design.width, texts * TEXT_DIMENSIONS, {}, np.zeros(0)
    for b in _blocks(batches, design, texts):
        if b.fold not in by_fold:
            used = np.flatnonzero(left_out != b.fold)
            by_fold[b.fold] = used, np.ascontiguousarray(weights[:, used]), np.zeros((width + wide + 1, len(used)))
        used, own, sums = by_fold[b.fold]
        if not len(used):
            continue
        n = len(b.terms)
        if spread.size < n * wide:
            spread = np.zeros(n * wide)
        cells = np.repeat(np.arange(n) * wide, b.terms) + b.places
        spread[cells] = b.values
        x = spread[:n * wide].reshape(n, wide)
        sign = (1.0 - 2.0 * b.columns[-1])[:, None]
        z = x @ own[width:]
        z += b.columns.T @ own[:width]
        z *= sign
        over = np.exp(-np.abs(z))
        under = over + 1.0
        np.copyto(over, 1.0, where=z >= 0)
        over /= under
        over *= sign
        sums[width:-1] += x.T @ over
        sums[:width] += b.columns @ over
        sums[-1] += np.log(under).sum(axis=0) + np.maximum(z, 0.0).sum(axis=0)
        spread[cells] = 0.0
    totals = np.zeros((len(left_out), width + wide + 1))
    for used, _, sums in by_fold.values():
        totals[used] += sums.T
    yield from _as_totals(dict(enumerate(totals)))


def _margins(batches: Iterator[pa.RecordBatch], design: Design, texts: int, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Log odds of a row by the fits that left its fold out; ``weights`` is (folds, columns and terms, settings).

    Column by column and row by row, since a matrix product may round equal rows differently, which would part ties.
    """
    names = ["_fold", "_label", *[f"_m{i}" for i in range(weights.shape[2])]]
    for b in _blocks(batches, design, texts):
        own = weights[b.fold]
        margins = _by_row(own[design.width + b.places] * b.values[:, None], b.terms).T
        for column, w in zip(b.columns, own):
            if column.any() and w.any():
                margins = margins + column * w[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.terms), b.fold), pa.int32()), pa.array(b.columns[-1]), *[pa.array(m) for m in margins]], names)


@dataclass(frozen=True)
class TextFit:
    """What one fit needs of its training rows; its weights: of the standardised features, of the scaled terms, then the intercept."""

    features: Features
    fold: int
    alpha: float
    n: float
    places: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    start: np.ndarray

    @staticmethod
    def of(moments: np.ndarray, design: Design, fold: int, alpha: float) -> "TextFit | None":
        """None without both classes, or if rows are not as ``standardised`` needs them."""
        square = design.width ** 2
        sums, (first, second) = moments[:square].reshape(design.width, design.width), moments[square:].reshape(2, -1)
        n, positives = sums[0, 0], sums[0, -1]
        found = standardised(sums, design) if 0 < positives < n else None
        if found is None:
            return None
        features, places, middle, spread = found
        centre = first / n
        varied = np.maximum(second / n - centre * centre, 0.0)
        differ = varied > 1e-12 * second / n
        scale = np.divide(1.0, np.sqrt(varied * n / (n - 1)), out=np.zeros_like(varied), where=differ)
        start = np.zeros(places.shape[1] + len(scale))
        start[-1] = np.log(positives / (n - positives))
        return TextFit(features, fold, alpha, n, places, middle, spread, centre, scale, start)

    def by_place(self, weights: np.ndarray) -> np.ndarray:
        """Weights of the design's columns, the last of which is the label, then of the terms."""
        known = len(self.spread)
        terms = weights[known:-1] * self.scale
        columns = self.places @ np.append(weights[:known], weights[-1])
        columns[0] -= terms @ self.centre
        columns[-1] = 0.0
        return np.concatenate([columns, terms])

    def objective(self, weights: np.ndarray, total: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss and penalty from the sums over the training rows."""
        inner = np.append(weights[:-1], 0.0)
        width = len(self.places)
        columns = self.places.T @ total[:width]
        terms = self.scale * (total[width:-1] - self.centre * total[0])
        return total[-1] / self.n + self.alpha / 2 * (inner @ inner), np.concatenate([columns[:-1], terms, columns[-1:]]) / self.n + self.alpha * inner

    def model(self, weights: np.ndarray, pipeline: PipelineModel, numerical: list[str], categorical: list[str]) -> LogisticRegressionModel:
        """As MLlib's learner would give it, for the features of this pipeline."""
        known = len(self.spread)
        inner = dict(zip(self.features.names, np.divide(weights[:known], self.spread, out=np.zeros(known), where=self.spread > 0)))
        levels = next((s.labelsArray for s in pipeline.stages if isinstance(s, StringIndexerModel)), [])
        order = [*numerical, *[(c, v) for c, values in zip(categorical, levels) for v in values]]
        terms = weights[known:-1] * self.scale
        intercept = weights[-1] - terms @ self.centre - weights[:known] @ self.middle
        context = SparkSession.getActiveSession().sparkContext
        coefficients = _py2java(context, Vectors.dense(np.concatenate([[inner[x] for x in order], terms])))
        return LogisticRegressionModel(context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
            context._jvm.org.apache.spark.ml.util.Identifiable.randomUID("logreg"), coefficients, float(intercept)))


@dataclass(frozen=True)
class TextFits:
    """By penalty the fits on all rows and their weights, and the held-out AUC of each fold."""

    fits: list[TextFit]
    weights: list[np.ndarray]
    scores: list[list[float | None]]


def fit_texts(rows: DataFrame, design: Design, text: list[str], folds: int, alphas: tuple[float, ...], max_iter: int) -> TextFits | None:
    """None if some training rows lack a class, a label is neither 0 nor 1, or a column has no values, infinite ones or
    none that differ by more than rounding.
    """
    spark, texts = rows.sparkSession, len(text)
    design = replace(design, shift=design.shift | {"_label": 0.0})
    ship(spark)
    with _few_at_once(spark, DOCUMENTS):
        packed = counted(rows, design, text).mapInArrow(partial(_packed, design=design, texts=texts), PACKED_DDL).persist(StorageLevel.DISK_ONLY)
        packed.count()
    try:
        with _few_at_once(spark, BLOCKS):
            by_fold = _scanned(packed, partial(_moments, design=design, texts=texts), folds)
            moments = np.zeros((folds, design.width ** 2 + 2 * texts * TEXT_DIMENSIONS))
            for fold, found in by_fold.items():
                moments[fold] = found
            whole = moments.sum(axis=0)
            fits = [TextFit.of(whole if fold < 0 else whole - moments[fold], design, fold, a) for fold in (-1, *range(folds)) for a in alphas]
            if any(f is None for f in fits):
                return None

            def losses(going: list[int], points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
                weights = np.stack([fits[i].by_place(p) for i, p in zip(going, points)], axis=1)
                scan = partial(_losses, design=design, texts=texts, weights=weights, left_out=np.array([fits[i].fold for i in going]))
                totals = _scanned(packed, scan, len(going))
                return [fits[i].objective(p, totals[k]) for k, (i, p) in enumerate(zip(going, points))]

            weights = side_by_side([minimise(f.start, max_iter) for f in fits], losses)
            held = np.stack([f.by_place(w) for f, w in zip(fits, weights)]).reshape(folds + 1, len(alphas), -1)[1:]
            ddl = "_fold int, _label double, " + ", ".join(f"_m{i} double" for i in range(len(alphas)))
            scored = packed.mapInArrow(partial(_margins, design=design, texts=texts, weights=held.transpose(0, 2, 1)), ddl)
            each = F.explode(F.array(*[F.struct(F.lit(i).alias("setting"), probability(F.col(f"_m{i}")).alias("score")) for i in range(len(alphas))]))
            long = scored.select("_fold", "_label", each.alias("c")).select("_fold", "_label", "c.setting", "c.score")
            found = {(r["_fold"], r["setting"]): r["value"] for r in task_metric(long, "binary", "score", "_label", ["_fold", "setting"]).collect()}
    finally:
        packed.unpersist()
    return TextFits(fits[:len(alphas)], weights[:len(alphas)], [[found.get((fold, i)) for fold in range(folds)] for i in range(len(alphas))])
