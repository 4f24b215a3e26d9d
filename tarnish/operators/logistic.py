"""Logistic regressions of all folds and penalties, fitted side by side.

A fold's features (gaps filled, numbers scaled, categories encoded) are linear in the columns
of a ``Design``, as in ``linear``.  So one scan of the plain rows gives the loss and gradient
of every fit at its own point, and all fits go through their steps together: the number of
scans is that of the longest fit, however many folds and penalties there are, and no vector
of features is stored.  The plain rows are stored as blocks of bytes, numbers beside the places
of their categories, so a scan costs what the arithmetic costs.  Each fit takes the steps and the stopping rules of MLlib's learner,
so its weights, also of a fit that ends early, are the same up to rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tarnish.operators.clean import Imputer
from tarnish.operators.linear import SUMS_DDL, Design, Features, added_up, design_cells, sum_rows
from tarnish.operators.metrics import task_metric
from tarnish.operators.scoring import ChainedScorer, LinearScorer
from tarnish.session import ship

# Stopping and searching as MLlib's learners do: tolerance, remembered steps, values looked back on, tries of a search.
TOLERANCE, MEMORY, LOOK_BACK, TRIES = 1e-6, 10, 20, 10
DECREASE, CURVATURE = 1e-4, 0.9
#: Rows that are packed together, and those of a fold that are spread out at once (under 1,024: see ``_losses``).
PACK, BLOCK = 10_000, 1_000
PACKED_DDL = "fold int, n int, fits boolean, block binary"

Steps = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def probability(log_odds: Column) -> Column:
    """Of class 1, as what the other class leaves of 1: rows where that is nothing tie."""
    return F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.exp(log_odds))


class ProbabilityScorer(LinearScorer):
    """A fitted logistic regression."""

    def score(self, df: DataFrame, into: str = "score") -> DataFrame:
        return df.withColumn(into, probability(self.predictor()))


def _direction(steps: list[tuple[np.ndarray, np.ndarray]], grad: np.ndarray) -> np.ndarray:
    """Downhill, by the curvature that the remembered (step, change of gradient) show, the latest first."""
    out, parts = grad.copy(), []
    for step, change in steps:
        part = (step @ out) / (step @ change)
        out -= part * change
        parts.append(part)
    if steps:
        step, change = steps[0]
        if not step @ change >= 0 or np.isnan(parts).any():
            raise ArithmeticError("the remembered steps show no curvature")
        out *= (step @ change) / (change @ change)
    for (step, change), part in zip(reversed(steps), reversed(parts)):
        out += (part - (change @ out) / (step @ change)) * step
    return -out


def _between(left: tuple, right: tuple) -> float:
    """Where the cubic through two (length, slope, value) has its minimum, kept away from both ends."""
    (t0, s0, v0), (t1, s1, v1) = left, right
    a = s0 + s1 - 3 * (v0 - v1) / (t0 - t1)
    b = np.sqrt(a * a - s0 * s1)
    t = t1 - (t1 - t0) * (s1 + b - a) / (s1 - s0 + 2 * b)
    if np.isnan(t):
        raise ArithmeticError("no minimum between the ends")
    return min(max(t, t0 + 0.1 * (t1 - t0)), t0 + 0.9 * (t1 - t0))


def search(x: np.ndarray, value: float, grad: np.ndarray, direction: np.ndarray, length: float, *, tries: int = TRIES,
           longest: float = np.inf, lower: np.ndarray | float = -np.inf) -> Generator:
    """A length along the direction with enough decrease and curvature (strong Wolfe conditions), or the longest one.

    Yields points, none below ``lower``, is sent (value, gradient), returns (length, point, value, gradient).
    """
    slope = grad @ direction
    low, high, zooms = (0.0, slope, value), None, 0
    if slope > 0:
        raise ArithmeticError("the direction leads uphill")
    for tried in range(2 * tries):
        if high is not None:
            zooms += 1
            length = _between(*sorted((low, high), key=lambda e: e[0]))
        elif tried == tries:
            break
        point = np.maximum(x + direction * length, lower)
        v, g = yield point
        if high is None and not np.isfinite(v):
            length /= 2
            continue
        now = (length, g @ direction, v)
        falls = v <= value + DECREASE * length * slope and not (v >= low[2] and (high is not None or tried > 0))
        if falls and abs(now[1]) <= CURVATURE * abs(slope):
            return length, point, v, g
        if high is not None:
            if not falls:
                high = now
            else:
                high, low = (low if now[1] * (high[0] - low[0]) >= 0 else high), now
        elif not falls:
            high = now
        elif now[1] >= 0:
            low, high = now, low
        elif length == longest:
            return length, point, v, g
        else:
            low = now
            length = min(length * 1.5, longest)
        if zooms == tries:
            break
    raise ArithmeticError("no such length found")


def minimise(x: np.ndarray, max_iter: int) -> Steps:
    """Limited-memory BFGS: yields points, is sent (value, gradient) of each, returns the last point."""
    value, grad = yield x
    first, recent, steps, done, failed = value, [np.inf], [], 0, False
    while done < max_iter and np.linalg.norm(grad) > max(TOLERANCE * value, 1e-8):
        if len(recent) > 1 and abs(value - max(recent)) <= TOLERANCE * first:
            break
        try:
            direction = _direction(steps, grad)
            length, point, new_value, new_grad = yield from search(
                x, value, grad, direction, 1 / np.linalg.norm(direction) if done == 0 else 1.0)
            if length * np.linalg.norm(grad) < 1e-10:
                raise ArithmeticError("the step is too small")
        except ArithmeticError:  # once more from here without the remembered steps
            if failed:
                break
            failed, steps = True, []
            continue
        steps = [(point - x, new_grad - grad), *steps][:MEMORY]
        x, value, grad, failed = point, new_value, new_grad, False
        recent = [*recent, value][-LOOK_BACK:]
        done += 1
    return x


def standardised(sums: np.ndarray, design: Design) -> tuple[Features, np.ndarray, np.ndarray, np.ndarray] | None:
    """(features, places of the standardised ones and of 1, their means and deviations) as MLlib's learners see training rows.

    None if a column has no value at all, infinite ones, or none that differ by more than rounding.
    """
    n = sums[0, 0]
    if n < 2 or not np.isfinite(sums).all():
        return None
    features = Features.of(sums, design)
    if any(sums[0, design.number(c) + 1] == n for c in design.numerical) or None in features.modes.values():
        return None
    if any(features.deviations[c] == 1.0 and 0 < sums[x, x] < 1e-12 * n for c in design.numerical for x in [design.number(c)]):
        return None
    a = features.columns
    centre = a.T @ sums[:, 0] / n
    spread = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", a, sums, a) / n - centre ** 2, 0.0) * n / (n - 1))
    spread = np.where(spread > 1e-9, spread, 0.0)
    scale = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
    places = np.zeros((design.width, a.shape[1] + 1))
    places[:, :-1] = a * scale
    places[0, :-1] -= centre * scale
    places[0, -1] = 1.0
    return features, places, centre * scale, spread


@dataclass(frozen=True)
class LogisticFit:
    """What one fit needs of its training rows, and its weights: of the standardised features, then the intercept."""

    features: Features
    fold: int
    alpha: float
    n: float
    places: np.ndarray
    start: np.ndarray

    @staticmethod
    def of(sums: np.ndarray, design: Design, fold: int, alpha: float) -> "LogisticFit | None":
        """None without both classes, or if a column has no value at all."""
        n, positives = sums[0, 0], sums[0, -1]
        found = standardised(sums, design) if 0 < positives < n else None
        if found is None:
            return None
        features, places, _, _ = found
        start = np.zeros(places.shape[1])
        start[-1] = np.log(positives / (n - positives))
        return LogisticFit(features, fold, alpha, n, places, start)

    def objective(self, weights: np.ndarray, loss: float, grad: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss and penalty from the sums over the training rows."""
        inner = np.append(weights[:-1], 0.0)
        return loss / self.n + self.alpha / 2 * (inner @ inner), self.places.T @ grad / self.n + self.alpha * inner

    def scorer(self, design: Design, weights: np.ndarray) -> ChainedScorer:
        """The fit as column expressions over raw rows, gaps filled as in training."""
        return raw_scorer(self.features, design, self.places @ weights, ProbabilityScorer, "probability")


def raw_scorer(features: Features, design: Design, by_place: np.ndarray, kind: type[LinearScorer], link: str = "logit") -> ChainedScorer:
    """Weights of the design's columns as column expressions over raw rows, gaps filled as in training."""
    numeric = {c: (float(by_place[design.number(c)]), features.means[c]) for c in design.numerical}
    categories = {}
    for c, values in design.levels.items():
        first = design.category(c)
        categories[c] = {v: float(by_place[first + k]) for k, v in enumerate(values)}
    moved = sum(w * design.shift[c] for c, (w, _) in numeric.items())
    imputers = [Imputer(d) for d in (dict(features.means), dict(features.modes)) if d]
    return ChainedScorer(kind(float(by_place[0] - moved), numeric, categories, link), tuple(imputers))


def _packed(batches: Iterator[pa.RecordBatch], design: Design, classes: bool = True) -> Iterator[pa.RecordBatch]:
    """The rows as blocks of one fold each, in bytes; ``fits`` says that all labels are 0 or 1, if they are ``classes``."""
    for batch in batches:
        for at in range(0, batch.num_rows, PACK):
            part = batch.slice(at, PACK)
            numbers, places, label = design.read(part)
            folds, blocks = part.column("_fold").to_numpy(zero_copy_only=False), []
            fits = not classes or bool(((label == 0) | (label == 1)).all())
            label = (label == 1).astype(np.uint8) if classes else label
            for fold in np.unique(folds).tolist():
                own = np.flatnonzero(folds == fold)
                blocks.append((fold, len(own), fits, b"".join(np.ascontiguousarray(x[..., own]).tobytes() for x in (numbers, places, label))))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*blocks), (pa.int32(), pa.int32(), pa.bool_(), pa.binary()))],
                                             ["fold", "n", "fits", "block"])


def _blocks(batches: Iterator[pa.RecordBatch], design: Design, label_type: type = np.uint8,
            most: int | None = None) -> Iterator[tuple[int, bool, np.ndarray]]:
    """Fold, whether the labels fit, and the design's columns, a few rows at a time."""
    for batch in batches:
        for fold, n, fits, block in zip(*(batch.column(c) for c in ("fold", "n", "fits", "block"))):
            n, data = n.as_py(), block.as_buffer()
            numbers = np.frombuffer(data, np.float64, n * len(design.numerical)).reshape(len(design.numerical), n)
            places = np.frombuffer(data, design.place_type, n * len(design.levels), numbers.nbytes).reshape(len(design.levels), n)
            label = np.frombuffer(data, label_type, n, numbers.nbytes + places.nbytes)
            for at in range(0, n, most or BLOCK):
                few = slice(at, at + (most or BLOCK))
                yield fold.as_py(), fits.as_py(), design.columns(numbers[:, few], places[:, few], label[few])


def _packed_sums(batches: Iterator[pa.RecordBatch], design: Design, label_type: type = np.uint8) -> Iterator[pa.RecordBatch]:
    """As ``linear`` sums them; a label that does not fit makes the sums no numbers."""
    totals: dict[int, np.ndarray] = {}
    for fold, fits, x in _blocks(batches, design, label_type):
        totals[fold] = totals.get(fold, 0.0) + (x @ x.T if fits else np.full((design.width, design.width), np.nan))
    yield from sum_rows(totals)


def _losses(batches: Iterator[pa.RecordBatch], design: Design, weights: np.ndarray, left_out: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of the gradients and losses of all fits, each over the rows that it does not leave out.

    With a row's sign turned by its label, z are the log odds of the other class, and the loss is log(1 + exp(z)).
    """
    totals = np.zeros((design.width + 1, len(left_out)))
    for fold, _, x in _blocks(batches, design):
        used = np.flatnonzero(left_out != fold)
        if not len(used):
            continue
        x *= 1.0 - 2.0 * x[-1]
        z = weights[:, used].T @ x
        over = np.exp(-np.abs(z))
        under = over + 1.0
        np.copyto(over, 1.0, where=z >= 0)
        over /= under
        totals[:-1, used] += x @ over.T
        # a product of BLOCK numbers of at most 2 is a number still, and needs one logarithm
        totals[-1, used] += np.log(np.multiply.reduce(under, axis=1)) + np.maximum(z, 0.0, out=z).sum(axis=1)
    yield as_sums(totals)


def _margins(batches: Iterator[pa.RecordBatch], design: Design, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Log odds of a row by the fits that left its fold out; ``weights`` is (folds, width, settings).

    Column by column, since a matrix product may round equal rows differently, which would part ties.
    """
    names = ["_fold", "_label", *[f"_m{i}" for i in range(weights.shape[2])]]
    for fold, _, x in _blocks(batches, design):
        margins = np.zeros((weights.shape[2], x.shape[1]))
        for column, own in zip(x, weights[fold]):
            if column.any() and own.any():
                margins += column * own[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(x.shape[1], fold), pa.int32()), pa.array(x[-1]), *[pa.array(m) for m in margins]], names)


def scanned(packed: DataFrame, scan: Callable, shape: tuple[int, ...]) -> np.ndarray:
    """The sums over all tasks of what ``scan`` gives by place (k, v) in an array of this shape."""
    summed = packed.mapInArrow(scan, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    totals = np.zeros(shape)
    totals.ravel()[summed["k"].to_numpy()] = summed["v"].to_numpy()
    return totals


def as_sums(totals: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(totals.size), pa.int32()), pa.array(totals.ravel())], ["k", "v"])


def side_by_side(runs: list[Steps], losses: Callable[[list[int], list[np.ndarray]], list[tuple[float, np.ndarray]]]) -> list[np.ndarray]:
    """Where all runs end; ``losses`` gives (value, gradient) of all that have not ended, by one scan."""
    points, found, going = [next(r) for r in runs], {}, list(range(len(runs)))
    while going:
        for i, sent in zip(going, losses(going, [points[i] for i in going])):
            try:
                with np.errstate(all="ignore"):
                    points[i] = runs[i].send(sent)
            except StopIteration as end:
                found[i] = end.value
        going = [i for i in going if i not in found]
    return [found[i] for i in range(len(runs))]


def _fitted(packed: DataFrame, design: Design, fits: list[LogisticFit], max_iter: int) -> list[np.ndarray]:
    """The weights of all fits."""
    def losses(going: list[int], points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        weights = np.stack([fits[i].places @ p for i, p in zip(going, points)], axis=1)
        weights[-1] = 0.0
        scan = partial(_losses, design=design, weights=weights, left_out=np.array([fits[i].fold for i in going]))
        totals = scanned(packed, scan, (design.width + 1, len(going)))
        return [fits[i].objective(p, total[-1], total[:-1]) for i, p, total in zip(going, points, totals.T)]

    return side_by_side([minimise(f.start, max_iter) for f in fits], losses)


def fit_logistic(rows: DataFrame, design: Design, folds: int, alphas: tuple[float, ...],
                 max_iter: int) -> tuple[list[ChainedScorer], list[list[float | None]]] | None:
    """By penalty: the fit on all rows, and the held-out AUC of each fold.

    None if some training rows lack a class, a label is neither 0 nor 1, or a column has no values, infinite ones or
    none that differ by more than rounding.
    """
    design = replace(design, shift=design.shift | {"_label": 0.0})
    ship(rows.sparkSession)
    packed = design_cells(rows, design).mapInArrow(partial(_packed, design=design), PACKED_DDL).persist()
    try:
        sums = added_up(packed.mapInArrow(partial(_packed_sums, design=design), SUMS_DDL), design, folds)
        if np.isnan(sums).any():
            return None
        whole = sums.sum(axis=0)
        fits = [LogisticFit.of(whole if fold < 0 else whole - sums[fold], design, fold, a) for fold in (-1, *range(folds)) for a in alphas]
        if any(f is None for f in fits):
            return None
        weights = _fitted(packed, design, fits, max_iter)
        by_fold = np.stack([f.places @ w for f, w in zip(fits, weights)]).reshape(folds + 1, len(alphas), design.width)[1:]
        by_fold[:, :, -1] = 0.0
        ddl = "_fold int, _label double, " + ", ".join(f"_m{i} double" for i in range(len(alphas)))
        scored = packed.mapInArrow(partial(_margins, design=design, weights=by_fold.transpose(0, 2, 1)), ddl)
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("setting"), probability(F.col(f"_m{i}")).alias("score")) for i in range(len(alphas))]))
        long = scored.select("_fold", "_label", each.alias("c")).select("_fold", "_label", "c.setting", "c.score")
        found = {(r["_fold"], r["setting"]): r["value"] for r in task_metric(long, "binary", "score", "_label", ["_fold", "setting"]).collect()}
    finally:
        packed.unpersist()
    scorers = [f.scorer(design, w) for f, w in zip(fits[:len(alphas)], weights)]
    return scorers, [[found.get((fold, i)) for fold in range(folds)] for i in range(len(alphas))]
