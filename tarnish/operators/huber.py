"""Huber regressions of all folds and penalties, fitted side by side.

As in ``logistic``: one scan of the packed plain rows gives loss and gradient of every fit at
its own point, so the number of scans is that of the longest fit.  MLlib's learner bounds the
scale of the residuals from below, with a method of its own; it stops after ``max_iter`` steps,
often far from the minimum, so the fits take its steps one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnish.operators.linear import Design, Features
from tarnish.operators.logistic import (
    LOOK_BACK, MEMORY, TOLERANCE, Steps, _blocks, as_sums, raw_scorer, scanned, search, side_by_side, standardised,
)
from tarnish.operators.scoring import ChainedScorer, LinearScorer

#: As MLlib's learner has them: where the loss turns linear, tries of a search, the step that counts as none, the smallest scale.
EPSILON, TRIES, STILL, SMALLEST = 1.35, 64, 1e-5, 5e-324
#: Scales that rows are not divided by beforehand, and rows that are spread out at once.
TINY, ROWS = 1e-100, 4_000
#: Changes of the gradient that are smaller than this part of it are no curvature.
FLAT = 2.2e-16


@dataclass(frozen=True)
class _Curvature:
    """theta * 1 - w @ m @ w.T, which the steps and changes of the gradient show, the latest last."""

    theta: float
    w: np.ndarray
    m: np.ndarray
    changes: np.ndarray
    steps: np.ndarray

    @staticmethod
    def none(n: int) -> "_Curvature":
        return _Curvature(1.0, np.zeros((n, 1)), np.zeros((1, 1)), np.zeros((n, 0)), np.zeros((n, 0)))

    def after(self, step: np.ndarray, change: np.ndarray) -> "_Curvature":
        changes, steps = (np.column_stack([old[:, -(MEMORY - 1):], new]) for old, new in ((self.changes, change), (self.steps, step)))
        if not FLAT * np.linalg.norm(change) < abs(step @ change):
            return _Curvature(self.theta, self.w, self.m, changes, steps)
        theta = (change @ change) / (change @ step)
        products = steps.T @ changes
        lower = np.tril(products, -1)
        m = np.block([[-np.diag(np.diag(products)), lower.T], [lower, theta * (steps.T @ steps)]])
        return _Curvature(theta, np.hstack([changes, theta * steps]), np.linalg.inv(m), changes, steps)


def _cauchy(curve: _Curvature, x: np.ndarray, grad: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first minimum of the model along the gradient, bent at the bounds, and the way there in terms of ``w``."""
    theta, w, m = curve.theta, curve.w, curve.m
    bound = np.where(grad < 0, upper, lower)
    ends = np.where(grad == 0, np.finfo(float).max, (x - bound) / np.where(grad == 0, 1.0, grad))
    d = np.where(ends == 0, 0.0, -grad)
    point, p, c = x.copy(), w.T @ d, np.zeros(len(m))
    slope = grad @ d
    bend = -theta * slope - p @ (m @ p)
    best, at = -slope / bend, 0.0
    order = [i for i in np.argsort(ends, kind="stable") if ends[i] != 0]
    while order and ends[order[0]] - at <= best:
        b = order.pop(0)
        far, row, g = ends[b] - at, w[b], grad[b]
        point[b] = upper[b] if d[b] > 0 else lower[b]
        c = c + p * far
        slope += far * bend + g * g + theta * g * (point[b] - x[b]) - (row * g) @ (m @ c)
        bend += -theta * g * g - 2 * (g * (row @ (m @ p))) - g * g * (row @ (m @ row))
        p = p + row * g
        d[b] = 0.0
        best, at = -slope / bend, ends[b]
    best = max(best, 0.0)
    point[order] = x[order] + (at + best) * d[order]
    return point, c + p * best


def _within(curve: _Curvature, point: np.ndarray, x: np.ndarray, c: np.ndarray, grad: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The minimum of the model over what is not at a bound, cut at the bounds."""
    free = np.flatnonzero((point != lower) & (point != upper))
    wz = curve.w[free].T
    r = (grad + (point - x) * curve.theta - curve.w @ (curve.m @ c))[free]
    v = np.linalg.solve(np.eye(len(wz)) - curve.m @ (wz @ wz.T / curve.theta), curve.m @ (wz @ r))
    move = -(r / curve.theta + wz.T @ v / curve.theta ** 2)
    room = np.where(move > 0, upper[free], lower[free]) - point[free]
    part = min([1.0, *(room[move != 0] / move[move != 0]).tolist()])
    out = point.copy()
    out[free] += move * part
    return out


def minimise_bounded(x: np.ndarray, lower: np.ndarray, max_iter: int) -> Steps:
    """Bounded limited-memory BFGS: yields points, is sent (value, gradient) of each, returns the last point."""
    upper = np.full(len(x), np.finfo(float).max)
    value, grad = yield x
    first, recent, curve, done, failed = value, [np.inf], _Curvature.none(len(x)), 0, False
    while done < max_iter and np.linalg.norm(grad) > max(TOLERANCE * value, 1e-8):
        if np.abs(np.clip(x - grad, lower, upper) - x).max() < STILL:
            break
        if len(recent) > 1 and abs(value - max(recent)) <= TOLERANCE * first:
            break
        try:
            point, c = _cauchy(curve, x, grad, lower, upper)
            point = np.clip(point, lower, upper)
            if done:
                point = np.clip(_within(curve, point, x, c, grad, lower, upper), lower, upper)
            direction = point - x
            moving = direction != 0
            longest = ((np.where(direction < 0, lower, upper) - x)[moving] / direction[moving]).min(initial=np.inf)
            _, point, new_value, new_grad = yield from search(x, value, grad, direction, 1.0, tries=TRIES, longest=max(longest, 1.0), lower=lower)
            curve = curve.after(point - x, new_grad - grad)
        except (ArithmeticError, np.linalg.LinAlgError):  # once more from here without the remembered steps
            if failed:
                break
            failed, curve = True, _Curvature.none(len(x))
            continue
        x, value, grad, failed = point, new_value, new_grad, False
        recent = [*recent, value][-LOOK_BACK:]
        done += 1
    return x


@dataclass(frozen=True)
class HuberFit:
    """What one fit needs of its training rows; its weights: of the standardised features, the intercept, and the scale of residuals."""

    features: Features
    fold: int
    alpha: float
    n: float
    places: np.ndarray
    start: np.ndarray
    penalty: np.ndarray

    @staticmethod
    def of(sums: np.ndarray, design: Design, fold: int, alpha: float) -> "HuberFit | None":
        """None where the labels are all the same, or rows are not as ``standardised`` needs them."""
        found = standardised(sums, design)
        if found is None or not sums[-1, -1] / sums[0, 0] - (sums[0, -1] / sums[0, 0]) ** 2 > 1e-12 * (1.0 + design.shift["_label"] ** 2):
            return None
        features, places, centre, spread = found
        penalty = np.divide(alpha, spread ** 2, out=np.zeros_like(spread), where=spread > 0)
        start = np.ones(len(spread) + 2)
        start[-2] += centre.sum()
        return HuberFit(features, fold, alpha, sums[0, 0], places, start, penalty)

    def by_place(self, weights: np.ndarray, design: Design) -> np.ndarray:
        """Weights of the design's columns, the last of which is the shifted label."""
        out = self.places @ weights[:-1]
        out[0] -= design.shift["_label"]
        return out

    def residual(self, weights: np.ndarray, design: Design) -> np.ndarray:
        """Label minus prediction in terms of the design's columns."""
        out = -self.by_place(weights, design)
        out[-1] = 1.0
        return out

    def objective(self, weights: np.ndarray, loss: float, by_scale: float, grad: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss and penalty from the sums over the training rows."""
        inner = weights[:-2]
        by_weight = self.places.T @ grad / self.n
        by_weight[:-1] += self.penalty * inner
        return loss / self.n + (self.penalty * inner) @ inner / 2, np.append(by_weight, by_scale / self.n)

    def scorer(self, design: Design, weights: np.ndarray) -> ChainedScorer:
        by_place = self.by_place(weights, design)
        by_place[0] += design.shift["_label"]
        return raw_scorer(self.features, design, by_place, LinearScorer)


def _losses(batches: Iterator[pa.RecordBatch], design: Design, residuals: np.ndarray, scales: np.ndarray, left_out: np.ndarray,
            live: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Sums of the gradients, their parts of the scale, and the losses of all fits, each over the rows that it does not leave out.

    ``live`` are the columns that are not 0 in all rows.
    """
    live = np.arange(design.width) if live is None else live
    totals = np.zeros((design.width + 2, len(left_out)))
    scaled = (residuals[live] / np.where(scales < TINY, 1.0, scales)).T
    by_fold: dict[int, tuple] = {}
    for fold, _, x in _blocks(batches, design, np.float64, ROWS):
        if fold not in by_fold:
            used = np.flatnonzero(left_out != fold)
            by_fold[fold] = used, np.ascontiguousarray(scaled[used]), scales[used], np.flatnonzero(scales[used] < TINY), np.zeros((len(live) + 2, len(used)))
        used, parts, scale, tiny, sums = by_fold[fold]
        if not len(used):
            continue
        x = x[live]
        off = parts @ x
        near = np.clip(off, -EPSILON, EPSILON)
        if len(tiny):
            with np.errstate(over="ignore"):  # the smallest scale leaves no row near
                near[tiny] = np.clip(off[tiny] / scale[tiny, None], -EPSILON, EPSILON)
        sums[:-2] -= x @ near.T
        rest = (x.shape[1] - _dots(near, near)) / 2
        sums[-2] += rest
        sums[-1] += _dots(near, off) * np.where(scale < TINY, 1.0, scale) + scale * rest
    for used, _, _, _, sums in by_fold.values():
        totals[np.ix_([*live, design.width, design.width + 1], used)] += sums
    yield as_sums(totals)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of one with that of the other."""
    return (a[:, None, :] @ b[:, :, None])[:, 0, 0]


def _errors(batches: Iterator[pa.RecordBatch], design: Design, residuals: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of the squared and absolute errors of held-out rows; ``residuals`` is (folds, width, settings)."""
    totals = np.zeros((2, len(residuals), residuals.shape[2]))
    for fold, _, x in _blocks(batches, design, np.float64):
        off = residuals[fold].T @ x
        totals[0, fold] += np.einsum("ij,ij->i", off, off)
        totals[1, fold] += np.abs(off).sum(axis=1)
    yield as_sums(totals)


def held_out_errors(packed: DataFrame, design: Design, residuals: np.ndarray) -> np.ndarray:
    """(2, folds, settings): sums of squared and absolute errors by the fits that left a row's fold out."""
    return scanned(packed, partial(_errors, design=design, residuals=residuals), (2, len(residuals), residuals.shape[2]))


def fit_huber(packed: DataFrame, design: Design, sums: np.ndarray, alphas: tuple[float, ...],
              max_iter: int) -> tuple[list[ChainedScorer], np.ndarray] | None:
    """By penalty: the fit on all rows, and the residuals (folds, width, settings) of the fits without each fold.

    None if some training rows have no two different labels, or a column no values, infinite ones or none that differ
    by more than rounding.
    """
    folds, whole = len(sums), sums.sum(axis=0)
    live = np.flatnonzero(np.diag(whole))
    with np.errstate(invalid="ignore"):
        fits = [HuberFit.of(whole if fold < 0 else whole - sums[fold], design, fold, a) for fold in (-1, *range(folds)) for a in alphas]
    if any(f is None for f in fits):
        return None

    def losses(going: list[int], points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        residuals = np.stack([fits[i].residual(p, design) for i, p in zip(going, points)], axis=1)
        scan = partial(_losses, design=design, residuals=residuals, scales=np.array([p[-1] for p in points]),
                       left_out=np.array([fits[i].fold for i in going]), live=live)
        totals = scanned(packed, scan, (design.width + 2, len(going)))
        return [fits[i].objective(p, t[-1], t[-2], t[:-2]) for i, p, t in zip(going, points, totals.T)]

    def run(fit: HuberFit) -> Steps:
        lower = np.full(len(fit.start), -np.finfo(float).max)
        lower[-1] = SMALLEST
        return minimise_bounded(fit.start, lower, max_iter)

    weights = side_by_side([run(f) for f in fits], losses)
    residuals = np.stack([f.residual(w, design) for f, w in zip(fits, weights)]).reshape(folds + 1, len(alphas), design.width)[1:]
    return [f.scorer(design, w) for f, w in zip(fits, weights)][:len(alphas)], residuals.transpose(0, 2, 1)
