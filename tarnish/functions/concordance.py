"""Per-partition sums behind the batched AUC, over Arrow batches sorted by score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# One output row per scenario seen in the partition; scenario -1 is the clean histogram.
SUMS_DDL = "_r int, idx int, P double, N double, dP double, dN double, base double, moved double"


class _RangeSums:
    """Running sums of one score range.

    Batches arrive in score order.  Counts seen so far are carried from batch to batch, so
    memory is one batch plus a few numbers per scenario.
    """

    def __init__(self, groups: int):
        self.clean = np.zeros(2)          # positives and negatives of the clean histogram so far
        self.own = np.zeros(groups)       # each scenario's changed negatives so far
        self.change = np.zeros((groups, 3))  # dP, dN, moved
        self.base = 0.0
        self.touched = np.zeros(groups, dtype=bool)

    def add(self, idx: np.ndarray, x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        """Rows of whole score values: no value may continue in the next call."""
        is_clean = idx < 0
        _, at = np.unique(x, return_inverse=True)
        tied = np.stack([np.bincount(at, weights=np.where(is_clean, side, 0.0)) for side in (pos, neg)])
        below = np.cumsum(tied, axis=1) - tied + self.clean[:, None]
        p_mid, n_mid = (below + 0.5 * tied)[:, at]
        self.base += float(np.sum(pos[is_clean] * n_mid[is_clean]))
        self.clean += tied.sum(axis=1)

        order = np.flatnonzero(~is_clean)
        if not len(order):
            return
        order = order[np.argsort(idx[order], kind="stable")]
        g, dp, dn = idx[order], pos[order], neg[order]
        before = np.cumsum(dn) - dn
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        sizes = np.diff(np.r_[starts, len(g)])
        own = before - np.repeat(before[starts], sizes) + self.own[g]
        moved = dp * (n_mid[order] + own + 0.5 * dn) - dn * p_mid[order]
        groups = len(self.own)
        for column, values in enumerate((dp, dn, moved)):
            self.change[:, column] += np.bincount(g, weights=values, minlength=groups)
        self.own += np.bincount(g, weights=dn, minlength=groups)
        self.touched[g] = True

    def rows(self, r: int) -> pa.RecordBatch:
        seen = np.flatnonzero(self.touched)
        zero = np.zeros(len(seen))
        columns = [
            np.r_[-1, seen], np.r_[self.clean[0], zero], np.r_[self.clean[1], zero],
            np.r_[0.0, self.change[seen, 0]], np.r_[0.0, self.change[seen, 1]],
            np.r_[self.base, zero], np.r_[0.0, self.change[seen, 2]],
        ]
        names = ["idx", "P", "N", "dP", "dN", "base", "moved"]
        arrays = [pa.array(np.full(len(seen) + 1, r), pa.int32())]
        arrays += [pa.array(c, pa.int32() if n == "idx" else pa.float64()) for n, c in zip(names, columns)]
        return pa.RecordBatch.from_arrays(arrays, ["_r", *names])


def range_sums(groups: int):
    """mapInArrow function over partitions of (_r, idx, x, pos, neg) sorted by x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, r, held = _RangeSums(groups), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            r = batch.column("_r")[0].as_py()
            part = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("idx", "x", "pos", "neg")]
            if held is not None:
                part = [np.r_[a, b] for a, b in zip(held, part)]
            # the last value may go on in the next batch; it has at most one row per scenario
            whole = int(np.searchsorted(part[1], part[1][-1], side="left"))
            held = [a[whole:] for a in part]
            if whole:
                sums.add(*(a[:whole] for a in part))
        if held is not None:
            sums.add(*held)
            yield sums.rows(r)

    return run
