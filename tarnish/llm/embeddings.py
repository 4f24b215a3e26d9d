"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its ``NEAREST`` nearest of ``PIVOTS`` reference points, in order of
their distance.  Where vectors share a direction the same points are nearest to all, so a sample's
mean is taken off first, for the description only.  That also spreads true pairs, so it goes no
further than ``SPREAD`` allows, and the more it spreads the more points describe a vector.  Vectors at a cosine of 0.95 or more share at least ``SHARED`` of these with
high probability; only such pairs are candidates, and these are verified in double precision.

The inverted lists hold a vector under each of its pivots but the last SHARED - 1 (by pivot
number), which every pair of candidates must meet in.  A pair counts in one list only, that of
the smallest pivot it shares.  A list that is too long for a task is refined by the next shared
pivot, up to SHARED of them; what is still too long is a dense cluster, dealt out in pairs of
blocks.  Lists return numbers of links and stars, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tarnish.llm.components import components
from tarnish.session import cut_lineage, ship

COSINE = 0.95
#: Reference points: from so many distinct vectors, the smallest by hash, those that are not close to another.
PIVOTS = 512
SAMPLE = 2048
APART = 0.7
NEAREST = 8
SHARED = 3
#: Square of the length that the description leaves of any sampled vector, out of 1.
SPREAD = 1 / 7
#: Vectors of a list that a task compares at once.
LIST = 2048

LISTED_DDL = "key long, path binary, mine int, other int, c long, n long, vector binary, pivots binary"
FOUND_DDL = f"kind int, a long, b long, {LISTED_DDL.replace('c long, n long', 'n long')}"
_LINK, _COUNT, _LONG = 0, 1, 2


def usable(v: Column) -> Column:
    """Whether the vector can link: no NULL, no NULL or non-finite component, not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; large and small components are scaled first."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def reference_points(sample: list[list[float]], dim: int, count: int) -> np.ndarray:
    """Sampled vectors that are apart, filled up with random directions."""
    mine = [np.asarray(v, float) for v in sample if len(v) == dim]
    kept = np.zeros((0, dim))
    for v in unit(np.array(mine)) if mine else []:
        if len(kept) < count and (not len(kept) or (kept @ v).max() < APART):
            kept = np.vstack([kept, v])
    more = np.random.default_rng([20, dim]).normal(size=(count - len(kept), dim))
    return np.vstack([kept, unit(more)]) if len(more) else kept


class Description:
    """What vectors of one length are described by: a centre, reference points, how many of them."""

    def __init__(self, sample: list[list[float]], dim: int, count: int, k: int):
        mine = [v for v in sample if len(v) == dim]
        units = unit(np.array(mine, float)) if mine else np.zeros((0, dim))
        mean = units.mean(axis=0) if len(units) > 1 else np.zeros(dim)
        self.centre, left = mean * self._share(units, mean), 1.0
        if len(units):
            left = max(SPREAD, ((units - self.centre) ** 2).sum(axis=1).min())
        lost = (1 - COSINE) * (1 / min(left, 1.0) - 1)  # how much lower the cosine of a pair at the border gets
        self.k = k + round(30 * lost)
        rest = units - self.centre
        self.points = reference_points(rest[(rest != 0).any(axis=1)].tolist(), dim, count if self.k <= k + 2 else 2 * count)

    @staticmethod
    def _share(units: np.ndarray, mean: np.ndarray) -> float:
        """The largest part of the mean that leaves SPREAD of each sampled vector: 1 - 2 x (v m) + x^2 (m m) >= SPREAD."""
        square = float(mean @ mean)
        if square == 0:
            return 0.0
        along = units @ mean
        under = along**2 - square * (1 - SPREAD)
        roots = (along[under > 0] - np.sqrt(under[under > 0])) / square
        return float(min(1.0, roots[roots > 0].min(initial=1.0)))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The pivots of unit vectors, the nearest first; lengths do not change the order."""
        return nearest(self.points, vectors - self.centre, self.k)


def nearest(points: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """The numbers of the k nearest points of each vector, the nearest first."""
    near = vectors @ points.T
    k = min(k, len(points))
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1).astype(np.uint16)


def _mixed(key: np.ndarray | int, pivot: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (np.asarray(key).astype(np.uint64) ^ (pivot.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def _listed(key, path, c, n, vector, pivots, mine=-1, other=-1) -> pa.RecordBatch:
    m = len(c)
    return pa.RecordBatch.from_arrays([
        pa.array(key, pa.int64()), pa.array(path, pa.binary()), pa.array(np.broadcast_to(mine, m).astype(np.int32)),
        pa.array(np.broadcast_to(other, m).astype(np.int32)), pa.array(c, pa.int64()), pa.array(n, pa.int64()),
        pa.array(vector, pa.binary()), pa.array(pivots, pa.binary())], [f.split()[0] for f in LISTED_DDL.split(", ")])


def _index(batches: Iterator[pa.RecordBatch], sample: list, count: int, k: int, shared: int) -> Iterator[pa.RecordBatch]:
    """Each class under its pivots but the last ``shared`` - 1 by number."""
    described_by: dict[int, Description] = {}
    for batch in batches:
        c, n = (batch.column(x).to_numpy() for x in ("c", "n"))
        lists = batch.column("v")
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.cumsum(sizes) - sizes
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            vectors = flat[(starts[rows][:, None] + np.arange(dim))]
            if dim not in described_by:
                described_by[dim] = Description(sample, int(dim), count, k)
            pivots = described_by[dim].of(unit(vectors))
            ordered = np.sort(pivots, axis=1)
            keep = max(1, ordered.shape[1] - shared + 1)
            start = int(_mixed(0, np.array([dim]))[0])  # lists of vectors of different length share no key
            raw, described = [v.tobytes() for v in vectors], [p.tobytes() for p in pivots]
            for j in range(keep):
                path = [p.tobytes() for p in ordered[:, j]]
                yield _listed(_mixed(start, ordered[:, j]), path, c[rows], n[rows], raw, described)


def _bits(pivots: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(pivots), size // 64 + 1), np.uint64)
    for column in pivots.T:
        np.bitwise_or.at(out, (np.arange(len(out)), column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pivots each of a shares with each of b."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for word in range(a.shape[1]):
        out += np.bitwise_count(a[:, word][:, None] & b[:, word][None, :])
    return out


def linked(vectors: np.ndarray, pivots: np.ndarray, path: np.ndarray, shared: int, cosine: float,
           rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Which of ``rows`` link with which of ``columns`` in the list of these smallest shared pivots."""
    size = int(pivots.max()) + 1
    bits = _bits(pivots, size)
    low = _bits(np.where(pivots < path[-1], pivots, size), size)  # pivots before the path's last one
    low[:, size // 64] &= ~(np.uint64(1) << np.uint64(size % 64))
    found = _common(bits[rows], bits[columns]) >= min(shared, pivots.shape[1])
    found &= _common(low[rows], low[columns]) == len(path) - 1
    if found.any():
        found &= vectors[rows] @ vectors[columns].T >= cosine
    return found


def _stars(found: np.ndarray) -> np.ndarray:
    """The smallest member of each row's component, from a symmetric table of links."""
    label, n = np.arange(len(found)), len(found)
    while True:
        new = np.minimum(label, np.where(found, label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _batch(kind: int, a, b=None, n=None, rest: pa.RecordBatch | None = None) -> pa.RecordBatch:
    m = len(a)
    names = [f.split()[0] for f in FOUND_DDL.split(", ")]
    columns = {"kind": pa.array(np.full(m, kind, np.int32)), "a": pa.array(a, pa.int64()), "b": pa.array(b if b is not None else [None] * m, pa.int64()),
               "n": pa.array(n if n is not None else [None] * m, pa.int64())}
    types = {"key": pa.int64(), "path": pa.binary(), "mine": pa.int32(), "other": pa.int32(), "vector": pa.binary(), "pivots": pa.binary()}
    for name, kind_ in types.items():
        columns[name] = rest.column(name) if rest is not None else pa.nulls(m, kind_)
    return pa.RecordBatch.from_arrays([columns[x] for x in names], names)


def _compare(rows: pa.RecordBatch, shared: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """Links of one list, or of two blocks of one."""
    c, n, mine, other = (rows.column(x).to_numpy() for x in ("c", "n", "mine", "other"))
    vectors = unit(np.array([np.frombuffer(v.as_py()) for v in rows.column("vector")]))
    pivots = np.array([np.frombuffer(v.as_py(), np.uint16) for v in rows.column("pivots")]).astype(np.int64)
    path = np.frombuffer(rows.column("path")[0].as_py(), np.uint16).astype(np.int64)
    low, high = np.flatnonzero(mine <= other), np.flatnonzero(mine >= other)  # a block with itself: all are both
    found = linked(vectors, pivots, path, shared, cosine, low, high)
    found[c[low][:, None] == c[high][None, :]] = False
    if not found.any():
        return
    if (mine == other).all():
        yield _batch(_COUNT, c, n=found @ n)
        root = _stars(found)
        moved = root != np.arange(len(c))
        yield _batch(_LINK, c[moved], c[root[moved]])
        return
    yield _batch(_COUNT, np.concatenate([c[low], c[high]]), n=np.concatenate([found @ n[high], found.T @ n[low]]))
    m = len(low)
    both = np.zeros((m + len(high),) * 2, bool)
    both[:m, m:], both[m:, :m] = found, found.T
    root, ids = _stars(both), np.concatenate([c[low], c[high]])
    moved = root != np.arange(len(ids))
    yield _batch(_LINK, ids[moved], ids[root[moved]])


def _search(batches: Iterator[pa.RecordBatch], limit: int, shared: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; lists longer than ``limit`` come back as they are.

    Pairs of blocks (``mine`` is not -1) are as long as was planned and are compared.
    """
    held: list[pa.RecordBatch] = []
    size, last, most = 0, None, limit

    def long(part: pa.RecordBatch) -> pa.RecordBatch:
        return _batch(_LONG, part.column("c"), n=part.column("n"), rest=part)

    def done() -> Iterator[pa.RecordBatch]:
        if held and 1 < size <= most:
            yield from _compare(pa.Table.from_batches(held).combine_chunks().to_batches()[0], shared, cosine)

    for batch in batches:
        keys = batch.column("key").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if keys[a] != last:
                yield from done()
                held, size, last = [], 0, keys[a]
                most = limit if part.column("mine")[0].as_py() < 0 else 1 << 62
            size += b - a
            if size <= most:
                held.append(part)
            else:
                yield from map(long, held)
                yield long(part)
                held = []
    yield from done()


def _refine(batches: Iterator[pa.RecordBatch], shared: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows of too long lists under the next pivot, or in pairs of blocks where no more are needed."""
    for batch in batches:
        key, c, n = (batch.column(x).to_numpy() for x in ("key", "a", "n"))
        paths, vectors, pivots = (batch.column(x).to_pylist() for x in ("path", "vector", "pivots"))
        out: list[tuple] = []
        for i, path in enumerate(paths):
            last = int(np.frombuffer(path, np.uint16)[-1])
            if len(path) < 2 * min(shared, len(pivots[i]) // 2):
                out.extend((i, path + p.tobytes(), int(p), -1, -1) for p in np.frombuffer(pivots[i], np.uint16) if p > last)
            else:
                own = int(c[i]) % blocks
                out.extend((i, path, 1 << 32 | min(own, x) << 16 | max(own, x), own, x) for x in range(blocks))
        if not out:
            continue
        row, path, step, mine, other = zip(*out, strict=True)
        row = np.array(row)
        yield _listed(_mixed(key[row], np.array(step)), path, c[row], n[row], [vectors[i] for i in row], [pivots[i] for i in row],
                      np.array(mine), np.array(other))


def links(classes: DataFrame, cosine: float = COSINE, pivots: int = PIVOTS, k: int = NEAREST, shared: int = SHARED, limit: int = LIST):
    """(stars, counts): links (a, b) that span the components, and (c, n) numbers of links to other classes.

    ``classes`` holds distinct usable vectors (c, v, n): a number, the vector, its copies.
    """
    spark = classes.sparkSession
    ship(spark)
    sample = [r.v for r in classes.select("v").orderBy(F.xxhash64("v"), "c").limit(SAMPLE).collect()]  # SAMPLE vectors at most
    rows = classes.mapInArrow(partial(_index, sample=sample, count=pivots, k=k, shared=shared), LISTED_DDL)
    parts = []
    while True:
        dealt = rows.repartition("key").sortWithinPartitions("key")
        found = cut_lineage(dealt.mapInArrow(partial(_search, limit=limit, shared=shared, cosine=cosine), FOUND_DDL))
        parts.append(found.where(f"kind <> {_LONG}"))
        over = found.where(f"kind = {_LONG}")
        longest = over.groupBy("key").count().agg(F.max("count")).first()[0]
        if longest is None:
            break
        blocks = min(1 << 15, -(-3 * longest // limit))  # a pair of blocks is two thirds of a list
        rows = over.mapInArrow(partial(_refine, shared=shared, blocks=blocks), LISTED_DDL)
    all_found = parts[0]
    for p in parts[1:]:
        all_found = all_found.unionByName(p)
    stars = all_found.where(f"kind = {_LINK}").select("a", "b")
    counts = all_found.where(f"kind = {_COUNT} and n > 0").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("n"))
    return stars, counts


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", **index) -> DataFrame:
    """A row per vector: n_links, component_id, kept.

    Vectors link at a cosine of COSINE or more; those of different length, and unusable ones,
    with nothing.  Equal vectors are one class, whose members all link.  NULL ids link but name
    no component: one of such rows alone has a NULL component_id, and is kept.  Repeated rows
    are vectors of their own.  An empty table gives an empty result.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"))
    rows = rows.withColumn("ok", usable(F.col("v"))).withColumn("c", F.when(F.col("ok"), F.xxhash64("v")))
    classes = cut_lineage(rows.where("ok").groupBy("v").agg(F.first("c").alias("c"), F.min("id").alias("first"), F.count("*").alias("n")))
    stars, counts = links(classes.select("c", "v", "n"), **index)
    roots = components(stars)
    told = classes.select("c", "first", "n").join(counts.withColumnRenamed("n", "links"), "c", "left").join(
        roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = told.groupBy("root").agg(F.min("first").alias("component"))
    told = cut_lineage(told.join(least, "root").select("c", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component"))
    usual = rows.where("ok").select("id", "c").join(told, "c").select("id", "links", "component")
    lone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = usual.unionByName(lone)
    return out.select(F.col("id").alias(vec_id), F.col("links").alias("n_links"), F.col("component").alias("component_id"),
                      F.col("id").eqNullSafe(F.col("component")).alias("kept"))
