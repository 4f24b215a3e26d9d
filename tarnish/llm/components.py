"""Connected components of a link table, by Spark joins and aggregations.

A round makes every node point at the smallest node it knows (large star) and hands that
node on to its other neighbours (small star); the number of rounds grows with the logarithm
of the longest chain.  Rounds end in the shared folder, so a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnish.session import cut_lineage, ship

LINKS_DDL = "a long, b long"
#: Links that a task merges in memory before it passes a forest on.
MERGE = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link from every node to the smallest node of its component, within these links."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(ends[: len(a)].tolist(), ends[len(a):].tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.fromiter((top(x) for x in range(len(nodes))), dtype=np.int64, count=len(nodes))
    moved = roots != np.arange(len(nodes))
    return nodes[moved], nodes[roots[moved]]


def links_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of a task by forests; no link between components is lost."""
    held, size = [], 0
    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        size += batch.num_rows
        if size >= MERGE:
            yield links_batch(*forest(*map(np.concatenate, zip(*held, strict=True))))
            held, size = [], 0
    if size:
        yield links_batch(*forest(*map(np.concatenate, zip(*held, strict=True))))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every link points down: from ``a`` to a smaller ``b``."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    handed = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(handed).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): the smallest node reachable.

    Links to itself, repeated links and NULL ends add nothing; without links the result is empty.
    """
    ship(links.sparkSession)
    clean = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = cut_lineage(clean.mapInArrow(merge_batches, LINKS_DDL).distinct())
    mark = _mark(now)
    while mark[0]:
        now = cut_lineage(_small_star(_large_star(now)))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
