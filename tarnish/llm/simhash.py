"""Near-duplicate texts by SimHash fingerprints and covering masks.

Fingerprints of 64 bits link where at most ``RADIUS`` = 4 bits differ.  Every bit position
gets a non-zero vector m(i) of RADIUS + 1 bits; the table of a non-zero vector v compares the
positions with <m(i), v> = 1 (mod 2).  The vectors of any four positions leave some v that is
orthogonal to all of them, and in that table the four are not compared: each pair within the
radius collides in at least one of the 2^5 - 1 tables, whatever the data.

A bucket that is too large for a task is refined, never cut: its fingerprints agree on the
compared positions, so the others are dealt into RADIUS + 1 blocks, and a pair within the
radius agrees on a whole block.  Distinct fingerprints of a bucket with 12 open positions are
at most 4,096, so refining ends; with RADIUS or fewer open positions all of a bucket link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tarnish.llm.common import fresh
from tarnish.llm.components import components, forest
from tarnish.session import cut_lineage, ship

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of one bucket that a task compares in memory.
BUCKET = 4096
FOUND_DDL = "a long, b long, open long, over boolean"
REFINED_DDL = "key long, fp long, open long"
_WAYS = 2 ** (RADIUS + 1) - 1


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def masks() -> list[int]:
    """The compared positions of each table, as 64-bit masks."""
    return [sum(1 << i for i in range(64) if ((i % _WAYS + 1) & v).bit_count() % 2) for v in range(1, _WAYS + 1)]


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint: bit set where over half of the shingles' hashes have it."""
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space parts
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = list(accumulate((len(t) + 1 for t in tokens)))
    starts = [0, *ends[: -SHINGLE]]
    hashes = np.array([xxhash.xxh64_intdigest(line[a:b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1:] or ends[-1:])],
                      dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([_signed(fingerprint(t)) for t in batch], dtype="int64")


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a BIGINT with the same bits."""
    return F.pandas_udf(_fingerprints, "long")(text)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _close_pairs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links within the buckets; rows are sorted by key."""
    a, b = [], []
    edges = np.flatnonzero(np.diff(key)) + 1
    sizes = np.diff(np.concatenate([[0], edges, [len(key)]]))
    first = np.repeat(np.concatenate([[0], edges]), sizes)
    left = np.repeat(sizes, sizes) - (np.arange(len(key)) - first) - 1  # later rows of the same bucket
    alive, shift = np.flatnonzero(left > 0), 1
    held = 0
    while len(alive):
        near = alive[np.bitwise_count(fp[alive] ^ fp[alive + shift]) <= RADIUS]
        a.append(fp[near])
        b.append(fp[near + shift])
        held += len(near)
        if held > 1_000_000:
            x, y = forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
            a, b, held = [x.view(np.uint64)], [y.view(np.uint64)], 0
        shift += 1
        alive = alive[left[alive] >= shift]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))


def _search(batches: Iterator[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
    """Links of whole buckets; rows come sorted by key and open positions, a bucket ends where they change."""
    def out(a, b, free, over):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(free, pa.int64()),
                                           pa.array(np.full(len(a), over))], ["a", "b", "open", "over"])

    def whole(key, fp):
        a, b = _close_pairs(key, fp.view(np.uint64))
        return out(a, b, np.zeros(len(a), np.int64), False)

    held = [np.zeros(0, np.int64)] * 3
    passing = None  # the key of a bucket that has already overflowed
    for batch in batches:
        new = [batch.column(c).to_numpy() for c in ("key", "fp", "open")]
        if passing is not None:
            n = int(np.searchsorted(new[0], passing, side="right"))
            if n:
                yield out(new[1][:n], new[0][:n], new[2][:n], True)
            new = [x[n:] for x in new]
            if not len(new[0]):
                continue
            passing = None
        key, fp, free = (np.concatenate(x) for x in zip(held, new, strict=True))
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        held = [key[last:], fp[last:], free[last:]]
        yield from _sorted_buckets(key[:last], fp[:last], free[:last], bucket, whole, out)
        if len(held[0]) > bucket:
            passing = held[0][0]
            yield out(held[1], held[0], held[2], True)
            held = [np.zeros(0, np.int64)] * 3
    yield from _sorted_buckets(*held, bucket, whole, out)


def _sorted_buckets(key, fp, free, bucket, whole, out):
    if not len(key):
        return
    _, counts = np.unique(key, return_counts=True)
    size = np.repeat(counts, counts)
    large = size > bucket
    if large.any():
        yield out(fp[large], key[large], free[large], True)
    rest = (size > 1) & ~large
    if rest.any():
        yield whole(key[rest], fp[rest])


def blocks_of(mask: int) -> list[int]:
    """The open positions dealt into RADIUS + 1 blocks."""
    bits = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << i for i in bits[j::RADIUS + 1]) for j in range(RADIUS + 1)]


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of too large buckets, once for each block of their open positions."""
    for batch in batches:
        fp, key, free = (batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b", "open"))
        for mask in np.unique(free):
            mine = free == mask
            for j, block in enumerate(blocks_of(int(mask))):
                agreed = fp[mine] & np.uint64(block)
                with np.errstate(over="ignore"):
                    x = (key[mine] ^ agreed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1)
                    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    x ^= x >> np.uint64(32)
                left = np.full(len(x), mask & ~np.uint64(block), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (x, fp[mine], left)], ["key", "fp", "open"])


def close_links(prints: DataFrame, fp: str = "fp", bucket: int = BUCKET) -> DataFrame:
    """(a, b) fingerprints that span the components of all pairs within the radius.

    ``prints`` holds distinct fingerprints.  Buckets are dealt by key and read in key order,
    so a task holds one bucket of at most ``bucket`` rows; larger ones come back refined.
    """
    if bucket < 2**RADIUS:
        raise ValueError(f"bucket must be at least {2**RADIUS}: so many fingerprints may differ in {RADIUS} positions")
    ship(prints.sparkSession)
    tables = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(_signed(m)).alias("m")) for v, m in enumerate(masks())])
    rows = prints.select(F.col(fp).alias("fp"), F.explode(tables).alias("t")).select(
        F.xxhash64("t.v", F.col("fp").bitwiseAND(F.col("t.m"))).alias("key"), "fp",
        F.bitwise_not("t.m").alias("open"))
    links = None
    while True:
        found = cut_lineage(rows.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_search, bucket=bucket), FOUND_DDL))
        part = found.where("not over").select("a", "b")
        links = part if links is None else links.unionByName(part)
        over = found.where("over")
        if over.isEmpty():
            return links
        rows = over.mapInArrow(_refine, REFINED_DDL).distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, fp, root, first): a row per row of ``docs``.

    ``root`` is the smallest fingerprint reachable, ``first`` the smallest id reachable.
    NULL or blank texts have fingerprint zero and link like any other; NULL ids count as no id
    (a class of only such rows has a NULL ``first``); repeated rows stay.  ``text_hash`` tells
    apart rows that share an id.  An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    keyed = cut_lineage(docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
                                    fingerprint_column(F.col(text)).alias("fp")))
    prints = cut_lineage(keyed.groupBy("fp").agg(F.min("id").alias("id")))
    stars = components(close_links(prints.select("fp")))
    rooted = prints.join(stars, prints.fp == stars.node, "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("id").alias("first"))
    member = cut_lineage(rooted.join(first, "root").select("fp", "root", "first"))
    return keyed.join(member, "fp").select("id", "text_hash", "fp", "root", "first")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``.  See ``classes``."""
    return classes(docs, doc_id, text).select(F.col("id").alias(doc_id), hexadecimal(F.col("fp")).alias("fingerprint"),
                                              F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: that with the smallest id; all columns of ``docs`` stay.

    A row is found again by id and text, so rows that share an id are told apart, and of
    repeated rows one stays.
    """
    known, hashed, n = fresh(docs, "kept_id", "kept_hash", "copy")
    least = classes(docs, doc_id, text).groupBy("root").agg(F.min_by(
        F.struct("id", "text_hash"), F.struct(F.col("id").isNull(), "id", "text_hash")).alias("k"))
    kept = least.select(F.col("k.id").alias(known), F.col("k.text_hash").alias(hashed))
    wide = docs.withColumn(hashed, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    # Rows of one id and text are copies: a running number keeps the first of them.
    same = wide.join(kept.withColumnRenamed(hashed, n), (F.col(doc_id).eqNullSafe(F.col(known))) & (F.col(hashed) == F.col(n)), "left_semi")
    order = W.partitionBy(doc_id, hashed).orderBy(hashed)
    return same.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).drop(n, hashed)
