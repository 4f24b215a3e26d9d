"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

The first pass writes a narrow row per document, its normalised length and the hash of its
beginning.  Lengths that occur once are settled there; of the rest, beginnings that occur once.
Only documents that share both get a hash of their whole content, in a second scan, and only
their narrow rows are shuffled by it.  What survives a step is told by a bit map of slots that
hold two rows or more: a slot that two keys share lets a row through, never loses one.  The bit
maps have a fixed greatest size and go to the scan by broadcast, so no text is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tarnish.llm.common import fresh
from tarnish.session import cut_lineage

#: White space that does not count: space and the control characters tab to carriage return.
IGNORED = " \t\n\x0b\x0c\r"
#: Code points of the normalised text that the second step hashes.
PREFIX = 128
#: Slots of the lengths, and the most slots of the beginnings; 64 slots are a row of the bit map.
LENGTH_SLOTS, MOST_SLOTS = 1 << 16, 1 << 24
#: Groups of more than a ``SHARE``-th of all rows (and at least ``LEAST``) are joined by broadcast.
SHARE, LEAST = 2000, 64


def normalised(text: Column) -> Column:
    """The text without ASCII white space; NULL is empty."""
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def _shared(keys: DataFrame, key: Column, slots: int) -> DataFrame:
    """(w, b): 64 slots a row, a bit for each slot that two rows or more fall into."""
    full = keys.groupBy(F.pmod(key, F.lit(slots)).cast("long").alias("p")).count().where("count > 1")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    return cut_lineage(full.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b")))


def _surviving(rows: DataFrame, key: Column, slots: int, shared: DataFrame, name: str) -> DataFrame:
    """``rows`` with the flag ``name``: their slot is shared.  At most slots / 64 rows are broadcast."""
    slot = F.pmod(key, F.lit(slots)).cast("long")
    words = shared.select(F.col("w").alias(f"{name}_w"), F.col("b").alias(f"{name}_b"))
    met = rows.join(F.broadcast(words), F.shiftright(slot, 6) == F.col(f"{name}_w"), "left")
    flag = F.coalesce(F.getbit(f"{name}_b", (slot % 64).cast("int")) == 1, F.lit(False))
    return met.withColumn(name, flag).drop(f"{name}_w", f"{name}_b")


def mark(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None,
         digests: Callable[[Column], dict[str, Column]] | None = None, most_slots: int = MOST_SLOTS) -> DataFrame:
    """A row per document: its id, ``keep_id``, ``group_size`` and ``kept``, and the columns to ``carry``.

    Of equal normalised texts the row with the most code points in its original text stays, then
    that with the smallest id; ``keep_id`` is its id.  A NULL text is empty and so equal to white
    space; a NULL id comes after all others.  Of rows that share id and text one stays.  An empty
    table gives an empty result.  Columns of ``docs`` may have any names; those carried under
    the names above are replaced.  ``digests`` makes further columns of the normalised text.
    """
    names = [c for c in (carry or []) if c not in (doc_id, "keep_id", "group_size", "kept")]
    body, size, length, start, alike, same, full, row, best = fresh(
        docs, "x_body", "x_size", "x_length", "x_start", "x_alike", "x_same", "x_full", "x_row", "x_best")
    extra = digests(F.col(body)) if digests else {}
    cleaned = docs.withColumn(body, normalised(F.col(text)))
    lengths, starts = F.length(body), F.xxhash64(F.length(body), F.substring(body, 1, PREFIX))

    narrow = cut_lineage(cleaned.select(lengths.alias(length), starts.alias(start)))
    by_length = _shared(narrow, F.col(length), LENGTH_SLOTS)
    left = _surviving(narrow, F.col(length), LENGTH_SLOTS, by_length, alike).where(alike)
    slots = max(64, min(most_slots, 1 << (8 * left.count()).bit_length()))
    by_start = _shared(left, F.col(start), slots)

    rows = cleaned.withColumns({size: F.length(text), length: lengths, start: starts})
    rows = _surviving(rows, F.col(length), LENGTH_SLOTS, by_length, alike)
    rows = _surviving(rows, F.col(start), slots, by_start, same)
    hashed = F.when(F.col(alike) & F.col(same), F.sha2(body, 256))
    rows = cut_lineage(rows.select(doc_id, *names, *[c.alias(n) for n, c in extra.items()], F.coalesce(size, F.lit(0)).alias(size),
                                   hashed.alias(full), F.monotonically_increasing_id().alias(row)))
    return _kept(rows, doc_id, [doc_id, *names, *extra], size, full, row, best)


def _kept(rows: DataFrame, doc_id: str, names: list[str], size: str, full: str, row: str, best: str) -> DataFrame:
    first = F.min(F.struct(-F.col(size), F.col(doc_id).isNull(), F.col(doc_id).alias("id"), F.col(row).alias("row")))
    met = rows.where(F.col(full).isNotNull())
    groups = met.groupBy(full).agg(F.count(F.lit(1)).alias("group_size"), first.alias(best))
    groups = cut_lineage(groups.select(full, "group_size", F.col(f"{best}.id").alias("keep_id"), F.col(f"{best}.row").alias(best)))
    # fewer than SHARE groups are large; the rows of a smaller one fit a task
    large = F.col("group_size") > max(LEAST, rows.count() // SHARE)
    heavy, light = F.broadcast(groups.where(large)), groups.where(~large & (F.col("group_size") > 1))

    def done(frame: DataFrame) -> DataFrame:
        return frame.select(*names, "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col(best) == F.col(row)).alias("kept"))

    plain = met.drop("keep_id", "group_size", best)
    rest = plain.join(F.broadcast(groups.where(large).select(full)), full, "left_anti")
    alone = {"keep_id": F.col(doc_id), "group_size": F.lit(1).cast("long"), best: F.col(row)}
    out = done(rows.where(F.col(full).isNull()).withColumns(alone)).unionByName(done(plain.join(heavy, full)))
    settled = rest.join(light, full, "left").withColumns(
        {"keep_id": F.when(F.col(best).isNull(), F.col(doc_id)).otherwise(F.col("keep_id")),
         "group_size": F.coalesce("group_size", F.lit(1)), best: F.coalesce(best, F.col(row))})
    return out.unionByName(done(settled))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; ids, NULL texts and ties as in ``mark``."""
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    marked = mark(inner, at[doc_id], at[text], carry=list(at.values()))
    return marked.where("kept").select(*[F.col(at[c]).alias(c) for c in docs.columns])
