"""Merkle trees over a table, one per group and one over the groups, by pivots of slots.

A parent's children are spread into as many columns as the fanout, by conditional aggregates;
the columns joined together are what the parent hashes, and without its own column they are
what a child needs to prove itself.  Rows are numbered within their group by a range sort and
counts per partition.  Several levels are climbed at once within blocks of neighbouring nodes,
which come together by one exchange; the proofs of a block's leaves travel up with its nodes,
so a block, and any row, holds a bounded number of them.  Of each block one node climbs on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnish.session import cut_lineage

#: Leaves of a block, at most.
BLOCK = 256
STEP = "struct<before:string,after:string>"


def field(value: Column) -> Column:
    """A value as it goes into a leaf: ``-`` for NULL, else its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def siblings(path: Column) -> Column:
    """All siblings from the leaf up, each level's from left to right, joined together."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``i``, their position in their group ``g`` in the given order, and ``n``, its size.

    The order must tell all rows apart, so that a range sort can cut it anywhere.
    """
    by = ["g", *order]
    placed = cut_lineage(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    runs = placed.groupBy(part.alias("part"), "g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("c").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("part", "g", (before - F.col("first")).alias("shift"), F.sum("c").over(group).alias("n"))
    return placed.withColumn("part", part).join(runs, ["part", "g"]).withColumn("i", F.col("at") + F.col("shift")).drop("part", "shift", "at")


def _levels(fanout: int) -> int:
    """Levels whose subtrees fit a block."""
    levels = 1
    while fanout ** (levels + 1) <= BLOCK:
        levels += 1
    return levels


def _climbed(nodes: DataFrame, fanout: int) -> DataFrame:
    """(g, block, n, digest, members): some levels up; members are the nodes below with their paths.

    ``nodes`` are (g, i, n, digest, item).  A group that is down to one node stays as it is.
    """
    levels = _levels(fanout)
    block = F.expr(f"i div {fanout ** levels}")
    alone = F.array(F.struct(F.col("item"), F.array().cast(f"array<{STEP}>").alias("path")))
    now = nodes.select("g", block.alias("block"), "i", "n", "digest", alone.alias("members")).repartition("g", "block")
    none = F.array().cast(now.schema["members"].dataType)
    digests = [F.col(f"c{s}.digest") for s in range(fanout)]
    for _ in range(levels):
        slot = F.col("i") % fanout
        children = [F.any_value(F.when(slot == s, F.struct("digest", "members")), True).alias(f"c{s}") for s in range(fanout)]
        up = now.groupBy("g", "block", F.expr(f"i div {fanout}").alias("parent")).agg(F.max("n").alias("size"), *children)
        steps = [F.struct(F.concat_ws("", *digests[:s]).alias("before"), F.concat_ws("", *digests[s + 1:]).alias("after")) for s in range(fanout)]
        longer = [F.coalesce(_extended(F.col(f"c{s}.members"), step), none) for s, step in enumerate(steps)]
        now = up.select("g", "block", F.col("parent").alias("i"), F.ceil(F.col("size") / fanout).cast("long").alias("n"),
                        F.when(F.col("size") > 1, F.sha2(F.concat_ws("", *digests), 256)).otherwise(digests[0]).alias("digest"),
                        F.concat(*longer).alias("members"))
    return now.drop("i")


def _extended(members: Column, step: Column) -> Column:
    """Members whose paths go one step further, unless their group (of ``size`` nodes) has ended."""
    more = F.when(F.col("size") > 1, F.array(step)).otherwise(F.array().cast(f"array<{STEP}>"))
    return F.transform(members, lambda m: F.struct(m["item"].alias("item"), F.concat(m["path"], more).alias("path")))


def _trees(nodes: DataFrame, fanout: int, crowned: bool) -> DataFrame:
    """(item, path, top, root) of each node; ``top`` is its group's root.

    With ``crowned`` the groups' roots are the leaves of one more tree, which paths and ``root``
    include; else ``root`` is ``top``.
    """
    strides, now = [], nodes
    while True:
        strides.append(cut_lineage(_climbed(now, fanout)))
        now = strides[-1].select("g", F.col("block").alias("i"), "n", "digest", F.struct("block").alias("item"))
        if (strides[-1].agg(F.max("n")).first()[0] or 1) == 1:
            break
    above = strides[-1].select("g", "block", F.col("digest").alias("top"))
    if crowned:
        groups = _numbered(above.select(F.lit("").alias("g"), F.struct("g").alias("item"), F.col("top").alias("digest"), F.col("g").alias("key")), ["key"])
        crown = _trees(groups, fanout, False).select(F.col("item.g").alias("g"), F.col("path").alias("rest"), "root")
        above = above.join(crown, "g")
    else:
        above = above.withColumns({"rest": F.array().cast(f"array<{STEP}>"), "root": F.col("top")})
    for k, stride in enumerate(reversed(strides)):
        found = stride.select("g", "block", F.explode("members").alias("m")).join(above, ["g", "block"])
        found = found.select("g", "m.item", F.concat("m.path", "rest").alias("path"), "top", "root")
        if k < len(strides) - 1:
            above = found.select("g", F.col("item.block").alias("block"), F.col("path").alias("rest"), "top", "root")
    return found.drop("g")


def prove(rows: DataFrame, leaf: Column, group: str, order: str, carry: list[Column], fanout: int = 2) -> DataFrame:
    """The ``carry`` columns of each row with its ``leaf``, ``subroot``, ``root`` and ``path``.

    Each group's leaves ascend by ``order`` (NULL first, then equal ones by their leaf); while
    several nodes remain, every ``fanout`` consecutive ones, the last run perhaps fewer, become
    the hash of their digests.  The groups' roots, NULL group first and then by bytes, make the
    root in the same way.  ``path`` holds for each level the digests ``before`` and ``after`` the
    own one.  Rows that repeat are leaves of their own; an empty table gives an empty result;
    columns of ``rows`` may have any names.  ``group`` is compared as text.
    """
    if fanout < 2:
        raise ValueError("a tree needs a fanout of 2 at least")
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = cut_lineage(rows.select(key.alias("g"), F.col(order).alias("o"), leaf.alias("digest"), F.struct(*carry).alias("item"),
                                     F.monotonically_increasing_id().alias("row")))
    nodes = _numbered(leaves, ["o", "digest", "row"]).select(
        "g", "i", "n", "digest", F.struct(F.col("item"), F.col("digest")).alias("item"))
    done = _trees(nodes, fanout, True)
    return done.select("item.item.*", F.col("item.digest").alias("leaf"), F.col("top").alias("subroot"), "root", "path")
