"""Distinct values: small sets that stop at a limit, and the commonest value of columns with long texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tarnish.operators.ranks import literal_rows
from tarnish.session import cut_lineage, ship

#: Tasks whose sets are merged in one.
FAN_IN = 256
#: Hashes of candidates that may be broadcast.
CANDIDATES = 200_000

SETS_DDL = "task int, c int, over boolean, v array<string>"
_SETS = pa.schema([("task", pa.int32()), ("c", pa.int32()), ("over", pa.bool_()), ("v", pa.list_(pa.string()))])


def _rows(task: int, found: dict[int, set[str] | None]) -> pa.RecordBatch:
    rows = [{"task": task, "c": c, "over": values is None, "v": [] if values is None else sorted(values)} for c, values in found.items()]
    return pa.RecordBatch.from_pylist(rows, schema=_SETS)


def _collected(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """A task's set of each column; one that passes the limit is given up, and not looked at again."""
    found: dict[int, set[str] | None] = {}
    for batch in batches:
        for c in range(batch.num_columns):
            held = found.setdefault(c, set())
            if held is not None:
                held.update(v for v in pc.unique(batch.column(c)).to_pylist() if v is not None)
                if len(held) > limit:
                    found[c] = None
    yield _rows(TaskContext.get().partitionId(), found)


def _united(rows: list[dict], limit: int) -> set[str] | None:
    out: set[str] = set()
    for row in rows:
        out.update(row["v"])
        if row["over"] or len(out) > limit:
            return None
    return out


def _merged(table: pa.Table, limit: int) -> pa.Table:
    rows = table.to_pylist()
    return pa.Table.from_batches([_rows(rows[0]["task"], {rows[0]["c"]: _united(rows, limit)})])


def capped_sets(df: DataFrame, columns: list[str], limit: int) -> dict[str, set[str] | None]:
    """The distinct values of each column as text, without NULL; None for a column with more than ``limit``.

    Exact, in one scan: a set stops at ``limit`` + 1, so tasks, merges and the driver hold a bounded
    number of values, and a column with many values costs nothing more once that is known.
    """
    if not columns:
        return {}
    ship(df.sparkSession)
    values = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    per_task = values.mapInArrow(partial(_collected, limit=limit), SETS_DDL)
    merged = per_task.groupBy((F.col("task") / FAN_IN).cast("int").alias("g"), "c").applyInArrow(lambda t: _merged(t, limit), SETS_DDL)
    found: dict[int, list[dict]] = {}
    for row in merged.collect():
        found.setdefault(row["c"], []).append(row.asDict())
    return {name: _united(found.get(c, []), limit) for c, name in enumerate(columns)}


def _hashes(value: Column) -> list[Column]:
    """128 bits that stand for a value."""
    return [F.xxhash64(value).alias("h"), F.xxhash64(F.lit(1), value).alias("k")]


def _cells(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("c"), text.alias("v")) for i, text in enumerate(texts.values())])
    return df.select(F.explode(cells).alias("x")).select("x.*").where(F.col("v").isNotNull())


def heads(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """(column, distinct, top_value, top_count): the commonest text of each column, the smallest of several.

    Only 128-bit hashes of the values are shuffled, so what moves does not grow with the length of
    the texts.  A second scan finds the texts behind the hashes that occur most often; it
    compares them where they lie and shuffles one value per task and column.
    """
    names = list(texts)
    counts = cut_lineage(_cells(df, texts).select("c", *_hashes(F.col("v"))).groupBy("c", "h", "k").agg(F.count(F.lit(1)).alias("n")))
    sizes = counts.groupBy("c").agg(F.count(F.lit(1)).alias("distinct"), F.max("n").alias("top_count")).collect()
    found = {r["c"]: {"column": names[r["c"]], "distinct": r["distinct"], "top_count": r["top_count"]} for r in sizes}
    for c, value in _smallest(df, {n: t for i, (n, t) in enumerate(texts.items()) if i in found and found[i]["top_count"] == 1}).items():
        found[names.index(c)]["top_value"] = value
    often = {c: r["top_count"] for c, r in found.items() if r["top_count"] > 1}
    if often:
        most = F.coalesce(*[F.when(F.col("c") == c, F.lit(n)) for c, n in often.items()])
        wanted = counts.where(F.col("n") == most).select("c", "h", "k")
        few = wanted.count() <= CANDIDATES
        cells = _cells(df, {n: t if i in often else F.lit(None).cast("string") for i, (n, t) in enumerate(texts.items())})
        near = cells.select("c", "v", *_hashes(F.col("v"))).join(F.broadcast(wanted) if few else wanted, ["c", "h", "k"], "left_semi")
        for r in near.groupBy("c").agg(F.min("v").alias("v")).collect():
            found[r["c"]]["top_value"] = r["v"]
    return literal_rows(df.sparkSession, list(found.values()), "column string, distinct bigint, top_value string, top_count bigint")


def _smallest(df: DataFrame, texts: dict[str, Column]) -> dict[str, str]:
    """The smallest text of each column all of whose values differ."""
    if not texts:
        return {}
    return dict(zip(texts, df.agg(*[F.min(t).alias(f"m{i}") for i, t in enumerate(texts.values())]).first()))
