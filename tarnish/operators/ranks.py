"""Exact order statistics and dense positions without a global sort in one task.

``positions`` finds the values that stand at given positions of the order of any number of
columns in two scans.  The first makes a summary that brackets every position for certain; the
second counts what lies between the brackets' ends and keeps only values inside one.  Those
few are cut by order, and the wanted value is read off a running count within one piece.

``draw_bounds`` does the same for uniform draws, whose bracket is known without a summary;
it settles rows chosen completely at random and rows that tie on a value.

Once the boundaries are known, "the k rows from position start on" is a comparison against
two constants, evaluated where each row already is.
"""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F, types as T

from tarnish.functions.rand import SALT_TYPE, Salt, micros, uniform
from tarnish.operators.summary import ENTRIES, arrow_kinds, summaries
from tarnish.session import cut_lineage

POSITION_BUCKET_ROWS = PIECE_ROWS = 500_000


def json_literal(value: object, ddl: str) -> Column:
    """A constant array or struct; folded into one literal when the query is planned."""
    return F.from_json(F.lit(json.dumps(value, default=str)), ddl)


def literal_rows(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small table from the driver as one literal; it takes no Python worker to read it."""
    kind = T.ArrayType(T.StructType.fromDDL(ddl))
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows, default=str)), kind)))


def order_value(df: DataFrame, name: str) -> Column:
    """The column in a form that can be collected and compared again without loss."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.nanvl(col.cast("double"), F.lit(None).cast("double"))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return col.cast("bigint")
    if isinstance(kind, T.BooleanType):
        return col.cast("int").cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(name, kind)
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("bigint")
    if isinstance(kind, (T.StringType, T.DecimalType)):
        return col
    raise ValueError(f"column {name!r} of type {kind.simpleString()} has no sort order here")


def order_struct(df: DataFrame, name: str) -> Column:
    """(missing last, value) as a comparable struct."""
    value = order_value(df, name)
    return F.struct(value.isNull().cast("int").alias("z"), value.alias("v"))


@dataclass(frozen=True)
class _Cuts:
    """The ends of a column's brackets, ascending, and which gaps between them lie in a bracket.

    Place 2i + 1 is the i-th end itself, place 2i the gap before it.
    """

    ends: list
    inside: np.ndarray

    @staticmethod
    def of(brackets: list[tuple]) -> "_Cuts":
        ends = sorted({end for bracket in brackets for end in bracket})
        at = {end: i for i, end in enumerate(ends)}
        inside = np.zeros(2 * len(ends) + 1, bool)
        for lo, hi in brackets:
            inside[2 * at[lo] + 2:2 * at[hi] + 1:2] = True
        return _Cuts(ends, inside)


def _place(batches: Iterator[pa.RecordBatch], cuts: list[_Cuts | None], lanes: list[int], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """(j, p, value, n): a task's rows by place; only those in a bracket's gaps with their value."""
    counts = [np.zeros(0 if c is None else len(c.inside), np.int64) for c in cuts]
    names = ["j", "p", *[f"v{i}" for i in range(len(kinds))], "n"]

    def rows(j: int, places: np.ndarray, values: pa.Array | None, n: np.ndarray) -> pa.RecordBatch:
        blank = [pa.nulls(len(n), k) for k in kinds]
        if values is not None:
            blank[lanes[j]] = values
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), j), pa.int32()), pa.array(places, pa.int32()), *blank, pa.array(n, pa.int64())], names)

    for batch in batches:
        for j, cut in enumerate(cuts):
            if cut is None:
                continue
            tally = pc.value_counts(batch.column(j).cast(kinds[lanes[j]]).drop_null())
            distinct, n = tally.field(0), tally.field(1).to_numpy(zero_copy_only=False)
            plain = distinct.to_numpy(zero_copy_only=False)
            ends = np.array(cut.ends, dtype=plain.dtype) if plain.dtype != object else cut.ends
            upto = np.array([bisect.bisect_right(ends, v) for v in plain]) if plain.dtype == object else np.searchsorted(ends, plain, "right")
            if not len(plain):
                continue
            hit = np.zeros(len(plain), bool)
            some = np.flatnonzero(upto)
            hit[some] = [ends[i] == v for i, v in zip(upto[some] - 1, plain[some])] if plain.dtype == object else ends[upto[some] - 1] == plain[some]
            places = 2 * upto - hit
            keep = cut.inside[places]
            np.add.at(counts[j], places[~keep], n[~keep])
            if keep.any():
                yield rows(j, places[keep], distinct.filter(pa.array(keep)), n[keep])
    for j, count in enumerate(counts):
        met = np.flatnonzero(count)
        if len(met):
            yield rows(j, met, None, count[met])


def _located(cells: DataFrame, order: list[str], targets: dict[int, list[int]], bound: float) -> list[Row]:
    """The cells at given positions of the running count ``n`` of each id in the given order.

    ``bound`` says how many cells an id has, about.  Up to ``PIECE_ROWS`` they are one piece;
    else Spark cuts them by order, and counts per piece tell the pieces that hold a target.
    Only there, within one piece, a running count is made.  A row has ``rank`` and ``below``.
    """
    wanted: dict[tuple[int, int], dict] = {}
    if bound <= PIECE_ROWS:
        pieces = cells.withColumn("_r", F.lit(0))
        wanted = {(i, 0): {"id": i, "_r": 0, "base": 0, "ranks": ranks} for i, ranks in targets.items() if ranks}
    else:
        pieces = cut_lineage(cells.repartitionByRange("id", *order).withColumn("_r", F.spark_partition_id()))
        sizes: dict[int, list[tuple[int, int]]] = {}
        for r in pieces.groupBy("id", "_r").agg(F.sum("n").alias("n")).collect():
            sizes.setdefault(r["id"], []).append((r["_r"], r["n"]))
        for i, ranks in targets.items():
            parts = sorted(sizes.get(i, []))
            upto = np.cumsum([n for _, n in parts])
            for rank in ranks:
                k = int(np.searchsorted(upto, rank, "right"))
                if k < len(parts):
                    found = wanted.setdefault((i, parts[k][0]), {"id": i, "_r": parts[k][0], "base": int(upto[k] - parts[k][1]), "ranks": []})
                    found["ranks"].append(rank)
    if not wanted:
        return []
    marked = literal_rows(cells.sparkSession, list(wanted.values()), "id int, _r int, base bigint, ranks array<bigint>")
    window = Window.partitionBy("id", "_r").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    upto = F.col("base") + F.sum("n").over(window)
    near = pieces.join(F.broadcast(marked), ["id", "_r"]).withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("n"))
    here = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("upto")))
    return near.withColumn("rank", F.explode(here)).drop("ranks", "base", "_r").collect()


def positions(df: DataFrame, wanted: dict[str, list[int]], entries: int | None = None) -> dict[str, dict[int, dict]]:
    """The values at 0-based positions of several columns, each in ascending order, missing last.

    Each answer holds the value ``v``, its missing flag ``z``, how many rows come before
    its first occurrence (``below``) and how many rows share it (``ties``).  Two scans of these
    columns answer everything: one summarises them, the other counts.
    """
    columns = [c for c, ranks in wanted.items() if ranks]
    if not columns:
        return {c: {} for c in wanted}
    values = df.select(*[order_value(df, c).alias(f"c{j}") for j, c in enumerate(columns)])
    names = [f.dataType.simpleString() for f in values.schema.fields]
    kinds = sorted(set(names))
    lanes = [kinds.index(n) for n in names]
    known = summaries(values, kinds, lanes, entries or ENTRIES)
    out: dict[str, dict[int, dict]] = {c: {} for c in wanted}
    cuts: list[_Cuts | None] = []
    bound = 0
    for c, (rows, blank, summary) in zip(columns, known):
        ranks = sorted(set(wanted[c]))
        if ranks[0] < 0 or ranks[-1] >= rows:
            raise ValueError(f"rank outside 0..{rows - 1}")
        out[c] = {r: {"z": 1, "v": None, "below": rows - blank, "ties": blank} for r in ranks if r >= rows - blank}
        inner = [r for r in ranks if r < rows - blank]
        cuts.append(_Cuts.of([summary.bracket(r) for r in inner]) if inner else None)
        bound = max([bound, sum(summary.within(*summary.bracket(r)) for r in inner) + 2 * len(inner)])
    if not any(cuts):
        return out
    lane_ddl = "".join(f", v{i} {k}" for i, k in enumerate(kinds))
    placed = values.mapInArrow(partial(_place, cuts=cuts, lanes=lanes, kinds=arrow_kinds(kinds)), f"j int, p int{lane_ddl}, n bigint")
    lane_names = [f"v{i}" for i in range(len(kinds))]
    cells = placed.groupBy(F.col("j").alias("id"), "p", *lane_names).agg(F.sum("n").alias("n"))
    targets = {j: [r for r in sorted(set(wanted[c])) if r not in out[c]] for j, c in enumerate(columns)}
    for row in _located(cells, ["p", *lane_names], targets, bound):
        c, cut, lane = columns[row["id"]], cuts[row["id"]], lanes[row["id"]]
        value = cut.ends[row["p"] // 2] if row["p"] % 2 else row[f"v{lane}"]
        value = value.item() if isinstance(value, np.generic) else value
        out[c][row["rank"]] = {"z": 0, "v": value, "below": row["below"], "ties": row["n"]}
    if any(len(out[c]) != len(set(wanted[c])) for c in columns):
        raise ValueError("the table changed between two scans")
    return out


def values_at_ranks(df: DataFrame, column: str, ranks: list[int], entries: int | None = None) -> dict[int, dict]:
    """``positions`` of one column."""
    return positions(df, {column: list(ranks)}, entries)[column]


def draw_bounds(data: DataFrame, requests: list[dict], value_type: str | None = None) -> list[dict]:
    """For each request the ``need``-th smallest (draw, key), so ``<=`` marks exactly that many.

    ``data`` has ``_k`` and ``_v`` and, when ``value_type`` is given, an order struct ``o``;
    a request has ``salt``, ``need``, ``rows`` (how many rows take part) and optionally the
    value ``o`` its rows share.  Draws are uniform, so the bracket is known beforehand and
    holds about sqrt(rows) rows; one scan answers all requests together.
    """
    found: dict[int, dict] = {}
    todo = list(range(len(requests)))
    ddl = f"array<struct<id:int,lo:double,hi:double,salt:{SALT_TYPE}" + (
        f",o:{value_type}>>" if value_type else ">>")
    for sigmas in (6.0, 40.0, math.inf):
        if not todo:
            break
        items = []
        for i in todo:
            r = requests[i]
            q = r["need"] / r["rows"]
            spread = 10 / r["rows"] + (sigmas * math.sqrt(q * (1 - q) / r["rows"]) if q < 1 else 0.0)
            item = {"id": i, "salt": r["salt"].record(),
                    "lo": max(0.0, q - spread) if math.isfinite(spread) else 0.0,
                    "hi": min(1.0, q + spread) if math.isfinite(spread) else 1.0}
            items.append(item | ({"o": r["o"]} if value_type else {}))
        spread_out = data.withColumn("s", F.explode(json_literal(items, ddl)))
        if value_type:
            spread_out = spread_out.where(F.col("o") == F.col("s.o"))
        inside = F.col("u") >= F.col("s.lo")
        cells = (
            spread_out.withColumn("u", uniform(F.col("_v"), Salt.field(F.col("s.salt"))))
            .where(F.col("u") <= F.col("s.hi"))
            .groupBy(F.col("s.id").alias("id"), F.when(inside, F.col("u")).alias("u"), F.when(inside, F.col("_k")).alias("k"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        bound = max(requests[i]["rows"] * (item["hi"] - item["lo"]) for i, item in zip(todo, items))
        for r in _located(cells, ["u", "k"], {i: [requests[i]["need"] - 1] for i in todo}, bound):
            if r["u"] is None:
                continue  # below the bracket
            if r["n"] != 1:
                raise ValueError("the row key is not unique")
            found[r["id"]] = {"u": r["u"], "k": r["k"]}
        todo = [i for i in todo if i not in found]
    if todo:
        raise ValueError("the table changed between two scans")
    return [found[i] for i in range(len(requests))]


def dense_positions(df: DataFrame, draw: str, tie: str, rows: int, by: tuple[str, ...] = (),
                    into: str = "position", bucket_rows: int | None = None) -> DataFrame:
    """Number rows 0..n-1 in the order of a uniform draw, separately for each ``by`` group.

    ``rows`` is the largest group's size.  The draw cuts a group into equal buckets, a
    small table of bucket counts gives each bucket its offset, and only rows of one
    bucket are sorted together.
    """
    buckets = max(1, math.ceil(rows / (bucket_rows or POSITION_BUCKET_ROWS)))
    by = list(by)
    cut = df.withColumn("_b", F.floor(F.col(draw) * buckets).cast("bigint"))
    inner = Window.partitionBy(*by, "_b").orderBy(draw, tie)
    numbered = cut.withColumn("_r", F.row_number().over(inner).cast("bigint") - 1)
    if buckets == 1:
        return numbered.withColumn(into, F.col("_r")).drop("_b", "_r")
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
        .select(*by, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    )
    return (
        numbered.join(offsets, [*by, "_b"])
        .withColumn(into, F.col("_r") + F.col("_off")).drop("_b", "_r", "_off")
    )
