"""Mergeable summaries of a column's order, with guaranteed ranks.

A summary holds some values of a column in ascending order.  Of each it knows how many values
are certainly not above it, and how many at most lie below it.  Sorting a run of values gives
exact numbers; merging two summaries adds the numbers of the neighbours, and thinning drops
entries, so the numbers of the rest stay true.  So every position of the order gets a bracket
that holds its value for certain, whatever the order of the rows: no sample, no second try.

Tasks summarise what they read, groups of tasks merge, the driver merges the groups; what it
gets is a small fixed number of entries per column and 256 tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tarnish.session import ship

#: Values sorted at once, entries of a summary, and bytes of text in one.
RUN = 1 << 16
ENTRIES = 2048
TEXT_BYTES = 1 << 18
#: Tasks whose summaries are merged in one.
FAN_IN = 256


@dataclass(frozen=True)
class Summary:
    """``le[i]``: so many values at least are <= values[i]; ``lt[i]``: so many at most are < values[i]."""

    values: np.ndarray
    le: np.ndarray
    lt: np.ndarray
    rows: int

    @staticmethod
    def of(run: pa.Array, entries: int = ENTRIES) -> "Summary":
        """Of values without missing ones; exact."""
        n = len(run)
        ordered = run.take(pc.sort_indices(run))
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = pc.not_equal(ordered.slice(1), ordered.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        lt = np.flatnonzero(new)
        le = np.append(lt[1:], n)
        kept = _spread(lt, le, n, _entries(ordered, entries))
        return Summary(ordered.take(pa.array(lt[kept])).to_numpy(zero_copy_only=False), le[kept].astype(np.int64), lt[kept].astype(np.int64), n)

    @staticmethod
    def merged(parts: list["Summary"], entries: int = ENTRIES) -> "Summary":
        if len(parts) == 1:
            return parts[0]
        values = np.unique(np.concatenate([p.values for p in parts]))
        le, lt = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        for p in parts:
            le += np.append(0, p.le)[np.searchsorted(p.values, values, "right")]
            lt += np.append(p.lt, p.rows)[np.searchsorted(p.values, values, "left")]
        rows = sum(p.rows for p in parts)
        if values.dtype == object and isinstance(values[0], str):
            entries = max(16, min(entries, int(entries * TEXT_BYTES / max(1, sum(map(len, values)) * entries / len(values)))))
        kept = _spread(lt, le, rows, entries)
        return Summary(values[kept], le[kept], lt[kept], rows)

    def bracket(self, rank: int) -> tuple[object, object]:
        """Two values, the one at this 0-based position between them or one of them."""
        lo = self.values[np.searchsorted(self.lt, rank, "right") - 1]
        return lo, self.values[np.searchsorted(self.le, rank + 1, "left")]

    def within(self, lo: object, hi: object) -> int:
        """At most so many values lie strictly between two entries."""
        return max(0, int(self.lt[np.searchsorted(self.values, hi)] - self.le[np.searchsorted(self.values, lo)]))


def _entries(ordered: pa.Array, entries: int) -> int:
    if not pa.types.is_string(ordered.type) and not pa.types.is_large_string(ordered.type):
        return entries
    mean = max(1.0, (pc.sum(pc.binary_length(ordered)).as_py() or 0) / len(ordered))
    return max(16, min(entries, int(TEXT_BYTES / mean)))


def _spread(lt: np.ndarray, le: np.ndarray, rows: int, entries: int) -> np.ndarray:
    """The first, the last, and those nearest to evenly spaced positions."""
    if len(lt) <= entries:
        return np.arange(len(lt))
    at = np.searchsorted((lt + le) / 2, np.linspace(0, rows, entries))
    return np.unique(np.r_[0, np.minimum(at, len(lt) - 1), len(lt) - 1])


class _Column:
    """The values of one column of one task; merges summaries of equal weight, like a binary counter."""

    def __init__(self, entries: int):
        self.entries, self.blank, self.rows = entries, 0, 0
        self.held: list[pa.Array] = []
        self.size = 0
        self.levels: list[Summary | None] = []

    def add(self, array: pa.Array) -> None:
        self.blank += array.null_count
        self.rows += len(array)
        array = array.drop_null()
        self.held.append(array)
        self.size += len(array)
        if self.size >= RUN:
            self._fold()

    def _fold(self) -> None:
        done, self.held, self.size = Summary.of(pa.concat_arrays(self.held), self.entries), [], 0
        for k, level in enumerate(self.levels):
            if level is None:
                self.levels[k] = done
                return
            done, self.levels[k] = Summary.merged([level, done], self.entries), None
        self.levels.append(done)

    def finish(self) -> Summary | None:
        if self.size:
            self._fold()
        parts = [s for s in self.levels if s is not None]
        return Summary.merged(parts, self.entries) if parts else None


def _schema(kinds: list[pa.DataType]) -> pa.Schema:
    return pa.schema([("task", pa.int32()), ("j", pa.int32()), ("total", pa.int64()), ("blank", pa.int64()), ("rows", pa.int64()),
                      ("le", pa.list_(pa.int64())), ("lt", pa.list_(pa.int64())), *[(f"v{i}", pa.list_(k)) for i, k in enumerate(kinds)]])


def _ddl(kinds: list[str]) -> str:
    lanes = "".join(f", v{i} array<{k}>" for i, k in enumerate(kinds))
    return f"task int, j int, total bigint, blank bigint, rows bigint, le array<bigint>, lt array<bigint>{lanes}"


def _record(task: int, j: int, lane: int, total: int, blank: int, s: Summary | None) -> dict:
    if s is None:
        return {"task": task, "j": j, "total": total, "blank": blank, "rows": 0, "le": [], "lt": [], f"v{lane}": []}
    return {"task": task, "j": j, "total": total, "blank": blank, "rows": s.rows, "le": s.le.tolist(), "lt": s.lt.tolist(), f"v{lane}": s.values.tolist()}


def _summarise(batches: Iterator[pa.RecordBatch], lanes: list[int], kinds: list[pa.DataType], entries: int) -> Iterator[pa.RecordBatch]:
    columns = [_Column(entries) for _ in lanes]
    for batch in batches:
        for j, column in enumerate(columns):
            column.add(batch.column(j).cast(kinds[lanes[j]]))
    task = TaskContext.get().partitionId()
    rows = [_record(task, j, lanes[j], c.rows, c.blank, c.finish()) for j, c in enumerate(columns)]
    yield pa.RecordBatch.from_pylist(rows, schema=_schema(kinds))


def _restored(row: dict, lane: int, kind: pa.DataType) -> Summary | None:
    if not row["rows"]:
        return None
    values = pa.array(row[f"v{lane}"], kind).to_numpy(zero_copy_only=False)
    return Summary(values, np.array(row["le"], np.int64), np.array(row["lt"], np.int64), row["rows"])


def _joined(rows: list[dict], lane: int, kind: pa.DataType, entries: int) -> tuple[int, int, Summary | None]:
    parts = [s for s in (_restored(r, lane, kind) for r in rows) if s is not None]
    return sum(r["total"] for r in rows), sum(r["blank"] for r in rows), Summary.merged(parts, entries) if parts else None


def _merge(table: pa.Table, lanes: list[int], kinds: list[pa.DataType], entries: int) -> pa.Table:
    rows = table.to_pylist()
    j = rows[0]["j"]
    merged = _record(rows[0]["task"], j, lanes[j], *_joined(rows, lanes[j], kinds[lanes[j]], entries))
    return pa.Table.from_pylist([merged], schema=_schema(kinds))


def arrow_kinds(kinds: list[str]) -> list[pa.DataType]:
    """Arrow types of order values, by their Spark names."""
    plain = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    return [plain[k] if k in plain else pa.decimal128(*map(int, k[8:-1].split(","))) for k in kinds]


def summaries(values: DataFrame, kinds: list[str], lanes: list[int], entries: int = ENTRIES) -> list[tuple[int, int, Summary | None]]:
    """(rows, missing, summary of the rest) of every column of ``values``, in one scan.

    ``kinds`` are the distinct types of the columns and ``lanes`` says which each column has.
    """
    ship(values.sparkSession)
    types = arrow_kinds(kinds)
    ddl, how = _ddl(kinds), {"lanes": lanes, "kinds": types, "entries": entries}
    per_task = values.mapInArrow(partial(_summarise, **how), ddl)
    merged = per_task.groupBy((per_task.task / FAN_IN).cast("int").alias("g"), "j").applyInArrow(lambda table: _merge(table, **how), ddl)
    found: dict[int, list[dict]] = {}
    for row in merged.collect():
        found.setdefault(row["j"], []).append(row.asDict())
    return [_joined(found.get(j, []), lane, types[lane], entries) for j, lane in enumerate(lanes)]
