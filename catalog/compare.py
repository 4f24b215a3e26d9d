"""Run registered queries against their SQL in DuckDB and compare the rows.

    python -m catalog.compare [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

from pyspark.sql import SparkSession

from catalog import load_all
from tarnish.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _cell(x: object) -> object:
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        x = float(x)
        return "nan" if math.isnan(x) else f"{round(x, 6) + 0.0:.6f}"
    if isinstance(x, dict):
        return str(sorted((k, _cell(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return _cell(x.asDict())
    if isinstance(x, (list, tuple)):
        return str([_cell(v) for v in x])
    return str(x)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(_cell(r[n]) for n in names) for r in df.collect())


def duck_rows(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    out = con.execute(sql)
    columns = [d[0] for d in out.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = sorted(tuple(_cell(r[i]) for i in order) for r in out.fetchall())
    return [columns[i] for i in order], rows


def check(spark: SparkSession, folder: str, name: str) -> tuple[bool, str]:
    query = load_all()[name]
    t0 = time.time()
    names, rows = spark_rows(query.run(spark, folder))
    took = time.time() - t0
    if query.sql is None:
        return True, f"{len(rows)} rows, no SQL, {took:.1f}s"
    t0 = time.time()
    other, expected = duck_rows(folder, query.sql)
    note = f"{len(rows)}/{len(expected)} rows, {took:.1f}s, sql {time.time() - t0:.1f}s"
    if names != other:
        return False, f"{note}; columns {names} / {other}"
    if rows != expected:
        odd = [(a, b) for a, b in zip(rows, expected) if a != b][:2]
        return False, f"{note}; differ: {odd}"
    return True, note


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session("compare")
    bad = []
    for name in args or list(load_all()):
        try:
            ok, note = check(spark, folder, name)
        except Exception as error:  # noqa: BLE001  (report and go on with the next query)
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(("ok   " if ok else "FAIL ") + f"{name}: {note}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
