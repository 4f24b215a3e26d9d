"""Rank summaries: guaranteed brackets, two scans for all columns, and the stabbing index built on ranks."""

import random
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tarnish.operators import ranks, summary
from tarnish.operators.ranks import positions
from tarnish.operators.stabbing import StabbingIndex
from tarnish.operators.summary import Summary

RUNS = st.lists(st.lists(st.integers(-50, 50), min_size=1, max_size=120), min_size=1, max_size=9)


@settings(max_examples=60, deadline=None)
@given(runs=RUNS, entries=st.integers(2, 40), shape=st.sampled_from(["flat", "tree", "chain"]))
def test_every_position_lies_in_its_bracket(runs, entries, shape):
    parts = [Summary.of(pa.array(r, pa.int64()), entries) for r in runs]
    while len(parts) > 1:
        step = {"flat": len(parts), "tree": 2, "chain": 2}[shape]
        rest = parts[step:] if shape == "chain" else [Summary.merged(parts[i:i + step], entries) for i in range(step, len(parts), step)]
        parts = [Summary.merged(parts[:step], entries), *rest]
    values = sorted(v for r in runs for v in r)
    for rank in range(len(values)):
        lo, hi = parts[0].bracket(rank)
        assert lo <= values[rank] <= hi
    assert len(parts[0].values) <= entries + 2


def test_brackets_are_narrow():
    values = np.random.default_rng(3).permutation(200_000)
    parts = [Summary.of(pa.array(values[i:i + 5000]), 256) for i in range(0, 200_000, 5000)]
    while len(parts) > 1:
        parts = [Summary.merged(parts[i:i + 2], 256) for i in range(0, len(parts), 2)]
    widths = [hi - lo for lo, hi in (parts[0].bracket(r) for r in range(0, 200_000, 997))]
    assert max(widths) <= 200_000 * 20 / 256


def test_long_texts_take_fewer_entries():
    texts = pa.array([f"{i:05d}" + "x" * 4000 for i in range(3000)])
    held = Summary.of(texts)
    assert sum(map(len, held.values)) < 2 * summary.TEXT_BYTES and held.bracket(1500)[0] <= texts[1500].as_py() <= held.bracket(1500)[1]


def mixed(spark, n=3000, parts=7):
    rows = []
    draw = random.Random(4)
    for i in range(n):
        rows.append((i, i if i % 3 else 17, None if i % 11 == 0 else draw.choice([0.5, -0.0, 0.0, float("nan"), i / 7]),
                     None if i % 5 == 0 else draw.choice(["", "é", "z", "\U0001f600", f"w{i}"]), Decimal(i * 37 % 1000).scaleb(-2), i % 2 == 0))
    return spark.createDataFrame(rows, "id long, n long, x double, s string, d decimal(12,2), b boolean").repartitionByRange(parts, "id")


@pytest.mark.parametrize("piece", [500_000, 10])
def test_all_columns_at_once_equal_sorting(spark, monkeypatch, piece):
    monkeypatch.setattr(ranks, "PIECE_ROWS", piece)
    df = mixed(spark)
    scans = []
    real = ranks.summaries
    monkeypatch.setattr(ranks, "summaries", lambda *a, **k: scans.append(1) or real(*a, **k))
    wanted = {c: sorted({0, 1, 29, 1000, 1499, 1500, 2500, 2998, 2999}) for c in ("n", "x", "s", "d", "b")}
    found = positions(df, wanted, entries=5)
    assert len(scans) == 1
    for c in wanted:
        order = sorted(((r.v is None, r.v if r.v is not None else 0) for r in df.select(ranks.order_value(df, c).alias("v")).collect()))
        for r in wanted[c]:
            got = found[c][r]
            assert (got["z"] == 1, got["v"] if got["v"] is not None else 0) == order[r], (c, r)
            assert got["below"] == order.index(order[r]) and got["ties"] == order.count(order[r])


def test_values_that_hide_from_samples(spark):
    """A few rows at one end of one task hold the wanted positions; nothing has to be tried twice."""
    df = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") < 19_990, F.lit(5.0)).otherwise(F.col("id") / 2).alias("v"))
    found = positions(df, {"v": [0, 19_989, 19_990, 19_999]}, entries=2)["v"]
    assert [found[r]["v"] for r in (0, 19_989, 19_990, 19_999)] == [5.0, 5.0, 9995.0, 9999.5]
    assert found[0]["ties"] == 19_990 and found[19_990] == {"z": 0, "v": 9995.0, "below": 19_990, "ties": 1}


def test_empty_and_blank_columns(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "v double, w long")
    assert positions(df, {"v": [0, 1], "w": []}) == {"v": {r: {"z": 1, "v": None, "below": 0, "ties": 2} for r in (0, 1)}, "w": {}}
    with pytest.raises(ValueError):
        positions(df, {"w": [2]})


@pytest.mark.parametrize("bound", [1000, 10**9])
def test_positions_are_read_off_within_pieces(spark, bound):
    cells = spark.range(1000).select(F.lit(0).alias("id"), (F.col("id") * 7 % 1000).alias("v"), F.lit(2).cast("long").alias("n"))
    rows = ranks._located(cells, ["v"], {0: [0, 1, 2, 999, 1999], 1: [5]}, bound)
    assert sorted((r["rank"], r["v"], r["below"]) for r in rows) == [(0, 0, 0), (1, 0, 0), (2, 1, 2), (999, 499, 998), (1999, 999, 1998)]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_stabbing_index_finds_every_window(spark, kind):
    draw = random.Random(9)
    value = (lambda i: i) if kind == "bigint" else (lambda i: f"k{i:03d}")

    def end(i, low):
        z = int(i is None)
        t = draw.choice([{"u": -1.0 if low else 2.0, "k": None}, {"u": draw.choice([0.25, 0.5]), "k": draw.choice("abc")}])
        return {"o": {"z": z, "v": None if z else value(i)}, "t": t}

    windows = []
    for i in range(60):
        a, b = sorted(draw.choices(range(40), k=2))
        windows.append((i, end(a, True), end(None if i % 20 == 0 else b + 1, False)))
    order = f"struct<z:int,v:{kind}>"
    rows = [(n, i, u, k) for n, (i, u, k) in enumerate((i, u, k) for i in [None, *range(42)] for u in (0.1, 0.25, 0.5) for k in "ab")]
    df = spark.createDataFrame(rows, "n int, i int, u double, k string")
    v = F.col("i").cast("bigint") if kind == "bigint" else F.format_string("k%03d", "i")
    v = F.when(F.col("i").isNotNull(), v)
    o, t = F.struct(v.isNull().cast("int").alias("z"), v.alias("v")), F.struct("u", "k")
    index = StabbingIndex(windows, order)
    got = {r.n: sorted(r.w) for r in df.select("n", index.found(o, t).alias("w")).collect()}
    key = lambda o, t: (o["z"], 0 if o["v"] is None else o["v"], t["u"], t["k"] is not None, t["k"] or "")
    for n, i, u, k in rows:
        at = key({"z": int(i is None), "v": None if i is None else value(i)}, {"u": u, "k": k})
        assert got[n] == [w for w, lo, hi in windows if key(**lo) <= at <= key(**hi)], (n, i, u, k)
    assert sum(map(len, index.notes)) <= 60 * 2 * 8
