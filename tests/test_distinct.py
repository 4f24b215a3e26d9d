"""Capped distinct sets and heads of text columns."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnish.operators import distinct
from tarnish.operators.distinct import capped_sets, heads
from tarnish.operators.schema import infer_schema, profile
from tarnish.plans import task as tasks


def valued(spark, n, parts=5):
    return spark.range(0, 3 * n, 1, parts).select("id", F.concat(F.lit("v"), (F.col("id") % n).cast("string")).alias("s"), F.lit(None).cast("string").alias("blank"))


@pytest.mark.parametrize("values", [99, 100, 101])
def test_sets_stop_at_the_limit(spark, values):
    df = valued(spark, values)
    found = capped_sets(df, ["s", "blank"], 100)
    assert found["blank"] == set() and (found["s"] is None) == (values > 100)
    assert values > 100 or len(found["s"]) == values
    roles = tasks.infer_roles(df, ["id"], 100)
    assert roles[0] == (["s", "blank"] if values <= 100 else ["blank"]) and roles[2] == ([] if values <= 100 else ["s"])
    known = infer_schema(df, ["s", "blank"])
    assert (known["s"].domain is None) == (values > 100) and known["blank"].domain is None and known["blank"].note is None
    assert (known["s"].note is not None) == (values > 100)


def test_each_task_below_the_limit_but_not_all_together(spark, monkeypatch):
    monkeypatch.setattr(distinct, "FAN_IN", 2)
    df = valued(spark, 60, 12)
    assert capped_sets(df, ["s"], 59) == {"s": None} and len(capped_sets(df, ["s"], 60)["s"]) == 60
    assert capped_sets(df.where("id < 0"), ["s"], 3) == {"s": set()} and capped_sets(df, [], 3) == {}


def test_no_expansion_of_rows(spark, monkeypatch):
    plans = []
    real = distinct.ship
    df = valued(spark, 20)
    monkeypatch.setattr(distinct, "ship", lambda s: plans.append(1) or real(s))
    tasks.infer_roles(df, ["id"])
    assert plans == [1]


@pytest.mark.parametrize("few", [200_000, 0])
def test_heads_equal_counting(spark, monkeypatch, few):
    monkeypatch.setattr(distinct, "CANDIDATES", few)
    draw = random.Random(2)
    rows = [(i, draw.choice(["b", "a", "", "é"]), f"text {i} " + "long " * 300, None, "x" if i < 2 else "y" if i < 4 else f"u{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, common string, unique string, blank string, tied string").repartition(6)
    found = {r.column: (r.distinct, r.top_value, r.top_count) for r in heads(df, {c: F.col(c) for c in df.columns[1:]}).collect()}
    for k, c in ((1, "common"), (2, "unique"), (4, "tied")):
        counts = Counter(r[k] for r in rows)
        top = max(counts.values())
        assert found[c] == (len(counts), min(v for v, n in counts.items() if n == top), top)
    assert "blank" not in found
    whole = {r.column: r for r in profile(df).collect()}
    assert whole["blank"].distinct is None and whole["unique"].top_count == 1


def test_heads_shuffle_no_texts(spark):
    short, long = (spark.range(0, 400, 1, 4).select(F.concat(F.lit("k" * n), (F.col("id") % 40).cast("string")).alias("s")) for n in (1, 5000))
    for df in (short, long):
        cells = distinct._cells(df, {"s": F.col("s")}).select("c", *distinct._hashes(F.col("v"))).groupBy("c", "h", "k").count()
        exchange = [line for line in cells._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]
        assert len(exchange) == 1
        plan = cells._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand" not in plan
    assert heads(long, {"s": F.col("s")}).first().top_count == 10
