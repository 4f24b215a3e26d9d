"""Filling gaps from other columns when one combination holds a third of the rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tarnish.operators import clean
from tarnish.operators.clean import fit_conditional_mode


def table(spark, n=3000):
    draw = random.Random(8)
    rows = []
    for i in range(n):
        combo = (None, 1) if i % 3 == 0 else (f"c{i % 200}", i % 2)
        rows.append((i, *combo, None if draw.random() < 0.4 else draw.choice("abcd"), "kept"))
    rows += [(n + i, "unseen", 9, None, "kept") for i in range(500)]
    return rows, spark.createDataFrame(rows, "id int, x string, y int, target string, _mode string").repartition(8)


def brute(rows):
    by, every = defaultdict(Counter), Counter()
    for _, x, y, t, _ in rows:
        if t is not None:
            by[x, y][t] += 1
            every[t] += 1
    best = lambda c: min(c, key=lambda v: (-c[v], v))
    return {i: t if t is not None else best(by[x, y]) if by[x, y] else best(every) for i, x, y, t, _ in rows}


@pytest.mark.parametrize("bound", [clean.BROADCAST_BYTES, 0])
def test_equals_counting(spark, bound):
    rows, df = table(spark)
    imputer = fit_conditional_mode(df, "target", ["x", "y"], broadcast_bytes=bound)
    assert imputer.whole == (bound > 0)
    got = imputer.transform(df)
    assert got.columns == df.columns
    assert {r.id: r.target for r in got.collect()} == brute(rows)


def test_heavy_combinations_and_present_targets_stay_where_they_are(spark):
    rows, df = table(spark)
    imputer = fit_conditional_mode(df, "target", ["x", "y"], broadcast_bytes=0)
    heavy = {(r.x, r.y) for r in imputer.table.where(F.col("_n") > imputer.heavy_rows).collect()}
    assert heavy == {(None, 1)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = imputer.transform(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 2  # both halves look up the heavy ones
    # what is left for the shuffled join is spread over salts: no task reads twice the median
    rest = df.where("target IS NULL AND NOT (x IS NULL AND y = 1)")
    lane = F.pmod(F.xxhash64(*df.columns), F.lit(clean.SALTS))
    sizes = sorted(r["count"] for r in rest.where("x = 'unseen'").groupBy(lane).count().collect())
    assert len(sizes) == clean.SALTS and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_light_combinations_are_not_broadcast_however_small_their_file(spark):
    _, df = table(spark)
    filled = fit_conditional_mode(df, "target", ["x", "y"], broadcast_bytes=0).transform(df)
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 2
