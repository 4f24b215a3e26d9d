import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tarnish.functions.rand import Salt, row_base, scalar_uniform, uniform, with_row_key
from tarnish.operators import ranks
from tarnish.operators.ranks import dense_positions, draw_bounds, order_struct, values_at_ranks
from tarnish.operators.sampling import KeyedTable, bootstrap, coin, sample_rows

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def numbers(spark, n, parts=4):
    return spark.range(0, n, 1, parts).select(
        F.col("id"), (F.col("id") * 7919 % 101).alias("x"), F.when(F.col("id") % 10 > 0, F.col("id") % 3).alias("few"),
        F.concat(F.lit("w"), (F.col("id") * 31 % 57).cast("string")).alias("word"))


def hits(df, *columns):
    return sorted(tuple(r) for r in df.where("hit").select(*columns).collect())


@QUICK
@given(fraction=st.floats(0, 1), mechanism=st.sampled_from(["MCAR", "MAR", "MNAR"]), seed=st.integers(0, 99))
def test_exact_count(spark, fraction, mechanism, seed):
    df = numbers(spark, 137)
    marked = sample_rows(df, ["id"], fraction, mechanism, column="x", depends_on="few", seed=seed)
    assert marked.where("hit").count() == (137 if fraction == 1.0 else math.floor(137 * fraction))


@pytest.mark.parametrize("column", ["x", "few", "word"])
def test_not_at_random_is_one_run(spark, column):
    marked = sample_rows(numbers(spark, 200), ["id"], 0.3, "NAR", column=column, seed=5).collect()
    key = lambda r: (r[column] is None, r[column] if r[column] is not None else 0)
    inside = [key(r) for r in marked if r["hit"]]
    between = [r for r in marked if min(inside) < key(r) < max(inside)]
    assert len(inside) == 60 and all(r["hit"] for r in between)


@pytest.mark.parametrize("mechanism", ["CAR", "AR", "NAR"])
def test_same_rows_for_any_partitioning(spark, mechanism):
    results = [
        hits(sample_rows(numbers(spark, 300, parts), ["id"], 0.25, mechanism, column="few", depends_on="word", seed=3), "id")
        for parts in (1, 4, 16)]
    assert results[0] == results[1] == results[2] and len(results[0]) == 75


@pytest.mark.parametrize("column", ["x", "few", "word"])
def test_large_table_path_agrees_with_sorting(spark, column):
    """A summary of few entries gives wide brackets; the answer must not change."""
    df = numbers(spark, 4000)
    wanted = [0, 1, 777, 2000, 3998, 3999]
    everything = sorted((r[column] is None, r[column] if r[column] is not None else 0) for r in df.collect())
    found = values_at_ranks(df, column, wanted, entries=8)
    for r in wanted:
        got = found[r]
        assert (got["z"] == 1, got["v"] if got["v"] is not None else 0) == everything[r]
        assert everything.index(everything[r]) == got["below"] and everything.count(everything[r]) == got["ties"]


def test_large_table_path_marks_the_same_rows(spark, monkeypatch):
    df = numbers(spark, 3000)
    plain = hits(sample_rows(df, ["id"], 0.4, "NAR", column="few", seed=1), "id")
    monkeypatch.setattr(ranks, "ENTRIES", 4)
    assert hits(sample_rows(df, ["id"], 0.4, "NAR", column="few", seed=1), "id") == plain


def test_a_third_of_all_rows_share_one_value(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("v"))
    marked = sample_rows(df, ["id"], 0.2, "NAR", column="v", seed=8)
    assert marked.where("hit").count() == 600


def test_draw_bounds_many_requests(spark):
    table = KeyedTable(numbers(spark, 1000), ["id"], 1)
    requests = [{"salt": Salt.of(i, "row"), "need": k, "rows": 1000} for i, k in enumerate((1, 10, 500, 999, 1000))]
    bounds = draw_bounds(table.df.select("_k", "_v"), requests)
    for r, b in zip(requests, bounds):
        u = uniform(F.col("_v"), r["salt"])
        assert table.df.where(u <= b["u"]).count() == r["need"]


def test_duplicate_key_is_reported(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("id"), F.lit(1).alias("x"))
    with pytest.raises(ValueError, match="unique"):
        sample_rows(df, ["id"], 0.3).count()


def test_edges(spark, toy):
    with pytest.raises(ValueError):
        sample_rows(toy, ["id"], 1.2)
    with pytest.raises(ValueError):
        sample_rows(toy, ["id"], 0.5, "SOMEHOW", column="A")
    with pytest.raises(ValueError):
        sample_rows(toy, [], 0.5)
    with pytest.raises(ValueError, match="floating"):
        sample_rows(toy, ["A"], 0.5)
    empty = toy.where("id < 0")
    assert sample_rows(empty, ["id"], 0.5, "NAR", column="A").count() == 0
    one = toy.where("id = 3")
    assert hits(sample_rows(one, ["id"], 0.99, "NAR", column="A"), "id") == []
    assert hits(sample_rows(one, ["id"], 1.0, "NAR", column="A"), "id") == [(3,)]
    # 100 * 0.29 is 28.999.. in double arithmetic, and 28 rows are hit
    assert len(hits(sample_rows(numbers(spark, 100), ["id"], 0.29), "id")) == 28


def test_coin_and_bootstrap(spark):
    df = numbers(spark, 2000)
    share = coin(df, ["id"], 0.3, 4).where("hit").count() / 2000
    assert 0.26 < share < 0.34
    drawn = bootstrap(df, ["id"], 2000, 6)
    assert drawn.count() == 2000 and 1150 < drawn.select("id").distinct().count() < 1400


def test_dense_positions_with_many_buckets(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("g")).withColumn(
        "_v", row_base(F.col("id").cast("string"))).withColumn("u", uniform(F.col("_v"), Salt.of(1, "p")))
    many = dense_positions(df, "u", "id", 250, by=("g",), bucket_rows=10)
    once = dense_positions(df, "u", "id", 250, by=("g",))
    assert sorted(many.select("id", "position").collect()) == sorted(once.select("id", "position").collect())
    assert sorted(r["position"] for r in many.where("g = 0").collect()) == list(range(250))


def test_row_key_for_identical_rows(spark):
    df = spark.createDataFrame([(1, "a")] * 7 + [(2, "b"), (2, None)], "x int, y string")
    keyed = with_row_key(df, copies_per_row=3)
    assert keyed.count() == 9 and keyed.select("row_key").distinct().count() == 9
    again = with_row_key(df.repartition(5))
    assert sorted(r["row_key"] for r in keyed.collect()) == sorted(r["row_key"] for r in again.collect())


def test_draws_are_uniform_and_unrelated(spark):
    base = spark.range(20000).select(row_base(F.col("id").cast("string")).alias("v"))
    u = [uniform(F.col("v"), Salt.of(f"s/{i}", "row")) for i in range(6)]
    row = base.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(u)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(u)],
                   *[F.corr(u[i], u[j]).alias(f"c{i}{j}") for i in range(6) for j in range(i)]).first()
    for name, value in row.asDict().items():
        target, slack = {"m": (0.5, 0.01), "s": (math.sqrt(1 / 12), 0.006), "c": (0.0, 0.03)}[name[0]]
        assert abs(value - target) < slack, name
    assert 0 <= scalar_uniform(1, "x") < 1


@pytest.mark.parametrize("mechanism", ["CAR", "AR", "NAR"])
def test_marking_is_a_narrow_map(spark, mechanism):
    marked = sample_rows(numbers(spark, 3000), ["id"], 0.3, mechanism, column="few", depends_on="x")
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_order_struct_puts_missing_last(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (-3.0,)], "v double")
    ordered = [r["v"] for r in df.orderBy(order_struct(df, "v")).collect()]
    assert ordered[:2] == [-3.0, 1.0]
