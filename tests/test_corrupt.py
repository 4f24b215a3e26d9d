import json

import pytest
from pyspark.sql import functions as F

from tarnish.operators.corrupt import (
    BrokenCharacters, CategoricalShift, CustomCorruption, GaussianNoise, MissingByConfidence, MissingValues, Scaling,
    SwappedValues, numeric_columns, permutations,
)
from tarnish.operators.scoring import LinearScorer


def rows(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_missing_values_only_touch_hits(toy):
    out = MissingValues("B", 0.5).transform(toy, ["id"], 3, hit="hit")
    before = rows(toy, "B")
    for r in out.collect():
        assert r["B"] is None if r["hit"] else r["B"] == before[r["id"]]
    assert out.where("hit").count() == 10 and out.columns == [*toy.columns, "hit"]


@pytest.mark.parametrize("mechanism", ["MCAR", "MAR", "MNAR"])
def test_fraction_one_hits_every_row(toy, mechanism):
    assert MissingValues("B", 1.0, mechanism).transform(toy, ["id"]).where("B is null").count() == 20


def test_sentinels(toy):
    out = MissingValues("A", 0.5, na_value=-999).transform(toy, ["id"])
    assert dict(out.dtypes)["A"] == "double" and out.where("A = -999").count() == 10
    with pytest.raises(ValueError, match="widen"):
        MissingValues("A", 0.5, na_value="BROKEN").transform(toy, ["id"])
    wide = MissingValues("A", 0.5, na_value="BROKEN", widen=True).transform(toy, ["id"])
    assert dict(wide.dtypes)["A"] == "string" and wide.where("A = 'BROKEN'").count() == 10
    half = MissingValues("id", 0.5, na_value=-0.5).transform(toy.withColumn("k", F.col("id")), ["k"])
    assert dict(half.dtypes)["id"] == "double"


def test_swap_twice_is_identity(toy):
    swap = SwappedValues("B", 0.5, swap_with="C")
    once = swap.transform(toy, ["id"], 9)
    assert rows(once, "B", "C") != rows(toy, "B", "C")
    assert rows(swap.transform(once, ["id"], 9), "B", "C") == rows(toy, "B", "C")


def test_swap_partner_and_types(toy):
    out = SwappedValues("A", 0.5).transform(toy, ["id"], 1, features=["A", "B"])
    assert dict(out.dtypes)["A"] == dict(out.dtypes)["B"] == "string"
    with pytest.raises(ValueError, match="second"):
        SwappedValues("A", 0.5).transform(toy.select("id", "A"), ["id"])


def test_shift_keeps_the_domain(toy):
    out = CategoricalShift("B", 1.0).transform(toy, ["id"], 2)
    pairs = {(a, b) for i, a in rows(toy, "B").items() for j, b in rows(out, "B").items() if i == j}
    assert len(pairs) == 3 and {b for _, b in pairs} == {"a", "b", "c"}
    moved = CategoricalShift("B", 1.0, derange=True).transform(toy, ["id"], 2)
    assert all(a != rows(moved, "B")[i] for i, a in rows(toy, "B").items())


def test_shift_edges(spark, toy):
    with pytest.warns(UserWarning, match="categorical"):
        same = CategoricalShift("A", 0.5).transform(toy, ["id"])
    assert rows(same, "A") == rows(toy, "A")
    gaps = toy.withColumn("B", F.when(F.col("id") % 4 > 0, F.col("B")))
    out = CategoricalShift("B", 1.0).transform(gaps, ["id"])
    assert out.where("B is null").count() == 5
    one = toy.withColumn("B", F.lit("z"))
    assert CategoricalShift("B", 1.0, derange=True).transform(one, ["id"]).where("B = 'z'").count() == 20


def test_permutation_is_a_bijection_in_buckets(spark, monkeypatch):
    from tarnish.operators import ranks
    df = spark.range(1000).select(F.concat(F.lit("v"), "id").alias("c"))
    monkeypatch.setattr(ranks, "POSITION_BUCKET_ROWS", 50)
    pairs = permutations(df, "c", [(0, "a", False), (1, "b", True)]).collect()
    for i in (0, 1):
        mine = [(r["value"], r["target"]) for r in pairs if r["id"] == i]
        assert len({a for a, _ in mine}) == len({b for _, b in mine}) == 1000
        if i:
            assert all(a != b for a, b in mine)


def test_noise(toy):
    out = GaussianNoise("A", 0.5).transform(toy, ["id"], 5, hit="hit")
    before = rows(toy, "A")
    assert all((r["A"] != before[r["id"]]) == r["hit"] for r in out.collect())
    whole = GaussianNoise("n", 0.5).transform(toy.withColumn("n", F.col("id")), ["id"])
    assert dict(whole.dtypes)["n"] == "double"
    still = GaussianNoise("A", 0.0).transform(toy, ["id"])
    assert rows(still, "A") == before


def test_scaling(spark, toy):
    out = Scaling("A", 1.0).transform(toy, ["id"], 5)
    ratios = {round(b / a, 6) for a, b in zip(rows(toy, "A").values(), rows(out, "A").values()) if a}
    assert len(ratios) == 1 and ratios <= {10.0, 100.0, 1000.0}
    big = spark.createDataFrame([(1, 2 ** 62), (2, 5)], "id int, n long")
    scaled = rows(Scaling("n", 1.0).transform(big, ["id"]), "n")
    assert scaled[1] is None and scaled[2] in (50, 500, 5000)
    gaps = toy.withColumn("A", F.when(F.col("id") > 5, F.col("A")))
    assert Scaling("A", 1.0).transform(gaps, ["id"]).where("A is null").count() == 6


def test_broken_characters(spark):
    df = spark.createDataFrame([(1, "aAeEoOuU xyz"), (2, None)], "id int, t string")
    out = rows(BrokenCharacters("t", 1.0).transform(df, ["id"]), "t")
    assert out[1] == "áÁéÉớỚúÚ xyz" and out[2] is None
    assert rows(BrokenCharacters("t", 0.0).transform(df, ["id"]), "t")[1] == "aAeEoOuU xyz"


def test_broken_characters_on_a_stream(spark, tmp_path):
    """A coin needs no row count, so the corruption is an ordinary streaming map."""
    spark.range(50).selectExpr("id", "'aeou' as t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, t string").parquet(str(tmp_path / "in"))
    out = BrokenCharacters("t", 0.5).transform(stream, ["id"], 1)
    query = out.writeStream.format("memory").queryName("broken").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    broken = spark.sql("select id from broken where t <> 'aeou'").collect()
    batch = BrokenCharacters("t", 0.5).transform(spark.read.parquet(str(tmp_path / "in")), ["id"], 1).where("t <> 'aeou'")
    assert sorted(r["id"] for r in broken) == sorted(r["id"] for r in batch.collect())


def test_confidence(toy):
    scorer = LinearScorer(-0.5, {"A": (1.0, 0.5)})
    order = sorted(range(20), key=lambda i: abs(i / 20 - 0.5))
    def gone(**options):
        out = MissingByConfidence("B", 0.2, scorer=scorer, **options).transform(toy, ["id"])
        return {r["id"] for r in out.where("B is null").collect()}
    most, least = gone(most_confident=True), gone(most_confident=False)
    assert len(most) == len(least) == 4 and order[0] in least and order[-1] in most and not most & least
    assert len(gone(most_confident=True, compat=True)) == 16
    other = toy.withColumn("A", 1.0 - F.col("A"))
    moved = MissingByConfidence("B", 0.2, scorer=scorer, predict_on=other).transform(toy, ["id"])
    assert moved.where("B is null").count() == 4
    everything = MissingByConfidence("B", 1.0, scorer=scorer, most_confident=False, compat=True).transform(toy, ["id"])
    assert everything.where("B is null").count() == 20


def test_descriptions(toy):
    spec = json.loads(MissingValues("B", 0.5, "MAR", na_value="x").describe())
    assert spec == {"corruption": "MissingValues", "column": "B", "fraction": 0.5, "sampling": "MAR", "na_value": "x",
                    "widen": False}
    with pytest.raises(ValueError):
        MissingValues("B", 1.5)
    with pytest.raises(ValueError, match="no such"):
        MissingValues("Z", 0.5).transform(toy, ["id"])
    assert numeric_columns(toy) == (["id", "A"], ["B", "C"])


def test_custom(toy):
    upper = CustomCorruption("upper", lambda df, column: df.withColumn(column, F.upper(column)), {"column": "B"})
    assert upper.transform(toy).where("B = 'A'").count() == toy.where("B = 'a'").count()
    assert "upper" in upper.describe()
