import pytest
from pyspark.sql import functions as F

from tarnish.operators import clean, metrics
from tarnish.operators.corrupt import GaussianNoise, MissingValues
from tarnish.operators.schema import Expectation, Schema, has_anomaly, infer_schema, profile, validate


def brute_auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_against_all_pairs(spark):
    pairs = [((i * 37 % 50) / 7.0, int(i * 13 % 5 > 2)) for i in range(300)]
    df = spark.createDataFrame(pairs, "s double, y int")
    value = metrics.roc_auc(df, "s", "y").first()["auc"]
    assert value == pytest.approx(brute_auc(pairs))
    turned = metrics.roc_auc(df.withColumn("s", -F.col("s")), "s", "y").first()["auc"]
    assert turned == pytest.approx(1 - value)


def test_auc_edges(spark):
    same = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 0)], "s double, y int")
    assert metrics.roc_auc(same, "s", "y").first()["auc"] == 0.5
    single = spark.createDataFrame([(1.0, 1), (2.0, 1)], "s double, y int")
    assert metrics.roc_auc(single, "s", "y").first()["auc"] is None


def test_shifted_auc_against_recomputing(spark):
    base = [((i * 37 % 91) / 7.0, int(i * 13 % 5 > 2)) for i in range(200)]
    changed = {g: [(s + (g + 1) * 3.5 if i % (g + 2) == 0 else s, y) for i, (s, y) in enumerate(base)] for g in range(3)}
    clean_hist = metrics.score_histogram(spark.createDataFrame(base, "s double, y int"), "s", "y")
    moves = [(g, s, y, w) for g, after in changed.items() for (a, y), (b, _) in zip(base, after) if a != b
             for s, w in ((a, -1), (b, 1))]
    delta = metrics.score_histogram(spark.createDataFrame(moves, "idx int, s double, y int, w int"), "s", "y", ["idx"], F.col("w"))
    found = {r["idx"]: r for r in metrics.shifted_auc(clean_hist, delta, 4).collect()}
    for g, after in changed.items():
        assert found[g]["shifted_score"] == pytest.approx(brute_auc(after))
        assert found[g]["clean_score"] == pytest.approx(brute_auc(base))
    assert found[3]["shifted_score"] == pytest.approx(brute_auc(base))


def test_macro_f1_is_not_weighted(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 1, 1, 2], [0, 0, 0, 0, 1, 1])), "y int, p int")
    # per class: 6/7, 1/2, 0
    assert metrics.macro_f1(df, "p", "y").first()["macro_f1"] == pytest.approx((6 / 7 + 0.5) / 3)


def test_macro_f1_compares_whole_and_floating_labels(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 2.0)], "y int, p double")
    assert metrics.macro_f1(df, "p", "y").first()["macro_f1"] == 1.0


def test_errors(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 0.0)], "y double, p double")
    assert metrics.mse(df, "p", "y").first()["mse"] == 5.0
    assert metrics.mae(df, "p", "y").first()["mae"] == 2.0


def test_schema_accepts_its_own_data(toy):
    schema = infer_schema(toy)
    assert not has_anomaly(validate(toy, schema))
    assert schema["B"].domain == ("a", "b", "c") and schema["A"].domain is None and schema["A"].min_fraction == 1.0


def codes(df, schema):
    return sorted((r["column"], r["code"]) for r in validate(df, schema).collect())


def test_anomalies(toy):
    schema = infer_schema(toy)
    assert codes(MissingValues("B", 0.5).transform(toy, ["id"]), schema) == [("B", "PRESENCE_BELOW_MIN")]
    assert codes(MissingValues("B", 0.5, na_value="").transform(toy, ["id"]), schema) == [("B", "OUT_OF_DOMAIN")]
    noisy = GaussianNoise("id", 0.5).transform(toy.withColumn("k", F.col("id")), ["k"]).drop("k")
    assert codes(noisy, schema) == [("id", "TYPE_MISMATCH")]
    assert codes(toy.drop("C").withColumn("D", F.lit(1)), schema) == [("C", "MISSING_COLUMN"), ("D", "NEW_COLUMN")]
    assert codes(toy, schema.relax("A", max=0.5)) == [("A", "OUT_OF_RANGE")]
    odd = MissingValues("B", 0.5, na_value="").transform(toy, ["id"])
    assert codes(odd, schema.relax("B", min_domain_mass=0.4)) == []
    with pytest.raises(KeyError):
        schema.relax("nope", min=0)


def test_empty_table_conforms(spark, toy):
    assert codes(toy.where("id < 0"), infer_schema(toy)) == []
    assert validate(toy.select("A"), Schema((Expectation("Z", "INT"),))).count() == 2


def test_wide_string_column_has_no_domain(spark):
    df = spark.range(300).select(F.concat(F.lit("v"), "id").alias("s"))
    assert infer_schema(df)["s"].domain is None


def test_profile_with_gaps(spark):
    df = spark.createDataFrame([(1, 0.0, "x"), (2, float("nan"), "x"), (None, 4.0, None), (4, None, "yy")], "i int, d double, s string")
    found = {r["column"]: r for r in profile(df).collect()}
    assert (found["d"]["present"], found["d"]["missing"], found["d"]["zeros"], found["d"]["mean"]) == (2, 2, 1, 2.0)
    assert (found["s"]["distinct"], found["s"]["top_value"], found["s"]["top_count"], found["s"]["missing"]) == (2, "x", 2, 1)
    assert found["i"]["missing"] == 1 and found["i"]["max"] == 4.0


def test_imputers(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 3.0, None), (4, float("nan"), "b"), (5, 2.0, "a")],
                               "id int, x double, c string")
    filled = clean.fit_mean(df, ["x"]).transform(df)
    assert [r["x"] for r in filled.orderBy("id").collect()] == [1.0, 2.0, 3.0, 2.0, 2.0]
    assert clean.fit_mode(df, ["c"]).fills == {"c": "a"}  # tie: the smaller value
    whole = clean.fit_mode(df, ["id"]).transform(df)
    assert dict(whole.dtypes)["id"] == "int"
    by_x = clean.fit_conditional_mode(df.fillna(0.0, ["x"]), "c", ["x"])
    assert by_x.transform(df.fillna(0.0, ["x"])).where("c is null").count() == 0
