"""Missing values, gaps in predictions and roles at the limit."""

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tarnish.operators import clean, corrupt, features, metrics
from tarnish.operators.corrupt import CategoricalShift, CustomCorruption, MissingValues, SwappedValues
from tarnish.operators.image import ImageCorruption
from tarnish.operators.metrics import score_predictions
from tarnish.operators.models import fit_baseline
from tarnish.operators.schema import infer_schema, profile
from tarnish.operators.scoring import LinearScorer, Scorer
from tarnish.plans import stress, task as tasks
from tarnish.plans.evaluate import ImpactEvaluator


def test_predictions_must_cover_the_labels(spark):
    labels = spark.createDataFrame([(i, float(i % 2)) for i in range(10)], "id int, label double")
    good = spark.createDataFrame([(i, float(i % 2)) for i in range(10)], "id int, score double")
    assert score_predictions(good, labels, ["id"], "binary").first()["value"] == 1.0
    for bad in (good.where("id > 0"), good.unionByName(good.where("id = 3")), good.selectExpr("id", "nullif(score, 1.0) AS score")):
        with pytest.raises(ValueError):
            score_predictions(bad, labels, ["id"], "binary")


@pytest.mark.parametrize("values", [98, 100, 101, 5000])
def test_roles_by_exact_count(spark, values):
    df = spark.range(6000).selectExpr(f"cast(id % {values} as string) AS c", "id AS n")
    assert tasks.infer_roles(df) == ((["c"], ["n"], []) if values <= 100 else ([], ["n"], ["c"]))


def test_nan_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, None), ("a", math.nan, False), ("a", 1.0, True), ("a", None, True)], "g string, x double, b boolean")
    out = [r.x for r in features.standardise(df, ["x"]).collect()]
    assert out[2] is None and out[4] is None and abs(sum(v for v in out if v is not None)) < 1e-9
    assert [r.x for r in clean.fit_conditional_mode(df, "x", ["g"]).transform(df).orderBy("x").collect()] == [1.0, 1.0, 1.0, 1.0, 3.0]
    assert sorted(r.b for r in clean.fit_mean(df, ["b"]).transform(df).collect()) == [0.0, 0.75, 1.0, 1.0, 1.0]


# -- evaluators ---------------------------------------------------------------------------


def halves(spark, label="cast(id % 3 = 0 as int)", n=300):
    df = spark.range(n).selectExpr("id", "id * 37 % 101 / 10 AS x", "id % 7 AS size", f"{label} AS label")
    return df.where(F.col("id") % 2 == 0), df.where(F.col("id") % 2 == 1)


def number_task(spark, label="cast(id % 3 = 0 as int)", kind="binary", **options):
    return tasks.Task(*halves(spark, label), ["id"], "label", kind, ["size"], ["x"], seed=3, **options)


SCORER = LinearScorer(-5.0, {"x": (1.0, 5.0)}, {"size": {3: 2.0, 5: -1.0}})


def test_regression_needs_numbers_at_construction(spark):
    with pytest.raises(ValueError):
        number_task(spark, "concat('v', id)", "regression")


def test_baseline_must_be_fitted_first(spark):
    with pytest.raises(ValueError, match="fit the baseline first"):
        number_task(spark).baseline_performance()


def test_text_classes_give_the_score_of_numbers(spark):
    texts = number_task(spark, "if(id % 3 = 0, 'yes', 'no')")
    assert texts.positive_class == "yes"
    assert texts.performance(SCORER).first() == number_task(spark).performance(SCORER).first()
    swapped = replace(texts, positive="no").performance(SCORER).first()[0]
    assert abs(swapped + texts.performance(SCORER).first()[0] - 1) < 1e-12


def test_fitted_text_classes_are_returned(spark):
    task = number_task(spark, "element_at(array('low', 'mid', 'top'), cast(floor(id * 37 % 101 / 34) + 1 as int))", "multiclass")
    model = fit_baseline(task, folds=2, max_iter=20)
    assert {r.score for r in model.score(task.test).select("score").distinct().collect()} <= {"low", "mid", "top"}
    assert task.baseline_performance().first()[0] > 0.8
    binary = number_task(spark, "if(id * 37 % 101 > 50, 'yes', 'no')")
    assert fit_baseline(binary, folds=2, max_iter=20) and binary.baseline_performance().first()[0] > 0.95


def test_fraction_zero_scores_the_baseline(spark):
    found = ImpactEvaluator(number_task(spark), SCORER).evaluate([SwappedValues("x", 0.0, swap_with="size")], 1).first()
    assert found.corrupted_score == found.baseline_score is not None


def test_missing_scores_give_no_metric(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (2, None, 0), (3, 0.1, 0)], "id int, s double, y int")
    assert metrics.roc_auc(df, "s", "y").first()[0] is None
    assert metrics.mse(df, "s", "y").first()[0] is None and metrics.mae(df, "s", "y").first()[0] is None
    assert metrics.roc_auc(df.where("id <> 2"), "s", "y").first()[0] == 1.0


def test_new_and_missing_columns_in_evaluators(spark):
    task = number_task(spark)
    known = infer_schema(task.train, ["x"])
    found = ImpactEvaluator(task, SCORER, known).evaluate([MissingValues("x", 0.2), CustomCorruption("same", lambda df: df)], 1)
    codes = [[(a["column"], a["code"]) for a in r["anomalies"]] for r in found.orderBy("scenario_id").collect()]
    assert ("size", "NEW_COLUMN") in codes[0] and codes[1] == [("size", "NEW_COLUMN")]
    lost = infer_schema(task.train.withColumn("gone", F.lit("x")), ["x", "size", "gone"])
    with pytest.raises(ValueError, match="does not accept"):
        stress.stress_test(task, SCORER, lost, 2, 0.03)


def test_user_corruptions_keep_the_rows(spark):
    evaluator = ImpactEvaluator(number_task(spark), SCORER)
    same = evaluator.evaluate([CustomCorruption("same", lambda df: df)], 1).first()
    assert same.corrupted_score == same.baseline_score
    with pytest.raises(Exception, match="number of test rows"):
        evaluator.evaluate([CustomCorruption("fewer", lambda df: df.where("id > 50"))], 1).collect()


class PixelSum(Scorer):
    def score(self, df, into="score"):
        return df.withColumn(into, F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x))


@pytest.mark.parametrize("kinds", [("gaussian_noise",), ("glass_blur",), ("defocus_blur", "contrast")])
def test_image_grid_equals_one_by_one(spark, kinds):
    images = spark.range(60).select(
        "id", F.lit(8).alias("height"), F.lit(8).alias("width"), (F.col("id") % 2).cast("int").alias("label"),
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((i * 7 + F.col("id") * 29) % 256).cast("int")).alias("pixels"))
    task = tasks.Task(images, images, ["id"], "label", "binary", images="pixels", seed=5)
    damage = [ImageCorruption(kinds, 3, 0.4), ImageCorruption(("brightness",), 2, 0.6)]
    for row in ImpactEvaluator(task, PixelSum()).evaluate(damage, 2).collect():
        plain = damage[row.scenario_id].transform(images, ["id"], f"5/{row.scenario_id}/{row.rep}")
        assert row.corrupted_score == pytest.approx(
            metrics.roc_auc(PixelSum().score(plain), "score", "label").first()[0])


def test_shift_join_beyond_the_broadcast(spark, monkeypatch):
    df = spark.range(500).selectExpr("id", "if(id % 3 = 0, null, concat('c', id % 5)) AS c").cache()
    wanted = sorted(CategoricalShift("c", 0.7).transform(df, ["id"], 4).collect())
    monkeypatch.setattr(corrupt, "BROADCAST_BYTES", 0)
    assert sorted(CategoricalShift("c", 0.7).transform(df, ["id"], 4).collect()) == wanted


def test_dates_in_the_profile(spark):
    df = spark.sql("SELECT date'2024-01-02' AS d, timestamp_ntz'2024-01-02 00:00:01' AS t UNION ALL SELECT NULL, NULL")
    found = {r["column"]: r for r in profile(df).collect()}
    assert found["d"]["min"] == 1704153600.0 and found["t"]["max"] == 1704153601.0
    assert found["d"]["distinct"] == 1 and found["t"]["missing"] == 1


def test_regression_grid_keeps_both_errors(spark):
    task = number_task(spark, "id * 37 % 101 / 5.0", "regression")
    model = fit_baseline(task, folds=2, max_iter=20)
    assert len(model.cv_absolute) == len(model.cv_scores) == 8
    assert all(0 <= a <= math.sqrt(s) + 1e-9 for (_, a), (_, s) in zip(model.cv_absolute, model.cv_scores))
