import pytest
from pyspark.sql import functions as F

from tarnish.operators.clean import fit_mean
from tarnish.operators.corrupt import (
    BrokenCharacters, CategoricalShift, GaussianNoise, MissingByConfidence, MissingValues, Scaling, SwappedValues,
)
from tarnish.operators.metrics import task_metric
from tarnish.operators.models import fit_baseline
from tarnish.operators.schema import infer_schema
from tarnish.operators.scoring import ChainedScorer, CutScorer, LinearScorer
from tarnish.plans import results, stress
from tarnish.plans.evaluate import ImpactEvaluator, SchemaEvaluator, grid
from tarnish.plans.task import BINARY, MULTICLASS, REGRESSION, Task, split


def frame(spark, n=400):
    return spark.range(n).select(
        F.col("id"), (F.col("id") * 37 % 101 / 10).alias("x"), (F.col("id") * 53 % 17).cast("int").alias("n"),
        F.element_at(F.array(*map(F.lit, "abcd")), (F.col("id") * 7 % 4 + 1).cast("int")).alias("c"),
        F.concat(F.lit("note "), (F.col("id") % 9).cast("string")).alias("t"))


def make_task(spark, kind=BINARY):
    x = F.col("x")
    label = {BINARY: (x + F.when(F.col("c") == "a", 2).otherwise(0) > 5).cast("int"),
             MULTICLASS: F.floor(x / 4).cast("int"), REGRESSION: x * 2 + F.col("n")}[kind]
    train, test = split(frame(spark).withColumn("label", label), ["id"], 0.5, 1)
    return Task(train.cache(), test.cache(), ["id"], "label", kind, ["c"], ["x", "n"], ["t"], seed=4)


SCORER = LinearScorer(-5.0, {"x": (1.0, 5.0), "n": (0.05, 8.0)}, {"c": {"a": 2.0}})
ALL = [
    MissingValues("x", 0.5), MissingValues("c", 0.3, "MNAR", na_value=""), GaussianNoise("n", 0.4, "MAR"),
    Scaling("x", 0.2, "NAR"), SwappedValues("x", 0.5, swap_with="n"), CategoricalShift("c", 0.9),
    BrokenCharacters("c", 0.5), MissingValues("x", 0.0), CategoricalShift("x", 0.5),
    MissingByConfidence("x", 0.3, most_confident=True),
]


def one_by_one(task, scorer, corruption, sid, rep):
    """The plain way: damage a whole copy, score it, compute the metric."""
    from dataclasses import replace
    if isinstance(corruption, MissingByConfidence):
        corruption = replace(corruption, scorer=scorer)
    bound = corruption.bind(task.features, f"{task.seed}/{sid}")
    from tarnish.operators.sampling import KeyedTable
    table = KeyedTable(task.test, task.key, task.seed)
    damaged = bound._transform(table, f"{task.seed}/{sid}/{rep}", task.features, None)
    scored = scorer.score(damaged, "_s")
    return task_metric(scored, task.task_type, "_s", task.label).first()["value"]


@pytest.mark.parametrize("kind, scorer", [
    (BINARY, SCORER), (MULTICLASS, CutScorer(SCORER, (-1.0, 3.0))), (REGRESSION, LinearScorer(0.0, {"x": (2.0, 5.0), "n": (1.0, 8.0)}))])
def test_batched_equals_one_by_one(spark, kind, scorer):
    task = make_task(spark, kind)
    chosen = ALL if kind == BINARY else ALL[:6]
    found = ImpactEvaluator(task, scorer).evaluate(chosen, 2).collect()
    assert len(found) == 2 * len(chosen)
    for r in found:
        expected = one_by_one(task, scorer, chosen[r["scenario_id"]], r["scenario_id"], r["rep"])
        assert r["corrupted_score"] == pytest.approx(expected), r["corruption"]
        assert r["baseline_score"] == pytest.approx(task.performance(scorer).first()[0])


def test_imputing_model_recovers(spark):
    task = make_task(spark)
    raw = LinearScorer(-5.0, {"x": (1.0, -100.0)})
    repaired = ChainedScorer(raw, (fit_mean(task.train, ["x"]),))
    out = ImpactEvaluator(task, raw).compare({"raw": raw, "repaired": repaired}, [MissingValues("x", 0.5, "MNAR")], 3)
    means = {r["model_id"]: r["m"] for r in out.groupBy("model_id").agg(F.avg("corrupted_score").alias("m")).collect()}
    assert means.keys() == {"raw", "repaired"}


def test_cross_type_swap_has_no_score_but_an_anomaly(spark):
    task = make_task(spark)
    schema = infer_schema(task.train, task.features)
    r = ImpactEvaluator(task, SCORER, schema).evaluate([SwappedValues("x", 0.5, swap_with="c")], 1).first()
    assert r["corrupted_score"] is None and r["anomaly_detected"]
    assert {a["code"] for a in r["anomalies"]} == {"TYPE_MISMATCH"}


def test_schema_evaluator(spark):
    task = make_task(spark)
    damage = [MissingValues("x", 0.5), MissingValues("c", 0.5, na_value=""), Scaling("x", 0.5), GaussianNoise("n", 0.5)]
    found = {r["scenario_id"]: {(a["column"], a["code"]) for a in r["anomalies"]}
             for r in SchemaEvaluator(task, SCORER).evaluate(damage, 1).collect()}
    assert found == {0: {("x", "PRESENCE_BELOW_MIN")}, 1: {("c", "OUT_OF_DOMAIN")}, 2: set(), 3: {("n", "TYPE_MISMATCH")}}


def test_grid_and_errors(spark):
    assert len(grid(MissingValues, ["x", "c"], [0.1, 0.5], ["MCAR", "MAR", "MNAR"], na_value=None)) == 12
    task = make_task(spark)
    with pytest.raises(ValueError, match="feature"):
        ImpactEvaluator(task, SCORER).evaluate([MissingValues("id", 0.5)], 1)


def test_stress_test(spark):
    task = make_task(spark)
    schema = infer_schema(task.train, task.features)
    out = stress.stress_test(task, SCORER, schema, 25, 0.02)
    rows = out.collect()
    assert len(rows) == 25
    for r in rows:
        harmful = r["drop"] is None or r["drop"] > 0.02
        assert r["status"] == {(1, 1): "TP", (1, 0): "FP", (0, 1): "FN", (0, 0): "TN"}[(int(r["anomaly_detected"]), int(harmful))]
    assert sum(r["n"] for r in stress.status_counts(out).collect()) == 25
    with pytest.raises(ValueError, match="clean"):
        stress.stress_test(task, SCORER, schema.relax("x", max=0.0), 5, 0.02)


def test_random_corruptions_cover_every_kind(spark):
    task = make_task(spark)
    drawn = stress.random_corruptions(task, 300, 5)
    names = {type(c).__name__ for c in drawn}
    assert names == {"MissingValues", "GaussianNoise", "Scaling", "SwappedValues", "BrokenCharacters"}
    assert all(c.column != c.swap_with for c in drawn if isinstance(c, SwappedValues))


def test_summaries(spark):
    rows = [(0, "c", "k", "x", 0.1, "CAR", i, 0.9, v) for i, v in enumerate([0.1, 0.2, 0.3, 0.4, 9.0])]
    df = spark.createDataFrame(rows, "scenario_id int, corruption string, kind string, column string, fraction double, "
                                     "sampling string, rep int, baseline_score double, corrupted_score double")
    assert results.mean_scores(df).first()["mean_score"] == pytest.approx(2.0)
    assert results.median_scores(df).first()["median_score"] == pytest.approx(0.3)
    box = results.box_scores(df).first()
    assert (box["q1"], box["q3"], box["whisker_low"], box["whisker_high"]) == pytest.approx((0.2, 0.4, 0.1, 0.4))
    assert results.find_result(df, "x", 0.1, "CAR").count() == 5


def test_fitted_baseline_is_kept(spark):
    task = make_task(spark)
    task = Task(task.train, task.test, task.key, task.label, BINARY, ["c"], ["x", "n"], seed=4)
    model = fit_baseline(task, folds=2, max_iter=10)
    assert fit_baseline(task) is model and len(model.cv_scores) == 4
    assert task.performance(model).first()[0] > 0.9
    other = fit_baseline(task, task.train.limit(100), folds=2, max_iter=5)
    assert other is not model and task.baseline is model
    out = ImpactEvaluator(task, model).evaluate([MissingValues("x", 0.9, na_value=-50)], 1).first()
    assert out["corrupted_score"] < out["baseline_score"]
    with pytest.raises(ValueError, match="label"):
        fit_baseline(task, task.train.drop("label"))


def test_no_window_without_keys(spark):
    out = ImpactEvaluator(make_task(spark), SCORER).evaluate(ALL[:4], 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "windowspecdefinition(specified" not in plan and "Join Cross" not in plan
