"""Least squares from fold sums against the same fit made row by row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnish.operators.features import PopulationScaler, feature_pipeline, standardise
from tarnish.operators.linear import RidgeFit, design_of, fit_ridge, fold_sums
from tarnish.operators.models import fit_baseline
from tarnish.plans.task import REGRESSION, Task

FOLDS, ALPHAS = 4, (0.001, 0.5)


def table(spark, n=400):
    draw = random.Random(6)
    rows = []
    for i in range(n):
        a = None if i % 9 == 0 else draw.gauss(1e6, 3.0)
        b = float("nan") if i % 13 == 0 else draw.uniform(-1, 1)
        c = None if i % 7 == 0 else draw.choice("xyz") if i % 50 else f"rare{i}"
        rows.append((i, a, b, 5.0, c, (a or 1e6) - 1e6 + 4 * (b if b == b else 0) + (c == "x") * 2 + draw.gauss(0, 0.1), i * 7 % FOLDS))
    return spark.createDataFrame(rows, "id int, a double, b double, flat double, c string, _label double, _fold int")


def plain(rows, alpha):
    """(predict, weights) by filling, scaling, encoding and solving on the rows themselves."""
    def number(values):
        known = [v for v in values if v is not None and v == v]
        mean = sum(known) / len(known)
        filled = np.array([mean if v is None or v != v else v for v in values])
        return mean, filled.std() if filled.std() > 1e-9 * max(1, abs(mean)) else 1.0

    fits = [number([r[i] for r in rows]) for i in (1, 2, 3)]
    seen = [r[4] for r in rows if r[4] is not None]
    mode = min(set(seen), key=lambda v: (-seen.count(v), v))
    levels = sorted(set(seen))

    def features(r):
        numbers = [((m if r[i] is None or r[i] != r[i] else r[i]) - m) / s for i, (m, s) in zip((1, 2, 3), fits)]
        return [*numbers, *[float((mode if r[4] is None else r[4]) == v) for v in levels]]

    x, y = np.array([features(r) for r in rows]), np.array([r[5] for r in rows])
    mx, my = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - mx).T @ (x - mx) / len(y) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my) / len(y))
    return lambda r: my + (np.array(features(r)) - mx) @ w, w


def test_fold_fits_equal_row_by_row_fits(spark):
    df = table(spark).repartition(5)
    rows = sorted(map(tuple, df.collect()))
    design = design_of(df, ["a", "b", "flat"], ["c"])
    without, whole, errors = fit_ridge(df, design, FOLDS, ALPHAS)
    for i, alpha in enumerate(ALPHAS):
        for fold in range(FOLDS):
            predict, _ = plain([r for r in rows if r[6] != fold], alpha)
            held = [r for r in rows if r[6] == fold]
            assert errors[fold][i] == pytest.approx(np.mean([(predict(r) - r[5]) ** 2 for r in held]), rel=1e-7)
        predict, w = plain(rows, alpha)
        scored = {r.id: r.score for r in whole[i].scorer().score(df).collect()}
        assert all(scored[r[0]] == pytest.approx(predict(r), abs=1e-6) for r in rows)
        assert [whole[i].weights[c] for c in ("a", "b", "flat")] == pytest.approx(w[:3], abs=1e-7)


def test_sums_add_up_and_are_one_scan(spark):
    df = table(spark)
    design = design_of(df, ["a", "b"], ["c"])
    sums = fold_sums(df, design, FOLDS)
    assert sums.shape == (FOLDS, design.width, design.width) and sums[:, 0, 0].sum() == 400
    assert np.allclose(sums, sums.transpose(0, 2, 1))
    one = fold_sums(df.where("_fold = 1"), design, FOLDS)
    assert np.allclose(one[1], sums[1]) and not one[0].any()


def test_wide_categories_are_left_to_the_iterative_learner(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("c"), F.col("id").cast("double").alias("_label"))
    assert design_of(df, [], ["c"], max_width=100) is None and design_of(df, [], ["c"]).width == 303


def test_blank_columns_and_an_empty_fold(spark):
    df = spark.createDataFrame([(None, 1.0, 0), (None, 3.0, 0), (None, 5.0, 1)], "a double, _label double, _fold int")
    without, whole, errors = fit_ridge(df, design_of(df, ["a"], []), 3, (0.1,))
    assert whole[0].intercept == pytest.approx(3.0) and whole[0].weights == {"a": 0.0}
    assert errors[2] == [None] and errors[1][0] == pytest.approx(9.0)
    assert isinstance(whole[0], RidgeFit)


def test_baseline_of_a_regression_needs_no_stored_vectors_for_squares(spark):
    df = table(spark).withColumnRenamed("_label", "label").drop("_fold")
    task = Task(df, df, ["id"], "label", REGRESSION, ["c"], ["a", "b"], seed=3)
    baseline = fit_baseline(task, folds=3, max_iter=5)
    settings = [p["loss"] for p, _ in baseline.cv_scores]
    assert settings.count("squaredError") == settings.count("huber") == 4
    best = dict((str(p), s) for p, s in baseline.cv_scores)[str(baseline.best)]
    assert best == min(s for _, s in baseline.cv_scores)
    assert task.performance(baseline).first()[0] < 0.5
    assert all(m >= 0 and m * m <= s + 1e-9 for (_, s), (_, m) in zip(baseline.cv_scores, baseline.cv_absolute))


def test_numbers_are_scaled_by_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 4), (2.0, 4), (6.0, 4)], "x double, flat int")
    wanted = [tuple(r) for r in standardise(df, ["x", "flat"]).collect()]
    scaled = PopulationScaler(["x", "flat"]).fit(df).transform(df).select("x_scaled", "flat_scaled")
    assert [tuple(r) for r in scaled.collect()] == [pytest.approx(w) for w in wanted]
    vectors = feature_pipeline(["x", "flat"], []).fit(df).transform(df).collect()
    assert [list(v.features) for v in vectors] == [pytest.approx(list(w)) for w in wanted]


def test_unknown_and_missing_categories_are_the_zero_vector(spark):
    train = spark.createDataFrame([("a",), ("b",), ("b",)], "c string")
    model = feature_pipeline([], ["c"]).fit(train)
    seen = model.transform(spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "c string")).collect()
    assert [r.features.toArray().tolist() for r in seen] == [[1, 0], [0, 1], [0, 0], [0, 0]]
