"""Fitted baselines and the learned imputer against what small made tables must give."""

import pytest

from tarnish.operators.clean import ConditionalMode
from tarnish.operators.models import fit_baseline, fit_image_baseline, fit_learned_imputer
from tarnish.plans.task import MULTICLASS, REGRESSION, Task, image_style, split


def test_multiclass_baseline_separates_three_bands(spark):
    df = spark.range(600).selectExpr("id", "cast(id % 100 as double) AS x", "cast(id % 7 as string) AS c",
                                     "cast(floor(id % 100 / 34) as int) AS label")
    train, test = split(df, ["id"], 0.25, 3)
    task = Task(train, test, ["id"], "label", MULTICLASS, ["c"], ["x"], seed=3)
    model = fit_baseline(task, folds=2, max_iter=40)
    assert len(model.cv_scores) == 4 and all(0 <= s <= 1 for _, s in model.cv_scores)
    assert max(model.cv_scores, key=lambda p: p[1])[0] == model.best
    assert task.baseline_performance().first()[0] > 0.9


def test_regression_baseline_finds_the_line(spark):
    df = spark.range(300).selectExpr("id", "cast(id % 50 as double) AS x", "3.0 * (id % 50) + 1 AS label")
    train, test = split(df.selectExpr("id", "x", "cast(label as double) AS label"), ["id"], 0.25, 3)
    task = Task(train, test, ["id"], "label", REGRESSION, [], ["x"], seed=3)
    model = fit_baseline(task, folds=2, max_iter=20)
    assert len(model.cv_scores) == len(model.cv_absolute) == 8
    assert min(s for _, s in model.cv_scores) < 0.1 and min(s for _, s in model.cv_absolute) < 0.3
    assert task.baseline_performance().first()[0] < 0.1


def test_image_baseline_tells_dark_from_bright(spark):
    df = spark.range(120).selectExpr("id", "2 AS height", "2 AS width", "if(id % 2 = 0, 7, 9) AS label",
                                     "transform(sequence(0, 3), i -> cast(if(id % 2 = 0, 40, 200) + (id * 7 + i * 3) % 30 as int)) AS pixels")
    task = image_style(df, ["id"], "label", 7, 9, seed=3)
    scorer = fit_image_baseline(task, hidden=4, max_iter=30)
    assert task.performance(scorer).first()[0] == 1.0
    assert fit_image_baseline(task) is scorer


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.range(300).selectExpr("id", "cast(id % 30 as double) AS x", "cast(id % 3 as string) AS g",
                                       "if(id % 5 = 0, null, concat('v', id % 3)) AS c")


def test_learned_imputer_fills_only_the_gaps(gaps):
    filled = fit_learned_imputer(gaps, "c", ["x"], ["g"]).transform(gaps)
    assert filled.columns == gaps.columns
    assert filled.where("c <> concat('v', id % 3) or c is null").count() == 0


def test_learned_imputer_of_many_classes_takes_the_conditional_mode(gaps):
    imputer = fit_learned_imputer(gaps, "c", ["x"], ["g"], max_classes=2)
    assert isinstance(imputer, ConditionalMode)
    assert imputer.transform(gaps).where("c <> concat('v', g) or c is null").count() == 0
