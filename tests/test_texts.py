"""Logistic regressions over hashed texts fitted side by side against MLlib's learner, one fit at a time."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark import StorageLevel

from tarnish.operators import models, texts
from tarnish.operators.features import TEXT_DIMENSIONS
from tarnish.operators.linear import Design
from tarnish.operators.models import fit_baseline, learners, with_folds
from tarnish.plans.task import BINARY, Task

ROWS = "id int, x double, c string, t string, u string, label int"


def _rows(spark, n=160):
    draw = random.Random(4)
    words = [f"word{i}" for i in range(30)]
    rows = []
    for i in range(n):
        label = int(draw.random() < 0.4)
        t = " ".join(draw.choices(words[:20 + 10 * label], k=draw.randrange(12)))
        rows.append((i, None if i % 9 == 0 else draw.gauss(1e4 + 3 * label, 5.0), None if i % 7 == 0 else draw.choice("abc"),
                     None if i % 11 == 0 else t, "" if i % 5 else f"same word{i % 3}", label))
    return spark.createDataFrame(rows, ROWS).repartition(3)


@pytest.mark.parametrize("numerical, categorical, text, max_iter", [(["x"], ["c"], ["t", "u"], 4), ([], [], ["t"], 12)])
def test_as_the_learner_fits_each_alone(spark, monkeypatch, numerical, categorical, text, max_iter):
    df = _rows(spark)
    fitted, stored, plain = [], [], models._fit_all
    monkeypatch.setattr(models, "_fit_all", lambda *parts: fitted.extend(parts[-1]) or plain(*parts))
    kept = type(df).persist
    monkeypatch.setattr(type(df), "persist", lambda self, *level: stored.extend(level or ["memory"]) or kept(self, *level))
    task = Task(df, df, ["id"], "label", BINARY, categorical, numerical, text, seed=3)
    model = fit_baseline(task, folds=2, max_iter=max_iter)
    assert not fitted and stored == [StorageLevel.DISK_ONLY]
    monkeypatch.undo()
    rows = with_folds(df.selectExpr("*", "cast(label as double) AS _label"), ["id"], 2, 3).cache()
    grid = learners(BINARY, max_iter)
    scores = []
    for fold in range(2):
        parts = models._fit_all(rows.where(f"_fold <> {fold}"), numerical, categorical, text, grid)
        scores.append([s for s, _ in models._held_out_scores(*parts, BINARY, rows.where(f"_fold = {fold}"))])
    assert [s for _, s in model.cv_scores] == pytest.approx(np.mean(scores, axis=0).tolist(), abs=1e-9)
    imputers, features, (alone,) = models._fit_all(rows, numerical, categorical, text, [g for g in grid if g[0] == model.best])
    scorer = models.ChainedScorer(models.ModelScorer(models.PipelineModel([features, alone])), imputers)
    both = scorer.score(model.score(task.test, "score"), "alone").select("alone", "score").toPandas()
    assert np.allclose(both["alone"], both["score"], rtol=1e-6, atol=1e-9)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def _batch(terms, label, fold):
    column = pa.StructArray.from_arrays([pa.array([sorted(t) for t in terms], pa.list_(pa.int32())),
                                         pa.array([[float(t[k]) for k in sorted(t)] for t in terms], pa.list_(pa.float64()))], ["indices", "values"])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(terms)) / 2.0), pa.array(label, pa.float64()), pa.array(fold, pa.int32()), column],
                                      ["x", "_label", "_fold", "_text0_tf"])


TERMS = [{3: 1, 9999: 2}, {}, {0: 70000, 3: 1}, {3: 1, 9999: 2}, {5: 4}, {}]
DESIGN = Design(("x",), {}, {"x": 1.0, "_label": 0.0})


def _dense(terms):
    x = np.zeros((len(terms), TEXT_DIMENSIONS))
    for row, t in zip(x, terms):
        row[list(t)] = list(t.values())
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def test_blocks_hold_all_terms_whatever_their_counts():
    packed = list(texts._packed(iter([_batch(TERMS, [0, 1, 0, 1, 1, 0], [0, 1, 2, 0, 1, 1])]), DESIGN, 1))
    found = {b.fold: b for b in texts._blocks(iter(packed), DESIGN, 1)}
    assert sorted(found) == [0, 1, 2] and packed[0].column("wide").to_pylist() == [False, False, True]
    for fold, own in ((0, [0, 3]), (1, [1, 4, 5]), (2, [2])):
        x = np.zeros((len(own), TEXT_DIMENSIONS))
        x[np.repeat(np.arange(len(own)), found[fold].terms), found[fold].places] = found[fold].values
        assert np.allclose(x, _dense([TERMS[i] for i in own])) and np.array_equal(found[fold].columns[1], np.array(own) / 2 - 1)
        assert found[fold].columns[-1].tolist() == [[0, 1, 0, 1, 1, 0][i] for i in own]


def test_losses_gradients_and_margins_of_all_fits_at_once():
    label, folds = np.array([0.0, 1, 0, 1, 1, 0]), np.array([0, 1, 0, 0, 1, 1])
    packed = list(texts._packed(iter([_batch(TERMS, label, folds)]), DESIGN, 1))
    rng = np.random.default_rng(3)
    weights, left_out = rng.normal(size=(DESIGN.width + TEXT_DIMENSIONS, 3)), np.array([-1, 0, 1])
    weights[DESIGN.width - 1] = 0.0
    totals = {k: np.frombuffer(t) for b in texts._added(texts._losses(iter(packed), DESIGN, 1, weights, left_out))
              for k, t in zip(b.column("k").to_pylist(), b.column("total").to_pylist())}
    columns = np.stack([np.ones(6), np.arange(6) / 2 - 1, np.zeros(6), label], axis=1)
    x = np.hstack([columns, _dense(TERMS)])
    for i, fold in enumerate(left_out):
        used, y = x[folds != fold], label[folds != fold]
        z = used @ weights[:, i]
        assert totals[i][-1] == pytest.approx((np.logaddexp(0, z) - y * z).sum(), rel=1e-12)
        assert np.allclose(totals[i][:-1], used.T @ (1 / (1 + np.exp(-z)) - y), atol=1e-12)
    by_fold = np.stack([weights[:, :2], weights[:, 1:]])
    found = pa.Table.from_batches(list(texts._margins(iter(packed), DESIGN, 1, by_fold))).to_pydict()
    order = np.argsort(folds, kind="stable")
    assert found["_fold"] == folds[order].tolist()
    assert np.allclose(np.stack([found["_m0"], found["_m1"]], axis=1), np.stack([x[i] @ by_fold[folds[i]] for i in order]))
