"""Huber regressions fitted side by side against MLlib's learner, one fit at a time."""

from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from tarnish.operators import huber, logistic, models
from tarnish.operators.linear import SUMS_DDL, Design, added_up, design_cells
from tarnish.operators.models import fit_baseline, learners, with_folds
from tarnish.plans.task import REGRESSION, Task
from tarnish.session import ship

ROUGH = "100 * (id % 37) + 9 * (id % 5) + if(id % 19 = 0, 5000, id % 7)"
SMALL = "(id % 37) / 10 + id % 5 + if(id % 19 = 0, 50, id % 7 / 7)"


def _rows(spark, label):
    return spark.range(900).selectExpr(
        "id", "if(id % 11 = 0, null, cast(id % 37 as double)) AS x", "if(id % 13 = 0, double('nan'), 100000 + id % 5) AS y",
        "if(id % 17 = 0, null, element_at(array('a', 'b', 'c', 'd'), cast(pmod(xxhash64(id, 1), 4) + 1 as int))) AS c", f"cast({label} as double) AS label")


def _packed(rows, design):
    ship(rows.sparkSession)
    packed = design_cells(rows, design).mapInArrow(partial(logistic._packed, design=design, classes=False), logistic.PACKED_DDL)
    return packed, added_up(packed.mapInArrow(partial(logistic._packed_sums, design=design, label_type=np.float64), SUMS_DDL), design, 2)


@pytest.mark.parametrize("label, max_iter", [(ROUGH, 12), (SMALL, 50)])
def test_as_the_learner_fits_each_alone(spark, label, max_iter):
    df = _rows(spark, label)
    rows = with_folds(df.withColumnRenamed("label", "_label"), ["id"], 2, 3).cache()
    design = models.design_of(rows, ["x", "y"], ["c"])
    packed, sums = _packed(rows, design)
    scorers, residuals = huber.fit_huber(packed, design, sums, models.ALPHAS, max_iter)
    square, absolute = huber.held_out_errors(packed, design, residuals) / sums[:, 0, 0][:, None]
    grid = [g for g in learners("regression", max_iter) if g[0]["loss"] == "huber"]
    imputers, features, fitted = models._fit_all(rows, ["x", "y"], ["c"], [], grid)
    for scorer, model in zip(scorers, fitted):
        alone = models.ChainedScorer(models.ModelScorer(models.PipelineModel([features, model]), "regression"), imputers)
        both = scorer.score(alone.score(df, "alone"), "score").select("alone", "score").toPandas()
        assert np.allclose(both["alone"], both["score"], rtol=1e-6, atol=1e-6)
    parts = models._fit_all(rows.where("_fold <> 1"), ["x", "y"], ["c"], [], grid)
    held = models._held_out_scores(*parts, "regression", rows.where("_fold = 1"))
    assert [s for s, _ in held] == pytest.approx(square[1].tolist(), rel=1e-6)
    assert [a for _, a in held] == pytest.approx(absolute[1].tolist(), rel=1e-6)


def test_regression_baseline_scans_once_for_all_folds_and_penalties(spark, monkeypatch):
    fits, together = [], huber.side_by_side
    monkeypatch.setattr(models, "_fit_all", lambda *_: pytest.fail("a learner was fitted alone"))
    monkeypatch.setattr(huber, "side_by_side", lambda runs, losses: fits.append(len(runs)) or together(runs, losses))
    df = _rows(spark, SMALL)
    task = Task(df, df, ["id"], "label", REGRESSION, ["c"], ["x", "y"], seed=3)
    model = fit_baseline(task, max_iter=5)
    assert fits == [24]
    assert [s["loss"] for s, _ in model.cv_scores] == ["squaredError"] * 4 + ["huber"] * 4
    assert all(0 < s < 1e4 for side in (model.cv_scores, model.cv_absolute) for _, s in side)


@pytest.mark.parametrize("x, label", [("x", "7"), ("if(x > 30, double('infinity'), x)", SMALL), ("cast(null as double)", SMALL), ("x", "if(id = 9, double('nan'), id)")])
def test_leaves_other_rows_to_the_learner(spark, x, label):
    rows = with_folds(_rows(spark, label).selectExpr("id", f"{x} AS x", "c", "label AS _label"), ["id"], 2, 3)
    design = models.design_of(rows, ["x"], ["c"])
    packed, sums = _packed(rows, design)
    assert huber.fit_huber(packed, design, sums, models.ALPHAS, 3) is None


def test_losses_at_the_smallest_scale_and_at_others():
    rng = np.random.default_rng(2)
    n = 2500
    batch = pa.RecordBatch.from_pydict({"x": pa.array(rng.normal(size=n) * 3), "_label": pa.array(rng.normal(size=n) * 9),
                                        "_fold": pa.array(rng.integers(0, 2, n), pa.int32())})
    design = Design(("x",), {}, {"x": 0.0, "_label": 0.0})
    residuals, scales, left_out = np.append(rng.normal(size=(design.width - 1, 3)), np.ones((1, 3)), axis=0), np.array([huber.SMALLEST, 0.5, 20.0]), np.array([-1, 0, 1])
    found, = huber._losses(logistic._packed(iter([batch]), design, classes=False), design, residuals, scales, left_out)
    totals = found.column("v").to_numpy().reshape(design.width + 2, 3)
    rows, folds, e = design.rows(batch), batch.column("_fold").to_numpy(), huber.EPSILON
    for i, (fold, scale) in enumerate(zip(left_out, scales)):
        used = rows[folds != fold]
        off = used @ residuals[:, i]
        near = np.abs(off) <= e * scale
        with np.errstate(over="ignore"):
            loss = np.where(near, (scale + off ** 2 / scale) / 2, (scale + 2 * e * np.abs(off) - scale * e * e) / 2)
            by_scale = np.where(near, (1 - (off / scale) ** 2) / 2, (1 - e * e) / 2)
            slope = -np.where(near, off / scale, np.sign(off) * e)
        assert totals[-1, i] == pytest.approx(loss.sum(), rel=1e-12) and totals[-2, i] == pytest.approx(by_scale.sum(), rel=1e-9)
        assert np.allclose(totals[:-3, i], used[:, :-1].T @ slope, rtol=1e-10)


@pytest.mark.parametrize("middle, found", [((2.0, 2.0, 3.0), (2.0, 2.0, 3.0)), ((2.0, -4.0, -1.0), (2.0, -4.0, 0.5))])
def test_a_bound_is_kept(middle, found):
    middle, curve = np.array(middle), np.array([1.0, 30.0, 5.0])
    run = huber.minimise_bounded(np.ones(3), np.array([-1e300, -1e300, 0.5]), 50)
    point = next(run)
    with pytest.raises(StopIteration) as end:
        for _ in range(500):
            assert point[2] >= 0.5
            point = run.send((1e-3 + float(curve @ (point - middle) ** 2), 2 * curve * (point - middle)))
    assert np.allclose(end.value.value, found, atol=1e-2)
