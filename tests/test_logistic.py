"""Logistic regressions fitted side by side against MLlib's learner, one fit at a time."""

import numpy as np
import pyarrow as pa
import pytest

from catalog.evaluation import bulk_task
from tarnish.operators import logistic, models
from tarnish.operators.linear import Design
from tarnish.operators.models import fit_baseline, learners, with_folds
from tarnish.operators.corrupt import MissingValues
from tarnish.plans import task as plans
from tarnish.plans.evaluate import ImpactEvaluator
from tarnish.plans.task import BINARY, Task, split

HARD = "pmod(xxhash64(id), 100) < 20 + id % 37"
LINE = "id % 37 + 3 * (id % 5) > 24"


def _rows(spark, label):
    return spark.range(1500).selectExpr(
        "id", "if(id % 11 = 0, null, cast(id % 37 as double)) AS x", "if(id % 13 = 0, double('nan'), 100000 + id % 5) AS y",
        "if(id % 17 = 0, null, element_at(array('a', 'b', 'c', 'd'), cast(pmod(xxhash64(id, 1), 4) + 1 as int))) AS c", f"cast({label} as int) AS label")


def _task(spark, label):
    train, test = split(_rows(spark, label), ["id"], 0.25, 3)
    return Task(train, test, ["id"], "label", BINARY, ["c"], ["x", "y"], seed=3)


@pytest.mark.parametrize("label, max_iter", [(HARD, 4), (LINE, 50)])
def test_as_the_learner_fits_each_alone(spark, label, max_iter):
    task = _task(spark, label)
    rows = with_folds(task.train.selectExpr("id", "x", "y", "c", "cast(label as double) AS _label"), ["id"], 3, 3)
    design = models.design_of(rows, ["x", "y"], ["c"])
    scorers, scores = logistic.fit_logistic(rows, design, 3, models.ALPHAS, max_iter)
    grid = learners("binary", max_iter)
    imputers, features, fitted = models._fit_all(rows, ["x", "y"], ["c"], [], grid)
    for scorer, model in zip(scorers, fitted):
        alone = models.ChainedScorer(models.ModelScorer(models.PipelineModel([features, model])), imputers)
        both = scorer.score(alone.score(task.test, "alone"), "score").select("alone", "score").toPandas()
        assert np.allclose(both["alone"], both["score"], rtol=1e-6, atol=1e-9)
    for fold in range(3):
        parts = models._fit_all(rows.where(f"_fold <> {fold}"), ["x", "y"], ["c"], [], grid)
        held = models._held_out_scores(*parts, "binary", rows.where(f"_fold = {fold}"))
        assert [s for s, _ in held] == pytest.approx([s[fold] for s in scores], abs=1e-9)


def test_binary_baseline_scans_once_for_all_folds_and_penalties(spark, monkeypatch):
    scans, summed = [], logistic._fitted
    monkeypatch.setattr(models, "_fit_all", lambda *_: pytest.fail("a learner was fitted alone"))
    monkeypatch.setattr(logistic, "_fitted", lambda cells, design, fits, max_iter: scans.append(len(fits)) or summed(cells, design, fits, max_iter))
    task = _task(spark, HARD)
    model = fit_baseline(task)
    assert scans == [24] and len(model.cv_scores) == 4
    assert task.baseline_performance().first()[0] > 0.6


@pytest.mark.parametrize("x, y, label", [("if(x > 30, double('infinity'), x)", "y", "label"), ("x", "cast(null as double)", "label"),
                                         ("x", "y", "label + 1"), ("x", "y", "if(id = 7, 1, 0)")])
def test_leaves_other_rows_to_the_learner(spark, x, y, label):
    rows = _rows(spark, HARD).selectExpr("id", f"{x} AS x", f"{y} AS y", "c", f"cast({label} as double) AS _label")
    rows = with_folds(rows, ["id"], 3, 3)
    assert logistic.fit_logistic(rows, models.design_of(rows, ["x", "y"], ["c"]), 3, models.ALPHAS, 5) is None


def test_no_length_is_found_on_a_line_that_never_ends():
    run = logistic.minimise(np.zeros(1), 50)
    point = next(run)
    with pytest.raises(StopIteration):
        for _ in range(50):
            point = run.send((-float(point[0]), np.array([-1.0])))


def test_impact_on_a_fitted_model_fits_no_learner_alone(spark, monkeypatch):
    monkeypatch.setattr(models, "_fit_all", lambda *_: pytest.fail("a learner was fitted alone"))
    task = _task(spark, HARD)
    rows = ImpactEvaluator(task, fit_baseline(task)).evaluate([MissingValues("x", 0.5, na_value=-999)], 1).collect()
    assert [r["corrupted_score"] < r["baseline_score"] for r in rows] == [True]


def test_a_scan_reads_blocks_of_rows(spark, monkeypatch):
    """A block for each fold of a batch, whatever its rows, goes from the JVM to Python, not a row at a time."""
    seen, fitted = [], logistic._fitted
    monkeypatch.setattr(logistic, "_fitted", lambda rows, design, fits, max_iter: seen.append(rows.count()) or fitted(rows, design, fits, 1))
    task = _task(spark, HARD)
    parts = spark.sparkContext.defaultParallelism
    fit_baseline(task)
    assert seen and seen[0] <= 5 * parts < task.train.count() / 10


@pytest.mark.parametrize("numerical, levels", [(("x", "y"), {"c": ("a", "b"), "d": ()}), (("x",), {}), ((), {"c": ("a", "b")})])
def test_blocks_hold_all_rows_by_fold(monkeypatch, numerical, levels):
    monkeypatch.setattr(logistic, "PACK", 3)
    monkeypatch.setattr(logistic, "BLOCK", 2)
    rng = np.random.default_rng(1)
    batch = pa.RecordBatch.from_pydict({
        "x": pa.array([1.5, None, float("inf"), -0.0, 7.0, None, 2.0, 3.0], pa.float64()), "y": pa.array(rng.normal(size=8)),
        "c": pa.array(["a", None, "b", "?", "a", "b", "a", "b"]), "d": pa.array([None] * 8, pa.string()),
        "_label": pa.array([0.0, 1, 1, 0, 1, 0, 0, 1]), "_fold": pa.array([0, 1, 1, 0, 4, 4, 1, 1], pa.int32())})
    design = Design(numerical, levels, {"x": 0.5, "y": 1.0, "_label": 0.0})
    found = {}
    for fold, fits, x in logistic._blocks(logistic._packed(iter([batch]), design), design):
        assert fits and x.shape[1] <= 2
        found.setdefault(fold, []).append(x)
    rows, folds = design.rows(batch), batch.column("_fold").to_numpy()
    assert sorted(found) == [0, 1, 4]
    for fold, parts in found.items():
        assert np.array_equal(np.concatenate(parts, axis=1).T, rows[folds == fold])


def test_losses_and_gradients_of_all_fits_at_once():
    rng = np.random.default_rng(2)
    n = 2500
    batch = pa.RecordBatch.from_pydict({"x": pa.array(rng.normal(size=n) * 300), "_label": pa.array(rng.integers(0, 2, n).astype(float)),
                                        "_fold": pa.array(rng.integers(0, 2, n), pa.int32())})
    design = Design(("x",), {}, {"x": 0.0, "_label": 0.0})
    weights, left_out = np.append(rng.normal(size=(design.width - 1, 3)) * 3, np.zeros((1, 3)), axis=0), np.array([-1, 0, 1])
    found, = logistic._losses(logistic._packed(iter([batch]), design), design, weights, left_out)
    totals = found.column("v").to_numpy().reshape(design.width + 1, 3)
    rows, folds = design.rows(batch), batch.column("_fold").to_numpy()
    for i, fold in enumerate(left_out):
        used = rows[folds != fold]
        z, y = used @ weights[:, i], used[:, -1]
        assert totals[-1, i] == pytest.approx((np.logaddexp(0, z) - y * z).sum(), rel=1e-12)
        with np.errstate(over="ignore"):
            assert np.allclose(totals[:-2, i], used[:, :-1].T @ (1 / (1 + np.exp(-z)) - y), rtol=1e-10)


def test_a_label_that_is_no_class_is_seen(spark):
    batch = pa.RecordBatch.from_pydict({"x": pa.array([1.0, 2.0]), "_label": pa.array([1.0, 0.5]), "_fold": pa.array([0, 1], pa.int32())})
    design = Design(("x",), {}, {"x": 0.0, "_label": 0.0})
    sums = list(logistic._packed_sums(logistic._packed(iter([batch]), design), design))
    assert all(np.isnan(s.column("v").to_numpy()).all() for s in sums)


def test_the_table_is_read_and_marked_once_for_both_sides(spark, tmp_path, monkeypatch):
    lines = spark.range(300).selectExpr("id AS l_orderkey", "id % 7 AS l_partkey", "id % 3 AS l_suppkey", "1 AS l_linenumber", "timestamp '2000-01-01' AS l_shipdate",
                                        "cast(id % 50 AS double) AS l_quantity", "0.1D AS l_discount", "0.2D AS l_tax", "'A' AS l_returnflag",
                                        "if(id = 5, null, 'F') AS l_linestatus", "cast(l_quantity * (1 - l_discount) > 24 AS int) AS label")
    lines.drop("label").write.parquet(f"{tmp_path}/lineitem.parquet")
    written, cut = [], plans.cut_lineage
    monkeypatch.setattr(plans, "cut_lineage", lambda df: written.append(any("lineitem" in f for f in df.inputFiles())) or cut(df))
    task = bulk_task(spark, str(tmp_path), store_train=True)
    assert written == [True, False]
    assert (task.train.count(), task.test.count()) == (240, 60)
    both = task.train.unionByName(task.test.select(task.train.columns))
    assert both.exceptAll(lines.select(both.columns)).isEmpty()
