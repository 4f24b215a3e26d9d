"""What an evaluation and the checks of a task scan again and again: written once, in code the JVM compiles."""

import pytest

from catalog import load_all
from tarnish.operators.scoring import LinearScorer
from tarnish.plans import task as tasks
from tarnish.plans.evaluate import ImpactEvaluator
from tarnish.plans.task import BINARY, MULTICLASS, Task, split
from tarnish.session import JIT_BYTES

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def lines(spark, path, n=400):
    spark.range(n).selectExpr(
        "id AS l_orderkey", "id % 7 AS l_partkey", "id % 5 AS l_suppkey", "CAST(id % 3 AS int) AS l_linenumber",
        "CAST(id % 50 + 1 AS double) AS l_quantity", "CAST(id * 37 % 1001 AS double) AS l_extendedprice",
        "id % 11 / 100D AS l_discount", "id % 9 / 100D AS l_tax", "substr('ANR', id % 3 + 1, 1) AS l_returnflag",
        "substr('OF', id % 2 + 1, 1) AS l_linestatus", "TIMESTAMP_NTZ '1996-01-01 00:00:00' AS l_shipdate").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("given, kept", [(65535, JIT_BYTES), (3000, 3000)])
def test_an_evaluation_runs_in_methods_that_are_compiled(spark, given, kept):
    rows = spark.range(10).selectExpr("id", "id % 2 AS label", "id / 2D AS x")
    spark.conf.set(LIMIT, str(given))
    try:
        ImpactEvaluator(Task(rows, rows, ["id"], "label", BINARY, [], ["x"]), LinearScorer(0.0, {"x": (1.0, 0.0)}))
        assert int(spark.conf.get(LIMIT)) == kept
    finally:
        spark.conf.unset(LIMIT)


def test_regression_scans_hash_no_key(spark, tmp_path):
    assert "md5" not in plan_of(load_all()["impact_regression"].run(spark, lines(spark, tmp_path)))


def test_task_checks_hash_no_key(spark, tmp_path, monkeypatch):
    seen, plain = [], tasks.label_task_type

    def spied(train, test, label, closed=None):
        seen.extend([plan_of(train.select(label)), plan_of(test.select(label))])
        return plain(train, test, label, closed=closed)

    monkeypatch.setattr(tasks, "label_task_type", spied)
    found = load_all()["task_checks"].run(spark, lines(spark, tmp_path)).collect()
    assert [r.fits for r in found] == [True, False, True, False, True, False, False]
    assert seen and not any("md5" in p for p in seen)


def test_stored_split_gives_the_same_rows(spark):
    rows = spark.range(100).selectExpr("id", "nullif(id % 4, 0) AS x")
    for plain, stored in zip(split(rows, ["id"], 0.2, 7), split(rows, ["id"], 0.2, 7, stored=True)):
        assert plain.columns == stored.columns and sorted(plain.collect()) == sorted(stored.collect())


def test_a_fit_uses_all_cores_however_few_files_its_rows_come_from(spark, monkeypatch):
    from tarnish.operators import models

    seen, plain = [], models._fit_all

    def spied(train, *rest):
        seen.append(train.rdd.getNumPartitions())
        return plain(train, *rest)

    monkeypatch.setattr(models, "_fit_all", spied)
    rows = spark.range(0, 2000, 1, 1).selectExpr(
        "if(id % 2 = 0, NULL, id) AS id", "CAST(id * 37 % 101 > 50 AS int) AS label", "id * 53 % 97 / 2D AS x", "id % 3 AS c")
    models.fit_baseline(Task(rows, rows, ["id"], "label", BINARY, ["c"], ["x"], seed=3))
    assert len(seen) == 6 and min(seen) > 1


def test_a_fit_of_three_classes_uses_all_cores_however_few_files_its_rows_come_from(spark, monkeypatch):
    from tarnish.operators import models

    seen, plain = [], models._fit_all

    def spied(train, *rest):
        seen.append(train.rdd.getNumPartitions())
        return plain(train, *rest)

    monkeypatch.setattr(models, "_fit_all", spied)
    rows = spark.range(0, 2000, 1, 1).selectExpr(
        "if(id % 2 = 0, NULL, id) AS id", "CAST(id * 37 % 101 % 3 AS int) AS label", "id * 53 % 97 / 2D AS x", "id % 3 AS c")
    models.fit_baseline(Task(rows, rows, ["id"], "label", MULTICLASS, ["c"], ["x"], seed=3), max_iter=2)
    assert len(seen) == 6 and min(seen) > 1
