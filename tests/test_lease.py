"""Stored steps go with their lease, and an evaluation leaves the shared folder as it was."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tarnish.operators.corrupt import CategoricalShift, MissingValues
from tarnish.operators.scoring import LinearScorer
from tarnish.plans.evaluate import SchemaEvaluator
from tarnish.plans.task import BINARY, Task, split
from tarnish.session import cut_lineage, inherited, shared_folder, stored_steps


def held(spark):
    return set(os.listdir(shared_folder(spark).removeprefix("file://")))


def evaluated(spark):
    rows = spark.range(400).select("id", (F.col("id") % 7).alias("x"), F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("c"),
                                   (F.col("id") % 2).cast("int").alias("label"))
    task = Task(*split(rows, ["id"], 0.5, 1), ["id"], "label", BINARY, ["c"], ["x"], seed=1).checkpointed()
    scorer = LinearScorer(0.0, {"x": (1.0, 3.0)}, {"c": {"c1": 0.5}})
    return SchemaEvaluator(task, scorer).evaluate([MissingValues("x", 0.3, "NAR"), CategoricalShift("c", 0.5)], 2).collect()


def test_an_evaluation_leaves_the_shared_folder_as_it_was(spark):
    before = held(spark)
    with stored_steps(spark) as lease:
        assert len(evaluated(spark)) == 4 and len(lease.paths) > 2 and held(spark) > before
    assert held(spark) == before and not lease.paths


def test_released_after_a_failure(spark):
    before = held(spark)
    with pytest.raises(Exception, match="too small"), stored_steps(spark):
        cut_lineage(spark.range(5)).count()
        cut_lineage(spark.range(5).select(F.raise_error(F.lit("too small")).alias("x")))
    assert held(spark) == before


def test_leases_nest_and_threads_inherit(spark):
    before = held(spark)
    with stored_steps(spark) as outer:
        kept = cut_lineage(spark.range(3))
        with stored_steps(spark) as inner, ThreadPoolExecutor(2) as pool:
            made = list(pool.map(inherited(lambda n: cut_lineage(spark.range(n)).count()), [4, 5]))
            assert made == [4, 5] and len(inner.paths) == 2 and len(outer.paths) == 1
        assert kept.count() == 3 and held(spark) - before == {os.path.basename(outer.paths[0])}
    assert held(spark) == before
    outside = cut_lineage(spark.range(2))
    assert outside.count() == 2 and len(held(spark) - before) == 1
