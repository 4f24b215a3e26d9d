"""Schema stress test: which harmful corruptions does a schema catch, and which not?"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tarnish.functions.rand import scalar_uniform
from tarnish.operators.corrupt import (
    BrokenCharacters, Corruption, GaussianNoise, MissingValues, Scaling, SwappedValues,
)
from tarnish.operators.schema import Schema, has_anomaly, validate
from tarnish.operators.scoring import Scorer
from tarnish.plans.evaluate import ImpactEvaluator
from tarnish.plans.task import Task

# Share of swaps, and the kinds of damage per column role.
SWAP_SHARE = 0.1
NUMERIC_KINDS = ("missing", "noise", "scaling")
STRING_KINDS = ("missing", "encoding")
MISSINGNESS = ("MCAR", "MAR", "MNAR")


def random_corruptions(task: Task, count: int, seed: object) -> list[Corruption]:
    """Random descriptions; a role is drawn in proportion to its number of columns."""
    roles = [("numerical", task.numerical), ("categorical", task.categorical), ("text", task.text)]
    total = sum(len(columns) for _, columns in roles)

    def draw(i: int, tag: str) -> float:
        return scalar_uniform(seed, tag, i)

    def choose(options: Sequence, i: int, tag: str):
        return options[math.floor(len(options) * draw(i, tag))]

    found: list[Corruption] = []
    for i in range(count):
        share, at = 0.0, draw(i, "type")
        for role, columns in roles:
            share += len(columns) / total
            if at < share:
                break
        fraction = math.floor(100 * draw(i, "frac")) / 100
        column = choose(columns, i, "column")
        if len(columns) >= 2 and draw(i, "swap?") < SWAP_SHARE:
            partner = choose([c for c in columns if c != column], i, "partner")
            found.append(SwappedValues(column, fraction, swap_with=partner))
            continue
        kind = choose(NUMERIC_KINDS if role == "numerical" else STRING_KINDS, i, "kind")
        if kind == "missing":
            na = None if role == "numerical" else ""
            found.append(MissingValues(column, fraction, choose(MISSINGNESS, i, "mechanism"), na_value=na))
        elif kind == "noise":
            found.append(GaussianNoise(column, fraction))
        elif kind == "scaling":
            found.append(Scaling(column, fraction))
        else:
            found.append(BrokenCharacters(column, fraction))
    return found


def classify(results: DataFrame, threshold: float, larger_is_better: bool = True) -> DataFrame:
    """Add the relative drop and TP / FP / FN / TN: anomaly found against real harm done."""
    drop = (F.col("baseline_score") - F.col("corrupted_score")) / F.col("baseline_score")
    if not larger_is_better:
        drop = -drop
    harmful = F.coalesce(F.col("drop") > F.lit(threshold), F.lit(True))
    return results.withColumn("drop", drop).withColumn(
        "status",
        F.when(F.col("anomaly_detected") & harmful, "TP").when(F.col("anomaly_detected"), "FP")
        .when(harmful, "FN").otherwise("TN"))


def stress_test(task: Task, scorer: Scorer, schema: Schema, count: int, threshold: float,
                seed: object | None = None) -> DataFrame:
    """Apply ``count`` random corruptions and compare detection with impact.

    The schema has to accept the clean test data first.
    """
    if has_anomaly(validate(task.test.select(*task.features), schema)):
        raise ValueError("the schema does not accept the clean test data")
    corruptions = random_corruptions(task, count, task.seed if seed is None else seed)
    results = ImpactEvaluator(task, scorer, schema).evaluate(corruptions, 1)
    return classify(results, threshold, task.larger_is_better)


def status_counts(outcome: DataFrame) -> DataFrame:
    return outcome.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
