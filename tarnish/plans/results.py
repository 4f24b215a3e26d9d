"""Summaries of evaluation results and augmentation of training data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tarnish.operators.corrupt import Corruption
from tarnish.operators.sampling import KeyedTable, bootstrap

SCENARIO = ["scenario_id", "corruption", "kind", "column", "fraction", "sampling"]


def mean_scores(results: DataFrame, by: list[str] = SCENARIO) -> DataFrame:
    return results.groupBy(*by).agg(F.avg("baseline_score").alias("baseline_score"),
                                    F.avg("corrupted_score").alias("mean_score"))


def median_scores(results: DataFrame, by: list[str] = SCENARIO) -> DataFrame:
    """Exact median; a group holds one value per repetition."""
    return results.groupBy(*by).agg(F.percentile("corrupted_score", F.lit(0.5)).alias("median_score"))


def box_scores(results: DataFrame, by: list[str] = SCENARIO) -> DataFrame:
    """Quartiles and whiskers: the extreme values within 1.5 interquartile ranges."""
    x = F.col("corrupted_score")
    quarts = F.percentile("corrupted_score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    boxed = results.withColumn("_q", quarts.over(Window.partitionBy(*by)))
    q1, q2, q3 = (F.col("_q")[i] for i in range(3))
    reach = (q3 - q1) * F.lit(1.5)
    near = F.when((x >= q1 - reach) & (x <= q3 + reach), x)
    return boxed.groupBy(*by).agg(
        F.first(q1).alias("q1"), F.first(q2).alias("median"), F.first(q3).alias("q3"),
        F.min(near).alias("whisker_low"), F.max(near).alias("whisker_high"))


def find_result(results: DataFrame, column: str, fraction: float, sampling: str) -> DataFrame:
    return results.where((F.col("column") == column) & (F.col("fraction") == fraction)
                         & (F.col("sampling") == sampling))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Values of a column by falling frequency."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column))


def side_by_side(df: DataFrame, key: list[str], corruptions: dict[str, object], seed: object = 0) -> DataFrame:
    """The table with one extra column per corrupted version of a column.

    Each version is computed from the original table.  Corruptions that look at one row only
    are added side by side in one projection; any other is attached by key.
    """
    features = [c for c in df.columns if c not in key]
    hashed = KeyedTable(df, key, seed)
    versions, out = {}, hashed.df
    for name, c in corruptions.items():
        if isinstance(c, Corruption) and type(c)._transform is Corruption._transform:
            own = f"{seed}/{name}"
            table = KeyedTable(hashed.df, key, own, rows=hashed.rows)
            versions[name] = c.bind(features, own).cell(table, own, features)
    out = out.withColumns(versions) if versions else out
    for name, c in corruptions.items():
        if name not in versions:
            damaged = c.transform(df, key, f"{seed}/{name}", features=features)
            out = out.join(damaged.select(*key, F.col(c.column).alias(name)), key)
    return out.select(*df.columns, *corruptions)


def augment(df: DataFrame, key: list[str], make_corruption, severities: list[int], sample: int, seed: object = 0) -> DataFrame:
    """Original rows plus, for each severity, ``sample`` rows drawn with replacement and corrupted.

    ``make_corruption(severity)`` gives an object with ``transform``; sampled rows are keyed
    by their draw number, so copies of one row are damaged independently.  The columns
    ``severity`` (0 = original) and ``draw`` tell the parts apart.
    """
    parts = [df.withColumn("severity", F.lit(0)).withColumn("draw", F.lit(None).cast("bigint"))]
    for severity in severities:
        drawn = bootstrap(df, key, sample, f"{seed}/{severity}")
        damaged = make_corruption(severity).transform(drawn, ["draw"], f"{seed}/{severity}")
        parts.append(damaged.withColumn("severity", F.lit(severity)))
    return reduce(lambda a, b: a.unionByName(b), parts)
