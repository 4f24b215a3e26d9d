"""Quality metrics, computed for every group (scenario, repetition) in one job.

The ROC AUC is exact and tie-aware.  Scores are first folded into a histogram of signed
positive and negative counts; the histogram is cut into score ranges so that no task sees
a whole group, each range is summed on its own, and ranges are combined through a table
with one row per group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tarnish.functions.concordance import SUMS_DDL, range_sums
from tarnish.session import ship


def is_positive(df: DataFrame, label: str, positive: object = 1) -> Column:
    """Is the label the positive class?  Booleans count as 0 and 1; text labels compare as text."""
    kind = df.schema[label].dataType
    if isinstance(kind, T.StringType):
        return F.col(label) == F.lit(str(positive))
    return F.col(label).cast("double") == F.lit(float(positive))


def score_histogram(df: DataFrame, score: str, label: str, by: list[str] = (), weight: Column | None = None,
                    positive: object = 1) -> DataFrame:
    """(by.., x, pos, neg): how often each score occurs with the positive label and with the other.

    Missing scores are counted under x NULL.
    """
    w = F.lit(1) if weight is None else weight
    positive = is_positive(df, label, positive)
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("x"))
        .agg(F.sum(F.when(positive, w).otherwise(0)).cast("bigint").alias("pos"),
             F.sum(F.when(positive, 0).otherwise(w)).cast("bigint").alias("neg"))
    )


def _cut_by_score(hist: DataFrame) -> DataFrame:
    """Number score ranges ``_r``; equal scores always fall into the same range."""
    return hist.repartitionByRange("x").withColumn("_r", F.spark_partition_id())


def _running(column: str, window) -> Column:
    """Double: counts multiply beyond BIGINT on large tables."""
    return F.coalesce(F.sum(F.col(column).cast("double")).over(window), F.lit(0.0))


def concordance(hist: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by.., pairs, pos, neg, blank): pairs = sum over pos of (neg below + half of neg tied).

    ``blank`` counts the labels without a score.
    """
    by = list(by)
    cut = _cut_by_score(hist)
    below = Window.partitionBy(*by, "_r").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    ranges = (
        cut.withColumn("_pairs", pos * (_running("neg", below) + neg * F.lit(0.5)))
        .groupBy(*by, "_r").agg(F.sum("_pairs").alias("pairs"), F.sum(pos).alias("pos"), F.sum(neg).alias("neg"),
                                F.sum(F.when(F.col("x").isNull(), pos + neg).otherwise(0.0)).alias("blank"))
    )
    earlier = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranges.withColumn("pairs", F.col("pairs") + F.col("pos") * _running("neg", earlier))
        .groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("pairs", "pos", "neg", "blank")])
    )


def auc_value(pairs: Column, pos: Column, neg: Column) -> Column:
    """NULL when one class is absent."""
    return F.when((pos > 0) & (neg > 0), pairs / (pos * neg))


def roc_auc(df: DataFrame, score: str, label: str, by: list[str] = (), into: str = "auc",
            positive: object = 1) -> DataFrame:
    """Exact area under the ROC curve of each group; NULL where a labelled row has no score."""
    by = list(by)
    sums = concordance(score_histogram(df, score, label, by, positive=positive), by)
    area = auc_value(F.col("pairs"), F.col("pos"), F.col("neg"))
    return sums.select(*by, F.when(F.col("blank") == 0, area).alias(into))


def shifted_auc(clean: DataFrame, delta: DataFrame, groups: int, labelled: int | None = None) -> DataFrame:
    """(idx, clean_score, shifted_score) for groups 0 .. ``groups`` - 1.

    With ``labelled``, the number of rows with a label, a side that does not score them all is NULL.

    ``clean`` is one score histogram, ``delta`` holds signed changes to it per group
    ``idx``.  The pair count is bilinear in positive and negative counts, so with clean
    counts P, N and changes dP, dN it moves by  (dP, N) + (P, dN) + (dP, dN).  Work and
    shuffle grow with the changed rows, not with groups times rows.  Spark cuts and sorts the
    rows by score; one pass over each range in Arrow batches adds them up.
    """
    columns = ["x", F.col("pos").cast("double").alias("pos"), F.col("neg").cast("double").alias("neg")]
    rows = clean.select(F.lit(-1).alias("idx"), *columns).unionByName(
        delta.select(F.col("idx").cast("int").alias("idx"), *columns)).where(F.col("x").isNotNull())
    sorted_ranges = _cut_by_score(rows).select("_r", "idx", "x", "pos", "neg").sortWithinPartitions("x")
    ship(clean.sparkSession)
    ranges = sorted_ranges.mapInArrow(range_sums(groups), SUMS_DDL)
    # every group gets a copy of the clean range totals: (ranges x groups) small rows
    everyone = F.sequence(F.lit(0), F.lit(groups - 1))
    sums = ["P", "N", "dP", "dN", "base", "moved"]
    dense = (
        ranges.withColumn("idx", F.explode(F.when(F.col("idx") < 0, everyone).otherwise(F.array("idx"))))
        .groupBy("idx", "_r").agg(*[F.sum(c).alias(c) for c in sums])
    )
    before = Window.partitionBy("idx").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("idx")
    n0, p0, own0 = _running("N", before), _running("P", before), _running("dN", before)
    total = (
        dense.withColumn("_b", F.col("base") + F.col("P") * n0)
        .withColumn("_m", F.col("moved") + F.col("dP") * (n0 + own0)
                    + F.col("dN") * (F.sum("P").over(whole) - p0))
        .groupBy("idx").agg(F.sum("_b").alias("b"), F.sum("_m").alias("m"),
                            F.sum("P").alias("P"), F.sum("N").alias("N"),
                            F.sum("dP").alias("dP"), F.sum("dN").alias("dN"))
    )
    p1, n1 = F.col("P") + F.col("dP"), F.col("N") + F.col("dN")

    def area(pairs: Column, pos: Column, neg: Column) -> Column:
        value = auc_value(pairs, pos, neg)
        return value if labelled is None else F.when(pos + neg == float(labelled), value)

    return total.select("idx", area(F.col("b"), F.col("P"), F.col("N")).alias("clean_score"),
                        area(F.col("b") + F.col("m"), p1, n1).alias("shifted_score"))


def _class_text(df: DataFrame, column: str) -> Column:
    """A class as text; numbers go through DOUBLE, so label 2 and prediction 2.0 are one class."""
    number = isinstance(df.schema[column].dataType, (T.NumericType, T.BooleanType))
    return (F.col(column).cast("double") if number else F.col(column)).cast("string")


def confusion(df: DataFrame, prediction: str, label: str, by: list[str] = (), weight: Column | None = None) -> DataFrame:
    """(by.., label, prediction, n), missing values counted as their own class."""
    w = F.lit(1) if weight is None else weight
    return df.groupBy(*by, _class_text(df, label).alias("label"), _class_text(df, prediction).alias("prediction")).agg(
        F.sum(w).cast("bigint").alias("n"))


def macro_f1_of(counts: DataFrame, by: list[str] = (), into: str = "macro_f1") -> DataFrame:
    """Unweighted mean of per-class F1 over all classes that occur as label or prediction."""
    by = list(by)
    sides = F.array(
        F.struct(F.col("label").alias("cls"), F.lit(1).alias("is_label"), F.lit(0).alias("is_pred")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).alias("is_label"), F.lit(1).alias("is_pred")))
    right = F.when(F.col("label").eqNullSafe(F.col("prediction")), F.col("n")).otherwise(0)
    per_class = (
        counts.withColumn("_right", right).withColumn("s", F.explode(sides))
        .groupBy(*by, F.col("s.cls").alias("cls"))
        .agg(F.sum(F.col("s.is_label") * F.col("_right")).alias("tp"),
             F.sum(F.col("s.is_label") * F.col("n")).alias("actual"),
             F.sum(F.col("s.is_pred") * F.col("n")).alias("predicted"))
        .where((F.col("actual") > 0) | (F.col("predicted") > 0))
    )
    # 2tp / (actual + predicted) is the harmonic mean, and 0 when the class is never right
    f1 = F.lit(2.0) * F.col("tp") / (F.col("actual") + F.col("predicted"))
    return per_class.groupBy(*by).agg(F.avg(f1).alias(into))


def macro_f1(df: DataFrame, prediction: str, label: str, by: list[str] = (), into: str = "macro_f1") -> DataFrame:
    return macro_f1_of(confusion(df, prediction, label, by), by, into)


def squared_error(prediction: str, label: str) -> Column:
    d = F.col(label).cast("double") - F.col(prediction).cast("double")
    return d * d


def absolute_error(prediction: str, label: str) -> Column:
    return F.abs(F.col(label).cast("double") - F.col(prediction).cast("double"))


def unscored(prediction: str, label: str) -> Column:
    """A labelled row without a prediction."""
    return F.col(prediction).isNull() & F.col(label).isNotNull()


def _mean_error(error: Column, prediction: str, label: str) -> Column:
    return F.when(F.count_if(unscored(prediction, label)) == 0, F.avg(error))


def mse(df: DataFrame, prediction: str, label: str, by: list[str] = (), into: str = "mse") -> DataFrame:
    """NULL where a labelled row has no prediction."""
    return df.groupBy(*by).agg(_mean_error(squared_error(prediction, label), prediction, label).alias(into))


def mae(df: DataFrame, prediction: str, label: str, by: list[str] = (), into: str = "mae") -> DataFrame:
    """NULL where a labelled row has no prediction."""
    return df.groupBy(*by).agg(_mean_error(absolute_error(prediction, label), prediction, label).alias(into))


# Metric of each task type and whether a larger value is better.
METRICS = {"binary": ("roc_auc", True), "multiclass": ("macro_f1", True), "regression": ("mse", False)}


def task_metric(df: DataFrame, task_type: str, score: str, label: str, by: list[str] = (),
                into: str = "value", positive: object = 1) -> DataFrame:
    """The metric that belongs to a task type."""
    if task_type == "binary":
        return roc_auc(df, score, label, by, into, positive)
    return {"multiclass": macro_f1, "regression": mse}[task_type](df, score, label, by, into)


def score_predictions(predictions: DataFrame, labels: DataFrame, key: list[str], task_type: str,
                      score: str = "score", label: str = "label", into: str = "value",
                      positive: object = 1) -> DataFrame:
    """Score predictions made elsewhere against the true labels, matched by key.

    Every label needs one prediction: a missing, repeated or NULL one raises.
    """
    per_key = predictions.groupBy(*key).agg(F.first(score).alias(score), F.count(F.lit(1)).alias("_n"))
    both = labels.select(*key, label).join(per_key, key, "left")
    missing, repeated = both.agg(F.count_if(F.col(score).isNull()), F.count_if(F.col("_n") > 1)).first()
    if missing or repeated:
        raise ValueError(f"{missing} labels without a prediction, {repeated} with several")
    return task_metric(both, task_type, score, label, into=into, positive=positive)
