"""Prediction tasks: train and test rows, label, column roles and the task's metric."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, functions as F, types as T

from tarnish.operators.corrupt import is_number
from tarnish.operators.metrics import METRICS, score_predictions, task_metric
from tarnish.operators.sampling import KeyedTable, random_split
from tarnish.operators.scoring import Scorer
from tarnish.operators.distinct import capped_sets
from tarnish.session import cut_lineage

BINARY, MULTICLASS, REGRESSION = "binary", "multiclass", "regression"


@dataclass
class Task:
    """Labels live in a column of the same table, so rows and labels cannot drift apart.

    Categories are text, whatever their type in the given tables.  ``positive`` names the
    positive one of two classes; by default it is 1, or the last of two text classes.
    """

    train: DataFrame
    test: DataFrame
    key: list[str]
    label: str
    task_type: str
    categorical: list[str] = field(default_factory=list)
    numerical: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    images: str | None = None
    seed: int = 0
    positive: object = None
    baseline: object = field(default=None, repr=False, compare=False)

    def __post_init__(self) -> None:
        for df in (self.train, self.test):
            wanted = [*self.key, self.label, *self.features]
            absent = [c for c in wanted if c not in df.columns]
            if absent:
                raise ValueError(f"columns not in the table: {absent}")
        if self.task_type not in METRICS:
            raise ValueError(f"unknown task type {self.task_type!r}")
        if self.task_type == REGRESSION and not all(
                isinstance(df.schema[self.label].dataType, T.NumericType) for df in (self.train, self.test)):
            raise ValueError("a regression needs numeric labels")
        self.train, self.test = (categories_as_text(df, self.categorical) for df in (self.train, self.test))

    @property
    def features(self) -> list[str]:
        return [*self.numerical, *self.categorical, *self.text, *([self.images] if self.images else [])]

    @property
    def larger_is_better(self) -> bool:
        return METRICS[self.task_type][1]

    def check(self) -> "Task":
        """Raise unless the labels fit the declared task type; image labels may be plain ids."""
        found = label_task_type(self.train, self.test, self.label,
                                closed=self.images is not None or self.task_type != REGRESSION)
        if found != self.task_type:
            raise ValueError(f"labels look like {found}, the task is declared {self.task_type}")
        return self

    @cached_property
    def positive_class(self) -> object:
        if self.positive is not None:
            return self.positive
        if self.task_type != BINARY or not isinstance(self.train.schema[self.label].dataType, T.StringType):
            return 1
        return self.train.agg(F.max(self.label)).first()[0]

    @cached_property
    def test_rows(self) -> int:
        return self.test.count()

    def checkpointed(self, train: bool = True) -> "Task":
        """The same task with its rows written once to the shared checkpoint folder.

        An evaluation scans the test rows many times; without this every scan repeats the
        work that made them (reading, splitting, labelling) and hashes every row key.  Rows
        are spread by key, so the files come out even after a split; test rows into as many
        files as the session's shuffles have parts, however few bytes they are, since an
        evaluation makes many rows of each.
        """
        keyed = KeyedTable(self.test, self.key, self.seed, rows=0).df
        spark = self.test.sparkSession
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        test = cut_lineage(keyed.repartition(parts, *self.key))
        return replace(self, train=cut_lineage(self.train.repartition(*self.key)) if train else self.train, test=test)

    def performance(self, scorer: Scorer, into: str = "value") -> DataFrame:
        """The task's metric for a scorer on the clean test rows."""
        scored = scorer.score(self.test, "_score")
        return task_metric(scored, self.task_type, "_score", self.label, into=into, positive=self.positive_class)

    def baseline_performance(self, into: str = "value") -> DataFrame:
        """The metric of the task's own baseline, which must have been fitted."""
        if self.baseline is None:
            raise ValueError("fit the baseline first")
        return self.performance(self.baseline, into)

    def score_predictions(self, predictions: DataFrame, score: str = "score", into: str = "value") -> DataFrame:
        return score_predictions(predictions, self.test, self.key, self.task_type, score, self.label, into,
                                 self.positive_class)

    def with_train(self, train: DataFrame) -> "Task":
        return replace(self, train=train, baseline=None)


def categories_as_text(df: DataFrame, categorical: list[str]) -> DataFrame:
    other = [c for c in categorical if not isinstance(df.schema[c].dataType, T.StringType)]
    return df.withColumns({c: F.col(c).cast("string") for c in other}) if other else df


def label_task_type(train: DataFrame, test: DataFrame, label: str, closed: bool | None = None) -> str | None:
    """Task type that the labels allow.

    ``closed`` says whether the labels are a fixed set of classes; by default a numeric
    label column is read as a quantity and any other as classes.  Train and test must show
    the same number of classes, otherwise there is no answer.
    """
    if closed is None:
        closed = not all(is_number(df.schema[label].dataType) for df in (train, test))
    if not closed:
        return REGRESSION
    counted = [
        df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col(label).isNotNull()).count()
        for df in (train, test)]
    if counted[0] != counted[1] or counted[0] < 2:
        return None
    return BINARY if counted[0] == 2 else MULTICLASS


def infer_roles(df: DataFrame, exclude: list[str] = (), max_categories: int = 100) -> tuple[list[str], list[str], list[str]]:
    """(categorical, numerical, text) columns by type.

    A string column is categorical up to ``max_categories`` distinct values, counted exactly.
    """
    fields = [f for f in df.schema.fields if f.name not in exclude]
    strings = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    sets = capped_sets(df, strings, max_categories)
    categorical = [c for c in strings if sets[c] is not None]
    numerical = [f.name for f in fields if is_number(f.dataType)]
    return categorical, numerical, [c for c in strings if c not in categorical]


# -- building blocks for labels and splits --------------------------------------------------


def label_equals(df: DataFrame, column: str, value: object, into: str = "label") -> DataFrame:
    """1 where the column equals the value, else 0 (a missing cell counts as 0)."""
    return df.withColumn(into, F.when(F.col(column) == F.lit(value), 1).otherwise(0))


def label_threshold(df: DataFrame, column: str, above: float, into: str = "label") -> DataFrame:
    """1 where the column exceeds the threshold, else 0."""
    return df.withColumn(into, F.when(F.col(column) > F.lit(above), 1).otherwise(0))


def two_classes(df: DataFrame, column: str, zero: object, one: object, into: str = "label") -> DataFrame:
    """Keep the rows of two classes and relabel them 0 and 1."""
    return df.where(F.col(column).isin(zero, one)).withColumn(into, F.when(F.col(column) == F.lit(one), 1).otherwise(0))


def joined_text(df: DataFrame, columns: list[str], into: str, separator: str = " ") -> DataFrame:
    """Missing parts count as empty text, so the separators stay."""
    return df.withColumn(into, F.concat_ws(separator, *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def between(df: DataFrame, column: str, first: object, last: object) -> DataFrame:
    """Inclusive slice; a plain comparison, so it reaches the Parquet scan."""
    return df.where(F.col(column).between(first, last))


def complete_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="any")


def split(df: DataFrame, key: list[str], test_size: float, seed: object, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """Exact random split into (train, test).

    With ``stored`` the marked rows are written once, where otherwise each scan of either side
    reads the table and hashes every row key again.
    """
    marked = random_split(df, key, test_size, seed, "_test")
    if stored:
        marked = cut_lineage(marked)
    return marked.where(~F.col("_test")).drop("_test"), marked.where("_test").drop("_test")


# -- ready-made tasks -----------------------------------------------------------------------


def income_style(df: DataFrame, key: list[str], label_column: str, positive: object, *, categorical: list[str],
                 numerical: list[str], test_size: float = 0.2, seed: int = 0, drop_incomplete: bool = False) -> Task:
    """Random split, label by equality; incomplete training rows can be dropped."""
    train, test = split(df, key, test_size, seed)
    if drop_incomplete:
        train = complete_rows(train)
    keep = [*key, "label", *numerical, *categorical]
    train, test = (label_equals(d, label_column, positive).select(*keep) for d in (train, test))
    return Task(train, test, key, "label", BINARY, categorical, numerical, seed=seed)


def review_style(df: DataFrame, key: list[str], date_column: str, train_dates: tuple, test_dates: tuple, *,
                 votes: str, leaks: list[str], text_parts: list[str], categorical: list[str], numerical: list[str],
                 above: float = 0, seed: int = 0) -> Task:
    """Time split, label by threshold, joined text; columns that give the label away are dropped."""
    whole = joined_text(df.drop(*leaks), text_parts, "text").fillna("", text_parts)
    parts = [label_threshold(between(whole, date_column, *dates), votes, above).drop(votes)
             for dates in (train_dates, test_dates)]
    return Task(*parts, key, "label", BINARY, categorical, numerical, [*text_parts, "text"], seed=seed)


def image_style(df: DataFrame, key: list[str], class_column: str, zero: object, one: object, *,
                pixels: str = "pixels", test_size: float = 0.2, seed: int = 0) -> Task:
    """Two classes of an image table."""
    kept = two_classes(df, class_column, zero, one)
    train, test = split(kept, key, test_size, seed)
    return Task(train, test, key, "label", BINARY, images=pixels, seed=seed)


def labelled_table(df: DataFrame, key: list[str], label: str, task_type: str, *, train_size: float = 0.8,
                   max_categories: int = 100, seed: int = 0) -> Task:
    """Any labelled table, column roles taken from the types; a string column of more values is text."""
    categorical, numerical, text = infer_roles(df, [*key, label], max_categories)
    train, test = split(df, key, round(1 - train_size, 10), seed)
    return Task(train, test, key, label, task_type, categorical, numerical, text, seed=seed)
