"""Scorers: anything that adds a ``score`` (or prediction) column row by row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F


def class_text(value: object) -> str:
    """A category as Spark writes it."""
    return str(value).lower() if isinstance(value, bool) else str(value)


class Scorer:
    """``score`` adds one column and leaves the others alone; it must look at one row only."""

    def score(self, df: DataFrame, into: str = "score") -> DataFrame:
        raise NotImplementedError

    def confidence(self, score: str = "score") -> Column:
        """A number that grows with the larger class probability."""
        return F.greatest(F.col(score), 1 - F.col(score))


@dataclass(frozen=True)
class LinearScorer(Scorer):
    """A fixed linear model as one column expression.

    ``numeric`` maps a column to (weight, value used when missing); ``categorical`` maps a
    column to {value: weight}, where missing and unknown values weigh 0.  With
    ``link="logit"`` the score is the linear predictor itself, which ranks rows exactly as
    the probability does.
    """

    intercept: float
    numeric: dict[str, tuple[float, float]] = field(default_factory=dict)
    categorical: dict[str, dict[str, float]] = field(default_factory=dict)
    link: str = "logit"

    def predictor(self) -> Column:
        total = F.lit(float(self.intercept))
        for name, (weight, fill) in self.numeric.items():
            x = F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")), F.lit(float(fill)))
            total = total + F.lit(float(weight)) * x
        for name, weights in self.categorical.items():
            case = F.lit(0.0)
            for i, (value, weight) in enumerate(weights.items()):
                test = F.col(name).cast("string") == F.lit(class_text(value))
                case = F.when(test, F.lit(float(weight))) if i == 0 else case.when(test, F.lit(float(weight)))
            total = total + (case.otherwise(F.lit(0.0)) if weights else case)
        return total

    def score(self, df: DataFrame, into: str = "score") -> DataFrame:
        value = self.predictor()
        if self.link == "probability":
            value = F.lit(1.0) / (F.lit(1.0) + F.exp(-value))
        return df.withColumn(into, value)

    def confidence(self, score: str = "score") -> Column:
        return F.abs(score) if self.link == "logit" else super().confidence(score)


@dataclass(frozen=True)
class CutScorer(Scorer):
    """A class label from a linear predictor and cut points: classes 0, 1, .. upwards."""

    linear: LinearScorer
    cuts: tuple[float, ...]

    def score(self, df: DataFrame, into: str = "score") -> DataFrame:
        scored = self.linear.score(df, "_linear")
        label = sum(((F.col("_linear") > F.lit(c)).cast("int") for c in self.cuts), F.lit(0))
        return scored.withColumn(into, label).drop("_linear")


@dataclass(frozen=True)
class ModelScorer(Scorer):
    """A fitted MLlib pipeline: probability of class 1, predicted class or predicted value.

    ``classes`` names the classes of a model that was fitted on their positions.
    """

    model: object
    task_type: str = "binary"
    classes: tuple[str, ...] | None = None

    def score(self, df: DataFrame, into: str = "score") -> DataFrame:
        out = self.model.transform(df)
        value = vector_to_array("probability")[1] if self.task_type == "binary" else F.col("prediction")
        if self.classes is not None and self.task_type == "multiclass":
            value = F.get(F.array(*[F.lit(c) for c in self.classes]), F.col("prediction").cast("int"))
        return out.select(*df.columns, value.alias(into))


@dataclass(frozen=True)
class ChainedScorer(Scorer):
    """Imputers in front of a scorer; the caller's columns keep their uncleaned values."""

    scorer: Scorer
    imputers: tuple = ()

    def score(self, df: DataFrame, into: str = "score") -> DataFrame:
        touched = [c for i in self.imputers for c in i.columns if c in df.columns]
        touched = list(dict.fromkeys(touched))
        saved = df.withColumns({f"_raw_{c}": F.col(c) for c in touched})
        for imputer in self.imputers:
            saved = imputer.transform(saved)
        scored = self.scorer.score(saved, into)
        keep = [F.col(f"_raw_{c}").alias(c) if c in touched else F.col(c) for c in df.columns if c != into]
        return scored.select(*keep, into)

    def confidence(self, score: str = "score") -> Column:
        return self.scorer.confidence(score)
