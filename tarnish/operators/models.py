"""Baseline models: MLlib learners, a small grid, cross-validation with keyed folds."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tarnish.functions.rand import Salt, key_string, row_base, uniform
from tarnish.operators.clean import ConditionalMode, fill_constant, fit_conditional_mode, fit_mean, fit_mode
from tarnish.operators.features import feature_pipeline
from tarnish.operators.huber import fit_huber, held_out_errors
from tarnish.operators.linear import SUMS_DDL, Design, added_up, design_cells, design_of, fit_ridge
from tarnish.operators.logistic import PACKED_DDL, _packed, _packed_sums, fit_logistic
from tarnish.operators.metrics import METRICS, absolute_error, squared_error, task_metric
from tarnish.operators.scoring import ChainedScorer, ModelScorer, Scorer
from tarnish.operators.texts import fit_texts
from tarnish.session import inherited, ship, spread

# Strengths of the L2 penalty and the losses tried for regression.
ALPHAS = (0.00001, 0.0001, 0.001, 0.01)
REGRESSION_LOSSES = ("squaredError", "huber")
FOLDS = 5


@dataclass(frozen=True)
class Baseline(ChainedScorer):
    """A fitted baseline: imputers, features and learner, with its cross-validation scores.

    For a regression ``cv_absolute`` holds the mean absolute errors beside the squared ones.
    """

    best: dict = field(default_factory=dict)
    cv_scores: tuple = ()
    cv_absolute: tuple = ()


def learners(task_type: str, max_iter: int) -> list[tuple[dict, Estimator]]:
    """One learner per grid setting."""
    if task_type == "regression":
        return [({"loss": loss, "alpha": a},
                 LinearRegression(labelCol="_label", regParam=a, loss=loss, standardization=False, maxIter=max_iter))
                for loss in REGRESSION_LOSSES for a in ALPHAS]
    family = "binomial" if task_type == "binary" else "multinomial"
    return [({"alpha": a}, LogisticRegression(labelCol="_label", regParam=a, elasticNetParam=0.0, family=family,
                                              maxIter=max_iter)) for a in ALPHAS]


def with_folds(df: DataFrame, key: list[str], folds: int, seed: object) -> DataFrame:
    """A fold number per row that depends on the key only."""
    draw = uniform(row_base(key_string(df, key)), Salt.of(seed, "fold"))
    return df.withColumn("_fold", F.floor(draw * folds).cast("int"))


def _imputers(df: DataFrame, numerical: list[str], categorical: list[str], text: list[str]) -> tuple:
    found = []
    if numerical:
        found.append(fit_mean(df, numerical))
    if categorical:
        found.append(fit_mode(df, categorical))
    if text:
        found.append(fill_constant(dict.fromkeys(text, "")))
    return tuple(found)


def fit_baseline(task, train: DataFrame | None = None, *, folds: int = FOLDS, max_iter: int = 50,
                 numerical: list[str] | None = None, categorical: list[str] | None = None) -> Baseline:
    """Fit the baseline of a task, choosing the grid setting by cross-validation.

    Without ``train`` the task's own training rows are used and the model is kept on the
    task, so a second call returns it.  With ``train`` the model is fitted on those rows and
    not kept.  Imputers, encoders and scalers are fitted inside each fold, once for all grid
    settings of that fold.
    """
    own = train is None
    if own and task.baseline is not None:
        return task.baseline
    rows = task.train if own else train
    if task.label not in rows.columns:
        raise ValueError(f"training rows need the label column {task.label!r}")
    numerical = task.numerical if numerical is None else numerical
    categorical = task.categorical if categorical is None else categorical
    text = list(task.text)
    classes, position = class_positions(rows, task.label, task.task_type, task.positive_class)
    if own:
        task.check()
    keep = [*task.key, *numerical, *categorical, *text, position.alias("_label")]
    rows = with_folds(rows.select(*keep).where(F.col("_label").isNotNull()), task.key, folds, task.seed)
    # not by the key alone, which may be missing in many rows, and not by long texts
    rows = spread(rows, *dict.fromkeys([*task.key, *numerical, *categorical]))
    some = task.task_type == "binary" or task.task_type == "regression" and not text
    design = design_of(rows, numerical, categorical) if some and numerical + categorical + text else None
    grid = learners(task.task_type, max_iter)
    tried = []  # (setting, score, mean absolute error, how to get the model)
    if design is not None and text:
        tried = _text_logits(rows, design, text, folds, max_iter)
        grid = [] if tried else grid
    elif design is not None and task.task_type == "binary":
        tried = _logits(rows, design, folds, max_iter)
        grid = [] if tried else grid
    elif design is not None:
        tried = _regressions(rows, design, folds, max_iter)
        grid = grid[len(tried):]
    if grid:
        rows = rows.persist()
    try:
        def one_fold(fold: int) -> list[tuple]:
            parts = _fit_all(rows.where(F.col("_fold") != fold), numerical, categorical, text, grid)
            return _held_out_scores(*parts, task.task_type, rows.where(F.col("_fold") == fold))

        with ThreadPoolExecutor(max_workers=min(folds, 4)) as pool:
            by_fold = list(pool.map(inherited(one_fold), range(folds))) if grid else []
        for i, (setting, learner) in enumerate(grid):
            score, absolute = (_mean([f[i][side] for f in by_fold]) for side in (0, 1))
            tried.append((setting, score, absolute, learner))
        scored = [t for t in tried if t[1] == t[1]]
        if not scored:
            raise ValueError("no fold gives a score: too few rows, or a class is absent")
        order = max if METRICS[task.task_type][1] else min
        best = order(scored, key=lambda t: t[1])
        if isinstance(best[3], ChainedScorer):
            scorer, imputers = best[3].scorer, best[3].imputers
        elif not grid:
            imputers, features, models = _fit_all(rows, numerical, categorical, text, [])
            scorer = ModelScorer(PipelineModel([features, best[3](features, numerical, categorical)]), task.task_type, classes)
        else:
            imputers, features, models = _fit_all(rows, numerical, categorical, text, [(best[0], best[3])])
            scorer = ModelScorer(PipelineModel([features, models[0]]), task.task_type, classes)
    finally:
        rows.unpersist()
    scores = tuple((dict(t[0]), t[1]) for t in tried)
    also = tuple((dict(t[0]), t[2]) for t in tried) if task.task_type == "regression" else ()
    baseline = Baseline(scorer, imputers, best[0], scores, also)
    if own:
        task.baseline = baseline
    return baseline


def _regressions(rows: DataFrame, design: Design, folds: int, max_iter: int) -> list[tuple]:
    """The settings of both losses, in the order of the grid; those of the Huber loss are left out where only the learner
    itself can tell what to do.

    The squared-error ones come from sums alone, the others are fitted together; one more scan measures the errors of all folds.
    """
    ship(rows.sparkSession)
    packed = design_cells(rows, design).mapInArrow(partial(_packed, design=design, classes=False), PACKED_DDL).persist()
    try:
        sums = added_up(packed.mapInArrow(partial(_packed_sums, design=design, label_type=np.float64), SUMS_DDL), design, folds)
        ridge = fit_ridge(rows, design, folds, ALPHAS, sums)
        huber = fit_huber(packed, design, sums, ALPHAS, max_iter)
        if huber is None:
            return _squares(rows, ridge)
        without, whole, squared = ridge
        scorers, residuals = huber
        residuals = np.concatenate([np.stack([[fit.residual for fit in fits] for fits in without]).transpose(0, 2, 1), residuals], axis=2)
        errors = held_out_errors(packed, design, residuals)
    finally:
        packed.unpersist()
    # a fold without rows has no error
    square, absolute = ([[e / n if n else None for e, n in zip(column, sums[:, 0, 0])] for column in side.T.tolist()] for side in errors)
    n = len(ALPHAS)
    found = [({"loss": "squaredError", "alpha": a}, _mean([e[i] for e in squared]), _mean(absolute[i]), whole[i].scorer()) for i, a in enumerate(ALPHAS)]
    return found + [({"loss": "huber", "alpha": a}, _mean(square[n + i]), _mean(absolute[n + i]), scorers[i]) for i, a in enumerate(ALPHAS)]


def _squares(rows: DataFrame, ridge: tuple[list, list, list]) -> list[tuple]:
    """The squared-error settings alone; one more scan measures absolute errors of all folds."""
    without, whole, errors = ridge
    parts = []
    for fold, fits in enumerate(without):
        held = rows.where(F.col("_fold") == fold)
        for i, fit in enumerate(fits):
            held = fit.scorer().score(held, f"_p{i}")
        if fits:
            parts.append(held.select(F.lit(fold).alias("fold"), "_label", *[f"_p{i}" for i in range(len(ALPHAS))]))
    both = reduce(DataFrame.unionByName, parts)
    found = both.groupBy("fold").agg(*[F.avg(absolute_error(f"_p{i}", "_label")).alias(f"e{i}") for i in range(len(ALPHAS))]).collect()
    return [({"loss": "squaredError", "alpha": a}, _mean([e[i] for e in errors]), _mean([r[f"e{i}"] for r in found]), whole[i].scorer())
            for i, a in enumerate(ALPHAS)]


def _logits(rows: DataFrame, design: Design, folds: int, max_iter: int) -> list[tuple]:
    """All settings of the logistic regression, fitted together; none where only the learner itself can tell what to do."""
    found = fit_logistic(rows, design, folds, ALPHAS, max_iter)
    if found is None:
        return []
    return [({"alpha": a}, _mean(scores), None, scorer) for a, scorer, scores in zip(ALPHAS, *found)]


def _text_logits(rows: DataFrame, design: Design, text: list[str], folds: int, max_iter: int) -> list[tuple]:
    """As ``_logits`` with texts; the model comes from the features' pipeline."""
    found = fit_texts(rows, design, text, folds, ALPHAS, max_iter)
    if found is None:
        return []
    return [({"alpha": a}, _mean(scores), None, partial(fit.model, weights))
            for a, fit, weights, scores in zip(ALPHAS, found.fits, found.weights, found.scores)]


def class_positions(rows: DataFrame, label: str, task_type: str,
                    positive: object = None) -> tuple[tuple[str, ...] | None, Column]:
    """(classes, position of a row's class); numbers stand for themselves.

    Text classes are learnt from the given rows and sorted; the positive one of two comes last.
    """
    if task_type == "regression" or not isinstance(rows.schema[label].dataType, T.StringType):
        return None, F.col(label).cast("double")
    known = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    classes = sorted(r[label] for r in known.collect())
    if task_type == "binary":
        classes.sort(key=lambda c: (c == positive, c))
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    return tuple(classes), F.when(position >= 0, position.cast("double"))


def _mean(values: list[float | None]) -> float:
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else float("nan")


def _fit_all(train: DataFrame, numerical: list[str], categorical: list[str], text: list[str],
             grid: list[tuple[dict, Estimator]]) -> tuple[tuple, PipelineModel, list]:
    """Imputers and features once, then every learner on the same cached vectors."""
    imputers = _imputers(train, numerical, categorical, text)
    filled = _filled(train, imputers)
    features = feature_pipeline(numerical, categorical, text).fit(filled)
    if not grid:
        return imputers, features, []
    vectors = features.transform(filled).select("features", "_label").persist()
    try:
        return imputers, features, [learner.fit(vectors) for _, learner in grid]
    finally:
        vectors.unpersist()


def _filled(df: DataFrame, imputers: tuple) -> DataFrame:
    for imputer in imputers:
        df = imputer.transform(df)
    return df


def _held_out_scores(imputers: tuple, features: PipelineModel, models: list, task_type: str,
                     held: DataFrame) -> list[tuple]:
    """(metric, mean absolute error of a regression) of every model on the held-out rows, all in one job."""
    out = features.transform(_filled(held, imputers)).select("features", "_label")
    cells = []
    for i, model in enumerate(models):
        names = {"predictionCol": f"_p{i}"}
        if task_type != "regression":
            names |= {"probabilityCol": f"_q{i}", "rawPredictionCol": f"_r{i}"}
        out = model.copy({getattr(model, k): v for k, v in names.items()}).transform(out)
        score = vector_to_array(f"_q{i}")[1] if task_type == "binary" else F.col(f"_p{i}")
        cells.append(F.struct(F.lit(i).alias("setting"), score.alias("score")))
    long = out.select("_label", F.explode(F.array(*cells)).alias("c")).select("_label", "c.setting", "c.score")
    if task_type == "regression":
        measured = long.groupBy("setting").agg(F.avg(squared_error("score", "_label")).alias("value"),
                                               F.avg(absolute_error("score", "_label")).alias("absolute"))
    else:
        measured = task_metric(long, task_type, "score", "_label", ["setting"]).withColumn("absolute", F.lit(None))
    found = {r["setting"]: (r["value"], r["absolute"]) for r in measured.collect()}
    return [found.get(i, (None, None)) for i in range(len(models))]


@dataclass(frozen=True)
class ImageScorer(Scorer):
    """Two-class probability from a pixel array."""

    model: object
    column: str

    def score(self, df: DataFrame, into: str = "score") -> DataFrame:
        out = self.model.transform(df.withColumn("features", pixel_vector(self.column)))
        return out.select(*df.columns, vector_to_array("probability")[1].alias(into))


def pixel_vector(column: str) -> Column:
    return array_to_vector(F.transform(column, lambda x: x.cast("double") / F.lit(255.0)))


def fit_image_baseline(task, train: DataFrame | None = None, *, hidden: int = 32, max_iter: int = 60) -> ImageScorer:
    """A small two-layer network on the scaled pixels; all images must have one size."""
    own = train is None
    if own and task.baseline is not None:
        return task.baseline
    rows = task.train if own else train
    _, position = class_positions(rows, task.label, task.task_type, task.positive_class)
    rows = rows.select(task.images, position.alias("_label"))
    if not own:  # copies come in very many small parts, and in no fixed order; the task's own rows stay as read
        rows = spread(rows)
    rows = rows.select(pixel_vector(task.images).alias("features"), "_label").persist()
    try:
        width = rows.select(F.max(F.size(vector_to_array("features")))).first()[0]
        learner = MultilayerPerceptronClassifier(layers=[width, hidden, 2], labelCol="_label", maxIter=max_iter,
                                                 seed=task.seed)
        scorer = ImageScorer(learner.fit(rows), task.images)
    finally:
        rows.unpersist()
    if own:
        task.baseline = scorer
    return scorer


@dataclass(frozen=True)
class LearnedImputer:
    """Predict a missing category from other columns and fill only the gaps."""

    target: str
    scorer: ChainedScorer
    labels: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return [self.target]

    def transform(self, df: DataFrame) -> DataFrame:
        guess = self.scorer.score(df, "_guess")
        names = F.array(*[F.lit(x) for x in self.labels])
        filled = F.coalesce(F.col(self.target), F.get(names, F.col("_guess").cast("int")))
        return guess.withColumn(self.target, filled).drop("_guess")


def fit_learned_imputer(df: DataFrame, target: str, numerical: list[str] = (), categorical: list[str] = (),
                        *, alpha: float = 0.001, max_iter: int = 50, max_classes: int = 1_000) -> LearnedImputer | ConditionalMode:
    """Multinomial regression of one categorical column on others; NULL targets are left out.

    The regression has a row of weights per class, so ``max_classes`` bounds it; a target with
    more values is filled with the commonest value among rows that agree on the categorical
    inputs (without any, on the numerical ones).
    """
    if not isinstance(df.schema[target].dataType, T.StringType):
        raise ValueError("the learned imputer fills string columns")
    known = df.where(F.col(target).isNotNull())
    found = known.groupBy(target).agg(F.count(F.lit(1)).alias("n")).orderBy(target).limit(max_classes + 1).collect()
    if len(found) > max_classes:
        return fit_conditional_mode(df, target, list(categorical or numerical))
    labels = tuple(r[target] for r in found)
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(target)) - 1
    rows = known.select(*numerical, *categorical, index.cast("double").alias("_label"))
    learner = LogisticRegression(labelCol="_label", regParam=alpha, family="multinomial", maxIter=max_iter)
    imputers, features, models = _fit_all(rows, list(numerical), list(categorical), None, [({}, learner)])
    model = PipelineModel([features, models[0]])
    return LearnedImputer(target, ChainedScorer(ModelScorer(model, "multiclass"), imputers), labels)
