"""Feature columns and fitted baseline models."""

from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog import register, sql, table
from catalog.evaluation import bulk_task
from catalog.images import image_table
from catalog.metrics import REVENUE, revenue_lines, sized_parts
from catalog.samplers import LINE_LOGIT, LINE_SCORER, SEED
from tarnish.operators import features
from tarnish.operators.corrupt import MissingValues
from tarnish.operators.clean import fit_mean
from tarnish.operators.image import ImageCorruption
from tarnish.operators.linear import design_of, fit_ridge
from tarnish.operators.models import fit_baseline, fit_image_baseline, fit_learned_imputer, with_folds
from tarnish.operators.ranks import literal_rows
from tarnish.operators.scoring import ChainedScorer
from tarnish.plans.evaluate import ImpactEvaluator
from tarnish.plans.results import augment
from tarnish.plans.task import BINARY, MULTICLASS, REGRESSION, Task, image_style, split

LINE_IDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@register("one_hot", f"""
SELECT {', '.join(LINE_IDS)}, (l_returnflag = 'A')::INT::DOUBLE AS flag_a, (l_returnflag = 'N')::INT::DOUBLE AS flag_n,
       (l_returnflag = 'R')::INT::DOUBLE AS flag_r FROM lineitem""")
def one_hot(spark, sf):
    lines = table(spark, sf, "lineitem").select(*LINE_IDS, "l_returnflag")
    hot = Pipeline(stages=features.one_hot_stages(["l_returnflag"])).fit(lines).transform(lines)
    vector = vector_to_array("l_returnflag_hot")
    return hot.select(*LINE_IDS, *[vector[i].alias(f"flag_{f}") for i, f in enumerate("anr")])


@register("standardize", f"""
SELECT {', '.join(LINE_IDS)}, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
       round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) AS l_tax FROM lineitem""")
def standardize(spark, sf):
    scaled = features.standardise(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"])
    return scaled.select(*LINE_IDS, *[F.round(c, 6).alias(c) for c in ("l_quantity", "l_tax")])


@register("cast_to_text", "SELECT p_partkey, p_size::VARCHAR AS p_size FROM part")
def cast_to_text(spark, sf):
    return features.cast_to_text(table(spark, sf, "part"), ["p_size"]).select("p_partkey", "p_size")


@register("linear_scores", f"SELECT {', '.join(LINE_IDS)}, round({LINE_LOGIT}, 9) AS score FROM lineitem")
def linear_scores(spark, sf):
    return LINE_SCORER.score(table(spark, sf, "lineitem")).select(*LINE_IDS, F.round("score", 9).alias("score"))


@register("feature_columns", f"""
SELECT {', '.join(LINE_IDS)}, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS quantity,
       round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) AS tax, (l_returnflag = 'A')::INT::DOUBLE AS flag_a,
       (l_returnflag = 'N')::INT::DOUBLE AS flag_n, (l_returnflag = 'R')::INT::DOUBLE AS flag_r,
       (l_linestatus = 'F')::INT::DOUBLE AS status_f, (l_linestatus = 'O')::INT::DOUBLE AS status_o FROM lineitem""")
def feature_columns(spark, sf):
    """Scaled numbers and one-hot categories side by side, as every fit sees them."""
    lines = table(spark, sf, "lineitem")
    vectors = features.feature_pipeline(["l_quantity", "l_tax"], ["l_returnflag", "l_linestatus"]).fit(lines).transform(lines)
    cell = vector_to_array("features")
    names = ["quantity", "tax", "flag_a", "flag_n", "flag_r", "status_f", "status_o"]
    return vectors.select(*LINE_IDS, *[F.round(cell[i], 6).alias(n) for i, n in enumerate(names)])


_GAPS = sql.marked("lineitem", 0.3, "CAR", SEED)


@register("chained_scores", f"""
WITH g AS (SELECT * REPLACE (CASE WHEN hit THEN NULL ELSE l_quantity END AS l_quantity) FROM ({_GAPS}) m)
SELECT {', '.join(LINE_IDS)}, l_quantity, round({LINE_LOGIT.replace('coalesce(l_quantity, 25.0::DOUBLE)', 'coalesce(l_quantity, (SELECT avg(l_quantity) FROM g))')}, 6) AS score FROM g""")
def chained_scores(spark, sf):
    """A model behind an imputer scores filled rows and leaves the caller's cells as they were."""
    gaps = MissingValues("l_quantity", 0.3).transform(table(spark, sf, "lineitem"), sql.KEYS["lineitem"], SEED)
    scored = ChainedScorer(LINE_SCORER, (fit_mean(gaps, ["l_quantity"]),)).score(gaps)
    return scored.select(*LINE_IDS, "l_quantity", F.round("score", 6).alias("score"))


@register("task_checks", """
SELECT * FROM (VALUES ('binary', 'binary', TRUE), ('binary', 'multiclass', FALSE), ('multiclass', 'multiclass', TRUE), ('multiclass', 'binary', FALSE),
  ('quantity', 'regression', TRUE), ('binary', 'regression', FALSE), ('absent feature', 'binary', FALSE)) v(label, task_type, fits)
WHERE (SELECT count(DISTINCT l_linestatus) FROM lineitem) = 2 AND (SELECT count(DISTINCT l_returnflag) FROM lineitem) = 3""")
def task_checks(spark, sf):
    """Which declared task types the labels of a table allow, and that every role column must exist."""
    lines = table(spark, sf, "lineitem").select(*sql.KEYS["lineitem"], "l_linestatus", "l_returnflag", "l_extendedprice", "l_quantity")
    train, test = split(lines, sql.KEYS["lineitem"], 0.2, SEED, stored=True)
    labels = {"binary": "l_linestatus", "multiclass": "l_returnflag", "quantity": "l_extendedprice", "absent feature": "l_linestatus"}
    rows = []
    for name, kind in (("binary", BINARY), ("binary", MULTICLASS), ("multiclass", MULTICLASS), ("multiclass", BINARY), ("quantity", REGRESSION),
                       ("binary", REGRESSION), ("absent feature", BINARY)):
        numbers = ["l_quantity", "nowhere"] if name == "absent feature" else ["l_quantity"]
        try:
            Task(train, test, sql.KEYS["lineitem"], labels[name], kind, [], numbers, seed=SEED).check()
            fits = True
        except ValueError:
            fits = False
        rows.append({"label": name, "task_type": kind, "fits": fits})
    return literal_rows(spark, rows, "label string, task_type string, fits boolean")


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]{2,}')"


@register("text_features", f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
                            list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS term FROM w),
c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL)
SELECT doc_id, sum(n)::BIGINT AS terms, count(*) AS distinct_terms, max(n) AS commonest, sum(n * length(term))::BIGINT AS letters,
       min(term) AS first_term, max(term) AS last_term
FROM c GROUP BY doc_id""")
def text_features(spark, sf):
    """Words and 2- and 3-grams of whole documents, as they go into the hashed vector."""
    documents = table(spark, sf, "documents").select("doc_id", "text").where(F.col("text").isNotNull())
    stages = [s for s in features.hashed_text_stages("text", "vector") if not isinstance(s, (HashingTF, Normalizer))]
    terms = Pipeline(stages=stages).fit(documents).transform(documents)
    return features.term_counts(terms, "doc_id", "text_terms")


def _report(spark, task, scorer):
    """One row per grid setting with its cross-validated score, beside the test score."""
    test = task.performance(scorer).first()[0]
    rows = [(str(sorted(p.items())), float(s), p == scorer.best, float(test)) for p, s in scorer.cv_scores]
    return spark.createDataFrame(rows, "setting string, cv_score double, chosen boolean, test_score double")


@register("fit_binary")
def fit_binary(spark, sf):
    task = bulk_task(spark, sf, store_train=True)
    return _report(spark, task, fit_baseline(task))


@register("fit_multiclass")
def fit_multiclass(spark, sf):
    key = ["p_partkey"]
    parts = sized_parts(spark, sf).select(*key, "label", "p_type", "p_size", "p_retailprice")
    train, test = split(parts, key, 0.2, SEED, stored=True)
    task = Task(train, test, key, "label", MULTICLASS, ["p_type"], ["p_size", "p_retailprice"], seed=SEED).check()
    return _report(spark, task, fit_baseline(task))


@register("fit_regression")
def fit_regression(spark, sf):
    key = sql.KEYS["lineitem"]
    lines = revenue_lines(spark, sf).select(*key, "label", "l_extendedprice", "l_discount", "l_tax")
    train, test = split(lines, key, 0.2, SEED, stored=True)
    task = Task(train, test, key, "label", REGRESSION, [], ["l_extendedprice", "l_discount", "l_tax"], seed=SEED)
    return _report(spark, task, fit_baseline(task))


_X = ["l_extendedprice", "l_discount", "l_tax"]
_RIDGE_ALPHA = 0.01


def _ridge_sql() -> str:
    """Normal equations of three scaled numbers, solved by determinants."""
    train = sql.marked("lineitem", 0.2, "CAR", f"{SEED}/split")
    pairs = [(i, j) for i in range(3) for j in range(i + 1, 3)]
    stats = [f"avg({REVENUE}) AS my", *[f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}, covar_pop({c}, {REVENUE}) AS cy{i}" for i, c in enumerate(_X)],
             *[f"covar_pop({_X[i]}, {_X[j]}) AS c{i}{j}" for i, j in pairs]]
    a = f"(1.0::DOUBLE + {_RIDGE_ALPHA}::DOUBLE)"
    cells = ", ".join([*[f"cy{i} / s{i} AS b{i}" for i in range(3)], *[f"c{i}{j} / (s{i} * s{j}) AS r{i}{j}" for i, j in pairs]])

    def det(m):
        return (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
                f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")

    matrix = [[a if i == j else f"r{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    solved = [f"{det([[f'b{i}' if j == k else matrix[i][j] for j in range(3)] for i in range(3)])} / {det(matrix)} AS w{k}" for k in range(3)]
    error = f"{REVENUE} - my" + "".join(f" - w{i} * ({c} - m{i}) / s{i}" for i, c in enumerate(_X))
    return f"""
WITH tr AS MATERIALIZED (SELECT *, floor({sql.draw('v', SEED, 'fold')} * 5)::INT AS fold FROM ({train}) m WHERE NOT hit),
st AS (SELECT f.fold, {', '.join(stats)} FROM (SELECT unnest(range(-1, 5))::INT AS fold) f JOIN tr ON tr.fold <> f.fold GROUP BY f.fold),
eq AS (SELECT *, {cells} FROM st), fit AS (SELECT *, {', '.join(solved)} FROM eq),
err AS (SELECT fit.fold, avg(({error}) * ({error})) AS mse FROM fit JOIN tr ON tr.fold = fit.fold GROUP BY fit.fold)
SELECT fit.fold, round(w0, 5) AS w_price, round(w1, 5) AS w_discount, round(w2, 5) AS w_tax, round(my, 5) AS intercept, round(mse, 3) AS held_out_mse
FROM fit LEFT JOIN err ON err.fold = fit.fold"""


@register("fit_ridge_folds", _ridge_sql())
def fit_ridge_folds(spark, sf):
    """Weights and held-out error of the squared-error baseline without each fold, and on all rows (-1)."""
    key = sql.KEYS["lineitem"]
    train, test = split(revenue_lines(spark, sf), key, 0.2, SEED)
    task = Task(train, test, key, "label", REGRESSION, [], _X, seed=SEED)
    rows = with_folds(task.train.select(*key, *_X, F.col("label").alias("_label")), key, 5, SEED)
    design = design_of(rows, _X, [])
    without, whole, errors = fit_ridge(rows, design, 5, (_RIDGE_ALPHA,))
    found = [(fold, *[fits[0].weights[c] for c in _X], fits[0].intercept, e[0]) for fold, fits, e in zip(range(5), without, errors)]
    found.append((-1, *[whole[0].weights[c] for c in _X], whole[0].intercept, None))
    names = ["fold", "w_price", "w_discount", "w_tax", "intercept", "held_out_mse"]
    out = literal_rows(spark, [dict(zip(names, r)) for r in found], "fold int, w_price double, w_discount double, w_tax double, intercept double, held_out_mse double")
    return out.select("fold", *[F.round(c, 5).alias(c) for c in names[1:5]], F.round("held_out_mse", 3).alias("held_out_mse"))


def document_task(spark, sf) -> Task:
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    rows = both.select("doc_id", "n_chars", "lang", "source", "text", F.col("quality").alias("label"))
    train, test = split(rows, ["doc_id"], 0.2, SEED, stored=True)
    return Task(train, test, ["doc_id"], "label", BINARY, ["lang", "source"], ["n_chars"], ["text"], seed=SEED)


@register("fit_text")
def fit_text(spark, sf):
    task = document_task(spark, sf)
    return _report(spark, task, fit_baseline(task))


@register("fit_image")
def fit_image(spark, sf):
    """Clean and damaged score of a pixel model, and of one trained on noisy copies as well."""
    task = image_style(image_table(spark, sf), ["vec_id"], "label", 7, 9, seed=SEED)
    plain = fit_image_baseline(task)
    more = augment(task.train, ["vec_id"], lambda s: ImageCorruption(("gaussian_noise",), s), [1, 2, 3, 4, 5],
                   task.train.count(), SEED)
    hardened = fit_image_baseline(task, more)
    noisy = ImageCorruption(("gaussian_noise",), 4, 0.5).transform(task.test, ["vec_id"], SEED)
    rows = []
    for name, scorer in (("plain", plain), ("augmented", hardened)):
        for data, df in (("clean", task.test), ("noisy", noisy)):
            value = task.score_predictions(scorer.score(df)).first()[0]
            rows.append((name, data, None if value is None else float(value)))
    return spark.createDataFrame(rows, "model string, data string, auc double")


@register("impute_learned")
def impute_learned(spark, sf):
    part = MissingValues("p_type", 0.3).transform(table(spark, sf, "part"), ["p_partkey"], SEED)
    imputer = fit_learned_imputer(part, "p_type", ["p_size", "p_retailprice"], ["p_brand"])
    return imputer.transform(part).select("p_partkey", "p_type")


@register("impact_fitted_model")
def impact_fitted_model(spark, sf):
    """Impact on a fitted model instead of fixed weights."""
    task = bulk_task(spark, sf, store_train=True)
    return ImpactEvaluator(task, fit_baseline(task)).evaluate(
        [MissingValues("l_quantity", 0.5, na_value=-999), MissingValues("l_discount", 0.25, "MNAR")], 2)
