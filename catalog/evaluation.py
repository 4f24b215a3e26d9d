"""Impact grids, schema evaluation, stress test and their summaries on the bulk-line task."""

from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from catalog import register, sql, table
from catalog import grid_sql as g
from catalog.images import IMAGES, image_table
from catalog.metrics import (
    BULK, PART_CLASS, PART_LINEAR, PART_SCORER, REVENUE, REVENUE_SCORER, bulk_lines, f1_sql, revenue_lines, sized_parts,
)
from catalog.samplers import LINE_LOGIT, LINE_SCORER, SEED
from tarnish.operators.clean import fill_constant, fit_mean, fit_mode
from tarnish.operators.corrupt import (
    BrokenCharacters, CategoricalShift, CustomCorruption, GaussianNoise, MissingByConfidence, MissingValues, Scaling, SwappedValues,
)
from tarnish.operators.image import ImageCorruption
from tarnish.operators.schema import infer_schema
from tarnish.operators.scoring import ChainedScorer, LinearScorer, Scorer
from tarnish.plans import results, stress
from tarnish.plans.evaluate import ImpactEvaluator, SchemaEvaluator, grid
from tarnish.plans.task import BINARY, MULTICLASS, REGRESSION, Task, image_style, split


def bulk_task(spark, sf, store_train: bool = False) -> Task:
    key = sql.KEYS["lineitem"]
    lines = bulk_lines(spark, sf).select(*key, "label", *g.FEATURES)
    train, test = split(lines, key, 0.2, SEED, stored=store_train)
    return Task(train, test, key, "label", BINARY, g.CATEGORICAL, g.NUMERICAL, seed=SEED).checkpointed(False)


def rounded(df, *keys):
    return df.select("scenario_id", "rep", *keys, F.round("baseline_score", 6).alias("baseline_score"),
                     F.round("corrupted_score", 6).alias("corrupted_score"))


@register("impact_single", g.impact([(0, "missing", "l_quantity", 0.05, "CAR", -999, None)], 3))
def impact_single(spark, sf):
    """Clean AUC against the AUC with 5 % of l_quantity set to -999."""
    evaluator = ImpactEvaluator(bulk_task(spark, sf), LINE_SCORER)
    return rounded(evaluator.evaluate([MissingValues("l_quantity", 0.05, na_value=-999)], 3))


@register("impact_text_label", g.impact([(0, "missing", "l_quantity", 0.05, "CAR", -999, None)], 2))
def impact_text_label(spark, sf):
    """The same task with classes named by texts."""
    task = bulk_task(spark, sf)

    def named(df):
        return df.withColumn("label", F.when(F.col("label") == 1, "bulk").otherwise("small"))

    task = replace(task, train=named(task.train), test=named(task.test), positive="bulk")
    return rounded(ImpactEvaluator(task, LINE_SCORER).evaluate([MissingValues("l_quantity", 0.05, na_value=-999)], 2))


class _Refusing(Scorer):
    """Scores as another does, but gives rows without a quantity no score."""

    def score(self, df, into="score"):
        return LINE_SCORER.score(df, into).withColumn(into, F.when(F.col("l_quantity").isNotNull(), F.col(into)))


HOLES = [(0, "missing", "l_quantity", 0.05, "CAR", None, None), (1, "missing", "l_tax", 0.05, "CAR", None, None),
         (2, "missing", "l_quantity", 0.0, "CAR", None, None)]


@register("impact_null_score", f"""WITH {g.damaged(g.scenario_values(HOLES), 2)},
after AS ({g.auc_sql('x', g.PLAIN, 'label', 'idx')}),
gaps AS (SELECT idx, count(*) - count(c_l_quantity) AS n FROM x GROUP BY idx)
SELECT scenario_id, rep, round({g.base_score()}, 6) AS baseline_score, CASE WHEN n = 0 THEN round(auc, 6) END AS corrupted_score
FROM after JOIN scen USING (idx) JOIN gaps USING (idx)""")
def impact_null_score(spark, sf):
    """A row without a score leaves its scenario without one."""
    holes = [MissingValues("l_quantity", 0.05), MissingValues("l_tax", 0.05), MissingValues("l_quantity", 0.0)]
    return rounded(ImpactEvaluator(bulk_task(spark, sf), _Refusing()).evaluate(holes, 2))


def _halved(df, above):
    return df.withColumn("l_quantity", F.when(F.col("l_discount") > above, F.col("l_quantity") / 2).otherwise(F.col("l_quantity")))


HALVED = g.PLAIN.replace("c_l_quantity", "(CASE WHEN c_l_discount > {d} THEN c_l_quantity / 2 ELSE c_l_quantity END)")


def _halved_sql(above: str) -> str:
    old = HALVED.replace("{d}", above)
    for f in g.FEATURES:
        old = old.replace(f"c_{f}", f)
    return f"(SELECT round(auc, 6) FROM ({g.auc_sql('test', old, 'label')}) h)"


@register("impact_custom", f"""WITH {g.damaged(g.scenario_values(HOLES[1:2]), 1)}
SELECT scenario_id, round({g.base_score()}, 6) AS baseline_score, CASE scenario_id WHEN 0 THEN {_halved_sql('0.05::DOUBLE')}
       ELSE {_halved_sql('0.02::DOUBLE')} END AS corrupted_score, corruption
FROM (SELECT unnest([0, 2]) AS scenario_id, unnest(['{{"above": 0.05, "corruption": "halved"}}', '{{"above": 0.02, "corruption": "halved"}}']) AS corruption) c
UNION ALL SELECT 1, round({g.base_score()}, 6), round(auc, 6),
       '{{"column": "l_tax", "corruption": "MissingValues", "fraction": 0.05, "na_value": null, "sampling": "CAR", "widen": false}}'
FROM (SELECT '{SEED}/1/0' AS seed, count(*) AS n FROM test) s,
     ({g.auc_sql(f"(SELECT label, l_quantity AS c_l_quantity, l_discount AS c_l_discount, l_returnflag AS c_l_returnflag, l_linestatus AS c_l_linestatus, CASE WHEN row_number() OVER (ORDER BY {sql.draw('v', f'{SEED}/1/0', 'row')}, k) - 1 < floor(n * 0.05::DOUBLE) THEN NULL ELSE l_tax END AS c_l_tax FROM test)", g.PLAIN, 'label')}) a""")
def impact_custom(spark, sf):
    """A user's own transformations beside one of the library, described in the result."""
    own = [CustomCorruption("halved", _halved, {"above": a}) for a in (0.05, 0.02)]
    found = ImpactEvaluator(bulk_task(spark, sf), LINE_SCORER).evaluate([own[0], MissingValues("l_tax", 0.05), own[1]], 1)
    return rounded(found, "corruption").drop("rep")


FLAG_SCORER = LinearScorer(-0.4, {"l_discount": (9.0, 0.05), "l_tax": (-6.0, 0.04)}, {"l_linestatus": {"F": 0.3, "O": -0.3}})
_FLAG_LOGIT = ("(-0.4::DOUBLE + 9.0::DOUBLE * coalesce(l_discount, 0.05::DOUBLE) + -6.0::DOUBLE * coalesce(l_tax, 0.04::DOUBLE)"
               " + CASE WHEN l_linestatus = 'F' THEN 0.3::DOUBLE WHEN l_linestatus = 'O' THEN -0.3::DOUBLE ELSE 0.0::DOUBLE END)")
_OTHER_LOGIT = LINE_LOGIT.replace("l_quantity", "(60 - l_quantity)")


def _confidence_sql() -> str:
    parts = []
    for sid, (logit, test) in enumerate([(LINE_LOGIT, "rk >= n - kk"), (_FLAG_LOGIT, "rk >= n - kk"), (_FLAG_LOGIT, "rk < kk"),
                                         (_OTHER_LOGIT, "rk >= n - kk"), (LINE_LOGIT, "rk < kk")]):
        kept = ", ".join(f"{f} AS c_{f}" for f in g.FEATURES if f != "l_quantity")
        parts.append(f"SELECT {sid} AS scenario_id, label, CASE WHEN {test} THEN NULL ELSE l_quantity END AS c_l_quantity, {kept} FROM ("
                     f"SELECT *, row_number() OVER (ORDER BY abs({logit}), {sql.draw('v', SEED, 'tie')}, k) - 1 AS rk, count(*) OVER () AS n, "
                     f"floor(count(*) OVER () * 0.3::DOUBLE) AS kk FROM test) r{sid}")
    return f"""WITH test AS MATERIALIZED (SELECT * EXCLUDE (hit), {BULK} AS label FROM ({sql.marked('lineitem', 0.2, 'CAR', g.SPLIT)}) m WHERE hit),
x AS MATERIALIZED ({' UNION ALL '.join(parts)})
SELECT scenario_id, round({g.base_score()}, 6) AS baseline_score, round(auc, 6) AS corrupted_score
FROM ({g.auc_sql('x', g.PLAIN, 'label', 'scenario_id')}) a"""


@register("impact_confidence", _confidence_sql())
def impact_confidence(spark, sf):
    """Rows that a corruption's own scorer is sure of, one on another version of the rows, in one job."""
    task = bulk_task(spark, sf)
    other = task.test.withColumn("l_quantity", 60 - F.col("l_quantity"))
    damage = [MissingByConfidence("l_quantity", 0.3), MissingByConfidence("l_quantity", 0.3, scorer=FLAG_SCORER),
              MissingByConfidence("l_quantity", 0.3, scorer=FLAG_SCORER, most_confident=False),
              MissingByConfidence("l_quantity", 0.3, scorer=LINE_SCORER, predict_on=other),
              MissingByConfidence("l_quantity", 0.3, scorer=LINE_SCORER, most_confident=False)]
    return rounded(ImpactEvaluator(task, LINE_SCORER).evaluate(damage, 1)).drop("rep")


@dataclass(frozen=True)
class PixelScorer(Scorer):
    """A fixed linear model over the pixels, in whole numbers."""

    step: int = 37

    def score(self, df, into="score"):
        total = F.aggregate(F.transform("pixels", lambda x, i: x * (i * self.step % 11 - 5)), F.lit(0).cast("bigint"), lambda a, x: a + x)
        return df.withColumn(into, total.cast("double"))


IMAGE_KINDS, IMAGE_FRACTIONS = ("gaussian_noise", "contrast", "brightness"), (0.01, 0.25, 0.5, 0.99)
_PIXEL_SUM = "list_sum(list_transform(pixels, lambda x, i: x * ((i - 1) * 37 % 11 - 5)))::DOUBLE"


def _image_grid_sql() -> str:
    salts = ", ".join(f"{s} AS {name}{i}" for name, tag in (("c", "coin"), ("p", "z1"), ("q", "z2"))
                      for i, s in enumerate(sql.salt("seed", tag)))
    unit = "(x::DOUBLE / 255.0::DOUBLE)"
    noise = sql.normal("v", ["p0", "p1", "p2"], ["q0", "q1", "q2"], "i")
    cell = (f"CASE WHEN NOT hit THEN x ELSE CAST(floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE kind "
            f"WHEN 'gaussian_noise' THEN {unit} + 0.26::DOUBLE * {noise} WHEN 'contrast' THEN ({unit} - m) * 0.1::DOUBLE + m "
            f"ELSE {unit} + 0.4::DOUBLE END)) * 255.0::DOUBLE) AS INT) END")
    kinds = ", ".join(sql.quoted(k) for k in IMAGE_KINDS)
    return f"""
WITH test AS MATERIALIZED (SELECT vec_id, CASE WHEN label = 9 THEN 1 ELSE 0 END AS label, pixels, v,
       list_sum(pixels)::DOUBLE / 64 / 255.0::DOUBLE AS m
     FROM ({sql.marked('embeddings', 0.2, 'CAR', f'{SEED}/split', source=f'(SELECT * FROM {IMAGES} im WHERE label IN (7, 9))')}) t WHERE hit),
scen AS (SELECT *, {salts} FROM (SELECT *, '{SEED}/' || scenario_id || '/' || rep AS seed FROM (
  SELECT kind, frac::DOUBLE AS frac, rep, (k * {len(IMAGE_FRACTIONS)} + f)::INT AS scenario_id
  FROM (SELECT unnest([{kinds}]) AS kind, unnest(range({len(IMAGE_KINDS)})) AS k) a,
       (SELECT unnest([{', '.join(map(str, IMAGE_FRACTIONS))}]) AS frac, unnest(range({len(IMAGE_FRACTIONS)})) AS f) b,
       (SELECT unnest(range(3))::INT AS rep) r) s0) s1),
px AS (SELECT *, {sql.u('v', ['c0', 'c1', 'c2'])} < frac AS hit, unnest(pixels) AS x, unnest(range(64)) AS i FROM test, scen),
after AS (SELECT scenario_id, rep, vec_id, any_value(label) AS label, sum({cell} * (i * 37 % 11 - 5))::DOUBLE AS s FROM px GROUP BY ALL)
SELECT scenario_id, rep, round((SELECT auc FROM ({g.auc_sql('test', _PIXEL_SUM, 'label')}) b), 6) AS baseline_score,
       round(auc, 6) AS corrupted_score FROM ({g.auc_sql('after', 's', 'label', 'scenario_id, rep')}) q"""


@register("impact_image_grid", _image_grid_sql())
def impact_image_grid(spark, sf):
    """Noise, contrast and brightness at severity 4 on growing shares of the images."""
    task = image_style(image_table(spark, sf), ["vec_id"], "label", 7, 9, seed=SEED)
    damage = [ImageCorruption((k,), 4, f) for k in IMAGE_KINDS for f in IMAGE_FRACTIONS]
    return rounded(ImpactEvaluator(task, PixelScorer()).evaluate(damage, 3))


GRID = [(c, f, m) for c in ("l_quantity", "l_returnflag") for f in (0.99, 0.25, 0.01) for m in ("MCAR", "MAR", "MNAR")]
GRID_ROWS = [(i, "missing", c, f, m, None, None) for i, (c, f, m) in enumerate(GRID)]


def _grid():
    return grid(MissingValues, ["l_quantity", "l_returnflag"], [0.99, 0.25, 0.01], ["MCAR", "MAR", "MNAR"])


@register("impact_grid", g.impact(GRID_ROWS, 2))
def impact_grid(spark, sf):
    return rounded(ImpactEvaluator(bulk_task(spark, sf), LINE_SCORER).evaluate(_grid(), 2))


MIXED = [
    (0, "noise", "l_quantity", 0.4, "CAR", None, None), (1, "noise", "l_discount", 0.5, "NAR", None, None),
    (2, "scaling", "l_quantity", 0.1, "AR", None, None), (3, "scaling", "l_tax", 0.3, "CAR", None, None),
    (4, "swap", "l_discount", 0.5, "CAR", None, "l_quantity"), (5, "swap", "l_returnflag", 0.5, "NAR", None, "l_linestatus"),
    (6, "shift", "l_returnflag", 0.8, "CAR", None, None), (7, "shift", "l_linestatus", 0.5, "AR", None, None),
    (8, "encoding", "l_returnflag", 0.7, "CAR", None, None), (9, "missing", "l_linestatus", 1.0, "NAR", "", None),
]


def _mixed():
    return [
        GaussianNoise("l_quantity", 0.4), GaussianNoise("l_discount", 0.5, "NAR"),
        Scaling("l_quantity", 0.1, "AR"), Scaling("l_tax", 0.3),
        SwappedValues("l_discount", 0.5, swap_with="l_quantity"),
        SwappedValues("l_returnflag", 0.5, "NAR", swap_with="l_linestatus"),
        CategoricalShift("l_returnflag", 0.8), CategoricalShift("l_linestatus", 0.5, "AR"),
        BrokenCharacters("l_returnflag", 0.7), MissingValues("l_linestatus", 1.0, "NAR", na_value=""),
    ]


@register("impact_mixed", g.impact(MIXED, 2))
def impact_mixed(spark, sf):
    """Every kind of tabular corruption in one job."""
    return rounded(ImpactEvaluator(bulk_task(spark, sf), LINE_SCORER).evaluate(_mixed(), 2))


IMPUTED = g.LOGIT.replace("c_l_returnflag", "coalesce(c_l_returnflag, (SELECT mode_flag FROM fills))").format(
    q="(SELECT mean_q FROM fills)", d="0.05::DOUBLE", t="0.04::DOUBLE")
FILLS = (", fills AS MATERIALIZED (SELECT avg(l_quantity) AS mean_q, (SELECT l_returnflag FROM train GROUP BY 1 "
         "ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_flag FROM train)")


@register("impact_two_models", f"""
SELECT *, 'raw' AS model_id FROM ({g.impact(GRID_ROWS, 1)}) a
UNION ALL SELECT *, 'imputing' FROM ({g.impact(GRID_ROWS, 1, IMPUTED, FILLS)}) b""")
def impact_two_models(spark, sf):
    """The same damage scored by a raw model and by one behind mean and mode imputation."""
    task = bulk_task(spark, sf)
    imputers = (fit_mean(task.train, ["l_quantity"]), fit_mode(task.train, ["l_returnflag"]))
    scorers = {"raw": LINE_SCORER, "imputing": ChainedScorer(LINE_SCORER, imputers)}
    return rounded(ImpactEvaluator(task, LINE_SCORER).compare(scorers, _grid(), 1), "model_id")


def _codes():
    return F.array_join(F.transform("anomalies", lambda a: F.concat_ws(":", a["column"], a["code"])), ",").alias("codes")


@register("schema_eval", f"""{g.flags(g.scenario_values(MIXED), 2)}
SELECT scenario_id, rep, codes, codes <> '' AS anomaly_detected, round({g.base_score()}, 6) AS baseline_score,
       round(auc, 6) AS corrupted_score FROM scen JOIN after USING (idx) JOIN verdict USING (idx)""")
def schema_eval(spark, sf):
    found = SchemaEvaluator(bulk_task(spark, sf, store_train=True), LINE_SCORER).evaluate(_mixed(), 2)
    return rounded(found, _codes(), "anomaly_detected")


STRESS_COUNT = 30
STRESS = f"""{g.flags(g.random_spec(STRESS_COUNT), 1)},
outcome AS (SELECT scenario_id, codes, {g.base_score()} AS b, auc AS c, codes <> '' AS found
            FROM scen JOIN after USING (idx) JOIN verdict USING (idx)),
judged AS (SELECT *, CASE WHEN found AND (b - c) / b > 0.03 THEN 'TP' WHEN found THEN 'FP'
                          WHEN (b - c) / b > 0.03 THEN 'FN' ELSE 'TN' END AS status FROM outcome)"""


def _stress(spark, sf):
    task = bulk_task(spark, sf, store_train=True)
    return stress.stress_test(task, LINE_SCORER, infer_schema(task.train, task.features), STRESS_COUNT, 0.03)


@register("stress_test", f"""{STRESS}
SELECT scenario_id, status, codes, round(b, 6) AS baseline_score, round(c, 6) AS corrupted_score FROM judged""")
def stress_test(spark, sf):
    return rounded(_stress(spark, sf), "status", _codes()).drop("rep")


@register("stress_confusion", f"{STRESS} SELECT status, count(*) AS n FROM judged GROUP BY status")
def stress_confusion(spark, sf):
    return stress.status_counts(_stress(spark, sf))


@register("random_scenarios", f"""WITH {g.damaged(g.random_spec(STRESS_COUNT), 1)}
SELECT scenario_id, col AS "column", frac AS fraction, sum(hit::INT)::BIGINT AS rows_hit
FROM x GROUP BY ALL""")
def random_scenarios(spark, sf):
    """Randomly drawn corruptions and how many test rows each one damages."""
    task = bulk_task(spark, sf)
    evaluator = ImpactEvaluator(task, LINE_SCORER)
    prepared = evaluator.prepare(stress.random_corruptions(task, STRESS_COUNT, SEED), 1)
    return evaluator.damage_counts(prepared).select("scenario_id", "column", "fraction", "rows_hit")


SIZE_SCORER = LinearScorer(0.0, {}, {"p_size": {s: (s * 13 % 17) / 16 for s in range(1, 51)}})
_SIZE_WEIGHT = "coalesce((try_cast({c} AS INT) * 13 % 17) / 16.0::DOUBLE, 0.0::DOUBLE)"


@register("stress_number_category", f"""
WITH sp AS MATERIALIZED (SELECT *, p_size::VARCHAR AS size, CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS label
                         FROM ({sql.marked('part', 0.2, 'CAR', f'{SEED}/split')}) m),
test AS MATERIALIZED (SELECT * EXCLUDE (hit), count(*) OVER () AS n FROM sp WHERE hit),
x AS (SELECT 0 AS scenario_id, label, CASE WHEN row_number() OVER (ORDER BY {sql.draw('v', f'{SEED}/0/0', 'row')}, k) - 1 < floor(n * 0.4::DOUBLE)
        THEN '' ELSE size END AS c FROM test
      UNION ALL SELECT 1, label, size FROM test)
SELECT scenario_id, scenario_id = 0 AS anomaly_detected, round((SELECT auc FROM ({g.auc_sql('test', _SIZE_WEIGHT.format(c='size'), 'label')}) b), 6) AS baseline_score,
       round(auc, 6) AS corrupted_score FROM ({g.auc_sql('x', _SIZE_WEIGHT.format(c='c'), 'label', 'scenario_id')}) q""")
def stress_number_category(spark, sf):
    """Whole numbers as categories: an empty text is damage, broken letters change no digit."""
    parts = table(spark, sf, "part").withColumn("label", (F.col("p_retailprice") > 1000).cast("int"))
    train, test = split(parts, ["p_partkey"], 0.2, SEED)
    task = Task(train, test, ["p_partkey"], "label", BINARY, ["p_size"], [], seed=SEED)
    domain = infer_schema(task.train.unionByName(task.test), task.features)
    damage = [MissingValues("p_size", 0.4, na_value=""), BrokenCharacters("p_size", 0.7)]
    return rounded(ImpactEvaluator(task, SIZE_SCORER, domain).evaluate(damage, 1), "anomaly_detected").drop("rep")


# -- other task types ---------------------------------------------------------------------

PART_TEST = f"(SELECT * EXCLUDE (hit) FROM ({sql.marked('part', 0.2, 'CAR', f'{SEED}/split')}) m WHERE hit)"


def _rank_sql(source: str, order: str) -> str:
    return f"row_number() OVER (ORDER BY {order}, {sql.draw('v', SEED, 'tie')}, k) - 1"


@register("impact_multiclass", f"""
WITH test AS MATERIALIZED (SELECT *, {PART_CLASS} AS y, {_rank_sql('', 'p_size')} AS rk, count(*) OVER () AS n FROM {PART_TEST} t),
scen AS (SELECT unnest(range(3)) AS rep),
x AS (SELECT rep, y, p_retailprice, CASE WHEN rk >= st AND rk < st + kk THEN p_size * CASE fac WHEN 0 THEN 10 WHEN 1 THEN 100 ELSE 1000 END
             ELSE p_size END AS p_size FROM (SELECT *, floor(n * 0.3::DOUBLE) AS kk,
        floor({sql.scalar(f"('{SEED}/0/' || rep)", 'start')} * (n - floor(n * 0.3::DOUBLE))) AS st,
        CAST(floor(3 * {sql.scalar(f"('{SEED}/0/' || rep)", 'factor')}) AS INT) AS fac FROM test, scen) p),
bad AS (SELECT rep, y, ({PART_LINEAR} > 19.0::DOUBLE)::INT + ({PART_LINEAR} > 36.0::DOUBLE)::INT AS g FROM x),
good AS (SELECT y, ({PART_LINEAR} > 19.0::DOUBLE)::INT + ({PART_LINEAR} > 36.0::DOUBLE)::INT AS g FROM test)
SELECT 0 AS scenario_id, rep, round((SELECT macro_f1 FROM ({f1_sql('good')}) b), 6) AS baseline_score,
       round(macro_f1, 6) AS corrupted_score FROM ({f1_sql('bad', 'rep')}) q""")
def impact_multiclass(spark, sf):
    train, test = split(sized_parts(spark, sf), ["p_partkey"], 0.2, SEED)
    task = Task(train, test, ["p_partkey"], "label", MULTICLASS, ["p_type", "p_brand"], ["p_size", "p_retailprice"], seed=SEED)
    return rounded(ImpactEvaluator(task, PART_SCORER).evaluate([Scaling("p_size", 0.3, "NAR")], 3))


LINE_TEST = f"(SELECT * EXCLUDE (hit) FROM ({sql.marked('lineitem', 0.2, 'CAR', f'{SEED}/split')}) m WHERE hit)"
_GUESS = ("(1500.0::DOUBLE + 0.95::DOUBLE * coalesce({p}, 30000.0::DOUBLE) + -28000.0::DOUBLE * "
          "coalesce(l_discount, 0.05::DOUBLE) + 27000.0::DOUBLE * coalesce(l_tax, 0.04::DOUBLE))")


@register("impact_regression", f"""
WITH test AS MATERIALIZED (SELECT *, {REVENUE} AS y, {_rank_sql('', 'l_extendedprice')} AS rk, count(*) OVER () AS n FROM {LINE_TEST} t),
scen AS (SELECT unnest(range(3)) AS rep),
x AS (SELECT *, CASE WHEN rk >= st AND rk < st + kk THEN NULL ELSE l_extendedprice END AS price
      FROM (SELECT *, floor(n * 0.1::DOUBLE) AS kk,
        floor({sql.scalar(f"('{SEED}/0/' || rep)", 'start')} * (n - floor(n * 0.1::DOUBLE))) AS st FROM test, scen) p)
SELECT 0 AS scenario_id, rep, round((SELECT avg((y - {_GUESS.format(p='l_extendedprice')}) ^ 2) FROM test), 1) AS baseline_score,
       round(avg((y - {_GUESS.format(p='price')}) ^ 2), 1) AS corrupted_score FROM x GROUP BY rep""")
def impact_regression(spark, sf):
    key = sql.KEYS["lineitem"]
    lines = revenue_lines(spark, sf).select(*key, "label", "l_extendedprice", "l_discount", "l_tax")
    train, test = split(lines, key, 0.2, SEED)
    task = Task(train, test, key, "label", REGRESSION, [], ["l_extendedprice", "l_discount", "l_tax"], seed=SEED).checkpointed(train=False)
    found = ImpactEvaluator(task, REVENUE_SCORER).evaluate([MissingValues("l_extendedprice", 0.1, "MNAR")], 3)
    return found.select("scenario_id", "rep", F.round("baseline_score", 1).alias("baseline_score"),
                        F.round("corrupted_score", 1).alias("corrupted_score"))


@register("baseline_performance", f"WITH {g.damaged(g.scenario_values(MIXED), 1)} SELECT round({g.base_score()}, 6) AS value")
def baseline_performance(spark, sf):
    return bulk_task(spark, sf).performance(LINE_SCORER).select(F.round("value", 6).alias("value"))


# -- summaries ----------------------------------------------------------------------------

NOISY = [(i, "noise", "l_quantity", f, "CAR", None, None) for i, f in enumerate((0.1, 0.5))]
NOISY_SQL = f"(WITH {g.damaged(g.scenario_values(NOISY), 5)}, after AS ({g.auc_sql('x', g.PLAIN, 'label', 'idx')}) " \
            "SELECT scenario_id, rep, frac AS fraction, col, samp, auc AS score FROM after JOIN scen USING (idx))"


def _noisy(spark, sf):
    evaluator = ImpactEvaluator(bulk_task(spark, sf), LINE_SCORER)
    return evaluator.evaluate([GaussianNoise("l_quantity", f) for f in (0.1, 0.5)], 5)


@register("result_mean", f"SELECT scenario_id, fraction, round(avg(score), 6) AS mean_score FROM {NOISY_SQL} q GROUP BY ALL")
def result_mean(spark, sf):
    return results.mean_scores(_noisy(spark, sf)).select(
        "scenario_id", "fraction", F.round("mean_score", 6).alias("mean_score"))


@register("result_median", f"SELECT scenario_id, round(quantile_cont(score, 0.5), 6) AS median_score FROM {NOISY_SQL} q GROUP BY ALL")
def result_median(spark, sf):
    return results.median_scores(_noisy(spark, sf)).select("scenario_id", F.round("median_score", 6).alias("median_score"))


@register("result_box", f"""
WITH s AS (SELECT * FROM {NOISY_SQL} q0),
q AS (SELECT scenario_id, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS q2, quantile_cont(score, 0.75) AS q3 FROM s GROUP BY ALL)
SELECT scenario_id, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3,
       round(min(score) FILTER (score >= q1 - 1.5 * (q3 - q1) AND score <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
       round(max(score) FILTER (score >= q1 - 1.5 * (q3 - q1) AND score <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high
FROM s JOIN q USING (scenario_id) GROUP BY scenario_id, q1, q2, q3""")
def result_box(spark, sf):
    boxed = results.box_scores(_noisy(spark, sf))
    numbers = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    return boxed.select("scenario_id", *[F.round(c, 6).alias(c) for c in numbers])


@register("result_lookup", f"""SELECT rep, round(score, 6) AS corrupted_score FROM {NOISY_SQL} q
WHERE col = 'l_quantity' AND fraction = 0.5 AND samp = 'CAR'""")
def result_lookup(spark, sf):
    found = results.find_result(_noisy(spark, sf), "l_quantity", 0.5, "CAR")
    return found.select("rep", F.round("corrupted_score", 6).alias("corrupted_score"))


@register("value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, sf):
    return results.value_counts(table(spark, sf, "orders"), "o_orderpriority")


@register("sort_inspect", f"""
SELECT p_partkey, p_size, CASE WHEN hit THEN NULL ELSE p_size END AS damaged
FROM ({sql.marked('part', 0.5, 'NAR', f'{SEED}/damaged', 'p_size')}) m ORDER BY p_size""")
def sort_inspect(spark, sf):
    """Sorted by the damaged column, the hits form one contiguous run of values."""
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    return results.side_by_side(part, ["p_partkey"], {"damaged": MissingValues("p_size", 0.5, "MNAR")}, SEED).orderBy("p_size")


@register("side_by_side", f"""
SELECT p_partkey, p_brand, CASE WHEN a.hit THEN NULL ELSE p_brand END AS brand_mcar,
       CASE WHEN b.hit THEN NULL ELSE p_brand END AS brand_mnar
FROM (SELECT p_partkey, p_brand, hit FROM ({sql.marked('part', 0.5, 'CAR', f'{SEED}/brand_mcar')}) m) a
JOIN (SELECT p_partkey, hit FROM ({sql.marked('part', 0.5, 'NAR', f'{SEED}/brand_mnar', 'p_brand')}) m) b USING (p_partkey)""")
def side_by_side(spark, sf):
    versions = {"brand_mcar": MissingValues("p_brand", 0.5), "brand_mnar": MissingValues("p_brand", 0.5, "MNAR")}
    return results.side_by_side(table(spark, sf, "part").select("p_partkey", "p_brand"), ["p_partkey"], versions, SEED)


@register("augment_tabular", f"""
WITH ranked AS (SELECT *, count(*) OVER () AS n FROM ({sql.keyed('part')}) k1),
parts AS (SELECT * FROM (VALUES (1), (2), (3)) p(severity)),
pos AS (SELECT severity, ranked.*, row_number() OVER (PARTITION BY severity
          ORDER BY {sql.u('v', sql.salt(f"('{SEED}/' || severity)", 'position'))}, k) - 1 AS pos FROM ranked, parts),
draws AS (SELECT severity, draw, v AS dv, CAST(floor({sql.u('v', sql.salt(f"('{SEED}/' || severity)", 'boot'))} * n) AS BIGINT) AS pos
          FROM (SELECT severity, draw, n, {sql.base('CAST(draw AS VARCHAR)')} AS v
                FROM parts, (SELECT n, unnest(range(n // 2)) AS draw FROM (SELECT count(*) AS n FROM part) c) d) e),
drawn AS (SELECT severity, draw, p_partkey, p_name, dv FROM draws JOIN pos USING (severity, pos))
SELECT 0 AS severity, NULL::BIGINT AS draw, p_partkey, p_name FROM part
UNION ALL SELECT severity, draw, p_partkey,
  CASE WHEN {sql.u('dv', sql.salt(f"('{SEED}/' || severity)", 'coin'))} < severity * 0.2::DOUBLE
       THEN translate(p_name, 'aAeEoOuU', 'áÁéÉớỚúÚ') ELSE p_name END FROM drawn""")
def augment_tabular(spark, sf):
    """Originals plus three resampled copies with more and more broken names."""
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    shares = {1: 0.2, 2: 0.4, 3: 0.6000000000000001}
    return results.augment(part, ["p_partkey"], lambda s: BrokenCharacters("p_name", shares[s]),
                           list(shares), part.count() // 2, SEED)
