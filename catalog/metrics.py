"""Quality metrics of the fixed scorers."""

from pyspark.sql import functions as F

from catalog import register, sql, table
from catalog.samplers import LINE_LOGIT, LINE_SCORER
from tarnish.operators import metrics
from tarnish.operators.scoring import CutScorer, LinearScorer

BULK = "CASE WHEN l_quantity * (1 - l_discount) > 24 THEN 1 ELSE 0 END"


def bulk_lines(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.withColumn("label", (F.col("l_quantity") * (1 - F.col("l_discount")) > 24).cast("int"))


def auc_sql(source: str, score: str, label: str, by: str = "") -> str:
    """Mann-Whitney form with average ranks."""
    part = f"PARTITION BY {by}" if by else ""
    tie = f"PARTITION BY {by}, s" if by else "PARTITION BY s"
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return (f"SELECT {keys}CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN r END) "
            f"- sum(y)::DOUBLE * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * (count(*) - sum(y))) END AS auc FROM ("
            f"SELECT *, rank() OVER ({part} ORDER BY s) + (count(*) OVER ({tie}) - 1) / 2.0::DOUBLE AS r FROM ("
            f"SELECT {keys}{score} AS s, {label} AS y FROM {source}) a0) a1 {group}")


@register("auc", f"SELECT round(auc, 9) AS auc FROM ({auc_sql('lineitem', LINE_LOGIT, BULK)}) q")
def auc(spark, sf):
    scored = LINE_SCORER.score(bulk_lines(spark, sf))
    return metrics.roc_auc(scored, "score", "label").select(F.round("auc", 9).alias("auc"))


@register("auc_ties", "SELECT l_returnflag, round(auc, 9) AS auc FROM ("
          f"{auc_sql('lineitem', 'floor(l_quantity / 10)', BULK, 'l_returnflag')}) q")
def auc_ties(spark, sf):
    """Heavily tied scores, one area per return flag."""
    lines = bulk_lines(spark, sf).withColumn("score", F.floor(F.col("l_quantity") / 10))
    return metrics.roc_auc(lines, "score", "label", ["l_returnflag"]).withColumn("auc", F.round("auc", 9))


@register("auc_text_label", "SELECT l_returnflag, round(auc, 9) AS auc FROM ("
          f"{auc_sql('lineitem', LINE_LOGIT, chr(40) + 'l_linestatus = ' + sql.quoted('F') + ')::INT', 'l_returnflag')}) q")
def auc_text_label(spark, sf):
    """Classes are texts; the positive one is named."""
    scored = LINE_SCORER.score(table(spark, sf, "lineitem"))
    return metrics.roc_auc(scored, "score", "l_linestatus", ["l_returnflag"], positive="F").withColumn("auc", F.round("auc", 9))


PART_SCORER = CutScorer(LinearScorer(0.0, {"p_size": (1.0, 25.0), "p_retailprice": (0.002, 1000.0)}), (19.0, 36.0))
PART_LINEAR = "(0.0::DOUBLE + 1.0::DOUBLE * p_size::DOUBLE + 0.002::DOUBLE * p_retailprice)"
PART_CLASS = "CASE WHEN p_size > 33 THEN 2 WHEN p_size > 16 THEN 1 ELSE 0 END"
PART_GUESS = f"(({PART_LINEAR} > 19.0::DOUBLE)::INT + ({PART_LINEAR} > 36.0::DOUBLE)::INT)"


def sized_parts(spark, sf):
    return table(spark, sf, "part").withColumn(
        "label", F.when(F.col("p_size") > 33, 2).when(F.col("p_size") > 16, 1).otherwise(0))


def f1_sql(source: str, by: str = "") -> str:
    """Macro F1 of columns y (label) and g (guess)."""
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return (f"SELECT {keys}avg(2.0::DOUBLE * tp / (a + p)) AS macro_f1 FROM ("
            f"SELECT {keys}c, sum(CASE WHEN side = 0 AND y = g THEN 1 ELSE 0 END) AS tp, "
            f"sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS a, sum(side) AS p FROM ("
            f"SELECT *, y AS c, 0 AS side FROM {source} UNION ALL SELECT *, g AS c, 1 AS side FROM {source}) f0 "
            f"GROUP BY {keys}c) f1 {group}")


@register("macro_f1", f"""
WITH x AS (SELECT {PART_CLASS} AS y, {PART_GUESS} AS g FROM part)
SELECT round(macro_f1, 9) AS macro_f1 FROM ({f1_sql('x')}) q""")
def macro_f1(spark, sf):
    scored = PART_SCORER.score(sized_parts(spark, sf))
    return metrics.macro_f1(scored, "score", "label").select(F.round("macro_f1", 9).alias("macro_f1"))


SIZES = ("small", "middle", "large")
_NAMES = "['small', 'middle', 'large']"


@register("macro_f1_text_label", f"""
WITH x AS (SELECT {_NAMES}[({PART_CLASS}) + 1] AS y, {_NAMES}[{PART_GUESS} + 1] AS g FROM part)
SELECT round(macro_f1, 9) AS macro_f1 FROM ({f1_sql('x')}) q""")
def macro_f1_text_label(spark, sf):
    names = F.array(*[F.lit(s) for s in SIZES])
    scored = PART_SCORER.score(sized_parts(spark, sf)).withColumns(
        {"label": F.get(names, F.col("label")), "score": F.get(names, F.col("score"))})
    return metrics.macro_f1(scored, "score", "label").select(F.round("macro_f1", 9).alias("macro_f1"))


REVENUE = "(l_extendedprice * (1 - l_discount) * (1 + l_tax))"
REVENUE_SCORER = LinearScorer(1500.0, {"l_extendedprice": (0.95, 30000.0), "l_discount": (-28000.0, 0.05),
                                       "l_tax": (27000.0, 0.04)})
REVENUE_GUESS = ("(1500.0::DOUBLE + 0.95::DOUBLE * coalesce(l_extendedprice, 30000.0::DOUBLE) + -28000.0::DOUBLE * "
                 "coalesce(l_discount, 0.05::DOUBLE) + 27000.0::DOUBLE * coalesce(l_tax, 0.04::DOUBLE))")


def revenue_lines(spark, sf):
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, sf, "lineitem").withColumn("label", revenue)


@register("mse", f"SELECT l_returnflag, round(avg(({REVENUE} - {REVENUE_GUESS}) ^ 2), 2) AS mse FROM lineitem GROUP BY 1")
def mse(spark, sf):
    scored = REVENUE_SCORER.score(revenue_lines(spark, sf))
    return metrics.mse(scored, "score", "label", ["l_returnflag"]).withColumn("mse", F.round("mse", 2))


@register("mae", f"SELECT l_returnflag, round(avg(abs({REVENUE} - {REVENUE_GUESS})), 6) AS mae FROM lineitem GROUP BY 1")
def mae(spark, sf):
    scored = REVENUE_SCORER.score(revenue_lines(spark, sf))
    return metrics.mae(scored, "score", "label", ["l_returnflag"]).withColumn("mae", F.round("mae", 6))


@register("score_predictions", f"SELECT round(auc, 9) AS value FROM ({auc_sql('lineitem', 'l_quantity', BULK)}) q")
def score_predictions(spark, sf):
    """Predictions that live in another table, matched by key."""
    lines, key = bulk_lines(spark, sf), sql.KEYS["lineitem"]
    predictions = table(spark, sf, "lineitem").select(*key, F.col("l_quantity").alias("score"))
    found = metrics.score_predictions(predictions, lines, key, "binary")
    return found.select(F.round("value", 9).alias("value"))
