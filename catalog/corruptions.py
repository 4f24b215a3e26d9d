"""Corruptions of single tables."""

from pyspark.sql import functions as F

from catalog import register, sql, table
from catalog.samplers import LINE_LOGIT, LINE_SCORER, SEED
from tarnish.operators.corrupt import (
    BrokenCharacters, CategoricalShift, GaussianNoise, MissingByConfidence, MissingValues, Scaling, SwappedValues,
)

LINE_IDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _when_hit(marked: str, columns: str, cells: str) -> str:
    return f"SELECT {columns}, {cells} FROM ({marked}) m"


@register("missing_car", _when_hit(sql.marked("orders", 0.25, "CAR", SEED), "o_orderkey",
                                   "CASE WHEN hit THEN NULL ELSE o_totalprice END AS o_totalprice"))
def missing_car(spark, sf):
    return MissingValues("o_totalprice", 0.25).transform(
        table(spark, sf, "orders"), ["o_orderkey"], SEED).select("o_orderkey", "o_totalprice")


@register("missing_nar", _when_hit(sql.marked("orders", 0.5, "NAR", SEED, "o_orderstatus"), "o_orderkey",
                                   "CASE WHEN hit THEN NULL ELSE o_orderstatus END AS o_orderstatus"))
def missing_nar(spark, sf):
    return MissingValues("o_orderstatus", 0.5, "MNAR").transform(
        table(spark, sf, "orders"), ["o_orderkey"], SEED).select("o_orderkey", "o_orderstatus")


def _driver(columns: list[str], column: str, seed: object) -> str:
    """The column drawn as driver; only names decide, so it is a fixed value per query."""
    from tarnish.operators.sampling import driver_column
    return driver_column(columns, column, seed)


ORDER_FEATURES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("missing_ar", _when_hit(
    sql.marked("orders", 0.1, "AR", SEED, _driver(ORDER_FEATURES, "o_orderpriority", SEED)), "o_orderkey",
    "CASE WHEN hit THEN NULL ELSE o_orderpriority END AS o_orderpriority"))
def missing_ar(spark, sf):
    return MissingValues("o_orderpriority", 0.1, "MAR").transform(
        table(spark, sf, "orders"), ["o_orderkey"], SEED).select("o_orderkey", "o_orderpriority")


@register("missing_sentinel", _when_hit(sql.marked("customer", 0.05, "CAR", SEED), "c_custkey",
                                        "CASE WHEN hit THEN -999.0 ELSE c_acctbal END AS c_acctbal"))
def missing_sentinel(spark, sf):
    return MissingValues("c_acctbal", 0.05, na_value=-999).transform(
        table(spark, sf, "customer"), ["c_custkey"], SEED).select("c_custkey", "c_acctbal")


@register("missing_empty_text", _when_hit(sql.marked("customer", 0.3, "NAR", SEED, "c_mktsegment"), "c_custkey",
                                          "CASE WHEN hit THEN '' ELSE c_mktsegment END AS c_mktsegment"))
def missing_empty_text(spark, sf):
    return MissingValues("c_mktsegment", 0.3, "MNAR", na_value="").transform(
        table(spark, sf, "customer"), ["c_custkey"], SEED).select("c_custkey", "c_mktsegment")


def _confident_sql(test: str) -> str:
    return (
        f"SELECT {', '.join(LINE_IDS)}, CASE WHEN {test} THEN NULL ELSE l_quantity END AS l_quantity FROM ("
        f"SELECT *, row_number() OVER (ORDER BY abs({LINE_LOGIT}), {sql.draw('v', SEED, 'tie')}, k) - 1 AS rk, "
        f"count(*) OVER () AS n FROM ({sql.keyed('lineitem')}) k1) q")


def _confident(spark, sf, **options):
    spec = MissingByConfidence("l_quantity", 0.3, scorer=LINE_SCORER, **options)
    return spec.transform(table(spark, sf, "lineitem"), sql.KEYS["lineitem"], SEED).select(*LINE_IDS, "l_quantity")


@register("missing_confidence", _confident_sql("rk >= n - floor(n * 0.3::DOUBLE)"))
def missing_confidence(spark, sf):
    return _confident(spark, sf, most_confident=True)


@register("missing_confidence_compat", _confident_sql("rk < floor(n * (1 - 0.3::DOUBLE))"))
def missing_confidence_compat(spark, sf):
    return _confident(spark, sf, most_confident=True, compat=True)


@register("swap_same_type", _when_hit(
    sql.marked("lineitem", 0.2, "CAR", SEED), ", ".join(LINE_IDS),
    "CASE WHEN hit THEN l_tax ELSE l_discount END AS l_discount, CASE WHEN hit THEN l_discount ELSE l_tax END AS l_tax"))
def swap_same_type(spark, sf):
    return SwappedValues("l_discount", 0.2, swap_with="l_tax").transform(
        table(spark, sf, "lineitem"), sql.KEYS["lineitem"], SEED).select(*LINE_IDS, "l_discount", "l_tax")


@register("swap_cross_type", _when_hit(
    sql.marked("part", 0.5, "NAR", SEED, "p_size"), "p_partkey",
    "CASE WHEN hit THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS p_size, "
    "CASE WHEN hit THEN CAST(p_size AS VARCHAR) ELSE p_brand END AS p_brand"))
def swap_cross_type(spark, sf):
    return SwappedValues("p_size", 0.5, "NAR", swap_with="p_brand").transform(
        table(spark, sf, "part"), ["p_partkey"], SEED).select("p_partkey", "p_size", "p_brand")


def shift_sql(values: str, column: str, seed: object) -> str:
    """(value, target) of the permutation of a column's values."""
    v = sql.base("CAST(value AS VARCHAR)")
    return (
        f"SELECT a.value, b.value AS target FROM "
        f"(SELECT value, row_number() OVER (ORDER BY {sql.draw('v', seed, 'from')}, value) AS p FROM "
        f"(SELECT DISTINCT {column} AS value, {v} AS v FROM (SELECT {column}, {column} AS value FROM {values} "
        f"WHERE {column} IS NOT NULL) d) a0) a JOIN "
        f"(SELECT value, row_number() OVER (ORDER BY {sql.draw('v', seed, 'to')}, value) AS p FROM "
        f"(SELECT DISTINCT {column} AS value, {v} AS v FROM (SELECT {column}, {column} AS value FROM {values} "
        f"WHERE {column} IS NOT NULL) d) b0) b USING (p)")


@register("categorical_shift", f"""
SELECT o_orderkey, CASE WHEN hit THEN target ELSE o_orderpriority END AS o_orderpriority
FROM ({sql.marked('orders', 0.6, 'CAR', SEED)}) m
LEFT JOIN ({shift_sql('orders', 'o_orderpriority', SEED)}) s ON s.value = o_orderpriority""")
def categorical_shift(spark, sf):
    return CategoricalShift("o_orderpriority", 0.6).transform(
        table(spark, sf, "orders"), ["o_orderkey"], SEED).select("o_orderkey", "o_orderpriority")


@register("categorical_shift_wide", f"""
SELECT c_custkey, CASE WHEN hit THEN target ELSE c_name END AS c_name
FROM ({sql.marked('customer', 0.5, 'NAR', SEED, 'c_name')}) m
LEFT JOIN ({shift_sql('customer', 'c_name', SEED)}) s ON s.value = c_name""")
def categorical_shift_wide(spark, sf):
    """A column whose values are all different."""
    return CategoricalShift("c_name", 0.5, "NAR").transform(
        table(spark, sf, "customer"), ["c_custkey"], SEED).select("c_custkey", "c_name")


def noise_sql(seed: str, v: str = "v") -> str:
    return sql.normal(v, sql.salt(seed, "n1"), sql.salt(seed, "n2"))


@register("gaussian_noise", f"""
SELECT p_partkey, round(CASE WHEN hit THEN p_retailprice + {noise_sql(sql.quoted(SEED))}
    * ((1 + 4 * {sql.scalar(sql.quoted(SEED), 'scale')}) * sd) ELSE p_retailprice END, 6) AS p_retailprice
FROM ({sql.marked('part', 0.5, 'CAR', SEED)}) m, (SELECT stddev_pop(p_retailprice) AS sd FROM part) s""")
def gaussian_noise(spark, sf):
    noisy = GaussianNoise("p_retailprice", 0.5).transform(table(spark, sf, "part"), ["p_partkey"], SEED)
    return noisy.select("p_partkey", F.round("p_retailprice", 6).alias("p_retailprice"))


@register("scaling", f"""
SELECT {', '.join(LINE_IDS)}, CASE WHEN hit THEN l_quantity *
    CASE CAST(floor(3 * {sql.scalar(sql.quoted(SEED), 'factor')}) AS INT) WHEN 0 THEN 10.0 WHEN 1 THEN 100.0 ELSE 1000.0 END
    ELSE l_quantity END AS l_quantity
FROM ({sql.marked('lineitem', 0.15, 'NAR', SEED, 'l_quantity')}) m""")
def scaling(spark, sf):
    return Scaling("l_quantity", 0.15, "NAR").transform(
        table(spark, sf, "lineitem"), sql.KEYS["lineitem"], SEED).select(*LINE_IDS, "l_quantity")


@register("broken_characters", _when_hit(
    sql.marked("documents", 0.5, "COIN", SEED), "doc_id",
    "CASE WHEN hit THEN translate(text, 'aAeEoOuU', 'áÁéÉớỚúÚ') ELSE text END AS text"))
def broken_characters(spark, sf):
    return BrokenCharacters("text", 0.5).transform(
        table(spark, sf, "documents"), ["doc_id"], SEED).select("doc_id", "text")
