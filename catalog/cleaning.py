"""Imputation after injected gaps."""

from pyspark.sql import functions as F

from catalog import register, sql, table
from catalog.samplers import SEED
from tarnish.operators import clean
from tarnish.operators.corrupt import MissingValues


def _gaps(spark, sf, name, column, fraction, **options):
    return MissingValues(column, fraction, **options).transform(table(spark, sf, name), sql.KEYS[name], SEED)


def _gaps_sql(name, column, fraction, na="NULL"):
    return (f"SELECT * REPLACE (CASE WHEN hit THEN {na} ELSE {column} END AS {column}) "
            f"FROM ({sql.marked(name, fraction, 'CAR', SEED)}) g")


def _mode_sql(source, column):
    return (f"SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} "
            f"ORDER BY count(*) DESC, {column} LIMIT 1")


@register("impute_mode", f"""
WITH g AS ({_gaps_sql('orders', 'o_orderpriority', 0.4)})
SELECT o_orderkey, coalesce(o_orderpriority, ({_mode_sql('g', 'o_orderpriority')})) AS o_orderpriority,
       coalesce(o_orderstatus, ({_mode_sql('g', 'o_orderstatus')})) AS o_orderstatus FROM g""")
def impute_mode(spark, sf):
    gaps = _gaps(spark, sf, "orders", "o_orderpriority", 0.4)
    return clean.fit_mode(gaps, ["o_orderpriority", "o_orderstatus"]).transform(gaps).select(
        "o_orderkey", "o_orderpriority", "o_orderstatus")


@register("impute_mode_number", f"""
WITH g AS ({_gaps_sql('part', 'p_size', 0.4)})
SELECT p_partkey, coalesce(p_size, ({_mode_sql('g', 'p_size')})) AS p_size FROM g""")
def impute_mode_number(spark, sf):
    gaps = _gaps(spark, sf, "part", "p_size", 0.4)
    return clean.fit_mode(gaps, ["p_size"]).transform(gaps).select("p_partkey", "p_size")


@register("impute_mean", f"""
WITH g AS ({_gaps_sql('orders', 'o_totalprice', 0.4)})
SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM g)), 4) AS o_totalprice FROM g""")
def impute_mean(spark, sf):
    gaps = _gaps(spark, sf, "orders", "o_totalprice", 0.4)
    filled = clean.fit_mean(gaps, ["o_totalprice"]).transform(gaps)
    return filled.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@register("impute_constant", f"""
SELECT c_custkey, coalesce(c_mktsegment, 'UNKNOWN') AS c_mktsegment
FROM ({_gaps_sql('customer', 'c_mktsegment', 0.3)}) g""")
def impute_constant(spark, sf):
    gaps = _gaps(spark, sf, "customer", "c_mktsegment", 0.3)
    return clean.fill_constant({"c_mktsegment": "UNKNOWN"}).transform(gaps).select("c_custkey", "c_mktsegment")


@register("repair_sentinel", f"""
SELECT p_partkey, round(CASE WHEN p_retailprice < 0 THEN (SELECT avg(p_retailprice) FROM part) ELSE p_retailprice END, 6)
       AS p_retailprice FROM ({_gaps_sql('part', 'p_retailprice', 0.8, '-1.0')}) g""")
def repair_sentinel(spark, sf):
    part = table(spark, sf, "part")
    broken = _gaps(spark, sf, "part", "p_retailprice", 0.8, na_value=-1.0)
    mean = clean.fit_mean(part, ["p_retailprice"]).fills["p_retailprice"]
    fixed = clean.repair_sentinel(broken, "p_retailprice", F.col("p_retailprice") < 0, mean)
    return fixed.select("p_partkey", F.round("p_retailprice", 6).alias("p_retailprice"))


@register("impute_conditional_mode", f"""
WITH g AS ({_gaps_sql('part', 'p_type', 0.5)}),
c AS (SELECT p_brand, p_size, p_type, count(*) AS n FROM g WHERE p_type IS NOT NULL GROUP BY ALL),
m AS (SELECT p_brand, p_size, p_type AS best FROM (
        SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY n DESC, p_type) AS r FROM c) x WHERE r = 1)
SELECT p_partkey, coalesce(p_type, best, ({_mode_sql('g', 'p_type')})) AS p_type
FROM g LEFT JOIN m USING (p_brand, p_size)""")
def impute_conditional_mode(spark, sf):
    gaps = _gaps(spark, sf, "part", "p_type", 0.5)
    return clean.fit_conditional_mode(gaps, "p_type", ["p_brand", "p_size"]).transform(gaps).select(
        "p_partkey", "p_type")


_COMBO = "CASE WHEN l_quantity <= 17 THEN 0 ELSE l_partkey END"


@register("impute_conditional_skew", f"""
WITH g AS (SELECT * REPLACE (CASE WHEN hit THEN NULL ELSE l_returnflag END AS l_returnflag), {_COMBO} AS combo
           FROM ({sql.marked('lineitem', 0.5, 'CAR', SEED)}) g0),
c AS (SELECT combo, l_returnflag, count(*) AS n FROM g WHERE l_returnflag IS NOT NULL GROUP BY ALL),
m AS (SELECT combo, l_returnflag AS best FROM (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY n DESC, l_returnflag) AS r FROM c) x WHERE r = 1)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(l_returnflag, best, ({_mode_sql('g', 'l_returnflag')})) AS l_returnflag
FROM g LEFT JOIN m USING (combo)""")
def impute_conditional_skew(spark, sf):
    """One combination holds a third of the rows; the table of modes is taken as too large to broadcast whole."""
    gaps = _gaps(spark, sf, "lineitem", "l_returnflag", 0.5).withColumn("combo", F.expr(_COMBO))
    imputer = clean.fit_conditional_mode(gaps, "l_returnflag", ["combo"], broadcast_bytes=0)
    return imputer.transform(gaps).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
