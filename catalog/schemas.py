"""Profiles, inferred schemas and validation."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from catalog import register, sql, table
from catalog.samplers import SEED
from tarnish.operators.corrupt import BrokenCharacters, MissingValues, Scaling
from tarnish.operators.schema import infer_schema, profile, validate, value_histogram

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDER_STRINGS = ["o_orderstatus", "o_orderpriority"]


def _profile_sql(name: str, source: str, numbers: dict[str, str], strings: list[str], times: list[str] = ()) -> str:
    parts = []
    for c, kind in numbers.items():
        x = f"{c}::DOUBLE"
        parts.append(
            f"SELECT '{c}' AS \"column\", '{kind}' AS type, count({c}) AS present, count(*) - count({c}) AS missing, "
            f"count(*) FILTER ({c} = 0) AS zeros, min({x}) AS min, max({x}) AS max, round(avg({x}), 6) AS mean, "
            f"round(stddev_pop({x}), 4) AS std, quantile_disc({x}, 0.5) AS median, NULL::BIGINT AS min_length, "
            f"NULL::BIGINT AS max_length, NULL::DOUBLE AS mean_length, NULL::BIGINT AS \"distinct\", "
            f"NULL::VARCHAR AS top_value, NULL::BIGINT AS top_count FROM {source}")
    for c in strings:
        top = f"FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        parts.append(
            f"SELECT '{c}', 'STRING', count({c}), count(*) - count({c}), NULL, NULL, NULL, NULL, NULL, NULL, min(length({c})), "
            f"max(length({c})), round(avg(length({c})), 6), count(DISTINCT {c}), (SELECT {c} {top}, (SELECT count(*) {top} FROM {source}")
    for c in times:
        text = f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
        top = f"FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        parts.append(
            f"SELECT '{c}', 'TIME', count({c}), count(*) - count({c}), NULL, epoch(min({c}))::DOUBLE, epoch(max({c}))::DOUBLE, "
            f"NULL, NULL, NULL, NULL, NULL, NULL, count(DISTINCT {c}), (SELECT {text} {top}, (SELECT count(*) {top} FROM {source}")
    return " UNION ALL ".join(parts)


def _profile(df, columns):
    found = profile(df, columns, exact=True)
    return found.select(
        "column", "type", "present", "missing", "zeros", "min", "max", F.round("mean", 6).alias("mean"),
        F.round("std", 4).alias("std"), F.col("q50").alias("median"), "min_length", "max_length",
        F.round("mean_length", 6).alias("mean_length"), "distinct", "top_value", "top_count")


@register("profile", _profile_sql("orders", "orders", {"o_orderkey": "INT", "o_custkey": "INT", "o_totalprice": "FLOAT"}, ORDER_STRINGS,
                                  ["o_orderdate"]))
def profile_orders(spark, sf):
    orders = table(spark, sf, "orders")
    return _profile(orders, orders.columns)


@register("profile_texts", _profile_sql("documents", "documents", {"n_chars": "INT"}, ["text", "lang", "source"])
          + " UNION ALL " + _profile_sql("pages", "pages", {}, ["url", "html"]))
def profile_texts(spark, sf):
    """Columns of long texts; only hashes of them are shuffled."""
    documents, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    return _profile(documents, ["n_chars", "text", "lang", "source"]).unionByName(_profile(pages, ["url", "html"]))


@register("profile_lineitem", _profile_sql(
    "lineitem", "lineitem", {"l_orderkey": "INT", "l_partkey": "INT", "l_suppkey": "INT", "l_linenumber": "INT",
                             "l_quantity": "FLOAT", "l_extendedprice": "FLOAT", "l_discount": "FLOAT", "l_tax": "FLOAT"},
    ["l_returnflag", "l_linestatus"], ["l_shipdate"]))
def profile_lineitem(spark, sf):
    lines = table(spark, sf, "lineitem")
    return _profile(lines, lines.columns)


@register("value_histogram", """
SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL""")
def histogram(spark, sf):
    return value_histogram(table(spark, sf, "orders"), ORDER_STRINGS)


def _expect(c: str, kind: str, source: str, domain: bool) -> str:
    values = (f"CASE WHEN count(DISTINCT {c}) <= 100 THEN array_to_string(list_sort(list(DISTINCT {c})), '|') END"
              if domain else "NULL")
    note = f"CASE WHEN count(DISTINCT {c}) > 100 THEN 'no domain: over 100 values' END" if domain else "NULL"
    return (f"SELECT '{c}' AS \"column\", '{kind}' AS type, CASE WHEN count(*) = count({c}) THEN 1.0 ELSE 0.0 END AS min_fraction, "
            f"{values} AS domain, {note} AS note FROM {source}")


HOLES = f"(SELECT * REPLACE (CASE WHEN hit THEN NULL ELSE c_acctbal END AS c_acctbal) FROM ({sql.marked('customer', 0.1, 'CAR', SEED)}) m)"


@register("infer_schema", " UNION ALL ".join([
    _expect("c_custkey", "INT", HOLES, False), _expect("c_name", "STRING", HOLES, True),
    _expect("c_nationkey", "INT", HOLES, False), _expect("c_acctbal", "FLOAT", HOLES, False),
    _expect("c_mktsegment", "STRING", HOLES, True)]))
def infer_customer(spark, sf):
    holes = MissingValues("c_acctbal", 0.1).transform(table(spark, sf, "customer"), ["c_custkey"], SEED)
    return infer_schema(holes).to_df(spark).select(
        "column", "type", "min_fraction", F.array_join("domain", "|").alias("domain"), "note")


@register("validate_clean", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS present, count(DISTINCT {c}) AS \"distinct\", 0::BIGINT AS anomalies FROM orders"
    for c in ORDER_COLUMNS if c not in ("o_orderkey", "o_custkey", "o_totalprice")))
def validate_clean(spark, sf):
    """A schema accepts the data it was learnt from; counted beside the cells that were checked."""
    orders = table(spark, sf, "orders").select(*ORDER_COLUMNS)
    found = validate(orders, infer_schema(orders)).groupBy("column").agg(F.count(F.lit(1)).alias("_n"))
    counted = profile(orders).where(F.col("distinct").isNotNull()).select("column", "present", "distinct")
    return counted.join(found, "column", "left").select("column", "present", "distinct", F.coalesce("_n", F.lit(0)).alias("anomalies"))


def _damaged_orders(spark, sf):
    orders, key = table(spark, sf, "orders").select(*ORDER_COLUMNS), ["o_orderkey"]
    damage = [MissingValues("o_totalprice", 0.2), BrokenCharacters("o_orderpriority", 0.5),
              MissingValues("o_orderstatus", 0.1, na_value="")]
    return orders, reduce(lambda df, c: c.transform(df, key, SEED), damage, orders)


DAMAGED = f"""
SELECT o_orderkey, CASE WHEN a.hit THEN NULL ELSE o_totalprice END AS o_totalprice,
       CASE WHEN b.hit THEN translate(o_orderpriority, 'aAeEoOuU', 'áÁéÉớỚúÚ') ELSE o_orderpriority END AS o_orderpriority,
       CASE WHEN c.hit THEN '' ELSE o_orderstatus END AS o_orderstatus
FROM ({sql.marked('orders', 0.2, 'CAR', SEED)}) a
JOIN (SELECT o_orderkey, hit FROM ({sql.marked('orders', 0.5, 'COIN', SEED)}) m) b USING (o_orderkey)
JOIN (SELECT o_orderkey, hit FROM ({sql.marked('orders', 0.1, 'CAR', SEED)}) m) c USING (o_orderkey)"""


def _inside(column: str) -> str:
    return f"avg(CASE WHEN {column} IN (SELECT DISTINCT {column} FROM orders) THEN 1.0 ELSE 0.0 END)"


CODES = f"""
SELECT 'o_totalprice' AS "column", 'PRESENCE_BELOW_MIN' AS code, round(count(o_totalprice) / count(*), 6) AS observed, 1.0 AS expected FROM d
UNION ALL SELECT 'o_orderpriority', 'OUT_OF_DOMAIN', round({_inside('o_orderpriority')}, 6), 1.0 FROM d
UNION ALL SELECT 'o_orderstatus', 'OUT_OF_DOMAIN', round({_inside('o_orderstatus')}, 6), 1.0 FROM d"""


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("column", "code", F.round("observed", 6).alias("observed"), "expected")


@register("validate_corrupted", f"WITH d AS MATERIALIZED ({DAMAGED}) {CODES}")
def validate_corrupted(spark, sf):
    orders, damaged = _damaged_orders(spark, sf)
    return _rounded(validate(damaged, infer_schema(orders)))


@register("relaxed_domain", f"""
WITH d AS MATERIALIZED ({DAMAGED}) SELECT * FROM ({CODES}) q WHERE "column" = 'o_totalprice'
UNION ALL SELECT 'o_custkey', 'OUT_OF_RANGE', count(*) FILTER (o_custkey > 100)::DOUBLE, 0.0 FROM orders""")
def relaxed_domain(spark, sf):
    """Domains no longer enforced, but a range on a number that the data break."""
    orders, damaged = _damaged_orders(spark, sf)
    schema = infer_schema(orders).relax("o_orderpriority", min_domain_mass=0.0)
    schema = schema.relax("o_orderstatus", min_domain_mass=0.0).relax("o_custkey", min=0, max=100)
    return _rounded(validate(damaged, schema))


@register("validate_structure", """
SELECT 'o_orderpriority' AS "column", 'MISSING_COLUMN' AS code, 0.0 AS observed, 1.0 AS expected, count(*) AS rows FROM orders
UNION ALL SELECT 'surprise', 'NEW_COLUMN', 1.0, 0.0, count(*) FROM orders
UNION ALL SELECT 'o_custkey', 'TYPE_MISMATCH', 0.0, 1.0, count(*) FROM orders""")
def validate_structure(spark, sf):
    """A dropped, an added and a retyped column, reported beside the number of rows checked."""
    orders = table(spark, sf, "orders").select(*ORDER_COLUMNS)
    changed = orders.drop("o_orderpriority").withColumn("surprise", F.lit(1)).withColumn(
        "o_custkey", F.col("o_custkey").cast("double"))
    return validate(changed, infer_schema(orders)).withColumn("rows", F.lit(changed.count()))


@register("validate_scaled", f"""
SELECT 'o_totalprice' AS "column", 'OUT_OF_RANGE' AS code, count(*) FILTER (p > 600000)::DOUBLE AS observed, 0.0 AS expected
FROM (SELECT CASE WHEN hit THEN o_totalprice * CASE CAST(floor(3 * {sql.scalar(sql.quoted(SEED), 'factor')}) AS INT)
        WHEN 0 THEN 10.0 WHEN 1 THEN 100.0 ELSE 1000.0 END ELSE o_totalprice END AS p
      FROM ({sql.marked('orders', 0.3, 'NAR', SEED, 'o_totalprice')}) m) q""")
def validate_scaled(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    schema = infer_schema(orders).relax("o_totalprice", min=0, max=600000)
    scaled = Scaling("o_totalprice", 0.3, "NAR").transform(orders, ["o_orderkey"], SEED)
    return validate(scaled, schema)
