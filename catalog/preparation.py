"""Labels, filters, splits, role inference and ready-made tasks."""

from pyspark.sql import functions as F

from catalog import register, sql, table
from catalog.samplers import SEED
from tarnish.operators.corrupt import MissingValues, numeric_columns
from tarnish.operators.ranks import literal_rows
from tarnish.plans import task as tasks


@register("label_equals", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS label FROM customer""")
def label_equals(spark, sf):
    return tasks.label_equals(table(spark, sf, "customer"), "c_mktsegment", "BUILDING").select("c_custkey", "label")


@register("label_threshold", "SELECT event_id, CASE WHEN value > 50 THEN 1 ELSE 0 END AS label FROM events")
def label_threshold(spark, sf):
    return tasks.label_threshold(table(spark, sf, "events"), "value", 50).select("event_id", "label")


@register("class_subset", """
SELECT vec_id, CASE WHEN label = 9 THEN 1 ELSE 0 END AS label FROM embeddings WHERE label IN (7, 9)""")
def class_subset(spark, sf):
    return tasks.two_classes(table(spark, sf, "embeddings"), "label", 7, 9).select("vec_id", "label")


@register("text_concat", """
SELECT p_partkey, coalesce(p_name, '') || ' ' || coalesce(p_brand, '') || ' ' || coalesce(p_type, '') AS text FROM part""")
def text_concat(spark, sf):
    return tasks.joined_text(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"], "text").select("p_partkey", "text")


@register("text_concat_missing", f"""
SELECT p_partkey, coalesce(CASE WHEN hit THEN NULL ELSE p_name END, '') || ' ' || p_type AS text
FROM ({sql.marked('part', 0.4, 'CAR', SEED)}) m""")
def text_concat_missing(spark, sf):
    holes = MissingValues("p_name", 0.4).transform(table(spark, sf, "part"), ["p_partkey"], SEED)
    return tasks.joined_text(holes, ["p_name", "p_type"], "text").select("p_partkey", "text")


@register("drop_incomplete", f"SELECT o_orderkey FROM ({sql.marked('orders', 0.25, 'CAR', SEED)}) m WHERE NOT hit")
def drop_incomplete(spark, sf):
    holes = MissingValues("o_totalprice", 0.25).transform(table(spark, sf, "orders"), ["o_orderkey"], SEED)
    return tasks.complete_rows(holes).select("o_orderkey")


@register("date_slice", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-05-04' AND TIMESTAMP '1997-06-14'""")
def date_slice(spark, sf):
    first, last = (F.lit(d).cast("timestamp_ntz") for d in ("1996-05-04", "1997-06-14"))
    return tasks.between(table(spark, sf, "orders"), "o_orderdate", first, last).select("o_orderkey", "o_totalprice")


@register("drop_leakage", "SELECT * EXCLUDE (value) FROM events")
def drop_leakage(spark, sf):
    return table(spark, sf, "events").drop("value")


ROLES = """
SELECT column_name AS "column", CASE WHEN data_type = 'VARCHAR' THEN CASE WHEN d <= 100 THEN 'categorical' ELSE 'text' END
       ELSE 'numerical' END AS role
FROM (SELECT 'l_quantity' AS column_name, 'DOUBLE' AS data_type, 0 AS d UNION ALL SELECT 'l_extendedprice', 'DOUBLE', 0
      UNION ALL SELECT 'l_discount', 'DOUBLE', 0 UNION ALL SELECT 'l_tax', 'DOUBLE', 0
      UNION ALL SELECT 'l_returnflag', 'VARCHAR', (SELECT count(DISTINCT l_returnflag) FROM lineitem)
      UNION ALL SELECT 'l_linestatus', 'VARCHAR', (SELECT count(DISTINCT l_linestatus) FROM lineitem)) c"""


@register("infer_roles", ROLES)
def infer_roles(spark, sf):
    lines = table(spark, sf, "lineitem")
    categorical, numerical, text = tasks.infer_roles(lines, sql.KEYS["lineitem"])
    rows = [(c, r) for r, cs in (("categorical", categorical), ("numerical", numerical), ("text", text)) for c in cs]
    return spark.createDataFrame(rows, "column string, role string")


_LIMITS = (24, 25, 26, 149, 150)


@register("infer_roles_limits", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {n} AS max_categories, c AS \"column\", CASE WHEN d <= {n} THEN 'categorical' ELSE 'text' END AS role FROM "
    f"(SELECT 'p_brand' AS c, count(DISTINCT p_brand) AS d FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part "
    f"UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part) x{n}" for n in _LIMITS) + ") y")
def infer_roles_limits(spark, sf):
    """Roles of a ready-made task's columns around the limit of categories that the caller names."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", (F.col("p_size") > 25).cast("int").alias("label"))
    rows = []
    for n in _LIMITS:
        made = tasks.labelled_table(part, ["p_partkey"], "label", "binary", max_categories=n, seed=SEED)
        rows += [{"max_categories": n, "column": c, "role": r} for r, cs in (("categorical", made.categorical), ("text", made.text)) for c in cs]
    return literal_rows(spark, rows, "max_categories int, column string, role string")


@register("task_type", """
SELECT 'lineitem' AS task, CASE WHEN a = b AND a = 2 THEN 'binary' WHEN a = b AND a > 2 THEN 'multiclass' END AS task_type
FROM (SELECT count(DISTINCT l_linestatus) FILTER (l_orderkey % 2 = 0) AS a,
             count(DISTINCT l_linestatus) FILTER (l_orderkey % 2 = 1) AS b FROM lineitem) x
UNION ALL SELECT 'orders', CASE WHEN a = b AND a = 2 THEN 'binary' WHEN a = b AND a > 2 THEN 'multiclass' END
FROM (SELECT count(DISTINCT o_orderstatus) FILTER (o_orderkey % 2 = 0) AS a,
             count(DISTINCT o_orderstatus) FILTER (o_orderkey % 2 = 1) AS b FROM orders) y
UNION ALL SELECT 'customer', 'regression'""")
def task_type(spark, sf):
    """Even keys train, odd keys test."""
    def halves(name, key):
        df = table(spark, sf, name)
        return df.where(F.col(key) % 2 == 0), df.where(F.col(key) % 2 == 1)

    found = [(n, tasks.label_task_type(*halves(n, k), c)) for n, k, c in (
        ("lineitem", "l_orderkey", "l_linestatus"), ("orders", "o_orderkey", "o_orderstatus"),
        ("customer", "c_custkey", "c_acctbal"))]
    return spark.createDataFrame(found, "task string, task_type string")


@register("numeric_split", """
SELECT 'numeric' AS side, count(*) AS n, CAST(sum(p_partkey + p_size) AS BIGINT) AS total FROM part
UNION ALL SELECT 'other', count(*), CAST(sum(length(p_name) + length(p_brand) + length(p_type)) AS BIGINT) FROM part""")
def numeric_split(spark, sf):
    """Whole numbers summed on one side, text lengths on the other."""
    part = table(spark, sf, "part")
    numeric, other = numeric_columns(part)
    whole = [c for c in numeric if c != "p_retailprice"]
    sides = [("numeric", sum((F.col(c).cast("bigint") for c in whole), F.lit(0))),
             ("other", sum((F.length(c) for c in other), F.lit(0)))]
    cells = F.array(*[F.struct(F.lit(n).alias("side"), e.cast("bigint").alias("x")) for n, e in sides])
    return part.select(F.explode(cells).alias("c")).groupBy("c.side").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c.x").alias("total"))


def _parts(task, *columns):
    return task.train.select(*columns, F.lit("train").alias("part")).unionByName(
        task.test.select(*columns, F.lit("test").alias("part")))


@register("task_income_style", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag,
       CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label, CASE WHEN hit THEN 'test' ELSE 'train' END AS part
FROM ({sql.marked('lineitem', 0.2, 'CAR', f'{SEED}/split')}) m""")
def task_income_style(spark, sf):
    made = tasks.income_style(
        table(spark, sf, "lineitem"), sql.KEYS["lineitem"], "l_linestatus", "O",
        categorical=["l_returnflag"], numerical=["l_quantity", "l_discount", "l_tax"], seed=SEED, drop_incomplete=True)
    return _parts(made, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "label")


@register("task_review_style", """
SELECT event_id, event_type || ' ' || props AS text, CASE WHEN value > 50 THEN 1 ELSE 0 END AS label,
       CASE WHEN ts <= TIMESTAMP '2024-01-21 00:00:00' THEN 'train' ELSE 'test' END AS part
FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-21 00:00:00'
   OR ts BETWEEN TIMESTAMP '2024-01-21 00:00:01' AND TIMESTAMP '2024-01-29'""")
def task_review_style(spark, sf):
    def at(text):
        return F.lit(text).cast("timestamp_ntz")

    made = tasks.review_style(
        table(spark, sf, "events"), ["event_id"], "ts", (at("2024-01-02 00:00:00"), at("2024-01-21 00:00:00")),
        (at("2024-01-21 00:00:01"), at("2024-01-29 00:00:00")), votes="value", leaks=["user_id"],
        text_parts=["event_type", "props"], categorical=["event_type"], numerical=[], above=50, seed=SEED)
    return _parts(made, "event_id", "text", "label")


@register("task_image", f"""
SELECT vec_id, label, CASE WHEN hit THEN 'test' ELSE 'train' END AS part, list_sum(pixels) AS total
FROM (SELECT * REPLACE (CASE WHEN label = 9 THEN 1 ELSE 0 END AS label),
      list_transform(embedding, lambda x: CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE,
        (x::DOUBLE + 0.5::DOUBLE) * 255.0::DOUBLE))) AS INT)) AS pixels
      FROM ({sql.marked('embeddings', 0.2, 'CAR', f'{SEED}/split',
                        source='(SELECT * FROM embeddings WHERE label IN (7, 9))')}) m) q""")
def task_image(spark, sf):
    from catalog.images import image_table

    made = tasks.image_style(image_table(spark, sf), ["vec_id"], "label", 7, 9, seed=SEED)
    whole = _parts(made, "vec_id", "label", "pixels")
    total = F.aggregate("pixels", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return whole.withColumn("total", total).drop("pixels")


@register("task_inferred", f"""
SELECT p_partkey, p_size, p_type, label, CASE WHEN hit THEN 'test' ELSE 'train' END AS part FROM (
  SELECT *, CASE WHEN p_size > 33 THEN 2 WHEN p_size > 16 THEN 1 ELSE 0 END AS label
  FROM ({sql.marked('part', 0.2, 'CAR', f'{SEED}/split')}) m) q""")
def task_inferred(spark, sf):
    part = table(spark, sf, "part").withColumn(
        "label", F.when(F.col("p_size") > 33, 2).when(F.col("p_size") > 16, 1).otherwise(0))
    made = tasks.labelled_table(part, ["p_partkey"], "label", "multiclass", seed=SEED).check()
    return _parts(made, "p_partkey", "p_size", "p_type", "label")
