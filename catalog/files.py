"""Sources and sinks: a given table goes out to files in the shared folder and comes back whole."""

import uuid

from pyspark.sql import functions as F

from catalog import register, sql, table
from catalog.images import IMAGES, image_table
from catalog.samplers import SEED
from tarnish.operators.corrupt import MissingValues
from tarnish.session import shared_folder
from tarnish.sources import tables

PARTS = f"""SELECT p_partkey, CASE WHEN hit THEN NULL ELSE p_name END AS p_name, p_size, round(p_retailprice, 2) AS p_retailprice
FROM ({sql.marked('part', 0.2, 'CAR', SEED)}) m"""


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _holed_parts(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.round("p_retailprice", 2).alias("p_retailprice"))
    return MissingValues("p_name", 0.2).transform(part, ["p_partkey"], SEED)


@register("source_csv", PARTS)
def source_csv(spark, sf):
    """Header, types found in the cells, ``?`` for missing."""
    path = _folder(spark)
    _holed_parts(spark, sf).write.csv(path, header=True, nullValue="?")
    return tables.read_csv(spark, path)


@register("source_tsv", PARTS)
def source_tsv(spark, sf):
    """No header, the caller's schema, empty cells for missing."""
    path = _folder(spark)
    _holed_parts(spark, sf).write.csv(path, sep="\t", nullValue="")
    return tables.read_tsv(spark, path, "p_partkey bigint, p_name string, p_size bigint, p_retailprice double")


@register("source_images", f"SELECT vec_id, label, height, width, list_sum(pixels)::BIGINT AS total, len(pixels) AS cells FROM {IMAGES} m")
def source_images(spark, sf):
    path = _folder(spark)
    image_table(spark, sf).write.parquet(path)
    total = F.aggregate("pixels", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return tables.read_images(spark, path).select("vec_id", "label", "height", "width", total.alias("total"),
                                                  F.size("pixels").cast("bigint").alias("cells"))


@register("source_table", """
SELECT event_id, user_id, event_type, CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM events""")
def source_table(spark, sf):
    """A typed table; NaN comes back as missing."""
    return tables.read_table(spark, f"{sf}/events.parquet").select("event_id", "user_id", "event_type", "value")


@register("sink_results", """
SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1""")
def sink_results(spark, sf):
    """A summary saved as JSON lines."""
    path = _folder(spark)
    found = table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
    tables.write_results(found, path)
    return spark.read.schema("o_orderpriority string, n bigint, mean_price double").json(path)
