import re

import pytest
from pyspark.sql import functions as F

from catalog.compare import duck_rows, spark_rows
from tarnish.llm import queries, sql, urls

DDL = "page_id long, url string, HOST int, verdict string"


def plain(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in urls.RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and len(rule) > len(best or ""):
            best = rule
    listed = re.search(urls.MARKS, host) is not None
    return host, path, best, urls.RULES[best] if best else "block" if listed else "allow"


CASES = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x#y", "x://example.org/es", "x://example.org/en/12", "x://notexample.org/es/", "x://com/fr/",
         "x://a.com/de/x", "x://spam.net/x", "x://a.spam-farm.net?x", "x://spammer.net#", "://pills.net/", "x://a\nb.net/p\nq", "x://É.net/", "a://b://c/d"]


def test_rules_and_parts(spark):
    rows = [(i, u, 3, "x") for i, u in enumerate(CASES)] + [(None, CASES[4], None, None)] * 2
    got = urls.judge(spark.createDataFrame(rows, DDL)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url), r.url


@pytest.mark.parametrize("inside,outside", [(1, 3000), (1500, 1500), (2500, 30), (40, 0), (0, 50)])
def test_cascade_is_exact_over_its_universe(spark, inside, outside):
    universe = spark.range(inside + outside).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") < inside).alias("listed"))
    filters = urls.cascade(universe)
    assert universe.where(filters.listed(F.col("key")) != F.col("listed")).count() == 0
    if outside > inside > 10:
        assert len(filters.levels) > 1


def test_join_beyond_the_bound(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    assert urls.cascade(spark.createDataFrame([("a", True), ("b", False)], "key string, listed boolean"), max_bits=100) is None
    key = lambda df: sorted(map(str, df.select("page_id", "rule", "verdict").collect()))
    assert key(urls.judge(pages, max_bits=100)) == key(urls.judge(pages))


def test_main_path_is_built_in_and_joins_nothing(spark, folder):
    plan = queries.op5_urls(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Join|Exchange|Python|Arrow|Pandas", plan)


def test_matches_sql(spark, folder):
    rows = spark_rows(queries.op5_urls(spark, folder))
    assert rows == duck_rows(folder, sql.URLS)
    assert urls.judge(spark.createDataFrame([], DDL)).count() == 0
