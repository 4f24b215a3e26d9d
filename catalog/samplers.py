"""Row samplers and splits."""

from pyspark.sql import functions as F

from catalog import register, sql, table
from tarnish.operators.corrupt import MissingByConfidence
from tarnish.operators.sampling import KeyedTable, Draw, bootstrap, coin, mark, random_split, sample_rows
from tarnish.operators.scoring import LinearScorer
from tarnish.plans.task import between

SEED = 7

# A fixed linear model of "this line ships in bulk"; the same numbers appear in the SQL.
LINE_SCORER = LinearScorer(
    -7.2, {"l_quantity": (0.3, 25.0), "l_discount": (-7.5, 0.05), "l_tax": (0.4, 0.04)},
    {"l_returnflag": {"A": 0.15, "N": -0.1, "R": 0.05}, "l_linestatus": {"F": 0.2, "O": -0.2}})
LINE_LOGIT = (
    "(-7.2::DOUBLE + 0.3::DOUBLE * coalesce(l_quantity, 25.0::DOUBLE) + -7.5::DOUBLE * coalesce(l_discount, 0.05::DOUBLE)"
    " + 0.4::DOUBLE * coalesce(l_tax, 0.04::DOUBLE)"
    " + CASE WHEN l_returnflag = 'A' THEN 0.15::DOUBLE WHEN l_returnflag = 'N' THEN -0.1::DOUBLE"
    " WHEN l_returnflag = 'R' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END"
    " + CASE WHEN l_linestatus = 'F' THEN 0.2::DOUBLE WHEN l_linestatus = 'O' THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END)")


@register("smp_car", f"SELECT o_orderkey, hit FROM ({sql.marked('orders', 0.3, 'CAR', SEED)}) q")
def smp_car(spark, sf):
    return sample_rows(table(spark, sf, "orders"), ["o_orderkey"], 0.3, "MCAR", seed=SEED).select("o_orderkey", "hit")


@register("smp_nar", f"SELECT o_orderkey, hit FROM ({sql.marked('orders', 0.29, 'NAR', SEED, 'o_totalprice')}) q")
def smp_nar(spark, sf):
    return sample_rows(table(spark, sf, "orders"), ["o_orderkey"], 0.29, "MNAR", column="o_totalprice",
                       seed=SEED).select("o_orderkey", "hit")


@register("smp_nar_ties", f"SELECT o_orderkey, hit FROM ({sql.marked('orders', 0.29, 'NAR', SEED, 'o_orderpriority')}) q")
def smp_nar_ties(spark, sf):
    return sample_rows(table(spark, sf, "orders"), ["o_orderkey"], 0.29, "NAR", column="o_orderpriority",
                       seed=SEED).select("o_orderkey", "hit")


@register("smp_ar", f"SELECT o_orderkey, hit FROM ({sql.marked('orders', 0.4, 'AR', SEED, 'o_orderdate')}) q")
def smp_ar(spark, sf):
    return sample_rows(table(spark, sf, "orders"), ["o_orderkey"], 0.4, "MAR", column="o_totalprice",
                       depends_on="o_orderdate", seed=SEED).select("o_orderkey", "hit")


@register("smp_nar_large", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, hit FROM ("
          f"{sql.marked('lineitem', 0.37, 'NAR', SEED, 'l_extendedprice')}) q")
def smp_nar_large(spark, sf):
    marked = sample_rows(table(spark, sf, "lineitem"), sql.KEYS["lineitem"], 0.37, "NAR",
                         column="l_extendedprice", seed=SEED)
    return marked.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "hit")


@register("smp_all", f"SELECT c_custkey, hit FROM ({sql.marked('customer', 1.0, 'CAR', SEED)}) q")
def smp_all(spark, sf):
    return sample_rows(table(spark, sf, "customer"), ["c_custkey"], 1.0, "AR", column="c_acctbal",
                       seed=SEED).select("c_custkey", "hit")


@register("smp_coin", f"SELECT event_id, hit FROM ({sql.marked('events', 0.25, 'COIN', SEED)}) q")
def smp_coin(spark, sf):
    return coin(table(spark, sf, "events"), ["event_id"], 0.25, SEED).select("event_id", "hit")


def _confidence_sql(side: str) -> str:
    test = "rk < kk" if side == "low" else "rk >= n - kk"
    return (
        f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {test} AS hit FROM ("
        f"SELECT *, row_number() OVER (ORDER BY abs({LINE_LOGIT}), {sql.draw('v', SEED, 'tie')}, k) - 1 AS rk, "
        f"count(*) OVER () AS n, floor(count(*) OVER () * 0.2::DOUBLE) AS kk FROM ({sql.keyed('lineitem')}) k1) q")


def _confidence(spark, sf, most: bool):
    scored = LINE_SCORER.score(table(spark, sf, "lineitem"), "_score")
    scored = scored.withColumn("_confidence", LINE_SCORER.confidence("_score"))
    spec = MissingByConfidence("l_quantity", 0.2, most_confident=most)
    draw = Draw(str(SEED), "RANKS", 0.2, "_confidence", span=spec.span)
    return mark(KeyedTable(scored, sql.KEYS["lineitem"], SEED), draw, "hit").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "hit")


@register("smp_confidence", _confidence_sql("high"))
def smp_confidence(spark, sf):
    return _confidence(spark, sf, True)


@register("smp_least_confident", _confidence_sql("low"))
def smp_least_confident(spark, sf):
    return _confidence(spark, sf, False)


@register("smp_bootstrap", f"""
WITH ranked AS (SELECT *, row_number() OVER (ORDER BY {sql.draw('v', SEED, 'position')}, k) - 1 AS pos,
                       count(*) OVER () AS n FROM ({sql.keyed('part')}) k1),
draws AS (SELECT draw, CAST(floor({sql.draw('v', SEED, 'boot')} * n) AS BIGINT) AS pos FROM (
            SELECT draw, n, {sql.base('CAST(draw AS VARCHAR)')} AS v
            FROM (SELECT n, unnest(range(n)) AS draw FROM (SELECT count(*) AS n FROM part) c) d) e)
SELECT draw, p_partkey, p_brand FROM draws JOIN ranked USING (pos)""")
def smp_bootstrap(spark, sf):
    part = table(spark, sf, "part")
    return bootstrap(part, ["p_partkey"], part.count(), SEED).select("draw", "p_partkey", "p_brand")


@register("split_random", f"SELECT o_orderkey, hit AS is_test FROM ({sql.marked('orders', 0.2, 'CAR', f'{SEED}/split')}) q")
def split_random(spark, sf):
    return random_split(table(spark, sf, "orders"), ["o_orderkey"], 0.2, SEED).select("o_orderkey", "is_test")


@register("split_time", """
SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-21 00:00:00' THEN 'train' ELSE 'test' END AS part FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-21 00:00:00'
   OR ts BETWEEN TIMESTAMP '2024-01-21 00:00:01' AND TIMESTAMP '2024-01-29 00:00:00'""")
def split_time(spark, sf):
    events = table(spark, sf, "events")
    train = between(events, "ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
                    F.lit("2024-01-21 00:00:00").cast("timestamp_ntz"))
    test = between(events, "ts", F.lit("2024-01-21 00:00:01").cast("timestamp_ntz"),
                   F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"))
    return train.select("event_id", F.lit("train").alias("part")).unionByName(
        test.select("event_id", F.lit("test").alias("part")))
