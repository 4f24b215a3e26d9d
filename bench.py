"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   folder with the tables    (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores               (default 8)
    BENCH_ONLY     comma-separated names     (default all)
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import functions as F

from catalog import load_all, sql, table
from tarnish.operators.corrupt import BrokenCharacters, MissingValues
from tarnish.operators.image import ImageCorruption
from tarnish.operators.sampling import sample_rows
from tarnish.operators.schema import profile
from tarnish.operators.scoring import LinearScorer
from tarnish.plans.evaluate import ImpactEvaluator, grid
from tarnish.plans.results import mean_scores
from tarnish.plans.task import BINARY, Task, image_style, split
from tarnish.session import local_session


def drain(df) -> None:
    """Compute every cell without sending rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def mark_car(spark, sf):
    return sample_rows(table(spark, sf, "lineitem"), sql.KEYS["lineitem"], 0.3, "MCAR", seed=7)


def mark_nar(spark, sf):
    return sample_rows(table(spark, sf, "lineitem"), sql.KEYS["lineitem"], 0.3, "MNAR", column="l_extendedprice", seed=7)


def grid_60x10(spark, sf):
    """4 columns x 5 fractions x 3 mechanisms x 10 repetitions on the test part of orders."""
    orders = table(spark, sf, "orders").withColumn("month", F.month("o_orderdate")).withColumn(
        "label", (F.col("o_totalprice") + F.when(F.col("o_orderstatus") == "F", 60000).otherwise(0) > 270000).cast("int"))
    train, test = split(orders, ["o_orderkey"], 0.2, 7)
    task = Task(train, test, ["o_orderkey"], "label", BINARY, ["o_orderstatus", "o_orderpriority"],
                ["o_totalprice", "month"], seed=7).checkpointed(train=False)
    scorer = LinearScorer(-2.7, {"o_totalprice": (0.00001, 250000.0), "month": (0.01, 6.0)},
                          {"o_orderstatus": {"F": 0.6}, "o_orderpriority": {"1-URGENT": 0.05, "5-LOW": -0.05}})
    damage = grid(MissingValues, ["o_totalprice", "month", "o_orderstatus", "o_orderpriority"],
                  [0.99, 0.5, 0.25, 0.1, 0.01], ["MCAR", "MAR", "MNAR"])
    return mean_scores(ImpactEvaluator(task, scorer).evaluate(damage, 10))


def profile_sketch(spark, sf):
    return profile(table(spark, sf, "lineitem"), exact=False)


def profile_exact(spark, sf):
    return profile(table(spark, sf, "lineitem"))


def broken_text(spark, sf):
    return BrokenCharacters("text", 0.5).transform(table(spark, sf, "documents"), ["doc_id"], 7)


def image_noise(spark, sf):
    from catalog.images import image_table
    return ImageCorruption(("gaussian_noise",), 4, 1.0).transform(image_table(spark, sf), ["vec_id"], 7)


def image_grid_7x10x2(spark, sf):
    """7 fractions x 10 repetitions x 3 kinds, scored by two models."""
    from catalog.evaluation import IMAGE_KINDS, PixelScorer
    from catalog.images import image_table
    task = image_style(image_table(spark, sf), ["vec_id"], "label", 7, 9, seed=7).checkpointed(train=False)
    damage = [ImageCorruption((k,), 4, f) for k in IMAGE_KINDS for f in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.99)]
    scorers = {"one": PixelScorer(37), "two": PixelScorer(53)}
    return ImpactEvaluator(task, PixelScorer(37)).compare(scorers, damage, 10)


HEADLINE = {
    "mark_car_lineitem": mark_car,
    "mark_nar_lineitem": mark_nar,
    "grid_60x10_orders": grid_60x10,
    "stress_test_lineitem": load_all()["stress_test"].run,
    "impact_single_lineitem": load_all()["impact_single"].run,
    "profile_lineitem": profile_sketch,
    "profile_exact_lineitem": profile_exact,
    "impact_image_grid_embeddings": image_grid_7x10x2,
    "broken_characters_documents": broken_text,
    "image_noise_embeddings": image_noise,
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    drain(table(spark, folder, "nation"))
    seconds = {}
    for name, query in HEADLINE.items():
        if only and name not in only:
            continue
        started = time.time()
        drain(query(spark, folder))
        seconds[name] = round(time.time() - started, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale.group(1)) if scale else folder,
                      "cpus": spark.sparkContext.defaultParallelism}))


if __name__ == "__main__":
    main()
