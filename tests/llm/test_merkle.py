import hashlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from catalog.compare import duck_rows, spark_rows
from tarnish.llm import merkle, queries, sql


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves, fanout):
    """The root and each leaf's path."""
    paths = [[] for _ in leaves]
    nodes = [(h, [k]) for k, h in enumerate(leaves)]
    while len(nodes) > 1:
        up = []
        for at in range(0, len(nodes), fanout):
            run = nodes[at:at + fanout]
            for s, (_, below) in enumerate(run):
                step = ("".join(h for h, _ in run[:s]), "".join(h for h, _ in run[s + 1:]))
                for k in below:
                    paths[k].append(step)
            up.append((digest("".join(h for h, _ in run)), [k for _, below in run for k in below]))
        nodes = up
    return nodes[0][0], paths


def brute(rows, fanout):
    """rows: (group, order, value)."""
    key = lambda r: (r[0] is not None, (r[0] or "").encode())
    groups = [sorted(((r[1] is not None, r[1] or 0, digest(field(r[2])), r) for r in g), key=lambda x: x[:3]) for _, g in groupby(sorted(rows, key=key), key)]
    trees = [tree([x[2] for x in g], fanout) for g in groups]
    root, tops = tree([t[0] for t in trees], fanout)
    return sorted([(x[3][1], x[3][2], x[2], sub, root, path + top) for g, (sub, paths), top in zip(groups, trees, tops) for x, path in zip(g, paths)], key=str)


def proved(spark, rows, fanout, ddl="path string, at long, digest string"):
    frame = spark.createDataFrame(rows, ddl).repartition(5)
    out = merkle.prove(frame, merkle.leaf_digest(F.col("digest")), "path", "at", [F.col("at"), F.col("digest")], fanout)
    out = out.withColumn("fold", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert all(r.fold == r.root for r in out)
    return sorted([(r["at"], r["digest"], r.leaf, r.subroot, r.root, [(p.before, p.after) for p in r.path]) for r in out], key=str)


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_equals_a_plain_tree(spark, fanout, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 8)  # several strides on small trees
    rows = [("fr", i * 7 % 100, f"v{i}") for i in range(100)] + [("de", i, "é") for i in range(17)] + [(None, i, None) for i in range(2)]
    rows += [("", 1, "x"), ("z", 5, "same"), ("z", 5, "same"), ("z", 5, "other"), ("z", None, "none"), ("É", 2, "w" * 100_000)]
    assert proved(spark, rows, fanout) == brute(rows, fanout)


def test_one_hot_group_of_equal_rows(spark):
    rows = [("a", 1, "r")] * 600 + [("b", i, "s") for i in range(3)]
    assert proved(spark, rows, 2) == brute(rows, 2)


def test_single_rows_and_empty_table(spark):
    assert proved(spark, [("a", 1, "v")], 2) == [(1, "v", digest("1:v"), digest("1:v"), digest("1:v"), [])]
    frame = spark.createDataFrame([], "g string, o long")
    assert merkle.prove(frame, merkle.leaf_digest(F.col("o")), "g", "o", [F.col("o")]).count() == 0
    with pytest.raises(ValueError):
        merkle.prove(frame, F.lit(""), "g", "o", [], 1)


def test_levels_of_a_block_share_one_exchange(spark):
    nodes = spark.range(1000).selectExpr("string(id div 5000) AS g", "id AS i", "1000L AS n", "string(id) AS digest", "struct(id) AS item")
    plan = merkle._climbed(nodes, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("SortAggregate") >= 8


def test_tampering_is_noticed(spark, folder):
    out = queries.op12_merkle(spark, folder)
    names, rows = spark_rows(out)
    assert (names, rows) == duck_rows(folder, sql.MERKLE)
    at = names.index("verified")
    assert {r[at] for r in rows} == {"True", "False"}
