import math

import numpy as np
import pytest

from tarnish.llm import embeddings, queries

DDL = "vec_id long, embedding array<float>, label string, C int"


def plain(rows):
    """Brute force over (id, vector) rows, ids unique: (n_links, component)."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    at = [i for i in range(len(rows)) if ok[i]]
    links = {i: set() for i in range(len(rows))}
    for dim in {len(rows[i][1]) for i in at}:
        mine = [i for i in at if len(rows[i][1]) == dim]
        x = np.array([rows[i][1] for i in mine], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= 0.95)):
            if a != b:
                links[mine[a]].add(mine[b])
    label = {}
    for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        if i not in label:
            stack = [i]
            while stack:
                j = stack.pop()
                if j not in label:
                    label[j] = rows[i][0]
                    stack.extend(links[j])
    return {rows[i][0]: (len(links[i]), label[i], label[i] == rows[i][0]) for i in range(len(rows))}, sum(map(len, links.values()))


def near(rng, v, cosine):
    z = rng.normal(size=len(v))
    v = v / np.linalg.norm(v)
    z -= (z @ v) * v
    z /= np.linalg.norm(z)
    return (cosine * v + math.sqrt(1 - cosine**2) * z) * rng.uniform(0.1, 10)


def test_query_against_brute_force(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    expected, _ = plain(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op3_embeddings(spark, folder).collect()}
    assert got == expected


@pytest.mark.parametrize("limit", [2048, 60])
def test_recall_and_precision(spark, limit):
    """Pairs just over and under the border, a dense cluster, copies; long lists are refined or cut into blocks."""
    rng = np.random.default_rng(1)
    vectors = []
    for i in range(250):
        v = rng.normal(size=32)
        vectors += [v, near(rng, v, rng.uniform(0.951, 0.999)), near(rng, v, rng.uniform(0.90, 0.949))]
    centre = rng.normal(size=32)
    vectors += [near(rng, centre, rng.uniform(0.96, 0.999)) for _ in range(150)] + [centre] * 40
    rows = [(i, np.asarray(v, np.float32).tolist()) for i, v in enumerate(vectors)]
    expected, total = plain(rows)
    frame = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], DDL)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame, limit=limit).collect()}
    assert sum(g[0] for g in got.values()) <= total
    assert all(got[i][0] <= expected[i][0] for i in got)
    assert sum(g[0] for g in got.values()) >= 0.97 * total
    pairs = [i for i in range(0, 750, 3) if expected[i][0]]
    assert np.mean([got[i] == expected[i] for i in pairs]) >= 0.95


def test_lists_give_the_same_links_at_any_length(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    rows = [(i, np.asarray(near(rng, centre, rng.uniform(0.93, 0.999)), np.float32).tolist(), "", 0) for i in range(300)]
    frame = spark.createDataFrame(rows, DDL)
    a = sorted(map(tuple, embeddings.near_duplicates(frame).collect()))
    assert a == sorted(map(tuple, embeddings.near_duplicates(frame, limit=40).collect()))


def test_edge_rows(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(5, v, "a", 1), (3, [2.0, 4.0, 6.0], "b", 1), (4, w, None, None), (4, w, None, None), (None, v, "n", 0), (6, None, "", 0), (7, [0.0, 0.0, 0.0], "", 0),
            (8, [1.0, None, 2.0], "", 0), (9, [1.0, float("nan"), 2.0], "", 0), (10, [1.0, float("inf")], "", 0), (11, [], "", 0), (12, [1.0, 2.0], "", 0),
            (13, [2.0, 4.0], "", 0), (None, [9.0, -9.0], "", 0), (14, [1e-30, 2e-30, 3e-30], "", 0), (15, [3e38, 3e38], "", 0)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, DDL)).collect())
    assert got == sorted([("5", 3, "3", False), ("3", 3, "3", True), ("None", 3, "3", False), ("14", 3, "3", False), ("4", 1, "4", True), ("4", 1, "4", True),
                          *[(str(i), 0, str(i), True) for i in (6, 7, 8, 9, 10, 11)], ("12", 1 + 0, "12", True), ("13", 1, "12", False),
                          ("None", 0, "None", True), ("15", 0, "15", True)])
    assert embeddings.near_duplicates(spark.createDataFrame([], DDL)).count() == 0


def test_vectors_of_several_lengths(spark):
    """Some hundred vectors of each length: their lists must not meet under one key."""
    rng = np.random.default_rng(3)
    rows = []
    for dim in (64, 128):
        for _ in range(150):
            v = rng.normal(size=dim)
            rows += [v, near(rng, v, 0.99)]
    rows = [(i, np.asarray(v, np.float32).tolist()) for i, v in enumerate(rows)]
    expected, total = plain(rows)
    frame = spark.createDataFrame([(i, v, "", 0) for i, v in rows], DDL)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame).collect()}
    assert total >= 600 and np.mean([got[i] == expected[i] for i in expected]) >= 0.97
    keys = [embeddings._mixed(int(embeddings._mixed(0, np.array([dim]))[0]), np.arange(embeddings.PIVOTS)) for dim in (2, 3, 64, 128, 384, 768)]
    assert len(np.unique(np.concatenate(keys))) == 6 * embeddings.PIVOTS


def _leaning(rng, n, dim, mean):
    """Vectors with this mean cosine to each other, and a partner just over the border for each."""
    unit = embeddings.unit
    v = unit(math.sqrt(mean) * unit(rng.normal(size=(1, dim))) + math.sqrt(1 - mean) * unit(rng.normal(size=(n, dim))))
    return v, unit(np.array([near(rng, x, rng.uniform(0.9505, 0.955)) for x in v]))


@pytest.mark.parametrize("mean", [0.0, 0.63, 0.83])
@pytest.mark.parametrize("dim", [64, 768])
def test_vectors_that_share_a_direction(mean, dim):
    """Few pairs become candidates, and hardly a true one is lost."""
    rng = np.random.default_rng(int(100 * mean) + dim)
    v, w = _leaning(rng, 3000, dim, mean)
    told = embeddings.Description(v[:2048].tolist(), dim, embeddings.PIVOTS, embeddings.NEAREST)
    size = len(told.points)
    a, b = (embeddings._bits(told.of(x).astype(np.int64), size) for x in (v, w))
    same = np.bitwise_count(a & b).sum(axis=1) >= embeddings.SHARED
    others = embeddings._common(a[:1000], a[1000:2000]) >= embeddings.SHARED
    assert same.mean() >= 0.98 and others.mean() < 0.01, (same.mean(), others.mean(), told.k)


@pytest.mark.parametrize("part", [0.34, 0.85, 1.0])
def test_dense_cluster_takes_part_in_the_centre(part):
    """The mean may lie in a cluster of pairs over the border: these must stay candidates."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=64)
    v = embeddings.unit(np.array([near(rng, centre, 0.976) if rng.random() < part else rng.normal(size=64) for _ in range(2000)]))
    told = embeddings.Description(v.tolist(), 64, embeddings.PIVOTS, embeddings.NEAREST)
    bits = embeddings._bits(told.of(v).astype(np.int64), len(told.points))
    found = embeddings._common(bits, bits) >= embeddings.SHARED
    linked = v @ v.T >= 0.95
    assert found[linked].mean() >= 0.98


def test_query_with_a_shared_direction(spark):
    rng = np.random.default_rng(3)
    v, w = _leaning(rng, 400, 64, 0.83)
    rows = [(i, np.asarray(x, np.float32).tolist(), "l", 1) for i, x in enumerate(np.concatenate([v, w]))]
    expected, _ = plain([(r[0], r[1]) for r in rows])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, DDL)).collect()}
    assert sum(got[i] == expected[i] for i in got) >= 0.96 * len(rows) and all(got[i][0] <= expected[i][0] for i in got)
