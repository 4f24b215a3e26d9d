import random

import numpy as np
import pytest
import xxhash

from tarnish.llm import simhash
from tarnish.llm.components import components

DDL = "doc_id long, text string, root string, FP int"


def plain_print(text):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i:i + 4]) for i in range(max(1, len(tokens) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    label = list(range(len(prints)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


def test_every_four_positions_escape_some_table():
    rng = random.Random(1)
    tables = simhash.masks()
    assert len(tables) == 31
    for _ in range(5000):
        flips = sum(1 << i for i in rng.sample(range(64), 4))
        assert any(m & flips == 0 for m in tables)


@pytest.mark.parametrize("text", ["", None, "One", "a b c", "A b c d e", "x " * 300000, "é\x85ü É ü z", "\t\n"])
def test_fingerprint(text):
    if text and len(text) > 1000:
        assert simhash.fingerprint(text) == plain_print(text[:2000])  # every shingle is the same
    else:
        assert simhash.fingerprint(text) == plain_print(text)


def test_matches_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [plain_print(r.text) for r in rows]
    roots = plain_components(prints)
    expected = {r.doc_id: (f"{p:016x}", rows[k].doc_id) for r, p, k in zip(rows, prints, roots)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == expected
    assert len({x[1] for x in got.values()}) < len(got)


@pytest.mark.parametrize("limit", [4096, 64])
def test_dense_bucket_is_refined_without_loss(spark, limit):
    """A long chain and a dense cloud of fingerprints, with buckets far over the limit."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(400):
        prints.add(centre ^ sum(1 << i for i in rng.sample(range(20), rng.randint(1, 6))))
    far = centre ^ (2**64 - 1)
    for k in range(40):
        prints.add(far)
        far ^= sum(1 << i for i in rng.sample(range(40, 64), 4))
    prints = sorted(simhash._signed(p) for p in prints)
    unsigned = [p % 2**64 for p in prints]
    roots = plain_components(unsigned)
    links = simhash.close_links(spark.createDataFrame([(p,) for p in prints], "fp long"), bucket=limit)
    got = {r.node: r.root for r in components(links).collect()}
    assert {p: got.get(p, p) for p in prints} == {p: prints[k] for p, k in zip(prints, roots)}


def test_edge_rows(spark):
    rows = [(1, "a b c d e f", "x", 1), (None, "a b c d e f", None, 2), (3, None, "y", 3), (2, "  ", None, None),
            (3, "other words that stand alone here", "z", 4), (3, "other words that stand alone here", "z", 4), (None, "only one without any id", "q", 5)]
    docs = spark.createDataFrame(rows, DDL)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([("1", "1"), ("None", "1"), ("3", "2"), ("2", "2"), ("3", "3"), ("3", "3"), ("None", "None")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted(
        [("1", "a b c d e f"), ("2", "  "), ("3", "other words that stand alone here"), ("None", "only one without any id")])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_components_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (7, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_of_one_batch_border():
    key = np.array([1, 1, 2, 3, 3, 3])
    fp = np.array([0, 31, 5, 8, 9, 2**40], dtype=np.uint64)
    a, b = simhash._close_pairs(key, fp)
    assert sorted(zip(a.tolist(), b.tolist())) == [(9, 8)] + [(2**40, 8)]
