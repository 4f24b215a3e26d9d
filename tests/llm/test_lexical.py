import math
import re
from collections import Counter

import numpy as np
import pytest

from catalog.compare import duck_rows, spark_rows
from tarnish.llm import lexical, queries, sql

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k=10):
    tallies = [(d, Counter(terms(t))) for d, t, *_ in docs]
    tallies = [x for x in tallies if x[1]]
    n, total = len(tallies), sum(sum(c.values()) for _, c in tallies)
    df = Counter(t for _, c in tallies for t in c)
    out = []
    for item, text, *_ in items:
        scored = []
        for d, c in tallies:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)))
            scored.append((-s, d is None, d or 0, d, s))
        out += [(item, r + 1, x[3], x[4]) for r, x in enumerate(sorted(x for x in scored if x[4] > 0)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string, score string, docs int").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string, rank string")
    return sorted(map(tuple, lexical.search(lexical.build(d), q, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


DOCS = [(1, "Alpha beta gamma"), (2, "alpha ALPHA alpha beta"), (3, None), (4, ""), (5, "... !!"), (6, "École été, ÉCOLE"), (7, "écolE"), (8, "a\x7fb a`b a{b"),
        (9, "long " * 60_000 + "needle"), (10, "needle"), (None, "needle"), (10, "needle"), (12, "naïve word 日本語 x1"), (13, " ".join(f"w{i}" for i in range(9000))),
        (14, "w1 w1 w2"), (15, "needle needle")]
ITEMS = [(1, "alpha beta"), (2, "NEEDLE"), (3, None), (4, "?!"), (5, "unseen words"), (6, "École"), (2, "w1 w2 w8999 alpha"), (None, "a b x1 日本語"), (8, "naïve word long")]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_edge_rows_equal_brute_force(spark, k):
    docs, items = [(*r, "s", 0) for r in DOCS], [(*r, "r") for r in ITEMS]
    assert found(spark, docs, items, k) == brute(docs, items, k)


def test_ties_and_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TERMS", 7)
    monkeypatch.setattr(lexical, "ITEMS", 2)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 4)
    docs = [(i, f"t{i % 5} t{i % 7} " + "common " * (i % 3 + 1), "", 0) for i in range(300, 0, -1)]
    items = [(i, f"t{i % 5} t{i} common t{i + 1}", "") for i in range(9)]
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a", "")]) == [] and found(spark, [(1, "a", "", 0)], []) == []


def test_bounds_hold_and_exclude(monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"v{i}".encode() for i in range(3000)]
    block = lexical._Block(lexical._bits_for(120))
    for d in range(400):
        picks = [words[i] for i in np.minimum(rng.zipf(1.3, 90) - 1, 2999)]
        tally = Counter(picks)
        block.ids.append(d)
        block.lengths.append(len(picks))
        block.terms.append(lexical._hashed(list(tally)))
        block.counts.append(np.fromiter(tally.values(), np.int32, len(tally)))
    row = block.row()
    wanted = np.unique(lexical._hashed([words[i] for i in range(0, 3000, 40)]))
    weights = rng.integers(1, 5000, len(wanted))
    matrix = weights[None, :].astype(np.float32)
    norm = np.full(400, 100)
    tops = np.frombuffer(row["tops"], np.int64)
    bounds = lexical._bounds(row, wanted, matrix, lexical.saturated(np.int64(1), norm), lexical.saturated(tops, norm))[0] * 1.0001
    exact = lexical.saturated(lexical._occurrences(row, np.arange(400), wanted).astype(np.int64), norm[:, None]) @ weights
    assert (bounds >= exact).all()
    assert (bounds < np.sort(exact)[-10]).mean() > 0.5


def test_query_matches_sql(spark, folder):
    assert spark_rows(queries.op11_lexical(spark, folder)) == duck_rows(folder, sql.LEXICAL)
