import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tarnish.llm import lm, queries


def plain(rows, order, mass):
    """(doc_id, text) rows -> scores by counting dictionaries."""
    texts = []
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2
        texts.append((doc_id, held, [*re.findall(r"[^\x20\x09-\x0D]+", low), None]))
    counts, followed = Counter(), Counter()
    for _, held, tokens in texts:
        if not held:
            padded = ["<s>\n", *tokens]
            for i in range(1, len(padded)):
                for k in range(min(order - 1, i) + 1):
                    counts[tuple(padded[i - k:i + 1])] += 1
                    if k:
                        followed[tuple(padded[i - k:i])] += 1
    words = {g[0]: c for g, c in counts.items() if len(g) == 1}
    n, v = sum(words.values()), len(words)

    def p(gram):
        if len(gram) == 1:
            return (words.get(gram[0], 0) + 1) / (n + v + 1)
        return (counts[gram] + mass * p(gram[1:])) / (followed[gram[:-1]] + mass)

    out = []
    for doc_id, held, tokens in texts:
        padded = ["<s>\n", *tokens]
        score = sum(math.log10(p(tuple(padded[max(0, i - order + 1):i + 1]))) for i in range(1, len(padded)))
        base = sum(math.log10((words.get(t, 0) + 1) / (n + v + 1)) for t in tokens)
        out.append((doc_id, held, len(tokens), sum(t in words for t in tokens), n, base, score))
    return out


def compare(got, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, expected = sorted(map(tuple, got), key=key), sorted(expected, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in expected], rtol=1e-9)


def test_query_against_brute_force(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.op8_lm(spark, folder).collect()
    compare(got, plain(rows, 2, lm.MASS))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_small_blocks_and_shards(spark, order):
    rows = [(i, " ".join("abcdefg"[(i * j * j + j) % 7] for j in range(i % 13))) for i in range(80)]
    rows += [(None, "A b"), (None, None), (5, "Repeated row\x0b é\x85É"), (5, "Repeated row\x0b é\x85É"), (2, "w " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(lm.scores(docs, order=order, block_bytes=200, shard_grams=50).collect(), plain(rows, order, lm.MASS))


def test_probabilities_sum_to_one():
    """Every context's arcs and failures together hold probability one."""
    rows = [(i, t) for i, t in enumerate(["a b a c", "b b a", "c", "", "a a a b c b"])]
    block = lm.Block(lm._block_row(0, [r[0] for r in rows], [r[1].encode() for r in rows]).to_pylist()[0], 3)
    totals = [g["own"] for g in block.levels]
    n = int(totals[0].sum() - totals[0][0])
    v = int((totals[0] > 0).sum() - 1)
    machine = lm.Automaton(block.levels, totals, n, v, 2.0)

    def follow(state, token):
        weight = 0.0
        while (arc := machine.arcs.get(state * machine.size + token)) is None:
            more, state = machine.fail[state]
            weight += more
        return 10 ** (weight + arc[0])

    unknown = 1 / (n + v + 1)
    for state in range(len(machine.fail)):
        fallen, at = 1.0, state
        while at:
            weight, at = machine.fail[at]
            fallen *= 10 ** weight
        total = sum(follow(state, t) for t in range(1, machine.size) if totals[0][t] > 0) + unknown * fallen
        has_following = state == 0 or any(k // machine.size == state for k in machine.arcs)
        if has_following:
            assert abs(total - 1) < 1e-9


def test_empty(spark):
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string, score string")).count() == 0
