import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tarnish.llm import packing, queries


def check(rows, limits):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    padding = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["segment"] for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(r["n_loss"] for r in pieces) <= limits.loss
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 64), packing.Limits(128, 8, 40), packing.Limits(16, 1, 5), packing.Limits(1, 1, 1)])
def test_packer_keeps_all_limits(limits):
    rng = random.Random(2)
    packer = packing.Packer(limits, 0)
    docs = {}
    for i in range(1200):
        n = rng.choice([1, 2, 3, 7, 20, 64, 300, 2048, 3000]) if limits.tokens > 16 else rng.randint(1, 40)
        docs[i] = np.array([rng.randint(2, 50000) for _ in range(n)], "<u4").tobytes()
        packer.add(i, docs[i], rng.choice([None, 0, 1, 5, n, n + 4]))
    packer.finish()
    rows = packer.batch().to_pylist()
    assert check(rows, limits) == 0
    parts = defaultdict(dict)
    for r in rows:
        assert parts[r["doc_id"]].setdefault(r["start"], r["ids"]) is r["ids"]
    for i, ids in docs.items():
        assert b"".join(parts[i][s] for s in sorted(parts[i])) == ids
        assert sorted(parts[i]) == [sum(len(parts[i][s]) // 4 for s in parts[i] if s < t) for t in sorted(parts[i])]


def test_ids_are_the_library_s(spark, folder):
    library = Tokenizer.from_file(queries.TOKENIZER)
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    texts += ["", "  a\n\n b", "x<|endoftext|>y", "\x1c\x85  z", "é" * 50, "1234 'll  I'll\t\t", "日本語 ٠١٢", "a" * 3000, " " * 5000 + "b"]
    tokens = packing.Tokens(queries.TOKENIZER, 1)
    for t, ids in zip(texts, tokens.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids + [1]


def test_query(spark, folder):
    library = Tokenizer.from_file(queries.TOKENIZER)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [r.asDict() for r in queries.op7_packing(spark, folder).collect()]
    assert check(rows, packing.Limits()) == 0
    total = defaultdict(int)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
        assert len(part) == 4 * r["length"] and zlib.crc32(part) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
        total[r["doc_id"]] += r["length"]
    assert total == {r["doc_id"]: r["doc_tokens"] for r in rows} and set(total) == set(texts)


def test_edge_rows(spark):
    rows = [(1, None, 5), (1, "", 6), (None, "some text", 7), (2, "some text", 8), (2, "some text", 8), (3, "word " * 60000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int")
    out = [r.asDict() for r in packing.pack(docs, queries.TOKENIZER, 1, packing.Limits(2048, 2, 2048)).collect()]
    assert check(out, packing.Limits(2048, 2, 2048)) == 0
    assert sum(r["length"] for r in out if r["doc_id"] == 1) == 2
    assert sum(r["length"] for r in out if r["doc_id"] == 2) == 2 * sum(r["length"] for r in out if r["doc_id"] is None)
    assert packing.pack(docs.limit(0), queries.TOKENIZER, 1).count() == 0
