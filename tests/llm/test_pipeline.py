"""The chain of stages against plain versions of each, one after the other."""

import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tarnish.llm import packing, quality, queries, secrets, sql
from tests.llm.test_packing import check
from tests.llm.test_secrets import plain_base
from tests.llm.test_simhash import plain_components, plain_print

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def line_passes(line):
    words = [w for w in SPACE.split(line) if w]
    chars, marks = sum(map(len, words)), len(re.findall(quality.SYMBOLS, line))
    found = lambda pattern: re.search(pattern, line) is not None
    bad = marks * 10 > chars * 3 or (len(words) > quality.BARE_WORDS and not found(quality.PAUSE)) or any(
        map(found, (quality.MENU, quality.LABEL, quality.BOILERPLATE)))
    return not words or not bad


def cleaned(text):
    lines = text.split("\n")
    return text if all(map(line_passes, lines)) else "\n".join(line for line in lines if line_passes(line))


def masked(text):
    out, at = [], 0
    for _, start, stop in plain_base(text):
        if start >= at:
            out.append(text[at:start] + secrets.MASK)
        at = max(at, stop)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def corpus(spark, folder, tmp_path_factory):
    """The documents with rows at the edges: NULL, empty, repeated, a hot text, a long one."""
    base = spark.read.parquet(f"{folder}/documents.parquet")
    plain = "A sentence that stands for many others, with words enough to pass all of the rules here. It goes on for a while, and then it ends."
    rows = [(9001, None), (9002, ""), (9003, " \n\t "), *[(9100 + i, plain) for i in range(60)], (9300, plain), (9300, plain),
            (9400, "\n".join(f"Number {i} is told apart from number {i * i}, as all numbers of this list are." for i in range(3000))),
            (9500, plain.replace("many", "all") + '\nThe password = "hunter2hunter2" was told to all of them, which is a pity for those who keep it secret.')]
    more = spark.createDataFrame([(i, t, "en", "made", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    place = tmp_path_factory.mktemp("corpus")
    base.unionByName(more.select(*base.columns)).repartition(4).write.parquet(f"file://{place}/documents.parquet")
    return str(place)


def test_stages_against_plain_versions(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    names, judged = _judged(corpus)
    keeps = {int(r[names.index("doc_id")]) for r in judged if r[names.index("kept")] == "True"}
    expected = sorted((i, cleaned(t)) for i, t in given if i in keeps)

    first = corpus_pipeline.quality_rules(spark, docs, corpus)
    assert first.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in first.collect()) == expected

    distinct = sorted(set(expected))
    roots = plain_components([plain_print(t) for _, t in distinct])
    expected = [distinct[k] for k in sorted(set(roots))]
    second = corpus_pipeline.near_duplicates(spark, first, corpus)
    assert second.columns == docs.columns and sorted((r.doc_id, r.text) for r in second.collect()) == expected
    assert sum(9100 <= i <= 9300 for i, _ in expected) == 1

    third = corpus_pipeline.secret_scans(spark, second, corpus)
    assert third.columns == docs.columns
    found = {r.doc_id: r for r in third.collect()}
    random = {r.doc_id for r in secrets.scan(second).collect() if any(s.kind == 3 for s in r.spans)}
    assert sorted(found) == [i for i, _ in expected] and len(random) < len(found) / 10
    for i, text in expected:
        assert i in random or (found[i].text, found[i].n_chars) == (masked(text), len(masked(text)) if plain_base(text) else found[i].n_chars)
    assert secrets.MASK in found[9500].text and "hunter2" not in found[9500].text

    pieces = [r.asDict() for r in corpus_pipeline.run(spark, corpus).collect()]
    library, by = Tokenizer.from_file(queries.TOKENIZER), defaultdict(list)
    for r in pieces:
        by[r["doc_id"]].append((r["start"], bytes(r["ids"])))
    assert sorted(by) == sorted(found)
    for i, parts in by.items():
        ids = [*library.encode(found[i].text, add_special_tokens=False).ids, queries.END]
        assert b"".join(data for _, data in sorted(parts)) == np.array(ids, "<u4").tobytes()
    assert check(pieces, packing.Limits()) == 0


def _judged(corpus):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{corpus}/documents.parquet/*.parquet')")
    out = con.execute(sql.QUALITY)
    return [d[0] for d in out.description], [tuple(map(str, r)) for r in out.fetchall()]


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
