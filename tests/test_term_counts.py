"""Counts of the terms of documents, most of them made where the document lies."""

from collections import Counter, defaultdict

import pytest

from tarnish.operators.features import term_counts

COLUMNS = ["terms", "distinct_terms", "commonest", "letters", "first_term", "last_term"]
ALONE = [(1, ["b", "a", "b", "\U0001d11e", "\uffee"]), (2, []), (3, ["zz"]), (4, ["", "x", ""])]
SHARED = [(5, ["a", "b"]), (5, ["b", "c"]), (6, []), (6, []), (None, ["q"]), (None, ["q", "r"])]


def brute(rows):
    by = defaultdict(Counter)
    for key, terms in rows:
        by[key].update(terms)
    return {k: (sum(c.values()), len(c), max(c.values()), sum(n * len(t) for t, n in c.items()),
                min(c, key=str.encode), max(c, key=str.encode)) for k, c in by.items() if c}


@pytest.mark.parametrize("rows", [ALONE, SHARED, ALONE + SHARED, [(None, ["w", "w"])]])
def test_equals_counting(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, words array<string>").repartition(4)
    got = [(r.id, tuple(r[c] for c in COLUMNS)) for r in term_counts(df, "id", "words").collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute(rows)


def test_terms_of_a_document_are_not_shuffled(spark):
    df = spark.createDataFrame(ALONE, "id bigint, words array<string>").repartition(4)
    plan = term_counts(df.where("id > 0"), "id", "words")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan  # the one that dealt the rows


def test_text_features_shuffles_ids_only(spark, tmp_path):
    from catalog import load_all

    rows = [(i, f"word{i} other word{i}") for i in range(50)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = load_all()["text_features"].run(spark, str(tmp_path))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r.terms, r.distinct_terms, r.commonest) for r in made.collect()} == {(6, 5, 2)}
