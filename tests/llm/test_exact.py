from collections import defaultdict

from catalog.compare import duck_rows, spark_rows
from tarnish.llm import exact, queries, sql

DDL = "doc_id long, text string, kept string, X_full int, group_size int"
GONE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[(text or "").translate(GONE)].append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for members in groups.values():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        out += [(m[2], best[2], len(members)) for m in members]
    return sorted(out, key=str), len(groups)


def test_edge_rows(spark):
    long = "wort " * 300_000
    rows = [(5, "a b"), (3, "ab"), (4, " a\tb\n"), (9, None), (8, ""), (7, " \x0b\x0c\r "), (1, "a b"), (2, "a b"), (6, long), (10, long + "\n"),
            (11, long + "x"), (12, "same"), (12, "same"), (None, "same"), (None, None), (13, "😀 é"), (14, "😀é "), (15, "prefix " * 40 + "1"), (16, "prefix " * 40 + "2")]
    docs = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], DDL).repartition(3)
    got = exact.mark(docs, carry=["kept", "X_full"]).collect()
    expected, groups = brute(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=str) == expected
    assert sum(r.kept for r in got) == groups
    by = {r.doc_id: r for r in got}
    assert by[4].kept and not by[3].kept and by[3].keep_id == 4 and by[10].kept and by[6].keep_id == 10 and by[7].kept
    stay = exact.keep_one(docs)
    assert stay.columns == docs.columns and stay.count() == groups


def test_a_full_bit_map_loses_nothing(spark):
    rows = [(i, f"text number {i % 700} " + "y" * (i % 3)) for i in range(2100)] + [(i, "hot") for i in range(2100, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact.mark(docs, most_slots=64).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=str) == brute(rows)[0]


def test_only_survivors_are_hashed_whole(spark):
    docs = spark.createDataFrame([(i, "z" * i) for i in range(1, 400)] + [(900, "z" * 7)], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact.mark(docs).where("group_size > 1").collect()) == [7, 900]


def test_no_shuffle_moves_a_text(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = exact.mark(docs)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.replace("text_sha", "")


def test_empty_table(spark):
    assert exact.mark(spark.createDataFrame([], DDL)).count() == 0
    assert exact.keep_one(spark.createDataFrame([], DDL)).count() == 0


def test_query_matches_sql(spark, folder):
    assert spark_rows(queries.op13_exact(spark, folder)) == duck_rows(folder, sql.EXACT)
