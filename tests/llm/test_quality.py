import re

from catalog.compare import duck_rows, spark_rows
from tarnish.llm import quality, queries, sql

DDL = "doc_id long, text string, n_chars long, kept string, Q_BODY int"


def plain(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(ws[i:i + 8]) for i in range(len(ws) - 7)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    n = len(ws)
    return (n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked),
            n < 20 or 100 * len(marked) > 30 * n)


CASES = [None, "", "one", "a b c d e f g h a b c d e f g h", "x " * 40, "line one\nline one\n \n\t\nline one ", "é\x85ü 😀 | # *\n\x0b",
         " ".join(str(i % 9) for i in range(60)), " ".join(map(str, range(30))) + " 0 1 2 3 4 5 6 7 8 " + "z 0 1 2 3 4 5 6 7",
         "Home\nNext\nA real sentence that has more than ten words and ends with a stop, as it should here today.\nAll rights reserved."]


def test_base_columns_against_brute_force(spark):
    rows = [(i, t, None, "x", 1) for i, t in enumerate(CASES)] + [(None, CASES[3], 3, None, None)] * 2
    got = quality.judge(spark.createDataFrame(rows, DDL)).collect()
    assert len(got) == len(rows)
    by_text = {r.text: r for r in got}
    for t in CASES:
        r = by_text[t]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), t
        assert not (r.base_failed and r.kept)


def test_line_rules(spark):
    good = "This is a sentence with quite a few words in it, and so it stays where it is in the text."
    bad = ["home | news | sport | weather | more", "Read more", "Copyright 2020 Some Company", "word " * 31, "a### b$$$ c%%%"]
    text = "\n".join([good, "", *bad, good + " Again."])
    rows = [(1, text, len(text), "a", 0), (2, "\n".join(bad * 4), 0, "b", 0), (3, good + "\n" + good.upper(), 5, None, None)]
    docs = spark.createDataFrame(rows, DDL)
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert got[1].cleaned == "\n".join([good, "", good + " Again."])
    assert got[1].lost_chars == sum(len(b.replace(" ", "")) for b in bad)
    assert not got[2].kept and got[3].kept and got[3].lost_chars == 0
    kept = quality.keep_clean(docs)
    assert kept.columns == docs.columns
    out = {r.doc_id: r for r in kept.collect()}
    assert out[3] == docs.where("doc_id = 3").first()
    if 1 in out:
        assert out[1].n_chars == len(out[1].text)
    assert quality.judge(docs.limit(0)).count() == 0 and quality.keep_clean(docs.limit(0)).count() == 0


def test_long_text(spark):
    text = ("Some words go here, and others follow them. " * 8 + "\n") * 2000
    r = quality.judge(spark.createDataFrame([(1, text, 0, "", 0)], DDL)).first()
    assert r.n_words == 16000 * 8 and r.n_repeat_words == r.n_words and r.base_failed


def test_matches_sql(spark, folder):
    assert spark_rows(queries.op9_quality(spark, folder)) == duck_rows(folder, sql.QUALITY)


def test_rules_are_evaluated_once(spark):
    docs = spark.createDataFrame([(1, "x", 1)], "doc_id long, text string, n_chars long")
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count(quality.BOILERPLATE[:12])
    assert count(quality.keep_clean(docs)) == count(quality.judge(docs)) > 0
