from catalog.compare import duck_rows, spark_rows
from tarnish.llm import preference, queries, sql

DDL = "pair_id long, turn int, role string, text string, chosen string"


def plain(c, r):
    clean = lambda t: (t or "").replace("<|", "< |")
    key = lambda t: tuple((x is not None, x or 0 if i == 0 else x or "") for i, x in enumerate(t))
    c, r = sorted(c, key=key), sorted(r, key=key)
    n = 0
    while n < min(len(c), len(r)) and c[n][1:] == r[n][1:]:
        n += 1

    def side(turns):
        out, spans = "", []
        for _, role, text in turns:
            out += f"<|{clean(role if role is not None else 'unknown')}|>\n"
            start = len(out)
            out += clean(text) + "<|end|>\n"
            if role == "assistant":
                spans.append((start, len(out)))
        return out, spans

    return n, side(c[:n])[0], side(c[n:]), side(r[n:])


CASES = {
    1: ([(0, "user", "hi"), (1, "assistant", "yes é😀")], [(0, "user", "hi"), (1, "assistant", "no <|end|>")]),
    2: ([(0, "user", "same"), (1, "assistant", "same")], [(0, "user", "same"), (1, "assistant", "same")]),
    3: ([(0, None, None), (1, "assistant", None)], [(0, None, None), (1, "assistant", "")]),
    4: ([(1, "assistant", "b"), (0, "user", "a"), (0, "user", "a"), (0, "system", "s")], [(0, "user", "z")]),
    5: ([(0, "user", "u"), (1, "assistant", "long " * 50000)] + [(i, "assistant", str(i)) for i in range(2, 700)], [(0, "user", "u")]),
    6: ([(None, "user", "x"), (0, "user", "y")], [(0, "user", "y")]),
}


def test_against_plain_python(spark):
    frames = [spark.createDataFrame([(k, *t, "x") for k, v in CASES.items() for t in v[side]] + [(None, 0, "user", "lost", "x")] + ([(9, 0, "user", "alone", "x")] if side else []), DDL)
              for side in (0, 1)]
    got = {r.pair_id: r for r in preference.pairs(*frames).collect()}
    assert set(got) == set(CASES)
    for k, (c, r) in CASES.items():
        n, prompt, (chosen, cs), (rejected, rs) = plain(c, r)
        row = got[k]
        assert (row.n_prompt_turns, row.prompt, row.chosen, row.rejected) == (n, prompt, chosen, rejected), k
        assert [tuple(s) for s in row.chosen_spans] == cs and [tuple(s) for s in row.rejected_spans] == rs
    assert preference.pairs(frames[0].limit(0), frames[1]).count() == 0


def test_matches_sql(spark, folder):
    rows = spark_rows(queries.op4_preference(spark, folder))
    assert rows == duck_rows(folder, sql.PREFERENCE) and len(rows[1]) > 10


def plain_diverted(talks):
    ids, out = sorted(talks), {}
    place = lambda t: -1 << 63 if t[0] is None else t[0]
    for i, k in enumerate(ids):
        at = min((place(t) for t in talks[k] if t[1] == "assistant"), default=None)
        out[k] = [t for t in talks[k] if at is None or place(t) < at]
        for other in ids[i + 1:i + 2] + ids[max(0, i - 1):i]:
            rest = [t for t in talks[other] if at is not None and place(t) >= at]
            if rest:
                out[k] += rest
                break
    return out


def test_every_conversation_has_a_row(spark):
    """Sparse ids, one without an assistant, one that begins with it, one longer than both neighbours, turns without a number."""
    talks = {k * k * 1_000_003 - (1 << 40): [(0, "user", f"u{k}"), *((t, "assistant" if t % 2 else "user", f"{k}:{t}") for t in range(1, 2 + k % 5))] for k in range(60)}
    ids = sorted(talks)
    talks[ids[7]] = [(0, "user", "alone"), (1, "user", "still")]
    talks[ids[20]] = [(90, "assistant", "late")]
    talks[ids[30]] = [(0, "assistant", "first"), (1, "user", "x")]
    talks[ids[40]] = [(None, "user", "early"), (None, "assistant", "unnumbered"), (3, "user", "z")]
    frame = spark.createDataFrame([(k, *t, "x") for k, v in talks.items() for t in v] + [(None, 0, "user", "lost", "x")], DDL).withColumnRenamed("pair_id", "conv_id").repartition(5)
    got = {r.conv_id: r for r in preference.pairs(frame, preference.diverted_all(frame), "conv_id", whole=True).collect()}
    assert set(got) == set(talks)
    for k, rejected in plain_diverted(talks).items():
        n, prompt, (chosen, cs), (other, rs) = plain(talks[k], rejected)
        row = got[k]
        assert (row.n_prompt_turns, row.prompt, row.chosen, row.rejected) == (n, prompt, chosen, other), k
        assert [tuple(s) for s in row.chosen_spans] == cs and [tuple(s) for s in row.rejected_spans] == rs
    assert got[ids[20]].rejected == "" and got[ids[7]].chosen == "" and got[ids[30]].rejected != ""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges, however small
    try:
        spread = preference.neighbours(frame, "conv_id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.conv_id: (r.before, r.after) for r in spread} == dict(zip(ids, zip([None, *ids[:-1]], [*ids[1:], None], strict=True), strict=True))


def test_query_keeps_all_conversations(spark, folder):
    talks = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        talks.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = {r.conv_id: (r.prompt, r.chosen, r.rejected) for r in queries.op4_preference_all(spark, folder).collect()}
    want = {k: plain(talks[k], v) for k, v in plain_diverted(talks).items()}
    assert got == {k: (prompt, chosen, rejected) for k, (_, prompt, (chosen, _), (rejected, _)) in want.items()}


def test_extra_columns_may_clash_and_turns_may_lack_a_number(spark):
    rows = [(1, 0, "user", "q", 5, "c"), (1, 1, "assistant", "a", 5, "c"), (2, 0, "user", "r", 5, "c"), (2, 1, "assistant", "b", 5, "c"), (2, None, "user", "x", 5, "c"),
            (None, 1, "assistant", "n", 5, "c")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, at int, place string")
    plain = sorted(map(tuple, preference.diverted(turns.drop("at", "place")).collect()))
    assert sorted(map(tuple, preference.diverted(turns).collect())) == plain == [(1, 0, "user", "q"), (1, 1, "assistant", "b")]
    assert preference.pairs(turns, preference.diverted(turns), "conv_id").count() == 1
    assert preference.pairs(turns, preference.diverted_all(turns), "conv_id", whole=True).count() == 2
    assert preference.diverted(turns.limit(0)).count() == 0
