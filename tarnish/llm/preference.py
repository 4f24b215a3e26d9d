"""Preference pairs: a common prompt, and two completions with masks.

The turns that a chosen and a rejected conversation share at their beginning are the prompt,
rendered once; what follows on either side is rendered as a completion, with the spans that
bear loss: the assistant's words and their end marks.  Only built-in expressions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnish.llm.common import let, sums_before
from tarnish.session import cut_lineage

# The template.  Its marks are broken up where a text holds them.
HEAD, MIDDLE, TAIL = "<|", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"
TURN = "struct<turn:bigint,role:string,text:string>"


def _clean(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(HEAD), _clean(F.coalesce(t["role"], F.lit("unknown"))), F.lit(MIDDLE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _clean(t["text"]), F.lit(TAIL))), "")


def loss_spans(turns: Column) -> Column:
    """(start, stop) in code points of the rendered turns, end exclusive; the assistant's only."""
    def spans(lengths: Column) -> Column:
        return let(sums_before(F.transform(lengths, lambda x: x["head"] + x["body"])), lambda base: F.filter(
            F.transform(lengths, lambda x, i: F.struct((F.get(base, i) + x["head"]).alias("start"), (F.get(base, i) + x["head"] + x["body"]).alias("stop"))),
            lambda s, i: F.get(turns, i)["role"] == ASSISTANT))

    sizes = F.transform(turns, lambda t: F.struct(F.length(_head(t)).alias("head"), (F.length(_clean(t["text"])) + len(TAIL)).alias("body")))
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    return F.when(F.size(turns) > 0, let(sizes, spans)).otherwise(empty)


def shared_turns(a: Column, b: Column) -> Column:
    """How many turns at the beginning agree in role and text (NULL agrees with NULL)."""
    same = F.zip_with(a, b, lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    return let(same, lambda s: F.coalesce(F.nullif(F.array_position(s, F.lit(False)), F.lit(0)) - 1, F.size(s)).cast("int"))


def conversations(turns: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the turns of each conversation in order; rows without a key belong to none."""
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return turns.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(key)).agg(F.array_sort(F.collect_list(row)).alias(name))


def pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id", whole: bool = False) -> DataFrame:
    """A row per pair: prompt, chosen, rejected, the loss spans of both and the number of prompt turns.

    Both tables hold (key, turn, role, text), a row per turn; a pair needs turns on both sides, or
    if ``whole`` on the chosen one: a rejected side without turns is empty.
    Turns are ordered by number, then role and text, so ties and repeated rows have one order and
    all stay.  A NULL text is empty, a NULL role is "unknown", rows with a NULL key are left out.
    Equal conversations have empty completions.  A conversation becomes one row, so it must fit a
    task, as its text must.
    """
    both = conversations(chosen, key, "c").join(conversations(rejected, key, "r"), key, "left" if whole else "inner")
    both = both.withColumn("r", F.coalesce("r", F.array().cast(f"array<{TURN}>")))
    both = both.withColumn("n_prompt_turns", shared_turns(F.col("c"), F.col("r")))
    rest = lambda side: F.slice(side, F.col("n_prompt_turns") + 1, F.greatest(F.size(side), F.lit(1)))
    both = both.withColumn("p", F.slice("c", 1, F.col("n_prompt_turns"))).withColumn("c", rest("c")).withColumn("r", rest("r"))
    return both.select(key, "n_prompt_turns", rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"),
                       loss_spans(F.col("c")).alias("chosen_spans"), loss_spans(F.col("r")).alias("rejected_spans"))


def diverted(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rejected conversations for a table without any: each goes on, from its first assistant turn,
    with the turns of the conversation with the id one larger.  One without an assistant turn, or
    without such a one that goes on, has none; ``diverted_all`` leaves none out.  A turn without a
    number, as one without a key, is left out; other columns may have any names."""
    turns = turns.select(key, "turn", "role", "text")
    at = turns.where((F.col("role") == ASSISTANT) & F.col(key).isNotNull()).groupBy(key).agg(F.min("turn").alias("at"))
    begin = turns.join(at, key).where(F.col("turn") < F.col("at")).select(key, "turn", "role", "text")
    after = turns.withColumn(key, F.col(key) - 1).join(at, key).where(F.col("turn") >= F.col("at")).select(key, "turn", "role", "text")
    goes_on = after.select(key).distinct()
    return begin.join(goes_on, key, "left_semi").unionByName(after)


def neighbours(ids: DataFrame, key: str) -> DataFrame:
    """(key, before, after): the next smaller and larger id of the table, NULL at its ends.

    Ids are cut into ranges and meet their neighbours there; of each range only the two ends,
    one row a range, are gathered.
    """
    cut = cut_lineage(ids.where(F.col(key).isNotNull()).select(key).distinct().repartitionByRange(F.col(key)).withColumn("range", F.spark_partition_id()))
    ends = sorted(cut.groupBy("range").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect())
    inside = Window.partitionBy("range").orderBy(key)
    before, after = F.lag(key).over(inside), F.lead(key).over(inside)
    if len(ends) > 1:
        told = lambda found: F.element_at(F.create_map(*[F.lit(x) for pair in found for x in pair]), F.col("range"))
        before = F.coalesce(before, told([(b["range"], a["high"]) for a, b in zip(ends, ends[1:])]))
        after = F.coalesce(after, told([(a["range"], b["low"]) for a, b in zip(ends, ends[1:])]))
    return cut.select(key, before.alias("before"), after.alias("after"))


def diverted_all(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rejected conversations for all conversations of a table, whatever their ids: each goes on, from
    its first assistant turn, with the turns of that with the next larger id in the table, or
    if that ends before, of that with the next smaller one.  Where neither goes on, or no assistant
    speaks, it just stops; a conversation that would begin there has no row here.  A turn without
    a number comes before all others."""
    place = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63)))
    own = turns.where(F.col(key).isNotNull()).select(key, "turn", "role", "text", place.alias("place"))
    per = own.groupBy(key).agg(F.min(F.when(F.col("role") == ASSISTANT, F.col("place"))).alias("at"), F.max("place").alias("end"))
    ends = lambda side: per.select(F.col(key).alias(side), F.col("end").alias(f"{side}_end"))
    told = per.select(key, "at").join(neighbours(per, key), key).join(ends("after"), "after", "left").join(ends("before"), "before", "left")
    goes_on = lambda side: F.col(f"{side}_end") >= F.col("at")
    plan = cut_lineage(told.select(key, "at", F.when(goes_on("after"), F.col("after")).when(goes_on("before"), F.col("before")).alias("other")))
    begin = own.join(plan, key).where(F.col("at").isNull() | (F.col("place") < F.col("at"))).select(key, "turn", "role", "text")
    rest = own.withColumnRenamed(key, "other").join(plan.where("other is not null"), "other").where(F.col("place") >= F.col("at"))
    return begin.unionByName(rest.select(key, "turn", "role", "text"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
