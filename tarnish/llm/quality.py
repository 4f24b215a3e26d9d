"""Quality rules, line first: judge lines, take failing lines out, then judge what is left.

Only built-in expressions run here; the text of a document never leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarnish.llm.common import fresh, let, words

WINDOW = 8
#: A document is rejected when its lines lose more than this percentage of the word characters.
MAX_LOST = 50
MIN_WORDS = 20
MAX_REPEATED = 30

# The line rules.  Patterns stay within the syntax that Java and RE2 share.
SYMBOLS = r"[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]"
#: Separators of menus and bread crumbs, three or more in a line.
MENU = r"([|»›•·>][\x20\x09-\x0D][^|»›•·>]*){3}"
#: A short line that is a link label.
LABEL = (r"(?i)^[\x20\x09-\x0D]*(home|menu|search|log ?in|sign (in|up)|register|subscribe|contact( us)?|about( us)?|next|"
         r"previous|back to top|read more|click here|share( this)?|skip to (main )?content|sitemap|newsletter)[\x20\x09-\x0D.!:»›>]*$")
BOILERPLATE = (r"(?i)(all rights reserved|copyright (©|\(c\)|[0-9]{4})|©[\x20]*[0-9]{4}|(we|site) uses? cookies|accept (all )?cookies|"
               r"cookie (policy|settings)|privacy policy|terms of (use|service)|enable javascript|lorem ipsum|"
               r"powered by|licensed under|permission is hereby granted)")
END = r"[.!?…。！？:;][\"'”’»)\]]*[\x20\x09-\x0D]*$"
PAUSE = r"[.,;:!?…，。；：！？]"
#: Longest run of words that may do without any punctuation.
BARE_WORDS = 30


def _characters(pieces: Column) -> Column:
    return F.length(F.array_join(pieces, ""))


def repeated_words(tokens: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the text.

    Windows are compared by 64-bit hashes.  Texts without a repeated window, nearly all, are
    done after one pass; the others sort their windows.
    """
    def windows(t: Column) -> Column:
        return F.when(F.size(t) >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - WINDOW + 1, F.lit(1))),
                                                       lambda i: F.xxhash64(F.slice(t, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: F.get(s, i - 1)["w"].eqNullSafe(x["w"]) | F.get(s, i + 1)["w"].eqNullSafe(x["w"]))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        sorted_windows = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return F.aggregate(let(sorted_windows, places), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                           lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
                           lambda acc: acc["n"])

    return let(let(tokens, windows), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))


def line_passes(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules; blank lines pass."""
    tokens = words(line)

    def judged(t: Column) -> Column:
        chars = _characters(t)
        marks = F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, ""))
        symbols_ok = marks * 10 <= chars * 3
        pauses_ok = (F.size(t) <= BARE_WORDS) | line.rlike(PAUSE)
        navigation = line.rlike(MENU) | line.rlike(LABEL)
        return (F.size(t) == 0) | (symbols_ok & pauses_ok & ~navigation & ~line.rlike(BOILERPLATE))

    return let(tokens, judged)


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    cleaned (the text without failing lines), lost_chars (word characters gone) and kept.

    A NULL text counts as one without words: it fails and ``cleaned`` is empty.  Columns of
    ``docs`` with one of these names are replaced.  Each row stands alone, so repeated rows and
    empty tables need nothing special.
    """
    body, tokens, lines, good = fresh(docs, "q_body", "q_tokens", "q_lines", "q_good")
    c = F.col
    out = docs.withColumn(body, F.coalesce(c(text), F.lit("")))
    out = out.withColumn(tokens, words(c(body))).withColumn(lines, F.split(c(body), "\n"))
    solid = F.filter(c(lines), lambda x: x.rlike(WORD))
    out = out.withColumns({
        "n_words": F.size(tokens).cast("long"),
        "word_chars": _characters(c(tokens)).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.regexp_replace(c(body), SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(solid, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long"),
        "n_repeat_words": repeated_words(c(tokens)).cast("long"),
        good: F.filter(c(lines), line_passes),
    })
    out = out.withColumn("base_failed", (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEATED * c("n_words")))
    out = out.withColumn("cleaned", F.array_join(good, "\n"))
    out = out.withColumn("lost_chars", c("word_chars") - F.length(F.regexp_replace(c("cleaned"), r"[\x20\x09-\x0D]+", "")))
    out = out.withColumn("kept", ~c("base_failed") & (100 * c("lost_chars") <= MAX_LOST * c("word_chars")))
    return out.drop(body, tokens, lines, good)


def keep_clean(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents that pass, without their failing lines; the columns of ``docs`` stay.

    ``n_chars`` is brought up to date where a line went.
    """
    extra = fresh(docs, "q_words", "q_clean", "q_keep")
    judged = judge(docs.select(F.struct("*").alias("row"), F.col(text).alias(extra[0])), extra[0])
    # an array of one row or none: a plain filter would be pushed down and the rules evaluated twice
    one = F.filter(F.array(F.struct("row", "cleaned", "lost_chars", "kept")), lambda r: r["kept"])
    kept = judged.select(one.alias("one")).select(F.explode_outer("one").alias("one")).where(F.col("one").isNotNull()).select("one.*")
    columns = []
    for name in docs.columns:
        old = F.col("row")[name]
        if name == text:
            old = F.when(F.col("lost_chars") > 0, F.col("cleaned")).otherwise(old)
        elif name == n_chars:
            old = F.when(F.col("lost_chars") > 0, F.length("cleaned").cast(docs.schema[name].dataType)).otherwise(old)
        columns.append(old.alias(name))
    return kept.select(*columns)
