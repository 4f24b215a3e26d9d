"""Secrets in texts: three fixed kinds, and strings that pass a battery of randomness tests.

A candidate is a long run of encoding characters with letters and digits.  Its encoding is
inferred as the smallest alphabet that holds it.  A run with both '+' or '/' and '-' or '_' is in
none; its parts between the former, and those between the latter, are candidates in its place.  Under the hypothesis that its symbols are
independent and uniform over that alphabet, three p-values are computed: chi-squared of the
symbol counts, runs above and below the middle of the alphabet, serial correlation of neighbours.
Three times the least is the candidate's p-value.

How small a p-value must be to say "not random" depends on the length: within each encoding and
class of lengths, a step-up rule over the p-values of the whole corpus keeps the expected share of
truly random strings among these at ``RATE``.

Not being rejected is no evidence, least of all for short strings.  The share of false reports is
bounded by a second rule, against the hypothesis that a candidate is an ordinary identifier.  Its
model draws classes of characters (lower, upper, digit, mark) from fixed chances of change and
letters from the pairs in the corpus's own words.  The probability of the string under uniformity
over that under the model averages at most 1 for identifiers (an e-value); it is zero for
candidates that the battery rejects.  Within each encoding and class of lengths the k largest are
reported, for the largest k for which all of them are at least m / (k ``RATE``), out of m.  The
expected share of identifiers that follow the model among the reports is then at most ``RATE``,
whatever depends on what.  Only built-in expressions run here.
"""

from __future__ import annotations

from math import inf, log2

from pyspark.sql import Column, DataFrame, functions as F

from tarnish.llm.common import fresh, let, sums_before

#: Share of random strings among the rejected candidates, and of identifiers among the reported.
RATE = 0.05
#: Odds of an identifier above this power of two count as this.
BITS = 64
MASK = "[SECRET]"
#: p-values are binned by quarter powers of two, down to 2^-64.
BINS = 256

# The kinds in the order of ties, and the candidate pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Parts of a run that no alphabet holds whole: as in base64url, and as in base64.
PARTS = (r"[A-Za-z0-9_-]{20,}", r"[A-Za-z0-9+/]{20,}")
KINDS = ("assign", "access", "hex", "random")
#: Alphabets by name, the smallest that fits counts; with the shortest candidate that has enough symbols to judge.
ALPHABETS = {
    "hex": ("0123456789abcdef", 24),
    "hex_upper": ("0123456789ABCDEF", 24),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 24),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", 24),
    "base36_upper": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 24),
    "base62": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 20),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 20),
    "base64url": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 20),
}
#: The characters of candidates by class (lower, upper, digit, mark), and an identifier's chances of the next class.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/-_")
CHANGES = ((0.78, 0.10, 0.06, 0.06), (0.50, 0.35, 0.08, 0.07), (0.10, 0.10, 0.70, 0.10), (0.45, 0.25, 0.25, 0.05))
SYMBOLS = "".join(CLASSES)
#: Words as identifiers are made of: longer runs are cut.  Rarer ones may be pieces of secrets.
WORD = r"[A-Z]{3,16}|[A-Z]?[a-z]{2,15}"
LEAST_COUNT = 2
#: Weight of equal chances in the letter pairs: as so many pairs, and as a share.
PRIOR, MIXED = 20.0, 0.1
#: Upper ends of the length classes.
LENGTHS = (27, 35, 47, 71, 127)

SPAN = "struct<start:int,kind:int,stop:int>"


def matches(text: Column, pattern: str) -> Column:
    """(start, stop, found) of the leftmost non-overlapping matches, in code points, end exclusive.

    Built-in functions give the matched strings and the pieces between them; their lengths, summed
    up, are the positions.
    """
    def placed(found: Column, gaps: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        return let(sums_before(lengths), lambda base: F.transform(found, lambda m, i: let(
            F.get(base, i) + F.length(F.get(gaps, i)), lambda at: F.struct(at.alias("start"), (at + F.length(m)).alias("stop"), m.alias("found")))))

    empty = F.array().cast("array<struct<start:int,stop:int,found:string>>")
    full = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda found: let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps)))
    return F.when(text.rlike(pattern), full).otherwise(empty)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["stop"].alias("stop")))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds, by start and then kind; an assignment needs a value of six characters."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.when(text.rlike(ASSIGN), let(values, lambda v: F.filter(
        matches(text, ASSIGN), lambda m, i: F.length(F.get(v, i)) >= 6))).otherwise(
        F.array().cast("array<struct<start:int,stop:int,found:string>>"))
    return F.array_sort(F.concat(_spans(assign, 0), _spans(matches(text, ACCESS), 1), _spans(matches(text, HEX), 2)).cast(f"array<{SPAN}>"))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, to 1e-7 (a rational approximation for z >= 0)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def p_value(values: Column, size: Column) -> Column:
    """The least of the three tests' p-values, times three; ``values`` are symbol numbers below ``size``."""
    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)

    def first(v: Column) -> Column:
        high = lambda x: 2 * x >= size
        counts = F.transform(F.array_distinct(v), lambda s: F.size(F.filter(v, lambda x: x == s)).cast("double"))
        return F.struct(
            F.size(v).cast("double").alias("n"), (total(v) / F.size(v)).alias("mean"),
            total(F.transform(counts, lambda c: c * c)).alias("squares"), F.size(F.filter(v, high)).cast("double").alias("high"),
            F.size(F.filter(v, lambda x, i: (i > 0) & (high(x) != high(F.get(v, i - 1))))).alias("changes"))

    def second(v: Column, s: Column) -> Column:
        mean, n = s["mean"], s["n"]
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda x, y: (x - mean) * (y - mean))
        runs = 2 * s["high"] * (n - s["high"]) / n + 1
        return F.struct((s["squares"] * size / n - n).alias("chi"), (size - 1).cast("double").alias("df"), runs.alias("runs"),
                        ((runs - 1) * (runs - 2) / (n - 1)).alias("runs_var"),
                        total(F.transform(v, lambda x: (x - mean) * (x - mean))).alias("spread"), total(pairs).alias("lagged"))

    def scores(s: Column, u: Column) -> Column:
        n = s["n"]
        chi = (F.cbrt(F.greatest(u["chi"], F.lit(0.0)) / u["df"]) - (1 - 2 / (9 * u["df"]))) / F.sqrt(2 / (9 * u["df"]))
        runs = F.when(u["runs_var"] > 0, F.abs(s["changes"] + 1 - u["runs"]) / F.sqrt(u["runs_var"])).otherwise(40.0)
        serial = F.when(u["spread"] > 0, F.abs(u["lagged"] / u["spread"] + 1 / n) * F.sqrt(n)).otherwise(40.0)
        return F.array(chi, runs, serial)

    def combined(z: Column) -> Column:
        tails = F.transform(z, lambda x, i: _upper_tail(x) * F.when(i > 0, 2).otherwise(1))
        return F.least(F.lit(1.0), 3 * F.array_min(tails))

    return let(values, lambda v: let(first(v), lambda s: let(second(v, s), lambda u: combined(scores(s, u)))))


def _encoding(body: Column) -> Column:
    """The number of the smallest alphabet that holds the string, if it is long enough and has letters and digits."""
    out = F.lit(None).cast("int")
    for k, (symbols, least) in reversed(list(enumerate(ALPHABETS.values()))):
        out = F.when((F.translate(body, symbols, "") == "") & (F.length(body) >= least), k).otherwise(out)
    return F.when(body.rlike("[0-9]") & body.rlike("[A-Za-z]"), out)


def letter_pairs(docs: DataFrame, text: str = "text") -> dict[tuple[str, str], int]:
    """How often a letter follows another, or starts a word (after ""), in all words that occur twice or more, case aside."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("w"))
    often = words.groupBy(F.lower("w").alias("w")).count().where(F.col("count") >= LEAST_COUNT)
    pairs = often.select("count", F.posexplode(F.split("w", "(?!$)")).alias("i", "letter"), "w")
    before = F.when(F.col("i") > 0, F.expr("substring(w, i, 1)")).otherwise("")
    return {(r.before, r.letter): r.n for r in pairs.groupBy(before.alias("before"), "letter").agg(F.sum("count").alias("n")).collect()}  # at most 27 x 26 rows


def identifier_bits(pairs: dict[tuple[str, str], int]) -> list[float]:
    """Bits of a symbol after another in an identifier: entry 66 a + b for symbols a, b; a = 66 at the start, which is as after a mark."""
    totals = {a: sum(pairs.get((a, b), 0) for b in CLASSES[0]) for a in ["", *CLASSES[0]]}
    sort = [k for k, chars in enumerate(CLASSES) for _ in chars]

    def bits(a: int, b: int) -> float:
        old, new = (3 if a == len(SYMBOLS) else sort[a]), sort[b]
        chance = CHANGES[old][new]
        if new > 1:
            return -log2(chance / len(CLASSES[new]))
        context = SYMBOLS[a].lower() if old < 2 and (old, new) != (0, 1) else ""  # a capital after a small letter starts a word
        share = (pairs.get((context, SYMBOLS[b].lower()), 0) + PRIOR / 26) / (totals[context] + PRIOR)
        return -log2(chance * ((1 - MIXED) * share + MIXED / 26))

    return [bits(a, b) for a in range(len(SYMBOLS) + 1) for b in range(len(SYMBOLS))]


def _battery(found: Column, table: list[float]) -> Column:
    """(start, stop, encoding, length class, p, bits) of each candidate that has an encoding; bits are log2 of the e-value."""
    alphabets = F.array(*[F.lit(symbols) for symbols, _ in ALPHABETS.values()])
    costs = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")  # folded into a constant

    def bits(chars: Column, size: Column) -> Column:
        def after(codes: Column) -> Column:
            each = F.transform(codes, lambda b, i: F.get(costs, F.when(i > 0, F.get(codes, i - 1)).otherwise(len(SYMBOLS)) * len(SYMBOLS) + b))
            return F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x) - F.size(codes) * F.log2(size.cast("double"))

        return let(F.transform(chars, lambda c: F.instr(F.lit(SYMBOLS), c) - 1), after)

    def tested(m: Column, body: Column, k: Column) -> Column:
        symbols, chars = F.get(alphabets, k), F.split(body, "(?!$)")
        values = F.transform(chars, lambda c: F.instr(symbols, c) - 1)
        length = sum(((F.length(body) > top).cast("int") for top in LENGTHS), F.lit(0))
        size = F.length(symbols)
        return F.struct(m["start"].alias("start"), m["stop"].alias("stop"), k.alias("encoding"), length.alias("length"),
                        F.when(k.isNotNull(), p_value(values, size)).alias("p"), F.when(k.isNotNull(), bits(chars, size)).alias("bits"))

    each = F.transform(found, lambda m: let(F.regexp_replace(m["found"], "=+$", ""),
                                            lambda body: let(_encoding(body), lambda k: tested(m, body, k))))
    return F.filter(each, lambda t: t["p"].isNotNull())


def _pieces(found: Column) -> Column:
    """The runs that one alphabet can hold, and the parts of the others; parts of the two kinds may overlap."""
    def part(m: Column, body: Column, p: Column) -> Column:
        stop = F.when(p["stop"] == F.length(body), m["stop"]).otherwise(m["start"] + p["stop"])  # the last keeps its padding
        return F.struct((m["start"] + p["start"]).alias("start"), stop.alias("stop"), p["found"].alias("found"))

    def split(m: Column, body: Column) -> Column:
        parts = F.concat(*[F.transform(matches(body, pattern), lambda p: part(m, body, p)) for pattern in PARTS])
        return F.when(body.rlike("[+/]") & body.rlike("[_-]"), F.array_distinct(parts)).otherwise(F.array(m))

    return F.flatten(F.transform(found, lambda m: let(F.regexp_replace(m["found"], "=+$", ""), lambda body: split(m, body))))


def candidates(text: Column, table: list[float]) -> Column:
    return let(_pieces(matches(text, CANDIDATE)), lambda found: _battery(found, table))


def _alone(found: Column, base: Column) -> Column:
    """The candidates that no base span touches; only these are judged."""
    return let(base, lambda spans: F.filter(found, lambda c: ~F.exists(spans, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))))


def thresholds(docs: DataFrame, table: list[float], text: str = "text", rate: float = RATE) -> dict[tuple[int, int], tuple[float, float]]:
    """For each (encoding, length class) that can have reports: a p-value to exceed, and bits to reach.

    Both rules run on binned values, whose counts are summed on the executors; the result has at
    most 8 encodings x 6 classes x 257 x 65 counts, mostly a few hundred.
    """
    judged = docs.select(F.col(text).alias("text")).where(F.col("text").rlike(CANDIDATE)).select(
        candidates(F.col("text"), table).alias("found"), base_spans(F.col("text")).alias("base"))
    found = judged.select(F.explode(_alone(F.col("found"), F.col("base"))).alias("c")).select("c.*")
    bins = found.groupBy("encoding", "length", F.least(F.floor(-4 * F.log2(F.greatest("p", F.lit(2.0**-70)))), F.lit(BINS)).alias("bin"),
                         F.greatest(F.least(F.floor("bits"), F.lit(BITS)), F.lit(0)).alias("bits")).count()
    by_class: dict[tuple[int, int], list] = {}
    for r in bins.collect():
        by_class.setdefault((r.encoding, r.length), []).append((r.bin, r.bits, r["count"]))
    out = {}
    for key, counts in by_class.items():
        low = step_up(_summed((b, n) for b, _, n in counts), rate)
        least = reach(_summed((e, n) for b, e, n in counts if 2.0 ** (-b / 4) > low), sum(n for _, _, n in counts), rate)
        if least < inf:
            out[key] = (low, least)
    return out


def _summed(pairs) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, n in pairs:
        out[k] = out.get(k, 0) + n
    return out


def reach(counts: dict[int, int], total: int, rate: float) -> float:
    """The bits that reports need: ``counts`` by whole bits of those not rejected, out of ``total``; infinite if there are none."""
    above, least = 0, inf
    for e in sorted((e for e in counts if e > 0), reverse=True):
        above += counts[e]
        if above * 2.0**e >= total / rate:
            least = float(e)
    return least


def step_up(counts: dict[int, int], rate: float) -> float:
    """The largest edge t with at least m t / rate p-values up to t, out of m; ``counts`` by bin: bin b holds p in (2^-(b+1)/4, 2^-b/4]."""
    total, below, best = sum(counts.values()), 0, 0.0
    for b in sorted(counts, reverse=True):  # from the smallest p upwards
        below += counts[b]
        edge = 2.0 ** (-b / 4)
        if below >= total * edge / rate:
            best = edge
    return best


def scan(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind, stop), kinds numbered as in ``KINDS``.

    ``spans`` holds the base spans and the candidates taken for random that no base span
    touches, by start and kind; parts of one run may overlap.  A NULL text has none.  The letter pairs
    and the thresholds need a pass over all texts each before.  Columns of ``docs`` with these names are replaced.
    """
    table = identifier_bits(letter_pairs(docs, text))
    limits = thresholds(docs, table, text, rate)
    body, = fresh(docs, "s_text")
    out = docs.withColumn(body, F.coalesce(F.col(text), F.lit(""))).withColumn("base", base_spans(F.col(body)))
    if not limits:
        return out.withColumn("spans", F.col("base")).drop(body)
    low, least = (F.create_map(*[F.lit(x) for (e, n), t in sorted(limits.items()) for x in (e * 10 + n, t[j])]) for j in (0, 1))
    key = lambda c: c["encoding"] * 10 + c["length"]
    found, = fresh(out, "s_found")
    out = out.withColumn(found, candidates(F.col(body), table))
    random = F.filter(_alone(F.col(found), F.col("base")),
                      lambda c: (c["p"] > F.try_element_at(low, key(c))) & (c["bits"] >= F.try_element_at(least, key(c))))
    return out.withColumn("spans", F.array_sort(F.concat("base", _spans(random, 3).cast(f"array<{SPAN}>")))).drop(body, found)


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or group of overlapping spans, replaced by ``MASK``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        between = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK)))
        return F.struct(between.otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def mask(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", rate: float = RATE) -> DataFrame:
    """``docs`` with their secrets replaced; all rows and columns stay, ``n_chars`` follows the text."""
    extra = fresh(docs, "m_text")
    found = scan(docs.select(F.struct("*").alias("row"), F.col(text).alias(extra[0])), extra[0], rate)
    new = F.when(F.size("spans") > 0, masked(F.col(extra[0]), F.col("spans"))).otherwise(F.col(extra[0]))
    columns = []
    for name in docs.columns:
        old = F.col("row")[name]
        if name == text:
            old = new
        elif name == n_chars:
            old = F.when(F.size("spans") > 0, F.length(new).cast(docs.schema[name].dataType)).otherwise(old)
        columns.append(old.alias(name))
    return found.select(*columns)
