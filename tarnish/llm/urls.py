"""URL rules, and exact membership in a list of hosts by a cascade of Bloom filters.

Level 1 encodes the listed keys.  Level 2 encodes the other keys of the corpus that level 1
takes for listed, level 3 the listed keys that level 2 takes for those, and so on until a level
makes no mistake.  As every key of the corpus was in one of the sets, the answer for each is
exact, and judging a row needs its key and the filters only: no join, no shuffle.

The filters are constants of the plan, so their size is checked; beyond the bound the same
question is answered by a join.  Only built-in expressions run here.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tarnish.llm.common import ascii_lower, fresh
from tarnish.session import cut_lineage

#: Bits of all levels together: 4 MB, sent with the plan.
MAX_BITS = 32 << 20
MAX_LEVELS = 64

# Rules as host and path, with their verdict.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Labels of hosts that the list is made of.
MARKS = r"(^|[.-])(spam|pills|casino|poker|viagra|loans|warez|torrent|xxx)([.-]|$)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty without ``://`` or for NULL."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits the host or a parent of it and the beginning of the path; else NULL."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: bytes

    def positions(self, key: Column) -> list[Column]:
        return _positions(key, self.bits, self.hashes, self.seed)

    def has(self, key: Column) -> Column:
        data, out = F.lit(self.words), F.lit(True)
        for p in self.positions(key):
            byte = F.conv(F.hex(F.substring(data, (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & (F.getbit(byte, (p % 8).cast("int")) == 1)
        return out


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(k)), F.lit(bits).cast("long")) for k in range(hashes)]


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter of ``n`` keys; its bits are gathered on the executors, 64 to a row."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, -(-int(1.45 * n * max(1.0, -math.log2(rate)) + 1) // 64) * 64)
    places = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed))).alias("p"))
    rows = places.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("b"))
    words = bytearray(bits // 8)
    for r in rows.collect():  # at most MAX_BITS / 64 rows, checked before
        words[8 * r.w:8 * r.w + 8] = (r.b % 2**64).to_bytes(8, "little")
    return Level(bits, hashes, seed, bytes(words))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def listed(self, key: Column) -> Column:
        """Exact for the keys of the universe; without levels nothing is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            out = F.when(self.levels[k].has(key), out).otherwise(F.lit(k % 2 == 1))
        return out


def cascade(universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade | None:
    """From (key, listed) with distinct keys; None if the filters would be larger than ``max_bits``.

    NULL keys are in no filter.
    """
    universe = universe.where("key is not null")
    n = {r.listed: r["count"] for r in universe.groupBy("listed").count().collect()}
    inside, outside = n.get(True, 0), n.get(False, 0)
    if not inside:
        return Cascade(())
    rate = min(0.5, max(2.0**-30, math.sqrt(0.5) * inside / outside)) if outside else 0.5
    if 1.45 * inside * (3 - math.log2(rate)) + 1024 > max_bits:
        return None
    include, exclude, size = universe.where("listed").select("key"), universe.where("not listed").select("key"), inside
    levels: list[Level] = []
    while size:
        if len(levels) == MAX_LEVELS or 1.45 * size - math.log2(rate) + sum(x.bits for x in levels) > max_bits:
            return None
        levels.append(_level(include, size, rate if not levels else 0.5, len(levels)))
        wrong = cut_lineage(exclude.where(levels[-1].has(F.col("key"))))
        include, exclude, size = wrong, include, wrong.count()
    return Cascade(tuple(levels))


def judge(pages: DataFrame, is_listed: Column | None = None, url: str = "url", rules: dict[str, str] = RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    A rule decides where one fits; otherwise listed hosts are blocked.  ``is_listed`` is a
    condition on the column ``host`` that makes the list, evaluated once for each host of the
    corpus; by default hosts with one of ``MARKS`` as a label.  A NULL url has an empty host and
    path.  Rows stand alone; an empty table gives an empty result; columns of ``pages`` with
    these names are replaced.
    """
    marked = F.col("host").rlike(MARKS) if is_listed is None else is_listed
    host, path = host_and_path(F.col(url))
    h, p = fresh(pages, "u_host", "u_path")
    out = pages.withColumn(h, host).withColumn(p, path).withColumn("host", F.col(h)).withColumn("path", F.col(p)).drop(h, p)
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    universe = cut_lineage(out.select("host").distinct().select(F.col("host").alias("key"), F.coalesce(marked, F.lit(False)).alias("listed")))
    filters = cascade(universe, max_bits)
    if filters is None:
        key, = fresh(out, "u_key")
        blocked = universe.where("listed").select(F.col("key").alias(key))
        out = out.join(blocked, out["host"] == blocked[key], "left").withColumn("verdict", F.when(F.col(key).isNotNull(), "block").otherwise("allow")).drop(key)
    else:
        out = out.withColumn("verdict", F.when(filters.listed(F.col("host")), "block").otherwise("allow"))
    ruled = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()], F.col("verdict")) if rules else F.col("verdict")
    return out.withColumn("verdict", ruled)
