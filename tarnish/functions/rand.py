"""Keyed randomness that does not depend on partitioning.

Every draw is a pure function of (row key, seed, tag).  A retried task, another
number of partitions or another cluster size therefore gives the same rows.

* ``row_base`` hashes the row key once to a 60-bit number (one md5 per row).
* ``uniform`` mixes that number with three integers derived from seed and tag, using
  only 64-bit multiply / xor / modulo.  A draw for one of many scenarios costs a few
  nanoseconds and stays in generated code, so a grid of hundreds of scenarios does not
  hash every row hundreds of times.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The modulus 2^31 - 1 and three published full-period multipliers for it.
MODULUS = 2147483647
MULTIPLIERS = (742938285, 950706376, 1226874159)
STEP_MULTIPLIER = 62089911

LOW_BITS = (1 << 30) - 1
TWO_52 = float(1 << 52)
TWO_53 = float(1 << 53)


def _digest(*parts: object) -> str:
    return hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()


def scalar_uniform(seed: object, tag: str, *parts: object) -> float:
    """One draw in [0, 1) for a decision made once per corruption, on the driver."""
    return int(_digest(seed, tag, *parts)[:13], 16) / TWO_52


def pick(options: list, seed: object, tag: str, *parts: object):
    """One of ``options``, each with the same probability."""
    return options[int(scalar_uniform(seed, tag, *parts) * len(options))]


@dataclass(frozen=True)
class Salt:
    """The three integers that stand for one (seed, tag) pair; ints or long columns."""

    a: int | Column
    b: int | Column
    c: int | Column

    @staticmethod
    def of(seed: object, tag: str) -> "Salt":
        h = _digest(seed, tag)
        return Salt(int(h[:7], 16), int(h[7:14], 16), int(h[14:21], 16))

    @staticmethod
    def field(struct: Column) -> "Salt":
        return Salt(struct["a"], struct["b"], struct["c"])

    def record(self) -> dict:
        return {"a": self.a, "b": self.b, "c": self.c}


SALT_TYPE = "struct<a:bigint,b:bigint,c:bigint>"


def micros(name: str, kind: T.DataType) -> Column:
    """Microseconds since 1970 of a timestamp; one without zone is read as it stands."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    whole = (F.unix_date(F.to_date(name)).cast("bigint") * 86_400
             + F.hour(name) * 3_600 + F.minute(name) * 60)
    part = (F.date_part(F.lit("SECONDS"), F.col(name)) * 1_000_000).cast("bigint")
    return whole * 1_000_000 + part


def key_string(df: DataFrame, key: list[str]) -> Column:
    """The row key as one string; built from integers and strings only.

    Floating point numbers print differently in different engines, so they are not
    accepted as key columns.  Timestamps count as microseconds, dates as days.
    """
    parts = []
    for name in key:
        kind = df.schema[name].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            raise ValueError(f"key column {name!r} is floating point; use integers or strings")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            parts.append(micros(name, kind).cast("string"))
        elif isinstance(kind, T.DateType):
            parts.append(F.unix_date(name).cast("string"))
        else:
            parts.append(F.col(name).cast("string"))
    return F.concat_ws(":", *parts)


def row_base(key_text: Column) -> Column:
    """60 well-mixed bits of a string, as BIGINT."""
    return F.conv(F.substring(F.md5(key_text), 1, 15), 16, 10).cast("bigint")


def _long(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("bigint")


def uniform(base: Column, salt: Salt, step: Column | None = None) -> Column:
    """Uniform double in [0, 1) for a row; ``step`` numbers several draws of one row."""
    hi, lo = F.shiftright(base, 30), base.bitwiseAND(LOW_BITS)
    a, b, c = _long(salt.a), _long(salt.b), _long(salt.c)
    if step is not None:
        a = (a + step.cast("bigint") * STEP_MULTIPLIER) % MODULUS
    m1, m2, m3 = MULTIPLIERS
    x = (hi.bitwiseXOR(a) * m1 + lo) % MODULUS
    y = (x.bitwiseXOR(b) * m2 + hi) % MODULUS
    z = (y.bitwiseXOR(c) * m3 + lo) % MODULUS
    return (z * (1 << 22) + F.shiftright(y, 9)).cast("double") / F.lit(TWO_53)


def normal(base: Column, first: Salt, second: Salt, step: Column | None = None) -> Column:
    """Standard normal draw (Box-Muller) from two uniform draws."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - uniform(base, first, step)))
    return radius * F.cos(F.lit(2.0) * F.pi() * uniform(base, second, step))


def with_row_key(df: DataFrame, name: str = "row_key", copies_per_row: int = 1_000_000) -> DataFrame:
    """Give a table without a key one: content hash plus a running number among copies.

    Identical rows cannot be told apart, so they are counted (partial aggregation keeps
    a heavily repeated row cheap) and written out again with numbers 0..count-1.  The
    repetition happens in pieces spread over the cluster, so a row that makes up a third
    of the table does not become one task's work.
    """
    columns = df.columns
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    size = F.lit(copies_per_row)
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    pieces = (
        counted.withColumn("_hash", F.md5(text))
        .withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                   F.expr(f"(_copies - 1) div {copies_per_row}"))))
        .repartition("_hash", "_piece")
    )
    first = F.col("_piece") * size
    last = F.least(first + size, F.col("_copies")) - 1
    return pieces.withColumn("_nr", F.explode(F.sequence(first, last))).select(
        *columns, F.concat_ws(":", "_hash", F.col("_nr").cast("string")).alias(name)
    )
