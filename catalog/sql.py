"""SQL texts for the draws and ranks of the library, spelled out for another engine."""

from __future__ import annotations

from tarnish.functions.rand import LOW_BITS, MODULUS, MULTIPLIERS, STEP_MULTIPLIER

# Key text of each table, from integers and strings only.
KEYS = {
    "orders": ["o_orderkey"],
    "customer": ["c_custkey"],
    "part": ["p_partkey"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"],
}


def quoted(text: object) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def key_text(table: str) -> str:
    parts = [f"epoch_us({c})" if c == "l_shipdate" else c for c in KEYS[table]]
    return f"concat_ws(':', {', '.join(parts)})"


def base(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def salt(seed: str, tag: str) -> list[str]:
    """Three integers of (seed, tag); ``seed`` is an SQL text expression."""
    h = f"md5({seed} || ':{tag}')"
    return [f"CAST('0x' || substr({h}, {at}, 7) AS BIGINT)" for at in (1, 8, 15)]


def u(v: str, salts: list[str], step: str | None = None) -> str:
    """Uniform draw of the row whose base is column ``v``."""
    hi, lo = f"({v} >> 30)", f"({v} & {LOW_BITS})"
    a, b, c = salts
    if step is not None:
        a = f"(({a} + ({step})::BIGINT * {STEP_MULTIPLIER}) % {MODULUS})"
    m1, m2, m3 = MULTIPLIERS
    x = f"((xor({hi}, {a}) * {m1} + {lo}) % {MODULUS})"
    y = f"((xor({x}, {b}) * {m2} + {hi}) % {MODULUS})"
    z = f"((xor({y}, {c}) * {m3} + {lo}) % {MODULUS})"
    return f"(({z} * 4194304 + ({y} >> 9))::DOUBLE / 9007199254740992.0::DOUBLE)"


def draw(v: str, seed: object, tag: str, step: str | None = None) -> str:
    return u(v, salt(quoted(seed), tag), step)


def normal(v: str, first: list[str], second: list[str], step: str | None = None) -> str:
    return (f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u(v, first, step)}))"
            f" * cos(2.0::DOUBLE * pi() * {u(v, second, step)}))")


def scalar(seed: str, tag: str) -> str:
    """A draw made once per corruption; ``seed`` is an SQL text expression."""
    return f"(CAST('0x' || substr(md5({seed} || ':{tag}'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def keyed(table: str, source: str | None = None) -> str:
    """A table with its key text ``k`` and hash base ``v``."""
    return (f"SELECT *, {base('k')} AS v FROM (SELECT *, {key_text(table)} AS k FROM {source or table}) kt")


def marked(table: str, fraction: float, sampling: str, seed: object, order: str | None = None,
           source: str | None = None) -> str:
    """The table with ``hit``; ``order`` is the damaged (NAR) or driver (AR) column."""
    seed_text = quoted(seed)
    if fraction == 1.0:
        return f"SELECT *, TRUE AS hit FROM ({keyed(table, source)}) k1"
    if sampling == "COIN":
        return f"SELECT *, {draw('v', seed, 'coin')} < {fraction}::DOUBLE AS hit FROM ({keyed(table, source)}) k1"
    if sampling == "CAR":
        ranked = f"row_number() OVER (ORDER BY {draw('v', seed, 'row')}, k) - 1"
        first = "0"
    else:
        ranked = (f"row_number() OVER (ORDER BY CASE WHEN {order} IS NULL THEN 1 ELSE 0 END, {order}, "
                  f"{draw('v', seed, 'tie')}, k) - 1")
        first = f"floor({scalar(seed_text, 'start')} * (n - kk))"
    return (f"SELECT * EXCLUDE (rk, n, kk), rk >= {first} AND rk < {first} + kk AS hit FROM ("
            f"SELECT *, {ranked} AS rk, n, floor(n * {fraction}::DOUBLE) AS kk FROM ({keyed(table, source)}) k1, "
            f"(SELECT count(*) AS n FROM {source or table}) k2) k3")
