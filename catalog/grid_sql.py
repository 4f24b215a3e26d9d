"""SQL that evaluates a grid the plain way: copy, damage and score the whole test table per scenario."""

from __future__ import annotations

from catalog import sql
from catalog.metrics import BULK, auc_sql
from catalog.samplers import SEED

NUMERICAL = ["l_quantity", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]
FEATURES = NUMERICAL + CATEGORICAL
SPLIT = f"{SEED}/split"

# Fixed weights of the scorer in catalog.samplers, written over the columns c_<feature>.
LOGIT = (
    "(-7.2::DOUBLE + 0.3::DOUBLE * coalesce(c_l_quantity, {q}) + -7.5::DOUBLE * coalesce(c_l_discount, {d})"
    " + 0.4::DOUBLE * coalesce(c_l_tax, {t})"
    " + CASE WHEN c_l_returnflag = 'A' THEN 0.15::DOUBLE WHEN c_l_returnflag = 'N' THEN -0.1::DOUBLE"
    " WHEN c_l_returnflag = 'R' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END"
    " + CASE WHEN c_l_linestatus = 'F' THEN 0.2::DOUBLE WHEN c_l_linestatus = 'O' THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END)")
PLAIN = LOGIT.format(q="25.0::DOUBLE", d="0.05::DOUBLE", t="0.04::DOUBLE")


def scenario_values(rows: list[tuple]) -> str:
    """VALUES of (scenario_id, kind, col, frac, samp, na, partner)."""
    def cell(x):
        return "NULL" if x is None else sql.quoted(x) if isinstance(x, str) else repr(x)
    body = ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows)
    return ("SELECT scenario_id, kind, col, frac::DOUBLE AS frac, samp, na::VARCHAR AS na, partner::VARCHAR AS partner "
            f"FROM (VALUES {body}) s(scenario_id, kind, col, frac, samp, na, partner)")


def damaged(spec: str, repetitions: int) -> str:
    """Named tables up to ``x``: one row per test row and scenario with old and new cells."""
    feature_list = "[" + ", ".join(sql.quoted(f) for f in FEATURES) + "]"
    salts = ", ".join(f"{s} AS {name}{i}" for name, tag in (("r", "row"), ("c", "coin"), ("p", "n1"), ("q", "n2"))
                      for i, s in enumerate(sql.salt("seed", tag)))
    ranks = ", ".join(
        f"row_number() OVER (ORDER BY CASE WHEN {f} IS NULL THEN 1 ELSE 0 END, {f}, {sql.draw('v', SEED, 'tie')}, k) - 1 "
        f"AS rk_{f}" for f in FEATURES)
    by_column = "CASE order_col " + " ".join(f"WHEN '{f}' THEN rk_{f}" for f in FEATURES) + " END"
    cells = []
    for f in FEATURES:
        kin = NUMERICAL if f in NUMERICAL else CATEGORICAL
        number = f in NUMERICAL
        out = f"CASE WHEN NOT hit THEN {f} WHEN kind = 'missing' AND col = '{f}' THEN " + (
            "na::DOUBLE" if number else "na")
        if number:
            out += (f" WHEN kind = 'noise' AND col = '{f}' THEN {f} + "
                    f"{sql.normal('v', ['p0', 'p1', 'p2'], ['q0', 'q1', 'q2'])} * ((1 + 4 * scale) * sd_{f})"
                    f" WHEN kind = 'scaling' AND col = '{f}' THEN {f} * factor")
        else:
            out += f" WHEN kind = 'encoding' AND col = '{f}' THEN translate({f}, 'aAeEoOuU', 'áÁéÉớỚúÚ')"
            out += f" WHEN kind = 'shift' AND col = '{f}' THEN coalesce(target, {f})"
        for g in kin:
            if g != f:
                out += f" WHEN kind = 'swap' AND ((col = '{f}' AND partner = '{g}') OR (col = '{g}' AND partner = '{f}')) THEN {g}"
        cells.append(out + f" ELSE {f} END AS c_{f}")
    spreads = ", ".join(f"stddev_pop({f}) AS sd_{f}" for f in NUMERICAL)
    value = "CASE col " + " ".join(f"WHEN '{f}' THEN {f}" for f in CATEGORICAL) + " END"
    categories = " UNION ".join(f"SELECT '{f}' AS col, {f} AS value FROM test WHERE {f} IS NOT NULL" for f in CATEGORICAL)
    def order(tag):
        return f"row_number() OVER (PARTITION BY idx ORDER BY {sql.u('v', sql.salt('seed', tag))}, value)"
    return f"""
sp AS MATERIALIZED (SELECT *, {BULK} AS label FROM ({sql.marked('lineitem', 0.2, 'CAR', SPLIT)}) m),
train AS (SELECT * FROM sp WHERE NOT hit),
test AS MATERIALIZED (SELECT * EXCLUDE (hit), {ranks}, count(*) OVER () AS n FROM sp WHERE hit),
sd AS (SELECT {spreads} FROM test),
spec AS ({spec}),
scen0 AS (SELECT *, scenario_id * {repetitions} + rep AS idx, '{SEED}/' || scenario_id || '/' || rep AS seed
          FROM spec, (SELECT unnest(range({repetitions})) AS rep) reps),
scen AS MATERIALIZED (SELECT *, {sql.scalar('seed', 'start')} AS start_u, {sql.scalar('seed', 'scale')} AS scale,
          CASE CAST(floor(3 * {sql.scalar('seed', 'factor')}) AS INT) WHEN 0 THEN 10.0 WHEN 1 THEN 100.0 ELSE 1000.0 END::DOUBLE AS factor,
          CASE WHEN samp LIKE '%NAR' THEN col WHEN samp LIKE '%CAR' THEN NULL ELSE
            (list_sort(list_transform(list_filter({feature_list}, lambda f: f <> col),
              lambda f: substr(md5(seed || ':dep:' || f), 1, 13) || f))[1])[14:] END AS order_col, {salts} FROM scen0),
cats AS (SELECT idx, s.col, seed, value, {sql.base('value')} AS v FROM ({categories}) c JOIN scen s ON s.col = c.col AND kind = 'shift'),
perm AS (SELECT a.idx, a.value, b.value AS target FROM (SELECT *, {order('from')} AS p FROM cats) a
         JOIN (SELECT *, {order('to')} AS p FROM cats) b ON a.idx = b.idx AND a.p = b.p),
pairs AS (SELECT test.*, scen.*, target, sd.*, floor(n * frac) AS kk,
          row_number() OVER (PARTITION BY scen.idx ORDER BY {sql.u('v', ['r0', 'r1', 'r2'])}, k) - 1 AS rk_car
          FROM test CROSS JOIN scen CROSS JOIN sd LEFT JOIN perm ON perm.idx = scen.idx AND perm.value = {value}),
h AS (SELECT *, CASE WHEN kind = 'encoding' THEN {sql.u('v', ['c0', 'c1', 'c2'])} < frac
        WHEN frac = 1 THEN TRUE WHEN samp LIKE '%CAR' THEN rk_car < kk
        ELSE {by_column} >= floor(start_u * (n - kk)) AND {by_column} < floor(start_u * (n - kk)) + kk END AS hit FROM pairs),
x AS MATERIALIZED (SELECT *, {', '.join(cells)} FROM h)"""


def base_score(logit: str = PLAIN) -> str:
    old = logit
    for f in FEATURES:
        old = old.replace(f"c_{f}", f)
    return f"(SELECT auc FROM ({auc_sql('test', old, 'label')}) b)"


def impact(rows: list[tuple], repetitions: int, logit: str = PLAIN, extra: str = "") -> str:
    return f"""WITH {damaged(scenario_values(rows), repetitions)}{extra},
after AS ({auc_sql('x', logit, 'label', 'idx')})
SELECT scenario_id, rep, round({base_score(logit)}, 6) AS baseline_score, round(auc, 6) AS corrupted_score
FROM after JOIN scen USING (idx)"""


def flags(spec: str, repetitions: int) -> str:
    """Tables up to ``verdict`` (idx, codes): expectations learnt on the train part."""
    counts, codes = [], []
    for f in FEATURES:
        counts.append(f"sum(CASE WHEN c_{f} IS NULL THEN 1 ELSE 0 END) AS gone_{f}")
        codes.append(f"CASE WHEN gone_{f} > 0 AND (SELECT count(*) = count({f}) FROM train) THEN '{f}:PRESENCE_BELOW_MIN' END")
        if f in CATEGORICAL:
            counts.append(f"sum(CASE WHEN c_{f} NOT IN (SELECT DISTINCT {f} FROM train) THEN 1 ELSE 0 END) AS odd_{f}")
            codes.append(f"CASE WHEN odd_{f} > 0 THEN '{f}:OUT_OF_DOMAIN' END")
    return f"""WITH {damaged(spec, repetitions)},
after AS ({auc_sql('x', PLAIN, 'label', 'idx')}),
counts AS (SELECT idx, {', '.join(counts)} FROM x GROUP BY idx),
verdict AS (SELECT idx, concat_ws(',', {', '.join(codes)}) AS codes FROM counts)"""


def random_spec(count: int) -> str:
    """Random corruption descriptions from the same scalar draws."""
    def d(tag):
        return f"(CAST('0x' || substr(md5('{SEED}:{tag}:' || i), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"

    def pick(options, tag):
        items = "[" + ", ".join(sql.quoted(o) for o in options) + "]"
        return f"({items})[CAST(floor({len(options)} * {d(tag)}) AS INT) + 1]"

    def partner(options):
        cases = " ".join(f"WHEN '{c}' THEN {pick([o for o in options if o != c], 'partner')}" for c in options)
        return f"CASE col {cases} END"

    share = repr(0.0 + len(NUMERICAL) / len(FEATURES))
    return f"""
SELECT scenario_id, kind, col, frac, CASE WHEN kind = 'missing' THEN samp ELSE 'CAR' END AS samp,
       CASE WHEN kind = 'missing' AND NOT num THEN '' END AS na, CASE WHEN kind = 'swap' THEN partner END AS partner
FROM (SELECT *, i AS scenario_id, floor(100 * {d('frac')}) / 100 AS frac, {pick(['MCAR', 'MAR', 'MNAR'], 'mechanism')} AS samp,
        CASE WHEN num THEN {partner(NUMERICAL)} ELSE {partner(CATEGORICAL)} END AS partner,
        CASE WHEN {d('swap?')} < 0.1::DOUBLE THEN 'swap' WHEN num THEN {pick(['missing', 'noise', 'scaling'], 'kind')}
             ELSE {pick(['missing', 'encoding'], 'kind')} END AS kind
      FROM (SELECT *, CASE WHEN num THEN {pick(NUMERICAL, 'column')} ELSE {pick(CATEGORICAL, 'column')} END AS col
            FROM (SELECT i, {d('type')} < {share}::DOUBLE AS num FROM (SELECT unnest(range({count})) AS i) r0) r1) r2) r3"""
