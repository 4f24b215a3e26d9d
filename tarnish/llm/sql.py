"""SQL that must give the same rows, where SQL can express an operator."""

from __future__ import annotations

from tarnish.llm import preference as f, quality as q, urls as u


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SPACE = r"'[\x20\x09-\x0D]+'"

QUALITY = rf"""
WITH body AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
toks AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, {_SPACE}), lambda w: w <> '') AS ws,
                string_split(t, chr(10)) AS ls FROM body),
wins AS (SELECT r, i, array_to_string(ws[i:i + {q.WINDOW - 1}], ' ') AS win
         FROM (SELECT r, ws, unnest(range(1, len(ws) - {q.WINDOW - 2})) AS i FROM toks)),
twice AS (SELECT r, i FROM wins WHERE (r, win) IN (SELECT (r, win) FROM wins GROUP BY r, win HAVING count(*) > 1)),
gaps AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM twice),
rep AS (SELECT r, sum(CASE WHEN p IS NULL THEN {q.WINDOW} ELSE least({q.WINDOW}, i - p) END) AS n FROM gaps GROUP BY r),
lines AS (SELECT r, k, l, list_filter(regexp_split_to_array(l, {_SPACE}), lambda w: w <> '') AS lw
          FROM (SELECT r, unnest(ls) AS l, unnest(range(len(ls))) AS k FROM toks)),
judged AS (SELECT r, l, lw, len(array_to_string(lw, '')) AS chars,
                  len(l) - len(regexp_replace(l, {_quoted(q.SYMBOLS)}, '', 'g')) AS marks FROM lines),
per AS (SELECT r, sum(chars) AS all_chars, sum(marks) AS n_symbols,
               count(*) FILTER (WHERE len(lw) > 0) - count(DISTINCT l) FILTER (WHERE len(lw) > 0) AS n_dup,
               sum(chars) FILTER (WHERE len(lw) > 0 AND NOT (marks * 10 <= chars * 3
                 AND (len(lw) <= {q.BARE_WORDS} OR regexp_matches(l, {_quoted(q.PAUSE)}))
                 AND NOT regexp_matches(l, {_quoted(q.MENU)}) AND NOT regexp_matches(l, {_quoted(q.LABEL)})
                 AND NOT regexp_matches(l, {_quoted(q.BOILERPLATE)}))) AS lost
        FROM judged GROUP BY r),
base AS (SELECT toks.r, doc_id, len(ws) AS n_words, all_chars, n_symbols, n_dup, coalesce(rep.n, 0) AS n_rep, coalesce(lost, 0) AS lost
         FROM toks JOIN per USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, all_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup::BIGINT AS n_dup_lines, n_rep::BIGINT AS n_repeat_words,
       (n_words < {q.MIN_WORDS} OR 100 * n_rep > {q.MAX_REPEATED} * n_words) AS base_failed,
       NOT (n_words < {q.MIN_WORDS} OR 100 * n_rep > {q.MAX_REPEATED} * n_words) AND 100 * lost <= {q.MAX_LOST} * all_chars AS kept,
       lost::BIGINT AS lost_chars
FROM base
"""

# Base 32 of the 160 bits of a SHA-1: 32 digits of five bits, from four pieces of 40 bits.
WARC = """
WITH body AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
dig AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h FROM body),
grp AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS last FROM dig)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((CAST('0x' || substr(h, (i // 8) * 10 + 1, 10) AS BIGINT)) >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM grp
"""

_FITS = " ".join(
    f"WHEN (host = '{r.split('/', 1)[0]}' OR ends_with(host, '.{r.split('/', 1)[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{r}'"
    for r in sorted(u.RULES, key=len, reverse=True))
_SAYS = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in u.RULES.items())

URLS = rf"""
WITH cut AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {_FITS} END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE rule {_SAYS} ELSE CASE WHEN regexp_matches(host, {_quoted(u.MARKS)}) THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled
"""

_TURN = f"'{f.HEAD}' || replace(coalesce(role, 'unknown'), '<|', '< |') || '{f.MIDDLE}'".replace("\n", "' || chr(10) || '")
_BODY = f"replace(coalesce(text, ''), '<|', '< |') || '{f.TAIL}'".replace("\n", "' || chr(10) || '")

PREFERENCE = f"""
WITH firsts AS (SELECT conv_id, min(turn) AS a FROM conversations WHERE role = '{f.ASSISTANT}' GROUP BY conv_id),
after AS (SELECT c.conv_id - 1 AS conv_id, turn, role, text FROM conversations c JOIN firsts ON firsts.conv_id = c.conv_id - 1 WHERE turn >= a),
rej AS (SELECT conv_id, turn, role, text FROM conversations JOIN firsts USING (conv_id) WHERE turn < a AND conv_id IN (SELECT conv_id FROM after)
        UNION ALL SELECT * FROM after),
cho AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IN (SELECT conv_id FROM rej)),
turns AS (SELECT *, row_number() OVER (PARTITION BY side, conv_id ORDER BY turn, role, text) AS k,
                {_TURN} AS head, {_BODY} AS body
         FROM (SELECT 'c' AS side, * FROM cho UNION ALL SELECT 'r' AS side, * FROM rej)),
same AS (SELECT c.conv_id, c.k, r.k IS NOT NULL AND c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS eq
         FROM (SELECT * FROM turns WHERE side = 'c') c LEFT JOIN (SELECT * FROM turns WHERE side = 'r') r ON r.conv_id = c.conv_id AND r.k = c.k),
cut AS (SELECT conv_id, coalesce(min(k) FILTER (WHERE NOT eq) - 1, max(k)) AS n FROM same WHERE conv_id IN (SELECT conv_id FROM rej) GROUP BY conv_id),
spans AS (SELECT turns.*, n, sum(len(head) + len(body)) OVER (PARTITION BY side, conv_id, k > n ORDER BY k) AS stop FROM turns JOIN cut USING (conv_id))
SELECT conv_id, any_value(n)::INT AS n_prompt_turns,
       coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE side = 'c' AND k <= n), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE side = 'c' AND k > n), '') AS chosen,
       coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE side = 'r' AND k > n), '') AS rejected,
       coalesce(string_agg((stop - len(body))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY k) FILTER (WHERE side = 'c' AND k > n AND role = '{f.ASSISTANT}'), '') AS chosen_spans,
       coalesce(string_agg((stop - len(body))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY k) FILTER (WHERE side = 'r' AND k > n AND role = '{f.ASSISTANT}'), '') AS rejected_spans
FROM spans GROUP BY conv_id
"""

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_TERM})"

LEXICAL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
ns AS (SELECT r, doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
st AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM ns),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, st GROUP BY t),
q AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS ts FROM benchmark),
qt AS (SELECT DISTINCT q, item_id, unnest(ts) AS t FROM q),
scored AS (SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
                  sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
           FROM qt JOIN w USING (t) JOIN tf USING (t) JOIN ns USING (r), st GROUP BY q, r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

EXACT = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY body)::BIGINT AS group_size,
       row_number() OVER best = 1 AS kept, sha256(body) AS text_sha256
FROM n WINDOW best AS (PARTITION BY body ORDER BY size DESC, doc_id NULLS LAST)
"""


def _leaf(n_chars: str) -> str:
    names = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in names) + ")"


# CRC-32 of the decimal digits, bit by bit with the reversed polynomial.
_CRC = ("xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), "
        "lambda c, x: list_reduce([xor(c, x)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))))")


def _tree(name: str, leaves: str, levels: int) -> str:
    """Tables of a tree with groups ``g``: nodes of every level, and each leaf's path so far and fold."""
    parts = [f"{name}n0 AS MATERIALIZED (SELECT g, i, n, h FROM {leaves})",
             f"{name}p0 AS MATERIALIZED (SELECT id, g, i, n, '' AS proof, fold FROM {leaves})"]
    for k in range(levels):
        parts.append(
            f"{name}n{k + 1} AS MATERIALIZED (SELECT g, i // 2 AS i, (any_value(n) + 1) // 2 AS n, "
            f"CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}n{k} GROUP BY g, i // 2)")
        parts.append(
            f"{name}p{k + 1} AS MATERIALIZED (SELECT p.id, p.g, p.i // 2 AS i, (p.n + 1) // 2 AS n, proof || coalesce(s.h, '') AS proof, "
            f"CASE WHEN p.n = 1 THEN fold WHEN p.i % 2 = 1 THEN sha256(coalesce(s.h, '') || fold) ELSE sha256(fold || coalesce(s.h, '')) END AS fold "
            f"FROM {name}p{k} p LEFT JOIN {name}n{k} s ON s.g = p.g AND s.i = xor(p.i, 1))")
    return ",\n".join(parts)


#: Levels of the trees of the SQL: 2 to this power leaves of a group, and groups.
_DEEP, _WIDE = 24, 10

MERKLE = f"""
WITH leaves AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce('1' || lang, '0') AS g, {_leaf('n_chars')} AS leaf,
                       CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('n_chars + 1')} END AS bad FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n,
                  leaf AS h, coalesce(bad, leaf) AS fold FROM leaves),
{_tree('a', 'placed', _DEEP)},
tops AS MATERIALIZED (SELECT g AS id, 0 AS g, row_number() OVER (ORDER BY g::BLOB) - 1 AS i, count(*) OVER () AS n, h, h AS fold FROM an{_DEEP}),
{_tree('b', 'tops', _WIDE)},
lower_paths AS MATERIALIZED (SELECT l.id, l.proof, l.fold, tops.i, tops.n, l.g AS top, tops.h AS subroot FROM ap{_DEEP} l JOIN tops ON tops.id = l.g),
both_paths AS MATERIALIZED (SELECT l.id, l.subroot, l.proof || u.proof AS proof, l.fold, l.i, l.n, 0 AS g FROM lower_paths l JOIN bp{_WIDE} u ON u.id = l.top),
{_tree('c', '(SELECT id, g, i, n, fold, subroot AS h FROM both_paths)', _WIDE).replace('cn0 AS MATERIALIZED (SELECT g, i, n, h FROM (SELECT id, g, i, n, fold, subroot AS h FROM both_paths))', 'cn0 AS MATERIALIZED (SELECT g, i, n, h FROM tops)')}
SELECT placed.doc_id, placed.leaf, subroot, bn{_WIDE}.h AS root, sha256(both_paths.proof) AS proof_sha256, cp{_WIDE}.fold AS folded_root,
       cp{_WIDE}.fold = bn{_WIDE}.h AS verified
FROM placed JOIN both_paths USING (id) JOIN cp{_WIDE} USING (id), bn{_WIDE}
"""
