"""DuckDB SQL of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from .quality import CHAR_LIMIT, CLASSES, COMMON_WORDS, MIN_WORDS, SYMBOLS, WORD_LIMIT, WORD_NOISE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' #'] ELSE [] END) AS s FROM w),
sh AS (SELECT doc_id, unnest(s) AS s FROM sets),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id > b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.y, r.root FROM r JOIN e ON r.x = e.x),
c AS (SELECT x AS doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""

_CLASS_SQL = ", ".join(rf"length(t) - length(regexp_replace(t, '[{c}]+', '', 'g'))" for c in CLASSES.values())
_WORDS_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in COMMON_WORDS.items()) + " END"


def _distance(counts: str, reference: str) -> str:
    p, q = f"({counts}[i] / list_sum({counts}))", f"({reference}[i] / list_sum({reference}))"
    part = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum(list_transform(generate_series(1, len({counts})), lambda i: {part(p)} + {part(q)})) / 2))"


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, {_WORDS_SQL} AS listed
  FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)),
f AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n_words, [{_CLASS_SQL}] AS c7,
         length(t) - length(regexp_replace(t, '[{SYMBOLS}]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         list_transform(w, lambda x: lower(x)) AS lw
  FROM d),
h AS (
  SELECT doc_id, lang, n_words, n_symbols, n_dup_lines, length(t) - c7[5] AS word_chars, list_append(c7, length(t) - list_sum(c7)) AS chars,
         list_transform(listed, lambda k: len(list_filter(lw, lambda x: x = k))) AS c20
  FROM f),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1) GROUP BY 1),
a AS (SELECT h.*, coalesce(rep.n, 0) AS n_repeat_words, list_append(c20, n_words - list_sum(c20)) AS common FROM h LEFT JOIN rep USING (doc_id)),
rc AS (SELECT lang, list(s ORDER BY i) AS ref FROM (SELECT lang, i, sum(chars[i]) AS s FROM (SELECT lang, chars, unnest(generate_series(1, len(chars))) AS i FROM a WHERE common IS NOT NULL) GROUP BY 1, 2) GROUP BY 1),
rw AS (SELECT lang, list(s ORDER BY i) AS ref FROM (SELECT lang, i, sum(common[i]) AS s FROM (SELECT lang, common, unnest(generate_series(1, len(common))) AS i FROM a WHERE common IS NOT NULL) GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT a.*, rc.ref AS r1, rw.ref AS r2 FROM a LEFT JOIN rc USING (lang) LEFT JOIN rw USING (lang)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN n_words > 0 AND r1 IS NOT NULL THEN {_distance("chars", "r1")} END AS cd, CASE WHEN n_words > 0 AND r2 IS NOT NULL THEN {_distance("common", "r2")} END AS wd FROM j)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(n_words >= {MIN_WORDS} AND (cd > {CHAR_LIMIT}::DOUBLE OR wd > {WORD_LIMIT}::DOUBLE + {WORD_NOISE}::DOUBLE / sqrt(n_words)), false) AS kept
FROM v
"""
