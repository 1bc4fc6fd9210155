"""DuckDB SQL for the queries that SQL can express."""

from pixelloom.llm.quality_rules import ALPHA, COUNTS, DELTA, DESIGN, GRIDS

LINE_DEDUP = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
    SELECT r, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM docs
),
keyed AS (
    SELECT r, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
judged AS (SELECT r, pos, line, k IN (SELECT k FROM common) AS dropped FROM keyed)
SELECT d.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged JOIN docs d USING (r) GROUP BY r, d.doc_id
"""

_RULES = ", ".join(f"('{rule}', {at}, {i}, {cutoff!r})" for at, (rule, grid) in enumerate(GRIDS.items()) for i, cutoff in enumerate(grid))
_FIGURE = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {rule}" for rule in GRIDS) + " END"

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 4], chr(10)) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g),
p AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS pos FROM c WHERE c > 1) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, lang, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(t) - length(replace(t, '!', '')) AS shouts, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper
  FROM d JOIN w USING (r) LEFT JOIN l USING (r) LEFT JOIN p USING (r)),
f AS (SELECT *, CAST(n_symbols AS DOUBLE) / greatest(n_words, 1) AS symbol_share, CAST(shouts AS DOUBLE) / greatest(n_words, 1) AS shout_share, CAST(upper AS DOUBLE) / greatest(word_chars, 1) AS upper_share,
  CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1) AS dup_line_share, CAST(n_repeat_words AS DOUBLE) / greatest(n_words, 1) AS repeat_share, CAST(word_chars AS DOUBLE) / greatest(n_words, 1) AS long_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m),
rules(rule, o, i, cutoff) AS (VALUES {_RULES}),
marks AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
lab AS (SELECT f.*, good, substr(md5(doc_id::VARCHAR), 1, 1) IN ({", ".join(f"'{c}'" for c in DESIGN)}) AS design FROM f JOIN marks USING (doc_id)),
alone AS (SELECT rule, o, i, cutoff, count(*) FILTER (WHERE NOT good AND {_FIGURE} > cutoff) AS bad, count(*) FILTER (WHERE good AND {_FIGURE} > cutoff) AS lost FROM (SELECT * FROM lab WHERE design), rules GROUP BY ALL),
gain AS (SELECT *, bad - coalesce(lag(bad) OVER (PARTITION BY rule ORDER BY i), 0) AS more FROM alone),
steps AS (SELECT rule, cutoff, row_number() OVER (ORDER BY lost, i, o) AS step FROM gain WHERE more > 0),
hit AS (SELECT r, min(step) AS step FROM f, steps WHERE {_FIGURE} > cutoff GROUP BY r),
held AS (SELECT lang, step FROM lab LEFT JOIN hit USING (r) WHERE good AND NOT design),
strata AS (SELECT lang, count(*) AS n, count(*) OVER () AS strata FROM held GROUP BY lang),
k AS (SELECT strata.lang, n, strata, steps.step, count(held.step) FILTER (WHERE held.step <= steps.step) AS k FROM strata CROSS JOIN steps LEFT JOIN held ON held.lang IS NOT DISTINCT FROM strata.lang GROUP BY ALL),
unsafe AS (SELECT lang, step FROM k WHERE CASE WHEN k >= n THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({ALPHA}) + (n - j) * ln(1.0 - {ALPHA}))))) END > {DELTA} / strata),
reach AS (SELECT strata.lang, coalesce(min(unsafe.step) - 1, (SELECT count(*) FROM steps)) AS reach FROM strata LEFT JOIN unsafe ON unsafe.lang IS NOT DISTINCT FROM strata.lang GROUP BY ALL)
SELECT doc_id, {', '.join(COUNTS)}, base_failed, NOT base_failed AND NOT coalesce(hit.step <= reach.reach, false) AS kept
FROM f LEFT JOIN hit USING (r) LEFT JOIN reach ON reach.lang IS NOT DISTINCT FROM f.lang
"""
