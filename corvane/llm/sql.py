"""The queries of this subpackage as DuckDB SQL, written without the operators' shortcuts."""

from __future__ import annotations

from corvane.llm import licenses, substring, suffixes

_A_Z = f"'{licenses.UPPER}', '{licenses.LOWER}'"


def _words(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(translate(coalesce({text}, ''), {_A_Z}), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _starts(phrase: str) -> str:
    parts = phrase.split()
    here = " AND ".join(f"w[i + {k}] = '{part}'" for k, part in enumerate(parts, 1))
    return f"list_filter(range(len(w) - {len(parts) - 1}), lambda i: {here})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LICENSE_SCAN = f"""
WITH given AS (
  SELECT k, label, list_distinct({_words("t")}) AS t_words, {_words("m")} AS must
  FROM (VALUES {", ".join(f"({k}, {_quoted(label)}, {_quoted(text)}, {_quoted(must)})" for k, (label, text, must) in enumerate(licenses.TEMPLATES))}) AS x(k, label, t, m)
), docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, text FROM documents
), lines AS (
  SELECT rid, string_split(coalesce(text, ''), chr(10)) AS each FROM docs
), block AS (
  SELECT DISTINCT rid, {_words("block")} AS b_words
  FROM (SELECT rid, unnest(list_transform(range(len(each)), lambda i: array_to_string(each[i + 1 : i + {licenses.LINES}], ' '))) AS block FROM lines)
), near AS (
  SELECT rid, label, len(list_intersect(t_words, b_words)) / len(t_words) AS containment
  FROM block, given
  WHERE len(list_intersect(t_words, b_words)) >= ceil(len(t_words) * {licenses.THRESHOLD}::DOUBLE) AND list_has_all(b_words, must)
), by_row AS (
  SELECT rid, list(DISTINCT label) AS found, max(containment) AS best FROM near GROUP BY rid
), word AS (
  SELECT rid, doc_id, {_words("text")} AS w FROM docs
), place AS (
  SELECT rid, doc_id, len(w) AS n_words, {", ".join(f"{_starts(phrase)} AS {label}" for phrase, label in licenses.PHRASES)} FROM word
), base AS (
  SELECT rid, doc_id, n_words, list_concat({", ".join(label for _, label in licenses.PHRASES)}) AS places,
    list_filter([{", ".join(f"CASE WHEN len({label}) > 0 THEN {_quoted(label)} END" for _, label in licenses.PHRASES)}], lambda x: x IS NOT NULL) AS labels
  FROM place
)
SELECT base.doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base,
  list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  array_to_string(list_sort(labels), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(labels, coalesce(found, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM base LEFT JOIN by_row USING (rid)
"""

SUBSTRING_DEDUP = f"""
WITH word AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + {substring.WINDOW - 1}), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {substring.WINDOW - 2})) AS i FROM word)
), least AS (
  SELECT k, min(doc_id) AS first FROM win GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {substring.WINDOW})) AS pos FROM win JOIN least USING (k) WHERE doc_id > first
), each AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM word
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT word.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM word LEFT JOIN kept USING (doc_id)
"""

SUFFIX_DEDUP = f"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), start AS (
  SELECT rid, h, unnest(range(0, len(h) // 2 - {suffixes.LENGTH - 1})) AS i FROM doc
), window_of AS MATERIALIZED (
  SELECT rid, i, md5(substring(h, (2 * i + 1)::BIGINT, {2 * suffixes.LENGTH})) AS k FROM start
), again AS (
  SELECT rid, i FROM window_of WHERE k IN (SELECT k FROM window_of GROUP BY k HAVING count(*) > 1)
), run AS (
  SELECT rid, i, sum(CASE WHEN i <= last + {suffixes.LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS n
  FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS last FROM again)
), span AS (
  SELECT rid, n, min(i) AS a, max(i) + {suffixes.LENGTH} AS b FROM run GROUP BY rid, n
), gone AS (
  SELECT rid, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY rid
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(len(a) + 1), lambda j: substring(h, 2 * (CASE WHEN j = 0 THEN 0 ELSE b[j] END) + 1,
    2 * ((CASE WHEN j = len(a) THEN len(h) // 2 ELSE a[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE b[j] END)))), '') END)) AS kept_sha256
FROM doc LEFT JOIN gone USING (rid)
"""

#: crc32 has no function in DuckDB: a table of the remainders of single bytes, then one step a byte.
_CRC_TABLE = "crc_table AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crcs FROM range(256) AS t(i))"


def _crc32(text: str) -> str:
    """crc32 of a text of code points below 2048, as UTF-8; needs crc_table in FROM."""
    octets = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"


PERIODIC_RUNS = rf"""
WITH {_CRC_TABLE},
doc AS (SELECT doc_id, string_split_regex(text, '[\x20\x09-\x0D]+') AS parts, {_crc32("doc_id::VARCHAR")} AS h FROM documents, crc_table),
split AS (SELECT doc_id, h, h // 10 AS g, coalesce(list_filter(parts, lambda w: w <> ''), []) AS words FROM doc),
place AS (SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN g % len(words) ELSE len(words) END AS a FROM split),
edited AS (SELECT doc_id, words, n, a, 1 + (n - a) // (3 + g % 8) AS p FROM place),
word AS (SELECT doc_id, n, i, words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS w FROM (SELECT *, unnest(range(n)) AS i FROM edited)),
pair AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM word AS x JOIN word AS y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
island AS (SELECT doc_id, q, min(i) AS first, max(i) + q + 1 AS past FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, first, past - first AS length, q AS period FROM island AS x WHERE NOT EXISTS (SELECT 1 FROM island AS y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.first <= x.first AND y.past >= x.past)),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(first || ',' || length || ',' || period || chr(10), '' ORDER BY first, period) AS lines FROM run GROUP BY doc_id),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, first, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first + period, first + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, first AS start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256, e.n::BIGINT AS n_words
FROM edited AS e LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SPELLING_VARIANTS = f"""
WITH RECURSIVE {_CRC_TABLE},
found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
here AS (SELECT doc_id, run, count(*) AS n FROM found GROUP BY ALL),
hashed AS (SELECT run, n, CASE WHEN doc_id IS NULL THEN 1 ELSE {_crc32("doc_id || ':' || run")} END AS h FROM here, crc_table),
edited AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
word AS (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM word)),
near AS (SELECT DISTINCT * FROM (
  SELECT a.word, b.word AS other, a.n, b.n AS other_n FROM cut AS a JOIN cut AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT c.word, w.word, c.n, w.n FROM cut AS c JOIN word AS w ON c.rest = w.word
  UNION ALL SELECT w.word, c.word, w.n, c.n FROM cut AS c JOIN word AS w ON c.rest = w.word)),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
form AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM word LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM form UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON form.word = chain.root WHERE form.form IS NOT NULL)
SELECT form.word, form.form, chain.root, form.n, form.n_near, form.form_n FROM form JOIN chain USING (word) JOIN form AS top ON top.word = chain.root WHERE top.form IS NULL
"""
