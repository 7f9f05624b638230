"""The text operators that SQL can express, for DuckDB."""

from __future__ import annotations

from .licenses import BREAK, COSINE, FILE_SHARE, MOST_TERMS, SPLIT, TEMPLATES, TRIGGER
from .url_filter import ORACLE_SQL as URL_FILTERS

EMBEDDINGS = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(c.low, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(c.low, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) n ON n.a = v.vec_id LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) c ON c.a = v.vec_id
"""

MIXING = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, length(text) AS n, length(text) - length(translate(text, '#*$%&|<>', '')) AS s,
  (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) * pow(2::DOUBLE, coalesce(CASE WHEN s * 100 <= n THEN 0 WHEN s * 25 <= n THEN 1 WHEN s * 10 <= n THEN 2 ELSE 3 END, 0)) AS key FROM d),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM k GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, (3 * source_size)::DOUBLE / (CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END) AS ratio FROM g),
f AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / sum(w) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN level > ratio THEN (3 * source_size)::DOUBLE ELSE (SELECT arg_min(level, (ratio, rank)) FROM f WHERE NOT level > ratio) * w END AS target FROM f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
c AS (SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, CAST(floor(b.target) AS BIGINT) - b.epochs * b.source_size - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target, CAST(epochs * size + greatest(0, least(size, room)) AS BIGINT) AS taken FROM c
"""

_ROWS = ", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(TEMPLATES))
_TERMS = f"list_filter(regexp_split_to_array(lower({{}}), '{SPLIT}'), lambda x: x <> '')"
_WORDS = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"

LICENSES = rf"""
WITH tpl(template, license, statement) AS (VALUES {_ROWS}),
files AS (SELECT doc_id, coalesce(source, '-') || '/' || coalesce(lang, '-') AS dir, coalesce(text, '') AS text FROM documents),
tt AS (SELECT template, license, term, count(*)::DOUBLE AS tf FROM (SELECT template, license, unnest({_TERMS.format("statement")}) AS term FROM tpl) GROUP BY ALL),
known AS (SELECT DISTINCT term FROM tt),
n AS (SELECT count(*)::DOUBLE AS n FROM files),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TERMS.format("text")}) AS term FROM files) JOIN known USING (term) GROUP BY term),
idf AS (SELECT term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM known LEFT JOIN df USING (term), n),
tv AS (SELECT template, license, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS norm FROM tt JOIN idf USING (term)),
told AS (SELECT doc_id, text, regexp_split_to_array(text, '{BREAK}') AS parts FROM files WHERE regexp_matches(lower(text), '{TRIGGER}')),
raw AS (SELECT doc_id, 0 AS kind, unnest(string_split(text, chr(10))) AS line FROM told
  UNION ALL SELECT doc_id, 1, line FROM (SELECT doc_id, unnest(parts) AS line FROM told) WHERE contains(line, chr(10)) AND len({_TERMS.format("line")}) <= {MOST_TERMS}
  UNION ALL SELECT doc_id, 2, text FROM told WHERE len(parts) > 1 AND len({_TERMS.format("text")}) <= {MOST_TERMS}),
li AS (SELECT DISTINCT doc_id, kind, line FROM raw WHERE regexp_matches(lower(line), '{TRIGGER}')),
lt AS (SELECT line, term, count(*)::DOUBLE AS tf FROM (SELECT line, unnest({_TERMS.format("line")}) AS term FROM (SELECT DISTINCT line FROM li)) GROUP BY ALL),
lv AS (SELECT line, term, tf * coalesce(idf, ln(n + 1) + 1) AS w FROM lt LEFT JOIN idf USING (term), n),
ln AS (SELECT line, sqrt(sum(w * w)) AS norm FROM lv GROUP BY line),
s AS (SELECT lv.line, license, template, round(sum(lv.w * tv.w / tv.norm) / any_value(ln.norm), 9) AS cosine FROM lv JOIN tv USING (term) JOIN ln ON ln.line = lv.line GROUP BY ALL),
best AS (SELECT line, max((cosine, license)) AS b FROM s GROUP BY line HAVING max(cosine) >= {COSINE}),
kinds AS (SELECT doc_id, kind, max((b[1], b[2], line)) AS m, sum({_WORDS.format("line")}) AS words FROM li JOIN best USING (line) GROUP BY ALL),
own AS (SELECT doc_id, max(m) AS m, max(words) AS words FROM kinds GROUP BY doc_id),
spk AS (SELECT dir, max(m) AS g FROM own JOIN files USING (doc_id) WHERE words >= {FILE_SHARE} * {_WORDS.format("text")} GROUP BY dir)
SELECT f.doc_id, coalesce(o.m[2], g[2]) AS license, coalesce(o.m[1], g[1]) AS cosine, coalesce(o.m[3], g[3]) AS line, CASE WHEN o.m IS NOT NULL THEN 'own' WHEN g IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  CASE WHEN o.m IS NOT NULL OR g IS NOT NULL THEN f.dir END AS folder
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN spk ON spk.dir = f.dir
"""


def sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": EMBEDDINGS, "op3_license_scans": LICENSES, "op4_mix_sources": MIXING, "op9_url_filters": URL_FILTERS}
