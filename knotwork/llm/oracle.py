"""DuckDB SQL for the queries that SQL can express, over whole tables, written without the operators' code."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: All pairs that share a shingle are counted out; components by their transitive closure.
NGRAM_JOIN = f"""WITH RECURSIVE
sets AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 4 THEN [array_to_string(t, ' ')] ELSE list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' '))) END AS s FROM (SELECT doc_id, {_WORDS} AS t FROM documents)),
keyed AS (SELECT doc_id, s, len(s)::BIGINT AS n, md5(array_to_string(list_sort(s), '|')) AS key FROM sets),
classes AS (SELECT key, n, min(doc_id) AS rep, count(*) AS n_copies, any_value(s) AS s FROM keyed WHERE n > 0 GROUP BY key, n),
each AS (SELECT rep, n, unnest(s) AS x FROM classes),
links AS (SELECT u, v FROM (SELECT a.rep AS u, b.rep AS v, a.n AS na, b.n AS nb, count(*) AS k FROM each a JOIN each b USING (x) WHERE a.rep < b.rep GROUP BY ALL) WHERE 100 * k >= 85 * (na + nb - k)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u, v FROM edges UNION SELECT r.u, b.v FROM reach r JOIN edges b ON r.v = b.u),
least_ AS (SELECT u, least(u, min(v)) AS component FROM reach GROUP BY u)
SELECT k.doc_id, k.n AS n_shingles, coalesce(l.component, c.rep, k.doc_id) AS component_id, coalesce(c.n_copies, 1)::BIGINT AS n_copies
FROM keyed k LEFT JOIN classes c ON c.key = k.key AND c.n = k.n LEFT JOIN least_ l ON l.u = c.rep"""

#: Water-filling from running sums, whole copies, and the carry from class to class as a recursion.
SOURCE_MIX = r"""WITH RECURSIVE
sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '#20260'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM documents),
classed AS (SELECT *, CASE WHEN size < 16 THEN size ELSE floor(round(log2(size::DOUBLE) * 8, 6))::BIGINT - 16 END AS class FROM sized),
sources AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
filling AS (SELECT *, row_number() OVER (ORDER BY fills_at, source ASC NULLS LAST) AS place FROM (SELECT *, 3.0::DOUBLE * source_size / weight AS fills_at FROM sources)),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filling),
level AS (SELECT arg_min(level, place) AS level FROM levels WHERE level < fills_at),
targets AS (SELECT source, source_size, least(weight * coalesce((SELECT level FROM level), 'infinity'::DOUBLE), 3.0::DOUBLE * source_size) AS target FROM sources),
plan AS (SELECT *, floor(round(ratio, 9))::BIGINT AS times, greatest(ratio - floor(round(ratio, 9)), 0.0) AS part FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM targets)),
counts AS (SELECT source, class, count(*) AS docs, sum(size)::BIGINT AS words, row_number() OVER (PARTITION BY source ORDER BY class DESC) AS i FROM classed GROUP BY source, class),
due AS (SELECT source, 0::BIGINT AS i, NULL::BIGINT AS class, 0::BIGINT AS k, 0.0::DOUBLE AS carry FROM plan
  UNION ALL SELECT source, i, class, k, want - k * (words / docs) FROM (SELECT *, CASE WHEN words = 0 THEN 0 ELSE greatest(least(round(want * docs / greatest(words, 1)), docs), 0) END::BIGINT AS k
    FROM (SELECT d.source, c.i, c.class, c.docs, c.words, p.part * c.words + d.carry AS want FROM due d JOIN counts c ON c.source IS NOT DISTINCT FROM d.source AND c.i = d.i + 1 JOIN plan p ON p.source IS NOT DISTINCT FROM d.source))),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source, class ORDER BY u, doc_id, size) AS n FROM classed)
SELECT doc_id, size, source_size, round(target, 6) AS target, copies, copies * size AS taken FROM (SELECT x.doc_id, x.size, p.source_size, p.target, least(p.times + (x.n <= d.k)::BIGINT, 3) AS copies
FROM numbered x JOIN plan p ON p.source IS NOT DISTINCT FROM x.source JOIN due d ON d.source IS NOT DISTINCT FROM x.source AND d.class = x.class)"""

ORACLES = {"op1_ngram_join": NGRAM_JOIN, "op3_source_mix": SOURCE_MIX}
