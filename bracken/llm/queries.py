"""One query for each operator, over whole tables with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, jaccard, jpeg, licenses, packing, quality, runindex, substring, toxicity, wrappers

QUERIES = {
    "op1_suffix_dedup": runindex.suffix_dedup,
    "op2_toxicity": toxicity.toxicity,
    "op3_best_fit_packing": packing.best_fit_packing,
    "op4_bpe_round_trip": bpe.bpe_round_trip,
    "op5_license_scan": licenses.license_scan,
    "op6_html_extraction": wrappers.html_extraction,
    "op7_ngram_jaccard_join": jaccard.ngram_jaccard_join,
    "op8_quality_rules": quality.quality_rules,
    "op9_media_round_trip": jpeg.media_round_trip,
    "op10_substring_dedup": substring.substring_dedup,
}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Windows by their own text, the least doc_id of each, and runs of covered places.
_BYTES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT r, doc_id, array_slice(b, i + 1, i + 50) AS w, i FROM (SELECT r, doc_id, b, unnest(range(0, octet_length(b) - 49)) AS i FROM d WHERE doc_id IS NOT NULL)),
f AS (SELECT w, min(doc_id) AS least FROM p GROUP BY w HAVING min(doc_id) < max(doc_id)),
c AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM p JOIN f USING (w) WHERE doc_id > least),
g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS span FROM c),
s AS (SELECT r, min(i) AS first, max(i) + 50 AS stop, coalesce(lag(max(i) + 50) OVER (PARTITION BY r ORDER BY min(i)), 0) AS before FROM g GROUP BY r, span),
k AS (SELECT r, sum(stop - first) AS gone, count(*) AS spans, string_agg(hex(array_slice(b, before + 1, first)), '' ORDER BY first) || hex(array_slice(any_value(b), max(stop) + 1, octet_length(any_value(b)))) AS kept FROM s JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, hex(b)))) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""

_WINDOWS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT r, doc_id, array_to_string(w[i + 1 : i + 50], ' ') AS x, i FROM (SELECT r, doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE doc_id IS NOT NULL)),
f AS (SELECT x, min(doc_id) AS least FROM p GROUP BY x HAVING min(doc_id) < max(doc_id)),
c AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM p JOIN f USING (x) WHERE doc_id > least),
g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS span FROM c),
s AS (SELECT r, min(i) AS a, max(i) + 50 AS b, coalesce(lag(max(i) + 50) OVER (PARTITION BY r ORDER BY min(i)), 0) AS before FROM g GROUP BY r, span),
k AS (SELECT r, sum(b - a) AS gone, list_concat(flatten(list(w[before + 1 : a] ORDER BY a)), any_value(w)[max(b) + 1 :]) AS kept FROM s JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(array_to_string(coalesce(kept, w), ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""

#: All pairs of distinct sets that share a shingle, exactly; classes by walking the links from each set.
_SIMILAR = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT r, doc_id, CASE WHEN doc_id IS NULL OR len(w) = 0 THEN NULL WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS s FROM d),
n AS (SELECT row_number() OVER () AS k, s, len(s) AS size, count(*) AS rows, min(doc_id) AS least FROM g WHERE s IS NOT NULL GROUP BY s),
e AS (SELECT k, size, unnest(s) AS x FROM n),
t AS (SELECT k, size, rank_x FROM e JOIN (SELECT x, row_number() OVER () AS rank_x FROM e GROUP BY x HAVING count(*) > 1) USING (x)),
l AS (SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON a.rank_x = b.rank_x AND a.k <> b.k AND 5 * a.size >= 4 * b.size AND 5 * b.size >= 4 * a.size GROUP BY a.k, b.k, a.size, b.size HAVING 10 * count(*) >= 8 * (a.size + b.size - count(*))),
walk(k, place) AS (SELECT k, k FROM n UNION SELECT walk.k, l.b FROM walk JOIN l ON l.a = walk.place),
class AS (SELECT walk.k, min(n.least) AS class_id FROM walk JOIN n ON n.k = walk.place GROUP BY walk.k),
links AS (SELECT l.a AS k, sum(n.rows) AS others FROM l JOIN n ON n.k = l.b GROUP BY l.a)
SELECT g.doc_id, coalesce(class.class_id, g.doc_id) AS class_id, CAST(coalesce(n.rows - 1 + coalesce(others, 0), 0) AS BIGINT) AS n_links
FROM g LEFT JOIN n ON g.s = n.s LEFT JOIN class ON class.k = n.k LEFT JOIN links ON links.k = n.k"""

ORACLE_SQL: dict[str, str] = {"op1_suffix_dedup": _BYTES, "op7_ngram_jaccard_join": _SIMILAR, "op10_substring_dedup": _WINDOWS}
