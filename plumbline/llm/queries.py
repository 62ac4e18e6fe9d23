"""The queries of this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from plumbline.llm import fingerprint, jaccard, langid, lmscore, media, mixing, packing, pii, toxicity, urlfilter

QUERIES = {
    "op1_urlfilter": urlfilter.op1_urlfilter,
    "op2_pii": pii.op2_pii,
    "op3_packing": packing.op3_packing,
    "op4_media": media.op4_media,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_fingerprint": fingerprint.op7_fingerprint,
    "op8_langid": langid.op8_langid,
    "op9_lmscore": lmscore.op9_lmscore,
    "op10_jaccard": jaccard.op10_jaccard,
}
#: The others fit models, hash, schedule or tokenize beyond SQL; tests/llm holds them against plain Python.
SQL: dict[str, str] = {
    "op9_lmscore": """WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT sum(len(w)) AS words FROM d),
p AS (SELECT doc_id, len(w) AS n, i, w[i] AS a, w[i - 1] AS b, w[i - 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT doc_id, n, i,
  count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY a, doc_id) AS k1,
  count(*) OVER (PARTITION BY a, b) - count(*) OVER (PARTITION BY a, b, doc_id) AS k2,
  count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY a, b, c, doc_id) AS k3 FROM p),
x AS (SELECT doc_id, n, i, k1, k2, k3, lag(k1) OVER (PARTITION BY doc_id ORDER BY i) AS before1, lag(k2) OVER (PARTITION BY doc_id ORDER BY i) AS before2 FROM k),
s AS (SELECT doc_id, CASE WHEN i > 2 AND k3 > 0 THEN k3 / greatest(before2, 1)
  WHEN i > 1 AND k2 > 0 THEN (CASE WHEN i > 2 THEN 0.4::DOUBLE ELSE 1::DOUBLE END) * k2 / greatest(before1, 1)
  ELSE (CASE WHEN i > 2 THEN 0.4::DOUBLE * 0.4::DOUBLE WHEN i > 1 THEN 0.4::DOUBLE ELSE 1::DOUBLE END)
    * (CASE WHEN k1 > 0 THEN k1 / greatest(1, words - n) ELSE 0.5::DOUBLE / words END) END AS score FROM x, t),
r AS (SELECT doc_id, sum(log10(score)) AS log_sum FROM s GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, round(CASE WHEN len(w) > 0 THEN log_sum / len(w) ELSE 0 END, 6) AS score, round(coalesce(log_sum, 0), 6) AS log_sum
FROM d LEFT JOIN r USING (doc_id)""",
    "op10_jaccard": """WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, ways.y FROM reach JOIN ways ON reach.r = ways.x)
SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id FROM reach JOIN n ON n.doc_id = reach.doc_id GROUP BY 1, 2""",
}
