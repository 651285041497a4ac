"""SQL that gives the same rows as the queries it can express."""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN k.keeper <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.keeper <> d.page_id THEN k.keeper END AS refers_to
FROM d LEFT JOIN k ON k.payload_digest = d.payload_digest AND d.payload_bytes >= 1000
"""

QUALITY = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(*) AS n_repeat_words FROM (
        SELECT DISTINCT doc_id, i + o AS place FROM r, (SELECT unnest([0, 1, 2]) AS o)) GROUP BY 1),
m AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed) AS DOUBLE) AS k FROM f GROUP BY 1),
t AS (SELECT count(*) AS hosts, sum(n) AS n, sum(k) / sum(n) AS mean, sum(n * n) AS nn, sum(k / n * k) AS kk FROM h),
v AS (SELECT *, mean * (1 - mean) AS v FROM t),
o AS (SELECT *, CASE WHEN hosts >= 2 AND v > 0 AND n - nn / n - (hosts - 1) > 0
                     THEN ((kk - n * mean * mean) / v - (hosts - 1)) / (n - nn / n - (hosts - 1)) ELSE 0 END AS rho FROM v),
s AS (SELECT *, CASE WHEN rho > 0 THEN greatest(1 / least(rho, 0.999) - 1, 1e-3) END AS size FROM o),
j AS (SELECT h.source, CASE WHEN size IS NULL THEN mean ELSE (k + mean * size) / (h.n + size) END <= 0.5 AS verdict FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND verdict AS kept
FROM f JOIN j ON j.source IS NOT DISTINCT FROM f.source
"""

PREFERENCES = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
l AS (SELECT conv_id, count(*) AS size, coalesce(max(i) FILTER (WHERE role = 'assistant'), 0) AS last FROM n GROUP BY 1),
reply AS (SELECT n.conv_id, role, text FROM n JOIN l ON l.conv_id = n.conv_id AND n.i = l.last),
rej AS (SELECT n.conv_id, i, role, text FROM n JOIN l ON l.conv_id = n.conv_id WHERE last = 0 OR i < last
        UNION ALL
        SELECT l.conv_id, last AS i, role, text FROM l JOIN reply r ON r.conv_id = xor(l.conv_id, 1) WHERE last > 0),
miss AS (SELECT conv_id, min(i) AS i FROM (
           SELECT coalesce(n.conv_id, r.conv_id) AS conv_id, coalesce(n.i, r.i) AS i FROM n FULL JOIN rej r ON r.conv_id = n.conv_id AND r.i = n.i
           WHERE n.i IS NULL OR r.i IS NULL OR n.role <> r.role OR n.text <> r.text) GROUP BY 1),
c AS (SELECT l.conv_id, CAST(coalesce(m.i - 1, l.size) AS INTEGER) AS n_common FROM l LEFT JOIN miss m ON m.conv_id = l.conv_id),
x AS (SELECT conv_id, i, 'a' AS side, role, text FROM n UNION ALL SELECT conv_id, i, 'b', role, text FROM rej),
y AS (SELECT x.conv_id, i, side, role, n_common, replace(role, '<|', '< |') AS r2, replace(text, '<|', '< |') AS t2 FROM x JOIN c ON c.conv_id = x.conv_id),
z AS (SELECT *, '<|im_start|>' || r2 || chr(10) || t2 || '<|im_end|>' || chr(10) AS s FROM y),
p AS (SELECT *, CAST(sum(length(s)) OVER (PARTITION BY conv_id, side, i > n_common ORDER BY i) AS BIGINT) AS stop FROM z)
SELECT c.conv_id, c.n_common,
       coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE side = 'a' AND i <= c.n_common), '') AS prompt,
       coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE side = 'a' AND i > c.n_common), '') AS chosen,
       coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE side = 'b' AND i > c.n_common), '') AS rejected,
       coalesce(string_agg((stop - length(s) + 13 + length(r2)) || ':' || (stop - 1), ',' ORDER BY i)
                FILTER (WHERE side = 'a' AND i > c.n_common AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((stop - length(s) + 13 + length(r2)) || ':' || (stop - 1), ',' ORDER BY i)
                FILTER (WHERE side = 'b' AND i > c.n_common AND role = 'assistant'), '') AS rejected_spans
FROM c LEFT JOIN p ON p.conv_id = c.conv_id GROUP BY c.conv_id, c.n_common
"""

MIXING = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
             CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), t)), 1, 15) AS BIGINT) AS h FROM d),
r AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS w FROM s GROUP BY source),
o AS (SELECT *, sum(3 * source_size) OVER k AS cap, sum(w) OVER k AS wsum FROM r WINDOW k AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT CAST(sum(source_size) AS DOUBLE) AS total, sum(w) AS weights FROM r),
l AS (SELECT greatest(max(total / weights), max(CASE WHEN weights > wsum THEN (total - cap) / (weights - wsum) END)) AS level FROM o, t),
g AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), w * level) AS target FROM r, l),
c AS (SELECT s.*, source_size, target, CAST(sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS DOUBLE) AS upto,
             CAST(sum(size) OVER (PARTITION BY s.source, h) AS DOUBLE) AS here FROM s JOIN g ON g.source IS NOT DISTINCT FROM s.source),
p AS (SELECT *, target - (k - 1) * source_size AS budget FROM c, (SELECT unnest([1, 2, 3]) AS k)),
x AS (SELECT *, CASE WHEN budget <= 0 THEN 0 WHEN budget >= source_size THEN 1
                     WHEN upto < budget OR (upto - here < budget AND upto - budget < budget - (upto - here)) THEN 1
                     ELSE 0 END AS hit FROM p)
SELECT doc_id, size, source_size, target, CAST(size * sum(hit) AS BIGINT) AS taken FROM x GROUP BY doc_id, h, size, source, source_size, target
"""

INFILL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us,
             CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
n AS (SELECT *, len(us) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                                   WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
p AS (SELECT *, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

NEGATIVES = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
