"""DuckDB statements for the corpus queries that SQL can express."""

FILTER_AUDIT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS least_id FROM texts GROUP BY t),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(words.t, '[^A-Z]', '', 'g')) > 5 * length(words.t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(words.t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN words.doc_id > least_id THEN 'E' ELSE '' END AS fails
  FROM words JOIN firsts ON words.t = firsts.t LEFT JOIN marks ON words.doc_id = marks.doc_id),
counts AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, filter_order[step:step] AS f, filter_order[1:step - 1] || '_' AS before
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
met AS (
  SELECT c.*, s.*, contains(fails, f) AS hit, regexp_matches(fails, '[' || before || ']') AS earlier FROM counts c, steps s),
summed AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (NOT hit AND NOT earlier), 0) AS kept,
         coalesce(sum(n) FILTER (hit AND NOT earlier), 0) AS removed,
         coalesce(sum(n) FILTER (hit AND earlier), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
         coalesce(sum(good) FILTER (hit AND NOT earlier), 0) AS good_lost,
         coalesce(sum(bad) FILTER (hit AND NOT earlier), 0) AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed"""

PREFIX_TRIE = r"""
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM numbered GROUP BY conv_id),
crc_table AS (
  SELECT list(list_reduce([CAST(i AS BIGINT)] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) g(i)),
plan AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                         lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM sizes, crc_table),
rebuilt AS (
  SELECT p.conv_id, b.pos, b.r, b.t FROM plan p JOIN numbered b ON b.conv_id = p.base AND b.pos <= p.h
  UNION ALL
  SELECT p.conv_id, o.pos - p.h + least(p.h, coalesce(s.n, 0)), o.r, o.t
  FROM plan p JOIN numbered o ON o.conv_id = p.conv_id AND o.pos > p.h LEFT JOIN sizes s ON s.conv_id = p.base),
paths AS (
  SELECT conv_id, pos AS depth, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words,
         string_agg(md5(length(r) || ':' || r || ':' || t), '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM sizes),
nodes AS (
  SELECT depth, path, any_value(words) AS words, count(*) AS n_convs, min(conv_id) AS conv_id FROM paths GROUP BY depth, path),
children AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
ends AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, max_by(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path),
full_nodes AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.path = n.path),
subtrees AS (
  SELECT left(path, 32 * d) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes) GROUP BY 1)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, CAST(a.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
       coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM full_nodes a JOIN subtrees s ON s.path = a.path LEFT JOIN ends e ON e.path = a.path
LEFT JOIN nodes p ON p.depth = a.depth - 1 AND p.path = left(a.path, 32 * (a.depth - 1))"""

WARC_REVISIT = """
WITH payloads AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, sha256(coalesce(html, '')) AS payload_digest,
         CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM firsts"""

SUFFIX_DEDUP = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
pieces AS (
  SELECT rid, q * 400 AS first, substr(h, q * 800 + 1, 1198) AS piece
  FROM (SELECT rid, h, unnest(range(0, CAST(strlen(h) // 800 AS BIGINT) + 1)) AS q FROM docs)),
spots AS (
  SELECT rid, first + o AS pos, md5_number(substr(piece, 2 * o + 1, 400)) AS s
  FROM (SELECT rid, first, piece, unnest(range(0, least(400, CAST(strlen(piece) // 2 AS BIGINT) - 199))) AS o FROM pieces)),
repeats AS (SELECT s FROM spots GROUP BY s HAVING count(*) > 1),
hits AS (SELECT rid, pos FROM spots SEMI JOIN repeats USING (s)),
gaps AS (SELECT rid, pos, CASE WHEN pos <= 200 + lag(pos) OVER w THEN 0 ELSE 1 END AS opens FROM hits WINDOW w AS (PARTITION BY rid ORDER BY pos)),
runs AS (
  SELECT rid, min(pos) AS a, max(pos) + 200 AS b
  FROM (SELECT rid, pos, sum(opens) OVER (PARTITION BY rid ORDER BY pos) AS run FROM gaps) GROUP BY rid, run),
cut AS (
  SELECT rid, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY rid)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(starts) + 2),
         lambda k: substr(h, 2 * coalesce(ends[k - 1], 0) + 1, 2 * (coalesce(starts[k], strlen(h) // 2) - coalesce(ends[k - 1], 0)))), '') END)) AS kept_sha256
FROM docs LEFT JOIN cut USING (rid)"""

NGRAM_JACCARD = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, md5(coalesce(text, '')) AS digest,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT digest, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) END) AS g
  FROM (SELECT digest, any_value(w) AS w FROM texts GROUP BY digest)),
sized AS (SELECT digest, len(g) AS n, g FROM grams),
shingles AS (SELECT digest, n, md5_number(unnest(g)) AS s FROM sized),
linked AS (
  SELECT a.digest AS x, b.digest AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.digest < b.digest
   AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
  GROUP BY a.digest, b.digest, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reached AS (
  SELECT digest AS x, digest AS y FROM sized WHERE n > 0
  UNION SELECT r.x, e.y FROM reached r JOIN edges e ON r.y = e.x),
ids AS (SELECT digest, min(doc_id) AS least_id FROM texts GROUP BY digest),
classes AS (SELECT x AS digest, min(least_id) AS component_id FROM reached JOIN ids ON ids.digest = reached.y GROUP BY x)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM texts JOIN sized USING (digest) LEFT JOIN classes USING (digest)"""

DECONTAMINATION = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT row_number() OVER () AS iid, coalesce(CAST(item_id AS VARCHAR), 'null') AS name, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT iid, name, size, q, array_to_string(w[q:q + size - 1], ' ') AS gram
  FROM (SELECT iid, name, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS q FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT rid, size, p, array_to_string(w[p:p + size - 1], ' ') AS gram
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT DISTINCT rid, size, p, gram FROM grams SEMI JOIN windows USING (size, gram)),
hit AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(p, p + size)) AS pos FROM found) GROUP BY rid),
placed AS (SELECT rid, size, p, q, iid, name FROM found JOIN windows USING (size, gram)),
named AS (
  SELECT rid, count(*) AS n_items, sha256(string_agg(name, ',' ORDER BY name)) AS items_sha256
  FROM (SELECT DISTINCT rid, name FROM placed) GROUP BY rid),
runs AS (
  SELECT rid, name, min(p) - 1 AS first, size + count(*) - 1 AS longest
  FROM (SELECT *, p - row_number() OVER (PARTITION BY rid, iid, size, p - q ORDER BY p) AS run FROM placed)
  GROUP BY rid, iid, name, size, p - q, run),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY longest DESC, first, name) = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
       CAST(coalesce(longest, 0) AS BIGINT) AS longest, best.name AS longest_item, CAST(first AS BIGINT) AS longest_start
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid) LEFT JOIN best USING (rid)"""
