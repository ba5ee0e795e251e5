"""SQL of the queries that another engine can express. The others are tested against brute force in tests/llm."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM split),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM lines),
held AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT d.doc_id, line, k, coalesce(d.doc_id <> first_doc, false) AS gone FROM keyed d LEFT JOIN held h ON d.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""

SUBSTRING_DEDUP = """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM starts),
firsts AS (SELECT x, min(doc_id) AS first_doc FROM windows GROUP BY x HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM windows JOIN firsts USING (x) WHERE doc_id > first_doc),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM words),
kept AS (SELECT e.doc_id, count(g.place) AS n_removed, string_agg(word, ' ' ORDER BY e.place) FILTER (g.place IS NULL) AS t FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.place = g.place GROUP BY e.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

_TERMS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = f"""
WITH words AS (SELECT doc_id, {_TERMS} AS w FROM documents), items AS (SELECT item_id::VARCHAR AS item, {_TERMS} AS w FROM benchmark WHERE item_id IS NOT NULL),
begins AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM begins),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n),
hits AS (SELECT doc_id, item, i, s.n FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM spots) s JOIN wanted v ON s.x = v.x AND s.n = v.n),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS found FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(found, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id LEFT JOIN named m ON w.doc_id = m.doc_id
"""

#: Sources by cap for each unit of weight: the first that what is left would not lift above its cap gives the common level.
MIXING = """
WITH rows_ AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(concat_ws(':', '7', doc_id)) AS turn FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY 1),
weighted AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sizes),
filled AS (SELECT *, 3.0::DOUBLE * source_size / weight AS level, ((SELECT sum(source_size) FROM sizes)::DOUBLE - coalesce(sum(3 * source_size) OVER before, 0)) / sum(weight) OVER rest AS unit FROM weighted
    WINDOW before AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rest AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
water AS (SELECT unit AS shared FROM filled WHERE level >= unit ORDER BY level, source LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN level < shared THEN 3.0::DOUBLE * source_size ELSE weight * shared END AS target FROM filled, water),
queued AS (SELECT r.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM rows_ r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
sent AS (SELECT q.*, c AS copy, (source_size * c + before + size)::DOUBLE / target AS finish FROM queued q, range(3) x(c) WHERE size > 0 AND target > 0),
ordered AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, copy, before, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM sent),
taken AS (SELECT doc_id, source, before, sum(size)::BIGINT AS taken FROM ordered WHERE upto <= (SELECT sum(target) FROM targets) + 1e-6 GROUP BY 1, 2, 3)
SELECT q.doc_id, q.source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id AND q.source IS NOT DISTINCT FROM t.source AND q.before = t.before
"""

#: Trie nodes are the distinct lists of turns; every node is compared with each of its beginnings. CRC-32 goes bit by bit: an operation of the list brings in a byte, or (-1) shifts once.
PREFIX_TRIE = """
WITH turns AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, r, substr(sha256(length(r) || ':' || r || x), 1, 32)) AS t FROM turns GROUP BY c),
coded AS (SELECT c, t, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END) AS crc FROM own),
sized AS (SELECT c, t, xor(crc, 4294967295::BIGINT) % 6 AS h FROM coded),
rebuilt AS (SELECT o.c, list_concat(coalesce(b.t[1:o.h], []), o.t[o.h + 1:]) AS t FROM sized o LEFT JOIN own b ON b.c = o.c - o.c % 100),
beginnings AS (SELECT c, d, len(t) AS n, t[1:d] AS p FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(p[d].x) END AS own_saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM beginnings GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)),
below AS (SELECT p[1:k] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(own_saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM whole) GROUP BY 1)
SELECT w.conv_id, w.d AS depth, a.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, w.ends_sha256 FROM whole w JOIN below USING (p) LEFT JOIN nodes a ON w.d > 0 AND a.p = w.p[1:w.d - 1]
"""

#: The filters' removals over all orders are summed up here as they are counted, without potentials.
FILTER_AUDIT = """
WITH rows_ AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM rows_),
known AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
failed AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > first_id, false)::INT AS mask FROM words d LEFT JOIN known k ON d.doc_id = k.doc_id),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, s AS step, filter_order[s] AS letter, 1 << (ascii(filter_order[s]) - 65) AS own, coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS earlier FROM orders, range(1, 6) x(s)),
cells AS (SELECT part, filter_order, step::INT AS step, letter, coalesce(sum(n) FILTER (mask & (earlier + own) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier = 0), 0) AS removed, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & own <> 0 AND mask & earlier = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & earlier = 0), 0) AS toxic_lost FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM cells
"""
