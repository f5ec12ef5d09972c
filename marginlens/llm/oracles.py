"""SQL for the text queries that SQL can express, written from the definitions and not from the operators."""

WORD = r"[^\x20\x09-\x0D]+"

# Every quotient of every party is listed and ranked here; the level of the targets is found by trying every source.
MIX = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((rk - 1) % 3 + 1)::INT] AS weight, (2 * source_size)::DOUBLE / [5, 2, 1][((rk - 1) % 3 + 1)::INT] AS full_at FROM s
), levels AS (
  SELECT a.full_at, a.rk,
         (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM w) - coalesce(sum(2 * b.source_size)::BIGINT, 0))
           / ((SELECT sum(weight)::BIGINT FROM w) - coalesce(sum(b.weight)::BIGINT, 0)) AS level
  FROM w a LEFT JOIN w b ON (b.full_at, b.rk) < (a.full_at, a.rk) GROUP BY a.full_at, a.rk
), chosen AS (
  SELECT level FROM levels WHERE level <= full_at ORDER BY full_at, rk LIMIT 1
), aims AS (
  SELECT *, least((2 * source_size)::DOUBLE, (SELECT level FROM chosen) * weight) AS target FROM w
), seats AS (
  SELECT floor(sum(target) / 8 + 0.5)::BIGINT AS n FROM aims
), dealt AS (
  SELECT rk, count(*) AS seats FROM (
    SELECT rk FROM aims, (SELECT unnest(range(1, (SELECT n FROM seats) + 1)) AS k) WHERE target > 0
    ORDER BY target / (2 * k - 1) DESC, rk, k LIMIT (SELECT n FROM seats)
  ) GROUP BY rk
), placed AS (
  SELECT d.*, a.rk, a.source_size, a.target, coalesce(q.seats, 0) AS seats,
         ('0x' || substr(md5('17:shard:' || coalesce(d.doc_id::VARCHAR, '-')), 1, 8))::BIGINT % greatest(ceil(a.source_size / 131072)::BIGINT, 1) AS shard,
         ('0x' || substr(md5('17:order:' || coalesce(d.doc_id::VARCHAR, '-')), 1, 8))::BIGINT AS draw
  FROM d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source LEFT JOIN dealt q ON q.rk = a.rk
), rings AS (
  SELECT rk, shard, any_value(seats) AS seats, sum(size)::BIGINT AS ring FROM placed GROUP BY rk, shard
), quotas AS (
  SELECT r.rk, r.shard, r.ring, coalesce(q.quota, 0) AS quota,
         CASE WHEN r.ring > 0 THEN ('0x' || substr(md5('17:start:' || r.rk || ':' || r.shard), 1, 8))::BIGINT % ceil(r.ring / 8)::BIGINT * 8 ELSE 0 END AS origin
  FROM rings r LEFT JOIN (
    SELECT rk, shard, count(*) AS quota FROM (
      SELECT rk, shard, seats, row_number() OVER (PARTITION BY rk ORDER BY ring::DOUBLE / (2 * k - 1) DESC, shard, k) AS place
      FROM (SELECT rk, shard, ring, seats, unnest(range(1, seats + 1)) AS k FROM rings WHERE ring > 0)
    ) WHERE place <= seats GROUP BY rk, shard
  ) q USING (rk, shard)
), spans AS (
  SELECT p.*, q.ring, q.origin, least(q.quota * 8, 2 * q.ring) AS takes,
         coalesce(sum(size) OVER (PARTITION BY p.rk, p.shard ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM placed p JOIN quotas q USING (rk, shard)
), cut AS (
  SELECT *, CASE WHEN ring > 0 THEN takes // ring ELSE 0 END AS rounds FROM spans
)
SELECT doc_id, size, source_size, target,
       (rounds * size
        + greatest(least(a + size, origin + takes - rounds * ring) - greatest(a, origin), 0)
        + greatest(least(a + size, origin - ring + takes - rounds * ring) - greatest(a, origin - ring), 0))::BIGINT AS taken
FROM cut
"""

# Windows are compared by their text, not by hashes, and without fingerprints in between.
LINES = rf"""
WITH l AS (
  SELECT doc_id, i - 1 AS pos, ls[i] AS line, len(regexp_extract_all(ls[i], '{WORD}')) AS words
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
), s AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l WHERE words > 0
), pairs AS (
  SELECT a.doc_id, a.pos AS a, b.pos AS b, b.upto - a.upto + a.words AS held, a.words AS first_words, b.words AS last_words
  FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.words - greatest(a.words, b.words) < 50
), runs AS (
  SELECT doc_id, a, b FROM pairs WHERE held >= 50 AND (held - last_words < 50 OR held - first_words < 50)
), texts AS (
  SELECT r.doc_id, r.a, r.b, string_agg(s.line, chr(10) ORDER BY s.pos) AS content
  FROM runs r JOIN s ON s.doc_id = r.doc_id AND s.pos BETWEEN r.a AND r.b GROUP BY r.doc_id, r.a, r.b
), later AS (
  SELECT doc_id, a, b FROM (SELECT *, min((doc_id, a)) OVER (PARTITION BY content) AS origin FROM texts) WHERE (doc_id, a) <> origin
), gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM l JOIN later r ON l.doc_id = r.doc_id AND l.pos BETWEEN r.a AND r.b
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

# Every document walks through every order of the filters; nothing is counted beforehand.
AUDIT = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '{WORD}') AS ws FROM d
), f AS (
  SELECT doc_id, part, {{
    'A': len(ws) < 200,
    'B': 100 * len(list_distinct(ws)) < 50 * len(ws),
    'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)
  }} AS fails FROM w
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END) AS failed
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step::INTEGER AS step, filter_order[step] AS filter, string_split(left(filter_order, step - 1), '') AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders)
), counted AS (
  SELECT part, filter_order, step, filter,
    count(*) FILTER (NOT list_contains(failed, filter) AND NOT list_has_any(failed, before)) AS kept,
    count(*) FILTER (list_contains(failed, filter) AND NOT list_has_any(failed, before)) AS removed,
    count(*) FILTER (list_contains(failed, filter) AND list_has_any(failed, before)) AS redundant,
    count(*) FILTER (failed = [filter]) AS unique_fails,
    count(*) FILTER (good AND list_contains(failed, filter) AND NOT list_has_any(failed, before)) AS good_lost,
    count(*) FILTER (toxic AND list_contains(failed, filter) AND NOT list_has_any(failed, before)) AS toxic_lost
  FROM failing, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
"""

# CRC-32 byte by byte, with the usual table of 256 remainders made from its polynomial.
RESAMPLING = r"""
WITH remainders AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS r
), d AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS ws FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+')) AS word FROM benchmark
), dw AS (
  SELECT doc_id, unnest(ws) AS word FROM d
), known AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM b)
), crcs AS (
  SELECT word, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, len(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
    lambda c, x: xor(c >> 8, r[(xor(c, x) & 255) + 1]))) % 10000 AS bucket
  FROM known, remainders
), buckets AS (
  SELECT unnest(range(10000)) AS bucket
), s AS (
  SELECT bucket, count(*) AS s FROM dw JOIN crcs USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM b JOIN crcs USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE
                                 / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM buckets LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), weights AS (
  SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN crcs USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score::BIGINT AS score, rank
FROM scored LEFT JOIN (SELECT doc_id, rank FROM ranked WHERE rank <= 10 * n // 100) USING (doc_id)
"""

ORACLE_SQL = {
    "op2_mix_sources": MIX, "op10_line_dedup": LINES, "op12_filter_audit": AUDIT, "op13_importance_resampling": RESAMPLING,
}
