WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS (
  SELECT rid, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS x FROM kept, unnest(range(0, 16)) AS u(part)
), book0 AS (
  SELECT part, rid AS entry, x FROM cut WHERE rid < 64
), dist0 AS (
  SELECT r.rid, r.part, b.entry, list_sum(list_transform(range(1, len(r.x) + 1), lambda j: (r.x[j] - b.x[j]) * (r.x[j] - b.x[j])))::HUGEINT AS d
  FROM cut r JOIN book0 b ON b.part = r.part
), near0 AS (
  SELECT rid, part, (min(d * 256 + entry) % 256)::BIGINT AS entry, min(d) AS d FROM dist0 GROUP BY rid, part
), sums0 AS (
  SELECT n.part, n.entry, j, count(*)::HUGEINT AS n, sum(r.x[j])::HUGEINT AS s
  FROM near0 n JOIN cut r ON r.rid = n.rid AND r.part = n.part, unnest(range(1, len(r.x) + 1)) AS u(j)
  GROUP BY 1, 2, 3
), means0 AS (
  SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM sums0 GROUP BY part, entry
), book1 AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book0 b LEFT JOIN means0 m ON m.part = b.part AND m.entry = b.entry
), dist1 AS (
  SELECT r.rid, r.part, b.entry, list_sum(list_transform(range(1, len(r.x) + 1), lambda j: (r.x[j] - b.x[j]) * (r.x[j] - b.x[j])))::HUGEINT AS d
  FROM cut r JOIN book1 b ON b.part = r.part
), near1 AS (
  SELECT rid, part, (min(d * 256 + entry) % 256)::BIGINT AS entry, min(d) AS d FROM dist1 GROUP BY rid, part
), sums1 AS (
  SELECT n.part, n.entry, j, count(*)::HUGEINT AS n, sum(r.x[j])::HUGEINT AS s
  FROM near1 n JOIN cut r ON r.rid = n.rid AND r.part = n.part, unnest(range(1, len(r.x) + 1)) AS u(j)
  GROUP BY 1, 2, 3
), means1 AS (
  SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM sums1 GROUP BY part, entry
), book2 AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book1 b LEFT JOIN means1 m ON m.part = b.part AND m.entry = b.entry
), dist2 AS (
  SELECT r.rid, r.part, b.entry, list_sum(list_transform(range(1, len(r.x) + 1), lambda j: (r.x[j] - b.x[j]) * (r.x[j] - b.x[j])))::HUGEINT AS d
  FROM cut r JOIN book2 b ON b.part = r.part
), near2 AS (
  SELECT rid, part, (min(d * 256 + entry) % 256)::BIGINT AS entry, min(d) AS d FROM dist2 GROUP BY rid, part
), coded AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d) AS error FROM near2 GROUP BY rid
), digest AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2
)
SELECT k.vec_id, c.code, c.error::BIGINT AS error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, codebooks_sha256
FROM kept k JOIN coded c ON c.rid = k.rid, digest
