WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
u AS (SELECT rid, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT rid, i, x || ' ' || lead(x, 1) OVER p || ' ' || lead(x, 2) OVER p || ' ' || lead(x, 3) OVER p || ' ' || lead(x, 4) OVER p AS gram FROM u WINDOW p AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g WHERE gram IS NOT NULL) WHERE n > 1),
c AS (SELECT rid, sum(least(5, coalesce(lead_i - i, 5))) AS covered FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS lead_i FROM r) GROUP BY rid),
m AS (SELECT d.doc_id, d.lang, d.source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
      FROM d JOIN w USING (rid) LEFT JOIN c USING (rid)),
v AS (SELECT *, 1000 * n_symbols // greatest(n_words, 1) AS symbols, 10 * word_chars // greatest(n_words, 1) AS word_length,
             1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines FROM m),
h AS (SELECT lang, source, measure, value - value % CAST(pow(10, greatest(length(CAST(value AS VARCHAR)) - 4, 0)) AS BIGINT) AS bucket FROM (SELECT lang, source, unnest(['symbols', 'word_length', 'dup_lines']) AS measure, unnest([symbols, word_length, dup_lines]) AS value FROM v WHERE n_words > 0)),
lv AS (SELECT 0 AS lvl, lang AS l, source AS s, measure, bucket FROM h UNION ALL SELECT 1, lang, NULL, measure, bucket FROM h UNION ALL SELECT 2, NULL, NULL, measure, bucket FROM h),
q AS (SELECT lvl, l, s, measure, max(total) AS total, min(CASE WHEN 4 * upto >= total THEN bucket END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS q3
      FROM (SELECT *, count(*) OVER (PARTITION BY lvl, l, s, measure ORDER BY bucket RANGE UNBOUNDED PRECEDING) AS upto, count(*) OVER (PARTITION BY lvl, l, s, measure) AS total FROM lv)
      GROUP BY lvl, l, s, measure),
x AS (SELECT lvl, l, s, max(total) AS total, max(CASE WHEN measure = 'symbols' THEN q3 + greatest(3 * (q3 - q1), 100) END) AS a,
             max(CASE WHEN measure = 'word_length' THEN q3 + greatest(3 * (q3 - q1), 40) END) AS b, max(CASE WHEN measure = 'dup_lines' THEN q3 + greatest(3 * (q3 - q1), 400) END) AS c
      FROM q GROUP BY lvl, l, s),
y AS (SELECT o.l, o.s, CASE WHEN o.total >= 100 THEN o.a WHEN p.total >= 100 THEN p.a ELSE z.a END AS a, CASE WHEN o.total >= 100 THEN o.b WHEN p.total >= 100 THEN p.b ELSE z.b END AS b,
             CASE WHEN o.total >= 100 THEN o.c WHEN p.total >= 100 THEN p.c ELSE z.c END AS c
      FROM (SELECT * FROM x WHERE lvl = 0) o LEFT JOIN (SELECT * FROM x WHERE lvl = 1) p ON o.l IS NOT DISTINCT FROM p.l LEFT JOIN (SELECT * FROM x WHERE lvl = 2) z ON true),
j AS (SELECT v.*, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, coalesce(symbols > a, false) OR coalesce(word_length > b, false) OR coalesce(dup_lines > c, false) AS over_limit
      FROM v LEFT JOIN y ON v.lang IS NOT DISTINCT FROM y.l AND v.source IS NOT DISTINCT FROM y.s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT over_limit) AS kept FROM j
