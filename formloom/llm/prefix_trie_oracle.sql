WITH crc_table AS (
  SELECT list(v ORDER BY k) AS steps
  FROM (
    SELECT k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(0, 256))::BIGINT AS k)
  )
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS own
  FROM turns GROUP BY conv_id
), numbered AS (
  SELECT conv_id, own, conv_id - ((conv_id % 100) + 100) % 100 AS base,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])
    )) % 6 AS h
  FROM own, crc_table
), rebuilt AS (
  SELECT n.conv_id, list_concat(coalesce(b.own[1:n.h], []), n.own[n.h + 1:]) AS turns
  FROM numbered n LEFT JOIN own b ON b.conv_id = n.base
), members AS (
  SELECT conv_id, len(turns) AS size, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt
), nodes AS (
  SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '') AS ends
  FROM members GROUP BY 1, 2
), family AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.path AS parent_path
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
), kids AS (
  SELECT depth - 1 AS depth, parent_path AS path, count(*) AS n_children FROM family WHERE depth > 0 GROUP BY 1, 2
), counted AS (
  SELECT f.*, coalesce(k.n_children, 0) AS n_children,
    (f.n_convs - 1) * CASE WHEN f.depth = 0 THEN 0 ELSE length(f.path[f.depth].text) END AS own_saved
  FROM family f LEFT JOIN kids k ON k.depth = f.depth AND k.path = f.path
), above AS (
  SELECT unnest(range(0, depth + 1)) AS top, path, n_children, own_saved FROM counted
), trees AS (
  SELECT top AS depth, path[1:top] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own_saved) AS saved_tokens FROM above GROUP BY 1, 2
)
SELECT c.conv_id::BIGINT AS conv_id, c.depth::BIGINT AS depth, c.parent_conv_id::BIGINT AS parent_conv_id, c.n_convs::BIGINT AS n_convs,
  c.n_children::BIGINT AS n_children, t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN trees t ON t.depth = c.depth AND t.path = c.path
