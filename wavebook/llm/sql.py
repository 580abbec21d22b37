"""DuckDB SQL for the queries it can express."""

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS place,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""

URL_FILTER = r"""
WITH a AS (
  SELECT page_id, url,
         CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM a),
j AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
  END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""


def mix_sql(documents: str = "documents") -> str:
    """Rows of ``documents`` with the words the mixture takes, the slots written out."""
    return rf"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')) AS digest
  FROM {documents}),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][CAST(place % 3 + 1 AS INTEGER)]::DOUBLE AS weight,
         CAST(source_size AS DOUBLE) * 2 AS most FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER o AS nth
  FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
f AS (SELECT arg_min(level, nth) AS found FROM l WHERE level * weight <= most),
t AS (
  SELECT source, source_size, least(most, coalesce(found * weight, most)) AS target
  FROM l CROSS JOIN (SELECT (SELECT found FROM f) AS found)),
b AS (
  SELECT *, greatest(1, CAST(ceil(sum(target) OVER () / 262144) AS BIGINT)) AS words,
         sum(target) OVER () AS all_words
  FROM t),
u AS (
  SELECT *, CAST(floor(sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) / all_words * 4294967296.0) AS BIGINT) AS upto,
         row_number() OVER (ORDER BY source DESC NULLS FIRST) = 1 AS final
  FROM b WHERE target > 0),
i AS (
  SELECT *, coalesce(lag(upto) OVER (ORDER BY source NULLS LAST), 0) AS low,
         CASE WHEN final THEN 4294967296 ELSE upto END AS high FROM u),
p AS (SELECT range AS slot, (range * 2654435769) % 4294967296 AS point FROM range(262144)),
k AS (
  SELECT i.source, i.source_size, i.words, row_number() OVER (PARTITION BY i.source ORDER BY slot) - 1 AS rank
  FROM p JOIN i ON point >= low AND point < high AND slot < ceil(all_words / words)),
c AS (
  SELECT source, words, rank % CAST(ceil(source_size / words) AS BIGINT) AS block, count(*) AS uses
  FROM k WHERE rank < CAST(ceil(source_size / words) AS BIGINT) * 2 GROUP BY ALL),
e AS (
  SELECT *, coalesce(sum(uses * words) OVER (PARTITION BY source ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_before,
         sum(uses * words) OVER (PARTITION BY source) AS all_used
  FROM c),
q AS (
  SELECT d.*, b.source_size, b.target, b.words,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
z AS (SELECT source, max(all_used) AS all_used FROM e GROUP BY source)
SELECT q.doc_id, q.size, q.source_size, q.target,
       CAST(CASE WHEN size > 0 THEN coalesce(y.used_before + y.uses * (start + size - (start + size - 1) // q.words * q.words), coalesce(z.all_used, 0))
            - coalesce(x.used_before + x.uses * (start - start // q.words * q.words), coalesce(z.all_used, 0)) ELSE 0 END AS BIGINT) AS taken,
       CAST(CASE WHEN size > 0 THEN coalesce(x.uses, 0) ELSE 0 END AS INTEGER) AS copies
FROM q
LEFT JOIN e x ON q.source IS NOT DISTINCT FROM x.source AND CAST(start // q.words AS BIGINT) = x.block
LEFT JOIN e y ON q.source IS NOT DISTINCT FROM y.source AND CAST((start + size - 1) // q.words AS BIGINT) = y.block
LEFT JOIN z ON q.source IS NOT DISTINCT FROM z.source
"""


MIX = mix_sql()

DECONTAMINATE = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE item_id IS NOT NULL),
w AS (
  SELECT DISTINCT item, least(10, len(words)) AS size, words[i : i + least(10, len(words)) - 1] AS part
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
d AS (
  SELECT doc_id, row_number() OVER () AS row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
p AS (
  SELECT row, size, i, words[i : i + size - 1] AS part
  FROM (SELECT row, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM w) WHERE len(words) >= size)),
m AS (SELECT row, i, p.size, item FROM p JOIN w ON p.part = w.part),
h AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS k FROM m) GROUP BY row),
t AS (
  SELECT row, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT row, item FROM m) GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN t USING (row)
"""

HARD_NEGATIVES = r"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, other NULLS LAST) AS n
  FROM s WHERE same QUALIFY n <= 5)
SELECT p.anchor_id, p.other AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.r, p.n ORDER BY s.score DESC, s.other NULLS LAST) AS INTEGER) AS rank,
       s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""

FILL_IN_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
h AS (
  SELECT *, len(units) AS n,
         CAST('0x' || substring(digest, 1, 8) AS BIGINT) % (len(units) + 1) AS one,
         CAST('0x' || substring(digest, 9, 8) AS BIGINT) % (len(units) + 1) AS two,
         CAST('0x' || substring(digest, 17, 8) AS BIGINT) % 100 AS three,
         CAST('0x' || substring(digest, 25, 8) AS BIGINT) % 100 AS four
  FROM d),
f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR three >= 90
                 THEN 'plain' WHEN four < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1 : least(one, two)], '') AS prefix,
         array_to_string(units[least(one, two) + 1 : greatest(one, two)], '') AS middle,
         array_to_string(units[greatest(one, two) + 1 :], '') AS suffix
  FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CAST(CASE WHEN form <> 'plain' THEN length(prefix) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN length(middle) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""
