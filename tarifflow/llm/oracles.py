"""DuckDB SQL for the operators that SQL can express."""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
      FROM documents)
WINDOW same AS (PARTITION BY text_sha256)
"""

QUALITY = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT rid, doc_id, text,
           list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM d
), tri AS (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS n
    FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), rep AS (
    SELECT rid, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY rid
), m AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
           CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
           len(lines) AS n_lines,
           len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_alpha
    FROM w LEFT JOIN rep USING (rid)
), b AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_symbols <= 10 * n_words AND 100 * n_dup_lines <= 50 * n_lines
       AND word_chars BETWEEN 2 * n_words AND 12 * n_words AND 100 * n_alpha >= 50 * n_words AS kept
FROM b
"""

URL_FILTER = r"""
WITH r AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
    SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM r
), p AS (
    SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(tail, '^[^?#]*') AS path,
           regexp_replace(regexp_replace(regexp_extract(tail, '^[^?#]*\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&+', '') AS query
    FROM h
), c AS (
    SELECT page_id, host, path,
           regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical
    FROM p
), listed AS (
    SELECT DISTINCT canonical FROM c WHERE list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills', 'casino-win'])
), rules(verdict, rhost, rpath) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
)
SELECT page_id, host, path,
       (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM rules
        WHERE (c.host = rhost OR ends_with(c.host, '.' || rhost)) AND starts_with(c.path, rpath)) AS rule,
       coalesce((SELECT arg_max(verdict, length(rhost || rpath)) FROM rules
                 WHERE (c.host = rhost OR ends_with(c.host, '.' || rhost)) AND starts_with(c.path, rpath)),
                CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM c
"""

HARD_NEGATIVES = """
WITH e AS (
    SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.rid AS arid, a.vec_id AS anchor_id, a.label = b.label AS same, b.rid, b.vec_id,
           CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM e a JOIN e b ON a.rid <> b.rid AND len(a.v) = len(b.v)
    WHERE a.vec_id % 50 = 0
), p AS (
    SELECT arid, anchor_id, rid AS prid, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id NULLS LAST, rid) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER nearest AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.arid = s.arid AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW nearest AS (PARTITION BY p.arid, p.prid ORDER BY s.score DESC, s.vec_id NULLS LAST, s.rid)
QUALIFY row_number() OVER nearest <= 3
"""

COLLOCATIONS = r"""
WITH d AS (
    SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), p AS (
    SELECT lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS w FROM d
), g AS (
    SELECT lang, m, i, w FROM p, range(1, 6) lengths(m), unnest(range(1, len(w) - m + 2)) places(i)
), f AS (
    SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS n FROM g GROUP BY ALL
), total AS (
    SELECT lang, sum(n) AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (
    SELECT lang, m, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE m >= 2 AND n >= 100
), inner_phrases AS (
    SELECT DISTINCT c.lang, array_to_string(c.w[i : i + k - 1], ' ') AS phrase, c.a
    FROM c, range(2, 5) lengths(k), unnest(range(1, c.m - k + 2)) places(i)
    WHERE k < c.m
), cuts AS (
    SELECT c.lang, c.phrase, c.a, k, l.n AS l, r.n AS r, total.n,
           CAST((1000::HUGEINT * c.a * total.n) // (l.n::HUGEINT * r.n) AS BIGINT) AS score
    FROM c, range(1, 5) cut(k), f l, f r, total
    WHERE k < c.m AND l.lang = c.lang AND r.lang = c.lang AND total.lang = c.lang
      AND l.phrase = array_to_string(c.w[1:k], ' ') AND r.phrase = array_to_string(c.w[k + 1:], ' ')
), weakest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM weakest
WHERE NOT EXISTS (FROM inner_phrases i WHERE i.lang = weakest.lang AND i.phrase = weakest.phrase AND 100 * i.a >= 100 * weakest.a)
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER best <= 2000
"""
