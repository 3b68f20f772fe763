"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

_REPEATS = """
WITH RECURSIVE docs AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), windows AS (
    SELECT doc_id, i - 1 AS i, array_to_string(w[i:i + 49], ' ') AS k
    FROM docs, unnest(range(1, len(w) - 48)) AS r(i)
), marked AS (
    SELECT doc_id, i, count(*) OVER p AS times, first_value(doc_id) OVER o AS d, first_value(i) OVER o AS f
    FROM windows WINDOW p AS (PARTITION BY k), o AS (PARTITION BY k ORDER BY doc_id, i)
), twice AS (
    SELECT doc_id, i, d, d = doc_id AND f = i AS kept FROM marked WHERE times > 1
), edges AS (
    SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM twice
), numbered AS (
    SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS span FROM edges
), spans AS (
    SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b, arg_min(d, i) AS source_id FROM numbered GROUP BY ALL
), gone AS (
    SELECT doc_id, i + k AS word FROM twice, range(50) AS r(k) WHERE NOT kept
    EXCEPT
    SELECT doc_id, i + k FROM twice, range(50) AS r(k) WHERE kept
)
SELECT s.doc_id, s.span::INT AS span, s.a::INT AS first_word, s.b::INT AS end_word,
       count(g.word)::INT AS removed_words, s.source_id
FROM spans s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.word >= s.a AND g.word < s.b
GROUP BY s.doc_id, s.span, s.a, s.b, s.source_id
"""

_TOP_K = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM vectors q, vectors c
    WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

_WARC = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages
), hashed AS (
    SELECT *, list_transform(range(8), lambda i: ('0x' || substr(sha1(payload), (5 * i + 1)::BIGINT, 5))::BIGINT) AS parts
    FROM payloads
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0],
           lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM hashed
"""

_GROUPS = """
WITH RECURSIVE docs AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM docs, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS r(i)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reached AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id JOIN reached r ON r.a = d.doc_id
GROUP BY d.doc_id
"""

_COPIES = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_PHRASES = """
WITH pieces AS (
    SELECT row_number() OVER () AS piece, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS t
    FROM documents
), split AS (
    SELECT lang, list_filter(regexp_split_to_array(t, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), counts AS (
    SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS t, k, count(*) AS f
    FROM split, unnest(range(1, 5)) AS s(k), unnest(range(1, greatest(len(w) - k + 2, 1))) AS r(i) GROUP BY ALL
), often AS (
    SELECT lang, t, string_split(t, ' ') AS p, k, f FROM counts WHERE f >= 30
), held AS (
    SELECT lang, array_to_string(p[i:i + m - 1], ' ') AS t, max(f) AS longer
    FROM often, unnest(range(2, k)) AS s(m), unnest(range(1, k - m + 2)) AS r(i) GROUP BY ALL
), free AS (
    SELECT c.* FROM often c LEFT JOIN held h ON h.lang = c.lang AND h.t = c.t
    WHERE c.k > 1 AND (h.longer IS NULL OR 100 * h.longer::HUGEINT < 80 * c.f::HUGEINT)
), cuts AS (
    SELECT lang, t, f AS a, j, array_to_string(p[1:j], ' ') AS head, array_to_string(p[j + 1:k], ' ') AS rest
    FROM free, unnest(range(1, k)) AS s(j)
), scored AS (
    SELECT c.*, x.f AS l, y.f AS r, (2000000 * a::HUGEINT // (x.f + y.f))::BIGINT AS score
    FROM cuts c JOIN often x ON x.lang = c.lang AND x.t = c.head JOIN often y ON y.lang = c.lang AND y.t = c.rest
), weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, t ORDER BY score, j) = 1
), ranked AS (
    SELECT *, t AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, t) AS rank FROM weakest
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM ranked JOIN (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""

# Fixed value: the reversed polynomial of CRC-32. Pairs of equal words q apart make the stretches; a stretch that a
# stretch of a smaller period holds is no run of its own.
_RUNS = """
WITH raw AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
           xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''),
               lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
               lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS h
    FROM documents
), shaped AS (
    SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS m FROM raw
), docs AS (
    SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // m) END])
        ELSE w END AS w
    FROM shaped
), words AS (
    SELECT doc_id, n, i, w[i + 1] AS word FROM docs, unnest(range(n)) AS r(i)
), pairs AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y
    ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), stretches AS (
    SELECT doc_id, q, min(i) AS a, max(i) + q + 1 AS b
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
    GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), runs AS (
    SELECT * FROM stretches s WHERE NOT EXISTS
        (SELECT 1 FROM stretches t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.a <= s.a AND t.b >= s.b)
), told AS (
    SELECT doc_id, count(*) AS n_runs, sha256(string_agg(format('{},{},{}', a, b - a, q) || chr(10), '' ORDER BY a, q)) AS digest
    FROM runs GROUP BY doc_id
), best AS (
    SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs s WHERE s.doc_id = r.doc_id AND
        ((s.b - s.a) * r.q > (r.b - r.a) * s.q OR ((s.b - s.a) * r.q = (r.b - r.a) * s.q AND (s.a, s.q) < (r.a, r.q))))
), left_over AS (
    SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS digest FROM words w
    WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.a + r.q AND w.i < r.b) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(t.n_runs, 0)::BIGINT AS n_runs, a::BIGINT AS start, (b - a)::BIGINT AS length, q::BIGINT AS period,
       (1000 * (b - a) // q)::BIGINT AS exponent_milli, coalesce(t.digest, sha256('')) AS runs_sha256,
       coalesce(l.digest, sha256('')) AS collapsed_sha256
FROM docs d LEFT JOIN told t USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN left_over l USING (doc_id)
"""

STATEMENTS = {
    "op2_suffix_dedup": _REPEATS,
    "op4_exact_topk": _TOP_K,
    "op6_warc": _WARC,
    "op9_jaccard_join": _GROUPS,
    "op11_exact_dedup": _COPIES,
    "op12_collocations": _PHRASES,
    "op13_periodic_runs": _RUNS,
}
