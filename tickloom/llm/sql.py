"""DuckDB SQL for the queries of this subpackage."""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2_LINE_DEDUP = r"""
WITH d AS (SELECT coalesce(doc_id, -9223372036854775808) AS did, doc_id, coalesce(text, '') AS body FROM documents),
parts AS (SELECT did, body, string_split(body, chr(10)) AS lines FROM d),
l AS (SELECT did, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts),
k AS (SELECT did, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(did) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT did) >= 2),
j AS (SELECT k.did, k.line, k.pos, (s.key IS NOT NULL AND k.did <> s.first) AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT nullif(did, -9223372036854775808) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY did
"""

OP5_QUALITY_RULES = (
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body, """
    + _WORDS
    + r""" AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS wl FROM documents),
n AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(body, '[^A-Z]+', '', 'g')) AS n_capitals,
    length(regexp_replace(body, '[^!]+', '', 'g')) AS n_exclamations,
    len(wl)::BIGINT AS n_word_lines, (len(wl) - len(list_distinct(wl)))::BIGINT AS n_dup_lines FROM d),
t AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM t),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
p AS (SELECT r, count(DISTINCT x)::BIGINT AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS x FROM c WHERE n > 1) GROUP BY r),
m AS (SELECT n.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM n LEFT JOIN p USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > word_chars THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 40 * n_word_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_capitals > word_chars THEN 64 ELSE 0 END
    + CASE WHEN 20 * n_exclamations > word_chars THEN 128 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
    fail_bits = 0 AS kept, fail_bits FROM b
"""
)

OP1_TOPK_SEARCH = r"""
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
u AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM e),
v AS (SELECT vec_id, i, floor(1024 * x::DOUBLE)::BIGINT AS x FROM u),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id
    WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP11_HARD_NEGATIVES = r"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS MATERIALIZED (SELECT r, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM e),
u AS MATERIALIZED (SELECT r, i, floor(256 * e::DOUBLE)::BIGINT AS x FROM v),
a AS MATERIALIZED (SELECT r AS ar, i, x AS ax FROM u WHERE r IN (SELECT r FROM e WHERE vec_id % 50 = 0)),
s AS MATERIALIZED (SELECT ar, u.r, sum(ax * x)::BIGINT AS score FROM a JOIN u USING (i) WHERE ar <> u.r GROUP BY ar, u.r),
t AS MATERIALIZED (SELECT s.ar, q.vec_id AS anchor_id, s.r, c.vec_id, score, q.label = c.label AS same
    FROM s JOIN e q ON q.r = s.ar JOIN e c ON c.r = s.r),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS n FROM t WHERE same),
m AS (SELECT p.ar, p.anchor_id, p.r AS pr, p.vec_id AS positive_id, p.score AS positive_score, t.vec_id AS negative_id, t.score AS negative_score
    FROM p JOIN t ON p.ar = t.ar AND NOT t.same AND 50 * p.score <= 100 * t.score AND 100 * t.score <= 95 * p.score WHERE p.n <= 5),
k AS (SELECT *, row_number() OVER (PARTITION BY ar, pr ORDER BY negative_score DESC, negative_id)::INTEGER AS rank FROM m)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM k WHERE rank <= 3
"""

OP12_WARC = r"""
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY page_id NULLS LAST) > 1 AND n >= 100 AS again,
    min(page_id) OVER (PARTITION BY digest) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN again THEN first_id END AS refers_to FROM r
"""

OP10_SUBSTRING_DEDUP = (
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, """
    + _WORDS
    + r""" AS w FROM documents),
s AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM s),
t AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM h JOIN t USING (h)),
a AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
k AS (SELECT a.r, string_agg(word, ' ' ORDER BY a.j) FILTER (WHERE g.j IS NULL) AS kept, count(g.j) AS n_removed
    FROM a LEFT JOIN g ON a.r = g.r AND a.j = g.j GROUP BY a.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
)


def _clustering(k: int = 40, rounds: int = 5) -> str:
    steps = [
        r"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS (SELECT r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v,
    sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h FROM e),
l AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
f AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM v),
c0 AS MATERIALIZED (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM f WHERE c < %d)"""
        % k
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""
d{n} AS (SELECT l.r, c, sum((l.x - c{n}.x) * (l.x - c{n}.x))::BIGINT AS d FROM l JOIN c{n} USING (i) GROUP BY l.r, c),
a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY r)"""
        )
        if n < rounds:
            steps.append(
                f"""
m{n} AS (SELECT c, i, sum(l.x)::BIGINT AS s, count(*) AS n FROM l JOIN a{n} USING (r) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{n} LEFT JOIN m{n} USING (c, i))"""
            )
    return (
        ",".join(steps)
        + f""",
t AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
    (sum(a.d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} a JOIN t USING (c) JOIN v USING (r)
"""
    )


OP13_CENTROID_CLUSTERING = _clustering()
