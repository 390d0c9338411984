"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        k AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS kept FROM p)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND kept > page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND kept > page_id THEN kept END AS refers_to
        FROM k
    """,
    "op4_mtree": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 5
    """,
    "op7_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN []::VARCHAR[] ELSE
                list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
        ), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
        ), reach AS (
            SELECT doc_id, doc_id AS root FROM s UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.doc_id
        ), least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, len(s) AS n_shingles, component_id FROM s JOIN least USING (doc_id)
    """,
    "op13_spelling": """
        WITH RECURSIVE bits AS (
            SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT)) AS t
        ), r AS (
            SELECT coalesce(doc_id::VARCHAR, '') || ':' AS head,
                unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zA-Z\u00C0-\u00FF]+')) AS run
            FROM documents
        ), d AS (SELECT head, run, length(run) AS len, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY ALL),
        u AS (
            SELECT run, len, n, flatten(list_transform(string_split(head || run, ''), lambda c:
                CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS b FROM d
        ), h AS (
            SELECT run, len, n, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x::BIGINT) & 255) + 1]), 4294967295::BIGINT)) AS h FROM u, bits
        ), w AS (
            SELECT CASE WHEN h % 97 = 0 THEN left(run, h % len) || substr(run, h % len + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1
        ), v AS (SELECT word, n FROM w WHERE length(word) >= 5 AND n >= 3),
        k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
        c AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM k),
        p AS (
            SELECT c.word AS a, v.word AS b, v.n FROM c JOIN v ON v.word = c.cut
            UNION SELECT v.word, c.word, c.n FROM c JOIN v ON v.word = c.cut
            UNION SELECT x.word, y.word, y.n FROM c x JOIN c y ON x.cut = y.cut AND x.i = y.i AND x.word <> y.word
        ), best AS (
            SELECT a AS word, count(*) AS n_near, arg_min(b, struct_pack(less := -n, b := encode(b))) AS near, max(n) AS near_n FROM p GROUP BY 1
        ), f AS (
            SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
            FROM v LEFT JOIN best USING (word)
        ), up AS (
            SELECT word, word AS top, 0 AS d FROM f UNION ALL SELECT up.word, f.form, d + 1 FROM up JOIN f ON f.word = up.top WHERE f.form IS NOT NULL
        ), root AS (SELECT word, arg_max(top, d) AS root FROM up GROUP BY 1)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)
    """,
}
