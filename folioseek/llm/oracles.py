"""SQL twins of the queries that SQL can express."""

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_url_filter": r"""
        WITH cut AS (SELECT page_id, row_number() OVER () AS id, url, coalesce(instr(url, '://'), 0) AS k FROM pages),
        rest AS (SELECT *, CASE WHEN k > 0 THEN substr(url, k + 3) ELSE '' END AS r FROM cut),
        parts AS (
            SELECT page_id, id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(r, '^[^?#]*\?([^#]*)', 1) AS query,
                   regexp_extract(r, '(?s)^[^#]*#(.*)$', 1) AS fragment,
                   CASE WHEN k > 0 THEN translate(substr(url, 1, k - 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS scheme
            FROM rest),
        listed AS (
            SELECT *, CASE
                WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
                WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
                WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
                WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule,
                CASE WHEN length(host) + length(path) = 0 THEN [] ELSE list_filter(list_distinct(
                    ['s:' || scheme, 'f:' || regexp_replace(fragment, '[0-9]+', '0', 'g')]
                    || list_transform(string_split(host, '.'), lambda x: 'h:' || x)
                    || list_transform(string_split(regexp_replace(path, '[0-9]+', '0', 'g'), '/'), lambda x: 'p:' || x)
                    || list_transform(string_split(query, '&'), lambda x: 'q:' || string_split(x, '=')[1])), lambda x: length(x) > 2) END AS tokens
            FROM parts),
        marks AS (
            SELECT doc_id, max(coalesce(quality = 0 OR toxic = 1, quality = 0, toxic = 1)) AS bad FROM labels GROUP BY doc_id),
        known AS (SELECT id, tokens, bad FROM listed JOIN marks ON doc_id = page_id WHERE bad IS NOT NULL),
        needed AS (SELECT greatest(5, ceil(0.005 * count(*))) AS need FROM known),
        held AS (
            SELECT k, bad, unnest(tokens) AS t FROM (SELECT row_number() OVER () AS k, tokens, bad FROM known)),
        often AS (SELECT t FROM held, needed GROUP BY t, need HAVING sum(bad::INT) >= need),
        items AS (SELECT k, bad, t FROM held JOIN often USING (t)),
        grown AS (
            WITH RECURSIVE g AS (
                SELECT [t] AS s, t AS last, k, bad, sum(bad::INT) OVER (PARTITION BY t) AS blocked, count(*) OVER (PARTITION BY t) AS m FROM items
                UNION ALL
                SELECT s, last, k, bad, blocked, m FROM (
                    SELECT s, last, k, bad, sum(bad::INT) OVER (PARTITION BY s) AS blocked, count(*) OVER (PARTITION BY s) AS m
                    FROM (SELECT list_append(g.s, x.t) AS s, x.t AS last, g.k, g.bad FROM g JOIN items x ON x.k = g.k AND x.t > g.last)), needed
                WHERE blocked >= need)
            SELECT DISTINCT s, blocked, m FROM g),
        rules AS (SELECT s FROM grown WHERE blocked::DOUBLE / m >= 0.6),
        hits AS (SELECT id, count(s) AS mined FROM listed LEFT JOIN rules ON rule IS NULL AND list_has_all(tokens, s) GROUP BY id)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR mined > 0 THEN 'block' ELSE 'allow' END AS verdict, mined
        FROM listed JOIN hits USING (id)
    """,
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
        SELECT q.vec_id AS query_id,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id)::INTEGER AS rank,
               c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        QUALIFY rank <= 20
    """,
    "op10_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                   ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
        items AS (SELECT doc_id, unnest(s) AS x FROM sets),
        sizes AS (SELECT doc_id, len(s) AS n FROM sets),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM items a JOIN items b USING (x)
            JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
            WHERE a.doc_id < b.doc_id AND 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n) GROUP BY ALL),
        links AS (
            SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
            WHERE 100 * c >= 80 * (p.n + q.n - c)),
        sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, e.b FROM reach r JOIN sym e ON e.a = r.b)
        SELECT doc_id, n AS n_shingles, m AS component_id, doc_id = m AS kept
        FROM sizes JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id
    """,
    "op11_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        escaped AS (
            SELECT *, regexp_replace(regexp_replace(text, '\[(\\*)(INST\]|/INST\])', '[\\\1\2', 'g'), '<(\\*)(/s>|\|endoftext\|>)', '<\\\1\2', 'g') AS e,
                   regexp_replace(regexp_replace(role, '\[(\\*)(INST\]|/INST\])', '[\\\1\2', 'g'), '<(\\*)(/s>|\|endoftext\|>)', '<\\\1\2', 'g') AS r
            FROM turns)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(17 + length(r) + length(e))::BIGINT AS formatted_chars
        FROM escaped GROUP BY conv_id
    """,
    "op12_periodic_runs": r"""
        WITH texts AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        hashed AS (
            SELECT *, len(w) AS n, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                lambda h, c: list_reduce([xor(h, c)] || range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) AS h FROM texts),
        starts AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM hashed),
        docs AS (
            SELECT id, doc_id, n, w[:a] || list_transform(range(a, n), lambda i: w[1 + a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8))]) AS w FROM starts),
        stretches AS (SELECT id, unnest(range(0, n - 15)) AS p, unnest(list_transform(range(0, n - 15), lambda i: list_aggregate(w[i + 1:i + 16], 'string_agg', ' '))) AS s FROM docs WHERE n >= 24),
        pairs AS (SELECT x.id, x.p, y.p - x.p AS q FROM stretches x JOIN stretches y ON x.id = y.id AND x.s = y.s AND x.p < y.p),
        grouped AS (SELECT *, p - row_number() OVER (PARTITION BY id, q ORDER BY p) AS g FROM pairs),
        stretched AS (SELECT id, q, min(p) AS s, count(*) + 15 + q AS m FROM grouped GROUP BY id, q, g HAVING count(*) + 15 + q >= greatest(24, 3 * q)),
        runs AS (
            SELECT * FROM stretched r WHERE NOT EXISTS (FROM stretched o WHERE o.id = r.id AND o.q < r.q AND o.s <= r.s AND o.s + o.m >= r.s + r.m)),
        figures AS (
            SELECT id, count(*) AS n_runs, string_agg(concat(s, ',', m, ',', q, chr(10)), '' ORDER BY s, q) AS lines,
                   first({'s': s, 'm': m, 'q': q} ORDER BY m::DOUBLE / q DESC, s, q) AS best FROM runs GROUP BY id),
        gone AS (SELECT DISTINCT id, unnest(range(s + q, s + m)) AS i FROM runs),
        words AS (SELECT id, unnest(range(0, n)) AS i, unnest(w) AS word FROM docs WHERE id IN (SELECT id FROM runs)),
        kept AS (SELECT id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (id, i) GROUP BY id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.m AS length, best.q AS period, 1000 * best.m // best.q AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256,
               sha256(CASE WHEN n_runs IS NULL THEN coalesce(array_to_string(w, ' '), '') ELSE coalesce(t, '') END) AS collapsed_sha256
        FROM docs LEFT JOIN figures USING (id) LEFT JOIN kept USING (id)
    """,
}
