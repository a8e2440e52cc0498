"""SQL for the queries that SQL can express."""

ORACLE = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)""",
    "op3_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, role, text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   regexp_replace(regexp_replace(coalesce(text, ''), '\\', '\\\\', 'g'),
                                  '([<\[])(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\\\2', 'g') AS escaped
            FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length('<s>[INST]' || role || '[/INST]' || escaped || '</s>'))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op6_prefix_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
                   ELSE [l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] FOR i IN range(1, len(l) - 1)] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep FROM (
            SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id)),
        r AS (SELECT s.* FROM s JOIN classes USING (doc_id) WHERE doc_id = rep),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
              FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
              WHERE 100 * c >= 90 * (na.n + nb.n - c)),
        u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach AS (SELECT rep AS x, rep AS y FROM classes UNION SELECT reach.x, u.b FROM reach JOIN u ON u.a = reach.y),
        parts AS (SELECT x AS rep, min(y) AS component_id FROM reach GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN classes USING (doc_id) LEFT JOIN parts USING (rep)""",
    "op12_resampling": r"""
        WITH RECURSIVE words AS (
            SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents
            UNION ALL SELECT 'b', NULL, -row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
        f AS (SELECT kind, r, unnest(l || [l[i] || ' ' || l[i + 1] FOR i IN range(1, len(l))]) AS g FROM words),
        steps AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
                  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1
                  FROM steps WHERE k < 8),
        tab AS MATERIALIZED (SELECT i, c FROM steps WHERE k = 8),
        grams AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM f)),
        crc AS (SELECT g, x, 0 AS k, 4294967295::BIGINT AS c FROM grams
                UNION ALL SELECT g, x, k + 1, xor(crc.c >> 8, tab.c)
                FROM crc JOIN tab ON tab.i = xor(crc.c & 255, ('0x' || substr(x, 2 * k + 1, 2))::BIGINT)
                WHERE 2 * k < length(x)),
        bucket AS MATERIALIZED (SELECT g, xor(c, 4294967295) % 10000 AS b FROM crc WHERE 2 * k = length(x)),
        hits AS MATERIALIZED (SELECT kind, r, b FROM f JOIN bucket USING (g)),
        counts AS (SELECT b, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM hits GROUP BY b),
        sums AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM counts),
        gain AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (ss + 10000)) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS v
                 FROM counts, sums),
        w AS (SELECT r, count(*) AS n, sum(v)::BIGINT AS v FROM hits JOIN gain USING (b) WHERE kind = 'd' GROUP BY r),
        scored AS (SELECT id AS doc_id, len(l) AS n_words, coalesce(n, 0) AS n_features,
                          coalesce(floor(v / n), 0)::BIGINT AS weight,
                          ('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT AS h
                   FROM words LEFT JOIN w USING (r) WHERE kind = 'd'),
        full_score AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
                          count(*) FILTER (n_words >= 20) OVER () AS able FROM full_score)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS rank
        FROM ranked""",
    "op13_merkle": r"""
        WITH RECURSIVE steps AS (
            SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
            UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
        tab AS MATERIALIZED (SELECT i, c FROM steps WHERE k = 8),
        d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text FROM documents),
        crc AS (SELECT r, doc_id::VARCHAR AS x, 0 AS k, 4294967295::BIGINT AS c FROM d
                UNION ALL SELECT r, x, k + 1, xor(crc.c >> 8, tab.c)
                FROM crc JOIN tab ON tab.i = xor(crc.c & 255, ord(substr(x, k + 1, 1))::BIGINT) WHERE k < length(x)),
        marked AS (SELECT r FROM crc WHERE k = length(x) AND xor(c, 4294967295) % 5 = 0),
        parts AS (SELECT r, doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
                         || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                         || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
                         CASE WHEN r IN (SELECT r FROM marked) THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now FROM d),
        leaves AS MATERIALIZED (
            SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS changed FROM parts),
        placed AS MATERIALIZED (
            SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos,
                   count(*) OVER (PARTITION BY source) AS n FROM leaves),
        nodes AS (
            SELECT 0 AS level, tree, pos, n, leaf AS node FROM placed
            UNION ALL SELECT level + 1, tree, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos))
            FROM nodes WHERE n > 1 GROUP BY level, tree, pos // 16, n),
        all_nodes AS MATERIALIZED (SELECT * FROM nodes),
        beside AS MATERIALIZED (
            SELECT a.level, a.tree, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS pre,
                   coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS post
            FROM all_nodes a JOIN all_nodes b ON a.level = b.level AND a.tree = b.tree AND a.pos // 16 = b.pos // 16
            WHERE a.n > 1 GROUP BY a.level, a.tree, a.pos),
        walk AS (
            SELECT r, 0 AS level, tree, pos, n, changed AS acc, '' AS sibs FROM placed
            UNION ALL SELECT r, walk.level + 1, walk.tree, walk.pos // 16, (n + 15) // 16, sha256(pre || acc || post), sibs || pre || post
            FROM walk JOIN beside ON beside.level = walk.level AND beside.tree = walk.tree AND beside.pos = walk.pos WHERE n > 1),
        subroots AS MATERIALIZED (SELECT tree, node AS subroot, count(*) OVER () AS n FROM all_nodes WHERE n = 1),
        upper AS (
            SELECT 0 AS level, tree AS pos, n, subroot AS node FROM subroots
            UNION ALL SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos))
            FROM upper WHERE n > 1 GROUP BY level, pos // 16, n),
        all_upper AS MATERIALIZED (SELECT * FROM upper),
        upper_beside AS MATERIALIZED (
            SELECT a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS pre,
                   coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS post
            FROM all_upper a JOIN all_upper b ON a.level = b.level AND a.pos // 16 = b.pos // 16
            WHERE a.n > 1 GROUP BY a.level, a.pos),
        climb AS (
            SELECT r, 0 AS level, tree, tree AS pos, subroots.n, acc, sibs FROM walk JOIN subroots USING (tree) WHERE walk.n = 1
            UNION ALL SELECT r, climb.level + 1, tree, climb.pos // 16, (n + 15) // 16, sha256(pre || acc || post), sibs || pre || post
            FROM climb JOIN upper_beside ON upper_beside.level = climb.level AND upper_beside.pos = climb.pos WHERE n > 1),
        root AS (SELECT node AS root FROM all_upper WHERE n = 1)
        SELECT doc_id, leaf, subroot, root, sha256(sibs) AS proof_sha256, acc AS folded_root, acc = root AS verified
        FROM climb JOIN placed USING (r) JOIN subroots ON subroots.tree = climb.tree, root WHERE climb.n = 1""",
}
