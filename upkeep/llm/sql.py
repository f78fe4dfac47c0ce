"""DuckDB texts of the operators that SQL can express."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE = {
    "op3_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 20""",
    "op6_near_duplicates": f"""
        WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{SPACED}') AS w FROM documents),
        shingles AS (
          SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS s
          FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(len(w), 4) + 1)) AS i FROM docs WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id),
        links AS (
          SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
        least_of AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM docs JOIN least_of USING (doc_id) LEFT JOIN sizes USING (doc_id)""",
    "op8_substring_dedup": f"""
        WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
        spots AS (
          SELECT uid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
          FROM (SELECT uid, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM docs WHERE len(w) >= 13)),
        sources AS (SELECT s, min(doc_id) AS source FROM spots GROUP BY s),
        gone AS (
          SELECT DISTINCT uid, unnest(generate_series(i, i + 12)) AS p FROM spots JOIN sources USING (s) WHERE source < doc_id),
        words AS (SELECT uid, unnest(generate_series(1, len(w))) AS p, unnest(w) AS x FROM docs),
        kept AS (SELECT uid, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (uid, p) GROUP BY uid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (uid)""",
    "op9_decontaminate": f"""
        WITH items AS (SELECT item_id, regexp_extract_all({LOWERED}, '{LETTERS}') AS w FROM benchmark),
        docs AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all({LOWERED}, '{LETTERS}') AS w FROM documents),
        windows AS (
          SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
          FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM items WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM windows),
        spots AS (
          SELECT uid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
          FROM (SELECT uid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, sizes WHERE len(w) >= n)),
        hits AS (SELECT spots.uid, spots.i, spots.n, item_id FROM spots JOIN windows USING (n, s)),
        words AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY uid),
        found AS (
          SELECT uid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT uid, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY uid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN words USING (uid) LEFT JOIN found USING (uid)""",
    "op12_filter_audit": f"""
        WITH docs AS (
          SELECT row_number() OVER () AS uid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                 regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
        firsts AS (SELECT t, min(doc_id) AS first FROM docs GROUP BY t),
        judged AS (
          SELECT part, doc_id, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
                 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS f
          FROM docs JOIN firsts USING (t)),
        marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
        cells AS (
          SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
          FROM judged LEFT JOIN marks USING (doc_id) GROUP BY part, f),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (
          SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
          WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
        falls AS (
          SELECT part, filter_order, step, n, good, toxic, f[ascii(substr(filter_order, step, 1)) - 64] AS fails,
                 len(list_filter(f, lambda b: b)) AS n_fails,
                 coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda k: f[ascii(substr(filter_order, k, 1)) - 64])), 6) AS gone
          FROM cells, steps),
        sums AS (
          SELECT part, filter_order, step, sum(n) FILTER (WHERE gone > step) AS kept, sum(n) FILTER (WHERE gone = step) AS removed,
                 sum(n) FILTER (WHERE fails AND gone < step) AS redundant, sum(n) FILTER (WHERE fails AND n_fails = 1) AS unique_fails,
                 sum(good) FILTER (WHERE gone = step) AS good_lost, sum(toxic) FILTER (WHERE gone = step) AS toxic_lost
          FROM falls GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
               CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
               CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley
        FROM sums""",
    "op13_source_divergence": f"""
        WITH docs AS (
          SELECT row_number() OVER () AS uid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all({LOWERED}, '{TERM}') AS w FROM documents),
        words AS (SELECT uid, lang, source, unnest(w) AS term FROM docs),
        kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT uid) >= 30),
        sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        totals AS (SELECT lang, source, sum(n) AS n_all FROM counts GROUP BY ALL),
        shares AS (
          SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (coalesce(t.n_all, 0) + 5 * s.v) AS p
          FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN totals t USING (lang, source)
          LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        whole AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL),
        lang_shares AS (
          SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
          FROM whole JOIN sizes USING (lang)),
        gaps AS (
          SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
          FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN gaps ON gaps.lang = a.lang AND gaps.source = a.source AND gaps.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
        QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50""",
}
