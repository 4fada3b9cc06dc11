"""DuckDB SQL for the operators that SQL can express."""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Lower-cased words: letters, digits and all beyond ASCII.
WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+')"

SQL = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM d JOIN g USING (norm)
    """,
    "op2_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, p, substring(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d)),
        r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
        g AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS new FROM r),
        i AS (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
        s AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY ALL),
        l AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS was FROM s),
        c AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substring(h, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) AS kept FROM l JOIN d USING (doc_id) GROUP BY 1)
        SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN c USING (doc_id)
    """,
    "op4_decontamination": f"""
        WITH w AS (
            SELECT 'd' AS side, doc_id AS id, {WORDS} AS words FROM documents
            UNION ALL SELECT 'i', item_id, {WORDS} FROM benchmark
        ),
        v AS (SELECT id, least(5, len(words)) AS width FROM w WHERE side = 'i' AND len(words) > 0),
        x AS (
            SELECT side, id, words, width FROM w JOIN v USING (id) WHERE side = 'i'
            UNION ALL SELECT side, id, words, width FROM w, (SELECT DISTINCT width FROM v) WHERE side = 'd'
        ),
        s AS (
            SELECT DISTINCT side, id, array_to_string(words[i : i + width - 1], ' ') AS shingle
            FROM (SELECT side, id, words, width, unnest(range(1, len(words) - width + 2)) AS i FROM x WHERE len(words) >= width)
        ),
        n AS (SELECT id, count(*) AS n_item FROM s WHERE side = 'i' GROUP BY id)
        SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
        FROM s AS d JOIN s AS i ON d.side = 'd' AND i.side = 'i' AND d.shingle = i.shingle JOIN n ON n.id = i.id
        GROUP BY d.id, i.id HAVING count(*) >= ceil(0.8 * any_value(n_item) - 1e-9)
    """,
}
