"""DuckDB SQL for the queries of this folder that it can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

TOKEN_COUNTS = r"""
    WITH kept AS (
        SELECT source, lang, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS one,
               len(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS two
        FROM (SELECT *, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents)
        WHERE doc_id = first_id)
    SELECT source, lang, 'words-v1' AS tokenizer, count(*) AS n_docs, CAST(sum(one + 1) AS BIGINT) AS n_tokens FROM kept GROUP BY ALL
    UNION ALL
    SELECT source, lang, 'words-v2' AS tokenizer, count(*) AS n_docs, CAST(sum(two) AS BIGINT) AS n_tokens FROM kept GROUP BY ALL"""

DECONTAMINATION = rf"""
    WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {WORDS} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
    p AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS s
          FROM (SELECT item, w, least(len(w), 13) AS m, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
    q AS (SELECT row_no, m, i, array_to_string(w[i : i + m - 1], ' ') AS s
          FROM (SELECT row_no, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM p))),
    h AS (SELECT q.row_no, q.i, q.m, p.item FROM q JOIN p ON q.m = p.m AND q.s = p.s),
    n AS (SELECT row_no, count(DISTINCT x) AS n_hit FROM (SELECT row_no, unnest(generate_series(i, i + m - 1)) AS x FROM h) GROUP BY row_no),
    t AS (SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_no, item FROM h) GROUP BY row_no)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN n USING (row_no) LEFT JOIN t USING (row_no)"""

SUFFIX_DEDUP = """
    WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS x, len(hex(coalesce(text, ''))) // 2 AS n FROM documents),
    s AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) AS w FROM (SELECT doc_id, x, unnest(generate_series(0, n - 100)) AS i FROM d)),
    e AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
    g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k
          FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM e)),
    r AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY doc_id, k),
    c AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS after FROM r),
    j AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(x, 2 * after + 1, 2 * (lo - after)), '' ORDER BY lo) AS kept
          FROM c JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN j USING (doc_id)"""

SQL: dict[str, str] = {"op6_token_counts": TOKEN_COUNTS, "op7_decontamination": DECONTAMINATION, "op10_suffix_dedup": SUFFIX_DEDUP}
