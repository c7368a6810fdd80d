"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_quality_rules"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), words AS (
    SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS solid,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM docs
), places AS (
    SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3
), windows AS (
    SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS three FROM places
), twice AS (
    SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, three) >= 2
), repeated AS (
    SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), counted AS (
    SELECT d.rid, d.doc_id, d.lang, d.source, len(w)::BIGINT AS n_words, length(solid)::BIGINT AS word_chars,
        (length(solid) - length(regexp_replace(solid, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(solid) - length(regexp_replace(solid, '[!-/:-@\[-`{-~]', '', 'g')))::BIGINT AS n_marks,
        (length(solid) - length(regexp_replace(solid, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words
    FROM docs d JOIN words USING (rid) LEFT JOIN repeated r USING (rid)
), shares AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        n_symbols::DOUBLE / greatest(word_chars, 1) AS symbol_share, n_marks::DOUBLE / greatest(word_chars, 1) AS punctuation_share,
        n_capitals::DOUBLE / greatest(word_chars, 1) AS capital_share, n_dup_lines::DOUBLE / greatest(n_lines, 1) AS same_line_share,
        n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_share
    FROM counted
), long AS (
    SELECT rid, lang, source, measure, value,
        CASE WHEN value <= 1e-4 THEN 0 ELSE ceil(ln(value / 1e-4) / ln(1.02::DOUBLE))::INT END AS bucket
    FROM (UNPIVOT shares ON symbol_share, punctuation_share, capital_share, same_line_share, repeat_share INTO NAME measure VALUE value)
), sketch AS (
    SELECT lang, source, measure, bucket, count(*) AS n FROM long GROUP BY ALL
), by_lang AS (
    SELECT lang, measure, bucket, sum(n) AS lent FROM sketch GROUP BY ALL
), lang_total AS (
    SELECT lang, measure, sum(n) AS lang_n FROM sketch GROUP BY ALL
), totals AS (
    SELECT DISTINCT s.lang, s.source, s.measure, l.lang_n
    FROM sketch s JOIN lang_total l ON s.lang IS NOT DISTINCT FROM l.lang AND s.measure = l.measure
), weights AS (
    SELECT lang, source, measure, bucket, sum(w) AS w FROM (
        SELECT s.lang, s.source, s.measure, s.bucket, s.n::HUGEINT * t.lang_n AS w
        FROM sketch s JOIN totals t ON s.lang IS NOT DISTINCT FROM t.lang AND s.source IS NOT DISTINCT FROM t.source AND s.measure = t.measure
        UNION ALL
        SELECT t.lang, t.source, t.measure, b.bucket, b.lent::HUGEINT * 200
        FROM totals t JOIN by_lang b ON t.lang IS NOT DISTINCT FROM b.lang AND t.measure = b.measure
    ) GROUP BY ALL
), running AS (
    SELECT *, sum(w) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS upto,
        sum(w) OVER (PARTITION BY lang, source, measure) AS total FROM weights
), cuts AS (
    SELECT lang, source, measure, min(CASE WHEN upto * 4 >= total THEN bucket END) AS lower,
        min(CASE WHEN upto * 4 >= total * 3 THEN bucket END) AS upper FROM running GROUP BY ALL
), bounds AS (
    SELECT lang, source, measure, CASE WHEN lower <= 0 THEN 0 ELSE 1e-4 * pow(1.02::DOUBLE, lower) END AS low,
        CASE WHEN upper <= 0 THEN 0 ELSE 1e-4 * pow(1.02::DOUBLE, upper) END AS top,
        CASE measure WHEN 'symbol_share' THEN 0.05::DOUBLE WHEN 'punctuation_share' THEN 0.10::DOUBLE WHEN 'capital_share' THEN 0.15::DOUBLE
            WHEN 'same_line_share' THEN 0.30::DOUBLE ELSE 0.40::DOUBLE END AS slack
    FROM cuts
), verdicts AS (
    SELECT l.rid, bool_and(l.value <= b.top + 3 * (b.top - b.low) + b.slack) AS fits
    FROM long l JOIN bounds b ON l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source AND l.measure = b.measure
    GROUP BY l.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fits AS kept
FROM shares JOIN verdicts USING (rid)
"""

ORACLES["op3_tool_calls"] = r"""
WITH chats AS (
    SELECT conv_id, turn, role, text, length(text)::BIGINT AS n, CASE WHEN text IS NOT NULL THEN to_json(text)::VARCHAR END AS whole
    FROM conversations
), calls AS (
    SELECT conv_id, turn, n, 'c' || conv_id || '-' || turn AS call_id, turn // 2 AS needs,
        CASE turn % 4 WHEN 1 THEN 'measure' WHEN 2 THEN 'translate' ELSE 'search' END AS name,
        CASE WHEN turn > 0 THEN '"after":"${c' || conv_id || '-' || (turn // 2) || '}"' END AS after, whole
    FROM chats WHERE role = 'user'
), replies AS (
    SELECT conv_id, turn, whole, 'c' || conv_id || '-' || (turn - 1) AS call_id FROM chats WHERE role = 'assistant'
), filled AS (
    SELECT *, '{' || CASE name
        WHEN 'search' THEN concat_ws(',', after, '"limit":' || (n % 60), '"query":' || whole)
        WHEN 'measure' THEN concat_ws(',', after, CASE WHEN n % 5 <> 0 THEN '"length":' || n END,
            CASE WHEN n % 5 = 0 THEN '"size":"' || n || '"' END,
            '"unit":"' || CASE WHEN n % 2 = 0 THEN 'words' WHEN n % 3 = 0 THEN 'bytes' ELSE 'chars' END || '"')
        ELSE concat_ws(',', '"rate":1.5,"target":"en"', '"text":' || whole) END || '}' AS arguments,
        concat_ws(',',
            CASE WHEN name = 'search' AND whole IS NULL THEN 'missing:query' END,
            CASE WHEN name = 'search' AND n % 60 NOT BETWEEN 1 AND 50 THEN 'range:limit' END,
            CASE WHEN name = 'measure' AND (n IS NULL OR n % 5 = 0) THEN 'missing:length' END,
            CASE WHEN name = 'measure' AND n % 2 <> 0 AND n % 3 = 0 THEN 'option:unit' END,
            CASE WHEN name = 'measure' AND n % 5 = 0 THEN 'unknown:size' END,
            CASE WHEN name = 'translate' AND whole IS NULL THEN 'missing:text' END,
            CASE WHEN name = 'translate' THEN 'unknown:rate' END) AS errors
    FROM calls
), edges AS (
    SELECT c.conv_id, c.turn, p.turn AS parent FROM calls c JOIN calls p ON c.conv_id = p.conv_id AND c.needs = p.turn AND c.turn > 0
    WHERE c.name <> 'translate'
), walk AS (
    WITH RECURSIVE up(conv_id, turn, here, steps) AS (
        SELECT conv_id, turn, turn, 0 FROM calls
        UNION ALL
        SELECT u.conv_id, u.turn, e.parent, u.steps + 1 FROM up u JOIN edges e ON u.conv_id = e.conv_id AND u.here = e.turn
    ) SELECT conv_id, turn, max(steps)::INT AS level FROM up GROUP BY ALL
)
SELECT f.conv_id, f.call_id, f.name, f.turn AS call_turn, 0 AS place, r.turn AS result_turn, 1::BIGINT AS same_id,
    CASE WHEN r.turn IS NULL THEN 'no_result' ELSE 'linked' END AS status, w.level, errors, errors = '' AS valid,
    '{"arguments":' || arguments || ',"id":"' || f.call_id || '","name":"' || name || '"'
        || coalesce(',"result":' || r.whole, '') || '}' AS canonical
FROM filled f JOIN walk w ON f.conv_id = w.conv_id AND f.turn = w.turn
LEFT JOIN replies r ON r.conv_id = f.conv_id AND r.call_id = f.call_id
UNION ALL
SELECT r.conv_id, r.call_id, NULL, NULL, NULL, r.turn, 0, 'no_call', NULL, '', true, NULL
FROM replies r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
UNION ALL
SELECT conv_id, NULL, NULL, turn, NULL, NULL, 0, 'prose', NULL, '', true,
    '{' || concat_ws(',', '"role":' || CASE WHEN role IS NOT NULL THEN to_json(role)::VARCHAR END, '"text":' || whole) || '}'
FROM chats WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""

ORACLES["op4_exact_topk"] = """
WITH usable AS (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""
