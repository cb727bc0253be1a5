"""SQL for an independent engine, for the operators that SQL can express."""

from __future__ import annotations

OP4 = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5(coalesce(doc_id::VARCHAR, '')) AS turn
    FROM documents
),
per AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place
    FROM sized GROUP BY source
),
weighed AS (
    SELECT *, [5.0, 2.0, 1.0][place + 1]::DOUBLE AS weight, [-0.6, 0.0, 0.6][place + 1]::DOUBLE AS slope,
           (2 * source_size)::DOUBLE AS cap,
           (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS everything
    FROM per
),
levels AS (
    SELECT *,
           (everything - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)
),
filled AS (SELECT *, cap <= level * weight AS is_full FROM levels),
aimed AS (
    SELECT source, source_size, slope,
           CASE WHEN is_full THEN cap
                ELSE (everything - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * weight
                     / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target
    FROM filled
),
line AS (
    SELECT s.doc_id, s.source, s.size, s.turn, s.size >= 2000 AS is_long, a.source_size, a.target, a.slope,
           round(a.target)::BIGINT AS demand,
           sum(CASE WHEN s.size >= 2000 THEN s.size ELSE 0 END) OVER (PARTITION BY s.source) AS long_words
    FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
),
ordered AS (
    SELECT doc_id, source, size, source_size, target, slope, demand,
           (sum(size) OVER (PARTITION BY source
                            ORDER BY is_long <> coalesce(demand % nullif(source_size, 0) >= long_words, false), turn, size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - size AS before
    FROM line
),
readings AS (
    SELECT *,
           CASE WHEN 2 * (demand - before) >= size THEN size ELSE 0 END AS w0,
           CASE WHEN 2 * (demand - source_size - before) >= size THEN size ELSE 0 END AS w1
    FROM ordered
),
middles AS (
    SELECT *,
           CASE WHEN w0 > 0 THEN (before + w0::DOUBLE / 2) / demand END AS u0,
           CASE WHEN w1 > 0 THEN (source_size + before + w1::DOUBLE / 2) / demand END AS u1
    FROM readings
)
SELECT doc_id, size, source_size, target, (w0 + w1)::BIGINT AS taken, source,
       2 * u0 / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * u0)) AS position,
       2 * u1 / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * u1)) AS position_again
FROM middles
"""

OP6 = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
    FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    WHERE q.vec_id % 50 = 0
),
ranked AS (
    SELECT query_id, vec_id, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_MEASURES = ("symbols", "upper", "lines", "length", "echo")
_SLACK = {"symbols": 0.25, "upper": 0.25, "lines": 0.6, "length": 1.5, "echo": 0.3}

OP10 = (
    r"""
WITH numbered AS (
    SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents
),
split AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM numbered
),
counted AS (
    SELECT r, doc_id, lang, source, words, len(words)::BIGINT AS n_words,
           coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           len(lines) AS n_lines,
           length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
           length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters,
           len(list_filter(list_zip(words[2:], words[:-2]), lambda p: p[1] = p[2])) AS n_echo
    FROM split
),
windows AS (
    SELECT r, i, array_to_string(words[i:i + 7], ' ') AS win
    FROM (SELECT r, words, unnest(range(1, n_words - 6)) AS i FROM counted WHERE n_words >= 8)
),
repeated AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1
),
covered AS (
    SELECT r, sum(least(8, coalesce(following - i, 8)))::BIGINT AS n_repeat_words
    FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM repeated)
    GROUP BY r
),
base AS (
    SELECT c.*, coalesce(v.n_repeat_words, 0) AS n_repeat_words,
           n_words < 20 OR 100 * coalesce(v.n_repeat_words, 0) > 30 * n_words AS base_failed,
           n_symbols / greatest(n_words, 1) AS symbols,
           n_upper / greatest(n_letters, 1) AS upper,
           n_dup_lines / greatest(n_lines, 1) AS lines,
           word_chars / greatest(n_words, 1) AS length,
           n_echo / greatest(n_words, 1) AS echo
    FROM counted c LEFT JOIN covered v USING (r)
),
long AS (
    UNPIVOT (SELECT lang, source, symbols, upper, lines, length, echo FROM base WHERE n_words >= 20)
    ON symbols, upper, lines, length, echo INTO NAME measure VALUE x
),
finest AS (
    SELECT lang, source, measure,
           CASE WHEN x <= 1e-4 THEN 0 ELSE ceil(ln(x / 1e-4) / ln(1.02 / 0.98)) END::INT AS bucket,
           count(*) AS n
    FROM long GROUP BY ALL
),
merged AS (
    SELECT 2 AS level, lang, source, measure, bucket, n FROM finest
    UNION ALL SELECT 1, lang, NULL, measure, bucket, sum(n) FROM finest GROUP BY ALL
    UNION ALL SELECT 0, NULL, NULL, measure, bucket, sum(n) FROM finest GROUP BY ALL
),
ranked AS (
    SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto,
           sum(n) OVER (PARTITION BY level, lang, source, measure) AS total,
           CASE WHEN bucket = 0 THEN 0::DOUBLE
                ELSE 1e-4::DOUBLE * 2 * pow(1.02::DOUBLE / 0.98::DOUBLE, bucket) / (1.02::DOUBLE / 0.98::DOUBLE + 1) END AS value
    FROM merged
),
quantiles AS (
    SELECT level, lang, source, measure, max(total) AS total,
           min(value) FILTER (upto >= 0.25 * total) AS q25, min(value) FILTER (upto >= 0.5 * total) AS q50
    FROM ranked GROUP BY ALL
),
bounds AS (
    SELECT level, lang, source, total,
"""
    + ",\n".join(
        f"           max(q50 + 6.0 * (q50 - q25) + {_SLACK[m]}) FILTER (measure = '{m}') AS hi_{m},\n"
        f"           max(q50 - 6.0 * (q50 - q25) - {_SLACK[m]}) FILTER (measure = '{m}') AS lo_{m}"
        for m in _MEASURES
    )
    + """
    FROM quantiles GROUP BY ALL
),
judged AS (
    SELECT b.*,
"""
    + ",\n".join(
        f"           CASE WHEN g.total >= 200 THEN g.{e}_{m} WHEN l.total >= 200 THEN l.{e}_{m} ELSE o.{e}_{m} END AS {e}_{m}"
        for m in _MEASURES
        for e in ("hi", "lo")
    )
    + """
    FROM base b
    LEFT JOIN bounds g ON g.level = 2 AND g.lang IS NOT DISTINCT FROM b.lang AND g.source IS NOT DISTINCT FROM b.source
    LEFT JOIN bounds l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM b.lang
    LEFT JOIN bounds o ON o.level = 0
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND symbols <= hi_symbols AND upper <= hi_upper AND lines <= hi_lines
       AND length <= hi_length AND echo <= hi_echo AND length >= lo_length AS kept
FROM judged
"""
)

ORACLE = {
    "op4_source_mixing": OP4,
    "op6_exact_top_k": OP6,
    "op10_quality_rules": OP10,
}
