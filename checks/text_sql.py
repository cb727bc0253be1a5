"""The same text queries as plain SQL."""

from __future__ import annotations

from checks.binding import PHRASES, QUESTIONS
from checks.market_sql import SCORED_CTES, SIGNALS, _sql, quoted, r
from spacelens.functions import verify_text as vt
from spacelens.functions.text import STOP_WORDS

WS = "regexp_replace({}, '\\s+', ' ', 'g')"
EDGE = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def toks(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: t NOT IN ({quoted(STOP_WORDS)}))"


CHUNKS = f"""
paras AS MATERIALIZED (
  SELECT doc_id, lang || ' ' || source AS title, list_filter(list_transform(string_split(text, chr(10)),
    lambda p: {EDGE.format("p")}), lambda p: p <> '') AS p FROM documents),
cnt AS MATERIALIZED (
  SELECT *, list_transform(p, lambda x: len(string_split(trim({WS.format("x")}), ' '))) AS n,
    string_split(trim({WS.format("array_to_string(p, ' ')")}), ' ') AS words FROM paras),
walk AS (
  SELECT doc_id, 1 AS i, n[1] AS held, 0 AS chunk_no, 0 AS carry FROM cnt WHERE len(n) > 0
  UNION ALL
  SELECT w.doc_id, i + 1, CASE WHEN held + n[i + 1] > 240 THEN least(held, 45) ELSE held END + n[i + 1],
    chunk_no + CASE WHEN held + n[i + 1] > 240 THEN 1 ELSE 0 END,
    CASE WHEN held + n[i + 1] > 240 THEN least(held, 45) ELSE carry END
  FROM walk w JOIN cnt c ON w.doc_id = c.doc_id WHERE i < len(n)),
groups AS (
  SELECT doc_id, chunk_no, min(i) AS a, max(i) AS z, max(carry) AS carry FROM walk GROUP BY 1, 2),
located AS (
  SELECT g.*, title, p, words, coalesce(list_sum(n[1:a - 1]), 0)::BIGINT AS before
  FROM groups g JOIN cnt USING (doc_id)),
chunks AS MATERIALIZED (
  SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, title, title || chr(10) || chr(10) ||
    CASE WHEN carry > 0 THEN array_to_string(words[before - carry + 1:before], ' ') || chr(10) || chr(10) ELSE '' END
    || array_to_string(p[a:z], chr(10) || chr(10)) AS text
  FROM located
  UNION ALL SELECT doc_id, 0, title, title FROM cnt WHERE len(p) = 0)
"""


def rec(ctes: str, select: str) -> str:
    return _sql(ctes, select).replace("WITH ", "WITH RECURSIVE ", 1)


def grams(source: str, key: str, column: str) -> str:
    clean = f"trim({WS.format(f'lower({column})')})"
    return (
        f"SELECT {key}, gram, count(*) AS tf FROM (SELECT {key}, unnest(CASE WHEN length(s) >= 3 THEN "
        f"list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3)) WHEN s = '' THEN "
        f"[]::VARCHAR[] ELSE [s] END) AS gram FROM (SELECT {key}, {clean} AS s FROM {source})) GROUP BY ALL"
    )


WORDS = CHUNKS + f""",
tok AS MATERIALIZED (SELECT doc_id, chunk_no, {toks("text")} AS t FROM chunks),
post AS MATERIALIZED (SELECT doc_id, chunk_no, term, length, count(*) AS tf FROM
  (SELECT doc_id, chunk_no, len(t) AS length, unnest(t) AS term FROM tok) GROUP BY ALL),
terms AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY 1),
st AS MATERIALIZED (SELECT count(*) AS passages, avg(len(t)) AS average FROM tok),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({toks("text")}) AS term FROM benchmark) GROUP BY ALL),
bm AS MATERIALIZED (
  SELECT query_id, doc_id, chunk_no, sum(ln(1 + (passages - df + 0.5) / (df + 0.5)) * (tf * 2.5)
    / (tf + 1.5 * (0.25 + 0.75 * length / average)) * qf) AS score
  FROM qt JOIN terms USING (term) JOIN post USING (term) CROSS JOIN st GROUP BY 1, 2, 3),
bm_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id, chunk_no) AS position
  FROM bm WHERE round(score, 9) > 0) WHERE position <= 24)
"""
GRAMS = f""",
gc AS MATERIALIZED ({grams("chunks", "doc_id, chunk_no", "text")}),
idf AS MATERIALIZED (SELECT gram, ln(1.0 + (SELECT count(*) FROM chunks) / (1.0 + count(*))) AS idf FROM gc GROUP BY 1),
gw AS MATERIALIZED (SELECT doc_id, chunk_no, gram, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY doc_id, chunk_no)), 0) AS weight
  FROM (SELECT doc_id, chunk_no, gram, (1.0 + ln(tf)) * idf AS w FROM gc JOIN idf USING (gram))),
qc AS ({grams("(SELECT item_id AS query_id, text FROM benchmark)", "query_id", "text")}),
qw AS MATERIALIZED (SELECT query_id, gram, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY query_id)), 0) AS q
  FROM (SELECT query_id, gram, (1.0 + ln(tf)) * idf AS w FROM qc JOIN idf USING (gram))),
co AS (SELECT query_id, doc_id, chunk_no, sum(weight * q) AS score FROM gw JOIN qw USING (gram) GROUP BY 1, 2, 3),
co_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id, chunk_no) AS position
  FROM co WHERE round(score, 9) > 0) WHERE position <= 24)
"""
RRF = """,
fused AS (SELECT query_id, doc_id, chunk_no, round(sum(1.0::DOUBLE / (60 + position)), 12) AS score
  FROM (SELECT query_id, doc_id, chunk_no, position FROM bm_top UNION ALL
        SELECT query_id, doc_id, chunk_no, position FROM co_top) GROUP BY 1, 2, 3),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_no) AS n FROM fused) WHERE n = 1),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM best) WHERE rank <= 6)
"""
HIT = "query_id, doc_id, chunk_no, "

NUM = (
    "(?:^|[^\\p{L}\\p{N}_.])([-+]?[0-9]{1,3}(?:,[0-9]{3})+(?:\\.[0-9]+)?|[-+]?[0-9]*\\.?[0-9]+)"
)


def nums(x: str) -> str:
    return (
        f"list_transform(regexp_extract_all({x}, '{NUM}', 1), lambda t: CAST(replace(t, ',', '') AS DOUBLE))"
    )


def stripped(x: str) -> str:
    for p in vt.STRUCTURAL:
        x = f"regexp_replace({x}, {lit(p)}, ' ', 'g')"
    return x


ANSWERS = """
answers AS MATERIALIZED (
  SELECT doc_id AS answer_id, lang AS evidence_key, text || ' It has ' || format('{:,}', n_chars) || ' signs [S-'
    || lpad(CAST(doc_id % 40 AS VARCHAR), 2, '0') || '], up ' || (doc_id % 50) || '.5 in 2024 by NFHS-5.'
    || CASE WHEN doc_id % 3 = 0 THEN ' The ministry published guidance. Sales are 2.' ELSE '' END AS text
  FROM documents)"""
EVIDENCE = f""",
pagelang AS (SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) AS evidence_key, html, length(html) AS size FROM pages),
evidence AS MATERIALIZED (
  SELECT DISTINCT * FROM (SELECT evidence_key, unnest({nums("html")}) AS value FROM pagelang
    UNION ALL SELECT evidence_key, unnest([CAST(size AS DOUBLE), round(size * 100.0, 6), round(size / 100.0, 6)]) FROM pagelang))"""
CLAIMS = f""",
claimed AS MATERIALIZED (SELECT answer_id, evidence_key, list_filter({nums(stripped("text"))}, lambda v: abs(v) >= 3.0) AS c FROM answers),
claims AS MATERIALIZED (SELECT answer_id, evidence_key, unnest(c) AS claim, unnest(range(len(c))) AS claim_no FROM claimed)"""
GROUNDED = """,
bad AS MATERIALIZED (
  SELECT answer_id, string_agg(printf('%.4f', claim), ';' ORDER BY claim_no) AS ungrounded, count(*) AS n FROM claims c
  WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.evidence_key = c.evidence_key
    AND abs(abs(e.value) - abs(c.claim)) <= greatest(0.02 * abs(c.claim), 0.005)) GROUP BY 1),
grounding AS MATERIALIZED (SELECT answer_id, n IS NULL AS passed, CAST(len(c) AS INTEGER) AS checked,
  coalesce(ungrounded, '') AS ungrounded, coalesce(n, 0) AS n FROM claimed LEFT JOIN bad USING (answer_id))"""
MARKERS = "[" + ", ".join(lit(m) for m in vt.CLAIM_MARKERS) + "]"
# RE2 has no look-around: mark the sentence end, keep its first and next character.
SENTENCES = (
    "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z(\\[])', "
    "'\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: " + EDGE.format("s") + "), lambda s: s <> '')"
)
CITES = f""",
cites AS MATERIALIZED (
  SELECT answer_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\[(S-\\d+)\\]', 1), lambda t: upper(t)))) AS cited,
    list_filter({SENTENCES}, lambda s: NOT regexp_matches(s, '\\[(S-\\d+)\\]')
      AND len(list_filter({MARKERS}, lambda m: contains(lower(s), m))) > 0) AS uncited FROM answers),
checked AS MATERIALIZED (
  SELECT *, list_filter(cited, lambda t: NOT list_contains(ids, t)) AS unknown
  FROM cites CROSS JOIN (SELECT list(upper(id)) AS ids FROM signals))"""


def pick(phrases, by):
    return "[" + ", ".join(lit(p) for p in phrases) + f"][({by}) % {len(phrases)} + 1]"


TEXTS = f"""
texts AS MATERIALIZED (SELECT 'd' || doc_id AS text_id, text || ' ' || {pick(PHRASES, "doc_id")} AS text FROM documents
  UNION ALL SELECT 'p' || page_id, html FROM pages)"""
FOUND = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(text, {lit(p)}) THEN '{i}' END" for i, p in enumerate(vt.INJECTION, start=1)
) + "], lambda x: x IS NOT NULL)"


def sanitised() -> str:
    x = "text"
    for p in vt.INJECTION:
        x = f"regexp_replace({x}, {lit(p)}, {lit(vt.FILTERED)}, 'g')"
    return f"'<retrieved_data source=''corpus''>' || chr(10) || {x} || chr(10) || '</retrieved_data>'"


ASKED = f"""
asked AS MATERIALIZED (SELECT conv_id * 1000 + turn AS question_id, {pick(QUESTIONS, "conv_id + turn")}
  || ' ' || text AS text FROM conversations WHERE role = 'user')"""


def words_in(words) -> str:
    return "list_filter([" + ", ".join(lit(w) for w in words) + "], lambda w: contains(lower(s), w))"


SCOPE = f"""
SELECT question_id, reason = 'in scope' AS allowed, reason FROM (SELECT question_id, CASE WHEN s = '' THEN 'empty question'
  WHEN {" OR ".join(f"regexp_matches(s, {lit(p)})" for p in vt.OVERRIDE)} THEN 'instruction override attempt'
  WHEN len({words_in(vt.HARD_BLOCK)}) > 0 THEN 'topic absent from the dataset: ' || array_to_string({words_in(vt.HARD_BLOCK)}[1:3], ', ')
  WHEN len({words_in(vt.IN_SCOPE)}) > 0 THEN 'in scope'
  WHEN len({words_in(vt.SOFT_BLOCK)}) > 0 THEN 'out-of-scope therapy area: ' || array_to_string({words_in(vt.SOFT_BLOCK)}[1:3], ', ')
  ELSE 'no in-scope terminology' END AS reason FROM (SELECT question_id, {EDGE.format("text")} AS s FROM asked))"""
INTENT = "SELECT question_id, CASE " + " ".join(
    f"WHEN regexp_matches(text, {lit('(?i)' + p)}) THEN '{name}'" for name, p in vt.INTENTS
) + " ELSE 'general' END AS intent FROM asked"

CASES = """
turns AS (SELECT a.conv_id * 1000 + a.turn AS i, coalesce(a.text, '') AS answer, coalesce(u.text, '') AS question,
    CASE WHEN u.conv_id IS NULL THEN ['assistant'] ELSE ['assistant', 'user'] END AS tools
  FROM conversations a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user'
  WHERE a.role = 'assistant'),
cases AS (SELECT i AS case_id, answer, length(answer) < 60 AS refused, i % 7 = 0 AS expected_refusal, tools,
    CASE WHEN i % 5 = 0 THEN ['user', 'tool'] ELSE ['user'] END AS required,
    lower(regexp_extract(question, '^[^ \n]+')) AS must, regexp_extract(question, '^[^ \n]+') AS must_raw,
    regexp_extract(question, '[^ \n]+$') AS mustnot,
    CASE WHEN i % 9 <> 0 THEN i % 4 <> 0 END AS grounded,
    CASE WHEN i % 6 = 0 THEN 'S-99' ELSE '' END AS invalid, length(answer) * 1.5::DOUBLE AS latency_ms FROM turns),
parts AS (SELECT *, array_to_string(list_filter(required, lambda t: NOT list_contains(tools, t)), '|') AS mt,
    CASE WHEN contains(lower(answer), must) THEN '' ELSE must_raw END AS mc,
    CASE WHEN mustnot <> '' AND contains(lower(answer), lower(mustnot)) THEN mustnot ELSE '' END AS fc,
    CAST(length(answer) AS INTEGER) AS answer_length FROM cases),
results AS MATERIALIZED (
  SELECT case_id, CASE WHEN expected_refusal THEN CASE WHEN refused THEN '' ELSE 'answered' END
    ELSE concat_ws('|', CASE WHEN refused THEN 'refused' END,
      CASE WHEN mt <> '' THEN 'tools: ' || mt END, CASE WHEN mc <> '' THEN 'omits: ' || mc END,
      CASE WHEN fc <> '' THEN 'forbidden: ' || fc END,
      CASE WHEN answer_length < 100 THEN 'short: ' || answer_length || ' < 100' END,
      CASE WHEN NOT grounded THEN 'ungrounded' END,
      CASE WHEN invalid <> '' THEN 'citations: ' || invalid END) END AS failure_reasons,
    CASE WHEN NOT expected_refusal THEN grounded END AS grounded, CASE WHEN expected_refusal THEN '' ELSE mt END AS missing_tools,
    CASE WHEN expected_refusal THEN '' ELSE mc END AS missing_content, CASE WHEN expected_refusal THEN '' ELSE fc END AS forbidden_content,
    CASE WHEN expected_refusal THEN '' ELSE invalid END AS invalid_citations, refused, expected_refusal, answer_length, latency_ms
  FROM parts)"""
EVAL_SUMMARY = """SELECT count(*) AS cases, count(*) FILTER (failure_reasons = '') AS passed,
  round(avg(CASE WHEN failure_reasons = '' THEN 1.0 ELSE 0.0 END), 6) AS pass_rate,
  round(avg(CASE WHEN grounded THEN 1.0 ELSE 0.0 END) FILTER (grounded IS NOT NULL AND NOT expected_refusal), 6) AS groundedness,
  round(avg(CASE WHEN missing_tools = '' THEN 1.0 ELSE 0.0 END) FILTER (NOT expected_refusal), 6) AS tool_recall,
  round(avg(CASE WHEN invalid_citations = '' THEN 1.0 ELSE 0.0 END) FILTER (NOT expected_refusal), 6) AS citation_validity,
  round(avg(CASE WHEN missing_content = '' THEN 1.0 ELSE 0.0 END) FILTER (NOT expected_refusal), 6) AS content_coverage,
  round(avg(CASE WHEN refused = expected_refusal THEN 1.0 ELSE 0.0 END), 6) AS refusal_accuracy,
  round((SELECT median(latency_ms) FROM results WHERE latency_ms > 0), 6) AS median_latency_ms,
  round((SELECT list_sort(list(latency_ms))[least(len(list(latency_ms)) - 1,
    CAST(round_even(0.95 * (len(list(latency_ms)) - 1), 0) AS BIGINT)) + 1] FROM results WHERE latency_ms > 0), 6) AS p95_latency_ms
FROM results"""

MENTIONED = SCORED_CTES + """,
asked AS (SELECT DISTINCT p_name || '/' || p_type AS question_id, 'How is ' || p_name || ' doing in ' || p_type || '?' AS text FROM part),
word AS (SELECT DISTINCT question_id, upper(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z\\-]{4,}'))) AS w FROM asked),
hit AS (SELECT question_id, level, space_id, round(count(*) * 1000.0 + max(value_t2), 6) AS score
  FROM word JOIN scored ON contains(upper(space_label), w) GROUP BY 1, 2, 3)
"""

CENTRES = """
dims AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS d FROM embeddings),
centre AS (SELECT label AS query_id, d, avg(v) AS v FROM dims GROUP BY 1, 2),
vn AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM dims GROUP BY 1),
cn AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM centre GROUP BY 1),
sim AS (SELECT c.query_id, x.vec_id AS doc_id, 0 AS chunk_no, sum(c.v * x.v) / any_value(cn.n) / any_value(vn.n) AS score
  FROM centre c JOIN dims x USING (d) JOIN cn ON cn.query_id = c.query_id JOIN vn ON vn.vec_id = x.vec_id GROUP BY 1, 2)
"""

ORACLE = {
    "chunks": rec(CHUNKS, "SELECT doc_id, chunk_no, title, text FROM chunks"),
    "tokens": f"SELECT term, count(*) AS n FROM (SELECT unnest({toks('text')}) AS term FROM documents) GROUP BY 1",
    "trigrams": f"SELECT gram, CAST(sum(tf) AS BIGINT) AS n, count(*) AS documents FROM ({grams('documents', 'doc_id', 'text')}) GROUP BY 1",
    "text_index": rec(WORDS + GRAMS, "SELECT doc_id, chunk_no, w.length, w.terms, g.grams, " + r("g.weight_sum", "weight_sum") + """ FROM
      (SELECT doc_id, chunk_no, CAST(sum(tf) AS BIGINT) AS length, count(*) AS terms FROM post GROUP BY 1, 2) w JOIN
      (SELECT doc_id, chunk_no, count(*) AS grams, sum(weight) AS weight_sum FROM gw GROUP BY 1, 2) g USING (doc_id, chunk_no)"""),
    "term_frequency": rec(WORDS, "SELECT term, df FROM terms"),
    "bm25": rec(WORDS, "SELECT " + HIT + "CAST(position AS INTEGER) AS position, " + r("score") + " FROM bm_top"),
    "trigram_cosine": rec(WORDS + GRAMS, "SELECT " + HIT + "CAST(position AS INTEGER) AS position, " + r("score") + " FROM co_top"),
    "dense_rank": _sql(CENTRES, "SELECT " + HIT + "CAST(position AS INTEGER) AS position, " + r("score", digits=5) + """ FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS position FROM sim)
      WHERE position <= 24"""),
    "rrf_search": rec(WORDS + GRAMS + RRF, "SELECT " + HIT + "CAST(rank AS INTEGER) AS rank, " + r("score", digits=9)
                      + ", title, text FROM hits JOIN chunks USING (doc_id, chunk_no)"),
    "term_relevance": rec(WORDS, "SELECT query_id, doc_id, round(s / max(s) OVER (PARTITION BY query_id), 6) AS relevance FROM "
                          "(SELECT query_id, doc_id, max(score) AS s FROM bm GROUP BY 1, 2) WHERE s > 0"),
    "evidence_numbers": _sql(ANSWERS + EVIDENCE, "SELECT evidence_key, " + r("value") + " FROM evidence"),
    "numeric_claims": _sql(ANSWERS + CLAIMS, "SELECT answer_id, CAST(claim_no AS INTEGER) AS claim_no, claim FROM claims"),
    "grounding_report": _sql(ANSWERS + EVIDENCE + CLAIMS + GROUNDED, "SELECT answer_id, passed, checked, ungrounded FROM grounding"),
    "citation_report": _sql(SIGNALS + ANSWERS + CITES, "SELECT answer_id, len(unknown) = 0 AS valid, array_to_string(cited, '|') AS cited, "
                            "array_to_string(unknown, '|') AS unknown, array_to_string(uncited, '|') AS uncited FROM checked"),
    "guard_verdict": _sql(SIGNALS + ANSWERS + EVIDENCE + CLAIMS + GROUNDED + CITES, """SELECT answer_id, passed AND len(unknown) = 0 AS passed,
      passed AS grounded, len(unknown) = 0 AS citations_valid, checked, CAST(n AS INTEGER) AS ungrounded_count,
      CAST(len(unknown) AS INTEGER) AS unknown_count, CAST(len(uncited) AS INTEGER) AS uncited_count,
      CASE WHEN len(uncited) > 0 THEN len(uncited) || ' sentence(s) make an external claim without a citation.' ELSE '' END AS warning
      FROM grounding JOIN checked USING (answer_id)"""),
    "injection_scan": _sql(TEXTS, f"SELECT text_id, len(f) = 0 AS clean, array_to_string(f, ',') AS patterns FROM (SELECT text_id, {FOUND} AS f FROM texts)"),
    "sanitised_text": _sql(TEXTS, f"SELECT text_id, {sanitised()} AS text FROM texts"),
    "scope_labels": _sql(ASKED, SCOPE),
    "intent_labels": _sql(ASKED, INTENT),
    "mentioned_spaces": _sql(MENTIONED, """SELECT question_id, level, space_id, score, CAST(position AS INTEGER) AS position FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, space_id DESC, level) AS position FROM hit) WHERE position <= 3"""),
    "eval_cases": _sql(CASES, "SELECT case_id, failure_reasons = '' AS passed, grounded, missing_tools, missing_content, forbidden_content, "
                       "invalid_citations, refused, expected_refusal, answer_length, latency_ms, failure_reasons FROM results"),
    "eval_summary": _sql(CASES, EVAL_SUMMARY),
}
