"""DuckDB SQL oracle for every registered query with an exact check.

The SQL is written independently of the Spark plans, in the plainest form
(brute-force joins, windows over whole groups); it only shares the fixed
patterns and values. Tables are the pre-registered views over the parquet
files.
"""

from __future__ import annotations

from ..functions import constants as K
from ..functions import text as T
from ..operators import corpus as C
from . import fixtures as X


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(x):
    return f"regexp_extract_all({x}, {lit(T.WORD)})"


def tokens(x):
    return f"regexp_extract_all({x}, {lit(T.TOKEN)})"


def terms(x):
    return f"regexp_extract_all(lower({x}), {lit(T.TERM)})"


def py_strip(x):
    return f"regexp_replace({x}, {lit('^' + T.WS + '|' + T.WS + '$')}, '', 'g')"


def collapse(x):
    return py_strip(f"regexp_replace({x}, {lit(T.WS)}, ' ', 'g')")


def non_ascii(x):
    return f"regexp_replace({x}, {lit(T.NON_ASCII)}, '', 'g')"


def first_words(x, n=5):
    return f"array_to_string({words(x)}[1:{n}], ' ')"


def strip_markup(x):
    for pat in (C._SCRIPT, C._STYLE, C._COMMENT):
        x = f"regexp_replace({x}, {lit(pat)}, ' ', 'g')"
    return f"regexp_replace({x}, {lit(C._TAG)}, ' ', 'g')"


def unescape(x):
    for ent, ch in C.HTML_ENTITIES:
        x = f"replace({x}, {lit(ent)}, {lit(ch)})"
    return x


def html_text(x):
    return collapse(unescape(strip_markup(x)))


def r6(x):
    return f"round(CAST({x} AS DOUBLE), 6)"


def names_list():
    return "[" + ", ".join(lit(n) for n in X.SECTION_NAMES) + "]"


def section_name(pos):
    return f"{names_list()}[CAST(({pos}) % {len(X.SECTION_NAMES)} AS BIGINT) + 1]"


# ---------------------------------------------------------------- fixtures
ARTICLE_DOCS = ("SELECT CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS page_id, doc_id, "
                "doc_id AS doc_pos, text AS content FROM documents")

SPARSE_QUERIES = "SELECT item_id AS query_id, item_id % 20 AS page_id, text AS query FROM benchmark"

CONV_SECTIONS = f"""
SELECT c.conv_id AS page_id, c.turn AS sec_pos, {section_name('c.turn')} AS section, c.role, c.text, k.key
FROM conversations c LEFT JOIN (
  SELECT conv_id, {first_words('text')} AS key FROM conversations WHERE turn = 0) k
ON c.conv_id = k.conv_id"""

VECTOR_PAGE = "CASE WHEN vec_id % 3 = 0 THEN 0 ELSE vec_id // 200 + 1 END"

VECTORS = f"SELECT {VECTOR_PAGE} AS page_id, vec_id AS chunk_id, embedding FROM embeddings"

VECTOR_QUERIES = (f"SELECT {VECTOR_PAGE} AS page_id, vec_id AS sec_pos, "
                  f"{section_name('vec_id')} AS section, embedding AS query_embedding FROM embeddings "
                  "WHERE vec_id % 3 <> 0 OR vec_id % 50 = 0")

DENSE_TOP5 = f"""
WITH s AS (
  SELECT q.page_id, q.sec_pos, v.chunk_id,
         list_sum(list_transform(range(1, len(q.query_embedding) + 1),
           lambda i: CAST(q.query_embedding[i] AS DOUBLE) * CAST(v.embedding[i] AS DOUBLE))) AS score
  FROM ({VECTOR_QUERIES}) q JOIN ({VECTORS}) v ON q.page_id = v.page_id),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, sec_pos
        ORDER BY {r6('score')} DESC, chunk_id) AS rank FROM s)
SELECT page_id, sec_pos, CAST(rank AS BIGINT) AS rank, chunk_id, {r6('score')} AS score
FROM r WHERE rank <= 5"""


def _sparse_topk(score_sql: str, k: int) -> str:
    return f"""
WITH docs AS ({ARTICLE_DOCS}),
q AS ({SPARSE_QUERIES}),
sc AS ({score_sql}),
cand AS (
  SELECT q.query_id, q.page_id, d.doc_id, d.doc_pos, coalesce(sc.score, 0.0) AS score
  FROM q JOIN docs d ON q.page_id = d.page_id
  LEFT JOIN sc ON sc.query_id = q.query_id AND sc.page_id = q.page_id AND sc.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_id
        ORDER BY {r6('score')} DESC, doc_pos, doc_id) AS rank FROM cand)
SELECT query_id, page_id, CAST(rank AS BIGINT) AS rank, doc_id, {r6('score')} AS score
FROM r WHERE rank <= {k}"""


BM25_SCORES = f"""
WITH dt AS (SELECT page_id, doc_id, {tokens("coalesce(content, '')")} AS tok FROM docs),
post AS (SELECT page_id, doc_id, dl, term, count(*) AS tf FROM (
  SELECT page_id, doc_id, len(tok) AS dl, unnest(tok) AS term FROM dt) GROUP BY ALL),
stats AS (SELECT page_id, count(*) AS n_docs, avg(len(tok)) AS avgdl FROM dt GROUP BY page_id),
dfs AS (SELECT page_id, term, count(*) AS df FROM post GROUP BY ALL),
idf0 AS (SELECT d.page_id, d.term, ln(s.n_docs - d.df + 0.5) - ln(d.df + 0.5) AS idf
         FROM dfs d JOIN stats s ON d.page_id = s.page_id),
fl AS (SELECT page_id, avg(idf) * {K.BM25_EPSILON} AS eps FROM idf0 GROUP BY page_id),
idf AS (SELECT i.page_id, i.term, CASE WHEN i.idf < 0 THEN f.eps ELSE i.idf END AS idf
        FROM idf0 i JOIN fl f ON i.page_id = f.page_id),
qt AS (SELECT query_id, page_id, term, count(*) AS qn FROM (
  SELECT query_id, page_id, unnest({tokens("coalesce(query, '')")}) AS term FROM q) GROUP BY ALL)
SELECT qt.query_id, qt.page_id, p.doc_id,
  sum(qt.qn * i.idf * p.tf * ({K.BM25_K1} + 1)
      / (p.tf + {K.BM25_K1} * (1 - {K.BM25_B} + {K.BM25_B} * p.dl / s.avgdl))) AS score
FROM qt JOIN idf i ON qt.page_id = i.page_id AND qt.term = i.term
JOIN post p ON p.page_id = qt.page_id AND p.term = qt.term
JOIN stats s ON s.page_id = qt.page_id
GROUP BY ALL"""

TFIDF_SCORES = f"""
WITH post AS (SELECT page_id, doc_id, term, count(*) AS tf FROM (
  SELECT page_id, doc_id, unnest({terms("coalesce(content, '')")}) AS term FROM docs) GROUP BY ALL),
n AS (SELECT page_id, count(*) AS n_docs FROM docs GROUP BY page_id),
idf AS (SELECT d.page_id, d.term, ln((1 + n.n_docs) / (1 + d.df)) + 1 AS idf
        FROM (SELECT page_id, term, count(*) AS df FROM post GROUP BY ALL) d
        JOIN n ON d.page_id = n.page_id),
w AS (SELECT p.page_id, p.doc_id, p.term, p.tf * i.idf AS w
      FROM post p JOIN idf i ON p.page_id = i.page_id AND p.term = i.term),
dn AS (SELECT page_id, doc_id, sqrt(sum(w * w)) AS dnorm FROM w GROUP BY ALL),
qw AS (SELECT qt.query_id, qt.page_id, qt.term, qt.qn * i.idf AS qw FROM (
         SELECT query_id, page_id, term, count(*) AS qn FROM (
           SELECT query_id, page_id, unnest({terms("coalesce(query, '')")}) AS term FROM q) GROUP BY ALL) qt
       JOIN idf i ON qt.page_id = i.page_id AND qt.term = i.term),
qn AS (SELECT query_id, page_id, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY ALL)
SELECT qw.query_id, qw.page_id, w.doc_id, sum(qw.qw / qn.qnorm * w.w / dn.dnorm) AS score
FROM qw JOIN qn ON qw.query_id = qn.query_id AND qw.page_id = qn.page_id
JOIN w ON w.page_id = qw.page_id AND w.term = qw.term
JOIN dn ON dn.page_id = w.page_id AND dn.doc_id = w.doc_id
GROUP BY ALL"""


SQL: dict[str, str] = {}

# ---------------------------------------------------------------- A / B
SQL["scan_documents"] = ("SELECT doc_id, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS page_id, "
                         "lang, n_chars FROM documents")

SQL["word_count_filter"] = f"""
SELECT doc_id, page_id, n_words FROM (
  SELECT doc_id, page_id, CAST(len({words('content')}) AS BIGINT) AS n_words FROM ({ARTICLE_DOCS}))
WHERE n_words BETWEEN 1000 AND 3000"""

SQL["new_titles"] = f"""
WITH old AS (SELECT doc_id AS id, {first_words('text')} AS title FROM documents),
new AS (SELECT doc_id AS id, {first_words(non_ascii('text'))} AS title FROM documents)
SELECT id, title FROM new n
WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.title IS NOT DISTINCT FROM n.title)"""

SQL["token_counts"] = f"SELECT doc_id, CAST(len({tokens('content')}) AS BIGINT) AS n_tokens FROM ({ARTICLE_DOCS})"

SQL["strip_non_ascii"] = f"SELECT doc_id, {non_ascii('content')} AS text FROM ({ARTICLE_DOCS})"

_CHUNKS = f"""
WITH d AS (SELECT page_id, doc_id, doc_pos, {tokens("coalesce(content, '')")} AS tok FROM ({ARTICLE_DOCS})),
c AS (SELECT page_id, doc_id, doc_pos, tok,
        unnest(range(0, CAST(ceil(len(tok) / {K.CHUNK_SIZE}.0) AS BIGINT))) AS chunk_pos FROM d)
SELECT page_id, doc_id, doc_pos, CAST(chunk_pos AS BIGINT) AS chunk_pos,
  array_to_string(tok[chunk_pos * {K.CHUNK_SIZE} + 1 : chunk_pos * {K.CHUNK_SIZE} + {K.CHUNK_SIZE}], ' ') AS content
FROM c"""

SQL["chunk_docs"] = f"SELECT page_id, doc_id, chunk_pos, content FROM ({_CHUNKS})"

SQL["chunk_ids"] = f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY doc_pos, chunk_pos) - 1 AS BIGINT) AS chunk_id,
  doc_id, content FROM ({_CHUNKS})"""

SQL["html_to_text"] = f"SELECT page_id, {html_text('html')} AS text FROM pages"

_SECTIONS = f"""
WITH m AS (
  SELECT page_id, string_split(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(html, {lit(C._SCRIPT)}, ' ', 'g'), {lit(C._STYLE)}, ' ', 'g'),
                   {lit(C._COMMENT)}, ' ', 'g'),
    {lit(C._HEADING)}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM pages),
p AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS sec_pos FROM m)
SELECT page_id, CAST(sec_pos AS BIGINT) AS sec_pos,
  {html_text("CASE WHEN sec_pos > 0 THEN split_part(part, chr(2), 1) ELSE '' END")} AS section,
  {html_text("CASE WHEN sec_pos > 0 THEN regexp_replace(part, '^[^' || chr(2) || ']*' || chr(2), '') ELSE part END")} AS text
FROM p"""

SQL["section_extract"] = _SECTIONS

SQL["drop_empty_pages"] = f"""
SELECT page_id, sec_pos, CAST(length(text) AS BIGINT) AS n_chars FROM (
  SELECT page_id, sec_pos, CASE page_id % 4 WHEN 1 THEN '  ' WHEN 2 THEN NULL
    WHEN 3 THEN 'Access denied. ' || text ELSE text END AS text FROM ({_SECTIONS}))
WHERE text IS NOT NULL AND {py_strip('text')} <> '' AND NOT contains(lower(text), 'access denied')"""

SQL["url_keep_last"] = """
SELECT host, url, max(pos) AS pos, md5(arg_max(text, pos)) AS text_md5 FROM (
  SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, page_id AS pos, url, html AS text FROM pages
  UNION ALL
  SELECT regexp_extract(url, '://([^/?#]+)', 1), page_id + 1000000000, url, 'second crawl' || chr(10) || html FROM pages)
GROUP BY host, url"""

_ANCHOR = '<a href="([^"]*)">([^<]*)</a>'
SQL["link_union"] = f"""
SELECT page_id, unnest(regexp_extract_all(html, {lit(_ANCHOR)}, 2)) AS title,
       unnest(regexp_extract_all(html, {lit(_ANCHOR)}, 1)) AS url, 'Wikipedia' AS source FROM pages
UNION ALL
SELECT page_id, {html_text("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
       url, 'Google' AS source FROM pages"""

SQL["section_rows"] = f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY sec_pos) - 1 AS BIGINT) AS sec_pos,
  section, text AS content FROM ({CONV_SECTIONS})"""

# ---------------------------------------------------------------- C
SQL["bm25_topk"] = _sparse_topk(BM25_SCORES, 5)
SQL["tfidf_topk"] = _sparse_topk(TFIDF_SCORES, 5)
SQL["topk_padded"] = _sparse_topk(BM25_SCORES, 60)

SQL["section_query_text"] = f"""
SELECT page_id, sec_pos, lower(section) || ' of ' || lower(key) || '?' AS query_text FROM ({CONV_SECTIONS})"""

SQL["dense_topk"] = DENSE_TOP5

SQL["retrieval_nested"] = f"""
WITH r AS (SELECT d.*, q.section FROM ({DENSE_TOP5}) d
           JOIN ({VECTOR_QUERIES}) q ON d.page_id = q.page_id AND d.sec_pos = q.sec_pos),
s AS (SELECT page_id, sec_pos, section, array_to_string(list(chunk_id ORDER BY rank), ',') AS ids
      FROM r GROUP BY ALL)
SELECT page_id, array_to_string(list(section ORDER BY sec_pos), '|') AS sections,
       array_to_string(list(ids ORDER BY sec_pos), ';') AS top_chunks
FROM s GROUP BY page_id"""

SQL["chunk_coverage"] = f"""
WITH per AS (SELECT page_id, count(DISTINCT chunk_id) AS n FROM ({DENSE_TOP5}) GROUP BY page_id)
SELECT count(*) AS n_articles, CAST(sum(n) AS BIGINT) AS total_distinct, {r6('avg(n)')} AS mean_distinct FROM per"""

SQL["retrieval_eligible"] = f"""
SELECT c.page_id, c.n_chunks, s.n_sections FROM
  (SELECT chunk_id AS page_id, count(*) AS n_chunks FROM ({VECTORS}) GROUP BY chunk_id) c
  JOIN (SELECT page_id, count(*) AS n_sections FROM ({CONV_SECTIONS}) GROUP BY page_id) s
  ON c.page_id = s.page_id"""

SQL["chunk_text_lookup"] = f"""
SELECT r.page_id, r.sec_pos, r.rank, r.chunk_id, d.text AS content
FROM ({DENSE_TOP5}) r JOIN documents d ON d.doc_id = r.chunk_id"""

# ---------------------------------------------------------------- D
from ..operators import shaping as S  # noqa: E402

NL = "chr(10)"


def str_list(values):
    return "[" + ", ".join(lit(v) for v in values) + "]"


CONV_ARTICLES = f"""
SELECT page_id, key, list(section ORDER BY sec_pos) AS outlines, list(text ORDER BY sec_pos) AS contents
FROM ({CONV_SECTIONS}) GROUP BY page_id, key"""

DENSE_TOP50 = DENSE_TOP5.replace("WHERE rank <= 5", "WHERE rank <= 50")

SECTION_CHUNKS = f"""
SELECT r.*, coalesce(d.text, '') AS chunk FROM ({DENSE_TOP50}) r LEFT JOIN documents d ON d.doc_id = r.chunk_id"""

EXCL = str_list(K.PROMPT_EXCLUDED_SECTIONS)
EXCL_OUTLINE = str_list(K.OUTLINE_EXCLUDED_SECTIONS)

SECTION_CONTEXT = f"""
SELECT q.page_id, q.sec_pos, q.section, c.rank, c.chunk_id, c.chunk
FROM ({VECTOR_QUERIES}) q JOIN ({SECTION_CHUNKS}) c ON q.page_id = c.page_id AND q.sec_pos = c.sec_pos
WHERE NOT list_contains({EXCL}, lower(q.section)) AND c.rank <= 5"""

CONTEXTS = f"""
SELECT page_id, sec_pos, section, list({non_ascii('chunk')} ORDER BY rank) AS docs
FROM ({SECTION_CONTEXT}) GROUP BY page_id, sec_pos, section"""


def numbered_colon(docs):
    return f"array_to_string(list_transform({docs}, lambda d, i: 'Document ' || i || ': ' || d), {NL})"


def fit(head, body, tail, budget=K.PROMPT_BUDGET):
    room = f"greatest(0, {budget} - len({words(head)}) - len({words(tail)}))"
    kept = f"array_to_string(regexp_extract_all({body}, {lit(T.SPACED_WORD)})[1:{room}], '')"
    return f"({head}) || CASE WHEN len({words(body)}) <= {room} THEN {body} ELSE {kept} END || ({tail})"


def page_key(col="page_id"):
    return f"('Topic ' || CAST({col} AS VARCHAR))"


SEC_HEAD = (f"'I have a topic \"' || {page_key()} || '\" and a section \"' || section || "
            f"'\" that contains the following documents:' || {NL}")
OUT_HEAD = f"'I have a topic \"' || {page_key()} || '\" that contains the following documents:' || {NL}"

SQL["section_filter"] = f"""
SELECT page_id, array_to_string(list_filter(outlines, lambda s: NOT list_contains({EXCL}, lower(s))), '|') AS outline
FROM ({CONV_ARTICLES})"""

SQL["clean_outline"] = f"""
SELECT page_id, array_to_string(list_filter(list_transform(outlines, lambda s: replace(s, '_', ' ')),
  lambda s: NOT list_contains({EXCL_OUTLINE}, lower(s))), '|') AS outline
FROM ({CONV_ARTICLES})"""

SQL["outline_explode"] = f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY sec_pos) - 1 AS BIGINT) AS sec_pos, section
FROM ({CONV_SECTIONS})"""

SQL["section_context"] = f"SELECT page_id, sec_pos, section, rank, chunk_id FROM ({SECTION_CONTEXT})"

SQL["numbered_context"] = f"SELECT page_id, sec_pos, {numbered_colon('docs')} AS context FROM ({CONTEXTS})"

_SEC_PROMPTS = f"""
SELECT page_id, sec_pos, {SEC_HEAD} AS head, {numbered_colon('docs')} AS body,
  {lit(K.SECTION_PROMPT_TAIL)} AS tail FROM ({CONTEXTS})"""

SQL["fit_budget"] = f"""
SELECT page_id, sec_pos, CAST(len({words('head')}) + len({words('body')}) + len({words('tail')}) AS BIGINT) AS n_before,
  CAST(len({words(fit('head', 'body', 'tail'))}) AS BIGINT) AS n_after FROM ({_SEC_PROMPTS})"""

SQL["section_prompt"] = f"""
SELECT page_id, sec_pos, '' AS sys_prompt, {fit('head', 'body', 'tail')} AS usr_prompt FROM ({_SEC_PROMPTS})"""

SQL["outline_prompt"] = f"""
WITH best AS (SELECT page_id, chunk_id, chunk, max(score) AS best FROM ({SECTION_CHUNKS}) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY best DESC, chunk_id) AS rank FROM best),
docs AS (SELECT page_id, list({non_ascii('chunk')} ORDER BY rank) AS docs FROM top WHERE rank <= 5 GROUP BY page_id)
SELECT page_id, {fit(OUT_HEAD, numbered_colon('docs'), lit(K.OUTLINE_PROMPT_TAIL))} AS usr_prompt FROM docs"""

_MSGS = f"""
SELECT page_id, sec_pos,
  CASE WHEN section = 'Introduction' THEN '' ELSE {lit(K.WRITER_PROMPTS['writer_per_section'])} END AS system,
  'Keyword: ' || {page_key()} || {NL}
    || CASE WHEN section IS NULL OR section = '' THEN '' ELSE 'Section: ' || section || {NL} END
    || CASE WHEN len(docs) > 0 THEN array_to_string(list_transform(docs, lambda d, i: 'Document [' || i || '] ' || d), {NL}) || {NL}
            ELSE '' END AS user
FROM ({CONTEXTS})"""

SQL["writer_messages"] = f"""
SELECT page_id, sec_pos, CAST(CASE WHEN system = '' THEN 1 ELSE 2 END AS BIGINT) AS n_messages, system, user
FROM ({_MSGS})"""

_TOKENS = f"""
SELECT page_id, sec_pos, CAST({K.TOKENS_BASE} + {K.TOKENS_PER_MESSAGE} + len({tokens("'user'")}) + len({tokens('user')})
  + CASE WHEN system = '' THEN 0 ELSE {K.TOKENS_PER_MESSAGE} + len({tokens("'system'")}) + len({tokens('system')}) END
  AS BIGINT) AS n_tokens FROM ({_MSGS})"""

SQL["message_tokens"] = _TOKENS

SQL["budget_split"] = f"""
SELECT page_id, sec_pos, n_tokens, n_tokens < {dict(K.MODEL_WINDOWS)['gpt-3.5-turbo-0613'] - 800} AS accepted
FROM ({_TOKENS})"""

RESPONSES = """
SELECT conv_id AS page_id, turn AS idx,
  CASE WHEN (conv_id + turn) % 7 = 0 THEN '{}'
       ELSE CAST(json_object('choices', json_array(json_object('message', json_object('content', text)))) AS VARCHAR)
  END AS response
FROM conversations"""

PARSED = f"""
SELECT page_id, idx, coalesce({py_strip("json_extract_string(response, '$.choices[0].message.content')")}, '') AS content
FROM ({RESPONSES})"""

SQL["parse_response"] = PARSED

SQL["ordered_responses"] = f"""
SELECT page_id, CAST(count(*) AS BIGINT) AS n_responses, array_to_string(list(content ORDER BY idx), {NL}) AS text
FROM ({PARSED}) GROUP BY page_id"""

SQL["section_rows_from_article"] = f"""
WITH o AS (SELECT page_id, list(section ORDER BY sec_pos) AS outline FROM ({CONV_SECTIONS}) GROUP BY page_id),
g AS (SELECT page_id, list(text ORDER BY sec_pos) AS gen FROM ({CONV_SECTIONS}) WHERE role = 'assistant' GROUP BY page_id),
a AS (SELECT o.page_id, outline, gen FROM o JOIN g ON o.page_id = g.page_id),
z AS (SELECT page_id, outline, gen, unnest(range(least(len(outline), len(gen)))) AS i FROM a)
SELECT page_id, CAST(i AS BIGINT) AS sec_pos, outline[i + 1] AS outline, gen[i + 1] AS generated_content FROM z"""

SQL["article_regroup"] = f"""
SELECT page_id, CAST(count(*) AS BIGINT) AS n_sections, array_to_string(list(section ORDER BY sec_pos), '|') AS outline,
  array_to_string(list(text ORDER BY sec_pos), {NL}) AS text
FROM ({CONV_SECTIONS}) GROUP BY page_id"""

SQL["rewrite_merge"] = f"""
WITH a AS (SELECT page_id, key, array_to_string(list(text ORDER BY sec_pos), {NL}) AS text
           FROM ({CONV_SECTIONS}) WHERE role = 'assistant' GROUP BY page_id, key),
r AS (SELECT page_id, arg_max(content, idx) AS content FROM ({PARSED}) GROUP BY page_id)
SELECT a.page_id, a.key, concat_ws({NL}, a.key, a.text) AS rewrite_input, r.content AS text
FROM a JOIN r ON a.page_id = r.page_id"""

_LINES = f"""
SELECT page_id, string_split('Here is the outline:' || {NL} || {NL} || array_to_string(list(
  CASE WHEN page_id % 2 = 1 THEN '==' || section || '==' ELSE CAST(sec_pos + 1 AS VARCHAR) || '. ' || section END
  ORDER BY sec_pos), {NL}) || {NL} || 'I hope it helps.', {NL}) AS lines FROM ({CONV_SECTIONS}) GROUP BY page_id"""

SQL["outline_parse"] = f"""
WITH l AS (SELECT page_id, regexp_replace(unnest(lines), '\\r$', '') AS line,
                  generate_subscripts(lines, 1) - 1 AS sec_pos FROM ({_LINES})),
p AS (SELECT page_id, CAST(sec_pos AS BIGINT) AS sec_pos,
        CASE WHEN regexp_matches(line, {lit(S._HEADING_LINE)}) THEN regexp_extract(line, {lit(S._HEADING_LINE)}, 1)
             WHEN regexp_matches(line, {lit(S._NUMBERED_LINE)}) THEN regexp_extract(line, {lit(S._NUMBERED_LINE)}, 1)
        END AS section FROM l)
SELECT * FROM p WHERE section IS NOT NULL AND section <> ''"""

# ---------------------------------------------------------------- E
GENERATED = """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN CAST(json_object('text', l) AS VARCHAR)
                     ELSE CAST(json_object('text', array_to_string(l, ' ')) AS VARCHAR) END AS json
FROM (SELECT conv_id AS page_id, list(text ORDER BY turn) AS l FROM conversations
      WHERE role = 'assistant' GROUP BY conv_id)"""

SQL["flatten_text"] = f"""
SELECT page_id, CASE WHEN json_type(json, '$.text') = 'ARRAY'
                     THEN array_to_string(from_json(json_extract(json, '$.text'), '["VARCHAR"]'), {NL})
                     ELSE json_extract_string(json, '$.text') END AS text
FROM ({GENERATED})"""

GOLD = f"""
SELECT 'conv' AS src, conv_id AS page_id, turn AS sec_pos, text FROM conversations WHERE role = 'user'
UNION ALL SELECT 'doc', doc_id, CAST(0 AS BIGINT), text FROM documents"""

CAND = f"""
SELECT 'conv' AS src, conv_id AS page_id, turn - 1 AS sec_pos, text FROM conversations WHERE role = 'assistant'
UNION ALL SELECT 'doc', doc_id, CAST(0 AS BIGINT),
  array_to_string(list_filter({words('text')}, lambda w, i: i % 7 <> 0), ' ') FROM documents"""

PAIRS = f"""
SELECT g.src, g.page_id, g.sec_pos, g.text AS ref, c.text AS cand
FROM ({GOLD}) g JOIN ({CAND}) c ON g.src = c.src AND g.page_id = c.page_id AND g.sec_pos = c.sec_pos"""

SQL["missing_candidates"] = f"""
SELECT g.src, g.page_id, g.sec_pos FROM ({GOLD}) g
WHERE NOT EXISTS (SELECT 1 FROM ({CAND}) c WHERE g.src = c.src AND g.page_id = c.page_id AND g.sec_pos = c.sec_pos)"""


def _ngrams_sql(col):
    return f"""
SELECT src, page_id, sec_pos, n, g, count(*) AS c FROM (
  SELECT src, page_id, sec_pos, o.n,
    unnest(list_transform(range(1, len(w) - o.n + 2), lambda i: array_to_string(w[i:i + o.n - 1], ' '))) AS g
  FROM (SELECT src, page_id, sec_pos, {words(col)} AS w FROM p) CROSS JOIN (VALUES (1), (2), (3), (4)) o(n))
GROUP BY ALL"""


def _p(n):
    return (f"CASE WHEN coalesce(h{n}, 0) > 0 THEN h{n} / greatest(1, c - {n - 1}) "
            f"ELSE {K.FLOAT_MIN!r} END")


BLEU = f"""
WITH p AS ({PAIRS}),
hc AS ({_ngrams_sql('cand')}),
hr AS ({_ngrams_sql('ref')}),
hits AS (SELECT hc.src, hc.page_id, hc.sec_pos, hc.n, sum(least(hc.c, coalesce(hr.c, 0))) AS hit
         FROM hc LEFT JOIN hr ON hc.src = hr.src AND hc.page_id = hr.page_id AND hc.sec_pos = hr.sec_pos
                              AND hc.n = hr.n AND hc.g = hr.g GROUP BY ALL),
wide AS (SELECT src, page_id, sec_pos, max(hit) FILTER (WHERE n = 1) AS h1, max(hit) FILTER (WHERE n = 2) AS h2,
           max(hit) FILTER (WHERE n = 3) AS h3, max(hit) FILTER (WHERE n = 4) AS h4 FROM hits GROUP BY ALL),
l AS (SELECT src, page_id, sec_pos, len({words('ref')}) AS r, len({words('cand')}) AS c FROM p),
j AS (SELECT l.*, h1, h2, h3, h4,
        CASE WHEN c > r THEN 1.0 WHEN c = 0 THEN 0.0 ELSE exp(1 - r / c) END AS bp
      FROM l LEFT JOIN wide w ON l.src = w.src AND l.page_id = w.page_id AND l.sec_pos = w.sec_pos)
SELECT src, page_id, sec_pos,
  {r6(f"CASE WHEN coalesce(h1, 0) = 0 THEN 0.0 ELSE bp * exp(1.0 * ln({_p(1)})) END")} AS bleu_1,
  {r6(f"CASE WHEN coalesce(h1, 0) = 0 THEN 0.0 ELSE bp * exp(0.25 * ln({_p(1)}) + 0.25 * ln({_p(2)}) + 0.25 * ln({_p(3)}) + 0.25 * ln({_p(4)})) END")} AS bleu_4
FROM j"""

SQL["bleu"] = BLEU

METEOR = f"""
WITH p AS ({PAIRS}),
h AS (SELECT src, page_id, sec_pos, unnest(w) AS w, generate_subscripts(w, 1) AS hp
      FROM (SELECT src, page_id, sec_pos, {words('lower(cand)')} AS w FROM p)),
r AS (SELECT src, page_id, sec_pos, unnest(w) AS w, generate_subscripts(w, 1) AS rp
      FROM (SELECT src, page_id, sec_pos, {words('lower(ref)')} AS w FROM p)),
hk AS (SELECT *, row_number() OVER (PARTITION BY src, page_id, sec_pos, w ORDER BY hp DESC) AS k FROM h),
rk AS (SELECT *, row_number() OVER (PARTITION BY src, page_id, sec_pos, w ORDER BY rp DESC) AS k FROM r),
m AS (SELECT hk.src, hk.page_id, hk.sec_pos, hp, rp FROM hk JOIN rk
      ON hk.src = rk.src AND hk.page_id = rk.page_id AND hk.sec_pos = rk.sec_pos AND hk.w = rk.w AND hk.k = rk.k),
st AS (SELECT m.src, m.page_id, m.sec_pos, count(*) AS m,
         count(*) FILTER (WHERE EXISTS (SELECT 1 FROM m m2 WHERE m2.src = m.src AND m2.page_id = m.page_id
                                        AND m2.sec_pos = m.sec_pos AND m2.hp = m.hp + 1 AND m2.rp = m.rp + 1)) AS cont
       FROM m GROUP BY ALL),
l AS (SELECT src, page_id, sec_pos, len({words('ref')}) AS rl, len({words('cand')}) AS hl FROM p),
j AS (SELECT l.*, coalesce(st.m, 0) AS m, coalesce(st.cont, 0) AS cont FROM l LEFT JOIN st
      ON l.src = st.src AND l.page_id = st.page_id AND l.sec_pos = st.sec_pos),
f AS (SELECT *, (m / hl) AS pr, (m / rl) AS rc FROM j)
SELECT src, page_id, sec_pos,
  {r6(f"CASE WHEN m = 0 THEN 0.0 ELSE (1 - {K.METEOR_GAMMA} * pow((m - cont) / m, {K.METEOR_BETA})) * (pr * rc / (CAST({K.METEOR_ALPHA} AS DOUBLE) * pr + (1 - CAST({K.METEOR_ALPHA} AS DOUBLE)) * rc)) END")} AS meteor
FROM f"""

SQL["meteor_exact"] = METEOR

SQL["metric_summary"] = f"""
WITH b AS ({BLEU}), m AS ({METEOR}), p AS ({PAIRS}),
s AS (SELECT b.src, b.bleu_1, b.bleu_4, m.meteor, len({tokens('p.cand')}) AS length
      FROM b JOIN m ON b.src = m.src AND b.page_id = m.page_id AND b.sec_pos = m.sec_pos
      JOIN p ON p.src = b.src AND p.page_id = b.page_id AND p.sec_pos = b.sec_pos)
SELECT src, count(*) AS n_pairs, {r6('avg(bleu_1) * 100')} AS bleu_1, {r6('avg(bleu_4) * 100')} AS bleu_4,
  {r6('avg(meteor) * 100')} AS meteor, {r6('avg(length)')} AS avg_length
FROM s GROUP BY src"""

CITED = f"""
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, {lit(X.SENTENCE)}),
  lambda x, i: CASE WHEN i % 4 <> 0 THEN x || '[' || CAST(i % 7 AS VARCHAR) || ']'
    || CASE WHEN i % 5 = 0 THEN '[' || CAST((i + 2) % 7 AS VARCHAR) || ']' ELSE '' END ELSE x END), '') AS text
FROM documents"""

UNITS = f"""
WITH pc AS (SELECT doc_id, string_split(regexp_replace(text, {lit('(' + T.MARKER + ')')}, chr(1) || '\\1' || chr(1), 'g'),
                                        chr(1)) AS parts FROM ({CITED})),
pe AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS p FROM pc),
pn AS (SELECT *, sum(CASE WHEN NOT regexp_matches(s, {lit('^' + T.MARKER + '$')}) AND s <> '' AND s <> chr(10)
                     THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS u FROM pe),
un AS (SELECT doc_id, u, string_agg(s, '' ORDER BY p) AS unit FROM pn GROUP BY doc_id, u)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY u) - 1 AS BIGINT) AS unit_pos, unit
FROM un WHERE u > 0 OR unit <> ''"""

SQL["citation_units"] = UNITS

SQL["citation_ids"] = f"""
SELECT doc_id, unit_pos, regexp_replace(unit, {lit(T.MARKER)}, '', 'g') AS hypothesis,
  array_to_string(list_transform(regexp_extract_all(unit, '\\[([0-9]+)\\]', 1), lambda x: CAST(x AS BIGINT) - 1), ',') AS cites
FROM ({UNITS})"""

PREMISES = f"""
WITH c AS (SELECT doc_id, unit_pos, regexp_replace(unit, {lit(T.MARKER)}, '', 'g') AS hypothesis,
                  list_transform(regexp_extract_all(unit, '\\[([0-9]+)\\]', 1), lambda x: CAST(x AS BIGINT) - 1) AS ids
           FROM ({UNITS})),
e AS (SELECT doc_id, unit_pos, hypothesis, unnest(ids) AS idx, generate_subscripts(ids, 1) - 1 AS cite_pos FROM c)
SELECT e.doc_id, e.unit_pos, CAST(e.cite_pos AS BIGINT) AS cite_pos, e.idx, e.hypothesis,
  coalesce(d.text, ' ') AS premise
FROM e LEFT JOIN documents d ON d.doc_id = e.doc_id + 1 + e.idx AND e.idx BETWEEN 0 AND 4"""

SQL["citation_premises"] = f"""
SELECT doc_id, unit_pos, cite_pos, idx, md5(premise) AS premise_md5, CAST(length(premise) AS BIGINT) AS premise_chars
FROM ({PREMISES})"""

SQL["nli_inputs"] = f"""
SELECT doc_id, unit_pos, cite_pos, md5('premise: ' || premise || ' hypothesis: ' || hypothesis) AS input_md5,
  CAST(length('premise: ' || premise || ' hypothesis: ' || hypothesis) AS BIGINT) AS input_chars
FROM ({PREMISES})"""

_W = "'[\\p{L}\\p{N}_]+'"
LABELS = f"""
SELECT doc_id, unit_pos, cite_pos,
  CASE WHEN len(h) > 0 AND len(list_intersect(h, p)) / len(h) >= 0.5 THEN '1' ELSE '0' END AS label
FROM (SELECT doc_id, unit_pos, cite_pos, list_distinct(regexp_extract_all(lower(hypothesis), {_W})) AS h,
        list_distinct(regexp_extract_all(lower(premise), {_W})) AS p FROM ({PREMISES}))"""

SQL["lexical_support"] = LABELS

UNIT_LABELS = f"""
SELECT u.doc_id, u.unit_pos, coalesce(l.labels, []) AS labels
FROM ({UNITS}) u LEFT JOIN (SELECT doc_id, unit_pos, list(label ORDER BY cite_pos) AS labels FROM ({LABELS})
                            GROUP BY doc_id, unit_pos) l ON u.doc_id = l.doc_id AND u.unit_pos = l.unit_pos"""

SQL["unit_labels"] = f"SELECT doc_id, unit_pos, array_to_string(labels, ',') AS labels FROM ({UNIT_LABELS})"

SQL["citation_scores"] = f"""
WITH pu AS (SELECT doc_id,
  CASE WHEN len(labels) > 0 THEN 1 - len(list_filter(labels, lambda x: x = '0')) / len(labels) ELSE 0.0 END AS pre,
  CASE WHEN len(list_filter(labels, lambda x: x = '1')) > 0 THEN 1.0 ELSE 0.0 END AS rec FROM ({UNIT_LABELS})),
pa AS (SELECT doc_id, avg(pre) AS pre, avg(rec) AS rec FROM pu GROUP BY doc_id),
al AS (SELECT d.doc_id, pa.pre, pa.rec FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN pa ON d.doc_id = pa.doc_id)
SELECT count(*) AS n_articles, {r6('avg(coalesce(rec, 0.0))')} AS citation_recall,
  {r6('avg(coalesce(pre, 0.0))')} AS citation_precision FROM al"""

REPLIES = f"""
SELECT l.doc_id, {first_words('d.text')} AS keyword, d.text,
  CASE WHEN l.doc_id % 11 = 0 THEN 'n/a' ELSE 'Fluency:' || CAST(l.doc_id % 8 AS VARCHAR) || ',Informativeness:'
    || CAST(l.quality * 5 + l.toxic AS VARCHAR) || ' Faithfulness:' || CAST((l.doc_id * 7) % 10 AS VARCHAR) END AS reply
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""

SQL["judge_prompt"] = f"""
SELECT doc_id, md5(replace(replace({lit(K.JUDGE_USER_TEMPLATE)}, '{{KEYWORD}}', keyword), '{{WIKITEXT}}', text)) AS prompt_md5,
  CAST(length(replace(replace({lit(K.JUDGE_USER_TEMPLATE)}, '{{KEYWORD}}', keyword), '{{WIKITEXT}}', text)) AS BIGINT) AS prompt_chars
FROM ({REPLIES})"""

SCORES = f"""
SELECT doc_id, CASE WHEN len(nums) = 3 THEN list_transform(nums, lambda x: CASE WHEN TRY_CAST(x AS BIGINT) <= {K.JUDGE_MAX_SCORE}
    THEN TRY_CAST(x AS BIGINT) ELSE CAST(0 AS BIGINT) END) ELSE [CAST(0 AS BIGINT), 0, 0] END AS s
FROM (SELECT doc_id, regexp_extract_all(coalesce(reply, ''), '([0-9]+)', 1)[1:3] AS nums FROM ({REPLIES}))"""

SQL["judge_scores"] = f"SELECT doc_id, s[1] AS fluency, s[2] AS informativeness, s[3] AS faithfulness FROM ({SCORES})"

SQL["judge_summary"] = f"""
SELECT count(*) AS n, {r6('avg(s[1])')} AS fluency, {r6('avg(s[2])')} AS informativeness,
  {r6('avg(s[3])')} AS faithfulness FROM ({SCORES})"""

# ---------------------------------------------------------------- A
SQL["resume_pending"] = """
SELECT doc_id, source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic <> 1 AND l.doc_id = d.doc_id)"""

SQL["incremental_ingest"] = f"""
SELECT page_id, url, CAST(length({html_text('html')}) AS BIGINT) AS n_chars FROM pages"""

SQL["hash_embed"] = f"""
WITH b AS (SELECT page_id, doc_id, list_transform({tokens("coalesce(content, '')")},
             lambda t: CAST(('0x' || substr(md5(t), 25, 8)) AS BIGINT) % 64) AS b FROM ({ARTICLE_DOCS})),
c AS (SELECT page_id, doc_id, list_transform(range(64), lambda i: len(list_filter(b, lambda x: x = i))) AS c FROM b),
n AS (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM c)
SELECT page_id, doc_id, array_to_string(list_transform(c, lambda x: CAST(round(
  CASE WHEN n > 0 THEN CAST(CAST(x / n AS FLOAT) AS DOUBLE) * 10000 ELSE 0 END) AS BIGINT)), ',') AS embedding_e4
FROM n"""


def _two(rows: str, keys: str, system: str, user: str) -> str:
    limit = dict(K.MODEL_WINDOWS)["gpt-3.5-turbo-0613"]
    n = (f"{K.TOKENS_BASE} + 2 * {K.TOKENS_PER_MESSAGE} + len({tokens(lit('system'))}) + len({tokens(lit('user'))})"
         f" + len({tokens('s')}) + len({tokens('u')})")
    return f"""SELECT {keys}, CAST(2 AS BIGINT) AS n_messages, md5(s) AS system_md5, md5(u) AS user_md5, ({n}) < {limit} AS accepted
FROM (SELECT {keys}, {lit(system)} AS s, {user} AS u FROM ({rows}))"""


SQL["rewrite_requests"] = _two(
    f"SELECT page_id, key, array_to_string(list(text ORDER BY sec_pos), {NL}) AS text FROM ({CONV_SECTIONS}) GROUP BY page_id, key",
    "page_id", K.WRITER_PROMPTS["rewrite"], f"'Original Passage:' || {NL} || key || {NL} || text")

SQL["outline_requests"] = _two(
    CONTEXTS, "page_id, sec_pos", K.WRITER_PROMPTS["outline"],
    f"""'Keyword: ' || {page_key()} || {NL} || CASE WHEN len(docs) > 0 THEN array_to_string(list_transform(docs,
      lambda d, i: 'Document [' || i || '] ' || d), {NL}) || {NL} ELSE '' END""")

SQL["judge_requests"] = _two(
    REPLIES, "doc_id", K.JUDGE_SYSTEM_PROMPT,
    f"replace(replace({lit(K.JUDGE_USER_TEMPLATE)}, '{{KEYWORD}}', keyword), '{{WIKITEXT}}', text)")

SQL["prompt_records"] = f"""
SELECT page_id, key, array_to_string(list(section ORDER BY sec_pos), '|') AS outline,
  md5(array_to_string(list(text ORDER BY sec_pos), '|')) AS chunks_md5, count(*) AS n_prompts,
  md5(array_to_string(list(section || {NL} || text ORDER BY sec_pos), '|')) AS prompts_md5
FROM ({CONV_SECTIONS}) GROUP BY page_id, key"""

# the stored index ranks as the exhaustive search does
SQL["bm25_index_topk"] = SQL["bm25_topk"]
SQL["tfidf_index_topk"] = SQL["tfidf_topk"]

SQL["outline_map_split"] = SQL["outline_explode"]

SQL["search_results_split"] = "SELECT page_id, url, md5(html) AS text_md5 FROM pages"

SQL["ingest_new_ids"] = "SELECT page_id, url FROM pages"

SQL["article_stream"] = f"""
WITH s AS ({CONV_SECTIONS}),
r AS (SELECT *, CASE WHEN (page_id + sec_pos) % 7 <> 0 THEN text END AS reply FROM s)
SELECT page_id, array_to_string(list(section ORDER BY sec_pos), '|') AS sections,
  md5(array_to_string(list(coalesce(reply, '') ORDER BY sec_pos), '|')) AS texts_md5,
  CAST(sum(CASE WHEN reply IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing,
  CAST(max(CASE WHEN reply IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS timed_out
FROM r GROUP BY page_id"""

SQL["page_sections"] = f"""
WITH s AS ({CONV_SECTIONS}),
h AS (SELECT page_id, sec_pos, section, CAST(2 + (sec_pos * sec_pos + page_id) % 3 AS BIGINT) AS level,
  text || CASE WHEN sec_pos % 3 = 0 THEN chr(10) || '[https://example.org/' || (sec_pos % 4) || ' more]' ELSE '' END AS body FROM s),
lead AS (SELECT page_id, {collapse('body')} AS summary FROM h WHERE sec_pos = 0),
links AS (SELECT page_id, array_to_string(list(url ORDER BY first), ' ') AS links FROM (
  SELECT page_id, 'https://example.org/' || (sec_pos % 4) AS url, min(sec_pos) AS first FROM h WHERE sec_pos % 3 = 0 GROUP BY ALL) GROUP BY page_id),
up AS (SELECT a.page_id, a.sec_pos, b.sec_pos AS up_pos, b.section AS up_name FROM h a JOIN h b ON a.page_id = b.page_id
  AND b.sec_pos <= a.sec_pos AND b.sec_pos > 0 AND a.sec_pos > 0
  AND (b.sec_pos = a.sec_pos OR b.level < (SELECT min(m.level) FROM h m WHERE m.page_id = a.page_id AND m.sec_pos > b.sec_pos AND m.sec_pos <= a.sec_pos)))
SELECT h.page_id, lead.summary, coalesce(links.links, '') AS links, h.sec_pos - 1 AS pos, h.level,
  p.path, {collapse('h.body')} AS text
FROM h JOIN lead USING (page_id) LEFT JOIN links USING (page_id)
JOIN (SELECT page_id, sec_pos, array_to_string(list(up_name ORDER BY up_pos), ' > ') AS path FROM up GROUP BY page_id, sec_pos) p
  ON p.page_id = h.page_id AND p.sec_pos = h.sec_pos
WHERE h.sec_pos > 0"""

_RECORD_SECTIONS = """
WITH a AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role = 'assistant'),
m AS (SELECT conv_id, i, turn, text AS own, text || '[' || (i % 4) || '][1]' AS marked FROM a),
fu AS (SELECT a.conv_id, a.turn, arg_min(u.text, u.turn) AS first_user FROM a JOIN conversations u
  ON u.conv_id = a.conv_id AND u.role = 'user' AND u.turn < a.turn GROUP BY a.conv_id, a.turn),
us AS (SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT m.conv_id AS page_id, i AS sec_pos, marked AS text, [coalesce(fu.first_user, 'none'), own] AS docs
FROM m LEFT JOIN fu ON fu.conv_id = m.conv_id AND fu.turn = m.turn WHERE m.conv_id % 2 = 0
UNION ALL
SELECT m.conv_id, 0, string_agg(marked, chr(10) ORDER BY m.turn), any_value(us.texts)
FROM m LEFT JOIN us ON us.conv_id = m.conv_id WHERE m.conv_id % 2 = 1 GROUP BY m.conv_id"""

SQL["section_premises"] = f"""
WITH sec AS ({_RECORD_SECTIONS}),
pe AS (SELECT page_id, sec_pos, unnest(parts) AS s, generate_subscripts(parts, 1) AS p FROM (
  SELECT page_id, sec_pos, string_split(regexp_replace(text, {lit('(' + T.MARKER + ')')}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM sec)),
pn AS (SELECT *, sum(CASE WHEN NOT regexp_matches(s, {lit('^' + T.MARKER + '$')}) AND s <> '' AND s <> chr(10) THEN 1 ELSE 0 END)
  OVER (PARTITION BY page_id, sec_pos ORDER BY p ROWS UNBOUNDED PRECEDING) AS u FROM pe),
un AS (SELECT page_id, sec_pos, u, string_agg(s, '' ORDER BY p) AS unit FROM pn GROUP BY page_id, sec_pos, u),
uu AS (SELECT page_id, sec_pos, row_number() OVER (PARTITION BY page_id, sec_pos ORDER BY u) - 1 AS unit_pos, unit FROM un WHERE u > 0 OR unit <> ''),
c AS (SELECT page_id, sec_pos, unit_pos, regexp_replace(unit, {lit(T.MARKER)}, '', 'g') AS hypothesis,
  list_transform(regexp_extract_all(unit, '\\[([0-9]+)\\]', 1), lambda x: CAST(x AS BIGINT) - 1) AS ids FROM uu),
e AS (SELECT *, unnest(ids) AS idx, generate_subscripts(ids, 1) - 1 AS cite_pos FROM c)
SELECT e.page_id, CAST(e.sec_pos AS BIGINT) AS sec_pos, CAST(unit_pos AS BIGINT) AS unit_pos, CAST(cite_pos AS BIGINT) AS cite_pos, idx,
  md5(hypothesis) AS hypothesis_md5,
  md5(CASE WHEN idx >= 0 AND idx < len(sec.docs) THEN coalesce(sec.docs[idx + 1], ' ') ELSE ' ' END) AS premise_md5
FROM e JOIN sec ON sec.page_id = e.page_id AND sec.sec_pos = e.sec_pos"""

SQL["article_files"] = f"""
SELECT page_id, any_value(key) AS key, array_to_string(list(section ORDER BY sec_pos), '|') AS outlines,
  md5(array_to_string(list(text ORDER BY sec_pos), '|')) AS contents_md5
FROM ({CONV_SECTIONS}) GROUP BY page_id
UNION ALL SELECT NULL, 'rejected', '{{"id": 1, "outlines": ["cut' || chr(10), NULL"""

SQL["search_files"] = SQL["search_results_split"]

SQL["retrieval_files"] = f"""
SELECT r.page_id, CAST(dense_rank() OVER (PARTITION BY r.page_id ORDER BY r.sec_pos) - 1 AS BIGINT) AS sec_pos, q.section, r.rank, r.chunk_id
FROM ({SQL["dense_topk"]}) r JOIN ({VECTOR_QUERIES}) q ON q.page_id = r.page_id AND q.sec_pos = r.sec_pos"""

SQL["dataset_files"] = f"""
WITH a AS (SELECT page_id, doc_id, CAST(length(content) AS BIGINT) AS n_chars FROM ({ARTICLE_DOCS}))
SELECT *, 'all' AS kind FROM a UNION ALL SELECT *, 'lines' FROM a UNION ALL SELECT *, 'good' FROM a WHERE n_chars < 2000
UNION ALL SELECT NULL, doc_id, NULL, 'log' FROM a WHERE n_chars >= 2000"""

SQL["retrieve_indices"] = f"SELECT query_id, page_id, rank, doc_id FROM ({SQL['tfidf_topk']})"

SQL["attach_responses"] = """
SELECT u.conv_id, u.turn, upper(u.role) AS kind, md5(u.text) AS asked_md5, a.text
FROM conversations u JOIN (SELECT conv_id, turn - 1 AS turn, max(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY ALL) a
  ON a.conv_id = u.conv_id AND a.turn = u.turn WHERE u.role = 'user'"""

SQL["article_records"] = f"""
SELECT page_id, array_to_string(list(section ORDER BY sec_pos), '|') AS outline,
  md5(array_to_string(list(section || ': ' || docs[1] ORDER BY sec_pos), '|')) AS text_md5,
  md5(array_to_string(list(array_to_string(docs, '~') ORDER BY sec_pos), '|')) AS retrieve_md5
FROM ({CONTEXTS}) GROUP BY page_id"""

SQL["chunk_text_lookup_bucketed"] = f"SELECT page_id, sec_pos, rank, chunk_id, md5(content) AS text_md5 FROM ({SQL['chunk_text_lookup']})"
