"""SQL (DuckDB) with the rows of the catalog's queries."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


_TOKENS = r"'[\p{L}\p{N}\p{Co}_][\p{L}\p{N}\p{Co}\p{Mn}_]*'"
_QUERY = r"list_filter(regexp_extract_all({}, '[A-Za-z0-9_]+'), lambda x: length(x) > 2)"

ORACLE["lines_nonblank"] = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, CAST(pos AS INT) AS pos, {_trim('x')} AS line FROM l WHERE {_trim('x')} <> ''
"""
ORACLE["html_layout"] = """
SELECT page_id, CAST(generate_subscripts(string_split(html, '<'), 1) - 1 AS INT) AS pos, unnest(string_split(html, '<')) AS chunk FROM pages
"""
_TITLES = "'title','h1','h2','h3','p','li'"
_AROUND = "'article','aside','body','footer','head','header','html','main','menu','nav','ol','section','ul'"
_INSIDE = """'address','blockquote','dd','details','div','dl','dt','fieldset','figcaption','figure','form','h4','h5','h6','hr','pre','summary',
'table','caption','tbody','td','tfoot','th','thead','tr'"""
_PAGE = "OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"
ORACLE["html_headings"] = rf"""
WITH r AS ({ORACLE["html_layout"]}), t AS (SELECT *, regexp_extract(chunk, '^(/?[a-z][a-z0-9]*)[^>]*>', 1) AS tag FROM r),
o AS (SELECT *, ltrim(tag, '/') AS name, last_value(CASE WHEN ltrim(tag, '/') IN ('script','style') THEN tag IN ('script','style') END IGNORE NULLS) {_PAGE} AS raw FROM t),
s AS (SELECT *, last_value(CASE WHEN tag IN ({_TITLES}) THEN pos END IGNORE NULLS) {_PAGE} AS start,
             last_value(CASE WHEN tag IN ({_TITLES}) THEN tag END IGNORE NULLS) {_PAGE} AS elem FROM o WHERE NOT coalesce(raw, false)),
e AS (SELECT *, last_value(CASE WHEN tag = '/' || elem OR name IN ({_AROUND}) OR (elem <> 'li' AND name IN ({_INSIDE}, {_TITLES}) AND pos > start) THEN pos END IGNORE NULLS) {_PAGE} AS ended FROM s),
p AS (SELECT page_id, start AS pos, elem, {_trim(f"""string_agg(CASE WHEN tag = 'br' OR name IN ({_INSIDE}, {_TITLES}) THEN chr(10) ELSE '' END
             || CASE WHEN regexp_matches(chunk, '^[a-zA-Z/!?]') THEN regexp_replace(chunk, '^[^>]*(>|$)', '') ELSE '<' || chunk END, '' ORDER BY pos)""")} AS text
      FROM e WHERE coalesce(ended, -1) < start GROUP BY page_id, start, elem)
SELECT page_id, pos, CASE WHEN elem IN ('p','li') THEN 'para' ELSE 'heading' END AS kind,
       CASE WHEN elem IN ('title','h1') THEN 1 WHEN elem IN ('h2','h3') THEN 2 ELSE 0 END AS level, text FROM p WHERE text <> ''
"""
ORACLE["line_class_share"] = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
w AS (SELECT doc_id, line, unnest(string_split(x, ' ')) AS w, generate_subscripts(string_split(x, ' '), 1) AS span FROM l),
c AS (SELECT *, {_trim('w')} <> '' AS solid,
      CASE WHEN regexp_matches(w, '[0-9]') THEN 'code' WHEN regexp_matches(w, '^[A-Z]') THEN 'head' ELSE 'body' END AS cls FROM w),
g AS (SELECT doc_id, line, string_agg(w || ' ', '' ORDER BY span) AS t, avg(CASE WHEN cls = 'head' THEN 1.0 ELSE 0 END) FILTER (solid) AS share,
      max(length(w)) FILTER (solid) AS size, bool_and(cls = 'code') FILTER (solid) AS code FROM c GROUP BY doc_id, line HAVING count(*) FILTER (solid) > 0),
k AS (SELECT *, CASE WHEN share >= 0.6 THEN 'heading' WHEN code THEN 'code' ELSE 'para' END AS kind FROM g)
SELECT doc_id, CAST(line AS INT) AS line, kind, CASE WHEN kind <> 'heading' THEN 0 WHEN size >= 8 THEN 1 ELSE 2 END AS level,
       CASE WHEN kind = 'code' THEN regexp_replace(t, '{SPACE}+$', '') ELSE {_trim('t')} END AS text FROM k
"""
ORACLE["page_range_scan"] = """
WITH r(chapter, span_ord, a, b) AS (VALUES ('1', 1, 10, 99), ('2', 2, 100, 399), ('a', 3, 50, 149), ('b', 4, 700, 1000000000))
SELECT chapter, CAST(span_ord AS BIGINT) AS span_ord, doc_id, n_chars FROM documents JOIN r ON doc_id BETWEEN a AND b WHERE doc_id >= 1
"""
ORACLE["figure_filter"] = """
SELECT p_partkey AS doc_id, '[FIGURE ' || p_size || 'x' || CAST(trunc(p_retailprice) AS INT) || ']' AS text FROM part WHERE p_size * p_retailprice >= 5000
"""


def _events(kinds: dict[str, tuple[str, int]]) -> str:
    kind = " ".join(f"WHEN '{n}' THEN '{k}'" for n, (k, _) in kinds.items())
    level = " ".join(f"WHEN '{n}' THEN {v}" for n, (_, v) in kinds.items())
    return f"""e AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord,
  CASE event_type {kind} ELSE 'para' END AS kind, CASE event_type {level} ELSE 0 END AS level, CAST(event_id % 100 AS INT) AS page,
  CASE event_type WHEN 'signup' THEN 'Chapter ' || event_id WHEN 'error' THEN (event_id % 7) || '.' || (event_id % 5) ELSE event_type || ' ' || event_id END AS text FROM events)"""


_UPTO = "OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)"
ORACLE["chapter_spans"] = f"""
WITH {_events({"signup": ("heading", 1)})},
m AS (SELECT *, CASE WHEN level = 1 THEN regexp_extract(text, '^Chapter ([0-9]+)', 1) END AS id FROM e),
s AS (SELECT doc_id, ord, last_value(id IGNORE NULLS) {_UPTO} AS chapter, count(id) {_UPTO} AS span_ord,
      last_value(CASE WHEN id IS NOT NULL THEN ord END IGNORE NULLS) {_UPTO} AS span_start, max(ord) OVER (PARTITION BY doc_id) + 1 AS n FROM m),
f AS (SELECT DISTINCT doc_id, span_start FROM s WHERE chapter IS NOT NULL),
e2 AS (SELECT doc_id, span_start, lead(span_start) OVER (PARTITION BY doc_id ORDER BY span_start) AS nxt FROM f)
SELECT s.doc_id, s.ord, chapter, span_ord, s.span_start, coalesce(nxt, n) AS span_end FROM s JOIN e2 USING (doc_id, span_start)
"""
ORACLE["section_ffill"] = f"""
WITH {_events({"error": ("heading", 2)})}
SELECT doc_id, ord, coalesce(last_value(CASE WHEN level = 2 THEN text END IGNORE NULLS) {_UPTO}, CAST(doc_id AS VARCHAR)) AS section FROM e
"""
ORACLE["stop_rule"] = f"""
WITH {_events({"signup": ("heading", 1), "view": ("figure", 0)})},
b AS (SELECT * FROM e WHERE kind <> 'figure'),
first_body AS (SELECT doc_id, min(ord) AS o FROM b WHERE kind <> 'heading' OR level = 2 GROUP BY doc_id),
stop AS (SELECT b.doc_id, min(b.ord) AS o FROM b JOIN first_body f ON b.doc_id = f.doc_id AND b.ord > f.o WHERE b.level = 1 GROUP BY b.doc_id)
SELECT b.doc_id, b.ord, b.kind FROM b LEFT JOIN stop USING (doc_id) WHERE stop.o IS NULL OR b.ord < stop.o
"""
ORACLE["code_runs"] = f"""
WITH {_events({"purchase": ("code", 0), "view": ("figure", 0)})},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - row_number() OVER (PARTITION BY doc_id, kind ORDER BY ord) AS run FROM e WHERE kind <> 'figure')
SELECT doc_id, min(ord) AS ord, string_agg(text, chr(10) ORDER BY ord) AS text, arg_min(page, ord) AS page FROM r WHERE kind = 'code' GROUP BY doc_id, run
"""
ORACLE["prose_runs"] = f"""
WITH {_events({"signup": ("heading", 2), "error": ("heading", 2), "purchase": ("code", 0), "view": ("figure", 0)})},
s AS (SELECT *, coalesce(last_value(CASE WHEN level = 2 AND regexp_matches(text, '^[0-9]+[.][0-9]+') THEN text END IGNORE NULLS) {_UPTO}, CAST(doc_id AS VARCHAR)) AS section
      FROM e WHERE kind <> 'figure'),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - row_number() OVER (PARTITION BY doc_id, kind ORDER BY ord) AS run FROM s)
SELECT doc_id, min(ord) AS unit_ord, any_value(section) AS section, string_agg(text, chr(10) ORDER BY ord) AS text, arg_min(page, ord) AS page, kind = 'code' AS is_code
FROM r WHERE kind IN ('para', 'code') GROUP BY doc_id, kind, CASE WHEN kind = 'code' THEN ord ELSE run END
"""
ORACLE["section_texts"] = f"""
WITH e AS (SELECT conv_id AS doc_id, turn AS ord, role = 'user' AS head, CASE WHEN role = 'user' THEN turn || '.0' ELSE text END AS text FROM conversations),
s AS (SELECT *, coalesce(last_value(CASE WHEN head THEN text END IGNORE NULLS) {_UPTO}, CAST(doc_id AS VARCHAR)) AS section,
      sum(CASE WHEN head THEN 1 ELSE 0 END) {_UPTO} AS run FROM e)
SELECT doc_id, section, coalesce(string_agg(text, chr(10) ORDER BY ord) FILTER (NOT head), '') AS section_text, count(DISTINCT run) FILTER (NOT head) AS n_units
FROM s GROUP BY doc_id, section
"""
ORACLE["unit_key"] = """
SELECT doc_id, sha1(source || '|' || CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END || '|' || text)[1:12] AS key FROM documents
"""
ORACLE["dedup_last_wins"] = """
SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, min(event_id) AS position FROM events GROUP BY user_id
"""
ORACLE["pending_anti"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE coalesce(toxic, 0) = 0)"
ORACLE["principle_override"] = """
SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS chapter, coalesce(CASE WHEN r_name <> 'AFRICA' THEN lower(r_name) END, '') AS principle
FROM customer LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey
"""
ORACLE["card_render"] = r"""
WITH n AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT r_name, 'principle: ' || r_name || chr(10) || 'name: ' || array_to_string(list_transform(string_split(lower(r_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ')
  || chr(10) || 'vocabulary:' || chr(10) || string_agg('  - ' || n_name, chr(10) ORDER BY n_name)
  || coalesce(chr(10) || 'red_flags:' || chr(10) || string_agg('  - ' || n_name, chr(10) ORDER BY n_name) FILTER (n_nationkey % 5 = 0), '') AS card FROM n GROUP BY r_name)
SELECT n_nationkey, CASE WHEN n_nationkey < 22 THEN card ELSE '' END AS card FROM n JOIN c USING (r_name)
"""
ORACLE["code_type_force"] = """
SELECT conv_id, turn, CASE role WHEN 'system' THEN 'code' WHEN 'user' THEN 'example' ELSE 'rationale' END AS type,
       sha1(role || '|' || CASE WHEN role = 'system' THEN 'True' ELSE 'False' END || '|' || text)[1:12] AS key, 0 AS needs_enrich FROM conversations
"""
ORACLE["prompt_render"] = """
SELECT doc_id, 'CARD {of} the source:' || chr(10) || source || chr(10) || 'SECTION:' || chr(10) || lang || chr(10) || 'PASSAGE:' || chr(10) || text AS prompt
FROM labels JOIN documents USING (doc_id)
"""
ORACLE["ctx_size"] = """
WITH n AS (SELECT max(length(text) + 20) // 3 + 2048 AS need FROM documents)
SELECT CAST(greatest(8192, least(need, 32768)) AS BIGINT) AS num_ctx, need > 32768 AS over_cap FROM n
"""
ORACLE["build_report"] = """
SELECT lang AS chapter, count(*) AS units, CAST(count(*) FILTER (quality IS NULL) AS BIGINT) AS failed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)
"""
ORACLE["facet_audit"] = """
WITH u AS (SELECT source, lang, CASE WHEN quality = 1 THEN 'example' ELSE 'rationale' END AS type, CAST(coalesce(toxic, 0) AS VARCHAR) AS todo FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'chapter' AS facet, lang AS value, count(*) AS n FROM u GROUP BY lang UNION ALL SELECT 'principle', source, count(*) FROM u GROUP BY source
UNION ALL SELECT 'type', type, count(*) FROM u GROUP BY type UNION ALL SELECT 'needs_enrich', todo, count(*) FROM u GROUP BY todo UNION ALL SELECT 'all', '', count(*) FROM u
"""
ORACLE["resumed_order"] = """
WITH t AS (SELECT conv_id AS doc_id, CASE WHEN turn < 3 THEN '1' ELSE '2' END AS chapter, sha1(text) AS digest, turn AS seq, (conv_id + turn * 2) % 3 AS attempt FROM conversations),
u AS (SELECT doc_id, chapter, digest, min(seq) FILTER (seq < 6) AS place, coalesce(max(seq) FILTER (seq < 6), arg_max(seq, attempt * 1000 + seq)) AS page, arg_max(attempt, attempt * 1000 + seq) AS attempt, min(attempt * 1000 + seq) AS saved FROM t GROUP BY ALL),
e AS (SELECT doc_id, chapter, max(seq) AS last FROM t WHERE seq < 6 GROUP BY ALL)
SELECT row_number() OVER (ORDER BY doc_id, coalesce(place, last), place IS NULL, saved) AS id, doc_id, chapter, digest, CAST(page AS INT) AS page, CAST(attempt AS INT) AS attempt FROM u JOIN e USING (doc_id, chapter)
"""
ORACLE["committed_batches"] = """
SELECT conv_id AS doc_id, role AS chapter, CAST(turn AS BIGINT) AS seq, CASE WHEN role = 'system' THEN 1 ELSE 0 END AS attempt, sha1(text) AS key FROM conversations
WHERE CASE WHEN role = 'system' THEN turn = 0 AND conv_id % 3 = 2 ELSE conv_id % 3 < 2 END
"""
ORACLE["enrich_stub"] = """
SELECT conv_id * 1000 + turn AS seq, sha1(role || '|' || CASE WHEN role = 'system' THEN 'True' ELSE 'False' END || '|' || text)[1:12] AS key, CAST(conv_id AS VARCHAR) AS chapter,
       role AS section, CAST(turn AS INT) AS page, 'stub' AS enrich_model, 0 AS needs_enrich, 'p' AS principle, CASE WHEN role = 'system' THEN 'code' ELSE 'example' END AS type,
       'c' AS context_line, 'w' AS applies_when, 'k1 k2' AS key_terms, 'q' AS questions FROM conversations
"""
ORACLE["match_query_text"] = f"""
SELECT item_id, array_to_string(list_transform({_QUERY.format('text')}, lambda x: x || '*'), ' OR ') AS match, len({_QUERY.format('text')}) AS n_tokens FROM benchmark
"""


def _index(units: str, columns: dict[str, float]) -> str:
    """CTEs tok (id, col, term), dl (id, dl), tf (term, id, wtf), stat (n, avgdl) of a relation with id and text columns."""
    toks = " UNION ALL ".join(f"SELECT id, {w} AS w, unnest(regexp_extract_all({c}, {_TOKENS})) AS t FROM {units}" for c, w in columns.items())
    lens = " + ".join(f"len(regexp_extract_all({c}, {_TOKENS}))" for c in columns)
    return f"""tok AS (SELECT id, w, {_fold('t')} AS term FROM ({toks})), dl AS (SELECT id, {lens} AS dl FROM {units}),
tf AS (SELECT term, id, sum(w) AS wtf FROM tok GROUP BY term, id), stat AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"""


_BM25 = """x AS (SELECT prefix, term FROM (SELECT DISTINCT prefix FROM q) JOIN (SELECT DISTINCT term FROM tf) ON starts_with(term, prefix)),
f AS (SELECT prefix, id, sum(wtf) AS f FROM x JOIN tf USING (term) GROUP BY prefix, id),
n AS (SELECT prefix, count(*) AS df FROM f GROUP BY prefix),
s AS (SELECT q.case_id, f.id, -sum(CASE WHEN ln((stat.n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((stat.n - df + 0.5) / (df + 0.5)) END
        * f.f * 2.2 / (f.f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM q JOIN f USING (prefix) JOIN n USING (prefix) JOIN dl USING (id), stat GROUP BY q.case_id, f.id)"""


def _q(text: str, relation: str = "(SELECT 0 AS case_id)") -> str:
    return f"q AS (SELECT case_id, lower(unnest({_QUERY.format(text)})) AS prefix FROM {relation})"


_UNITS = "u AS (SELECT doc_id AS id, text, lang AS section, source AS principle, n_chars FROM documents)"
_DOCS = f"{_UNITS}, {_index('u', {'text': 10.0})}"
_FIXED = f"WITH {_DOCS}, {_q(chr(39) + 'the entire station onion' + chr(39))}, {_BM25}"
_CASES = f"""c AS (SELECT item_id AS case_id, text AS query FROM benchmark), {_q('query', 'c')}"""
ORACLE["doc_stats"] = f"WITH {_DOCS} SELECT dl.id, CAST(dl AS BIGINT) AS dl, count(term) AS terms FROM dl LEFT JOIN tf USING (id) GROUP BY dl.id, dl"
ORACLE["term_df_idf"] = f"""WITH {_DOCS}, v AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT term, df, round(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END, 6) AS idf, round(avgdl, 6) AS avgdl FROM v, stat"""
ORACLE["prefix_expand"] = f"""WITH {_DOCS}, {_q('text', '(SELECT item_id AS case_id, text FROM benchmark)')}
SELECT p.prefix, v.term FROM (SELECT DISTINCT prefix FROM q) p JOIN (SELECT DISTINCT term FROM tf) v ON starts_with(v.term, p.prefix)"""
ORACLE["bm25_topk"] = f"{_FIXED} SELECT round(score, 6) AS score, id, section, principle, n_chars FROM s JOIN u USING (id) ORDER BY round(s.score, 9), id LIMIT 10"
ORACLE["index_changes"] = f"""WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 1 AND doc_id % 7 <> 2 THEN 'the station entire ' || text ELSE text END AS text, lang AS section
  FROM documents WHERE doc_id % 7 <> 2 OR doc_id % 2 = 0), {_index('d', {'text': 10.0})}, {_q(chr(39) + 'the entire station onion' + chr(39))}, {_BM25}
SELECT round(score, 6) AS score, id, section FROM s JOIN d USING (id) ORDER BY round(s.score, 9), id LIMIT 20"""
ORACLE["passage_holders"] = "SELECT item_id AS case_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)"
ORACLE["bm25_faceted"] = f"""{_FIXED} SELECT round(score, 6) AS score, id, section, principle FROM s JOIN u USING (id)
WHERE section IN ('en', 'fr') AND principle IN ('src1', 'src2', 'src3', 'src4') ORDER BY round(s.score, 9), id LIMIT 10"""
ORACLE["bm25_weighted"] = f"""WITH h AS ({ORACLE["html_headings"]}),
u AS (SELECT page_id AS id, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (kind = 'heading'), '') AS title,
      coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (kind = 'para'), '') AS body FROM h GROUP BY page_id),
{_index('u', {'title': 10.0, 'body': 4.0})}, {_q("'the station de que'")}, {_BM25}
SELECT round(score, 6) AS score, id FROM s ORDER BY round(s.score, 9), id LIMIT 20"""
ORACLE["eval_topk"] = f"""WITH {_DOCS}, {_CASES}, {_BM25}
SELECT case_id, round(score, 6) AS score, id FROM s QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9), id) <= 5"""
ORACLE["eval_hit_rate"] = f"""WITH {_DOCS}, {_CASES}, {_BM25},
top AS (SELECT case_id, id FROM s QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9), id) <= 5),
want AS (SELECT case_id, arg_min(source, doc_id) AS p FROM c JOIN documents ON contains(text, query) GROUP BY case_id),
hit AS (SELECT c.case_id, coalesce(bool_or(u.principle = want.p), false) AS h FROM c LEFT JOIN want USING (case_id) LEFT JOIN top USING (case_id) LEFT JOIN u ON u.id = top.id GROUP BY c.case_id)
SELECT round(avg(CASE WHEN h THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(*) AS n FROM hit"""
ORACLE["json_hits"] = f"""{_FIXED} SELECT '{{"id":' || id || ',"section":"' || section || '","principle":"' || principle || '","n_chars":' || n_chars || '}}' AS json
FROM s JOIN u USING (id) ORDER BY round(s.score, 9), id LIMIT 5"""
ORACLE["citations"] = f"""{_FIXED} SELECT id, '[' || principle || ' §' || section || ' p.' || n_chars || '] (rationale)' || chr(10) || text || chr(10) AS citation
FROM s JOIN u USING (id) ORDER BY round(s.score, 9), id LIMIT 5"""
