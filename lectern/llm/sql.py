"""SQL for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

#: Classes of exact similarities, all pairs that share a shingle being compared.
ORACLE["op1_near_dups"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE pairs.n / (x.n + y.n - pairs.n) >= 0.8),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b)
SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_rows, any_value(coalesce(n, 0)) AS n_shingles FROM reach LEFT JOIN n ON n.doc_id = reach.a GROUP BY a
"""

#: All windows of the benchmark against all windows of the documents.
_WORDS5 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE["op5_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS5} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 13) AS n FROM (SELECT item_id, {_WORDS5} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i))
), hits AS (SELECT doc_id, p, n, item FROM dw JOIN iw USING (n, s)),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id),
cover AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN found USING (doc_id) LEFT JOIN cover USING (doc_id)
"""

#: All windows of 50 words by their words.
ORACLE["op8_drop_repeats"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM win JOIN least USING (s) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS t FROM word ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: Cross-site lines, counted exactly.
ORACLE["op7_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), spread AS (
  SELECT line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY line HAVING count(DISTINCT source) >= 5
), marked AS (
  SELECT l.*, s.line IS NOT NULL AS gone FROM lines l LEFT JOIN spread s USING (line)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: Markers: turn 8, text 8, part 8, end 8 characters; an escape is one more character.
ORACLE["op9_format_chats"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), seen AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS merged FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(regexp_replace(text, '<(\\*)\|', '<_\1|', 'g'))
           + CASE WHEN merged THEN 8 ELSE 24 + length(regexp_replace(role, '<(\\*)\|', '<_\1|', 'g')) END) AS BIGINT) AS formatted_chars
FROM seen GROUP BY conv_id
"""


def _told(text: str) -> str:
    """What a leaf of the manifest is the digest of; ``text`` stands for the text."""
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)


def _levels(name: str, leaves: str, tree: str) -> str:
    """CTEs of all nodes (tree, level, pos, h) over (tree, pos, h), and of the runs that have a node above them."""
    return f"""{name} AS (
  SELECT {tree} AS tree, 0 AS level, pos, h FROM {leaves}
  UNION ALL SELECT tree, any_value(level) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}) WHERE n > 1 GROUP BY tree, pos // 8
), {name}_runs AS (
  SELECT tree, level, pos // 8 AS run, list(h ORDER BY pos) AS hs
  FROM (SELECT *, max(level) OVER (PARTITION BY tree) AS height FROM {name}) WHERE level < height GROUP BY tree, level, pos // 8
)"""


def _fold(name: str, start: str, nodes: str) -> str:
    """CTE that folds (id, tree, level, pos, h, proof) up the runs of ``nodes``."""
    return f"""{name} AS (
  {start}
  UNION ALL SELECT id, f.tree, f.level + 1, pos // 8, sha256(array_to_string(hs[1:pos % 8] || [h] || hs[pos % 8 + 2:], '')),
    proof || array_to_string(hs[1:pos % 8] || hs[pos % 8 + 2:], '')
  FROM {name} f JOIN {nodes}_runs r ON r.tree IS NOT DISTINCT FROM f.tree AND r.level = f.level AND r.run = f.pos // 8
)"""


#: CRC-32 of the decimal doc_id, bit by bit: a code is mixed in, a -1 shifts.
_CRC = """xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Nodes level by level, then every document's leaf folded up to its tree's root and from there to the root.
ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, sha256({_told('text')}) AS h,
    CASE WHEN {_CRC} % 3 = 0 THEN sha256({_told(_LOWERED)}) ELSE sha256({_told('text')}) END AS t
  FROM documents
),
{_levels('node', 'leaf', 'lang')},
sub AS (SELECT tree AS lang, arg_max(h, level) AS h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos FROM node GROUP BY tree),
{_levels('upper', 'sub', '0')},
{_fold('inside', "SELECT doc_id AS id, lang AS tree, 0 AS level, pos, t AS h, '' AS proof FROM leaf", 'node')},
tops AS (SELECT id, arg_max(tree, level) AS lang, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM inside GROUP BY id),
{_fold('outside', "SELECT id, 0 AS tree, 0 AS level, sub.pos, tops.h, proof FROM tops JOIN sub ON sub.lang IS NOT DISTINCT FROM tops.lang", 'upper')},
done AS (SELECT id, arg_max(h, level) AS folded, arg_max(proof, level) AS proof FROM outside GROUP BY id),
root AS (SELECT arg_max(h, level) AS root FROM upper)
SELECT doc_id, leaf.h AS leaf, sub.h AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaf JOIN done ON id = doc_id JOIN sub ON sub.lang IS NOT DISTINCT FROM leaf.lang, root
"""

#: All documents by what they fail, against the steps of all orders.
ORACLE["op13_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)
), c AS (SELECT part, fails, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
x AS (SELECT *, contains(fails, f) AS failed, length(translate(earlier, fails, '')) < length(earlier) AS gone FROM c, s),
y AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (failed AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
    coalesce(sum(n) FILTER (failed AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (failed AND NOT gone AND toxic), 0) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM y
"""
