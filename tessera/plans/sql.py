"""DuckDB SQL for the registered queries, written apart from the Spark plans: nothing of the engine is imported."""

from __future__ import annotations

# Fixed values, stated here once more.
STOPWORDS = (
    "a an and are at be been but by can could did do does for from how i if in is it its may me might my of on or our "
    "shall should so that the then these this those to was we were what when where which who why will with would you your"
).split()
PROTECTED = "change check close no not open run set start stop turn use".split()
IRREGULAR = {"children": "child", "feet": "foot", "men": "man", "teeth": "tooth", "women": "woman"}
INTENTS = [
    ("image_trace", "pic image figure diagram"), ("ocr_audit", "ocr source rawtext"), ("safety", "safety warning caution"), ("troubleshooting", "fault error broken repair"),
    ("legal", "warranty policy legal"), ("procedure", "howto how install replace setup"), ("overview", "overview toc chapter"), ("component", "where button indicator port part"),
]
MANUAL = "according to the manual|in the manual|manual program|ocr"
SERVICE = "customer service|order|shipping|delivery|invoice|refund|return|coupon"
ASKED = (
    "how to|how the|how do|how can|how should|what is|what are|what do|what can|what should|what kinds|what information|please introduce|if i need to|when encountering|difficult to|first use|install|setup|connect|pair|operate|"
    "replace|clean|assemble|button|indicator|component|specification|troubleshoot|safety"
)
TYPES = [
    ("legal_statement", "warranty|copyright|fcc|compliance|liability|trademark"), ("safety_warning", "warning|caution|danger|safety|electric shock|injury|fire hazard"),
    ("troubleshooting_qa", "troubleshooting|problem|cause|solution|error code|cannot|does not work"), ("parts_list", "package contents|parts list|supplied accessories|included|contents of package"),
    ("specification_table", "specification|rating|dimension|voltage|model|capacity"), ("assembly_steps", "install|assemble|assembly|mount|connect|insert|remove|attach|replace"),
    ("maintenance_guide", "clean|maintenance|store|storage|inspect|lubricat|filter|service"), ("operation_guide", "press|select|set|start|stop|use |operate|adjust|configure"),
    ("component_description", "location|overview|component|button|connector|control|feature"), ("product_overview", "introduction|about this|description|general information"),
]
FAMILIES = {
    "product_overview": "overview", "component_description": "component", "assembly_steps": "procedure", "operation_guide": "procedure", "maintenance_guide": "procedure", "troubleshooting_qa": "troubleshooting",
    "safety_warning": "safety", "legal_statement": "legal", "parts_list": "component", "specification_table": "component", "general_info": "general",
}
NEWLINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_STOP = _list(STOPWORDS)


def _tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda t: NOT list_contains({_STOP}, t))"


def _undouble(s: str) -> str:
    return f"CASE WHEN length({s}) > 2 AND {s}[-1:] = {s}[-2:-2] AND NOT contains('aeiou', {s}[-1:]) THEN {s}[:-2] ELSE {s} END"


_IRREGULAR = " ".join(f"WHEN t = '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
_STEM = f"""CASE WHEN list_contains({_list(PROTECTED)}, t) THEN t {_IRREGULAR}
 WHEN length(t) <= 3 OR regexp_full_match(t, '[0-9]+') THEN t
 WHEN suffix(t, 'ies') AND length(t) > 4 THEN t[:-4] || 'y'
 WHEN suffix(t, 'ing') AND length(t) > 5 THEN {_undouble("t[:-4]")}
 WHEN suffix(t, 'ied') AND length(t) > 4 THEN t[:-4] || 'y'
 WHEN suffix(t, 'ed') AND length(t) > 4 THEN {_undouble("t[:-3]")}
 WHEN regexp_matches(t, '(sses|xes|zes|ches|shes)$') AND length(t) > 4 THEN t[:-3]
 WHEN suffix(t, 's') THEN t[:-2] ELSE t END"""


def _index_tokens(text: str) -> str:
    both = f"flatten(list_transform({_tokens(text)}, lambda t: CASE WHEN {_STEM} = t THEN [t] ELSE [t, {_STEM}] END))"
    return f"CASE WHEN len({both}) > 0 THEN {both} ELSE ['__empty__'] END"


def _terms(text: str) -> str:
    """The first 16 distinct tokens; order kept."""
    t = _tokens(text)
    return f"list_filter({t}, lambda x, i: list_position({t}, x) = i)[1:16]"


def _bm25(k: int = 10, docs: str = "documents", key: str = "doc_id") -> str:
    return f"""
bm_tok AS (SELECT {key} AS doc_id, {_index_tokens("text")} AS tokens FROM {docs}),
bm_post AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS term FROM bm_tok) GROUP BY doc_id, term),
bm_df AS (SELECT term, count(*) AS df FROM bm_post GROUP BY term),
bm_raw AS (SELECT term, df, ln(((SELECT count(DISTINCT doc_id) FROM bm_post) - df + 0.5) / (df + 0.5)) AS raw FROM bm_df),
bm_idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM bm_raw) ELSE raw END AS idf FROM bm_raw),
bm_q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_index_tokens("text")}) AS term FROM benchmark) GROUP BY item_id, term),
bm_avg AS (SELECT avg(len(tokens)) AS avgdl FROM bm_tok),
bm_score AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avgdl))), 6) AS score
 FROM bm_q JOIN bm_idf USING (term) JOIN bm_post USING (term), bm_avg GROUP BY item_id, doc_id),
bm25_{k} AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm_score WHERE score > 0) WHERE rank <= {k})"""


def _scan(k: int = 10) -> str:
    return f"""
sc_doc AS (SELECT DISTINCT doc_id, unnest({_tokens("text")}) AS term FROM documents),
sc_q AS (SELECT item_id, unnest({_terms("text")}) AS term FROM benchmark),
scan_{k} AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
 SELECT item_id AS query_id, doc_id AS chunk_id, sum(greatest(4, least(length(term), 20)))::DOUBLE AS score FROM sc_q JOIN sc_doc USING (term) GROUP BY item_id, doc_id)) WHERE rank <= {k})"""


_NORMALIZED = """
ch AS (SELECT *, 'bm25' AS channel FROM bm25_10 UNION ALL SELECT *, 'scan' AS channel FROM scan_10),
norm AS (SELECT query_id, chunk_id, channel, rank, CASE WHEN channel = 'scan' OR hi = lo THEN (n - rank + 1) / n ELSE (score - lo) / (hi - lo) END AS norm FROM (
 SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, count(*) OVER w AS n FROM ch WINDOW w AS (PARTITION BY query_id, channel)))"""
_CHANNELS = f"WITH {_bm25()}, {_scan()}, {_NORMALIZED}"
_FUSED = """
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY merged_score DESC, channels DESC, chunk_id DESC) AS rank FROM (
 SELECT query_id, chunk_id, round(sum(norm * CASE channel WHEN 'bm25' THEN 0.4 ELSE 0.2 END), 6) AS merged_score, string_agg(channel, '+' ORDER BY channel) AS channels FROM norm GROUP BY query_id, chunk_id))"""

_TREE = """
tree AS (SELECT 'r' || r_regionkey AS chunk_id, NULL AS parent_id, 'big_support' AS tier, r_regionkey::BIGINT AS pos FROM region
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'support', n_nationkey FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'primary', c_custkey FROM customer
 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'primary', s_suppkey FROM supplier)"""
_HITS = """
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
 SELECT year(o_orderdate) AS query_id, 'c' || c_custkey AS chunk_id, 'n' || c_nationkey AS parent_id, round(sum(o_totalprice), 2) AS score
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)) WHERE rank <= 20),
seen AS (SELECT query_id, parent_id, min(rank) AS seen FROM hits GROUP BY ALL),
parents AS (SELECT query_id, s.parent_id, t.tier AS parent_tier, row_number() OVER (PARTITION BY query_id ORDER BY seen, s.parent_id) AS rank
 FROM seen s JOIN tree t ON s.parent_id = t.chunk_id WHERE t.tier IN ('support', 'big_support'))"""
_PATHS = """
paths AS (SELECT doc, path FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS doc,
 list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]+/?', ''), '/'), lambda p: p <> '') AS path FROM pages) WHERE len(path) > 0)"""
_MESSAGES = """
m AS (SELECT conv_id AS session, turn AS seq, min(struct_pack(role := role, text := coalesce(text, ''))) AS v FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL),
msg AS (SELECT session, seq, v.role AS role, v.text AS text FROM m)"""
_BOUNDARY = """
turns AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY session ORDER BY seq DESC) AS users FROM msg),
starts AS (SELECT session, seq AS start FROM turns WHERE role = 'user' AND users = 3),
bounds AS (SELECT session, max(seq) AS through_seq, count(*) AS n_prefix FROM msg JOIN starts USING (session) WHERE seq < start GROUP BY session)"""
_PROFILES = f"""
words AS (SELECT source AS doc, unnest({_tokens("text")}) AS term FROM documents),
counts AS (SELECT doc, term, count(*) AS n FROM words WHERE length(term) >= 2 AND NOT regexp_matches(term, '^(manual|page)[0-9]+$') GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, term) AS rank FROM counts) WHERE rank <= 256)"""
_RELEVANT = """
rel AS (SELECT b.query_id, b.chunk_id, b.rank, contains(lower(d.text), lower(i.text[1:30])) AS relevant FROM bm25_10 b JOIN documents d ON d.doc_id = b.chunk_id JOIN benchmark i ON i.item_id = b.query_id)"""


def _cosine(k: int, where: str = "TRUE") -> str:
    return f"""SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND c.{where})) WHERE rank <= {k}"""


_BUCKETS = "CASE WHEN length(text) < 50 THEN '<50' WHEN length(text) < 100 THEN '50-99' WHEN length(text) < 200 THEN '100-199' WHEN length(text) < 500 THEN '200-499' WHEN length(text) < 1000 THEN '500-999' ELSE '1000+' END"


def _bare(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def _squeezed(text: str) -> str:
    return rf"lower(regexp_replace(coalesce({text}, ''), '\s+', '', 'g'))"


def _has(text: str, words: str, mark: str = "|") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words.split(mark)) + ")"


def _intent(squeezed: str) -> str:
    return "CASE " + " ".join(f"WHEN {_has(squeezed, words, ' ')} THEN '{name}'" for name, words in INTENTS) + " ELSE 'general' END"


def _older(text: str, squeezed: str) -> str:
    """What the older cascade gives for text without Chinese."""
    return f"CASE WHEN regexp_matches({text}, '[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9]') OR contains({squeezed}, 'pic') THEN 'image_trace' WHEN contains({squeezed}, 'ocr') THEN 'ocr_audit' ELSE 'general' END"


def _type(low: str) -> str:
    return "CASE " + " ".join(f"WHEN {_has(low, words)} THEN '{name}'" for name, words in TYPES) + " ELSE 'general_info' END"


_DESCRIPTION = r"\{\{(?:此图片描述为|图片描述|image description)[:：]\s*(.*?)\}\}"


def _plain(text: str) -> str:
    out = f"coalesce({text}, '')"
    for pattern, to in (
        (rf"(?is)<PIC:[^>]+>(?:\s*{_DESCRIPTION})?", r" \1 "), (rf"(?is){_DESCRIPTION}", r" \1 "), ("(?s)```.*?```", " "), (r"!\[[^\]]*\]\([^)]+\)", " "), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), ("`([^`]*)`", r"\1"),
        (r"(?m)^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$", " "), (r"(?m)^\s{0,3}#{1,6}\s*", ""), (r"(?m)^\s*[-*+·]\s*", ""), (r"(?m)^\s*[0-9]+[.)]\s+", ""), (r"\|", " "), (r"[ \t\r\f\v]+", " "), (" *\\n *", "\n"), ("\\n{3,}", "\n\n"),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return _bare(out)


def _deduped(source: str) -> str:
    """(id, text) of a relation with id and text: each line once, single blank lines between others."""
    return rf"""
dd_l AS (SELECT id, unnest(list_transform(regexp_split_to_array(text, '{NEWLINES}'), lambda x: {_bare('x')})) AS line, unnest(range(len(regexp_split_to_array(text, '{NEWLINES}')))) AS i FROM {source}),
dd_k AS (SELECT * FROM dd_l QUALIFY line = '' OR row_number() OVER (PARTITION BY id, regexp_replace(line, '[ \t\r\f\v]+', ' ', 'g') ORDER BY i) = 1),
dd_b AS (SELECT id, i, line, coalesce(lag(line) OVER (PARTITION BY id ORDER BY i), '') AS before FROM dd_k),
deduped AS (SELECT s.id, regexp_replace(coalesce(t, ''), '\n+$', '') AS text FROM {source} s LEFT JOIN (SELECT id, string_agg(line, chr(10) ORDER BY i) FILTER (line <> '' OR before <> '') AS t FROM dd_b GROUP BY id) USING (id))"""


_MARKED = r"regexp_replace(coalesce(text, ''), '([.!?])(\s|$)', '\1' || chr(1) || '\2', 'g')"
_SENTENCES = rf"list_transform(regexp_extract_all({_MARKED}, '[^.!?\n\x01]+[.!?]\x01'), lambda s: {_bare('s[:-2]')})"
_FULL_LINES = rf"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '{NEWLINES}'), lambda l: {_bare('l')}), lambda l: l <> '')"


def _x17(terms: str, query: str, title: str, text: str, score: str, intent: str, tier: str) -> str:
    """X17 without Chinese text, chunk type, pictures and notes."""
    h, t = _squeezed(title), _squeezed(text)
    pic = f"regexp_extract({query}, '[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+')"
    shown = f"CASE WHEN {pic} <> '' AND (contains({h}, lower({pic})) OR contains({t}, lower({pic}))) THEN 80 ELSE 0 END"
    found = f"coalesce(list_sum(list_transform({terms}, lambda x: CASE WHEN contains({h}, x) THEN 28 ELSE 0 END + CASE WHEN contains({t}, x) THEN 8 ELSE 0 END)), 0)"
    unmet = f"CASE WHEN len({terms}) > 0 AND len(list_filter({terms}, lambda x: contains({h} || {t}, x))) = 0 THEN -28 ELSE 0 END"
    of = f"CASE WHEN {intent} = 'legal' THEN -42 WHEN {intent} IN ('component', 'procedure', 'safety', 'troubleshooting') THEN -12 WHEN {intent} = 'overview' AND {tier} = 'support' THEN 20 WHEN {intent} = 'ocr_audit' AND contains({h}, 'ocr') THEN 36 ELSE 0 END"
    return f"round(10 / (1 + greatest({score}, 0)) + {shown} + {unmet} + {found} + {of} + CASE WHEN {tier} = 'primary' THEN 4 ELSE 0 END, 6)"


_FOLDED = r"regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')"
#: Documents as chunks, benchmark items as questions.
_ASKED = f"asked AS (SELECT item_id AS query_id, text AS query, {_terms('text')} AS terms, {_intent(_squeezed('text'))} AS intent, {_older('text', _squeezed('text'))} AS older FROM benchmark)"


def _needles() -> str:
    return "CASE WHEN n = 0 THEN TRUE WHEN intent IN ('image_trace', 'ocr_audit') THEN TRUE WHEN len(terms) = 0 THEN coalesce(merged, 0) < 0.18 ELSE coalesce(lexical, 0) < CASE WHEN intent IN ('safety', 'troubleshooting', 'general') THEN 24 ELSE 20 END END"


_SQL = {
    "x01_normalize": r"SELECT doc_id, length(n) AS n, md5(n) AS digest FROM (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) AS n FROM documents)",
    "x02_language": "SELECT CASE WHEN regexp_matches(coalesce(text, ''), '[一-鿿]') THEN 'zh' ELSE 'en' END AS detected, CASE WHEN lower(trim(lang)) LIKE 'en%' THEN 'en' WHEN lower(trim(lang)) LIKE 'zh%' OR lower(trim(lang)) IN ('cn', 'chinese') THEN 'zh' ELSE 'none' END AS normalized, count(*) AS n FROM documents GROUP BY ALL",
    "x04_tokens": f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "x07_query_terms": f"SELECT item_id, array_to_string({_terms('text')}, ' ') AS terms FROM benchmark",
    "x28_clip": r"SELECT conv_id, turn, rtrim(trim(regexp_replace(text, '\s+', ' ', 'g'))[1:180]) AS clipped FROM conversations",
    "x30_chunk_keys": "SELECT page_id, CASE WHEN length(k) BETWEEN 1 AND 100 THEN k ELSE 'chunk_' || sha1(k) END AS key, sha256(url) AS user_dir FROM (SELECT page_id, url, trim(url || '#' || repeat('x', (page_id % 120)::INT)) AS k FROM pages)",
    "t01_bm25": f"WITH {_bm25()} SELECT * FROM bm25_10",
    "a06_term_statistics": f"WITH {_bm25()} SELECT term, df, round(idf, 6) AS idf FROM bm_idf",
    "r01_cosine": _cosine(5, "vec_id >= 0"),
    "f01_filtered_cosine": _cosine(3, "label IN (0, 1, 2)"),
    "r04_scan": f"WITH {_scan()} SELECT * FROM scan_10",
    "w01_normalized": f"{_CHANNELS} SELECT query_id, chunk_id, channel, rank, round(norm, 6) AS norm FROM norm",
    "j01_fused": f"{_CHANNELS}, {_FUSED} SELECT query_id, chunk_id, merged_score, channels, rank FROM fused",
    "j11_rank_changes": f"{_CHANNELS}, {_FUSED} SELECT f.query_id, f.chunk_id, f.rank AS rank_after, b.rank AS rank_before, b.rank - f.rank AS delta FROM fused f LEFT JOIN bm25_10 b USING (query_id, chunk_id)",
    "j12_completed": f"WITH {_bm25()}, {_scan(3)} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY part, place, chunk_id) AS rank FROM (SELECT query_id, chunk_id, 0 AS part, rank AS place FROM scan_3 UNION ALL SELECT b.query_id, b.chunk_id, 1, b.rank FROM bm25_10 b ANTI JOIN scan_3 s USING (query_id, chunk_id))",
    "r03_route_order": f"WITH {_bm25(5)}, {_scan(5)}, u AS (SELECT query_id, chunk_id, 0 AS route, rank FROM scan_5 UNION ALL SELECT query_id, chunk_id, 1, rank FROM bm25_5), o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY route, rank) = 1) SELECT * FROM (SELECT query_id, chunk_id, route, row_number() OVER (PARTITION BY query_id ORDER BY route, rank, chunk_id) AS place FROM o) WHERE place <= 8",
    "a03_noisy_or": f"{_CHANNELS}, p AS (SELECT query_id, chunk_id AS label, channel, round(norm * 0.9, 4) AS s FROM norm), f AS (SELECT query_id, label, round(1 - product(1 - s), 4) AS score, string_agg(channel, '+' ORDER BY channel) AS sources FROM p GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank, score >= 0.7 AS strong FROM f) WHERE rank <= 8",
    "a04_deduped_terms": r"WITH t AS (SELECT item_id AS query_id, unnest(string_split(text, ' ')) AS term, unnest(range(len(string_split(text, ' ')))) AS pos FROM benchmark), k AS (SELECT *, length(term)::DOUBLE AS weight, lower(regexp_replace(term, '\s+', '', 'g')) AS key FROM t), b AS (SELECT query_id, key, arg_max(term, struct_pack(w := weight, p := -pos)) AS term, max(weight) AS weight FROM k WHERE key <> '' GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) AS rank FROM b) WHERE rank <= 16",
    "a05_profiles": f"WITH {_PROFILES}, l AS (SELECT doc, string_agg(term, ' ' ORDER BY rank) AS terms FROM top GROUP BY doc) SELECT source AS doc, min(source) AS name, count(*) AS chunks, string_agg(DISTINCT lang, ',' ORDER BY lang) AS kinds, any_value(terms) AS terms FROM documents LEFT JOIN l ON l.doc = source GROUP BY source",
    "j14_profile_scores": f"WITH {_PROFILES}, q AS (SELECT item_id AS query_id, unnest({_terms('text')}) AS term FROM benchmark), s AS (SELECT query_id, doc, least(1.0, round(least(0.3, sum(0.1::DOUBLE)) + least(0.45, sum(CASE WHEN length(term) >= 4 THEN 0.12::DOUBLE ELSE 0.08::DOUBLE END)), 4)) AS score FROM q JOIN top USING (term) WHERE rank <= 32 GROUP BY ALL) SELECT query_id, doc, score FROM s WHERE score >= 0.18",
    "h09_completed_sections": r"""
WITH d AS (SELECT doc_id::VARCHAR AS doc, string_split(regexp_replace(coalesce(text, ''), '\r\n|\r', chr(10), 'g'), chr(10)) AS lines FROM documents),
c AS (SELECT doc, lines, unnest(range(0, (len(lines) - 1) // 2 + 1)) AS i FROM d),
n AS (SELECT doc, lines, i AS pos, false AS synthetic, 2 * i + 1 AS f, least(2 * i + 2, len(lines)) AS l, i // 3 AS part FROM c
 UNION ALL SELECT doc, lines, min(i), true, min(2 * i + 1), max(least(2 * i + 2, len(lines))), i // 3 FROM c GROUP BY doc, lines, i // 3),
o AS (SELECT *, format('{}_{:04d}', doc, row_number() OVER (PARTITION BY doc ORDER BY pos, synthetic DESC)) AS chunk_id FROM n)
SELECT o.doc, o.chunk_id, p.chunk_id AS parent_id, CASE WHEN o.synthetic THEN 'support' ELSE 'primary' END AS tier, o.f::INT AS first_line, o.l::INT AS last_line, o.synthetic,
 md5(regexp_replace(array_to_string(o.lines[o.f:o.l], chr(10)), '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '')) AS digest
FROM o LEFT JOIN o p ON NOT o.synthetic AND p.synthetic AND p.doc = o.doc AND p.part = o.part
""",
    "j02_parents": f"WITH {_TREE}, {_HITS} SELECT * FROM parents",
    "j03_support_context": f"WITH {_TREE}, {_HITS} SELECT query_id, parent_id, rank FROM parents p WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = p.query_id AND h.chunk_id = p.parent_id)",
    "j04_children": f"WITH {_TREE} SELECT parent_id, chunk_id, tier FROM tree WHERE parent_id IN (SELECT chunk_id FROM tree WHERE tier = 'big_support')",
    "j05_descendants": f"WITH RECURSIVE {_TREE}, walk AS (SELECT chunk_id AS root, chunk_id, tier, 0 AS depth FROM tree WHERE parent_id IS NULL UNION ALL SELECT w.root, t.chunk_id, t.tier, w.depth + 1 FROM walk w JOIN tree t ON t.parent_id = w.chunk_id WHERE w.depth < 4 AND w.tier <> 'primary') SELECT root, chunk_id, tier, depth::INT AS depth FROM walk WHERE depth > 0",
    "j06_best_per_parent": "SELECT parent_id, chunk_id, score, rank FROM (SELECT 'n' || c_nationkey AS parent_id, 'c' || c_custkey AS chunk_id, c_acctbal AS score, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, 'c' || c_custkey) AS rank FROM customer) WHERE rank <= 3",
    "w09_siblings": f"WITH {_TREE} SELECT chunk_id, parent_id, last_value(CASE WHEN tier = 'primary' THEN chunk_id END IGNORE NULLS) OVER (PARTITION BY parent_id ORDER BY pos, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_primary, first_value(CASE WHEN tier = 'primary' THEN chunk_id END IGNORE NULLS) OVER (PARTITION BY parent_id ORDER BY pos, chunk_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_primary FROM tree WHERE tier <> 'big_support'",
    "w10_renumbered": f"WITH {_TREE}, d AS (SELECT *, chunk_id[1:1] AS doc FROM tree), n AS (SELECT *, format('{{}}_{{:04d}}', doc, row_number() OVER (PARTITION BY doc ORDER BY pos, chunk_id)) AS new_id FROM d) SELECT n.chunk_id, n.new_id, CASE WHEN p.new_id <> n.new_id THEN p.new_id END AS new_parent FROM n LEFT JOIN n p ON p.doc = n.doc AND p.chunk_id = n.parent_id",
    "h11_violations": f"WITH {_TREE}, k AS (SELECT parent_id AS chunk_id, count(*) AS kids FROM tree WHERE parent_id IS NOT NULL GROUP BY 1), j AS (SELECT t.*, kids FROM tree t LEFT JOIN k USING (chunk_id)) SELECT 'dangling_parent' AS fault, count(*) AS n FROM tree WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT chunk_id FROM tree) UNION ALL SELECT 'primary_with_children', count(*) FROM j WHERE tier = 'primary' AND kids > 0 UNION ALL SELECT 'childless_support', count(*) FROM j WHERE tier <> 'primary' AND kids IS NULL UNION ALL SELECT 'self_parent', count(*) FROM j WHERE chunk_id = parent_id",
    "u06_missing_prefixes": f"WITH {_PATHS}, p AS (SELECT DISTINCT doc, path[1:n] AS path FROM (SELECT doc, path, unnest(range(1, len(path) + 1)) AS n FROM paths)) SELECT doc, array_to_string(path, '/') AS path FROM p WHERE NOT EXISTS (SELECT 1 FROM paths x WHERE x.doc = p.doc AND x.path = p.path)",
    "j20_nearest_ancestor": f"WITH {_PATHS}, d AS (SELECT DISTINCT doc, path FROM paths), t AS (SELECT doc, path, unnest(range(1, len(path))) AS n FROM d), b AS (SELECT t.doc, t.path, max(n) AS n FROM t JOIN d a ON a.doc = t.doc AND a.path = t.path[1:n] GROUP BY ALL) SELECT d.doc, array_to_string(d.path, '/') AS path, coalesce(array_to_string(d.path[1:b.n], '/'), '') AS ancestor FROM d LEFT JOIN b ON b.doc = d.doc AND b.path = d.path",
    "a16_tier_depth": f"WITH {_TREE} SELECT tier, CASE tier WHEN 'big_support' THEN 1 WHEN 'support' THEN 2 ELSE 3 END::BIGINT AS depth, count(*) AS n, count(parent_id) AS with_parent FROM tree GROUP BY ALL",
    "a08_metric_summary": "SELECT event_type AS series, round(arg_min(value, event_id), 4) AS first, round(arg_max(value, event_id), 4) AS last, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS mean, count(*) AS samples FROM events WHERE value IS NOT NULL GROUP BY 1",
    "s20_thresholds": "SELECT event_id, round(value, 1) AS value, coalesce(CASE event_type WHEN 'view' THEN round(value, 1) > 80 WHEN 'click' THEN round(value, 1) > 70 END, FALSE) AS alert FROM events",
    "s17_log_search": "SELECT event_id, ts, event_type || ' ' || props AS message FROM events WHERE ts >= (SELECT min(ts) FROM events) AND ts < (SELECT max(ts) FROM events) AND contains(event_type || ' ' || props, 'error') ORDER BY ts DESC, event_id DESC LIMIT 50",
    "p13_log_rows": "SELECT event_id, coalesce(json_extract_string(props, '$.message'), json_extract_string(props, '$.k'), '') AS message, upper(event_type) AS level FROM events",
    "s18_topics": "SELECT r_regionkey, n_name FROM region JOIN nation ON contains(lower(n_name), CASE WHEN r_regionkey = 0 THEN 'a' ELSE lower(r_name) END) OR contains(CASE WHEN r_regionkey = 0 THEN 'a' ELSE lower(r_name) END, lower(n_name))",
    "j16_arguments": "SELECT p.p_partkey AS call_id, min(c.p_type || ':' || format('{:08d}', c.p_partkey)) AS key, 1 AS extra FROM part p JOIN part c ON c.p_type = p.p_type AND c.p_brand = p.p_brand GROUP BY 1",
    "a12_diagnosis": r"WITH r AS (SELECT event_type <> 'error' AS completed, contains(lower(regexp_replace('cause: VIEW-page, ' || event_type, '[^\p{L}\p{N}]', '', 'g')), lower(event_type)) OR contains(lower(regexp_replace('cause: VIEW-page, ' || event_type, '[^\p{L}\p{N}]', '', 'g')), 'viewpage') AS c, contains('user' || (event_id % 100), 'user' || user_id) AS o, value FROM events) SELECT count(*) AS n, count(*) FILTER (completed) AS completed, round(avg(c::INT) FILTER (completed), 4) AS cause_accuracy, round(avg(o::INT) FILTER (completed), 4) AS object_accuracy, round(avg((c AND o)::INT) FILTER (completed), 4) AS joint_accuracy, round(avg(value) FILTER (value > 0), 3) AS mean_latency FROM r",
    "a14_batch_stats": "SELECT CASE event_type WHEN 'error' THEN 'fail' ELSE 'success' END AS status, count(*) AS n, round(sum(value), 3) AS total, round(avg(value), 3) AS mean FROM events GROUP BY 1",
    "w04_boundary": f"WITH {_MESSAGES}, {_BOUNDARY} SELECT * FROM bounds",
    "w05_tail": f"WITH {_MESSAGES}, {_BOUNDARY} SELECT session, seq, role FROM msg LEFT JOIN bounds USING (session) WHERE through_seq IS NULL OR seq > through_seq",
    "w06_gaps": f"WITH {_MESSAGES}, s AS (SELECT *, seq - coalesce(lag(seq) OVER (PARTITION BY session ORDER BY seq), seq - 1) - 1 AS missing FROM msg) SELECT session, count(*) AS n, count(*) FILTER (missing > 0) AS gaps, min(CASE WHEN missing > 0 THEN seq - missing END) AS first_missing FROM s GROUP BY session",
    "s16_gap_free": f"WITH {_MESSAGES}, s AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) = seq + 1 AS ok FROM msg) SELECT session, seq, role FROM s WHERE session NOT IN (SELECT session FROM s WHERE NOT ok)",
    "a22_token_budget": f"WITH {_MESSAGES}, t AS (SELECT session, count(*) AS n, sum(4 + ceil(strlen(text) / 3))::BIGINT AS tokens FROM msg GROUP BY session) SELECT *, 300 AS available, tokens >= 240 AS compact, tokens >= 300 AS over FROM t",
    "x35_dialogue": f"WITH {_MESSAGES} SELECT session, md5(string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text, chr(10) ORDER BY seq)) AS digest FROM msg GROUP BY session",
    "w12_trimmed": f"WITH {_MESSAGES}, s AS (SELECT *, count(*) OVER (PARTITION BY session) AS n, row_number() OVER (PARTITION BY session ORDER BY seq) AS place FROM msg) SELECT session, seq FROM s WHERE n <= 7 OR place = 1 OR place > n - CASE WHEN n % 2 = 0 THEN 6 ELSE 7 END",
    "f11_latest": f"WITH {_MESSAGES} SELECT * FROM (SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS back FROM msg WHERE trim(text) <> '') WHERE back <= 4",
    "k11_sequence": f"WITH {_MESSAGES} SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY seq) AS message_seq FROM msg",
    "t09_memories": "SELECT * FROM (SELECT user_id, event_id AS memory_id, row_number() OVER (PARTITION BY user_id ORDER BY ((event_id % 7) / 7) * ((event_id % 10) / 10) DESC, event_id) AS rank FROM events WHERE event_type <> 'error' AND (event_id % 10) / 10 >= 0.7 AND (event_id % 7) / 7 >= 0.2) WHERE rank <= 5",
    "k14_memory_state": "WITH a AS (SELECT user_id AS memory_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'deactivate' ELSE 'update' END AS action FROM events), l AS (SELECT *, coalesce(sum((action = 'delete')::INT) OVER (PARTITION BY memory_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM a), g AS (SELECT memory_id, life, arg_max(action, seq) AS last, 'v' || max(seq) FILTER (action IN ('create', 'update')) AS content, min(seq) AS created_at, max(seq) AS updated_at FROM l GROUP BY ALL) SELECT memory_id, CASE last WHEN 'deactivate' THEN 'inactive' ELSE 'active' END AS status, content, created_at, updated_at FROM g WHERE life = (SELECT max(life) FROM g x WHERE x.memory_id = g.memory_id) AND last <> 'delete'",
    "a09_recall": f"WITH {_bm25()}, {_RELEVANT}, h AS (SELECT query_id, bool_or(relevant) AS hit FROM rel WHERE rank <= 5 GROUP BY 1), q AS (SELECT 'g' || (item_id % 4) AS grp, coalesce(hit, FALSE)::INT AS hit FROM benchmark LEFT JOIN h ON query_id = item_id) SELECT coalesce(grp, 'all') AS grp, count(*) AS n, sum(hit)::BIGINT AS hits, round(100 * avg(hit), 1) AS recall FROM q GROUP BY ROLLUP (grp)",
    "a10_hit_rates": f"WITH {_bm25()}, {_RELEVANT} SELECT (SELECT count(*) FROM benchmark) AS n, count(DISTINCT query_id) FILTER (relevant AND rank <= 1) AS at1, count(DISTINCT query_id) FILTER (relevant AND rank <= 3) AS at3, count(DISTINCT query_id) FILTER (relevant) AS anywhere FROM rel",
    "a15_length_buckets": f"SELECT {_BUCKETS} AS bucket, count(*) AS n FROM documents GROUP BY 1",
    "k02_quarantine": "SELECT CASE WHEN reason = '' THEN 'valid' ELSE 'quarantined' END AS state, reason, count(*) AS n FROM (SELECT CASE WHEN doc_id IS NULL THEN 'no_id' WHEN trim(coalesce(text, '')) = '' THEN 'no_text' WHEN strlen(text) > 8000 THEN 'too_long' ELSE '' END AS reason FROM documents) GROUP BY ALL",
}


_SQL |= {
    "x05_index_tokens": f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_index_tokens('text')} AS t FROM documents)",
    "x26_alnum": r"SELECT doc_id, md5(lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g'))) AS digest FROM documents",
    "x13_intents": f"SELECT {_intent('s')} AS intent, {_older('text', 's')} AS older, count(*) AS n FROM (SELECT coalesce(text, '') AS text, {_squeezed('text')} AS s FROM documents) GROUP BY ALL",
    "f12_routed": rf"""WITH t AS (SELECT conv_id, turn, lower({_bare(_FOLDED)}) AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN q = '' THEN FALSE WHEN regexp_matches(q, '(^|[^\p{{L}}\p{{N}}_])manual[0-9]+_[a-z0-9_]+') OR {_has('q', MANUAL)}
 OR len(list_filter(regexp_extract_all(q, '[\p{{L}}\p{{N}}_-]+'), lambda x: regexp_matches(x, '(^|-)[a-z][a-z0-9-]*[0-9]') AND regexp_matches(x, '(^|-)[a-z][a-z0-9-]{{2,}}[a-z0-9]($|-)'))) > 0 THEN TRUE
 WHEN {_has('q', SERVICE)} THEN FALSE ELSE {_has('q', ASKED)} END AS routed FROM t""",
    "x10_variants": f"SELECT item_id, CASE WHEN len(terms) = 0 OR array_to_string(terms, ' ') = trim(text) THEN trim(text) ELSE trim(text) || '|' || array_to_string(terms, ' ') END AS variants FROM (SELECT item_id, text, {_terms('text')} AS terms FROM benchmark)",
    "x20_markdown_text": f"SELECT doc_id, length(p) AS n, md5(p) AS digest FROM (SELECT doc_id, {_plain('text')} AS p FROM documents)",
    "x23_dedupe_lines": f"WITH src AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {_deduped('src')} SELECT id AS doc_id, length(text) AS n, md5(text) AS digest FROM deduped",
    "x24_sentences": f"SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN array_to_string(s[1:2], ' ') ELSE array_to_string(l[1:2], chr(10)) END AS head, CASE WHEN len(s) > 0 THEN array_to_string(s[greatest(len(s) - 1, 1):], ' ') ELSE array_to_string(l[greatest(len(l) - 1, 1):], chr(10)) END AS tail FROM (SELECT doc_id, {_SENTENCES} AS s, {_FULL_LINES} AS l FROM documents)",
    "x25_types": f"SELECT lang, {_type('low')} AS kind, count(*) AS n FROM (SELECT lang, lower(coalesce(text, '')) AS low FROM documents) GROUP BY ALL",
    "x15_families": "SELECT CASE kind " + " ".join(f"WHEN '{k}' THEN '{f}'" for k, f in FAMILIES.items()) + f" END AS families, count(*) AS n FROM (SELECT {_type("lower(coalesce(text, ''))")} AS kind FROM documents) GROUP BY ALL",
    "x31_settings": "SELECT event_id, CASE event_type WHEN 'click' THEN TRUE WHEN 'view' THEN FALSE ELSE event_id % 2 = 0 END AS flag, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS number, CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE value END AS amount FROM events",
    "x32_index_text": f"WITH b AS (SELECT doc_id AS id, source, lang, {_plain('text')} AS body FROM documents), src AS (SELECT id, source || ' > ' || lang || CASE WHEN body <> '' AND starts_with(body, source) THEN '' ELSE chr(10) || source END || CASE WHEN body <> '' THEN chr(10) || body ELSE '' END AS text FROM b), {_deduped('src')} SELECT id AS doc_id, md5(text) AS digest FROM deduped",
    "a15_length_stats": "SELECT lang, count(text) AS n, sum(contains(text, '@')::INT)::BIGINT AS with_pics, min(length(text)) AS least, max(length(text)) AS greatest, round(avg(length(text)), 1) AS mean, round(median(length(text)), 1) AS median, coalesce(round(stddev_samp(length(text)), 1), 0) AS deviation FROM documents GROUP BY lang",
    "p04_doc_names": "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'named' WHEN page_id % 2 = 0 THEN 'suffix' || (page_id % 7) WHEN page_id % 3 = 0 THEN 'id' || page_id ELSE CASE WHEN regexp_matches(f, '.\\.[^.]*$') THEN regexp_replace(f, '\\.[^.]*$', '') ELSE f END END AS name FROM (SELECT page_id, regexp_extract(url, '([^/]*)/?$', 1) AS f FROM pages)".replace("\\\\", "\\"),
    "p05_paths": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'data/' || page_id || '/a.md' WHEN 1 THEN 'docs/x' || page_id ELSE '/plain/' || page_id END AS path FROM pages",
    "p11_rerank_text": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN source ELSE lang || '-' || source END AS said FROM documents",
    "p12_index_text": f"SELECT doc_id, md5(array_to_string(list_filter([{_bare("coalesce(text, '')")}, {_bare("coalesce(text, '')")}, lang, source, lang, 'k' || doc_id], lambda x: x <> ''), ' ')) AS digest FROM documents",
    "s14_collection_scan": "SELECT doc_id AS chunk_id, lang, 0.0::DOUBLE AS score FROM documents WHERE lang IN ('en', 'fr')",
    "s15_bounded_scan": "SELECT doc_id AS chunk_id, lang, 0.0::DOUBLE AS score FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 100",
    "s19_regions": "SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'ap-beijing' WHEN 1 THEN 'ap-hongkong' END AS region_code, r_regionkey < 2 AS available FROM region",
    "a13_judge": "SELECT lang AS question_type, count(*) FILTER (toxic IS NOT NULL AND quality = 1) AS n, coalesce(sum(toxic) FILTER (quality = 1), 0)::BIGINT AS correct, round(avg(toxic) FILTER (quality = 1), 4) AS accuracy, count(*) FILTER (quality <> 1) AS refused FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)",
    "f15_cases": "SELECT item_id FROM benchmark WHERE item_id % 2 = 0 ORDER BY item_id LIMIT 10 OFFSET 3",
    "e07_replay": "SELECT p_partkey AS call_id, CASE WHEN p_size % 2 = 0 THEN 'GetAlerts' ELSE 'GetResources' END AS tool, (SELECT min(printf('%08d', q.p_partkey)) FROM part q WHERE q.p_brand = p.p_brand AND q.p_size % 2 = p.p_size % 2) AS matched_key FROM part p",
    "k13_states": "SELECT user_id AS session_id, CASE WHEN count(*) > 1 THEN 'busy' ELSE min(event_type) END AS goal, CASE WHEN count(*) > 1 AND NOT (min(event_type) = 'busy') THEN 2 ELSE 1 END::BIGINT AS updated_at FROM events GROUP BY user_id",
    "f10_admitted": "SELECT conv_id, turn FROM conversations WHERE trim(coalesce(text, '')) <> '' AND trim(coalesce(role, '')) <> '' AND turn % 5 <> 4 AND conv_id % 3 <> 0 AND NOT list_has_any(list_transform(['身份证', '手机号', '手机号码', '住址', '家庭住址', '银行卡', '密码', '密钥', 'api key', 'apikey', 'token', '病历', '诊断'], lambda w: contains(lower(text || ' ' || role), w)), [true])",
    "p10_api_metadata": """SELECT doc_id, m AS typed, m AS untyped FROM (SELECT doc_id, '{"intent":"' || coalesce(lang, 'none') || '","top_hits":[{"chunk_id":' || doc_id || ',"deep":{"score":' || coalesce(n_chars, 0) || '}}],"warnings":["w"]}' AS m FROM documents)""",
    "t06_fetch_limits": "SELECT item_id, greatest(32, 4 * item_id, 8)::BIGINT AS fetch FROM benchmark",
    "f16_filtered_rank": f"WITH {_bm25()}, p AS (SELECT b.*, d.lang IN ('en', 'es') AS passes FROM bm25_10 b JOIN documents d ON d.doc_id = b.chunk_id) SELECT query_id, chunk_id, score, passes, CASE WHEN passes THEN row_number() OVER (PARTITION BY query_id, passes ORDER BY score DESC, chunk_id) END AS place FROM p",
    "j15_summary_scores": f"""WITH {_PROFILES}, l AS (SELECT doc, list(term ORDER BY rank) AS terms FROM top GROUP BY doc), k AS (SELECT source AS doc, list_sort(list(DISTINCT lang)) AS kinds FROM documents GROUP BY source),
h AS (SELECT doc, {_squeezed("doc || ' ' || doc || ' ' || array_to_string(list_concat(terms[1:32], kinds), ' ') || ' ' || array_to_string(terms, ' ')")} AS hay FROM k LEFT JOIN l USING (doc)),
q AS (SELECT item_id AS query_id, {_squeezed('text')} AS whole, {_terms('text')} AS terms FROM benchmark),
m AS (SELECT query_id, doc, list_filter(terms, lambda x: contains(hay, x)) AS found, contains(hay, whole) AS said FROM q, h),
r AS (SELECT query_id, doc, round(least(0.92, coalesce(list_sum(list_transform(found, lambda x: CASE WHEN length(x) >= 4 THEN 0.16::DOUBLE ELSE 0.1::DOUBLE END)), 0) + CASE WHEN said THEN 0.4 ELSE 0 END), 4) AS score, array_to_string(found, ' ') AS matched FROM m) SELECT * FROM r WHERE score >= 0.18""",
    "j14_whole_profile_scores": f"""WITH {_PROFILES}, l AS (SELECT doc, list(term ORDER BY rank) AS terms FROM top GROUP BY doc),
p AS (SELECT doc, {_squeezed('doc')} AS key, coalesce(terms, []) AS terms FROM (SELECT DISTINCT source AS doc FROM documents) LEFT JOIN l USING (doc)),
q AS (SELECT item_id AS query_id, {_squeezed('text')} AS query, {_terms('text')} AS asked FROM benchmark),
s AS (SELECT query_id, doc, least(100, CASE WHEN key <> '' AND contains(query, key) THEN 85 + 75 ELSE 0 END
 + least(45, coalesce(list_sum(list_transform(list_filter(terms, lambda t: contains(query, t)), lambda t: CASE WHEN length(t) >= 4 THEN 12 ELSE 8 END)), 0))
 + least(30, coalesce(list_sum(list_transform(asked, lambda a: CASE WHEN list_contains(terms, a) THEN 10
   WHEN length(a) >= 2 AND len(list_filter(terms[1:32], lambda t: length(t) >= 2 AND (contains(a, t) OR contains(t, a)))) > 0 THEN 6 ELSE 0 END)), 0))) AS points FROM p, q)
SELECT query_id, doc, points / 100 AS score FROM s WHERE points >= 18""",
    "r04_whole_scan": f"""WITH q AS (SELECT item_id AS query_id, {_terms('text')} AS terms, lower(trim(coalesce(text, ''))) AS said FROM benchmark),
a AS (SELECT DISTINCT query_id, unnest(CASE WHEN len(terms) > 0 THEN terms WHEN said <> '' THEN [said] ELSE [] END) AS term FROM q), t AS (SELECT DISTINCT term FROM a),
h AS (SELECT doc_id AS chunk_id, term FROM documents, t WHERE contains(lower(text), term)),
s AS (SELECT query_id, chunk_id, 1 + sum(greatest(4, least(length(term), 20)))::DOUBLE AS score FROM h JOIN a USING (term) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""",
    "t03_lexical_order": f"""WITH {_bm25()}, {_ASKED}, s AS (SELECT b.query_id, b.chunk_id, b.rank AS was, {_x17('a.terms', 'a.query', 'd.source', 'd.text', 'b.score', 'a.older', "'primary'")} AS lexical FROM bm25_10 b JOIN asked a USING (query_id) JOIN documents d ON d.doc_id = b.chunk_id)
SELECT query_id, chunk_id, lexical, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, was, chunk_id) AS rank FROM s""",
    "r05_scan_needed": f"""WITH {_bm25()}, {_ASKED}, f AS (SELECT query_id, chunk_id, score, round(0.4 * CASE WHEN hi = lo THEN (c - rank + 1) / c ELSE (score - lo) / (hi - lo) END, 6) AS merged FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, count(*) OVER w AS c FROM bm25_10 WINDOW w AS (PARTITION BY query_id))),
t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY merged DESC, chunk_id DESC) = 1), c AS (SELECT query_id, count(*) AS n FROM bm25_10 GROUP BY 1),
l AS (SELECT a.query_id, a.terms, a.intent, coalesce(c.n, 0) AS n, t.merged, CASE WHEN d.doc_id IS NOT NULL THEN {_x17('a.terms', 'a.query', 'd.source', 'd.text', 't.score', 'a.intent', "'primary'")} END AS lexical FROM asked a LEFT JOIN t USING (query_id) LEFT JOIN c USING (query_id) LEFT JOIN documents d ON d.doc_id = t.chunk_id)
SELECT query_id, n AS n_hits, lexical, {_needles()} AS scan FROM l""",
    "p08_evidence": f"WITH {_bm25()} SELECT query_id, b.rank, 'primary' AS role, chunk_id, d.source AS doc_id, d.lang AS language, b.score, d.text FROM bm25_10 b JOIN documents d ON d.doc_id = b.chunk_id WHERE b.rank <= 3".replace(" d.lang AS language,", ""),
    "p09_hit_summaries": f"WITH {_bm25()} SELECT query_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS chunks, count(*) FILTER (chunk_id % 2 = 0) AS with_images FROM bm25_10 WHERE rank <= 3 GROUP BY query_id",
    "a11_evidence": f"""WITH {_bm25()}, {_ASKED}, h AS (SELECT query_id, list(chunk_id) FILTER (rank <= 1) AS one, list(chunk_id) FILTER (rank <= 3) AS three, list(chunk_id) AS every FROM bm25_10 GROUP BY 1)
SELECT query_id, intent = older AS intent_match, coalesce(list_contains(one, query_id * 7), FALSE) AS hit_at_1, coalesce(list_contains(three, query_id * 7), FALSE) AS hit_at_3, coalesce(list_contains(every, query_id * 7), FALSE) AS hit_anywhere,
 query_id % 2 = 0 OR coalesce(len(list_filter(every, lambda c: c % 10 = query_id % 10)) > 0, FALSE) AS pic_hit FROM asked LEFT JOIN h USING (query_id)""",
}


def _fusion(source: str, out: str) -> str:
    """Fused rows of a relation with query_id, chunk_id, channel, score and rank."""
    return f"""
{out}_n AS (SELECT query_id, chunk_id, channel, CASE WHEN channel = 'scan' OR hi = lo THEN (c - rank + 1) / c ELSE (score - lo) / (hi - lo) END AS norm FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, count(*) OVER w AS c FROM {source} WINDOW w AS (PARTITION BY query_id, channel))),
{out} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY merged DESC, channels DESC, chunk_id DESC) AS rank FROM (
 SELECT query_id, chunk_id, round(sum(norm * CASE channel WHEN 'vector' THEN 0.6 WHEN 'bm25' THEN 0.4 ELSE 0.2 END), 6) AS merged, string_agg(channel, '+' ORDER BY channel) AS channels FROM {out}_n GROUP BY query_id, chunk_id))"""


_CHUNKS = "chunks AS (SELECT 'd' || doc_id AS chunk_id, 's-' || source AS parent_id, 'primary' AS tier, text FROM documents UNION ALL SELECT DISTINCT 's-' || source, NULL, 'support', 'documents of ' || source FROM documents)"
_SQL["r14_retrieve"] = rf"""
WITH {_CHUNKS}, {_ASKED}, {_bm25(32, 'chunks', 'chunk_id')},
vec AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.vec_id AS query_id, 'd' || c.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id IN (SELECT item_id FROM benchmark))) WHERE rank <= 32),
found AS (SELECT *, 'bm25' AS channel FROM bm25_32 UNION ALL SELECT *, 'vector' FROM vec WHERE chunk_id IN (SELECT chunk_id FROM chunks)),
{_fusion('found', 'first')},
best AS (SELECT f.query_id, f.chunk_id, f.merged, arg_max(x.score, (x.channel = 'vector')::INT) AS score FROM first f JOIN found x USING (query_id, chunk_id) WHERE f.rank = 1 GROUP BY ALL),
state AS (SELECT a.query_id, a.query, a.terms, a.intent, (SELECT count(DISTINCT chunk_id) FROM found x WHERE x.query_id = a.query_id) AS n, b.merged, CASE WHEN c.chunk_id IS NOT NULL THEN {_x17('a.terms', 'a.query', "''", 'c.text', 'b.score', 'a.intent', 'c.tier')} END AS lexical FROM asked a LEFT JOIN best b USING (query_id) LEFT JOIN chunks c USING (chunk_id)),
weak AS (SELECT query_id, query, terms FROM state WHERE {_needles()}),
points AS (SELECT query_id, chunk_id, 1.0::DOUBLE + CASE WHEN len(terms) > 0 THEN coalesce(list_sum(list_transform(list_filter(terms, lambda t: contains(lower(text), t)), lambda t: greatest(4, least(length(t), 20)))), 0) WHEN contains(lower(text), lower(trim(query))) THEN greatest(4, least(length(trim(query)), 20)) ELSE 0 END AS score FROM weak, chunks),
scan AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, 'scan' AS channel FROM points WHERE score > 1 QUALIFY rank <= 32),
every AS (SELECT * FROM found UNION ALL SELECT * FROM scan),
{_fusion('every', 'whole')},
lex AS (SELECT w.query_id, w.chunk_id, w.rank AS was, c.tier, c.parent_id, {_x17('a.terms', 'a.query', "''", 'c.text', 'w.merged', 'a.older', 'c.tier')} AS lexical FROM whole w JOIN asked a USING (query_id) JOIN chunks c USING (chunk_id)),
top3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, was, chunk_id) AS rank FROM lex QUALIFY rank <= 3),
above AS (SELECT query_id, parent_id, min(rank) AS seen FROM top3 WHERE tier = 'primary' AND parent_id IS NOT NULL GROUP BY ALL)
SELECT query_id, chunk_id, rank, 'primary' AS role FROM top3 UNION ALL SELECT query_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY seen, parent_id), 'support' FROM above a WHERE NOT EXISTS (SELECT 1 FROM top3 t WHERE t.query_id = a.query_id AND t.chunk_id = a.parent_id)
"""


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
