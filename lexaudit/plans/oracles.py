"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from ..functions.values import (
    COMPLIANCE_WORDS,
    CONCEPTS,
    CONTENT_INDICATORS,
    DATA_MENTIONS,
    DEFAULT_DATA_TERMS,
    DEFAULT_REGULATORY_TERMS,
    DOCUMENT_TYPES,
    FRAMEWORK_FILES,
    HEADER,
    MODELS,
    REFERENCE_KINDS,
    REFERENCE_NUMBER,
    REGULATION_PHRASES,
    STOPWORDS,
)
from ..operators.prompts import DEFAULT_TEMPLATE, GUIDANCE
from ..operators.reports import RULE, SHORT_RULE, THIN
from . import corpus as C


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_DOCS = "docs AS (" + C.AUDIT_DOCS.format(customer="customer") + ")"
_RESPONSES = "responses AS (" + C.AUDIT_RESPONSES.format(orders="orders") + ")"
_STRUCTURED = "structured AS (" + C.AUDIT_STRUCTURED.format(orders="orders") + ")"
_FINDINGS = "findings AS (" + C.AUDIT_FINDINGS.format(orders="orders") + ")"
_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{n}'" for p, n in DOCUMENT_TYPES) + " ELSE 'unknown' END"


def _words(words) -> str:
    return rf"array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '\b({'|'.join(words)})\b', 1))), '|')"


_SECTIONS = (
    _DOCS
    + rf""", marked AS (SELECT doc_id, text, {_TYPE} AS document_type, n_bytes, regexp_replace(text, {_q(HEADER)}, chr(1) || '\0' || chr(2), 'g') AS m FROM docs),
pieces AS (SELECT doc_id, document_type, n_bytes, contains(m, chr(1)) AS headed, unnest(string_split(m, chr(1))) AS piece, generate_subscripts(string_split(m, chr(1)), 1) - 1 AS ord FROM marked),
parts AS (SELECT *, contains(piece, chr(2)) AS is_section, string_split(piece, chr(2))[1] AS header FROM pieces),
sections AS (SELECT doc_id, ord::INTEGER AS section_ord,
  CASE WHEN NOT headed THEN 'Document' WHEN is_section THEN {_strip('header')} ELSE 'Introduction/Header' END AS title,
  CASE WHEN headed THEN {_strip("replace(piece, chr(2), '')")} ELSE piece END AS text,
  CASE WHEN is_section AND regexp_matches(header, '^\n?\d+(\.\d+)*\.\s+[^\n]') THEN len(header) - len(replace(header, '.', '')) ELSE 0 END::INTEGER AS level, document_type, n_bytes
  FROM parts WHERE is_section OR NOT headed OR {_strip("piece")} <> '')"""
)


def _chunks(source: str, size: str, overlap: str, extra: str) -> str:
    """Chunks of the rows of ``source``: a fold of paragraphs with a state of the same shape."""
    state = "{cur: '', out: []::VARCHAR[]}"
    full = f"len(acc.cur) + len(x.cur) + 2 > {size} AND acc.cur <> ''"
    tail = rf"regexp_replace(right(acc.cur, {overlap}), '^(?s:.*?[.!?])\s+', '')"
    return rf"""paras AS (SELECT *, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda p: {_strip('p')}), lambda p: p <> '') AS ps FROM {source}),
folded AS (SELECT *, CASE WHEN len(text) <= {size} THEN [text] ELSE list_transform([list_reduce(list_prepend({state}, list_transform(ps, lambda p: {{cur: p, out: []::VARCHAR[]}})),
  lambda acc, x: {{cur: CASE WHEN {full} THEN CASE WHEN {overlap} > 0 AND len(acc.cur) > {overlap} THEN {tail} || chr(10) || chr(10) || x.cur ELSE x.cur END WHEN acc.cur <> '' THEN acc.cur || chr(10) || chr(10) || x.cur ELSE x.cur END,
  out: CASE WHEN {full} THEN list_append(acc.out, acc.cur) ELSE acc.out END}})], lambda s: CASE WHEN s.cur <> '' THEN list_append(s.out, s.cur) ELSE s.out END)[1] END AS cs FROM paras),
split AS (SELECT * EXCLUDE (text, ps, cs), len(text) <= {size} AS whole, unnest(cs) AS text, generate_subscripts(cs, 1) AS part FROM folded),
chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY section_ord, part) - 1)::INTEGER AS chunk_index,
  CASE WHEN whole THEN title ELSE title || ' (Part ' || part || ')' END AS position, text, level{extra} FROM split)"""


_CHUNKS = _SECTIONS + ", " + _chunks("sections", "500", "100", ", document_type")
_TERM_LINES = "".join(
    f"{'UNION ALL ' if i else ''}SELECT '{kind}' AS term_type, unnest(string_split({_q(text)}, chr(10))) AS line, generate_subscripts(string_split({_q(text)}, chr(10)), 1) - 1 AS term_ord "
    for i, (kind, text) in enumerate((("data_terms", C.TERMS), ("regulatory_keywords", C.KEYWORDS)))
)
_TERMS = f"terms AS (SELECT term_type, term_ord::BIGINT AS term_ord, {_strip('line')} AS term FROM ({_TERM_LINES}) WHERE NOT starts_with(line, '#') AND {_strip('line')} <> '')"
_SCORES = (
    _CHUNKS
    + ", "
    + _TERMS
    + """, scored AS (SELECT c.doc_id, c.chunk_index, c.position, c.text, c.document_type, count(*) FILTER (t.term_type = 'data_terms')::INTEGER AS data_score, count(*) FILTER (t.term_type = 'regulatory_keywords')::INTEGER AS regulatory_score
FROM chunks c LEFT JOIN terms t ON contains(lower(c.text), t.term) GROUP BY ALL),
routed AS (SELECT *, data_score + regulatory_score AS total_score, CASE WHEN len(text) < 100 THEN false ELSE data_score + regulatory_score >= 3 OR len(text) > 1500 END AS should_analyze FROM scored)"""
)
_FILE = lambda text: f"(SELECT 'demo' AS framework, {_q(text)} AS text)"
_FILES = lambda sql: f"({sql.format(customer='customer')})"
_PATTERNS_OF = lambda source: f"""blocks AS (SELECT framework, unnest(string_split(text, chr(10) || chr(10))) AS block, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS pattern_ord FROM {source} f),
fields AS (SELECT framework, pattern_ord::INTEGER AS pattern_ord, regexp_extract(block, '(?m)^Pattern:(.*)$', 1) AS p, regexp_extract(block, '(?m)^Description:(.*)$', 1) AS d, regexp_extract(block, '(?m)^Indicators:(.*)$', 1) AS i, regexp_extract(block, '(?m)^Related[^:]*:(.*)$', 1) AS r FROM blocks WHERE len(string_split(block, chr(10))) >= 3),
patterns AS (SELECT framework, pattern_ord, trim(p) AS pattern, trim(d) AS description, CASE WHEN contains(i, '"') THEN regexp_extract_all(i, '"([^"]*)"', 1) ELSE list_transform(string_split(i, ','), lambda x: trim(x)) END AS indicators, list_transform(string_split(trim(r), ','), lambda x: trim(x)) AS related_refs FROM fields WHERE p <> ''),
inds AS (SELECT pattern_ord, (generate_subscripts(indicators, 1) - 1)::INTEGER AS indicator_ord, pattern, description, unnest(indicators) AS indicator, related_refs FROM patterns)"""  # noqa: E731
_PATTERNS = _PATTERNS_OF(_FILE(C.PATTERNS))


def _scan(source: str, keys: str) -> str:
    return f"""found AS (SELECT {keys}, pattern_ord, indicator_ord, pattern, description, indicator, related_refs,
  substr(text, greatest(instr(lower(text), lower(indicator)) - 50, 1), instr(lower(text), lower(indicator)) + len(indicator) + 50 - greatest(instr(lower(text), lower(indicator)) - 50, 1)) AS context
  FROM {source} JOIN inds ON contains(lower(text), lower(indicator)))"""


_ARTICLE_LINES = lambda source: f"""lines AS (SELECT framework, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {source} f),
flags AS (SELECT *, regexp_matches(trim(line), '^((Article|Section|Rule|Standard|Requirement|Principle|Regulation|Part|Chapter)\\s+\\S+|\\d+\\.\\s*[A-Z]|[A-Z][A-Z\\s]+[A-Z]$|\\d+\\.\\d+\\s+)') AS starts FROM lines),
grouped AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY framework ORDER BY n) AS art, CASE WHEN starts THEN CASE WHEN contains(line, ' - ') THEN trim(substr(line, instr(line, ' - ') + 3)) ELSE '' END ELSE line END AS tagged FROM flags)""".replace("\\\\", "\\")  # noqa: E731
_CONCEPTS_OF = lambda x: f"list_sort(list_filter({_list(CONCEPTS)}, lambda c: regexp_matches(lower({x}), '\\b' || c || '\\b')))"
_ARTICLES_OF = lambda source: _ARTICLE_LINES(source) + f""", articles AS (SELECT framework, (row_number() OVER (PARTITION BY framework ORDER BY art) - 1)::INTEGER AS art_ord, coalesce(max(CASE WHEN starts THEN trim(string_split(line, ' - ')[1]) END), '') AS id,
  coalesce(max(CASE WHEN starts THEN tagged END), '') AS title, string_agg(line || chr(10), '' ORDER BY n) AS text, flatten(list({_CONCEPTS_OF('tagged')} ORDER BY n)) AS related_concepts FROM grouped GROUP BY framework, art)"""  # noqa: E731
_ARTICLES = _ARTICLES_OF(_FILE(C.ARTICLES))
_KNN = """reps AS (SELECT label AS art_ord, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
pairs AS (SELECT vec_id, art_ord, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: (embedding[i]::DOUBLE - v[i]::DOUBLE) * (embedding[i]::DOUBLE - v[i]::DOUBLE))), 6) AS distance FROM embeddings, reps),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, art_ord)::INTEGER AS rank FROM pairs)"""


def _bare(x: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace({x}, '[^\w\s]', '', 'g'), '\s+', ' ', 'g')")


def _norm_text(x: str) -> str:
    return _bare(rf"regexp_replace(lower({x}), '\b({'|'.join(STOPWORDS)})\b', '', 'g')")


def _norm_reg(x: str, compat: bool = True) -> str:
    bare = _bare(f"lower({x})")
    pattern = r"'(article|regulation|section|rule)\s+(\d+)'"
    kind = f"regexp_extract({bare}, {pattern}, {2 if compat else 1})"
    return f"CASE WHEN {x} = '' THEN 'unknown' WHEN regexp_matches({bare}, {pattern}) THEN {kind} || regexp_extract({bare}, {pattern}, 2) ELSE {bare} END"


_KEY = f"({_norm_reg('regulation')}) || ':' || left({_norm_text('description')}, 40)"
_KINDS = "|".join(REFERENCE_KINDS)
_INNER, _BARE = rf"'(?i)\((?:({_KINDS})\s*)?({REFERENCE_NUMBER})\)'", rf"'(?i)\b({_KINDS})\s*({REFERENCE_NUMBER})\b'"


def _reference(x: str) -> str:
    kind = f"regexp_extract({x}, {_INNER}, 1)"
    return f"CASE WHEN regexp_matches({x}, {_INNER}) THEN CASE WHEN {kind} = '' THEN 'Section' ELSE {kind} END || ' ' || regexp_extract({x}, {_INNER}, 2) WHEN regexp_matches({x}, {_BARE}) THEN regexp_extract({x}, {_BARE}, 1) || ' ' || regexp_extract({x}, {_BARE}, 2) ELSE 'Unknown Regulation' END"


def _article(x: str) -> str:
    own = rf"regexp_extract({x}, '^(?i:Article|Art\.)\s*(\d+(?:\(\d+\))?(?:\([a-z]\))?)', 1)"
    other = rf"regexp_extract({x}, '^(?i:Section|Rule|Standard|Requirement|Regulation|Part|Chapter)\s*(\d+(?:\.\d+)?(?:\(\d+\))?(?:\([a-z]\))?)', 1)"
    number = rf"regexp_extract({x}, '(\d+(?:\(\d+\))?(?:\([a-z]\))?)', 1)"
    return rf"CASE WHEN {x} IN ('', 'Unknown regulation', 'Unknown Regulation') OR NOT regexp_matches({x}, '\d') THEN 'Unknown Article' ELSE 'Article ' || CASE WHEN regexp_matches({x}, '^\d+$') THEN {x} WHEN {own} <> '' THEN {own} WHEN {other} <> '' THEN {other} ELSE {number} END END"


def _citation(x: str) -> str:
    text = f"trim(trim({x}, '\"'), '''')"
    return f"len({text}) >= 10 AND NOT regexp_matches(lower({text}), '{'|'.join(REGULATION_PHRASES)}')"


_CLEAN = r"regexp_replace(response, '(?s)```.*?```', '', 'g')"


def _block(kind: str) -> str:
    heading = {"issue": "ISSUES", "point": "POINTS"}[kind]
    end = r"(?:COMPLIANCE\s+POINTS:|\n?\z)" if kind == "issue" else r"\n?\z"
    return rf"CASE WHEN contains({_CLEAN}, 'NO COMPLIANCE {heading} DETECTED') THEN '' ELSE {_strip(rf"regexp_extract({_CLEAN}, '(?is)COMPLIANCE\s+{heading}:?\s*\n(.*?){end}', 1)")} END"


def _parsed(kind: str) -> str:
    none, dismissed = {"issue": ("'compliance issues', 'no issues'", "This violates"), "point": ("'compliance points', 'no points'", "This supports")}[kind]
    cut = lambda x: f"CASE WHEN quote <> '' AND contains({x}, quote) THEN {_strip(f'string_split({x}, quote)[1]')} ELSE {x} END"
    return rf"""WITH {_RESPONSES}, b AS (SELECT *, {_block(kind)} AS block FROM responses),
p AS (SELECT doc_id, chunk_index, position, should_analyze, list_filter(list_transform(string_split(regexp_replace(block, '(^|\n)\s*\d+\.\s+', chr(1), 'g'), chr(1))[2:],
  lambda x: {_strip(r"regexp_replace(x, '(?s)\n\s*\d+\..*$', '')")}), lambda x: len(x) >= 10 AND lower(x) NOT IN ({none})) AS items FROM b),
i AS (SELECT * EXCLUDE (items), unnest(items) AS item, (generate_subscripts(items, 1) - 1)::INTEGER AS ord FROM p),
q AS (SELECT *, regexp_extract(item, '"([^"]+)"', 0) AS quote, string_split_regex(item, '(?i)EXPLANATION:') AS e FROM i),
h AS (SELECT *, {_strip('e[1]')} AS head0, {_strip("array_to_string(e[2:], 'EXPLANATION:')")} AS tail FROM q),
g AS (SELECT *, {cut('head0')} AS head FROM h)
SELECT doc_id, chunk_index, ord, CASE WHEN len(e) > 1 THEN CASE WHEN tail <> '' AND NOT starts_with(tail, '{dismissed}') AND NOT ends_with(head, '.') THEN head || '. ' || tail ELSE head END ELSE {cut('item')} END AS description,
  {_reference('item')} AS regulation, 'Medium' AS confidence, quote AS citation, position AS section, should_analyze FROM g"""


_SPLIT = _STRUCTURED + """, after AS (SELECT doc_id, response, contains(response, 'COMPLIANCE ISSUES:') AS hi, contains(response, 'COMPLIANCE POINTS:') AS hp, string_split(response, 'COMPLIANCE ISSUES:')[2] AS rest FROM structured),
halves AS (SELECT doc_id, """ + _strip("coalesce(CASE WHEN hi AND contains(rest, 'COMPLIANCE POINTS:') THEN string_split(rest, 'COMPLIANCE POINTS:')[1] WHEN hi AND NOT hp THEN rest ELSE '' END, '')") + " AS issues, " + _strip("coalesce(CASE WHEN hi THEN string_split(rest, 'COMPLIANCE POINTS:')[2] WHEN hp THEN string_split(response, 'COMPLIANCE POINTS:')[2] ELSE '' END, '')") + " AS points FROM after)"

_RANK = "CASE upper(confidence) WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"


def _dedup(source: str) -> str:
    """merged: one row per key, from the first rows of each group."""
    return f"""keyed AS (SELECT *, {_KEY} AS key, row_number() OVER (PARTITION BY doc_id, kind ORDER BY chunk_index, ord) AS n, {_RANK} AS rank FROM {source} WHERE description <> ''),
g AS (SELECT doc_id, kind, key, arg_min(description, n) AS description, arg_min(regulation, n) AS regulation, arg_max(confidence, rank * 1000000000::BIGINT - n) AS confidence, arg_min(citation, n) AS citation0, arg_min(explanation, n) AS explanation0,
  arg_min(should_analyze, n) AS first_analyzed, arg_min(citation, n) FILTER (should_analyze) AS later_citation, arg_min(explanation, n) FILTER (should_analyze) AS later_explanation, bool_or(should_analyze) AS should_analyze, min(n) AS n, count(*) AS n_merged FROM keyed GROUP BY ALL),
places AS (SELECT doc_id, kind, key, section, min(n) AS n FROM keyed GROUP BY ALL),
unions AS (SELECT doc_id, kind, key, list(section ORDER BY n) AS sections FROM places GROUP BY ALL),
merged AS (SELECT g.* EXCLUDE (citation0, explanation0, first_analyzed, later_citation, later_explanation), sections, CASE WHEN NOT first_analyzed AND should_analyze THEN later_explanation ELSE explanation0 END AS explanation,
  CASE WHEN NOT first_analyzed AND should_analyze AND later_citation <> 'No specific quote provided.' THEN later_citation ELSE citation0 END AS citation FROM g JOIN unions USING (doc_id, kind, key)),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY CASE {_RANK} WHEN 3 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END, regulation, n)::INTEGER AS place FROM merged)"""


_MERGED = f"WITH {_FINDINGS}, {_dedup('findings')} "
_MERGED_COLUMNS = "doc_id, key, description, regulation, confidence, citation, explanation, should_analyze, n_merged"
_RULES = f"""WITH {_SCORES}, {_PATTERNS}, {_scan('routed', 'doc_id, chunk_index, position, should_analyze')},
firsts AS (SELECT doc_id, chunk_index, position, pattern_ord, arg_min(description, indicator_ord) AS description, arg_min(related_refs, indicator_ord) AS refs, arg_min(indicator, indicator_ord) AS indicator FROM found WHERE should_analyze GROUP BY ALL),
rules AS (SELECT doc_id, chunk_index, 'issue' AS kind, pattern_ord AS ord, description, refs[1] AS regulation, 'Medium' AS confidence, '"' || indicator || '"' AS citation, '' AS explanation, position AS section, true AS should_analyze FROM firsts)"""
_SHOWN = "CASE WHEN len(sections) <= 2 THEN array_to_string(sections, ', ') ELSE sections[1] || ', ' || sections[2] || ' and ' || (len(sections) - 2) || ' more' END"
_MODELS = "(VALUES " + ", ".join(f"({_q(k)}, {_q(n)}, {b}, {c}, {t}::DOUBLE, {_q(x)})" for k, n, b, c, t, x in MODELS) + ") m(key, name, batch_size, context_window, temperature, description)"

_FIELDS = "'" + r'(?is)ISSUE\s*\d+:\s*(.+?)\s*\nArticle:\s*(.+?)\s*\nConfidence:\s*(High|Medium|Low)\s*\nExplanation:\s*(.+?)\s*\n(?:Citation:\s*(?:"(.+?)"|(.+?)))?(?:\n\n|\nISSUE|\z)' + "'"
_STRUCTURED_ITEMS = f"""WITH {_SPLIT}, a AS (SELECT doc_id, {", ".join(f"regexp_extract_all(issues, {_FIELDS}, {n}) AS f{n}" for n in range(1, 7))} FROM halves),
u AS (SELECT doc_id, {", ".join(f"unnest(f{n}) AS f{n}" for n in range(1, 7))}, (generate_subscripts(f1, 1) - 1)::INTEGER AS ord FROM a), c AS (SELECT *, {_strip('f2')} AS art, {_strip("CASE WHEN f5 <> '' THEN f5 ELSE f6 END")} AS cit FROM u)
SELECT doc_id, {_strip('f1')} AS title, {_article('art')} AS regulation, {_strip('f3')} AS confidence, {_strip('f4')} AS explanation, CASE WHEN cit <> '' AND {_citation('cit')} THEN cit END AS citation FROM c"""
_SIMPLE_ITEMS = rf"""WITH {_SPLIT}, b AS (SELECT doc_id, 'issue' AS kind, string_split(issues, chr(10)) AS ls FROM halves UNION ALL SELECT doc_id, 'point', string_split(points, chr(10)) FROM halves),
l AS (SELECT doc_id, kind, unnest(ls) AS raw, generate_subscripts(ls, 1) AS n FROM b), s AS (SELECT doc_id, kind, n, {_strip('raw')} AS line FROM l),
m AS (SELECT *, regexp_matches(line, '^(\d+\.|[-*•])') AS starts FROM s WHERE line <> ''),
f AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY doc_id, kind ORDER BY n)::INTEGER AS item_ord, CASE WHEN starts THEN 'start' WHEN regexp_matches(line, '(?i)^(Article|GDPR Article)') THEN 'article' WHEN regexp_matches(line, '(?i)^Confidence') THEN 'confidence' WHEN regexp_matches(line, '(?i)^Explanation') THEN 'explanation' WHEN regexp_matches(line, '(?i)^Citation') THEN 'citation' ELSE 'other' END AS field,
  CASE WHEN contains(line, ':') THEN {_strip("substr(line, instr(line, ':') + 1)")} END AS value, regexp_extract(line, '(?i)(High|Medium|Low)', 1) AS level FROM m),
g AS (SELECT *, trim(value, '"') AS quote, max(CASE WHEN field = 'explanation' AND value IS NOT NULL THEN n END) OVER (PARTITION BY doc_id, kind, item_ord) AS restart FROM f WHERE item_ord > 0)
SELECT doc_id, kind, item_ord, max(line) FILTER (field = 'start') AS title, coalesce(arg_max(line, n) FILTER (field = 'article'), 'Unknown Article') AS regulation, coalesce(arg_max(level, n) FILTER (field = 'confidence' AND level <> ''), 'Medium') AS confidence,
  coalesce(arg_max(value, n) FILTER (field = 'explanation' AND value IS NOT NULL), '') || coalesce(string_agg(' ' || line, '' ORDER BY n) FILTER (field = 'other' AND n > coalesce(restart, -1)), '') AS explanation,
  arg_max(quote, n) FILTER (field = 'citation' AND {_citation('quote')}) AS citation FROM g GROUP BY doc_id, kind, item_ord"""
_BULLETS = " || chr(10) || ".join(rf"'- Contains {n[4:]} references: ' || CASE WHEN regexp_matches(text, '(?i)\b({'|'.join(w)})\b') THEN 'Yes' ELSE 'No' END" for n, w in CONTENT_INDICATORS.items())
_VIOLATION = """rank || '. Potential ''' || pattern || ''' pattern detected' || chr(10) || '   Description: ' || description || chr(10) || '   Indicator: ''' || indicator || '''' || chr(10) || '   Context: "...' || context || '..."' || chr(10) || '   Related articles: ' || array_to_string(related_refs, ', ') || chr(10) || chr(10)"""
_SHAPE = lambda x: f"[len({x}) % 13, len({x}) // 40]"


def _prompt(risk: str) -> str:
    sql = _q(DEFAULT_TEMPLATE)
    for name, value in {"section": "position", "text": "text", "regulations": "regs", "indicators": "bullets", "violations": "coalesce(v, '')", "guidance": _q(GUIDANCE.get(risk, ""))}.items():
        sql = sql.replace("{" + name + "}", f"' || {value} || '")
    return sql


_NEAREST = f"""asked AS (SELECT * FROM routed WHERE should_analyze), vs AS (SELECT a.doc_id, a.chunk_index, art_ord, id, title, r.text AS body, related_concepts, {_SHAPE('a.text')} AS x, {_SHAPE('r.text')} AS y FROM asked a, articles r),
near AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY (x[1] - y[1]) * (x[1] - y[1]) + (x[2] - y[2]) * (x[2] - y[2]), art_ord) AS place FROM vs)"""
_PROMPTS = f"""WITH {_SCORES}, {_PATTERNS}, {_ARTICLES}, {_NEAREST}, {_scan('asked', 'doc_id, chunk_index')},
h AS (SELECT doc_id, chunk_index, 'REGULATION CONTEXT:' || chr(10) || 'Rules on data.' || chr(10) || chr(10) || 'VIOLATION PATTERNS: 4 patterns available' || string_agg(chr(10) || chr(10) || 'REGULATION ' || place || ': ' || id || CASE WHEN title <> '' THEN ' - ' || title ELSE '' END
  || CASE WHEN len(related_concepts) > 0 THEN chr(10) || 'RELATED CONCEPTS: ' || array_to_string(related_concepts, ', ') ELSE '' END || chr(10) || body, '' ORDER BY place) AS regs FROM near WHERE place <= 5 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY pattern_ord, indicator_ord) AS rank FROM found),
v AS (SELECT doc_id, chunk_index, 'PRE-SCAN DETECTED POTENTIAL VIOLATIONS:' || chr(10) || string_agg({_VIOLATION}, '' ORDER BY rank) AS v FROM r WHERE rank <= 5 GROUP BY ALL),
c AS (SELECT *, {_BULLETS} AS bullets FROM asked), p AS (SELECT doc_id, chunk_index, position, @ AS prompt FROM c JOIN h USING (doc_id, chunk_index) LEFT JOIN v USING (doc_id, chunk_index))"""
_HOOKS = f"""WITH {_SCORES}, {_ARTICLES}, {_NEAREST}, h AS (SELECT doc_id, chunk_index, string_agg(upper(id), ';' ORDER BY place) AS regs FROM near WHERE place <= 5 GROUP BY ALL)
SELECT doc_id, chunk_index, position || '|' || regs || '|- Contains mail references: ' || CASE WHEN contains(lower(text), 'email') THEN 'Yes' ELSE 'No' END || '|' || CASE WHEN contains(lower(text), 'encryption') THEN 'PRE-SCAN DETECTED POTENTIAL VIOLATIONS:' || chr(10) || '1. Potential ''Own scan'' pattern detected' || chr(10)
  || '   Indicator: ''encryption''' || chr(10) || '   Context: "...own..."' || chr(10) || chr(10) ELSE '' END || '|' || {_q(GUIDANCE['low'])} AS prompt FROM asked JOIN h USING (doc_id, chunk_index)"""
_MODEL_AUDIT = _PROMPTS.replace("@", _prompt("unknown")) + """, k AS (SELECT *, len(prompt) AS n FROM p)
SELECT doc_id, chunk_index, 'issue' AS kind, 'The request has ' || n || ' characters (Article ' || (n % 9 + 1) || ').' AS description, 'Article ' || (n % 9 + 1) AS regulation, '"' || n || ' of them"' AS citation, position AS section FROM k
UNION ALL SELECT doc_id, chunk_index, 'point', 'It was read as a whole. nothing is cut (Rule ' || (n % 7) || ').', 'Rule ' || (n % 7), '', position FROM k"""
_CANNED = f"""WITH {_SCORES}, e AS (SELECT doc_id, should_analyze, should_analyze AND contains(text, 'audit') AS failed, len(text) AS n FROM routed)
SELECT doc_id, count(*) FILTER (failed) AS n_errors, count(*) AS n_chunks, count(DISTINCT n) FILTER (should_analyze AND NOT failed) AS n_findings FROM e GROUP BY doc_id"""
_REPORT_ROWS = f"{_DOCS}, rules AS ({C.REPORT_FINDINGS.format(orders='orders')}), chunk_rows AS ({C.REPORT_CHUNKS.format(customer='customer')}), {_dedup('rules')}"
_CITED = "CASE WHEN starts_with(citation, '\"') OR ends_with(citation, '\"') THEN citation ELSE '\"' || citation || '\"' END"


def _overview(kind: str, part: int, title: str, noun: str, summary: str, before: str) -> str:
    """Lines of the summary of a kind: its confidences, and its regulations with the findings of each."""
    return f"""
  UNION ALL SELECT doc_id, {part + 1}, 0, 0, [{before}'CONFIDENCE BREAKDOWN OF {title}:', '- High Confidence {noun}: ' || {kind}_high, '- Medium Confidence {noun}: ' || {kind}_medium, '- Low Confidence {noun}: ' || {kind}_low, '', 'SUMMARY OF COMPLIANCE {summary}:', '{THIN}', ''] FROM w WHERE {kind}_total > 0
  UNION ALL SELECT doc_id, {part + 2}, grp, 0, [regulation || ':'] FROM rg WHERE kind = '{kind}' UNION ALL SELECT doc_id, {part + 2}, grp, 1000000, [''] FROM rg WHERE kind = '{kind}'
  UNION ALL SELECT doc_id, {part + 2}, grp, place, ['  - ' || description || CASE WHEN sa THEN '' ELSE ' (SKIPPED)' END || ' (in ' || {_SHOWN} || ', ' || confidence || ' confidence)'] FROM fs JOIN un USING (doc_id, kind, regulation, description) JOIN rg USING (doc_id, kind, regulation) WHERE kind = '{kind}'
  UNION ALL SELECT doc_id, {part + 3}, 0, 0, ['{THIN}', ''] FROM w WHERE {kind}_total > 0"""


def _per_kind(kind: str) -> str:
    of = f"kind = '{kind}'"
    return f"count(*) FILTER ({of}) AS {kind}_total, count(*) FILTER ({of} AND should_analyze) AS {kind}_analyzed, " + ", ".join(f"count(*) FILTER ({of} AND upper(confidence) = '{level.upper()}') AS {kind}_{level}" for level in ("high", "medium", "low"))


_WIDE = [f"{kind}_{c}" for kind in ("issue", "point") for c in ("total", "analyzed", "high", "medium", "low")] + ["issues_before", "points_before"]
_REPORT = f"""WITH {_REPORT_ROWS},
n AS (SELECT doc_id, {_per_kind('issue')}, {_per_kind('point')} FROM merged GROUP BY doc_id),
o AS (SELECT doc_id, count(*) FILTER (kind = 'issue') AS issues_before, count(*) FILTER (kind = 'point') AS points_before FROM rules GROUP BY doc_id),
w AS (SELECT d.doc_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _WIDE)}, regexp_extract(path, '[^/]*$') AS name, {_TYPE} AS type, replace({_words(DATA_MENTIONS)}, '|', ', ') AS mentions, replace({_words(COMPLIANCE_WORDS)}, '|', ', ') AS words
  FROM docs d LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)),
rg AS (SELECT doc_id, kind, regulation, min(place) AS grp FROM placed GROUP BY ALL),
each AS (SELECT doc_id, kind, regulation, description, place, unnest(sections) AS section, generate_subscripts(sections, 1) AS spot FROM placed),
once AS (SELECT doc_id, kind, regulation, description, section, min(place * 1000 + spot) AS spot FROM each GROUP BY ALL),
un AS (SELECT doc_id, kind, regulation, description, list(section ORDER BY spot) AS sections FROM once GROUP BY ALL),
fs AS (SELECT doc_id, kind, regulation, description, arg_min(confidence, place) AS confidence, arg_min(should_analyze, place) AS sa, min(place) AS place FROM placed GROUP BY ALL),
pc AS (SELECT doc_id, chunk_index, count(*) FILTER (kind = 'issue') AS n_issue, count(*) FILTER (kind = 'point') AS n_point FROM rules GROUP BY ALL),
ls AS (SELECT *, CASE kind WHEN 'issue' THEN 0 ELSE 1000000 END + row_number() OVER k AS spot, row_number() OVER k AS place, count(*) OVER (PARTITION BY doc_id, chunk_index, kind) AS n_kind FROM rules WINDOW k AS (PARTITION BY doc_id, chunk_index, kind ORDER BY ord)),
ck AS (SELECT r.*, coalesce(n_issue, 0) AS n_issue, coalesce(n_point, 0) AS n_point, CASE WHEN should_analyze THEN '' ELSE ' SKIPPED' END AS mark FROM chunk_rows r LEFT JOIN pc USING (doc_id, chunk_index)),
blocks_of AS (
  SELECT doc_id, 0 AS a, 0 AS b, 0 AS c, ['{RULE}', 'DEMO COMPLIANCE ANALYSIS REPORT', '{RULE}', '', 'Document: ' || name, 'Document Type: ' || type, 'Regulation: demo', 'Analysis Date: 2024-01-01 00:00:00', '', 'POTENTIAL DATA CONTEXT:', 'Data mentions: ' || mentions, 'Compliance indicators: ' || words, '',
    'Total Issues Found: ' || issue_total, 'Analysis Method: Progressive (focused on relevant sections)', '- From analyzed sections: ' || issue_analyzed, '- From skipped sections: ' || (issue_total - issue_analyzed), '', 'PROCESSING SUMMARY:', '- Original issues: ' || issues_before || ' → Final: ' || issue_total, '- Original compliance points: ' || points_before || ' → Final: ' || point_total] AS lines FROM w
  {_overview('issue', 0, 'ISSUES', 'Issues', 'CONCERNS', "'', ")}{_overview('point', 10, 'COMPLIANCE POINTS', 'Points', 'STRENGTHS', '')}
  UNION ALL SELECT doc_id, 30, 0, 0, ['DETAILED ANALYSIS BY SECTION:', '{RULE}', ''] FROM w
  UNION ALL SELECT doc_id, 31, chunk_index, 0, ['SECTION #' || (chunk_index + 1) || ' - ' || position || CASE WHEN should_analyze THEN '' ELSE ' [SKIPPED]' END, '{THIN}', '', 'DOCUMENT TEXT:', text, ''] || CASE WHEN n_issue > 0 THEN ['COMPLIANCE ISSUES:', ''] ELSE ['NO COMPLIANCE ISSUES DETECTED IN THIS' || mark || ' SECTION'] END FROM ck
  UNION ALL SELECT doc_id, 31, chunk_index, spot, [CASE kind WHEN 'issue' THEN 'Issue ' ELSE 'Point ' END || place || ': ' || replace(description, '*', ''), 'Regulation: ' || regulation, 'Confidence: ' || confidence] || CASE WHEN citation <> '' THEN ['Citation: ' || {_CITED}] ELSE [] END || CASE WHEN place < n_kind THEN ['{SHORT_RULE}', ''] ELSE [] END FROM ls
  UNION ALL SELECT doc_id, 31, chunk_index, 1000000, CASE WHEN n_issue > 0 THEN ['', ''] ELSE [] END || CASE WHEN n_point > 0 THEN ['COMPLIANCE POINTS:', ''] ELSE ['NO COMPLIANCE POINTS DETECTED IN THIS' || mark || ' SECTION'] END FROM ck
  UNION ALL SELECT doc_id, 31, chunk_index, 2000000, ['', '{RULE}', ''] FROM ck),
un2 AS (SELECT doc_id, a, b, c, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM blocks_of)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b, c, i)::INTEGER AS line_no, line FROM un2"""

_JSON = f"""WITH {_REPORT_ROWS},
e AS (SELECT doc_id, kind, place, '{{"' || kind || '":' || to_json(description) || ',"regulation":' || to_json(regulation) || ',"confidence":' || to_json(confidence) || ',"explanation":' || to_json(explanation) || ',"citation":' || to_json(citation)
  || CASE WHEN len(sections) = 1 THEN ',"section":' || to_json(sections[1]) ELSE ',"sections":' || to_json(sections) END || ',"should_analyze":' || to_json(should_analyze) || '}}' AS entry FROM placed),
a AS (SELECT doc_id, count(*) FILTER (kind = 'issue') AS n, count(*) FILTER (kind = 'point') AS m, string_agg(entry, ',' ORDER BY place) FILTER (kind = 'issue') AS entries, string_agg(entry, ',' ORDER BY place) FILTER (kind = 'point') AS others FROM e GROUP BY doc_id)
SELECT doc_id, '{{"document":' || to_json(regexp_extract(path, '[^/]*$')) || ',"document_type":' || to_json({_TYPE}) || ',"regulation_framework":"demo","findings":[' || coalesce(entries, '') || '],"compliance_points":[' || coalesce(others, '') || '],"analysis_type":"progressive","summary":"The document contains '
  || coalesce(n, 0) || ' potential compliance issue(s) and ' || coalesce(m, 0) || ' compliance point(s) related to demo."}}' AS report FROM docs LEFT JOIN a USING (doc_id)"""

_FIELD = lambda f: f"trim(coalesce(json_extract_string(item, '$.{f}'), ''))"
_JSON_FINDINGS = rf"""answers AS ({C.AUDIT_JSON.format(orders="orders")}),
bodies AS (SELECT *, regexp_extract(response, '(?s)\{{.*\}}', 0) AS body FROM answers), checked AS (SELECT *, body <> '' AND json_valid(body) AS valid FROM bodies),
listed AS (SELECT doc_id, chunk_index, position, NOT valid AS repaired, CASE WHEN valid THEN json_extract(body, '$.issues[*]')::VARCHAR[] ELSE list_filter(regexp_extract_all(response, '\{{[^{{}}]*\}}'), lambda x: json_valid(x)) END AS items,
  CASE WHEN valid THEN json_extract_string(body, '$.topic_tags[*]') ELSE regexp_extract_all(regexp_extract(response, '"topic_tags"\s*:\s*\[([^\]]*)', 1), '"([^"]*)"', 1) END AS named FROM checked),
numbered AS (SELECT doc_id, chunk_index, position, repaired, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS ord,
  list_sort(list_distinct(list_filter(list_transform(named, lambda t: regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')), lambda t: t <> ''))) AS tags FROM listed),
json_found AS (SELECT doc_id, chunk_index, ord::INTEGER AS ord, {_FIELD('issue')} AS description, CASE WHEN {_FIELD('regulation')} = '' THEN 'Unknown Regulation' ELSE {_FIELD('regulation')} END AS regulation,
  CASE lower({_FIELD('confidence')}) WHEN 'high' THEN 'High' WHEN 'low' THEN 'Low' ELSE 'Medium' END AS confidence, {_FIELD('citation')} AS citation, {_FIELD('explanation')} AS explanation, position AS section, repaired, tags FROM numbered WHERE {_FIELD('issue')} <> '')"""
_PAIRS = r"""said AS (SELECT doc_id, chunk_index, ord, section, description, regexp_matches(lower(description), '\b(no|not|never|none|nobody|nothing|without|cannot|lacks|missing|fails)\b') AS denies, unnest(tags) AS tag FROM json_found),
met AS (SELECT a.doc_id, b.chunk_index AS earlier_chunk, b.ord AS earlier_ord, b.section AS earlier_section, b.description AS earlier_description, a.chunk_index AS later_chunk, a.ord AS later_ord, a.section AS later_section, a.description AS later_description, a.tag
  FROM said a JOIN said b ON a.doc_id = b.doc_id AND a.tag = b.tag AND a.denies <> b.denies AND b.chunk_index < a.chunk_index
  QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.tag, a.chunk_index, a.ord ORDER BY b.chunk_index DESC, b.ord DESC) = 1)"""

ORACLES: dict[str, str] = {
    "doc_type": f"WITH {_DOCS} SELECT doc_id, {_TYPE} AS document_type FROM docs",
    "data_mentions": f"WITH {_DOCS} SELECT doc_id, {_words(DATA_MENTIONS)} AS mentions FROM docs",
    "compliance_indicators": f"WITH {_DOCS} SELECT doc_id, {_words(COMPLIANCE_WORDS)} AS mentions FROM docs",
    "content_indicators": f"WITH {_DOCS} SELECT doc_id, " + ", ".join(rf"CASE WHEN regexp_matches(text, '(?i)\b({'|'.join(w)})\b') THEN 'Yes' ELSE 'No' END AS {n}" for n, w in CONTENT_INDICATORS.items()) + " FROM docs",
    "indicator_bullets": f"WITH {_DOCS} SELECT doc_id, " + " || chr(10) || ".join(rf"'- Contains {n[4:]} references: ' || CASE WHEN regexp_matches(text, '(?i)\b({'|'.join(w)})\b') THEN 'Yes' ELSE 'No' END" for n, w in CONTENT_INDICATORS.items()) + " AS bullets FROM docs",
    "chunk_params": "WITH n AS (SELECT doc_id, strlen(text) AS b FROM documents) SELECT doc_id, b AS n_bytes, CASE WHEN b < 10000 THEN 10000 WHEN b < 50000 THEN 5000 WHEN b < 200000 THEN 2500 ELSE 500 END AS chunk_size, CASE WHEN b < 10000 THEN 0 WHEN b < 50000 THEN 500 WHEN b < 200000 THEN 250 ELSE 100 END AS chunk_overlap FROM n",
    "preview": "SELECT doc_id, left(text, 100) || CASE WHEN len(text) > 100 THEN '...' ELSE '' END AS preview FROM documents",
    "file_dispatch": f"WITH {_DOCS}, n AS (SELECT doc_id, n_bytes, path || CASE WHEN doc_id % 5 = 0 THEN '.Pdf' ELSE '' END AS path FROM docs) SELECT doc_id, CASE WHEN path ILIKE '%.pdf' THEN 'pdf' ELSE 'text' END AS kind, regexp_extract(path, '[^/]*$') AS document, n_bytes FROM n",
    "sections": f"WITH {_SECTIONS} SELECT doc_id, section_ord, title, text, level FROM sections",
    "section_levels": f"WITH {_SECTIONS} SELECT level, count(*) AS n_sections, count(DISTINCT doc_id) AS n_docs FROM sections GROUP BY level",
    "intro_sections": f"WITH {_SECTIONS} SELECT doc_id, title, text FROM sections WHERE title IN ('Introduction/Header', 'Document')",
    "chunk_pack": f"WITH {_SECTIONS}, {_chunks('sections', '500', '0', ', document_type')} SELECT * FROM chunks",
    "chunk_pack_overlap": f"WITH {_CHUNKS} SELECT * FROM chunks",
    "chunk_lines_overlap": "WITH rows AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text, 'Document' AS title, 0 AS level, 0 AS section_ord FROM documents), " + _chunks("rows", "2500", "250", "") + " SELECT doc_id, chunk_index, position, text FROM chunks",
    "chunk_tiers": f"WITH {_SECTIONS}, sized AS (SELECT *, CASE WHEN n_bytes * 20 < 10000 THEN 10000 WHEN n_bytes * 20 < 50000 THEN 5000 WHEN n_bytes * 20 < 200000 THEN 2500 ELSE 500 END / 10 AS size, CASE WHEN n_bytes * 20 < 10000 THEN 0 WHEN n_bytes * 20 < 50000 THEN 500 WHEN n_bytes * 20 < 200000 THEN 250 ELSE 100 END AS overlap FROM sections), {_chunks('sized', 'size', 'overlap', '')} SELECT doc_id, chunk_index, position, len(text)::INTEGER AS n_chars FROM chunks",
    "json_findings": f"WITH {_JSON_FINDINGS} SELECT * EXCLUDE (tags), array_to_string(tags, '|') AS tags FROM json_found",
    "contradiction_pairs": f"WITH {_JSON_FINDINGS}, {_PAIRS} SELECT * EXCLUDE (tag), string_agg(tag, '|' ORDER BY tag) AS tags FROM met WHERE earlier_section <> later_section GROUP BY ALL",
    "stored_answers": f"WITH {_RESPONSES}, r AS (SELECT doc_id, chunk_index, should_analyze, left(response, 200) AS p FROM responses), k AS (SELECT DISTINCT p FROM r WHERE should_analyze AND doc_id % 2 = 0) SELECT doc_id, chunk_index, should_analyze, CASE WHEN should_analyze THEN length(r.p) || ' ' || left(r.p, 30) ELSE '' END AS response, should_analyze AND k.p IS NOT NULL AS kept FROM r LEFT JOIN k ON r.p = k.p",
    "pdf_pages": "SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS page, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL",
    "pdf_join": "WITH p AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS page, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) SELECT doc_id, coalesce(string_agg(CASE WHEN text <> '' THEN '[Page ' || page || '] ' || text || chr(10) || chr(10) END, '' ORDER BY page), '') AS text FROM p GROUP BY doc_id",
    "page_join": "SELECT conv_id AS doc_id, coalesce(string_agg(CASE WHEN text <> '' THEN '[Page ' || (turn + 1) || '] ' || text || chr(10) || chr(10) END, '' ORDER BY turn), '') AS text FROM conversations GROUP BY conv_id",
    "term_scan": f"WITH l AS (SELECT framework, term_type, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS term_ord FROM {_FILES(C.TERM_FILES)} f) SELECT framework, term_type, term_ord::BIGINT AS term_ord, {_strip('line')} AS term FROM l WHERE NOT starts_with(line, '#') AND {_strip('line')} <> ''",
    "term_score": f"WITH {_SCORES} SELECT doc_id, chunk_index, data_score, regulatory_score, total_score FROM routed",
    "route": f"WITH {_SCORES} SELECT doc_id, chunk_index, should_analyze FROM routed",
    "route_documents": f"WITH s AS (SELECT text, len(list_filter({_list(DEFAULT_DATA_TERMS)}, lambda t: contains(lower(text), t))) + len(list_filter({_list(DEFAULT_REGULATORY_TERMS)}, lambda t: contains(lower(text), t))) AS n FROM documents) SELECT n::INTEGER AS total_score, len(text) >= 100 AND (n >= 3 OR len(text) > 1500) AS should_analyze, count(*) AS n, min(len(text))::INTEGER AS shortest, max(len(text))::INTEGER AS longest FROM s GROUP BY 1, 2",
    "route_partition": f"WITH {_SCORES} SELECT doc_id, count(*) FILTER (should_analyze) AS analyzed, count(*) FILTER (NOT should_analyze) AS skipped, bool_or(should_analyze) AS any_analyzed FROM routed GROUP BY doc_id",
    "skip_union": f"WITH {_SCORES} SELECT doc_id, chunk_index, position, should_analyze, CASE WHEN should_analyze THEN 1 ELSE 0 END AS n_issues FROM routed",
    "batching": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, (chunk_index // 4 + 1)::INTEGER AS batch_no, ((count(*) OVER (PARTITION BY doc_id) + 3) // 4)::INTEGER AS n_batches FROM chunks",
    "term_join": f"WITH {_CHUNKS}, {_TERMS} SELECT doc_id, chunk_index, term_type, count(*) AS score FROM chunks JOIN terms ON contains(lower(text), term) GROUP BY ALL",
    "pattern_parse": f"WITH {_PATTERNS_OF(_FILES(C.PATTERN_FILES))} SELECT framework, pattern_ord, pattern, description, array_to_string(indicators, '|') AS indicators, array_to_string(related_refs, '|') AS related_refs FROM patterns",
    "pattern_count": f"SELECT framework, len(regexp_extract_all(text, 'Pattern:'))::BIGINT AS n_patterns FROM {_FILES(C.PATTERN_FILES)} f",
    "article_parse": f"WITH {_ARTICLES_OF(_FILES(C.ARTICLE_FILES))} SELECT framework, art_ord, id, title, text FROM articles",
    "concept_tag": f"WITH {_DOCS} SELECT doc_id, array_to_string({_CONCEPTS_OF('text')}, '|') AS concepts FROM docs",
    "concept_bag": f"WITH {_ARTICLES_OF(_FILES(C.ARTICLE_FILES))} SELECT framework, art_ord, array_to_string(related_concepts, '|') AS related_concepts FROM articles",
    "indicator_scan": f"WITH {_CHUNKS}, {_PATTERNS}, {_scan('chunks', 'doc_id, chunk_index')} SELECT doc_id, chunk_index, pattern_ord, indicator_ord, pattern, description, indicator, context, array_to_string(related_refs, '|') AS related_refs FROM found",
    "top5_violations": f"WITH {_DOCS}, {_PATTERNS}, {_scan('docs', 'doc_id')}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pattern_ord, indicator_ord)::INTEGER AS rank FROM found) SELECT doc_id, rank, pattern_ord, indicator_ord, indicator FROM r WHERE rank <= 5",
    "benchmark_needles": f"WITH inds AS (SELECT item_id AS pattern_ord, 0 AS indicator_ord, '' AS pattern, '' AS description, text AS indicator, [] AS related_refs FROM benchmark), {_scan('documents', 'doc_id')} SELECT doc_id, pattern_ord, context FROM found",
    "knn_top3": f"WITH {_KNN} SELECT vec_id, rank, art_ord, distance FROM ranked WHERE rank <= 3",
    "knn_top5": f"WITH {_KNN} SELECT vec_id, rank, art_ord, distance FROM ranked WHERE rank <= 5",
    "knn_join_meta": f"WITH {_KNN} SELECT vec_id, rank, 'Article ' || art_ord AS id, '' AS title, 'data' AS related_concepts FROM ranked WHERE rank <= 5",
    "doc_meta_join": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, document_type FROM chunks",
    "model_lookup": f"WITH w AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'large' WHEN 1 THEN 'medium' ELSE lower(c_mktsegment) END AS asked FROM customer) SELECT c_custkey, key, name, batch_size, context_window, temperature FROM w JOIN {_MODELS} ON m.key = CASE WHEN asked IN ('small', 'medium', 'large') THEN asked ELSE 'small' END",
    "models": f"WITH a AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'large' WHEN 1 THEN 'medium' ELSE lower(c_mktsegment) END AS key, count(*) AS n FROM customer GROUP BY 1) SELECT m.*, coalesce(n, 0) AS n_customers FROM {_MODELS} LEFT JOIN a ON a.key = m.key",
    "framework_files": f"WITH e AS (SELECT n_nationkey, n_name AS id, unnest({_list(FRAMEWORK_FILES)}) AS file FROM nation) SELECT id, file FROM e WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = e.n_nationkey AND c.c_custkey % 3 = 0 AND {_list(FRAMEWORK_FILES)}[c.c_custkey % {len(FRAMEWORK_FILES)} + 1] = e.file)",
    "regulation_norm": f"WITH {_FINDINGS} SELECT doc_id, chunk_index, {_norm_reg('regulation')} AS norm, {_norm_reg('regulation', False)} AS norm_plain FROM findings",
    "text_norm": f"WITH {_FINDINGS} SELECT doc_id, chunk_index, {_norm_text('description')} AS norm FROM findings",
    "dedup_key": f"WITH {_FINDINGS} SELECT doc_id, chunk_index, {_KEY} AS key FROM findings",
    "extract_quote": f"WITH {_RESPONSES} SELECT doc_id, chunk_index, regexp_extract(response, '\"([^\"]+)\"', 0) AS quote FROM responses",
    "extract_regulation": f"WITH {_FINDINGS} SELECT doc_id, chunk_index, {_reference('description')} AS regulation FROM findings",
    "citation_cleanup": f"WITH {_FINDINGS}, c AS (SELECT doc_id, chunk_index, CASE chunk_index % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'bare words' ELSE citation END AS c FROM findings) SELECT doc_id, chunk_index, CASE WHEN trim(c) IN ('None', '') THEN 'No specific quote provided.' WHEN starts_with(c, '\"') OR ends_with(c, '\"') THEN c ELSE '\"' || c || '\"' END AS shown FROM c",
    "format_article": f"WITH {_FINDINGS}, a AS (SELECT doc_id, chunk_index, CASE chunk_index % 6 WHEN 0 THEN '12' WHEN 1 THEN 'Art. 9(2)(a)' WHEN 2 THEN 'voice' ELSE regulation END AS a FROM findings) SELECT doc_id, chunk_index, {_article('a')} AS article FROM a",
    "doc_citation_pred": f"WITH {_FINDINGS}, c AS (SELECT doc_id, chunk_index, CASE WHEN chunk_index % 2 = 0 THEN description ELSE citation END AS c FROM findings) SELECT doc_id, chunk_index, {_citation('c')} AS is_document FROM c",
    "strip_asterisks": f"WITH {_FINDINGS} SELECT doc_id, chunk_index, replace('**' || regulation || '** *x*', '*', '') AS clean FROM findings",
    "fence_strip": f"WITH {_RESPONSES} SELECT doc_id, chunk_index, {_CLEAN} AS clean FROM responses",
    "no_issue_marker": f"WITH {_RESPONSES} SELECT doc_id, chunk_index, ({_block('issue')}) = '' AS no_issues, ({_block('point')}) = '' AS no_points FROM responses".replace(_CLEAN, "response"),
    "parse_issues": _parsed("issue"),
    "parse_points": _parsed("point"),
    "direct_blocks": f"WITH {_SPLIT} SELECT doc_id, issues, points FROM halves",
    "dedup_issues": _MERGED + f"SELECT {_MERGED_COLUMNS} FROM merged WHERE kind = 'issue'",
    "dedup_points": _MERGED + f"SELECT {_MERGED_COLUMNS} FROM merged WHERE kind = 'point'",
    "section_union": _MERGED + "SELECT doc_id, kind, key, array_to_string(sections, '|') AS sections FROM merged",
    "section_display": _MERGED + f"SELECT doc_id, kind, key, {_SHOWN} AS shown FROM merged",
    "dedup_counts": _MERGED + "SELECT r.*, coalesce(final_issues, 0) AS final_issues, coalesce(final_points, 0) AS final_points FROM (SELECT doc_id, count(*) FILTER (kind = 'issue') AS original_issues, count(*) FILTER (kind = 'point') AS original_points FROM findings GROUP BY 1) r LEFT JOIN (SELECT doc_id, count(*) FILTER (kind = 'issue') AS final_issues, count(*) FILTER (kind = 'point') AS final_points FROM merged GROUP BY 1) USING (doc_id)",
    "confidence_breakdown": _MERGED + "SELECT doc_id, kind, count(*) AS total, count(*) FILTER (upper(confidence) = 'HIGH') AS high, count(*) FILTER (upper(confidence) = 'MEDIUM') AS medium, count(*) FILTER (upper(confidence) = 'LOW') AS low, count(*) FILTER (should_analyze) AS analyzed, count(*) FILTER (NOT should_analyze) AS skipped FROM merged GROUP BY ALL",
    "finding_rollups": _MERGED + "SELECT doc_id, CASE WHEN GROUPING(confidence) = 0 THEN 'confidence' WHEN GROUPING(regulation) = 0 THEN 'regulation' WHEN GROUPING(kind) = 0 THEN 'kind' ELSE 'document' END AS of, kind, confidence, regulation, count(*) AS n_findings, count(*) FILTER (should_analyze) AS n_analyzed FROM (SELECT * REPLACE (upper(confidence) AS confidence) FROM merged) m GROUP BY GROUPING SETS ((doc_id), (doc_id, kind), (doc_id, kind, confidence), (doc_id, kind, regulation))",
    "by_regulation": _MERGED + "SELECT doc_id, kind, regulation, count(*) AS n_findings, min(place) AS first_position FROM placed GROUP BY ALL",
    "by_regulation_issue": _MERGED + ", each AS (SELECT doc_id, kind, regulation, description, place, unnest(sections) AS section, generate_subscripts(sections, 1) AS spot FROM placed), once AS (SELECT doc_id, kind, regulation, description, section, min(place * 1000 + spot) AS spot FROM each GROUP BY ALL), u AS (SELECT doc_id, kind, regulation, description, string_agg(section, '|' ORDER BY spot) AS sections FROM once GROUP BY ALL), f AS (SELECT doc_id, kind, regulation, description, arg_min(confidence, place) AS confidence, arg_min(should_analyze, place) AS should_analyze, min(place) AS first_position FROM placed GROUP BY ALL) SELECT * FROM u JOIN f USING (doc_id, kind, regulation, description)",
    "sorted_findings": _MERGED + "SELECT doc_id, kind, place AS position, key FROM placed",
    "summary_sentence": _MERGED + "SELECT doc_id, 'The document contains ' || count(*) FILTER (kind = 'issue') || ' potential compliance issue(s) and ' || count(*) FILTER (kind = 'point') || ' compliance point(s) related to demo.' AS summary FROM merged GROUP BY doc_id",
    "detected_patterns": f"WITH {_FINDINGS}, p AS (SELECT doc_id, chunk_index, unnest([kind, 'a']) AS pattern, unnest([regulation, 'b: ' || section]) AS indicator FROM findings) SELECT *, '...' || indicator || '...' AS context FROM p",
    "finding_defaults": f"WITH {_FINDINGS}, {_RESPONSES} SELECT f.doc_id, f.chunk_index, CASE WHEN f.chunk_index % 2 = 0 THEN section ELSE position END AS section, response AS text, CASE WHEN f.chunk_index % 3 = 0 THEN false ELSE r.should_analyze END AS should_analyze FROM findings f JOIN responses r USING (doc_id, chunk_index)",
    "first_issues": f"WITH {_FINDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY chunk_index)::INTEGER AS place FROM findings) SELECT doc_id, kind, place, chunk_index AS ord, description FROM r WHERE place <= 3",
    "labels_breakdown": "SELECT quality, count(*) AS n, count(*) FILTER (toxic = 1) AS toxic FROM labels GROUP BY quality",
    "format_regulations": f"WITH {_ARTICLES_OF(_FILES(C.ARTICLE_FILES))} SELECT framework, 'VIOLATION PATTERNS: 4 patterns available' || string_agg(chr(10) || chr(10) || 'REGULATION ' || (art_ord + 1) || ': ' || id || CASE WHEN title <> '' THEN ' - ' || title ELSE '' END || CASE WHEN len(related_concepts) > 0 THEN chr(10) || 'RELATED CONCEPTS: ' || array_to_string(related_concepts, ', ') ELSE '' END || chr(10) || text, '' ORDER BY art_ord) AS regulations FROM articles WHERE art_ord < 5 GROUP BY framework",
    "structured_parse": _STRUCTURED_ITEMS,
    "simple_items": _SIMPLE_ITEMS,
    "restructure": f"WITH f AS ({_STRUCTURED_ITEMS.replace('SELECT doc_id, ' + _strip('f1'), 'SELECT doc_id, ord, ' + _strip('f1'))}), l AS ({_SIMPLE_ITEMS}) SELECT doc_id, 'issue' AS kind, ord, title AS description, regulation, confidence, coalesce(citation, '') AS citation, explanation FROM f UNION ALL SELECT doc_id, kind, item_ord - 1, title, regulation, confidence, coalesce(citation, ''), explanation FROM l WHERE NOT (kind = 'issue' AND doc_id IN (SELECT doc_id FROM f))",
    "prompt_build": _PROMPTS.replace("@", _prompt("high")) + " SELECT doc_id, chunk_index, prompt FROM p",
    "prompt_hooks": _HOOKS,
    "model_audit": _MODEL_AUDIT,
    "canned_judge": _CANNED,
    "report_lines": _REPORT,
    "report_json": _JSON,
    "rule_findings": _RULES + " SELECT doc_id, chunk_index, ord, description, regulation, citation, section FROM rules",
    "audit_summary": _RULES + f", {_dedup('rules')} SELECT doc_id, regulation, count(*) AS n_issues, count(*) FILTER (upper(confidence) = 'HIGH') AS high, count(*) FILTER (upper(confidence) = 'MEDIUM') AS medium, count(*) FILTER (upper(confidence) = 'LOW') AS low, sum(len(sections))::BIGINT AS n_sections FROM merged GROUP BY ALL",
}
