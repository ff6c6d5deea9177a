"""SQL for DuckDB that gives the same rows as the queries of the same names, written on its own.

Left out is what SQL can't express (a network with drawn or learned weights); the tests hold that against plain arrays.
"""

from __future__ import annotations

from storyloom.operators.align import CONTRADICTIONS
from storyloom.operators.annotate import LEMMAS, STATES
from storyloom.operators.consolidate import EDGE_TYPES
from storyloom.operators.segments import DAYS
from storyloom.functions.text import NEGATIVE, SEPARATORS, TAGS
from storyloom.functions.timex import DURATIONS, HOURS, SIGNAL_PATTERN, SIGNALS, TIMEX_PATTERNS
from storyloom.plans import fixtures as fx

W = r"[\p{L}\p{N}_]+"


def _lit(v: object) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows)


def _list(words) -> str:
    return "[" + ", ".join(map(_lit, words)) + "]"


def words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{W}')"


def entities(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all({c}, '{W}'), lambda w: regexp_full_match(w, '[A-Z][a-z]+')))"


def spaced(c: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda w: w <> ''))"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def sentences(c: str, least: int = 1) -> str:
    cut = rf"string_split(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {strip('s')}), lambda s: length(s) >= {least})"


def polarity(c: str) -> str:
    return f"CASE WHEN list_has_any({words(c)}, {_list(NEGATIVE)}) THEN 'NEG' ELSE 'POS' END"


def bucket(w: str, width: int = 300) -> str:
    part = lambda i: f"CAST(concat('0x', substr(md5({w}), {8 * i + 1}, 8)) AS BIGINT)"
    out = f"({part(0)} % {width})"
    for i in (1, 2, 3):
        out = f"(({out} * 4294967296 + {part(i)}) % {width})"
    return out


def slice_part(t: str, part: str) -> str:
    n = f"length({t}) // 2"
    return f"CASE WHEN {part} IS NULL OR length({t}) < 20 THEN {t} WHEN {part} = 'a' THEN {strip(f'left({t}, CAST({n} AS BIGINT))')} ELSE {strip(f'substr({t}, CAST({n} AS BIGINT) + 1)')} END"


# Verses of turns; the fixture's verses; both; events
TURNS = """turns AS (
  SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS verse_idx, text FROM conversations),
verses AS (SELECT doc_id, verse_idx, CAST(verse_idx // 10 + 1 AS INT) AS chapter, CAST(verse_idx % 10 + 1 AS INT) AS verse, text FROM turns)"""
FIXED = f"fixed(doc_id, verse_idx, chapter, verse, text) AS ({_values(fx.VERSES)})"
ALL = f"{TURNS}, {FIXED}, whole AS (SELECT * FROM verses UNION ALL SELECT * FROM fixed)"


def events(of: str) -> str:
    return f"""events AS (
  SELECT doc_id || '_e' || verse_idx AS id, doc_id, verse_idx AS seq, {strip('text')} AS text, verse_idx, chapter, verse, chapter || ':' || verse AS verse_ref,
    'OCCURRENCE' AS event_class, 'PAST' AS tense, 'PERFECTIVE' AS aspect, {polarity('text')} AS polarity FROM {of})"""


_CLASS = "CASE " + " ".join(f"WHEN list_has_any(w, {_list(v)}) THEN '{k}'" for k, v in LEMMAS.items()) + f" WHEN list_has_any(w, {_list(STATES)}) THEN 'STATE' ELSE 'OCCURRENCE' END"


def lexicon(of: str) -> str:
    """Events by sentence. The first of equal sentences of a verse counts."""
    return f"""cut AS (
  SELECT doc_id, verse_idx, chapter, verse, unnest(s) AS t, generate_subscripts(s, 1) AS p FROM (SELECT *, {sentences('text')} AS s FROM {of})),
firsts AS (SELECT doc_id, verse_idx, chapter, verse, t, min(p) AS p FROM cut GROUP BY ALL),
levents AS (
  SELECT doc_id || '_e' || n AS id, doc_id, n AS seq, t AS text, verse_idx, {_CLASS} AS event_class, {polarity('t')} AS polarity
  FROM (SELECT *, {words('t')} AS w, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY verse_idx, p) - 1 AS INT) AS n FROM firsts))"""


def marks(pattern: str, of: str, name: str, tail: str = "") -> str:
    """Matches with their places, by cutting at a sentinel that is put around each match; `tail` may not belong to a word."""
    return rf"""{name} AS (
  SELECT doc_id, verse_idx, part AS text, CAST(pos - length(part) AS INT) AS start_char, CAST(pos AS INT) AS end_char FROM (
    SELECT doc_id, verse_idx, i, part, sum(length(part)) OVER (PARTITION BY doc_id, verse_idx ORDER BY i) AS pos FROM (
      SELECT doc_id, verse_idx, unnest(s) AS part, generate_subscripts(s, 1) AS i FROM (
        SELECT doc_id, verse_idx, string_split(regexp_replace(text, '{pattern}', chr(1) || '\0' || chr(1), 'gi'), chr(1)) AS s FROM {of})))
  WHERE i % 2 = 0)"""


# RE2 knows word boundaries in ASCII only: the neighbours of a signal are checked below
SIGNAL = (
    marks(SIGNAL_PATTERN, "whole", "smarks")
    + r""",
signals AS (
  SELECT doc_id || '_s' || seq AS id, * FROM (
    SELECT m.doc_id, CAST(row_number() OVER (PARTITION BY m.doc_id ORDER BY m.verse_idx, m.start_char) - 1 AS INT) AS seq, m.text, m.verse_idx, m.start_char, m.end_char
    FROM smarks m JOIN whole v ON m.doc_id = v.doc_id AND m.verse_idx = v.verse_idx
    WHERE (m.start_char = 0 OR NOT regexp_matches(substr(v.text, m.start_char, 1), '[\p{L}\p{N}_]')) AND NOT regexp_matches(substr(v.text, m.end_char + 1, 1), '[\p{L}\p{N}_]')))"""
)


def normal(t: str) -> str:
    t = f"lower({strip(t)})"
    rules = [f"WHEN contains({t}, '{k}') THEN '{v}'" for k, v in DURATIONS.items()]
    rules += [f"WHEN contains({t}, '{k}') AND contains({t}, 'hour') THEN '{v}'" for k, v in HOURS.items()]
    rules += [f"WHEN contains({t}, 'third day') THEN '+P3D' WHEN contains({t}, 'next day') OR contains({t}, 'following day') THEN '+P1D' WHEN contains({t}, 'sabbath') THEN 'XXXX-WXX-6'"]
    return "CASE " + " ".join(rules) + " END"


_MEETS = "a.doc_id = {x}.doc_id AND a.verse_idx = {x}.verse_idx AND a.start_char < {x}.end_char AND {x}.start_char < a.end_char"
TIMES = (
    ", ".join(marks(p, "whole", f"t{i}") for i, (p, _) in enumerate(TIMEX_PATTERNS))
    + f", k0 AS (SELECT *, 0 AS p, '{TIMEX_PATTERNS[0][1]}' AS kind FROM t0)"
    + "".join(
        f", k{i} AS (SELECT * FROM k{i - 1} UNION ALL SELECT x.*, {i}, '{kind}' FROM t{i} x WHERE NOT EXISTS (SELECT 1 FROM k{i - 1} a WHERE {_MEETS.format(x='x')}))"
        for i, (_, kind) in list(enumerate(TIMEX_PATTERNS))[1:]
    )
    + f""",
times AS (
  SELECT doc_id || '_t' || seq AS id, doc_id, seq, text, verse_idx, kind AS timex3_type, {normal('text')} AS value, start_char, end_char
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY verse_idx, p, start_char) - 1 AS INT) AS seq FROM k3))"""
)
TOLD = f"told AS (SELECT s.*, r.rel AS rel_type FROM signals s JOIN ({_values(list(SIGNALS.items()))}) r(word, rel) ON lower(s.text) = r.word)"
NARRATIVE = """narr AS (
  SELECT doc_id, seq, id AS event_id, lead(id) OVER (PARTITION BY doc_id ORDER BY seq) AS related_to_event, 'BEFORE' AS rel_type, 'narrative_order' AS source FROM events)"""


def ends(of: str) -> str:
    return f"ends AS (SELECT doc_id, verse_idx, count(*) AS n, min_by(id, seq) AS event_id, max_by(id, seq) AS related_to_event FROM {of} GROUP BY 1, 2)"


LINKS = f"""{ends('events')}, {TOLD}, {NARRATIVE},
parts AS (
  SELECT doc_id, 0 AS rule, seq, 0 AS seq2, rel_type, event_id, related_to_event, NULL AS related_to_time, NULL AS signal_id, source FROM narr WHERE related_to_event IS NOT NULL
  UNION ALL SELECT t.doc_id, 1, t.seq, 0, t.rel_type, e.event_id, e.related_to_event, NULL, t.id, 'signal' FROM told t JOIN ends e USING (doc_id, verse_idx) WHERE e.n >= 2
  UNION ALL SELECT e.doc_id, 2, t.seq, e.seq, 'IS_INCLUDED', e.id, NULL, t.id, NULL, 'temporal_anchor' FROM events e JOIN times t USING (doc_id, verse_idx)),
tlinks AS (
  SELECT doc_id || '_tl' || (row_number() OVER (PARTITION BY doc_id ORDER BY rule, seq, seq2) - 1) AS id, doc_id, rel_type, event_id, related_to_event, related_to_time, signal_id, source FROM parts)"""
SUBORDINATE = """nexts AS (
  SELECT *, lead(id) OVER w AS nid, lead(verse_idx) OVER w AS nverse FROM {of} WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
kinds AS (
  SELECT *, CASE WHEN event_class = 'REPORTING' THEN 'EVIDENTIAL' WHEN event_class = 'I_ACTION' THEN 'MODAL'
    WHEN polarity = 'NEG' AND event_class IN ('I_STATE', 'PERCEPTION') THEN 'COUNTER_FACTIVE' END AS rel_type FROM nexts WHERE nverse = verse_idx),
slinks AS (
  SELECT doc_id || '_sl' || (row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1) AS id, doc_id, rel_type, id AS event_id, nid AS subordinated_event FROM kinds WHERE rel_type IS NOT NULL)"""
NEIGHBOURS = "near AS (SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL)"
CENTRE = """cells AS (SELECT label, vec_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
centre AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM cells GROUP BY 1, 2) GROUP BY 1),
rel AS (SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::double[], c.c), 6) AS relevance FROM embeddings e JOIN centre c USING (label))"""

# A role is a document, a conversation a chapter
ROLES = f"""rverses AS (
  SELECT role AS doc_id, CAST(row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS INT) AS verse_idx, CAST(conv_id + 1 AS INT) AS chapter, CAST(turn + 1 AS INT) AS verse, text FROM conversations),
{events('rverses')}"""


def match(prox: str) -> str:
    """Best matches among roles, where prox gives the proximity of doc_a and doc_b."""
    return f"""{ROLES},
bag AS (SELECT id, doc_id, b, count(*) AS c FROM (SELECT id, doc_id, {bucket('w')} AS b FROM (SELECT id, doc_id, unnest({words('text')}) AS w FROM events)) GROUP BY 1, 2, 3),
sq AS (SELECT id, sum(c * c)::bigint AS n FROM bag GROUP BY 1),
dots AS (SELECT x.doc_id AS doc_a, x.id AS ev_a, y.doc_id AS doc_b, y.id AS ev_b, sum(x.c * y.c)::bigint AS d FROM bag x JOIN bag y ON x.b = y.b AND x.doc_id < y.doc_id GROUP BY 1, 2, 3, 4),
ents AS (SELECT id, seq, {entities('text')} AS e FROM events),
scored AS (
  SELECT doc_a, ev_a, doc_b, ev_b, eb.seq, round(0.45::double * (d / sqrt((na.n * nb.n)::double)) + 0.3::double * ({overlap('ea.e', 'eb.e')})::double + 0.25::double * ({prox})::double, 9) AS score
  FROM dots JOIN sq na ON na.id = ev_a JOIN sq nb ON nb.id = ev_b JOIN ents ea ON ea.id = ev_a JOIN ents eb ON eb.id = ev_b),
best AS (
  SELECT doc_a, ev_a, doc_b, ev_b, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_a, ev_a, doc_b ORDER BY score DESC, seq) AS r FROM scored WHERE score > 0.35) WHERE r = 1),
groups AS (
  SELECT 'align_' || (row_number() OVER (ORDER BY doc_a, doc_b, e.seq) - 1) AS group_id, b.* FROM best b JOIN events e ON e.id = b.ev_a)"""


MATCH = match("0.5")
#: The timetable knows two roles: they are near if some conversation has both
_NEAR = "CASE WHEN doc_a IN ('assistant', 'user') AND doc_b IN ('assistant', 'user') AND (SELECT count(*) FROM (SELECT conv_id FROM conversations WHERE role IN ('assistant', 'user') GROUP BY 1 HAVING count(DISTINCT role) = 2)) > 0 THEN 1 ELSE 0.5 END"
_DAYLIST = _list(fx.DAY_CYCLE)
TABLE = f"""talk AS (SELECT conv_id, max(turn) AS last, list(DISTINCT role) AS who FROM conversations GROUP BY 1),
tt AS (SELECT CAST(conv_id AS INT) AS k, 'Conversation ' || conv_id AS description, {_DAYLIST}[CAST(conv_id % {len(fx.DAY_CYCLE)} AS INT) + 1] AS day FROM talk)"""
MACRO = f"""{ROLES}, {TABLE},
order_of(doc_id, o) AS (VALUES ('user', 0), ('assistant', 1), ('system', 2)),
acc AS (
  SELECT chapter - 1 AS k, doc_id, o, string_agg(id, '|' ORDER BY verse) AS ids, string_agg(text, ' ' ORDER BY verse) FILTER (text <> '') AS text
  FROM events JOIN order_of USING (doc_id) GROUP BY 1, 2, 3),
macro AS (
  SELECT 'macro_' || k AS id, string_agg(text, ' <doc-sep> ' ORDER BY o) AS text, any_value(description) AS description, string_agg(ids, '|' ORDER BY o) AS original_events, k AS chronology_index,
    CAST(count(text) AS INT) AS num_source_texts, string_agg(doc_id, '|' ORDER BY o) AS source_docs, any_value(day) AS day, arg_max(doc_id, [length(text), -o]) AS chosen_doc
  FROM acc JOIN tt USING (k) WHERE text IS NOT NULL GROUP BY k)"""
_STEMS = ", ".join(f"CASE WHEN starts_with(lower(day_key), {_lit(d.lower().split(' (')[0])}) THEN {i} END" for i, d in enumerate(DAYS))
TIMELINE = """line AS (
  SELECT event_id, lead(event_id) OVER w AS n, event_type, CASE WHEN value <= lead(value) OVER w THEN 'BEFORE' ELSE 'AFTER' END AS rel
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
pred AS (SELECT event_id, n, 'BEFORE' AS rel, CASE WHEN event_type = 'purchase' THEN 'signal' ELSE 'narrative_order' END AS source FROM line WHERE n IS NOT NULL),
gold AS (SELECT event_id, n, rel FROM line WHERE n IS NOT NULL AND event_type <> 'error')"""
TALKS = """talks AS (
  SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '') AS output, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '') AS reference
  FROM conversations GROUP BY 1)"""


def grams(c: str, n: int) -> str:
    return f"list_transform(range(1, len(w_{c}) - {n} + 2), lambda i: array_to_string(w_{c}[i:i + {n} - 1], ' '))"


def rouge(n: int) -> str:
    return f"""WITH {TALKS}, toks AS (SELECT conv_id, {words('output')} AS w_output, {words('reference')} AS w_reference FROM talks),
o AS (SELECT conv_id, g, count(*) AS c FROM (SELECT conv_id, unnest({grams('output', n)}) AS g FROM toks) GROUP BY 1, 2),
r AS (SELECT conv_id, g, count(*) AS c FROM (SELECT conv_id, unnest({grams('reference', n)}) AS g FROM toks) GROUP BY 1, 2),
h AS (SELECT conv_id, sum(least(o.c, r.c))::bigint AS hits FROM o JOIN r USING (conv_id, g) GROUP BY 1),
s AS (SELECT conv_id, coalesce(hits, 0) AS hits, greatest(len(w_output) - {n - 1}, 0) AS n_out, greatest(len(w_reference) - {n - 1}, 0) AS n_ref FROM toks LEFT JOIN h USING (conv_id)),
f AS (SELECT *, CASE WHEN n_out > 0 THEN hits / n_out::double ELSE 0 END AS precision, CASE WHEN n_ref > 0 THEN hits / n_ref::double ELSE 0 END AS recall FROM s)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM f"""


RING = """ring AS (
  SELECT vec_id AS dst_no, unnest([lead(vec_id, 1) OVER w, lead(vec_id, 2) OVER w]) AS src_no, unnest([0, 1]) AS type_no FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
edges AS (SELECT CAST(src_no AS INT) AS src_no, CAST(dst_no AS INT) AS dst_no, type_no FROM ring WHERE src_no IS NOT NULL)"""


def softmax(score: str) -> str:
    return f"""s AS (SELECT *, {score} AS score FROM edges),
t AS (SELECT *, exp(score - greatest(max(score) OVER (PARTITION BY dst_no), 0)) AS e FROM s),
w AS (SELECT *, e / (sum(e) OVER (PARTITION BY dst_no) + 1e-12::double) AS weight FROM t)"""


def clean_final(c: str) -> str:
    steps = [(r"<[^>]*>", " "), (r"[.]{2,}", "."), (r"[,]{2,}", ",")]
    for a, b in steps:
        c = f"regexp_replace({c}, '{a}', '{b}', 'g')"
    c = rf"regexp_replace({c}, '(^|[^\p{{L}}\p{{N}}_])[a-zA-Z](?:\s[a-zA-Z])+([^\p{{L}}\p{{N}}_]|$)', '\1 \2', 'g')"
    c = rf"regexp_replace({c}, '\s+', ' ', 'g')"
    c = f"regexp_replace({c}, '[“”]', '\"', 'g')"
    c = f"regexp_replace({c}, '[‘’]', '''', 'g')"
    return strip(rf"regexp_replace({c}, '([.!?])\s*([a-z])', '\1 \2', 'g')")


def clean_separators(c: str) -> str:
    for p in SEPARATORS:
        c = f"regexp_replace({c}, '{p}', ' <doc-sep> ', 'gi')"
    c = f"regexp_replace({c}, '{TAGS}', ' ', 'gi')"
    return strip(rf"regexp_replace({c}, '\s+', ' ', 'g')")


_CROSS, _ONE, _WITHIN = r"^(\d+):(\d+)([ab]?)-(\d+):(\d+)([ab]?)$", r"^\s*(\d+)\s*:(\d+)([ab]?)$", r"^\s*(\d+)\s*:\s*(\d+)([ab]?)\s*-\s*(\d+)([ab]?)\s*$"


def _groups(p: str, gs: tuple[int, ...]) -> str:
    g = [f"nullif(regexp_extract(t, '{p}', {i}), '')" for i in gs]
    return ", ".join([*(f"CAST({x} AS INT) AS {n}" for x, n in zip(g[:4], ("sc", "sv", "ec", "ev"), strict=True)), f"{g[4]} AS sp", f"{g[5]} AS ep"])


def parsed(keys: str = "ref") -> str:
    """A CTE `parsed` of the references t in a table r, with its columns `keys`."""
    forms = ((_CROSS, (1, 2, 4, 5, 3, 6)), (_ONE, (1, 2, 1, 2, 3, 3)), (_WITHIN, (1, 2, 1, 4, 3, 5)))
    parts = [f"SELECT {keys}, {_groups(p, g)} FROM r WHERE regexp_matches(t, '{p}')" for p, g in forms]
    none = " AND ".join(f"NOT regexp_matches(t, '{p}')" for p, _ in forms)
    return "parsed AS (" + " UNION ALL ".join([*parts, f"SELECT {keys}, NULL, NULL, NULL, NULL, NULL, NULL FROM r WHERE {none}"]) + ")"


def ranges(keys: str) -> str:
    """The ranges within chapters that the references of `parsed` cover."""
    return f"""
  SELECT {keys}, 0 AS range_no, sc AS chapter, sv AS v_start, CASE WHEN sc = ec THEN ev ELSE 999 END AS v_end FROM parsed WHERE ec <= sc + 3
  UNION ALL SELECT {keys}, CAST(c - sc AS INT), CAST(c AS INT), 1, 999 FROM (SELECT *, unnest(range(sc + 1, ec)) AS c FROM parsed WHERE ec <= sc + 3)
  UNION ALL SELECT {keys}, greatest(ec - sc, 1), ec, 1, ev FROM parsed WHERE ec <= sc + 3 AND sc <> ec"""


REFS = f"refs(ref) AS ({_values([(r,) for r in fx.REFERENCES])})"
PARSED = f"{REFS}, r AS (SELECT ref, {strip('ref')} AS t FROM refs), {parsed()}"
_FIXKEYS = "k, doc_id, o, sc, sv, ec, ev, sp, ep"
#: The fixture's timetable, joined with the fixture's verses
FIXMACRO = f"""{FIXED}, {events('fixed')},
tt(k, name, day, matthew, mark, luke) AS ({_values(fx.TIMETABLE)}),
cells AS (SELECT k, unnest(['matthew', 'mark', 'luke']) AS doc_id, unnest([0, 1, 2]) AS o, unnest([matthew, mark, luke]) AS ref FROM tt),
r AS (SELECT k, doc_id, o, {strip('ref')} AS t FROM cells WHERE length({strip('ref')}) > 0),
{parsed('k, doc_id, o')},
x AS ({ranges(_FIXKEYS)}),
last AS (SELECT doc_id, chapter, max(verse) AS m FROM events GROUP BY 1, 2),
spans AS (SELECT x.*, CASE WHEN v_end = 999 THEN coalesce(m, v_start) ELSE v_end END AS e FROM x LEFT JOIN last USING (doc_id, chapter)),
cov AS (SELECT *, CAST(unnest(range(v_start, e + 1)) AS INT) AS verse FROM spans WHERE v_start <= e),
vt AS (SELECT doc_id, chapter, verse, arg_max({strip('text')}, verse_idx) AS text FROM fixed WHERE {strip('text')} <> '' GROUP BY 1, 2, 3),
halves AS (
  SELECT cov.*, text, CASE WHEN chapter = sc AND verse = sv THEN {slice_part('text', 'sp')} ELSE text END AS head, {slice_part('text', 'coalesce(sp, ep)')} AS alone FROM cov JOIN vt USING (doc_id, chapter, verse)),
told AS (
  SELECT k, doc_id, o, string_agg(t, ' ' ORDER BY range_no, verse) AS text FROM (
    SELECT *, {strip("CASE WHEN sc = ec AND sv = ev AND coalesce(sp, ep) IS NOT NULL THEN alone WHEN chapter = ec AND verse = ev THEN " + slice_part('head', 'ep') + " ELSE head END")} AS t FROM halves) WHERE t <> '' GROUP BY 1, 2, 3),
had AS (SELECT k, doc_id, o, string_agg(id, '|' ORDER BY range_no, cov.verse, seq) AS ids FROM cov JOIN events USING (doc_id, chapter, verse) GROUP BY 1, 2, 3),
acc AS (SELECT k, doc_id, o, coalesce(text, '') AS text, ids FROM told FULL JOIN had USING (k, doc_id, o))
SELECT 'macro_' || k AS id, string_agg(text, ' <doc-sep> ' ORDER BY o) FILTER (text <> '') AS text, any_value(name) AS description, string_agg(ids, '|' ORDER BY o) AS original_events, k AS chronology_index,
  CAST(count(*) FILTER (text <> '') AS INT) AS num_source_texts, string_agg(doc_id, '|' ORDER BY o) FILTER (text <> '') AS source_docs, arg_max(doc_id, [length(text), -o]) AS chosen_doc, any_value(day) AS day
FROM acc JOIN tt USING (k) GROUP BY k HAVING count(*) FILTER (text <> '') > 0"""
#: References with parts, over conversations
PARTED = f"""{ROLES},
last AS (SELECT doc_id, chapter, max(verse) AS m FROM rverses GROUP BY 1, 2), ks AS (SELECT DISTINCT CAST(conv_id AS INT) AS k FROM conversations),
x AS (
  SELECT k, 'user' AS doc_id, 0 AS no, k + 1 AS chapter, 1 AS v, coalesce(m, 1) AS e FROM ks LEFT JOIN last ON last.doc_id = 'user' AND last.chapter = k + 1
  UNION ALL SELECT k, 'user', 1, k + 2, 1, 2 FROM ks UNION ALL SELECT k, 'assistant', 0, k + 1, 2, 2 FROM ks),
cov AS (SELECT *, CAST(unnest(range(v, e + 1)) AS INT) AS verse FROM x),
parts AS (SELECT *, CASE WHEN doc_id = 'assistant' OR (no = 1 AND verse = 2) THEN 'a' WHEN no = 0 AND verse = 1 THEN 'b' END AS part FROM cov),
vt AS (SELECT doc_id, chapter, verse, {strip('text')} AS t FROM rverses WHERE {strip('text')} <> ''),
told AS (SELECT k, doc_id, string_agg(t, ' ' ORDER BY no, verse) AS text FROM (SELECT k, doc_id, no, verse, {strip(slice_part('t', 'part'))} AS t FROM parts JOIN vt USING (doc_id, chapter, verse)) WHERE t <> '' GROUP BY 1, 2),
had AS (SELECT k, doc_id, string_agg(id, '|' ORDER BY no, cov.verse, seq) AS event_ids FROM cov JOIN events USING (doc_id, chapter, verse) GROUP BY 1, 2)"""


def dedup_list(found: str, threshold: float, most: int | None = None) -> str:
    """A list of sentences without those that are like an earlier one that is kept."""
    full = f"len(acc) >= {most} OR" if most else ""
    like = f"({overlap(spaced('s'), spaced('k'))}) >= {threshold}"
    return f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({found}, lambda z: [z])), lambda acc, one: CASE WHEN {full} len(list_filter(acc, lambda k: list_contains(list_transform(one, lambda s: {like}), true))) > 0 THEN acc ELSE list_concat(acc, one) END)"


def dedup(c: str, threshold: float, most: int | None = None) -> str:
    return dedup_list(sentences(c), threshold, most)


def reduced(of: str, keys: str, name: str) -> str:
    """A CTE: the texts of a table (keys, text), rid of repetition and cleaned."""
    joined = f"SELECT {keys}, array_to_string({dedup('text', 0.65)}, ' ') AS t FROM {of}"
    return f"{name} AS (SELECT {keys}, {clean_final('t')} AS text FROM (SELECT {keys}, CASE WHEN t = '' OR ends_with(t, '.') THEN t ELSE t || '.' END AS t FROM ({joined})))"


def _picks(n: int) -> str:
    """CTEs of the choices by marginal relevance, one after the other."""
    out = ["c1 AS (SELECT id, i, 1 AS step FROM (SELECT id, i, row_number() OVER (PARTITION BY id ORDER BY round(0.7::double * rel, 9) DESC, i) AS r FROM relevance) WHERE r = 1), d1 AS (SELECT * FROM c1)"]
    for k in range(2, n + 1):
        near = f"(SELECT l.id, l.i, max(l.v) AS near FROM likeness l JOIN d{k - 1} d ON d.id = l.id AND d.i = l.j GROUP BY 1, 2)"
        out.append(f"""c{k} AS (SELECT id, i, {k} AS step FROM (
  SELECT x.id, x.i, row_number() OVER (PARTITION BY x.id ORDER BY round(0.7::double * rel - (1::double - 0.7::double) * coalesce(near, 0), 9) DESC, x.i) AS r
  FROM relevance x LEFT JOIN {near} y ON x.id = y.id AND x.i = y.i WHERE NOT EXISTS (SELECT 1 FROM d{k - 1} d WHERE d.id = x.id AND d.i = x.i)) WHERE r = 1),
d{k} AS (SELECT * FROM d{k - 1} UNION ALL SELECT * FROM c{k})""")
    return ",\n".join(out)


def extracted(of: str) -> str:
    """CTEs that end in `extract` (id, text): accounts of a table (id, text), merged by extraction."""
    return f"""cleaned AS (SELECT id, {clean_separators('text')} AS text FROM {of}),
pieces AS (SELECT id, text, list_filter(list_transform(string_split(text, '<doc-sep>'), lambda p: {strip('p')}), lambda p: p <> '') AS p FROM cleaned),
sents AS (SELECT id, {dedup_list("flatten(list_transform(p, lambda q: " + sentences('q', 11) + "))", 0.85, 201)} AS s FROM pieces WHERE len(p) > 1),
s AS (SELECT id, unnest(s) AS t, generate_subscripts(s, 1) AS i, len(s) AS n FROM sents),
xbag AS (SELECT id, i, b, count(*) AS c FROM (SELECT id, i, {bucket('w')} AS b FROM (SELECT id, i, unnest({words('t')}) AS w FROM s)) GROUP BY 1, 2, 3),
unit AS (SELECT id, i, b, c / sqrt((sum(c * c) OVER (PARTITION BY id, i))::double) AS u FROM xbag),
middle AS (SELECT unit.id, b, sum(u) / any_value(n) AS m FROM unit JOIN (SELECT id, any_value(n) AS n FROM s GROUP BY 1) z ON z.id = unit.id GROUP BY 1, 2),
width AS (SELECT id, sqrt(sum(m * m)) AS w FROM middle GROUP BY 1),
near AS (SELECT unit.id, i, sum(u * m) / any_value(w) AS v FROM unit JOIN middle ON middle.id = unit.id AND middle.b = unit.b JOIN width ON width.id = unit.id GROUP BY 1, 2),
relevance AS (SELECT s.id, s.i, round(coalesce(v, 0), 9) AS rel FROM s LEFT JOIN near ON near.id = s.id AND near.i = s.i),
likeness AS (SELECT x.id, x.i, y.i AS j, round(sum(x.u * y.u), 9) AS v FROM unit x JOIN unit y ON x.id = y.id AND x.b = y.b GROUP BY 1, 2, 3),
{_picks(6)},
chosen AS (SELECT s.id, string_agg(t, '. ' ORDER BY step) AS t FROM d6 JOIN s ON s.id = d6.id AND s.i = d6.i GROUP BY 1),
extract AS (
  SELECT pieces.id, CASE WHEN len(p) <= 1 THEN text WHEN t IS NULL THEN array_to_string(p, ' ') WHEN ends_with(t, '.') THEN t ELSE t || '.' END AS text FROM pieces LEFT JOIN chosen ON chosen.id = pieces.id)"""


SEGMENTS = f"""days AS (SELECT id, chronology_index, {strip("coalesce(nullif(day, ''), 'Unknown')")} AS day_key FROM macro),
firsts AS (SELECT day_key, min(chronology_index) AS f, coalesce(list_min(list_filter([{_STEMS}], lambda i: i IS NOT NULL)), 100) AS r FROM days GROUP BY 1),
ranked AS (SELECT day_key, CAST(row_number() OVER (ORDER BY r, f) AS INT) AS seg_rank, CASE WHEN r < 100 THEN {_list(DAYS)}[r + 1] ELSE day_key END AS label FROM firsts)"""
LOG = f"""{MACRO}, {SEGMENTS},
inputs AS (SELECT *, num_source_texts > 1 AND contains({strip('text')}, '<doc-sep>') AS many, {strip('text')} AS input FROM macro WHERE {strip('text')} <> ''),
multi AS (SELECT id, input AS text FROM inputs WHERE many), {extracted('multi')}, {reduced('extract', 'id', 'short')},
log AS (
  SELECT i.id AS event_id, seg_rank, label, i.chronology_index, description, day, num_source_texts AS num_sources, replace(source_docs, '|', ', ') AS source_docs,
    CASE WHEN many THEN 'PRIMERA' ELSE 'single_source' END AS method, CASE WHEN many THEN 'extractive' ELSE 'single_source' END AS actual_method,
    length(input) AS input_chars, CASE WHEN many THEN short.text ELSE input END AS consolidated_text, left(input, 2000) AS input_text
  FROM inputs i JOIN days USING (id) JOIN ranked USING (day_key) LEFT JOIN short ON short.id = i.id)"""
#: The longest common subsequence is the longest rising run of places in the reference
LCS = f"""{TALKS}, toks AS (SELECT conv_id, {words('output')} AS o, {words('reference')} AS r FROM talks),
a AS (SELECT conv_id, unnest(o) AS w, generate_subscripts(o, 1) AS i FROM toks), b AS (SELECT conv_id, unnest(r) AS w, generate_subscripts(r, 1) AS p FROM toks),
runs AS (SELECT a.conv_id, list(p ORDER BY i, p DESC) AS ps FROM a JOIN b ON a.conv_id = b.conv_id AND a.w = b.w GROUP BY 1),
lens AS (
  SELECT conv_id, len(list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(ps, lambda z: [z])),
    lambda acc, one: list_concat(list_concat(acc[1:len(list_filter(acc, lambda t: t < one[1]))], one), acc[len(list_filter(acc, lambda t: t < one[1])) + 2:]))) AS n FROM runs),
s AS (SELECT conv_id, coalesce(n, 0) AS hits, len(o) AS n_out, len(r) AS n_ref FROM toks LEFT JOIN lens USING (conv_id)),
f AS (SELECT *, CASE WHEN n_out > 0 THEN hits / n_out::double ELSE 0 END AS precision, CASE WHEN n_ref > 0 THEN hits / n_ref::double ELSE 0 END AS recall FROM s)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM f"""
_FREE = "list_filter(range(1, len(r) + 1), lambda i: r[i] = one.w AND NOT list_contains(acc.used, i))"
METEOR = f"""{TALKS}, toks AS (SELECT conv_id, {words('output')} AS o, {words('reference')} AS r FROM talks),
m AS (
  SELECT conv_id, len(o) AS n_o, len(r) AS n_r, list_reduce(
    list_prepend({{'w': '', 'used': CAST([] AS BIGINT[]), 'spot': -1::BIGINT, 'chunks': 0, 'matches': 0, 'follows': false}},
      list_transform(o, lambda x: {{'w': x, 'used': CAST([] AS BIGINT[]), 'spot': 0::BIGINT, 'chunks': 0, 'matches': 0, 'follows': false}})),
    lambda acc, one: CASE WHEN len({_FREE}) = 0 THEN {{'w': '', 'used': acc.used, 'spot': acc.spot, 'chunks': acc.chunks, 'matches': acc.matches, 'follows': false}}
      WHEN list_contains({_FREE}, acc.spot + 1) THEN {{'w': '', 'used': list_append(acc.used, acc.spot + 1), 'spot': acc.spot + 1, 'chunks': acc.chunks + CASE WHEN acc.follows THEN 0 ELSE 1 END, 'matches': acc.matches + 1, 'follows': true}}
      ELSE {{'w': '', 'used': list_append(acc.used, ({_FREE})[1]), 'spot': ({_FREE})[1], 'chunks': acc.chunks + 1, 'matches': acc.matches + 1, 'follows': true}} END) AS a FROM toks)
SELECT conv_id, a.matches AS matches, a.chunks AS chunks, CASE WHEN a.matches > 0 THEN
  10 * (a.matches / n_o::double) * (a.matches / n_r::double) / (a.matches / n_r::double + 9 * (a.matches / n_o::double)) * (1 - 0.5::double * pow(a.chunks / a.matches::double, 3)) ELSE 0 END AS meteor FROM m"""


def oracle_sql() -> dict[str, str]:
    out = {
        "verses_from_conversations": f"WITH {TURNS} SELECT * FROM verses",
        "verses_from_documents": f"SELECT doc_id, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS seq FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)",
        "sentence_split": f"SELECT doc_id, len({sentences('text')}) AS n_sentences, len({sentences('text', 11)}) AS n_long FROM documents",
        "word_tokens": f"SELECT doc_id, len({words('text')}) AS n_words, len(list_distinct({words('text')})) AS n_distinct, len({spaced('text')}) AS n_spaced FROM documents",
        "token_offsets": rf"""WITH p AS (SELECT doc_id, unnest(s) AS part, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '({W})', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)),
a AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM p)
SELECT doc_id, count(*) FILTER (i % 2 = 0) AS n, coalesce(sum(pos - length(part)) FILTER (i % 2 = 0), 0)::bigint AS sum_start, coalesce(sum(pos) FILTER (i % 2 = 0), 0)::bigint AS sum_end FROM a GROUP BY 1""",
        "text_projections": f"SELECT doc_id, left(text, 2000) AS head, length(text) AS n_chars, length({slice_part('text', _lit('a'))}) AS n_first, length({slice_part('text', _lit('b'))}) AS n_second, upper(left(lang, 1)) || substr(lower(lang), 2) AS lang FROM documents",
        "entity_set": f"SELECT doc_id, len(e) AS n, array_to_string(list_sort(e), '|') AS entities FROM (SELECT doc_id, {entities('text')} AS e FROM documents)",
        "jaccard_pairs": f"WITH {NEIGHBOURS} SELECT conv_id, turn, {overlap('a', 'b')} AS jaccard FROM (SELECT *, {spaced('before')} AS a, {spaced('text')} AS b FROM near)",
        "entity_overlap_pairs": f"WITH {NEIGHBOURS} SELECT conv_id, turn, {overlap('a', 'b')} AS overlap FROM (SELECT *, {entities('before')} AS a, {entities('text')} AS b FROM near)",
        "clean_separators": f"SELECT page_id, {clean_separators('text')} AS text FROM (SELECT page_id, html AS text FROM pages UNION ALL SELECT * FROM ({_values(fx.MARKUP)}))",
        "clean_final": f"SELECT doc_id, {clean_final('text')} AS text FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM ({_values(fx.DIRTY)}))",
        "greedy_dedup": f"SELECT conv_id, turn, {clean_final('t')} AS text FROM (SELECT conv_id, turn, CASE WHEN t = '' OR ends_with(t, '.') THEN t ELSE t || '.' END AS t FROM (SELECT conv_id, turn, array_to_string({dedup('text', 0.65)}, ' ') AS t FROM conversations))",
        "greedy_dedup_documents": f"WITH {reduced('documents', 'doc_id', 'short')} SELECT * FROM short",
        "dedup_cap8": f"SELECT doc_id, len(k) AS n, array_to_string(k, ' ') AS text FROM (SELECT doc_id, {dedup('text', 0.6, 8)} AS k FROM documents)",
        "polarity": f"SELECT conv_id, turn, {polarity('text')} AS polarity FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT c0, c1, c3 FROM ({_values(fx.TURNS)}) f(c0, c1, c2, c3))",
        "event_fallback": f"WITH {TURNS}, {events('verses')} SELECT * FROM events",
        "event_class_lexicon": f"WITH {ALL}, {lexicon('whole')} SELECT id, doc_id, verse_idx, text, event_class, polarity FROM levents",
        "signal_extract": f"WITH {ALL}, {SIGNAL} SELECT id, doc_id, text, verse_idx, start_char, end_char FROM signals",
        "signal_relation_join": f"WITH {ALL}, {SIGNAL}, {TOLD} SELECT rel_type, count(*) AS n FROM told GROUP BY 1",
        "timex_extract": f"WITH {ALL}, {TIMES} SELECT id, doc_id, text, verse_idx, timex3_type, value, start_char, end_char FROM times",
        "timex_normalise": f"SELECT text, {normal('text')} AS value FROM ({_values([(t,) for t in fx.TIMES])}) t(text)",
        "tlink_narrative": f"WITH {TURNS}, {events('verses')}, {NARRATIVE} SELECT doc_id, event_id, related_to_event, rel_type, source FROM narr WHERE related_to_event IS NOT NULL",
        "tlink_signal": f"WITH {ALL}, {lexicon('whole')}, {SIGNAL}, {TOLD}, {ends('levents')} SELECT t.doc_id, e.event_id, e.related_to_event, t.rel_type, t.id AS signal_id, 'signal' AS source FROM told t JOIN ends e USING (doc_id, verse_idx) WHERE e.n >= 2",
        "tlink_anchor": f"WITH {ALL}, {lexicon('whole')}, {TIMES} SELECT e.doc_id, e.id AS event_id, t.id AS related_to_time, 'IS_INCLUDED' AS rel_type, 'temporal_anchor' AS source FROM levents e JOIN times t USING (doc_id, verse_idx)",
        "tlinks": f"WITH {ALL}, {events('whole')}, {SIGNAL}, {TIMES}, {LINKS} SELECT * FROM tlinks",
        "slinks": f"WITH {ALL}, {lexicon('whole')}, {SUBORDINATE.format(of='levents')} SELECT * FROM slinks",
        "annotation_type_counts": f"""WITH {ALL}, {events('whole')}, {SIGNAL}, {TIMES}, {LINKS}, {SUBORDINATE.format(of='events')},
u AS (SELECT doc_id, 'EVENT' AS type FROM events UNION ALL SELECT doc_id, 'TIMEX3' FROM times UNION ALL SELECT doc_id, 'SIGNAL' FROM signals UNION ALL SELECT doc_id, 'TLINK' FROM tlinks UNION ALL SELECT doc_id, 'SLINK' FROM slinks)
SELECT doc_id, type, count(*) AS n FROM u GROUP BY ROLLUP (doc_id, type)""",
        "hash_buckets": f"SELECT conv_id, turn, {bucket('w')} AS bucket, count(*) AS cnt FROM (SELECT conv_id, turn, unnest({words('text')}) AS w FROM conversations) GROUP BY 1, 2, 3",
        "hash_cosine_pairs": f"""WITH {TURNS}, {events('verses')}, {NARRATIVE},
bag AS (SELECT id, b, count(*) AS c FROM (SELECT id, {bucket('w')} AS b FROM (SELECT id, unnest({words('text')}) AS w FROM events)) GROUP BY 1, 2),
sq AS (SELECT id, sum(c * c)::bigint AS n FROM bag GROUP BY 1),
own AS MATERIALIZED (SELECT event_id, related_to_event, b, c FROM narr JOIN bag ON id = event_id),
dots AS MATERIALIZED (SELECT event_id, related_to_event, sum(own.c * bag.c)::bigint AS d FROM own JOIN bag ON bag.id = related_to_event AND bag.b = own.b GROUP BY 1, 2)
SELECT event_id AS a, related_to_event AS b, round(coalesce(d / sqrt((p.n * q.n)::double), 0), 9) AS cosine FROM narr LEFT JOIN dots USING (event_id, related_to_event) LEFT JOIN sq p ON p.id = event_id LEFT JOIN sq q ON q.id = related_to_event WHERE related_to_event IS NOT NULL""",
        "centroid_relevance": f"WITH {CENTRE} SELECT vec_id, label, relevance FROM rel",
        "dense_cosine_topk": f"WITH {CENTRE} SELECT label, vec_id, relevance, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY relevance DESC, vec_id) AS rank FROM rel) WHERE rank <= 5",
        "vector_pad": "SELECT vec_id, 96::bigint AS width, embedding[64]::double AS last, 0::double AS end FROM embeddings",
        "doc_pairs": "SELECT a.source AS doc_a, b.source AS doc_b FROM (SELECT DISTINCT source FROM documents) a JOIN (SELECT DISTINCT source FROM documents) b ON a.source < b.source",
        "parallel_pericopes": f"""WITH tt(k, name, day, matthew, mark, luke) AS ({_values(fx.TIMETABLE)}),
cells AS (SELECT k, name, doc, trim(ref) AS ref FROM (SELECT k, name, unnest(['matthew', 'mark', 'luke']) AS doc, unnest([matthew, mark, luke]) AS ref FROM tt) WHERE trim(ref) <> ''),
p AS (SELECT k, name, string_agg(doc || '=' || ref, ';' ORDER BY doc) AS refs FROM cells GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT max(k) AS chrono_idx, name AS event_name, arg_max(refs, k) AS refs FROM p GROUP BY name""",
        "align_best_match": f"WITH {MATCH} SELECT * FROM best",
        "align_inverted_index": f"WITH {MATCH} SELECT * FROM best",
        "alignment_groups": f"WITH {MATCH} SELECT * FROM groups",
        "tlink_gather": f"""WITH {MATCH}, {NARRATIVE},
links AS (SELECT doc_id || '_tl' || seq AS id, doc_id, rel_type, event_id, related_to_event FROM narr WHERE related_to_event IS NOT NULL),
e AS (SELECT group_id, ev_a AS ev FROM groups UNION ALL SELECT group_id, ev_b FROM groups)
SELECT DISTINCT group_id, l.* FROM e JOIN links l ON ev = event_id OR ev = related_to_event""",
        "align_with_pericopes": f"WITH {match(_NEAR)} SELECT * FROM best",
        "conflicts": f"""WITH l(group_id, a, b, rel, doc, ord) AS ({_values(fx.GROUP_LINKS)} UNION ALL
  SELECT 'u' || user_id, event_type, n, rel, 'd' || (event_id % 4), event_id FROM (
    SELECT *, lead(event_type) OVER w AS n, CASE WHEN value <= lead(value) OVER w THEN 'BEFORE' ELSE 'AFTER' END AS rel FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n IS NOT NULL),
t AS (SELECT group_id, a, b, doc, arg_max(rel, ord) AS rel, min(ord) AS at FROM l GROUP BY 1, 2, 3, 4)
SELECT x.group_id, x.a AS event_a, x.b AS event_b, x.rel AS rel_a, y.rel AS rel_b, x.doc AS doc_1, y.doc AS doc_2 FROM t x JOIN t y ON x.group_id = y.group_id AND x.a = y.a AND x.b = y.b AND x.at < y.at
WHERE (x.rel, y.rel) IN ({", ".join(f"('{p}', '{q}')" for p, q in CONTRADICTIONS)})""",
        "part_ranges": f"WITH {PARTED} SELECT k AS chronology_index, doc_id, coalesce(text, '') AS text, coalesce(event_ids, '') AS event_ids FROM told FULL JOIN had USING (k, doc_id)",
        "chapter_verse": f"""WITH refs(ref) AS ({_values([(r,) for r in fx.REFERENCES + fx.ODD_REFERENCES])} UNION ALL
  SELECT unnest([(conv_id + 1) || ':1b-' || (conv_id + 2) || ':2a', (conv_id + 1) || ':2a']) FROM (SELECT DISTINCT conv_id FROM conversations)),
r AS (SELECT ref, {strip('ref')} AS t FROM refs), {parsed()}, n AS (SELECT ref, sc, sv, regexp_extract(ref, '^(\\d+):(\\d+)', 1) AS c, regexp_extract(ref, '^(\\d+):(\\d+)', 2) AS v FROM parsed)
SELECT ref, coalesce(sc, CAST(nullif(c, '') AS INT), 0) AS chapter, coalesce(sv, CAST(nullif(v, '') AS INT), 0) AS verse FROM n""",
        "macro_events_fixture": f"WITH {FIXMACRO}",
        "verse_ref_parse": f"WITH {PARSED} SELECT * FROM parsed",
        "verse_range_expand": f"WITH {PARSED}, x AS ({ranges('ref')}) SELECT * FROM x",
        "verse_range_join": "SELECT CAST(o_orderkey AS INT) AS chronology_index, count(*) AS n_verses, sum(l_quantity) AS sum_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber BETWEEN 2 AND 5 GROUP BY 1",
        "part_slice": f"SELECT conv_id, turn, {slice_part('text', 'part')} AS text FROM (SELECT *, CASE turn % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS part FROM conversations)",
        "macro_events": f"WITH {MACRO} SELECT id, text, description, original_events, chronology_index, num_source_texts, source_docs, day FROM macro",
        "account_argmax": f"WITH {MACRO} SELECT chronology_index, chosen_doc FROM macro",
        "chain_edges": f"WITH {MACRO} SELECT * FROM (SELECT id AS src, lead(id) OVER (ORDER BY chronology_index) AS dst, 'BEFORE' AS etype FROM macro) WHERE dst IS NOT NULL",
        "detail_edges": f"""WITH {MATCH}, {NARRATIVE},
p AS (SELECT ev_a AS e, ev_b AS o FROM best UNION ALL SELECT ev_b, ev_a FROM best),
x AS (
  SELECT DISTINCT event_id AS src, related_to_event AS dst, 'INTRA_BEFORE' AS etype FROM narr WHERE related_to_event IS NOT NULL
  UNION ALL SELECT DISTINCT ev_a, ev_b, 'SAME_EVENT' FROM best
  UNION ALL SELECT DISTINCT o, related_to_event, 'INTER_BEFORE' FROM narr JOIN p ON e = event_id WHERE related_to_event IS NOT NULL AND o <> related_to_event)
SELECT etype, count(*) AS n FROM x GROUP BY 1""",
        "segment_events": f"""WITH {MACRO},
k AS (SELECT id, chronology_index, {strip("coalesce(nullif(day, ''), 'Unknown')")} AS day_key FROM macro),
g AS (SELECT day_key, min(chronology_index) AS f, coalesce(list_min(list_filter([{_STEMS}], lambda i: i IS NOT NULL)), 100) AS r FROM k GROUP BY 1),
s AS (SELECT day_key, CAST(row_number() OVER (ORDER BY r, f) AS INT) AS seg_rank, CASE WHEN r < 100 THEN {_list(DAYS)}[r + 1] ELSE day_key END AS label FROM g)
SELECT id, seg_rank, label, day_key, chronology_index FROM k JOIN s USING (day_key)""",
        "segment_runs": f"""WITH {TABLE}, k AS (SELECT k, {strip("coalesce(nullif(day, ''), 'Unknown')")} AS label FROM tt),
n AS (SELECT *, CASE WHEN label = lag(label) OVER (ORDER BY k) THEN 0 ELSE 1 END AS new FROM k)
SELECT k AS chronology_index, CAST(sum(new) OVER (ORDER BY k) AS INT) AS seg_rank, label FROM n""",
        "topo_order": f"""WITH RECURSIVE {MACRO},
nodes(id, no) AS ({_values(fx.NODES)} UNION ALL SELECT id, chronology_index + 100 FROM macro),
edges(src, dst) AS ({_values(fx.EDGES)} UNION ALL SELECT id, n FROM (SELECT id, lead(id) OVER (ORDER BY chronology_index) AS n FROM macro) WHERE n IS NOT NULL),
walk AS (SELECT id, 0 AS level FROM nodes WHERE id NOT IN (SELECT dst FROM edges) UNION SELECT dst, level + 1 FROM walk JOIN edges ON src = id),
l AS (SELECT id, max(level) AS level FROM walk GROUP BY 1)
SELECT id, CAST(row_number() OVER (ORDER BY level, no) AS INT) AS position FROM l JOIN nodes USING (id)""",
        "extractive_consolidate": f"WITH {MACRO}, {extracted('(SELECT id, text FROM macro)')} SELECT id, text FROM extract",
        "consolidation_log": f"WITH {LOG} SELECT *, length(consolidated_text) AS output_chars FROM log",
        "narrative": f"""WITH {LOG}, whole AS (SELECT seg_rank, string_agg(consolidated_text, ' ' ORDER BY chronology_index) AS text FROM log GROUP BY 1), {reduced('whole', 'seg_rank', 'parts')},
one AS (SELECT string_agg(text, chr(10) || chr(10) ORDER BY seg_rank) AS t FROM parts) SELECT {clean_final('t')} AS narrative FROM one""",
        "temporal_ordering_accuracy": f"WITH {TIMELINE} SELECT *, CASE WHEN evaluated > 0 THEN correct / evaluated::double ELSE 0 END AS accuracy FROM (SELECT count(*) AS evaluated, count(*) FILTER (p.rel = g.rel) AS correct FROM pred p JOIN gold g USING (event_id, n))",
        "adjacent_pair_accuracy": f"WITH {TIMELINE} SELECT *, CASE WHEN evaluated > 0 THEN correct / evaluated::double ELSE 0 END AS accuracy FROM (SELECT count(*) AS evaluated, count(*) FILTER (p.rel = g.rel) AS correct FROM pred p JOIN gold g USING (event_id, n) WHERE source = 'narrative_order')",
        "temporal_f1": f"""WITH {TIMELINE}, a AS (SELECT DISTINCT event_id, n, rel FROM pred), b AS (SELECT DISTINCT event_id, n, rel FROM gold),
c AS (SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS tp, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS fp, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS fn),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::double ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::double ELSE 0 END AS recall FROM c)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r""",
        "entity_coverage": f"""WITH {TALKS}, e AS (SELECT conv_id, {entities('reference')} AS g, {entities('output')} AS o FROM talks)
SELECT conv_id, len(g) AS n_entities, len(list_intersect(g, o)) AS n_covered, CASE WHEN len(g) > 0 THEN len(list_intersect(g, o)) / len(g)::double ELSE 1 END AS coverage FROM e""",
        "coherence": f"""WITH s AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, {sentences('text', 11)} AS s FROM documents)),
bag AS (SELECT doc_id, i, b, count(*) AS c FROM (SELECT doc_id, i, {bucket('w')} AS b FROM (SELECT doc_id, i, unnest({words('t')}) AS w FROM s)) GROUP BY 1, 2, 3),
sq AS (SELECT doc_id, i, sum(c * c)::bigint AS n FROM bag GROUP BY 1, 2),
d AS (SELECT x.doc_id, x.i, sum(x.c * y.c)::bigint AS d FROM bag x JOIN bag y ON x.doc_id = y.doc_id AND y.i = x.i + 1 AND x.b = y.b GROUP BY 1, 2),
c AS (SELECT d.doc_id, sum(d / sqrt((p.n * q.n)::double)) AS total FROM d JOIN sq p ON p.doc_id = d.doc_id AND p.i = d.i JOIN sq q ON q.doc_id = d.doc_id AND q.i = d.i + 1 GROUP BY 1),
n AS (SELECT doc_id, len({sentences('text', 11)}) AS n FROM documents)
SELECT doc_id, round(CASE WHEN n >= 2 THEN coalesce(total, 0) / (n - 1) ELSE 0 END, 9) AS coherence FROM n LEFT JOIN c USING (doc_id)""",
        "redundancy_ratio": f"""WITH s AS (SELECT conv_id, turn, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM (SELECT conv_id, turn, {sentences('text', 11)} AS s FROM conversations)),
bag AS (SELECT conv_id, turn, i, b, count(*) AS c FROM (SELECT conv_id, turn, i, {bucket('w')} AS b FROM (SELECT conv_id, turn, i, unnest({words('t')}) AS w FROM s)) GROUP BY 1, 2, 3, 4),
sq AS (SELECT conv_id, turn, i, sum(c * c)::bigint AS n FROM bag GROUP BY 1, 2, 3),
d AS (SELECT x.conv_id, x.turn, x.i, y.i AS j, sum(x.c * y.c)::bigint AS d FROM bag x JOIN bag y ON x.conv_id = y.conv_id AND x.turn = y.turn AND y.i < x.i AND x.b = y.b GROUP BY 1, 2, 3, 4),
r AS (SELECT DISTINCT d.conv_id, d.turn, d.i FROM d JOIN sq p ON p.conv_id = d.conv_id AND p.turn = d.turn AND p.i = d.i JOIN sq q ON q.conv_id = d.conv_id AND q.turn = d.turn AND q.i = d.j WHERE round(d / sqrt((p.n * q.n)::double), 9) >= 0.85),
n AS (SELECT conv_id, turn, len({sentences('text', 11)}) AS n_sentences FROM conversations), k AS (SELECT conv_id, turn, count(*) AS n_repeated FROM r GROUP BY 1, 2)
SELECT conv_id, turn, n_sentences, coalesce(n_repeated, 0) AS n_repeated, CASE WHEN n_sentences >= 2 THEN coalesce(n_repeated, 0) / n_sentences::double ELSE 0 END AS ratio FROM n LEFT JOIN k USING (conv_id, turn)""",
        "ngram_redundancy": f"""WITH t AS (SELECT doc_id, {words('text')} AS w_text FROM documents), g AS (SELECT doc_id, {grams('text', 3)} AS g FROM t)
SELECT doc_id, len(g) AS n_grams, len(list_distinct(g)) AS n_distinct, CASE WHEN len(g) > 0 THEN 1 - len(list_distinct(g)) / len(g)::double ELSE 0 END AS ratio FROM g""",
        "rouge_1": rouge(1),
        "rouge_2": rouge(2),
        "rouge_l": f"WITH {LCS}",
        "meteor": f"WITH {METEOR}",
        "kendall_tau": """WITH p AS (SELECT x.user_id, count(*) FILTER (x.value > y.value) AS concordant, count(*) FILTER (x.value < y.value) AS discordant FROM events x JOIN events y ON x.user_id = y.user_id AND x.ts > y.ts GROUP BY 1),
n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
tx AS (SELECT user_id, sum(c * (c - 1) / 2)::double AS tx FROM (SELECT user_id, ts, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1), ty AS (SELECT user_id, sum(c * (c - 1) / 2)::double AS ty FROM (SELECT user_id, value, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT user_id, n, coalesce(concordant, 0) AS concordant, coalesce(discordant, 0) AS discordant, sqrt((n::double * (n::double - 1) / 2 - tx) * (n::double * (n::double - 1) / 2 - ty)) AS size FROM n LEFT JOIN p USING (user_id) JOIN tx USING (user_id) JOIN ty USING (user_id))
SELECT user_id, n, concordant, discordant, CASE WHEN size > 0 THEN (concordant - discordant) / size ELSE 0 END AS tau FROM z""",
        "rank_pair_accuracy": "SELECT user_id, count(*) AS total_pairs, count(*) FILTER (b < value) AS correct_pairs, count(*) FILTER (b < value) / count(*)::double AS accuracy FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) WHERE b IS NOT NULL GROUP BY 1",
        "greedy_matching": """WITH v AS (SELECT label, vec_id, embedding::double[] AS e FROM embeddings),
c AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
p AS (SELECT label, avg(m) AS precision FROM (SELECT label, i, max(c) AS m FROM c GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT label, avg(m) AS recall FROM (SELECT label, j, max(c) AS m FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM p JOIN r USING (label)""",
        "rgat_softmax": f"WITH {RING}, {softmax('(SELECT round(list_dot_product(a.embedding::double[], b.embedding::double[]), 9) FROM embeddings a, embeddings b WHERE a.vec_id = src_no AND b.vec_id = dst_no)')} SELECT dst_no, src_no, round(weight, 6) AS weight FROM w",
        "rgat_message": f"""WITH {RING}, {softmax('0.5::double * type_no')},
m AS (SELECT dst_no, sum(weight * embedding[1]) AS f, sum(weight * embedding[64]) AS l FROM w JOIN embeddings ON vec_id = src_no GROUP BY 1)
SELECT CAST(vec_id AS INT) AS no, round(f, 6) AS first, round(l, 6) AS last FROM embeddings LEFT JOIN m ON dst_no = vec_id""",
        "rgat_losses": f"""WITH {RING},
r AS (SELECT avg(list_sum(list_transform(embedding::double[], lambda v: v * v / 4)) / len(embedding)) AS reconstruction FROM embeddings),
c AS (SELECT avg(list_distance(a.embedding::double[], b.embedding::double[]) ** 2 / 4 / len(a.embedding)) AS consistency FROM edges JOIN embeddings a ON a.vec_id = src_no JOIN embeddings b ON b.vec_id = dst_no)
SELECT round(reconstruction, 9) AS reconstruction, round(consistency, 9) AS consistency, round(reconstruction + consistency / 2, 9) AS loss FROM r, c""",
        "document_of": "SELECT CAST(conv_id AS VARCHAR) AS doc_id, count(*) AS n FROM conversations GROUP BY 1",
        "preview_rows": f"WITH {MACRO} SELECT chronology_index, description FROM macro ORDER BY 1 LIMIT 3",
        "index_edges": f"WITH {MACRO}, n AS (SELECT CAST(row_number() OVER (ORDER BY chronology_index) - 1 AS INT) AS no FROM macro) SELECT no AS src_no, CAST(no + 1 AS INT) AS dst_no, {EDGE_TYPES.index('BEFORE')} AS type_no FROM n WHERE no < (SELECT max(no) FROM n)",
    }
    return out
