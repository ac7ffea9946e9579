"""Pieces of DuckDB SQL for the queries' reference SQL.  Nothing here comes from the operators: all is written out anew."""


class X:
    """The patterns as RE2 spells them."""

    URL = r"(https?://[^\s)\],\"']+)"
    PREFIX_ID = r"\b([A-Z][A-Z0-9]{1,9}(?:-[A-Z0-9]{2,12})*-[0-9]+[A-Z0-9-]*)\b"
    LOWER_ID = r"\b([a-z][a-z0-9]{1,12}_[a-z0-9]{6,})\b"
    HEX_ID = r"\b([0-9a-fA-F]{8,16})\b"
    EMAIL = r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"
    FILE_LIKE = r"\b([A-Za-z0-9_./-]+\.[A-Za-z0-9]{1,8})\b"
    PHRASE = r"\b((?:(?:Dr|Ms|Mr|Mrs|Prof)\.[ \t\n]+)?[A-Z][A-Za-z0-9_-]+(?:[ \t\n]+[A-Z][A-Za-z0-9_-]+){0,3})\b"
    TIMESTAMP = r"\b([0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T][0-9]{2}:[0-9]{2})?)\b"
    LABEL = r'^[ \t]*"?([A-Za-z][A-Za-z0-9 _/-]{1,80})"?[ \t]*[:=][ \t]*"?([^"{}\[\]\n;,|]+)'
    OBJECT = r"(\{[^{}\n]*(?:\{[^{}\n]*\}[^{}\n]*)*\})"
    PAIR = r'"?([A-Za-z][A-Za-z0-9 _/-]{0,80})"?[ \t]*:[ \t]*(?:"([^"\n{}\[\]]*)"|([^,"{}\[\]\n]+))'
    QUOTED_PAIR = r'(?i)"([^"\n]{1,80})"[ \t\n]*:[ \t\n]*(?:"([^"\n]*)"|(-?[0-9]+(?:\.[0-9]+)?|true|false|null))'


WORD = r"[A-Za-z0-9][A-Za-z0-9_.@:/#-]*"
BLOB = r"\b(?:[0-9a-fA-F]{24,}|[A-Za-z0-9+/]{32,}=*)(?:[^A-Za-z0-9_]|$)"
STOP_WORDS = ("a", "an", "and", "are", "as", "by", "can", "could", "did", "does", "for", "from", "had", "has", "have", "how", "in", "is", "it", "of", "on", "or", "should", "that", "the", "to", "was", "were", "what", "when", "where", "which", "who", "with", "would")
WS = "chr(32) || chr(9) || chr(13) || chr(10)"
_SP = r"[\s\x0B\x{85}\p{Z}]+"


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '{_SP}', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), {q(WORD)}), lambda t: lower(trim(t, '.,;:!?()[]{{}}\"''`'))), lambda t: t <> '')"


def compact(x: str) -> str:
    return f"trim(trim(regexp_replace(coalesce({x}, ''), '{_SP}', ' ', 'g')), ' .;:')"


def clean(x: str) -> str:
    v = f"trim({compact(x)}, {WS} || '\"''`{{}}[](),')"
    return compact(f"trim(regexp_replace({v}, '\\s*[}}\\]),]+$', ''), ' \"''`')")


def every(x: str, pattern: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), {q(pattern)}, 1)"


STOP = "(" + ", ".join(q(w) for w in STOP_WORDS) + ")"
LINES = "SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '')"
FULL_LINES = f"SELECT * FROM ({LINES}) WHERE regexp_matches(text, '[^ \\t\\r]')"
QUALITY = f"""
SELECT doc_id, length(text) AS char_count, length(text) - length(regexp_extract_all(text, '[\\p{{C}}\\p{{Z}}]')) + length(regexp_extract_all(text, '[ \\t\\n\\x0B\\f\\r]')) AS printable,
  length(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]')) AS alnum, length(text) - length(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\s\\x0B\\x1c-\\x1f\\x{{85}}\\p{{Z}}]')) AS symbols,
  len(k) AS token_count, len(list_distinct(k)) AS unique_tokens, len(list_filter(k, lambda t: length(t) >= 24)) AS long_tokens,
  length(regexp_extract_all(text, '[^\\x00-\\x7f]')) AS non_ascii, len(list_filter(k, lambda t: regexp_matches(t, '[0-9]') AND regexp_matches(t, '[a-z]'))) AS mixed_tokens,
  regexp_matches(text, {q(BLOB)}) AS has_blob, contains({norm('text')}, 'no actionable fact is asserted') AS says_nothing
FROM (SELECT doc_id, text, {toks('text')} AS k FROM documents WHERE text IS NOT NULL)"""


def share(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN {a} / {b}::DOUBLE ELSE 0 END)"


CLASS = f"""CASE WHEN char_count = 0 THEN 'empty' WHEN {share('symbols', 'char_count')} > 0.35 OR {share('printable', 'char_count')} < 0.75 THEN 'random_character_noise'
 WHEN {share('long_tokens', 'token_count')} > 0.25 OR has_blob THEN 'base64_or_hex_blob' WHEN {share('mixed_tokens', 'token_count')} > 0.20 THEN 'ocr_corruption'
 WHEN {share('non_ascii', 'char_count')} > 0.05 AND {share('unique_tokens', 'token_count')} > 0.80 THEN 'multilingual_word_salad'
 WHEN token_count >= 12 AND {share('unique_tokens', 'token_count')} > 0.90 THEN 'word_salad' WHEN says_nothing THEN 'plausible_babble' ELSE 'meaningful_discourse' END"""
NOISE = f"""(char_count = 0 OR {share('printable', 'char_count')} < 0.75 OR {share('alnum', 'char_count')} < 0.25 OR {share('symbols', 'char_count')} > 0.35 OR (char_count > 80 AND token_count < 4)
 OR (token_count >= 20 AND {share('unique_tokens', 'token_count')} > 0.95 AND {share('long_tokens', 'token_count')} > 0.20))"""
LABELS = f"""
SELECT doc_id, line, item - 1 AS item, label AS subject, value FROM (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS item, label, value FROM (
    SELECT doc_id, line, k, {clean(f"regexp_extract(p, {q(X.LABEL)}, 1)")} AS label, {clean(f"regexp_extract(p, {q(X.LABEL)}, 2)")} AS value
    FROM (SELECT doc_id, line, k, CASE WHEN regexp_matches(raw, {q(X.LABEL)}) THEN raw ELSE regexp_replace(ltrim(raw, ' '), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9]{{2}}:[0-9]{{2}})?[ \\t]+', '') END AS p
      FROM (SELECT doc_id, line, generate_subscripts(ps, 1) AS k, unnest(ps) AS raw FROM (SELECT doc_id, line, string_split_regex(text, '[|;,\\n]') AS ps FROM ({FULL_LINES}))))
    WHERE NOT regexp_matches(p, '[{{}}\\[\\]]|://')) WHERE label <> '' AND value <> '')"""
SPANS = f"SELECT doc_id, line, generate_subscripts(o, 1) - 1 AS span_no, unnest(o) AS span FROM (SELECT doc_id, line, {every('text', X.OBJECT)} AS o FROM ({FULL_LINES}) WHERE contains(text, '{{')) "
PAIRS = f"""
SELECT doc_id, line, span_no, {clean('k')} AS subject, {clean("CASE WHEN b <> '' THEN b ELSE v END")} AS value FROM (
  SELECT doc_id, line, span_no, unnest(regexp_extract_all(span, {q(X.PAIR)}, 1)) AS k, unnest(regexp_extract_all(span, {q(X.PAIR)}, 2)) AS v, unnest(regexp_extract_all(span, {q(X.PAIR)}, 3)) AS b
  FROM ({SPANS}) WHERE contains(span, ':')) WHERE {clean('k')} <> '' AND {clean("CASE WHEN b <> '' THEN b ELSE v END")} <> ''"""
CELLS = f"""
SELECT doc_id, line, list_filter(list_transform(string_split_regex(text, '[|\\t]'), lambda c: {clean('c')}), lambda c: c <> '') AS cells
FROM ({FULL_LINES}) WHERE contains(text, '|') OR contains(text, chr(9))"""
_V, _LOW = clean("value"), norm(clean("value"))
_LONE_URL = f"""(regexp_extract({_V}, {q(X.URL)}, 1) <> '' AND len(regexp_extract_all({_V}, {q(X.URL)})) = 1
 AND regexp_matches(trim(replace({_LOW}, lower(regexp_extract({_V}, {q(X.URL)}, 1)), ' ')), '^((at|in|on|from|to)( +|$))*$'))"""
TYPE = f"""CASE WHEN {_V} = '' OR {_LOW} = 'unknown' THEN 'unknown' WHEN regexp_matches({_LOW}, '^(yes|no)($|[;,:.!?] )') THEN 'boolean'
 WHEN regexp_matches({_V}, '^https?://[^\\s)\\],"'']+$') OR {_LONE_URL} THEN 'url' WHEN regexp_matches({_V}, '^[0-9]+$') THEN 'count'
 WHEN regexp_matches({_V}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?)?$|^[0-9]{{1,2}}:[0-9]{{2}}$|^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}$') OR regexp_matches({_LOW}, '^[0-9]+(\\.[0-9]+)? ?(second|minute|hour|day|week|month|year)s?$') THEN 'date_time'
 WHEN regexp_matches({_V}, '^[A-Z][A-Z0-9]{{1,9}}(-[A-Z0-9]{{2,12}})*-[0-9]+[A-Z0-9-]*$') THEN 'identifier'
 WHEN regexp_matches({_V}, '^[A-Za-z0-9_./-]+\\.[A-Za-z][A-Za-z0-9]{{0,7}}$') THEN 'file_path' ELSE 'content_phrase' END"""

# Units with their places: titles' dots are held apart by chr(2), breaks are marked by chr(1) and chr(3), and places are
# sums of lengths.
UNITS = f"""
SELECT doc_id, rel_path, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS unit_order, place + lead AS char_start, place + lead + length(t) AS char_end, t AS text FROM (
  SELECT doc_id, rel_path, k, sum(length(sep) + length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - length(piece) AS place,
    length(piece) - length(ltrim(piece, {WS})) AS lead, replace(trim(piece, {WS}), chr(2), '.') AS t
  FROM (SELECT doc_id, rel_path, k, sep, CASE WHEN k = 1 THEN x ELSE substring(x, length(sep) + 2) END AS piece
    FROM (SELECT doc_id, rel_path, k, x, CASE WHEN k = 1 THEN '' ELSE split_part(x, chr(3), 1) END AS sep
      FROM (SELECT doc_id, rel_path, generate_subscripts(e, 1) AS k, unnest(e) AS x
        FROM (SELECT doc_id, rel_path, string_split(regexp_replace(regexp_replace(text, '(^|[^A-Za-z0-9_])(Dr|Ms|Mr|Mrs|Prof)\\.', '\\1\\2' || chr(2), 'g'), '([.!?])([ \\t\\n\\r]+)|(\\n+)', '\\1' || chr(1) || '\\2\\3' || chr(3), 'g'), chr(1)) AS e FROM documents WHERE text <> '')))))
WHERE t <> ''"""


def ids(x: str) -> str:
    return f"list_concat(list_concat({every(x, X.PREFIX_ID)}, {every(x, X.LOWER_ID)}), list_concat({every(x, X.HEX_ID)}, list_concat({every(x, X.EMAIL)}, {every(x, X.FILE_LIKE)})))"


def urls(x: str) -> str:
    return f"list_transform({every(x, X.URL)}, lambda u: rtrim(u, '.'))"


ENTITY = """CASE WHEN regexp_matches(surface, '^https?://[^\\s]+$') THEN 'url' WHEN regexp_matches(surface, '^[A-Z][A-Z0-9]{1,9}-[0-9]+[A-Z0-9-]*$') OR regexp_matches(surface, '^[a-z][a-z0-9]{1,12}_[a-z0-9]{6,}$') THEN 'identifier'
 WHEN regexp_matches(surface, '^[0-9a-fA-F]{8,16}$') THEN 'commit' WHEN contains(surface, '@') AND contains(surface, '.') THEN 'email' WHEN regexp_matches(surface, '[^\\s][ \\t\\n]+[^\\s]') THEN 'name' ELSE 'entity' END"""
MENTIONED = f"""SELECT doc_id, unit_order, surface, {ENTITY} AS entity_type, char_start + instr(text, surface) - 1 AS char_start, char_start + instr(text, surface) - 1 + length(surface) AS char_end
 FROM (SELECT DISTINCT doc_id, unit_order, char_start, text, unnest(list_concat(list_concat({urls('text')}, {ids('text')}), {every('text', X.PHRASE)})) AS surface FROM ({UNITS}))"""
_K = "doc_id, unit_order"
_UPAIR = f"""SELECT {_K}, 1 AS k1, k2, generate_subscripts(a, 1) AS k3, 'record_value' AS relation_type, 'key_value' AS predicate, unnest(a) AS s0, unnest(v) AS v1, unnest(b) AS v2, 0.84 AS confidence, 'object:' || substring(sha256({norm('span')}), 1, 16) AS record_group, 'object_like' AS surface_format
  FROM (SELECT {_K}, k2, span, regexp_extract_all(span, {q(X.PAIR)}, 1) AS a, regexp_extract_all(span, {q(X.PAIR)}, 2) AS v, regexp_extract_all(span, {q(X.PAIR)}, 3) AS b
    FROM (SELECT {_K}, generate_subscripts(o, 1) AS k2, unnest(o) AS span FROM (SELECT {_K}, {every('text', X.OBJECT)} AS o FROM ({UNITS}))) WHERE contains(span, ':'))"""
_UOUT = f"""SELECT {_K}, 2 AS k1, 0 AS k2, generate_subscripts(a, 1) AS k3, 'record_value' AS relation_type, 'key_value' AS predicate, unnest(a) AS s0, unnest(v) AS v1, unnest(b) AS v2, 0.83 AS confidence, NULL AS record_group, 'json_like' AS surface_format
  FROM (SELECT {_K}, regexp_extract_all(r, {q(X.QUOTED_PAIR)}, 1) AS a, regexp_extract_all(r, {q(X.QUOTED_PAIR)}, 2) AS v, regexp_extract_all(r, {q(X.QUOTED_PAIR)}, 3) AS b FROM (SELECT {_K}, regexp_replace(text, {q(X.OBJECT)}, chr(10), 'g') AS r FROM ({UNITS})))"""
_ULABEL = f"""SELECT {_K}, 3 AS k1, 0 AS k2, k AS k3, 'label_value' AS relation_type, 'label' AS predicate, regexp_extract(p, {q(X.LABEL)}, 1) AS s0, regexp_extract(p, {q(X.LABEL)}, 2) AS v1, '' AS v2, 0.84 AS confidence, NULL AS record_group, '' AS surface_format
  FROM (SELECT {_K}, k, CASE WHEN regexp_matches(raw, {q(X.LABEL)}) THEN raw ELSE regexp_replace(ltrim(raw, ' '), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9]{{2}}:[0-9]{{2}})?[ \\t]+', '') END AS p
    FROM (SELECT {_K}, generate_subscripts(ps, 1) AS k, unnest(ps) AS raw FROM (SELECT {_K}, string_split_regex(text, '[|;,\\n]') AS ps FROM ({UNITS}))) WHERE NOT regexp_matches(raw, '[{{}}\\[\\]]|://'))
  WHERE regexp_matches(p, {q(X.LABEL)})"""
_UCELL = f"""SELECT {_K}, 4 AS k1, 0 AS k2, k AS k3, 'table_cell' AS relation_type, 'cell_' || (k - 1) AS predicate, first AS s0, c AS v1, '' AS v2, 0.72 AS confidence, NULL AS record_group, '' AS surface_format
  FROM (SELECT {_K}, cells[1] AS first, generate_subscripts(cells, 1) AS k, unnest(cells) AS c FROM (SELECT {_K}, list_filter(list_transform(string_split_regex(text, '[|\\t]'), lambda c: {clean('c')}), lambda c: c <> '') AS cells FROM ({UNITS}) WHERE regexp_matches(text, '[|\\t]')) WHERE len(cells) >= 2) WHERE k > 1"""


def _single(k: int, values: str, kind: str, name: str, confidence: float) -> str:
    return f"SELECT {_K}, {k} AS k1, 0 AS k2, generate_subscripts(a, 1) AS k3, '{kind}' AS relation_type, '{name}' AS predicate, '' AS s0, unnest(a) AS v1, '' AS v2, {confidence} AS confidence, NULL AS record_group, '' AS surface_format FROM (SELECT {_K}, {values} AS a FROM ({UNITS}))"


_NAMED = "relation_type IN ('record_value', 'label_value')"
RELATIONS = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_K}, relation_type, predicate, {norm('subject')}, {norm('value')} ORDER BY k1, k2, k3) AS rn FROM (
  SELECT {_K}, k1, k2, k3, relation_type, predicate, {clean('s0')} AS subject, {clean("CASE WHEN v2 <> '' THEN v2 ELSE v1 END")} AS value, CAST(confidence AS DOUBLE) AS confidence,
    CASE WHEN k1 = 2 THEN CASE WHEN contains({clean('s0')}, '.') THEN regexp_replace({clean('s0')}, '\\.[^.]*$', '') ELSE {clean('s0')} END ELSE record_group END AS record_group, surface_format
  FROM ({" UNION ALL ".join((_UPAIR, _UOUT, _ULABEL, _UCELL, _single(5, urls('text'), 'identifier', 'url', 0.85), _single(6, ids('text'), 'identifier', 'identifier', 0.8), _single(7, every('text', X.TIMESTAMP), 'temporal', 'timestamp', 0.8)))}))
 WHERE (subject <> '' OR value <> '') AND NOT ({_NAMED} AND (subject = '' OR value = ''))) WHERE rn = 1"""


def long_phrase(x: str) -> str:
    return f"(len(list_filter({every(x, X.PHRASE)}, lambda p: regexp_matches(p, '[ \\t\\n]'))) > 0)"


def heading(x: str) -> str:
    c = clean(x)
    return f"({c} <> '' AND length({c}) <= 100 AND NOT regexp_matches({c}, '[:|\\t]') AND len({urls(c)}) = 0 AND len({ids(c)}) = 0 AND len({toks(c)}) BETWEEN 1 AND 8 AND len({every(c, X.PHRASE)}) > 0)"


STRUCTURE = f"""
SELECT {_K}, text, is_heading, starts_record, coalesce(n_all = n_own, false) AND NOT starts_record AS inherits, plain_prefix,
  CASE WHEN NOT is_heading AND n_labels = 1 AND NOT regexp_matches(text, '[|\\t]|://') AND len({ids('label')}) = 0 AND len(list_filter({every('label', X.PHRASE)}, lambda p: regexp_matches(p, '[ \\t\\n]') AND {norm('p')} = {norm('label')})) > 0 THEN label END AS label_heading
FROM (SELECT {_K}, text, {heading('text')} AS is_heading, (regexp_matches(text, '[|\\t]') OR regexp_matches(text, '^[ \\t]*[\\[{{]') OR {long_phrase("regexp_extract(text, '^[^:=]*')")}) AS starts_record, NOT {long_phrase("regexp_extract(text, '^[^:=|\\t]*')")} AS plain_prefix FROM ({UNITS}))
LEFT JOIN (SELECT {_K}, count(*) AS n_all, count(*) FILTER (relation_type = 'label_value') AS n_labels, count(*) FILTER ({_NAMED}) AS n_own, max(value) FILTER (relation_type = 'label_value') AS label FROM ({RELATIONS}) GROUP BY ALL) USING ({_K})"""
ANCHORED = f"""SELECT *, coalesce(last_value(CASE WHEN is_heading THEN {clean('text')} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY unit_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(label_heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY unit_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS section_anchor FROM ({STRUCTURE})"""


def sid(prefix: str, *parts: str) -> str:
    joined = " || chr(31) || ".join(f"coalesce(CAST({p} AS VARCHAR), 'None')" for p in parts)
    return f"'{prefix}_' || substring(sha256({joined}), 1, 24)"


GROUPED = f"""SELECT r.doc_id, r.unit_order, k1, k2, k3, relation_type, predicate, subject, value, confidence, surface_format,
  CASE WHEN inherits AND section_anchor IS NOT NULL THEN {sid('section_group', 'r.doc_id', 'section_anchor')} ELSE coalesce(record_group, {sid('sentence_group', 'r.doc_id', 'r.unit_order')}) END AS record_group,
  CASE WHEN (inherits AND section_anchor IS NOT NULL) OR NOT starts_record OR plain_prefix THEN section_anchor END AS section_anchor,
  {sid('rel', 'r.doc_id', 'r.unit_order', 'relation_type', 'predicate', 'subject', 'value')} AS relation_id
 FROM ({RELATIONS}) r JOIN ({ANCHORED}) a ON r.doc_id = a.doc_id AND r.unit_order = a.unit_order"""


def variants(t: str) -> str:
    cut = lambda end, more="": f"CASE WHEN ends_with({t}, '{end}') AND length({t}) > {len(end) + 2}{more} THEN substring({t}, 1, length({t}) - {len(end)}) || '{'y' if end == 'ies' else ''}' END"
    plain = f" AND NOT regexp_matches({t}, '(ss|us|is)$')"
    every_one = f"[{t}, {cut('ing')}, {cut('ied')}, {cut('ed')}, {cut('ies')}, {cut('s', plain)}]"
    return f"CASE WHEN regexp_matches({t}, '^[a-z]+$') THEN list_sort(list_distinct(list_filter({every_one}, lambda v: v IS NOT NULL AND length(v) > 1))) ELSE [{t}] END"


def predicate_norm(x: str) -> str:
    t = f"split_part({norm(x)}, ' ', 1)"
    return f"coalesce(substring(list_sort(list_transform({variants(t)}, lambda v: lpad(CAST(length(v) AS VARCHAR), 6, '0') || v))[1], 7), {t})"


FRAMES = f"""SELECT {_K}, frame_no, {sid('frm', 'doc_id', 'unit_order', 'relation_type', 'predicate', 'subject', 'value')} AS frame_id, CASE WHEN relation_type = 'label_value' THEN {predicate_norm('subject')} ELSE predicate END AS predicate, confidence, subject, value
 FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY k1, k2, k3) AS frame_no FROM ({RELATIONS})) WHERE frame_no <= 32"""
ARGUMENTS = f"""SELECT {_K}, frame_id, role, surface, value_type, {sid('ref', norm('surface'), 'value_type')} AS referent_id FROM (
  SELECT {_K}, frame_id, 'subject' AS role, subject AS surface, 'unknown' AS value_type FROM ({FRAMES}) WHERE subject <> '' UNION ALL SELECT {_K}, frame_id, 'value', value, {TYPE} FROM ({FRAMES}) WHERE value <> '')"""
