"""Queries of retrieval over units and of questions answered in batches, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import extract, terms
from loomtext.functions.text import normalize
from loomtext.operators import graph, questions as Q
from loomtext.operators import provenance as P
from loomtext.operators import ranking, retrieval as R
from loomtext.operators.units import lines
from loomtext.plans import provenance_queries as G
from loomtext.plans.sqltext import ARGUMENTS, FRAMES, FULL_LINES, GROUPED, MENTIONED, NOISE, QUALITY, RELATIONS, STOP, TYPE, UNITS, X, clean, every, ids, norm, q, toks, urls, variants
from loomtext.runtime import durable, table

TARGET, RELATION, LEXICAL, REQUIRED = ["north pump"], ["sealed", "blocked"], ["rain", "crew", "yard"], ["in spite of the rain"]
QUERY = "Was the crane sealed in spite of the rain?"
ANCHORS, PREDICATES, ASKED = ["crane", "pier nine"], ["status", "owner"], ["notes", "logs", "gate"]


def docs(spark, d):
    return table(spark, d, "documents")


def _paths(spark, d):
    return docs(spark, d).select("doc_id", "rel_path")


def _ranked(df):
    return df.select("doc_id", F.col("unit_order").cast("bigint").alias("unit_order"), "rel_path", "score")


def _required(spark, d):
    """Units that hold every required phrase, as search hits."""
    u = G.units(spark, d).withColumn("key", F.concat_ws("/", "doc_id", "unit_order"))
    return ranking.lexical_search(u, "key", QUERY, REQUIRED, 20, ("rel_path", "doc_id", "unit_order")).withColumn("unit_order", F.col("unit_order").cast("bigint"))


def _lexical(spark, d, limit=1_000):
    u = G.units(spark, d).withColumn("key", F.concat_ws("/", "doc_id", "unit_order"))
    return ranking.lexical_search(u, "key", QUERY, [], limit, ("rel_path", "doc_id", "unit_order"))


def _scope(spark, d):
    ranked = ranking.rank_documents(docs(spark, d), TARGET, RELATION, LEXICAL).select("doc_id")
    noise = R.noisy(docs(spark, d).join(ranked, "doc_id", "left_semi"))
    return noise.withColumn("has_target", F.lit(True))  # a document without a target is not ranked


def _chunks(spark, d):
    out = R.rank_chunks(G.units(spark, d), _scope(spark, d), TARGET, RELATION, LEXICAL)
    return out.select("doc_id", F.col("unit_order").cast("bigint").alias("unit_order"), "rel_path", "score", F.col("distance").cast("bigint").alias("distance"))


def _referents(spark, d, limit=40):
    return R.referent_candidates(P.mention_rows(G.units(spark, d)), _paths(spark, d), ANCHORS, limit)


def _frames(spark, d, limit=40):
    f = P.frames(G.relations(spark, d))
    return R.frame_candidates(P.frame_arguments(f), f, _paths(spark, d), ["key_value", *PREDICATES], ANCHORS, limit)


def _relations(spark, d, limit=40):
    return R.relation_candidates(G.relations(spark, d), _paths(spark, d), PREDICATES, ANCHORS, limit)


def _prior(spark, d):
    return R.prior_units(G.units(spark, d), docs(spark, d), ASKED)


def _fused(spark, d):
    """Each way of finding gives its best thousand units to the fusion, in place of the reference's smaller lists."""
    return R.fused(_lexical(spark, d), _referents(spark, d, 1_000), _frames(spark, d, 1_000), _relations(spark, d, 1_000), _prior(spark, d), G.units(spark, d), R.noisy(docs(spark, d)), ["crane"], ["sealed"])


def _asked(spark, d):
    """A question for every record that has a reference: what its status is."""
    refs = P.unit_relations(G.units(spark, d)).where((normalize(F.col("subject")) == "reference") & F.col("value").rlike(r"^[A-Z][A-Z0-9]{1,9}-[0-9]+$"))
    q_ = refs.select(F.col("value").alias("question_id")).distinct().withColumn("question", F.concat(F.lit("What is the status of "), F.col("question_id"), F.lit("?")))
    return Q.frame_of(q_).withColumn("answer_type", F.lit("state"))


def _grouped(spark, d):
    return durable(P.grouped_relations(G.relations(spark, d), G.anchors(spark, d)))


def _candidates(spark, d):
    asked = durable(_asked(spark, d))
    return asked, durable(Q.groups_for(asked, _grouped(spark, d)))


def _qa(spark, d):
    asked, rows = _candidates(spark, d)
    return Q.choose(Q.bind_record_groups(rows), asked)


def _qa_relations(spark, d):
    asked, rows = _candidates(spark, d)
    return Q.choose(Q.bind_relations(rows, G.units(spark, d)), asked).select("question_id", "answer", "score", "support")


def _qa_lists(spark, d):
    asked, rows = _candidates(spark, d)
    return Q.list_values(Q.bind_record_groups(rows), asked)


def _qa_counts(spark, d):
    return Q.counted(_candidates(spark, d)[1])


def _gold(spark, d):
    """The status that stands beside a reference in the same written record, read straight from the lines: the key is the
    lines' own, not the graph's.  Where records differ the lesser status counts."""
    own = lambda k: F.regexp_extract("text", rf'{k}: "([^"]+)"', 1)
    g = lines(docs(spark, d)).where("text LIKE '{%'").select(own("reference").alias("question_id"), own("status").alias("gold")).where(r"question_id RLIKE '^[A-Z][A-Z0-9]{1,9}-[0-9]+$' AND gold <> ''")
    return g.groupBy("question_id").agg(F.min("gold").alias("gold")).select("question_id", F.substring("question_id", 1, 3).alias("category"), "gold")


def _accuracy(spark, d):
    return Q.accuracy(_qa(spark, d), _gold(spark, d))


def _frames_of_questions(spark, d):
    """The frames of all questions that the documents themselves ask."""
    u = G.units(spark, d).where("text LIKE '%?'").select(F.concat_ws("/", "doc_id", "unit_order").alias("question_id"), F.col("text").alias("question"))
    f = Q.frame_of(u)
    return f.select("question_id", F.array_join("target_terms", " | ").alias("targets"), F.array_join(F.array_sort("relation_terms"), " ").alias("relations"))


def _canonical(spark, d):
    """What the values of all relations are under each of four answer types."""
    r = G.relations(spark, d).where("value <> ''").select("value").distinct()
    t = r.select("value", F.explode(F.array(*map(F.lit, ("identifier", "url", "count", "state")))).alias("answer_type"))
    return t.select("value", "answer_type", Q.canonical(F.col("value"), F.col("answer_type")).alias("answer")).where("answer <> ''")


def _metadata(spark, d):
    """Which file holds each title's directory: questions of type metadata_value on the documents' melted facts."""
    asked = docs(spark, d).where("rel_path IS NOT NULL").select(F.col("rel_path").alias("question_id"), F.array(F.lower("rel_path")).alias("target_terms"), F.array(F.lit("encoding")).alias("relation_terms"), F.lit("metadata_value").alias("answer_type")).distinct()
    melted = graph.melt(docs(spark, d)).join(_paths(spark, d), "doc_id").where("key IN ('encoding', 'mime_type')")
    return Q.bind_metadata(asked, melted).groupBy("question_id", "value").agg(F.count("*").alias("n"), F.max("score").alias("score"))


def _times(spark, d):
    """The status that each sensor had last, bound over the sheets' lines by their times."""
    from loomtext.plans.provenance_queries import _sheet_lines

    r = P.unit_relations(_sheet_lines(spark, d)).withColumns({"record_group": F.concat(F.lit("row:"), "doc_id"), "section_anchor": F.lit(None).cast("string")})
    asked = r.where("relation_type = 'table_cell' AND subject RLIKE '^S-[0-9]{1,5}$'").select(F.col("subject").alias("question_id")).distinct()
    asked = asked.withColumns({"target_terms": F.array(F.lower("question_id")), "relation_terms": F.array().cast("array<string>"), "answer_type": F.lit("state")})
    asked, r = durable(asked), durable(r)
    return Q.choose(Q.bind_times(Q.groups_for(asked, r)), asked).select("question_id", "answer", "score")


def _execute(spark, d):
    """Three questions for every reference: its status, how many records say it, and all that owns it."""
    asked = durable(_asked(spark, d))
    ask = lambda what, kind, how: asked.select(F.concat_ws(":", F.lit(what), "question_id").alias("question_id"), "target_terms", F.array(F.lit(what)).alias("relation_terms"), F.lit(kind).alias("answer_type"), F.lit("").alias("temporal_scope"), F.lit(how).alias("aggregation"))
    batch = durable(ask("status", "state", "").unionByName(ask("status ", "count", "count").withColumn("relation_terms", F.array(F.lit("status")))).unionByName(ask("owner", "person", "list")))
    records = graph.melt(docs(spark, d)).join(_paths(spark, d), "doc_id")
    return Q.execute(batch, _grouped(spark, d), G.units(spark, d), records).select("question_id", "answer", "binder")


QUERIES = {
    "required_search": _required,
    "all_containing": lambda spark, d: R.all_containing(G.units(spark, d), ["crane", "sealed"]).select("doc_id", F.col("unit_order").cast("bigint").alias("unit_order")),
    "rank_chunks": _chunks,
    "referent_candidates": lambda spark, d: _ranked(_referents(spark, d)),
    "frame_candidates": lambda spark, d: _ranked(_frames(spark, d)),
    "relation_candidates": lambda spark, d: _ranked(_relations(spark, d)),
    "mention_payload": lambda spark, d: R.mention_payload(P.mention_rows(G.units(spark, d)), G.units(spark, d)).groupBy("doc_id", "unit_order").agg(F.count("*").alias("n"), F.min("label_norm").alias("first_label"), F.min("char_start").cast("bigint").alias("first_place")).select("doc_id", F.col("unit_order").cast("bigint").alias("unit_order"), "n", "first_label", "first_place"),
    "frame_payload": lambda spark, d: (lambda f: R.frame_payload(f, P.frame_arguments(f), G.units(spark, d)))(P.frames(G.relations(spark, d))).select("doc_id", F.col("unit_order").cast("bigint").alias("unit_order"), "frame_id", "predicate", "role", "surface", "context", F.md5("unit_text").alias("unit_md5")),
    "prior_units": lambda spark, d: _prior(spark, d).select("doc_id", F.col("unit_order").cast("bigint").alias("unit_order"), F.col("score").cast("bigint").alias("score")),
    "evidence_windows": lambda spark, d: R.evidence_window(R.all_containing(G.units(spark, d), ["crane", "sealed"]), G.units(spark, d)).select("doc_id", F.col("unit_order").cast("bigint").alias("unit_order"), "window"),
    "fused_search": lambda spark, d: _ranked(_fused(spark, d)),
    "question_frames": _frames_of_questions,
    "canonicalize": _canonical,
    "qa_batch": lambda spark, d: _qa(spark, d).select("question_id", "answer", "score", "support"),
    "qa_relations": _qa_relations,
    "qa_list_parts": _qa_lists,
    "qa_counts": _qa_counts,
    "qa_accuracy": _accuracy,
    "bind_metadata": _metadata,
    "bind_times": _times,
    "qa_execute": _execute,
    "grounded_answers": lambda spark, d: (lambda a: Q.grounded(Q.choose(b := Q.bind_record_groups(a[1]), a[0]), b, G.units(spark, d)))(_candidates(spark, d)).select("question_id", "answer", "support"),
}


def _h(x: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {q(w)}) AS INT)" for w in words) + ")"


_QTOK = {"crane": 1, "sealed": 1, "spite": 1, "rain": 1}
_LEX = " + ".join(f"least(len(list_filter(k, lambda t: t = '{t}')), {n})" for t, n in _QTOK.items())
_CONTENT = f"list_filter({toks('text')}, lambda t: length(t) > 2 AND t NOT IN {STOP})"
_LEXROWS = f"SELECT doc_id, unit_order, rel_path, m, CAST({_LEX} AS DOUBLE) AS score FROM (SELECT *, {_CONTENT} AS k, {norm('text')} AS m FROM ({UNITS}))"
_BEST = "ORDER BY score DESC, rel_path, doc_id, unit_order LIMIT {0}"
_NOISY = f"SELECT doc_id, {NOISE} AS low FROM ({QUALITY}) WHERE char_count > 0"
_DOCS = f"SELECT doc_id, low FROM (SELECT doc_id, rel_path, low, round(CASE WHEN low THEN 0.2 * s ELSE 1.0 * s END, 6) AS score FROM (SELECT doc_id, rel_path, 16 * {_h('m', TARGET)} + 8 * {_h('m', RELATION)} + {_h('m', LEXICAL)} AS s, {_h('m', TARGET)} AS t FROM (SELECT doc_id, rel_path, {norm('text')} AS m FROM documents WHERE text <> '')) JOIN ({_NOISY}) USING (doc_id) WHERE s > 0 AND t > 0 ORDER BY score DESC, rel_path, doc_id LIMIT 40)"
_CHUNKS = f"""WITH s AS MATERIALIZED (SELECT u.doc_id, unit_order, rel_path, round((22 * {_h('m', TARGET)} + 11 * {_h('m', RELATION)} + 2 * {_h('m', LEXICAL)} + CASE WHEN {_h('m', RELATION)} > 0 THEN 12 ELSE 0 END) * CASE WHEN low THEN 0.15 ELSE 1.0 END, 6) AS score
  FROM (SELECT *, {norm('text')} AS m FROM ({UNITS})) u JOIN ({_DOCS}) d ON u.doc_id = d.doc_id), t AS (SELECT * FROM s WHERE score > 0 {_BEST.format(160)})
SELECT s.doc_id, s.unit_order, s.rel_path, CAST(s.score AS DOUBLE) AS score, min(abs(s.unit_order - t.unit_order)) AS distance FROM s JOIN t ON s.doc_id = t.doc_id AND abs(s.unit_order - t.unit_order) <= 4 GROUP BY ALL ORDER BY distance, score DESC, rel_path, s.doc_id, s.unit_order LIMIT 160"""
_PATH = "(SELECT doc_id, rel_path FROM documents)"


def _top(rows: str, score: str, limit: int) -> str:
    return f"SELECT * FROM (SELECT doc_id, unit_order, rel_path, CAST(round({score}, 6) AS DOUBLE) AS score FROM ({rows}) JOIN {_PATH} USING (doc_id) GROUP BY doc_id, unit_order, rel_path) WHERE score > 0 {_BEST.format(limit)}"


def _ref(limit: int) -> str:
    return _top(f"SELECT *, {_h(norm('surface'), ANCHORS)} AS h FROM ({MENTIONED})", "sum(3.0 * h)", limit)


def _frm(limit: int) -> str:
    return _top(f"SELECT f.doc_id, f.unit_order, 4.0 + 2 * {_h('coalesce(m, chr(32))', ANCHORS)} AS s FROM (SELECT * FROM ({FRAMES}) WHERE predicate IN ('key_value', 'status', 'owner')) f LEFT JOIN (SELECT frame_id, string_agg({norm('surface')}, ' ' ORDER BY {norm('surface')}) AS m FROM ({ARGUMENTS}) GROUP BY 1) a ON f.frame_id = a.frame_id", "sum(s)", limit)


def _rel(limit: int) -> str:
    m, p = norm("subject || chr(32) || value"), norm("predicate || chr(32) || subject")
    return _top(f"SELECT doc_id, unit_order, confidence + 2.5 * a + 1.5 * p AS s FROM (SELECT *, {_h(m, ANCHORS)} AS a, {_h(p, PREDICATES)} AS p FROM ({RELATIONS})) WHERE a + p > 0", "sum(s)", limit)


_OVERLAP = " OR ".join(f"list_contains({_CONTENT}, '{t}')" for t in ASKED)
_PRIOR = f"SELECT u.doc_id, u.unit_order, d.score FROM (SELECT * FROM ({UNITS}) WHERE {_OVERLAP}) u JOIN (SELECT doc_id, 4 * {_h(norm('rel_path'), ASKED)} AS score FROM documents WHERE {_h(norm('rel_path'), ASKED)} > 0 ORDER BY score DESC, rel_path, doc_id LIMIT 8) d ON u.doc_id = d.doc_id"
_FUSED = f"""WITH u AS MATERIALIZED (SELECT *, {norm('text')} AS m FROM ({UNITS})),
p AS (SELECT doc_id, unit_order, score FROM (SELECT * FROM ({_LEXROWS}) WHERE score > 0 {_BEST.format(1000)}) UNION ALL SELECT doc_id, unit_order, 2.0 FROM ({_ref(1000)}) UNION ALL SELECT doc_id, unit_order, 2.5 FROM ({_frm(1000)}) UNION ALL SELECT doc_id, unit_order, 2.5 FROM ({_rel(1000)})),
b AS MATERIALIZED (SELECT doc_id, unit_order, max(score) AS score FROM (SELECT doc_id, unit_order, sum(score) AS score FROM p GROUP BY ALL UNION ALL SELECT * FROM ({_PRIOR})) GROUP BY ALL)
SELECT u.doc_id, u.unit_order, u.rel_path, CAST(round((max(CASE WHEN b.unit_order = u.unit_order THEN b.score ELSE 0.55 * b.score END) + 2 * {_h('u.m', ['crane'])} + 4 * {_h('u.m', ['sealed'])}) * CASE WHEN low THEN 0.15 ELSE 1.0 END, 6) AS DOUBLE) AS score
FROM u JOIN b ON b.doc_id = u.doc_id AND abs(b.unit_order - u.unit_order) <= 4 JOIN ({_NOISY}) n ON n.doc_id = u.doc_id GROUP BY u.doc_id, u.unit_order, u.rel_path, u.m, low HAVING score > 0 ORDER BY score DESC, rel_path, u.doc_id, u.unit_order LIMIT 20"""
_HIT = f"SELECT doc_id, unit_order FROM ({UNITS}) WHERE contains({norm('text')}, 'crane') AND contains({norm('text')}, 'sealed')"
_SKIP = "('Who','What','Which','Where','When','How','Can','Could','Did','Does','Do','Is','Are','Was','Were','Find','Return','Show','Give','ID','IDs','URL','URLs','JSON')"
_QW = "('what','which','who','where','when','why','how','many','did','does','do','is','are','was','were','can','could','should','has','have','find','provide','show','return','give','the','a','an','for','of','to','in','on','at','about','according','answer','content','document','entity','fact','field','folder','item','name','note','object','record','records','row','rows','entry','entries','source','text','thing','value','count','number')"
_PHR = f"list_filter({every('text', X.PHRASE)}, lambda p: regexp_extract(p, '^[^ \\t\\n]+') NOT IN {_SKIP} AND p NOT IN {_SKIP} AND NOT (upper(p) = p AND length(p) <= 5))"
_RAW = f"list_concat(list_concat({urls('text')}, {ids('text')}), {_PHR})"
_QF = f"""WITH u AS (SELECT doc_id || '/' || unit_order AS question_id, text FROM ({UNITS}) WHERE ends_with(text, '?')),
a AS (SELECT question_id, text, list_filter(list_transform({_RAW}, lambda x: x), lambda x: x <> '') AS r FROM u),
o AS (SELECT question_id, text, list_filter(list_transform(r, lambda x, i: CASE WHEN list_position(r, x) = i THEN x END), lambda x: x IS NOT NULL) AS r FROM a),
n AS (SELECT question_id, text, list_transform(r, lambda x: {norm('x')}) AS r FROM o),
s AS (SELECT question_id, text, r, flatten(list_transform(r, lambda x: CASE WHEN contains(x, ' ') THEN [x, replace(x, ' ', '_'), replace(x, ' ', '-')] ELSE [x] END)) AS t FROM n),
k AS (SELECT question_id, r, list_filter(list_transform(t, lambda x, i: CASE WHEN list_position(t, x) = i THEN x END), lambda x: x IS NOT NULL) AS t,
  list_filter({toks(f"regexp_replace({norm('text')}, '(^|[^a-z0-9_])according to .+', ' ')")}, lambda w: w NOT IN {_QW} AND length(w) > 1 AND len(list_filter(r, lambda x: contains(x, w))) = 0) AS w FROM s)
SELECT question_id, array_to_string(t, ' | ') AS targets, array_to_string(list_sort(list_filter(list_distinct(flatten(list_transform(w, lambda x: {variants('x')}))), lambda x: x NOT IN ('current','currently','latest','most_recent','recent','final','last','earliest','oldest','first','initial'))), ' ') AS relations FROM k"""
_M = norm("concat_ws(' ', relation_type, predicate, subject, value, coalesce(section_anchor, ''))")
_ID = "'^[A-Z][A-Z0-9]{1,9}-[0-9]+$'"
_STATE = f"({TYPE}) NOT IN ('unknown', 'url', 'identifier', 'file_path', 'date_time', 'count')"
_QA = f"""r AS MATERIALIZED (SELECT *, {_M} AS m FROM ({GROUPED})), asked AS (SELECT DISTINCT value AS question_id, {norm('value')} AS target FROM r WHERE {norm('subject')} = 'reference' AND regexp_matches(value, {_ID})),
grp AS (SELECT doc_id, record_group, string_agg(m, ' ' ORDER BY unit_order, k1, k2, k3) AS gm FROM r GROUP BY 1, 2),
pair AS (SELECT question_id, target, g.doc_id, g.record_group, gm FROM (SELECT *, unnest(list_distinct({toks('gm')})) AS tok FROM grp) g JOIN asked ON tok = target),
cand AS (SELECT question_id, r.doc_id, r.unit_order, value, m, {clean('value')} AS answer, round((5.0 + 5.0 + 6.0 + 1.5 + 4.0 * CAST(contains({norm('value')}, 'status') AS INT)) * confidence, 6) AS score, confidence, target
  FROM pair p JOIN r ON p.doc_id = r.doc_id AND p.record_group = r.record_group WHERE contains(m, 'status') AND contains(gm, target) AND {_STATE} AND {norm('value')} <> 'status' AND {norm('value')} <> target AND NOT contains(' ' || regexp_replace({norm('value')}, '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || regexp_replace(target, '[^a-z0-9]+', ' ', 'g') || ' ')),
summed AS (SELECT question_id, answer, round(sum(score), 6) AS score, count(*) AS support FROM cand WHERE answer <> '' GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, length(answer), answer) AS rn FROM summed) WHERE rn = 1)"""
_GOLD = f"SELECT question_id, substring(question_id, 1, 3) AS category, min(gold) AS gold FROM (SELECT regexp_extract(text, 'reference: \"([^\"]+)\"', 1) AS question_id, regexp_extract(text, 'status: \"([^\"]+)\"', 1) AS gold FROM ({FULL_LINES}) WHERE starts_with(text, '{{')) WHERE regexp_matches(question_id, {_ID}) AND gold <> '' GROUP BY 1, 2"
SQL = {
    "required_search": f"SELECT doc_id || '/' || unit_order AS key, rel_path, doc_id, unit_order, score + 4 AS score FROM ({_LEXROWS}) WHERE contains(m, 'in spite of the rain') ORDER BY score DESC, rel_path, doc_id, unit_order LIMIT 20",
    "all_containing": _HIT,
    "rank_chunks": _CHUNKS,
    "referent_candidates": _ref(40),
    "frame_candidates": _frm(40),
    "relation_candidates": _rel(40),
    "mention_payload": f"SELECT doc_id, unit_order, count(*) AS n, min({norm('surface')}) AS first_label, CAST(min(char_start) AS BIGINT) AS first_place FROM ({MENTIONED}) GROUP BY 1, 2",
    "frame_payload": f"SELECT f.doc_id, f.unit_order, f.frame_id, f.predicate, a.role, a.surface, 'asserted' AS context, md5(u.text) AS unit_md5 FROM ({FRAMES}) f JOIN ({UNITS}) u ON u.doc_id = f.doc_id AND u.unit_order = f.unit_order LEFT JOIN ({ARGUMENTS}) a ON a.frame_id = f.frame_id",
    "prior_units": f"SELECT doc_id, unit_order, CAST(score AS BIGINT) AS score FROM ({_PRIOR})",
    "evidence_windows": f"SELECT h.doc_id, h.unit_order, substring(string_agg(u.text, ' ' ORDER BY u.unit_order), 1, 1200) AS \"window\" FROM ({_HIT}) h JOIN ({UNITS}) u ON u.doc_id = h.doc_id AND abs(u.unit_order - h.unit_order) <= 3 GROUP BY 1, 2",
    "fused_search": _FUSED,
    "question_frames": _QF,
    "qa_batch": f"WITH {_QA} SELECT question_id, answer, score, support FROM best",
    "qa_list_parts": f"WITH {_QA} SELECT DISTINCT question_id, unnest(list_filter(list_transform(string_split(answer, ';'), lambda p: {clean('p')}), lambda p: p <> '')) AS part FROM cand",
    "qa_counts": f"WITH {_QA}, said AS (SELECT p.question_id, p.target, r.doc_id, r.unit_order, string_agg(DISTINCT r.m, ' ' ORDER BY r.m) AS s FROM pair p JOIN r ON p.doc_id = r.doc_id AND p.record_group = r.record_group GROUP BY ALL) SELECT question_id, count(*) AS n FROM said WHERE contains(s, target) AND contains(s, 'status') GROUP BY 1",
    "qa_accuracy": f"WITH {_QA} SELECT category, count(*) AS total, count(answer) AS answered, count(*) FILTER ({norm('answer')} = {norm('gold')} AND answer IS NOT NULL) AS correct FROM ({_GOLD}) g LEFT JOIN best USING (question_id) GROUP BY 1",
    "grounded_answers": f"WITH {_QA}, seen AS (SELECT DISTINCT b.question_id FROM best b JOIN cand c ON c.question_id = b.question_id JOIN ({UNITS}) u ON u.doc_id = c.doc_id AND u.unit_order = c.unit_order WHERE contains({norm('u.text')}, {norm('b.answer')})) SELECT b.question_id, CASE WHEN s.question_id IS NOT NULL THEN answer ELSE 'unknown' END AS answer, support FROM best b LEFT JOIN seen s ON s.question_id = b.question_id",
}
