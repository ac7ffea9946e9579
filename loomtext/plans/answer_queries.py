"""Queries of ranking, retrieval and answer binding, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions.text import normalize
from loomtext.operators import binding, ranking
from loomtext.operators.relations import object_relations
from loomtext.plans.sqltext import NOISE, PAIRS, QUALITY, SPANS, TYPE, clean, norm, q, toks
from loomtext.runtime import table

TARGET, RELATION, LEXICAL = ["north pump"], ["sealed", "blocked"], ["rain", "crew", "yard"]
QUERY, REQUIRED = "the crane was sealed, the rain", ["in spite of the rain"]
QUERY_TOKENS = {"crane": 1, "sealed": 1, "rain": 1}  # without stop words


def _sentences(spark, d):
    """Each delivered unit once; the copies of a late delivery hold the same text."""
    return table(spark, d, "sentences").groupBy("sentence_id").agg(F.min("text").alias("text"))


def _chunks(spark, d):
    return table(spark, d, "chunks").select("chunk_id", "document_id", "chunk_order", "text").distinct()


def _neighbours(spark, d):
    c = _chunks(spark, d)
    return ranking.neighbours(c.where(F.lower("text").contains("parcel cage")), c).select("document_id", F.col("chunk_order").cast("bigint").alias("chunk_order"), "chunk_id", F.col("distance").cast("bigint").alias("distance"))


def _records(spark, d):
    """Object-like records as (doc_id, line, record_group, item, status, owner)."""
    r = object_relations(table(spark, d, "documents"))
    field = lambda k: F.min(F.when(normalize(F.col("subject")) == k, F.col("value"))).alias(k)
    return r.groupBy("doc_id", "line", "record_group").agg(field("item"), field("status"), field("owner"))


def _candidates(spark, d, column):
    return _records(spark, d).where(f"item IS NOT NULL AND {column} IS NOT NULL").select(normalize(F.col("item")).alias("question"), F.col(column).alias("value"), F.lit(5.88).alias("score"))


def _bound(spark, d):
    return binding.matched(object_relations(table(spark, d, "documents")), ["status"], ["sealed", "blocked"]).groupBy("doc_id", "value", "score").agg(F.count("*").alias("n"))


def _postings(spark, d):
    p = ranking.term_counts(table(spark, d, "documents"), "doc_id")
    return p.groupBy("token").agg(F.count("*").alias("documents"), F.sum("tf").alias("tf")).orderBy(F.desc("documents"), "token").limit(100)


def _prior(spark, d):
    """Documents whose path names the asked tokens, 4 a token."""
    m = normalize(F.col("rel_path"))
    s = 4 * ranking.hits(m, ["notes", "logs", "claims"])
    return table(spark, d, "documents").select("doc_id", "rel_path", s.alias("score")).where("score > 0").orderBy(F.desc("score"), "rel_path", "doc_id").limit(8)


QUERIES = {
    "rank_documents": lambda spark, d: ranking.rank_documents(table(spark, d, "documents"), TARGET, RELATION, LEXICAL),
    "lexical_search": lambda spark, d: ranking.lexical_search(_sentences(spark, d), "sentence_id", QUERY, REQUIRED),
    "token_postings": _postings,
    "token_rows": lambda spark, d: ranking.term_counts(table(spark, d, "documents"), "doc_id"),
    "neighbour_window": _neighbours,
    "metadata_prior": _prior,
    "bind_relations": _bound,
    "choose_answer": lambda spark, d: binding.choose(_candidates(spark, d, "status"), "question").select("question", "answer", "answer_type", "score", "support"),
    "list_answer": lambda spark, d: binding.list_values(_candidates(spark, d, "owner"), "question"),
    "count_groups": lambda spark, d: binding.count_groups(object_relations(table(spark, d, "documents")), [("item", "the gate"), ("status", "sealed")]),
    "ambiguous_users": lambda spark, d: binding.ambiguous(table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("value")), "user_id", "day"),
}


def _hits(x: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {q(t)}) AS INT)" for t in terms) + ")"


_SCORE = f"16 * {_hits('m', TARGET)} + 8 * {_hits('m', RELATION)} + {_hits('m', LEXICAL)}"
_SENT = "SELECT sentence_id, min(text) AS text FROM sentences GROUP BY sentence_id"
_SHARED = " + ".join(f"least(len(list_filter(k, lambda t: t = {q(t)})), {n})" for t, n in QUERY_TOKENS.items())
_ALL = " AND ".join(f"contains(m, {q(p)})" for p in REQUIRED)
_CH = "SELECT DISTINCT chunk_id, document_id, chunk_order, text FROM chunks"
_GROUPED = f"""SELECT p.doc_id, p.line, substring(sha256({norm('s.span')}), 1, 16) AS record_group, subject, value FROM ({PAIRS}) p JOIN ({SPANS}) s ON p.doc_id = s.doc_id AND p.line = s.line AND p.span_no = s.span_no"""
_REC = f"SELECT doc_id, line, record_group, " + ", ".join(f"min(CASE WHEN {norm('subject')} = '{k}' THEN value END) AS {k}" for k in ("item", "status", "owner")) + f" FROM ({_GROUPED}) GROUP BY 1, 2, 3"


def _cand(column: str) -> str:
    return f"SELECT {norm('item')} AS question, {clean(column)} AS canonical FROM ({_REC}) WHERE item IS NOT NULL AND {clean(column)} <> ''"


_SCORED = f"SELECT question, canonical, count(*) AS support, round(count(*) * 5.88, 6) AS score FROM ({_cand('status')}) GROUP BY 1, 2"
_CHOSEN = f"SELECT question, canonical AS value, canonical AS answer, score, support FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, length(canonical), canonical) AS rn FROM ({_SCORED})) WHERE rn = 1"
_MATCH = f"{norm('predicate || chr(32) || subject || chr(32) || value')}"
SQL = {
    "rank_documents": f"SELECT d.doc_id, d.rel_path, round(CASE WHEN {NOISE} THEN 0.2 * s ELSE 1.0 * s END, 6) AS score FROM (SELECT doc_id, rel_path, {_SCORE} AS s, {_hits('m', TARGET)} AS t FROM (SELECT doc_id, rel_path, {norm('text')} AS m FROM documents WHERE text <> '')) d JOIN ({QUALITY}) USING (doc_id) WHERE s > 0 AND t > 0 ORDER BY score DESC, rel_path, doc_id LIMIT 40",
    "lexical_search": f"SELECT sentence_id, CAST({_SHARED} + {4 * len(REQUIRED)} AS DOUBLE) AS score FROM (SELECT sentence_id, {toks('text')} AS k, {norm('text')} AS m FROM ({_SENT})) WHERE {_ALL} ORDER BY score DESC, sentence_id LIMIT 20",
    "token_rows": f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({toks('text')}) AS token FROM documents) GROUP BY 1, 2",
    "token_postings": f"SELECT token, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({toks('text')}) AS token FROM documents) GROUP BY 1, 2) GROUP BY token ORDER BY documents DESC, token LIMIT 100",
    "neighbour_window": f"SELECT c.document_id, CAST(c.chunk_order AS BIGINT) AS chunk_order, c.chunk_id, CAST(min(abs(c.chunk_order - h.chunk_order)) AS BIGINT) AS distance FROM ({_CH}) c JOIN ({_CH}) h ON c.document_id = h.document_id AND abs(c.chunk_order - h.chunk_order) <= 4 AND contains(lower(h.text), 'parcel cage') GROUP BY 1, 2, 3",
    "metadata_prior": f"SELECT doc_id, rel_path, 4 * {_hits(norm('rel_path'), ['notes', 'logs', 'claims'])} AS score FROM documents WHERE {_hits(norm('rel_path'), ['notes', 'logs', 'claims'])} > 0 ORDER BY score DESC, rel_path, doc_id LIMIT 8",
    "bind_relations": f"SELECT doc_id, value, score, count(*) AS n FROM (SELECT doc_id, value, round((4 * {_hits('m', ['status'])} + 3 * {_hits('m', ['sealed', 'blocked'])} + 1) * 0.84, 6) AS score FROM (SELECT *, {_MATCH} AS m FROM (SELECT *, 'key_value' AS predicate FROM ({PAIRS}))) WHERE {_hits('m', ['status'])} > 0 AND {_hits('m', ['sealed', 'blocked'])} > 0) GROUP BY 1, 2, 3",
    "choose_answer": f"SELECT question, answer, {TYPE} AS answer_type, score, support FROM ({_CHOSEN})",
    "list_answer": f"SELECT question, string_agg(canonical, '; ' ORDER BY canonical) AS answer, count(*) AS n FROM (SELECT DISTINCT question, canonical FROM ({_cand('owner')})) GROUP BY question",
    "count_groups": f"SELECT count(*) AS n FROM (SELECT doc_id, line, record_group FROM ({_GROUPED}) GROUP BY 1, 2, 3 HAVING bool_or({norm('subject')} = 'item' AND {norm('value')} = 'the gate') AND bool_or({norm('subject')} = 'status' AND {norm('value')} = 'sealed'))",
    "ambiguous_users": "SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS dates, count(DISTINCT event_type) AS \"values\" FROM events GROUP BY user_id HAVING dates >= 2 AND count(DISTINCT event_type) >= 2",
}
