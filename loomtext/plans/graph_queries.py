"""Queries of the provenance graph: contexts, referents, integrity, chains, time, streams; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomtext.functions import extract as X
from loomtext.functions.text import normalize, token_estimate
from loomtext.operators import binding, graph
from loomtext.operators.ranking import is_heading, section_anchor
from loomtext.operators.units import lines
from loomtext.plans.sqltext import X as SX
from loomtext.plans.sqltext import FULL_LINES, every, heading, norm, toks
from loomtext.runtime import checkpoint_dir, table
from loomtext.streaming.ingest import stream_units, windowed_counts

TABLES = ("documents", "chunks", "sentences", "shipping", "measurements", "extraction_runs")


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _counts(spark, d):
    return _union([table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in TABLES])


LINKS = (("chunks", "document_id", "documents", "document_id"), ("sentences", "document_id", "documents", "document_id"), ("documents", "run_id", "extraction_runs", "run_id"))


def _integrity(spark, d):
    return _union([graph.orphans(table(spark, d, a), table(spark, d, b), k, to).select(F.lit(f"{a}.{k}").alias("link"), "orphans") for a, k, b, to in LINKS])


def _referents(spark, d):
    return graph.referents(graph.mentions(table(spark, d, "documents"))).select("label_norm", "entity_type", "first_doc", "mentions", "documents", "referent_id")


def _same_surface(spark, d):
    """Identifiers that several documents name: each with its class's first document, one row per document."""
    m = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(X.all_of(F.col("text"), X.PREFIX_ID))).alias("surface"))
    cls = m.groupBy("surface").agg(F.min("doc_id").alias("representative"), F.count("*").alias("n")).where("n > 1")
    return m.join(cls, "surface").groupBy("doc_id").agg(F.count("*").alias("links"), F.min("representative").alias("representative"))


def _edges(spark, d):
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.concat(F.lit("c"), "o_custkey").alias("parent"))
    return r.unionByName(n).unionByName(c).unionByName(o)


def _anchors(spark, d):
    rows = section_anchor(lines(table(spark, d, "documents")), is_heading(F.col("text")))
    return rows.where("anchor IS NOT NULL").groupBy("doc_id", "anchor").agg(F.count("*").alias("n_lines"))


def _state(latest):
    def run(spark, d):
        e = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "event_id", "event_type")
        return binding.by_time(e, "user_id", "at", "event_id", latest).select("user_id", "event_id", "event_type")

    return run


def _capped(spark, d):
    """At most eight times of each line, in their order; a line is the unit that the cap is for."""
    s = table(spark, d, "measurements").select("rel_path", "row_id", F.posexplode(F.slice(X.timestamps(F.col("c0")), 1, 8)).alias("n", "stamp"))
    return s.select("rel_path", "row_id", "stamp")


def _stream(spark, d):
    at = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    folder = f"{d}/documents.parquet"
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)).isDirectory():
        folder = f"{d}/document[s].parquet"  # a stream reads folders and patterns
    out = stream_units(spark, folder, spark.read.parquet(folder).schema, f"{at}/out", f"{at}/state")
    return out.groupBy("doc_id").agg(F.count("*").alias("n_units"))


QUERIES = {
    "table_counts": _counts,
    "integrity_fk": _integrity,
    "referents_dedupe": _referents,
    "source_contexts": lambda spark, d: graph.contexts(table(spark, d, "documents")),
    "identity_same_surface": _same_surface,
    "context_chain": lambda spark, d: graph.chains(_edges(spark, d)),
    "doc_metadata_melt": lambda spark, d: graph.melt(table(spark, d, "documents")),
    "chunk_token_estimates": lambda spark, d: table(spark, d, "chunks").distinct().groupBy("document_id").agg(F.sum(token_estimate(F.col("text"))).cast("bigint").alias("tokens"), F.count("*").alias("n_chunks")),
    "section_anchor": _anchors,
    "state_latest": _state(True),
    "state_earliest": _state(False),
    "temporal_capped": _capped,
    "event_windows": lambda spark, d: windowed_counts(table(spark, d, "events")),
    "stream_ingest": _stream,
}
_MENTIONS = f"""SELECT DISTINCT doc_id, line, surface, entity_type FROM (
  SELECT doc_id, line, rtrim(unnest({every('text', SX.URL)}), '.') AS surface, 'url' AS entity_type FROM ({FULL_LINES})
  UNION ALL SELECT doc_id, line, unnest({every('text', SX.PREFIX_ID)}), 'identifier' FROM ({FULL_LINES})
  UNION ALL SELECT doc_id, line, unnest({every('text', SX.PHRASE)}), 'name' FROM ({FULL_LINES}))"""
_IDS = f"SELECT DISTINCT doc_id, surface FROM (SELECT doc_id, unnest({every('text', SX.PREFIX_ID)}) AS surface FROM documents)"
_EDGES = """SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders"""
_HEADING = heading("text")
_KEYS = ("file_name", "stem", "suffix", "parent_rel_path", "directory_depth", "encoding", "decode_errors", "mime_type", "title", "author", "line_count", "word_count")
_STATE = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts {0}, event_id) AS rn FROM events) WHERE rn = 1"
SQL = {
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES),
    "integrity_fk": " UNION ALL ".join(f"SELECT '{a}.{k}' AS link, count(*) AS orphans FROM {a} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {to} FROM {b} WHERE {to} IS NOT NULL)" for a, k, b, to in LINKS),
    "referents_dedupe": f"SELECT *, 'ref_' || substring(sha256(label_norm || chr(31) || entity_type), 1, 24) AS referent_id FROM (SELECT {norm('surface')} AS label_norm, entity_type, min(doc_id) AS first_doc, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM ({_MENTIONS}) GROUP BY 1, 2)",
    "source_contexts": "SELECT source, min(doc_id) AS holder, count(*) AS carriers, 'ctx_' || substring(sha256(coalesce(source, 'None')), 1, 24) AS context_id FROM documents GROUP BY source",
    "identity_same_surface": f"SELECT i.doc_id, count(*) AS links, min(c.representative) AS representative FROM ({_IDS}) i JOIN (SELECT surface, min(doc_id) AS representative FROM ({_IDS}) GROUP BY surface HAVING count(*) > 1) c ON i.surface = c.surface GROUP BY i.doc_id",
    "context_chain": f"WITH RECURSIVE e AS ({_EDGES}), c AS (SELECT node, parent AS ancestor, 1 AS distance FROM e WHERE parent IS NOT NULL UNION ALL SELECT c.node, e.parent, distance + 1 FROM c JOIN e ON c.ancestor = e.node WHERE e.parent IS NOT NULL) SELECT * FROM c",
    "doc_metadata_melt": " UNION ALL ".join([f"SELECT doc_id, '{k}' AS key, CAST({k} AS VARCHAR) AS value, 'filesystem' AS source FROM documents WHERE CAST({k} AS VARCHAR) <> ''" for k in ("rel_path", "size_bytes", "source")] + [f"SELECT doc_id, '{k}', json_extract_string(metadata_json, '$.{k}'), 'analysis' FROM documents WHERE json_extract_string(metadata_json, '$.{k}') <> ''" for k in _KEYS]),
    "chunk_token_estimates": f"SELECT document_id, CAST(sum(greatest(1, len({toks('text')}))) AS BIGINT) AS tokens, count(*) AS n_chunks FROM (SELECT DISTINCT * FROM chunks) GROUP BY document_id",
    "section_anchor": f"SELECT doc_id, anchor, count(*) AS n_lines FROM (SELECT doc_id, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor FROM (SELECT *, CASE WHEN {_HEADING} THEN text END AS h FROM (SELECT *, trim(text, chr(32) || chr(9) || chr(13)) AS t FROM ({FULL_LINES})))) WHERE anchor IS NOT NULL GROUP BY 1, 2",
    "state_latest": _STATE.format("DESC"),
    "state_earliest": _STATE.format("ASC"),
    "temporal_capped": f"SELECT rel_path, row_id, stamp FROM (SELECT rel_path, row_id, generate_subscripts(a, 1) AS n, unnest(a) AS stamp FROM (SELECT rel_path, row_id, {every('c0', SX.TIMESTAMP)} AS a FROM measurements)) WHERE n <= 8",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
