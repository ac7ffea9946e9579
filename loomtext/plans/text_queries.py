"""Queries of text functions and surface extraction, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import extract as X
from loomtext.functions import text as T
from loomtext.operators import relations as R
from loomtext.operators.units import lines, units
from loomtext.plans.sqltext import X as SX
from loomtext.plans.sqltext import CELLS, CLASS, FULL_LINES, LABELS, NOISE, PAIRS, QUALITY, STOP, TYPE, WS, every, norm, q, toks
from loomtext.runtime import table


def docs(spark, d):
    return table(spark, d, "documents")


def _unit_sizes(u):
    return u.groupBy("doc_id").agg(F.count("*").alias("n_units"), F.sum(F.length("text")).alias("unit_chars"))


def _tokens(spark, d):
    k = docs(spark, d).where("text IS NOT NULL").select("doc_id", T.tokens(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("k")).cast("bigint").alias("n_distinct"), F.size(T.content(F.col("k"))).cast("bigint").alias("n_content"))


def _top_tokens(spark, d):
    k = docs(spark, d).select(F.explode(T.content(T.tokens(F.col("text")))).alias("token"))
    return k.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(50)


def _quality(spark, d):
    x = docs(spark, d).where("text IS NOT NULL").select("doc_id", "text", T.tokens(F.col("text")).alias("k"))
    return x.select("doc_id", *[c.alias(n) for n, c in T.quality_counts(F.col("text"), F.col("k")).items()])


def _values(values, name):
    return lambda spark, d: docs(spark, d).select("doc_id", F.explode(values(F.col("text"))).alias(name)).groupBy("doc_id", name).agg(F.count("*").alias("n"))


def _families(spark, d):
    count = lambda p: F.size(X.all_of(F.col("text"), p)).cast("bigint")
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", count(X.LOWER_ID).alias("lower_ids"), count(X.EMAIL).alias("emails"), count(X.FILE_LIKE).alias("file_like"))


def _phrases(spark, d):
    return lines(docs(spark, d)).select(F.explode(X.all_of(F.col("text"), X.PHRASE)).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(100)


def _phrase_rows(spark, d):
    return lines(docs(spark, d)).select("doc_id", F.explode(X.all_of(F.col("text"), X.PHRASE)).alias("phrase")).groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))


def _stamps(spark, d):
    return table(spark, d, "measurements").select(F.explode(X.timestamps(F.col("c0"))).alias("stamp")).groupBy("stamp").agg(F.count("*").alias("n"))


def _grouped(relations):
    return relations.groupBy("doc_id", "subject", "value").agg(F.count("*").alias("n"))


QUERIES = {
    "units_split": lambda spark, d: _unit_sizes(units(docs(spark, d))),
    "units_windowed": lambda spark, d: _unit_sizes(units(docs(spark, d), 4_000)),
    "token_counts": _tokens,
    "content_token_top": _top_tokens,
    "quality_metrics": _quality,
    "quality_class": lambda spark, d: _quality(spark, d).groupBy(T.quality_class().alias("quality")).agg(F.count("*").alias("n")),
    "noise_docs": lambda spark, d: _quality(spark, d).where(T.low_semantic_noise()).select("doc_id"),
    "stable_ids": lambda spark, d: docs(spark, d).select("doc_id", T.stable_id("doc", F.col("rel_path"), F.col("doc_id"), F.col("run_id")).alias("stable_id")),
    "normalized_titles": lambda spark, d: docs(spark, d).select(T.normalize(F.get_json_object("metadata_json", "$.title")).alias("title")).groupBy("title").agg(F.count("*").alias("n")),
    "url_extract": _values(X.urls, "url"),
    "identifier_extract": _values(lambda t: X.all_of(t, X.PREFIX_ID), "identifier"),
    "identifier_families": _families,
    "phrase_extract": _phrases,
    "phrase_rows": _phrase_rows,
    "timestamps_rel": _stamps,
    "label_values": lambda spark, d: _grouped(R.label_relations(docs(spark, d))),
    "object_pairs": lambda spark, d: _grouped(R.object_relations(docs(spark, d))),
    "json_pairs": lambda spark, d: table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")),
    "table_cells": lambda spark, d: R.cell_relations(docs(spark, d)).select("doc_id", F.col("line").cast("bigint").alias("line"), F.col("item").cast("bigint").alias("item"), "subject", "value"),
    "header_cells": lambda spark, d: R.header_relations(docs(spark, d)),
    "relation_dedupe": lambda spark, d: R.dedupe(R.label_relations(docs(spark, d))).select("doc_id", F.col("line").cast("bigint").alias("line"), F.col("item").cast("bigint").alias("item"), "subject", "value"),
    "classify_values": lambda spark, d: R.object_relations(docs(spark, d)).groupBy("subject", X.value_type(F.col("value")).alias("value_type")).agg(F.count("*").alias("n")),
}
_T = "(Dr|Ms|Mr|Mrs|Prof)"
SQL = {
    "units_split": f"""WITH u AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(regexp_replace(trim(text, {WS}), '(^|[^A-Za-z0-9_]){_T}\\.', '\\1\\2' || chr(2), 'g'), '([.!?])[ \\t\\n\\r]+', '\\1' || chr(10), 'g'), '\\n+')) AS p FROM documents WHERE text <> ''),
      v AS (SELECT doc_id, trim(replace(p, chr(2), '.'), {WS}) AS t FROM u) SELECT doc_id, count(*) AS n_units, CAST(sum(length(t)) AS BIGINT) AS unit_chars FROM v WHERE t <> '' GROUP BY doc_id""",
    "token_counts": f"SELECT doc_id, len(k) AS n_tokens, len(list_distinct(k)) AS n_distinct, len(list_filter(k, lambda t: length(t) > 2 AND t NOT IN {STOP})) AS n_content FROM (SELECT doc_id, {toks('text')} AS k FROM documents WHERE text IS NOT NULL)",
    "content_token_top": f"SELECT token, count(*) AS n FROM (SELECT unnest({toks('text')}) AS token FROM documents) WHERE length(token) > 2 AND token NOT IN {STOP} GROUP BY token ORDER BY n DESC, token LIMIT 50",
    "quality_metrics": QUALITY,
    "quality_class": f"SELECT {CLASS} AS quality, count(*) AS n FROM ({QUALITY}) GROUP BY 1",
    "noise_docs": f"SELECT doc_id FROM ({QUALITY}) WHERE {NOISE}",
    "stable_ids": "SELECT doc_id, 'doc_' || substring(sha256(coalesce(rel_path, 'None') || chr(31) || doc_id || chr(31) || coalesce(run_id, 'None')), 1, 24) AS stable_id FROM documents",
    "normalized_titles": f"SELECT {norm(chr(106) + '')} AS title, count(*) AS n FROM (SELECT json_extract_string(metadata_json, '$.title') AS j FROM documents) GROUP BY 1",
    "url_extract": f"SELECT doc_id, rtrim(u, '.') AS url, count(*) AS n FROM (SELECT doc_id, unnest({every('text', SX.URL)}) AS u FROM documents) GROUP BY 1, 2",
    "identifier_extract": f"SELECT doc_id, identifier, count(*) AS n FROM (SELECT doc_id, unnest({every('text', SX.PREFIX_ID)}) AS identifier FROM documents) GROUP BY 1, 2",
    "identifier_families": f"SELECT doc_id, len({every('text', SX.LOWER_ID)}) AS lower_ids, len({every('text', SX.EMAIL)}) AS emails, len({every('text', SX.FILE_LIKE)}) AS file_like FROM documents WHERE text IS NOT NULL",
    "phrase_extract": f"SELECT phrase, count(*) AS n FROM (SELECT unnest({every('text', SX.PHRASE)}) AS phrase FROM ({FULL_LINES})) GROUP BY 1 ORDER BY n DESC, phrase LIMIT 100",
    "phrase_rows": f"SELECT doc_id, phrase, count(*) AS n FROM (SELECT doc_id, unnest({every('text', SX.PHRASE)}) AS phrase FROM ({FULL_LINES})) GROUP BY 1, 2",
    "timestamps_rel": f"SELECT stamp, count(*) AS n FROM (SELECT unnest({every('c0', SX.TIMESTAMP)}) AS stamp FROM measurements) GROUP BY 1",
    "label_values": f"SELECT doc_id, subject, value, count(*) AS n FROM ({LABELS}) GROUP BY 1, 2, 3",
    "object_pairs": f"SELECT doc_id, subject, value, count(*) AS n FROM ({PAIRS}) GROUP BY 1, 2, 3",
    "json_pairs": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "table_cells": f"SELECT doc_id, line, k - 1 AS item, first AS subject, value FROM (SELECT doc_id, line, cells[1] AS first, generate_subscripts(cells, 1) AS k, unnest(cells) AS value FROM ({CELLS}) WHERE len(cells) >= 2) WHERE k > 1",
    "relation_dedupe": f"SELECT doc_id, line, item, subject, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {norm('subject')}, {norm('value')} ORDER BY line, item) AS rn FROM ({LABELS})) WHERE rn = 1",
    "classify_values": f"SELECT subject, {TYPE} AS value_type, count(*) AS n FROM ({PAIRS}) GROUP BY 1, 2",
}
