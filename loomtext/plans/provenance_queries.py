"""Queries of the provenance graph's tables and of term functions over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import terms
from loomtext.functions.text import normalize, quality_class, quality_counts, tokens
from loomtext.operators import contexts as C
from loomtext.operators import provenance as P
from loomtext.operators.relations import object_relations
from loomtext.operators.units import placed_units
from loomtext.plans.sqltext import ANCHORED, ARGUMENTS, CLASS, FRAMES, GROUPED, MENTIONED, PAIRS, QUALITY, RELATIONS, STRUCTURE, UNITS, clean, norm, predicate_norm, sid, toks, variants
from loomtext.runtime import durable, table


def units(spark, d):
    return placed_units(table(spark, d, "documents"))


def relations(spark, d):
    return P.unit_relations(units(spark, d))


def _sheet_lines(spark, d):
    """The lines of the sensor sheets as units, each of its own."""
    m = table(spark, d, "measurements").where("c0 <> ''")
    return m.select(F.col("row_id").alias("doc_id"), F.lit(0).alias("unit_order"), F.lit(0).alias("char_start"), F.col("c0").alias("text"))


def anchors(spark, d):
    return P.anchored(P.structure(units(spark, d), relations(spark, d)))


def _long(df, *names):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in ("unit_order", "char_start", "char_end", "frame_no", "hops") else c for c in names])


def _unit_offsets(spark, d):
    u = units(spark, d)
    return u.select("doc_id", F.col("unit_order").cast("bigint").alias("unit_order"), F.col("char_start").cast("bigint").alias("char_start"), F.col("char_end").cast("bigint").alias("char_end"), F.md5("text").alias("text_md5"), F.greatest(F.lit(1), F.size(tokens(F.col("text")))).cast("bigint").alias("token_estimate"))


def _structural(spark, d):
    s = P.structure(units(spark, d), relations(spark, d))
    return _long(s, "doc_id", "unit_order", "is_heading", "starts_record", "inherits", "label_heading")


def _frames(spark, d):
    return P.frames(relations(spark, d))


def _identity(spark, d):
    return P.self_identity(P.mention_rows(units(spark, d)), P.frame_arguments(_frames(spark, d)))


def _closure(spark, d):
    """All referents within three steps of same-surface identity, from every referent that has any."""
    e = durable(_identity(spark, d).select("left_id", "right_id").distinct())  # seeds and edges come from the same rows
    return P.closure(e.select(F.col("left_id").alias("seed")), e).select("seed", "node", F.col("hops").cast("bigint").alias("hops"))


def _surface_members(spark, d):
    """(surface, representative, doc_id): every document that names an identifier which others name as well."""
    m = P.mention_rows(units(spark, d)).where("entity_type = 'identifier'").select("surface", "doc_id").distinct()
    first = m.groupBy("surface").agg(F.min("doc_id").alias("representative"), F.count("*").alias("n")).where("n > 1").drop("n")
    return m.join(first, "surface")


def _variant_rows(spark, d):
    k = table(spark, d, "documents").select(F.explode(tokens(F.col("text"))).alias("token")).distinct()
    return k.select("token", F.array_join(terms.stems(F.col("token")), " ").alias("variants"))


def _pair_values(spark, d):
    return object_relations(table(spark, d, "documents")).select("subject", "value")


def _runs(spark, d):
    """Each run with what it has read; runs that read nothing stay."""
    own = table(spark, d, "documents").groupBy("run_id").agg(F.count("*").alias("documents"), F.count_distinct("rel_path").alias("paths"), F.sum("n_chars").alias("characters"))
    runs = table(spark, d, "extraction_runs").select("run_id", "status")
    return runs.join(own, "run_id", "left").select("run_id", "status", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("paths", F.lit(0)).alias("paths"), "characters")


def _context_access(spark, d):
    """Which documents' contexts may speak where mails are required, by class of quality."""
    q = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "source", "text", tokens(F.col("text")).alias("__k"))
    q = q.withColumns(quality_counts(F.col("text"), F.col("__k"))).select("source", quality_class().alias("quality"))
    link = lambda kind, holder: F.struct(kind.alias("kind"), holder.alias("holder"), F.lit("").alias("evidence"))
    chain = F.array(link(F.lit("asserted"), F.lit("")), link(F.concat(F.lit("quality:"), "quality"), F.lit("")), link(F.lit("source"), F.coalesce("source", F.lit(""))))
    none = F.array().cast("array<string>")
    ok = C.accessible(chain, F.array(F.lit("mail_gateway")), none, F.lit("state"), F.lit(False))
    return q.groupBy("quality", ok.alias("accessible")).agg(F.count("*").alias("n"))


QUERIES = {
    "run_metrics": _runs,
    "context_access": _context_access,
    "unit_offsets": _unit_offsets,
    "mention_spans": lambda spark, d: _long(P.mention_rows(units(spark, d)), "doc_id", "unit_order", "surface", "entity_type", "char_start", "char_end"),
    "mention_types": lambda spark, d: P.mention_rows(units(spark, d)).groupBy("entity_type").agg(F.count("*").alias("n"), F.count_distinct("surface").alias("surfaces")),
    "graph_referents": lambda spark, d: P.first_referents(P.mention_rows(units(spark, d))).select("label_norm", "entity_type", "first_doc", "mentions", "referent_id"),
    "typed_relations": lambda spark, d: _long(relations(spark, d), "doc_id", "unit_order", "relation_type", "predicate", "subject", "value", "confidence", "record_group"),
    "structural_units": _structural,
    "section_carry": lambda spark, d: _long(anchors(spark, d).where("section_anchor IS NOT NULL"), "doc_id", "unit_order", "section_anchor"),
    "relation_groups": lambda spark, d: _long(P.grouped_relations(relations(spark, d), anchors(spark, d)), "doc_id", "unit_order", "relation_id", "relation_type", "record_group", "section_anchor"),
    "frames_capped": lambda spark, d: _long(_frames(spark, d), "doc_id", "unit_order", "frame_no", "frame_id", "predicate"),
    "frame_arguments": lambda spark, d: _long(P.frame_arguments(_frames(spark, d)), "doc_id", "unit_order", "frame_id", "role", "surface", "value_type", "referent_id"),
    "self_identity": lambda spark, d: _long(_identity(spark, d), "doc_id", "unit_order", "surface_norm", "left_id", "right_id"),
    "identity_closure3": _closure,
    "surface_members": _surface_members,
    "temporal_edges": lambda spark, d: _long(P.temporal_edges(P.unit_relations(_sheet_lines(spark, d))), "doc_id", "unit_order", "relation", "temporal_value", "state_value", "confidence"),
    "quality_contexts": lambda spark, d: P.quality_contexts(table(spark, d, "documents")),
    "context_carriers": lambda spark, d: P.carriers(table(spark, d, "documents"), units(spark, d)).groupBy("carrier_kind", "doc_id").agg(F.count("*").alias("n"), F.max("carrier_surface").alias("surface"), F.max("temporal_value").alias("temporal_value")),
    "context_assignments": lambda spark, d: P.assignments(units(spark, d)).groupBy("doc_id", "applies_to", "context").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence")),
    "json_paths": lambda spark, d: table(spark, d, "documents").select("doc_id", F.explode(P.flatten_json(F.col("metadata_json"))).alias("p")).select("doc_id", "p.path", "p.value"),
    "term_variants": _variant_rows,
    "predicate_norms": lambda spark, d: _pair_values(spark, d).groupBy("subject").agg(F.count("*").alias("n")).select("subject", terms.predicate_norm(F.col("subject")).alias("predicate"), "n"),
    "temporal_scopes": lambda spark, d: table(spark, d, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("token")).select("doc_id", terms.scope_of(F.col("token")).alias("scope")).where("scope IN ('latest', 'earliest')").groupBy("doc_id", "scope").agg(F.count("*").alias("n")),
    "confidences": lambda spark, d: _pair_values(spark, d).select(terms.confidence_of(F.col("value")).alias("confidence")).groupBy("confidence").agg(F.count("*").alias("n")),
    "char_token_estimates": lambda spark, d: table(spark, d, "chunks").select("chunk_id", terms.char_tokens(F.col("text")).cast("bigint").alias("tokens")).distinct(),
    "times_iso": lambda spark, d: table(spark, d, "documents").select("doc_id", terms.iso_utc(F.unix_micros(F.col("mtime").cast("timestamp")) / 1_000_000).alias("modified")),
    "answer_part_rows": lambda spark, d: P.unit_relations(units(spark, d)).where("value <> ''").select(F.explode(terms.answer_parts(F.col("value"))).alias("part")).groupBy("part").agg(F.count("*").alias("n")),
    "token_sets": lambda spark, d: P.mention_rows(units(spark, d)).select("surface").distinct().select("surface", F.array_join(terms.token_set(F.col("surface")), " ").alias("parts")),
}

_SCOPE = "CASE WHEN token IN ('current', 'currently', 'latest', 'most_recent', 'recent', 'final', 'last') THEN 'latest' WHEN token IN ('earliest', 'oldest', 'first', 'initial') THEN 'earliest' END"
_CONF = f"CASE {norm('value')} WHEN 'very high' THEN 0.95 WHEN 'high' THEN 0.85 WHEN 'medium' THEN 0.65 WHEN 'moderate' THEN 0.65 WHEN 'low' THEN 0.35 WHEN 'very low' THEN 0.15 ELSE CASE WHEN try_cast({norm('value')} AS DOUBLE) IS NULL THEN 0.65 ELSE least(1.0, greatest(0.0, try_cast({norm('value')} AS DOUBLE))) END END"
_IDENT = f"SELECT DISTINCT m.doc_id, m.unit_order, m.n AS surface_norm, m.ref AS left_id, a.referent_id AS right_id FROM (SELECT doc_id, unit_order, {norm('surface')} AS n, {sid('ref', norm('surface'), 'entity_type')} AS ref FROM ({MENTIONED})) m JOIN (SELECT *, {norm('surface')} AS n FROM ({ARGUMENTS})) a ON m.doc_id = a.doc_id AND m.unit_order = a.unit_order AND m.n = a.n WHERE m.ref <> a.referent_id"
_LINES = "SELECT row_id AS doc_id, CAST(0 AS BIGINT) AS unit_order, 0 AS char_start, c0 AS text FROM measurements WHERE c0 <> ''"
_TIMES = f"""WITH r AS MATERIALIZED (SELECT * FROM ({RELATIONS.replace(UNITS, _LINES)})), s AS (SELECT doc_id, unit_order, count(*) FILTER (relation_type = 'temporal') AS t, count(*) FILTER (relation_type <> 'temporal' AND value <> '') AS o FROM r GROUP BY ALL)
SELECT r.doc_id, r.unit_order, CASE WHEN r.subject <> '' THEN r.subject ELSE r.predicate END AS relation, x.value AS temporal_value, r.value AS state_value, least(0.9, r.confidence) AS confidence
FROM r JOIN s ON r.doc_id = s.doc_id AND r.unit_order = s.unit_order AND t BETWEEN 1 AND 8 AND t * o <= 64 JOIN r x ON x.doc_id = r.doc_id AND x.unit_order = r.unit_order AND x.relation_type = 'temporal' WHERE r.relation_type <> 'temporal' AND r.value <> ''"""
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"
SQL = {
    "run_metrics": "SELECT r.run_id, r.status, count(d.doc_id) AS documents, count(DISTINCT d.rel_path) AS paths, CAST(sum(d.n_chars) AS BIGINT) AS characters FROM extraction_runs r LEFT JOIN documents d ON d.run_id = r.run_id GROUP BY 1, 2",
    "context_access": f"SELECT {CLASS} AS quality, contains(lower(coalesce(source, '')), 'mail_gateway') AS accessible, count(*) AS n FROM ({QUALITY}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY 1, 2",
    "unit_offsets": f"SELECT doc_id, unit_order, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, md5(text) AS text_md5, greatest(1, len({toks('text')})) AS token_estimate FROM ({UNITS})",
    "mention_spans": f"SELECT doc_id, unit_order, surface, entity_type, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end FROM ({MENTIONED})",
    "mention_types": f"SELECT entity_type, count(*) AS n, count(DISTINCT surface) AS surfaces FROM ({MENTIONED}) GROUP BY 1",
    "graph_referents": f"SELECT {norm('surface')} AS label_norm, entity_type, min(doc_id) AS first_doc, count(*) AS mentions, {sid('ref', norm('any_value(surface)'), 'entity_type')} AS referent_id FROM ({MENTIONED}) GROUP BY 1, 2",
    "typed_relations": f"SELECT doc_id, unit_order, relation_type, predicate, subject, value, confidence, record_group FROM ({RELATIONS})",
    "structural_units": f"SELECT doc_id, unit_order, is_heading, starts_record, inherits, label_heading FROM ({STRUCTURE})",
    "section_carry": f"SELECT doc_id, unit_order, section_anchor FROM ({ANCHORED}) WHERE section_anchor IS NOT NULL",
    "relation_groups": f"SELECT doc_id, unit_order, relation_id, relation_type, record_group, section_anchor FROM ({GROUPED})",
    "frames_capped": f"SELECT doc_id, unit_order, frame_no, frame_id, predicate FROM ({FRAMES})",
    "frame_arguments": ARGUMENTS,
    "self_identity": _IDENT,
    "identity_closure3": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT left_id, right_id FROM ({_IDENT})), b AS (SELECT left_id AS a, right_id AS b FROM e UNION SELECT right_id, left_id FROM e),
      c AS (SELECT DISTINCT left_id AS seed, left_id AS node, 0 AS hops FROM e UNION SELECT c.seed, b.b, c.hops + 1 FROM c JOIN b ON c.node = b.a WHERE c.hops < 3) SELECT seed, node, CAST(min(hops) AS BIGINT) AS hops FROM c GROUP BY 1, 2""",
    "surface_members": f"WITH m AS MATERIALIZED (SELECT DISTINCT surface, doc_id FROM ({MENTIONED}) WHERE entity_type = 'identifier') SELECT m.surface, m.doc_id, f.representative FROM m JOIN (SELECT surface, min(doc_id) AS representative FROM m GROUP BY 1 HAVING count(*) > 1) f ON m.surface = f.surface",
    "temporal_edges": _TIMES,
    "quality_contexts": f"SELECT kind, holder, documents, {sid('ctx', 'kind')} AS context_id FROM (SELECT 'quality:' || {CLASS} AS kind, min(doc_id) AS holder, count(*) AS documents FROM ({QUALITY}) GROUP BY 1)",
    "context_carriers": f"""SELECT 'source_quality' AS carrier_kind, doc_id, 1 AS n, {CLASS} AS surface, NULL AS temporal_value FROM ({QUALITY})
      UNION ALL SELECT 'filesystem_time', doc_id, (mtime IS NOT NULL)::BIGINT + (ctime IS NOT NULL)::BIGINT, CASE WHEN mtime IS NOT NULL THEN 'mtime' ELSE 'ctime' END, greatest({_ISO.format('mtime')}, {_ISO.format('ctime')}) FROM documents WHERE text IS NOT NULL AND (mtime IS NOT NULL OR ctime IS NOT NULL)
      UNION ALL SELECT 'sentence_context', doc_id, count(*), 'asserted', NULL FROM ({UNITS}) GROUP BY doc_id""",
    "context_assignments": f"SELECT doc_id, applies_to, 'asserted' AS context, count(*) AS n, CAST(0.9 AS DOUBLE) AS confidence FROM (SELECT doc_id, unnest(['chunk', 'source_span']) AS applies_to FROM ({UNITS})) GROUP BY 1, 2",
    "json_paths": "SELECT doc_id, regexp_replace(regexp_replace(substring(t.fullkey, 3), '\\[([0-9]+)\\]', '.\\1', 'g'), '\"', '', 'g') AS path, CASE t.type WHEN 'NULL' THEN 'null' ELSE t.atom ->> '$' END AS value FROM documents, json_tree(CASE WHEN json_valid(metadata_json) THEN metadata_json END) t WHERE t.type NOT IN ('OBJECT', 'ARRAY') AND coalesce(t.atom ->> '$', 'null') <> ''",
    "term_variants": f"SELECT token, array_to_string({variants('token')}, ' ') AS variants FROM (SELECT DISTINCT unnest({toks('text')}) AS token FROM documents)",
    "predicate_norms": f"SELECT subject, {predicate_norm('subject')} AS predicate, n FROM (SELECT subject, count(*) AS n FROM ({PAIRS}) GROUP BY 1)",
    "temporal_scopes": f"SELECT doc_id, scope, count(*) AS n FROM (SELECT doc_id, {_SCOPE} AS scope FROM (SELECT doc_id, unnest({toks('text')}) AS token FROM documents)) WHERE scope IS NOT NULL GROUP BY 1, 2",
    "confidences": f"SELECT CAST({_CONF} AS DOUBLE) AS confidence, count(*) AS n FROM ({PAIRS}) GROUP BY 1",
    "char_token_estimates": "SELECT DISTINCT chunk_id, CAST(greatest(1, ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM chunks",
    "times_iso": f"SELECT doc_id, {_ISO.format('mtime')} AS modified FROM documents",
    "answer_part_rows": f"SELECT part, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(string_split({clean('value')}, ';'), lambda p: {clean('p')}), lambda p: p <> '')) AS part FROM ({RELATIONS})) GROUP BY 1",
    "token_sets": f"SELECT surface, array_to_string(list_sort(list_distinct(list_filter(string_split_regex({norm('surface')}, '[^a-z0-9]+'), lambda p: p <> ''))), ' ') AS parts FROM (SELECT DISTINCT surface FROM ({MENTIONED}))",
}
