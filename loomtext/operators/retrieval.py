"""Retrieval over units and the graph's tables: conjunctive and fused search, chunk ranking, candidates by referent, frame
and relation, windows of evidence.

Terms come from a question and are few; scores are Column expressions before any shuffle, and only the best rows are
sorted, under a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import content, low_semantic_noise, normalize, quality_counts, tokens
from loomtext.operators.ranking import hits

PLACE = ("doc_id", "unit_order")


def all_containing(units: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, unit_order) of the units whose normalised text holds every term; without terms none."""
    m, ok = normalize(F.col("text")), F.lit(bool(terms))
    for t in terms:
        ok = ok & m.contains(t)
    return units.where(ok).select(*PLACE)


def noisy(documents: DataFrame) -> DataFrame:
    """(doc_id, low_priority) of every document with a text."""
    d = documents.where("text IS NOT NULL AND text <> ''").select("doc_id", "text", tokens(F.col("text")).alias("__k"))
    return d.withColumns(quality_counts(F.col("text"), F.col("__k"))).select("doc_id", low_semantic_noise().alias("low_priority"))


def rank_chunks(units: DataFrame, documents: DataFrame, target: list[str], relation: list[str], lexical: list[str], reach: int = 4, limit: int = 160) -> DataFrame:
    """The units of ``documents`` (doc_id, rel_path, low_priority, has_target) in the order in which they are looked at.

    22 a target term, 11 a relation term, 2 a lexical one, 12 where the document has a target and the unit a relation
    term, 0.15 of it in documents of low priority.  The best ``limit`` units bring their neighbours up to ``reach``
    places away, each at its least distance; of all these the best ``limit`` stay."""
    u = units.join(documents, "doc_id").withColumn("__m", normalize(F.col("text")))
    r = hits(F.col("__m"), relation)
    score = 22 * hits(F.col("__m"), target) + 11 * r + 2 * hits(F.col("__m"), lexical) + F.when(F.col("has_target") & (r > 0), 12).otherwise(0)
    scored = u.select(*PLACE, "rel_path", F.round(score * F.when(F.col("low_priority"), 0.15).otherwise(1.0), 6).alias("score"))
    top = scored.where("score > 0").orderBy(F.desc("score"), "rel_path", *PLACE).limit(limit)
    near = top.select("doc_id", F.col("unit_order").alias("__at"), F.explode(F.sequence(F.col("unit_order") - reach, F.col("unit_order") + reach)).alias("unit_order"))
    near = near.groupBy(*PLACE).agg(F.min(F.abs(F.col("unit_order") - F.col("__at"))).alias("distance"))
    return scored.join(near, list(PLACE)).select(*PLACE, "rel_path", "score", "distance").orderBy("distance", F.desc("score"), "rel_path", *PLACE).limit(limit)


def _best(rows: DataFrame, score: Column, paths: DataFrame, limit: int) -> DataFrame:
    out = rows.groupBy(*PLACE).agg(F.round(score, 6).alias("score")).where("score > 0").join(paths, "doc_id")
    return out.select(*PLACE, "rel_path", "score").orderBy(F.desc("score"), "rel_path", *PLACE).limit(limit)


def referent_candidates(mentions: DataFrame, paths: DataFrame, anchors: list[str], limit: int = 40) -> DataFrame:
    """Units that mention a referent whose label holds an anchor: 3 for each such mention and anchor."""
    label = normalize(F.col("surface"))
    return _best(mentions.withColumn("__h", hits(label, anchors)).where("__h > 0"), F.sum(3.0 * F.col("__h")), paths, limit)


def frame_candidates(arguments: DataFrame, frames: DataFrame, paths: DataFrame, predicates: list[str], anchors: list[str], limit: int = 40) -> DataFrame:
    """Units with a frame of one of the predicates: 4 a frame and 2 for each anchor in its arguments."""
    f = frames.where(F.col("predicate").isin(*predicates)).select(*PLACE, "frame_id")
    said = arguments.groupBy("frame_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list(normalize(F.col("surface"))))).alias("__m"))  # two arguments a frame at most
    return _best(f.join(said, "frame_id", "left"), F.sum(4.0 + 2 * hits(F.coalesce("__m", F.lit("")), anchors)), paths, limit)


def relation_candidates(relations: DataFrame, paths: DataFrame, predicates: list[str], anchors: list[str], limit: int = 40) -> DataFrame:
    """Units by their relations: the confidence, 2.5 for each anchor in a relation and 1.5 for each predicate term in what
    names it; relations with neither count nothing."""
    m, p = normalize(F.concat_ws(" ", "subject", "value")), normalize(F.concat_ws(" ", "predicate", "subject"))
    r = relations.withColumns({"__a": hits(m, anchors), "__p": hits(p, predicates)}).where("__a + __p > 0")
    return _best(r, F.sum(F.col("confidence") + 2.5 * F.col("__a") + 1.5 * F.col("__p")), paths, limit)


def mention_payload(mentions: DataFrame, units: DataFrame) -> DataFrame:
    """(…unit, item, surface, entity_type, label_norm, char_start): mentions with their referents, in document order."""
    return mentions.select(*PLACE, "item", "surface", "entity_type", normalize(F.col("surface")).alias("label_norm"), "char_start").join(units.select(*PLACE), list(PLACE))


def frame_payload(frames: DataFrame, arguments: DataFrame, units: DataFrame) -> DataFrame:
    """(…unit, frame_id, predicate, role, surface, context, unit_text): frames with their unit, context and arguments; a
    frame without arguments keeps one row."""
    f = frames.select(*PLACE, "frame_id", "predicate").join(units.select(*PLACE, F.col("text").alias("unit_text")), list(PLACE))
    return f.join(arguments.select("frame_id", "role", "surface"), "frame_id", "left").select(*PLACE, "frame_id", "predicate", "role", "surface", F.lit("asserted").alias("context"), "unit_text")


def fused(lexical: DataFrame, referent: DataFrame, frame: DataFrame, relation: DataFrame, prior: DataFrame, units: DataFrame, noise: DataFrame, target: list[str], relation_terms: list[str], reach: int = 4, limit: int = 20) -> DataFrame:
    """One score for each unit from all ways of finding it.

    The lexical score, 2 for a referent, 2.5 for a frame and 2.5 for a relation; at least the prior of its path; a
    neighbour up to ``reach`` places away takes 0.55 of the best such score; then 2 for each target and 4 for each
    relation term of the unit; 0.15 of it in documents of low priority."""
    one = lambda df, score: df.select(*PLACE, score.alias("score"))
    parts = one(lexical, F.col("score")).unionByName(one(referent, F.lit(2.0))).unionByName(one(frame, F.lit(2.5))).unionByName(one(relation, F.lit(2.5)))
    base = parts.groupBy(*PLACE).agg(F.sum("score").alias("score")).unionByName(one(prior, F.col("score").cast("double"))).groupBy(*PLACE).agg(F.max("score").alias("score"))
    around = base.select("doc_id", F.col("unit_order").alias("__at"), "score", F.explode(F.sequence(F.col("unit_order") - reach, F.col("unit_order") + reach)).alias("unit_order"))
    spread = around.select(*PLACE, F.when(F.col("__at") == F.col("unit_order"), F.col("score")).otherwise(0.55 * F.col("score")).alias("score")).groupBy(*PLACE).agg(F.max("score").alias("score"))
    u = units.join(spread, list(PLACE)).join(noise, "doc_id").withColumn("__m", normalize(F.col("text")))
    score = (F.col("score") + 2 * hits(F.col("__m"), target) + 4 * hits(F.col("__m"), relation_terms)) * F.when(F.col("low_priority"), 0.15).otherwise(1.0)
    return u.select(*PLACE, "rel_path", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "rel_path", *PLACE).limit(limit)


def evidence_window(found: DataFrame, units: DataFrame, reach: int = 3, size: int = 1_200) -> DataFrame:
    """(…unit, window): each unit found with those up to ``reach`` places around it in order, joined by blanks, at most
    ``size`` characters."""
    near = found.select("doc_id", F.col("unit_order").alias("__hit"), F.explode(F.sequence(F.col("unit_order") - reach, F.col("unit_order") + reach)).alias("unit_order")).distinct()
    got = units.select(*PLACE, "text").join(near, list(PLACE)).groupBy("doc_id", "__hit").agg(F.sort_array(F.collect_list(F.struct("unit_order", "text"))).alias("w"))  # 2 * reach + 1 units at most
    return got.select("doc_id", F.col("__hit").alias("unit_order"), F.substring(F.array_join(F.transform("w", lambda x: x["text"]), " "), 1, size).alias("window"))


def prior_units(units: DataFrame, documents: DataFrame, asked: list[str], limit: int = 8) -> DataFrame:
    """Units with an asked token in the best documents by path: 4 for each asked token in the path."""
    s = 4 * hits(normalize(F.col("rel_path")), asked)
    best = documents.select("doc_id", "rel_path", s.alias("score")).where("score > 0").orderBy(F.desc("score"), "rel_path", "doc_id").limit(limit)
    k = content(tokens(F.col("text")))
    return units.where(F.arrays_overlap(k, F.array(*map(F.lit, asked)))).select(*PLACE).join(best.select("doc_id", "score"), "doc_id")
