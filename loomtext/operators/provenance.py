"""The provenance graph of documents as tables: units, mentions, relations with their groups and anchors, frames with
arguments, identity, temporal edges, contexts with carriers and assignments.

Every table is keyed by (doc_id, unit_order) and a place in the unit, which is the order of first writers; nothing is
collected.  Null and empty texts have no rows; an empty table gives empty tables.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import extract
from loomtext.functions.terms import predicate_norm
from loomtext.functions.text import bound, clean_value, normalize, quality_class, quality_counts, stable_id, tokens
from loomtext.operators.ranking import is_heading
from loomtext.runtime import durable

TIMES, EDGES, FRAMES = 8, 64, 32  # most times and edges of a unit that are related, and frames of a unit
UNIT = ("doc_id", "unit_order")


def mention_rows(units: DataFrame, cap: int | None = None) -> DataFrame:
    """(doc_id, unit_order, item, surface, entity_type, char_start, char_end): addresses, identifiers and phrases of each
    unit at their first place, each surface once; at most ``cap`` a unit, where it is given."""
    found = F.array_distinct(F.concat(extract.urls(F.col("text")), extract.identifiers(F.col("text")), extract.phrases(F.col("text"))))
    rows = units.select(*UNIT, F.col("char_start").alias("__at"), "text", F.posexplode(found if cap is None else F.slice(found, 1, cap)).alias("item", "surface"))
    start = F.col("__at") + F.instr("text", F.col("surface")) - 1
    return rows.select(*UNIT, "item", "surface", extract.entity_type(F.col("surface")).alias("entity_type"), start.alias("char_start"), (start + F.length("surface")).alias("char_end"))


def referent_key(surface: Column, kind: Column) -> Column:
    return stable_id("ref", normalize(surface), kind)


def first_referents(mentions: DataFrame) -> DataFrame:
    """One row per (normalised surface, type) with the spelling of the first mention; aggregated map-side."""
    place = F.struct("doc_id", "unit_order", "item")
    out = mentions.groupBy(normalize(F.col("surface")).alias("label_norm"), "entity_type").agg(F.min_by("surface", place).alias("label"), F.min("doc_id").alias("first_doc"), F.count("*").alias("mentions"))
    return out.withColumn("referent_id", stable_id("ref", F.col("label_norm"), F.col("entity_type")))


def _relation(kind: str, predicate: Column, subject: Column, value: Column, confidence: float, group: Column | None = None, form: str = "") -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("relation_type"), predicate.alias("predicate"), subject.alias("subject"), value.alias("value"), F.lit(confidence).alias("confidence"),
                    (none if group is None else group).alias("record_group"), F.lit(form).alias("surface_format"))


def relation_arrays(text: Column) -> Column:
    """All surface relations of a text in the order of their kinds: pairs of objects and quoted pairs outside them, labels,
    cells, addresses, identifiers, times."""
    objects = F.flatten(F.transform(extract.object_spans(text), lambda o: F.transform(extract.object_pairs(o), lambda p: _relation("record_value", F.lit("key_value"), p.key, p.value, 0.84, F.concat(F.lit("object:"), F.substring(F.sha2(normalize(o), 256), 1, 16)), "object_like"))))
    outside = F.transform(extract.outside_pairs(text), lambda p: _relation("record_value", F.lit("key_value"), p.key, p.value, 0.83, F.when(p.key.contains("."), F.regexp_replace(p.key, r"\.[^.]*$", "")).otherwise(p.key), "json_like"))
    labels = F.transform(extract.label_pairs(text), lambda p: _relation("label_value", F.lit("label"), p.label, p.value, 0.84))
    of_row = lambda row: F.transform(F.filter(F.transform(row, lambda c, k: F.struct(c.alias("c"), k.alias("k"))), lambda x: x.k > 0), lambda x: _relation("table_cell", F.concat(F.lit("cell_"), x.k), row[0], x.c, 0.72))
    cells = bound(extract.cells(extract.only(text, text.rlike(r"[|\t]"))), of_row)
    single = lambda values, kind, name, conf: F.transform(values, lambda v: _relation(kind, F.lit(name), F.lit(""), clean_value(v), conf))
    parts = (objects, outside, labels, cells, single(extract.urls(text), "identifier", "url", 0.85), single(extract.identifiers(text), "identifier", "identifier", 0.8), single(extract.timestamps(text), "temporal", "timestamp", 0.8))
    return F.filter(F.concat(*parts), lambda r: (r.subject != "") | (r.value != ""))


def unit_relations(units: DataFrame) -> DataFrame:
    """(…unit, item, relation_type, predicate, subject, value, confidence, record_group, surface_format): the first of the
    relations of a unit that read the same when normalised."""
    rows = units.select(*UNIT, F.posexplode(relation_arrays(F.col("text"))).alias("item", "r")).select(*UNIT, "item", "r.*")
    same = Window.partitionBy(*UNIT, "relation_type", "predicate", normalize(F.col("subject")), normalize(F.col("value"))).orderBy("item")
    return rows.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")


def header_cells(units: DataFrame) -> DataFrame:
    """Relations of cells to the header in force in their document, as ``unit_relations`` gives them, after those of the unit.

    The header is carried over each document's own rows by a fold; a document's rows are the most that one task holds."""
    row = F.filter(extract.cells(F.col("text")), lambda c: c != "")
    rows = units.where(r"text LIKE '%|%' OR text LIKE concat('%', chr(9), '%')").select("doc_id", F.col("unit_order").alias("line"), row.alias("cells")).where("size(cells) > 0")
    carried = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line", "cells"))).alias("rows")).select("doc_id", F.explode(extract.carry_header(F.col("rows"))).alias("r"))
    key = F.get(F.col("r.cells"), F.lit(0))
    group = stable_id("table_row", F.col("doc_id"), F.col("r.line"), key, F.array_join("r.cells", "|"))
    cells = carried.select("doc_id", F.col("r.line").alias("unit_order"), key.alias("subject"), group.alias("record_group"), F.posexplode(F.arrays_zip(F.col("r.header").alias("h"), F.col("r.cells").alias("c"))).alias("k", "x")).where("k > 0 AND x.h <> '' AND x.c <> ''")
    return cells.select(*UNIT, (1_000_000 + F.col("k")).alias("item"), F.lit("table_cell").alias("relation_type"), normalize(F.col("x.h")).alias("predicate"), "subject", F.col("x.c").alias("value"), F.lit(0.82).alias("confidence"), "record_group", F.lit("delimited_table").alias("surface_format"))


def _long_phrase(text: Column) -> Column:
    return F.exists(extract.phrases(text), lambda p: p.rlike(r"[ \t\n]"))


def starts_record(text: Column) -> Column:
    """Whether a unit begins a record of its own: cells, an object, or a phrase of two words before its first label mark."""
    return text.rlike(r"[|\t]") | text.rlike(r"^[ \t]*[\[{]") | _long_phrase(F.regexp_extract(text, "^[^:=]*", 0))


def structure(units: DataFrame, relations: DataFrame) -> DataFrame:
    """(…unit, is_heading, starts_record, inherits, label_heading, plain_prefix) of every unit; ``relations`` are those of
    ``unit_relations``."""
    labels = F.col("relation_type") == "label_value"
    of = relations.groupBy(*UNIT).agg(F.count("*").alias("__all"), F.count_if(labels).alias("__labels"), F.count_if(labels | (F.col("relation_type") == "record_value")).alias("__own"), F.max(F.when(labels, F.col("value"))).alias("__label"))
    u = units.join(of, list(UNIT), "left")
    named = F.exists(extract.phrases(F.col("__label")), lambda p: p.rlike(r"[ \t\n]") & (normalize(p) == normalize(F.col("__label"))))
    label = F.when((F.col("__labels") == 1) & ~F.col("text").rlike(r"[|\t]|://") & (F.size(extract.identifiers(F.col("__label"))) == 0) & named, F.col("__label"))
    heading, starts = is_heading(F.col("text")), starts_record(F.col("text"))
    return u.select(*UNIT, "text", heading.alias("is_heading"), starts.alias("starts_record"), F.coalesce((F.col("__all") == F.col("__own")) & ~starts, F.lit(False)).alias("inherits"),
                    F.when(~heading, label).alias("label_heading"), (~_long_phrase(F.regexp_extract(F.col("text"), r"^[^:=|\t]*", 0))).alias("plain_prefix"))


def anchored(units: DataFrame) -> DataFrame:
    """Adds ``section_anchor`` to ``structure``: the last heading at or before a unit; before any heading the first label
    heading of an earlier unit."""
    w = Window.partitionBy("doc_id").orderBy("unit_order")
    heading = F.last(F.when(F.col("is_heading"), clean_value(F.col("text"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    pending = F.first("label_heading", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return units.withColumn("section_anchor", F.coalesce(heading, pending))


def grouped_relations(relations: DataFrame, anchors: DataFrame) -> DataFrame:
    """Relations with ``sentence_group``, ``record_group`` and ``section_anchor`` by the rules of their unit, and an id."""
    a = anchors.select(*UNIT, "starts_record", "inherits", "plain_prefix", F.col("section_anchor").alias("__anchor"))
    r = relations.join(a, list(UNIT))
    unit = stable_id("sentence_group", F.col("doc_id"), F.col("unit_order"))
    section = stable_id("section_group", F.col("doc_id"), F.col("__anchor"))
    inherits = F.col("inherits") & F.col("__anchor").isNotNull()
    anchor = F.when(inherits | ~F.col("starts_record") | F.col("plain_prefix"), F.col("__anchor"))
    return r.select(*UNIT, "item", "relation_type", "predicate", "subject", "value", "confidence", "surface_format", unit.alias("sentence_group"),
                    F.when(inherits, section).otherwise(F.coalesce("record_group", unit)).alias("record_group"), anchor.alias("section_anchor"),
                    stable_id("rel", F.col("doc_id"), F.col("unit_order"), F.col("relation_type"), F.col("predicate"), F.col("subject"), F.col("value")).alias("relation_id"))


def frames(relations: DataFrame, cap: int = FRAMES) -> DataFrame:
    """Relations as frames, (…unit, frame_no, frame_id, predicate, arguments), the first ``cap`` of each unit; arguments
    are (role, surface, value_type) of what is given of subject and value."""
    n = F.row_number().over(Window.partitionBy(*UNIT).orderBy("item"))
    kind = extract.value_type(F.col("value"))
    args = F.filter(F.array(F.struct(F.lit("subject").alias("role"), F.col("subject").alias("surface"), F.lit("unknown").alias("value_type")), F.struct(F.lit("value").alias("role"), F.col("value").alias("surface"), kind.alias("value_type"))), lambda x: x.surface != "")
    some = relations.withColumn("frame_no", n).where(F.col("frame_no") <= cap)
    return some.select(*UNIT, "frame_no", stable_id("frm", F.col("doc_id"), F.col("unit_order"), F.col("relation_type"), F.col("predicate"), F.col("subject"), F.col("value")).alias("frame_id"),
                       F.when(F.col("relation_type") == "label_value", predicate_norm(F.col("subject"))).otherwise(F.col("predicate")).alias("predicate"), "confidence", args.alias("arguments"))


def frame_arguments(of: DataFrame) -> DataFrame:
    """(…unit, frame_id, arg_no, role, surface, value_type, referent_id)."""
    a = of.select(*UNIT, "frame_id", F.posexplode("arguments").alias("arg_no", "a")).select(*UNIT, "frame_id", "arg_no", "a.*")
    return a.withColumn("referent_id", referent_key(F.col("surface"), F.col("value_type")))


def self_identity(mentions: DataFrame, arguments: DataFrame) -> DataFrame:
    """(…unit, surface_norm, left_id, right_id): a mention and an argument of one unit that read the same but are other
    referents.  Joined within units, so no surface is a hot key."""
    m = mentions.select(*UNIT, normalize(F.col("surface")).alias("surface_norm"), referent_key(F.col("surface"), F.col("entity_type")).alias("left_id")).distinct()
    a = arguments.select(*UNIT, normalize(F.col("surface")).alias("surface_norm"), F.col("referent_id").alias("right_id")).distinct()
    return m.join(a, [*UNIT, "surface_norm"]).where("left_id <> right_id")


def temporal_edges(relations: DataFrame, times: int = TIMES, edges: int = EDGES) -> DataFrame:
    """(…unit, item, relation, temporal_value, state_value, confidence): the times of a unit with its other relations,
    where they are at most ``times`` and the pairs at most ``edges``; others are held to say nothing of each other."""
    kind = F.col("relation_type") == "temporal"
    stated = ~kind & (F.col("value") != "")
    size = relations.groupBy(*UNIT).agg(F.array_agg(F.when(kind, F.struct("item", "value"))).alias("__t"), F.count_if(kind).alias("__times"), F.count_if(stated).alias("__stated"))
    ok = size.where((F.col("__times") > 0) & (F.col("__times") <= times) & (F.col("__times") * F.col("__stated") <= edges)).select(*UNIT, F.explode("__t").alias("__x"))
    rows = relations.where(stated).join(ok, list(UNIT))
    name = F.when(F.col("subject") != "", F.col("subject")).when(F.col("predicate") != "", F.col("predicate")).otherwise(F.col("relation_type"))
    return rows.select(*UNIT, "item", name.alias("relation"), F.col("__x.value").alias("temporal_value"), F.col("value").alias("state_value"), F.least(F.lit(0.9), "confidence").alias("confidence"))


def quality_contexts(documents: DataFrame) -> DataFrame:
    """(kind, holder, documents, context_id): one context for each class of text quality, its first document as holder."""
    d = documents.where("text IS NOT NULL").select("doc_id", "text", tokens(F.col("text")).alias("__k"))
    d = d.withColumns(quality_counts(F.col("text"), F.col("__k")))
    out = d.groupBy(F.concat(F.lit("quality:"), quality_class()).alias("kind")).agg(F.min("doc_id").alias("holder"), F.count("*").alias("documents"))
    return out.withColumn("context_id", stable_id("ctx", F.col("kind")))


def carriers(documents: DataFrame, units: DataFrame) -> DataFrame:
    """(carrier_kind, doc_id, unit_order, carrier_surface, temporal_value): what carries a context: a document's quality,
    its times, and every unit."""
    d = documents.where("text IS NOT NULL").select("doc_id", "text", "mtime", "ctime", tokens(F.col("text")).alias("__k"))
    none = F.lit(None).cast("string")
    q = d.withColumns(quality_counts(F.col("text"), F.col("__k"))).select(F.lit("source_quality").alias("carrier_kind"), "doc_id", F.lit(None).cast("int").alias("unit_order"), quality_class().alias("carrier_surface"), none.alias("temporal_value"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    times = [d.where(F.col(c).isNotNull()).select(F.lit("filesystem_time").alias("carrier_kind"), "doc_id", F.lit(None).cast("int").alias("unit_order"), F.lit(c).alias("carrier_surface"), iso(c).alias("temporal_value")) for c in ("mtime", "ctime")]
    s = units.select(F.lit("sentence_context").alias("carrier_kind"), "doc_id", "unit_order", F.lit("asserted").alias("carrier_surface"), none.alias("temporal_value"))
    return q.unionByName(times[0]).unionByName(times[1]).unionByName(s)


def assignments(units: DataFrame) -> DataFrame:
    """(applies_to, doc_id, unit_order, context, confidence): the asserted context of every unit, as chunk and as span."""
    to = F.explode(F.array(F.lit("chunk"), F.lit("source_span"))).alias("applies_to")
    return units.select(to, "doc_id", "unit_order", F.lit("asserted").alias("context"), F.lit(0.9).alias("confidence"))


def closure(seeds: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """(seed, node, hops): what is reached from each seed over undirected ``edges`` (left_id, right_id) in at most
    ``hops`` steps, each node at its least distance; one equi-join a step, and each step's rows are written once, so that
    no step computes those before it again."""
    both = durable(edges.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).unionByName(edges.select(F.col("right_id").alias("a"), F.col("left_id").alias("b"))).distinct())
    seen = durable(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops")).distinct())
    front = seen
    for k in range(1, hops + 1):
        near = front.join(both, front["node"] == both["a"]).select("seed", F.col("b").alias("node")).distinct()
        front = durable(near.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(k)))
        seen = seen.unionByName(front)
    return seen


def flatten_json(raw: Column) -> Column:
    """(path, value) of every scalar of a JSON object or array, paths dotted with places in arrays, in document order.

    Null, unparsable and scalar texts have none; null, true and false are spelt so, numbers as written; empty strings are
    left out.  JSON nests to any depth, which no Column expression walks, so batches are parsed by Arrow."""
    return F.pandas_udf(_flatten, "array<struct<path: string, value: string>>")(raw)


def _flatten(rows: pd.Series) -> pd.Series:
    def walk(value, path, out):
        if isinstance(value, dict):
            for k, v in value.items():
                walk(v, f"{path}.{k}" if path else str(k), out)
        elif isinstance(value, list):
            for k, v in enumerate(value):
                walk(v, f"{path}.{k}" if path else str(k), out)
        else:
            text = "null" if value is None else "true" if value is True else "false" if value is False else str(value)
            if path and text:
                out.append({"path": path, "value": text})

    found = []
    for raw in rows:
        out: list = []
        if raw and raw.lstrip()[:1] in ("{", "["):
            try:
                walk(json.loads(raw, parse_float=str, parse_int=str), "", out)
            except (ValueError, RecursionError):
                out = []
        found.append(out)
    return pd.Series(found)
