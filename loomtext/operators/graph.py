"""The provenance graph: referents, contexts, carriers, integrity, and chains of parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import extract
from loomtext.functions.text import normalize, stable_id
from loomtext.operators.units import lines
from loomtext.runtime import durable


def mentions(documents: DataFrame, cap: int | None = None) -> DataFrame:
    """(doc_id, line, item, surface, entity_type) of addresses, identifiers and phrases; at most ``cap`` a line, where it is given."""
    typed = lambda values, kind: F.transform(values, lambda v: F.struct(v.alias("surface"), F.lit(kind).alias("entity_type")))
    found = F.concat(*[typed(values, kind) for values, kind in (
        (extract.urls(F.col("text")), "url"), (extract.all_of(F.col("text"), extract.PREFIX_ID), "identifier"), (extract.phrases(F.col("text")), "name"))])
    own = F.array_distinct(found)
    return lines(documents).select("doc_id", "line", F.posexplode(own if cap is None else F.slice(own, 1, cap)).alias("item", "m")).select("doc_id", "line", "item", "m.surface", "m.entity_type")


def referents(found: DataFrame) -> DataFrame:
    """One row per (normalised surface, type); the first writer's spelling stays.  min_by aggregates map-side, so that a
    surface that fills the corpus is no hot group."""
    first = F.struct("doc_id", "line", "item")
    norm = normalize(F.col("surface"))
    out = found.groupBy(norm.alias("label_norm"), "entity_type").agg(F.min_by("surface", first).alias("label"), F.min("doc_id").alias("first_doc"), F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("documents"))
    return out.withColumn("referent_id", stable_id("ref", F.col("label_norm"), F.col("entity_type")))


def contexts(documents: DataFrame) -> DataFrame:
    """One context per source with its first document as holder."""
    return documents.groupBy("source").agg(F.min("doc_id").alias("holder"), F.count("*").alias("carriers")).withColumn("context_id", stable_id("ctx", F.col("source")))


def orphans(child: DataFrame, parent: DataFrame, key: str, to: str) -> DataFrame:
    """Rows of ``child`` whose key, if given, has no row in ``parent``."""
    keys = parent.select(F.col(to).alias("__k")).distinct()
    return child.where(F.col(key).isNotNull()).join(keys, child[key] == keys["__k"], "left_anti").agg(F.count("*").alias("orphans"))


def chains(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, ancestor, distance) of all ancestors, of those up to ``depth`` parents away where it is given; a cycle ends
    where a node would come again.  Each step is written before it is asked whether any node goes further."""
    step = edges.select(F.col("node"), F.col("parent").alias("ancestor"), F.array("node").alias("path")).where("ancestor IS NOT NULL")
    out, up, k = None, edges.select(F.col("node").alias("__n"), F.col("parent").alias("__p")), 1
    while True:
        level = step.select("node", "ancestor", F.lit(k).alias("distance"))
        out = level if out is None else out.unionByName(level)
        if k == depth:
            return out
        step = durable(step.join(up, step["ancestor"] == up["__n"]).select("node", F.col("__p").alias("ancestor"), F.concat("path", F.array("__n")).alias("path")).where("ancestor IS NOT NULL AND NOT array_contains(path, ancestor)"))
        k += 1
        if step.isEmpty():
            return out


def melt(documents: DataFrame) -> DataFrame:
    """(doc_id, key, value, source): what the table and the file system say of a document, one fact a row; blanks left out."""
    fs = documents.select("doc_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("rel_path", "size_bytes", "source"))), F.array("rel_path", F.col("size_bytes").cast("string"), "source"))).alias("key", "value"))
    keys = ("file_name", "stem", "suffix", "parent_rel_path", "directory_depth", "encoding", "decode_errors", "mime_type", "title", "author", "line_count", "word_count")
    parsed = documents.select("doc_id", F.from_json("metadata_json", ", ".join(f"{k} string" for k in keys)).alias("j"))
    stack = parsed.select("doc_id", F.expr(f"stack({len(keys)}, {', '.join(f'{k!r}, j.{k}' for k in keys)}) AS (key, value)"))
    return fs.withColumn("source", F.lit("filesystem")).unionByName(stack.withColumn("source", F.lit("analysis"))).where("value IS NOT NULL AND value <> ''")
