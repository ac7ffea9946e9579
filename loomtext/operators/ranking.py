"""Ranking of documents and units for a question's terms, and neighbours of what was found."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import extract
from loomtext.functions.terms import content_words
from loomtext.functions.text import bound, clean_value, content, low_semantic_noise, normalize, quality_counts, tokens


def hits(material: Column, terms: list[str]) -> Column:
    """How many of the terms the normalised material contains."""
    return sum((material.contains(t).cast("int") for t in terms), F.lit(0))


def rank_documents(documents: DataFrame, target: list[str], relation: list[str], lexical: list[str], limit: int = 40) -> DataFrame:
    """Best documents: 16 a target term, 8 a relation term, 1 a lexical term, a fifth of it for noise; without any
    target term a document is out, if there are target terms."""
    d = documents.where("text IS NOT NULL AND text <> ''").select("doc_id", "rel_path", "text").withColumn("__m", normalize(F.col("text")))
    d = d.withColumns({"__t": hits(F.col("__m"), target), "__s": 16 * hits(F.col("__m"), target) + 8 * hits(F.col("__m"), relation) + hits(F.col("__m"), lexical)})
    d = d.where((F.col("__s") > 0) & ((F.col("__t") > 0) if target else F.lit(True)))
    d = d.withColumn("__k", tokens(F.col("text"))).withColumns(quality_counts(F.col("text"), F.col("__k")))
    score = F.when(low_semantic_noise(), 0.2 * F.col("__s")).otherwise(1.0 * F.col("__s"))
    return d.select("doc_id", "rel_path", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "rel_path", "doc_id").limit(limit)


def lexical_search(units: DataFrame, key: str, query: str, required: list[str], limit: int = 20, order: tuple = ()) -> DataFrame:
    """Best units for the content tokens of ``query``: each counts as often as it stands in the unit, at most as often as
    in the query.  A unit that lacks a required phrase is out; each adds 4.  Counts are made before any shuffle, and only
    the best rows are sorted, equal ones by ``order``."""
    wanted = Counter(content_words(query))
    u = units.withColumn("__k", content(tokens(F.col("text")))).withColumn("__m", normalize(F.col("text")))
    times = lambda word: F.size(F.filter("__k", lambda t: t == word))
    shared = sum((F.least(times(word), F.lit(n)) for word, n in wanted.items()), F.lit(0))
    has_all = F.lit(True)
    for phrase in required:
        has_all = has_all & F.col("__m").contains(" ".join(phrase.lower().split()))
    out = u.where(has_all).withColumn("score", (shared + 4 * len(required)).cast("double")).where("score > 0")
    return out.select(key, *[c for c in order if c != key], "score").orderBy(F.desc("score"), *(order or (key,))).limit(limit)


def term_counts(units: DataFrame, key: str) -> DataFrame:
    """Postings: (key, token, tf)."""
    return units.select(key, F.explode(tokens(F.col("text"))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def neighbours(hits_of: DataFrame, units: DataFrame, reach: int = 4) -> DataFrame:
    """Units at most ``reach`` places from a hit in the same document, each with its distance to the nearest."""
    around = hits_of.select("document_id", F.col("chunk_order").alias("at")).distinct().select("document_id", "at", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach)).alias("chunk_order"))
    near = around.groupBy("document_id", "chunk_order").agg(F.min(F.abs(F.col("chunk_order") - F.col("at"))).alias("distance"))
    return units.join(near, ["document_id", "chunk_order"]).select("document_id", "chunk_order", "chunk_id", "distance")


def section_anchor(rows: DataFrame, heading: Column) -> DataFrame:
    """``anchor``: the last heading at or before each row of a document."""
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("anchor", F.last(F.when(heading, F.col("text")), ignorenulls=True).over(w))


def is_heading(text: Column) -> Column:
    """A short line with a capitalised phrase, one to eight tokens, and no label, cell, address or identifier."""
    shaped = lambda t: (t != "") & (F.length(t) <= 100) & ~t.rlike(r"[:|\t]") & (F.size(extract.urls(t)) == 0) & (F.size(extract.identifiers(t)) == 0) & F.size(tokens(t)).between(1, 8) & (F.size(extract.phrases(t)) > 0)
    return bound(clean_value(text), shaped)
