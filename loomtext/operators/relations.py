"""Relations read off the surface of documents, deduplicated by their first place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import extract
from loomtext.functions.text import normalize
from loomtext.operators.units import lines

COLUMNS = ("doc_id", "line", "item", "relation_type", "predicate", "subject", "value", "confidence")


def label_relations(documents: DataFrame) -> DataFrame:
    found = lines(documents).select("doc_id", "line", F.posexplode(extract.label_pairs(F.col("text"))).alias("item", "p"))
    return found.select("doc_id", "line", "item", F.lit("label_value").alias("relation_type"), F.lit("label").alias("predicate"), F.col("p.label").alias("subject"), F.col("p.value").alias("value"), F.lit(0.84).alias("confidence"))


def object_relations(documents: DataFrame) -> DataFrame:
    """Pairs of object-like spans; all of a span share a record group."""
    spans = lines(documents).where("text LIKE '%{%'").select("doc_id", "line", F.posexplode(extract.object_spans(F.col("text"))).alias("span_no", "span"))
    pairs = spans.select("doc_id", "line", "span_no", F.substring(F.sha2(normalize(F.col("span")), 256), 1, 16).alias("record_group"), F.posexplode(extract.object_pairs(F.col("span"))).alias("item", "p"))
    return pairs.select("doc_id", "line", (F.col("span_no") * 1000 + F.col("item")).alias("item"), F.lit("record_value").alias("relation_type"), F.lit("key_value").alias("predicate"), F.col("p.key").alias("subject"), F.col("p.value").alias("value"), F.lit(0.84).alias("confidence"), "record_group")


def cell_relations(documents: DataFrame) -> DataFrame:
    """Cells of rows with bars or tabs, each related to its row's first cell."""
    rows = lines(documents).where("text LIKE '%|%' OR text LIKE concat('%', chr(9), '%')").select("doc_id", "line", extract.cells(F.col("text")).alias("cells")).where("size(cells) >= 2")
    cells = rows.select("doc_id", "line", F.get("cells", F.lit(0)).alias("subject"), F.posexplode("cells").alias("item", "value")).where("item > 0")
    return cells.select("doc_id", "line", "item", F.lit("table_cell").alias("relation_type"), F.concat(F.lit("cell_"), F.col("item")).alias("predicate"), "subject", "value", F.lit(0.72).alias("confidence"))


def header_relations(documents: DataFrame) -> DataFrame:
    """Cells under the header in force: (doc_id, line, row_key, column, value).  The header is carried in document order
    by a fold over each document's own rows."""
    rows = lines(documents).where("text LIKE '%|%' OR text LIKE concat('%', chr(9), '%')").select("doc_id", "line", extract.cells(F.col("text")).alias("cells")).where("size(cells) >= 2 AND NOT cells[0] RLIKE '^-+$'")
    by_doc = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line", "cells"))).alias("rows"))
    carried = by_doc.select("doc_id", F.explode(extract.carry_header(F.col("rows"))).alias("r"))
    cells = carried.select("doc_id", F.col("r.line").alias("line"), F.get(F.col("r.cells"), F.lit(0)).alias("row_key"), F.posexplode(F.arrays_zip(F.col("r.header").alias("h"), F.col("r.cells").alias("c"))).alias("k", "x"))
    return cells.where("k > 0").select("doc_id", "line", "row_key", normalize(F.col("x.h")).alias("column"), F.col("x.c").alias("value"))


def dedupe(relations: DataFrame) -> DataFrame:
    """The first of the relations of a document that read the same when normalised."""
    key = [normalize(F.col(c)) for c in ("relation_type", "predicate", "subject", "value")]
    first = F.row_number().over(Window.partitionBy("doc_id", *key).orderBy("line", "item"))
    return relations.withColumn("__n", first).where("__n = 1").drop("__n")
