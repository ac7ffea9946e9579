"""Raw text from a folder tree, decoded and described, without a driver-side walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: path, rel_path, text, size_bytes, mtime, encoding, decode_errors, content_hash.

    Bytes that are no valid UTF-8 become U+FFFD and are counted as replaced; CR and CRLF become LF.  A missing folder
    raises as Spark's reader does; an empty file has the text ''.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.lit(folder.rstrip("/") + "/")
    valid = F.is_valid_utf8(F.col("content"))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content")), "\r\n?", "\n")
    return files.select(
        "path", F.element_at(F.split(F.regexp_replace("path", "^file:/*", "/"), root), -1).alias("rel_path"), text.alias("text"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"),
        F.lit("utf-8").alias("encoding"), F.when(valid, "strict").otherwise("replace").alias("decode_errors"), F.sha2("content", 256).alias("content_hash"))


def document_order(documents: DataFrame) -> DataFrame:
    """The key by which documents are ordered: the parts of their path, not the path as one string."""
    return documents.withColumn("path_parts", F.split("rel_path", "/"))
