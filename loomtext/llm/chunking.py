"""Splitting oversized items at natural boundaries (problem 3).

A chunk whose text exceeds its source's token limit is cut by a hierarchy of separators: sections, paragraphs, lines,
sentences, words, characters.  Units of the highest level that fit are packed greedily up to the limit; a unit that is
itself too large is cut by the next level.  Consecutive pieces share the source's overlap exactly, in tokens.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.runtime import durable, table

CHARS_PER_TOKEN = 4  # fixed by the problem: a token is four code points, rounded up
LEVELS = [
    ("section", re.compile(r"\n[ \t]*\n[ \t]*\n\s*|\n(?=#{1,6} )")),
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"(?<=[.!?…])[\"”»“)\]’']*\s+|(?<=[。！？।؟])[」”』）》\"]*\s*")),
    ("word", re.compile(r"\s+")),
]
CHARACTER = "character"


def tokens_of(length):
    return -(-length // CHARS_PER_TOKEN)


def _ends(text: str) -> list[tuple[str, list[int]]]:
    """For each level the sorted places just after its separators."""
    return [(name, [m.end() for m in p.finditer(text)]) for name, p in LEVELS]


def split_text(text: str, max_tokens: int, overlap_tokens: int) -> list[tuple[int, int, str]]:
    """Pieces (start, end, boundary the piece ends at) that cover ``text``; each but the first starts ``overlap_tokens``
    before its predecessor's end.  A text within the limit is one piece; an overlap of the limit or more is cut to one
    token less than the limit, so that every piece moves on."""
    limit, size = max_tokens * CHARS_PER_TOKEN, len(text)
    if size <= limit:
        return [(0, size, "end")]
    share = min(overlap_tokens, max_tokens - 1) * CHARS_PER_TOKEN
    levels, pieces, start = _ends(text), [], 0
    while True:
        if size - start <= limit:
            pieces.append((start, size, "end"))
            return pieces
        last, end, name = start + limit, start + limit, CHARACTER
        fresh = pieces[-1][1] if pieces else start  # what lies before it was given out already
        least = fresh + (last - fresh) // 3
        for level, places in levels:
            k = bisect_right(places, last) - 1
            if k >= 0 and places[k] > (fresh if level == "word" else least):
                end, name = places[k], level
                break
        pieces.append((start, end, name))
        start = max(end - share, start + 1)
        if share:  # of the few starts that share the same number of tokens take a word's, if there is one
            start = next((p for p in range(start, start + CHARS_PER_TOKEN) if p < end and text[p - 1].isspace() and not text[p].isspace()), start)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            first = None if pd.isna(r.char_start) else int(r.char_start)
            for k, (s, e, name) in enumerate(split_text(r.text, int(r.max_tokens), int(r.overlap_tokens))):
                rows.append((r.chunk_id, r.document_id, k, None if first is None else first + s, None if first is None else first + e, tokens_of(e - s), name, r.text[s:e]))
        yield pd.DataFrame(rows, columns=["chunk_id", "document_id", "piece", "char_start", "char_end", "token_estimate", "boundary", "text"]).astype({"char_start": "Int64", "char_end": "Int64"})


def oversized(chunks: DataFrame, documents: DataFrame, limits: DataFrame) -> DataFrame:
    """Chunks above their source's limit, each once.

    Lengths are compared with the smallest limit before the join, so that only texts that can be too large are moved.
    Exact copies of a chunk's row are one chunk; chunks with null text, of unknown documents or of sources without a
    limit (null or missing) are never oversized.  The wrong ``token_estimate`` of the input is not read.
    """
    lim = limits.where("max_tokens > 0").select("source", "max_tokens", F.greatest(F.coalesce("overlap_tokens", F.lit(0)), F.lit(0)).alias("overlap_tokens"))
    least = lim.agg(F.min("max_tokens")).scalar()
    size = F.ceil(F.length("text") / F.lit(CHARS_PER_TOKEN))
    big = chunks.select("chunk_id", "document_id", "char_start", "text").where(size > least)
    docs = documents.select("document_id", "source")
    out = big.join(docs, "document_id").join(lim, "source").where(size > F.col("max_tokens"))
    kept = F.row_number().over(_window("document_id", "chunk_id"))
    return out.withColumn("__n", kept).where("__n = 1").drop("__n")


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(F.col("char_start").asc_nulls_last())


def split_oversized(chunks: DataFrame, documents: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per piece of every oversized chunk: ``piece`` counts from 0; ``char_start`` and ``char_end`` are offsets
    into the document (null where the chunk's own place is unknown); an empty input gives an empty table."""
    schema = "chunk_id string, document_id string, piece int, char_start bigint, char_end bigint, token_estimate int, boundary string, text string"
    return oversized(chunks, documents, limits).mapInPandas(_pieces, schema)


def locate(pieces_of: DataFrame, documents: DataFrame) -> DataFrame:
    """``char_start`` filled where it was unknown and the chunk's text stands in its document exactly once."""
    lost = pieces_of.where("char_start IS NULL")
    # only the documents of such chunks send their texts through the shuffle; the keys are written first, so that Spark
    # sees how few they are
    keys = durable(lost.select("document_id").distinct())
    texts = documents.select("document_id", F.col("text").alias("__text")).join(keys, "document_id", "left_semi")
    at = F.instr("__text", F.col("text"))
    again = F.instr(F.expr("substring(__text, instr(__text, text) + 1)"), F.col("text"))
    found = lost.join(texts, "document_id", "left").withColumn("char_start", F.when((at > 0) & (again == 0), (at - 1).cast("int"))).drop("__text")
    return pieces_of.where("char_start IS NOT NULL").unionByName(found)


def _inputs(spark, d):
    return table(spark, d, "chunks"), table(spark, d, "documents"), table(spark, d, "chunk_limits")


def found(chunks: DataFrame, documents: DataFrame, limits: DataFrame) -> DataFrame:
    """``chunk_id`` of every chunk that had to be cut."""
    return split_oversized(chunks, documents, limits).where("piece = 1").select("chunk_id")


def pieces(chunks: DataFrame, documents: DataFrame, limits: DataFrame) -> DataFrame:
    """All pieces, with the places of chunks whose ``char_start`` is missing restored where they are certain."""
    schema = "chunk_id string, document_id string, piece int, char_start bigint, char_end bigint, token_estimate int, boundary string, text string"
    return locate(oversized(chunks, documents, limits), documents).mapInPandas(_pieces, schema)


QUERIES = {
    "p3_found": lambda spark, d: found(*_inputs(spark, d)),
    "p3_pieces": lambda spark, d: pieces(*_inputs(spark, d)),
}
SQL = {
    "p3_found": "SELECT DISTINCT c.chunk_id FROM chunks c JOIN documents d ON c.document_id = d.document_id JOIN chunk_limits l ON l.source = d.source WHERE ceil(length(c.text) / 4.0) > l.max_tokens",
}
