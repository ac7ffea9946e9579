"""Units of a document: plain sentence-like pieces of short texts, windows of long ones."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import stable_id

CAP = 4_000  # characters above which a text is cut into windows instead


# A run of line ends, or of blanks behind a sentence mark that is not the dot of a title.
BREAK = r"(?<=[.!?])(?<!(?:^|[^A-Za-z0-9_])(?:Dr|Ms|Mr|Mrs|Prof)\.)[ \t\n\r]+|\n+"


def plain_units(text: Column) -> Column:
    """Pieces between sentence marks followed by blanks, and line ends; titles such as ``Dr.`` end nothing."""
    return F.filter(F.transform(F.split(text, BREAK), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")


_MARK = re.compile(r"[.!?][ \t\n\r]+|\n+")
_TITLE = re.compile(r"(?:^|[^A-Za-z0-9_])(?:Dr|Ms|Mr|Mrs|Prof)\.$")


def _spans(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        edges = [0]
        for m in _MARK.finditer(text or ""):
            mark = m.group()[0] in ".!?"
            if not (mark and _TITLE.search(text, max(0, m.start() - 6), m.start() + 1)):
                edges += [m.start() + mark, m.end()]
            elif "\n" in m.group():  # a line end stays a break behind a title, too
                at = m.start() + m.group().index("\n")
                edges += [at, at + 1]
        edges.append(len(text or ""))
        found = []
        for s, e in zip(edges[::2], edges[1::2]):
            piece = text[s:e]
            s += len(piece) - len(piece.lstrip(" \t\r\n"))
            e = s + len(piece.strip(" \t\r\n"))
            if s < e:
                found.append({"char_start": s, "char_end": e})
        out.append(found)
    return pd.Series(out)


def placed_units(documents: DataFrame) -> DataFrame:
    """(doc_id, rel_path, unit_order, char_start, char_end, text, unit_id): the plain units with their places in the text.

    Null and empty texts have none; a unit's text is that slice of its document's."""
    spans = F.pandas_udf(_spans, "array<struct<char_start: int, char_end: int>>")
    d = documents.where("text IS NOT NULL AND text <> ''").select("doc_id", "rel_path", F.col("text").alias("__t"), F.posexplode(spans("text")).alias("unit_order", "s"))
    cut = F.substring("__t", F.col("s.char_start") + 1, F.col("s.char_end") - F.col("s.char_start"))
    return d.select("doc_id", "rel_path", "unit_order", "s.char_start", "s.char_end", cut.alias("text"), stable_id("unit", F.col("doc_id"), F.col("unit_order")).alias("unit_id"))


def windows(text: Column, cap: int = CAP) -> Column:
    """Windows of at most ``cap`` characters, each cut at the last blank of its second half where there is one."""
    n = F.length(text)
    steps = F.sequence(F.lit(1), F.ceil(2 * n / F.lit(cap)).cast("int") + 2)
    start = F.expr("named_struct('at', 1, 'out', CAST(array() AS array<string>))")

    def step(acc, _):
        piece = F.substring(text, acc["at"], F.lit(cap))
        back = F.instr(F.reverse(F.substring(piece, F.lit(cap // 2 + 2), F.lit(cap))), F.lit(" "))
        size = F.when((n - acc["at"] + 1 <= cap) | (back == 0), F.length(piece)).otherwise(F.length(piece) - back)
        done = acc["at"] > n
        unit = F.btrim(F.substring(piece, F.lit(1), size), F.lit(" \t\r\n"))
        out = F.when(done | (unit == ""), acc["out"]).otherwise(F.concat(acc["out"], F.array(unit)))
        return F.struct(F.when(done, acc["at"]).otherwise(acc["at"] + F.greatest(size, F.lit(1))).alias("at"), out.alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def units(documents: DataFrame, cap: int | None = None) -> DataFrame:
    """(doc_id, unit_order, text); null and empty texts have no units.  With ``cap`` longer texts give windows."""
    text = F.btrim("text", F.lit(" \t\r\n"))
    pieces = plain_units(text) if cap is None else F.when(F.length(text) > cap, windows(text, cap)).otherwise(plain_units(text))
    return documents.where("text IS NOT NULL AND text <> ''").select("doc_id", F.posexplode(pieces).alias("unit_order", "text"))


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line, text) of the non-blank lines."""
    out = documents.where("text IS NOT NULL AND text <> ''").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return out.where(r"text RLIKE '[^ \\t\\r]'")
