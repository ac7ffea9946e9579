"""Rows that fail to parse: an error-tolerant parse of delimited lines.

Every line is reduced on the JVM to its structure (quotes, delimiters and runs of anything else).  A dynamic program
over that structure finds the cheapest way to make it a well-formed record of the wanted width, where inserting or
deleting a quote costs far more than inserting or deleting a delimiter.  Lines that need no edit and whose fields have
valid types load; every other line comes out with its edits, which state the reason.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\r\n"
MARK = "\u0001"  # stands for the delimiter of the line's own sheet
ESCAPE, ESCAPED = "\u0002", {"\u0002": "\u00020", MARK: "\u00021"}  # how these two are spelt where they stand in a line
EDITS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("quotes_inserted", "quotes_deleted", "delimiters_inserted", "delimiters_deleted")])
QUOTE_COST, DELIMITER_COST = 1_000_000, 1
# Places of the automaton: at a field's start, after an inserted delimiter (no quote may open there), in plain text,
# inside quotes, after a closing quote, and after a closing quote plus an inserted delimiter.
START, CUT, PLAIN, QUOTED, CLOSED, CUT_CLOSED = range(6)


def _reads(place: int, symbol: str) -> int | None:
    """The place after reading ``symbol`` unedited, or None where the grammar forbids it."""
    if symbol == "x":
        return {START: PLAIN, CUT: PLAIN, PLAIN: PLAIN, QUOTED: QUOTED}.get(place)
    if symbol == '"':
        return {START: QUOTED, QUOTED: CLOSED, CLOSED: QUOTED}.get(place)
    return QUOTED if place == QUOTED else START


@lru_cache(maxsize=50_000)
def cheapest_edits(structure: str, width: int) -> tuple[int, int, int, int]:
    """Fewest edits (quotes inserted, quotes deleted, delimiters inserted, delimiters deleted) that make ``structure``,
    a string of ``"``, the delimiter mark and ``x``, a record of ``width`` fields.

    Edited delimiters never touch a quote's neighbourhood, so whether quotes must be edited depends on the quotes alone.
    """
    best: dict[tuple[int, int], tuple[int, tuple[int, int, int, int]]] = {(1, START): (0, (0, 0, 0, 0))}

    def offer(to: dict, key: tuple[int, int], cost: int, edits: tuple[int, int, int, int]) -> bool:
        if key[0] <= width and (key not in to or cost < to[key][0]):
            to[key] = (cost, edits)
            return True
        return False

    def insertions(states: dict) -> dict:
        todo = list(states)
        while todo:
            field, place = key = todo.pop()
            cost, (qi, qd, di, dd) = states[key]
            after = _reads(place, '"')
            if after is not None and offer(states, (field, after), cost + QUOTE_COST, (qi + 1, qd, di, dd)):
                todo.append((field, after))
            if place != QUOTED:
                cut = CUT if place in (START, CUT, PLAIN) else CUT_CLOSED
                if offer(states, (field + 1, cut), cost + DELIMITER_COST, (qi, qd, di + 1, dd)):
                    todo.append((field + 1, cut))
        return states

    for symbol in structure:
        step: dict = {}
        for (field, place), (cost, (qi, qd, di, dd)) in insertions(best).items():
            after = _reads(place, symbol)
            if after is not None:
                offer(step, (field + (symbol == MARK and place != QUOTED), after), cost, (qi, qd, di, dd))
            if symbol == '"':
                offer(step, (field, place), cost + QUOTE_COST, (qi, qd + 1, di, dd))
            elif symbol == MARK and place != QUOTED:
                offer(step, (field, START), cost + DELIMITER_COST, (qi, qd, di, dd + 1))
        best = step
    ends = [v for (field, place), v in insertions(best).items() if field == width and place != QUOTED]
    return min(ends)[1]


def _edits(structures: pd.Series, width: pd.Series) -> pd.DataFrame:
    pairs = pd.DataFrame({"s": structures.fillna(""), "w": width})
    distinct = pairs.drop_duplicates()
    found = pd.DataFrame([cheapest_edits(s, w) for s, w in zip(distinct.s, distinct.w)], columns=EDITS.names, index=pd.MultiIndex.from_frame(distinct), dtype="int32")
    return found.loc[pd.MultiIndex.from_frame(pairs)].reset_index(drop=True)


def _edits_udf():
    # marked so that no filter is pushed below it and evaluates it a second time
    return F.pandas_udf(_edits, EDITS).asNondeterministic()


def blank_trim(column: Column) -> Column:
    return F.btrim(column, F.lit(BLANKS))


def parse_lines(lines: DataFrame, line: str, delimiter: str, width: int, valid: list, fields: str = "fields") -> DataFrame:
    """Adds ``fields`` (array of unquoted, trimmed values; null where edits are needed), ``edits`` and ``reason``.

    ``valid`` holds for each field a function from its column to a boolean column.  ``reason`` is null for a row that
    loads, else the first that applies of ``quoting`` (quotes must be edited), ``columns`` (delimiters must be edited)
    and ``value`` (a field of a well-formed line has no valid value).  A null line is an empty line of one field; an
    empty table gives an empty table; columns of ``lines`` keep their names and values.
    """
    marked, structure = "__marked", "__structure"
    text = F.coalesce(F.col(line), F.lit(""))
    out = lines.withColumn(marked, F.replace(F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED[ESCAPE])), F.lit(MARK), F.lit(ESCAPED[MARK])), F.col(delimiter), F.lit(MARK)))
    out = out.withColumn(structure, F.regexp_replace(marked, f'[^"{MARK}]+', "x"))
    out = out.withColumn("edits", _edits_udf()(F.col(structure), F.lit(width)))
    raw = F.regexp_extract_all(F.concat(F.lit(MARK), F.col(marked)), F.lit(f'{MARK}("(?:[^"]++|"")*+"|[^"{MARK}]*)'), F.lit(1))
    written = lambda v: F.replace(F.replace(F.replace(v, F.lit(MARK), F.col(delimiter)), F.lit(ESCAPED[MARK]), F.lit(MARK)), F.lit(ESCAPED[ESCAPE]), F.lit(ESCAPE))
    clean = F.transform(raw, lambda v: blank_trim(written(F.when(v.startswith('"'), F.replace(v.substr(F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v))))
    e = F.col("edits")
    quoting, columns = e.quotes_inserted + e.quotes_deleted > 0, e.delimiters_inserted + e.delimiters_deleted > 0
    out = out.withColumn(fields, F.when(~quoting & ~columns, clean))

    def bad(values: Column) -> Column:
        wrong = F.lit(False)
        for k, check in enumerate(valid):
            wrong = wrong | ~F.coalesce(check(F.get(values, F.lit(k))), F.lit(False))
        return wrong

    # bound as the variable of a lambda, so that all checks share one evaluation of the fields
    wrong = F.get(F.transform(F.array(F.col(fields)), bad), F.lit(0))
    return out.withColumn("reason", F.when(quoting, "quoting").when(columns, "columns").when(wrong, "value")).drop(marked, structure)


def real_date(column: Column) -> Column:
    return F.when(column.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), column.try_cast("date").isNotNull()).otherwise(False)


PARCEL = r"^[A-Z]{3}-[0-9]{2,8}$"
SENSOR = r"^S-[0-9]{1,5}$"
READING = r"^(?:[+-]?[0-9]{1,6}(?:\.[0-9]+)?)?$"
SHIPPING_STATUS = r"^(?i:delivered|delayed|in transit|held|returned|lost)$"
SENSOR_STATUS = r"^(?i:stable|watch|critical|offline)$"
HEADER_NAMES = ("sensor", "reading_mm", "status", "measured_on")


def _header_pattern() -> str:
    cell = [rf'[ ]*(?:"[ ]*{n}[ ]*"|{n})[ ]*' for n in HEADER_NAMES]
    return rf"^[ \t\r\n]*{cell[0]}([\t,;|]){cell[1]}\1{cell[2]}\1{cell[3]}[ \t\r\n]*$"


def parse_shipping(shipping: DataFrame) -> DataFrame:
    """Shipping lines, put together again from their pieces, with ``fields``, ``edits`` and ``reason``."""
    line = F.concat_ws("\t", "parcel", "city", "status", "extra")
    lines = shipping.select("row_id", "rel_path", "line_no", "loaded_at", line.alias("line"), F.lit("\t").alias("delimiter"))
    valid = [lambda c: c.rlike(PARCEL), lambda c: c.isNotNull(), lambda c: c.rlike(SHIPPING_STATUS)]
    return parse_lines(lines, "line", "delimiter", 3, valid)


def sheet_headers(measurements: DataFrame) -> DataFrame:
    """For each file its first header line: one row per file, made before any shuffle from header lines only."""
    found = F.regexp_extract("c0", _header_pattern(), 1)
    lines = measurements.select("rel_path", "line_no", found.alias("delimiter")).where(F.col("delimiter") != "")
    return lines.groupBy("rel_path").agg(F.min_by("delimiter", "line_no").alias("delimiter"), F.min("line_no").alias("header_line"))


def parse_measurements(measurements: DataFrame) -> DataFrame:
    """Measurement lines after their file's header, without blank lines, with ``fields``, ``edits`` and ``reason``.

    Files without a header line, and lines without a place in their file (null ``line_no``), hold no records.  The
    header side is some hundred times smaller than the lines; the planner broadcasts it where its measured size allows,
    otherwise both sides are shuffled and a file that holds a large part of the lines is split as a skewed join.
    """
    heads = sheet_headers(measurements).withColumnRenamed("rel_path", "__file")
    lines = measurements.select("row_id", "rel_path", "line_no", "loaded_at", F.col("c0").alias("line"))
    lines = lines.where(blank_trim(F.coalesce("line", F.lit(""))) != "")
    lines = lines.join(heads, lines.rel_path.eqNullSafe(heads["__file"])).where(F.col("line_no") > F.col("header_line")).drop("__file")
    valid = [lambda c: c.rlike(SENSOR), lambda c: c.rlike(READING), lambda c: c.rlike(SENSOR_STATUS), real_date]
    return parse_lines(lines, "line", "delimiter", 4, valid)


def rejected_rows(shipping: DataFrame, measurements: DataFrame) -> DataFrame:
    """(table_name, row_id, reason) of every line of either table that is no valid record."""
    parts = [(parse_shipping(shipping), "shipping"), (parse_measurements(measurements), "measurements")]
    parts = [p.where(F.col("reason").isNotNull()).select(F.lit(name).alias("table_name"), "row_id", "reason") for p, name in parts]
    return parts[0].unionByName(parts[1])


def loaded_shipping(shipping: DataFrame) -> DataFrame:
    """The valid shipping lines as typed rows; an absent city is null."""
    f = F.col("fields")
    return parse_shipping(shipping).where(F.col("reason").isNull()).select("row_id", F.get(f, F.lit(0)).alias("parcel"), F.nullif(F.get(f, F.lit(1)), F.lit("")).alias("city"), F.lower(F.get(f, F.lit(2))).alias("status"))


def loaded_measurements(measurements: DataFrame) -> DataFrame:
    """The valid measurement lines as typed rows; an empty reading is null."""
    f = F.col("fields")
    return parse_measurements(measurements).where(F.col("reason").isNull()).select(
        "row_id", F.get(f, F.lit(0)).alias("sensor"), F.nullif(F.get(f, F.lit(1)), F.lit("")).cast("double").alias("reading_mm"),
        F.lower(F.get(f, F.lit(2))).alias("status"), F.get(f, F.lit(3)).try_cast("date").alias("measured_on"))
