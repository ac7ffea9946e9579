"""Queries over lines that fail to parse (problem 1) and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.runtime import table
from loomtext.sources import delimited


def _both(f):
    return lambda spark, d: f(table(spark, d, "shipping"), table(spark, d, "measurements"))


def _edit_summary(shipping, measurements):
    """How many lines each kind of edit would repair, per table."""
    e = F.col("edits")
    parts = []
    for p, name in ((delimited.parse_shipping(shipping), "shipping"), (delimited.parse_measurements(measurements), "measurements")):
        parts.append(p.where("reason IN ('quoting', 'columns')").select(F.lit(name).alias("table_name"), "reason", (e.quotes_inserted + e.quotes_deleted).alias("quote_edits"), (e.delimiters_inserted + e.delimiters_deleted).alias("delimiter_edits")))
    return parts[0].unionByName(parts[1]).groupBy("table_name", "reason").agg(F.count("*").alias("n_lines"), F.sum("quote_edits").cast("bigint").alias("quote_edits"), F.sum("delimiter_edits").cast("bigint").alias("delimiter_edits"))


QUERIES = {
    "p1_found": _both(delimited.rejected_rows),
    "p1_shipping_rows": lambda spark, d: delimited.loaded_shipping(table(spark, d, "shipping")),
    "p1_measurement_rows": lambda spark, d: delimited.loaded_measurements(table(spark, d, "measurements")).withColumn("measured_on", F.col("measured_on").cast("timestamp")),
    "p1_edit_summary": _both(_edit_summary),
}

_FIELD = r'"(?:[^"]|"")*"|[^"\x01]*'
_PARSED = rf"""
WITH heads AS (
  SELECT rel_path, min(line_no) AS header_line, arg_min(regexp_extract(c0, '^\s*"?\s*sensor\s*"?\s*([\t,;|])', 1), line_no) AS d
  FROM measurements
  WHERE regexp_full_match(c0, '\s*(?:"\s*sensor\s*"|sensor)\s*([\t,;|])\s*(?:"\s*reading_mm\s*"|reading_mm)\s*[\t,;|]\s*(?:"\s*status\s*"|status)\s*[\t,;|]\s*(?:"\s*measured_on\s*"|measured_on)\s*')
  GROUP BY rel_path),
lines AS (
  SELECT 'shipping' AS table_name, row_id, concat_ws(chr(9), parcel, city, status, extra) AS line, chr(9) AS d, 3 AS n FROM shipping
  UNION ALL
  SELECT 'measurements', row_id, c0, d, 4 FROM measurements m JOIN heads h ON m.rel_path IS NOT DISTINCT FROM h.rel_path
  WHERE line_no > header_line AND trim(c0, chr(32) || chr(9) || chr(13) || chr(10)) <> ''),
marked AS (SELECT *, replace(line, d, chr(1)) AS m FROM lines),
split AS (SELECT *, regexp_full_match(m, '(?s)(?:{_FIELD})(?:\x01(?:{_FIELD}))*') AS quoted_well, regexp_extract_all(chr(1) || m, '(?s)\x01({_FIELD})', 1) AS raw FROM marked),
fields AS (SELECT *, list_transform(raw, lambda v: trim(replace(CASE WHEN starts_with(v, '"') THEN replace(substring(v, 2, length(v) - 2), '""', '"') ELSE v END, chr(1), d), chr(32) || chr(9) || chr(13) || chr(10))) AS f FROM split),
judged AS (
  SELECT *, CASE WHEN NOT quoted_well THEN 'quoting' WHEN len(raw) <> n THEN 'columns'
    WHEN table_name = 'shipping' AND NOT (regexp_full_match(f[1], '[A-Z]{{3}}-[0-9]{{2,8}}') AND regexp_full_match(f[3], '(?i)delivered|delayed|in transit|held|returned|lost')) THEN 'value'
    WHEN table_name = 'measurements' AND NOT (regexp_full_match(f[1], 'S-[0-9]{{1,5}}') AND regexp_full_match(f[2], '(?:[+-]?[0-9]{{1,6}}(?:\.[0-9]+)?)?')
      AND regexp_full_match(f[3], '(?i)stable|watch|critical|offline') AND regexp_full_match(f[4], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(f[4] AS DATE) IS NOT NULL) THEN 'value' END AS reason
  FROM fields)
"""
SQL = {
    "p1_found": _PARSED + "SELECT table_name, row_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_shipping_rows": _PARSED + "SELECT row_id, f[1] AS parcel, nullif(f[2], '') AS city, lower(f[3]) AS status FROM judged WHERE reason IS NULL AND table_name = 'shipping'",
    "p1_measurement_rows": _PARSED + "SELECT row_id, f[1] AS sensor, CAST(nullif(f[2], '') AS DOUBLE) AS reading_mm, lower(f[3]) AS status, CAST(f[4] AS TIMESTAMP) AS measured_on FROM judged WHERE reason IS NULL AND table_name = 'measurements'",
}
