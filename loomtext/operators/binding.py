"""Binding of an answer over extracted relations: matching, scoring, time, counting, listing, choosing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.extract import value_type
from loomtext.functions.text import clean_value, normalize


def matched(relations: DataFrame, target: list[str], wanted: list[str]) -> DataFrame:
    """Relations whose own material holds a wanted term and a target term, scored (4 a target, 3 a wanted, and 1), by
    confidence."""
    m = normalize(F.concat_ws(" ", "predicate", "subject", "value"))
    t = sum((m.contains(x).cast("int") for x in target), F.lit(0))
    r = sum((m.contains(x).cast("int") for x in wanted), F.lit(0))
    ok = (t > 0 if target else F.lit(True)) & (r > 0)
    return relations.where(ok).withColumn("score", F.round((4 * t + 3 * r + 1) * F.col("confidence"), 6))


def choose(candidates: DataFrame, *keys: str) -> DataFrame:
    """The best answer of each question: highest summed score of a canonical value, then the shorter, then the lesser."""
    c = candidates.withColumn("canonical", clean_value(F.col("value"))).where("canonical <> ''")
    scored = c.groupBy(*keys, "canonical").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("support"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.length("canonical"), "canonical"))
    out = scored.withColumn("__n", best).where("__n = 1")
    return out.select(*keys, F.col("canonical").alias("answer"), value_type(F.col("canonical")).alias("answer_type"), "score", "support", F.least(F.lit(0.95), F.greatest(F.lit(0.0), F.col("score") / 10)).alias("confidence"))


def by_time(events: DataFrame, key: str, time: str, order: str, latest: bool = True) -> DataFrame:
    """The latest (earliest) row of each key by the text of its time; of equal times the first in order.

    max_by and min_by aggregate map-side, so that a key with a third of the rows moves one row a task."""
    row = F.struct(*[c for c in events.columns if c != key])
    if latest:
        best = F.max_by(row, F.struct(F.col(time), -F.col(order)))
    else:
        best = F.min_by(row, F.struct(F.col(time), F.col(order)))
    return events.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def count_groups(relations: DataFrame, conditions: list[tuple[str, str]]) -> DataFrame:
    """How many record groups hold every (key, value) of the conditions."""
    want = [((normalize(F.col("subject")) == k) & (normalize(F.col("value")) == v)) for k, v in conditions]
    flags = [F.max(w.cast("int")).alias(f"c{n}") for n, w in enumerate(want)]
    groups = relations.groupBy("doc_id", "line", "record_group").agg(*flags)
    return groups.where(" AND ".join(f"c{n} = 1" for n in range(len(want)))).agg(F.count("*").alias("n"))


def list_values(candidates: DataFrame, *keys: str) -> DataFrame:
    """All distinct canonical values of each question in order, joined by '; '."""
    c = candidates.withColumn("canonical", clean_value(F.col("value"))).where("canonical <> ''")
    return c.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("canonical")), "; ").alias("answer"), F.countDistinct("canonical").alias("n"))


def ambiguous(candidates: DataFrame, key: str, time: str) -> DataFrame:
    """Questions without a time scope whose candidates hold two dates or more and two values or more."""
    return candidates.groupBy(key).agg(F.countDistinct(time).alias("dates"), F.countDistinct("value").alias("values")).where("dates >= 2 AND values >= 2")


def accessible(kind: Column, wanted: list[str]) -> Column:
    """Whether a context of ``kind`` may speak for facts: asserted, source, metadata and quality ones, and those asked for."""
    return kind.isin("asserted", "source", "metadata", *wanted) | kind.startswith("quality:")
