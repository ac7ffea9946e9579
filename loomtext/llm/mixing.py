"""Mixing sources to target weights (problem 8).

Every source gets as many expected copies a text as its share of the total asks for, the total being the largest that
no source's cap on repeats forbids.  Whole copies are certain; the fractions are rounded by the pivotal method, which
moves mass between two texts until one is integral and keeps the tokens drawn.  Groups of bounded size leave at most one
fraction each, and these are combined by a reduction tree until one is left a source.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.tokens import TOKENIZER, token_count
from loomtext.runtime import durable, table

GROUP, FAN = 4_000, 64  # texts of a first group on average; residuals that meet in a node of the tree
STATE = "source string, doc_id bigint, tokens int, base int, p double, grp int"


def pivotal(p: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities rounded to 0 and 1 but for at most one; the expectation of each is its ``p``, and the sum of
    ``weight * p`` stays what it was."""
    p = p.astype(float).copy()
    open_at = -1
    draws = rng.random(len(p))
    for j in range(len(p)):
        if p[j] <= 0 or p[j] >= 1:
            continue
        if open_at < 0:
            open_at = j
            continue
        i = open_at
        up = min((1 - p[i]) * weight[i], p[j] * weight[j])
        down = min(p[i] * weight[i], (1 - p[j]) * weight[j])
        move = up if draws[j] * (up + down) < down else -down
        p[i] += move / weight[i]
        p[j] -= move / weight[j]
        for k in (i, j):
            p[k] = 0.0 if p[k] < 1e-9 else 1.0 if p[k] > 1 - 1e-9 else p[k]
        open_at = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return p


HEAVY = 0.004  # of the expected tokens of a group: texts above it are settled first


def settle(p: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """``pivotal`` with the heavy texts first: their rounding error is spread over the probabilities of the others, so
    that the one fraction left belongs to a light text.  The expectation of each stays its ``p``."""
    p = p.astype(float).copy()
    heavy = weight > HEAVY * (weight * p).sum()
    light = ~heavy & (p > 0) & (p < 1)
    if heavy.any() and light.any():
        sure = pivotal(p[heavy], weight[heavy], rng)
        sure = np.where((sure > 0) & (sure < 1), rng.random(len(sure)) < sure, sure)
        over = ((sure - p[heavy]) * weight[heavy]).sum()
        room = p[light] if over > 0 else 1 - p[light]
        most = (room * weight[light]).sum()
        if abs(over) > most:
            return pivotal(p, weight, rng)
        p[heavy] = sure
        p[light] -= over * room / most
    at = np.argsort(-weight, kind="stable")
    out = p.copy()
    out[at] = pivotal(p[at], weight[at], rng)
    return out


def _round(seed: int, final: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        key = f"{seed}|{pdf['source'].iloc[0]}|{pdf['grp'].iloc[0]}|{final}"
        rng = np.random.default_rng(zlib.crc32(key.encode("utf-8", "surrogatepass")))
        p = settle(pdf["p"].to_numpy(), pdf["tokens"].to_numpy(float), rng)
        if final:
            p = np.where((p > 0) & (p < 1), rng.random(len(p)) < p, p)
        return pdf.assign(p=p.astype(float))

    return run


def expected_copies(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, doc_id, tokens, base, p, grp): certain copies and the fraction of another, of every text of a source
    that has a positive target."""
    sized = durable(documents.where("text IS NOT NULL AND text <> ''").select("doc_id", "source", token_count(F.col("text"), tokenizer).alias("tokens")).where("tokens > 0"))
    wanted = targets.where("target_share > 0 AND max_repeats > 0").select("source", "target_share", "max_repeats")
    have = sized.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("texts")).join(wanted, "source")
    total = have.agg(F.min(F.col("max_repeats") * F.col("have") / F.col("target_share")).alias("total"))
    copies = have.select("source", "texts", F.least(F.col("max_repeats").cast("double"), F.col("target_share") * total.scalar() / F.col("have")).alias("copies"))
    near = F.when(F.abs(F.col("copies") - F.round("copies")) < 1e-9, F.round("copies")).otherwise(F.col("copies"))
    groups = F.ceil(F.col("texts") / GROUP).cast("int")
    return sized.join(copies, "source").select("source", "doc_id", "tokens", F.floor(near).cast("int").alias("base"), (near - F.floor(near)).alias("p"), F.pmod(F.xxhash64("doc_id"), groups).cast("int").alias("grp"))


def draw(documents: DataFrame, targets: DataFrame, seed: int = 0, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, doc_id, tokens, repeats) of the texts drawn.

    Texts that are null or empty, and those of sources without a positive target, are not drawn; equal texts are drawn
    each on its own; a source with a target but no text has no row.  The same seed draws the same texts.
    """
    state = durable(expected_copies(documents, targets, tokenizer).groupBy("source", "grp").applyInPandas(_round(seed, False), STATE))
    groups = state.agg(F.coalesce(F.max("grp"), F.lit(0))).first()[0] + 1
    done, rest = state.where("p = 0 OR p = 1"), state.where("p > 0 AND p < 1")
    while True:
        final = groups <= FAN
        rest = durable(rest.withColumn("grp", (F.col("grp") / FAN).cast("int")).groupBy("source", "grp").applyInPandas(_round(seed, final), STATE))
        done, rest = done.unionByName(rest.where("p = 0 OR p = 1")), rest.where("p > 0 AND p < 1")
        groups = -(-groups // FAN)
        if final:
            break
    return done.select("source", "doc_id", "tokens", (F.col("base") + F.col("p")).cast("int").alias("repeats")).where("repeats > 0")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of each source of the targets."""
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.count("*").alias("texts"), F.max("repeats").alias("most_repeats"))
    all_of = got.agg(F.sum("drawn_tokens")).scalar()
    return targets.join(got, "source", "left").select("source", "target_share", F.coalesce("drawn_tokens", F.lit(0)).cast("bigint").alias("drawn_tokens"), F.coalesce("texts", F.lit(0)).cast("bigint").alias("texts"), F.coalesce("most_repeats", F.lit(0)).cast("int").alias("most_repeats"), (F.coalesce("drawn_tokens", F.lit(0)) / all_of).alias("actual_share"))


def _drawn(spark, d):
    return draw(table(spark, d, "documents"), table(spark, d, "mix_targets"))


QUERIES = {
    "p8_draw": _drawn,
    "p8_shares": lambda spark, d: shares(_drawn(spark, d), table(spark, d, "mix_targets")),
}
SQL: dict[str, str] = {}
