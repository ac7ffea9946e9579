"""Filling fixed-capacity containers (problem 7).

Texts are spread over groups of bounded size; in each, sets that dominate all others of their largest item (Martello and
Toth) are fixed for good, and what remains is packed best-fit in decreasing order.  A group leaves at most about one
container badly filled, so the loss does not grow with the corpus.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.tokens import TOKENIZER, token_count
from loomtext.runtime import durable, table

GROUP = 4_000  # items of a group, on average
POOL_BLOCK = 1_000  # pools that are written into one plan, on average; more make more plans


def _dominating(values: list[int], size: int, room: int) -> list[int] | None:
    """Of the items ``values`` (ascending) those that a set with an item of ``size`` takes which dominates every other set
    with it; None if no such set is known.

    Alone where nothing fits; with an item that fills the container, or with the largest that fits where no two fit or no
    two that fit weigh more; where no three fit, with the largest that leaves room for another and the largest beside it,
    if no other pair has a larger lesser item."""
    at = bisect_right(values, room) - 1
    if at < 0:
        return []
    if values[at] == room or at == 0 or values[0] + values[1] > room:
        return [at]
    if at >= 2 and values[0] + values[1] + values[2] <= room:
        return None
    best = 0  # the heaviest pair that fits
    for x in range(at, 0, -1):
        if 2 * values[x] <= best:
            break
        y = min(bisect_right(values, room - values[x]) - 1, x - 1)
        if y >= 0:
            best = max(best, values[x] + values[y])
    if values[at] >= best:
        return [at]
    y = min(bisect_right(values, room - values[at]) - 1, at - 1)
    if y >= 0:
        low, high = 0, at  # the last place whose item fits with the next one
        while low < high - 1:
            mid = (low + high) // 2
            low, high = (mid, high) if values[mid] + values[mid + 1] <= room else (low, mid)
        if values[low] <= values[y]:
            return [y, at]
    return None


def reduce_by_dominance(sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """(containers fixed, items left), as positions in ``sizes``, all within ``capacity``.

    Items are tried from the largest down; what is fixed shrinks the instance, so the passes are repeated until one fixes
    nothing."""
    order = sorted(range(len(sizes)), key=lambda k: sizes[k])
    values = [sizes[k] for k in order]  # ascending
    fixed, again = [], True
    while again:
        again, k = False, len(order) - 1
        while k >= 0:
            item, size = order.pop(k), values.pop(k)
            others = _dominating(values, size, capacity - size)
            if others is None:
                order.insert(k, item)
                values.insert(k, size)
            else:
                fixed.append([item, *(order[o] for o in others)])
                for o in sorted(others, reverse=True):
                    order.pop(o)
                    values.pop(o)
                again = True
                k -= sum(o < k for o in others)
            k -= 1
    return fixed, order[::-1]


def best_fit(sizes: list[int], items: list[int], capacity: int) -> list[list[int]]:
    """Items, largest first, each into the fullest container that takes it."""
    rooms: list[tuple[int, int]] = []  # (room, container), ascending
    out: list[list[int]] = []
    for k in sorted(items, key=lambda k: -sizes[k]):
        at = bisect_left(rooms, (sizes[k], -1))
        if at == len(rooms):
            out.append([k])
            insort(rooms, (capacity - sizes[k], len(out) - 1))
        else:
            room, c = rooms.pop(at)
            out[c].append(k)
            insort(rooms, (room - sizes[k], c))
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "part"], kind="stable").reset_index(drop=True)
    sizes, capacity = pdf["tokens"].tolist(), int(pdf["capacity"].iloc[0])
    fixed, left = reduce_by_dominance(sizes, capacity)
    containers = fixed + best_fit(sizes, left, capacity)
    number, fill = [0] * len(sizes), [0] * len(sizes)
    by_dominance = [False] * len(sizes)
    for c, items in enumerate(containers):
        total = sum(sizes[k] for k in items)
        for k in items:
            number[k], fill[k], by_dominance[k] = c, total, c < len(fixed)
    pdf["container"] = pdf["pool"] + "-" + pdf["grp"].astype(str) + "-" + pd.Series(number, dtype="int64").astype(str)
    pdf["fill"] = pd.Series(fill, dtype="int32")
    pdf["fixed"] = by_dominance
    return pdf[["pool", "container", "doc_id", "part", "token_start", "tokens", "capacity", "fill", "fixed"]]


def pack(documents: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER, block: int = POOL_BLOCK) -> DataFrame:
    """For each pool a packing of all texts: one row per text, or per part of a text larger than a container.

    ``token_start`` is where a part starts in its text's tokens.  Null and empty texts have no tokens and no row; equal
    texts are packed each on its own; ``fixed`` tells the containers that dominance fixed; pools without a positive capacity take nothing;
    a pool that is listed more than once has its largest capacity.  Pools are taken in blocks of about ``block``, however many there are.
    """
    pools = limits.where("capacity_tokens > 0 AND pool IS NOT NULL").groupBy("pool").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    schema = "pool string, container string, doc_id bigint, part int, token_start int, tokens int, capacity int, fill int, fixed boolean"
    blocks = -(-pools.count() // block)
    if not blocks:
        return documents.sparkSession.createDataFrame([], schema)
    sized = durable(documents.where("text IS NOT NULL AND text <> ''").select("doc_id", token_count(F.col("text"), tokenizer).alias("n")))
    groups = max(1, -(-sized.count() // GROUP))
    of_block = (pools.where(F.pmod(F.xxhash64("pool"), F.lit(blocks)) == b).collect() for b in range(blocks))
    return reduce(DataFrame.unionByName, [_packed(sized, some, groups, schema) for some in of_block if some])


def _packed(sized: DataFrame, pools: list, groups: int, schema: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(p["pool"]).alias("pool"), F.lit(int(p["capacity_tokens"])).alias("capacity")) for p in pools]))
    items = sized.where("n > 0").select("doc_id", "n", each.alias("p")).select("doc_id", "n", "p.*")
    last = F.ceil(F.col("n") / F.col("capacity")).cast("int") - 1
    items = items.select("*", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    start = (F.col("part") * F.col("capacity")).cast("int")
    items = items.select("pool", "capacity", "doc_id", "part", start.alias("token_start"), F.least(F.col("capacity"), F.col("n") - start).cast("int").alias("tokens"))
    # parts of one huge text are spread too, so that no group holds them all
    items = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "part"), F.lit(groups)).cast("int"))
    return items.groupBy("pool", "grp").applyInPandas(_pack, schema)


def fill_of(packed: DataFrame) -> DataFrame:
    """For each pool its containers, their mean fill, and the room left over."""
    one = packed.groupBy("pool", "container").agg(F.sum("tokens").alias("tokens"), F.first("capacity").alias("capacity"), F.max("fixed").alias("fixed"))
    return one.groupBy("pool").agg(F.count("*").alias("containers"), F.count_if("fixed").alias("fixed_by_dominance"), F.sum("tokens").alias("tokens"), F.sum(F.col("capacity") - F.col("tokens")).alias("unused"), F.avg(F.col("tokens") / F.col("capacity")).alias("mean_fill"))


def _inputs(spark, d):
    return table(spark, d, "documents"), table(spark, d, "pack_limits")


QUERIES = {
    "p7_containers": lambda spark, d: pack(*_inputs(spark, d)),
    "p7_fill": lambda spark, d: fill_of(pack(*_inputs(spark, d))),
}
SQL: dict[str, str] = {}
