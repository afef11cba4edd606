"""Sharding by best-fit-decreasing bin packing: groups that must stay whole, sorted by
size, enter the shard with the tightest remaining capacity that still holds them.

A group is all rows of equal text. Packing is sequential, so it runs on a list that is
bounded at any corpus size: groups of at least 1 / (shards * LARGE) of all bytes are
items of their own (at most shards * LARGE), all smaller groups go whole into PARCELS
parcels by their hash. The free capacities stand in a sorted list (a balanced tree's
work: bisection finds the tightest bin), the capacity is the least at which all items
fit, and a group above the mean shard gets a shard of its own. Item sizes come from one
aggregation; rows get their place in the shard from counts by (item, lane), so a group
with a third of all rows is still numbered by many tasks.

Defined results: null text is a group of its own with size 1 a row; an empty table gives
an empty result; repeated rows are numbered one by one, in an order that their columns
doc_id and text fix.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import col, need, staged

SHARDS = 16
PARCELS = 4096
LARGE = 256
LANES = 32


def best_fit(sizes: list[tuple[int, int]], bins: int, capacity: int) -> list[tuple[int, int]] | None:
    """(item, bin) for (size, item) sorted by falling size, or None if they don't fit."""
    free = [(capacity, b) for b in range(bins)]
    out = []
    for size, item in sizes:
        at = bisect_left(free, (size, -1))
        if at == len(free):
            return None
        room, b = free.pop(at)
        insort(free, (room - size, b))
        out.append((item, b))
    return out


def pack(sizes: dict[int, int], bins: int) -> dict[int, int]:
    """Item -> bin: items above the mean of what is left stand alone, the others are
    packed by best fit at the least capacity that holds them."""
    items = sorted(((s, i) for i, s in sizes.items()), key=lambda x: (-x[0], x[1]))
    out, left = {}, sum(sizes.values())
    while items and bins - len(out) > 1 and items[0][0] * (bins - len(out)) > left:
        size, item = items.pop(0)
        out[item] = len(out)
        left -= size
    alone, rest = len(out), bins - len(out)
    low = max([-(-left // rest), *(s for s, _ in items[:1])])
    high = low + sum(s for s, _ in items[:1]) + 1
    while (found := best_fit(items, rest, high)) is None:
        low, high = high + 1, high * 2
    while low < high:
        mid = (low + high) // 2
        tried = best_fit(items, rest, mid)
        low, high, found = (low, mid, tried) if tried is not None else (mid + 1, high, found)
    return out | {item: alone + b for item, b in found}


def sharded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, parcels: int = PARCELS) -> DataFrame:
    """One row for each document: doc_id, size (bytes + 1), text_crc32, law "bytes",
    shard, slot (gapless from 0 within the shard), grown_shard (null: this law has none)."""
    need(docs, doc_id, text)
    raw = col(text).cast("string")
    size = (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long")
    body = F.coalesce(raw, F.lit("")).cast("binary")
    digest = F.when(raw.isNull(), F.lit("")).otherwise(F.md5(body))
    rows = docs.select(col(doc_id).alias("doc_id"), size.alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(digest, size).alias("g1"), F.xxhash64(F.reverse(digest), size).alias("g2"))
    rows = staged(rows, "sizes", few=True)
    total = rows.agg(F.sum("size")).first()[0] or 0
    least = max(1, -(-total // (shards * LARGE)))
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"))
    big = groups.where(F.col("bytes") >= least).orderBy(F.col("bytes").desc(), "g1", "g2").collect()
    spark = docs.sparkSession
    # at most shards * LARGE groups can reach `least`, so this table may be broadcast
    own = spark.createDataFrame([(r.g1, r.g2, parcels + i) for i, r in enumerate(big)], "g1 long, g2 long, own int")
    rows = rows.join(F.broadcast(own), ["g1", "g2"], "left")
    item = F.coalesce("own", F.pmod(F.col("g1"), F.lit(parcels)).cast("int"))
    rows = rows.select("doc_id", "size", "text_crc32", "g1", "g2", item.alias("item"), F.pmod(F.xxhash64("doc_id"), F.lit(LANES)).cast("int").alias("lane"))
    counts = staged(rows.groupBy("item", "lane").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "counts")
    sizes = {r[0]: r[1] for r in counts.groupBy("item").agg(F.sum("bytes")).collect()}
    place = spark.createDataFrame(sorted(pack(sizes, shards).items()), "item int, shard int")
    w = Window.partitionBy("shard").orderBy("item", "lane").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.join(F.broadcast(place), "item").select("item", "lane", "shard", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    turn = F.row_number().over(Window.partitionBy("item", "lane").orderBy("doc_id", "g1", "g2")) - 1
    out = rows.withColumn("turn", turn).join(before, ["item", "lane"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("turn")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
