"""Filling fixed-capacity containers (problem 7): minimum bin slack.

Items are dealt by hash to blocks of bounded size; inside a block each container is filled from a window of the
largest remaining lengths by a bitset subset-sum: bit s of row k tells that the first k lengths can sum to s. The
highest reachable sum not above the capacity is the fill, and walking the rows back gives how many items of each
length it takes. The largest remaining item always goes in, so every container makes progress.

An item above the capacity is split into full pieces and a rest; only these are split. Items of null or no tokens
are left out (nothing has to be put anywhere). Repeated item ids are packed once. Ties go to the smaller id.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces in a block; a block wastes at most its last, unfilled container.
BLOCK = 4096
#: Distinct lengths offered to the subset sum of one container.
WINDOW = 48


def fill(lengths: list[int], capacity: int) -> list[int]:
    """Indexes (into ``lengths``, sorted from large to small) of a subset with the largest sum up to ``capacity``."""
    mask = (1 << (capacity + 1)) - 1
    rows = [1]
    for n in lengths:
        rows.append(rows[-1] | (rows[-1] << n) & mask)
        if rows[-1] >> capacity & 1:
            break
    left, taken = rows[-1].bit_length() - 1, []
    for k in range(len(rows) - 1, 0, -1):
        if not rows[k - 1] >> left & 1:
            taken.append(k - 1)
            left -= lengths[k - 1]
    return taken


def pack(sizes: list[int], capacity: int, window: int = WINDOW) -> list[int]:
    """The container, numbered from 0, of each item; no item is above ``capacity``."""
    by: dict[int, list[int]] = defaultdict(list)
    for i in range(len(sizes) - 1, -1, -1):
        by[sizes[i]].append(i)
    lengths = sorted(by)
    out, bin_no = [0] * len(sizes), 0
    while lengths:
        seed = lengths[-1]
        room, pick = capacity - seed, [seed]
        fits = bisect_right(lengths, room)
        if fits:
            # The window: lengths spread evenly over all that fit, each as often as it is left and fits.
            at = range(fits - 1, -1, -1) if fits <= window else [fits - 1 - k * (fits - 1) // (window - 1) for k in range(window)]
            offer = [n for n in (lengths[k] for k in at) for _ in range(min(len(by[n]) - (n == seed), room // n, window))]
            pick += [offer[k] for k in fill(offer, room)]
        for n in pick:
            out[by[n].pop()] = bin_no
            if not by[n]:
                del lengths[bisect_left(lengths, n)]
        bin_no += 1
    return out


def pack_items(items: DataFrame, capacities: DataFrame, *, item: str = "doc_id", size: str = "n_tokens", name: str = "container_name", capacity: str = "capacity_tokens", block: int = BLOCK) -> DataFrame:
    """(name, container_id, item, piece_no, n_pieces, piece_tokens, capacity) for each capacity and piece of an item.

    ``items`` is read twice (write it first if it is dear). ``capacities`` is a fixed list of at most a thousand rows;
    rows of it without name or a positive capacity are left out.
    """
    items = items.select(F.col(item).alias("item"), F.col(size).cast("long").alias("size")).filter("item IS NOT NULL AND size > 0").groupBy("item").agg(F.max("size").alias("size"))
    caps = capacities.select(F.col(name).alias("container"), F.col(capacity).cast("long").alias("cap")).filter("container IS NOT NULL AND cap > 0").distinct().orderBy("container", "cap").limit(1001).collect()
    if len(caps) > 1000:
        raise ValueError("capacities is meant as a short fixed list")
    blocks = max(1, -(-items.count() // block))
    each = F.array(*[F.struct(F.lit(c.container).alias("container"), F.lit(c.cap).alias("cap")) for c in caps]).cast("array<struct<container:string,cap:bigint>>")
    at = items.withColumn("c", F.explode(each)).select("item", "size", "c.container", "c.cap")
    at = at.withColumn("n_pieces", F.ceil(F.col("size") / F.col("cap"))).withColumn("piece_no", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_pieces")))
    at = at.withColumn("piece_tokens", F.least("cap", F.col("size") - (F.col("piece_no") - 1) * F.col("cap")))
    full = at.filter("piece_tokens = cap").withColumn("container_id", F.concat_ws("-", "container", "item", "piece_no"))
    rest = at.filter("piece_tokens < cap").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["piece_tokens", "item"], ascending=[False, True], ignore_index=True)
        where = pack(pdf["piece_tokens"].tolist(), int(pdf["cap"].iat[0]))
        head = f"{pdf['container'].iat[0]}-b{pdf['block'].iat[0]}-"
        return pdf.drop(columns="block").assign(container_id=[f"{head}{k}" for k in where])

    rest = rest.groupBy("container", "cap", "block").applyInPandas(one, T.StructType([*rest.drop("block").schema.fields, T.StructField("container_id", T.StringType())]))
    out = full.unionByName(rest)
    return out.select(F.col("container").alias(name), "container_id", F.col("item").alias(item), "piece_no", "n_pieces", "piece_tokens", F.col("cap").alias(capacity))


def fill_report(packed: DataFrame, *, name: str = "container_name", capacity: str = "capacity_tokens") -> DataFrame:
    """Containers, tokens and unused share per capacity."""
    return packed.groupBy(name, capacity).agg(F.countDistinct("container_id").alias("containers"), F.sum("piece_tokens").alias("tokens")).withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * F.col(capacity)))
