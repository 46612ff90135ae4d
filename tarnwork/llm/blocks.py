"""Dealing ordered rows to blocks so that each row meets its neighbours in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks per shuffle partition, so that hashing blocks to partitions evens out; blocks at most.
BLOCKS_PER_PARTITION, MOST_BLOCKS = 4, 20_000
#: Keys of the sample that sets the bounds, per block.
SAMPLED_PER_BLOCK = 20
#: Stands between the bounds in one literal; no key holds it.
BETWEEN = "\x02"


def _literal(values: list[str]) -> Column:
    """Constant array of strings, as one folded literal."""
    return F.split(F.lit(BETWEEN.join(values)), BETWEEN) if values else F.array().cast("array<string>")


def deal(rows: DataFrame, key: str, keys: DataFrame | None = None, ring: bool = False) -> DataFrame:
    """rows with their block and guest: 0 in the block that is theirs; key is a string column that orders the rows.

    Blocks are ranges of the key. The first and last rows of a block are also
    guests of the blocks beside it, -1 if they come before it and 1 if after,
    so a window over a block by (guest, key) sees the neighbours of all its
    rows; in a ring the last block is beside the first. The bounds come from a sample of the keys and decide on
    balance only. The driver gets 20 keys for each of at most 20,000 blocks.
    keys: the same keys by a cheaper plan, if there is one.
    """
    spark = rows.sparkSession
    wanted = min(MOST_BLOCKS, BLOCKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = rows.select(key) if keys is None else keys
    total = keys.count()
    share = min(1.0, SAMPLED_PER_BLOCK * wanted / max(total, 1))
    sample = sorted(r[0] for r in (keys if share == 1.0 else keys.sample(share, seed=1)).collect())
    bounds = sorted({sample[i * len(sample) // wanted] for i in range(1, wanted)}) if sample else []
    # a search in two steps, each over about the root of the number of bounds
    width = max(1, math.isqrt(len(bounds)))
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col(key)))
    coarse = below(_literal(bounds[width - 1 :: width]))
    block = (coarse * width + below(F.slice(_literal(bounds), coarse * width + 1, F.lit(width)))).cast("int") if bounds else F.lit(0)
    ends = sorted((r["block"], r["low"], r["high"]) for r in keys.select(key, block.alias("block")).groupBy("block").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect())
    beside = list(zip(ends, ends[1:], strict=False))
    if ring and len(ends) > 1:
        beside.append((ends[-1], ends[0]))
    visits = [(b[1], a[0], 1) for a, b in beside] + [(a[2], b[0], -1) for a, b in beside]
    own = F.array(F.struct(block.alias("block"), F.lit(0).alias("guest")))
    if not visits:
        return rows.select("*", F.inline(own))
    # two rows per block at most
    places = spark.createDataFrame(visits, "visitor string, block int, guest int").groupBy("visitor").agg(F.collect_list(F.struct("block", "guest")).alias("places"))
    placed = rows.join(F.broadcast(places), F.col(key) == F.col("visitor"), "left")
    return placed.select(*rows.columns, F.inline(F.concat(own, F.coalesce("places", F.array().cast("array<struct<block:int,guest:int>>")))))
