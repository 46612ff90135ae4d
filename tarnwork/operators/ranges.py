"""Running values over a table in order, by ranges of the order: each range apart, one row per range to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written


def ranged(rows: DataFrame, order: Sequence[str], add: dict[str, Column] | None = None) -> DataFrame:
    """rows dealt to ranges of order, written, with __part, the number of the range, and the columns of add."""
    return written(rows.withColumns(add or {}).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def running_totals(rows: DataFrame, order: Sequence[str], sizes: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """rows with, per name in sizes, the sum of that size over all rows before in order; and the sums of all rows."""
    spark, names = rows.sparkSession, list(sizes)
    parts = ranged(rows, order, {f"__{n}": c.cast("long") for n, c in sizes.items()})
    totals = dict.fromkeys(names, 0)
    starts = []
    for r in sorted(parts.groupBy("__part").agg(*[F.sum(f"__{n}").alias(n) for n in names]).collect()):
        starts.append((r["__part"], *totals.values()))
        totals = {n: totals[n] + r[n] for n in names}
    offsets = F.broadcast(spark.createDataFrame(starts, "__part int, " + ", ".join(f"__start_{n} long" for n in names)))
    before = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = parts.join(offsets, "__part")
    made = {n: F.col(f"__start_{n}") + F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)) for n in names}
    return found.withColumns(made).select(*rows.columns, *names), totals


def last_seen(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """rows with seen: the last value that is not null among the rows of key up to each, in order.

    A range that starts within a key goes on from what the ranges before it saw last.
    """
    spark = rows.sparkSession
    kinds = {c: t for c, t in rows.dtypes}
    named = rows.withColumn("__value", value)
    kind = dict(named.dtypes)["__value"]
    parts = ranged(named, [*key, *order])
    # per range: its last key, and what was seen last of it there
    newest = F.max_by(F.struct(*key, F.col("__seen").alias("seen")), F.struct(*key, *order)).alias("last")
    upto = Window.partitionBy("__part", *key).orderBy(*order)
    local = parts.withColumn("__seen", F.last("__value", ignorenulls=True).over(upto))
    carried, held = [], None
    for r in sorted(local.groupBy("__part").agg(newest).collect(), key=lambda r: r["__part"]):
        if held is not None:
            carried.append((r["__part"], *held))
        own = tuple(r["last"][c] for c in key)
        seen = r["last"]["seen"]
        held = (*own, held[-1] if seen is None and held is not None and held[:-1] == own else seen)
    schema = "__part int, " + ", ".join(f"__k_{c} {kinds[c]}" for c in key) + f", __carried {kind}"
    before = F.broadcast(spark.createDataFrame(carried, schema))
    same = F.col("__of") == F.col("__part")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    joined = local.join(before.withColumnRenamed("__part", "__of"), same, "left")
    return joined.select(*rows.columns, F.coalesce("__seen", "__carried").alias("seen"))
