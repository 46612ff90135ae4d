"""Accounts of a run as a scan: what was reserved and spent before each call, and the call at which the run stops.

A run keeps a quota window, the tokens reserved or used so far. A reservation
of t tokens is x -> x + t; its settlement by u used tokens gives the
reservation back first, x -> max(0, x - t) + u. Both have the form
x -> max(a, x + b), and so has one after the other, so the window before each
event is a running sum and a running maximum. Ranges of the order are scanned
apart and the driver adds up one row per range.

A call is refused if a ceiling is reached when it comes: cost, then tokens,
then requests, then the quota its reservation would not fit into. The run has
then stopped: all later calls are refused for the same reason, and up to there
none was, so the first such call in the order decides all.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written

REASONS = ("cost_ceiling", "token_ceiling", "quota_requests", "quota_tokens")
MONEY = "decimal(28,9)"


class Limits(NamedTuple):
    """None: no limit."""

    requests: int | None = None
    quota_tokens: int | None = None
    tokens_per_run: int | None = None
    cost: str | None = None


class Settled(NamedTuple):
    #: call events with quota_before, requests_before, tokens_before, cost_before, accepted, reason
    events: DataFrame
    #: per tier: calls, cached, unreported, refused, tokens, cost
    tiers: DataFrame
    #: one row: requests, quota, tokens, cost, reason, stopped_at (null where the run did not stop)
    run: DataFrame


def _before(events: DataFrame) -> DataFrame:
    """events with the state before each, if none before it was refused."""
    spark = events.sparkSession
    zero = F.lit(0).cast("long")
    reserve, live = F.col("kind") == "reserve", (F.col("kind") == "charge") & ~F.coalesce("cached", F.lit(False))
    given_back = F.coalesce("reserved", zero)
    add = F.when(reserve, F.greatest(zero, F.col("tokens"))).when(live, F.col("tokens") - given_back).otherwise(zero)
    # a settlement leaves what was used at least
    least = F.when(live & F.col("reserved").isNotNull(), F.col("tokens"))
    used, spent = F.when(live, F.col("tokens")).otherwise(zero), F.when(live, F.col("cost")).otherwise(F.lit(0)).cast(MONEY)
    made = events.withColumns({"__add": add.cast("long"), "__least": least.cast("long"), "__used": used.cast("long"), "__cost": spent, "__request": reserve.cast("long")})
    ranged = written(made.repartitionByRange("place").withColumn("__part", F.spark_partition_id()))
    upto = Window.partitionBy("__part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("__sum", F.sum("__add").over(upto)).withColumn("__floor", F.col("__least") - F.col("__sum"))
    totals = summed.groupBy("__part").agg(F.sum("__add").alias("add"), F.max("__floor").alias("floor"), *[F.sum(f"__{c}").alias(c) for c in ("used", "cost", "request")])
    starts, quota, tokens, cost, requests = [], 0, 0, 0, 0
    # one row per range
    for r in sorted(totals.collect()):
        starts.append((r["__part"], quota, tokens, cost, requests))
        quota = max(quota, quota if r.floor is None else r.floor) + r["add"]
        tokens, cost, requests = tokens + r.used, cost + r.cost, requests + r.request
    offsets = F.broadcast(spark.createDataFrame([(p, q, n, str(c), k) for p, q, n, c, k in starts], "__part int, __quota long, __tokens long, __money string, __requests long"))
    so_far = lambda c, kind="long": F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast(kind)
    found = summed.join(offsets, "__part").withColumns(
        {
            "quota_before": F.greatest(F.col("__quota"), F.max("__floor").over(earlier)) + so_far("__add"),
            "requests_before": F.col("__requests") + so_far("__request"),
            "tokens_before": F.col("__tokens") + so_far("__used"),
            "cost_before": (F.col("__money").cast(MONEY) + so_far("__cost", MONEY)).cast(MONEY),
        }
    )
    return found.drop("__part", "__sum", "__floor", "__quota", "__tokens", "__money", "__requests")


def _stop(limits: Limits) -> Column:
    """Why a reservation is refused, null if it is not."""
    never = F.lit(False)
    at_least = lambda c, most, kind: never if most is None else F.col(c) >= F.lit(most).cast(kind)
    fits = never if limits.quota_tokens is None else F.col("quota_before") + F.greatest(F.lit(0), F.col("tokens")) > limits.quota_tokens
    tests = (at_least("cost_before", limits.cost, MONEY), at_least("tokens_before", limits.tokens_per_run, "long"), at_least("requests_before", limits.requests, "long"), fits)
    reason = F.lit(None).cast("string")
    for name, test in reversed(list(zip(REASONS, tests, strict=True))):
        reason = F.when(test, name).otherwise(reason)
    return F.when(F.col("kind") == "reserve", reason)


def settle(events: DataFrame, limits: Limits) -> Settled:
    """The account of events: place (their order, distinct), call_id, tier, kind, tokens, and of charges since, reserved, cached, cost.

    kind is reserve or charge. A charge settles the reservation made at place
    since, of reserved tokens (both null: none was made); a cached answer is
    counted and costs nothing. Charges of refused calls do not happen.
    """
    before = written(_before(events))
    first = before.withColumn("reason", _stop(limits)).where("reason is not null").agg(F.min(F.struct("place", "reason")).alias("x")).first().x
    stop, reason = (first.place, first.reason) if first else (None, None)
    origin = F.when(F.col("kind") == "reserve", F.col("place")).otherwise(F.col("since"))
    accepted = F.lit(True) if stop is None else F.coalesce(origin < F.lit(stop), F.lit(True))
    known = before.withColumn("accepted", accepted).withColumn("reason", F.when(~F.col("accepted"), F.lit(reason)))
    happened, live = F.col("accepted") & (F.col("kind") == "charge"), ~F.coalesce("cached", F.lit(False))
    tiers = known.groupBy("tier").agg(
        F.count_if(happened & live).alias("calls"),
        F.count_if(happened & ~live).alias("cached"),
        F.count_if(happened & live & (F.col("tokens") == 0)).alias("unreported"),
        F.count_if(~F.col("accepted") & (F.col("kind") == "reserve")).alias("refused"),
        F.sum(F.when(happened & live, F.col("tokens")).otherwise(0)).cast("long").alias("tokens"),
        F.sum(F.when(happened & live, F.col("cost").cast(MONEY)).otherwise(F.lit(0).cast(MONEY))).cast(MONEY).alias("cost"),
    )
    # what is left of the window: the charges in flight when the run stopped still settle
    left = _before(known.where("accepted").select(*events.columns))
    after = F.greatest("__least", F.col("quota_before") + F.col("__add"))
    money = F.col("cost_before") + F.col("__cost")
    end = F.max_by(F.struct(after.alias("quota"), (F.col("requests_before") + F.col("__request")).alias("requests"), (F.col("tokens_before") + F.col("__used")).alias("tokens"), money.cast(MONEY).alias("cost")), "place").alias("e")
    run = left.agg(end).select(*[F.coalesce(f"e.{c}", F.lit(0)).alias(c) for c in ("requests", "quota", "tokens", "cost")], F.lit(reason).cast("string").alias("reason"), F.lit(stop).cast("long").alias("stopped_at"))
    return Settled(known.drop("__add", "__least", "__used", "__cost", "__request"), tiers, run)
