"""Budgets: what fits into a context, run ledgers and accounts.

Selection skips what does not fit and goes on, so it is no running sum. Units
are sorted within partitions and folded as a stream with a few numbers of
state per candidate; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import rank
from ..plans.scratch import written
from ..values import UNIT_CLASSES


def unit_order() -> list[Column]:
    """The order in which a context presents its units."""
    return [rank(F.col("unit_class"), UNIT_CLASSES), F.col("relevance").desc(), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("evidence_id")]


def _select(batches: Iterator[pd.DataFrame], budget: int, max_units: int) -> Iterator[pd.DataFrame]:
    running, kept, spent = None, 0, 0
    for batch in batches:
        outcome = []
        for candidate, tokens, primary, primary_tokens, primaries in zip(batch["candidate_id"], batch["tokens"], batch["is_primary"], batch["primary_tokens"], batch["primaries"], strict=True):
            if candidate != running:
                running, kept, spent = candidate, int(primaries), int(primary_tokens)
            if primary_tokens > budget:
                outcome.append("primary_budget_exceeded")
            elif primary:
                outcome.append("kept")
            elif kept >= max_units:
                outcome.append("max_units")
            elif spent + tokens > budget:
                outcome.append("budget")
            else:
                kept, spent = kept + 1, spent + int(tokens)
                outcome.append("kept")
        yield batch.assign(outcome=outcome)[["candidate_id", "unit", "tokens", "outcome"]]


def select_units(units: DataFrame, budget: int, max_units: int) -> DataFrame:
    """candidate_id, unit, tokens, outcome of units (candidate_id, unit, place, tokens, is_primary).

    Primaries are kept unconditionally; where they alone exceed the budget all
    is dropped. Others follow in order of place: dropped by max_units first,
    by budget where they do not fit, else kept.
    """
    kinds = dict(units.dtypes)
    primary = units.where("is_primary").groupBy("candidate_id").agg(F.sum("tokens").alias("primary_tokens"), F.count(F.lit(1)).alias("primaries"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rows = units.join(primary, "candidate_id", "left").select("candidate_id", "unit", "place", F.col("tokens").cast("long").alias("tokens"), "is_primary", zero("primary_tokens"), zero("primaries"))
    in_order = rows.repartition("candidate_id").sortWithinPartitions("candidate_id", "place", "unit")
    return in_order.mapInPandas(lambda it: _select(it, budget, max_units), f"candidate_id {kinds['candidate_id']}, unit {kinds['unit']}, tokens long, outcome string")


def run_ledger(candidates: list[tuple[str, int]], per_run: int, per_candidate: int) -> list[tuple[str, int, int, bool]]:
    """candidate, allowance, spent after it, starved, in visiting order: a fold over one number per candidate on the driver."""
    out, spent = [], 0
    for candidate, tokens in candidates:
        allowance = min(per_candidate, max(0, per_run - spent))
        starved = allowance <= 0
        spent += 0 if starved else max(0, min(tokens, allowance))
        out.append((candidate, allowance, spent, starved))
    return out


def ledger(candidates: DataFrame, per_run: int, per_candidate: int) -> DataFrame:
    """candidates (candidate_id, place, tokens) with their allowance, what the run has spent after each, and starved.

    The same as run_ledger in order of (place, candidate_id), without a driver's
    list: no candidate takes more than its allowance, so what is spent is a
    running total, cut at the run's budget. Ranges of the order are summed
    apart; the driver sees one number per range.
    """
    spark = candidates.sparkSession
    takes = F.greatest(F.lit(0), F.least(F.col("tokens"), F.lit(per_candidate))).cast("long")
    ranged = written(candidates.withColumn("__takes", takes).repartitionByRange("place", "candidate_id").withColumn("__part", F.spark_partition_id()))
    starts, total = [], 0
    for part, n in sorted(map(tuple, ranged.groupBy("__part").agg(F.sum("__takes")).collect())):
        starts.append((part, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(starts, "__part int, __start long"))
    before = Window.partitionBy("__part").orderBy("place", "candidate_id").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.least(F.lit(per_run), F.col("__start") + F.coalesce(F.sum("__takes").over(before), F.lit(0))).cast("long")
    found = ranged.join(offsets, "__part").withColumn("__spent", spent)
    allowance = F.least(F.lit(per_candidate), F.greatest(F.lit(0), F.lit(per_run) - F.col("__spent"))).cast("long")
    known = found.withColumn("allowance", allowance).withColumn("starved", F.col("allowance") <= 0)
    return known.withColumn("spent", F.col("__spent") + F.least("__takes", F.greatest("allowance", F.lit(0)))).drop("__takes", "__part", "__start", "__spent")


class Account:
    """Calls, tokens and quota of a run, per tier. State of the driver: calls are made one after another."""

    def __init__(self, requests: int | None = None, tokens: int | None = None, per_run: int = 1_000_000, max_cost: float | None = None, pricing: Mapping[str, Mapping[str, float]] | None = None) -> None:
        self.request_limit, self.token_limit, self.per_run, self.max_cost, self.pricing = requests, tokens, per_run, max_cost, pricing or {}
        self.requests = self.reserved = 0
        self.usage: dict[str, dict[str, int]] = {}
        self.calls: dict[str, int] = {}
        self.cached: dict[str, int] = {}
        self.refused: list[str] = []
        self.stopped: str | None = None

    def reserve(self, tokens: int) -> int | None:
        tokens = max(0, tokens)
        if self.request_limit is not None and self.requests >= self.request_limit:
            self.stopped = "quota_requests"
        elif self.token_limit is not None and self.reserved + tokens > self.token_limit:
            self.stopped = "quota_tokens"
        else:
            self.requests, self.reserved, self.stopped = self.requests + 1, self.reserved + tokens, None
            return tokens
        return None

    def charge(self, tier: str, usage: Mapping[str, int], cached: bool = False, reservation: int | None = None) -> None:
        if cached:
            self.cached[tier] = self.cached.get(tier, 0) + 1
            return
        self.calls[tier] = self.calls.get(tier, 0) + 1
        own = self.usage.setdefault(tier, {})
        for kind, n in usage.items():
            own[kind] = own.get(kind, 0) + n
        used = sum(usage.values())
        self.reserved = self.reserved + used if reservation is None else max(0, self.reserved - reservation) + used

    def refuse(self, candidate: str) -> tuple[str, str, str]:
        """The limitation of a candidate that no model was asked about."""
        self.refused.append(candidate)
        return "token_budget_exhausted", f"no model was asked: {self.stop_reason()}", candidate

    @property
    def total_tokens(self) -> int:
        return sum(sum(u.values()) for u in self.usage.values())

    def cost(self) -> float:
        """Dollars: tokens of each kind by the tier's price per million."""
        return sum(n * self.pricing.get(t, {}).get(kind, 0.0) / 1e6 for t, u in self.usage.items() for kind, n in u.items())

    def stop_reason(self) -> str | None:
        if self.stopped:
            return self.stopped
        if self.max_cost is not None and self.cost() >= self.max_cost:
            return "cost_ceiling"
        return "token_ceiling" if self.total_tokens >= self.per_run else None


def usage_by_tier(calls: DataFrame, kinds: list[str]) -> DataFrame:
    """tier, calls, cached and the tokens of each kind over rows (tier, cached, kinds...)."""
    live = lambda c: F.sum(F.when(~F.col("cached"), F.col(c)).otherwise(0)).cast("long").alias(c)
    return calls.groupBy("tier").agg(F.count_if(~F.col("cached")).alias("calls"), F.count_if("cached").alias("cached"), *map(live, kinds))
