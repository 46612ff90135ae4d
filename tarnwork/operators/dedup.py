"""Deduplication and merging of candidates, entries, symbols and limitations.

Merging by place is greedy over sorted rows and not transitive. Rows are
first reduced to distinct places (with partial aggregation), so a fingerprint
that is everywhere costs its places, and folded in sorted streams, so no
group is collected.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..values import MERGE_TOLERANCE


def candidate_order() -> list[Column]:
    """The order of merging and reports."""
    return [F.col(c) for c in ("path", "start_line", "start_byte", "end_line", "candidate_id")]


def sort_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(*candidate_order())


def visit_order(candidates: DataFrame) -> DataFrame:
    """The order in which candidates get their budget."""
    return candidates.orderBy("path", "start_line", "candidate_id")


def _fold(batches: Iterator[pd.DataFrame], tolerance: int) -> Iterator[pd.DataFrame]:
    """cluster of each place of a stream sorted by fingerprint and line: the line of its cluster's first place.

    Of the running fingerprint are kept the first cluster of each symbol and,
    in order, the clusters near enough to be joined by line, so a place costs
    the same however many clusters there are.
    """
    running, made = None, 0
    of_symbol: dict = {}
    near: collections.deque = collections.deque()
    nameless: collections.deque = collections.deque()
    for batch in batches:
        found = []
        for fp, line, symbol in zip(batch["fingerprint"], batch["line"], batch["symbol"], strict=True):
            if fp != running:
                running, made = fp, 0
                of_symbol.clear(), near.clear(), nameless.clear()
            # places are sorted: a cluster that is too far behind is joined by line no more
            for open_ in (near, nameless):
                while open_ and line - open_[0][1] > tolerance:
                    open_.popleft()
            if symbol is None:
                chosen = near[0] if near else None
            else:
                chosen = min((c for c in (of_symbol.get(symbol), nameless[0] if nameless else None) if c is not None), default=None)
            if chosen is None:
                chosen, made = (made, line, symbol), made + 1
                near.append(chosen)
                if symbol is None:
                    nameless.append(chosen)
                else:
                    of_symbol[symbol] = chosen
            found.append(chosen)
        yield batch.assign(cluster=[c[1] for c in found], cluster_symbol=[c[2] for c in found])


def cluster_places(candidates: DataFrame, tolerance: int = MERGE_TOLERANCE) -> DataFrame:
    """fingerprint, line, symbol, cluster, cluster_symbol of each distinct place of candidates.

    symbol is the proven enclosing symbol, null without one: two places with
    symbols are one defect if the symbols are equal, others if the cluster's
    first line is within the tolerance. Each place joins the first cluster of
    its fingerprint that it agrees with.
    """
    kinds = dict(candidates.dtypes)
    places = candidates.groupBy("fingerprint", "line", "symbol").agg(F.count(F.lit(1)).alias("rows"))
    sorted_places = places.repartition("fingerprint").sortWithinPartitions("fingerprint", "line", F.asc_nulls_last("symbol"))
    schema = f"fingerprint {kinds['fingerprint']}, line {kinds['line']}, symbol {kinds['symbol']}, rows long, cluster {kinds['line']}, cluster_symbol {kinds['symbol']}"
    return sorted_places.mapInPandas(lambda it: _fold(it, tolerance), schema)


def _clustered(candidates: DataFrame, tolerance: int) -> DataFrame:
    """candidates with the cluster of their place."""
    places = cluster_places(candidates, tolerance).withColumnsRenamed({"fingerprint": "__fp", "line": "__line", "symbol": "__symbol"})
    same_place = (F.col("fingerprint") == F.col("__fp")) & (F.col("line") == F.col("__line")) & F.col("symbol").eqNullSafe(F.col("__symbol"))
    return candidates.join(places, same_place).drop("__fp", "__line", "__symbol")


def merge_candidates(candidates: DataFrame, tolerance: int = MERGE_TOLERANCE) -> DataFrame:
    """One row per cluster: the earliest candidate's id and line, the number merged, and all tools in first-seen order.

    candidates: fingerprint, line, symbol, candidate_id, tool.
    """
    clustered = _clustered(candidates, tolerance)
    # a row per cluster and tool first, so that a cluster brings no more than its tools together
    first = F.min(F.struct("line", "candidate_id")).alias("first")
    by_tool = clustered.groupBy("fingerprint", "cluster", "cluster_symbol", "tool").agg(first, F.count(F.lit(1)).alias("merged"))
    tools = F.transform(F.array_sort(F.collect_list(F.struct("first", "tool"))), lambda t: t["tool"])
    merged = by_tool.groupBy("fingerprint", "cluster", "cluster_symbol").agg(F.min("first").alias("first"), F.sum("merged").alias("merged"), tools.alias("tools"))
    return merged.select("fingerprint", F.col("first.line").alias("line"), F.col("first.candidate_id").alias("candidate_id"), "merged", "tools")


def merged_lists(candidates: DataFrame, tolerance: int = MERGE_TOLERANCE) -> DataFrame:
    """fingerprint, candidate_id of each cluster of merge_candidates, with all cwes and provenance of its members in first-seen order.

    candidates: fingerprint, line, symbol, candidate_id, cwes (array), and
    provenance (array of strings). Members come by (line, candidate_id), and
    within one its lists in their order. A cluster brings one row per distinct
    value together, not its members.
    """
    clustered = _clustered(candidates, tolerance)
    cluster = ["fingerprint", "cluster", "cluster_symbol"]
    first = clustered.groupBy(*cluster).agg(F.min(F.struct("line", "candidate_id")).alias("first"))
    out = first.select(*cluster, F.col("first.candidate_id").alias("candidate_id"))
    for name in ("cwes", "provenance"):
        seen = clustered.select(*cluster, "line", "candidate_id", F.posexplode(name).alias("at", "value")).groupBy(*cluster, "value").agg(F.min(F.struct("line", "candidate_id", "at")).alias("seen"))
        lists = seen.groupBy(*cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "value"))), lambda x: x["value"]).alias(name))
        mine = lists.withColumnsRenamed({c: f"__{c}" for c in cluster})
        same = (F.col("fingerprint") == F.col("__fingerprint")) & (F.col("cluster") == F.col("__cluster")) & F.col("cluster_symbol").eqNullSafe(F.col("__cluster_symbol"))
        out = out.join(mine, same, "left").drop(*[f"__{c}" for c in cluster])
    none = F.array().cast("array<string>")
    return out.select("fingerprint", "candidate_id", F.coalesce("cwes", none).alias("cwes"), F.coalesce("provenance", none).alias("provenance"))


def merge_by_fingerprint(candidates: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each fingerprint in order, with the number merged: place is ignored."""
    rest = [c for c in candidates.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return candidates.groupBy(key).agg(first.alias("__row"), F.count(F.lit(1)).alias("merged")).select(key, "__row.*", "merged")


def last_entry(entries: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last entry of each key and how many it displaced."""
    rest = [c for c in entries.columns if c != key]
    kept = entries.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("__row"), (F.count(F.lit(1)) - 1).alias("displaced"))
    return kept.select(key, "__row.*", "displaced")


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in order; null keys are keys."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*") if rest else rows.distinct()


def ordered_union(*parts: DataFrame) -> DataFrame:
    """Rows of all parts with the number of their part, for first-seen reductions."""
    every = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("part", F.lit(i)))
    return every


def distinct_limitations(*parts: DataFrame) -> DataFrame:
    """kind, affects, detail, part, ordinal of each limitation once, where it was seen first."""
    return first_of(ordered_union(*parts), ["kind", "affects", "detail"], ["part", "ordinal"])


def grouped_messages(units: DataFrame) -> DataFrame:
    """region, messages (distinct, in order, joined), occurrences of rows (region, ordinal, message)."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "message"))), lambda m: m["message"])
    return units.groupBy("region").agg(F.array_join(F.array_distinct(in_order), "; ").alias("messages"), F.count(F.lit(1)).alias("occurrences"))


def exclusion_limitations(excluded: DataFrame) -> DataFrame:
    """reason, files, examples: one line per reason of rows (path, reason)."""
    return excluded.groupBy("reason").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("example"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that come more than once, with their number."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def merge_symbols(symbols: DataFrame) -> DataFrame:
    """usr, definition (the first by place), declarations (all other regions, sorted) of rows (usr, region, is_definition)."""
    definition = F.min(F.when(F.col("is_definition"), F.col("region")))
    every = F.array_sort(F.collect_set("region"))
    found = symbols.groupBy("usr").agg(definition.alias("definition"), every.alias("regions"))
    return found.select("usr", "definition", F.filter("regions", lambda r: ~r.eqNullSafe(F.col("definition"))).alias("declarations"))


def evidence_union(first: Column, second: Column) -> Column:
    """Items of two arrays of structs with evidence_id, the first of each id, order kept."""
    both = F.concat(first, second)
    ids = F.transform(both, lambda e: e["evidence_id"])
    return F.filter(both, lambda e, i: F.array_position(ids, e["evidence_id"]) == i + 1)


def top_rank(rows: DataFrame, partition: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
