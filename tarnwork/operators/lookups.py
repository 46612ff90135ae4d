"""Lookups in an index's tables, and counts over the records of a run: each a join or an aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def symbols_in_files(symbols: DataFrame, paths: DataFrame) -> DataFrame:
    """path, usr of all symbols with a region in the paths, each once, by place; symbols: usr, path, start_line."""
    return symbols.join(paths.select("path").distinct(), "path", "left_semi").groupBy("path", "usr").agg(F.min("start_line").alias("start_line"))


def symbols_named(symbols: DataFrame, names: DataFrame, columns: Sequence[str] = ("name", "qualified_name")) -> DataFrame:
    """name, usr of every symbol that one of the names is a name of, plain or qualified."""
    own = symbols.select("usr", F.explode(F.array_distinct(F.array(*columns))).alias("name")).where("name <> ''")
    return own.join(names.select("name").distinct(), "name").distinct()


def referenced_symbols(references: DataFrame, symbols: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """source and the symbol (all its columns) of each reference (source, target); targets that are no symbol are left out."""
    # a task holds its sources, then its symbols; references, which are far more, are not sorted for a join
    wanted = references if sources is None else references.join(sources.select("source").distinct().hint("shuffle_hash"), "source", "left_semi")
    return wanted.select("source", F.col("target").alias("usr")).distinct().join(symbols.hint("shuffle_hash"), "usr")


def targets_of(references: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """source and its distinct targets, sorted."""
    return references.groupBy(source).agg(F.sort_array(F.collect_set(target)).alias("targets"))


def has_edges(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """asked (caller, callee) with whether the graph has that edge; an unresolved call is no edge."""
    known = edges.where("callee is not null").select("caller", "callee").distinct().withColumn("has_edge", F.lit(True))
    return asked.join(known, ["caller", "callee"], "left").withColumn("has_edge", F.coalesce("has_edge", F.lit(False)))


def expansions_named(expansions: DataFrame, names: DataFrame) -> DataFrame:
    """The macro expansions of the given names."""
    return expansions.join(names.select("name").distinct(), "name", "left_semi")


def includes_of(includes: DataFrame, paths: DataFrame) -> DataFrame:
    """path, included: in-tree headers that each path includes, each once; includes: path, included (null outside the tree)."""
    return includes.where("included is not null").join(paths.select("path").distinct(), "path", "left_semi").select("path", "included").distinct()


def included_by(includes: DataFrame, headers: DataFrame) -> DataFrame:
    """included, path: the files that include each header, each once."""
    return includes.join(headers.select("included").distinct(), "included", "left_semi").select("included", "path").distinct()


def external_includes(includes: DataFrame) -> DataFrame:
    """Spellings that lead outside the tree, and how many files have them."""
    return includes.where("included is null").groupBy("spelling").agg(F.count_distinct("path").alias("files"))


def status_counts(results: DataFrame, status: str = "status") -> DataFrame:
    """status, units: how many units ended in each."""
    return results.groupBy(status).agg(F.count(F.lit(1)).alias("units"))


def skipped_by_weakness(cases: DataFrame, supported: DataFrame, cwe: str = "cwe") -> DataFrame:
    """cwe, skipped: cases of weaknesses that the catalogue does not support."""
    return cases.join(supported.select(cwe).distinct(), cwe, "left_anti").groupBy(cwe).agg(F.count(F.lit(1)).alias("skipped"))


def stratified_pick(cases: DataFrame, stratum: str, case: str, seed: int, most: int = 1) -> DataFrame:
    """The cases of each stratum with the smallest hashes of seed and id: the same for any order of rows.

    One per stratum is an aggregate; more are ranked in the stratum.
    """
    key = F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col(case).cast("string"))).alias("h"), F.col(case).alias("i"))
    if most == 1:
        return cases.groupBy(stratum).agg(F.min_by(case, key).alias(case))
    return cases.withColumn("__k", F.row_number().over(Window.partitionBy(stratum).orderBy(key))).where(F.col("__k") <= most).select(stratum, case)


def lines_of_code(units: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files and physical lines of the selected units; files: path, line_count."""
    own = units.select("path").distinct().join(files.select("path", "line_count"), "path")
    return own.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).cast("long").alias("lines"))


def partial(stages: DataFrame) -> DataFrame:
    """run_id, partial: whether any stage of a run (run_id, status) failed or was degraded."""
    return stages.groupBy("run_id").agg(F.coalesce(F.bool_or(F.col("status").isin("failed", "degraded")), F.lit(False)).alias("partial"))


def allowed_models(config: Mapping[str, object]) -> list[str]:
    """Names of the models that a configuration's tiers (model_policy) may use, and no other."""
    policy = config.get("model_policy") or {}
    return sorted({str(tier["model"]) for tier in policy.values() if isinstance(tier, Mapping) and tier.get("model")})


def overlay(config: Mapping[str, object], factors: Mapping[str, object]) -> dict[str, object]:
    """A configuration with an experiment's factors (dotted keys) laid over it; an unknown key raises."""
    out = {k: dict(v) if isinstance(v, Mapping) else v for k, v in config.items()}
    for key, value in factors.items():
        *path, last = key.split(".")
        at = out
        for p in path:
            if not isinstance(at.get(p), dict):
                raise KeyError(key)
            at = at[p]
        if last not in at:
            raise KeyError(key)
        at[last] = value
    return out


def carried(rows: DataFrame, group: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """rows with the last non-null value at or before each: what a heading above applies to."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def out_of_order(rows: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """rows that have a next one in order, with whether they are below it."""
    following = F.lead(value).over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("__next", following).where("__next is not null").withColumn("out_of_order", F.col(value) < F.col("__next")).drop("__next")
