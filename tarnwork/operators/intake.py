"""Scan plans: which entries of a compilation database are analysed, and how much of the tree they cover."""

from __future__ import annotations

import difflib
import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..values import COVERAGE_FLOOR, FLOOR_EPSILON
from .dedup import last_entry
from .metrics import ratio

#: Targets that are compared in one task at most.
TARGETS = 200


def plan(entries: DataFrame, path: str = "path", ordinal: str = "ordinal") -> DataFrame:
    """Entries inside the root, the last of each path; those outside have a null path and are dropped."""
    return last_entry(entries.where(F.col(path).isNotNull()), path, ordinal)


def classified(files: DataFrame, reason: Column) -> DataFrame:
    """files with their exclusion reason, null where they are analysed."""
    return files.withColumn("reason", reason)


def reason_counts(files: DataFrame) -> DataFrame:
    """reason, files: how many of each, analysed ones under "selected"."""
    return files.groupBy(F.coalesce("reason", F.lit("selected")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))


def coverage(present: DataFrame, described: DataFrame, key: str = "path") -> DataFrame:
    """One row: present, covered, ratio of the files that the database describes."""
    covered = present.join(described.select(key).distinct(), key, "left_semi")
    found = present.agg(F.count(F.lit(1)).alias("present")).crossJoin(covered.agg(F.count(F.lit(1)).alias("covered")))
    return found.withColumn("ratio", ratio(F.col("covered"), F.col("present")))


def completeness(found: DataFrame, floor: float = COVERAGE_FLOOR, allow_partial: bool = False) -> DataFrame:
    """found with its verdict: complete, limited (to be reported) or refused (below the floor and not allowed)."""
    below = F.col("ratio") + FLOOR_EPSILON < floor
    verdict = F.when(below & F.lit(not allow_partial), "refused").when(below | (F.col("covered") < F.col("present")), "limited").otherwise("complete")
    return found.withColumn("verdict", verdict)


def absent(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of left that right has not: uncovered files, unlabelled cases, missing recordings."""
    return left.select(key).where(F.col(key).isNotNull()).distinct().join(right.select(key).distinct(), key, "left_anti")


def unmatched_targets(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """Targets that are no path and no directory of one: each path is joined by its own prefixes."""
    parts = F.split("path", "/")
    prefixes = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("target")).distinct()
    return targets.join(prefixes, "target", "left_anti")


def suggestions(missing: DataFrame, known: DataFrame, most: int = 3, least: float = 0.4) -> DataFrame:
    """target, suggestions: the known paths closest to each missing target, for messages; none are an empty list.

    Closeness is the ratio of difflib, at least ``least``; the best first, of
    equal ones the path that is later by code point, as get_close_matches has
    it. Targets are what a user asked for, so every target meets every path:
    in blocks of TARGETS, the paths dealt out, each task keeping its best.
    """
    targets = missing.select(F.col("target").cast("string").alias("target")).where("target is not null").distinct()
    paths = known.select(F.col("path").cast("string").alias("path")).where("path is not null").distinct()
    blocks = max(1, -(-targets.count() // TARGETS))
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = targets.withColumn("block", F.pmod(F.xxhash64("target"), F.lit(blocks)).cast("int")).withColumn("slice", every(parts))
    right = paths.withColumn("slice", F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))

    def closest(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        found = []
        for target in mine["target"]:
            matcher = difflib.SequenceMatcher(b=target)
            held: list[tuple[float, str]] = []
            for path in theirs["path"]:
                matcher.set_seq1(path)
                floor = max(least, held[0][0]) if len(held) == most else least
                if matcher.real_quick_ratio() >= floor and matcher.quick_ratio() >= floor and (ratio := matcher.ratio()) >= floor:
                    (heapq.heappushpop if len(held) == most else heapq.heappush)(held, (ratio, path))
            found += [(target, ratio, path) for ratio, path in held]
        return pd.DataFrame(found, columns=["target", "ratio", "path"])

    best = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(closest, "target string, ratio double, path string")
    ranked = best.withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("ratio"), F.desc("path")))).where(F.col("k") <= most)
    listed = ranked.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("suggestions"))
    return targets.join(listed, "target", "left").select("target", F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))


def reusable_units(inputs: DataFrame, current: DataFrame) -> DataFrame:
    """unit, reusable: units whose every recorded input hash still holds (none recorded: not reusable); inputs: unit, path, sha256."""
    same = inputs.join(current.select("path", F.col("sha256").alias("__now")), "path", "left")
    return same.groupBy("unit").agg(F.bool_and(F.coalesce(F.col("sha256") == F.col("__now"), F.lit(False))).alias("reusable"))


def rules_lookup(rule_ids: DataFrame, checks: DataFrame, aliases: Sequence[tuple[str, str]] = (("clang-analyzer-", ""), ("clang-diagnostic-", "-W"))) -> DataFrame:
    """rule_id, check_id: an exact check under any spelling, else the glob with the longest prefix, spellings in order.

    checks: check_id; a trailing * makes a glob. Both joins are by equality:
    spellings are cut to the lengths that prefixes have.
    """
    value = F.col("rule_id")
    spell = F.array(value)
    (analyzer, _), (diagnostic, flag) = aliases
    spell = (
        F.when(value.startswith(analyzer), F.array(value, F.substring(value, F.lit(len(analyzer) + 1), F.char_length(value))))
        .when(value.startswith(diagnostic), F.array(value, F.concat(F.lit(flag), F.substring(value, F.lit(len(diagnostic) + 1), F.char_length(value)))))
        .when(value.startswith(flag), F.array(value, F.concat(F.lit(diagnostic), F.substring(value, F.lit(len(flag) + 1), F.char_length(value)))))
        .when(F.contains(value, F.lit(".")) & ~value.startswith("-"), F.array(value, F.concat(F.lit(analyzer), value)))
        .otherwise(spell)
    )
    ids = rule_ids.select("rule_id").distinct()
    spelled = ids.select("rule_id", F.posexplode(spell).alias("at", "spelling"))
    exact = spelled.join(checks.where(~F.col("check_id").endswith("*")), F.col("spelling") == F.col("check_id"))
    globs = checks.where(F.col("check_id").endswith("*")).select("check_id", F.expr("substring(check_id, 1, char_length(check_id) - 1)").alias("prefix"))
    lengths = F.broadcast(globs.select(F.char_length("prefix").alias("n")).distinct())
    cut = spelled.join(lengths, F.char_length("spelling") >= F.col("n")).withColumn("prefix", F.substring(F.col("spelling"), F.lit(1), F.col("n")))
    by_glob = cut.join(globs, "prefix")
    order = lambda kind, n: F.struct(F.lit(kind).alias("kind"), F.col("at"), (-n).alias("length"))
    every = exact.select("rule_id", "check_id", order(0, F.lit(0)).alias("o")).unionByName(by_glob.select("rule_id", "check_id", order(1, F.col("n")).alias("o")))
    return rule_ids.join(every.groupBy("rule_id").agg(F.min_by("check_id", "o").alias("check_id")), "rule_id", "left")
