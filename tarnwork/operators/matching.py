"""Matching findings to truths: candidate pairs by a range join, then a greedy one-to-one choice.

Truths choose in their given order, each the nearest finding still free, of
equals that with the smaller id. As all findings rank the truths alike, pairs
that are first for each other can be settled together, round by round.

Both sides of a join grow with the input, and Parquet files of few different
values are far smaller than their rows: the size of the files would have them
broadcast, so the joins ask for a merge.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regions import line_distance
from ..functions.weakness import equivalent
from ..plans.scratch import written
from ..values import LINE_TOLERANCE
from .intervals import points_in_intervals


def candidate_pairs(truths: DataFrame, findings: DataFrame, on: tuple[str, ...] = ("case_id", "path"), tolerance: int | Column = LINE_TOLERANCE, check_cwe: bool | Column = True) -> DataFrame:
    """Pairs (case_id, truth, finding_id, distance) that may be credited.

    truths: case_id, path, truth (its place in order), line[, cwe, variant];
    findings: case_id, path, finding_id, start_line, end_line[, cwe]. Truths of
    the variant "fixed" match nothing. tolerance and check_cwe may be columns of
    findings.
    """
    if "variant" in truths.columns:
        truths = truths.where(F.coalesce(F.col("variant"), F.lit("vulnerable")) != "fixed")
    checked = isinstance(check_cwe, Column) or check_cwe
    cwes = [F.col("cwe").alias("__cwe"), (check_cwe if isinstance(check_cwe, Column) else F.lit(True)).alias("__check")] if checked else []
    near = findings.select(*dict.fromkeys([*on, "finding_id", "start_line", "end_line"]), (F.col("start_line") - tolerance).alias("__low"), (F.col("end_line") + tolerance).alias("__high"), *cwes)
    found = points_in_intervals(truths.select(*dict.fromkeys(["case_id", *on, "truth", "line"]), *(["cwe"] if checked else [])), near, on, "line", "__low", "__high")
    if checked:
        found = found.where(~F.col("__check") | equivalent(F.col("cwe"), F.col("__cwe")))
    return found.select("case_id", "truth", "finding_id", line_distance(F.col("line"), F.col("start_line"), F.col("end_line")).cast("long").alias("distance"))


def match_one_to_one(pairs: DataFrame) -> DataFrame:
    """case_id, truth, finding_id: at most one pair per truth and per finding.

    In rounds: a truth's nearest finding still free is its own if no earlier
    truth may have that finding too. Pairs of truths and findings so decided
    go, and every round decides the earliest truth of each case at least, and
    all others that no such chain runs through. A case is never one task.
    """
    left = written(pairs.select("case_id", "truth", "finding_id", "distance").distinct())
    chosen: list[DataFrame] = []
    while left.limit(1).count():
        best = left.groupBy("case_id", "truth").agg(F.min(F.struct("distance", "finding_id")).alias("b")).select("case_id", "truth", F.col("b.finding_id").alias("finding_id"))
        first = left.groupBy("case_id", "finding_id").agg(F.min("truth").alias("truth"))
        mutual = written(best.join(first.hint("merge"), ["case_id", "truth", "finding_id"]))
        chosen.append(mutual)
        rest = left.join(mutual.select("case_id", "truth").hint("merge"), ["case_id", "truth"], "left_anti")
        left = written(rest.join(mutual.select("case_id", "finding_id").hint("merge"), ["case_id", "finding_id"], "left_anti"))
    if not chosen:
        return left.select("case_id", "truth", "finding_id")
    return functools.reduce(DataFrame.unionByName, chosen).select("case_id", "truth", "finding_id")


def outcomes(truths: DataFrame, findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """case_id, family, outcome of each truth (tp, fn) and each finding left over (fp).

    truths: case_id, truth, family, variant; findings: case_id, finding_id, family.
    """
    vulnerable = truths.where(F.coalesce(F.col("variant"), F.lit("vulnerable")) == "vulnerable")
    hit = pairs.select("case_id", "truth", F.lit(True).alias("hit"))
    of_truths = vulnerable.join(hit.hint("merge"), ["case_id", "truth"], "left").select("case_id", "family", F.when(F.col("hit"), "tp").otherwise("fn").alias("outcome"))
    left_over = findings.join(pairs.select("case_id", "finding_id").hint("merge"), ["case_id", "finding_id"], "left_anti").select("case_id", "family", F.lit("fp").alias("outcome"))
    return of_truths.unionByName(left_over)


def label_findings(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """findings with truth: whether they were matched, all findings taking part."""
    return findings.join(pairs.select("case_id", "finding_id", F.lit(True).alias("truth")).hint("merge"), ["case_id", "finding_id"], "left").withColumn("truth", F.coalesce("truth", F.lit(False)))
