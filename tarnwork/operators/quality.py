"""Calibration of confidence labels, label agreement, category scores, ranking quality and pair outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import rank
from ..values import CONFIDENCES, LEAST_PER_BIN, SEVERITIES, UNREACHABLE_CATEGORIES
from .metrics import ratio


def reliability(findings: DataFrame) -> DataFrame:
    """confidence, count, correct, accuracy for every label, used or not, of rows (confidence, truth)."""
    spark = findings.sparkSession
    labels = spark.createDataFrame([(i, c) for i, c in enumerate(CONFIDENCES)], "place int, confidence string")
    used = findings.groupBy("confidence").agg(F.count(F.lit(1)).alias("count"), F.count_if("truth").alias("correct"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    every = F.broadcast(labels).join(used, "confidence", "left").select("place", "confidence", zero("count").alias("count"), zero("correct").alias("correct"))
    return every.withColumn("accuracy", ratio(F.col("correct"), F.col("count")))


def pooled(*reports: DataFrame) -> DataFrame:
    """Bins summed over reports."""
    every = reports[0]
    for r in reports[1:]:
        every = every.unionByName(r)
    return every.groupBy("place", "confidence").agg(F.sum("count").alias("count"), F.sum("correct").alias("correct")).withColumn("accuracy", ratio(F.col("correct"), F.col("count")))


def miscalibration(bins: DataFrame, least: int = LEAST_PER_BIN) -> DataFrame:
    """stronger, weaker: the first neighbouring labels, of those used enough, that are out of order; no row if none."""
    order = Window.orderBy("place")  # three rows
    judged = bins.where(F.col("count") >= least)
    beside = judged.withColumn("weaker", F.lead("confidence").over(order)).withColumn("weaker_accuracy", F.lead("accuracy").over(order))
    wrong = beside.where(F.col("accuracy") < F.col("weaker_accuracy"))
    return wrong.orderBy("place").limit(1).select(F.col("confidence").alias("stronger"), F.round("accuracy", 9).alias("stronger_accuracy"), "weaker", F.round("weaker_accuracy", 9).alias("weaker_accuracy"))


def severity_agreement(findings: DataFrame) -> DataFrame:
    """compared, exact, overstated, understated of rows (reported, adjudicated); no row where nothing compares."""
    both = findings.where("reported is not null and adjudicated is not null")
    r, a = rank(F.col("reported"), SEVERITIES), rank(F.col("adjudicated"), SEVERITIES)
    found = both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(r == a).alias("exact"), F.count_if(r < a).alias("overstated"), F.count_if(r > a).alias("understated"))
    return found.where("compared > 0")


def agreement(labels: DataFrame) -> DataFrame:
    """cases, agreed, raw_agreement, kappa of rows (category, agreed); kappa is null under two categories."""
    by_category = labels.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("agreed").alias("agreed"))
    # the squares are summed as integers: one division gives the chance agreement
    total = by_category.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cases"), F.coalesce(F.sum("agreed"), F.lit(0)).alias("agreed"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("squares"), F.count(F.lit(1)).alias("categories"))
    raw = ratio(F.col("agreed"), F.col("cases"))
    chance = F.col("squares").cast("double") / (F.col("cases") * F.col("cases")).cast("double")
    kappa = F.when(F.col("categories") >= 2, F.when(chance >= 1.0, F.lit(1.0)).otherwise((raw - chance) / (1.0 - chance)))
    return total.select(F.col("cases").cast("long").alias("cases"), F.col("agreed").cast("long").alias("agreed"), raw.alias("raw_agreement"), kappa.alias("kappa"))


def category_f1(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """category, expected, actual, overlap, f1 over (case_id, category) of both sides; empty categories have no row."""
    t, p = truth.where("category is not null"), predicted.where("category is not null")
    expected = t.groupBy("category").agg(F.count(F.lit(1)).alias("expected"))
    actual = p.groupBy("category").agg(F.count(F.lit(1)).alias("actual"))
    both = t.join(p, ["case_id", "category"]).groupBy("category").agg(F.count(F.lit(1)).alias("overlap"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    joined = expected.join(actual, "category", "full_outer").join(both, "category", "left").select("category", zero("expected"), zero("actual"), zero("overlap"))
    pr, re_ = ratio(F.col("overlap"), F.col("actual")), ratio(F.col("overlap"), F.col("expected"))
    return joined.withColumn("f1", F.when(pr + re_ == 0, F.lit(0.0)).otherwise(2 * pr * re_ / (pr + re_)))


def ndcg(ranked: DataFrame, group: str, relevance: str, order: list[Column], k: int = 10) -> DataFrame:
    """group, ndcg at k of each group's rows in order; 1 where nothing is relevant.

    Ranks beyond k are cut in the window, so a large group costs its top rows.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    top = lambda by: ranked.withColumn("__place", F.row_number().over(Window.partitionBy(group).orderBy(*by))).where(F.col("__place") <= k)
    gain = lambda d, name: d.groupBy(group).agg(F.sum(F.col(relevance).cast("double") / F.log2(F.col("__place") + 1)).alias(name))
    both = gain(top(order), "dcg").join(gain(top([F.col(relevance).desc(), *order]), "ideal"), group)
    return both.select(group, F.round(F.when(F.col("ideal") == 0, F.lit(1.0)).otherwise(F.col("dcg") / F.col("ideal")), 9).alias("ndcg"))


def top_per_case(findings: DataFrame, case: str, order: list[Column]) -> DataFrame:
    """The first finding of each case in order."""
    return findings.withColumn("__place", F.row_number().over(Window.partitionBy(case).orderBy(*order))).where("__place = 1").drop("__place")


def unreachable_labels(labels: DataFrame) -> DataFrame:
    """Labelled categories that no prediction can reach."""
    return labels.where(F.col("category").isin(*UNREACHABLE_CATEGORIES)).select("category").distinct()


def pair_outcomes(vulnerable: DataFrame, fixed: DataFrame) -> DataFrame:
    """pair_id, excluded, detected, persisted, missed from the scans of both revisions (pair_id, found, valid, failure).

    A pair with a side that failed or is missing is excluded and scored nowhere.
    """
    v = vulnerable.select("pair_id", F.col("found").alias("v_found"), "valid", F.col("failure").alias("v_failure"), F.lit(True).alias("v"))
    f = fixed.select("pair_id", F.col("found").alias("f_found"), F.col("failure").alias("f_failure"), F.lit(True).alias("f"))
    both = v.join(f, "pair_id", "full_outer")
    excluded = F.col("v").isNull() | F.col("f").isNull() | F.col("v_failure").isNotNull() | F.col("f_failure").isNotNull()
    hit = ~excluded & F.coalesce(F.col("v_found") & F.col("valid"), F.lit(False))
    after = ~excluded & F.coalesce(F.col("f_found"), F.lit(False))
    return both.select("pair_id", excluded.alias("excluded"), hit.alias("detected"), after.alias("persisted"), (~excluded & ~hit).alias("missed"))


def score_pairs(outcomes: DataFrame) -> DataFrame:
    """scored, detected, persisted, excluded, detection_rate, persistence_rate."""
    n = outcomes.agg(F.count_if(~F.col("excluded")).alias("scored"), F.count_if("detected").alias("detected"), F.count_if("persisted").alias("persisted"), F.count_if("excluded").alias("excluded"))
    return n.withColumn("detection_rate", ratio(F.col("detected"), F.col("scored"))).withColumn("persistence_rate", ratio(F.col("persisted"), F.col("detected"), empty=0.0))
