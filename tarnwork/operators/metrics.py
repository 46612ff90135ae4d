"""Detection metrics, gates and comparison of runs.

Counts are summed as integers and divided once, so no result depends on the
order of rows. Empty denominators follow fixed rules: precision, recall and
rates are 1, F is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.build import lookup
from ..values import CITATION_FLOOR, FABRICATION_OF_STATUS


def ratio(part: Column, whole: Column, empty: float = 1.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part.cast("double") / whole.cast("double"))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f_beta(p: Column, r: Column, beta: float = 2.0) -> Column:
    weight = beta * beta
    return F.when((p == 0) & (r == 0), F.lit(0.0)).otherwise((1 + weight) * p * r / (weight * p + r))


def counts_by_family(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, family, tp, fp, fn from rows (by, family, outcome)."""
    count = lambda kind: F.count_if(F.col("outcome") == kind).alias(kind)
    return outcomes.groupBy(*by, "family").agg(count("tp"), count("fp"), count("fn"))


def family_metrics(counts: DataFrame) -> DataFrame:
    """counts with precision, recall, f2 and whether the family is scored at all."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = counts.withColumn("precision", precision(tp, fp)).withColumn("recall", recall(tp, fn))
    return scored.withColumn("f2", f_beta(F.col("precision"), F.col("recall"))).withColumn("scored", tp + fp + fn > 0)


def overall_metrics(families: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (of each by): tp, fp, fn, precision, recall, macro_f2 over the scored families."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    one = families.groupBy(*by).agg(total("tp"), total("fp"), total("fn"), F.round(F.coalesce(F.avg(F.when(F.col("scored"), F.col("f2"))), F.lit(0.0)), 9).alias("macro_f2"))
    return one.select(*by, "tp", "fp", "fn", precision(F.col("tp"), F.col("fp")).alias("precision"), recall(F.col("tp"), F.col("fn")).alias("recall"), "macro_f2")


def fp_per_thousand(false_positives: Column, units: Column) -> Column:
    return F.when(units > 0, false_positives / (units / F.lit(1000.0))).otherwise(F.lit(0.0))


def resolution_rate(resolutions: DataFrame) -> DataFrame:
    """One row: resolved, total, rate of rows (status)."""
    found = resolutions.agg(F.count_if(F.col("status") == "ok").alias("resolved"), F.count(F.lit(1)).alias("total"))
    return found.withColumn("rate", ratio(F.col("resolved"), F.col("total")))


def evidence_validity(findings: DataFrame, failed_paths: DataFrame, failed_ids: DataFrame) -> DataFrame:
    """One row: the share of findings (finding_id, paths, evidence_ids) that cite nothing that failed."""
    bad_path = findings.select("finding_id", F.explode("paths").alias("path")).join(failed_paths, "path", "left_semi").select("finding_id")
    bad_id = findings.select("finding_id", F.explode("evidence_ids").alias("evidence_id")).join(failed_ids, "evidence_id", "left_semi").select("finding_id")
    intact = findings.join(bad_path.union(bad_id).distinct(), "finding_id", "left_anti")
    return findings.agg(F.count(F.lit(1)).alias("total")).crossJoin(intact.agg(F.count(F.lit(1)).alias("intact"))).select("intact", "total", ratio(F.col("intact"), F.col("total")).alias("rate"))


def fabrication_signals(resolutions: DataFrame, credited: DataFrame, known_tools: Sequence[str]) -> DataFrame:
    """kind, subject, detail of what was invented, once each, with its first detail.

    resolutions: ordinal, status, subject, detail; credited: ordinal, tool_name, detail.
    """
    first = resolutions.select(F.lit(0).alias("source"), "ordinal", lookup(FABRICATION_OF_STATUS, F.col("status")).alias("kind"), "subject", "detail").where("kind is not null")
    second = credited.where(~F.lower("tool_name").isin([t.lower() for t in known_tools])).select(F.lit(1).alias("source"), "ordinal", F.lit("fabricated_analyzer").alias("kind"), F.col("tool_name").alias("subject"), "detail")
    return first.unionByName(second).groupBy("kind", "subject").agg(F.min_by("detail", F.struct("source", "ordinal")).alias("detail"))


def gates(summary: DataFrame, is_baseline: bool = False) -> DataFrame:
    """name, passed, observed, threshold of the four gates.

    summary is one row: citation_rate, fabrications, merged_counts, macro_f2,
    baseline_f2 (null where no baseline was given).
    """
    given = F.col("baseline_f2").isNotNull()
    floor_passes = F.when(given, F.col("macro_f2") >= F.col("baseline_f2")).otherwise(F.lit(is_baseline))
    observed = F.when(given | F.lit(is_baseline), F.round("macro_f2", 6)).otherwise(F.lit(0.0))
    threshold = F.when(given, F.round("baseline_f2", 6)).otherwise(F.lit(0.0 if is_baseline else 1.0))
    gate = lambda name, passed, seen, limit: F.struct(F.lit(name).alias("name"), passed.alias("passed"), seen.cast("double").alias("observed"), limit.cast("double").alias("threshold"))
    four = F.array(
        gate("citation_resolution", F.col("citation_rate") >= CITATION_FLOOR, F.round("citation_rate", 6), F.lit(CITATION_FLOOR)),
        gate("zero_fabrication", F.col("fabrications") == 0, F.col("fabrications"), F.lit(0)),
        gate("counts_separate", F.col("merged_counts") == 0, F.col("merged_counts"), F.lit(0)),
        gate("baseline_floor", floor_passes, observed, threshold),
    )
    return summary.select(F.inline(four))


def gates_passed(results: DataFrame) -> DataFrame:
    """One row: passed, failed (names of the gates that did not)."""
    return results.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("name")))).alias("failed"))


def overall_score(security: Column, maintainability: Column, passed: Column) -> Column:
    """The mean of both scores, refused where a gate failed."""
    return F.when(passed, 0.5 * security + 0.5 * maintainability).otherwise(F.raise_error(F.lit("a gate failed: there is no overall score")).cast("double"))


def metrics_delta(baseline: DataFrame, other: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """other less baseline by key, a missing side as 0."""
    joined = baseline.select(key, *[F.col(m).alias(f"__{m}") for m in measures]).join(other.select(key, *measures), key, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(key, *[(zero(m) - zero(f"__{m}")).alias(m) for m in measures])


def differing(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, left, right where two key-value tables differ; nulls equal nulls, a missing key is null."""
    joined = left.select(key, F.col(value).alias("left")).join(right.select(key, F.col(value).alias("right")), key, "full_outer")
    return joined.where(~F.col("left").eqNullSafe(F.col("right")))


def cost_minus(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), a - b)


def assert_one(df: DataFrame, what: Column, message: str) -> DataFrame:
    """df, failing when what has more than one distinct non-null value."""
    guard = df.agg(F.when(F.count_distinct(what) > 1, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)).alias("__one"))
    return df.crossJoin(F.broadcast(guard)).where("__one").drop("__one")
