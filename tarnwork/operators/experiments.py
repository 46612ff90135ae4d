"""Experiments: grids of configurations, deltas to a baseline, comparability of runs, attribution and repeatability."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import bag_digest, set_hash
from ..values import STAGES_OF_ATTRIBUTION


def vary(baseline: Mapping[str, object], field: str, value: object, name: str = "") -> dict[str, object]:
    """baseline with one field changed; an unknown field or the same value raises."""
    if field not in baseline or field == "name":
        raise ValueError(f"{field} is no field of a configuration")
    if baseline[field] == value:
        raise ValueError(f"{field} is {value} already")
    return {**baseline, field: value, "name": name or f"{field}={value}"}


def grid(baseline: Mapping[str, object], factors: Mapping[str, Sequence[object]], control: tuple[str, object]) -> list[dict[str, object]]:
    """The baseline, one row per changed factor, and the control: one factor at a time, never their product."""
    rows = [dict(baseline)] + [vary(baseline, f, v) for f, values in factors.items() for v in values if v != baseline[f]]
    field, value = control
    if not any(r[field] == value for r in rows):
        rows.append(vary(baseline, field, value, "control"))
    return rows


def differing_fields(left: Mapping[str, object], right: Mapping[str, object]) -> list[str]:
    return [k for k in left if k != "name" and left[k] != right.get(k)]


def deltas(scores: DataFrame, baseline: str) -> DataFrame:
    """name, score, delta to the baseline's score; scores that have no such baseline, or two, raise."""
    # one row
    base = scores.where(F.col("name") == baseline).agg(F.count(F.lit(1)).alias("__n"), F.max("score").alias("__base"))
    none = F.raise_error(F.lit(f"there is no single baseline {baseline}")).cast("double")
    delta = F.when(F.col("__n") != 1, none).otherwise(F.col("score") - F.col("__base"))
    return scores.crossJoin(F.broadcast(base)).select("name", "score", delta.alias("delta"))


def earns_itself(scores: DataFrame, baseline: str, control: str, measure: str = "score") -> DataFrame:
    """One row: whether the baseline beats the control; null where either was not measured."""
    of = lambda name: F.max(F.when(F.col("name") == name, F.col(measure)))
    return scores.agg((of(baseline) > of(control)).alias("earns"))


def exclusions_agree(excluded: DataFrame) -> DataFrame:
    """One row: whether all configurations excluded the same cases; rows (name, case_id). Sets are compared by their digests."""
    sets = excluded.select("name", "case_id").distinct().groupBy("name").agg(bag_digest(F.sha2(F.col("case_id").cast("string"), 256)).alias("cases"))
    return sets.agg((F.count_distinct("cases") <= 1).alias("agree"))


def comparable(left: Mapping[str, object], right: Mapping[str, object]) -> list[str]:
    """Why two runs cannot be compared, in order; nothing recorded on a side is no difference.

    Keys: experiment and policies (maps), suite, scope (cases), version, adjudicated.
    """
    out = []
    a, b = left.get("experiment") or {}, right.get("experiment") or {}
    if a and b:
        out += [f"experiment {k} differs" for k in a if a[k] != b.get(k)]
    if left.get("version") != right.get("version"):
        out.append("matching versions differ")
    if left.get("suite") != right.get("suite"):
        out.append("suites differ")
    if left.get("scope") and right.get("scope") and set(left["scope"]) != set(right["scope"]):
        out.append("scopes differ")
    both = bool(left.get("adjudicated") and right.get("adjudicated"))
    for policy in ("matching", *(("prompt", "retrieval") if both else ())):
        x, y = (left.get("policies") or {}).get(policy), (right.get("policies") or {}).get(policy)
        if x and y and x != y:
            out.append(f"{policy} policies differ")
    return out


def caveats(left: Mapping[str, object], right: Mapping[str, object]) -> list[str]:
    """What could not be checked when two runs are compared, and what the comparison is not about."""
    out = [f"{side} records no experiment" for side, run in (("baseline", left), ("other", right)) if not run.get("experiment")]
    out += [f"{side} records no scope" for side, run in (("baseline", left), ("other", right)) if not run.get("scope")]
    a, b = bool(left.get("adjudicated")), bool(right.get("adjudicated"))
    recorded = lambda run, policy: (run.get("policies") or {}).get(policy)
    for policy in ("matching", *(("prompt", "retrieval") if a and b else ())):
        if not (recorded(left, policy) and recorded(right, policy)):
            out.append(f"the {policy} policy is not recorded by both")
    if a == b:
        out.append("both took part with a model: a change between two such runs" if a else "no model took part: two measurements of analyzers")
    return out


def attribution(reports: DataFrame, deferred: Sequence[str] = ()) -> DataFrame:
    """stage, status, macro_f2 of every stage, measured or not; reports without A0, or of another identity than A0's, raise."""
    spark = reports.sparkSession
    stages = spark.createDataFrame([(s, s in deferred) for s in STAGES_OF_ATTRIBUTION], "stage string, deferred boolean")
    # one row, also where there is no such stage
    first = reports.where("stage = 'A0'").agg(F.max("identity").alias("__first"))
    joined = stages.join(reports, "stage", "left").crossJoin(F.broadcast(first))
    wrong = F.col("identity").isNotNull() & (F.col("identity") != F.col("__first"))
    fail = lambda *text: F.raise_error(F.concat(*text)).cast("string")
    status = F.when(F.col("__first").isNull(), fail(F.lit("stage A0 is not among the reports"))).when(wrong, fail(F.lit("another experiment in stage "), F.col("stage")))
    return joined.select("stage", status.when(F.col("identity").isNotNull(), "measured").when(F.col("deferred"), "deferred").otherwise("not_run").alias("status"), "macro_f2")


def repeatable(attempts: DataFrame) -> DataFrame:
    """One row: attempts, completed, repeatable (one distinct hash over the completed)."""
    done = F.when(F.col("completed"), F.col("result_hash"))
    return attempts.agg(F.count(F.lit(1)).alias("attempts"), F.count_if("completed").alias("completed"), (F.count_distinct(done) == 1).alias("repeatable"))


def run_repeatedly(spark: SparkSession, run: Callable[[int], DataFrame], repetitions: int, group: str, order: Sequence[str]) -> DataFrame:
    """attempt, completed, result_hash of a run made several times over; a run that fails is an attempt that did not complete.

    The hash names the set of a run's rows, whatever their order.
    """
    attempts = []
    for i in range(repetitions):
        try:
            attempts.append((i, True, set_hash(run(i), group, order).first()["hash"]))
        except Exception:  # the failure is the attempt's result
            attempts.append((i, False, None))
    return spark.createDataFrame(attempts, "attempt int, completed boolean, result_hash string")


def identity(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, identity: a digest of each key's rows that does not depend on their order, in memory that does not grow with them."""
    return rows.groupBy(key).agg(bag_digest(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)).alias("identity"))
