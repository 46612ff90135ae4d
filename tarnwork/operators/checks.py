"""Guards and small relations of the gate: refusals, comparability, redactions and withheld units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import matching_glob


def refuse(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """df, failing on the first row that is bad: never trimmed."""
    guard = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
    return df.where(guard)


def select_cases(cases: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted cases, all without a wish; an unknown id raises."""
    if not wanted:
        return cases
    ids = cases.sparkSession.createDataFrame([(w,) for w in wanted], "case_id string")
    unknown = [r[0] for r in ids.join(cases, "case_id", "left_anti").collect()]
    if unknown:
        raise KeyError(f"unknown cases: {', '.join(sorted(unknown))}")
    return cases.join(F.broadcast(ids), "case_id", "left_semi")


def detections(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Confirmed findings (pair_id, path, section) in the paths that their pair affects (pair_id, affected_paths)."""
    affected = pairs.select("pair_id", F.explode("affected_paths").alias("path"))
    return findings.where("section = 'confirmed'").join(affected, ["pair_id", "path"], "left_semi")


def withheld(units: DataFrame, globs: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Units that may be shown, and limitations for those whose path is excluded."""
    marked = units.withColumn("__glob", matching_glob(F.col("path"), globs))
    limits = marked.where("__glob is not null").select(F.lit("excluded_by_filter").alias("kind"), F.col("path").alias("affects"), F.concat(F.lit("withheld by "), "__glob").alias("detail"))
    return marked.where("__glob is null").drop("__glob"), limits.distinct()


def redaction_limitations(units: DataFrame) -> DataFrame:
    """Limitations for primary units (evidence_id, unit_class, counts) in which secrets were replaced."""
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda n, x: n + x)
    hit = units.where((F.col("unit_class") == "primary") & (total > 0))
    return hit.select(F.lit("excluded_by_filter").alias("kind"), F.col("evidence_id").alias("affects"), F.concat(total.cast("string"), F.lit(" secret(s) replaced")).alias("detail"))


def captured_intact(bundle: DataFrame, evidence_ids: DataFrame) -> DataFrame:
    """evidence_id, intact: whether the captured bytes still hash to the recorded value; an unknown id is not."""
    return evidence_ids.join(bundle.select("evidence_id", "captured", "sha256"), "evidence_id", "left").select("evidence_id", F.coalesce(F.sha2("captured", 256) == F.lower("sha256"), F.lit(False)).alias("intact"))


def assert_same_version(left: object, right: object, what: str) -> None:
    if left != right:
        raise ValueError(f"{what} differ ({left} and {right}): results are not comparable")


def assert_control(configs: Sequence[dict], field: str, value: object) -> None:
    if not any(c.get(field) == value for c in configs):
        raise ValueError(f"the grid has no control with {field}={value}")
