"""Check profiles: which rules an analyzer runs, and the weaknesses they report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..values import FAMILIES

SECTIONS = ("diagnostics", "csa", "tidy")
CHECK = "producer string, check_id string, families array<string>, cwes array<string>, enabled boolean, note string"


class ProfileError(ValueError):
    """A profile that cannot be used, and why."""


def _check(entry: object, where: str) -> tuple[str, list[str], list[str], bool, str | None]:
    if not isinstance(entry, Mapping) or not str(entry.get("id") or "").strip():
        raise ProfileError(f"{where}: a check is a mapping with an id")
    name = str(entry["id"]).strip()
    if extra := set(entry) - {"id", "families", "cwe", "enabled", "note"}:
        raise ProfileError(f"{where}: check {name} has unknown keys {sorted(extra)}")
    families = list(dict.fromkeys(entry.get("families") or []))
    if not families or set(families) - set(FAMILIES):
        raise ProfileError(f"{where}: check {name} needs families out of {', '.join(FAMILIES)}")
    cwes = list(entry.get("cwe") or [])
    if any(not str(c).startswith("CWE-") or not str(c)[4:].isdigit() for c in cwes):
        raise ProfileError(f"{where}: check {name} names a malformed weakness id")
    return name, families, cwes, bool(entry.get("enabled", True)), entry.get("note")


def parse_profile(spark: SparkSession, raw: object, where: str = "profile") -> DataFrame:
    """The checks of a profile (a parsed document), in order; bad shapes, unknown families and duplicates raise ProfileError."""
    if not isinstance(raw, Mapping):
        raise ProfileError(f"{where}: a profile is a mapping")
    if not str(raw.get("version") or "").strip():
        raise ProfileError(f"{where}: a profile has a version")
    out = []
    for producer in SECTIONS:
        section = raw.get(producer) or {}
        if not isinstance(section, Mapping) or not isinstance(section.get("checks") or [], list):
            raise ProfileError(f"{where}: {producer} is a mapping with a list of checks")
        out += [(producer, *_check(entry, where)) for entry in section.get("checks") or []]
    names = [r[1] for r in out]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ProfileError(f"{where}: checks come twice: {', '.join(twice)}")
    return spark.createDataFrame(out, CHECK)


def load_profile(spark: SparkSession, text: str, where: str = "profile") -> DataFrame:
    """The checks of a YAML profile (its text)."""
    import yaml

    return parse_profile(spark, yaml.safe_load(text), where)


def checks_for(checks: DataFrame, producer: str, enabled_only: bool = True) -> DataFrame:
    return checks.where((F.col("producer") == producer) & (F.col("enabled") | F.lit(not enabled_only)))


def families_covered(checks: DataFrame) -> DataFrame:
    return checks.where("enabled").select(F.explode("families").alias("family")).distinct()


def checks_argument(checks: DataFrame) -> str:
    """The list that enables a profile's checks and then disables the others it names."""
    rows = sorted((r["check_id"], r["enabled"]) for r in checks_for(checks, "tidy", enabled_only=False).collect())
    return ",".join(["-*", *(c for c, on in rows if on), *(f"-{c}" for c, on in rows if not on)])
