"""Scans end to end: intake, index, candidates, and the record of a run."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup, intake
from ..sources import diagnostics as d
from ..sources.records import merge_units

Runner = Callable[[str, str, list[str]], tuple[str, str]]


def scan_plan(entries: DataFrame, reason, present: DataFrame, outside: DataFrame | None = None) -> dict[str, DataFrame]:
    """units, excluded, coverage and limitations of a compilation database's entries (path, ordinal, arguments, ...).

    reason is the exclusion reason as a column over the entries.
    """
    kept = intake.plan(entries)
    classified = intake.classified(kept, reason)
    excluded = classified.where("reason is not null").select("path", "reason")
    repeated = kept.where("displaced > 0").select(F.lit("ambiguous_build_config").alias("kind"), F.col("path").alias("affects"), F.concat(F.col("displaced").cast("string"), F.lit(" other configuration(s)")).alias("detail"))
    by_reason = dedup.exclusion_limitations(excluded).select(F.lit("excluded_by_filter").alias("kind"), F.col("example").alias("affects"), F.concat("reason", F.lit(": "), F.col("files").cast("string")).alias("detail"))
    return {
        "units": classified.where("reason is null").drop("reason").orderBy("path"), "excluded": excluded.orderBy("path", "reason"),
        "coverage": intake.completeness(intake.coverage(present, kept)), "limitations": repeated.unionByName(by_reason),
    }


def run_analyzers(units: DataFrame, analyzers: DataFrame, runner: Runner) -> DataFrame:
    """unit, analyzer, status, text of every analyzer on every unit; runner(path, analyzer, arguments) gives status and output.

    A failing run is a row with its status, never an absent one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, name, arguments in zip(batch["path"], batch["analyzer"], batch["arguments"], strict=True):
                try:
                    status, text = runner(path, name, list(arguments if arguments is not None else []))
                except Exception as e:  # the run's failure is its result
                    status, text = "crashed", str(e)
                out.append((path, name, status, text))
            yield pd.DataFrame(out, columns=["unit", "analyzer", "status", "text"])

    # a few analyzers, named by the caller
    both = units.select("path", "arguments").crossJoin(F.broadcast(analyzers.select("analyzer")))
    return both.mapInPandas(run, "unit string, analyzer string, status string, text string")


def run_limitations(runs: DataFrame) -> DataFrame:
    return runs.where("status <> 'ok'").select(F.lit("analyzer_failed").alias("kind"), F.col("unit").alias("affects"), F.concat("analyzer", F.lit(": "), "status").alias("detail"))


def generate_candidates(outputs: DataFrame, files: DataFrame, root: str, producer: str, checks: DataFrame, kind: str = "text") -> DataFrame:
    """Merged candidates of analyzer outputs (run, text): parsed, placed, classified by rule, merged by place.

    A merged candidate has the weaknesses and rules of all its members, in
    first-seen order, and the region and message of the earliest.
    """
    parse = {"text": d.parse_text, "json": d.parse_json, "sarif": d.parse_sarif}[kind]
    parsed = parse(outputs).withColumn("rule_id", F.coalesce("rule_id", F.lit("")))
    matched = intake.rules_lookup(parsed.select("rule_id").distinct(), checks.select("check_id"))
    rules = matched.join(checks.select("check_id", "cwes"), "check_id", "left").select("rule_id", "cwes")
    found = d.candidates(parsed, files, root, producer, rules).where("drop_reason is null")
    rule = F.array(F.concat_ws(":", F.lit(producer), "rule_id"))
    placed = found.select("fingerprint", F.col("region.start_line").alias("line"), "symbol", "candidate_id", F.lit(producer).alias("tool"), "cwes", rule.alias("provenance"))
    merged = dedup.merge_candidates(placed).join(dedup.merged_lists(placed), ["fingerprint", "candidate_id"])
    return merged.join(found.select("candidate_id", "region", "message").dropDuplicates(["candidate_id"]), "candidate_id")


def build_index(inputs: DataFrame, current: DataFrame, cached: DataFrame, parse: Callable[[DataFrame], DataFrame], units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and limitations: cached units whose inputs still hold, and the others parsed anew.

    inputs: unit, path, sha256; cached: unit, status, error, ...; parse takes units to rows like cached.
    """
    good = intake.reusable_units(inputs, current).where("reusable").select("unit")
    fresh = parse(units.join(good, "unit", "left_anti"))
    return merge_units(cached.join(good, "unit", "left_semi").unionByName(fresh, allowMissingColumns=True))


def facts(parsed: DataFrame, lists: tuple[str, ...] = ("symbols", "calls", "macros", "includes")) -> dict[str, DataFrame]:
    """One table per list of parsed units (unit, lists of structs)."""
    return {name: parsed.select("unit", F.explode(name).alias("x")).select("unit", "x.*").distinct() for name in lists if name in parsed.columns}


def revision(outputs: Mapping[str, str | None]) -> dict[str, object]:
    """revision, dirty, pinned of recorded version-control output (head, status); no repository is unknown and a limitation."""
    head = (outputs.get("head") or "").strip()
    if not head:
        return {"revision": "unknown", "dirty": False, "pinned": False, "limitation": "revision_unavailable"}
    dirty = bool((outputs.get("status") or "").strip())
    return {"revision": head, "dirty": dirty, "pinned": not dirty, "limitation": None}


def git(root: str, arguments: list[str]) -> str | None:
    """What version control says about a tree on the driver's disk, null where it fails or there is none."""
    try:
        done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, timeout=60, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def resolve_revision(root: str, runner: Callable[[str, list[str]], str | None] = git) -> dict[str, object]:
    """revision, dirty, pinned of a tree; one that is no repository is unknown, with a limitation. Untracked files make it dirty."""
    return revision({"head": runner(root, ["rev-parse", "HEAD"]), "status": runner(root, ["status", "--porcelain"])})


def run_manifest(values: Mapping[str, object], tools: DataFrame) -> dict[str, object]:
    """The record of a run; what must be known and is not is an error."""
    for field in ("revision", "policy_version", "config_hash"):
        if not values.get(field):
            raise ValueError(f"the manifest needs {field}")
    return {**values, "tools": {r["tool"]: r["version"] for r in tools.orderBy("tool").collect()}}


def notifications(partial: bool, coverage: Mapping[str, object], counts: Mapping[str, int], limitations: DataFrame) -> list[str]:
    """What a run says about itself, in order: that it is partial, coverage, counts apart, limitations."""
    out = ["this run is partial"] if partial else []
    out.append("covered {covered} of {present} source files".format(**coverage))
    out.append("{confirmed} confirmed; {needs_review} to review".format(**counts))
    return out + [f"{r['kind']}: {r['detail']}" for r in limitations.orderBy("kind", "affects", "detail").collect()]


def exit_code(failed: bool, confirmed: int, partial: bool) -> int:
    """1 with confirmed findings, also of a partial run; 3 where nothing could run, or a partial run found nothing; else 0. 2 is for wrong usage, which no run reports."""
    if failed:
        return 3
    if confirmed:
        return 1
    return 3 if partial else 0
