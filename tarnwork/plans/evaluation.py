"""Evaluation of a suite, end to end: recorded diagnostics to findings, citations, metrics and gates."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weakness import family_of
from ..operators import gate, matching, metrics, resolution


class Evaluation(NamedTuple):
    findings: DataFrame
    resolutions: DataFrame
    families: DataFrame
    summary: DataFrame
    gates: DataFrame


def run_suite(candidates: DataFrame, truths: DataFrame, files: DataFrame, lines_of_code: DataFrame, fallback_family: str = "out_of_bounds", baseline_f2: float | None = None) -> Evaluation:
    """candidates: case_id, candidate_id, path, lines, bytes, sha256, cwes, message; truths as in records.truths with case_id.

    Findings are promoted without a model, every location is resolved against
    the files, confirmed ones are matched to truths, and metrics and gates are
    computed. lines_of_code: case_id, n. Where files have a case_id, each case
    has its own; a finding is known by its case and candidate.
    """
    places = candidates.select("candidate_id", "case_id", "path", "start_line", "end_line", "start_byte", "end_byte", "sha256")
    if "case_id" in files.columns:
        promoted = gate.promote(candidates, files).join(places, ["candidate_id", "case_id"])
        promoted = promoted.withColumn("finding_id", F.concat("case_id", F.lit("/"), "candidate_id"))
    else:
        promoted = gate.promote(candidates, files).join(places, "candidate_id").withColumn("finding_id", F.col("candidate_id"))
    citations = promoted.select("case_id", F.col("finding_id").alias("citation_id"), F.lit(None).cast("string").alias("evidence_id"), F.lit(None).cast("boolean").alias("issued"), "path", "start_line", "end_line", "start_byte", "end_byte", "sha256")
    resolved = resolution.resolve(citations, files)
    findings = gate.sections(promoted, resolved.select(F.col("citation_id").alias("finding_id"), F.lit(0).alias("place"), "status"))
    confirmed = findings.where("section = 'confirmed'")
    pairs = matching.match_one_to_one(matching.candidate_pairs(truths, confirmed.select("case_id", "path", "finding_id", "start_line", "end_line", "cwe")))
    of_case = truths.groupBy("case_id").agg(F.min_by("family", "truth").alias("__first"))
    with_family = confirmed.join(of_case, "case_id", "left").select("case_id", "finding_id", F.coalesce(family_of(F.col("cwe")), "__first", F.lit(fallback_family)).alias("family"))
    families = metrics.family_metrics(metrics.counts_by_family(matching.outcomes(truths.select("case_id", "truth", "family", "variant"), with_family, pairs)))
    rate = metrics.resolution_rate(resolved)
    loc = lines_of_code.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))
    counts = findings.agg(F.count_if(F.col("section") == "confirmed").alias("confirmed"), F.count_if(F.col("section") == "needs_review").alias("needs_review"))
    summary = metrics.overall_metrics(families).crossJoin(rate).crossJoin(loc).crossJoin(counts).withColumn("fp_per_kloc", metrics.fp_per_thousand(F.col("fp"), F.col("lines")))
    one = summary.select(F.col("rate").alias("citation_rate"), (F.col("total") - F.col("resolved")).alias("fabrications"), F.lit(0).alias("merged_counts"), "macro_f2", F.lit(baseline_f2).cast("double").alias("baseline_f2"))
    return Evaluation(findings, resolved, families, summary, metrics.gates(one, is_baseline=baseline_f2 is None))
