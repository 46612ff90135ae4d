"""The evidence gate: every check of an answer gives failure rows, which decide acceptance, confidence and reasons.

Checks are independent relations keyed by candidate_id, joined once at the
end, so all failures are collected, not only the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, ranks, weakness
from ..values import BLOCKING_REASONS, EXPLOITABILITIES, FLOW_KINDS, REACHABILITIES, UPSTREAM_ROLES
from .dedup import evidence_union

#: Failures that lower a claim and the confidence, and do not refuse the answer.
LOWERING = ("impact_exceeds_evidence",)


def unissued(answers: DataFrame, issued: DataFrame) -> DataFrame:
    """candidate_id, subject, reason of ids an answer cites that were not issued to it."""
    cited = answers.select("candidate_id", F.explode(F.array_distinct("cited")).alias("evidence_id"))
    return cited.join(issued.select("candidate_id", "evidence_id"), ["candidate_id", "evidence_id"], "left_anti").select("candidate_id", F.col("evidence_id").alias("subject"), F.lit("citation_unresolved").alias("reason"))


def verdicts(answers: DataFrame) -> DataFrame:
    reason = F.when(F.col("verdict") == "rejected", "model_rejected").when(F.col("verdict") != "confirmed", "model_inconclusive")
    return answers.select("candidate_id", F.lit("verdict").alias("subject"), reason.alias("reason")).where("reason is not null")


def quotations(answers: DataFrame, captured: DataFrame) -> DataFrame:
    """Quotations (evidence_id, text) whose bytes do not stand in the captured region."""
    quoted = answers.select("candidate_id", F.inline("quotations"))
    joined = quoted.join(captured.select("candidate_id", "evidence_id", "captured"), ["candidate_id", "evidence_id"], "left")
    absent = ~F.coalesce(F.contains(F.col("captured").cast("binary"), F.col("text").cast("binary")), F.lit(False))
    return joined.where(absent).select("candidate_id", F.col("evidence_id").alias("subject"), F.lit("hash_mismatch").alias("reason"))


def assumptions(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """An empty list of assumptions that drops or limitations of the context contradict; contexts: candidate_id, dropped, limitations."""
    empty = answers.where(F.size("assumptions") == 0).join(contexts.where("dropped > 0 or limitations > 0"), "candidate_id", "left_semi")
    return empty.select("candidate_id", F.lit("unresolved_assumptions").alias("subject"), F.lit("assumptions_unstated").alias("reason"))


def provenance(candidates: DataFrame, tools: DataFrame) -> DataFrame:
    """Analyzers that a candidate credits and that did not run; candidates: candidate_id, tool."""
    return candidates.join(tools, "tool", "left_anti").select("candidate_id", F.col("tool").alias("subject"), F.lit("schema_violation").alias("reason"))


def weaknesses(answers: DataFrame, cited_text: DataFrame) -> DataFrame:
    """Confirmed ids that cannot be carried, or whose lexical precondition the cited text does not meet.

    cited_text: candidate_id, text; where nothing citable is left the precondition is not checked.
    """
    confirmed = answers.where("verdict = 'confirmed'").join(cited_text, "candidate_id", "left")
    status = weakness.status_failure(F.col("cwe"), F.col("cwe_rationale"))
    lexical = F.when(F.col("text").isNotNull() & ~weakness.precondition_holds(F.col("cwe"), F.col("text")), "evidence_does_not_support_cwe")
    return confirmed.select("candidate_id", F.col("cwe").alias("subject"), F.coalesce(status, lexical).alias("reason")).where("reason is not null")


def signals(answers: DataFrame, units: DataFrame, edges: DataFrame) -> DataFrame:
    """candidate_id, control_flow, code, upstream from what an answer cites.

    units: candidate_id, evidence_id, kind, role; edges: candidate_id, verified.
    """
    cited = answers.select("candidate_id", F.explode_outer(F.array_distinct("cited")).alias("evidence_id"))
    joined = cited.join(units, ["candidate_id", "evidence_id"], "left").join(edges, "candidate_id", "left")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    verified = F.col("verified") > 0
    return joined.groupBy("candidate_id").agg(
        some(verified | F.col("kind").isin(*FLOW_KINDS) | (F.col("role") == "flow_function")).alias("control_flow"),
        some(F.col("kind") != "analyzer_diagnostic").alias("code"),
        some(verified | F.col("role").isin(*UPSTREAM_ROLES)).alias("upstream"),
    )


def capped_claims(answers: DataFrame, found: DataFrame) -> DataFrame:
    """candidate_id, reachability, exploitability (only lowered) and lowered: which of the two were."""
    joined = answers.join(found, "candidate_id")
    reach = ranks.weaker(F.col("reachability"), ranks.reachability_ceiling(F.col("control_flow"), F.col("code")), REACHABILITIES)
    exploit = ranks.weaker(F.col("exploitability"), ranks.exploitability_ceiling(F.col("upstream"), F.col("control_flow")), EXPLOITABILITIES)
    changed = F.filter(F.array(F.when(reach != F.col("reachability"), "reachability"), F.when(exploit != F.col("exploitability"), "exploitability")), lambda x: x.isNotNull())
    return joined.select("candidate_id", reach.alias("reachability"), exploit.alias("exploitability"), changed.alias("lowered"))


def decide(answers: DataFrame, failures: DataFrame, claims: DataFrame) -> DataFrame:
    """candidate_id, accepted, confidence, reason, reasons, reachability, exploitability of each answer.

    failures: candidate_id, subject, reason from all checks.
    """
    lowering = claims.select("candidate_id", F.explode("lowered").alias("subject"), F.lit("impact_exceeds_evidence").alias("reason"))
    every = failures.select("candidate_id", "subject", "reason").unionByName(lowering)
    blocks = F.col("reason").isin(*BLOCKING_REASONS) & ~F.col("reason").isin(*LOWERING)
    grouped = every.groupBy("candidate_id").agg(ranks.ordered_reasons(F.collect_set("reason")).alias("reasons"), ranks.ordered_reasons(F.collect_set(F.when(blocks, F.col("reason")))).alias("blocking"))
    joined = answers.select("candidate_id", "verdict").join(grouped, "candidate_id", "left").join(claims, "candidate_id", "left")
    none = F.array().cast("array<string>")
    blocking = F.coalesce("blocking", none)
    accepted = (F.col("verdict") == "confirmed") & (F.size(blocking) == 0)
    confidence = F.when(~accepted, "review_required").when(F.size(F.coalesce("lowered", none)) > 0, "medium").otherwise("high")
    reason = F.when(accepted, "all_citations_resolved").otherwise(F.coalesce(F.get(blocking, F.lit(0)), F.lit("model_inconclusive")))
    return joined.select("candidate_id", accepted.alias("accepted"), confidence.alias("confidence"), reason.alias("reason"), F.coalesce("reasons", none).alias("reasons"), "reachability", "exploitability")


def promote(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Findings without a model: candidate_id, cwe, family, impact, severity, confidence, reason.

    candidates: candidate_id, path, start_byte, end_byte, sha256, cwes, message;
    a region whose bytes changed, or a weakness of no family, goes to review.
    """
    from ..functions.build import lookup
    from ..functions.regions import slice_bytes
    from ..values import IMPACT_OF_FAMILY

    by_case = [c for c in ("case_id",) if c in files.columns]
    joined = candidates.join(files.select(*by_case, "path", "content"), [*by_case, "path"], "left")
    stale = F.coalesce(F.sha2(slice_bytes(F.col("content"), F.col("start_byte"), F.col("end_byte")), 256) != F.lower("sha256"), F.lit(True))
    family = F.get(weakness.families_of(F.col("cwes")), F.lit(0))
    part = lambda i, other: F.coalesce(lookup({f: v[i] for f, v in IMPACT_OF_FAMILY.items()}, family), F.lit(other))
    reason = F.when(stale, "hash_mismatch").when(family.isNull(), "out_of_scope_family").otherwise("analyzer_only")
    return joined.select(
        "candidate_id", *by_case, weakness.primary(F.col("cwes"), F.col("message")).alias("cwe"), family.alias("family"), part(0, "undefined_behavior").alias("impact"), part(1, "low").alias("severity"),
        F.when(reason == "analyzer_only", "medium").otherwise("review_required").alias("confidence"), reason.alias("reason"), F.lit("unknown").alias("reachability"), F.lit("unknown").alias("exploitability"),
    )


ITEM = "struct<evidence_id:string,kind:string,path:string,start_line:int,end_line:int,start_byte:bigint,end_byte:bigint,sha256:string,symbol:string>"
#: What to do about a weakness of each family, and about others.
REMEDIES = {
    "out_of_bounds": "Check the index or length against the size of the object before the access.",
    "memory_lifetime": "Give the object one owner, and drop every other reference when it is freed.",
    "null_uninitialized": "Initialize the value, or test it, on every path that leads to its use.",
    "integer": "Test the operands before the operation, or compute in a wider type.",
    "resource_leak": "Release the resource on every way out, early returns and errors included.",
    "injection": "Keep untrusted text out of the command or query: pass it as data.",
}
OTHER_REMEDY = "Review the diagnostic and the code around it."
LIMIT = "array<struct<kind:string,detail:string,affects:string>>"


def _item(kind: str, path: Column, region: Column, symbol: Column) -> Column:
    start, end = region["start_byte"].cast("long"), region["end_byte"].cast("long")
    name = ids.evidence_id(F.lit(kind), path, start, end, region["sha256"])
    fields = {"evidence_id": name, "kind": F.lit(kind), "path": path, "start_line": region["start_line"], "end_line": region["end_line"], "start_byte": start, "end_byte": end, "sha256": region["sha256"], "symbol": symbol}
    return F.struct(*[c.alias(n) for n, c in fields.items()]).cast(ITEM)


def findings(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Whole findings without a model: what ``promote`` decides, and finding_id, fingerprint, evidence, symbol, texts, limitations.

    candidates: as for promote, and start_line, end_line, symbol (a name or
    null), enclosing (the region that holds the symbol: struct of lines, bytes
    and sha256, or null), steps (array of ITEM, the analyzer's path). Evidence
    is the diagnostic, the enclosing code, then the steps in their order, each
    id once. A symbol is carried only with a region that proves it; one that
    is not proven is a limitation. Where candidates and files have a case_id,
    both belong together by it.
    """
    from ..functions.build import lookup

    by_case = [c for c in ("case_id",) if c in files.columns]
    rows = promote(candidates, files).join(candidates.select("candidate_id", *by_case, "path", "start_line", "end_line", "start_byte", "end_byte", "sha256", "message", "symbol", "enclosing", "steps"), ["candidate_id", *by_case])
    enclosed = F.col("enclosing").isNotNull()
    proven = F.when(enclosed, F.col("symbol"))
    region = F.struct("start_line", "end_line", "start_byte", "end_byte", "sha256")
    none = F.array().cast(f"array<{ITEM}>")
    own = F.array(_item("analyzer_diagnostic", F.col("path"), region, F.lit(None).cast("string")))
    around = F.when(enclosed, F.array(_item("primary_code", F.col("path"), F.col("enclosing"), proven))).otherwise(none)
    evidence = evidence_union(F.concat(own, around), F.coalesce(F.col("steps").cast(f"array<{ITEM}>"), none))
    where = F.concat("path", F.lit(":"), F.col("start_line").cast("string"))
    rationale = F.when(F.col("reason") == "out_of_scope_family", F.concat(F.col("cwe"), F.lit(" is not among the families that are judged"))).otherwise(F.concat(F.lit("the rule behind the diagnostic stands for "), "cwe"))
    limit = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"), F.col("path").alias("affects"))
    unproven = F.col("symbol").isNotNull() & ~enclosed
    limits = F.concat(
        F.array(limit("no_evidence_expansion", F.lit("analyzer only: nothing was retrieved and no model was asked"))).cast(LIMIT),
        F.when(unproven, F.array(limit("unresolved_symbol", F.concat(F.lit("no region proves that the line is inside "), F.coalesce("symbol", F.lit(""))))).cast(LIMIT)).otherwise(F.array().cast(LIMIT)),
    )
    return rows.select(
        "candidate_id", *by_case, ids.finding_id(F.col("cwe"), F.col("path"), proven, F.col("message"), F.col("start_byte"), F.col("end_byte")).alias("finding_id"), ids.dedup_fingerprint(F.col("cwe"), F.col("path"), proven, F.col("message")).alias("fingerprint"),
        "cwe", rationale.alias("cwe_rationale"), "family", "path", "start_line", "end_line", "start_byte", "end_byte", "sha256", proven.alias("symbol"), evidence.alias("evidence"), "impact", "severity", F.col("message").alias("description"),
        F.concat(F.lit("an analyzer reported this at "), where, F.lit("; the evidence is its diagnostic and that region")).alias("evidence_supports"), "reachability", "exploitability", "confidence", "reason",
        F.coalesce(lookup(REMEDIES, F.col("family")), F.lit(OTHER_REMEDY)).alias("remediation"), limits.alias("limitations"),
    )


def sections(findings: DataFrame, resolved: DataFrame) -> DataFrame:
    """findings with section (confirmed, needs_review), and confidence and reason lowered by their first failing citation.

    resolved: finding_id, place, status.
    """
    from ..functions.build import lookup
    from ..values import REASON_OF_STATUS
    from .resolution import first_failures

    failed = first_failures(resolved, "finding_id", "place").withColumnRenamed("status", "__failed")
    joined = findings.join(failed, "finding_id", "left")
    broken = F.col("__failed").isNotNull()
    lowered = joined.withColumn("confidence", F.when(broken, "review_required").otherwise(F.col("confidence"))).withColumn("reason", F.when(broken, F.coalesce(lookup(REASON_OF_STATUS, F.col("__failed")), F.lit("schema_violation"))).otherwise(F.col("reason")))
    return lowered.withColumn("section", F.when(F.col("confidence") == "review_required", "needs_review").otherwise("confirmed")).drop("__failed")


def refused(candidates: DataFrame, reason: Column) -> DataFrame:
    """Candidates that got no answer, kept with a reason: a blocking one means review."""
    return candidates.withColumn("reason", reason).withColumn("confidence", F.when(F.col("reason").isin(*BLOCKING_REASONS), "review_required").otherwise(F.lit("medium")))


def route(disposition: Column, ambiguous: Column, severity: Column, has_code: Column, out_of_scope: Column, allow_escalation: bool = True, escalate_at: str = "high") -> Column:
    """The tier that answers."""
    from ..values import SEVERITIES

    severe = ranks.rank(severity, SEVERITIES) <= SEVERITIES.index(escalate_at)
    return F.when(disposition == "dismiss", "triage").when(ambiguous & severe & F.lit(allow_escalation) & has_code & ~out_of_scope, "escalation").otherwise("adjudication")


def triage_of(verdict: Column) -> Column:
    """struct(disposition, ambiguous) of a verdict."""
    return F.struct(F.when(verdict == "rejected", "dismiss").otherwise("adjudicate").alias("disposition"), (~verdict.isin("confirmed", "rejected")).alias("ambiguous"))


def recorded_answers(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """requests joined to recorded answers by key; those without one keep null and a status."""
    joined = requests.join(answers.withColumn("__found", F.lit(True)), "key", "left")
    return joined.withColumn("status", F.when(F.col("__found"), "answered").otherwise("not_recorded")).drop("__found")
