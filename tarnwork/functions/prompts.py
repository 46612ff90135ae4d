"""Requests to a model as columns: units, limitations, whole prompts, and answers read back. Nothing is sent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fence, scrub, token_estimate

#: Lines of a free-form answer (fixed values).
VERDICT = r"(?im)^\s*VERDICT\s*:\s*(confirmed|rejected|review_required)\s*$"
CWE = r"(?im)^\s*CWE\s*:\s*(CWE-\d+|none|null)\s*$"
RATIONALE = r"(?im)^\s*RATIONALE\s*:\s*(.+?)\s*$"


def render_unit(evidence_id: Column, role: Column, path: Column, start_line: Column, end_line: Column, body: Column) -> Column:
    """One retrieved unit: a heading and its text between fences that the text cannot close."""
    marks = fence(body)
    where = F.concat(path, F.lit(":"), start_line.cast("string"), F.lit("-"), end_line.cast("string"))
    return F.concat(F.lit("### "), evidence_id, F.lit(" "), role, F.lit(" "), where, F.lit("\n"), marks, F.lit("\n"), body, F.lit("\n"), marks)


def render_limitations(limitations: Column) -> Column:
    """Distinct lines of (kind, detail), first seen first."""
    lines = F.transform(limitations, lambda x: F.concat(F.lit("- "), x["kind"], F.lit(": "), x["detail"]))
    return F.when(F.size(limitations) == 0, F.lit("None.")).otherwise(F.array_join(F.array_distinct(lines), "\n"))


def assemble(message: Column, units: Column, limitations: Column) -> Column:
    """struct(text, counts, tokens): the prompt of a candidate, its secrets replaced, and its estimate; units are rendered texts in order."""
    text = F.concat(F.lit("## Diagnostic\n"), message, F.lit("\n\n## Evidence\n"), F.array_join(units, "\n\n"), F.lit("\n\n## Limitations\n"), render_limitations(limitations))
    clean = scrub(text)
    return F.struct(clean["text"].alias("text"), clean["counts"].alias("counts"), token_estimate(clean["text"]).alias("tokens"))


def window_prompt(message: Column, path: Column, first: Column, last: Column, body: Column) -> Column:
    """The control: a diagnostic and the lines around it."""
    where = F.concat(path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"))
    return F.concat(message, F.lit("\n"), where, F.lit("\n"), fence(body), F.lit("\n"), body, F.lit("\n"), fence(body))


def read_answer(text: Column) -> Column:
    """struct(verdict, cwe, rationale) of a free-form answer; null without verdict or rationale, or confirmed without an id."""
    part = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    verdict, named, rationale = F.lower(part(VERDICT)), F.upper(part(CWE)), part(RATIONALE)
    cwe = F.when(~named.isin("NONE", "NULL"), named)
    usable = verdict.isNotNull() & rationale.isNotNull() & ~((verdict == "confirmed") & cwe.isNull())
    return F.when(usable, F.struct(verdict.alias("verdict"), cwe.alias("cwe"), rationale.alias("rationale")))


def merged_counts(left: Column, right: Column) -> Column:
    """Counts by kind, added."""
    return F.map_zip_with(left, right, lambda _, a, b: F.coalesce(a, F.lit(0).cast("long")) + F.coalesce(b, F.lit(0).cast("long")))


def claim_provenance(claims: Column) -> Column:
    """struct(facts, models): claims (producer, tool_name) by who made them."""
    by = lambda model: F.transform(F.filter(claims, lambda c: (c["producer"] == "llm") == F.lit(model)), lambda c: c["tool_name"])
    return F.struct(F.array_distinct(by(False)).alias("facts"), F.array_distinct(by(True)).alias("models"))


def attempt_reason(failures: Column) -> Column:
    """Why no attempt was accepted: an unknown citation, else a schema failure, else that nobody answered."""
    return F.when(F.array_contains(failures, "unknown_citation"), "citation_unresolved").when(F.array_contains(failures, "schema"), "schema_invalid_response").otherwise("provider_unavailable")
