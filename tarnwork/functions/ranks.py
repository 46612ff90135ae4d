"""Ranks and scores of findings, claims and retrieved units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V
from .build import lookup
from .weakness import family_of


def rank(value: Column, order: Sequence[str]) -> Column:
    """The place of a value in an order, the order's length for others."""
    return F.coalesce(lookup({v: i for i, v in enumerate(order)}, value), F.lit(len(order)))


def severity_of(cwe: Column, impact: Column) -> Column:
    """The family's severity, lowered to what the kind of impact can be worth."""
    base = F.coalesce(lookup(V.SEVERITY_OF_FAMILY, family_of(cwe)), F.lit("low"))
    ceiling = F.coalesce(lookup(V.CEILING_OF_IMPACT, impact), F.lit("low"))
    return F.when(rank(base, V.SEVERITIES) >= rank(ceiling, V.SEVERITIES), base).otherwise(ceiling)


def effort_of(regions: Column) -> Column:
    """How far a fix reaches, from the distinct (path, start_line, end_line) it touches."""
    distinct = F.array_distinct(regions)
    return F.when(F.size(F.array_distinct(F.transform(distinct, lambda r: r["path"]))) > 1, "cross_module").when(F.size(distinct) > 1, "function").otherwise("local")


def agreement_of(provenance: Column, producers: Sequence[str] = V.ANALYZER_PRODUCERS) -> Column:
    """How many distinct analyzers reported a finding; (producer, tool_name) entries."""
    return F.size(F.array_distinct(F.transform(F.filter(provenance, lambda p: p["producer"].isin(*producers)), lambda p: p["tool_name"])))


def rank_key(severity: Column, confidence: Column, reachability: Column, agreement: Column, effort: Column) -> Column:
    """The order of a report, strongest first."""
    return F.struct(
        rank(severity, V.SEVERITIES).alias("severity"), rank(confidence, V.CONFIDENCES).alias("confidence"), rank(reachability, V.REACHABILITIES).alias("reachability"),
        (-agreement).alias("agreement"), rank(effort, V.EFFORTS).alias("effort"),
    )


def explain(severity: Column, confidence: Column, reachability: Column, agreement: Column, effort: Column) -> Column:
    return F.concat(severity, F.lit(" severity, "), confidence, F.lit(" confidence, reachability "), reachability, F.lit(", reported by "), agreement.cast("string"), F.lit(" analyzer(s), fix reaches "), effort)


def weaker(claimed: Column, ceiling: Column, order: Sequence[str]) -> Column:
    """The lower of a claim and its ceiling; the order's first is the strongest."""
    return F.when(rank(claimed, order) >= rank(ceiling, order), claimed).otherwise(ceiling)


def reachability_ceiling(control_flow: Column, code: Column) -> Column:
    return F.when(control_flow, "demonstrated").when(code, "argued").otherwise("unknown")


def exploitability_ceiling(upstream: Column, control_flow: Column) -> Column:
    return F.when(upstream & control_flow, "demonstrated").when(upstream, "plausible").otherwise("unlikely")


def unit_class(role: Column) -> Column:
    return lookup({r: c for r, c, _, _ in V.ROLES}, role)


def evidence_kind(role: Column) -> Column:
    return lookup({r: k for r, _, k, _ in V.ROLES}, role)


def relevance(role: Column, depth: Column, on_flow: Column) -> Column:
    """Base points less a penalty per hop after the first, more on the flow, as a share of the scale."""
    points = lookup({r: p for r, _, _, p in V.ROLES}, role) - F.greatest(F.lit(0), depth - 1) * V.DEPTH_PENALTY + F.when(on_flow, V.FLOW_BONUS).otherwise(0)
    return F.least(F.lit(V.FULL_SCALE), F.greatest(F.lit(0), points)) / F.lit(float(V.FULL_SCALE))


def is_release_call(name: Column) -> Column:
    low = F.lower(name)
    pattern = "(?:" + "|".join(V.RELEASE_SUFFIXES) + ")$|^(?:" + "|".join(V.RELEASE_PREFIXES) + ")"
    return F.coalesce(low.isin(*V.RELEASE_NAMES) | low.rlike(pattern), F.lit(False))


def review_reason(status: Column, has_edge: Column) -> Column:
    """The reason a failed citation is reviewed for: a symbol failure of an edge is the edge's."""
    return (
        F.when(has_edge & (status == "symbol_not_found"), "call_edge_unresolved")
        .when(status == "unknown_evidence_id", "citation_unresolved")
        .otherwise(F.coalesce(lookup(V.REASON_OF_STATUS, status), F.lit("schema_violation")))
    )


def ordered_reasons(reasons: Column) -> Column:
    """Distinct reasons by precedence, then name."""
    keyed = F.transform(F.array_distinct(reasons), lambda r: F.struct(rank(r, V.REVIEW_REASONS).alias("k"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda x: x["r"])


def predict_category(cwe: Column, effort: Column) -> Column:
    """The maintainability category of a finding, null where neither family nor effort says one."""
    return F.coalesce(lookup(V.CATEGORY_OF_FAMILY, family_of(cwe)), lookup(V.CATEGORY_OF_EFFORT, effort))


def diagnostic_severity(word: Column) -> Column:
    """A tool's word on four levels; an unknown one is a warning."""
    text = F.lower(F.trim(word))
    return F.when(F.contains(text, F.lit("fatal")) | (text == "error"), "error").when(text.isin("note", "remark"), text).otherwise("warning")
