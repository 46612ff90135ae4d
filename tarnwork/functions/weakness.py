"""Weakness ids: status, family, replacements, and the primary id of a candidate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import CWE_CATALOGUE, CWE_EQUIVALENT, CWE_PROHIBITED, MESSAGE_PHRASES, PRECONDITION_OF_CWE, PRECONDITION_OF_FAMILY, PRECONDITIONS
from .build import lookup
from .ids import normalize_message

_STATUS = {c[0]: c[3] for c in CWE_CATALOGUE} | {c[0]: "prohibited" for c in CWE_PROHIBITED}
_FAMILY = {c[0]: c[2] for c in CWE_CATALOGUE}


def is_cwe_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^CWE-\d{1,5}$"), F.lit(False))


def status_of(cwe: Column) -> Column:
    return F.coalesce(lookup(_STATUS, cwe), F.lit("out_of_scope"))


def family_of(cwe: Column) -> Column:
    return lookup(_FAMILY, cwe)


def families_of(cwes: Column) -> Column:
    """Distinct families of an array of ids, in order."""
    return F.array_distinct(F.filter(F.transform(cwes, family_of), lambda f: f.isNotNull()))


def out_of_scope(cwes: Column) -> Column:
    """No id, or none that a finding can carry."""
    return (F.size(cwes) == 0) | F.forall(cwes, lambda c: status_of(c).isin("out_of_scope", "prohibited"))


def equivalent(truth: Column, found: Column) -> Column:
    """Whether a found id counts for a true one."""
    known = F.create_map(*[x for k, v in CWE_EQUIVALENT.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    return (truth == found) | F.coalesce(F.array_contains(F.try_element_at(known, truth), found), F.lit(False))


def replacements(cwe: Column, context: Column) -> Column:
    """For a prohibited id, the allowed ones of its families: first those whose hints stand in the context."""
    families = F.create_map(*[x for i, _, f in CWE_PROHIBITED for x in (F.lit(i), F.array(*map(F.lit, f)) if f else F.array().cast("array<string>"))])
    allowed = F.array(*[F.struct(F.lit(i).alias("cwe"), F.lit(f).alias("family"), (F.array(*map(F.lit, h)) if h else F.array().cast("array<string>")).alias("hints")) for i, _, f, s, h in CWE_CATALOGUE if s == "allowed"])
    mine = F.filter(allowed, lambda e: F.coalesce(F.array_contains(F.try_element_at(families, cwe), e["family"]), F.lit(False)))
    hinted = lambda e: F.exists(e["hints"], lambda h: F.contains(F.lower(context), h))
    return F.transform(F.concat(F.filter(mine, hinted), F.filter(mine, lambda e: ~hinted(e))), lambda e: e["cwe"])


def usable(proposed: Column, suggested: Column, fallback: Column) -> Column:
    """The proposed id if a finding can carry it, else the first suggested one that it can, else the fallback."""
    carriable = lambda c: status_of(c).isin("allowed", "discouraged")
    return F.coalesce(F.when(carriable(proposed), proposed), F.get(F.filter(suggested, carriable), F.lit(0)), fallback)


def primary(suggested: Column, message: Column) -> Column:
    """The id a candidate is reported under.

    Among several mapped ids the message decides by the first phrase it holds
    whose id is mapped, else the first mapped one; with none, a keyword.
    """
    mapped = F.filter(suggested, lambda c: family_of(c).isNotNull())
    text = normalize_message(message)
    chosen = F.coalesce(*[F.when(F.contains(text, F.lit(phrase)) & F.array_contains(mapped, cwe), F.lit(cwe)) for phrase, cwe in MESSAGE_PHRASES])
    keyword = F.when(F.contains(text, F.lit("leak")), "CWE-772").when(F.contains(text, F.lit("null")), "CWE-476").when(F.contains(text, F.lit("uninitialized")), "CWE-457").otherwise("CWE-908")
    return F.coalesce(F.when(F.size(mapped) > 1, chosen), F.get(mapped, F.lit(0)), keyword)


def sort_key(cwe: Column) -> Column:
    """Numeric order of ids, then text."""
    return F.struct(F.coalesce(F.regexp_extract(cwe, r"(\d+)$", 1).try_cast("int"), F.lit(0)).alias("n"), cwe.alias("cwe"))


def precondition_of(cwe: Column) -> Column:
    """The name of the lexical rule that a claim of this id has to satisfy, null without one."""
    return F.coalesce(lookup(PRECONDITION_OF_CWE, cwe), lookup(PRECONDITION_OF_FAMILY, family_of(cwe)))


def precondition_holds(cwe: Column, cited: Column) -> Column:
    """Whether the cited text has what the claim needs; true where nothing is needed."""
    rule = precondition_of(cwe)
    holds = F.when(rule.isNull(), F.lit(True))
    for name, (_, pattern) in PRECONDITIONS.items():
        holds = holds.when(rule == name, cited.rlike(f"(?mU){pattern}"))
    return holds


def status_failure(cwe: Column, rationale: Column) -> Column:
    """The reason a claimed id is refused, null if it is not."""
    status = status_of(cwe)
    return (
        F.when(cwe.isNull(), "evidence_does_not_support_cwe")
        .when(status == "prohibited", "cwe_mapping_rejected")
        .when(status == "out_of_scope", "out_of_scope_family")
        .when((status == "discouraged") & (F.trim(F.coalesce(rationale, F.lit(""))) == ""), "cwe_mapping_rejected")
    )
