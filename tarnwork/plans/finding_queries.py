"""Queries of whole findings, merged candidates and what a run notes about itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, gate
from . import grid
from .function_queries import by, pick
from .registry import query, t
from .relation_queries import name

_PART = "encode({0}) || '\\x00'::BLOB"


def _id(prefix: str, domain: str, *parts: str) -> str:
    """SQL of a content address; a part that may be null is given as a blob of its own."""
    blobs = " || ".join(p if p.startswith("(") else _PART.format(p) for p in (f"'audit/{domain}'", *parts))
    return f"'{prefix}' || substr(sha256({blobs}), 1, 16)"


_SYMBOL = "(CASE WHEN k = 1 THEN encode('fn' || doc_id) || '\\x00'::BLOB ELSE '\\xFF\\x00'::BLOB END)"
_REMEDY = "CASE family " + " ".join(f"WHEN '{f}' THEN '{text}'" for f, text in gate.REMEDIES.items()) + f" ELSE '{gate.OTHER_REMEDY}' END"


@query(
    "whole_findings",
    f"""
    WITH x AS (
      SELECT doc_id, doc_id % 4 AS k, 'f' || doc_id AS path, {by('doc_id', 'CWE-787', 'CWE-79', 'CWE-401')} AS given, doc_id % 5 = 0 OR strlen(coalesce(text, '')) < 10 AS stale,
             CASE WHEN doc_id % 5 = 0 THEN repeat('0', 64) ELSE sha256(array_slice(encode(coalesce(text, '')), 3, 10)) END AS sha FROM documents
    ), y AS (
      SELECT *, CASE WHEN given = 'CWE-79' THEN 'CWE-908' ELSE given END AS cwe, CASE given WHEN 'CWE-787' THEN 'out_of_bounds' WHEN 'CWE-401' THEN 'resource_leak' END AS family,
             {_id('ev-', 'evidence-id/v1', "'analyzer_diagnostic'", 'path', "'2'", "'10'", 'sha')} AS diagnostic,
             {_id('ev-', 'evidence-id/v1', "'primary_code'", 'path', "'0'", "'90'", "repeat('e', 64)")} AS code FROM x
    )
    SELECT doc_id AS candidate_id, {_id('finding-', 'finding-id/v2', 'cwe', 'path', _SYMBOL, "'it is so'", "'2'", "'10'")} AS finding_id, {_id('fp-', 'dedup-fingerprint/v1', 'cwe', 'path', _SYMBOL, "'it is so'")} AS fingerprint,
           CASE WHEN k = 1 THEN 'fn' || doc_id END AS symbol, diagnostic || CASE WHEN k = 1 THEN ' ' || code ELSE '' END || ' ev-step2 ev-step1' AS evidence,
           CASE WHEN family IS NULL AND NOT stale THEN cwe || ' is not among the families that are judged' ELSE 'the rule behind the diagnostic stands for ' || cwe END AS cwe_rationale, {_REMEDY} AS remediation,
           'no_evidence_expansion' || CASE WHEN k > 1 THEN ' unresolved_symbol' ELSE '' END AS limitations, CASE WHEN stale OR family IS NULL THEN 'review_required' ELSE 'medium' END AS confidence
    FROM y
    """,
)
def whole_findings(s: SparkSession, d: str) -> DataFrame:
    """A finding of each document as a candidate: ids, proven symbols, evidence in order, texts and limitations."""
    own = F.coalesce("text", F.lit("")).cast("binary")
    docs = t(s, d, "documents").select(F.col("doc_id").alias("candidate_id"), name("f", "doc_id").alias("path"), own.alias("content"))
    c = F.col("candidate_id")
    sha = F.when(c % 5 == 0, F.lit("0" * 64)).otherwise(F.sha2(F.substring("content", 3, 8), 256))
    region = F.struct(F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.lit(0).cast("long").alias("start_byte"), F.lit(90).cast("long").alias("end_byte"), F.lit("e" * 64).alias("sha256"))
    step = lambda n: F.struct(F.lit(f"ev-step{n}"), F.lit("flow_step"), F.col("path"), F.lit(n), F.lit(n), F.lit(0), F.lit(1), F.lit("s"), F.lit(None).cast("string")).cast(gate.ITEM)
    long = lambda n: F.lit(n).cast("long")
    candidates = docs.select(
        "candidate_id", "path", F.lit(3).alias("start_line"), F.lit(4).alias("end_line"), long(2).alias("start_byte"), long(10).alias("end_byte"), sha.alias("sha256"), F.array(pick(c, "CWE-787", "CWE-79", "CWE-401")).alias("cwes"), F.lit("it is so").alias("message"),
        F.when(c % 4 != 0, name("fn", "candidate_id")).alias("symbol"), F.when(c % 4 == 1, region).alias("enclosing"), F.array(step(2), step(1), step(2)).alias("steps"),
    )
    ids_of = lambda a, f: F.array_join(F.transform(a, lambda e: e[f]), " ")
    found = gate.findings(candidates, docs.select("path", "content"))
    return found.select("candidate_id", "finding_id", "fingerprint", "symbol", ids_of("evidence", "evidence_id").alias("evidence"), "cwe_rationale", "remediation", ids_of("limitations", "kind").alias("limitations"), "confidence")


@query(
    "merged_lists",
    """
    WITH r AS (SELECT l_suppkey AS s, l_orderkey AS o, l_linenumber AS n, l_returnflag || l_linestatus AS cwe, l_shipdate::DATE::VARCHAR AS tool FROM lineitem),
    head AS (SELECT s, min(o * 10 + n) AS first FROM r GROUP BY s),
    c AS (SELECT s, cwe, min(o * 10 + n) AS seen FROM r GROUP BY ALL), p AS (SELECT s, tool, min(o * 10 + n) AS seen FROM r GROUP BY ALL)
    SELECT s::VARCHAR AS fingerprint, first::VARCHAR AS candidate_id, (SELECT string_agg(cwe, ',' ORDER BY seen, cwe) FROM c WHERE c.s = head.s) AS cwes, (SELECT string_agg(tool, ',' ORDER BY seen, tool) FROM p WHERE p.s = head.s) AS provenance FROM head
    """,
)
def merged_lists(s: SparkSession, d: str) -> DataFrame:
    """Lines of orders merged by supplier, all at one place: every flag and date of the members, in first-seen order."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = t(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("fingerprint"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("symbol"), key.alias("candidate_id"), F.array(F.concat("l_returnflag", "l_linestatus")).alias("cwes"), F.array(F.col("l_shipdate").cast("date").cast("string")).alias("provenance"))
    found = dedup.merged_lists(rows)
    return found.select("fingerprint", F.col("candidate_id").cast("string").alias("candidate_id"), F.array_join("cwes", ",").alias("cwes"), F.array_join("provenance", ",").alias("provenance"))


CONFIGS = [("baseline", 3, "low", None, True, None), ("wide", 6, "low", None, True, None), ("severe", 3, "high", None, True, None), ("any_weakness", 3, None, None, False, None), ("one_family", 3, None, ["integer"], True, None), ("first_only", 3, None, None, True, 1), ("nothing", 0, "critical", ["injection"], True, None)]


@query(
    "grid_scores",
    f"""
    WITH c(name, tolerance, least, family, check_cwe, most) AS (VALUES {', '.join(f"('{n}', {k}, {dict(critical=1, high=2, low=4).get(least or 'low')}, {chr(39) + f[0] + chr(39) if f else 'NULL'}, {w}, {m or 'NULL'})" for n, k, least, f, w, m in CONFIGS)}),
    x AS (SELECT doc_id, lang, {by('doc_id', 'CWE-787', 'CWE-190', 'CWE-401')} AS cwe, {by('doc_id', 'out_of_bounds', 'integer', 'resource_leak')} AS family, doc_id % 7 AS off, {by('doc_id', '2', '3', '4')}::INT AS severity FROM documents),
    f AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'CWE-476' ELSE cwe END AS found, CASE WHEN doc_id % 5 = 0 THEN 'null_uninitialized' ELSE family END AS found_family FROM x WHERE doc_id % 4 <> 0),
    k AS (SELECT c.name, c.most, f.*, c.tolerance >= off AND (NOT check_cwe OR found = cwe) AS hit, row_number() OVER (PARTITION BY c.name, lang ORDER BY severity, doc_id) AS place FROM f JOIN c ON severity <= least AND (c.family IS NULL OR c.family = found_family)),
    kept AS (SELECT * FROM k WHERE most IS NULL OR place <= most),
    o AS (
      SELECT name, found_family AS family, 0 AS tp, 1 AS fp, 0 AS fn FROM kept WHERE NOT hit
      UNION ALL SELECT c.name, x.family, (k.doc_id IS NOT NULL)::INT, 0, (k.doc_id IS NULL)::INT FROM c CROSS JOIN x LEFT JOIN (SELECT * FROM kept WHERE hit) k ON k.name = c.name AND k.doc_id = x.doc_id
    ), s AS (SELECT name, family, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM o GROUP BY ALL),
    r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fn) END AS q FROM s),
    m AS (SELECT name, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(avg(CASE WHEN p = 0 AND q = 0 THEN 0.0 ELSE 5 * p * q / (4 * p + q) END), 9) AS macro_f2 FROM r GROUP BY name)
    SELECT name, tp, fp, fn, macro_f2, round(macro_f2 - (SELECT macro_f2 FROM m WHERE name = 'baseline'), 9) AS delta FROM m
    """,
)
def grid_scores(s: SparkSession, d: str) -> DataFrame:
    """Documents as findings of seven configurations at once: severities, families, tolerances, budgets."""
    c = F.col("doc_id")
    cwe, family = pick(c, "CWE-787", "CWE-190", "CWE-401"), pick(c, "out_of_bounds", "integer", "resource_leak")
    docs = t(s, d, "documents").select("doc_id", F.col("lang").alias("case_id"), F.lit("p").alias("path"), cwe.alias("cwe"), family.alias("family"), pick(c, "high", "medium", "low").alias("severity"))
    truths = docs.select("case_id", "path", F.col("doc_id").alias("truth"), (c * 100).cast("int").alias("line"), "cwe", "family", F.lit("vulnerable").alias("variant"))
    line = (c * 100 + c % 7).cast("int")
    other = c % 5 == 0
    findings = docs.where(c % 4 != 0).select("case_id", "path", F.lpad(c.cast("string"), 12, "0").alias("finding_id"), line.alias("start_line"), line.alias("end_line"), F.when(other, "CWE-476").otherwise(F.col("cwe")).alias("cwe"), F.when(other, "null_uninitialized").otherwise(F.col("family")).alias("family"), "severity")
    found = grid.run_grid(findings, truths, s.createDataFrame(CONFIGS, grid.CONFIG), "baseline")
    return found.summary.join(found.deltas, "name").select("name", "tp", "fp", "fn", "macro_f2", F.round("delta", 9).alias("delta"))
