"""Queries of the operators over tables: lookups, resolution, the gate, walks, retrieval, metrics, experiments and records."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, dedup, experiments, gate, graph, intake, intervals, lookups, matching, metrics, quality, resolution, retrieval
from ..sinks import reports
from ..sources import cfacts, diagnostics, profiles, records
from . import adjudication, scan
from .function_queries import by, pick
from .registry import _SITES, _sites, _windows, query, t

NONE = "array<string>"
#: Sources that one task reads facts of, and counts them.
UNITS_PER_TASK = 20_000


def name(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# --- lookups -----------------------------------------------------------------


@query("expansions_in_regions", f"WITH {_SITES} SELECT usr, count(*) AS sites FROM p JOIN w ON p.path = w.path AND line BETWEEN start_line AND end_line GROUP BY usr")
def expansions_in_regions(s: SparkSession, d: str) -> DataFrame:
    found = intervals.points_in_intervals(_sites(s, d), _windows(s, d), ["path"], "line", "start_line", "end_line")
    return found.groupBy("usr").agg(F.count(F.lit(1)).alias("sites"))


@query("points_outside", f"WITH {_SITES} SELECT path, site, line FROM p WHERE NOT EXISTS (SELECT 1 FROM w WHERE p.path = w.path AND line BETWEEN start_line AND end_line)")
def points_outside(s: SparkSession, d: str) -> DataFrame:
    return intervals.points_in_intervals(_sites(s, d), _windows(s, d), ["path"], "line", "start_line", "end_line", how="left_anti")


@query("symbols_in_files", "SELECT l_suppkey AS path, l_partkey AS usr, min(l_linenumber)::INT AS start_line FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1, 2")
def symbols_in_files(s: SparkSession, d: str) -> DataFrame:
    symbols = t(s, d, "lineitem").select(F.col("l_partkey").alias("usr"), F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("start_line"))
    return lookups.symbols_in_files(symbols, t(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("path")))


@query(
    "symbols_named",
    """WITH n AS (SELECT p_type AS name FROM part WHERE p_size > 40 UNION SELECT p_brand FROM part WHERE p_size < 5) SELECT p_partkey AS usr, p_brand AS name FROM part WHERE p_brand IN (SELECT name FROM n) UNION SELECT p_partkey, p_type FROM part WHERE p_type IN (SELECT name FROM n)""",
)
def symbols_named(s: SparkSession, d: str) -> DataFrame:
    p = t(s, d, "part")
    names = p.where("p_size > 40").select(F.col("p_type").alias("name")).union(p.where("p_size < 5").select("p_brand"))
    return lookups.symbols_named(p.select(F.col("p_partkey").alias("usr"), F.col("p_brand").alias("name"), F.col("p_type").alias("qualified_name")), names)


@query("referenced_symbols", "SELECT DISTINCT l_orderkey AS source, p_partkey AS usr, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size <= 25 AND o_orderstatus = 'P'")
def referenced_symbols(s: SparkSession, d: str) -> DataFrame:
    references = t(s, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    symbols = t(s, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("usr"), "p_brand")
    return lookups.referenced_symbols(references, symbols, t(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("source")))


@query(
    "has_edges",
    """WITH a AS (SELECT DISTINCT l_partkey AS caller, l_suppkey + l_linenumber % 2 AS callee FROM lineitem), e AS (SELECT DISTINCT l_partkey AS caller, l_suppkey AS callee FROM lineitem WHERE l_linestatus = 'F')
    SELECT a.caller, a.callee, e.caller IS NOT NULL AS has_edge FROM a LEFT JOIN e ON a.caller = e.caller AND a.callee = e.callee""",
)
def has_edges(s: SparkSession, d: str) -> DataFrame:
    l = t(s, d, "lineitem")  # noqa: E741
    asked = l.select(F.col("l_partkey").alias("caller"), (F.col("l_suppkey") + F.col("l_linenumber") % 2).alias("callee")).distinct()
    return lookups.has_edges(asked, l.select(F.col("l_partkey").alias("caller"), F.when(F.col("l_linestatus") == "F", F.col("l_suppkey")).alias("callee")))


@query("expansions_named", "SELECT event_id, event_type AS name FROM events WHERE event_type IN (SELECT CASE WHEN quality = 1 THEN 'view' ELSE 'click' END FROM labels)")
def expansions_named(s: SparkSession, d: str) -> DataFrame:
    names = t(s, d, "labels").select(F.when(F.col("quality") == 1, "view").otherwise("click").alias("name"))
    return lookups.expansions_named(t(s, d, "events").select("event_id", F.col("event_type").alias("name")), names)


def _includes(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("included"), name("h", "l_suppkey").alias("spelling"))


@query("includes_of", "SELECT DISTINCT l_orderkey AS path, l_partkey AS included FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' AND o_orderstatus = 'O'")
def includes_of(s: SparkSession, d: str) -> DataFrame:
    return lookups.includes_of(_includes(s, d), t(s, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("path")))


@query("included_by", "SELECT DISTINCT l_partkey AS included, l_orderkey AS path FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' AND p_size > 30")
def included_by(s: SparkSession, d: str) -> DataFrame:
    return lookups.included_by(_includes(s, d), t(s, d, "part").where("p_size > 30").select(F.col("p_partkey").alias("included")))


@query("external_includes", "SELECT 'h' || l_suppkey AS spelling, count(DISTINCT l_orderkey) AS files FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def external_includes(s: SparkSession, d: str) -> DataFrame:
    return lookups.external_includes(_includes(s, d))


@query("parse_status_counts", "SELECT event_type AS status, count(*) AS units FROM events GROUP BY 1")
def parse_status_counts(s: SparkSession, d: str) -> DataFrame:
    return lookups.status_counts(t(s, d, "events").withColumnRenamed("event_type", "status"))


@query("skipped_by_weakness", "SELECT l_suppkey AS cwe, count(*) AS skipped FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def skipped_by_weakness(s: SparkSession, d: str) -> DataFrame:
    return lookups.skipped_by_weakness(t(s, d, "lineitem").select(F.col("l_suppkey").alias("cwe")), t(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("cwe")))


@query("lines_of_code", "SELECT count(*) AS files, coalesce(sum(n_chars), 0)::BIGINT AS lines FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def lines_of_code(s: SparkSession, d: str) -> DataFrame:
    return lookups.lines_of_code(t(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("path")), t(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("line_count")))


@query("partial_runs", "SELECT user_id AS run_id, bool_or(event_type = 'error') AS partial FROM events GROUP BY 1")
def partial_runs(s: SparkSession, d: str) -> DataFrame:
    return lookups.partial(t(s, d, "events").select(F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status")))


@query(
    "rules_by_alias",
    """WITH x AS (SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN 'clang-analyzer-core.' || p_type WHEN 1 THEN 'core.' || p_type WHEN 2 THEN '-Wunused' WHEN 3 THEN 'clang-diagnostic-unused' ELSE 'bugprone-' || p_type END AS rule_id FROM part)
    SELECT rule_id, CASE WHEN rule_id LIKE '%core.%' THEN 'core.*' WHEN rule_id LIKE '%unused' THEN 'clang-diagnostic-unused' WHEN rule_id = 'bugprone-ECONOMY' THEN 'bugprone-ECONOMY' ELSE 'bugprone-*' END AS check_id FROM x""",
)
def rules_by_alias(s: SparkSession, d: str) -> DataFrame:
    size, kind = F.col("p_size"), F.col("p_type")
    rule = F.when(size % 5 == 0, F.concat(F.lit("clang-analyzer-core."), kind)).when(size % 5 == 1, F.concat(F.lit("core."), kind)).when(size % 5 == 2, "-Wunused").when(size % 5 == 3, "clang-diagnostic-unused").otherwise(F.concat(F.lit("bugprone-"), kind))
    known = s.createDataFrame([("core.*",), ("clang-diagnostic-unused",), ("bugprone-*",), ("bugprone-ECONOMY",)], "check_id string")
    return intake.rules_lookup(t(s, d, "part").select(rule.alias("rule_id")).distinct(), known)


# --- resolution --------------------------------------------------------------


@query(
    "issued_regions",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'R' AND p_size <= 30 THEN p_brand ELSE l_linestatus END AS path, CASE WHEN l_returnflag <> 'R' AND p_size <= 30 THEN p_size ELSE 1 END::INT AS start_line,
    CASE WHEN l_returnflag <> 'R' THEN p_size <= 30 END AS known FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def issued_regions(s: SparkSession, d: str) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    cited = t(s, d, "lineitem").join(t(s, d, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("evidence_id"), F.col("l_linestatus").alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
        null("long").alias("start_byte"), null("long").alias("end_byte"), null("string").alias("sha256"),
    )
    issued = t(s, d, "part").where("p_size <= 30").select(F.col("p_partkey").alias("evidence_id"), F.col("p_brand").alias("path"), F.col("p_size").alias("start_line"), F.col("p_size").alias("end_line"), null("long").alias("start_byte"), null("long").alias("end_byte"), F.lit("x").alias("sha256"))
    known = F.when(F.col("evidence_id").isNotNull(), F.coalesce("issued", F.lit(False)))
    return resolution.with_issued(cited, issued).select("l_orderkey", "l_linenumber", "l_partkey", "path", "start_line", known.alias("known"))


@query(
    "cited_symbols",
    """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS citation_id, l_orderkey, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'u' || l_partkey WHEN l_partkey % 3 = 1 THEN p_name ELSE 'no such' END AS symbol, l_suppkey % 50 AS line FROM lineitem JOIN part ON l_partkey = p_partkey),
    r AS (SELECT 'u' || p_partkey AS symbol, p_size FROM part UNION ALL SELECT p_name, p_size FROM part),
    h AS (SELECT DISTINCT symbol, p_size FROM r)
    SELECT citation_id, l_partkey, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.symbol = c.symbol AND h.p_size BETWEEN c.line AND c.line + 10) THEN 'ok' ELSE 'symbol_not_found' END AS status FROM c""",
)
def cited_symbols(s: SparkSession, d: str) -> DataFrame:
    p = t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    key = F.col("l_partkey")
    symbol = F.when(key % 3 == 0, name("u", "l_partkey")).when(key % 3 == 1, F.col("p_name")).otherwise("no such")
    line = (F.col("l_suppkey") % 50).cast("int")
    cited = t(s, d, "lineitem").join(p, "l_partkey").select(F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("c"), key.alias("p"), F.col("l_suppkey")).alias("citation_id"), F.lit("ok").alias("status"), symbol.alias("symbol"), F.lit("f").alias("path"), line.alias("start_line"), (line + 10).alias("end_line"))
    symbols = p.select("p_name", name("u", "l_partkey").alias("usr"), F.lit("f").alias("path"), F.col("p_size").alias("start_line"), F.col("p_size").alias("end_line")).withColumnRenamed("p_name", "name")
    return resolution.check_symbols(cited, symbols).select(F.col("citation_id.c").alias("citation_id"), F.col("citation_id.p").alias("l_partkey"), "status")


@query(
    "cited_edges",
    """WITH c AS (SELECT o_orderkey AS citation_id, 'p' || (o_orderkey % 400) AS caller, 's' || (o_custkey % 150) AS callee FROM orders), e AS (SELECT DISTINCT 'p' || l_partkey AS caller, 's' || l_suppkey AS callee FROM lineitem),
    n AS (SELECT 'p' || p_partkey AS name FROM part UNION SELECT 's' || s_suppkey FROM supplier)
    SELECT citation_id, CASE WHEN e.caller IS NOT NULL THEN 'ok' ELSE 'symbol_not_found' END AS status, CASE WHEN e.caller IS NOT NULL THEN NULL WHEN c.caller NOT IN (SELECT name FROM n) OR c.callee NOT IN (SELECT name FROM n) THEN 'unknown_name' ELSE 'missing_edge' END AS why
    FROM c LEFT JOIN e ON c.caller = e.caller AND c.callee = e.callee""",
)
def cited_edges(s: SparkSession, d: str) -> DataFrame:
    claims = t(s, d, "orders").select(F.col("o_orderkey").alias("citation_id"), F.concat(F.lit("p"), (F.col("o_orderkey") % 400).cast("string")).alias("caller"), F.concat(F.lit("s"), (F.col("o_custkey") % 150).cast("string")).alias("callee"))
    symbols = t(s, d, "part").select(name("p", "p_partkey").alias("name"), name("c:", "p_partkey").alias("usr")).union(t(s, d, "supplier").select(name("s", "s_suppkey"), name("c:s", "s_suppkey")))
    edges = t(s, d, "lineitem").select(name("c:", "l_partkey").alias("caller"), name("c:s", "l_suppkey").alias("callee"))
    return resolution.check_edges(claims, symbols, edges).select("citation_id", "status", "why")


@query(
    "citation_failures",
    f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {by('l_suppkey', 'ok', 'missing_file', 'symbol_not_found', 'hash_mismatch', 'unknown_evidence_id', 'line_out_of_range', 'ok')} AS status, l_tax > 0.04 AS edge FROM lineitem)
    SELECT l_orderkey, reason, count(*) AS n FROM (SELECT *, CASE status WHEN 'missing_file' THEN 'missing_file' WHEN 'symbol_not_found' THEN CASE WHEN edge THEN 'call_edge_unresolved' ELSE 'symbol_unresolved' END WHEN 'hash_mismatch' THEN 'hash_mismatch' ELSE 'citation_unresolved' END AS reason FROM c WHERE status <> 'ok') GROUP BY ALL""",
)
def citation_failures(s: SparkSession, d: str) -> DataFrame:
    edge = F.when(F.col("l_tax") > 0.04, "f")
    rows = t(s, d, "lineitem").select(F.col("l_orderkey").alias("citation_id"), pick(F.col("l_suppkey"), "ok", "missing_file", "symbol_not_found", "hash_mismatch", "unknown_evidence_id", "line_out_of_range", "ok").alias("status"), edge.alias("caller"), edge.alias("callee"))
    return resolution.location_failures(rows).groupBy(F.col("citation_id").alias("l_orderkey"), "reason").agg(F.count(F.lit(1)).alias("n"))


@query("first_failures", f"SELECT l_orderkey, arg_min({by('l_suppkey', 'ok', 'missing_file', 'hash_mismatch')}, (l_linenumber, l_partkey, l_suppkey)) AS status FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY 1")
def first_failures(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"), pick(F.col("l_suppkey"), "ok", "missing_file", "hash_mismatch").alias("status"))
    return resolution.first_failures(rows, "l_orderkey", "place")


# --- the gate ----------------------------------------------------------------


def _answers(s: SparkSession, d: str) -> DataFrame:
    """Orders as answers that cite their parts."""
    cited = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("candidate_id")).agg(F.collect_list("l_partkey").alias("cited"))
    return t(s, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.when(F.col("o_orderstatus") == "O", "confirmed").otherwise("rejected").alias("verdict"), pick(F.col("o_custkey"), "CWE-416", "CWE-119", "CWE-79").alias("cwe"), F.lit(" ").alias("cwe_rationale")).join(cited, "candidate_id")


@query("unissued_ids", "SELECT DISTINCT l_orderkey AS candidate_id, l_partkey AS subject, 'citation_unresolved' AS reason FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_partkey = l.l_partkey AND m.l_tax < 0.05)")
def unissued_ids(s: SparkSession, d: str) -> DataFrame:
    issued = t(s, d, "lineitem").where("l_tax < 0.05").select(F.col("l_orderkey").alias("candidate_id"), F.col("l_partkey").alias("evidence_id"))
    return gate.unissued(_answers(s, d), issued)


@query(
    "quotation_failures",
    """SELECT doc_id AS candidate_id, 'e' || q AS subject, 'hash_mismatch' AS reason FROM documents, (VALUES (0), (1), (2)) v(q)
    WHERE NOT coalesce(CASE q WHEN 0 THEN contains(coalesce(text, ''), 'the ') WHEN 1 THEN contains(coalesce(text, ''), lang) ELSE false END, false)""",
)
def quotation_failures(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents")
    quote = lambda i, words: F.struct(F.lit(i).alias("evidence_id"), words.alias("text"))
    said = F.array(quote("e0", F.lit("the ")), quote("e1", F.col("lang")), quote("e2", F.lit("x")))
    captured = docs.select(F.col("doc_id").alias("candidate_id"), F.explode(F.array(F.lit("e0"), F.lit("e1"))).alias("evidence_id"), F.coalesce("text", F.lit("")).cast("binary").alias("captured"))
    return gate.quotations(docs.select(F.col("doc_id").alias("candidate_id"), said.alias("quotations")), captured)


@query("unstated_assumptions", "SELECT o_orderkey AS candidate_id, 'unresolved_assumptions' AS subject, 'assumptions_unstated' AS reason FROM orders WHERE o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_tax > 0.06) > 0 OR count(*) FILTER (l_discount > 0.08) > 0)")
def unstated_assumptions(s: SparkSession, d: str) -> DataFrame:
    contexts = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("candidate_id")).agg(F.count_if(F.col("l_tax") > 0.06).alias("dropped"), F.count_if(F.col("l_discount") > 0.08).alias("limitations"))
    answers = t(s, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.when(F.col("o_orderstatus") == "O", F.array().cast(NONE)).otherwise(F.array(F.lit("a"))).alias("assumptions"))
    return gate.assumptions(answers, contexts)


@query("uncredited_tools", "SELECT l_orderkey AS candidate_id, 's' || l_suppkey AS subject, 'schema_violation' AS reason FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def uncredited_tools(s: SparkSession, d: str) -> DataFrame:
    return gate.provenance(t(s, d, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), name("s", "l_suppkey").alias("tool")), t(s, d, "supplier").where("s_acctbal > 0").select(name("s", "s_suppkey").alias("tool")))


@query(
    "weakness_failures",
    f"""WITH a AS (SELECT o_orderkey AS candidate_id, {by('o_custkey', 'CWE-416', 'CWE-119', 'CWE-79')} AS subject, o_orderkey % 3 AS k FROM orders WHERE o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem))
    SELECT candidate_id, subject, CASE subject WHEN 'CWE-119' THEN 'cwe_mapping_rejected' WHEN 'CWE-79' THEN 'out_of_scope_family' ELSE 'evidence_does_not_support_cwe' END AS reason FROM a WHERE subject <> 'CWE-416' OR k = 1""",
)
def weakness_failures(s: SparkSession, d: str) -> DataFrame:
    cited = t(s, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), pick(F.col("o_orderkey"), "free(p);", "return p;", None).alias("text"))
    return gate.weaknesses(_answers(s, d), cited)


@query(
    "evidence_signals",
    """WITH u AS (SELECT l_orderkey AS candidate_id, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'analyzer_diagnostic' WHEN l_returnflag = 'A' THEN 'control_flow_step' ELSE 'primary_code' END AS kind, CASE WHEN l_linestatus = 'F' THEN 'caller' ELSE 'type_decl' END AS role FROM lineitem),
    v AS (SELECT l_orderkey AS candidate_id, count(*) FILTER (l_tax > 0.07) AS verified FROM lineitem GROUP BY 1)
    SELECT candidate_id, bool_or(verified > 0 OR kind = 'control_flow_step') AS control_flow, bool_or(kind <> 'analyzer_diagnostic') AS code, bool_or(verified > 0 OR role = 'caller') AS upstream FROM u JOIN v USING (candidate_id) GROUP BY 1""",
)
def evidence_signals(s: SparkSession, d: str) -> DataFrame:
    units, edges, answers = _signals(s, d)
    return gate.signals(answers, units, edges)


def _signals(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    l = t(s, d, "lineitem")  # noqa: E741
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    kind = F.when(F.col("l_returnflag") == "R", "analyzer_diagnostic").when(F.col("l_returnflag") == "A", "control_flow_step").otherwise("primary_code")
    units = l.select(F.col("l_orderkey").alias("candidate_id"), key.alias("evidence_id"), kind.alias("kind"), F.when(F.col("l_linestatus") == "F", "caller").otherwise("type_decl").alias("role"))
    edges = l.groupBy(F.col("l_orderkey").alias("candidate_id")).agg(F.count_if(F.col("l_tax") > 0.07).alias("verified"))
    return units, edges, l.groupBy(F.col("l_orderkey").alias("candidate_id")).agg(F.collect_list(key).alias("cited"))


@query(
    "capped_claims",
    """WITH u AS (SELECT l_orderkey AS candidate_id, CASE WHEN l_returnflag = 'R' THEN 'analyzer_diagnostic' WHEN l_returnflag = 'A' THEN 'control_flow_step' ELSE 'primary_code' END AS kind, l_linestatus = 'F' AS up FROM lineitem),
    v AS (SELECT l_orderkey AS candidate_id, count(*) FILTER (l_tax > 0.07) AS verified FROM lineitem GROUP BY 1),
    f AS (SELECT candidate_id, bool_or(verified > 0 OR kind = 'control_flow_step') AS flow, bool_or(kind <> 'analyzer_diagnostic') AS code, bool_or(verified > 0 OR up) AS up FROM u JOIN v USING (candidate_id) GROUP BY 1),
    c AS (SELECT *, CASE WHEN flow THEN 0 WHEN code THEN 1 ELSE 2 END AS r, CASE WHEN up AND flow THEN 0 WHEN up THEN 1 ELSE 2 END AS e FROM f)
    SELECT candidate_id, ['demonstrated', 'argued', 'unknown'][r + 1] AS reachability, ['demonstrated', 'plausible', 'unlikely'][greatest(e, 1) + 1] AS exploitability,
    CASE WHEN r > 0 THEN 'reachability' ELSE '' END || CASE WHEN r > 0 AND e > 1 THEN ',' ELSE '' END || CASE WHEN e > 1 THEN 'exploitability' ELSE '' END AS lowered FROM c""",
)
def capped_claims(s: SparkSession, d: str) -> DataFrame:
    units, edges, answers = _signals(s, d)
    claimed = answers.select("candidate_id", F.lit("demonstrated").alias("reachability"), F.lit("plausible").alias("exploitability"))
    return gate.capped_claims(claimed, gate.signals(answers, units, edges)).withColumn("lowered", F.array_join("lowered", ","))


@query(
    "promoted_candidates",
    f"""WITH x AS (SELECT doc_id AS candidate_id, {by('doc_id', 'CWE-787', 'CWE-79', 'CWE-401')} AS cwe, doc_id % 5 = 0 OR octet_length(encode(coalesce(text, ''))) < 10 AS stale FROM documents)
    SELECT candidate_id, CASE WHEN cwe = 'CWE-79' THEN 'CWE-908' ELSE cwe END AS cwe, CASE cwe WHEN 'CWE-787' THEN 'out_of_bounds' WHEN 'CWE-401' THEN 'resource_leak' END AS family, CASE cwe WHEN 'CWE-787' THEN 'memory_corruption' WHEN 'CWE-401' THEN 'resource_exhaustion' ELSE 'undefined_behavior' END AS impact,
    CASE cwe WHEN 'CWE-787' THEN 'high' WHEN 'CWE-401' THEN 'medium' ELSE 'low' END AS severity, CASE WHEN stale OR cwe = 'CWE-79' THEN 'review_required' ELSE 'medium' END AS confidence,
    CASE WHEN stale THEN 'hash_mismatch' WHEN cwe = 'CWE-79' THEN 'out_of_scope_family' ELSE 'analyzer_only' END AS reason FROM x""",
)
def promoted_candidates(s: SparkSession, d: str) -> DataFrame:
    own = F.coalesce("text", F.lit("")).cast("binary")
    docs = t(s, d, "documents").select(F.col("doc_id").alias("candidate_id"), name("f", "doc_id").alias("path"), own.alias("content"))
    sha = F.when(F.col("candidate_id") % 5 == 0, F.lit("0" * 64)).otherwise(F.upper(F.sha2(F.substring("content", 3, 8), 256)))
    found = docs.select("candidate_id", "path", F.lit(2).cast("long").alias("start_byte"), F.lit(10).cast("long").alias("end_byte"), sha.alias("sha256"), F.array(pick(F.col("candidate_id"), "CWE-787", "CWE-79", "CWE-401")).alias("cwes"), F.lit("it is so").alias("message"))
    return gate.promote(found, docs.select("path", "content")).drop("reachability", "exploitability")


@query(
    "report_sections",
    f"""WITH f AS (SELECT l_orderkey AS finding_id, arg_min({by('l_suppkey', 'ok', 'missing_file', 'symbol_not_found')}, (l_linenumber, l_partkey, l_suppkey)) AS status FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY 1),
    x AS (SELECT o_orderkey AS finding_id, CASE o_orderstatus WHEN 'O' THEN 'high' WHEN 'F' THEN 'medium' ELSE 'review_required' END AS confidence, status FROM orders LEFT JOIN f ON o_orderkey = finding_id)
    SELECT finding_id, CASE WHEN status IS NULL THEN confidence ELSE 'review_required' END AS confidence, CASE status WHEN 'missing_file' THEN 'missing_file' WHEN 'symbol_not_found' THEN 'symbol_unresolved' ELSE 'given' END AS reason,
    CASE WHEN status IS NOT NULL OR confidence = 'review_required' THEN 'needs_review' ELSE 'confirmed' END AS section FROM x""",
)
def report_sections(s: SparkSession, d: str) -> DataFrame:
    findings = t(s, d, "orders").select(F.col("o_orderkey").alias("finding_id"), F.when(F.col("o_orderstatus") == "O", "high").when(F.col("o_orderstatus") == "F", "medium").otherwise("review_required").alias("confidence"), F.lit("given").alias("reason"))
    resolved = t(s, d, "lineitem").select(F.col("l_orderkey").alias("finding_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"), pick(F.col("l_suppkey"), "ok", "missing_file", "symbol_not_found").alias("status"))
    return gate.sections(findings, resolved)


@query("refusals", "SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'provider_unavailable' ELSE 'analyzer_only' END AS reason, CASE event_id % 2 WHEN 0 THEN 'review_required' ELSE 'medium' END AS confidence, CASE WHEN event_type = 'view' THEN 'dismiss' ELSE 'adjudicate' END AS disposition, event_type = 'click' AS ambiguous FROM events")
def refusals(s: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("event_type") == "view", "rejected").when(F.col("event_type") == "click", "review_required").otherwise("confirmed")
    rows = t(s, d, "events").select("event_id", gate.triage_of(verdict).alias("triage"))
    return gate.refused(rows, pick(F.col("event_id"), "provider_unavailable", "analyzer_only")).select("event_id", "reason", "confidence", "triage.disposition", "triage.ambiguous")


@query("recorded_answers", "SELECT doc_id AS key, CASE WHEN quality IS NULL THEN 'not_recorded' ELSE 'answered' END AS status, quality FROM documents LEFT JOIN labels USING (doc_id)")
def recorded_answers(s: SparkSession, d: str) -> DataFrame:
    return gate.recorded_answers(t(s, d, "documents").select(F.col("doc_id").alias("key")), t(s, d, "labels").select(F.col("doc_id").alias("key"), "quality")).select("key", "status", "quality")


# --- asking models -----------------------------------------------------------


def _provider(tier: str, prompt: str, correction: str | None) -> adjudication.Reply:
    """Answers by the number that a prompt is: what the statement below says."""
    n = int(prompt)
    say = lambda verdict, *cited: adjudication.Reply(json.dumps({"verdict": verdict, "rationale": "r", "cwe": "CWE-416", "cited": list(cited)}), None, 3, 2)
    if tier == "triage":
        return say("rejected" if n % 5 == 0 else "confirmed")
    if tier == "escalation":
        return say("confirmed", "e1") if n % 3 == 0 else adjudication.Reply(failure="refused")
    if n % 7 == 0:
        return adjudication.Reply(failure="transport: down")
    if n % 7 == 1:
        return say("confirmed", "other")
    if n % 7 == 2 and correction is None:
        return adjudication.Reply("not JSON", None, 3, 1)
    return say("review_required" if n % 2 else "confirmed", "e1")


_ADJUDICATED = """WITH x AS (SELECT o_orderkey AS n, o_custkey % 11 = 0 AS starved, o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS severe FROM orders),
y AS (SELECT *, CASE WHEN starved THEN 'starved' WHEN n % 5 = 0 THEN 'triage' WHEN n % 7 = 0 THEN 'down' WHEN n % 7 = 1 THEN 'unknown' WHEN n % 2 = 1 AND severe THEN CASE WHEN n % 3 = 0 THEN 'higher' ELSE 'kept' END WHEN n % 2 = 1 THEN 'open' ELSE 'plain' END AS way FROM x)"""


@query(
    "adjudication",
    f"""{_ADJUDICATED} SELECT n::VARCHAR AS candidate_id, CASE way WHEN 'triage' THEN 'triage' WHEN 'higher' THEN 'escalation' ELSE 'adjudication' END AS tier, way NOT IN ('starved', 'down', 'unknown') AS answered,
    CASE way WHEN 'starved' THEN 'run_budget_exhausted' WHEN 'down' THEN 'provider_unavailable' WHEN 'unknown' THEN 'citation_unresolved' END AS reason,
    CASE way WHEN 'triage' THEN 'rejected' WHEN 'higher' THEN 'confirmed' WHEN 'kept' THEN 'review_required' WHEN 'open' THEN 'review_required' WHEN 'plain' THEN 'confirmed' END AS verdict,
    CASE way WHEN 'starved' THEN 0 WHEN 'triage' THEN 1 WHEN 'down' THEN 4 WHEN 'unknown' THEN 2 WHEN 'higher' THEN 3 WHEN 'kept' THEN 3 ELSE 2 END + CASE WHEN way IN ('higher', 'kept', 'open', 'plain') AND n % 7 = 2 THEN 1 ELSE 0 END::BIGINT AS calls FROM y""",
)
def adjudicated(s: SparkSession, d: str) -> DataFrame:
    severe = F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2")
    key = F.col("o_orderkey").cast("string")
    asked = t(s, d, "orders").select(key.alias("candidate_id"), key.alias("prompt"), F.array(F.lit("e1")).alias("issued"), F.when(severe, "high").otherwise("low").alias("severity"), F.lit(True).alias("triage"), (F.col("o_custkey") % 11 == 0).alias("starved"))
    return adjudication.adjudicate(asked, _provider, consent=True).select("candidate_id", "tier", "answered", "reason", "verdict", "calls")


@query(
    "adjudicated_cases",
    """SELECT l.doc_id AS case_id, CASE WHEN d.n_chars > 500 THEN 'adjudicated' ELSE 'unindexable' END AS status, CASE WHEN d.n_chars > 500 THEN 1 END::BIGINT AS findings, CASE WHEN d.n_chars > 500 THEN l.quality END::BIGINT AS confirmed FROM labels l JOIN documents d USING (doc_id)""",
)
def adjudicated_cases(s: SparkSession, d: str) -> DataFrame:
    labels = t(s, d, "labels").select(F.col("doc_id").alias("case_id"), F.lit(True).alias("answered"), F.when(F.col("quality") == 1, "confirmed").otherwise("rejected").alias("verdict"))
    return adjudication.adjudicated_cases(labels, labels, t(s, d, "documents").where("n_chars > 500").select(F.col("doc_id").alias("case_id")))


@query(
    "control_prompts",
    """SELECT doc_id AS candidate_id, sha256('m' || chr(10) || source || doc_id || ':1-' || least(len(string_split(coalesce(text, ''), chr(10))), 3) || chr(10) || '```' || chr(10) || array_to_string(string_split(coalesce(text, ''), chr(10))[1:3], chr(10)) || chr(10) || '```') AS digest FROM documents WHERE NOT contains(coalesce(text, ''), '`')
    UNION ALL SELECT doc_id, 'quotes' FROM documents WHERE contains(coalesce(text, ''), '`')""",
)
def control_prompts(s: SparkSession, d: str) -> DataFrame:
    path = F.concat("source", F.col("doc_id").cast("string"))
    docs = t(s, d, "documents").select(F.col("doc_id").alias("candidate_id"), path.alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    made = adjudication.naive_prompts(docs.select("candidate_id", "path", F.lit("m").alias("message"), F.lit(1).alias("line")), docs.select("path", "text"), 2)
    quotes = docs.select("candidate_id", F.contains("text", F.lit("`")).alias("q"))
    return made.join(quotes, "candidate_id").select("candidate_id", F.when(F.col("q"), "quotes").otherwise(F.sha2("prompt", 256)).alias("digest"))


@query(
    "run_ledger",
    """WITH RECURSIVE x AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS k, least(ceil(length(p_name) / 3.0::DOUBLE), 4)::BIGINT AS tokens FROM part),
    f AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS p_partkey, 0::BIGINT AS spent, false AS starved UNION ALL SELECT x.k, x.p_partkey, CASE WHEN spent >= 500 THEN spent ELSE spent + least(tokens, 500 - spent) END, spent >= 500 FROM f JOIN x ON x.k = f.k + 1)
    SELECT p_partkey::VARCHAR AS candidate_id, starved FROM f WHERE k > 0""",
)
def run_ledger(s: SparkSession, d: str) -> DataFrame:
    prompts = t(s, d, "part").select(F.col("p_partkey").cast("string").alias("candidate_id"), F.col("p_partkey").alias("place"), F.col("p_name").alias("prompt"))
    issued = t(s, d, "part").select(F.col("p_partkey").cast("string").alias("candidate_id"), F.col("p_brand").alias("evidence_id"))
    severity = t(s, d, "part").select(F.col("p_partkey").cast("string").alias("candidate_id"), F.lit("high").alias("severity"))
    return adjudication.requests(prompts, issued, severity, 500, 4).select("candidate_id", "starved")


# --- walks and retrieval -----------------------------------------------------

_CALLS = """calls AS (SELECT DISTINCT 'c' || o_custkey AS caller, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'c' || (o_custkey * 7 + o_orderkey) % 500 END AS callee FROM orders)"""


def _calls(s: SparkSession, d: str) -> DataFrame:
    callee = F.concat(F.lit("c"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 500).cast("string"))
    return t(s, d, "orders").select(name("c", "o_custkey").alias("caller"), F.when(F.col("o_orderstatus") != "P", callee).alias("callee")).distinct()


_WALK = f"""WITH RECURSIVE {_CALLS}, r AS (SELECT seed, seed AS node, 0 AS depth FROM (SELECT 'c' || n_nationkey AS seed FROM nation) UNION SELECT seed, callee, depth + 1 FROM r JOIN calls ON caller = node WHERE depth < 2 AND callee IS NOT NULL),
w AS (SELECT seed, node, min(depth) AS depth FROM r GROUP BY ALL)"""


def _seeds(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "nation").select(name("c", "n_nationkey").alias("node"))


@query("unresolved_calls", f"{_WALK} SELECT seed, count(*) AS unresolved FROM w JOIN calls ON caller = node WHERE depth < 2 AND callee IS NULL GROUP BY 1")
def unresolved_calls(s: SparkSession, d: str) -> DataFrame:
    calls = _calls(s, d)
    return graph.unresolved_from(graph.walk(_seeds(s, d), calls, 2), calls, 2)


@query("walked_edges", f"{_WALK} SELECT seed, caller, callee FROM w JOIN calls ON caller = node WHERE depth < 2 AND callee IS NOT NULL")
def walked_edges(s: SparkSession, d: str) -> DataFrame:
    calls = _calls(s, d)
    return graph.walked_edges(graph.walk(_seeds(s, d), calls, 2), calls, 2).select("seed", "caller", "callee")


@query("callers", f"WITH {_CALLS} SELECT seed, seed AS node, 0::INT AS depth, (SELECT count(*) FROM calls WHERE callee IS NULL) AS unresolved FROM (SELECT 'c' || n_nationkey AS seed FROM nation) UNION ALL SELECT DISTINCT callee, caller, 1, (SELECT count(*) FROM calls WHERE callee IS NULL) FROM calls WHERE callee IN (SELECT 'c' || n_nationkey FROM nation) AND caller <> callee")
def callers(s: SparkSession, d: str) -> DataFrame:
    return graph.callers(_seeds(s, d), _calls(s, d), 1)


@query("edge_places", f"WITH {_CALLS} SELECT caller, callee, row_number() OVER (PARTITION BY caller ORDER BY coalesce(callee, ''))::INT AS place FROM calls")
def edge_places(s: SparkSession, d: str) -> DataFrame:
    same = {c: F.lit(1) for c in ("start_line", "start_byte", "end_line", "end_byte")}
    edges = _calls(s, d).withColumns({"path": F.lit("f"), "kind": F.lit("direct"), **same})
    return dedup.top_rank(edges, ["caller"], graph.edge_order()).select("caller", "callee", "place")


@query("candidate_places", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_orderkey, l_partkey, l_orderkey)::INT AS place FROM lineitem")
def candidate_places(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("start_line"), F.col("l_orderkey").alias("start_byte"), F.col("l_partkey").alias("end_line"), F.col("l_orderkey").alias("candidate_id"))
    return dedup.top_rank(rows, ["path"], dedup.candidate_order()).select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query(
    "virtual_calls",
    """WITH m AS (SELECT 'm' || p_partkey AS usr, p_brand AS class, p_type AS suffix FROM part), c AS (SELECT DISTINCT l_orderkey AS caller, 'm' || l_partkey AS callee, CASE WHEN l_returnflag = 'R' THEN 'virtual' ELSE 'direct' END AS kind FROM lineitem),
    d AS (SELECT 'Brand#1' AS base, 'Brand#2' AS class UNION ALL SELECT 'Brand#1', 'Brand#3' UNION ALL SELECT 'Brand#2', 'Brand#3')
    SELECT *, false AS inferred FROM c UNION SELECT DISTINCT c.caller, o.usr, 'virtual', true FROM c JOIN m ON m.usr = c.callee JOIN d ON d.base = m.class JOIN m o ON o.class = d.class AND o.suffix = m.suffix WHERE kind = 'virtual'""",
)
def virtual_calls(s: SparkSession, d: str) -> DataFrame:
    methods = t(s, d, "part").select(name("m", "p_partkey").alias("usr"), F.col("p_brand").alias("class"), F.col("p_type").alias("suffix"))
    calls = t(s, d, "lineitem").select(F.col("l_orderkey").alias("caller"), name("m", "l_partkey").alias("callee"), F.when(F.col("l_returnflag") == "R", "virtual").otherwise("direct").alias("kind")).distinct()
    derived = s.createDataFrame([("Brand#1", "Brand#2"), ("Brand#1", "Brand#3"), ("Brand#2", "Brand#3")], "base string, class string")
    return graph.resolve_virtual(calls, derived, methods)


@query(
    "macro_calls",
    """WITH c AS (SELECT l_suppkey AS path, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n, l_orderkey, l_linenumber, l_partkey, l_orderkey * 10 AS s, l_orderkey * 10 + l_linenumber AS e, l_returnflag FROM lineitem), x AS (SELECT DISTINCT o_custkey % 100 AS path, o_orderkey * 10 - 5 AS s, o_orderkey * 10 + 3 AS e FROM orders)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'R' AND EXISTS (SELECT 1 FROM x WHERE x.path = c.path AND x.s <= c.s AND c.e <= x.e) THEN 'macro' WHEN l_returnflag = 'R' THEN 'virtual' ELSE 'direct' END AS kind FROM c""",
)
def macro_calls(s: SparkSession, d: str) -> DataFrame:
    at = F.col("l_orderkey") * 10
    calls = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("path"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("call_id"), at.alias("start_byte"), (at + F.col("l_linenumber")).alias("end_byte"), F.when(F.col("l_returnflag") == "R", "virtual").otherwise("direct").alias("kind"))
    spans = t(s, d, "orders").select((F.col("o_custkey") % 100).alias("path"), (F.col("o_orderkey") * 10 - 5).alias("start_byte"), (F.col("o_orderkey") * 10 + 3).alias("end_byte"))
    return graph.classify_macro_calls(calls, spans).select("l_orderkey", "l_linenumber", "l_partkey", "kind")


@query(
    "macro_fixpoint",
    """WITH RECURSIVE x AS (SELECT DISTINCT p_partkey AS usr, p_size AS path, (p_partkey % 40) AS line, (p_partkey * 3) % 50 AS body_path, (p_partkey * 5) % 40 AS body_line FROM part),
    f AS (SELECT usr, 0 AS round FROM x WHERE path = 7 AND line BETWEEN 1 AND 20 UNION SELECT x.usr, f.round + 1 FROM f JOIN x b ON b.usr = f.usr JOIN x ON x.path = b.body_path AND x.line BETWEEN b.body_line AND b.body_line + 2 WHERE f.round < 60)
    SELECT usr, min(round)::INT AS round FROM f GROUP BY 1""",
)
def macro_fixpoint(s: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    at = (n * 5 % 40).cast("int")
    x = t(s, d, "part").select(n.alias("usr"), F.col("p_size").cast("long").alias("path"), (n % 40).cast("int").alias("line"), (n * 3 % 50).alias("body_path"), at.alias("body_start"), (at + 2).alias("body_end"))
    return graph.macro_fixpoint(s.createDataFrame([(7, 1, 20)], "path long, start_line int, end_line int"), x)


def _symbols(s: SparkSession, d: str) -> DataFrame:
    return _windows(s, d).withColumn("kind", F.lit("function"))


@query("containing_functions", f"WITH {_SITES}, b AS (SELECT site, arg_min(usr, (end_line - start_line, usr)) AS usr FROM p JOIN w ON p.path = w.path AND line BETWEEN start_line AND end_line GROUP BY site) SELECT DISTINCT p.site AS candidate_id, b.usr, p.path, coalesce(w.start_line, p.line) AS start_line, coalesce(w.end_line, p.line) AS end_line FROM (SELECT DISTINCT * FROM p) p LEFT JOIN b USING (site) LEFT JOIN w USING (usr)")
def containing_functions(s: SparkSession, d: str) -> DataFrame:
    sites = _sites(s, d).distinct().select(F.col("site").alias("candidate_id"), "path", "line", F.lit(None).cast("long").alias("end_line"))
    # an order may hold a line number twice: the regions are the same, the lines may differ
    return retrieval.containing(sites, _symbols(s, d)).distinct()


@query(
    "neighbour_units",
    f"""WITH {_CALLS}, r AS (SELECT DISTINCT 'c' || n_nationkey AS candidate_id, 'caller' AS role, caller AS usr FROM nation JOIN calls ON callee = 'c' || n_nationkey WHERE caller <> callee)
    SELECT candidate_id, role, 1::INT AS depth, usr, c_mktsegment AS path FROM r LEFT JOIN customer ON usr = 'c' || c_custkey""",
)
def neighbour_units(s: SparkSession, d: str) -> DataFrame:
    own = _seeds(s, d).select(F.col("node").alias("candidate_id"), F.col("node").alias("usr"))
    symbols = t(s, d, "customer").select(name("c", "c_custkey").alias("usr"), F.col("c_mktsegment").alias("path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    return retrieval.neighbours(own, _calls(s, d), symbols, 1, "caller").select("candidate_id", "role", "depth", "usr", "path")


@query(
    "type_closure",
    """WITH RECURSIVE e AS (SELECT DISTINCT 't' || p_size AS source, 't' || (p_size * 3 + p_partkey % 5) % 60 AS target FROM part), r AS (SELECT seed, seed AS node, 0 AS depth FROM (SELECT 't' || r_regionkey AS seed FROM region) UNION SELECT seed, target, depth + 1 FROM r JOIN e ON source = node WHERE depth < 2),
    w AS (SELECT seed, node, min(depth) AS depth FROM r GROUP BY ALL) SELECT seed AS candidate_id, 'type_decl' AS role, depth::INT AS depth, node AS usr FROM w WHERE depth > 0 AND node IN (SELECT 't' || p_size FROM part)""",
)
def type_closure(s: SparkSession, d: str) -> DataFrame:
    target = F.concat(F.lit("t"), ((F.col("p_size") * 3 + F.col("p_partkey") % 5) % 60).cast("string"))
    references = t(s, d, "part").select(name("t", "p_size").alias("source"), target.alias("target"))
    own = t(s, d, "region").select(name("t", "r_regionkey").alias("candidate_id"), name("t", "r_regionkey").alias("usr"))
    symbols = t(s, d, "part").select(name("t", "p_size").alias("usr"), F.lit("f").alias("path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line")).distinct()
    return retrieval.types_and_globals(own, references, symbols, "type_decl", 2).select("candidate_id", "role", "depth", "usr")


@query("release_sites", "SELECT DISTINCT o_custkey AS candidate_id, l_linenumber::INT AS start_line FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber BETWEEN 2 AND 5 AND l_returnflag IN ('A', 'R')")
def release_sites(s: SparkSession, d: str) -> DataFrame:
    own = t(s, d, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").alias("usr"), F.lit("f").alias("path"), F.lit(2).alias("start_line"), F.lit(5).alias("end_line"))
    called = F.when(F.col("l_returnflag") == "A", "my_free").when(F.col("l_returnflag") == "R", "close").otherwise("open")
    edges = t(s, d, "lineitem").select(F.col("l_orderkey").alias("caller"), F.lit("x").alias("callee"), called.alias("name"), F.col("l_linenumber").alias("line"))
    return retrieval.release_sites(own, edges, own).select("candidate_id", "start_line").distinct()


@query(
    "label_blocks",
    "SELECT p_partkey AS candidate_id, 4::INT AS start_line, 5::INT AS end_line FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 5, 5 FROM part WHERE p_size % 3 = 0",
)
def label_blocks(s: SparkSession, d: str) -> DataFrame:
    p = t(s, d, "part")
    body = F.concat(F.lit("void f() {\n"), F.when(F.col("p_size") % 2 == 0, " if (x) goto out;\n").otherwise(" y();\n"), F.when(F.col("p_size") % 3 == 0, " goto  end ;\n").otherwise(" z::out();\n"), F.lit("out: free(p);\n end:\n}\nout:\n"))
    own = p.select(F.col("p_partkey").alias("candidate_id"), F.col("p_partkey").alias("usr"), name("f", "p_partkey").alias("path"), F.lit(1).alias("start_line"), F.lit(5).alias("end_line"))
    return retrieval.label_blocks(own, p.select(name("f", "p_partkey").alias("path"), body.alias("text"))).select("candidate_id", F.col("start_line").cast("int").alias("start_line"), "end_line")


@query("flat_windows", "SELECT doc_id AS candidate_id, greatest(1, doc_id - 40) AS start_line, least(n_chars, doc_id + 40) AS end_line FROM documents")
def flat_windows(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents").select(F.col("doc_id").alias("candidate_id"), name("f", "doc_id").alias("path"), F.col("doc_id").alias("line"), F.lit(None).cast("long").alias("end_line"), F.col("n_chars").alias("line_count"))
    return retrieval.flat_window(docs.drop("line_count"), docs.select("path", "line_count")).select("candidate_id", "start_line", "end_line")


@query(
    "flow_functions",
    f"WITH {_SITES}, b AS (SELECT site, path, arg_min(usr, (end_line - start_line, usr)) AS usr FROM p JOIN w USING (path) WHERE line BETWEEN start_line AND end_line GROUP BY site, path) SELECT path AS candidate_id, usr, min(site) AS step FROM b WHERE path <> usr GROUP BY 1, 2",
)
def flow_functions(s: SparkSession, d: str) -> DataFrame:
    flow = _sites(s, d).select(F.col("path").alias("candidate_id"), F.col("site").alias("step"), "path", "line")
    own = t(s, d, "customer").select(F.col("c_custkey").alias("candidate_id"), F.col("c_custkey").alias("usr"))
    return retrieval.flow_functions(flow, _symbols(s, d), own)


@query("covered_truths", f"WITH {_SITES} SELECT count(*) AS truths, count(*) FILTER (hit) AS covered, count(*) FILTER (hit)::DOUBLE / count(*)::DOUBLE AS coverage FROM (SELECT EXISTS (SELECT 1 FROM w WHERE p.path = w.path AND line BETWEEN start_line AND end_line) AS hit FROM p)")
def covered_truths(s: SparkSession, d: str) -> DataFrame:
    truths = _sites(s, d).withColumn("case_id", F.lit("c"))
    return retrieval.covered_truths(truths, _windows(s, d).withColumn("case_id", F.lit("c")))


@query("incomplete_walks", "SELECT DISTINCT 'no_evidence_expansion' AS kind, 'p' || l_partkey AS affects, 'no definition of p' || l_partkey AS detail FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 WHERE p_partkey IS NULL")
def incomplete_walks(s: SparkSession, d: str) -> DataFrame:
    units = t(s, d, "lineitem").join(t(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("start_line")), "l_partkey", "left")
    return retrieval.incomplete(units.select(name("p", "l_partkey").alias("usr"), "start_line"))


@query(
    "expanded_units",
    f"""WITH {_CALLS}, s AS (SELECT 'c' || c_custkey AS usr, c_custkey FROM customer)
    SELECT DISTINCT 'n' || n_nationkey AS candidate_id, 'containing_function' AS role, 0::INT AS depth, 'c' || n_nationkey AS usr FROM nation JOIN s ON s.usr = 'c' || n_nationkey
    UNION ALL SELECT DISTINCT 'n' || n_nationkey, 'callee', 1, callee FROM nation JOIN calls ON caller = 'c' || n_nationkey WHERE callee IS NOT NULL AND callee <> caller
    UNION ALL SELECT DISTINCT 'n' || n_nationkey, 'caller', 1, caller FROM nation JOIN calls ON callee = 'c' || n_nationkey WHERE caller <> callee""",
)
def expanded_units(s: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    symbols = t(s, d, "customer").select(name("c", "c_custkey").alias("usr"), F.lit("function").alias("kind"), F.lit("f").alias("path"), (key * 10).alias("start_line"), (key * 10 + 5).alias("end_line"))
    at = F.col("n_nationkey").cast("long") * 10 + 2
    candidates = t(s, d, "nation").select(name("n", "n_nationkey").alias("candidate_id"), F.lit("f").alias("path"), at.alias("line"), at.alias("end_line"))
    calls = _calls(s, d).withColumns({"name": F.lit("f"), "path": F.lit("f"), "line": F.lit(0)})
    nothing = s.createDataFrame([], "source string, target string")
    return retrieval.expand(candidates, symbols, calls, nothing, nothing).select("candidate_id", "role", "depth", "usr")


# --- facts -------------------------------------------------------------------


@query(
    "source_facts",
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 3 AS m FROM customer) SELECT 'call' AS kind, k, count(*) AS n FROM (SELECT k FROM c UNION ALL SELECT k FROM c WHERE m = 1 UNION ALL SELECT k FROM c WHERE m = 2) GROUP BY k
    UNION ALL SELECT 'symbol', k, 3 FROM c UNION ALL SELECT 'include', k, 1 FROM c UNION ALL SELECT 'macro', k, 1 FROM c UNION ALL SELECT 'input', k, 1 FROM c UNION ALL SELECT 'global_reference', k, 1 FROM c
    UNION ALL SELECT 'expansion', k, 1 FROM c WHERE m = 0 UNION ALL SELECT 'limitation', k, 1 FROM c WHERE m = 2""",
)
def source_facts(s: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    body = pick(F.col("c_custkey"), "x = SIZE;", 'puts("g(1)"); /* g(2) */', "(*hook)(1);")
    source = F.concat(F.lit('#include "a.h"\n#define SIZE 3\nstatic int total = 0;\nint f'), key, F.lit("(int x);\nint f"), key, F.lit("(int x) {\n  total = g(x); // call\n  "), body, F.lit("\n}\n"))
    # sources are far larger than the keys they are made of: tasks by their number
    units = t(s, d, "customer").select("c_custkey")
    tasks = -(-units.count() // UNITS_PER_TASK) or 1
    facts = cfacts.extract(units.repartition(tasks).select(F.concat(F.lit("src/"), key, F.lit(".c")).alias("path"), source.alias("text")), ["src/a.h"])
    return facts.select("kind", F.regexp_extract("unit", r"(\d+)", 1).cast("long").alias("k")).repartition(tasks, "kind", "k").groupBy("kind", "k").agg(F.count(F.lit(1)).alias("n"))


@query("source_calls", "SELECT 'c:@F@f' || c_custkey AS caller, 'c:@F@f' || (c_custkey * 7 % 100) AS callee, 2::INT AS line, octet_length(encode('int f' || c_custkey || '() {' || chr(10) || 'é'))::BIGINT AS start_byte FROM customer")
def source_calls(s: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    source = F.concat(F.lit("int f"), key, F.lit("() {\né f"), (F.col("c_custkey") * 7 % 100).cast("string"), F.lit("(); }\n"))
    calls = cfacts.tables(cfacts.extract(t(s, d, "customer").select(name("u", "c_custkey").alias("path"), source.alias("text"))))["calls"]
    return calls.select("caller", "callee", "line", (F.col("start_byte") - 1).alias("start_byte"))


# --- merging and ordering ----------------------------------------------------


@query("grouped_messages", "WITH x AS (SELECT l_partkey AS region, l_returnflag AS m, min((l_orderkey, l_linenumber, l_suppkey, l_returnflag)) AS o FROM lineitem GROUP BY ALL), n AS (SELECT l_partkey AS region, count(*) AS occurrences FROM lineitem GROUP BY 1) SELECT region, string_agg(m, '; ' ORDER BY o) AS messages, any_value(occurrences) AS occurrences FROM x JOIN n USING (region) GROUP BY 1")
def grouped_messages(s: SparkSession, d: str) -> DataFrame:
    return dedup.grouped_messages(t(s, d, "lineitem").select(F.col("l_partkey").alias("region"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("ordinal"), F.col("l_returnflag").alias("message")))


@query("exclusion_limitations", "SELECT source AS reason, count(*) AS files, min(lang || doc_id) AS example FROM documents GROUP BY 1")
def exclusion_limitations(s: SparkSession, d: str) -> DataFrame:
    return dedup.exclusion_limitations(t(s, d, "documents").select(F.concat("lang", F.col("doc_id").cast("string")).alias("path"), F.col("source").alias("reason")))


@query("duplicate_keys", "SELECT sha256(coalesce(text, '')) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(s: SparkSession, d: str) -> DataFrame:
    return dedup.duplicates(t(s, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")), "key")


@query(
    "merged_symbols",
    """WITH x AS (SELECT DISTINCT l_partkey AS usr, l_suppkey AS region, l_returnflag = 'A' AS is_definition FROM lineitem), d AS (SELECT usr, min(region) FILTER (is_definition) AS definition FROM x GROUP BY 1)
    SELECT usr, any_value(definition) AS definition, coalesce(string_agg(DISTINCT region, ',' ORDER BY region) FILTER (region IS DISTINCT FROM definition), '') AS declarations FROM x JOIN d USING (usr) GROUP BY usr""",
)
def merged_symbols(s: SparkSession, d: str) -> DataFrame:
    found = dedup.merge_symbols(t(s, d, "lineitem").select(F.col("l_partkey").alias("usr"), F.col("l_suppkey").alias("region"), (F.col("l_returnflag") == "A").alias("is_definition")))
    return found.select("usr", "definition", F.array_join(F.col("declarations").cast(NONE), ",").alias("declarations"))


@query("first_of_each", "SELECT l_partkey, l_returnflag, (min((l_linenumber, l_orderkey, l_suppkey)))[2] AS l_orderkey FROM lineitem GROUP BY 1, 2")
def first_of_each(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "lineitem").select("l_partkey", "l_returnflag", "l_linenumber", "l_orderkey", "l_suppkey")
    return dedup.first_of(rows, ["l_partkey", "l_returnflag"], ["l_linenumber", "l_orderkey", "l_suppkey"]).select("l_partkey", "l_returnflag", "l_orderkey")


@query(
    "evidence_unions",
    "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'a1,b1,' || o_orderstatus || '2' WHEN o_custkey % 3 = 1 THEN 'a1,b1,a2' ELSE 'a1,b1' END AS kept FROM orders",
)
def evidence_unions(s: SparkSession, d: str) -> DataFrame:
    item = lambda i, n: F.struct(i.alias("evidence_id"), F.lit(n).alias("n"))
    third = F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderstatus")).when(F.col("o_custkey") % 3 == 1, F.lit("x")).otherwise("b")
    union = dedup.evidence_union(F.array(item(F.lit("a"), 1), item(F.lit("b"), 1)), F.array(item(F.lit("a"), 2), item(third, 2)))
    text = F.array_join(F.transform(union, lambda e: F.concat(F.when(e["evidence_id"] == "x", "a").otherwise(e["evidence_id"]), e["n"].cast("string"))), ",")
    return t(s, d, "orders").select("o_orderkey", text.alias("kept"))


# --- metrics, calibration, experiments ----------------------------------------


@query(
    "evidence_validity",
    """SELECT count(*) FILTER (NOT bad) AS intact, count(*) AS total, count(*) FILTER (NOT bad)::DOUBLE / count(*)::DOUBLE AS rate FROM (SELECT l_orderkey, bool_or(l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < -500)) AS bad FROM lineitem GROUP BY 1)""",
)
def evidence_validity(s: SparkSession, d: str) -> DataFrame:
    findings = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("finding_id")).agg(F.collect_list("l_partkey").alias("paths"), F.collect_list("l_suppkey").alias("evidence_ids"))
    return metrics.evidence_validity(findings, t(s, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("path")), t(s, d, "supplier").where("s_acctbal < -500").select(F.col("s_suppkey").alias("evidence_id")))


@query("gates_passed", "SELECT bool_and(v > 2) AS passed, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (v <= 2), '') AS failed FROM (SELECT event_type, count(DISTINCT user_id) % 5 AS v FROM events GROUP BY 1)")
def gates_passed(s: SparkSession, d: str) -> DataFrame:
    gates = t(s, d, "events").groupBy(F.col("event_type").alias("name")).agg((F.count_distinct("user_id") % 5 > 2).alias("passed"))
    return metrics.gates_passed(gates).withColumn("failed", F.array_join("failed", ","))


@query("overall_scores", "SELECT l_orderkey, l_linenumber, l_partkey, 0.5::DOUBLE * l_tax + 0.5::DOUBLE * l_discount AS score, greatest(0, l_quantity - 25) AS cost FROM lineitem")
def overall_scores(s: SparkSession, d: str) -> DataFrame:
    score = metrics.overall_score(F.col("l_tax"), F.col("l_discount"), F.lit(True))
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", score.alias("score"), metrics.cost_minus(F.col("l_quantity"), F.lit(25.0)).alias("cost"))


@query("one_policy", "SELECT n_nationkey, n_regionkey FROM nation")
def one_policy(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "nation").select("n_nationkey", "n_regionkey", F.lit("v1").alias("policy"))
    return checks.refuse(metrics.assert_one(rows, F.col("policy"), "policies differ"), F.col("n_nationkey") < 0, "no such nation").drop("policy")


@query("unreachable_categories", "SELECT DISTINCT CASE WHEN quality = 0 THEN 'error_handling' ELSE 'coupling' END AS category FROM labels WHERE quality = 0")
def unreachable_categories(s: SparkSession, d: str) -> DataFrame:
    return quality.unreachable_labels(t(s, d, "labels").select(F.when(F.col("quality") == 0, "error_handling").otherwise("coupling").alias("category")))


@query(
    "truth_outcomes",
    """WITH p AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS truth, l_suppkey AS finding_id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1), v AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS truth FROM lineitem WHERE l_linestatus = 'F'), f AS (SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS finding_id FROM lineitem),
    o AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.case_id = v.case_id AND p.truth = v.truth) THEN 'tp' ELSE 'fn' END AS outcome FROM v UNION ALL SELECT 'fp' FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.case_id = f.case_id AND p.finding_id = f.finding_id))
    SELECT 'all' AS family, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM o""",
)
def truth_outcomes(s: SparkSession, d: str) -> DataFrame:
    truths, findings, pairs = _outcomes(s, d)
    return metrics.counts_by_family(matching.outcomes(truths, findings, pairs))


def _outcomes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    l = t(s, d, "lineitem").withColumnRenamed("l_orderkey", "case_id")  # noqa: E741
    pairs = l.where("l_returnflag = 'R' and l_linenumber = 1").select("case_id", F.col("l_partkey").alias("truth"), F.col("l_suppkey").alias("finding_id")).distinct()
    variants = F.when(F.col("l_linestatus") == "F", "vulnerable").otherwise("fixed")
    truths = l.select("case_id", F.col("l_partkey").alias("truth"), F.lit("all").alias("family"), variants.alias("variant")).distinct()
    return truths.where("variant = 'vulnerable'"), l.select("case_id", F.col("l_suppkey").alias("finding_id"), F.lit("all").alias("family")).distinct(), pairs


@query(
    "labelled_findings",
    """WITH p AS (SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS finding_id FROM lineitem WHERE l_returnflag = 'R') SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS finding_id, EXISTS (SELECT 1 FROM p WHERE p.case_id = l_orderkey AND p.finding_id = l_suppkey) AS truth FROM lineitem""",
)
def labelled_findings(s: SparkSession, d: str) -> DataFrame:
    l = t(s, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("finding_id"), "l_returnflag")  # noqa: E741
    return matching.label_findings(l.select("case_id", "finding_id").distinct(), l.where("l_returnflag = 'R'").select("case_id", "finding_id").distinct())


@query("factor_earns", "SELECT (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A') > (SELECT count(*) FROM lineitem WHERE l_returnflag = 'N') AS earns, count(DISTINCT x) <= 1 AS agree FROM (SELECT string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS x FROM lineitem GROUP BY l_returnflag)")
def factor_earns(s: SparkSession, d: str) -> DataFrame:
    l = t(s, d, "lineitem")  # noqa: E741
    scores = l.groupBy(F.col("l_returnflag").alias("name")).agg(F.count(F.lit(1)).alias("score"))
    same = experiments.exclusions_agree(l.select(F.col("l_returnflag").alias("name"), F.col("l_suppkey").cast("string").alias("case_id")))
    # one row each
    return experiments.earns_itself(scores, "A", "N").crossJoin(F.broadcast(same))


@query("attribution", "SELECT 'A' || k AS stage, CASE WHEN r_regionkey IS NOT NULL THEN 'measured' WHEN k = 7 THEN 'deferred' ELSE 'not_run' END AS status, (r_regionkey * 0.5)::DOUBLE AS macro_f2 FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) v(k) LEFT JOIN region ON r_regionkey = k")
def attribution(s: SparkSession, d: str) -> DataFrame:
    reports_ = t(s, d, "region").select(name("A", "r_regionkey").alias("stage"), F.lit("same").alias("identity"), (F.col("r_regionkey") * 0.5).alias("macro_f2"))
    return experiments.attribution(reports_, ["A7"])


@query("repeatability", "SELECT count(*) AS attempts, count(*) FILTER (o_orderstatus <> 'P') AS completed, count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN 'h' || (o_orderkey % 2) END) = 1 AS repeatable FROM orders")
def repeatability(s: SparkSession, d: str) -> DataFrame:
    return experiments.repeatable(t(s, d, "orders").select((F.col("o_orderstatus") != "P").alias("completed"), F.concat(F.lit("h"), (F.col("o_orderkey") % 2).cast("string")).alias("result_hash")))


@query(
    "identities",
    """WITH h AS (SELECT l_partkey, sha256('{"l_suppkey":' || l_suppkey || ',"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || '}') AS h FROM lineitem)
    SELECT l_partkey, sha256(count(*)"""
    + "".join(f" || ' ' || sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT)" for k in range(8))
    + ") AS identity FROM h GROUP BY 1",
)
def identities(s: SparkSession, d: str) -> DataFrame:
    return experiments.identity(t(s, d, "lineitem"), "l_partkey", ["l_suppkey", "l_orderkey", "l_linenumber"])


# --- checks, records, sinks ----------------------------------------------------


@query("selected_cases", "SELECT r_regionkey::VARCHAR AS case_id, r_name FROM region WHERE r_regionkey IN (1, 3)")
def selected_cases(s: SparkSession, d: str) -> DataFrame:
    return checks.select_cases(t(s, d, "region").select(F.col("r_regionkey").cast("string").alias("case_id"), "r_name"), ["1", "3"])


@query("detections", "SELECT l_orderkey AS pair_id, l_suppkey AS path, 'confirmed' AS section FROM lineitem l JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'A' AND l_suppkey IN (o_custkey % 100, o_orderkey % 100)")
def detections(s: SparkSession, d: str) -> DataFrame:
    findings = t(s, d, "lineitem").select(F.col("l_orderkey").alias("pair_id"), F.col("l_suppkey").alias("path"), F.when(F.col("l_returnflag") == "A", "confirmed").otherwise("needs_review").alias("section"))
    return checks.detections(findings, t(s, d, "orders").select(F.col("o_orderkey").alias("pair_id"), F.array(F.col("o_custkey") % 100, F.col("o_orderkey") % 100).alias("affected_paths"))).select("pair_id", "path", "section")


@query("withheld_units", "SELECT 'shown' AS kind, source || '/x' AS path, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY ALL UNION ALL SELECT DISTINCT 'withheld by ' || source || '/**', source || '/x', 1 FROM documents WHERE source IN ('src1', 'src2')")
def withheld_units(s: SparkSession, d: str) -> DataFrame:
    shown, limits = checks.withheld(t(s, d, "documents").select(F.concat("source", F.lit("/x")).alias("path")), ["src1/**", "src2/**"])
    return shown.groupBy(F.lit("shown").alias("kind"), "path").agg(F.count(F.lit(1)).alias("n")).unionByName(limits.select(F.col("detail").alias("kind"), F.col("affects").alias("path"), F.lit(1).cast("long").alias("n")))


@query("redaction_limitations", "SELECT 'excluded_by_filter' AS kind, 'e' || p_partkey AS affects, (p_size % 3 + 1) || ' secret(s) replaced' AS detail FROM part WHERE p_size % 2 = 0")
def redaction_limitations(s: SparkSession, d: str) -> DataFrame:
    counts = F.create_map(F.lit("a"), (F.col("p_size") % 3).cast("long"), F.lit("b"), F.lit(1).cast("long"))
    units = t(s, d, "part").select(name("e", "p_partkey").alias("evidence_id"), F.when(F.col("p_size") % 2 == 0, "primary").otherwise("secondary").alias("unit_class"), counts.alias("counts"))
    return checks.redaction_limitations(units)


@query("captured_intact", "SELECT p_partkey AS evidence_id, p_size % 3 = 0 AND p_size > 10 AS intact FROM part")
def captured_intact(s: SparkSession, d: str) -> DataFrame:
    p = t(s, d, "part").withColumnRenamed("p_partkey", "evidence_id")
    bundle = p.where("p_size > 10").select("evidence_id", F.col("p_name").cast("binary").alias("captured"), F.when(F.col("p_size") % 3 == 0, F.upper(F.sha2("p_name", 256))).otherwise("0").alias("sha256"))
    return checks.captured_intact(bundle, p.select("evidence_id"))


@query("case_truths", "SELECT o_orderkey::VARCHAR AS case_id, l_linenumber::INT AS line, count(*) AS n, max(CASE WHEN l_returnflag = 'R' THEN 'fixed' ELSE 'vulnerable' END) AS variant FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def case_truths(s: SparkSession, d: str) -> DataFrame:
    null = F.lit(None).cast("string")
    truth = F.struct(F.lit("a.c").alias("path"), F.col("l_linenumber").alias("line"), F.lit("CWE-787").alias("cwe"), F.lit("f").alias("family"), F.when(F.col("l_returnflag") == "R", "fixed").alias("variant"), null.alias("note"))
    cases = t(s, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("case_id")).agg(F.collect_list(truth).alias("ground_truth"))
    return records.truths(cases).groupBy("case_id", "line").agg(F.count(F.lit(1)).alias("n"), F.max("variant").alias("variant"))


@query("manifest_cases", "SELECT o_orderkey AS case_id, o_orderpriority AS family, l::INT AS line FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber - 2 AS l FROM lineitem WHERE l_linenumber - 2 >= 1) ON l_orderkey = o_orderkey")
def manifest_cases(s: SparkSession, d: str) -> DataFrame:
    lines = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_linenumber") - 2).alias("lines"))
    manifest = t(s, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("family"), F.coalesce("lines", F.array().cast("array<int>")).alias("lines"))
    return records.manifest_cases(manifest)


@query("marked_lines", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 4 + 1 END::INT AS line FROM part")
def marked_lines(s: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.repeat(F.lit("x\n"), (F.col("p_size") % 4).cast("int")), F.when(F.col("p_size") % 4 == 0, "none").otherwise("  FLAW here\nFLAW"))
    return t(s, d, "part").select("p_partkey", records.marked_line(body, "FLAW").alias("line"))


@query("merged_units", "SELECT event_type = 'error' AS failed, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'toolchain_unavailable' ELSE 'parse_failed' END ELSE 'facts' END AS kind, count(*) AS n FROM events GROUP BY ALL")
def merged_units(s: SparkSession, d: str) -> DataFrame:
    parsed = t(s, d, "events").select(F.col("event_id").cast("string").alias("unit"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), pick(F.col("event_id"), "x.h: File not found", "odd token").alias("error"))
    good, limits = records.merge_units(parsed)
    both = good.select(F.lit(False).alias("failed"), F.lit("facts").alias("kind")).unionByName(limits.select(F.lit(True).alias("failed"), "kind"))
    return both.groupBy("failed", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "added_lines",
    "SELECT p_partkey AS pair_id, unnest(range(p_size + 10, p_size + 10 + 1 + p_size % 3))::BIGINT AS line FROM part UNION ALL SELECT p_partkey, 201 FROM part WHERE p_size % 2 = 0",
)
def added_lines(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    n = size % 3 + 1
    first = F.concat(F.lit("@@ -1,2 +"), (size + 10).cast("string"), F.lit(","), n.cast("string"), F.lit(" @@ f\n-old\n"), F.repeat(F.lit("+new\n"), n.cast("int")))
    second = F.when(size % 2 == 0, "@@ -300,2 +200,0 @@\n-gone\n-gone\n").otherwise("")
    diffs = t(s, d, "part").select(F.col("p_partkey").alias("pair_id"), F.concat(F.lit("--- a\n+++ b\n"), first, second).alias("diff"))
    return diagnostics.added_lines(diffs)


@query("flow_steps", "SELECT o_orderkey, 'm1,m2,s1,s2' AS in_order, 2::INT AS steps, o_orderkey + 2 AS last FROM orders")
def flow_steps(s: SparkSession, d: str) -> DataFrame:
    item = lambda kind, uri, line: F.struct(F.lit(kind).alias("kind"), F.lit(uri).alias("path"), (F.col("o_orderkey") + line).alias("start_line"))
    evidence = F.array(item("control_flow_step", "s1", 1), item("primary_code", "m1", 0), item("control_flow_step", "s2", 2), item("type_decl", "m2", 0))
    flow = reports.code_flow(evidence)
    return t(s, d, "orders").select("o_orderkey", F.array_join(F.transform(reports.ordered_evidence(evidence), lambda e: e["path"]), ",").alias("in_order"), F.size(flow).alias("steps"), F.element_at(flow, -1)["startLine"].alias("last"))


@query("exclusion_lines", "SELECT source AS reason, count(*) AS files FROM documents GROUP BY 1")
def exclusion_lines(s: SparkSession, d: str) -> DataFrame:
    return reports.exclusion_lines(t(s, d, "documents").select(F.col("source").alias("reason")))


@query("tool_records", "SELECT DISTINCT 's' || l_suppkey AS tool, s_name AS version FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def tool_records(s: SparkSession, d: str) -> DataFrame:
    versions = t(s, d, "supplier").select(name("s", "s_suppkey").alias("tool"), F.col("s_name").alias("version"))
    ran = t(s, d, "lineitem").join(t(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi").select(name("s", "l_suppkey").alias("tool"))
    return reports.tool_records(ran, versions)


@query("report_summary", "SELECT count(*) FILTER (o_orderstatus = 'O') AS confirmed, count(*) FILTER (o_orderstatus = 'F') AS needs_review FROM orders")
def report_summary(s: SparkSession, d: str) -> DataFrame:
    return reports.summary(t(s, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "confirmed").when(F.col("o_orderstatus") == "F", "needs_review").alias("section")))


@query("candidate_summary", "SELECT l_returnflag AS producer, l_linestatus AS family, count(*) AS candidates FROM lineitem GROUP BY 1, 2")
def candidate_summary(s: SparkSession, d: str) -> DataFrame:
    return reports.candidate_summary(t(s, d, "lineitem").select(F.col("l_returnflag").alias("producer"), F.col("l_linestatus").alias("family")))


@query("index_summary", "SELECT 'part' AS \"table\", count(*) AS rows FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'region', count(*) FROM region")
def index_summary(s: SparkSession, d: str) -> DataFrame:
    return reports.index_summary({n: t(s, d, n) for n in ("part", "orders", "region")})


@query("report_rules", "SELECT l_suppkey AS rule_id, string_agg(DISTINCT 'CWE-' || (l_partkey % 9), ',' ORDER BY 'CWE-' || (l_partkey % 9)) AS cwes, arg_min(l_returnflag, (l_orderkey, l_linenumber, l_partkey, l_returnflag)) AS tool FROM lineitem GROUP BY 1")
def report_rules(s: SparkSession, d: str) -> DataFrame:
    findings = t(s, d, "lineitem").select(F.col("l_suppkey").alias("rule_id"), F.concat(F.lit("CWE-"), (F.col("l_partkey") % 9).cast("string")).alias("cwe"), F.col("l_returnflag").alias("tool"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").alias("finding_id"))
    return reports.rules(findings).withColumn("cwes", F.array_join("cwes", ","))


@query("report_taxa", "SELECT DISTINCT 'CWE-' || p_size AS cwe FROM part")
def report_taxa(s: SparkSession, d: str) -> DataFrame:
    return reports.taxa(t(s, d, "part").select(name("CWE-", "p_size").alias("cwe")))


@query("family_rows", "SELECT p_brand AS family, count(*) FILTER (p_size > 25)::INT AS tp, count(*) FILTER (p_size <= 25)::INT AS fp, 0::INT AS fn FROM part GROUP BY 1")
def family_rows(s: SparkSession, d: str) -> DataFrame:
    counted = t(s, d, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") > 25).cast("int").alias("true_positives"), F.count_if(F.col("p_size") <= 25).cast("int").alias("false_positives"))
    v = F.struct("true_positives", "false_positives", F.lit(0).alias("false_negatives"))
    return records.family_rows(counted.select(F.create_map("p_brand", v).alias("per_family")))


@query("run_limitations", "SELECT 'analyzer_failed' AS kind, 'u' || event_id AS affects, event_type || ': crashed' AS detail FROM events WHERE event_type = 'error'")
def run_limitations(s: SparkSession, d: str) -> DataFrame:
    return scan.run_limitations(t(s, d, "events").select(name("u", "event_id").alias("unit"), F.col("event_type").alias("analyzer"), F.when(F.col("event_type") == "error", "crashed").otherwise("ok").alias("status")))


@query("analyzer_runs", "SELECT 'p' || p_partkey AS unit, a AS analyzer, CASE WHEN p_size % 7 = 0 AND a = 'y' THEN 'crashed' ELSE 'ok' END AS status, CASE WHEN p_size % 7 = 0 AND a = 'y' THEN 'broken' ELSE a || ' p' || p_partkey || ' -c' END AS text FROM part, (VALUES ('x'), ('y')) v(a)")
def analyzer_runs(s: SparkSession, d: str) -> DataFrame:
    units = t(s, d, "part").select(F.concat(name("p", "p_partkey"), F.when(F.col("p_size") % 7 == 0, "!").otherwise("")).alias("path"), F.array(F.lit("-c")).alias("arguments"))

    def runner(path: str, analyzer: str, arguments: list[str]) -> tuple[str, str]:
        if path.endswith("!") and analyzer == "y":
            raise RuntimeError("broken")
        return "ok", f"{analyzer} {path.rstrip('!')} {arguments[0]}"

    runs = scan.run_analyzers(units, s.createDataFrame([("x",), ("y",)], "analyzer string"), runner)
    return runs.withColumn("unit", F.rtrim(F.replace("unit", F.lit("!"), F.lit(""))))


@query(
    "scan_plan",
    "WITH k AS (SELECT 's' || l_suppkey AS path, count(*) - 1 AS displaced FROM lineitem GROUP BY 1) SELECT 'unit' AS kind, path, displaced FROM k WHERE path NOT LIKE 's1%' UNION ALL SELECT 'excluded', path, 0 FROM k WHERE path LIKE 's1%' UNION ALL SELECT 'ambiguous_build_config', path, 0 FROM k WHERE displaced > 0 UNION ALL SELECT 'excluded_by_filter', min(path), 0 FROM k WHERE path LIKE 's1%' HAVING count(*) > 0",
)
def scan_plan(s: SparkSession, d: str) -> DataFrame:
    entries = t(s, d, "lineitem").select(name("s", "l_suppkey").alias("path"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("ordinal"))
    plan = scan.scan_plan(entries, F.when(F.col("path").startswith("s1"), "third_party"), entries.select("path").distinct())
    zero = F.lit(0).cast("long").alias("displaced")
    return plan["units"].select(F.lit("unit").alias("kind"), "path", "displaced").unionByName(plan["excluded"].select(F.lit("excluded").alias("kind"), "path", zero)).unionByName(plan["limitations"].select("kind", F.col("affects").alias("path"), zero))


@query("families_covered", "SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'integer' ELSE 'injection' END AS family FROM part WHERE p_size > 10 AND p_type <> 'ECONOMY'")
def families_covered(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "part").where("p_type <> 'ECONOMY'").select(F.lit("tidy").alias("producer"), F.col("p_name").alias("check_id"), F.array(F.when(F.col("p_size") % 2 == 0, "integer").otherwise("injection")).alias("families"), (F.col("p_size") > 10).alias("enabled"))
    return profiles.families_covered(profiles.checks_for(rows, "tidy"))


@query("effective_settings", "SELECT r_name AS key, CASE WHEN r_regionkey % 2 = 0 THEN 'file' ELSE r_regionkey::VARCHAR END AS value, CASE WHEN r_regionkey % 2 = 0 THEN 'environment' ELSE 'defaults' END AS layer FROM region")
def effective_settings(s: SparkSession, d: str) -> DataFrame:
    # settings are a few, read by the driver
    rows = t(s, d, "region").collect()
    return records.effective_config([("defaults", {r["r_name"]: str(r["r_regionkey"]) for r in rows}), ("environment", {r["r_name"]: "file" for r in rows if r["r_regionkey"] % 2 == 0})], s)
