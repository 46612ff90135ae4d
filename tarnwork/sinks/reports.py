"""Reports: Markdown, SARIF, metrics and tables, with deterministic bytes.

A report is a table of lines or results in order, made where its rows are.
``render_markdown`` and ``build_sarif`` bring it to the driver as one text;
``write_markdown`` and ``write_sarif`` write it by Spark, at any size. The
tables behind it are written as Parquet.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.weakness import sort_key
from ..operators.dedup import first_of
from .commits import Commits

#: Rules, and weaknesses, that the head of a report lists at most: it is one value.
MOST_RULES = 100_000


def ordered_evidence(evidence: Column) -> Column:
    """Evidence that is no flow step first, flow steps after it, both in their order."""
    flow = lambda e: e["kind"] == "control_flow_step"
    return F.concat(F.filter(evidence, lambda e: ~flow(e)), F.filter(evidence, flow))


def code_flow(evidence: Column) -> Column:
    """Flow steps with their place from 1."""
    return F.transform(F.filter(evidence, lambda e: e["kind"] == "control_flow_step"), lambda e, i: F.struct((i + 1).alias("executionOrder"), e["path"].alias("uri"), e["start_line"].alias("startLine")))


def exclusion_lines(excluded: DataFrame) -> DataFrame:
    """reason, files, without zero counts, sorted."""
    return excluded.groupBy("reason").agg(F.count(F.lit(1)).alias("files")).orderBy("reason")


def tool_records(ran: DataFrame, versions: DataFrame) -> DataFrame:
    """tool, version of what ran; an unknown version is an error."""
    joined = ran.select("tool").distinct().join(versions, "tool", "left")
    return joined.select("tool", F.coalesce("version", F.raise_error(F.concat(F.lit("no version known for "), "tool")).cast("string")).alias("version"))


def summary(findings: DataFrame) -> DataFrame:
    """One row: confirmed and needs_review, apart; no count adds them up."""
    return findings.agg(F.count_if(F.col("section") == "confirmed").alias("confirmed"), F.count_if(F.col("section") == "needs_review").alias("needs_review"))


def candidate_summary(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("producer", "family").agg(F.count(F.lit(1)).alias("candidates"))


def index_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table, rows of each fact table."""
    parts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rules(findings: DataFrame) -> DataFrame:
    """rule_id, cwes (sorted), tool (the first by finding) of findings."""
    return findings.groupBy("rule_id").agg(F.array_sort(F.collect_set("cwe")).alias("cwes"), F.min_by("tool", "finding_id").alias("tool")).orderBy("rule_id")


def taxa(findings: DataFrame) -> DataFrame:
    return findings.select("cwe").distinct().orderBy(sort_key(F.col("cwe")))


def _location(path: Column, first: Column, last: Column) -> Column:
    region = F.struct(first.cast("int").alias("startLine"), last.cast("int").alias("endLine"))
    return F.struct(F.struct(F.struct(path.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))


def with_evidence(findings: DataFrame, evidence: DataFrame | None) -> DataFrame:
    """findings with their evidence as an array in order; evidence: finding_id, ordinal, evidence_id, kind, path, start_line, end_line."""
    kind = "array<struct<ordinal:int,evidence_id:string,kind:string,path:string,start_line:int,end_line:int>>"
    if evidence is None:
        return findings.withColumn("evidence", F.array().cast(kind))
    item = F.struct(F.col("ordinal").cast("int").alias("ordinal"), "evidence_id", "kind", "path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))
    own = evidence.groupBy("finding_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    return findings.join(own, "finding_id", "left").withColumn("evidence", ordered_evidence(F.coalesce("evidence", F.array().cast(kind))))


def sarif_results(findings: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """section, place, finding_id, result: one SARIF result (JSON) per finding, made where the finding is.

    findings: finding_id, section, place, rule_id, rule_index, cwe, message,
    path, start_line, end_line, sha256. Steps of control flow become a code
    flow, other evidence related locations. Confirmed findings fail; findings
    for review have no level.
    """
    confirmed = F.col("section") == "confirmed"
    step = lambda e: F.struct(_location(e["path"], e["start_line"], e["end_line"]).alias("location"))
    flow = F.filter("evidence", lambda e: e["kind"] == "control_flow_step")
    other = F.filter("evidence", lambda e: e["kind"] != "control_flow_step")
    threads = F.struct(F.array(F.struct(F.transform(flow, step).alias("locations"))).alias("threadFlows"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), F.when(confirmed, "fail").otherwise("review").alias("kind"), F.when(confirmed, "error").otherwise("none").alias("level"), F.col("place").cast("double").alias("rank"),
        F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(F.col("cwe").alias("id"), F.struct(F.lit("CWE").alias("name")).alias("toolComponent"))).alias("taxa"), F.struct(F.col("finding_id").alias("finding")).alias("fingerprints"),
        F.array(_location(F.col("path"), F.col("start_line"), F.col("end_line"))).alias("locations"), F.when(F.size(flow) > 0, F.array(threads)).alias("codeFlows"),
        F.when(F.size(other) > 0, F.transform(other, lambda e: _location(e["path"], e["start_line"], e["end_line"]))).alias("relatedLocations"), F.struct(F.col("sha256").alias("regionSha256")).alias("properties"),
    )
    return with_evidence(findings, evidence).select("section", "place", "finding_id", F.to_json(result).alias("result"))


def _indexed(findings: DataFrame, tool: str) -> tuple[DataFrame, list[str]]:
    """findings with the index of their rule; rules and weaknesses are lists of a catalogue's size, and more than that is an error."""
    names = [r["rule_id"] for r in rules(findings.withColumn("tool", F.lit(tool))).limit(MOST_RULES + 1).collect()]
    if len(names) > MOST_RULES or taxa(findings).limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules or weaknesses are no catalogue")
    index = findings.sparkSession.createDataFrame(list(enumerate(names)), "rule_index int, rule_id string")
    return findings.join(F.broadcast(index), "rule_id"), names


def _sarif_head(findings: DataFrame, names: Sequence[str], notifications: Sequence[str], tool: str, version: str) -> dict[str, object]:
    return {
        "tool": {"driver": {"name": tool, "version": version, "rules": [{"id": n} for n in names]}},
        "taxonomies": [{"name": "CWE", "taxa": [{"id": r["cwe"]} for r in taxa(findings).collect()]}],
        "invocations": [{"executionSuccessful": True, "toolExecutionNotifications": [{"message": {"text": n}} for n in notifications]}],
    }


_SARIF = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"}


def build_sarif(findings: DataFrame, notifications: Sequence[str] = (), tool: str = "tarnwork", version: str = "1", evidence: DataFrame | None = None) -> str:
    """One SARIF document of a report that a driver can hold; ranks count from 1 in each section."""
    indexed, names = _indexed(findings, tool)
    rows = sarif_results(indexed, evidence).orderBy("section", "place", "finding_id").select("result").collect()
    run = _sarif_head(findings, names, notifications, tool, version) | {"results": [json.loads(r["result"]) for r in rows]}
    return json.dumps({**_SARIF, "runs": [run]}, sort_keys=True, indent=2) + "\n"


def write_sarif(findings: DataFrame, path: str, notifications: Sequence[str] = (), tool: str = "tarnwork", version: str = "1", evidence: DataFrame | None = None) -> None:
    """A SARIF document of any size, by Spark: text files below path that are the document one after the other."""
    indexed, names = _indexed(findings, tool)
    run = json.dumps(_sarif_head(findings, names, notifications, tool, version), sort_keys=True)
    spark = findings.sparkSession
    results = sarif_results(indexed, evidence).select(F.when(F.col("section") == "confirmed", 1).otherwise(2).alias("part"), "place", F.col("finding_id").cast("string").alias("key"), "result")
    # a comma before every result but the first in order
    first = results.agg(F.min(F.struct("part", "place", "key")).alias("first")).first()["first"]
    is_first = (F.col("part") == first["part"]) & (F.col("place") == first["place"]) & (F.col("key") == first["key"]) if first is not None else F.lit(False)
    head = json.dumps(_SARIF)[:-1] + ', "runs": [' + run[:-1] + ', "results": ['
    ends = spark.createDataFrame([(0, 0, "", head), (9, 0, "", "]}]}")], "part int, place int, key string, line string")
    lines = results.select("part", F.col("place").cast("int").alias("place"), "key", F.concat(F.when(is_first, "").otherwise(","), "result").alias("line")).unionByName(ends)
    lines.orderBy("part", "place", "key").select("line").write.mode("overwrite").text(path)


def markdown_lines(findings: DataFrame, coverage: Mapping[str, object], excluded: DataFrame, limitations: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """part, place, key, ordinal, line of the report, in that order; each finding is followed by its evidence."""
    spark = findings.sparkSession
    fixed = ["# Audit report", "", "## Coverage", "", "| measure | value |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in coverage.items()]]
    made = [(0, i, "", 0, x) for i, x in enumerate(fixed)]
    kind = "part int, place int, key string, ordinal int, line string"
    count = exclusion_lines(excluded).select(F.lit(1).alias("part"), F.lit(0).alias("place"), F.col("reason").alias("key"), F.lit(0).alias("ordinal"), F.concat(F.lit("| excluded: "), "reason", F.lit(" | "), F.col("files").cast("string"), F.lit(" |")).alias("line"))
    parts = [count]
    for part, (section, title) in enumerate((("confirmed", "Confirmed"), ("needs_review", "Needs review")), 2):
        own = with_evidence(findings.where(F.col("section") == section), evidence)
        head = F.concat(F.col("place").cast("string"), F.lit(". `"), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("` "), "cwe", F.lit(": "), "message", F.lit(" ("), "confidence", F.lit(", "), "reason", F.lit(")"))
        cited = F.transform("evidence", lambda e: F.concat(F.lit("   - "), e["kind"], F.lit(" `"), e["path"], F.lit(":"), e["start_line"].cast("string"), F.lit("-"), e["end_line"].cast("string"), F.lit("` "), e["evidence_id"]))
        parts.append(own.select(F.lit(part).alias("part"), F.col("place").cast("int").alias("place"), F.col("finding_id").cast("string").alias("key"), F.posexplode(F.concat(F.array(head), cited)).alias("ordinal", "line")))
        made += [(part, -1, "", i, x) for i, x in enumerate(("", f"## {title}", "", *(() if own.limit(1).count() else ("None.",))))]
    limit = F.concat(F.lit("- "), "kind", F.lit(": "), "detail", F.when(F.coalesce("affects", F.lit("")) != "", F.concat(F.lit(" ("), "affects", F.lit(")"))).otherwise(""))
    parts.append(limitations.select(F.lit(4).alias("part"), F.lit(0).alias("place"), F.concat_ws("\x01", "kind", "affects", "detail").alias("key"), F.lit(0).alias("ordinal"), limit.alias("line")))
    made += [(4, -1, "", i, x) for i, x in enumerate(("", "## Limitations", "", *(() if limitations.limit(1).count() else ("None.",))))]
    out = spark.createDataFrame(made, kind)
    for p in parts:
        out = out.unionByName(p)
    return out


def write_markdown(lines: DataFrame, path: str) -> None:
    """A report of any size, by Spark: text files below path that are the document one after the other."""
    lines.orderBy("part", "place", "key", "ordinal").select("line").write.mode("overwrite").text(path)


def render_markdown(findings: DataFrame, coverage: Mapping[str, object], excluded: DataFrame, limitations: DataFrame, roots: Sequence[str] = (), evidence: DataFrame | None = None) -> str:
    """The report as Markdown that a driver can hold; absolute names of the roots are cut to base names last."""
    lines = markdown_lines(findings, coverage, excluded, limitations, evidence).orderBy("part", "place", "key", "ordinal").select("line").collect()
    text = "\n".join(r["line"] for r in lines) + "\n"
    for root in sorted({r.rstrip("/") for r in roots} - {""}, key=len, reverse=True):
        text = text.replace(root, root.rsplit("/", 1)[-1])
    return text


def write_text(text: str, path: str) -> str:
    """Write a document whole or not at all: to a name beside it, then renamed. A driver's local path."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".part", "w", encoding="utf-8", newline="\n") as f:
        f.write(text)
    os.replace(path + ".part", path)
    return path


def write_json(value: object, path: str) -> str:
    return write_text(json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n", path)


def write_table(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A table in the order of its keys, by Spark: ranges of the order in ascending files."""
    df.orderBy(*order).write.mode("overwrite").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Append events to a trace of JSON lines."""
    events.select(F.to_json(F.struct(*sorted(events.columns))).alias("value")).write.mode("append").text(path)


def export_schemas(schemas: Mapping[str, T.StructType], folder: str) -> list[str]:
    return [write_text(json.dumps(s.jsonValue(), sort_keys=True, indent=2) + "\n", f"{folder}/{name}.schema.json") for name, s in sorted(schemas.items())]


def schema_drift(committed: DataFrame, fresh: DataFrame) -> DataFrame:
    """name, state of schemas (name, text) that are missing, new or changed."""
    joined = committed.withColumnRenamed("text", "old").join(fresh.withColumnRenamed("text", "new"), "name", "full_outer")
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "missing").when(F.col("old") != F.col("new"), "changed")
    return joined.select("name", state.alias("state")).where("state is not null")


def record_access(spark: SparkSession, folder: str, policy_version: str, **about: object) -> int:
    """Note that held-out data are used under a policy version; how often they were, this time included.

    The note is an entry that only one run can make under its number, so two
    runs at once never both were the first.
    """
    return Commits(spark, f"{folder}/{hashlib.sha256(policy_version.encode()).hexdigest()[:32]}").append({"policy_version": policy_version, **about})


def accesses(spark: SparkSession, folder: str, policy_version: str) -> list[dict]:
    """The notes of record_access under a policy version, in order."""
    log = Commits(spark, f"{folder}/{hashlib.sha256(policy_version.encode()).hexdigest()[:32]}")
    return [log.read(n) for n in log.numbers()]


def put_responses(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Content-addressed responses: what is stored wins, new keys are added, the first of each."""
    return first_of(stored.withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1))), ["key"], ["part", "payload"]).drop("part")


def write_prompts(prompts: DataFrame, path: str) -> None:
    """Assembled requests (candidate_id, text), one folder per candidate; nothing is sent."""
    prompts.select("candidate_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("candidate_id").text(path)
