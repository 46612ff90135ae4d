"""Recorded inputs: benchmark cases, pairs, labels, reports, traces, snapshots, answers, configuration and consent."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRUTH = "struct<path:string,line:int,cwe:string,family:string,variant:string,note:string>"
CASE = f"case_id string, family string, description string, analyzer_blind_spot boolean, ground_truth array<{TRUTH}>"
LABEL = "case_id string, category string, path string, line int, labelers array<string>, agreed boolean, adjudicator_note string, source string, severity_note string"
REGION = "struct<path:string,start_line:int,end_line:int,start_byte:bigint,end_byte:bigint,sha256:string>"
SNAPSHOT_LISTS = ("units", "symbols", "calls", "macros", "includes", "type_references", "global_references", "limitations")


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from JSON documents, their truths as an array in order."""
    return spark.read.schema(CASE).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def truths(cases: DataFrame) -> DataFrame:
    """case_id, truth (place), path, line, cwe, family, variant: one row per truth; the variant defaults to vulnerable."""
    rows = cases.select("case_id", F.posexplode("ground_truth").alias("truth", "t")).select("case_id", "truth", "t.*")
    return rows.withColumn("variant", F.coalesce("variant", F.lit("vulnerable"))).drop("note")


def manifest_cases(manifest: DataFrame) -> DataFrame:
    """case_id, family, line of a manifest (id, family, lines): no lines is a safe case of its family with no truths."""
    return manifest.select(F.col("id").alias("case_id"), "family", F.explode_outer(F.filter("lines", lambda x: x >= 1)).alias("line"))


def marked_line(text, pattern: str):
    """The 1-based line of the first match of a pattern, null without one."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.size(F.split(F.substring(text, F.lit(1), at - 1), "\n")))


def load_pairs(spark: SparkSession, text: str) -> DataFrame:
    """Repository pairs of a YAML manifest (its text), pinned revisions and truth lines by path."""
    import yaml

    rows = [
        (p["pair_id"], p["repo_url"], p["vulnerable_rev"], p["fixed_rev"], p.get("cve"), p["cwe"], p["pair_set"], list(p.get("affected_paths") or []), {k: list(v) for k, v in (p.get("truth_lines") or {}).items()})
        for p in (yaml.safe_load(text) or {}).get("pairs") or []
    ]
    return spark.createDataFrame(rows, "pair_id string, repo_url string, vulnerable_rev string, fixed_rev string, cve string, cwe string, pair_set string, affected_paths array<string>, truth_lines map<string,array<int>>")


def load_labels(spark: SparkSession, path: str | None, least_labelers: int = 2) -> DataFrame:
    """Maintainability labels; no file is an empty set; a label by too few people, or without agreement and note, raises."""
    if path is None:
        return spark.createDataFrame([], LABEL)
    raw = spark.read.schema(f"labels array<struct<{', '.join(f'{c.split(chr(32), 1)[0]}:{c.split(chr(32), 1)[1]}' for c in LABEL.split(', '))}>>").option("multiLine", "true").json(path)
    rows = raw.select(F.inline("labels"))
    few = F.size(F.array_distinct("labelers")) < least_labelers
    unsettled = ~F.col("agreed") & (F.coalesce("adjudicator_note", F.lit("")) == "")
    return rows.withColumn("case_id", F.when(few | unsettled, F.raise_error(F.concat(F.lit("label cannot be used: "), "case_id")).cast("string")).otherwise(F.col("case_id")))


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """suite, policy_version, macro_f2, families of a metrics report, also of the older shape that is the metrics alone."""
    family = "map<string,struct<true_positives:int,false_positives:int,false_negatives:int,precision:double,recall:double,f2:double,scored:boolean>>"
    body = f"suite string, policy_version string, macro_f2 double, per_family {family}"
    nested = body.replace(" string", ":string").replace(" double,", ":double,").replace("per_family ", "per_family:").replace(", ", ",")
    raw = spark.read.text(path, wholetext=True)
    both = raw.select(F.from_json("value", f"metrics struct<{nested}>")["metrics"].alias("m"), F.from_json("value", body).alias("o"))
    pick = lambda c: F.coalesce(F.col(f"m.{c}"), F.col(f"o.{c}")).alias(c)
    return both.select(pick("suite"), pick("policy_version"), pick("macro_f2"), pick("per_family"))


def family_rows(report: DataFrame) -> DataFrame:
    return report.select(F.explode("per_family").alias("family", "v")).select("family", F.col("v.true_positives").alias("tp"), F.col("v.false_positives").alias("fp"), F.col("v.false_negatives").alias("fn"))


def parse_trace(lines: DataFrame) -> DataFrame:
    """Events of lines (value, JSON objects): event, run_id, policy_version and all other fields as a map."""
    kept = lines.where("trim(value) <> ''")
    parsed = kept.select(F.from_json("value", "event string, run_id string, policy_version string").alias("e"), F.from_json("value", "map<string,string>").alias("fields"))
    return parsed.select("e.*", F.map_filter("fields", lambda k, _: ~k.isin("event", "run_id", "policy_version")).alias("fields"))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Events of a run trace (JSON lines)."""
    return parse_trace(spark.read.text(path))


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The fact tables of an index snapshot (one JSON document): one table per list."""
    raw = spark.read.option("multiLine", "true").json(path)
    tables = {}
    for name in SNAPSHOT_LISTS:
        if name in raw.columns:
            tables[name] = raw.select(F.explode(name).alias("x")).select("x.*" if dict(raw.dtypes)[name].startswith("array<struct") else F.col("x"))
    return tables


def merge_units(parsed: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """Facts of units that parsed, and a limitation for each that did not."""
    failed = parsed.where(F.col(status) != "ok")
    limitation = failed.select(F.when(F.col("error").rlike("(?i)file not found"), "toolchain_unavailable").otherwise("parse_failed").alias("kind"), F.col("unit").alias("affects"), F.col("error").alias("detail"))
    return parsed.where(F.col(status) == "ok"), limitation


def effective_config(layers: Sequence[tuple[str, Mapping[str, str]]], spark: SparkSession) -> DataFrame:
    """key, value, layer: the last layer that sets a key wins."""
    rows = [(i, name, k, str(v)) for i, (name, values) in enumerate(layers) for k, v in values.items()]
    given = spark.createDataFrame(rows, "priority int, layer string, key string, value string")
    return given.groupBy("key").agg(F.max_by(F.struct("value", "layer"), "priority").alias("w")).select("key", "w.value", "w.layer")


def cassette(spark: SparkSession, text: str, prompt_version: str) -> DataFrame:
    """turn, text, failure of a recording of model turns; one of another prompt version is refused."""
    recorded = json.loads(text)
    if recorded.get("prompt_version") != prompt_version:
        raise ValueError(f"recorded with prompt {recorded.get('prompt_version')}, not {prompt_version}")
    rows = [(i, t.get("text"), t.get("failure")) for i, t in enumerate(recorded["turns"])]
    return spark.createDataFrame(rows, "turn int, text string, failure string")


def checkpoint_state(text: str | None, identity: str) -> dict | None:
    """The completed prefix of a run that was cut short, None without one; of another run it raises rather than start again."""
    if text is None:
        return None
    state = json.loads(text)
    if state.get("identity") != identity:
        raise ValueError("the checkpoint belongs to another run")
    return state


def case_arguments(line, source):
    """The arguments for analysis of a recorded compile line: without output flags, the file last."""
    from ..functions.build import strip_compile_only

    words = F.filter(F.split(F.trim(line), r"\s+"), lambda a: ~a.rlike(r"\.(?:c|cc|cpp|cxx)$"))
    return F.concat(strip_compile_only(words), F.array(source))


def consent(text: str | None, flag: bool | None = None) -> bool:
    """Whether sending code out was agreed to: the flag, else a record that says so; anything else is a no."""
    if flag is not None:
        return flag
    try:
        return json.loads(text or "")["granted"] is True
    except (ValueError, KeyError, TypeError):
        return False
