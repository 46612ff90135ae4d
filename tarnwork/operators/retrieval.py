"""Retrieval of code for candidates: containing function, closure over types, macros and globals, callers, callees and cleanup.

All candidates are expanded at once: every step is a join keyed by
candidate_id over the index's tables, and rows keep the role and depth that
rank them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import is_release_call
from ..values import GOTO, LABEL
from .graph import walk
from .intervals import innermost, points_in_intervals

UNIT = ["candidate_id", "role", "depth", "usr", "path", "start_line", "end_line"]


def containing(candidates: DataFrame, symbols: DataFrame) -> DataFrame:
    """candidate_id, usr, path, start_line, end_line: the innermost callable around each candidate's line, else its own region whole.

    candidates: candidate_id, path, line, end_line; symbols: usr, kind, path, start_line, end_line.
    """
    callable_ = symbols.where(F.col("kind").isin("function", "method", "constructor", "destructor"))
    inner = innermost(candidates, callable_, ["path"], "line", "start_line", "end_line", "candidate_id", "usr")
    regions = callable_.select("usr", F.col("start_line").alias("__s"), F.col("end_line").alias("__e"))
    # the regions meet those that have one: candidates in none, all with a null usr, would be one task's
    joined = candidates.join(inner.join(regions.hint("merge"), "usr").hint("merge"), "candidate_id", "left")
    return joined.select("candidate_id", "usr", "path", F.coalesce("__s", "line").alias("start_line"), F.coalesce("__e", F.coalesce("end_line", "line")).alias("end_line"))


def flow_functions(flow: DataFrame, symbols: DataFrame, contained: DataFrame) -> DataFrame:
    """Functions around flow steps (candidate_id, step, path, line), each once, by first step, without the containing one."""
    steps = flow.withColumn("point", F.struct("candidate_id", "step"))
    inner = innermost(steps, symbols.where("kind = 'function'"), ["path"], "line", "start_line", "end_line", "point", "usr")
    first = inner.groupBy(F.col("point.candidate_id").alias("candidate_id"), "usr").agg(F.min("point.step").alias("step"))
    return first.join(contained.select("candidate_id", "usr"), ["candidate_id", "usr"], "left_anti")


def neighbours(contained: DataFrame, edges: DataFrame, symbols: DataFrame, depth: int, direction: str) -> DataFrame:
    """Units of callers or callees within depth hops, at their first depth; those without a definition keep null regions."""
    source, target = ("callee", "caller") if direction == "caller" else ("caller", "callee")
    reached = walk(contained.select(F.col("usr").alias("node")).where("node is not null").distinct(), edges, depth, source, target).where("depth > 0")
    found = contained.select("candidate_id", F.col("usr").alias("seed")).join(reached, "seed").select("candidate_id", F.lit(direction).alias("role"), "depth", F.col("node").alias("usr"))
    return found.join(symbols.select("usr", "path", "start_line", "end_line"), "usr", "left").select(*UNIT)


def types_and_globals(contained: DataFrame, references: DataFrame, symbols: DataFrame, role: str, depth: int) -> DataFrame:
    """Units of what a function refers to (references: source, target), types to depth 2, globals to 1."""
    reached = walk(contained.select(F.col("usr").alias("node")).where("node is not null").distinct(), references, depth, "source", "target").where("depth > 0")
    found = contained.select("candidate_id", F.col("usr").alias("seed")).join(reached, "seed").select("candidate_id", F.lit(role).alias("role"), "depth", F.col("node").alias("usr"))
    return found.join(symbols.select("usr", "path", "start_line", "end_line"), "usr").select(*UNIT)


def release_sites(contained: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls inside the containing region to names that give a resource back; edges: caller, callee, name, path, line."""
    calls = edges.where(is_release_call(F.col("name"))).select(F.col("caller").alias("usr"), F.col("line").alias("site"))
    found = contained.join(calls, "usr").where("site between start_line and end_line")
    return found.select("candidate_id", F.lit("cleanup_path").alias("role"), F.lit(1).alias("depth"), "usr", "path", F.col("site").alias("start_line"), F.col("site").alias("end_line")).distinct()


def label_blocks(contained: DataFrame, files: DataFrame) -> DataFrame:
    """From each label that a goto of the function names to the function's end; files: path, text."""
    lines = files.join(contained.select("path").distinct(), "path", "left_semi").select("path", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("n", F.col("pos") + 1)
    inside = points_in_intervals(lines, contained, ["path"], "n", "start_line", "end_line")
    targets = inside.select("candidate_id", F.explode(F.regexp_extract_all("raw", F.lit(GOTO), F.lit(1))).alias("label")).distinct()
    labels = inside.select("candidate_id", "usr", "path", "n", "end_line", F.regexp_extract("raw", LABEL, 1).alias("label")).where("label <> ''")
    return labels.join(targets, ["candidate_id", "label"]).select("candidate_id", F.lit("cleanup_path").alias("role"), F.lit(1).alias("depth"), "usr", "path", F.col("n").alias("start_line"), "end_line")


def flat_window(candidates: DataFrame, files: DataFrame, lines: int = 40) -> DataFrame:
    """The control: some lines around each candidate, kept inside its file; files: path, line_count."""
    joined = candidates.join(files.select("path", "line_count"), "path")
    return joined.select("candidate_id", F.lit("flat_window").alias("role"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("usr"), "path", F.greatest(F.lit(1), F.col("line") - lines).alias("start_line"), F.least("line_count", F.coalesce("end_line", "line") + lines).alias("end_line"))


def expand(candidates: DataFrame, symbols: DataFrame, edges: DataFrame, types: DataFrame, variables: DataFrame, caller_depth: int = 1, callee_depth: int = 1, type_depth: int = 2) -> DataFrame:
    """All units of all candidates, each (candidate, role, usr) at its first depth."""
    own = containing(candidates, symbols)
    first = own.select("candidate_id", F.when(F.col("usr").isNull(), "candidate_site").otherwise("containing_function").alias("role"), F.lit(0).alias("depth"), "usr", "path", "start_line", "end_line")
    parts = [
        neighbours(own, edges, symbols, caller_depth, "caller"), neighbours(own, edges, symbols, callee_depth, "callee"),
        types_and_globals(own, types, symbols, "type_decl", type_depth), types_and_globals(own, variables, symbols, "global_decl", 1), release_sites(own, edges, symbols),
    ]
    for p in parts:
        first = first.unionByName(p)
    return first.dropDuplicates(["candidate_id", "role", "usr", "start_line"])


def covered_truths(truths: DataFrame, units: DataFrame) -> DataFrame:
    """One row: truths, covered, coverage of truths (case_id, path, line) by units of their case; null without truths."""
    spans = units.select("case_id", "path", "start_line", "end_line").where("start_line is not null").distinct()
    hit = points_in_intervals(truths, spans, ["case_id", "path"], "line", "start_line", "end_line", how="left_semi")
    both = truths.agg(F.count(F.lit(1)).alias("truths")).crossJoin(hit.agg(F.count(F.lit(1)).alias("covered")))
    return both.withColumn("coverage", F.try_divide(F.col("covered").cast("double"), F.col("truths").cast("double")))


def incomplete(units: DataFrame) -> DataFrame:
    """Limitations for functions that a walk reached and the index has no region of."""
    return units.where("start_line is null").select(F.lit("no_evidence_expansion").alias("kind"), F.col("usr").alias("affects"), F.concat(F.lit("no definition of "), "usr").alias("detail")).distinct()
