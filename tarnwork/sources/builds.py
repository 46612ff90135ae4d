"""Compilation databases and source trees as tables."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.build import strip_compile_only
from ..functions.paths import matches_any, relative_to
from ..functions.regions import line_starts
from ..functions.text import split_command
from ..plans.scratch import written
from ..values import HEADERS, MAX_ARGUMENTS, MAX_RESPONSE_DEPTH, SOURCE_LANGUAGE
from . import json_arrays

ENTRY = "path string, ordinal long, directory string, file string, output string, arguments array<string>, command string, problem string"
#: Bytes up to which a document that is no array is parsed to say what it is instead.
SMALL = 1_000_000


class IntakeError(ValueError):
    """A compilation database that cannot be used, and why."""


def _problem(entry: object) -> str | None:
    """What is wrong with an entry of a compilation database."""
    if not isinstance(entry, dict):
        return "is not an object"
    for field in ("file", "directory"):
        if not isinstance(entry.get(field), str) or not entry[field].strip():
            return f"has no {field}"
    if not entry["directory"].startswith("/"):
        return "has a relative directory"
    arguments, command = entry.get("arguments"), entry.get("command")
    if arguments is not None:
        if not (isinstance(arguments, list) and all(isinstance(a, str) for a in arguments)):
            return "has arguments that are no list of strings"
        return None if arguments else "has an empty list of arguments"
    return None if isinstance(command, str) and command.strip() else "has neither arguments nor a command"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 3, pa.list_(pa.string()), *[pa.string()] * 2]
    for batch in batches:
        out = []
        for path, ordinal, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            try:
                entry = json.loads(text)
                problem = _problem(entry)
            except ValueError as e:
                entry, problem = None, f"is not JSON: {e}" if text.strip() else "is empty"
            if problem:
                out.append((path, ordinal, *[None] * 5, problem))
                continue
            output = entry.get("output")
            out.append((path, ordinal, entry["directory"], entry["file"], output if isinstance(output, str) else None, entry.get("arguments"), entry.get("command") if entry.get("arguments") is None else None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True)], [c.split()[0] for c in ENTRY.split(", ")])


def _kind(spark: SparkSession, path: str) -> str | None:
    """What a small document is, if it is JSON and no array."""
    if (spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or SMALL) >= SMALL:
        return None
    try:
        return {dict: "an object", str: "a string", list: None}.get(type(json.loads(spark.read.text(path, wholetext=True).first()[0])), "a single value")
    except ValueError:
        return None


def load_databases(spark: SparkSession, path: str) -> DataFrame:
    """path, ordinal, directory, file, output, arguments of the entries of all compilation databases at path.

    Read and parsed in parallel at byte ranges, from any store; the driver gets
    one row per range and the first entry that cannot be used. Absent, empty,
    malformed and mistyped databases raise IntakeError, each with its own
    message. Arguments win over a command, which is cut as a shell does.
    """
    try:
        found = json_arrays.elements(spark, path)
    except AnalysisException as e:
        raise IntakeError(f"{path}: there is no compilation database") from e
    except json_arrays.NotAnArray as e:
        if kind := _kind(spark, path):
            raise IntakeError(f"{path}: a compilation database is an array of entries, this is {kind}") from e
        raise IntakeError(str(e).replace("the document", "the compilation database")) from e
    entries = written(found.mapInArrow(_parsed, ENTRY))
    bad = entries.where("problem is not null")
    # a file that is not JSON is that first of all
    first = bad.orderBy("path", ~F.col("problem").rlike("^is (not JSON|empty)"), "ordinal").first()
    if first and first.problem == "is empty" and not first.ordinal and not entries.where((F.col("path") == first.path) & (F.col("ordinal") > 0)).limit(1).count():
        raise IntakeError(f"{first.path}: the compilation database has no entries")
    if first:
        raise IntakeError(f"{first.path}: entry {first.ordinal} {first.problem}")
    return entries.withColumn("arguments", F.coalesce("arguments", split_command(F.col("command")))).drop("command", "problem")


def load_entries(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, directory, file, output, arguments of one compilation database; see load_databases."""
    return load_databases(spark, path).drop("path")


def expand_responses(entries: DataFrame, files: DataFrame, max_depth: int = MAX_RESPONSE_DEPTH) -> DataFrame:
    """entries with every @file argument replaced by its arguments, in place, at most max_depth deep.

    files: path, arguments. One join per level; a file that is not known stays
    as it is; a loop or too deep a nest raises.
    """
    rows = entries.select("ordinal", F.posexplode("arguments").alias("p", "a")).select("ordinal", F.array("p").alias("key"), "a")
    known = files.select(F.concat(F.lit("@"), "path").alias("a"), F.col("arguments").alias("more"))
    for level in range(max_depth + 1):
        joined = written(rows.join(known, "a", "left"))
        if not joined.where("more is not null").limit(1).count():
            break
        if level == max_depth:
            raise IntakeError(f"response files nest deeper than {max_depth}")
        opened = joined.where("more is not null").select("ordinal", "key", F.posexplode("more").alias("p", "a")).select("ordinal", F.concat("key", F.array("p")).alias("key"), "a")
        rows = joined.where("more is null").select("ordinal", "key", "a").unionByName(opened)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("key", "a"))), lambda x: x["a"])
    flat = rows.groupBy("ordinal").agg(in_order.alias("arguments"))
    checked = F.when(F.size("arguments") > MAX_ARGUMENTS, F.raise_error(F.lit("a response file expands to too many arguments")).cast("array<string>")).otherwise(F.col("arguments"))
    return entries.drop("arguments").join(flat.withColumn("arguments", checked), "ordinal", "left").withColumn("arguments", F.coalesce("arguments", F.array().cast("array<string>")))


def units(entries: DataFrame, root: str) -> DataFrame:
    """entries with their path inside root (null outside) and the arguments that matter for parsing."""
    return entries.withColumn("path", relative_to(F.col("file"), root, F.col("directory"))).withColumn("parse_arguments", strip_compile_only(F.col("arguments")))


def list_sources(root: str, skip: Sequence[str] = (".git",), headers: bool = False) -> list[str]:
    """Source files below root on the driver's disk, sorted: no skipped or hidden directories, no links."""
    wanted, out = (*SOURCE_LANGUAGE, *(HEADERS if headers else ())), []
    for base, directories, names in os.walk(root):
        directories[:] = sorted(d for d in directories if d not in skip and not d.startswith(".") and not os.path.islink(os.path.join(base, d)))
        out += [os.path.relpath(os.path.join(base, n), root) for n in names if os.path.splitext(n)[1] in wanted and not os.path.islink(os.path.join(base, n))]
    return sorted(out)


def read_files(spark: SparkSession, root: str, paths: Sequence[str] | None = None, max_bytes: int = 2_000_000, exclude: Sequence[str] = ()) -> DataFrame:
    """path, content, size, sha256, starts of the files below root, read once by Spark.

    Files above max_bytes keep a null content; excluded ones are left out.
    Without named paths all that Spark lists is read, from any store; named
    paths are below a root on the driver's disk.
    """
    base = root.rstrip("/") + "/"
    reader = spark.read.format("binaryFile")
    relative = F.regexp_extract("path", ".*" + re.escape(base) + "(.*)$", 1)
    if paths is None:
        found = reader.option("recursiveFileLookup", "true").load(base).withColumn("path", relative)
    else:
        # Spark leaves out empty files and names that begin with _ or .: the driver ships those
        shipped = [p for p in paths if any(x[:1] in "_." for x in p.split("/")) or not os.path.getsize(base + p)]
        made = []
        for p in shipped:
            with open(base + p, "rb") as f:
                data = f.read()
            made.append((p, bytearray(data), len(data)))
        found = spark.createDataFrame(made, "path string, content binary, length long")
        if rest := [base + p for p in paths if p not in set(shipped)]:
            found = found.unionByName(reader.load(rest).select(relative.alias("path"), "content", "length"))
    small = F.col("length") <= max_bytes
    rows = found.select("path", F.when(small, F.col("content")).alias("content"), F.col("length").alias("size"))
    kept = rows.where(~matches_any(F.col("path"), exclude)) if exclude else rows
    return kept.withColumn("sha256", F.sha2("content", 256)).withColumn("starts", line_starts(F.col("content")))
