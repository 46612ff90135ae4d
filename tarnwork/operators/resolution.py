"""Resolving citations against scanned files, symbols and call edges: one ladder of checks per citation.

Contents stay on the files' side: a citation is joined to its file once, by
path, after everything that needs no file has been decided.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import canonical_path, matching_glob
from ..functions.ranks import review_reason
from ..functions.regions import line_to_bytes, slice_bytes
from ..plans.scratch import written
from .intervals import overlapping

#: Rows citing one place beyond which it is broadcast: there is one such place in as many rows at most.
HOT = 10_000


def range_problem() -> Column:
    """What is wrong with a citation's own numbers, in order; null if nothing."""
    sl, el, sb, eb = (F.col(c) for c in ("start_line", "end_line", "start_byte", "end_byte"))
    return (
        F.when(sl.isNotNull() & (sl < 1) | el.isNotNull() & (el < 1), "line numbers start at 1")
        .when(sl.isNotNull() & el.isNotNull() & (el < sl), "the last line is before the first")
        .when(sb.isNotNull() & (sb < 0) | eb.isNotNull() & (eb < 0), "byte offsets start at 0")
        .when(sb.isNotNull() & eb.isNotNull() & (eb < sb), "the last byte is before the first")
    )


def with_issued(citations: DataFrame, issued: DataFrame) -> DataFrame:
    """citations with the region of their evidence id where they name one, and whether it was issued.

    issued: evidence_id, path, start_line, end_line, start_byte, end_byte, sha256.
    """
    cols = ["path", "start_line", "end_line", "start_byte", "end_byte", "sha256"]
    known = issued.select("evidence_id", F.lit(True).alias("issued"), *[F.col(c).alias(f"__{c}") for c in cols])
    joined = citations.join(known, "evidence_id", "left")
    by_id = F.col("evidence_id").isNotNull() & F.col("issued").isNotNull()
    for c in cols:
        joined = joined.withColumn(c, F.when(by_id, F.col(f"__{c}")).otherwise(F.col(c))).drop(f"__{c}")
    return joined


def resolve(citations: DataFrame, files: DataFrame, exclude: Sequence[str] = (), max_bytes: int = 2_000_000) -> DataFrame:
    """citations with status: the first check that fails, else ok.

    citations: citation_id, evidence_id, issued, path, lines, bytes, sha256;
    files: path, size, starts (line offsets), content. The order is: id
    issued, path given, inside the root, numbers, filter, presence, size,
    lines, bytes, hash. Where files have a case_id, a citation is resolved
    against the files of its own case; a path that has two files raises.
    """
    by_case = "case_id" in files.columns
    case = [F.col("case_id").alias("__case")] if by_case else []
    key = [*(["__case"] if by_case else []), "__path"]
    f = files.select(*case, F.col("path").alias("__path"), F.col("size").alias("__size"), F.col("starts").alias("__starts"), F.col("content").alias("__content"))
    twice = f.groupBy(*key).agg(F.count(F.lit(1)).alias("__files")).where("__files > 1")
    f = f.join(twice, key, "left")
    clean = citations.withColumn("__clean", canonical_path(F.col("path")))
    same = F.col("__clean") == F.col("__path")
    joined = clean.join(f, same & (F.col("case_id") == F.col("__case")) if by_case else same, "left")
    first = F.coalesce("start_line", F.lit(1))
    last = F.coalesce("end_line", first)
    span = line_to_bytes(F.col("__starts"), F.col("__size").cast("long"), first, last)
    begin, end = F.coalesce("start_byte", span["start"]), F.coalesce("end_byte", span["end"])
    seen = F.sha2(slice_bytes(F.col("__content"), begin, end), 256)
    status = (
        F.when(F.col("__files") > 1, F.raise_error(F.concat(F.lit("two files are called "), F.col("__path"))).cast("string"))
        .when(F.col("evidence_id").isNotNull() & F.col("issued").isNull(), "unknown_evidence_id")
        .when(F.col("path").isNull(), "byte_range_invalid")
        .when(F.col("__clean").isNull(), "outside_repo_root")
        .when(range_problem().isNotNull(), "byte_range_invalid")
        .when(matching_glob(F.col("__clean"), exclude).isNotNull(), "excluded_file")
        .when(F.col("__path").isNull(), "missing_file")
        .when(F.col("__size") > max_bytes, "file_too_large")
        .when(last > F.size("__starts"), "line_out_of_range")
        .when(end > F.col("__size"), "byte_range_invalid")
        .when(F.col("sha256").isNotNull() & (F.lower("sha256") != seen), "hash_mismatch")
        .otherwise("ok")
    )
    return joined.withColumn("status", status).drop("__path", "__size", "__starts", "__content", "__clean", "__files", "__case")


def check_symbols(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """resolved with the status of those that name a symbol: known, and in the cited lines.

    symbols: name, usr, path, start_line, end_line (one row per region).
    """
    wanted = resolved.where("status = 'ok' and symbol is not null")
    # places and regions once each, whoever cites or declares them
    place = ["symbol", "path", "start_line", "__last"]
    places = written(wanted.withColumn("__last", F.coalesce("end_line", "start_line")).groupBy(*place).agg(F.count(F.lit(1)).alias("__n")))
    regions = symbols.select(F.explode(F.array("name", "usr")).alias("symbol"), "path", F.col("start_line").alias("__s"), F.col("end_line").alias("__e")).distinct()
    met = overlapping(places, regions, ["symbol", "path"], ("start_line", "__last"), ("__s", "__e")).select(*place, "__n").distinct().withColumn("__here", F.lit(True))
    # places that many rows cite are broadcast, known or not: their rows, and those that ask for nothing, are dealt out and meet nothing
    hot = F.broadcast(places.where(F.col("__n") > HOT).join(met.drop("__n"), place, "left").select(*place, F.coalesce("__here", F.lit(False)).alias("__hot")))
    cold = met.where(F.col("__n") <= HOT).select(*place, "__here", F.lit(0).cast("long").alias("__salt")).hint("merge")
    asks = (F.col("status") == "ok") & F.col("symbol").isNotNull()
    dealt = F.when(F.coalesce(asks, F.lit(False)) & F.col("__hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("citation_id"), F.lit(997)) + 1).cast("long")
    joined = resolved.withColumn("__last", F.coalesce("end_line", "start_line")).join(hot, place, "left").withColumn("__salt", dealt).join(cold, [*place, "__salt"], "left")
    absent = asks & ~F.coalesce("__here", "__hot", F.lit(False))
    return joined.withColumn("status", F.when(absent, "symbol_not_found").otherwise(F.col("status"))).select(*resolved.columns)


def check_edges(claims: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """claims (citation_id, caller, callee) with status and why: an unknown name and a missing edge differ.

    Names stand for all symbols of that name; an id (c:...) for itself.
    """
    ids = symbols.select(F.explode(F.array("name", "usr")).alias("name"), "usr").distinct()
    side = lambda c: claims.select("citation_id", F.col(c).alias("name")).join(ids, "name", "left").select("citation_id", F.col("usr").alias(f"__{c}"))
    callers, callees = side("caller"), side("callee")
    known = callers.groupBy("citation_id").agg(F.count("__caller").alias("__n_callers")).join(callees.groupBy("citation_id").agg(F.count("__callee").alias("__n_callees")), "citation_id")
    real = edges.where("callee is not null").select(F.col("caller").alias("__caller"), F.col("callee").alias("__callee")).distinct()
    hit = callers.join(real, "__caller").join(callees, ["citation_id", "__callee"]).select("citation_id", F.lit(True).alias("__hit")).distinct()
    joined = claims.join(known, "citation_id", "left").join(hit, "citation_id", "left")
    why = F.when(F.col("__hit"), F.lit(None)).when((F.col("__n_callers") == 0) | (F.col("__n_callees") == 0), "unknown_name").otherwise("missing_edge")
    return joined.withColumn("status", F.when(F.col("__hit"), "ok").otherwise("symbol_not_found")).withColumn("why", why.cast("string")).drop("__n_callers", "__n_callees", "__hit")


def first_failures(resolved: DataFrame, key: str, place: str) -> DataFrame:
    """key, status of the first failing citation of each key."""
    return resolved.where("status <> 'ok'").groupBy(key).agg(F.min_by("status", place).alias("status"))


def location_failures(resolved: DataFrame) -> DataFrame:
    """subject, reason of citations that failed."""
    has_edge = F.col("caller").isNotNull() & F.col("callee").isNotNull() if {"caller", "callee"} <= set(resolved.columns) else F.lit(False)
    return resolved.where("status <> 'ok'").select("citation_id", review_reason(F.col("status"), has_edge).alias("reason"))
