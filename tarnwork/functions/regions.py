"""Regions of source files: lines, bytes, hashes and containment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def line_starts(content: Column) -> Column:
    """Byte offsets of line starts; a closing line end adds none, an empty file has one line."""

    def one(data: bytes | None) -> list[int] | None:
        if data is None:
            return None
        ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
        return [0, *ends[ends < len(data)].tolist()]

    def run(contents: pd.Series) -> pd.Series:
        return contents.map(one)

    return F.pandas_udf(run, "array<long>")(content)


def text_line_starts(text: Column) -> Column:
    """line_starts of a text's UTF-8: only the lengths of its lines go to Python, whatever it holds."""

    def one(lengths: np.ndarray | None) -> list[int] | None:
        if lengths is None:
            return None
        ends = np.cumsum(lengths.astype("int64") + 1)
        return [0, *ends[:-1][ends[:-1] < ends[-1] - 1].tolist()]

    def run(lengths: pd.Series) -> pd.Series:
        return lengths.map(one)

    return F.pandas_udf(run, "array<long>")(F.transform(F.split(text, "\n"), lambda line: F.octet_length(line)))


def line_to_bytes(starts: Column, size: Column, first: Column, last: Column) -> Column:
    """struct(start, end) of lines first..last, half open; null outside the file."""
    inside = (first >= 1) & (last >= first) & (last <= F.size(starts))
    return F.when(inside, F.struct(F.get(starts, first - 1).alias("start"), F.coalesce(F.get(starts, last), size).alias("end")))


def byte_to_line(starts: Column, offset: Column) -> Column:
    return F.size(F.filter(starts, lambda s: s <= offset))


def slice_bytes(content: Column, start: Column, end: Column) -> Column:
    """The bytes of a region, never cut short: null if the file ends before it."""
    return F.when((start >= 0) & (end >= start) & (end <= F.octet_length(content)), F.substring(content, (start + 1).cast("int"), (end - start).cast("int")))


def make_region(path: Column, content: Column, starts: Column, first: Column, last: Column) -> Column:
    """The hashed region of a span of lines; null outside the file."""
    span = line_to_bytes(starts, F.octet_length(content).cast("long"), first, last)
    return F.when(
        span.isNotNull(),
        F.struct(
            path.alias("path"), first.cast("int").alias("start_line"), last.cast("int").alias("end_line"), span["start"].alias("start_byte"), span["end"].alias("end_byte"),
            F.sha2(slice_bytes(content, span["start"], span["end"]), 256).alias("sha256"),
        ),
    )


def window(line: Column, before: int, after: int, lines: Column) -> Column:
    """struct(first, last): the lines around one, kept inside the file."""
    return F.struct(F.greatest(F.lit(1), line - before).alias("first"), F.least(lines, line + after).alias("last"))


def contains(outer_start: Column, outer_end: Column, inner_start: Column, inner_end: Column) -> Column:
    return (outer_start <= inner_start) & (inner_end <= outer_end)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def line_distance(line: Column, start: Column, end: Column) -> Column:
    """Distance of a line to a range of lines, 0 inside."""
    return F.greatest(start - line, line - end, F.lit(0))


def on_flow_path(region: Column, flow: Column) -> Column:
    """Whether a step of the flow (array of regions) lies inside the region."""
    return F.exists(flow, lambda s: (s["path"] == region["path"]) & contains(region["start_byte"], region["end_byte"], s["start_byte"], s["end_byte"]))


def count_code_lines(text: Column) -> Column:
    """Lines that are not blank and not only comment, block comments followed across lines."""
    lines = F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.trim(x))
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("block"))

    def step(s: Column, line: Column) -> Column:
        closes, opens = F.contains(line, F.lit("*/")), line.startswith("/*")
        code = ~s["block"] & (line != "") & ~line.startswith("//") & ~opens
        return F.struct((s["n"] + code.cast("int")).alias("n"), F.when(s["block"], ~closes).otherwise(opens & ~closes).alias("block"))

    return F.aggregate(lines, start, step, lambda s: s["n"].cast("long"))


def cited_text(chunks: Column) -> Column:
    """Cited byte chunks, in order, as one text; what is not UTF-8 replaced."""
    return F.array_join(F.transform(chunks, lambda c: F.make_valid_utf8(c.cast("string"))), "\n")
