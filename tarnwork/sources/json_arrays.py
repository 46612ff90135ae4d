"""Elements of JSON arrays of any size, cut on executors at byte ranges.

Spark's text reader deals a file out by byte ranges, here in pieces that end at
a closing brace. What a range means depends on all before it: whether it starts
inside a string, and at what depth. Both compose, so two passes do:

1. Each range gives, for a start outside and a start inside a string, where it
   ends and by how much the depth changes. One row per range goes to the driver,
   which adds them up in order.
2. Each range, now with its start known, is cut at the commas of depth one. What
   lies whole within a range is an element; the ends of ranges are joined by
   the number of their element, the commas before it.

Files are read through Spark, so they may lie in any store; a path may match
several files, each an array of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import written

CUT = "}"
#: A whole string, or a character that counts outside of strings.
TOKEN = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"|["\[\]{},]', re.S)
STRING = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
END_OF_STRING = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
RANGE = "path string, start long, pieces long, bytes long, size long, out_inside boolean, out_depth long, in_inside boolean, in_depth long"
PART = "path string, start long, local long, edge boolean, text binary, commas long, opened long, problem string"


class NotAnArray(ValueError):
    """What is wrong with a document, and in which file."""


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """path, start of the range, size of the file and bytes of each piece, in file order within a range."""
    read = spark.read.option("lineSep", CUT).option("recursiveFileLookup", "true").text(path)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def _ranges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)


def advance(inside: bool, data: bytes) -> tuple[bool, int]:
    """Whether data ends inside a string, and the change of depth, after a start inside or outside of one."""
    if inside:
        m = END_OF_STRING.match(data)
        if not m:
            return True, 0
        data = data[m.end() :]
    bare = STRING.sub(b"", data)
    open_at = bare.find(b'"')
    if open_at >= 0:
        bare = bare[:open_at]
    return open_at >= 0, bare.count(b"{") + bare.count(b"[") - bare.count(b"}") - bare.count(b"]")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], list] = {}
    for path, start, size, value in _ranges_of(batches):
        row = found.setdefault((path, start), [0, 0, size, False, 0, True, 0])
        row[0] += 1
        row[1] += len(value)
        for at in (3, 5):
            row[at], change = advance(row[at], value + b"}")
            row[at + 1] += change
    columns = list(zip(*((*k, *v) for k, v in found.items()), strict=True)) or [()] * 9
    kinds = [pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in RANGE.split(", ")])


def cut(pieces: list[bytes] | Iterator[bytes], inside: bool, depth: int) -> Iterator[tuple[int, bool, bytes | None, int, int, str | None]]:
    """The elements of a range from its state at the start: local number, whether the range's end cuts it, text.

    The last line has no text: the commas of the range, the arrays that begin in it, and what is wrong with it.
    """
    local, parts, problem, opened = 0, [], None, 0
    for data in pieces:
        start = at = 0
        if inside:
            m = END_OF_STRING.match(data)
            if not m:
                parts.append(data)
                continue
            inside, at = False, m.end()
        for m in TOKEN.finditer(data, at):
            c = m[0]
            if c == b'"':
                inside = True
                break
            if len(c) > 1:
                problem = problem or ("text around the array" if not depth else None)
                continue
            if c in b"[{":
                if not depth:
                    opened += 1
                    problem = problem or ("text around the array" if data[start : m.start()].strip() or c != b"[" else None)
                    start = m.end()
                depth += 1
            elif c in b"]}":
                depth -= 1
                if not depth:
                    parts.append(data[start : m.start()])
                    yield local, True, b"".join(parts), 0, 0, None
                    parts, start = [], m.end()
                    problem = problem or ("an array closed by a brace" if c != b"]" else None)
                elif depth < 0:
                    problem, depth = problem or "a bracket closed that was not open", 0
            elif depth == 1:
                parts.append(data[start : m.start()])
                yield local, local == 0, b"".join(parts), 0, 0, None
                local, parts, start = local + 1, [], m.end()
            elif not depth:
                problem = problem or "text around the array"
        if depth:
            parts.append(data[start:])
        elif data[start:].strip():
            problem = problem or "text around the array"
    if depth:
        yield local, True, b"".join(parts), 0, 0, None
    yield -1, False, None, local, opened, problem


def _cutter(starts: dict[tuple[str, int], tuple[bool, int, int, bool]]):
    """starts: of each range whether it starts inside a string, its depth, its pieces, and whether its last piece ends the file without a brace."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*held, strict=True)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in PART.split(", ")])
            held.clear()
            return out

        rows = _ranges_of(batches)
        row = next(rows, None)
        while row is not None:
            key = row[0], row[1]
            inside, depth, pieces, bare = starts[key]

            def own() -> Iterator[bytes]:
                nonlocal row
                n = 0
                while row is not None and (row[0], row[1]) == key:  # noqa: B023
                    n += 1
                    yield row[3] + (b"" if bare and n == pieces else b"}")  # noqa: B023
                    row = next(rows, None)

            for part in cut(own(), inside, depth):
                held.append((*key, *part))
                weight += len(part[2] or b"") + 100
                if weight > 4_000_000:
                    yield batch()
                    weight = 0
        if held:
            yield batch()

    return run


def elements(spark: SparkSession, path: str) -> DataFrame:
    """path, ordinal and text (bytes) of each element of the arrays at path, in no order.

    NotAnArray is raised where a file is empty, is no array, is cut short, or
    has more than the array. Elements are told apart, not yet parsed.
    """
    pieces = _pieces(spark, path)
    by_file: dict[str, list] = {}
    # one row per range
    for r in pieces.mapInArrow(_summaries, RANGE).collect():
        by_file.setdefault(r.path, []).append(r)
    starts: dict[tuple[str, int], tuple[bool, int, int, bool]] = {}
    for file, ranges in by_file.items():
        ranges.sort(key=lambda r: r.start)
        # braces that the reader took away: one for each piece but perhaps the last
        bare = ranges[0].size - sum(r.bytes for r in ranges) < sum(r.pieces for r in ranges)
        inside, depth = False, 0
        for r in ranges:
            starts[file, r.start] = (inside, depth, r.pieces, bare and r is ranges[-1])
            inside, depth = (r.in_inside, depth + r.in_depth) if inside else (r.out_inside, depth + r.out_depth)
        # the summaries close a brace for each piece
        if inside or depth + bare > 0:
            raise NotAnArray(f"{file}: not JSON: it ends inside {'a string' if inside else 'an array or object'}")
    if not starts:
        raise NotAnArray(f"{path}: the document is empty")
    parts = written(pieces.mapInArrow(_cutter(starts), PART))
    ends = sorted(parts.where("local = -1").select("path", "start", "commas", "opened", "problem").collect())
    offsets, before, arrays = [], dict.fromkeys(by_file, 0), dict.fromkeys(by_file, 0)
    for file, start, commas, opened, problem in ends:
        if problem:
            raise NotAnArray(f"{file}: not JSON: {problem}")
        offsets.append((file, start, before[file]))
        before[file] += commas
        arrays[file] += opened
    for file, n in arrays.items():
        if n != 1:
            raise NotAnArray(f"{file}: not JSON: a second array" if n else f"{file}: the document is empty")
    # one row per range
    offset = F.broadcast(spark.createDataFrame(offsets, "path string, start long, before long"))
    numbered = parts.where("local >= 0").join(offset, ["path", "start"]).select("path", "start", (F.col("before") + F.col("local")).alias("ordinal"), "edge", "text")
    spanning = numbered.where("edge").groupBy("path", "ordinal").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
    joined = spanning.select("path", "ordinal", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["text"])).alias("text"))
    return numbered.where("not edge").select("path", "ordinal", "text").unionByName(joined)
