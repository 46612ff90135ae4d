"""Reproducible archives of any number of members: blocks with known offsets, made and hashed where the members are.

An archive is a tar of its members by name, then a manifest with their hashes,
then the end mark. Where each part goes follows from the sizes before it, a
running sum over ranges of names, so headers, contents and manifest lines are
rows of a table (offset, bytes) that executors write; the driver sees one sum
per range. The table can be checked as it lies. A single file is copied from it
in order, a block at a time. Equal members give equal bytes.
"""

from __future__ import annotations

import hashlib
import tarfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import running_totals
from ..plans.scratch import written

MANIFEST = "MANIFEST.sha256"
BLOCK = 512
#: Bytes of a name at most, by the format.
LONGEST_NAME = 100


class BundleError(ValueError):
    """Members that cannot be bundled, or a bundle that is not whole."""


def unsafe(name: Column) -> Column:
    """Whether a name would leave the folder it is unpacked in, or cannot be written."""
    return F.coalesce((name == "") | name.startswith("/") | name.rlike(r"(^|/)\.\.(/|$)") | name.contains("\\") | name.contains("\n") | (F.octet_length(name) > LONGEST_NAME) | (name == MANIFEST), F.lit(True))


def _header(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT)


def header(name: Column, size: Column) -> Column:
    """The block before a member's content."""

    def run(names: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([_header(n, int(s)) for n, s in zip(names, sizes, strict=True)], dtype=object)

    return F.pandas_udf(run, "binary")(name, size)


def _padding(size: Column) -> Column:
    """Bytes that fill the last block."""
    return F.pmod(-size, F.lit(BLOCK)).cast("int")


def _zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n))


def blocks(members: DataFrame) -> DataFrame:
    """offset, kind, name, sha256, bytes of the archive of members (name, content); a null content is an empty one."""
    spark = members.sparkSession
    rows = members.select("name", F.coalesce("content", F.unhex(F.lit(""))).cast("binary").alias("content"))
    if bad := rows.where(unsafe(F.col("name"))).select("name").first():
        raise BundleError(f"a member cannot be called {bad.name!r}")
    if twice := rows.groupBy("name").count().where("count > 1").first():
        raise BundleError(f"{twice.name} comes twice")
    size = F.octet_length("content").cast("long")
    line = F.concat(F.sha2("content", 256), F.lit("  "), "name", F.lit("\n"))
    narrow = written(rows.select("name", size.alias("size"), line.alias("line")))
    placed, total = running_totals(narrow, ["name"], {"offset": F.col("size") + _padding(F.col("size")) + BLOCK, "at": F.octet_length("line")})
    placed = written(placed)
    files = rows.join(placed, "name").select("offset", F.lit("member").alias("kind"), "name", F.substring("line", 1, 64).alias("sha256"), F.concat(header(F.col("name"), F.col("size")), "content", _zeros(_padding(F.col("size")))).alias("bytes"))
    start = total["offset"] + BLOCK
    lines = placed.select((F.col("at") + start).alias("offset"), F.lit("line").alias("kind"), "name", F.substring("line", 1, 64).alias("sha256"), F.col("line").cast("binary").alias("bytes"))
    ends = [(total["offset"], "manifest", MANIFEST, None, bytearray(_header(MANIFEST, total["at"]))), (start + total["at"], "end", None, None, bytearray(-total["at"] % BLOCK + 2 * BLOCK))]
    return files.unionByName(lines).unionByName(spark.createDataFrame(ends, "offset long, kind string, name string, sha256 string, bytes binary"))


def write_bundle(members: DataFrame, folder: str) -> None:
    """The blocks of an archive as a table in order of their offsets; a folder that is there already is an error."""
    blocks(members).repartitionByRange("offset").sortWithinPartitions("offset").write.parquet(folder)


def verify_blocks(spark: SparkSession, folder: str) -> int:
    """How many members a bundle has, all whole: bytes follow each other without a gap, contents have their hashes, and the manifest has those."""
    table = spark.read.parquet(folder)
    sized = table.select("offset", "kind", "name", F.octet_length("bytes").alias("n"))
    placed, _ = running_totals(sized, ["offset", "n"], {"before": F.col("n")})
    if gap := placed.where("offset <> before").orderBy("offset").first():
        raise BundleError(f"the bytes before {gap.offset} are missing or there twice")
    n = F.conv(F.regexp_replace(F.decode(F.substring("bytes", 125, 12), "US-ASCII"), "[^0-7]", ""), 8, 10).cast("int")
    of_header = F.regexp_replace(F.decode(F.substring("bytes", 1, LONGEST_NAME), "UTF-8"), "\\x00+$", "")
    content = F.sha2(F.substring(F.col("bytes"), F.lit(BLOCK + 1), n), 256)
    files = table.where("kind = 'member'").select("name", of_header.alias("called"), content.alias("found"), "sha256")
    if bad := files.where("found <> sha256 or called <> name").orderBy("name").first():
        raise BundleError(f"{bad.name} is damaged")
    lines = table.where("kind = 'line'").select(F.regexp_extract(F.decode("bytes", "UTF-8"), "^([0-9a-f]{64})  ", 1).alias("listed"), F.regexp_extract(F.decode("bytes", "UTF-8"), "^[0-9a-f]{64}  (.*)\n$", 1).alias("name"))
    both = files.join(lines, "name", "full_outer").where("found is null or listed is null or found <> listed")
    if bad := both.orderBy("name").first():
        raise BundleError(f"{bad.name} and the manifest differ")
    if table.where("kind in ('manifest', 'end')").count() != 2:
        raise BundleError("the manifest or the end is missing")
    return files.count()


def export_bundle(spark: SparkSession, folder: str, path: str) -> str:
    """Copy a bundle to one file, in order, a block at a time; the sha256 of the file. Nothing is held but a partition of blocks."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, False)
    whole = hashlib.sha256()
    try:
        for r in spark.read.parquet(folder).select("offset", "bytes").orderBy("offset").toLocalIterator():
            whole.update(r.bytes)
            out.write(r.bytes)
    finally:
        out.close()
    return whole.hexdigest()


def verify_tar(path: str) -> dict[str, str]:
    """The hashes of an exported file's members, checked against its manifest member by member, in memory for one of them."""
    found: dict[str, str] = {}
    listed = None
    try:
        with tarfile.open(path, "r|") as tar:
            for info in tar:
                name, data = info.name, tar.extractfile(info)
                if name in found or listed is not None:
                    raise BundleError(f"{name} comes twice or after the manifest")
                if name.startswith("/") or ".." in name.split("/") or data is None:
                    raise BundleError(f"a member cannot be called {name!r}")
                if name == MANIFEST:
                    listed = dict(line.decode().rstrip("\n").split("  ", 1)[::-1] for line in iter(data.readline, b""))
                else:
                    found[name] = hashlib.file_digest(data, "sha256").hexdigest()
    except (tarfile.TarError, ValueError) as e:
        raise e if isinstance(e, BundleError) else BundleError(f"{path} is no whole archive: {e}") from e
    if found != listed:
        raise BundleError(f"members differ from the manifest: {sorted(set(found.items()) ^ set((listed or {}).items()))[:5]}")
    return found
