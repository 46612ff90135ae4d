"""Mixing sources to target weights, with DataFrame functions only.

Tokens are aggregated per source, a repetition rate is derived for each
source, and each document is emitted floor(rate) times plus one more time with
the fraction of the rate as probability, by a hash of its id and text. Draws
of a source are not independent, as a few very large documents would then take
its sum far from the target: the documents of one size class (powers of two)
that are taken once more are those of the smallest hashes, and their number is
the fraction of the class, rounded up or down by a running sum over the classes
that starts at a hash of the source. So over seeds every document has exactly
the fraction, and the words taken come near the target. Which hash is the last
one taken in a class is found by counts per leading digits of the hashes, and a
sort of the one set of digits that holds it; a rerun, a lost executor or another
partitioning gives the same copies.

Targets come from rounds of aggregates over one row per source: shares go by
weight, sources whose share is above their cap stop there, and the rest is
shared again until none does. No window and no sort holds all sources in a
task, and no documents of one source ever meet.

Defined cases: a null text has size 0; a null source is a source of its own,
ordered last; documents of size 0 are emitted floor(rate) times (a source
without tokens has rate 0); rows of one id, or of none, draw apart by their
texts; rows equal in id and text draw apart by their place in the scan, so that
a source of repeated rows comes near its target too (which of them are taken
then depends on how the table is cut into files; nothing else does); an empty
table gives an empty result; other columns are kept by ``mix`` and not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, OWN, join_counted, materialize

TOKEN = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_RATE = 3
#: Leading digits of a draw by which draws of a class are counted.
DIGITS = 3
#: Rows of the per-source table up to which it is broadcast; beyond, only sources of many rows are.
BROADCAST_SOURCES = 10_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def _ranked(per_source: DataFrame) -> DataFrame:
    """per_source with its place (from 0) by code point of source, nulls last: ranges are sorted apart and counted."""
    spark = per_source.sparkSession
    named = per_source.where("source is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(named.repartitionByRange(parts, "source").select("*", F.spark_partition_id().alias("part")))
    sizes = sorted(map(tuple, ranged.groupBy("part").count().collect()))
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    # one row per partition
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("source"))
    placed = ranged.withColumn("within", within).join(offsets, "part").select(*per_source.columns, (F.col("start") + F.col("within") - 1).alias("place"))
    return placed.unionByName(per_source.where("source is null").withColumn("place", F.lit(total).cast("long")))


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """Target per source from rows (source, size): source, source_size, n_docs, target.

    Shares go by weight; a target stops at max_rate times its source's size
    and the excess is shared again. Each round is one aggregate; the number of
    stopped sources only grows, and rounds end when it does not.
    """
    wide = "decimal(38,0)"
    per_source = materialize(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    caps = materialize(_ranked(per_source).select("source", "source_size", "n_docs", weight.cast(wide).alias("w"), (F.col("source_size") * max_rate).cast(wide).alias("cap")))
    left, w_left, stopped = None, None, -1
    while True:
        # stopped: the cap is below the share at the level of the round before
        stops = F.lit(False) if left is None else F.col("cap") * F.lit(w_left).cast(wide) < F.col("w") * F.lit(left).cast(wide)
        kept = lambda c: F.sum(F.when(~stops, F.col(c)).otherwise(F.lit(0).cast(wide)))  # noqa: B023, E731
        capped = F.sum(F.when(stops, F.col("cap")).otherwise(F.lit(0).cast(wide)))
        total, w, spent, n = caps.agg(F.sum("source_size"), kept("w"), capped, F.count_if(stops)).first()
        if not total or n == stopped:
            break
        left, w_left, stopped = int(total) - int(spent), int(w), n
    if left is None:
        return caps.select("source", "source_size", "n_docs", F.lit(0.0).alias("target"))
    stops = F.col("cap") * F.lit(w_left).cast(wide) < F.col("w") * F.lit(left).cast(wide)
    shared = (F.col("w") * F.lit(left).cast(wide)).cast("double") / F.lit(float(w_left))
    return caps.select("source", "source_size", "n_docs", F.when(stops, F.col("cap").cast("double")).otherwise(shared).alias("target"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with what each row draws by: a digest of its id and text; and, where others have the same, its place in the scan."""
    return docs.withColumns({f"{OWN}key": key_of(F.col("doc_id"), F.col("text")), f"{OWN}place": F.monotonically_increasing_id()})


def key_of(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def draw(key: Column, seed: int = 0) -> Column:
    """What a key draws: 32 digits, of which the smallest win."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def size_class(size: Column) -> Column:
    """Number of binary digits of a size."""
    return F.length(F.bin(size))


def rates(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE, seed: int = 0) -> DataFrame:
    """source, source_size, n_docs, target, whole, last from rows (source, size, draw).

    whole is the number of copies that all documents get; a document gets one
    more if its draw is not beyond the last one of its size class, last[class].
    """
    targets = source_targets(sized, weights, max_rate)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    rated = materialize(targets.select("*", F.floor(rate).alias("whole"), (rate - F.floor(rate).cast("double")).alias("fraction")))
    rows = sized.select("source", size_class(F.col("size")).alias("class"), F.col(f"{OWN}draw").alias("draw"), F.substring(f"{OWN}draw", 1, DIGITS).alias("digits"))
    counted = rows.groupBy("source", "class", "digits").agg(F.count(F.lit(1)).alias("n"))
    # at most 16 ** DIGITS sets of digits for a class, at most 64 classes for a source
    by_class = counted.groupBy("source", "class").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("digits", "n"))).alias("cells"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy(F.desc("class")))
    side = rated.select(F.col("source").alias(f"{OWN}source"), "fraction")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    reached = lambda n: F.floor(n.cast("double") * F.col("fraction") + start)
    sized_classes = by_class.withColumn("upto", upto).join(side, F.col("source").eqNullSafe(F.col(f"{OWN}source")))
    wanted = sized_classes.select("source", "class", "cells", (reached(F.col("upto")) - reached(F.col("upto") - F.col("n"))).alias("m")).where("m > 0")
    none = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("string").alias("digits"))
    step = lambda s, c: F.when(s["digits"].isNotNull(), s).otherwise(F.struct(F.when(s["before"] + c["n"] < F.col("m"), s["before"] + c["n"]).otherwise(s["before"]).alias("before"), F.when(s["before"] + c["n"] >= F.col("m"), c["digits"]).alias("digits")))
    at = wanted.withColumn("at", F.aggregate("cells", none, step)).select(F.col("source").alias(f"{OWN}source"), F.col("class").alias(f"{OWN}class"), F.col("at.digits").alias(f"{OWN}digits"), (F.col("m") - F.col("at.before")).alias("rank"))
    same = F.col("source").eqNullSafe(F.col(f"{OWN}source")) & (F.col("class") == F.col(f"{OWN}class")) & (F.col("digits") == F.col(f"{OWN}digits"))
    order = F.row_number().over(Window.partitionBy("source", "class").orderBy("draw"))
    ends = rows.join(at, same).withColumn("k", order).where("k = rank")
    last = ends.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("class", "draw"))).alias("last")).withColumnRenamed("source", f"{OWN}source")
    return rated.join(last, F.col("source").eqNullSafe(F.col(f"{OWN}source")), "left").select("source", "source_size", "n_docs", "target", "whole", F.coalesce("last", F.create_map().cast("map<int,string>")).alias("last"))


def with_rates(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (with source) and the line of found for their source; found is one row per source.

    Beyond BROADCAST_SOURCES sources, those of the hot ones are broadcast, and
    the rows of the others are shuffled by source.
    """
    found = materialize(found)
    side = found.select(*[F.col(c).alias(f"{OWN}{c}") for c in found.columns])
    same = F.col("source").eqNullSafe(F.col(f"{OWN}source"))
    sources, n = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    if sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(side), same)
    return join_counted(rows, side, same, F.col(f"{OWN}n_docs"), n)


def copies(size: Column) -> Column:
    """How often a document is taken, beside its draw and the columns of with_rates."""
    more = F.coalesce(F.col(f"{OWN}draw") <= F.col(f"{OWN}last")[size_class(size)], F.lit(False))
    return (F.col(f"{OWN}whole") + more.cast("long")).cast("long")


def repeats(rows: DataFrame) -> DataFrame | None:
    """The keys of two rows or more, with their number of rows; None where there are none."""
    found = materialize(rows.groupBy(f"{OWN}key").agg(F.count(F.lit(1)).alias(f"{OWN}n")).where(f"{OWN}n > 1"))
    return None if found.isEmpty() else found


def with_draws(rows: DataFrame, again: DataFrame | None, seed: int) -> DataFrame:
    """rows (of keyed) with their draw instead of key and place; rows whose key is among again draw by their place too."""
    key, columns = F.col(f"{OWN}key"), [c for c in rows.columns if c not in (f"{OWN}key", f"{OWN}place")]
    if again is None:
        return rows.select(*columns, draw(key, seed).alias(f"{OWN}draw"))
    keys, total = again.agg(F.count(F.lit(1)), F.sum(f"{OWN}n")).first()
    marked = again.select(F.col(f"{OWN}key").alias(f"{OWN}again"), f"{OWN}n")
    same = key == F.col(f"{OWN}again")
    if keys <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(marked), same, "left")
    else:
        hot = F.col(f"{OWN}n") > total / HOT_SHARE
        often = F.broadcast(marked.where(hot))
        joined = rows.join(often, same).unionByName(rows.join(often, same, "left_anti").join(marked.where(~hot), same, "left"))
    apart = F.concat(key, F.lit(":"), F.col(f"{OWN}place").cast("string"))
    return joined.select(*columns, draw(F.when(F.col(f"{OWN}again").isNull(), key).otherwise(apart), seed).alias(f"{OWN}draw"))


def _sized(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, source, size, draw of each row, and the keys that repeat."""
    rows = materialize(keyed(docs).select("doc_id", "source", token_count(F.col("text")).alias("size"), f"{OWN}key", f"{OWN}place"))
    again = repeats(rows)
    return materialize(with_draws(rows, again, seed)), again


def mix_report(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE, seed: int = 0) -> DataFrame:
    """What the mix takes, one row per row of docs: doc_id, size, source_size, target, copies, taken."""
    sized, _ = _sized(docs, seed)
    joined = with_rates(sized, rates(sized, weights, max_rate, seed))
    return joined.select("doc_id", "size", F.col(f"{OWN}source_size").alias("source_size"), F.col(f"{OWN}target").alias("target"), copies(F.col("size")).alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE, seed: int = 0) -> DataFrame:
    """The mixed documents: each row of docs, all its columns, as often as it is taken."""
    sized, again = _sized(docs, seed)
    drawn = with_draws(keyed(docs), again, seed)
    times = copies(token_count(F.col("text")))
    repeated = F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<bigint>")))
    return with_rates(drawn, rates(sized, weights, max_rate, seed)).withColumn(f"{OWN}copy", repeated).select(*docs.columns)


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key FROM documents
), drawn AS (
  SELECT *, length(bin(size)) AS class, md5('0:' || key) AS draw FROM sized
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), caps AS (
  SELECT *, CAST([5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS HUGEINT) AS w,
         (3 * source_size)::HUGEINT AS cap FROM per_source
), level AS (
  SELECT *, sum(source_size) OVER ()::HUGEINT - (sum(cap) OVER o - cap) AS lft, sum(w) OVER () - (sum(w) OVER o - w) AS w_left,
         row_number() OVER o AS rnk
  FROM caps WINDOW o AS (ORDER BY cap::DOUBLE / w::DOUBLE, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)
), f AS (
  SELECT rnk, lft, w_left FROM level WHERE lft * w <= cap * w_left ORDER BY rnk LIMIT 1
), targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN l.rnk < f.rnk THEN l.cap::DOUBLE ELSE (l.w * f.lft)::DOUBLE / f.w_left::DOUBLE END AS target
  FROM level l, f
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('0:' || coalesce('=' || source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE AS start FROM targets
), classes AS (
  SELECT source, class, count(*) AS n, sum(count(*)) OVER (PARTITION BY source ORDER BY class DESC) AS upto FROM drawn GROUP BY source, class
), more AS (
  SELECT c.source, c.class, r.source_size, r.target, floor(r.rate)::BIGINT AS whole,
         floor(c.upto::DOUBLE * (r.rate - floor(r.rate)) + r.start) - floor((c.upto - c.n)::DOUBLE * (r.rate - floor(r.rate)) + r.start) AS m
  FROM classes c JOIN rated r ON c.source IS NOT DISTINCT FROM r.source
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source, class ORDER BY draw) AS k FROM drawn
)
SELECT d.doc_id, d.size, m.source_size, m.target, (d.size * (m.whole + (d.k <= m.m)::BIGINT))::BIGINT AS taken
FROM ranked d JOIN more m ON m.source IS NOT DISTINCT FROM d.source AND m.class = d.class
"""


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the whole documents table, mixed."""
    from .common import table

    return mix_report(table(spark, sf_dir, "documents")).drop("copies")
