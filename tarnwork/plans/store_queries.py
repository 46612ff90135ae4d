"""Queries of what is kept between runs: databases read by ranges, the index store, traces, accounts and resumed stages."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.regions import text_line_starts
from ..operators import accounts
from ..sinks import bundles
from ..sinks.journal import Journal, identity_of
from ..sinks.store import TableStore
from ..sources import builds, diagnostics
from ..streaming import trace
from .registry import query, t
from .scratch import scratch_folder


def folder(df: DataFrame) -> str:
    """A new folder among the intermediate tables; it goes when the session's JVM ends."""
    spark, path = df.sparkSession, f"{scratch_folder(df)}/tarnwork-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


# --- compilation databases ----------------------------------------------------


@query(
    "database_entries",
    """
    SELECT doc_id % 8 AS database, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) - 1 AS ordinal,
           '/r/' || source AS directory, 'f' || doc_id || '}.c' AS file,
           CASE WHEN doc_id % 2 = 0 THEN 'cc|-DNAME="]' || lang || '[{,"|-c' ELSE 'cc|-c|f' || doc_id || '.c' END AS argv
    FROM documents
    """,
)
def database_entries(s: SparkSession, d: str) -> DataFrame:
    """The documents as entries of eight compilation databases, each one JSON array, written and read back."""
    docs = t(s, d, "documents")
    out = folder(docs)
    even = F.col("doc_id") % 2 == 0
    argv = F.when(even, F.array(F.lit("cc"), F.concat(F.lit('-DNAME="]'), "lang", F.lit('[{,"')), F.lit("-c")))
    command = F.when(~even, F.concat(F.lit("cc -c 'f"), F.col("doc_id"), F.lit(".c'")))
    entry = F.to_json(F.struct(F.concat(F.lit("/r/"), "source").alias("directory"), F.concat(F.lit("f"), "doc_id", F.lit("}.c")).alias("file"), argv.alias("arguments"), command.alias("command")))
    w = Window.partitionBy("b").orderBy("doc_id")
    rows = docs.select((F.col("doc_id") % 8).alias("b"), "doc_id", entry.alias("entry")).withColumns({"k": F.row_number().over(w), "next": F.lead("doc_id").over(w)})
    line = F.concat(F.when(F.col("k") == 1, "[").otherwise(","), "entry", F.when(F.col("next").isNull(), "]").otherwise(""))
    rows.select("b", "doc_id", line.alias("value")).repartition("b").sortWithinPartitions("b", "doc_id").drop("doc_id").write.partitionBy("b").text(f"{out}/db")
    found = builds.load_databases(s, f"{out}/db")
    return found.select(F.regexp_extract("path", "/b=([0-9]+)/", 1).cast("long").alias("database"), "ordinal", "directory", "file", F.array_join("arguments", "|").alias("argv"))


# --- the index store ----------------------------------------------------------


def _facts(docs: DataFrame, changed: Callable[[DataFrame], DataFrame] = lambda x: x) -> tuple[DataFrame, Callable[[DataFrame], dict[str, DataFrame]]]:
    """Units of documents and their parser: words of a text, and its language."""
    texts = changed(docs.select(F.col("doc_id").cast("string").alias("unit"), F.coalesce("text", F.lit("")).alias("text"), "lang"))
    current = texts.select("unit", F.md5("text").alias("input_hash"))

    def parse(units: DataFrame) -> dict[str, DataFrame]:
        mine = texts.join(units.select("unit").hint("shuffle_hash"), "unit")
        # within the row: words as rows of their own would be sorted and shuffled by unit
        words = F.split("text", r"\s+")
        return {"words": mine.select("unit", F.size(words).cast("long").alias("words"), F.array_max(words).alias("last")), "languages": mine.select("unit", "lang")}

    return current, parse


@query(
    "index_refresh",
    """
    WITH changed AS (
      SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 'new start ' || coalesce(text, '') ELSE coalesce(text, '') END AS text FROM documents WHERE doc_id % 10 <> 3
    )
    SELECT doc_id::VARCHAR AS unit, lang, len(string_split_regex(text, '\\s+'))::BIGINT AS words, list_max(string_split_regex(text, '\\s+')) AS last,
           CASE WHEN lang = 'en' THEN 2 ELSE 1 END::BIGINT AS since FROM changed
    """,
)
def index_refresh(s: SparkSession, d: str) -> DataFrame:
    """An index of all documents, refreshed after English ones changed and a tenth went: only what changed is parsed again (since)."""
    docs = t(s, d, "documents")
    store = TableStore(s, folder(docs), "2")
    store.refresh(*_facts(docs))
    newer = F.when(F.col("lang") == "en", F.concat(F.lit("new start "), "text")).otherwise(F.col("text"))
    store.refresh(*_facts(docs.where("doc_id % 10 <> 3"), lambda x: x.withColumn("text", newer)))
    found = store.tables()
    return found["words"].join(found["languages"].drop("since"), "unit").select("unit", "lang", "words", "last", "since")


# --- traces -------------------------------------------------------------------


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The events table as a stream."""
    schema = t(s, d, "events").schema
    return s.readStream.schema(schema).parquet(_alone(s, d))


def _alone(s: SparkSession, d: str) -> str:
    """A folder with the events table and nothing else."""
    events = t(s, d, "events")
    out = f"{folder(events)}/events"
    events.write.parquet(out)
    return out


@query("trace_replayed", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def trace_replayed(s: SparkSession, d: str) -> DataFrame:
    """A stream of events written to a trace, then its first batch again as after a failure: each event is there once."""
    source = _stream(s, d)
    out = folder(t(s, d, "events"))
    trace.write_trace(source, f"{out}/trace", f"{out}/checkpoint", once=True).awaitTermination()
    trace.append_batch(t(s, d, "events"), 0, f"{out}/trace")
    return trace.read_committed(s, f"{out}/trace").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "runs_followed",
    """
    WITH runs AS (
      SELECT user_id::VARCHAR AS run_id, min(ts) AS opened, min(ts) FILTER (event_type = 'purchase') AS closed, max(ts) AS last, count(*) AS events
      FROM events WHERE user_id IS NOT NULL GROUP BY user_id
    )
    SELECT run_id, epoch_us(opened) AS opened_us, epoch_us(closed) AS closed_us, events, CASE WHEN closed IS NULL THEN 'abandoned' ELSE 'closed' END AS outcome
    FROM runs WHERE coalesce(closed, last + INTERVAL 2 DAY) < (SELECT max(ts) - INTERVAL 1 DAY FROM events)
    """,
)
def runs_followed(s: SparkSession, d: str) -> DataFrame:
    """Users as runs that a purchase closes: state per run, given out when the watermark has passed."""
    events = _stream(s, d).where("user_id is not null").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("event"), F.col("ts").cast("timestamp").alias("at"))
    out = folder(t(s, d, "events"))
    found = trace.runs(events, "purchase", "2 days", "1 day")
    trace.write_trace(found, f"{out}/runs", f"{out}/checkpoint", once=True).awaitTermination()
    us = lambda c: F.unix_micros(c)
    return trace.read_committed(s, f"{out}/runs").select("run_id", us("opened").alias("opened_us"), us("closed").alias("closed_us"), "events", "outcome")


# --- accounts -----------------------------------------------------------------

_CALLS = """
WITH calls AS (
  SELECT event_id, event_id AS i, event_type AS tier, 100 + event_id * 37 % 400 AS r, event_id * 53 % 450 AS u FROM events
), e AS (
  SELECT 100 * i AS place, event_id, tier, 'reserve' AS kind, r AS add, NULL::BIGINT AS least, 0 AS used, NULL::BIGINT AS since FROM calls
  UNION ALL SELECT 100 * (i + 5) + 1, event_id, tier, 'charge', u - r, u, u, 100 * i FROM calls WHERE event_id % 4 <> 0
), s AS (
  SELECT *, sum(add) OVER (ORDER BY place) AS upto, coalesce(sum(used) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM e
), b AS (
  SELECT *, greatest(0, coalesce(max(least - upto) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) + upto - add AS held FROM s
), stop AS (
  SELECT coalesce(min(place), 1000000000000) AS ends FROM b WHERE kind = 'reserve' AND (spent >= (SELECT sum(u) * 2 // 3 FROM calls) OR held + add > (SELECT sum(r) // 2 FROM calls))
)
"""


def _calls(s: SparkSession, d: str) -> tuple[DataFrame, accounts.Limits]:
    """The events table as calls, settled five calls later, a quarter never; limits that stop the run on its way."""
    ranked = t(s, d, "events").select("event_id", F.col("event_type").alias("tier"))
    calls = ranked.select(F.col("event_id").alias("i"), "event_id", "tier", (100 + F.col("event_id") * 37 % 400).alias("r"), (F.col("event_id") * 53 % 450).alias("u"))
    none, cost = F.lit(None).cast("long"), F.lit(0).cast("decimal(28,9)")
    reserve = calls.select((100 * F.col("i")).alias("place"), F.col("event_id").alias("call_id"), "tier", F.lit("reserve").alias("kind"), F.col("r").alias("tokens"), none.alias("since"), none.alias("reserved"), F.lit(False).alias("cached"), cost.alias("cost"))
    charge = calls.where("event_id % 4 <> 0").select((100 * (F.col("i") + 5) + 1).alias("place"), F.col("event_id").alias("call_id"), "tier", F.lit("charge").alias("kind"), F.col("u").alias("tokens"), (100 * F.col("i")).alias("since"), F.col("r").alias("reserved"), F.lit(False).alias("cached"), cost.alias("cost"))
    total = calls.agg(F.sum("r"), F.sum("u")).first()
    return reserve.unionByName(charge), accounts.Limits(quota_tokens=total[0] // 2, tokens_per_run=total[1] * 2 // 3)


@query("account_calls", _CALLS + "SELECT event_id AS call_id, place < ends AS accepted, held::BIGINT AS quota_before, spent::BIGINT AS tokens_before FROM b, stop WHERE kind = 'reserve' AND place <= ends")
def account_calls(s: SparkSession, d: str) -> DataFrame:
    """The account before each call up to the one that stops the run."""
    found = accounts.settle(*_calls(s, d))
    stop = found.run.first().stopped_at
    calls = found.events.where("kind = 'reserve'")
    return (calls if stop is None else calls.where(F.col("place") <= stop)).select("call_id", "accepted", "quota_before", "tokens_before")


@query(
    "account_tiers",
    _CALLS
    + """SELECT tier, count(*) FILTER (kind = 'charge' AND since < ends) AS calls, count(*) FILTER (kind = 'charge' AND since < ends AND used = 0) AS unreported,
         count(*) FILTER (kind = 'reserve' AND place >= ends) AS refused, coalesce(sum(used) FILTER (kind = 'charge' AND since < ends), 0)::BIGINT AS tokens FROM b, stop GROUP BY tier""",
)
def account_tiers(s: SparkSession, d: str) -> DataFrame:
    """What each tier was charged, and how many of its calls were refused."""
    return accounts.settle(*_calls(s, d)).tiers.select("tier", "calls", "unreported", "refused", "tokens")


# --- resumed stages -----------------------------------------------------------


class _Cut(RuntimeError):
    """The run ends here."""


@query("stage_resumed", "SELECT doc_id, md5(coalesce(text, '') || '!') AS answer, 1::BIGINT AS times FROM documents WHERE doc_id IS NOT NULL")
def stage_resumed(s: SparkSession, d: str) -> DataFrame:
    """A stage over all documents that is cut short after two of its batches, then resumed: every answer once."""
    work = t(s, d, "documents").where("doc_id is not null").select("doc_id", "text")
    where, me = folder(work), identity_of(work, model="m")
    left = [2]

    def answer(rows: DataFrame, cut: bool = False) -> DataFrame:
        if cut and not left[0]:
            raise _Cut
        left[0] -= 1
        return rows.select("doc_id", F.md5(F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).alias("answer"))

    try:
        Journal(s, where, me).run(work, "doc_id", lambda rows: answer(rows, True), "doc_id long, answer string", 4)
    except _Cut:
        pass
    done = Journal(s, where, me).run(work, "doc_id", answer, "doc_id long, answer string", 4)
    return done.groupBy("doc_id").agg(F.min("answer").alias("answer"), F.count(F.lit(1)).alias("times"))


# --- bundles ------------------------------------------------------------------


@query(
    "bundle_offsets",
    """
    WITH m AS (SELECT source || '/' || doc_id AS name, coalesce(text, '') AS text FROM documents),
    s AS (SELECT name, sha256(text) AS sha256, 512 + (strlen(text) + 511) // 512 * 512 AS n FROM m)
    SELECT name, sha256, (sum(n) OVER (ORDER BY encode(name)) - n)::BIGINT AS "offset", n::BIGINT AS bytes FROM s
    """,
)
def bundle_offsets(s: SparkSession, d: str) -> DataFrame:
    """The documents as members of an archive, written as blocks and checked: where each lies, and its hash."""
    docs = t(s, d, "documents")
    out = f"{folder(docs)}/bundle"
    bundles.write_bundle(docs.select(F.concat("source", F.lit("/"), "doc_id").alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")), out)
    bundles.verify_blocks(s, out)
    return s.read.parquet(out).where("kind = 'member'").select("name", "sha256", "offset", F.octet_length("bytes").cast("long").alias("bytes"))


# --- places of exported fixes -------------------------------------------------

_AT = "1 + length(left(text, {c})) - length(replace(left(text, {c}), chr(10), ''))"
_COLUMN = "1 + strlen(left(text, {c})) - coalesce(strlen(left(text, {c})) - strlen(regexp_extract(left(text, {c}), '[^\n]*$')), 0)"


@query(
    "fix_places",
    f"""
    WITH x AS (SELECT doc_id, doc_id % 3 AS k, coalesce(text, '') AS text FROM documents), y AS (SELECT *, (doc_id * 37 % (length(text) + 1))::BIGINT AS a, (doc_id * 101 % (length(text) + 1))::BIGINT AS b FROM x)
    SELECT doc_id AS run, {_AT.format(c='a')} AS line, {_COLUMN.format(c='a')} AS "column", CASE WHEN k > 0 THEN {_AT.format(c='b')} END AS note_line,
           CASE WHEN k > 1 THEN {_AT.format(c='least(a, b)')} END AS from_line, CASE WHEN k > 1 THEN {_AT.format(c='greatest(a, b)')} END AS to_line FROM y
    """,
)
def fix_places(s: SparkSession, d: str) -> DataFrame:
    """Documents as files with a diagnostic, a note and a replacement each, whose byte offsets become lines."""
    content = F.coalesce("text", F.lit(""))
    size = F.char_length(content) + 1
    docs = t(s, d, "documents").select(F.col("doc_id").cast("string").alias("run"), F.col("doc_id").cast("string").alias("path"), content.alias("text"), "doc_id", (F.col("doc_id") * 37 % size).cast("int").alias("a"), (F.col("doc_id") * 101 % size).cast("int").alias("b"))
    byte = lambda c: F.octet_length(F.substring(F.col("text"), F.lit(1), c)).cast("long")
    a, b = byte(F.col("a")), byte(F.col("b"))
    note = F.struct(F.lit(0).alias("pos"), F.col("path").alias("path"), b.alias("offset"), F.lit("n").alias("message"))
    change = F.struct(F.col("path").alias("path"), F.least(a, b).alias("offset"), F.abs(a - b).alias("length"), F.lit("").alias("text"))
    some = lambda least, item: F.when(F.col("doc_id") % 3 > least, F.array(item)).otherwise(F.filter(F.array(item), lambda _: F.lit(False)))
    fixes = docs.select("run", F.lit(0).alias("ordinal"), "path", a.alias("offset"), F.lit("warning").alias("severity"), F.lit("m").alias("message"), F.lit("r").alias("rule_id"), some(0, note).alias("notes"), some(1, change).alias("replacements"))
    files = docs.select("path", F.octet_length("text").alias("size"), text_line_starts(F.col("text")).alias("starts"))
    found = diagnostics.placed_fixes(fixes, files)
    get = lambda c, f: F.get(F.col(c), F.lit(0))[f]
    return found.select(F.col("run").cast("long").alias("run"), "line", "column", get("notes", "line").alias("note_line"), get("replacements", "line").alias("from_line"), get("replacements", "end_line").alias("to_line"))
