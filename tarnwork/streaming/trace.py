"""Run traces as streams: events counted as they are appended, written exactly once, and followed from a run's first to its last."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sinks.commits import Commits, Conflict

EVENT = "event string, run_id string, policy_version string, at timestamp"


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events appended to a folder of JSON lines."""
    return spark.readStream.schema(EVENT).json(folder)


def event_counts(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """run_id, event, start, n per window; events later than the watermark are left out, state is bounded by it."""
    counted = events.withWatermark("at", late).groupBy(F.window("at", every), "run_id", "event").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("run_id", "event", F.col("window.start").alias("start"), "n")


def append_batch(batch: DataFrame, number: int, folder: str) -> bool:
    """Write a batch of a stream to a trace folder, once: a batch whose number is committed changes nothing. Whether it was written."""
    commits = Commits(batch.sparkSession, f"{folder}/commits")
    entry = number + 1
    if entry in commits.numbers():
        return False
    part = uuid.uuid4().hex
    batch.write.parquet(f"{folder}/events/{part}")
    try:
        commits.put(entry, {"batch": number, "part": part, "schema": batch.schema.json()})
    except Conflict:  # another attempt at this batch was first
        return False
    return True


def write_trace(events: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start appending a stream of events to a trace folder, each batch exactly once, whatever is replayed."""
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: append_batch(batch, number, folder))
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_committed(spark: SparkSession, folder: str) -> DataFrame:
    """The events of all committed batches of a trace folder, with their batch."""
    commits = Commits(spark, f"{folder}/commits")
    found = [commits.read(n) for n in commits.numbers()]
    if not found:
        raise ValueError(f"{folder} has no committed batch")
    schema = T.StructType.fromJson(json.loads(found[-1]["schema"]))
    rows = spark.read.schema(schema).parquet(*[f"{folder}/events/{e['part']}" for e in found])
    batch_of = spark.createDataFrame([(e["part"], e["batch"]) for e in found], "__part string, batch long")
    part = F.regexp_extract(F.col("_metadata.file_path"), "/events/([^/]*)/[^/]*$", 1)
    return rows.withColumn("__part", part).join(F.broadcast(batch_of), "__part").drop("__part")


RUN = "run_id string, opened long, closed long, last long, events long"
RUN_STATE = "run_id array<string>, opened array<long>, closed array<long>, last array<long>, events array<long>, until array<long>"
#: Microseconds later than any event: no closing event yet.
NEVER = 1 << 62
#: Groups of runs, by hash; a stream's checkpoint belongs to one number. A call of Python costs milliseconds, so each follows many runs.
GROUPS = 1024


def runs(events: DataFrame, closing: str = "run_closed", silent: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """One row per run of a stream of events (run_id, event, at), once no more of it can come.

    A run is closed when the watermark passes its first closing event, and
    abandoned when the watermark passes its last event by silent. The state of
    a run is four numbers and when it is due, whatever the number and order of
    its events, so results do not depend on how the stream is cut into batches.
    Runs of a group are followed in one call, by column.
    """
    wait = int(pd.Timedelta(silent).total_seconds() * 1e6)
    kinds = {"opened": "min", "closed": "min", "last": "max", "events": "sum", "until": "min"}

    def folded(parts: list[pd.DataFrame]) -> pd.DataFrame:
        found = pd.concat(parts).groupby("run_id", sort=False, dropna=False, as_index=False).agg(kinds)
        return found.assign(run_id=found["run_id"].astype(object).where(found["run_id"].notna(), None))

    def follow(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        known = pd.DataFrame(dict(zip(["run_id", *kinds], state.get))) if state.exists else None
        if not state.hasTimedOut:
            # until 0: due anew, and not in this batch
            fresh = [folded([chunk.assign(events=1, until=0)]) for chunk in chunks]
            known = folded(fresh if known is None else [known, *fresh])
            due = known["last"].add(wait).where(known["closed"] == NEVER, known["closed"]).floordiv(1000).clip(lower=now + 1)
            known["until"] = known["until"].where(known["until"] > 0, due.where(known["last"] > -NEVER, NEVER))
        over = known["until"] < now
        left = known[~over]
        if len(left):
            state.update(tuple(left[c].tolist() for c in ["run_id", *kinds]))
            state.setTimeoutTimestamp(int(left["until"].min()))
        else:
            state.remove()
        if over.any():
            yield known.loc[over, ["run_id", "opened", "closed", "last", "events"]]

    at = F.unix_micros("at")
    none = F.lit(NEVER)
    moments = {"opened": F.coalesce(at, none), "closed": F.coalesce(F.when(F.col("event") == closing, at), none), "last": F.coalesce(at, -none)}
    group = F.pmod(F.xxhash64("run_id"), F.lit(GROUPS)).alias("group")
    keyed = events.withWatermark("at", late).select(group, F.col("run_id").cast("string").alias("run_id"), "at", *[v.alias(k) for k, v in moments.items()])
    found = keyed.groupBy("group").applyInPandasWithState(follow, RUN, RUN_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    closed = F.timestamp_micros(F.nullif("closed", none))
    return found.select("run_id", F.timestamp_micros("opened").alias("opened"), closed.alias("closed"), F.timestamp_micros("last").alias("last"), "events", F.when(closed.isNull(), "abandoned").otherwise("closed").alias("outcome"))
