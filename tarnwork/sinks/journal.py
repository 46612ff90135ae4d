"""Resumable stages: results by key in a journal, so that a run cut short goes on where it was.

A journal belongs to one identity, a digest of whatever decides the answers
(inputs, model, prompt); one of another identity is refused, not overwritten.
Work is done in batches of keys. A batch's results are written first and then
counted by a commit, so a batch is there whole or not at all, and what a run
that resumes has to do is what no committed batch has: an anti-join.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import bag_digest
from ..plans.scratch import written
from .commits import Commits


def identity_of(work: DataFrame, **settings: object) -> str:
    """Digest of a table, in any order of rows and partitions, and of the settings that decide its answers."""
    row = F.sha2(F.to_json(F.struct(*sorted(work.columns)), {"ignoreNullFields": "false"}), 256)
    said = F.lit("".join(f"\n{k}={v}" for k, v in sorted(settings.items())))
    return work.agg(F.sha2(F.concat(bag_digest(row), said), 256)).first()[0]


class Journal:
    """The results of a stage so far, in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, identity: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.commits = Commits(spark, f"{self.folder}/commits")
        self.commits.once({"identity": identity})

    def batches(self) -> list[str]:
        return [self.commits.read(n)["batch"] for n in self.commits.numbers() if n > 1]

    def done(self, schema: str) -> DataFrame:
        """The results of all committed batches."""
        paths = [f"{self.folder}/results/{b}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def run(self, work: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], schema: str, batches: int = 8) -> DataFrame:
        """compute's results (with key) for all rows of work, computed for what the journal does not have yet.

        Keys are dealt to batches by their hash. A key without a result is
        computed again by the next run; a key is never computed twice in one.
        """
        todo = written(work.join(self.done(schema).select(key).distinct(), key, "left_anti"))
        deal = F.pmod(F.xxhash64(F.col(key)), F.lit(batches))
        for b in sorted(r[0] for r in todo.select(deal).distinct().collect()):
            name = uuid.uuid4().hex
            compute(todo.where(deal == b)).write.parquet(f"{self.folder}/results/{name}")
            self.commits.append({"batch": name})
        return self.done(schema)
