"""A versioned store of fact tables by unit, such as an index of translation units.

Facts lie in parts, folders of Parquet that one refresh wrote and nobody
changes. A version is a manifest (an entry of ``Commits``) and a table of its
units: what each unit was made from (a hash) and the part that holds its facts.
A refresh compares hashes, has the changed units parsed, writes one part of
their facts, and commits. Readers take the facts whose part is the one of
their unit in the version they opened, so a refresh in between, or a writer that
lost, is never seen. Manifests name their format; another format is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import written
from .commits import Commits, Conflict

#: Parts of a version beyond which a refresh writes all facts anew.
MOST_PARTS = 64
UNIT = "unit string, input_hash string, part string"
Parse = Callable[[DataFrame], Mapping[str, DataFrame]]


class StoreError(RuntimeError):
    """A store that cannot be read here, and why."""


class Refreshed(NamedTuple):
    version: int
    parsed: int
    reused: int
    removed: int


class TableStore:
    """Fact tables in a shared folder; each table has a column unit."""

    def __init__(self, spark: SparkSession, folder: str, format_version: str) -> None:
        self.spark, self.folder, self.format = spark, folder.rstrip("/"), format_version
        self.commits = Commits(spark, f"{self.folder}/manifests")

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the last by default; without any, an empty one of version 0."""
        number = self.commits.head() if version is None else version
        if not number:
            return {"version": 0, "format": self.format, "parts": {}, "tables": {}, "units": None}
        try:
            found = self.commits.read(number)
        except Exception as e:
            raise StoreError(f"{self.folder}: there is no version {number}") from e
        if found.get("format") != self.format:
            raise StoreError(f"{self.folder}: version {number} has format {found.get('format')!r}, this reads {self.format!r}")
        return found

    def units(self, version: int | None = None) -> DataFrame:
        """unit, input_hash and part of a version."""
        path = self.manifest(version)["units"]
        return self.spark.read.schema(UNIT).parquet(path) if path else self.spark.createDataFrame([], UNIT)

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """The facts of a version by table, each row with since, the version that wrote it."""
        manifest = self.manifest(version)
        return {name: self._facts(manifest, name) for name in manifest["tables"]}

    def _facts(self, manifest: dict, name: str) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["tables"][name]))
        paths = [f"{self.folder}/data/{name}/{part}" for part in manifest["parts"]]
        if not paths:
            return self.spark.createDataFrame([], schema.add("since", T.LongType()))
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("__part", T.StringType())])).parquet(*paths)
        live = self.spark.read.schema(UNIT).parquet(manifest["units"]).select("unit", F.col("part").alias("__part"))
        # one entry per part, of which there are MOST_PARTS at most
        since = F.create_map(*[F.lit(x) for part, n in manifest["parts"].items() for x in (part, n)])
        return rows.join(live, ["unit", "__part"], "left_semi").select(*schema.names, since[F.col("__part")].cast("long").alias("since"))

    def refresh(self, current: DataFrame, parse: Parse, retries: int = 3) -> Refreshed:
        """Bring the store to current (unit, input_hash): parse gets the units whose hash changed and gives the facts of each table.

        Units that are gone go; all others keep their facts as they lie. If
        another writer commits first, this one starts over from what is there
        then, and Conflict is raised after so many retries.
        """
        current = written(current.select(F.col("unit").cast("string").alias("unit"), "input_hash"))
        if current.groupBy("unit").count().where("count > 1").limit(1).count():
            raise StoreError("a unit comes twice")
        while True:
            try:
                return self._refresh(current, parse)
            except Conflict:
                retries -= 1
                if retries < 0:
                    raise

    def _refresh(self, current: DataFrame, parse: Parse) -> Refreshed:
        manifest = self.manifest()
        version, part = manifest["version"] + 1, uuid.uuid4().hex
        old = self.units(manifest["version"])
        full = len(manifest["parts"]) >= MOST_PARTS
        known = old.withColumnRenamed("part", "held")
        marked = written(current.join(known, ["unit", "input_hash"], "left"))
        changed = marked.where("held is null").select("unit", "input_hash")
        n = marked.agg(F.count_if(F.col("held").isNull()).alias("parsed"), F.count_if(F.col("held").isNotNull()).alias("reused")).first()
        removed = old.join(current, "unit", "left_anti").count()
        facts = dict(parse(changed))
        if manifest["tables"] and set(facts) != set(manifest["tables"]):
            raise StoreError(f"tables {sorted(facts)} were parsed, the store has {sorted(manifest['tables'])}")
        for name, rows in facts.items():
            rows = rows.withColumn("unit", F.col("unit").cast("string"))
            if full:
                rows = rows.unionByName(self._facts(manifest, name).drop("since").join(marked.where("held is not null").select("unit"), "unit", "left_semi"))
            rows.withColumn("__part", F.lit(part)).write.parquet(f"{self.folder}/data/{name}/{part}")
            facts[name] = rows
        where = F.lit(part) if full else F.coalesce("held", F.lit(part))
        units = f"{self.folder}/units/{part}"
        marked.select("unit", "input_hash", where.alias("part")).write.parquet(units)
        # one row per part
        live = {r.part for r in self.spark.read.schema(UNIT).parquet(units).select("part").distinct().collect()}
        parts = {p: v for p, v in {**manifest["parts"], part: version}.items() if p in live}
        tables = {name: json.dumps(T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]).jsonValue()) for name, rows in facts.items()}
        self.commits.put(version, {"version": version, "format": self.format, "parts": parts, "tables": tables, "units": units})
        return Refreshed(version, n.parsed, n.reused, removed)
