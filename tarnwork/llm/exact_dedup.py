"""Exact duplicates by a tree-merge of sorted digest runs, with DataFrame functions only.

Each input partition sorts the digests of its rows into a run and keeps one
line per digest: its smallest identifier and the number of rows. Runs then go
up a binomial tree: in a round every run hands its lines to the run whose
number has the round's lowest bits cleared (``FAN`` bits, so 2 ** FAN runs
meet), which merges them in digest order and keeps the smallest identifier
again. After log(partitions) / FAN rounds one run is left. A round is one
aggregate: below the exchange a partition sorts and reduces what it holds,
above it the sorted lines of sibling runs are merged as a stream (the kept
line is a struct, for which Spark aggregates by sorting). A run is spread over
all tasks by digest, so none is ever whole in one place, and a text that
a third of all rows share is one line per run from the first step on.

A digest alone does not decide: lines are merged only where the SHA-256, the
length in bytes and a second, independent hash of the normalised texts all
agree, at every level; texts that differed in one of them would stay apart.

The way back to the rows is a join by digest with the groups of two rows or
more. Groups of more than a thousandth of all rows, of which there are fewer
than a thousand, are broadcast, so their rows stay where they are.

Defined cases: a null text is an empty one; white space at either end counts
as one space; a null doc_id comes after all others, so it stays only where no
row of the group has one (keep_id is then null); of rows equal in text and id
exactly one stays, the first in the order of the scan; an empty table gives an
empty result; other columns are not read, and ``dedup`` carries them along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, OWN, materialize, table

SPACE = r"[\x20\x09-\x0D]+"
#: Binary rounds taken at once: 2 ** FAN runs are merged into one.
FAN = 4
#: What must agree for two rows to be of one group.
PROOF = [f"{OWN}digest", f"{OWN}bytes", f"{OWN}check"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def with_proof(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with the digest of the normalised text, its two witnesses, the run and the number of the row."""
    plain = normalised(F.col(text))
    digest, size, check = PROOF
    return rows.withColumns({digest: F.unhex(F.sha2(plain, 256)), size: F.octet_length(plain), check: F.xxhash64(plain), f"{OWN}run": F.spark_partition_id(), f"{OWN}row": F.monotonically_increasing_id()})


def merge_runs(lines: DataFrame, runs: int, fan: int = FAN) -> DataFrame:
    """One line per digest from lines (run, proof, keep, size): the smallest keep and the sum of sizes, by rounds of exchanges."""
    run = F.col(f"{OWN}run")
    while True:
        runs = (runs - 1 >> fan) + 1
        lines = lines.groupBy(F.shiftright(run, fan).alias(f"{OWN}run"), *PROOF).agg(F.min(f"{OWN}keep").alias(f"{OWN}keep"), F.sum(f"{OWN}size").alias(f"{OWN}size"))
        if runs <= 1:
            return lines.drop(f"{OWN}run")


def groups(rows: DataFrame, doc_id: str = "doc_id", fan: int = FAN) -> DataFrame:
    """Proof, keep (struct of none, id, row) and size per group of equal texts, from rows of with_proof."""
    keep = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(f"{OWN}row").alias("row"))
    runs = (rows.agg(F.max(f"{OWN}run")).first()[0] or 0) + 1
    lines = rows.select(f"{OWN}run", *PROOF, keep.alias(f"{OWN}keep"), F.lit(1).cast("long").alias(f"{OWN}size"))
    return merge_runs(lines, runs, fan)


def with_groups(rows: DataFrame, doc_id: str = "doc_id", fan: int = FAN) -> DataFrame:
    """rows (of with_proof, written) with keep and size of their group."""
    found = materialize(groups(rows, doc_id, fan).where(f"{OWN}size > 1"))
    total = rows.count()
    hot = F.col(f"{OWN}size") > total / HOT_SHARE
    often = F.broadcast(found.where(hot))
    own = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(f"{OWN}row").alias("row"))
    rest = rows.join(often.select(*PROOF), PROOF, "left_anti").join(found.where(~hot), PROOF, "left")
    filled = rest.withColumns({f"{OWN}keep": F.coalesce(f"{OWN}keep", own), f"{OWN}size": F.coalesce(f"{OWN}size", F.lit(1).cast("long"))})
    return rows.join(often, PROOF).unionByName(filled)


def report(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(with_proof(docs.select("doc_id", "text")).drop("text"))
    kept = F.col(f"{OWN}keep.row") == F.col(f"{OWN}row")
    digest = F.lower(F.hex(PROOF[0]))
    return with_groups(rows, fan=fan).select("doc_id", F.col(f"{OWN}keep.id").alias("keep_id"), F.col(f"{OWN}size").alias("group_size"), kept.alias("kept"), digest.alias("text_sha256"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan: int = FAN) -> DataFrame:
    """The rows of docs that stay, all their columns. docs is written once, so that row numbers hold."""
    rows = materialize(with_proof(docs, text))
    narrow = rows.select(F.col(doc_id).alias("doc_id"), *PROOF, f"{OWN}run", f"{OWN}row")
    gone = with_groups(narrow, fan=fan).where(f"{OWN}keep.row <> {OWN}row").select(f"{OWN}row")
    return rows.join(gone, f"{OWN}row", "left_anti").select(*docs.columns)


ORACLE_SQL = """
WITH plain AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t)::BIGINT AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id ASC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM plain
"""


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the whole documents table."""
    return report(table(spark, sf_dir, "documents"))
