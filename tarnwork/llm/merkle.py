"""A Merkle manifest of a dataset: digests of rows, trees per group, one root, a proof for each row.

Levels are windows. A window over (group, parent) ordered by place, with a full
frame, gives every node the digests of its run, at most ``FAN`` of them. Joined
they are what the parent is the digest of, and without the node itself they are
its siblings in its proof. One node of each run goes on as the parent, so
the next level has a sixteenth of the rows. Groups whose tree is done rest; the
roots of the groups then form one more tree in the same way.

Places within a group come from ranges of (group, order): rows are counted per
range and numbered within it, so no task holds a group, and a group of a third
of all rows is spread over a third of the ranges.

Proofs go down: a parent's chain (the siblings on its way to the root) is
joined to its children by (group, parent), the partitioning of their window.
Chains are carried by parents only, a sixteenth of the rows; what a row adds
comes from its own window.

Defined cases: a null value is ``-``, so it differs from an empty text; a null
group is a group, before all others; rows are ordered by id, nulls first, rows
of one id by their digest, so repeated rows have places beside each other and
swapping them changes nothing; an empty table has no root and gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Pairs of a range and a group up to which their counts are broadcast.
BROADCAST_RANGES = 100_000
LINK = "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length, so that no two rows have the same joined text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return digest(*map(field, columns))


def group_key(group: Column) -> Column:
    """A text never null that orders as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """nodes (grp and others) with place, from 0 in each grp by order, and n, the rows of the grp."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(nodes.repartitionByRange(parts, "grp", *order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("here"))
    # as many rows per grp as it has ranges
    by_part = Window.partitionBy("grp").orderBy("part")
    before = F.coalesce(F.sum("here").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(counts.select("grp", "part", before.alias("start"), F.sum("here").over(Window.partitionBy("grp")).alias("n")))
    if starts.count() <= BROADCAST_RANGES:
        starts = F.broadcast(starts)
    within = F.row_number().over(Window.partitionBy("part", "grp").orderBy(*order)) - 1
    return ranged.withColumn("within", within).join(starts, ["grp", "part"]).select(*nodes.columns, (F.col("start") + F.col("within")).alias("place"), "n")


def with_run(nodes: DataFrame, fan: int) -> DataFrame:
    """nodes (grp, place, digest) with parent (its place) and run, the digests under that parent in order."""
    rows = nodes.withColumn("parent", F.floor(F.col("place") / fan))
    whole = Window.partitionBy("grp", "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("run", F.collect_list("digest").over(whole))


def link(fan: int) -> Column:
    """The siblings of a node with run and place: those before it and those after it, joined."""
    at = F.pmod("place", F.lit(fan)).cast("int")
    return F.struct(F.array_join(F.slice("run", F.lit(1), at), "").alias("before"), F.array_join(F.slice("run", at + 2, F.lit(fan)), "").alias("after"))


def levels(leaves: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """The levels of the trees over leaves (grp, place, n, digest), leaves first; each node once, n the nodes of its grp on its level."""
    found = [leaves.select("grp", "place", "n", "digest")]
    most = found[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = with_run(found[-1].where("n > 1"), fan)
        up = runs.where(F.pmod("place", F.lit(fan)) == 0).select("grp", F.col("parent").alias("place"), F.ceil(F.col("n") / fan).alias("n"), F.sha2(F.array_join("run", ""), 256).alias("digest"))
        found.append(materialize(up))
        most = -(-most // fan)
    return found


def roots(trees: Sequence[DataFrame]) -> DataFrame:
    """grp and digest of the last node of each tree."""
    last = [t.where("n = 1").select("grp", "digest") for t in trees]
    out = last[0]
    for t in last[1:]:
        out = out.unionByName(t)
    return out


def chained(nodes: DataFrame, above: DataFrame | None, tops: DataFrame, fan: int) -> DataFrame:
    """nodes of a level (all their columns) with chain and top.

    above: grp, place, chain, top of the level above; tops: grp, chain, top of the roots.
    """
    done = nodes.where("n = 1").join(tops, "grp")
    if above is None:
        return done
    parents = above.select("grp", F.col("place").alias("parent"), F.col("chain").alias("rest"), "top")
    under = with_run(nodes.where("n > 1"), fan).join(parents, ["grp", "parent"])
    return under.select(*nodes.columns, F.concat(F.array(link(fan)), "rest").alias("chain"), "top").unionByName(done.select(*nodes.columns, "chain", "top"))


def chains(leaves: DataFrame, trees: Sequence[DataFrame], tops: DataFrame, fan: int = FAN) -> DataFrame:
    """leaves (grp, place, n, digest and others) with chain, from their level to the root, and top, what tops says of their tree."""
    above = None
    for nodes in reversed(trees[1:]):
        above = materialize(chained(nodes, above, tops, fan).select("grp", "place", "chain", "top"))
    return chained(leaves, above, tops, fan)


def joined(chain: Column) -> Column:
    """All siblings of a proof as one text."""
    return F.array_join(F.transform(chain, lambda x: F.concat(x["before"], x["after"])), "")


def folded(start: Column, chain: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(chain, start, lambda node, x: digest(x["before"], node, x["after"]))


def manifest(leaves: DataFrame, fan: int = FAN) -> DataFrame:
    """Proofs for leaves (grp, id, digest and others): their columns and subroot, root, chain (links from the leaf to the root)."""
    own = leaves.columns
    numbered = materialize(placed(leaves, ["id", "digest"]))
    trees = levels(numbered, fan)
    subroots = materialize(roots(trees))
    # the tree over the groups: one group, ordered by what was the group
    over = materialize(placed(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("id"), "digest"), ["id"]))
    top = levels(over, fan)
    root = roots(top).select("digest").first()
    one = leaves.sparkSession.range(1).select(F.lit("").alias("grp"), F.array().cast(f"array<{LINK}>").alias("chain"), F.lit(None).cast("string").alias("top"))
    tops = materialize(chains(over, top, one, fan).select(F.col("id").alias("grp"), "chain", F.col("digest").alias("top")))
    return chains(numbered, trees, tops, fan).select(*own, F.col("top").alias("subroot"), F.lit(root[0] if root else None).cast("string").alias("root"), "chain")


def tampered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit(docs: DataFrame, forged: Column, fan: int = FAN) -> DataFrame:
    """Manifest of docs and the outcome of checking each row, where forged (boolean) with its text tampered with.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    columns = [F.col(c) for c in COLUMNS]
    changed = F.when(forged, leaf([tampered(c) if n == "text" else c for n, c in zip(COLUMNS, columns, strict=True)]))
    leaves = materialize(docs.select(group_key(F.col("source")).alias("grp"), F.col("doc_id").alias("id"), leaf(columns).alias("digest"), changed.alias("forged")))
    found = manifest(leaves, fan).withColumn("folded_root", folded(F.coalesce("forged", "digest"), F.col("chain")))
    return found.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(joined(F.col("chain")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the whole documents table; rows whose id has a CRC-32 divisible by 5 are tampered with."""
    docs = table(spark, sf_dir, "documents")
    return audit(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))


def _level_sql(name: str, k: int) -> str:
    return f"""{name}{k + 1} AS (
  SELECT grp, p AS place, ceil(n / 16.0)::BIGINT AS n, sha256(string_agg(digest, '' ORDER BY place)) AS digest
  FROM (SELECT *, place // 16 AS p FROM {name}{k} WHERE n > 1) GROUP BY grp, p, n
), {name}s{k} AS (
  SELECT grp, place, n, digest, place // 16 AS parent,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k} WHERE n > 1 WINDOW w AS (PARTITION BY grp, place // 16 ORDER BY place)
)"""


def _chain_sql(name: str, out: str, depth: int, tops: str) -> str:
    """Chains of all levels, from the highest to the leaves; lists of [before, after]."""
    parts, done = [], f"SELECT x.grp, x.place, t.chain, t.top FROM {name}{{k}} x JOIN {tops} t USING (grp) WHERE x.n = 1"
    parts.append(f"{out}{depth} AS ({done.format(k=depth)})")
    for k in range(depth - 1, -1, -1):
        parts.append(f"""{out}{k} AS (
  SELECT s.grp, s.place, list_prepend([s.l, s.r], c.chain) AS chain, c.top FROM {name}s{k} s JOIN {out}{k + 1} c ON c.grp = s.grp AND c.place = s.parent
  UNION ALL {done.format(k=k)}
)""")
    return ", ".join(parts)


def oracle_sql(depth: int = 5, over: int = 3) -> str:
    """The manifest in SQL for groups of up to 16 ** depth rows and up to 16 ** over groups."""
    one = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(map(one, COLUMNS[:-1]))
    nodes = lambda name, n: " UNION ALL ".join(f"SELECT grp, digest FROM {name}{k} WHERE n = 1" for k in range(n + 1))
    # CRC-32 bit by bit: a byte is taken in, then eight shifts (-1) follow
    steps = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce({steps}, lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, 4294967295), 4294967295)"
    return f"""
WITH leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp, sha256({head} || {one("text")}) AS digest,
         CASE WHEN ({crc}) % 5 = 0 THEN sha256({head} || {one(lower)}) END AS forged
  FROM documents
), g0 AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS place, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), {", ".join(_level_sql("g", k) for k in range(depth))},
subroots AS ({nodes("g", depth)}),
t0 AS (SELECT '' AS grp, grp AS id, digest, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM subroots),
{", ".join(_level_sql("t", k) for k in range(over))},
root AS (SELECT digest FROM ({nodes("t", over)})),
nothing AS (SELECT '' AS grp, []::VARCHAR[][] AS chain, NULL::VARCHAR AS top),
{_chain_sql("t", "tc", over, "nothing")},
tops AS (SELECT t.id AS grp, c.chain, t.digest AS top FROM t0 t JOIN tc0 c USING (place)),
{_chain_sql("g", "gc", depth, "tops")},
folds AS (
  SELECT g.doc_id, g.digest AS leaf, c.top AS subroot, (SELECT digest FROM root) AS root,
         sha256(coalesce(list_aggregate(flatten(c.chain), 'string_agg', ''), '')) AS proof_sha256,
         list_reduce(c.chain, lambda a, x: [sha256(x[1] || a[1] || x[2])], [coalesce(g.forged, g.digest)])[1] AS folded_root
  FROM g0 g JOIN gc0 c USING (grp, place)
)
SELECT *, folded_root = root AS verified FROM folds
"""


ORACLE_SQL = oracle_sql()
