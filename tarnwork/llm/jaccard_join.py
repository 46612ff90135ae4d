"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles; a link joins two documents whose
sets have a Jaccard similarity of 0.8 or more.

1. Equal texts are one node with a count of its copies. A node's set is
   represented by SIGNATURE tokens, each the smallest under one hash function,
   so that two nodes share a token with the probability of their similarity.
2. In each run nodes are split by a sampled token. A bucket of more than
   SMALL nodes is split again by one or two (1.25 on average) tokens sampled
   by a hash of its path, until it is small, or a split keeps most of it
   together: then it holds near copies and is joined as a whole. Every other
   split leaves less than that share in a child, so splitting ends. Small buckets
   are compared by brute force on one-byte sketches of the tokens.
   A run finds a pair at the threshold in small buckets with probability of
   0.8, and in buckets split d times more with 0.8 * 0.84**d at least.
   Runs are repeated until the recall reaches TARGET. It is measured: the pairs
   of SAMPLED nodes with all others whose signatures agree in 0.8 or more of
   the places, found by comparing each with every node, in blocks.
3. Pairs whose sketches agree in SKETCH_SHARE or more of the places connect their
   nodes to families (their similarity is about 0.5 or more). Within a family
   every pair is checked exactly on whole shingle sets. Families are packed
   into cells of bounded size; one beyond that is dealt into blocks, and every
   pair of blocks is a task. A task returns, per node, its links and the
   smallest node that it is connected to, never the pairs.

Tables with one row per bucket meet those with one row per node by (path,
salt), the salt by the node, so a bucket that holds a third of all nodes is
spread over tasks while it is split.

So a hot text costs one node, a hot shingle is split away, and a large family
is spread over tasks of bounded memory.

Defined cases: words are separated by white space; fewer than five words are
one shingle; a null or empty text has no shingles, no links and a class of its
own per row; equal texts are linked (similarity 1); repeated rows are copies;
an empty table gives an empty result; other columns are not read. Rows with a
null doc_id are linked and counted like others; a class_id is null only where
all ids of the class are. Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, materialize
from .components import connected_components
from .shingles import run_hashes

WORDS = 5
#: The threshold as a fraction, for exact comparison.
SIMILAR = (4, 5)
SIGNATURE = 64
#: Runs before the recall is measured, and each time that it falls short.
RUNS, MORE_RUNS = 10, 6
#: The recall that runs are repeated for, and the nodes it is measured on.
TARGET, SAMPLED = 0.99, 100
SMALL = 64
#: Tasks that the nodes of a bucket are spread over.
SALTS = 16
#: The share of a bucket kept together by a split from which on it counts as near copies.
DENSE = 0.6
SKETCH_SHARE = 0.5
#: Nodes and shingles of a block at most, on average.
BLOCK_NODES, BLOCK_SHINGLES = 2048, 1_000_000
#: Stands for a null doc_id where texts meet their nodes.
LAST = 2**63 - 1

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(0, 2**63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(run_hashes((text or "").split(), WORDS))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value under each hash function."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(least, (shingles[i : i + 512, None] * _FACTORS[None, :]).min(axis=0), out=least)
    return least


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, node, n_shingles, tokens, sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, tokens, sketches = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py())
                least = signature(s)
                sizes.append(len(s))
                tokens.append(least.view(np.int64))
                # a middle byte; the high ones of a minimum are nearly always 0
                sketches.append((least >> np.uint64(16)).astype(np.uint8).tobytes())
            flat = pa.array(np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, SIGNATURE * len(sizes) + 1, SIGNATURE), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), lists, pa.array(sketches, pa.binary())], ["doc_id", "node", "n_shingles", "tokens", "sketch"])

    return docs.select("doc_id", "node", "text").mapInArrow(run, "doc_id long, node long, n_shingles int, tokens array<long>, sketch binary")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and the node of each row: a hash of its text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("node"))


def _salted(rows: DataFrame, per_key: DataFrame, key: str, how: str, by: str = "node") -> DataFrame:
    """rows joined to per_key (one row per key), the rows of a key spread over SALTS tasks by another column."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    spread = per_key.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(spread, [key, "salt"], how).drop("salt")


def _sizes(buckets: DataFrame, *more: Column) -> DataFrame:
    """path, n, head (the smallest node) of each path of buckets (path, node) with two nodes or more."""
    return buckets.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head"), *more).where("n > 1")


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each of n things the first that it is connected to by a symmetric boolean matrix."""
    n = len(linked)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            root[i] = i
            front = np.array([i])
            while len(front):
                near = linked[front].any(axis=0) & (root < 0)
                front = np.flatnonzero(near)
                root[front] = i
    return root


def _sketch_edges(buckets: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes of small buckets (path, node, sketch) whose sketches agree."""

    def edges(nodes: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        s = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), SIGNATURE)
        agree = (s[:, None, :] == s[None, :, :]).sum(axis=2, dtype=np.int32) >= SKETCH_SHARE * SIGNATURE
        root = _forest(agree)
        other = root != np.arange(len(root))
        return nodes[other], nodes[root[other]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def found(rows: pd.DataFrame) -> pd.DataFrame:
            path, node, sketch = rows["path"].to_numpy(), rows["node"].to_numpy(), rows["sketch"].tolist()
            cuts = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1], [True])))
            pairs = [edges(node[i:j], sketch[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if j - i > 1]
            if not pairs:
                return pd.DataFrame({"a": np.zeros(0, dtype=np.int64), "b": np.zeros(0, dtype=np.int64)})
            return pd.DataFrame({"a": np.concatenate([p[0] for p in pairs]), "b": np.concatenate([p[1] for p in pairs])}).drop_duplicates()

        for batch in batches:
            rows = batch if rest is None else pd.concat((rest, batch), ignore_index=True)
            if not len(rows):
                continue
            last = rows["path"].to_numpy() == rows["path"].iloc[-1]
            rest, rows = rows[last], rows[~last]
            if len(rows):
                yield found(rows)
        if rest is not None and len(rest):
            yield found(rest)

    return buckets.repartition("path").sortWithinPartitions("path").select("path", "node", "sketch").mapInPandas(run, "a long, b long")


def candidate_edges(nodes: DataFrame, runs: range = range(RUNS), small: int | None = None) -> DataFrame:
    """Edges that connect similar nodes of (node, tokens, sketch), by the chosen paths of some runs."""
    small = SMALL if small is None else small
    first = F.explode(F.array(*[F.xxhash64(F.lit(r), F.get("tokens", F.lit(r % SIGNATURE))) for r in runs])).alias("path")
    found, ready = [], []

    def sorted_out(rows: DataFrame, sizes: DataFrame) -> DataFrame:
        """The rows (path, node) of large paths, with n and head; those of small ones are ready."""
        marked = materialize(_salted(rows.select("path", "node"), sizes.where(F.col("n") > small).select("path", "n", "head"), "path", "left"))
        ready.append(marked.where("n is null").select("path", "node").join(sizes.where(F.col("n") <= small).select("path"), "path"))
        return marked.where("n is not null")

    buckets = nodes.select("node", first)
    large = sorted_out(buckets, materialize(_sizes(buckets)))
    while large.limit(1).count():
        place = lambda i: F.pmod(F.xxhash64("path", F.lit(i)), F.lit(SIGNATURE)).cast("int")
        twice = F.pmod(F.xxhash64("path", F.lit(-1)), F.lit(4)) == 0
        step = lambda i: F.xxhash64("path", F.lit(i), F.get("tokens", place(i)))
        children = F.explode(F.when(twice, F.array(step(0), step(1))).otherwise(F.array(step(0))))
        split = materialize(large.join(nodes.select("node", "tokens"), "node").select("node", F.col("path").alias("parent"), F.col("n").alias("parent_n"), children.alias("path")))
        sizes = materialize(_sizes(split, F.first("parent").alias("parent"), F.first("parent_n").alias("parent_n")))
        # a path that keeps most of its nodes together holds near copies
        dense = materialize(sizes.where(F.col("n") >= DENSE * F.col("parent_n")).select("parent").distinct())
        found.append(materialize(_salted(large, dense.withColumnRenamed("parent", "path"), "path", "inner").select(F.col("node").alias("a"), F.col("head").alias("b"))))
        others = _salted(split, dense, "parent", "left_anti")
        large = sorted_out(others, materialize(_salted(sizes, dense, "parent", "left_anti", by="path")))
    in_buckets = ready[0]
    for more in ready[1:]:
        in_buckets = in_buckets.union(more)
    edges = _sketch_edges(in_buckets.join(nodes.select("node", "sketch"), "node"))
    for more in found:
        edges = edges.union(more)
    return edges


def measured_recall(nodes: DataFrame, families: DataFrame, sampled: int = SAMPLED) -> float:
    """The share of the similar pairs of a sample of nodes with any node that families (node, component) have together."""
    sample = nodes.select("node", "tokens").orderBy(F.xxhash64("node"), "node").limit(sampled).collect()
    if not sample:
        return 1.0
    # a fixed number of signatures
    ids = np.array([r["node"] for r in sample], dtype=np.int64)
    signatures = np.array([r["tokens"] for r in sample], dtype=np.int64)
    least = -(-SIGNATURE * SIMILAR[0] // SIMILAR[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            tokens = batch.column(1).flatten().to_numpy().reshape(len(own), SIGNATURE)
            near = [np.flatnonzero(((tokens == s).sum(axis=1) >= least) & (own != i)) for i, s in zip(ids, signatures, strict=True)]
            at = np.concatenate(near)
            yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(np.repeat(ids, [len(x) for x in near]))], ["node", "sample"])

    pairs = nodes.select("node", "tokens").mapInArrow(run, "node long, sample long")
    of_sample = F.broadcast(families.where(F.col("node").isin(ids.tolist())).select(F.col("node").alias("sample"), F.col("component").alias("own")))
    met = pairs.join(families, "node", "left").join(of_sample, "sample", "left").agg(F.count(F.lit(1)), F.count_if(F.col("component") == F.col("own"))).first()
    return met[1] / met[0] if met[0] else 1.0


def families_of(nodes: DataFrame, target: float = TARGET) -> DataFrame:
    """node, component of the nodes (node, tokens, sketch) that runs connect; as many runs as the target recall takes."""
    done = RUNS
    edges = materialize(candidate_edges(nodes, range(done)))
    while True:
        families = connected_components(edges)
        recall = measured_recall(nodes, families)
        logging.getLogger(__name__).info("recall %.4f after %d runs", recall, done)
        if recall >= target:
            return families
        edges = edges.union(materialize(candidate_edges(nodes, range(done, done + MORE_RUNS))))
        done += MORE_RUNS


def shared_counts(sets: list[np.ndarray], n_left: int) -> np.ndarray:
    """The sizes of the intersections of the first n_left sets with the others (with each other if there are no others)."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    pairwise = n_left == len(sets)
    right_at = 0 if pairwise else n_left
    n_right = len(sets) - right_at
    out = np.zeros((n_left, n_right))
    # frequent shingles by dense products, rare ones by their pairs
    limit = max(8, len(sets) // 64)
    rank = np.full(len(values), -1)
    frequent = np.flatnonzero(df > limit)
    rank[frequent] = np.arange(len(frequent))
    at = rank[column]
    held = at >= 0
    rows, cols = owner[held], at[held]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    width = 1024
    for c in range(0, len(frequent), width):
        i, j = np.searchsorted(cols, (c, c + width))
        block = np.zeros((len(sets), min(width, len(frequent) - c)), dtype=np.float32)
        block[rows[i:j], cols[i:j] - c] = 1
        out += block[:n_left] @ block[right_at:].T
    rare = (df[column] > 1) & ~held
    rows, cols = owner[rare], column[rare]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    flat = out.reshape(-1)
    for shift in range(1, limit):
        same = cols[shift:] == cols[:-shift]
        if not same.any():
            break
        a, b = rows[:-shift][same], rows[shift:][same]
        if pairwise:
            np.add.at(flat, np.concatenate((a * n_right + b, b * n_right + a)), 1.0)
        else:
            cross = (a < n_left) & (b >= n_left)
            np.add.at(flat, a[cross] * n_right + b[cross] - right_at, 1.0)
    if pairwise:
        np.fill_diagonal(out, sizes)
    return out


def _check_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """node, links, root, whole for the rows of one task (family, side, node, copies, shingles, whole).

    side 2: the family's pairs are all here or in this block; sides 0 and 1: pairs between two blocks.
    """
    out = []
    num, den = SIMILAR
    rows = rows.drop_duplicates(["family", "side", "node"])
    for _, family in rows.groupby("family", sort=False):
        family = family.sort_values(["side", "node"])
        node, copies = family["node"].to_numpy(), family["copies"].to_numpy().astype(np.float64)
        sets = [np.frombuffer(b, dtype=np.uint64) for b in family["shingles"]]
        size = np.fromiter(map(len, sets), dtype=np.float64, count=len(sets))
        side = family["side"].to_numpy()
        n_left = len(sets) if side[0] == 2 else int((side == 0).sum())
        right = slice(0 if side[0] == 2 else n_left, None)
        if n_left == 0 or len(sets) - (right.start or 0) == 0:
            continue
        shared = shared_counts(sets, n_left)
        similar = (num + den) * shared >= num * (size[:n_left, None] + size[None, right])
        if side[0] == 2:
            np.fill_diagonal(similar, False)
            links, root = similar @ copies, _forest(similar)
        else:
            links = np.concatenate((similar @ copies[right], copies[:n_left] @ similar))
            # roots over both blocks: a bipartite walk
            root = np.full(len(sets), -1)
            for i in range(len(sets)):
                if root[i] < 0:
                    root[i] = i
                    front = np.array([i])
                    while len(front):
                        left, other = front[front < n_left], front[front >= n_left] - n_left
                        near = np.concatenate((similar[:, other].any(axis=1), similar[left].any(axis=0))) & (root < 0)
                        front = np.flatnonzero(near)
                        root[front] = i
        out.append(pd.DataFrame({"node": node, "links": links.astype(np.int64), "root": node[root], "whole": family["whole"].to_numpy()}))
    return pd.concat(out) if out else pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64), "whole": np.zeros(0, bool)})


def _exact_links(rows: DataFrame, nodes: DataFrame, families: DataFrame) -> DataFrame:
    """node, links, component of the nodes of families (node, component), checked on whole sets."""
    members = nodes.select("node", "doc_id", "copies", "n_shingles").join(families.withColumnRenamed("component", "family"), "node")
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    dealt = materialize(members.join(sizes.select("family", blocks.alias("blocks")), "family"))
    total = dealt.where("blocks = 1").agg(F.sum("n_shingles")).first()[0] or 0
    cells = max(1, -(-int(total) // BLOCK_SHINGLES) * 2)

    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(own == j, 2).when(own < j, 0).otherwise(1).alias("side")))
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.pmod(F.xxhash64("family"), F.lit(cells)).cast("int").alias("j"), F.lit(2).alias("side")))
    tasks = F.inline(F.when(F.col("blocks") == 1, whole).otherwise(others))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py()).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.binary())], ["node", "family", "copies", "blocks", "shingles"])

    # one row of each node brings the text; a node's copies stay behind. By a merge join at every size
    key = F.coalesce("doc_id", F.lit(LAST)).alias("key")
    wanted = dealt.select("node", key, "family", "copies", "blocks").hint("merge")
    texts = rows.select("node", key, "text").join(wanted, ["node", "key"]).dropDuplicates(["node", "key"])
    with_sets = texts.select("text", "node", "family", "copies", "blocks").mapInArrow(sets, "node long, family long, copies long, blocks int, shingles binary")
    spread = with_sets.select("node", "family", "copies", "shingles", (F.col("blocks") == 1).alias("whole"), tasks)
    task = F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(F.col("family"))
    checked = spread.withColumn("task", task).groupBy("task", "i", "j").applyInPandas(lambda pdf: _check_pairs(pdf), "node long, links long, root long, whole boolean")
    links = materialize(checked)
    per_node = links.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.first("whole").alias("whole"))
    split = links.where("not whole and root <> node")
    if not split.limit(1).count():
        return per_node.select("node", "links", F.col("root").alias("component"))
    joined = connected_components(split.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return per_node.join(joined, "node", "left").select("node", "links", F.coalesce("component", "root").alias("component"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, node, n_shingles of each row of docs (doc_id, text); and node, doc_id, copies, links, component of each node."""
    rows = _rows(docs)
    signed = materialize(_signed(rows))
    nodes = materialize(
        signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    )
    families = families_of(nodes)
    linked = materialize(_exact_links(rows, nodes, families))
    found = nodes.select("node", "doc_id", "copies").join(linked, "node", "left")
    per_node = materialize(found.select("node", "doc_id", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("component", "node").alias("component")))
    return signed.select("doc_id", "node", "n_shingles"), per_node


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links of each row of docs (doc_id, text).

    class_id is the smallest doc_id among the documents that links connect;
    n_links the number of other rows that the row is linked to.
    """
    signed, per_node = _classes(docs)
    class_ids = materialize(per_node.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")))
    result = materialize(_joined(per_node, class_ids, "component", "n").select("node", "copies", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links")))
    joined = _joined(signed.where("n_shingles > 0").select("doc_id", "node"), result, "node", "copies")
    alone = signed.where("n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return joined.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links").unionByName(alone)


def _joined(rows: DataFrame, per_key: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined to per_key, where n rows have the key: the line of a text or class with very many is broadcast, not shuffled to."""
    total = per_key.agg(F.sum(n)).first()[0] or 0
    side = per_key.withColumnRenamed(key, "__tw_key")
    return join_counted(rows, side, F.col(key) == F.col("__tw_key"), F.col(n), total).drop("__tw_key")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each class: that of the smallest doc_id.

    Rows are decided by doc_id and text, so a text stays or goes whatever other
    texts its id has. A null doc_id is equal to null and after all others, so
    texts of null ids stay unless their class has another row; of several texts
    of the smallest id in a class that of the smallest hash stays. Rows equal
    in both are one document: of them stays the row whose other columns come
    first as JSON. Texts without shingles are no copies and stay, every row.
    """
    own_id, own_node, goes = "__tw_doc_id", "__tw_node", "__tw_goes"
    signed, per_node = _classes(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "node")).alias("first")
    heads = materialize(per_node.groupBy("component").agg(first, F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("nodes")).where("rows > 1"))
    of_node = materialize(_joined(per_node.select("node", "copies", "component"), heads, "component", "nodes").select("node", "copies", "first"))
    decided = _joined(signed.where("n_shingles > 0").select("doc_id", "node"), of_node, "node", "copies").groupBy("node", "doc_id").agg(F.first("first").alias("first"), F.count(F.lit(1)).alias("n"))
    gone = (F.col("node") != F.col("first.node")) | ~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    decided = materialize(decided.select(F.col("doc_id").alias(own_id), F.col("node").alias(own_node), gone.alias(goes), "n").where(f"{goes} or n > 1"))

    keyed = docs.select("*", F.col("doc_id").cast("long").alias("__tw_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__tw_text"))
    same = (F.col("__tw_text") == F.col(own_node)) & F.col("__tw_id").eqNullSafe(F.col(own_id))
    kept = keyed.join(decided.where(goes).select(own_id, own_node).hint("merge"), same, "left_anti")
    repeated = decided.where(f"not {goes}").select(own_id, own_node)
    if not repeated.limit(1).count():
        return kept.select(*docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    one = kept.join(repeated.hint("merge"), same, "left_semi").groupBy("__tw_id", "__tw_text").agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    return kept.join(repeated.hint("merge"), same, "left_anti").select(*docs.columns).unionByName(one.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the whole documents table joined with itself."""
    from .common import table

    return join(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS doc, count(*) AS copies, list_filter(string_split_regex(coalesce(any_value(text), ''), '\s+'), lambda x: x <> '') AS w
  FROM documents GROUP BY coalesce(text, '')
), sets AS (
  SELECT doc, copies, list_distinct(list_transform(range(0, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS s FROM texts WHERE len(w) > 0
), tokens AS (SELECT doc, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc AS a, b.doc AS b, count(*) AS c FROM tokens a JOIN tokens b ON a.g = b.g AND a.doc <> b.doc GROUP BY ALL),
links AS (SELECT a, b, y.copies FROM shared JOIN sets x ON x.doc = a JOIN sets y ON y.doc = b WHERE 9 * c >= 4 * (len(x.s) + len(y.s))),
reach AS (SELECT doc AS a, doc AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
classes AS (SELECT a AS doc, min(b) AS class_id FROM reach GROUP BY 1),
counts AS (SELECT doc, sets.copies - 1 + coalesce(sum(links.copies), 0) AS n_links FROM sets LEFT JOIN links ON a = doc GROUP BY doc, sets.copies)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM documents d JOIN texts t ON coalesce(d.text, '') = t.text LEFT JOIN classes USING (doc) LEFT JOIN counts USING (doc)
"""
