"""Hard negatives of anchors by bit-sliced integer products.

A component becomes an integer, and an integer its bits in two's complement.
The product of an anchor with a row is the sum, over the bit-planes of the
row, of the plane's weight times the sum of the anchor's components where the
bit is set. Planes are processed from the most significant down. With k planes
left a component can grow by 0 to 2 ** k - 1, so the score lies between the
part known plus (2 ** k - 1) times the anchor's negative components and the
part known plus (2 ** k - 1) times its positive ones. The interval halves with
each plane, and a pair is dropped as soon as its interval misses every window
asked for, or ends below the k-th largest lower end among the pairs that are
certain to be within the window. What is left after the last plane has its
exact score. While many pairs of a tile are left, a plane is one matrix
product; after that only the pairs left are looked up.

Spark deals the work: rows and anchors go to blocks of bounded size, a pair of
blocks meets in one task, and gives each anchor's best few; a window over them
picks the best of all blocks. Positives come first, within a label, whose
blocks are counted per label, so a label of a third of all rows has a third of
the blocks; then negatives, between all blocks, within the windows that the
positives' scores set.

Defined cases: rows with a null label, a null vector or a component null, NaN
or infinite take no part; vectors shorter than the longest count as padded
with zeros; a null id comes after all others and is no anchor; rows of one id
are rows of their own (an anchor's other rows are all rows but itself), rows
of one score and id are in no defined order, but they differ in nothing that
is returned; a positive without negatives, or an anchor without positives,
gives no row; an empty table gives an empty result; other columns are not
read. Components so large that a score might exceed 2 ** 55 are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SCALE = 256
ANCHOR_EVERY = 50
POSITIVES, NEGATIVES = 5, 3
#: Rows of a block, and anchors of one, at most on average; rows at least, where tables are small.
ROWS, ANCHORS, LEAST_ROWS = 32_768, 8_192, 1_024
#: Anchors and rows of a tile, which is worked on at once; the share of its pairs from which they are looked up one by one.
TILE_ANCHORS, TILE_ROWS, SPARSE = 256, 4_096, 1 / 16
#: Pairs looked up at once.
GATHER = 65_536
FAR = np.int64(1) << 60


def bit_planes(q: np.ndarray, bits: int, kind: type) -> Iterator[tuple[int, int, np.ndarray]]:
    """Weight, planes left after it, and 0/1 matrix of each bit of q in two's complement, most significant first."""
    for k in range(bits - 1, -1, -1):
        yield (-(1 << k) if k == bits - 1 else 1 << k), k, ((q >> k) & 1).astype(kind)


def kth_largest(slots: np.ndarray, values: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th largest value of each slot (of n); -FAR where it has fewer."""
    out = np.full(n, -FAR)
    order = np.lexsort((-values, slots))
    slots, values = slots[order], values[order]
    first = np.searchsorted(slots, np.arange(n))
    at = first + k - 1
    enough = at < np.searchsorted(slots, np.arange(n), side="right")
    out[enough] = values[at[enough]]
    return out


def search(anchors: np.ndarray, rows: np.ndarray, lows: np.ndarray, highs: np.ndarray, k: int, bits: int, order: np.ndarray, allowed: Callable[[slice, slice], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows (score descending, then order ascending) of each anchor and window: slot, row, score.

    anchors and rows are integer matrices; lows and highs (anchors x windows)
    bound the scores of a window, inclusive; slot is anchor * windows + window.
    allowed gives the pairs of a tile that count, as a matrix.
    """
    many, windows = lows.shape
    slots, found, scores = (np.empty(0, np.int64) for _ in range(3))
    widest = np.abs(anchors).sum(1).max(initial=0) * (1 << bits)
    kind = np.float32 if widest < 1 << 24 else np.float64 if widest < 1 << 53 else np.int64
    for r0 in range(0, len(rows), TILE_ROWS):
        at_rows = slice(r0, min(r0 + TILE_ROWS, len(rows)))
        planes = list(bit_planes(rows[at_rows], bits, kind))
        for a0 in range(0, many, TILE_ANCHORS):
            at = slice(a0, min(a0 + TILE_ANCHORS, many))
            best = kth_largest(slots, scores, k, many * windows).reshape(many, windows)[at] if len(slots) else np.full((at.stop - a0, windows), -FAR)
            mine = _tile(anchors[at], planes, lows[at], highs[at], best, k, allowed(at, at_rows), kind)
            slots, found, scores = (np.concatenate(x) for x in zip((slots, found, scores), (mine[0] + a0 * windows, mine[1] + r0, mine[2]), strict=True))
        ranked = np.lexsort((order[found], -scores, slots))
        slots, found, scores = slots[ranked], found[ranked], scores[ranked]
        top = np.arange(len(slots)) - np.searchsorted(slots, slots) < k
        slots, found, scores = slots[top], found[top], scores[top]
    return slots, found, scores


def _tile(anchors, planes, lows, highs, best, k, allowed, kind):
    """Pairs of a tile within a window and not below best, with their exact scores; best is changed."""
    n, windows = lows.shape
    plus, minus = anchors.clip(0).sum(1), anchors.clip(None, 0).sum(1)
    own = anchors.astype(kind)
    part = np.zeros(allowed.shape, kind)
    pairs = None
    for weight, left, plane in planes:
        rest = (1 << left) - 1
        if pairs is None:
            part += weight * (own @ plane.T)
            if windows == 1 and part.shape[1] >= k:
                # pairs certain to be within the window: all, where it has no upper end
                open_ended = highs[:, 0] >= FAR
                held = np.where(allowed, part, -np.inf if kind != np.int64 else -FAR)
                kth = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
                known = np.isfinite(kth) & open_ended
                lower = np.where(known, np.where(known, kth, 0).astype(np.int64) + rest * minus, -FAR)
                best[:, 0] = np.maximum(best[:, 0], np.where(lower >= lows[:, 0], lower, -FAR))
            floor, top = np.maximum(lows, best).min(1), highs.max(1)
            keep = allowed & (part >= (floor - rest * plus)[:, None].astype(np.float64)) & (part <= (top - rest * minus)[:, None].astype(np.float64))
            if keep.mean() <= SPARSE:
                a, r = np.nonzero(keep)
                pairs, score = (a, r), part[a, r].astype(np.int64)
            continue
        a, r = pairs
        for i in range(0, len(a), GATHER):
            some = slice(i, i + GATHER)
            score[some] += weight * np.einsum("ij,ij->i", own[a[some]], plane[r[some]]).astype(np.int64)
        keep = np.zeros(len(a), bool)
        low, high = score + rest * minus[a], score + rest * plus[a]
        for j in range(windows):
            sure = (low >= lows[a, j]) & (high <= highs[a, j])
            best[:, j] = np.maximum(best[:, j], kth_largest(a[sure], low[sure], k, n))
            keep |= (high >= np.maximum(lows[a, j], best[a, j])) & (low <= highs[a, j])
        pairs, score = (a[keep], r[keep]), score[keep]
    if pairs is None:
        a, r = np.nonzero(keep) if planes else np.nonzero(allowed)
        pairs, score = (a, r), part[a, r].astype(np.int64)
    a, r = pairs
    out = []
    for j in range(windows):
        within = (score >= np.maximum(lows[a, j], best[a, j])) & (score <= highs[a, j])
        out.append((a[within] * windows + j, r[within], score[within]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def prepare(vectors: DataFrame) -> DataFrame:
    """The rows that take part: vec_id, label and q, the scaled integers."""
    x = F.col("embedding")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    label = F.col("label").cast("long")
    return vectors.where(label.isNotNull() & x.isNotNull() & good).select("vec_id", label.alias("label"), q.alias("q"))


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    whole = column.combine_chunks()
    flat = whole.flatten() if isinstance(whole, (pa.ListArray, pa.LargeListArray)) else pa.concat_arrays([c.flatten() for c in whole.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def _ordered(part: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """part, and the rank of each row by vec_id (nulls last), then row."""
    ids = part["vec_id"].combine_chunks()
    null = ids.is_null().to_numpy(zero_copy_only=False)
    known = ids.fill_null(0).to_numpy(zero_copy_only=False)
    ranks = np.empty(part.num_rows, np.int64)
    ranks[np.lexsort((part["row"].to_numpy(), known, null))] = np.arange(part.num_rows)
    return part, ranks


def _positives(bits: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def best(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows, order = _ordered(rows)
        own, others = anchors["row"].to_numpy(), rows["row"].to_numpy()
        shape = (anchors.num_rows, 1)
        if not anchors.num_rows or not rows.num_rows:
            slots = found = scores = np.empty(0, np.int64)
        else:
            slots, found, scores = search(
                _matrix(anchors["q"], anchors.num_rows), _matrix(rows["q"], rows.num_rows), np.full(shape, -FAR), np.full(shape, FAR), k, bits, order, lambda a, r: own[a, None] != others[None, r]
            )
        return pa.table({"anchor": pa.array(own[slots], pa.int64()), "row": pa.array(others[found], pa.int64()), "vec_id": rows["vec_id"].combine_chunks().take(pa.array(found)), "score": pa.array(scores, pa.int64())})

    return best


def _negatives(bits: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def best(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows, order = _ordered(rows)
        others = rows["row"].to_numpy()
        slots, found, scores = (np.empty(0, np.int64) for _ in range(3))
        width = 1
        if anchors.num_rows and rows.num_rows:
            asked = anchors["positive_scores"].to_pylist()
            width = max(map(len, asked))
            shape = (len(asked), width)
            lows, highs = np.full(shape, FAR), np.full(shape, -FAR)  # a window that nothing is in
            for i, scores_of in enumerate(asked):
                lows[i, : len(scores_of)] = [-(-s // 2) for s in scores_of]
                highs[i, : len(scores_of)] = [95 * s // 100 for s in scores_of]
            mine, theirs = anchors["label"].to_numpy(), rows["label"].to_numpy()
            slots, found, scores = search(_matrix(anchors["q"], len(asked)), _matrix(rows["q"], rows.num_rows), lows, highs, k, bits, order, lambda a, r: mine[a, None] != theirs[None, r])
        own = anchors["row"].to_numpy()
        return pa.table({"anchor": pa.array(own[slots // width], pa.int64()), "place": pa.array((slots % width).astype(np.int32), pa.int32()), "row": pa.array(others[found], pa.int64()), "vec_id": rows["vec_id"].combine_chunks().take(pa.array(found)), "score": pa.array(scores, pa.int64())})

    return best


def _best(rows: DataFrame, by: list[str], k: int, rank: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def _dealt(anchors: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with a_block and r_block: each anchor once for each block of rows, each row once for each block of anchors, as many as their columns a_blocks and r_blocks say."""
    deal = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    left = anchors.withColumn("a_block", deal("a_blocks")).withColumn("r_block", every("r_blocks"))
    right = rows.withColumn("r_block", deal("r_blocks")).withColumn("a_block", every("a_blocks"))
    left, right = left.drop("a_blocks", "r_blocks"), right.drop("a_blocks", "r_blocks")
    return left.toDF(*left.columns), right  # new names for columns that both sides read from one table


def mine(prepared: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Hard negatives from rows (vec_id, label, q): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    The window of a positive's negatives is half to 95 hundredths of its score.
    """
    spark = prepared.sparkSession
    rows = materialize(prepared.withColumn("row", F.monotonically_increasing_id()))
    size, lowest, highest = F.max(F.size("q")), F.min(F.array_min("q")), F.max(F.array_max("q"))
    total, d, low, high = rows.agg(F.count(F.lit(1)), size, lowest, highest).first()
    d, low, high = d or 0, low or 0, high or 0
    bits = max((-low - 1).bit_length() if low < 0 else 0, high.bit_length() if high > 0 else 0) + 1
    if max(d, 1) << (2 * bits - 2) > 1 << 55:
        raise ValueError(f"scores of {d} components of {bits} bits may exceed 2 ** 55: scale the vectors down")
    rows = rows.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(max(d, 1)) - F.size("q"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = min(ROWS, max(LEAST_ROWS, total // (2 * parts)))
    blocks = lambda n, each: F.greatest(F.lit(1), F.ceil(n / each)).cast("int")
    per_label = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("n_anchors"))
    # labels of more than a block: fewer than there are blocks
    large = per_label.where(F.col("n") > block).select("label", blocks(F.col("n_anchors"), ANCHORS).alias("a_blocks"), blocks(F.col("n"), block).alias("r_blocks"))
    sized = rows.join(F.broadcast(materialize(large)), "label", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("a_blocks", "r_blocks")})
    left, right = _dealt(sized.where(is_anchor), sized)
    near = left.groupBy("label", "a_block", "r_block").cogroup(right.groupBy("label", "a_block", "r_block")).applyInArrow(_positives(bits, positives), "anchor long, row long, vec_id long, score long")
    chosen = materialize(_best(near, ["anchor"], positives, "place"))
    asked = chosen.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("positive_scores"))
    anchors = materialize(rows.where(is_anchor).join(asked.withColumnRenamed("anchor", "row"), "row"))
    n_anchors = anchors.count()
    counts = {"a_blocks": F.lit(max(1, -(-n_anchors // ANCHORS))), "r_blocks": F.lit(max(1, -(-total // block)))}
    left, right = _dealt(anchors.drop("vec_id").withColumns(counts), rows.withColumns(counts))
    far = left.groupBy("a_block", "r_block").cogroup(right.groupBy("a_block", "r_block")).applyInArrow(_negatives(bits, negatives), "anchor long, place int, row long, vec_id long, score long")
    found = _best(far, ["anchor", "place"], negatives, "rank").select("anchor", (F.col("place") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = chosen.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(pairs, ["anchor", "place"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), s AS (
  SELECT a.vec_id AS a, a.label AS la, b.vec_id AS b, b.label AS lb, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT a, b, score FROM s WHERE la = lb QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER w::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND s.la <> s.lb AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)
QUALIFY row_number() OVER w <= 3
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the whole embeddings table; labels of ids divisible by 7 are moved on, anchors are ids divisible by 50."""
    rows = prepare(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.coalesce(F.col("vec_id") % ANCHOR_EVERY == 0, F.lit(False)))
