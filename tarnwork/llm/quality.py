"""Quality classifier from positive and unlabelled documents.

A small network g scores features of a text. It is fitted by the non-negative
unbiased risk of positive-unlabelled learning with the sigmoid loss l:

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

over trusted positives P and unlabelled documents U; where the bounded term
is negative, the step goes against its gradient instead. Documents whose label
is 0 are never used as negatives, nor for the prior: it is estimated from P
and U alone. A network that tells P from U is fitted on one half of the sample;
on the other half the share of U above a score is at least prior times the
share of P above it, so the least ratio of the two, at the score where its
confidence bound is least, is the estimate (best bin).

Only rows whose crc32(doc_id as text) mod 3 is not 1 are learnt from. The fit
uses a bounded sample (FIT_ROWS positive and as many unlabelled rows, those
of the smallest hashes of id and text); every row is scored, from its whole
text. The features of the sample are all that reaches the driver. Scoring is a
scan: no shuffle, batches of bounded rows, nothing that a lost executor takes
along.

Features are shares of hashed words and of hashed triples of bytes, and
statistics of characters, words and lines, all by array operations over the
bytes of a batch of texts: never the label, language, source, id or the length
as such. What a text of over CHUNK bytes repeats is counted piece by piece.

Defined cases: a null text counts as empty and is scored; a document with
contradicting labels is no trusted positive; null labels and ids are none;
without any trusted positive every score is 0 where there are labels of 0
alone, and 1 where there are none; repeated rows count once in the sample and
get the same score; an empty table gives an empty result; other columns are
kept by ``keep_good`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN
from .shingles import _power_tables, mix

FOLDS, HELD_OUT = 3, 1
FIT_ROWS = 10_000
HIDDEN, EPOCHS, BATCH, STEP, SEED = 16, 60, 512, 0.01, 7
#: Confidence of the bound by which the prior is chosen.
DELTA = 0.1
#: Characters counted as symbols, one feature each.
SYMBOLS = "!?|*#$%&@=+_~^<>[]{}\\/:;"
#: Buckets of hashed words and of hashed byte triples, and their weight beside the statistics.
WORD_BUCKETS, BYTE_BUCKETS, HASHED_SCALE = 256, 256, 0.05
N_STATISTICS = 20 + len(SYMBOLS)
N_FEATURES = N_STATISTICS + WORD_BUCKETS + BYTE_BUCKETS
#: Bytes of text handled at once; a longer text goes through in pieces.
CHUNK = 1_000_000


def _table(members: bytes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(members)] = True
    return found


_SPACE, _UPPER, _LOWER, _DIGIT = _table(b" \t\n\v\f\r"), _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(bytes(range(48, 58)))
_WORDLIKE = _UPPER | _LOWER | _DIGIT | _table(bytes(range(128, 256)))
_CONTINUED = _table(bytes(range(128, 192)))
_STOP, _ENDING = _table(b"."), _table(b".,;:")


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class _Counts:
    """Sums over the pieces of a number of texts, from which their features follow."""

    NAMES = "words lines word_bytes word_bytes2 repeats pairs distinct_pairs triples distinct_triples distinct_words distinct_lines shouted ending stops odd_start odd_end".split()

    def __init__(self, n: int) -> None:
        self.n = n
        self.bytes_ = np.zeros((n, 256))
        self.longest = np.zeros(n)
        self.word_buckets, self.byte_buckets = np.zeros((n, WORD_BUCKETS)), np.zeros((n, BYTE_BUCKETS))
        self.sums = {k: np.zeros(n) for k in self.NAMES}

    def add(self, data: bytes, starts: np.ndarray, docs: np.ndarray) -> None:
        """Counts pieces of texts: piece i is of text docs[i], starts at starts[i] and ends with a line end."""
        n, m = self.n, len(data)
        a = np.frombuffer(data, dtype=np.uint8)
        of_byte = np.repeat(docs, np.diff(np.append(starts, m)))
        tally = lambda doc, where=None: np.bincount(doc if where is None else doc[where], minlength=n)
        self.bytes_ += np.bincount(of_byte * 256 + a, minlength=n * 256).reshape(n, 256)
        # the line end that separates pieces is no text
        self.bytes_[:, 10] -= tally(docs)
        if m >= 3:
            three = a[:-2].astype(np.uint32) | a[1:-1].astype(np.uint32) << np.uint32(8) | a[2:].astype(np.uint32) << np.uint32(16)
            bucket = (three * np.uint32(2654435761)) >> np.uint32(24)
            inside = of_byte[2:] == of_byte[:-2]
            self.byte_buckets += np.bincount((of_byte[:-2] * BYTE_BUCKETS + bucket.astype(np.int64))[inside], minlength=n * BYTE_BUCKETS).reshape(n, BYTE_BUCKETS)
        up, down = _power_tables(m + 1)
        prefix = np.zeros(m + 1, dtype=np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=prefix[1:])
        hashes = lambda s, e: mix((prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64))
        salt = mix(np.arange(1, n + 1, dtype=np.uint64))

        def distinct(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
            key, first = np.unique(h ^ salt[doc], return_index=True)
            return tally(doc[first])

        sums = self.sums
        s, e = _runs(~_SPACE[a])
        doc = of_byte[s]
        length = (e - s).astype(np.float64)
        sums["words"] += tally(doc)
        sums["word_bytes"] += np.bincount(doc, weights=length, minlength=n)
        sums["word_bytes2"] += np.bincount(doc, weights=length * length, minlength=n)
        np.maximum.at(self.longest, doc, length)
        h = hashes(s, e)
        self.word_buckets += np.bincount(doc * WORD_BUCKETS + (h >> np.uint64(56)).astype(np.int64) % WORD_BUCKETS, minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
        same = doc[1:] == doc[:-1]
        sums["repeats"] += tally(doc[1:], same & (h[1:] == h[:-1]))
        pair = mix(h[:-1] * np.uint64(3) + h[1:])
        sums["pairs"] += tally(doc[1:], same)
        sums["distinct_pairs"] += distinct(doc[1:][same], pair[same])
        if len(doc) > 2:
            same3 = doc[2:] == doc[:-2]
            sums["triples"] += tally(doc[2:], same3)
            sums["distinct_triples"] += distinct(doc[2:][same3], mix(pair[:-1] * np.uint64(3) + h[2:])[same3])
        sums["distinct_words"] += distinct(doc, h)
        upper, lower = (np.concatenate(([0], np.cumsum(t[a]))) for t in (_UPPER, _LOWER))
        sums["shouted"] += tally(doc, (upper[e] - upper[s] > 1) & (lower[e] == lower[s]))
        last, head = a[e - 1], a[s]
        for name, where in (("ending", _ENDING[last]), ("stops", _STOP[last]), ("odd_start", ~_WORDLIKE[head]), ("odd_end", ~_WORDLIKE[last])):
            sums[name] += tally(doc, where)
        s, e = _runs(a != 10)
        sums["lines"] += tally(of_byte[s])
        sums["distinct_lines"] += distinct(of_byte[s], hashes(s, e))

    def features(self) -> np.ndarray:
        x = np.zeros((self.n, N_FEATURES), dtype=np.float32)
        c, b = self.sums, self.bytes_
        total = b.sum(axis=1)
        chars = np.maximum(total - b[:, _CONTINUED].sum(axis=1), 1)
        words, lines = np.maximum(c["words"], 1), np.maximum(c["lines"], 1)
        upper, lower = b[:, _UPPER].sum(axis=1), b[:, _LOWER].sum(axis=1)
        mean = c["word_bytes"] / words
        x[:, 0] = total == 0
        x[:, 1] = upper / np.maximum(lower + upper, 1)
        x[:, 2] = b[:, _DIGIT].sum(axis=1) / chars
        x[:, 3] = b[:, _SPACE].sum(axis=1) / chars
        x[:, 4] = np.maximum(total / chars - 1, 0)
        x[:, 5] = mean / 10
        x[:, 6] = np.sqrt(np.maximum(c["word_bytes2"] / words - mean * mean, 0)) / 10
        x[:, 7] = self.longest / 50
        x[:, 8] = c["repeats"] / words
        x[:, 9] = 1 - c["distinct_pairs"] / np.maximum(c["pairs"], 1)
        x[:, 10] = 1 - c["distinct_triples"] / np.maximum(c["triples"], 1)
        x[:, 11] = c["shouted"] / words
        x[:, 12] = c["ending"] / words
        x[:, 13] = c["stops"] / words
        x[:, 14] = 1 - c["distinct_lines"] / lines
        x[:, 15] = np.log1p(words / lines) / 5
        x[:, 16] = c["distinct_words"] / words**0.9
        x[:, 17] = 1 - b[:, 33:127].sum(axis=1) / chars
        x[:, 18] = c["odd_start"] / words
        x[:, 19] = c["odd_end"] / words
        x[:, 20:N_STATISTICS] = b[:, list(SYMBOLS.encode())] / words[:, None]
        x[total == 0, 1:] = 0
        at = N_STATISTICS
        for counts in (self.word_buckets, self.byte_buckets):
            x[:, at : at + counts.shape[1]] = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
            at += counts.shape[1]
        return x


def features(texts: list[str | None]) -> np.ndarray:
    """One row of features per text, whole texts in chunks of bounded bytes; a piece of a longer text ends after a space."""
    counts = _Counts(len(texts))
    parts: list[bytes] = []
    starts: list[int] = []
    docs: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if parts:
            counts.add(b"".join(parts), np.array(starts), np.array(docs))
            parts.clear(), starts.clear(), docs.clear()
            held = 0

    for i, text in enumerate(texts):
        data = (text or "").encode()
        at = 0
        while at < len(data):
            end = min(len(data), at + CHUNK)
            if end < len(data):
                cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
                end = cut + 1 if cut > at else end
            # a text of several pieces shares them with no other, so that nothing depends on the batch
            if len(data) > CHUNK or held + end - at > CHUNK:
                flush()
            starts.append(held)
            docs.append(i)
            parts.append(data[at:end] + b"\n")
            held += end - at + 1
            at = end
        if len(data) > CHUNK:
            flush()
    flush()
    return counts.features()


def _fed(x: np.ndarray) -> np.ndarray:
    """Features on a scale where rare small values still show."""
    return np.sqrt(np.clip(x, 0, 4))


class Model:
    """One hidden layer over standardised features; all of it some ten thousand numbers."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, layers: list[np.ndarray]) -> None:
        self.mean, self.scale, self.layers = mean, scale, layers

    def margin(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(standardised(x, self.mean, self.scale) @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x).astype(np.float64), -30, 30)))


def standardised(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return ((_fed(x) - mean) / scale).clip(-8, 8)


def loss_and_gradient(layers: list[np.ndarray], x: np.ndarray, sign: float) -> tuple[float, list[np.ndarray]]:
    """Mean of l(sign * g) over x and its gradient."""
    w1, b1, w2, b2 = layers
    h = np.tanh(x @ w1 + b1)
    loss = 1 / (1 + np.exp(np.clip(sign * (h @ w2 + b2[0]), -30, 30)))
    slope = -sign * loss * (1 - loss) / len(x)
    back = np.outer(slope, w2) * (1 - h * h)
    return float(loss.mean()), [x.T @ back, back.sum(0), h.T @ slope, np.array([slope.sum()], dtype=x.dtype)]


def risk_and_step(layers: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float | None) -> tuple[float, list[np.ndarray]]:
    """The non-negative risk and the direction to step against; without a prior the risk of telling P from U."""
    (up_loss, up), (u_loss, u_down) = loss_and_gradient(layers, p, 1.0), loss_and_gradient(layers, u, -1.0)
    if prior is None:
        return up_loss + u_loss, [a + b for a, b in zip(up, u_down, strict=True)]
    down_loss, down = loss_and_gradient(layers, p, -1.0)
    rest = u_loss - prior * down_loss
    if rest >= 0:
        return prior * up_loss + rest, [prior * a + c - prior * b for a, b, c in zip(up, down, u_down, strict=True)]
    return prior * up_loss, [prior * b - c for b, c in zip(down, u_down, strict=True)]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int = EPOCHS) -> Model:
    """The network of least risk, by Adam; the same inputs give the same network."""
    rng = np.random.default_rng(SEED)
    every = _fed(np.vstack((positive, unlabelled)))
    mean, scale = every.mean(0), every.std(0) + 1e-3
    scale[N_STATISTICS:] /= HASHED_SCALE
    p, u = (standardised(x, mean, scale) for x in (positive, unlabelled))
    d = p.shape[1]
    layers = [rng.normal(0, N_STATISTICS**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    layers = [w.astype(np.float32) for w in layers]
    first, second, t = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    steps = max(20, max(len(p), len(u)) // BATCH)
    for epoch in range(epochs):
        rate = STEP * (1 - epoch / epochs)
        for _ in range(steps):
            a, b = p[rng.integers(len(p), size=BATCH)], u[rng.integers(len(u), size=BATCH)]
            t += 1
            for i, v in enumerate(risk_and_step(layers, a, b, prior)[1]):
                v = v + 1e-4 * layers[i]
                first[i] = 0.9 * first[i] + 0.1 * v
                second[i] = 0.999 * second[i] + 0.001 * v * v
                layers[i] = (layers[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, layers)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled rows, by the best bin of a network that tells the two apart."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    told = fit(positive[::2], unlabelled[::2], None, EPOCHS // 4)
    p, u = np.sort(told.margin(positive[1::2])), np.sort(told.margin(unlabelled[1::2]))
    at = np.unique(p)
    share_p = 1 - np.searchsorted(p, at) / len(p)
    share_u = 1 - np.searchsorted(u, at) / len(u)
    doubt = np.sqrt(np.log(4 / DELTA) / 2 / len(u)) + np.sqrt(np.log(4 / DELTA) / 2 / len(p))
    best = np.argmin((share_u + doubt) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _features_of(docs: DataFrame, keys: DataFrame, rows: int) -> np.ndarray:
    """Features of rows of docs (doc_id, digest, text), those of the smallest hashes of keys (doc_id, digest); equal rows count once."""
    chosen = F.broadcast(keys.distinct().orderBy(F.xxhash64("doc_id", "digest"), "doc_id", "digest").limit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(2).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_FEATURES), pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "digest", "x"])

    found = docs.join(chosen, ["doc_id", "digest"], "left_semi").select("doc_id", "digest", "text").mapInArrow(run, "doc_id long, digest long, x array<float>")
    # at most `rows` of them
    once = found.groupBy("doc_id", "digest").agg(F.first("x").alias("x")).toArrow()
    x = once.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)
    return x[np.lexsort((once.column("digest").to_numpy(), once.column("doc_id").to_numpy()))]


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[Model | None, float]:
    """The model, None without trusted positives, and the class prior."""
    text = F.coalesce("text", F.lit(""))
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text")).where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    per_id = known.groupBy("doc_id").agg(F.min("quality").alias("least"))
    some, trusted = per_id.agg(F.count(F.lit(1)), F.count_if(F.col("least") == 1)).first()
    if not trusted:
        return None, 0.0 if some else 1.0
    keys = usable.select("doc_id", "digest")
    p = _features_of(usable, keys.join(per_id.where("least = 1").select("doc_id"), "doc_id", "left_semi"), rows)
    u = _features_of(usable, keys, rows)
    if not len(p) or not len(u):
        return None, 1.0
    prior = estimated_prior(p, u)
    return fit(p, u, prior), prior


def score(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """docs with one more column, the score."""
    model, prior = train(docs, labels, rows)
    if model is None:
        return docs.withColumn(f"{OWN}score", F.lit(float(prior)))
    sent = docs.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.layers))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*sent.value)
        for texts in batches:
            yield pd.Series(own.score(features(texts.tolist())))

    # not deterministic to the optimizer, so that a filter on the score does not compute it twice
    return docs.withColumn(f"{OWN}score", F.pandas_udf(run, "double").asNondeterministic()(F.col("text")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, with the columns of docs."""
    return score(docs, labels).where(F.col(f"{OWN}score") >= 0.5).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document scored."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = F.col(f"{OWN}score")
    return score(docs, table(spark, sf_dir, "labels")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))
