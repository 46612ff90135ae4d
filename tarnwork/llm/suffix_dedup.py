"""Exact removal of repeated passages by a sparse suffix array.

A window of MIN_WORDS consecutive words that occurred before, by (doc_id,
place), is a repeat; the words of all repeats are removed, so one occurrence of
every passage stays, the first.

1. Of the suffixes of a text only those at minimisers are retained: the place,
   in each window, of the smallest hash of GRAM consecutive words. The content
   alone selects it, so equal windows retain the same suffix of theirs, and
   every window has exactly one.
2. Suffixes are ordered by their first GRAM words (by hash, a total order like
   any other). Where no neighbour has the same, nothing can repeat: most
   suffixes end here, as narrow rows.
3. The others are sorted by the words that follow. The longest common prefix
   with both neighbours bounds every match to the right; the words before the
   suffix extend it to the left. Within a run of equal GRAM words each window
   around the suffix is looked up by a hash of the words on both sides, its
   first occurrence stays and the others are marked.
   A run of more than HOT suffixes is not brought to one task: there the
   windows are grouped as rows, with partial aggregation.

Equal texts are one text here; all but the first document of them are repeats
as a whole. Rows that leave a task are bounded by the text: a suffix has the
40 words before and after it at most.

Defined cases: words are separated by white space; null, empty and short texts
(under MIN_WORDS words) keep everything; a null doc_id counts as the last;
rows of equal doc_id and text share their decision; an empty table gives an
empty result; ``clean`` keeps all columns and updates n_chars where there is
one. Texts and words are told apart by 64- and 32-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, materialize
from .shingles import mix, run_hashes

MIN_WORDS, GRAM = 50, 10
SIDE = MIN_WORDS - GRAM
#: Suffixes of one run of equal first words that a task takes.
HOT = 20_000
LAST = 2**63 - 1


def minimisers(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of a text's minimisers, the hashes of the words there, and the fewest and most words before them in their windows."""
    if len(words) < MIN_WORDS:
        empty = np.zeros(0, dtype=np.int64)
        return empty, np.zeros(0, dtype=np.uint64), empty, empty
    grams = run_hashes(words, GRAM)
    windows = np.lib.stride_tricks.sliding_window_view(grams, SIDE + 1)
    # in pieces, since a very long text has many windows
    least = np.concatenate([windows[i : i + 65_536].argmin(axis=1) for i in range(0, len(windows), 65_536)])
    place, first, count = np.unique(np.arange(len(windows)) + least, return_index=True, return_counts=True)
    return place, grams[place], place - (first + count - 1), place - first


def _retained(rows: DataFrame) -> DataFrame:
    """doc_id, node, n_words, grams (distinct), times of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, grams, times = [], [], []
            for text in batch.column(2):
                words = text.as_py().split()
                distinct, count = np.unique(minimisers(words)[1], return_counts=True)
                n_words.append(len(words))
                grams.append(distinct.view(np.int64))
                times.append(count.astype(np.int32))
            at = pa.array(np.concatenate(([0], np.cumsum([len(g) for g in grams]))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x) if x else np.zeros(0, dtype=kind))) for x, kind in ((grams, np.int64), (times, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int32()), *lists], ["doc_id", "node", "n_words", "grams", "times"])

    return rows.select("doc_id", "node", "text").mapInArrow(run, "doc_id long, node long, n_words int, grams array<long>, times array<int>")


def _suffixes(texts: DataFrame) -> DataFrame:
    """Rows of the suffixes of (doc, node, text, wanted) that begin with a wanted gram: the words on both sides as hashes.

    Where a text repeats a suffix with all the words of its windows, the first
    place is a row like others. The further places are repeats whatever other
    texts hold: neighbouring ones are one row, marked, under a gram of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"doc": pa.int64(), "node": pa.int64(), "gram": pa.int64(), "place": pa.int32(), "fewest": pa.int32(), "most": pa.int32(), "before": pa.binary(), "after": pa.binary(), "again": pa.bool_()}
        for batch in batches:
            out: dict[str, list] = {k: [] for k in kinds}
            add = lambda *row: [v.append(x) for v, x in zip(out.values(), row, strict=True)]  # noqa: B023, E731
            for doc, node, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.split()
                place, gram, fewest, most = minimisers(words)
                kept = np.isin(gram.view(np.int64), np.array(wanted))
                hashes = (run_hashes(words, 1) >> np.uint64(32)).astype(">u4")
                seen, further = set(), None
                for p, g, lo, hi in zip(place[kept].tolist(), gram[kept].view(np.int64).tolist(), fewest[kept].tolist(), most[kept].tolist(), strict=True):
                    before, after = hashes[p - hi : p][::-1].tobytes(), hashes[p + GRAM : p + MIN_WORDS - lo].tobytes()
                    if (known := (g, lo, hi, before, after)) not in seen:
                        seen.add(known)
                        add(doc, node, g, p, lo, hi, before, after, False)
                    elif further is not None and p - hi <= further[1] + 1:
                        further[1] = max(further[1], p - lo)
                    else:
                        if further is not None:
                            add(doc, node, node, further[1], 0, further[1] - further[0], b"", b"", True)
                        further = [p - hi, p - lo]
                if further is not None:
                    add(doc, node, node, further[1], 0, further[1] - further[0], b"", b"", True)
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], list(out))

    return texts.select("doc", "node", "text", "wanted").mapInArrow(run, "doc long, node long, gram long, place int, fewest int, most int, before binary, after binary, again boolean")


def _padded(parts: list[bytes]) -> np.ndarray:
    """Word hashes as rows of SIDE places, 0 where there are none."""
    return np.frombuffer(b"".join(p.ljust(4 * SIDE, b"\0") for p in parts), dtype=">u4").reshape(len(parts), SIDE).astype(np.uint64)


def window_hashes(rows: pd.DataFrame, in_order: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window with l words before the suffix, for each row and l = 0..SIDE, and whether it may repeat.

    A window counts only if the row's suffix is its own and, where the rows are
    whole runs in order, one of the row's neighbours agrees on its words to the
    right.
    """
    before, after = _padded(rows["before"].tolist()), _padded(rows["after"].tolist())
    gram = rows["gram"].to_numpy().view(np.uint64)
    agree = np.full(max(len(rows) - 1, 0), SIDE) if not in_order else (after[1:] == after[:-1]).cumprod(axis=1).sum(axis=1) * (gram[1:] == gram[:-1]) if len(rows) > 1 else np.zeros(0, dtype=np.int64)
    # beside the first and last row stand rows of other tasks: no bound for them
    right = np.maximum(np.concatenate(([SIDE], agree)), np.concatenate((agree, [SIDE])))
    steps = np.cumprod(np.full(SIDE, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64), dtype=np.uint64)
    zero = np.zeros((len(rows), 1), dtype=np.uint64)
    left_hash = np.concatenate((zero, np.cumsum((before + np.uint64(1)) * steps, axis=1, dtype=np.uint64)), axis=1)
    right_hash = np.concatenate((zero, np.cumsum((after + np.uint64(1)) * steps, axis=1, dtype=np.uint64)), axis=1)
    words = np.arange(SIDE + 1)
    h = mix(gram[:, None] + mix(left_hash) + mix(right_hash[:, ::-1] ^ np.uint64(0x5851F42D4C957F2D)) + words.astype(np.uint64))
    valid = (words >= rows["fewest"].to_numpy()[:, None]) & (words <= rows["most"].to_numpy()[:, None]) & (SIDE - words <= right[:, None])
    return h, valid


def _ranges(marked: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last start of each run of marked windows."""
    edge = np.diff(np.pad(marked.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return row, place[row] - (high - 1), place[row] - low


def _mark(rows: pd.DataFrame) -> pd.DataFrame:
    """node, first, last: starts of the windows of whole runs of suffixes that are not the first of their kind."""
    again_rows = rows[rows["again"]]
    rows = rows[~rows["again"]]
    own = pd.DataFrame({"node": again_rows["node"].to_numpy(), "first": (again_rows["place"] - again_rows["most"]).to_numpy(), "last": (again_rows["place"] - again_rows["fewest"]).to_numpy()})
    if not len(rows):
        return own
    h, valid = window_hashes(rows)
    row, words = np.nonzero(valid)
    doc, place = rows["doc"].to_numpy()[row], rows["place"].to_numpy()[row] - words
    keys = h[row, words]
    order = np.lexsort((place, doc, keys))
    again = np.zeros(len(order), dtype=bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    marked = np.zeros(valid.shape, dtype=bool)
    marked[row[again], words[again]] = True
    r, first, last = _ranges(marked, rows["place"].to_numpy())
    return pd.concat((own, pd.DataFrame({"node": rows["node"].to_numpy()[r], "first": first.astype(np.int32), "last": last.astype(np.int32)})))


def _mark_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """_mark over a partition sorted by suffix, whole runs at a time."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if rest is None else pd.concat((rest, batch), ignore_index=True)
        if not len(rows):
            continue
        last = rows["gram"].to_numpy() == rows["gram"].iloc[-1]
        rest, rows = rows[last].reset_index(drop=True), rows[~last].reset_index(drop=True)
        if len(rows):
            yield _mark(rows)
    if rest is not None and len(rest):
        yield _mark(rest)


def _window_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node, doc, start, window: the windows of a part of a run, as rows."""
    for rows in batches:
        if len(rows):
            h, valid = window_hashes(rows.reset_index(drop=True), in_order=False)
            row, words = np.nonzero(valid)
            yield pd.DataFrame({"node": rows["node"].to_numpy()[row], "doc": rows["doc"].to_numpy()[row], "start": (rows["place"].to_numpy()[row] - words).astype(np.int32), "window": h[row, words].view(np.int64)})


def _mark_hot(suffixes: DataFrame) -> DataFrame:
    """As _mark, for runs too long for a task: windows are grouped with partial aggregation."""
    windows = suffixes.mapInPandas(_window_rows, "node long, doc long, start int, window long")
    in_doc = windows.groupBy("window", "doc", "node").agg(F.min("start").alias("head"), F.sort_array(F.collect_list("start")).alias("starts"))
    in_doc = materialize(in_doc)
    first = in_doc.groupBy("window").agg(F.min("doc").alias("first_doc"))
    marked = in_doc.join(first, "window").select("node", F.explode(F.when(F.col("doc") == F.col("first_doc"), F.slice("starts", F.lit(2), F.greatest(F.size("starts"), F.lit(1)))).otherwise(F.col("starts"))).alias("start"))
    return marked.select("node", F.col("start").alias("first"), F.col("start").alias("last"))


def _spans(ranges: DataFrame) -> DataFrame:
    """node, spans: the words covered by marked windows, as merged [start, end) intervals."""

    def merged(ranges: pd.Series) -> pd.Series:
        def one(found: list) -> list[dict]:
            spans: list[list[int]] = []
            for first, last in sorted((r["first"], r["last"]) for r in found):
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], last + MIN_WORDS)
                else:
                    spans.append([first, last + MIN_WORDS])
            return [{"start": a, "end": b} for a, b in spans]

        return ranges.map(one)

    kind = "array<struct<start:int,end:int>>"
    union = F.pandas_udf(lambda s: merged(s), kind)
    return ranges.groupBy("node").agg(F.collect_list(F.struct("first", "last")).alias("ranges")).select("node", union("ranges").alias("spans"))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("node"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, node, n_words, spans: the words [start, end) of each row that occurred before."""
    rows = _rows(docs)
    retained = materialize(_retained(rows))
    order = F.coalesce("doc_id", F.lit(LAST))
    heads = materialize(retained.groupBy("node").agg(F.min(order).alias("doc")))

    suffix = retained.select("node", F.inline(F.arrays_zip("grams", "times"))).withColumnsRenamed({"grams": "gram", "times": "t"})
    runs = suffix.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t")).where("t > 1").select("gram", "n")
    found = suffix.join(runs, "gram").groupBy("node").agg(F.collect_set("gram").alias("wanted"), F.collect_set(F.when(F.col("n") > HOT, F.col("gram"))).alias("hot"))
    wanted = materialize(heads.join(found, "node"))
    # the first row of each text brings the words
    first_row = wanted.select("node", "doc", "wanted")
    # by a merge join at every size
    texts = rows.withColumn("doc", order).join(first_row.hint("merge"), ["node", "doc"])
    if _has_repeated_rows(retained):
        texts = texts.dropDuplicates(["node", "doc"])
    suffixes = _suffixes(texts)
    if wanted.where("size(hot) > 0").limit(1).count():
        hot = materialize(wanted.select(F.explode("hot").alias("gram")).distinct())
        suffixes = materialize(suffixes)
        cold = suffixes.join(hot, "gram", "left_anti")
        extra = _mark_hot(suffixes.join(hot, "gram", "left_semi"))
    else:
        cold, extra = suffixes, None
    marked = cold.repartition("gram").sortWithinPartitions("gram", "after").mapInPandas(_mark_runs, "node long, first int, last int")
    spans = _spans(marked if extra is None else marked.union(extra))

    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    every = retained.select("doc_id", "node", "n_words").join(heads, "node").join(spans, "node", "left")
    decided = F.when(order == F.col("doc"), F.coalesce("spans", none)).when(F.col("n_words") >= MIN_WORDS, whole).otherwise(none)
    return every.select("doc_id", "node", "n_words", decided.alias("spans"))


def _has_repeated_rows(retained: DataFrame) -> bool:
    """Whether an id comes twice with one text."""
    return bool(retained.groupBy("doc_id", "node").count().where("count > 1").limit(1).count())


_WORD = re.compile(r"\S+")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and the white space after them."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = starts[b]
    return "".join(out) + text[at:]


def clean(docs: DataFrame) -> DataFrame:
    """docs with the repeats cut out of their texts; all columns and rows stay."""

    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut(t, [(x["start"], x["end"]) for x in s]) if s is not None and len(s) else t for t, s in zip(texts, spans, strict=True)], dtype=object)

    decided = materialize(repeats(docs).where("size(spans) > 0").select(F.coalesce("doc_id", F.lit(LAST)).alias(f"{OWN}doc"), F.col("node").alias(f"{OWN}node"), F.col("spans").alias(f"{OWN}spans")).distinct())
    keys = (F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)) == F.col(f"{OWN}doc")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(f"{OWN}node"))
    joined = docs.join(decided.hint("merge"), keys, "left").withColumn("text", F.pandas_udf(lambda t, s: run(t, s), "string")("text", f"{OWN}spans"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.lit(0).cast("long")))
    return joined.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the repeated passages of the whole documents table."""
    from .common import table

    found = repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    written = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), removed.cast("long").alias("n_removed"), written.alias("spans"))


ORACLE_SQL = r"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
heads AS (SELECT text, min(doc_id) AS doc_id, any_value(w) AS w FROM rows GROUP BY text),
windows AS (SELECT doc_id, start, md5(array_to_string(w[start + 1 : start + 50], ' ')) AS h FROM heads, unnest(range(0, len(w) - 49)) u(start)),
again AS (SELECT doc_id, start FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, start) AS k FROM windows) WHERE k > 1),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS i FROM (SELECT *, CASE WHEN start <= lag(start) OVER (PARTITION BY doc_id ORDER BY start) + 50 THEN 0 ELSE 1 END AS fresh FROM again)),
spans AS (SELECT doc_id, min(start) AS a, max(start) + 50 AS b FROM islands GROUP BY doc_id, i),
merged AS (SELECT doc_id, sum(b - a) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS s FROM spans GROUP BY 1)
SELECT r.doc_id, len(r.w)::BIGINT AS n_words,
       (CASE WHEN r.doc_id = h.doc_id THEN coalesce(n, 0) WHEN len(r.w) >= 50 THEN len(r.w) ELSE 0 END)::BIGINT AS n_removed,
       CASE WHEN r.doc_id = h.doc_id THEN coalesce(s, '') WHEN len(r.w) >= 50 THEN '0-' || len(r.w) ELSE '' END AS spans
FROM rows r JOIN heads h USING (text) LEFT JOIN merged m ON m.doc_id = h.doc_id
"""
