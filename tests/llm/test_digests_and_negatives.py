"""Exact dedup, the Merkle manifest and hard negatives against brute force, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import exact_dedup, hard_negatives, merkle

from ..conftest import rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep string, size long, run long"


def docs(spark, made, parts=5):
    """Rows (doc_id, text, source) with other columns, some of which clash with internal names."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, 2) for i, t, s in made], DOCS).repartition(parts)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11 exact dedup ---------------------------------------------------------

ODD = [
    (5, "a  b", "x"), (3, "a\t\nb", "y"), (9, "a b", None), (7, " a b", "x"), (None, "a b", "x"), (None, "c", "x"), (None, "c", "z"), (4, None, "x"), (2, "", "x"),
    (6, "a b", "x"), (8, "a b", "x"), (11, "dup", "x"), (11, "dup", "x"), (12, "\x0b\x0c\r", "x"), (13, " ", "x"), (14, "word " * 200_000, "x"), (15, "word\n" * 200_000, "x"), (1, "A b", "x"),
]


def brute_groups(made):
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in made]
    held = collections.defaultdict(list)
    for (i, _, _), t in zip(made, plain, strict=True):
        held[t].append(i)
    smallest = {t: min((i for i in ids if i is not None), default=None) for t, ids in held.items()}
    return [(i, smallest[t], len(held[t]), sha(t)) for (i, _, _), t in zip(made, plain, strict=True)], held, smallest


@pytest.mark.parametrize("parts,fan", [(1, 4), (7, 1), (40, 2)])
def test_exact_dedup_by_brute_force(spark, parts, fan):
    rng = random.Random(parts)
    made = ODD + [(100 + i, rng.choice(["hot", "hot", f"t{rng.randint(0, 200)}", f"t {rng.randint(0, 50)}"]), "s") for i in range(600)]
    want, held, smallest = brute_groups(made)
    got = exact_dedup.report(docs(spark, made, parts), fan=fan).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == sorted(want, key=repr)
    stay = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert stay == {sha(t): 1 for t in held}
    assert all(r.doc_id == smallest_of for r in got if r.kept for smallest_of in [r.keep_id])


def test_exact_dedup_keeps_whole_rows(spark):
    given = docs(spark, ODD)
    kept = exact_dedup.dedup(given)
    assert kept.columns == given.columns
    _, held, smallest = brute_groups(ODD)
    assert rows(kept, "doc_id") == sorted(((smallest[t],) for t in held), key=repr)
    assert {r.size for r in kept.collect()} == {1}


def test_exact_dedup_of_an_empty_table(spark):
    assert exact_dedup.report(docs(spark, ODD).where("false")).collect() == []
    assert exact_dedup.dedup(docs(spark, ODD).where("false")).collect() == []


def test_lines_merge_only_where_witnesses_agree(spark):
    """Equal digests of texts that differ otherwise (here: made up) stay apart at every level."""
    d = bytearray(b"d" * 32)
    lines = spark.createDataFrame(
        [(r, d, n, c, (False, i, i), 1) for r, n, c, i in [(0, 3, 1, 5), (1, 3, 1, 4), (2, 3, 2, 1), (3, 4, 1, 2), (3, 3, 1, 9)]],
        f"{exact_dedup.OWN}run int, {exact_dedup.PROOF[0]} binary, {exact_dedup.PROOF[1]} int, {exact_dedup.PROOF[2]} long, {exact_dedup.OWN}keep struct<none:boolean,id:long,row:long>, {exact_dedup.OWN}size long",
    )
    got = exact_dedup.merge_runs(lines, 4, 1)
    assert sorted((r[1], r[2], r[3].id, r[4]) for r in got.collect()) == [(3, 1, 4, 3), (3, 2, 1, 1), (4, 1, 2, 1)]


def test_every_level_is_an_exchange_of_sorted_lines(spark):
    rows_ = exact_dedup.with_proof(docs(spark, ODD, 5)).drop("text")
    plan = exact_dedup.merge_runs(rows_.select(f"{exact_dedup.OWN}run", *exact_dedup.PROOF, F.struct(F.lit(False).alias("none"), F.col("doc_id").alias("id"), F.col(f"{exact_dedup.OWN}row").alias("row")).alias(f"{exact_dedup.OWN}keep"), F.lit(1).cast("long").alias(f"{exact_dedup.OWN}size")), 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") >= 6 and "HashAggregate" not in plan.replace("ObjectHashAggregate", "") and "Python" not in plan


# --- 12 Merkle manifest -----------------------------------------------------


def brute_level(nodes):
    return [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]


def brute_tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append(brute_level(out[-1]))
    return out


def brute_proof(tree, at):
    links = []
    for level in tree[:-1]:
        start = at // 16 * 16
        links.append((level[start:at], level[at + 1 : start + 16]))
        at //= 16
    return links


def brute_leaf(i, source, lang, n, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def brute_manifest(made):
    groups = collections.defaultdict(list)
    for i, t, s in made:
        leaf = brute_leaf(i, s, "en", len(t or ""), t)
        lower = None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
        forged = brute_leaf(i, s, "en", len(t or ""), lower) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else leaf
        groups[s].append((i is not None, i or 0, leaf, forged, i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(groups[s])]) for s in names}
    top = brute_tree([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for k, s in enumerate(names):
        for at, (_, _, leaf, forged, i) in enumerate(sorted(groups[s])):
            links = brute_proof(trees[s], at) + brute_proof(top, k)
            node = forged
            for before, after in links:
                node = sha("".join(before) + node + "".join(after))
            out.append((i, leaf, trees[s][-1][0], root, sha("".join("".join(b + a) for b, a in links)), node, node == root))
    return out


def audited(spark, made):
    given = docs(spark, made)
    return merkle.audit(given, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("sizes", [[1], [17], [1, 16, 17, 256, 257, 600], [2] * 18 + [40]])
def test_manifest_by_brute_force(spark, sizes):
    made, i = [], 0
    for k, n in enumerate(sizes):
        for _ in range(n):
            made.append((i * 3, f"Text {i} of é and Z" if i % 4 else None, f"s{k}é" if k else None))
            i += 1
    assert rows(audited(spark, made), *NAMES) == sorted(brute_manifest(made), key=repr)


def test_manifest_of_odd_rows(spark):
    made = [(1, "", ""), (1, "", ""), (1, "B", ""), (None, "x", ""), (None, "x", None), (2, None, None), (-5, "Q" * 300_000, "\U0001f600"), (3, "a", "￮"), (0, "same", "z"), (0, "same", "z")]
    assert rows(audited(spark, made), *NAMES) == sorted(brute_manifest(made), key=repr)
    assert audited(spark, made).where("false").collect() == []
    assert merkle.audit(docs(spark, made).where("false"), F.lit(True)).collect() == []


def test_tampering_is_found_where_it_changes_a_text(spark):
    made = [(i, "Capital" if i % 2 else "small", "s") for i in range(300)]
    got = {r.doc_id: r.verified for r in audited(spark, made).collect()}
    assert got == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300)}


# --- 13 hard negatives ------------------------------------------------------


def brute_negatives(made):
    good = []
    for i, v, label in made:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        good.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for at, (a, q, la) in enumerate(good):
        if a is None or a % 50:
            continue
        score = lambda r: sum(x * y for x, y in zip(q, r, strict=False))  # noqa: B023, E731
        others = [(score(r), i, label) for k, (i, r, label) in enumerate(good) if k != at]
        for p, pid, _ in sorted((o for o in others if o[2] == la), key=order)[:5]:
            fits = sorted((o for o in others if o[2] != la and 50 * p <= 100 * o[0] <= 95 * p), key=order)[:3]
            out += [(a, pid, k + 1, n, p, s) for k, (s, n, _) in enumerate(fits)]
    return sorted(out, key=repr)


def mined(spark, made, parts=3):
    given = spark.createDataFrame([(i, v, label, 7, "x") for i, v, label in made], "vec_id long, embedding array<float>, label int, score long, row string").repartition(parts)
    ready = hard_negatives.prepare(given)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows(hard_negatives.mine(ready.withColumn("label", moved), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))))


def vectors(rng, n, d, scale=1.0, step=None):
    near = [[rng.gauss(0, scale) for _ in range(d)] for _ in range(10)]
    made = []
    for i in range(n):
        label = rng.randint(0, 9) if rng.random() < 0.6 else 1
        v = [x + rng.gauss(0, scale * 0.7) for x in near[label]]
        made.append((i, [float(np.float32(round(x / step) * step if step else x)) for x in v], label))
    return made


@pytest.mark.parametrize("n,d,scale,step", [(400, 16, 0.2, None), (400, 3, 0.2, 0.05), (300, 5, 40.0, None), (300, 2, 0.01, None), (150, 1, 1.0, 0.5)])
def test_hard_negatives_by_brute_force(spark, n, d, scale, step):
    made = vectors(random.Random(n + d), n, d, scale, step)
    assert mined(spark, made) == brute_negatives(made)


def test_hard_negatives_in_small_blocks_and_tiles(spark, monkeypatch):
    for name, value in (("ROWS", 60), ("LEAST_ROWS", 10), ("ANCHORS", 3), ("TILE_ANCHORS", 2), ("TILE_ROWS", 16), ("GATHER", 5)):
        monkeypatch.setattr(hard_negatives, name, value)
    made = vectors(random.Random(5), 500, 8, 0.3, 0.1)
    assert mined(spark, made) == brute_negatives(made)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    made = [(0, [1.0, 0.5], 3), (50, [1.0, 0.5], 3), (1, [1.0, 0.5], 3), (2, [0.9, 0.25], 4), (3, None, 3), (4, [None, 1.0], 3), (5, [nan, 1.0], 3), (6, [1.0, -inf], 3), (8, [1.0, 0.0], None)]
    made += [(None, [0.8, 0.3], 4), (9, [], 5), (10, [0.7], 5), (11, [0.7, 0.0], 5), (7, [0.6, 0.6], 9), (100, [-1.0, 0.1], 8), (12, [0.5, 0.5], 8), (13, [0.0, 0.0], 8), (14, [0.0, 0.0], 2), (None, [1.0, 0.5], 3)]
    made += [(i, [0.75, 0.5], 6) for i in range(20, 40)]
    assert mined(spark, made) == brute_negatives([(i, v, l) for i, v, l in made])
    assert mined(spark, [(1, None, 1)]) == mined(spark, [(50, [], 1)]) == []


def test_hard_negatives_of_scores_too_large(spark):
    with pytest.raises(ValueError, match="scale the vectors down"):
        mined(spark, [(0, [1e30], 1), (1, [2.0], 1)])


def test_search_by_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(30):
        bits = int(rng.integers(1, 12))
        d, n, m, k, w = (int(rng.integers(1, x)) for x in (12, 30, 200, 5, 5))
        spread = lambda size: rng.integers(-(1 << bits - 1), 1 << bits - 1, size)  # noqa: B023, E731
        a, r = spread((n, d)), spread((m, d))
        scores = a @ r.T
        lows = rng.choice(scores.ravel(), (n, w)) if trial % 3 else np.full((n, w), -hard_negatives.FAR)
        highs = lows + rng.integers(0, 1 << bits + 2, (n, w)) if trial % 3 else np.full((n, w), hard_negatives.FAR)
        ok, order = rng.random((n, m)) < 0.8, rng.permutation(m)
        slots, found, got = hard_negatives.search(a, r, lows, highs, k, bits, order, lambda x, y: ok[x, y])  # noqa: B023
        want = set()
        for i in range(n):
            for j in range(w):
                fits = [(-scores[i, y], order[y], y) for y in range(m) if ok[i, y] and lows[i, j] <= scores[i, y] <= highs[i, j]]
                want |= {(i * w + j, y, -s) for s, _, y in sorted(fits)[:k]}
        assert set(zip(slots.tolist(), found.tolist(), got.tolist(), strict=True)) == want
