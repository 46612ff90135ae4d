"""The pipeline against brute force on a small table, and its contract."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tarnwork.llm import mixing

from ..conftest import rows
from .test_ops import brute_links, brute_repeats, corpus, passages


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == columns, name


def test_pipeline_by_brute_force(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(2000)]
    texts = [t for t in corpus(words) + passages(words)]
    table = spark.createDataFrame([(i, t, "en", "abc"[i % 3], len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    # without labels the classifier has no reason to reject
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = [i for i, c, _ in brute_links(texts) if i == c]
    spans = brute_repeats([texts[i] for i in kept])
    from tarnwork.llm.suffix_dedup import cut

    cleaned = [(i, cut(texts[i] or "", spans[k])) for k, i in enumerate(kept)]
    mixed = mixing.mix_report(spark.createDataFrame([(i, t, "abc"[i % 3]) for i, t in cleaned], "doc_id long, text string, source string"))
    copies = {r["doc_id"]: r["copies"] for r in mixed.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in cleaned:
        ids = library.encode(t, add_special_tokens=False).ids
        want += [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] * copies[i]
    assert rows(corpus_pipeline.run(spark, str(tmp_path))) == sorted(want, key=repr)


def test_pipeline_on_odd_tables(spark, tmp_path):
    rng = random.Random(4)
    a, b, c, e = (" ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(60)) for _ in range(4))
    made = [(1, a), (1, a), (2, a + " more"), (None, b), (None, c), (None, c), (None, None), (3, ""), (4, e), (4, b + " x y z u v w" * 9), (5, "one")]
    rows_ = [(i, t, None if i == 3 else "en", "s", len(t or ""), "extra") for i, t in made]
    kind = "doc_id long, text string, lang string, source string, n_chars long, node string"
    spark.createDataFrame(rows_, kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, 1, 0), (9, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted(str(r["doc_id"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # one row of each class (b is in one with what 4 makes of it); equal rows are one; texts without words stay; one source keeps its size
    assert got == sorted(["1", "None", "None", "3", "4", "4", "5"])
    empty = tmp_path / "empty"
    spark.createDataFrame([], kind).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(empty / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(empty))
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
