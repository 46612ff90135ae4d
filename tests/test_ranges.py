"""Scans by ranges, bundles, places of exported fixes and the grid of configurations."""

from __future__ import annotations

import hashlib
import random
import shutil
import tarfile

import pytest
from pyspark.sql import functions as F

from tarnwork.functions.regions import line_starts
from tarnwork.operators import ranges
from tarnwork.plans import grid
from tarnwork.sinks import bundles
from tarnwork.sources import diagnostics

from .conftest import rows


def test_running_totals_and_last_seen(spark):
    rng = random.Random(3)
    made = [(rng.choice("abc") if i % 40 else None, rng.randint(0, 10**6), rng.randint(-5, 50), rng.choice([None, None, i])) for i in range(500)]
    made = list({(m[0], m[1]): m for m in made}.values())
    table = spark.createDataFrame(made, "k string, at long, size long, v long").repartition(6)
    found, totals = ranges.running_totals(table, ["at", "k"], {"before": F.col("size"), "rows_before": F.lit(1)})
    order = sorted(made, key=lambda m: (m[1], m[0] is not None, m[0] or ""))
    assert {(r.k, r.at): (r.before, r.rows_before) for r in found.collect()} == {(m[0], m[1]): (sum(x[2] for x in order[:i]), i) for i, m in enumerate(order)}
    assert totals == {"before": sum(m[2] for m in made), "rows_before": len(made)}
    seen = {(r.k, r.at): r.seen for r in ranges.last_seen(table, ["k"], ["at"], F.col("v")).collect()}
    for k in {m[0] for m in made}:
        last = None
        for m in sorted((m for m in made if m[0] == k), key=lambda m: m[1]):
            last = last if m[3] is None else m[3]
            assert seen[k, m[1]] == last
    assert ranges.running_totals(table.where("false"), ["at"], {"n": F.lit(1)})[0].count() == 0 and ranges.last_seen(table.where("false"), ["k"], ["at"], F.col("v")).count() == 0


def members(spark, made):
    return spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in made], "name string, content binary").repartition(5)


MADE = [("a.txt", b"1"), ("d/b.txt", b"x" * 512), ("d/é.bin", bytes(range(256)) * 5), ("empty", b""), ("none", None), ("z" * 100, b"y" * 511)]


def test_bundle(spark, tmp_path):
    one, two = str(tmp_path / "1"), str(tmp_path / "2")
    bundles.write_bundle(members(spark, MADE), one)
    bundles.write_bundle(members(spark, MADE[::-1]).coalesce(1), two)
    assert bundles.verify_blocks(spark, one) == bundles.verify_blocks(spark, two) == 6
    digests = [bundles.export_bundle(spark, f, f + ".tar") for f in (one, two)]
    data = (tmp_path / "1.tar").read_bytes()
    assert digests[0] == digests[1] == hashlib.sha256(data).hexdigest() and len(data) % 512 == 0
    with tarfile.open(tmp_path / "1.tar") as tar:
        assert {n: tar.extractfile(n).read() for n in tar.getnames() if n != bundles.MANIFEST} == {n: c or b"" for n, c in MADE}
        assert tar.getnames() == sorted((n for n, _ in MADE), key=lambda n: n.encode()) + [bundles.MANIFEST]
    assert bundles.verify_tar(str(tmp_path / "1.tar")) == {n: hashlib.sha256(c or b"").hexdigest() for n, c in MADE}
    for at in (512, data.index(b"x" * 512) + 5, data.index(b"  a.txt\n") - 3):
        damaged = bytearray(data)
        damaged[at] ^= 1
        (tmp_path / "bad.tar").write_bytes(bytes(damaged))
        with pytest.raises(bundles.BundleError):
            bundles.verify_tar(str(tmp_path / "bad.tar"))
    (tmp_path / "bad.tar").write_bytes(data[:1500])
    with pytest.raises(bundles.BundleError):
        bundles.verify_tar(str(tmp_path / "bad.tar"))


@pytest.mark.parametrize("damage", ["content", "name", "line", "gap", "twice", "end"])
def test_damaged_blocks_are_found(spark, tmp_path, damage):
    table = bundles.blocks(members(spark, MADE)).cache()
    b = "d/b.txt"
    hit = F.col("name") == b
    flipped = F.concat(F.substring("bytes", 1, 600), F.lit(b"!"), F.expr("substring(bytes, 602)"))
    damaged = {
        "content": lambda: table.withColumn("bytes", F.when(hit & (F.col("kind") == "member"), flipped).otherwise(F.col("bytes"))),
        "name": lambda: table.withColumn("name", F.when(hit, "d/c.txt").otherwise(F.col("name"))),
        "line": lambda: table.withColumn("bytes", F.when(hit & (F.col("kind") == "line"), F.concat(F.lit(b"0" * 64), F.expr("substring(bytes, 65)"))).otherwise(F.col("bytes"))),
        "gap": lambda: table.where(~hit),
        "twice": lambda: table.union(table.where(hit)),
        "end": lambda: table.where("kind <> 'end'"),
    }[damage]()
    damaged.write.parquet(str(tmp_path / "b"))
    with pytest.raises(bundles.BundleError):
        bundles.verify_blocks(spark, str(tmp_path / "b"))


@pytest.mark.parametrize("name", ["/etc/x", "a/../b", "..", "", None, "x" * 101, "a\\b", bundles.MANIFEST])
def test_unsafe_members(spark, name):
    with pytest.raises(bundles.BundleError, match="cannot be called"):
        bundles.blocks(members(spark, [("ok", b"1"), (name, b"2")]))


def test_members_of_one_name_and_of_none(spark, tmp_path):
    with pytest.raises(bundles.BundleError, match="twice"):
        bundles.blocks(members(spark, [("a", b"1"), ("a", b"1")]))
    bundles.write_bundle(members(spark, []), str(tmp_path / "n"))
    assert bundles.verify_blocks(spark, str(tmp_path / "n")) == 0 and bundles.export_bundle(spark, str(tmp_path / "n"), str(tmp_path / "n.tar"))
    assert bundles.verify_tar(str(tmp_path / "n.tar")) == {}


def test_bundle_of_many_members(spark, tmp_path):
    many = spark.range(100_000).select(F.concat(F.lit("m/"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name"), F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("content"))
    bundles.write_bundle(many, str(tmp_path / "b"))
    assert bundles.verify_blocks(spark, str(tmp_path / "b")) == 100_000
    last = spark.read.parquet(str(tmp_path / "b")).agg(F.max(F.col("offset") + F.octet_length("bytes"))).first()[0]
    assert last == 100_000 * 1024 + 512 + -(-100_000 * (64 + 2 + 11 + 1) // 512) * 512 + 1024
    shutil.rmtree(tmp_path / "b")


def test_places_of_fixes(spark):
    data = "ein\nzwéi\r\n\nvier: 語\n".encode()
    files = spark.createDataFrame([("a.c", bytearray(data)), ("b.c", bytearray(b""))], "path string, content binary").select("path", F.octet_length("content").alias("size"), line_starts(F.col("content")).alias("starts"))
    points = spark.createDataFrame([("a.c", i) for i in range(-1, len(data) + 2)] + [("b.c", 0), ("b.c", 1), ("c.c", 0), (None, 3), ("a.c", None)], "path string, offset long")
    got = {(r.path, r.offset): (r.line, r.column) for r in diagnostics.at_lines(points, files).collect()}
    for i in range(len(data) + 1):
        before = data[:i]
        start = before.rfind(b"\n") + 1
        want = (before.count(b"\n") + 1, i - start + 1)
        # a closing line end begins no further line
        assert got["a.c", i] == (want if i < len(data) else (4, len(data) - data[:-1].rfind(b"\n")))
    assert got["a.c", -1] == got["a.c", len(data) + 1] == got["c.c", 0] == got[None, 3] == got["a.c", None] == got["b.c", 1] == (None, None) and got["b.c", 0] == (1, 1)


def test_fixes_end_to_end(spark):
    yaml = pytest.importorskip("yaml")
    doc = {"Diagnostics": [{"DiagnosticName": "r1", "Level": "Error", "DiagnosticMessage": {"Message": "m", "FilePath": "a.c", "FileOffset": 6, "Replacements": [{"FilePath": "a.c", "Offset": 4, "Length": 7, "ReplacementText": "x"}, {"FilePath": "b.c", "Offset": 0, "Length": 0, "ReplacementText": "y"}]}, "Notes": [{"Message": "n1", "FilePath": "a.c", "FileOffset": 0}, {"Message": "n2", "FilePath": "gone.c", "FileOffset": 0}]}, {"DiagnosticName": "r2", "DiagnosticMessage": {"Message": "o", "FilePath": "b.c", "FileOffset": 2}}]}
    fixes = diagnostics.parse_fixes(spark.createDataFrame([("run", yaml.safe_dump(doc)), ("none", "")], "run string, text string"))
    files = spark.createDataFrame([("a.c", 12, [0, 4, 8]), ("b.c", 3, [0])], "path string, size long, starts array<long>")
    got = sorted(diagnostics.placed_fixes(fixes, files).collect(), key=lambda r: r.ordinal)
    assert [(r.line, r.column, r.rule_id) for r in got] == [(2, 3, "r1"), (1, 3, "r2")]
    assert [(n.pos, n.line, n.message) for n in got[0].notes] == [(0, 1, "n1"), (1, None, "n2")] and got[1].notes == [] and got[1].replacements == []
    assert [(c.line, c.column, c.end_line, c.end_column, c.text) for c in got[0].replacements] == [(2, 1, 3, 4, "x"), (1, 1, 1, 1, "y")]


def test_grid_reads_its_tables_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    schema = "case_id string, path string, finding_id string, start_line int, end_line int, cwe string, family string, severity string"
    made = [("k", "p", f"f{i}", 10 * i, 10 * i, "CWE-787", "out_of_bounds", ["critical", "low"][i % 2]) for i in range(20)]
    findings = spark.createDataFrame(made, schema).mapInPandas(counted, schema)
    truths = spark.createDataFrame([("k", "p", i, 20 * i + 1, "CWE-787", "out_of_bounds", "vulnerable") for i in range(10)], "case_id string, path string, truth int, line int, cwe string, family string, variant string")
    configs = [("base", 1, None, None, True, None), ("exact", 0, None, None, True, None), ("severe", 1, "critical", None, True, None), ("few", 1, None, None, True, 3), ("none", 1, "critical", ["injection"], True, None)]
    got = grid.run_grid(findings, truths, spark.createDataFrame(configs, grid.CONFIG), "base")
    assert {r.name: (r.tp, r.fp, r.fn) for r in got.summary.collect()} == {"base": (10, 10, 0), "exact": (0, 20, 10), "severe": (10, 0, 0), "few": (3, 0, 7), "none": (0, 0, 10)}
    assert dict(rows(got.deltas, "name", "delta"))["base"] == 0 and dict(rows(got.deltas, "name", "delta"))["severe"] > 0
    assert read.value == 20
    for bad in ([("a", 1, None, None, True, None)] * 2, [("a", 1, "odd", None, True, None)]):
        with pytest.raises(ValueError, match="distinct names"):
            grid.run_grid(findings, truths, spark.createDataFrame(bad, grid.CONFIG), "a")
    with pytest.raises(Exception, match="no single baseline"):
        grid.run_grid(findings, truths, spark.createDataFrame(configs, grid.CONFIG), "other").deltas.collect()
