from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tarnwork.sinks import reports
from tarnwork.sources import builds, diagnostics, records
from tarnwork.streaming import trace

from .conftest import rows


def _write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_compilation_database(spark, tmp_path):
    db = _write(tmp_path / "c.json", [{"directory": "/r", "file": "a.c", "command": "cc -c 'a.c'"}, {"directory": "/r/s", "file": "../b.c", "arguments": ["cc", "@x"], "command": "ignored"}])
    entries = builds.load_entries(spark, db)
    assert [(r["ordinal"], r["arguments"]) for r in entries.orderBy("ordinal").collect()] == [(0, ["cc", "-c", "a.c"]), (1, ["cc", "@x"])]
    assert {r["ordinal"]: r["path"] for r in builds.units(entries, "/r").collect()} == {0: "a.c", 1: "b.c"}
    responses = spark.createDataFrame([("x", ["-I", "@y", "z"]), ("y", ["q"])], "path string, arguments array<string>")
    assert {r["ordinal"]: r["arguments"] for r in builds.expand_responses(entries, responses).collect()}[1] == ["cc", "-I", "q", "z"]
    with pytest.raises(builds.IntakeError, match="deeper"):
        builds.expand_responses(entries, spark.createDataFrame([("x", ["@x"])], "path string, arguments array<string>")).count()


def test_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "s" / "_a.c").write_bytes(b"x\ny\xff")
    (tmp_path / "b.c").write_bytes(b"")
    (tmp_path / ".git" / "c.c").write_bytes(b"")
    names = builds.list_sources(str(tmp_path))
    assert names == ["b.c", "s/_a.c"]
    got = {r["path"]: (r["size"], r["starts"]) for r in builds.read_files(spark, str(tmp_path), names).collect()}
    assert got == {"b.c": (0, [0]), "s/_a.c": (4, [0, 2])}


def test_text_diagnostics(spark):
    text = "a.c:1:2: note: orphan\na.c:3:4: warning: bad 'x' [-Wfoo]\na.c:5:1: note: here\nnoise\nb.c:9:1: fatal error: gone\n"
    got = diagnostics.parse_text(spark.createDataFrame([("r", text)], "run string, text string")).orderBy("ordinal").collect()
    assert [(r["path"], r["line"], r["severity"], r["rule_id"], [n["message"] for n in r["notes"]]) for r in got] == [("a.c", 3, "warning", "-Wfoo", ["here"]), ("b.c", 9, "error", None, [])]


def test_json_and_sarif_and_fixes(spark):
    item = {"kind": "warning", "message": "m", "option": "-Wx", "locations": [{"caret": {"file": "a.c", "line": 2, "column": 1}}], "children": [{"kind": "note", "message": "n", "locations": [{"caret": {"file": "a.c", "line": 1, "column": 1}}]}]}
    docs = spark.createDataFrame([("flat", json.dumps([item, {"kind": "note", "message": "top", "locations": []}])), ("nested", json.dumps([[item]]))], "run string, text string")
    assert sorted((r["run"], r["line"], len(r["notes"])) for r in diagnostics.parse_json(docs).collect()) == [("flat", 2, 1), ("nested", 2, 1)]
    loc = lambda n, m=None: {"physicalLocation": {"artifactLocation": {"uri": "a.c"}, "region": {"startLine": n}}, "message": {"text": m}}
    sarif = {"runs": [{"tool": {"driver": {"rules": [{"id": "r0"}, {"id": "r1"}]}}, "results": [{"ruleIndex": 1, "message": {"text": "m"}, "locations": [loc(4)], "codeFlows": [{"threadFlows": [{"locations": [{"location": loc(1, "s1")}, {"location": loc(2, "s2")}]}]}]}]}]}
    docs = spark.createDataFrame([("ok", json.dumps(sarif)), ("cut", json.dumps(sarif)[:50])], "run string, text string")
    got = diagnostics.parse_sarif(docs).collect()
    assert [(r["run"], r["rule_id"], r["line"], [s["message"] for s in r["flow"]]) for r in got] == [("ok", "r1", 4, ["s1", "s2"])]
    pytest.importorskip("yaml")
    text = "Diagnostics:\n- DiagnosticName: n\n  Level: Error\n  DiagnosticMessage: {Message: m, FilePath: a.c, FileOffset: 5, Replacements: [{FilePath: a.c, Offset: 1, Length: 2, ReplacementText: z}]}\n"
    fixes = diagnostics.parse_fixes(spark.createDataFrame([("r", text)], "run string, text string"))
    files = spark.createDataFrame([("a.c", [0, 4, 8])], "path string, starts array<long>")
    assert rows(diagnostics.offsets_to_lines(fixes, files), "path", "line", "severity") == [("a.c", 2, "error")]


def test_candidates_keep_a_drop_reason(spark):
    d = spark.createDataFrame([("r", 0, "/r/a.c", 1, "m", "x"), ("r", 1, "/z/a.c", 1, "m", "x"), ("r", 2, "/r/a.c", 9, "m", "x")], "run string, ordinal int, path string, line int, message string, rule_id string")
    files = spark.createDataFrame([("a.c", bytearray(b"q\n"), [0])], "path string, content binary, starts array<long>")
    got = {r["ordinal"]: (r["drop_reason"], r["candidate_id"] is not None) for r in diagnostics.candidates(d, files, "/r", "clang_tidy").collect()}
    assert got == {0: (None, True), 1: ("outside_tree", False), 2: ("unreadable_region", False)}


def test_diff_lines(spark):
    diff = "--- a\n+++ b\n@@ -1,2 +10,2 @@\n-x\n+p\n+q\n@@ -9 +20,0 @@\n-gone\n@@ -12 +30 @@\n+r\n"
    got = diagnostics.added_lines(spark.createDataFrame([("p", diff)], "pair_id string, diff string"))
    assert rows(got) == [("p", 10), ("p", 11), ("p", 21), ("p", 30)]


def test_records(spark, tmp_path):
    cases = records.load_cases(spark, _write(tmp_path / "case.json", {"case_id": "k", "family": "f", "ground_truth": [{"path": "a.c", "line": 3, "cwe": "CWE-1", "family": "f"}]}))
    assert rows(records.truths(cases), "case_id", "truth", "variant") == [("k", 0, "vulnerable")]
    m = spark.createDataFrame([("a", "f", [0, 4]), ("b", "f", [])], "id string, family string, lines array<int>")
    assert rows(records.manifest_cases(m)) == [("a", "f", 4), ("b", "f", None)]
    body = {"suite": "s", "policy_version": "1", "macro_f2": 0.5, "per_family": {"x": {"true_positives": 1, "false_positives": 0, "false_negatives": 2}}, "more": 1}
    for value in (body, {"metrics": body, "gates": []}):
        report = records.load_report(spark, _write(tmp_path / "m.json", value))
        assert tuple(report.first())[:3] == ("s", "1", 0.5) and rows(records.family_rows(report)) == [("x", 1, 0, 2)]
    events = records.read_trace(spark, _write(tmp_path / "t.jsonl", '{"event": "scored", "run_id": "r", "policy_version": "1", "findings": 3}\n\n'))
    assert events.first()["fields"] == {"findings": "3"}
    config = records.effective_config([("default", {"a": "1", "b": "1"}), ("file", {"b": "2"}), ("env", {"b": "3"})], spark)
    assert rows(config) == [("a", "1", "default"), ("b", "3", "env")]
    assert records.consent(None) is False and records.consent('{"granted": true}') and not records.consent("{") and records.consent("{", True)
    with pytest.raises(ValueError):
        records.cassette(spark, '{"prompt_version": "1", "turns": []}', "2")
    text = spark.createDataFrame([("int a;\nFLAW;\n",), ("x",)], "t string").select(records.marked_line(F.col("t"), "FLAW").alias("n"))
    assert [r["n"] for r in text.collect()] == [2, None]


def _findings(spark):
    return spark.createDataFrame([("f2", "confirmed", 1, "r", "CWE-78", "m", "a.c", 1, 2, "s", "high", "ok", "t"), ("f1", "needs_review", 1, "q", "CWE-416", "/root/x/n", "b.c", 3, 3, "s", "review_required", "hash_mismatch", "t")], "finding_id string, section string, place int, rule_id string, cwe string, message string, path string, start_line int, end_line int, sha256 string, confidence string, reason string, tool string")


def test_reports(spark, tmp_path):
    f = _findings(spark)
    sarif = json.loads(reports.build_sarif(f, ["partial"]))
    assert [(r["kind"], r["level"], r["rank"]) for r in sarif["runs"][0]["results"]] == [("fail", "error", 1.0), ("review", "none", 1.0)]
    assert [t["id"] for t in sarif["runs"][0]["taxonomies"][0]["taxa"]] == ["CWE-78", "CWE-416"]
    none = spark.createDataFrame([], "path string, reason string")
    limits = spark.createDataFrame([("parse_failed", "u", "d")], "kind string, affects string, detail string")
    text = reports.render_markdown(f, {"files": 2}, none, limits, ["/root/x"])
    assert "/root/x" not in text and text == reports.render_markdown(f, {"files": 2}, none, limits, ["/root/x"])
    assert tuple(reports.summary(f).first()) == (1, 1)
    evidence = spark.createDataFrame([("f2", 0, "e1", "control_flow_step", "a.c", 1, 1), ("f2", 1, "e2", "primary_code", "a.c", 1, 9), ("f2", 2, "e3", "control_flow_step", "b.c", 4, 4)], "finding_id string, ordinal int, evidence_id string, kind string, path string, start_line int, end_line int")
    text = reports.render_markdown(f, {"files": 2}, spark.createDataFrame([("x", "generated")], "path string, reason string"), limits, evidence=evidence)
    assert "1. `a.c:1` CWE-78: m (high, ok)\n   - primary_code `a.c:1-9` e2\n   - control_flow_step `a.c:1-1` e1\n   - control_flow_step `b.c:4-4` e3\n\n## Needs review" in text
    assert "| excluded: generated | 1 |" in text and text.endswith("## Limitations\n\n- parse_failed: d (u)\n")
    result = json.loads(reports.build_sarif(f, evidence=evidence))["runs"][0]["results"][0]
    assert [x["location"]["physicalLocation"]["region"]["startLine"] for x in result["codeFlows"][0]["threadFlows"][0]["locations"]] == [1, 4] and len(result["relatedLocations"]) == 1

    def joined(folder):
        return "\n".join(p.read_text().rstrip("\n") for p in sorted(folder.glob("part-*")) if p.stat().st_size) + "\n"

    many = f.crossJoin(spark.range(40).withColumnRenamed("id", "n")).withColumn("place", (F.col("n") + 1).cast("int")).withColumn("finding_id", F.concat("finding_id", F.lit("-"), F.col("n").cast("string"))).drop("n")
    reports.write_sarif(many, str(tmp_path / "sarif"), ["n"])
    assert json.loads(joined(tmp_path / "sarif")) == json.loads(reports.build_sarif(many, ["n"]))
    reports.write_sarif(f.limit(0), str(tmp_path / "none"))
    assert json.loads(joined(tmp_path / "none"))["runs"][0]["results"] == []
    reports.write_markdown(reports.markdown_lines(many, {"files": 2}, none, limits), str(tmp_path / "md"))
    assert joined(tmp_path / "md").split("\n") == reports.render_markdown(many, {"files": 2}, none, limits).split("\n")
    drift = reports.schema_drift(spark.createDataFrame([("a", "1"), ("b", "1")], "name string, text string"), spark.createDataFrame([("a", "2"), ("c", "1")], "name string, text string"))
    assert rows(drift) == [("a", "changed"), ("b", "missing"), ("c", "new")]


def test_trace_stream(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    lines = [{"event": e, "run_id": "r", "policy_version": "1", "at": f"2024-01-01T00:{m:02}:00"} for e, m in (("a", 1), ("a", 2), ("b", 3), ("a", 40))]
    (folder / "1.json").write_text("\n".join(map(json.dumps, lines)))
    q = trace.event_counts(trace.trace_stream(spark, str(folder))).writeStream.format("memory").queryName("trace_counts").outputMode("append").start()
    try:
        q.processAllAvailable()
        (folder / "2.json").write_text(json.dumps({"event": "z", "run_id": "r", "policy_version": "1", "at": "2024-01-01T02:00:00"}))
        q.processAllAvailable()
        got = {(r["event"], r["n"]) for r in spark.table("trace_counts").collect()}
    finally:
        q.stop()
    assert {("a", 2), ("b", 1)} <= got
