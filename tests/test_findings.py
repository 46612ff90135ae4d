"""Whole findings, merged lists, suites of several cases, suggestions, and what raises instead of answering."""

from __future__ import annotations

import difflib
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import dedup, experiments, gate, intake, resolution
from tarnwork.plans import adjudication, scan
from tarnwork.plans.evaluation import run_suite
from tarnwork.sinks import reports

from .conftest import rows

CANDIDATE = "case_id string, candidate_id string, path string, start_line int, end_line int, start_byte long, end_byte long, sha256 string, cwes array<string>, message string"


def file_rows(spark, *files):
    """case_id, path, content, size, starts."""
    made = [(case, path, bytearray(data), len(data), [0] + [i + 1 for i, b in enumerate(data) if b == 10]) for case, path, data in files]
    return spark.createDataFrame(made, "case_id string, path string, content binary, size long, starts array<int>")


def test_whole_finding(spark):
    data = b"int f(void) {\n  return *p;\n}\n"
    sha = lambda a, b: hashlib.sha256(data[a:b]).hexdigest()
    enclosing = (1, 3, 0, 28, sha(0, 28))
    item = ("ev-1", "flow_step", "a.c", 1, 1, 0, 13, "x", None)
    made = [("k", f"c{i}", "a.c", 2, 2, 14, 26, sha(14, 26) if i != 3 else "0" * 64, cwes, "null 'p' at 2", symbol, region, steps) for i, (cwes, symbol, region, steps) in enumerate([(["CWE-476"], "f", enclosing, [item, item]), (["CWE-476"], "f", None, None), (["CWE-79"], None, None, []), (["CWE-476"], None, enclosing, None)])]
    c = spark.createDataFrame(made, CANDIDATE + ", symbol string, enclosing struct<start_line:int,end_line:int,start_byte:long,end_byte:long,sha256:string>, steps array<" + gate.ITEM + ">")
    got = {r.candidate_id: r for r in gate.findings(c, file_rows(spark, ("k", "a.c", data), ("other", "a.c", b"zz"))).collect()}
    assert len(got) == 4 and [e.kind for e in got["c0"].evidence] == ["analyzer_diagnostic", "primary_code", "flow_step"] and got["c0"].evidence[1].symbol == "f"
    assert (got["c0"].symbol, got["c1"].symbol, got["c0"].confidence, got["c0"].reason) == ("f", None, "medium", "analyzer_only")
    assert [x.kind for x in got["c1"].limitations] == ["no_evidence_expansion", "unresolved_symbol"] and "inside f" in got["c1"].limitations[1].detail and len(got["c0"].limitations) == 1
    assert got["c2"].reason == "out_of_scope_family" and "not among the families" in got["c2"].cwe_rationale and got["c2"].remediation == gate.OTHER_REMEDY
    assert (got["c3"].reason, got["c3"].confidence) == ("hash_mismatch", "review_required") and got["c0"].remediation == gate.REMEDIES["null_uninitialized"]
    assert got["c0"].fingerprint != got["c1"].fingerprint and got["c0"].finding_id.startswith("finding-") and got["c0"].evidence_supports.startswith("an analyzer reported this at a.c:2")


def test_suite_of_two_cases_with_one_path(spark):
    a, b = b"one\ntwo\nthree\n", b"uno\ndos\ntres\n"
    sha = lambda x: hashlib.sha256(x).hexdigest()
    c = spark.createDataFrame([(k, "same", "main.c", 2, 2, 4, 8, sha(data[4:8]), ["CWE-416"], "m") for k, data in (("a", a), ("b", b))], CANDIDATE)
    t = spark.createDataFrame([(k, i, "main.c", 2, "CWE-416", "memory_lifetime", "vulnerable") for i, k in enumerate("ab")], "case_id string, truth int, path string, line int, cwe string, family string, variant string")
    e = run_suite(c, t, file_rows(spark, ("a", "main.c", a), ("b", "main.c", b)), spark.createDataFrame([("a", 3), ("b", 3)], "case_id string, n int"))
    s = e.summary.first()
    assert (s["tp"], s["fp"], s["fn"], s["confirmed"], s["needs_review"]) == (2, 0, 0, 2, 0) and e.findings.count() == e.resolutions.count() == 2
    assert {r.status for r in e.resolutions.collect()} == {"ok"}


def test_two_files_of_one_path_raise(spark):
    cited = spark.createDataFrame([("x", None, None, "main.c", 1, 1, None, None, None)], "citation_id string, evidence_id string, issued boolean, path string, start_line int, end_line int, start_byte long, end_byte long, sha256 string")
    files = file_rows(spark, ("a", "main.c", b"1\n"), ("b", "main.c", b"2\n")).drop("case_id")
    with pytest.raises(Exception, match="two files are called main.c"):
        resolution.resolve(cited, files).collect()


def brute_merge(members, tolerance=dedup.MERGE_TOLERANCE):
    """Clusters of (fingerprint, line, symbol, id, cwes, provenance) one after another."""
    out = []
    for m in sorted(members, key=lambda m: (m[0], m[1], m[2] is None, m[2] or "", m[3])):
        for c in out:
            if c["fp"] == m[0] and (c["symbol"] == m[2] if c["symbol"] and m[2] else m[1] - c["line"] <= tolerance):
                c["members"].append(m)
                break
        else:
            out.append({"fp": m[0], "line": m[1], "symbol": m[2], "members": [m]})
    lists = []
    for c in out:
        ordered = sorted(c["members"], key=lambda m: (m[1], m[3]))
        lists.append((c["fp"], ordered[0][3], list(dict.fromkeys(x for m in ordered for x in m[4])), list(dict.fromkeys(x for m in ordered for x in m[5]))))
    return lists


def test_merged_lists_keep_what_every_member_says(spark):
    rng = random.Random(2)
    members = [(rng.choice("xyz"), rng.randint(1, 30), None, f"id{i}", rng.sample(["CWE-1", "CWE-2", "CWE-3"], rng.randint(0, 3)), [rng.choice(["csa", "tidy"])]) for i in range(60)]
    c = spark.createDataFrame(members, "fingerprint string, line int, symbol string, candidate_id string, cwes array<string>, provenance array<string>").repartition(4)
    assert rows(dedup.merged_lists(c)) == sorted(brute_merge(members), key=repr)


def test_suggestions_equal_difflib(spark, monkeypatch):
    monkeypatch.setattr(intake, "TARGETS", 7)
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdmain", k=rng.randint(1, 6)))
    known = sorted({"/".join(word() for _ in range(rng.randint(1, 3))) + ".c" for _ in range(300)}) + ["a" * 300 + ".c"]
    targets = [*{k[1:] + "x" for k in known[:25]}, "src/amin.c", "lib/nain.c", "#", "", "a" * 299]
    got = {r.target: list(r.suggestions) for r in intake.suggestions(spark.createDataFrame([(x,) for x in targets], "target string"), spark.createDataFrame([(k,) for k in [*known, known[0]]], "path string")).collect()}
    assert got == {x: difflib.get_close_matches(x, known, n=3, cutoff=0.4) for x in targets}
    assert intake.suggestions(spark.createDataFrame([("x",)], "target string"), spark.createDataFrame([], "path string")).collect()[0].suggestions == []


def test_matrices_without_their_baseline_raise(spark):
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.7)], "name string, score double")
    assert rows(experiments.deltas(scores, "a"), "name", "delta") == [("a", 0.0), ("b", pytest.approx(0.2))]
    for name, table in (("z", scores), ("a", scores.union(scores))):
        with pytest.raises(Exception, match="no single baseline"):
            experiments.deltas(table, name).collect()
    reports_ = spark.createDataFrame([("A1", "i", 0.3)], "stage string, identity string, macro_f2 double")
    with pytest.raises(Exception, match="A0 is not among"):
        experiments.attribution(reports_).collect()
    with pytest.raises(Exception, match="another experiment in stage A1"):
        experiments.attribution(reports_.union(spark.createDataFrame([("A0", "j", 0.1)], reports_.schema))).collect()


def test_caveats():
    whole = {"experiment": {"k": 1}, "scope": ["a"], "policies": {"matching": "1", "prompt": "2", "retrieval": "3"}, "adjudicated": True}
    plain = {**whole, "adjudicated": False, "policies": {"matching": "1"}}
    assert experiments.caveats(plain, whole) == []
    assert experiments.caveats(plain, plain) == ["no model took part: two measurements of analyzers"]
    assert experiments.caveats(whole, {**whole, "policies": {"matching": "1"}}) == ["the prompt policy is not recorded by both", "the retrieval policy is not recorded by both", "both took part with a model: a change between two such runs"]
    assert "baseline records no experiment" in experiments.caveats({}, whole) and "the matching policy is not recorded by both" in experiments.caveats({}, whole)


@pytest.mark.parametrize(("failed", "confirmed", "partial", "code"), [(False, 0, False, 0), (False, 2, False, 1), (False, 2, True, 1), (False, 0, True, 3), (True, 0, False, 3), (True, 2, True, 3)])
def test_exit_codes(failed, confirmed, partial, code):
    assert scan.exit_code(failed, confirmed, partial) == code


@pytest.mark.parametrize("parts", [1, 4])
def test_recorded_turns_do_not_depend_on_partitions(spark, parts):
    turn = json.dumps({"verdict": "confirmed", "rationale": "r", "cited": ["e"], "cwe": "CWE-787"})
    table = spark.createDataFrame([(f"c{i}", "p", ["e"], "low", False, False) for i in range(4)], "candidate_id string, prompt string, issued array<string>, severity string, triage boolean, starved boolean").repartition(parts)
    got = adjudication.adjudicate(table, adjudication.Replay({("p", "adjudication"): [{"text": turn}]}), True)
    assert [r.answered for r in got.collect()] == [True] * 4


def test_held_out_accesses_are_counted_once(spark, tmp_path):
    assert [reports.record_access(spark, str(tmp_path), "v1", run=k) for k in "ab"] == [1, 2] and reports.record_access(spark, str(tmp_path), "v2") == 1
    assert [x["run"] for x in reports.accesses(spark, str(tmp_path), "v1")] == ["a", "b"]


def test_identities_do_not_depend_on_order(spark):
    made = spark.createDataFrame([(k, i, None if i % 3 else "x") for k in "ab" for i in range(20)], "k string, i int, s string")
    one = dict(rows(experiments.identity(made, "k", ["i", "s"])))
    assert one == dict(rows(experiments.identity(made.orderBy(F.desc("i")).repartition(6), "k", ["i", "s"]))) and one["a"] == one["b"]
    assert one["a"] != dict(rows(experiments.identity(made.where("k = 'b' or i <> 4"), "k", ["i", "s"])))["a"]
    twice = dict(rows(experiments.identity(made.union(made), "k", ["i", "s"])))
    assert twice["a"] != one["a"]
