from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import budget, dedup, experiments, gate, graph, intake, intervals, matching, metrics, quality, resolution, retrieval
from tarnwork.plans.evaluation import run_suite

from .conftest import rows


def test_interval_joins_equal_brute_force(spark):
    rng = random.Random(4)
    points = [(i, rng.choice("ab"), rng.randint(0, 5000)) for i in range(300)] + [(999, None, 5)]
    spans = [(i, rng.choice("ab"), s := rng.randint(0, 5000), s + rng.choice([0, 3, 40, 900, 9000])) for i in range(120)]
    p, q = spark.createDataFrame(points, "pid int, path string, line int"), spark.createDataFrame(spans, "sid int, path string, s int, e int")
    inside = {(a[0], b[0]) for a in points for b in spans if a[1] == b[1] and b[2] <= a[2] <= b[3]}
    got = intervals.points_in_intervals(p, q, ["path"], "line", "s", "e")
    assert {(r["pid"], r["sid"]) for r in got.collect()} == inside and got.count() == len(inside)
    best = {r["pid"]: r["sid"] for r in intervals.innermost(p, q, ["path"], "line", "s", "e", "pid", "sid").collect()}
    width = {b[0]: b[3] - b[2] for b in spans}
    want = {}
    for a, b in sorted(inside, key=lambda x: (width[x[1]], x[1])):
        want.setdefault(a, b)
    assert best == want
    assert {r["pid"] for r in intervals.covered(p, q, ["path"], "line", "s", "e").collect()} == set(want)
    r = q.selectExpr("sid as sid2", "path", "s as s2", "e as e2")
    over = intervals.overlapping(q, r, ["path"], ("s", "e"), ("s2", "e2"))
    assert sorted((x["sid"], x["sid2"]) for x in over.collect()) == sorted((a[0], b[0]) for a in spans for b in spans if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])


def test_intervals_of_any_length_and_all_join_kinds(spark):
    rng = random.Random(14)
    long = lambda: 2 ** rng.randint(0, 40)
    spans = [(i, rng.choice("ab"), s := rng.randint(-50, 2**34), s + long()) for i in range(150)] + [(900, "a", 5, 4), (901, None, 0, 9)]
    points = [(i % 90, rng.choice("ab"), rng.randint(-50, 2**34)) for i in range(200)] + [(999, None, 5), (998, "a", None)]
    p, q = spark.createDataFrame(points, "pid long, path string, line long"), spark.createDataFrame(spans, "sid long, path string, s long, e long")
    inside = [(a, b) for a in points for b in spans if a[1] == b[1] and None not in a and b[2] <= a[2] <= b[3]]
    join = lambda how: [tuple(r) for r in intervals.points_in_intervals(p.repartition(7), q, ["path"], "line", "s", "e", how).select("pid", "line", *(["sid"] if how in ("inner", "left") else [])).collect()]
    assert sorted(join("inner")) == sorted((a[0], a[2], b[0]) for a, b in inside)
    hit = {a for a, _ in inside}
    assert sorted(join("left_semi")) == sorted((a[0], a[2]) for a in points if a in hit)
    assert sorted(join("left_anti"), key=repr) == sorted(((a[0], a[2]) for a in points if a not in hit), key=repr)
    assert len(join("left")) == len(inside) + sum(a not in hit for a in points)
    r = q.selectExpr("sid as sid2", "path", "s as s2", "e as e2")
    over = intervals.overlapping(q, r, ["path"], ("s", "e"), ("s2", "e2"))
    assert sorted((x["sid"], x["sid2"]) for x in over.collect()) == sorted((a[0], b[0]) for a in spans for b in spans if a[1] and a[1] == b[1] and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3])


def test_merging_equals_a_plain_fold(spark):
    rng = random.Random(21)
    made = [(f"f{rng.randint(0, 2)}", rng.randint(0, 120), rng.choice(["s", "t", "u", None, None]), f"c{i:03d}", rng.choice("xyz")) for i in range(400)]
    want, clusters = {}, {}
    for fp, line, symbol in sorted({m[:3] for m in made}, key=lambda m: (m[0], m[1], m[2] is None, m[2] or "")):
        for c in clusters.setdefault(fp, []):
            if (symbol == c[1]) if None not in (symbol, c[1]) else abs(line - c[0]) <= 12:
                break
        else:
            clusters[fp].append(c := (line, symbol))
        want[fp, line, symbol] = c
    merged: dict = {}
    for m in made:
        merged.setdefault((m[0], *want[m[:3]]), []).append(m)
    expected = []
    for (fp, *_), group in merged.items():
        group.sort(key=lambda m: (m[1], m[3], m[4]))
        expected.append((fp, group[0][1], group[0][3], len(group), list(dict.fromkeys(m[4] for m in group))))
    got = dedup.merge_candidates(spark.createDataFrame(made, "fingerprint string, line int, symbol string, candidate_id string, tool string").repartition(5))
    assert rows(got) == sorted(expected, key=repr)


def test_matching_equals_a_plain_choice(spark):
    rng = random.Random(5)
    pairs = sorted({(rng.choice("ab"), rng.randint(0, 40), rng.randint(0, 30)) for _ in range(300)})
    given = [(c, t, f, (t * 7 + f * 3) % 5) for c, t, f in pairs]
    want = []
    for case in "ab":
        taken = set()
        for t in sorted({p[1] for p in given if p[0] == case}):
            free = [(p[3], p[2]) for p in given if p[:2] == (case, t) and p[2] not in taken]
            if free:
                taken.add(min(free)[1])
                want.append((case, t, min(free)[1]))
    got = matching.match_one_to_one(spark.createDataFrame(given, "case_id string, truth int, finding_id int, distance long"))
    assert rows(got) == sorted(want, key=repr) and matching.match_one_to_one(got.withColumn("distance", F.lit(0).cast("long")).limit(0)).count() == 0


def test_closure_and_macros_run_to_the_end(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(75)], "a int, b int")
    assert graph.closure(chain, "a", "b").count() == 75 * 76 // 2
    nested = spark.createDataFrame([(f"m{i}", "f.c" if i == 0 else "m.h", 3 if i == 0 else 100 * i, "m.h", 100 * (i + 1), 100 * (i + 1)) for i in range(20)], "usr string, path string, line int, body_path string, body_start int, body_end int")
    assert graph.macro_fixpoint(spark.createDataFrame([("f.c", 1, 5)], "path string, start_line int, end_line int"), nested).count() == 20


def test_quotations_are_compared_by_byte(spark):
    answers = spark.createDataFrame([("c1", [("e1", "F"), ("e1", "d"), ("e1", "é"), ("e2", "x"), ("e1", None)])], "candidate_id string, quotations array<struct<evidence_id:string,text:string>>")
    captured = spark.createDataFrame([("c1", "e1", bytearray("abcdfé".encode()))], "candidate_id string, evidence_id string, captured binary")
    assert rows(gate.quotations(answers, captured), "subject") == [("e1",), ("e1",), ("e2",)]


def test_one_truth_takes_one_finding(spark):
    truths = spark.createDataFrame([("c", "a.c", 0, 10, "CWE-787", "f", "vulnerable"), ("c", "a.c", 1, 11, "CWE-787", "f", "vulnerable"), ("c", "a.c", 2, 10, "CWE-787", "f", "fixed")], "case_id string, path string, truth int, line int, cwe string, family string, variant string")
    findings = spark.createDataFrame([("c", "a.c", "z", 11, 11, "CWE-121", "f"), ("c", "a.c", "y", 30, 30, "CWE-787", "f")], "case_id string, path string, finding_id string, start_line int, end_line int, cwe string, family string")
    pairs = matching.match_one_to_one(matching.candidate_pairs(truths, findings))
    assert rows(pairs) == [("c", 0, "z")]
    counts = metrics.counts_by_family(matching.outcomes(truths, findings, pairs))
    assert rows(counts) == [("f", 1, 1, 1)]
    assert {r["finding_id"]: r["truth"] for r in matching.label_findings(findings, pairs).collect()} == {"z": True, "y": False}


def test_matching_does_not_depend_on_order(spark):
    truths = [("c", "a", i, 10 + i) for i in range(4)]
    found = [("c", "a", f"f{i}", 9 + i, 9 + i) for i in range(5)]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(found)
        pairs = matching.match_one_to_one(matching.candidate_pairs(spark.createDataFrame(truths, "case_id string, path string, truth int, line int"), spark.createDataFrame(found, "case_id string, path string, finding_id string, start_line int, end_line int"), check_cwe=False))
        seen.add(tuple(rows(pairs)))
    assert seen == {(("c", 0, "f1"), ("c", 1, "f2"), ("c", 2, "f3"), ("c", 3, "f4"))}


def test_empty_denominators(spark):
    got = metrics.family_metrics(spark.createDataFrame([("a", 0, 0, 0), ("b", 0, 1, 1), ("c", 2, 1, 0)], "family string, tp int, fp int, fn int"))
    by = {r["family"]: r for r in got.collect()}
    assert (by["a"]["precision"], by["a"]["f2"], by["a"]["scored"]) == (1.0, 1.0, False) and by["b"]["f2"] == 0.0 and by["c"]["f2"] == pytest.approx(10 / 11)
    assert metrics.overall_metrics(got).first()["macro_f2"] == pytest.approx(5 / 11, abs=1e-8)


def test_merge_is_greedy_and_not_transitive(spark):
    c = spark.createDataFrame([("f", n, None, f"c{n:02}", t) for n, t in ((0, "x"), (10, "y"), (20, "x"), (21, "z"))] + [("g", 0, "s", "d0", "x"), ("g", 500, "s", "d1", "y"), ("g", 1, "r", "d2", "y")], "fingerprint string, line int, symbol string, candidate_id string, tool string")
    got = {(r["fingerprint"], r["line"]): (r["candidate_id"], r["merged"], r["tools"]) for r in dedup.merge_candidates(c).collect()}
    assert got == {("f", 0): ("c00", 2, ["x", "y"]), ("f", 20): ("c20", 2, ["x", "z"]), ("g", 0): ("d0", 2, ["x", "y"]), ("g", 1): ("d2", 1, ["y"])}


def test_selection_skips_and_continues(spark):
    units = [("a", "p", 0, 50, True), ("a", "q", 1, 60, False), ("a", "r", 2, 20, False), ("a", "s", 3, 20, False), ("a", "t", 4, 1, False), ("b", "p", 0, 200, True), ("b", "q", 1, 1, False)]
    df = spark.createDataFrame(units, "candidate_id string, unit string, place int, tokens int, is_primary boolean")
    got = {(r["candidate_id"], r["unit"]): r["outcome"] for r in budget.select_units(df, 100, 3).collect()}
    assert got == {("a", "p"): "kept", ("a", "q"): "budget", ("a", "r"): "kept", ("a", "s"): "kept", ("a", "t"): "max_units", ("b", "p"): "primary_budget_exceeded", ("b", "q"): "primary_budget_exceeded"}
    assert budget.run_ledger([("a", 60), ("b", 60), ("c", 1)], 100, 80) == [("a", 80, 60, False), ("b", 40, 100, False), ("c", 0, 100, True)]


def test_ledger_equals_the_fold(spark):
    rng = random.Random(3)
    made = [(f"c{i:03d}", rng.randint(0, 50), rng.choice([0, 3, 10, 40, -2])) for i in range(300)]
    table = spark.createDataFrame(made, "candidate_id string, place int, tokens long").repartition(7)
    in_order = [(c, n) for c, _, n in sorted(made, key=lambda m: (m[1], m[0]))]
    for per_run, per_candidate in ((700, 15), (0, 5), (10**6, 20), (37, 100)):
        got = budget.ledger(table, per_run, per_candidate).orderBy("place", "candidate_id").select("candidate_id", "allowance", "spent", "starved").collect()
        assert [tuple(r) for r in got] == budget.run_ledger(in_order, per_run, per_candidate)
    assert budget.ledger(table.limit(0), 5, 5).count() == 0


def test_account(spark):
    a = budget.Account(requests=1, tokens=100, per_run=50, pricing={"triage": {"input": 2.0}})
    r = a.reserve(30)
    a.charge("triage", {"input": 40, "output": 10}, reservation=r)
    assert a.reserved == 50 and a.cost() == pytest.approx(8e-5) and a.reserve(1) is None and a.stop_reason() == "quota_requests"
    assert a.refuse("x")[2] == "x" and a.total_tokens == 50


def test_walks(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", None), ("x", "a")], "caller string, callee string")
    seed = spark.createDataFrame([("a",)], "node string")
    down = graph.walk(seed, e, 2)
    assert rows(down) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]
    assert rows(graph.unresolved_from(down, e, 2)) == [("a", 1)]
    assert rows(graph.unresolved_from(graph.walk(seed, e, 1), e, 1)) == []
    up = {(r["node"], r["depth"], r["unresolved"]) for r in graph.callers(seed, e, 1).collect()}
    assert up == {("a", 0, 1), ("c", 1, 1), ("x", 1, 1)}
    assert rows(graph.walked_edges(down, e, 2), "caller", "callee") == [("a", "b"), ("b", "c")]


def test_macros_virtual_calls_and_prefixes(spark):
    regions = spark.createDataFrame([("f.c", 1, 5)], "path string, start_line int, end_line int")
    macros = spark.createDataFrame([("A", "f.c", 3, "m.h", 10, 12), ("B", "m.h", 11, "m.h", 20, 20), ("C", "f.c", 9, "m.h", 30, 30)], "usr string, path string, line int, body_path string, body_start int, body_end int")
    assert rows(graph.macro_fixpoint(regions, macros)) == [("A", 0), ("B", 1)]
    calls = spark.createDataFrame([("m", "B.f", "virtual"), ("m", "g", "direct")], "caller string, callee string, kind string")
    derived = spark.createDataFrame([("B", "D")], "base string, class string")
    methods = spark.createDataFrame([("B.f", "B", "f()"), ("D.f", "D", "f()")], "usr string, class string, suffix string")
    assert rows(graph.resolve_virtual(calls, derived, methods)) == [("m", "B.f", "virtual", False), ("m", "D.f", "virtual", True), ("m", "g", "direct", False)]
    sites = spark.createDataFrame([(1, "a.c", 5, 9, "direct"), (2, "a.c", 50, 59, "direct"), (3, "a.c", 6, 7, "virtual")], "call_id int, path string, start_byte int, end_byte int, kind string")
    spans = spark.createDataFrame([("a.c", 0, 20)], "path string, start_byte int, end_byte int")
    assert {r["call_id"]: r["kind"] for r in graph.classify_macro_calls(sites, spans).collect()} == {1: "macro", 2: "direct", 3: "virtual"}


def _files(spark, data=b"one\ntwo\nthree\n"):
    return spark.createDataFrame([("a.c", data, len(data), [0, 4, 8])], "path string, content binary, size long, starts array<long>")


def test_resolution_ladder_order(spark):
    sha = hashlib.sha256(b"two\n").hexdigest()
    cited = [
        (1, None, None, "a.c", 2, 2, None, None, sha), (2, None, None, "a.c", 2, 2, None, None, "0" * 64), (3, None, None, "../a.c", 0, 0, None, None, None), (4, None, None, "a.c", 0, 0, None, None, None), (5, None, None, "b.c", 9, 9, None, None, None),
        (6, None, None, "a.c", 9, 9, None, None, None), (7, None, None, "a.c", 1, 1, 0, 99, None), (8, "ev-x", None, None, None, None, None, None, None), (9, None, None, None, None, None, None, None, None), (10, None, None, "x/a.c", 1, 1, None, None, None),
    ]
    df = spark.createDataFrame(cited, "citation_id int, evidence_id string, issued boolean, path string, start_line int, end_line int, start_byte long, end_byte long, sha256 string")
    got = {r["citation_id"]: r["status"] for r in resolution.resolve(df, _files(spark), ["x/*"]).collect()}
    assert got == {1: "ok", 2: "hash_mismatch", 3: "outside_repo_root", 4: "byte_range_invalid", 5: "missing_file", 6: "line_out_of_range", 7: "byte_range_invalid", 8: "unknown_evidence_id", 9: "byte_range_invalid", 10: "excluded_file"}


def test_symbols_and_edges(spark):
    symbols = spark.createDataFrame([("f", "c:f", "a.c", 1, 2), ("g", "c:g", "a.c", 3, 3)], "name string, usr string, path string, start_line int, end_line int")
    r = spark.createDataFrame([(1, "ok", "f", "a.c", 2, 2), (2, "ok", "g", "a.c", 1, 1), (3, "ok", "nope", "a.c", 1, 1), (4, "ok", None, "a.c", 1, 1)], "citation_id int, status string, symbol string, path string, start_line int, end_line int")
    assert {x["citation_id"]: x["status"] for x in resolution.check_symbols(r, symbols).collect()} == {1: "ok", 2: "symbol_not_found", 3: "symbol_not_found", 4: "ok"}
    claims = spark.createDataFrame([(1, "f", "g"), (2, "g", "f"), (3, "f", "nope"), (4, "c:f", "g")], "citation_id int, caller string, callee string")
    edges = spark.createDataFrame([("c:f", "c:g"), ("c:g", None)], "caller string, callee string")
    assert {x["citation_id"]: (x["status"], x["why"]) for x in resolution.check_edges(claims, symbols, edges).collect()} == {1: ("ok", None), 2: ("symbol_not_found", "missing_edge"), 3: ("symbol_not_found", "unknown_name"), 4: ("ok", None)}


def _answers(spark):
    schema = "candidate_id string, verdict string, cwe string, cwe_rationale string, cited array<string>, assumptions array<string>, quotations array<struct<evidence_id:string,text:string>>, reachability string, exploitability string"
    return spark.createDataFrame([("a", "confirmed", "CWE-416", "r", ["e1"], ["x"], [("e1", "free(p)")], "demonstrated", "plausible"), ("b", "confirmed", "CWE-664", "r", ["e9"], [], [], "unknown", "unknown"), ("c", "rejected", None, "", [], ["x"], [], "unknown", "unknown")], schema)


def test_gate_collects_all_failures(spark):
    answers = _answers(spark)
    issued = spark.createDataFrame([("a", "e1", bytearray(b"free(p);"), "primary_code", "caller")], "candidate_id string, evidence_id string, captured binary, kind string, role string")
    contexts = spark.createDataFrame([("b", 1, 0)], "candidate_id string, dropped int, limitations int")
    edges = spark.createDataFrame([("a", 0)], "candidate_id string, verified int")
    cited = spark.createDataFrame([("a", "free(p);")], "candidate_id string, text string")
    failures = gate.unissued(answers, issued).unionByName(gate.verdicts(answers)).unionByName(gate.quotations(answers, issued)).unionByName(gate.assumptions(answers, contexts)).unionByName(gate.weaknesses(answers, cited))
    claims = gate.capped_claims(answers, gate.signals(answers, issued, edges))
    got = {r["candidate_id"]: (r["accepted"], r["confidence"], r["reason"], r["reasons"], r["reachability"], r["exploitability"]) for r in gate.decide(answers, failures, claims).collect()}
    assert got["a"] == (True, "medium", "all_citations_resolved", ["impact_exceeds_evidence"], "argued", "plausible")
    assert got["b"][:3] == (False, "review_required", "citation_unresolved") and got["b"][3] == ["citation_unresolved", "cwe_mapping_rejected", "assumptions_unstated"]
    assert got["c"][:3] == (False, "review_required", "model_rejected")


def test_routing_and_triage(spark):
    df = spark.createDataFrame([("dismiss", True, "critical"), ("adjudicate", False, "critical"), ("adjudicate", True, "medium"), ("adjudicate", True, "high")], "d string, a boolean, s string")
    assert [r[0] for r in df.select(gate.route(F.col("d"), F.col("a"), F.col("s"), F.lit(True), F.lit(False))).collect()] == ["triage", "adjudication", "adjudication", "escalation"]
    assert tuple(df.select(gate.triage_of(F.lit("review_required")).alias("t")).first()["t"]) == ("adjudicate", True)


def test_suite_end_to_end(spark):
    data = b"one\ntwo\nthree\n"
    sha = lambda a, b: hashlib.sha256(data[a:b]).hexdigest()
    c = spark.createDataFrame([("k", "x", "a.c", 2, 2, 4, 8, sha(4, 8), ["CWE-416"], "m"), ("k", "y", "a.c", 3, 3, 8, 14, "0" * 64, ["CWE-416"], "m"), ("k", "z", "a.c", 1, 1, 0, 4, sha(0, 4), ["CWE-787"], "m")], "case_id string, candidate_id string, path string, start_line int, end_line int, start_byte long, end_byte long, sha256 string, cwes array<string>, message string")
    t = spark.createDataFrame([("k", 0, "a.c", 3, "CWE-416", "memory_lifetime", "vulnerable")], "case_id string, truth int, path string, line int, cwe string, family string, variant string")
    e = run_suite(c, t, _files(spark, data), spark.createDataFrame([("k", 3)], "case_id string, n int"))
    s = e.summary.first()
    assert (s["tp"], s["fp"], s["fn"], s["confirmed"], s["needs_review"]) == (1, 1, 0, 2, 1) and s["fp_per_kloc"] == pytest.approx(1000 / 3)
    assert {r["name"]: r["passed"] for r in e.gates.collect()} == {"citation_resolution": False, "zero_fabrication": False, "counts_separate": True, "baseline_floor": True}


def test_calibration_conventions(spark):
    f = spark.createDataFrame([("high", True)] * 4 + [("high", False)] * 4 + [("medium", True)] * 5, "confidence string, truth boolean")
    bins = quality.reliability(f)
    assert [(r["count"], r["accuracy"]) for r in bins.orderBy("place").collect()] == [(8, 0.5), (5, 1.0), (0, 1.0)]
    assert rows(quality.miscalibration(bins)) == [("high", 0.5, "medium", 1.0)] and quality.miscalibration(bins, 6).count() == 0
    assert quality.severity_agreement(spark.createDataFrame([("high", None)], "reported string, adjudicated string")).count() == 0
    assert quality.agreement(spark.createDataFrame([("a", True)], "category string, agreed boolean")).first()["kappa"] is None


def test_intake(spark):
    checks = spark.createDataFrame([("unix.Malloc",), ("core.*",), ("core.Null*",), ("-Wformat",)], "check_id string")
    ids = spark.createDataFrame([("clang-analyzer-unix.Malloc",), ("core.NullDereference",), ("core.X",), ("clang-diagnostic-format",), ("zzz",)], "rule_id string")
    assert dict(rows(intake.rules_lookup(ids, checks))) == {"clang-analyzer-unix.Malloc": "unix.Malloc", "core.NullDereference": "core.Null*", "core.X": "core.*", "clang-diagnostic-format": "-Wformat", "zzz": None}
    cov = spark.createDataFrame([(10, 6, 0.6), (10, 5, 0.5), (10, 10, 1.0)], "present int, covered int, ratio double")
    assert [r["verdict"] for r in intake.completeness(cov).collect()] == ["limited", "refused", "complete"]


def test_experiments(spark):
    base = {"name": "base", "budget": 10, "depth": 1, "retrieval": "structural"}
    got = experiments.grid(base, {"budget": [10, 20], "depth": [2]}, ("retrieval", "flat"))
    assert [r["name"] for r in got] == ["base", "budget=20", "depth=2", "control"] and experiments.differing_fields(base, got[1]) == ["budget"]
    with pytest.raises(ValueError):
        experiments.vary(base, "budget", 10)
    scores = spark.createDataFrame([("base", 0.5), ("control", None)], "name string, score double")
    assert experiments.earns_itself(scores, "base", "control").first()["earns"] is None
    assert experiments.comparable({"suite": "a", "version": 1, "scope": ["x"]}, {"suite": "b", "version": 1, "scope": ["y"]}) == ["suites differ", "scopes differ"]
    assert experiments.comparable({"suite": "a"}, {"suite": "a", "policies": {"prompt": "2"}}) == []
    runs = spark.createDataFrame([(True, "h"), (True, "h"), (False, "z")], "completed boolean, result_hash string")
    assert tuple(experiments.repeatable(runs).first()) == (3, 2, True)
    reports = spark.createDataFrame([("A0", "i", 0.2), ("A2", "i", 0.3)], "stage string, identity string, macro_f2 double")
    assert {r["stage"]: r["status"] for r in experiments.attribution(reports, ["A7"]).collect()}["A2"] == "measured"


def test_retrieval(spark):
    candidates = spark.createDataFrame([("k", "a.c", 5, 5), ("o", "z.c", 1, 2)], "candidate_id string, path string, line int, end_line int")
    symbols = spark.createDataFrame([("f", "function", "a.c", 1, 10), ("inner", "function", "a.c", 4, 6), ("g", "function", "a.c", 20, 30), ("T", "struct", "t.h", 1, 3)], "usr string, kind string, path string, start_line int, end_line int")
    edges = spark.createDataFrame([("inner", "g", "g", "a.c", 5), ("g", "h", "kfree", "a.c", 22), ("f", "inner", "inner", "a.c", 8), ("inner", "h", "free", "a.c", 6)], "caller string, callee string, name string, path string, line int")
    types = spark.createDataFrame([("inner", "T")], "source string, target string")
    none = spark.createDataFrame([], "source string, target string")
    got = {(r["candidate_id"], r["role"], r["usr"], r["depth"]) for r in retrieval.expand(candidates, symbols, edges, types, none).collect()}
    assert got == {("k", "containing_function", "inner", 0), ("k", "caller", "f", 1), ("k", "callee", "g", 1), ("k", "callee", "h", 1), ("k", "type_decl", "T", 1), ("k", "cleanup_path", "inner", 1), ("o", "candidate_site", None, 0)}
    files = spark.createDataFrame([("a.c", "void f() {\nx;\nif (y)\n goto out;\nz;\nout:\n free(p);\n}")], "path string, text string")
    own = spark.createDataFrame([("k", "f", "a.c", 1, 8)], "candidate_id string, usr string, path string, start_line int, end_line int")
    assert rows(retrieval.label_blocks(own, files), "start_line", "end_line") == [(6, 8)]


def test_scan_composition(spark):
    from tarnwork.plans import scan

    entries = spark.createDataFrame([("a.c", 0, ["cc"]), ("a.c", 1, ["cc", "-g"]), ("vendor/b.c", 2, ["cc"]), (None, 3, [])], "path string, ordinal int, arguments array<string>")
    from tarnwork.functions.paths import is_third_party

    plan = scan.scan_plan(entries, F.when(is_third_party(F.col("path")), "third_party"), spark.createDataFrame([("a.c",), ("c.c",)], "path string"))
    assert rows(plan["units"], "path", "arguments") == [("a.c", ["cc", "-g"])] and rows(plan["excluded"]) == [("vendor/b.c", "third_party")]
    assert plan["coverage"].first()["verdict"] == "refused" and plan["limitations"].count() == 2

    def runner(path, name, arguments):
        if name == "bad":
            raise RuntimeError("no")
        return "ok", f"/r/{path}:1:1: warning: memory is never released [-Wleak]\n/r/{path}:2:1: warning: memory is never released [-Wleak]\n"

    runs = scan.run_analyzers(plan["units"], spark.createDataFrame([("good",), ("bad",)], "analyzer string"), runner)
    assert rows(scan.run_limitations(runs)) == [("analyzer_failed", "a.c", "bad: crashed")]
    files = spark.createDataFrame([("a.c", bytearray(b"x\ny\n"), [0, 2])], "path string, content binary, starts array<long>")
    checks = spark.createDataFrame([("-Wl*", ["CWE-401"])], "check_id string, cwes array<string>")
    got = scan.generate_candidates(runs.where("status = 'ok'").select(F.col("unit").alias("run"), "text"), files, "/r", "clang_diagnostic", checks).collect()
    assert [(r["line"], r["merged"], r["cwes"]) for r in got] == [(1, 2, ["CWE-401"])]
    assert scan.revision({"head": "abc\n", "status": " M a"}) == {"revision": "abc", "dirty": True, "pinned": False, "limitation": None} and scan.revision({})["limitation"]


def test_incremental_index(spark):
    from tarnwork.plans import scan

    inputs = spark.createDataFrame([("u", "a", "1"), ("v", "b", "1")], "unit string, path string, sha256 string")
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    cached = spark.createDataFrame([("u", "ok", None, "old"), ("v", "ok", None, "old")], "unit string, status string, error string, x string")
    units = spark.createDataFrame([("u",), ("v",), ("w",)], "unit string")
    parse = lambda u: u.select("unit", F.when(F.col("unit") == "w", "failed").otherwise("ok").alias("status"), F.lit("'q.h' file not found").alias("error"), F.lit("new").alias("x"))
    ok, limits = scan.build_index(inputs, now, cached, parse, units)
    assert rows(ok, "unit", "x") == [("u", "old"), ("v", "new")] and rows(limits, "kind", "affects") == [("toolchain_unavailable", "w")]


def test_profiles_and_prompts(spark):
    from tarnwork.functions import prompts, symbols
    from tarnwork.sources import profiles

    raw = {"version": "1", "csa": {"checks": [{"id": "core.X", "families": ["integer"], "cwe": ["CWE-190"]}]}, "tidy": {"checks": [{"id": "b", "families": ["integer"]}, {"id": "a", "families": ["injection"], "enabled": False}]}}
    checks = profiles.parse_profile(spark, raw)
    assert profiles.checks_argument(checks) == "-*,b,-a" and rows(profiles.families_covered(checks)) == [("integer",)]
    for bad in ([], {}, {"version": "1", "csa": {"checks": [{"id": "x", "families": ["zzz"]}]}}, {"version": "1", "csa": {"checks": [{"id": "x", "families": ["integer"]}] * 2}}):
        with pytest.raises(profiles.ProfileError):
            profiles.parse_profile(spark, bad)
    df = spark.createDataFrame([("VERDICT: Confirmed\ncwe: cwe-416\nRationale: because \n",), ("VERDICT: confirmed\nRATIONALE: x",), ("hm",)], "t string")
    assert [tuple(r[0]) if r[0] else None for r in df.select(prompts.read_answer(F.col("t"))).collect()] == [("confirmed", "CWE-416", "because"), None, None]
    one = spark.range(1).select(symbols.normalize_usr(F.lit("c:a.c@12@macro@X"), F.lit("s/a.c")).alias("a"), symbols.normalize_usr(F.lit("c:@F@f"), F.lit("s/a.c")).alias("b"), symbols.qualified_name(F.array(F.lit("c"), F.lit(""), F.lit("A"))).alias("c")).first()
    assert tuple(one) == ("c:s/a.c@macro@X", "c:@F@f", "A::c")
    unit = prompts.render_unit(F.lit("ev-1"), F.lit("caller"), F.lit("a.c"), F.lit(1), F.lit(2), F.lit("x ``` y"))
    text = spark.range(1).select(prompts.assemble(F.lit("m"), F.array(unit), F.array(F.struct(F.lit("k").alias("kind"), F.lit("d").alias("detail")))).alias("p")).first()["p"]
    assert "````\nx ``` y\n````" in text["text"] and text["text"].endswith("- k: d") and text["tokens"] > 0


def test_checks(spark):
    from tarnwork.functions import schema
    from tarnwork.operators import checks
    from tarnwork.sources import records

    df = spark.createDataFrame([("a.c",), ("x/b.c",)], "path string")
    shown, limits = checks.withheld(df, ["x/*"])
    assert rows(shown) == [("a.c",)] and rows(limits) == [("excluded_by_filter", "x/b.c", "withheld by x/*")]
    with pytest.raises(Exception, match="excluded"):
        checks.refuse(df, F.col("path").startswith("x"), "excluded path").collect()
    cases = spark.createDataFrame([("k",), ("l",)], "case_id string")
    assert rows(checks.select_cases(cases, ["k"])) == [("k",)]
    with pytest.raises(KeyError):
        checks.select_cases(cases, ["z"])
    bundle = spark.createDataFrame([("e", bytearray(b"x"), hashlib.sha256(b"x").hexdigest()), ("f", bytearray(b"x"), "0")], "evidence_id string, captured binary, sha256 string")
    ids = spark.createDataFrame([("e",), ("f",), ("g",)], "evidence_id string")
    assert dict(rows(checks.captured_intact(bundle, ids))) == {"e": True, "f": False, "g": False}
    flat = schema.flatten({"$defs": {"A": {"type": "object", "title": "A", "properties": {"title": {"type": "string", "title": "t"}}}}, "properties": {"a": {"$ref": "#/$defs/A"}, "b": {"anyOf": [{"type": "string"}, {"type": "null"}]}}})
    assert flat == {"properties": {"a": {"type": "object", "properties": {"title": {"type": "string"}}}, "b": {"type": "string", "nullable": True}}}
    with pytest.raises(ValueError):
        schema.flatten({"$defs": {"A": {"properties": {"x": {"$ref": "#/$defs/A"}}}}, "properties": {"a": {"$ref": "#/$defs/A"}}})
    assert records.checkpoint_state(None, "i") is None and records.checkpoint_state('{"identity": "i"}', "i") == {"identity": "i"}
    with pytest.raises(ValueError):
        records.checkpoint_state('{"identity": "j"}', "i")
    got = spark.range(1).select(records.case_arguments(F.lit("gcc -c a.c -o a.o -Wall"), F.lit("a.c")).alias("x")).first()["x"]
    assert got == ["gcc", "-Wall", "a.c"]
