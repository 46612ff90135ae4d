"""Facts of sources, lookups in them, and asking models about candidates."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import ids
from tarnwork.operators import graph, lookups, retrieval
from tarnwork.plans import adjudication
from tarnwork.sources import cfacts

from .conftest import rows

SOURCE = """#include "util.h"
#include <stdio.h>
#define LIMIT 10 /* not { a scope */
#define GUARD(x) \\
  if (!(x)) return -1
struct node { int value; struct node *next; };
typedef struct node node_t;
static int counter = 0;
int handlers[4];
static int helper(node_t *n);
// call nothing( here
int visit(struct node *n, int (*cb)(int)) {
  const char *s = "helper(n) }";
  GUARD(n);
  counter += LIMIT;
  n->run(n);
  (*cb)(1);
  if (n->value > 1) { return helper(n->next); }
  free(n);
  return 0;
}
static int helper(node_t *n) { return visit(n, 0); }
"""

CLASSES = """namespace a {
class Base { public: virtual void go(int); int x; };
class Derived : public Base {
 public:
  Derived() { go(1); }
  ~Derived() {}
  void go(int v) override { x = v; }
};
}
void a::Base::go(int v) { x = v; }
"""


def index(spark):
    units = spark.createDataFrame([("src/main.c", SOURCE), ("src/shape.cpp", CLASSES), ("src/bad.c", None), ("src/open.c", "int f() { if (1) {")], "path string, text string")
    return cfacts.tables(cfacts.extract(units, ["src/util.h", "src/main.c"]).cache())


def test_facts_of_c(spark):
    t = index(spark)
    symbols = {(r["name"], r["kind"], r["start_line"], r["end_line"], r["is_definition"]) for r in t["symbols"].where("path = 'src/main.c'").collect()}
    assert symbols == {("node", "type", 6, 6, True), ("node_t", "typedef", 7, 7, True), ("counter", "variable", 8, 8, True), ("handlers", "variable", 9, 9, True), ("helper", "function", 10, 10, False), ("visit", "function", 12, 21, True), ("helper", "function", 22, 22, True)}
    calls = {(r["caller"].rsplit("@", 1)[-1], (r["callee"] or "?").rsplit("@", 1)[-1], r["name"], r["kind"], r["line"]) for r in t["calls"].where("path = 'src/main.c'").collect()}
    assert calls == {("visit", "?", "run", "function_pointer", 16), ("visit", "?", None, "function_pointer", 17), ("visit", "helper", "helper", "direct", 18), ("visit", "free", "free", "direct", 19), ("helper", "visit", "visit", "direct", 22)}
    assert {(r["name"], r["line"]) for r in t["expansions"].collect()} == {("GUARD", 14), ("LIMIT", 15)}
    assert rows(t["includes"], "included", "spelling") == [("src/util.h", "util.h"), (None, "stdio.h")] or rows(t["includes"], "spelling") == [("stdio.h",), ("util.h",)]
    assert {(r["source"].rsplit("@", 1)[-1], r["target"].rsplit("@", 1)[-1]) for r in t["global_references"].collect()} == {("visit", "counter")}
    assert ("helper", "node_t") in {(r["source"].rsplit("@", 1)[-1], r["target"].rsplit("@", 1)[-1]) for r in t["type_references"].collect()}
    data = SOURCE.encode()
    for r in t["symbols"].where("path = 'src/main.c' and name = 'visit'").collect():
        assert data[r["start_byte"] : r["end_byte"]].startswith(b"int visit") and data[r["start_byte"] : r["end_byte"]].endswith(b"}")
    kinds = {(r["kind"], r["affects"]) for r in t["limitations"].collect()}
    assert ("parse_failed", "src/bad.c") in kinds and ("parse_failed", "c:@F@f") in kinds and any(k == "unresolved_indirect_call" for k, _ in kinds)
    assert {r["path"] for r in t["inputs"].collect()} == {"src/main.c", "src/shape.cpp", "src/open.c"}


def test_facts_of_classes(spark):
    t = index(spark)
    found = {(r["qualified_name"], r["kind"]) for r in t["symbols"].where("path = 'src/shape.cpp' and is_definition").collect()}
    assert {("a::Base", "type"), ("a::Derived", "type"), ("a::Derived::Derived", "constructor"), ("a::Derived::~Derived", "destructor"), ("a::Derived::go", "method")} <= found
    derived = t["derived"].select(F.concat(F.lit("c:@a@S@"), "base").alias("base"), "class")
    assert rows(derived) == [("c:@a@S@Base", "c:@a@S@Derived")]
    assert {(r["class"].rsplit("@", 1)[-1], r["suffix"]) for r in t["methods"].collect()} == {("Base", "go"), ("Derived", "go")}
    calls = spark.createDataFrame([("m", "c:@a@Base@F@go", "virtual")], "caller string, callee string, kind string")
    fanned = graph.resolve_virtual(calls, derived, t["methods"])
    assert {r["callee"] for r in fanned.collect()} == {"c:@a@Base@F@go", "c:@a@Derived@F@go"}


def test_very_long_and_odd_sources():
    import time

    for text in ("{" * 200_000, "(" * 200_000, "a(" * 100_000, "/*" * 200_000, '"' * 200_001, "#define x \\\n" * 50_000, "int f() {" + "g(1);" * 50_000 + "}", "\\" * 100_000, "class A : " * 20_000):
        began = time.process_time()
        assert cfacts.parse_unit("u.c", text) is not None
        assert time.process_time() - began < 20, text[:9]


def test_lookups(spark):
    t = index(spark)
    main = spark.createDataFrame([("src/main.c",)], "path string")
    assert lookups.symbols_in_files(t["symbols"], main).count() == 6
    names = spark.createDataFrame([("a::Derived::go",), ("visit",)], "name string")
    assert len(lookups.symbols_named(t["symbols"], names).collect()) == 2
    refs = lookups.referenced_symbols(t["global_references"], t["symbols"])
    assert [r["name"] for r in refs.collect()] == ["counter"]
    assert [len(r["targets"]) for r in lookups.targets_of(t["type_references"]).orderBy("source").collect()]
    visit, helper = "c:@F@visit", "c:src/main.c@F@helper"
    asked = spark.createDataFrame([(visit, helper), (helper, helper)], "caller string, callee string")
    assert {(r["caller"], r["has_edge"]) for r in lookups.has_edges(asked, t["calls"]).collect()} == {(visit, True), (helper, False)}
    assert lookups.expansions_named(t["expansions"], spark.createDataFrame([("LIMIT",)], "name string")).count() == 1
    assert rows(lookups.includes_of(t["includes"], main)) == [("src/main.c", "src/util.h")]
    assert rows(lookups.included_by(t["includes"], spark.createDataFrame([("src/util.h",)], "included string"))) == [("src/util.h", "src/main.c")]
    assert rows(lookups.external_includes(t["includes"])) == [("stdio.h", 1)]
    down = graph.walk(spark.createDataFrame([(visit,)], "node string"), t["calls"].select("caller", "callee"), 1)
    assert {r["node"] for r in down.collect()} == {visit, helper, "c:@F@free"} and rows(graph.unresolved_from(down, t["calls"], 1)) == [(visit, 2)]
    own = retrieval.containing(spark.createDataFrame([("c1", "src/main.c", 18, 18)], "candidate_id string, path string, line int, end_line int"), t["symbols"].where("is_definition"))
    assert rows(own, "usr", "start_line", "end_line") == [(visit, 12, 21)]
    assert {r["start_line"] for r in retrieval.release_sites(own, t["calls"], t["symbols"]).collect()} == {19}
    cases = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 9)], "s string, id int")
    assert lookups.stratified_pick(cases, "s", "id", 3).count() == 2 and lookups.stratified_pick(cases, "s", "id", 3, 2).count() == 3
    stages = spark.createDataFrame([("r", "ok"), ("r", "degraded"), ("q", "ok")], "run_id string, status string")
    assert rows(lookups.partial(stages)) == [("q", False), ("r", True)] and rows(lookups.status_counts(stages)) == [("degraded", 1), ("ok", 2)]
    assert lookups.allowed_models({"model_policy": {"a": {"model": "m2"}, "b": {"model": "m1"}}}) == ["m1", "m2"]
    assert lookups.overlay({"a": {"b": 1}, "c": 2}, {"a.b": 5}) == {"a": {"b": 5}, "c": 2}
    with pytest.raises(KeyError):
        lookups.overlay({"a": {"b": 1}}, {"a.x": 5})


def reply(verdict, cited=(), cwe="CWE-787", **more):
    return json.dumps({"verdict": verdict, "rationale": "because", "cited": list(cited), "cwe": cwe, **more})


def test_attempts():
    def provider(*turns):
        it = iter(turns)
        return lambda tier, prompt, correction: next(it)

    ok, bad = adjudication.Reply(reply("confirmed", ["e1"]), None, 5, 7), adjudication.Reply("{}", None, 5, 1)
    answer, asked = adjudication.attempt(provider(bad, adjudication.Reply(failure="transport: x"), ok), "adjudication", "p", ["e1"])
    assert answer["verdict"] == "confirmed" and [x[2] for x in asked.log] == ["schema_invalid", "transport_error", "accepted"] and (asked.calls, asked.input_tokens) == (3, 10)
    answer, asked = adjudication.attempt(provider(adjudication.Reply(reply("confirmed", ["other"])), ok), "adjudication", "p", ["e1"])
    assert answer is None and asked.calls == 1 and adjudication.reason_of(asked.log) == "citation_unresolved"
    answer, asked = adjudication.attempt(provider(bad, bad, bad, ok), "adjudication", "p", [])
    assert answer is None and asked.calls == 3 and adjudication.reason_of(asked.log) == "schema_invalid_response"
    answer, asked = adjudication.attempt(provider(adjudication.Reply(failure="refused: policy"), ok), "adjudication", "p", [])
    assert answer is None and asked.calls == 1 and adjudication.reason_of(asked.log) == "provider_unavailable"
    answer, asked = adjudication.attempt(provider(), "adjudication", "p", [], remembered=reply("rejected"))
    assert answer["verdict"] == "rejected" and asked.calls == 0 and asked.log[0][2] == "cached"
    answer, asked = adjudication.attempt(provider(*[adjudication.Reply(failure="transport")] * 9), "adjudication", "p", [])
    assert answer is None and asked.calls == 3


def test_adjudication_of_a_table(spark):
    turns = {
        ("p1", "triage"): [{"text": reply("confirmed")}], ("p1", "adjudication"): [{"text": reply("confirmed", ["e1"]), "input_tokens": 11}],
        ("p2", "triage"): [{"text": reply("rejected")}],
        ("p3", "triage"): [{"text": reply("review_required")}], ("p3", "adjudication"): [{"text": reply("review_required", ["e3"])}], ("p3", "escalation"): [{"text": reply("confirmed", ["e3"])}],
        ("p4", "triage"): [{"text": reply("review_required")}], ("p4", "adjudication"): [{"text": reply("review_required", ["e4"])}], ("p4", "escalation"): [{"failure": "refused"}],
        ("p5", "adjudication"): [{"text": reply("confirmed", ["not issued"])}],
    }
    made = [("c1", "p1", ["e1"], "low", False), ("c2", "p2", ["e2"], "high", False), ("c3", "p3", ["e3"], "critical", False), ("c4", "p4", ["e4"], "high", False), ("c5", "p5", ["e5"], "high", False), ("c6", None, [], "high", False), ("c7", "p7", [], "high", True), ("c8", "p8", ["e8"], "low", False)]
    table = spark.createDataFrame([(*m[:4], True, m[4]) for m in made], "candidate_id string, prompt string, issued array<string>, severity string, triage boolean, starved boolean")
    key = spark.range(1).select(ids.cache_key(F.lit("p8"), F.lit("recorded"), F.lit("1"), F.lit("1")).alias("key")).first()["key"]
    cache = spark.createDataFrame([(key, reply("rejected"))], "key string, text string")
    out = {r["candidate_id"]: r for r in adjudication.adjudicate(table, adjudication.Replay(turns), True, cache).collect()}
    got = {c: (r["tier"], r["answered"], r["verdict"], r["reason"]) for c, r in out.items()}
    assert got == {
        "c1": ("adjudication", True, "confirmed", None), "c2": ("triage", True, "rejected", None), "c3": ("escalation", True, "confirmed", None), "c4": ("adjudication", True, "review_required", None),
        "c5": ("adjudication", False, None, "citation_unresolved"), "c6": ("adjudication", False, None, "context_budget_exceeded"), "c7": ("adjudication", False, None, "run_budget_exhausted"), "c8": ("adjudication", True, "rejected", None),
    }
    assert out["c1"]["input_tokens"] == 11 and out["c4"]["attempts"][-1]["outcome"] == "refused" and out["c8"]["attempts"][-1]["outcome"] == "cached"
    with pytest.raises(PermissionError):
        adjudication.adjudicate(table, adjudication.Replay(turns), False)


def test_control_conditions(spark):
    files = spark.createDataFrame([("a.c", "one\ntwo\nthree\nfour\nfive")], "path string, text string")
    c = spark.createDataFrame([("c1", "k1", "a.c", 3, "bad"), ("c2", "k2", "a.c", 1, "x")], "candidate_id string, case_id string, path string, line int, message string")
    prompts = {r["candidate_id"]: r["prompt"] for r in adjudication.naive_prompts(c, files, 1).collect()}
    assert "two\nthree\nfour" in prompts["c1"] and "one\ntwo" in prompts["c2"] and "three" not in prompts["c2"]
    outcomes = spark.createDataFrame([("c1", True, "confirmed", "CWE-416", "r", "k1"), ("c2", True, "rejected", None, "r", "k2")], "candidate_id string, answered boolean, verdict string, cwe string, rationale string, case_id string")
    assert rows(adjudication.naive_findings(outcomes, c), "candidate_id", "cwe") == [("c1", "CWE-416")]
    cases = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "case_id string")
    got = adjudication.adjudicated_cases(cases, outcomes, cases.where("case_id <> 'k3'"))
    assert rows(got) == [("k1", "adjudicated", 1, 1), ("k2", "adjudicated", 1, 0), ("k3", "unindexable", None, None)]
    prompts = spark.createDataFrame([("c1", 1, "x" * 30), ("c2", 2, "y" * 30), ("c3", 3, "z")], "candidate_id string, place int, prompt string")
    issued = spark.createDataFrame([("c1", "e2"), ("c1", "e1")], "candidate_id string, evidence_id string")
    made = adjudication.requests(prompts, issued, spark.createDataFrame([("c1", "high")], "candidate_id string, severity string"), 15, 100)
    assert {r["candidate_id"]: (r["starved"], r["issued"]) for r in made.collect()} == {"c1": (False, ["e1", "e2"]), "c2": (False, None), "c3": (True, None)}
    out = adjudication.tools_baseline(spark.createDataFrame([("src/a.c", bytearray(b"int x;\nint y;\n"), [0, 7], ["-c"])], "path string, content binary, starts array<long>, arguments array<string>"), "/r", lambda path, tool, args: ("ok", f"/r/{path}:2:5: warning: bad thing [core.X]"), ["t"], "clang_tidy")
    assert [r["drop_reason"] for r in out["candidates"].collect()] == [None] and out["limitations"].count() == 0


def test_revision_of_a_tree(tmp_path):
    import subprocess

    from tarnwork.plans import scan

    assert scan.resolve_revision(str(tmp_path))["limitation"] == "revision_unavailable"
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.c").write_text("int x;")
    run("add", "a.c")
    run("commit", "-qm", "one")
    clean = scan.resolve_revision(str(tmp_path))
    assert clean["pinned"] and len(clean["revision"]) == 40
    (tmp_path / "a.c").write_text("int y;")
    assert scan.resolve_revision(str(tmp_path))["dirty"] and scan.resolve_revision("/", lambda root, a: None)["revision"] == "unknown"


def test_runs_made_several_times(spark):
    from tarnwork.operators import experiments

    def run(i):
        if i == 2:
            raise RuntimeError("broken")
        return spark.range(20).selectExpr("id", "id % 3 as g").repartition(i + 1)

    attempts = experiments.run_repeatedly(spark, run, 4, "g", ["id"])
    assert tuple(experiments.repeatable(attempts).first()) == (4, 3, True)
    other = experiments.run_repeatedly(spark, lambda i: spark.range(20 + i).selectExpr("id", "id % 3 as g"), 2, "g", ["id"])
    assert not experiments.repeatable(other).first()["repeatable"]
