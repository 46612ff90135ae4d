"""What grows with the input: the joins, sorts and tasks of operators, by their plans and on keys that many rows share."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.functions.regions import line_starts, text_line_starts
from tarnwork.operators import graph, intervals, lookups, matching, resolution, retrieval
from tarnwork.streaming import trace

from .conftest import rows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()

def test_points_probe_the_levels_in_use(spark):
    points = spark.createDataFrame([(i, "a", i) for i in range(40)] + [(99, None, 3), (98, "a", None)], "pid int, path string, line int")
    spans = spark.createDataFrame([(1, "a", 3, 9), (2, "a", 30, 35), (3, "b", 0, 90), (4, "a", 8, 7)], "sid int, path string, s int, e int")
    join = lambda q, how: intervals.points_in_intervals(points, q, ["path"], "line", "s", "e", how)
    held = [*range(3, 10), *range(30, 36)]
    assert sorted(r.pid for r in join(spans, "left_semi").collect()) == sorted(r.pid for r in join(spans, "inner").collect()) == held
    assert rows(join(spans, "left_anti"), "pid") == sorted([(i,) for i in [*range(40), 98, 99] if i not in held], key=repr)
    assert join(spans.limit(0), "left_semi").count() == 0 and join(spans.limit(0), "left_anti").count() == 42
    # rows are neither copied nor made distinct and joined again
    assert "explode([0" not in plan(join(spans, "inner")).replace("array(0", "[0") and "Aggregate" not in plan(join(spans, "left_semi"))
    long = spans.unionByName(spark.createDataFrame([(5, "a", 20, 2**30)], "sid int, path string, s int, e int"))
    assert sorted(r.pid for r in join(long, "left_semi").collect()) == [*range(3, 10), *range(20, 40)]


def test_matching_broadcasts_no_table_that_grows(spark):
    truths = spark.createDataFrame([("k", "p", i, 20 * i, "CWE-787") for i in range(9)], "case_id string, path string, truth int, line int, cwe string")
    findings = spark.createDataFrame([("k", "p", f"f{i}", 20 * i + 1, 20 * i + 1, ["CWE-787", "CWE-79"][i % 2], i % 4, i < 6) for i in range(9)], "case_id string, path string, finding_id string, start_line int, end_line int, cwe string, tolerance int, check_cwe boolean")
    pairs = matching.candidate_pairs(truths, findings, tolerance=F.col("tolerance"), check_cwe=F.col("check_cwe"))
    assert rows(pairs, "truth", "finding_id") == [(2, "f2"), (6, "f6"), (7, "f7")]
    left = matching.outcomes(truths.withColumns({"family": F.lit("x"), "variant": F.lit("vulnerable")}), findings.withColumn("family", F.lit("x")), pairs)
    assert "BroadcastHashJoin" not in plan(pairs) + plan(left)


def test_containing_regions_meet_no_null_key(spark):
    candidates = spark.createDataFrame([(i, "a", i, None) for i in range(40)], "candidate_id int, path string, line int, end_line int")
    symbols = spark.createDataFrame([("f", "function", "a", 3, 9), ("g", "function", "a", 4, 5), ("g", "function", "a", 50, 51)], "usr string, kind string, path string, start_line int, end_line int")
    got = retrieval.containing(candidates, symbols)
    assert {(r.candidate_id, r.usr, r.start_line) for r in got.collect()} == {(i, "f", 3) for i in (3, 6, 7, 8, 9)} | {(i, "g", s) for i in (4, 5) for s in (4, 50)} | {(i, None, i) for i in range(40) if not 3 <= i <= 9}
    # candidates in no function all have a null usr: an outer join by it would have them in one task
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LeftOuter") == 1


def test_overrides_are_fanned_out_from_distinct_asks(spark):
    calls = spark.createDataFrame([(c, f"B{i}", "virtual") for c in "xy" for i in range(5)] + [("x", "g", "direct")], "caller string, callee string, kind string")
    derived = spark.createDataFrame([("B", "D"), ("B", "E"), ("D", "E")], "base string, class string")
    methods = spark.createDataFrame([(f"B{i}", "B", "f") for i in range(5)] + [("D0", "D", "f"), ("E0", "E", "f"), ("E0", "D", "f"), ("E1", "E", "h")], "usr string, class string, suffix string")
    got = graph.resolve_virtual(calls, derived, methods)
    assert "32" in plan(got) and rows(got.where("inferred"), "caller", "callee") == [("x", "D0"), ("x", "E0"), ("y", "D0"), ("y", "E0")] and got.where("not inferred").count() == 11


def test_overrides_go_out_in_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    for what, n in (("FAN", 100), ("BLOCK", 16), ("ROW", 1)):
        monkeypatch.setattr(graph, what, n, raising=False)
    own = [(f"D.{i}", "D", "f()") for i in range(40)] + [(None, "D", "f()"), ("two", "D", "f()"), ("two", "E", "f()"), ("E.0", "E", "f()"), ("D.g", "D", "g()"), ("D.0", "D", "f()"), (None, "D", None), ("none", None, "f()")]
    methods = spark.createDataFrame([("B.f", "B", "f()"), ("B.x", "B", None), *own], "usr string, class string, suffix string")
    calls = [(f"c{i}", "B.f", "virtual") for i in range(60)] + [(None, "B.f", "virtual"), ("c1", "B.x", "virtual"), ("c2", "B.f", "direct"), ("c1", "B.f", "virtual"), ("c3", None, "virtual")]
    derived = spark.createDataFrame([("B", "D"), ("B", "E")], "base string, class string")
    got = graph.resolve_virtual(spark.createDataFrame(calls, "caller string, callee string, kind string"), derived, methods)
    met = {u for u, c, s in own if c in ("D", "E") and s == "f()"}
    want = {(*c, False) for c in calls} | {(c[0], u, "virtual", True) for c in calls if c[1:] == ("B.f", "virtual") for u in met}
    assert rows(got) == sorted(want, key=repr)
    shares = [r["count"] for r in got.where("inferred").groupBy(F.spark_partition_id()).count().collect()]
    assert max(shares) * 4 < sum(shares), "a few tasks, by the bytes that went in"
    none = graph.resolve_virtual(spark.createDataFrame(calls, got.select("caller", "callee", "kind").schema), derived.limit(0), methods)
    assert none.schema.names == got.schema.names and rows(none) == sorted({(*c, False) for c in calls}, key=repr)


def test_symbols_cited_by_many_rows_are_not_one_task(spark, monkeypatch):
    monkeypatch.setattr(resolution, "HOT", 3)
    cited = [(i, "ok", ["f", "gone", "g", None][i % 4], "a", 5, None) for i in range(40)] + [(40, "ok", "g", "a", 50, 60), (41, "missing_file", "f", "a", 5, 5), (42, "ok", "f", "a", 6, 6)]
    symbols = spark.createDataFrame([("f", "u1", "a", 1, 5), ("g", "u2", "a", 55, 58)], "name string, usr string, path string, start_line int, end_line int")
    got = resolution.check_symbols(spark.createDataFrame(cited, "citation_id int, status string, symbol string, path string, start_line int, end_line int"), symbols)
    want = {i: "ok" if i % 4 in (0, 3) else "symbol_not_found" for i in range(40)} | {40: "ok", 41: "missing_file", 42: "symbol_not_found"}
    assert {r.citation_id: r.status for r in got.collect()} == want and got.count() == 43


def test_line_starts_of_texts_equal_those_of_their_bytes(spark):
    df = spark.createDataFrame([(x,) for x in ("", "\n", "a", "a\n", "é\nb\r\n\n", "\n\nx", None)], "text string")
    got = df.select(line_starts(F.encode("text", "UTF-8")).alias("a"), text_line_starts(F.col("text")).alias("b"))
    assert all(r.a == r.b for r in got.collect()) and got.where("b is null").count() == 1


def test_runs_are_followed_many_in_a_call(spark, tmp_path):
    # run_id, event, second: 3,000 runs and one without an id; the last event lets the watermark pass all others
    made = [(f"r{i}" if i else None, ["step", "run_closed", "open"][(i + k) % 3], i + k + 1) for i in range(3000) for k in range(i % 4 + 1)] + [("end", "open", 100_000)]
    for i in range(2):
        part = spark.createDataFrame(made[i::2], "run_id string, event string, at long")
        part.select("run_id", "event", F.timestamp_seconds("at").alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema("run_id string, event string, at timestamp").parquet(str(tmp_path / "in"))
    stream = trace.write_trace(trace.runs(read), str(tmp_path / "t"), str(tmp_path / "c"), once=True)
    stream.awaitTermination()
    got = {r[0]: tuple(r)[1:] for r in trace.read_committed(spark, str(tmp_path / "t")).select("run_id", F.unix_seconds("opened"), F.unix_seconds("closed"), F.unix_seconds("last"), "events", "outcome").collect()}
    want = {}
    for i in range(3000):
        ends = [i + k + 1 for k in range(i % 4 + 1) if (i + k) % 3 == 1]
        want[f"r{i}" if i else None] = (i + 1, min(ends, default=None), i + i % 4 + 1, i % 4 + 1, "closed" if ends else "abandoned")
    assert got == want
    # a run is no entry of the state of its own, as each entry costs a call of Python
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in stream.recentProgress) <= 1024


def test_references_are_not_sorted_to_find_their_symbols(spark):
    made = [(i % 7, f"u{i % 5}") for i in range(200)] + [(None, "u1"), (1, None), (1, "gone"), (9, "u1")]
    references = spark.createDataFrame(made, "source int, target string")
    symbols = spark.createDataFrame([(f"u{i}", p) for i in range(4) for p in ("a", "b")] + [(None, "c"), ("other", "c")], "usr string, path string")
    sources = spark.createDataFrame([(1,), (1,), (3,), (9,), (50,), (None,)], "source int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where all tables are large
    try:
        got = lookups.referenced_symbols(references, symbols, sources)
        assert "SortMergeJoin" not in plan(got) and plan(got).count("ShuffledHashJoin") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    want = {(s, u, p) for s, u in made if s in (1, 3, 9) and u in ("u0", "u1", "u2", "u3") for p in ("a", "b")}
    assert rows(got, "source", "usr", "path") == sorted(want, key=repr)
    assert {tuple(r) for r in lookups.referenced_symbols(references, symbols).select("source", "usr", "path").collect()} == {(s, u, p) for s, u in made if u in ("u0", "u1", "u2", "u3") for p in ("a", "b")}
