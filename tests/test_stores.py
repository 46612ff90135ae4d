"""The commit log, the table store, journals, traces and accounts: two writers, runs cut short, replays."""

from __future__ import annotations

import random
import threading
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import accounts
from tarnwork.sinks.commits import Commits, Conflict
from tarnwork.sinks.journal import Journal, identity_of
from tarnwork.sinks.store import StoreError, TableStore
from tarnwork.streaming import trace

from .conftest import rows


def test_commits_are_numbered_once(spark, tmp_path):
    log = Commits(spark, str(tmp_path / "log"))
    assert log.head() == 0 and log.append({"a": 1}) == 1 and log.read(1) == {"a": 1}
    with pytest.raises(Conflict):
        log.put(1, {"a": 2})
    got, made = [], [threading.Thread(target=lambda k=k: got.append(Commits(spark, str(tmp_path / "log")).append({"k": k}))) for k in range(8)]
    for x in made:
        x.start()
    for x in made:
        x.join()
    assert sorted(got) == list(range(2, 10)) and {log.read(n)["k"] for n in got} == set(range(8))
    assert not list((tmp_path / "log").glob("*.part"))


def facts(spark, units, seen=None):
    """Current units and a parser that says which units it was given."""

    def parse(changed):
        given = rows(changed, "unit")
        if seen is not None:
            seen.append({u for (u,) in given})
        return {"lines": changed.select("unit", F.explode(F.split("input_hash", " ")).alias("line")), "sizes": changed.select(F.length("input_hash").alias("n"), "unit")}

    return spark.createDataFrame(list(units.items()), "unit string, input_hash string"), parse


def lines(store, version=None):
    return rows(store.tables(version)["lines"], "unit", "line", "since")


def test_store_rewrites_what_changed(spark, tmp_path):
    store, seen = TableStore(spark, str(tmp_path / "s"), "2"), []
    assert store.tables() == {} and store.manifest()["version"] == 0
    assert store.refresh(*facts(spark, {"a": "1 2", "b": "3", "c": "4"}, seen)) == (1, 3, 0, 0)
    assert store.refresh(*facts(spark, {"a": "1 2", "b": "9 8", "d": "5"}, seen)) == (2, 2, 1, 1)
    assert seen == [{"a", "b", "c"}, {"b", "d"}]
    assert lines(store) == [("a", "1", 1), ("a", "2", 1), ("b", "8", 2), ("b", "9", 2), ("d", "5", 2)]
    assert lines(store, 1) == [("a", "1", 1), ("a", "2", 1), ("b", "3", 1), ("c", "4", 1)]
    assert rows(store.tables()["sizes"]) == [(1, "d", 2), (3, "a", 1), (3, "b", 2)]
    assert store.refresh(*facts(spark, {"a": "1 2", "b": "9 8", "d": "5"}, seen)) == (3, 0, 3, 0) and seen[-1] == set()
    assert store.refresh(*facts(spark, {}, seen)) == (4, 0, 0, 3) and lines(store) == []


def test_store_of_many_parts_is_written_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tarnwork.sinks.store.MOST_PARTS", 2)
    store = TableStore(spark, str(tmp_path / "s"), "2")
    for i in range(4):
        store.refresh(*facts(spark, {"a": "x", "b": f"{i} y", f"n{i // 2}": str(i)}))
    assert len(store.manifest()["parts"]) == 2
    assert [(u, x) for u, x, _ in lines(store)] == [("a", "x"), ("b", "3"), ("b", "y"), ("n1", "3")]


def test_store_refuses_other_formats_and_twice_given_units(spark, tmp_path):
    TableStore(spark, str(tmp_path / "s"), "1").refresh(*facts(spark, {"a": "1"}))
    newer = TableStore(spark, str(tmp_path / "s"), "2")
    with pytest.raises(StoreError, match="has format '1', this reads '2'"):
        newer.tables()
    with pytest.raises(StoreError, match="has format"):
        newer.refresh(*facts(spark, {"a": "1"}))
    with pytest.raises(StoreError, match="no version 7"):
        newer.manifest(7)
    current, parse = facts(spark, {"a": "1"})
    with pytest.raises(StoreError, match="twice"):
        TableStore(spark, str(tmp_path / "t"), "1").refresh(current.union(current), parse)


def test_two_writers_leave_one_valid_snapshot(spark, tmp_path):
    at_once, failed = threading.Barrier(2), []

    def write(units):
        current, parse = facts(spark, units)
        first = [True]

        def wait(changed):
            if first.pop() if first else False:
                at_once.wait(60)
            return parse(changed)

        try:
            TableStore(spark, str(tmp_path / "s"), "2").refresh(current, wait)
        except Exception as e:  # told to the test
            failed.append(e)

    both = [{"a": "1", "b": "2"}, {"a": "1", "c": "3"}]
    made = [threading.Thread(target=write, args=(u,)) for u in both]
    for x in made:
        x.start()
    for x in made:
        x.join()
    store = TableStore(spark, str(tmp_path / "s"), "2")
    assert not failed and store.commits.numbers() == [1, 2]
    of = lambda v: {(u, x) for u, x, _ in lines(store, v)}
    assert sorted([of(1), of(2)], key=str) == sorted([set(u.items()) for u in both], key=str)
    assert {s for u, _, s in lines(store, 2) if u == "a"} == {1}


def test_a_writer_that_always_loses_gives_up(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"), "2")
    current, parse = facts(spark, {"a": "1"})

    def lose(changed):
        store.commits.append({"version": store.commits.head() + 1, "format": "2", "parts": {}, "tables": {}, "units": None})
        return parse(changed)

    with pytest.raises(Conflict):
        store.refresh(current, lose, retries=1)


def test_a_stage_goes_on_where_it_was_cut(spark, tmp_path):
    work = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "id long, text string")
    asked, left = spark.sparkContext.accumulator(0), [2]
    schema = "id long, answer string"

    def compute(batch):
        if not left:
            raise RuntimeError("cut")
        left.pop()
        asked.add(batch.count())
        return batch.select("id", F.upper("text").alias("answer"))

    me = identity_of(work, model="m1")
    assert me == identity_of(work.orderBy(F.desc("id")).repartition(7), model="m1") != identity_of(work, model="m2") and me != identity_of(work.where("id <> 5"), model="m1")
    with pytest.raises(RuntimeError, match="cut"):
        Journal(spark, str(tmp_path / "j"), me).run(work, "id", compute, schema, 5)
    half = Journal(spark, str(tmp_path / "j"), me).done(schema).count()
    assert 0 < half < 100 and half == asked.value
    left.extend([1] * 50)
    with pytest.raises(ValueError, match="belongs to identity"):
        Journal(spark, str(tmp_path / "j"), identity_of(work, model="m2"))
    got = Journal(spark, str(tmp_path / "j"), me).run(work, "id", compute, schema, 5)
    assert rows(got) == sorted([(i, f"T{i}") for i in range(100)], key=repr) and asked.value == 100
    assert rows(Journal(spark, str(tmp_path / "j"), me).run(work, "id", compute, schema, 3)) == rows(got) and asked.value == 100


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    folder, source = str(tmp_path / "t"), tmp_path / "in"
    for i in range(3):
        spark.createDataFrame([(f"r{i}", n) for n in range(5)], "run_id string, n long").coalesce(1).write.mode("append").parquet(str(source))
        read = spark.readStream.schema("run_id string, n long").parquet(str(source))
        trace.write_trace(read, folder, str(tmp_path / "c"), once=True).awaitTermination()
    want = sorted(((f"r{i}", n, i) for i in range(3) for n in range(5)), key=repr)
    assert rows(trace.read_committed(spark, folder), "run_id", "n", "batch") == want
    assert not trace.append_batch(spark.createDataFrame([("other", 1)], "run_id string, n long"), 1, folder)
    assert rows(trace.read_committed(spark, folder), "run_id", "n", "batch") == want
    # a job that died before its commit left files that do not count
    spark.createDataFrame([("dead", 1)], "run_id string, n long").write.parquet(f"{folder}/events/dead")
    assert rows(trace.read_committed(spark, folder), "run_id", "n", "batch") == want


@pytest.mark.parametrize("per_batch", [1, 100])
def test_runs_do_not_depend_on_how_a_stream_is_cut(spark, tmp_path, per_batch):
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    made = [("a", "open", 0), ("b", "open", 5), ("a", "step", 10), ("a", "run_closed", 20), ("b", "step", 30), ("c", "run_closed", 40), ("c", "open", 35), ("d", "open", 400), ("e", "open", 600)]
    for i in range(0, len(made), 3):
        spark.createDataFrame([(r, e, at(m)) for r, e, m in made[i : i + 3]], "run_id string, event string, at string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema("run_id string, event string, at string").option("maxFilesPerTrigger", per_batch).parquet(str(tmp_path / "in")).withColumn("at", F.to_timestamp("at"))
    trace.write_trace(trace.runs(read), str(tmp_path / "t"), str(tmp_path / "c"), once=True).awaitTermination()
    got = trace.read_committed(spark, str(tmp_path / "t"))
    assert rows(got.select("run_id", F.minute("closed"), "events", "outcome")) == sorted([("a", 20, 3, "closed"), ("b", None, 2, "abandoned"), ("c", 40, 2, "closed"), ("d", None, 1, "abandoned")], key=repr)


def fold(events, limits):
    """The account of events one after another."""
    requests = quota = tokens = 0
    cost, stopped, refused, out, tiers = Decimal(0), None, set(), [], {}
    for e in sorted(events, key=lambda e: e["place"]):
        t = tiers.setdefault(e["tier"], [0, 0, 0, 0, 0, Decimal(0)])
        if e["kind"] == "reserve":
            if stopped is None:
                want = max(0, e["tokens"])
                checks = [("cost_ceiling", limits.cost is not None and cost >= Decimal(limits.cost)), ("token_ceiling", limits.tokens_per_run is not None and tokens >= limits.tokens_per_run), ("quota_requests", limits.requests is not None and requests >= limits.requests), ("quota_tokens", limits.quota_tokens is not None and quota + want > limits.quota_tokens)]
                stopped = next(((n, e["place"]) for n, hit in checks if hit), None)
            if stopped:
                refused.add(e["call_id"])
                t[3] += 1
            else:
                out.append((e["place"], quota, requests, tokens))
                requests, quota = requests + 1, quota + max(0, e["tokens"])
        elif e["call_id"] not in refused:
            if e["cached"]:
                t[1] += 1
                continue
            quota = quota + e["tokens"] if e["reserved"] is None else max(0, quota - e["reserved"]) + e["tokens"]
            tokens, cost = tokens + e["tokens"], cost + e["cost"]
            t[0], t[2], t[4], t[5] = t[0] + 1, t[2] + (e["tokens"] == 0), t[4] + e["tokens"], t[5] + e["cost"]
    return out, {k: tuple(v) for k, v in tiers.items()}, (requests, quota, tokens, cost, *(stopped or (None, None)))


EVENT = "place long, call_id long, tier string, kind string, tokens long, since long, reserved long, cached boolean, cost decimal(28,9)"


@pytest.mark.parametrize("limits", [accounts.Limits(), accounts.Limits(quota_tokens=3_000), accounts.Limits(requests=120), accounts.Limits(tokens_per_run=20_000, requests=900), accounts.Limits(cost="2.5", quota_tokens=10**6), accounts.Limits(requests=0)])
def test_accounts_equal_a_fold(spark, limits):
    rng, events, n = random.Random(str(limits)), [], 500
    for i in range(n):
        r, u, place = rng.randint(-5, 300), rng.choice([0, rng.randint(1, 900)]), 10 * i
        tier = rng.choice("abc")
        if rng.random() < 0.1:
            events.append((place, i, tier, "charge", u, None, None, rng.random() < 0.5, Decimal("0.01")))
            continue
        events.append((place, i, tier, "reserve", r, None, None, False, Decimal(0)))
        if rng.random() < 0.9:
            events.append((place + 10 * rng.randint(0, 30) + 1 + rng.randint(0, 8), i, tier, "charge", u, place, max(0, r), rng.random() < 0.05, Decimal(rng.randint(0, 10**8)) / 10**9))
    events = list({e[0]: e for e in events}.values())
    got = accounts.settle(spark.createDataFrame(events, EVENT).repartition(5), limits)
    calls, tiers, run = fold([dict(zip([c.split()[0] for c in EVENT.split(", ")], e, strict=True)) for e in events], limits)
    assert rows(got.events.where("kind = 'reserve' and accepted"), "place", "quota_before", "requests_before", "tokens_before") == sorted(calls, key=repr)
    assert {r.tier: (r.calls, r.cached, r.unreported, r.refused, r.tokens, r.cost) for r in got.tiers.collect()} == tiers
    assert tuple(got.run.first()) == run


def test_accounts_of_no_calls(spark):
    got = accounts.settle(spark.createDataFrame([], EVENT), accounts.Limits(requests=1))
    assert got.events.count() == got.tiers.count() == 0 and tuple(got.run.first())[:4] == (0, 0, 0, 0)


def test_accounts_of_a_million_events(spark):
    """The window before each of a million events against a fold over them."""
    n = 500_000
    made = spark.range(n).select(F.col("id").alias("i"), (100 + F.col("id") * 37 % 400).alias("r"), (F.col("id") * 53 % 450).alias("u"))
    base = [F.lit("t").alias("tier")]
    reserve = made.select((F.col("i") * 10).alias("place"), F.col("i").alias("call_id"), *base, F.lit("reserve").alias("kind"), F.col("r").alias("tokens"), F.lit(None).cast("long").alias("since"), F.lit(None).cast("long").alias("reserved"))
    charge = made.where("i % 3 <> 0").select((F.col("i") * 10 + 71).alias("place"), F.col("i").alias("call_id"), *base, F.lit("charge").alias("kind"), F.col("u").alias("tokens"), (F.col("i") * 10).alias("since"), F.col("r").alias("reserved"))
    events = reserve.unionByName(charge).withColumns({"cached": F.lit(False), "cost": F.lit(0).cast("decimal(28,9)")})
    got = accounts.settle(events, accounts.Limits()).events.agg(F.sum(F.col("quota_before").cast("decimal(38,0)")), F.max("quota_before"), F.count(F.lit(1))).first()
    order = sorted([(10 * i, 100 + i * 37 % 400, None) for i in range(n)] + [(10 * i + 71, i * 53 % 450, 100 + i * 37 % 400) for i in range(n) if i % 3])
    quota = total = most = 0
    for _, tokens, reserved in order:
        total, most = total + quota, max(most, quota)
        quota = quota + tokens if reserved is None else max(0, quota - reserved) + tokens
    assert tuple(got) == (total, most, len(order))
