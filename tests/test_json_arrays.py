from __future__ import annotations

import json
import random

import pytest

from tarnwork.sources import builds, json_arrays


@pytest.fixture
def small_ranges(spark):
    """Ranges of so many bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def value(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 4 else 3)
    if kind == 0:
        return rng.choice([None, True, -1.5e3, 17])
    if kind < 4:
        return "".join(rng.choices('ab{}[]",\\\n\té\U0001f600 }{"', k=rng.randint(0, 12)))
    if kind < 6:
        return {f"k{rng.choice('}{ab')}{i}": value(rng, depth + 1) for i in range(rng.randint(0, 4))}
    return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]


@pytest.mark.parametrize(("size", "indent", "ascii_only"), [(120, None, True), (3_000, 1, False), (10_000_000, None, False)])
def test_elements_by_brute_force(spark, tmp_path, small_ranges, size, indent, ascii_only):
    rng, want = random.Random(size), {}
    for name in "abc":
        made = [value(rng) for _ in range({120: 40, 3_000: 600, 10_000_000: 2000}[size])]
        (tmp_path / f"{name}.json").write_text("\n " * (name == "a") + json.dumps(made, indent=indent, ensure_ascii=ascii_only) + "\n" * (name == "b"))
        want |= {(name, i): v for i, v in enumerate(made)}
    small_ranges(size)
    got = [((r.path[-6], r.ordinal), json.loads(r.text)) for r in json_arrays.elements(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and dict(got) == want


@pytest.mark.parametrize("text", ["", " [1, 2", '[1, "a}', '["a\\"]', "[1]]", "[1] 2", "x[1]", "[1][2]", '"a" [1]', "[1}", "{}", '{"a": [1]}', '"[1]"', "[[1]", '[{"a": 1}', "3", "]", "}"])
def test_documents_that_are_no_array(spark, tmp_path, small_ranges, text):
    (tmp_path / "c.json").write_text(text)
    small_ranges(4)
    with pytest.raises(json_arrays.NotAnArray):
        json_arrays.elements(spark, str(tmp_path / "c.json"))


ENTRY = {"directory": "/r", "file": "a.c", "command": "cc -c a.c"}
BAD = [
    ("\n \n", "empty"), ("[{", "not JSON"), ('[{"directory": "/r"', "not JSON"), ("[1,]", "entry 1 is empty"), ("{}", "this is an object"), ('"x"', "this is a string"), ("3", "this is a single value"), ("x", "not JSON"), (" [ ]\n", "no entries"),
    (json.dumps([ENTRY, 1]), "entry 1 is not an object"), ('[{"a" 1}]', "entry 0 is not JSON"), (json.dumps([ENTRY, {**ENTRY, "file": " "}]), "entry 1 has no file"), (json.dumps([ENTRY] * 3 + [{"file": "a"}]), "entry 3 has no directory"),
    (json.dumps([{**ENTRY, "directory": "r"}]), "relative directory"), (json.dumps([{**ENTRY, "arguments": "cc"}]), "no list of strings"), (json.dumps([{**ENTRY, "arguments": ["cc", 1]}]), "no list of strings"), (json.dumps([{**ENTRY, "arguments": []}]), "empty list"),
    (json.dumps([{"directory": "/r", "file": "a"}]), "neither"), (json.dumps([{**ENTRY, "command": "  "}]), "neither"),
]


@pytest.mark.parametrize(("content", "message"), BAD)
def test_bad_databases_say_why(spark, tmp_path, content, message):
    (tmp_path / "c.json").write_text(content)
    with pytest.raises(builds.IntakeError, match=message):
        builds.load_entries(spark, str(tmp_path / "c.json"))


def test_absent_database(spark, tmp_path):
    with pytest.raises(builds.IntakeError, match="there is no compilation database"):
        builds.load_entries(spark, str(tmp_path / "c.json"))


def test_the_first_problem_is_named(spark, tmp_path, small_ranges):
    small_ranges(500)
    made = [ENTRY | {"file": f"s/{i}.c"} for i in range(300)]
    made[200], made[90] = 5, {**ENTRY, "file": 4}
    (tmp_path / "c.json").write_text(json.dumps(made))
    with pytest.raises(builds.IntakeError, match="entry 90 has no file"):
        builds.load_entries(spark, str(tmp_path / "c.json"))
    made[200] = made[90] = ENTRY
    (tmp_path / "c.json").write_text(json.dumps(made))
    got = builds.load_entries(spark, str(tmp_path / "c.json"))
    assert [r.file for r in got.orderBy("ordinal").collect()] == [m["file"] for m in made]
