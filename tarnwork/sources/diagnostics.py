"""Analyzer output as tables: text, JSON, SARIF and exported fixes, and candidates made of them.

Inputs are tables with one document per row (run, tool_version, text), so a
corpus of runs is parsed by as many tasks as it has rows. Order within a
document is data and is kept in columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.build import lookup
from ..functions.paths import relative_to
from ..functions.ranks import diagnostic_severity
from ..functions.regions import make_region
from ..operators.ranges import last_seen

#: path:line:column: severity: message [rule]
TEXT_LINE = r"^([^:\n]+):(\d+):(\d+):\s+(fatal error|error|warning|note|remark):\s+(.*?)(?:\s+\[(-W[\w+.\-]+)\])?$"

_POSITION = "struct<file:string,line:int,column:int>"
_JSON_ITEM = f"struct<kind:string,message:string,option:string,locations:array<struct<caret:{_POSITION},start:{_POSITION},finish:{_POSITION}>>"
JSON = f"array<{_JSON_ITEM},children:array<{_JSON_ITEM}>>>>"
_LOC = "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int,endLine:int>>,message:struct<text:string>>"
SARIF = (
    "struct<runs:array<struct<tool:struct<driver:struct<rules:array<struct<id:string,name:string>>>>,"
    f"results:array<struct<ruleId:string,ruleIndex:int,level:string,message:struct<text:string>,locations:array<{_LOC}>,relatedLocations:array<{_LOC}>,"
    f"codeFlows:array<struct<threadFlows:array<struct<locations:array<struct<location:{_LOC}>>>>>>>>>>>"
)


def parse_text(documents: DataFrame) -> DataFrame:
    """run, ordinal, path, line, column, severity, message, rule_id, notes of diagnostic text.

    A note belongs to the diagnostic right above it; notes above any are dropped.
    """
    lines = documents.select("run", F.posexplode(F.split("text", "\r?\n")).alias("pos", "raw"))
    part = lambda i: F.regexp_extract("raw", TEXT_LINE, i)
    parsed = lines.where(F.col("raw").rlike(TEXT_LINE)).select("run", "pos", part(1).alias("path"), part(2).cast("int").alias("line"), part(3).cast("int").alias("column"), part(4).alias("word"), part(5).alias("message"), F.nullif(part(6), F.lit("")).alias("rule_id"))
    is_note = F.col("word") == "note"
    order = Window.partitionBy("run").orderBy("pos")
    grouped = parsed.withColumn("ordinal", F.sum((~is_note).cast("int")).over(order)).where("ordinal > 0")
    note = F.when(is_note, F.struct("pos", "path", "line", "column", "message"))
    head = lambda c: F.max(F.when(~is_note, F.col(c))).alias(c)
    return grouped.groupBy("run", "ordinal").agg(head("path"), head("line"), head("column"), diagnostic_severity(F.max(F.when(~is_note, F.col("word")))).alias("severity"), head("message"), head("rule_id"), F.array_sort(F.collect_list(note)).alias("notes"))


def parse_json(documents: DataFrame) -> DataFrame:
    """run, ordinal, path, line, column, severity, message, rule_id, notes of JSON diagnostics, flat or nested arrays; children are notes, top-level notes are dropped."""
    nested = F.from_json("text", f"array<{JSON}>")
    flat = F.from_json("text", JSON)
    is_nested = F.col("text").rlike(r"^\s*\[\s*\[")
    items = documents.select("run", F.posexplode(F.when(is_nested, F.flatten(nested)).otherwise(flat)).alias("ordinal", "d")).where("d.kind <> 'note'")
    caret = lambda d: F.coalesce(F.get(d["locations"], F.lit(0))["caret"], F.get(d["locations"], F.lit(0))["start"])
    own = caret(F.col("d"))
    notes = F.transform(F.coalesce("d.children", F.array()), lambda c, i: F.struct(i.alias("pos"), caret(c)["file"].alias("path"), caret(c)["line"].alias("line"), caret(c)["column"].alias("column"), c["message"].alias("message")))
    return items.select("run", "ordinal", own["file"].alias("path"), own["line"].alias("line"), own["column"].alias("column"), diagnostic_severity(F.col("d.kind")).alias("severity"), F.col("d.message").alias("message"), F.col("d.option").alias("rule_id"), notes.alias("notes"))


def parse_sarif(documents: DataFrame) -> DataFrame:
    """run, ordinal, path, line, end_line, severity, message, rule_id, flow, related of SARIF results; what is cut short has none.

    The rule is the result's id, else that of its index; flow and related keep their order.
    """
    runs = documents.select("run", F.posexplode(F.from_json("text", SARIF)["runs"]).alias("at", "r"))
    results = runs.select("run", "at", F.col("r.tool.driver.rules").alias("rules"), F.posexplode("r.results").alias("ordinal", "x"))
    place = lambda l: F.struct(l["physicalLocation"]["artifactLocation"]["uri"].alias("path"), l["physicalLocation"]["region"]["startLine"].alias("line"), F.coalesce(l["physicalLocation"]["region"]["endLine"], l["physicalLocation"]["region"]["startLine"]).alias("end_line"), l["message"]["text"].alias("message"))  # noqa: E731, E741
    none = F.array().cast("array<struct<path:string,line:int,end_line:int,message:string>>")
    threads = F.flatten(F.transform("x.codeFlows", lambda f: f["threadFlows"]))
    flow = F.transform(F.flatten(F.transform(threads, lambda t: t["locations"])), lambda s: place(s["location"]))
    rule = F.coalesce("x.ruleId", F.get("rules", F.col("x.ruleIndex"))["id"], F.lit(""))
    first = place(F.get("x.locations", F.lit(0)))
    return results.select(
        "run", F.struct("at", "ordinal").alias("ordinal"), first["path"].alias("path"), first["line"].alias("line"), first["end_line"].alias("end_line"), diagnostic_severity(F.coalesce("x.level", F.lit("warning"))).alias("severity"),
        F.col("x.message.text").alias("message"), rule.alias("rule_id"), F.coalesce(flow, none).alias("flow"), F.coalesce(F.transform("x.relatedLocations", place), none).alias("related"),
    )


def parse_fixes(documents: DataFrame) -> DataFrame:
    """run, ordinal, path, offset, severity, message, rule_id, notes, replacements of exported fixes (YAML, places as byte offsets)."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            out = []
            for name, text in zip(batch["run"], batch["text"], strict=True):
                for i, d in enumerate((yaml.safe_load(text or "") or {}).get("Diagnostics") or []):
                    m = d.get("DiagnosticMessage") or d
                    notes = [{"pos": k, "path": n.get("FilePath"), "offset": n.get("FileOffset"), "message": n.get("Message")} for k, n in enumerate(d.get("Notes") or [])]
                    fixes = [{"path": r.get("FilePath"), "offset": r.get("Offset"), "length": r.get("Length"), "text": r.get("ReplacementText")} for r in m.get("Replacements") or []]
                    out.append((name, i, m.get("FilePath"), m.get("FileOffset"), d.get("Level") or "warning", m.get("Message"), d.get("DiagnosticName"), notes, fixes))
            yield pd.DataFrame(out, columns=["run", "ordinal", "path", "offset", "severity", "message", "rule_id", "notes", "replacements"])

    schema = "run string, ordinal int, path string, offset long, severity string, message string, rule_id string, notes array<struct<pos:int,path:string,offset:long,message:string>>, replacements array<struct<path:string,offset:long,length:long,text:string>>"
    parsed = documents.select("run", "text").mapInPandas(run, schema)
    return parsed.withColumn("severity", diagnostic_severity(F.col("severity")))


def offsets_to_lines(diagnostics: DataFrame, files: DataFrame) -> DataFrame:
    """diagnostics with the line of their byte offset; an unknown file gives line 1."""
    return _swept(diagnostics, files).withColumn("line", F.coalesce("seen.line", F.lit(1))).drop("seen")


def in_order(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.orderBy("path", "line", "column", "rule_id", "message")


def detail(severity: Column, steps: Column, notes: Column, has_fix: Column) -> Column:
    """What a candidate's provenance says about its diagnostic."""
    count = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}")))
    return F.concat_ws("; ", F.concat(F.lit("severity "), severity), count(steps, "step(s)"), count(notes, "note(s)"), F.when(has_fix, "fix offered"))


def candidates(diagnostics: DataFrame, files: DataFrame, root: str, producer: str, rules: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """Candidates of diagnostics, and why a diagnostic gives none (drop_reason): outside the tree, or no readable region.

    rules: rule_id, cwes; symbols: ordinal keyed enclosing symbols, if known.
    """
    placed = diagnostics.withColumn("relative", relative_to(F.col("path"), root))
    known = files.select(F.col("path").alias("relative"), "content", "starts")
    joined = placed.join(known, "relative", "left")
    last = F.coalesce("end_line", "line") if "end_line" in diagnostics.columns else F.col("line")
    region = make_region(F.col("relative"), F.col("content"), F.col("starts"), F.col("line"), last)
    found = joined.withColumn("region", region).drop("content", "starts")
    if rules is not None:
        found = found.join(rules.select("rule_id", "cwes"), "rule_id", "left")
    else:
        found = found.withColumn("cwes", F.array().cast("array<string>"))
    cwes = F.coalesce("cwes", F.array().cast("array<string>"))
    first = F.coalesce(F.get(cwes, F.lit(0)), F.lit("CWE-0"))
    symbol = F.col("symbol") if "symbol" in found.columns else F.lit(None).cast("string")
    reason = F.when(F.col("relative").isNull(), "outside_tree").when(F.col("region").isNull(), "unreadable_region")
    return found.select(
        "run", "ordinal", reason.alias("drop_reason"), F.when(reason.isNull(), ids.candidate_id(F.lit(producer), F.col("rule_id"), F.col("relative"), F.col("line"), F.col("message"))).alias("candidate_id"),
        F.when(reason.isNull(), ids.dedup_fingerprint(first, F.col("relative"), symbol, F.col("message"))).alias("fingerprint"), "region", "message", "rule_id", cwes.alias("cwes"), symbol.alias("symbol"),
    )


def added_lines(diffs: DataFrame) -> DataFrame:
    """pair_id, line: lines of the earlier side that a --unified=0 diff guards: each added line at a running place, or the one after an insertion."""
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    lines = diffs.select("pair_id", F.posexplode(F.split("diff", "\r?\n")).alias("pos", "raw"))
    is_hunk = F.col("raw").rlike(hunk)
    start, count = F.regexp_extract("raw", hunk, 1).try_cast("int"), F.coalesce(F.regexp_extract("raw", hunk, 2).try_cast("int"), F.lit(1))
    marked = lines.select("pair_id", "pos", "raw", is_hunk.alias("h"), F.when(is_hunk, start).alias("start"), F.when(is_hunk, count).alias("n"))
    w = Window.partitionBy("pair_id").orderBy("pos")
    carried = marked.withColumn("block", F.sum(F.col("h").cast("int")).over(w)).withColumn("at", F.last("start", ignorenulls=True).over(w)).withColumn("size", F.last("n", ignorenulls=True).over(w))
    added = ~F.col("h") & F.col("raw").startswith("+") & ~F.col("raw").startswith("+++")
    inner = Window.partitionBy("pair_id", "block").orderBy("pos")
    counted = carried.withColumn("k", F.sum(added.cast("int")).over(inner))
    line = F.when(F.col("h") & (F.col("size") == 0), F.col("at") + 1).when(added & (F.col("size") > 0), F.col("at") + F.col("k") - 1)
    return counted.select("pair_id", line.alias("line")).where("line is not null").distinct()


def checker_names(output: Column, prefix: str = r"^\s{2,}([A-Za-z]\w*(?:\.\w+)+)") -> Column:
    """Names of a tool's checker list; null (the probe failed) differs from none."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(output, F.lit(f"(?m){prefix}"), F.lit(1))))


def severity_words(mapping: dict[str, str], word: Column) -> Column:
    return F.coalesce(lookup(mapping, F.lower(word)), F.lit("warning"))


def _swept(points: DataFrame, files: DataFrame) -> DataFrame:
    """points (path, offset and others) with seen: the number and offset of the last line start up to each.

    Line starts and points are swept together in ranges of (path, offset), so
    neither a file's starts nor its points ever meet in one row.
    """
    kinds = {c: t for c, t in points.dtypes if c not in ("path", "offset")}
    none = [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    starts = files.select("path", F.posexplode("starts").alias("__n", "offset")).select("path", F.col("offset").cast("long").alias("offset"), F.lit(0).alias("__kind"), (F.col("__n") + 1).alias("__line"), *none)
    asked = points.select("path", F.col("offset").cast("long").alias("offset"), F.lit(1).alias("__kind"), F.lit(None).cast("int").alias("__line"), *kinds)
    start = F.when(F.col("__kind") == 0, F.struct(F.col("__line").alias("line"), F.col("offset").alias("start")))
    return last_seen(starts.unionByName(asked), ["path"], ["offset", "__kind"], start).where("__kind = 1").drop("__kind", "__line")


def at_lines(points: DataFrame, files: DataFrame) -> DataFrame:
    """points (path, offset in bytes and others) with line and column (in bytes), both from 1; null outside of the file or without it.

    files: path, size, starts.
    """
    size = files.select("path", F.col("size").cast("long").alias("__size"))
    found = _swept(points, files).join(size, "path", "left")
    inside = (F.col("offset") >= 0) & (F.col("offset") <= F.col("__size"))
    return found.withColumns({"line": F.when(inside, F.col("seen.line")), "column": F.when(inside, F.col("offset") - F.col("seen.start") + 1)}).drop("seen", "__size")


def placed_fixes(fixes: DataFrame, files: DataFrame) -> DataFrame:
    """Exported fixes (as of parse_fixes) with line and column of each diagnostic, note and replacement.

    run, ordinal, path, line, column, severity, message, rule_id, notes (pos,
    path, line, column, message), replacements (pos, path, line, column,
    end_line, end_column, length, text): a replacement ends after its length.
    """
    key = ["run", "ordinal"]
    point = lambda kind, pos, path, offset: [*key, F.lit(kind).alias("kind"), pos.alias("pos"), path.alias("path"), offset.alias("offset")]
    notes = fixes.select(*key, F.explode("notes").alias("n"))
    changes = fixes.select(*key, F.posexplode("replacements").alias("pos", "r"))
    end = F.col("r.offset") + F.col("r.length")
    points = fixes.select(*point("own", F.lit(0), F.col("path"), F.col("offset"))).unionByName(notes.select(*point("note", F.col("n.pos"), F.col("n.path"), F.col("n.offset"))))
    points = points.unionByName(changes.select(*point("from", F.col("pos"), F.col("r.path"), F.col("r.offset")))).unionByName(changes.select(*point("to", F.col("pos"), F.col("r.path"), end)))
    at = F.struct("kind", "pos", "line", "column")
    met = at_lines(points, files).groupBy(*key).agg(F.collect_list(at).alias("places"))
    joined = fixes.join(met, key)
    of = lambda kind, pos: F.get(F.filter("places", lambda p: (p["kind"] == kind) & (p["pos"] == pos)), F.lit(0))
    fields = lambda **c: F.struct(*[v.alias(n) for n, v in c.items()])
    note = F.transform("notes", lambda n: fields(pos=n["pos"], path=n["path"], line=of("note", n["pos"])["line"], column=of("note", n["pos"])["column"], message=n["message"]))
    change = F.transform("replacements", lambda r, i: fields(pos=i, path=r["path"], line=of("from", i)["line"], column=of("from", i)["column"], end_line=of("to", i)["line"], end_column=of("to", i)["column"], length=r["length"], text=r["text"]))
    return joined.select(*key, "path", of("own", F.lit(0))["line"].alias("line"), of("own", F.lit(0))["column"].alias("column"), "severity", "message", "rule_id", note.alias("notes"), change.alias("replacements"))
