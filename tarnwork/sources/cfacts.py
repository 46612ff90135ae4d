"""Facts of C and C++ sources, read without a compiler: symbols, calls, macros, includes and references.

A unit is lexed and its scopes are walked once, without recursion. Nothing is
type-checked: a call is resolved by name, and one through a pointer or member
keeps a null callee and a limitation, so no answer over the graph looks
complete that is not. A unit that cannot be read gives a row that says so.
Units are independent (``mapInPandas``); a unit's facts are bounded by its
text.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACT = "unit string, kind string, usr string, other string, name string, qualified string, detail string, path string, start_line int, end_line int, start_byte long, end_byte long, flag boolean"
COLUMNS = [c.split()[0] for c in FACT.split(", ")]

# Fixed values of the languages.
KEYWORDS = frozenset(
    "alignas alignof and asm auto bool break case catch char class const constexpr const_cast continue decltype default delete do double dynamic_cast else enum explicit extern "
    "float for friend goto if inline int long mutable namespace new noexcept nullptr operator override private protected public register reinterpret_cast restrict return short "
    "signed sizeof static static_assert static_cast struct switch template this throw try typedef typeid typename union unsigned using virtual void volatile while _Static_assert _Generic".split()
)
TOKEN = re.compile(r"[A-Za-z_]\w*+|\d[\w.]*+|::|->|\.\.\.|[{}()\[\];,=*&:<>~.#?!+\-/%|^]")
DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w+)[ \t]*(.*)$")


class Token(NamedTuple):
    text: str
    at: int


def blanked(source: str) -> str:
    """source with comments and the contents of literals blanked, every other character in its place; one pass."""
    out, at, n = [], 0, len(source)
    stops = re.compile(r"//|/\*|\"|'")
    while at < n:
        m = stops.search(source, at)
        if not m:
            out.append(source[at:])
            break
        out.append(source[at : m.start()])
        start, mark = m.start(), m[0]
        if mark == "//":
            end = source.find("\n", start)
            end = n if end < 0 else end
        elif mark == "/*":
            end = source.find("*/", start + 2)
            end = n if end < 0 else end + 2
        else:
            end = start + 1
            while end < n and source[end] != mark and source[end] != "\n":
                end += 2 if source[end] == "\\" else 1
            end = min(end + 1, n)
        body = re.sub(r"[^\n]", " ", source[start:end])
        out.append(mark + body[1:-1] + mark if mark in "\"'" and len(body) > 1 else body)
        at = end
    return "".join(out)


class Collector:
    """The facts of one unit."""

    def __init__(self, unit: str, source: str, tree: Sequence[str] = ()) -> None:
        self.unit, self.source, self.tree = unit, source, frozenset(tree)
        self.rows: list[tuple] = []
        self.clean = blanked(source)
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        # byte offset of each character
        self.bytes = None if source.isascii() else [0, *itertools.accumulate(len(c.encode("utf-8", "replace")) for c in source)]
        self.macros: dict[str, tuple[int, int]] = {}
        self.functions: dict[str, str] = {}
        self.types: dict[str, str] = {}
        self.globals: dict[str, str] = {}
        self.calls: list[tuple[str, str, str, int, int]] = []
        self.uses: list[tuple[str, str, int]] = []

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at)

    def add(self, kind: str, usr: str | None, other: str | None = None, name: str | None = None, qualified: str | None = None, detail: str | None = None, start: int = 0, end: int = 0, flag: bool | None = None) -> None:
        end = max(start, end)
        first, last = (start, end) if self.bytes is None else (self.bytes[start], self.bytes[end])
        self.rows.append((self.unit, kind, usr, other, name, qualified, detail, self.unit, self.line(start), self.line(max(start, end - 1)), first, last, flag))

    def collect(self) -> list[tuple]:
        """Inputs and directives, then scopes, then what needs all names: calls, references and expansions."""
        self.record_inputs()
        self.walk()
        self.resolve()
        return self.rows

    def record_inputs(self) -> None:
        """The unit itself, its includes (null outside the tree) and its macros; directives are blanked."""
        self.add("input", None, detail=hashlib.sha256(self.source.encode("utf-8", "replace")).hexdigest(), end=len(self.source))
        at, kept = 0, []
        lines = self.clean.split("\n")
        i = 0
        while i < len(lines):
            first, start = i, at
            text = lines[i]
            at += len(text) + 1
            if text.lstrip().startswith("#"):
                while lines[i].endswith("\\") and i + 1 < len(lines):
                    i += 1
                    at += len(lines[i]) + 1
                self.directive(self.source[start : at - 1], start, at - 1)
                kept += [" " * len(x) for x in lines[first : i + 1]]
            else:
                kept.append(text)
            i += 1
        self.clean = "\n".join(kept)

    def directive(self, text: str, start: int, end: int) -> None:
        m = DIRECTIVE.match(text.split("\n", 1)[0])
        if not m:
            return
        if m[1] == "include" and (q := re.match(r"[\"<]([^\">]+)[\">]", m[2])):
            folder = self.unit.rsplit("/", 1)[0] + "/" if "/" in self.unit else ""
            near = [p for p in (folder + q[1], q[1]) if p in self.tree]
            self.add("include", None, near[0] if near else None, name=q[1], start=start, end=end)
        elif m[1] == "define" and (d := re.match(r"([A-Za-z_]\w*)", m[2])):
            self.macros[d[1]] = (start, end)
            self.add("macro", f"c:{self.unit}@macro@{d[1]}", name=d[1], start=start, end=end)

    def walk(self) -> None:
        """Scopes by their braces: what stands before an opening one says what it opens."""
        tokens = [Token(m[0], m.start()) for m in TOKEN.finditer(self.clean)]
        head: list[int] = []
        # open scopes: kind (namespace, type, function, block), name, usr, start
        stack: list[tuple[str, str, str | None, int]] = []
        # those of them that name something, and the outermost function
        named: list[tuple[str, str, str | None, int]] = []
        inside, depth = None, 0
        for i, t in enumerate(tokens):
            if t.text == "{":
                start = tokens[head[0]].at if head else t.at
                kind, name = ("block", "") if inside else self.opened([tokens[k].text for k in head])
                stack.append(self.visit(kind, name, [tokens[k].text for k in head], named, start))
                if kind == "function":
                    inside, depth = stack[-1], len(stack)
                elif kind != "block" and name:
                    named.append(stack[-1])
                head = []
            elif t.text == "}":
                if stack:
                    kind, name, usr, start = opened = stack.pop()
                    if named and named[-1] is opened:
                        named.pop()
                    if inside and len(stack) < depth:
                        inside = None
                    if kind in ("function", "type") and usr:
                        scope = "::".join([s[1] for s in named] + [name])
                        self.add("symbol", usr, name=name.rsplit("::", 1)[-1], qualified=scope, detail=kind if kind != "function" else self.kind_of(named, name), start=start, end=t.at + 1, flag=True)
                head = []
            elif t.text == ";":
                if not inside:
                    self.declared([tokens[k] for k in head], named, t.at + 1)
                head = []
            elif t.text == ":" and head and tokens[head[-1]].text in ("public", "private", "protected"):
                head = []
            else:
                if inside:
                    self.use(tokens, i, inside[2] or "")
                head.append(i)
        for kind, name, usr, start in stack:
            if kind in ("function", "type") and usr:
                self.add("limitation", usr, name="parse_failed", detail=f"{name} is not closed", start=start, end=start)

    def opened(self, head: list[str]) -> tuple[str, str]:
        """What a brace opens at file, namespace or class scope."""
        if "namespace" in head:
            return "namespace", "::".join(x for x in head[head.index("namespace") + 1 :] if x not in ("::", "inline"))
        if "(" in head and head[0] != "=":
            at = head.index("(")
            if at and re.match(r"[A-Za-z_]", head[at - 1]) and head[at - 1] not in KEYWORDS and "=" not in head[:at]:
                name = head[at - 1]
                if at > 1 and head[at - 2] == "~":
                    name, at = "~" + name, at - 1
                while at > 2 and head[at - 2] == "::":
                    name, at = f"{head[at - 3]}::{name}", at - 2
                return "function", name
        for word in ("class", "struct", "union", "enum"):
            if word in head:
                names = [x for x in head[head.index(word) + 1 :] if re.match(r"[A-Za-z_]", x) and x not in KEYWORDS]
                return "type", names[0] if names else ""
        return "block", ""

    def kind_of(self, stack: list, name: str) -> str:
        owner = next((s[1] for s in reversed(stack) if s[0] == "type"), name.rsplit("::", 2)[-2] if "::" in name else None)
        last = name.rsplit("::", 1)[-1]
        if owner is None:
            return "function"
        return "destructor" if last.startswith("~") else "constructor" if last == owner else "method"

    def visit(self, kind: str, name: str, head: list[str], stack: list, start: int) -> tuple[str, str, str | None, int]:
        """A scope and its id; classes say what they derive from."""
        if kind == "block":
            return kind, name, None, start
        scope = "".join(f"@{s[1]}" for s in stack)
        if kind == "function":
            own = f":{self.unit}" if "static" in head and not scope else ":"
            usr = f"c{own}{scope}@F@{name.replace('::', '@')}"
            self.functions[name.rsplit("::", 1)[-1]] = usr
            if "virtual" in head or "override" in head:
                self.add("virtual", usr, name=name.rsplit("::", 1)[-1], detail=next((s[2] for s in reversed(stack) if s[0] == "type"), None), start=start, end=start)
            for word in head:
                self.uses.append((usr, word, start))
            return kind, name, usr, start
        if kind == "type":
            usr = f"c:{scope}@S@{name}" if name else None
            if usr:
                self.types[name] = usr
                if ":" in head:
                    for base in (x for x in head[head.index(":") + 1 :] if re.match(r"[A-Za-z_]", x) and x not in KEYWORDS):
                        self.add("derived", usr, name=base, start=start, end=start)
            return kind, name, usr, start
        return kind, name, None, start

    def declared(self, head: list[Token], stack: list, end: int) -> None:
        """A declaration at file, namespace or class scope: a prototype, a type name or a variable."""
        words = [t.text for t in head]
        names = [w for w in words if re.match(r"[A-Za-z_]", w) and w not in KEYWORDS]
        if not names or words[0] in ("using", "friend", "public", "private", "protected", "return"):
            return
        scope = "".join(f"@{s[1]}" for s in stack)
        start = head[0].at
        if words[0] == "typedef":
            usr = f"c:{scope}@T@{names[-1]}"
            self.types[names[-1]] = usr
            self.add("symbol", usr, name=names[-1], qualified=names[-1], detail="typedef", start=start, end=end, flag=True)
        elif "(" in words and "=" not in words[: words.index("(")]:
            at = words.index("(")
            if at and words[at - 1] in names:
                own = f":{self.unit}" if words[0] == "static" and not scope else ":"
                usr = f"c{own}{scope}@F@{words[at - 1]}"
                self.functions.setdefault(words[at - 1], usr)
                self.add("symbol", usr, name=words[at - 1], qualified=words[at - 1], detail=self.kind_of(stack, words[at - 1]), start=start, end=end, flag=False)
                if "virtual" in words or "override" in words:
                    self.add("virtual", usr, name=words[at - 1], detail=next((s[2] for s in reversed(stack) if s[0] == "type"), None), start=start, end=start)
        elif not any(s[0] == "type" for s in stack):
            stop = words.index("=") if "=" in words else words.index("[") if "[" in words else len(words)
            own = [w for w in words[:stop] if w in names]
            if len(own) + sum(w in KEYWORDS for w in words[:stop]) > 1 and own:
                usr = f"c:{self.unit}{scope}@{own[-1]}" if words[0] == "static" else f"c:{scope}@{own[-1]}"
                self.globals[own[-1]] = usr
                self.add("symbol", usr, name=own[-1], qualified=own[-1], detail="variable", start=start, end=end, flag="extern" not in words)

    def use(self, tokens: list[Token], i: int, caller: str) -> None:
        """A name inside a function: a call where a bracket follows, a reference otherwise."""
        t = tokens[i]
        following = tokens[i + 1].text if i + 1 < len(tokens) else ""
        before = tokens[i - 1].text if i else ""
        if re.match(r"[A-Za-z_]", t.text) and t.text not in KEYWORDS:
            if following == "(":
                self.calls.append((caller, t.text, "member" if before in (".", "->") else "direct", t.at, t.at + len(t.text)))
            else:
                self.uses.append((caller, t.text, t.at))
        elif t.text == "(" and before == ")" and i > 2 and tokens[i - 2].text not in KEYWORDS:
            back = i - 2
            while back > 0 and tokens[back].text not in ("(", ";", "{", "}"):
                back -= 1
            if back + 1 < len(tokens) and tokens[back].text == "(" and tokens[back + 1].text == "*":
                self.calls.append((caller, "", "pointer", tokens[back].at, t.at))

    def resolve(self) -> None:
        """Calls by name, expansions of the unit's macros, and references to its types and variables."""
        for caller, name, kind, start, end in self.calls:
            if name in self.macros:
                self.add("expansion", f"c:{self.unit}@macro@{name}", caller, name=name, start=start, end=end)
                continue
            callee = self.functions.get(name) or (f"c:@F@{name}" if kind == "direct" and name not in self.globals else None)
            if kind == "pointer" or callee is None:
                self.add("call", caller, None, name=name or None, detail="function_pointer", start=start, end=end)
                self.add("limitation", caller, name="unresolved_indirect_call", detail=f"call through {name or 'a pointer'}", start=start, end=end)
            else:
                self.add("call", caller, callee, name=name, detail="virtual" if kind == "member" else "direct", start=start, end=end)
        seen = set()
        for caller, name, at in self.uses:
            if name in self.macros:
                self.add("expansion", f"c:{self.unit}@macro@{name}", caller, name=name, start=at, end=at + len(name))
            for kind, known in (("type_reference", self.types), ("global_reference", self.globals)):
                if name in known and (caller, kind, name) not in seen:
                    seen.add((caller, kind, name))
                    self.add(kind, caller, known[name], name=name, start=at, end=at + len(name))


def parse_unit(unit: str, source: str | None, tree: Sequence[str] = ()) -> list[tuple]:
    """The facts of a unit; a row of kind failed where it cannot be read. Never raises."""
    try:
        if source is None:
            raise ValueError("no source")
        return Collector(unit, source, tree).collect()
    except Exception as e:  # a unit's failure is its result
        return [(unit, "failed", None, None, None, None, str(e), unit, None, None, None, None, None)]


def extract(units: DataFrame, tree: Sequence[str] = ()) -> DataFrame:
    """All facts (FACT's columns) of units (path, text); tree: paths that includes may lead to, of a bounded list."""
    known = list(tree)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [fact for path, text in zip(batch["path"], batch["text"], strict=True) for fact in parse_unit(path, text, known)]
            yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)

    return units.select("path", "text").mapInPandas(run, FACT)


def tables(facts: DataFrame) -> dict[str, DataFrame]:
    """The fact tables of an index from extracted facts, one selection each."""
    of = lambda kind: facts.where(F.col("kind") == kind)
    place = ("path", "start_line", "end_line", "start_byte", "end_byte")
    return {
        "symbols": of("symbol").select("usr", "name", F.col("qualified").alias("qualified_name"), F.col("detail").alias("kind"), *place, F.col("flag").alias("is_definition")),
        "calls": of("call").select(F.col("usr").alias("caller"), F.col("other").alias("callee"), "name", F.col("detail").alias("kind"), F.col("start_line").alias("line"), *place),
        "macros": of("macro").select("usr", "name", *place),
        "expansions": of("expansion").select("usr", F.col("other").alias("caller"), "name", F.col("start_line").alias("line"), *place),
        "includes": of("include").select("path", F.col("other").alias("included"), F.col("name").alias("spelling"), F.col("start_line").alias("line")),
        "type_references": of("type_reference").select(F.col("usr").alias("source"), F.col("other").alias("target")),
        "global_references": of("global_reference").select(F.col("usr").alias("source"), F.col("other").alias("target")),
        "derived": of("derived").select(F.col("usr").alias("class"), F.col("name").alias("base")),
        "methods": of("virtual").select("usr", F.col("detail").alias("class"), F.col("name").alias("suffix")).distinct(),
        "inputs": of("input").select("unit", "path", F.col("detail").alias("sha256")),
        "limitations": of("limitation").select(F.col("name").alias("kind"), F.col("usr").alias("affects"), "detail").unionByName(of("failed").select(F.lit("parse_failed").alias("kind"), F.col("unit").alias("affects"), "detail")),
    }
