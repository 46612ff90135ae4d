"""Paths: canonical form, globs, containment and the ladder of exclusion reasons."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import BANNER, BANNER_BYTES, BANNER_LINES, GENERATED_GLOBS, HEADERS, SOURCE_LANGUAGE, THIRD_PARTY


def canonical_path(path: Column) -> Column:
    """A relative path without empty and dot segments; null where it is absolute, empty or leaves the root."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(
        parts, F.struct(F.lit(0).alias("depth"), F.lit(True).alias("inside")),
        lambda s, p: F.struct((s["depth"] + F.when(p == "..", -1).otherwise(1)).alias("depth"), (s["inside"] & (s["depth"] + F.when(p == "..", -1).otherwise(1) >= 0)).alias("inside")),
    )
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when(p == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))))
    joined = F.array_join(folded, "/")
    return F.when(~path.startswith("/") & depth["inside"] & (joined != ""), joined)


def normalize_repo_path(path: Column) -> Column:
    """canonical_path that raises instead of null."""
    return F.coalesce(canonical_path(path), F.raise_error(F.concat(F.lit("not a path inside the repository: "), F.coalesce(path, F.lit("null")))).cast("string"))


def relative_to(path: Column, root: str, base: Column | None = None) -> Column:
    """An absolute or relative path as one inside root, null outside; relative ones start at base."""
    root = root.rstrip("/") + "/"
    full = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", base if base is not None else F.lit(root.rstrip("/")), path))
    return F.when(full.startswith(root), canonical_path(F.substring(full, F.lit(len(root) + 1), F.char_length(full))))


def glob_pattern(glob: str) -> str:
    """The expression of a glob: * stays in a segment, **/ spans segments, ? is one character."""
    pieces = re.findall(r"\*{2,}/|\*{2,}|\*|\?|[^*?]+", glob)
    known = {"*": "[^/]*", "?": "[^/]"}
    return "^" + "".join("(?:[^/].*/)?" if p[:2] == "**" and p[-1] == "/" else ".*" if p[:2] == "**" else known.get(p) or re.escape(p) for p in pieces) + "$"


def matching_glob(path: Column, globs: Sequence[str]) -> Column:
    """The first glob, in order, that a path matches."""
    return F.coalesce(*[F.when(path.rlike(glob_pattern(g)), F.lit(g)) for g in globs], F.lit(None).cast("string")) if globs else F.lit(None).cast("string")


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs)) if globs else F.lit(False)


def is_third_party(path: Column, names: Sequence[str] = THIRD_PARTY) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def is_generated_name(path: Column, extra: Sequence[str] = ()) -> Column:
    return matches_any(path, (*GENERATED_GLOBS, *extra))


def has_generated_banner(text: Column, lines: int = BANNER_LINES) -> Column:
    """Whether one of the first lines, within the first 8 KiB, says that the file is generated."""
    head = F.slice(F.split(F.substring(text, 1, BANNER_BYTES), "\r\n|\r|\n"), 1, lines)
    return F.exists(head, lambda line: line.rlike(BANNER))


def selects(path: Column, targets: Sequence[str]) -> Column:
    """Whether a path is one of the targets or below one; no targets select all."""
    cleaned = [t.strip().rstrip("/") for t in targets if t.strip()]
    found = F.lit(not cleaned)
    for t in cleaned:
        found = found | (path == t) | path.startswith(f"{t}/")
    return found


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def is_header(path: Column) -> Column:
    return extension(path).isin(*HEADERS)


def is_implementation(path: Column) -> Column:
    return extension(path).isin(*SOURCE_LANGUAGE)


def exclusion_reason(
    path: Column, *, exists: Column, size: Column, text: Column, language_supported: Column, targets: Sequence[str] = (), user_globs: Sequence[str] = (),
    include_third_party: bool = False, include_generated: bool = False, max_bytes: int = 2_000_000, generated_name: Column | None = None, third_party: Column | None = None, banner: Column | None = None,
) -> Column:
    """Why a file is not analysed, null if it is: the first reason of the ladder."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    generated = is_generated_name(path) if generated_name is None else generated_name
    vendored = (is_third_party(path) | matches_any(path, user_globs)) if third_party is None else third_party
    says = has_generated_banner(text) if banner is None else banner
    return (
        F.when(~yes(selects(path, targets)), "not_selected")
        .when(yes(generated) & F.lit(not include_generated), "generated")
        .when(yes(vendored) & F.lit(not include_third_party), "third_party")
        .when(~yes(language_supported), "unsupported_language")
        .when(~yes(exists), "missing_source")
        .when(yes(size > max_bytes), "too_large")
        .when(yes(says) & F.lit(not include_generated), "generated")
    )
