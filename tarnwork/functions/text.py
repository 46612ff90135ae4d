"""Text: tokens, fences, secrets, placeholders and lossy decoding."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import SECRET_RULES
from .ids import apart, path_pattern

PLACEHOLDER = "[redacted:"
#: What a text has to hold for a rule to match at all: a plain search that spares the pattern.
NEEDLES = {
    "private_key_block": ("-----BEGIN ",), "aws_access_key": ("AKIA", "ASIA", "AGPA", "AIDA"), "google_api_key": ("AIza",), "json_web_token": ("eyJ",),
    "vendor_token": ("gh", "xox", "sk-", "ya29."), "assigned_literal": ('"',),
}


def token_estimate(text: Column, chars_per_token: float = 3.0) -> Column:
    """ceil(characters / ratio) and one more per line break; none for no text."""
    breaks = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.coalesce(F.ceil(F.char_length(text) / F.lit(float(chars_per_token))) + breaks, F.lit(0)).cast("long")


def decode_for_display(data: Column) -> Column:
    """Bytes as text, what is not UTF-8 replaced."""
    return F.make_valid_utf8(data.cast("string"))


def contains_identifier(body: Column, name: Column) -> Column:
    """Whether a name stands in bytes as a whole identifier; Latin-1 letters count as part of one."""
    text = F.decode(body, "ISO-8859-1")
    edge = "[A-Za-z0-9_ª²³µ¹º¼-¾À-ÖØ-öø-ÿ]"
    return F.rlike(text, F.concat(F.lit(f"(?<!{edge})\\Q"), name, F.lit(f"\\E(?!{edge})")))


def fence(text: Column) -> Column:
    """A run of back quotes longer than any in the text, three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.char_length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def scrub(text: Column, rules: Sequence[tuple[str, str, int]] = SECRET_RULES, registered: Sequence[str] = ()) -> Column:
    """struct(text, counts): secrets replaced rule by rule, each rule on what the one before left, and counted by kind.

    Registered secrets go first, the longest first. A rule of group 2 keeps
    what stands around its second group. What a former rule replaced is not
    counted again.
    """
    kinds: list[str] = []
    state = F.struct(text.alias("text"), F.array().cast("array<bigint>").alias("n"))

    def then(step: Callable[[Column], tuple[Column, Column]]) -> None:
        """The state after one rule; the one before it is bound to a variable, not written out again."""
        nonlocal state

        def bound(before: Column) -> Column:
            after, n = step(before["text"])
            return F.struct(after.alias("text"), F.concat(before["n"], F.array(n.cast("bigint"))).alias("n"))

        state = F.get(F.transform(F.array(state), bound), F.lit(0))

    for secret in sorted(registered, key=len, reverse=True):
        kinds.append("registered_secret")
        then(lambda t, secret=secret: (F.replace(t, F.lit(secret), F.lit(f"{PLACEHOLDER}registered_secret]")), F.regexp_count(t, F.lit(re.escape(secret)))))
    for kind, pattern, group in rules:
        # what a former rule put in the place of the second group is left alone
        fresh = pattern.replace(")([^", f")((?!{re.escape(PLACEHOLDER)})[^") if group else pattern
        mark = f"{PLACEHOLDER}{kind}]"
        needles = NEEDLES.get(kind, ()) if (kind, pattern, group) in SECRET_RULES else ()

        def rule(t: Column, fresh: str = fresh, put: str = f"$1{mark}$3" if group else mark, needles: Sequence[str] = needles) -> tuple[Column, Column]:
            may = functools.reduce(Column.__or__, [F.contains(t, F.lit(n)) for n in needles]) if needles else F.lit(True)
            return F.when(may, F.regexp_replace(t, fresh, put)).otherwise(t), F.when(may, F.regexp_count(t, F.lit(fresh))).otherwise(F.lit(0))

        kinds.append(kind)
        then(rule)

    def result(s: Column) -> Column:
        total = {k: functools.reduce(Column.__add__, [F.get(s["n"], F.lit(i)) for i, x in enumerate(kinds) if x == k]) for k in dict.fromkeys(kinds)}
        found = F.map_from_arrays(F.array(*map(F.lit, total)), F.array(*total.values()))
        return F.struct(s["text"].alias("text"), F.map_filter(found, lambda _, n: n > 0).alias("counts"))

    return F.get(F.transform(F.array(state), result), F.lit(0))


def mask_paths(text: Column, pattern: str) -> Column:
    """Code paths that a pattern excludes, replaced in generated text, the longest first."""
    paths = F.filter(F.array_distinct(F.regexp_extract_all(apart(text), F.lit(path_pattern(r"\w+")), F.lit(0))), lambda p: F.rlike(p, F.lit(pattern)))
    longest_first = F.array_sort(paths, lambda a, b: F.char_length(b) - F.char_length(a))
    return F.aggregate(longest_first, text, lambda t, p: F.replace(t, p, F.lit("[excluded path]")))


def redact_roots(text: Column, compile_database: str, root: str) -> Column:
    """Absolute names of the database and the root, the longest first, as base names; a root of / is left alone."""
    for place in sorted({compile_database, root} - {"", "/"}, key=len, reverse=True):
        text = F.replace(text, F.lit(place), F.lit(place.rstrip("/").rsplit("/", 1)[-1]))
    return text


def substitute(template: str, values: Mapping[str, Column]) -> Column:
    """A template with {{name}} places filled in one pass; values are never read as templates; an unknown name raises."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    unknown = sorted(set(parts[1::2]) - set(values))
    if unknown:
        raise KeyError(f"template names unknown values: {', '.join(unknown)}")
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) for i, p in enumerate(parts)])


def split_command(command: Column) -> Column:
    """A command line cut as a POSIX shell does; null and unbalanced quotes give null."""
    import shlex

    def one(text: str | None) -> list[str] | None:
        try:
            return None if text is None else shlex.split(text)
        except ValueError:
            return None

    def run(commands: pd.Series) -> pd.Series:
        return commands.map(one)

    return F.pandas_udf(run, "array<string>")(command)
