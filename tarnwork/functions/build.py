"""Compiler arguments: language, standard and what only matters for object files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import BARE_FLAGS, ISO_C_YEAR, JOINED_FLAGS, LEAST_C, LEAST_CXX, SOURCE_LANGUAGE, VALUED_FLAGS, X_LANGUAGE
from .paths import extension


def lookup(table: dict, key: Column) -> Column:
    """table[key], null where it has none."""
    if not table:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for k, v in table.items() for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), key)


def parse_std(value: Column) -> Column:
    """struct(language, year) of a -std= value; nulls where it is not known."""
    text = F.lower(F.trim(value))
    iso = lookup(ISO_C_YEAR, F.substring(text, F.lit(9), F.char_length(text)))
    body = F.regexp_extract(text, r"^(?:gnu|c)(.*)$", 1)
    cxx = body.startswith("++")
    digits = F.when(cxx, F.substring(body, F.lit(3), F.char_length(body))).otherwise(body)
    year = (
        F.when(digits.rlike(r"^\d{2}$"), digits.try_cast("int"))
        .when(digits.rlike(r"^\d{4}$"), digits.try_cast("int") % 100)
        .when(digits.rlike(r"^\d[a-z]$"), F.substring(digits, 1, 1).try_cast("int") * 10)
    )
    is_iso = text.startswith("iso9899:")
    found = F.when(is_iso, iso).when(text.rlike("^(?:gnu|c)"), year)
    language = F.when(found.isNotNull(), F.when(~is_iso & cxx, "c++").otherwise("c"))
    return F.struct(language.alias("language"), found.cast("int").alias("year"))


def standard_is_supported(std: Column) -> Column:
    """C11 and C++17 or later; an unknown year counts, a year of the last century does not."""
    cxx = std["language"] == "c++"
    old = std["year"] >= F.when(cxx, 90).otherwise(80)
    enough = std["year"] >= F.when(cxx, LEAST_CXX).otherwise(LEAST_C)
    return F.when(std["year"].isNull(), F.lit(True)).otherwise(~old & enough)


def _explicit_language(arguments: Column) -> Column:
    """The value of the last -x, null without one."""
    found = F.transform(
        arguments,
        lambda a, i: F.when(a == "-x", F.get(arguments, i + 1)).when(a.startswith("-x") & (F.char_length(a) > 2), F.substring(a, F.lit(3), F.char_length(a))),
    )
    return F.lower(F.trim(F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(-1))))


def language_of(arguments: Column, file: Column) -> Column:
    """The last -x, even where it names a language that is not handled (null), else the file's extension."""
    explicit = _explicit_language(arguments)
    return F.when(explicit.isNotNull(), lookup(X_LANGUAGE, explicit)).otherwise(lookup(SOURCE_LANGUAGE, extension(file)))


def std_argument(arguments: Column) -> Column:
    """The last -std= or --std= value, null without one."""
    found = F.filter(F.transform(arguments, lambda a: F.lower(F.trim(F.regexp_extract(a, "^--?std=(.*)$", 1)))), lambda x: x != "")
    return F.try_element_at(found, F.lit(-1))


def strip_compile_only(arguments: Column) -> Column:
    """Arguments without those for objects and dependency lists; a valued flag takes the next argument along."""
    valued, bare = F.array(*map(F.lit, VALUED_FLAGS)), F.array(*map(F.lit, BARE_FLAGS))
    joined = lambda a: F.lit(False) if not JOINED_FLAGS else a.rlike("^(?:" + "|".join(JOINED_FLAGS) + ").")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("skip"))

    def step(s: Column, a: Column) -> Column:
        drop = s["skip"] | F.array_contains(valued, a) | F.array_contains(bare, a) | joined(a)
        return F.struct(F.when(drop, s["kept"]).otherwise(F.concat(s["kept"], F.array(a))).alias("kept"), (~s["skip"] & F.array_contains(valued, a)).alias("skip"))

    return F.aggregate(arguments, start, step, lambda s: s["kept"])


def version_of(text: Column) -> Column:
    """The first x.y or x.y.z in a tool's version text, null without one."""
    return F.nullif(F.regexp_extract(text, r"(\d+\.\d+(?:\.\d+)?)", 1), F.lit(""))
