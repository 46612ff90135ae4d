"""Symbol ids and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_usr(usr: Column, path: Column) -> Column:
    """An id that names its file by base name (c:file@...) with the whole path instead; a macro's offset goes."""
    named = r"^c:([^@]+)@(.*)$"
    rest = F.regexp_replace(F.regexp_extract(usr, named, 2), r"^\d+@(macro@)", "$1")
    return F.when(usr.rlike(named), F.concat(F.lit("c:"), path, F.lit("@"), rest)).otherwise(usr)


def qualified_name(ancestors: Column) -> Column:
    """A::B::c of names from the innermost out; nameless scopes are skipped."""
    return F.array_join(F.reverse(F.filter(ancestors, lambda a: F.coalesce(a, F.lit("")) != "")), "::")


def best_region(definition: Column, declarations: Column) -> Column:
    """The definition, else the first declaration."""
    return F.coalesce(definition, F.get(declarations, F.lit(0)))
