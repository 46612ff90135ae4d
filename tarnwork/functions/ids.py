"""Content addresses: domain-separated digests of columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Domain prefix of every digest, and the prefix of a finding's id; both can be given.
NAMESPACE, FINDING_PREFIX = "audit", "finding-"

_SUFFIXES = "c|h|cc|cpp|cxx|hpp|hh|hxx|inc|ipp"
_QUOTED = "'[^']*'|\"[^\"]*\"|`[^`]*`|‘[^’]*’"
#: Noncharacters that stand for something while patterns run; no text holds them.
_EMPTY, _OPEN = "\ufdd0", "\ufdd1"
_NUMBER = r"(?U)\b0[xX][0-9a-fA-F]+\b|\b\d+\b"


def path_pattern(suffix: str) -> str:
    """A path of named segments that ends in a dot and a suffix (a pattern), in a text whose slashes are apart.

    A path starts where its first segment does and ends after the last such
    suffix in it, so each character is tried once, and no group is repeated:
    a very long path or word costs no stack and no more than its length.
    """
    return rf"(?iU)(?<![\w.\-])(?<![\w.\-]/)(?=[\w.\-])[\w.\-/]*[\w.\-]\.(?:{suffix})"


def apart(text: Column) -> Column:
    """text with a mark between two slashes: there is no segment there, so a path ends."""
    for _ in range(2):
        text = F.replace(text, F.lit("//"), F.lit(f"/{_EMPTY}/"))
    return text


def replace_paths(text: Column, suffix: str, put: str) -> Column:
    return F.replace(F.regexp_replace(apart(text), path_pattern(suffix), put), F.lit(_EMPTY), F.lit(""))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _replace_quoted(text: Column) -> Column:
    """Quoted names as <id>; an opening mark after the last closing one is left out of the search, so that it is linear."""
    plain = F.regexp_replace(text, _QUOTED, "<id>")
    head = F.regexp_extract(text, "(?s)^.*’", 0)
    tail = F.substring(text, F.char_length(head) + 1, F.char_length(text))
    found = F.regexp_replace(F.concat(head, F.replace(tail, F.lit("‘"), F.lit(_OPEN))), _QUOTED, "<id>")
    return F.when(F.contains(text, F.lit("‘")), F.replace(found, F.lit(_OPEN), F.lit("‘"))).otherwise(plain)


def normalize_message(message: Column) -> Column:
    """A diagnostic without what moves when code moves: paths, quoted names and numbers. Idempotent."""
    text = bound(replace_paths(message, rf"(?:{_SUFFIXES})\b", "<path>"), _replace_quoted)
    text = F.regexp_replace(text, _NUMBER, "<n>")
    text = F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))
    return F.regexp_replace(text, r"(?<![ .;:])[ .;:]++$", "")


def digest(domain: str, *parts: Column) -> Column:
    """sha256 over the domain and the parts, each closed by a zero byte; a null part is byte 0xFF."""
    zero, null = F.unhex(F.lit("00")), F.unhex(F.lit("FF"))
    out = [F.lit(domain).cast("binary"), zero]
    for part in parts:
        out += [F.coalesce(part.cast("binary"), null), zero]
    return F.sha2(F.concat(*out), 256)


def _short(prefix: str, domain: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(digest(domain, *parts), 1, 16))


def _text(value: Column) -> Column:
    return value.cast("string")


def finding_id(cwe: Column, path: Column, symbol: Column, message: Column, start_byte: Column, end_byte: Column, namespace: str = NAMESPACE, prefix: str = FINDING_PREFIX) -> Column:
    """Names one report entry: it moves with its bytes."""
    return _short(prefix, f"{namespace}/finding-id/v2", cwe, path, symbol, normalize_message(message), _text(start_byte), _text(end_byte))


def dedup_fingerprint(cwe: Column, path: Column, symbol: Column, message: Column, namespace: str = NAMESPACE) -> Column:
    """Survives motion within a file: no line, no byte."""
    return _short("fp-", f"{namespace}/dedup-fingerprint/v1", cwe, path, symbol, normalize_message(message))


def evidence_id(kind: Column, path: Column, start_byte: Column, end_byte: Column, sha256: Column, namespace: str = NAMESPACE) -> Column:
    return _short("ev-", f"{namespace}/evidence-id/v1", kind, path, _text(start_byte), _text(end_byte), sha256)


def candidate_id(producer: Column, rule_id: Column, path: Column, start_line: Column, message: Column, namespace: str = NAMESPACE) -> Column:
    return _short("cand-", f"{namespace}/candidate-id/v1", producer, rule_id, path, _text(start_line), normalize_message(message))


def hash_bytes(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def hashes_match(expected: Column, observed: Column) -> Column:
    return F.lower(expected) == F.lower(observed)


def _sorted_keys(value: Column, kind: DataType) -> Column:
    """value with the fields of its structs and the keys of its maps in order of their names."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_sorted_keys(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _sorted_keys(x, kind.elementType))
    if isinstance(kind, MapType):
        in_order = F.array_sort(F.map_keys(value))
        return F.map_from_arrays(in_order, F.transform(in_order, lambda k: _sorted_keys(F.element_at(value, k), kind.valueType)))
    return value


def canonical_json(value: Column, kind: DataType) -> Column:
    """Compact JSON of a struct, array or map of this type: keys sorted at every level, nulls kept."""
    return F.to_json(_sorted_keys(value, kind), {"ignoreNullFields": "false"})


def canonical_hash(value: Column, kind: DataType) -> Column:
    """sha256 of a value as canonical JSON."""
    return F.sha2(canonical_json(value, kind), 256)


def bag_digest(digest: Column) -> Column:
    """Aggregate: names a bag of digests (64 hex digits each) whatever their order and partitions, in memory that does not grow.

    The count and the sums of the eight parts of the digests, in a digest.
    """
    part = lambda k: F.sum(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)"))
    return F.sha2(F.concat_ws(" ", F.count(digest).cast("string"), *[F.coalesce(part(k), F.lit(0)).cast("string") for k in range(8)]), 256)


def set_hash(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """One row (members, hash) that names a set of rows, whatever their order and partitions.

    Rows are hashed each, the hashes of a group in order make its hash, and
    those of the groups by name make the set's; what meets in a task is 64
    characters a row of one group.
    """
    kind = rows.schema
    hashed = rows.select(group, F.struct(*order).alias("o"), canonical_hash(F.struct(*rows.columns), kind).alias("h"))
    own = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), "\n"), 256)
    groups = hashed.groupBy(group).agg(own.alias("h"))
    line = F.concat_ws(" ", F.coalesce(F.col(group).cast("string"), F.lit("")), "h")
    return groups.agg(F.count(F.lit(1)).alias("members"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("hash"))


def cache_key(prompt: Column, model_id: Column, prompt_version: Column, schema_version: Column, namespace: str = NAMESPACE) -> Column:
    return digest(f"{namespace}/response/v1", prompt, model_id, prompt_version, schema_version)
