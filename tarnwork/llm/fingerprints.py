"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

For each of SAMPLES independent samples, every term of a text draws r and c
from Gamma(2, 1) and b from the uniform distribution, all from a hash of the
term and the sample's number. A term of weight w takes
``t = floor(ln(w) / r + b)`` and the value ``ln(c) - r * (t - b + 1)``; the
smallest value of a text selects (term, t). Two texts select the same with the
probability of their generalised Jaccard similarity, sum(min) / sum(max) of
the weights. The weight of a term (white-space separated) is its count.

A Gamma(2, 1) draw is minus the logarithm of the product of two uniform draws,
each the midpoint of one of 4,096 cells; b keeps 16 bits. The value goes to the high
bits of a long and the selected pair's hash to the low ones, so that one
``min`` over longs per sample is the whole aggregation.

The edited text needs the next document's text. Documents are dealt to blocks
by ranges of (doc_id, hash of the text); the first document of a block is also
sent to the block before it. Texts move in this one shuffle; windows, terms,
samples and comparisons all stay in the block's task. The driver gets a few
keys per block. Rows of one id, or of null, with different texts are split like
others; rows equal in both are neighbours in one block.

Defined cases: a null text counts as empty; a text without terms has a
fingerprint of its own kind, equal to that of any other such text and alike to
no other; rows of one id follow each other by the hexadecimal hash of their
texts, nulls last; a single row is its own next document; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import deal

SAMPLES = 32
SPACE = r"[\x20\x09-\x0D]+"
NO_TERM = 2**31 - 1


def sample_value(term: Column, log_weight: Column, k: int) -> Column:
    """Value and selected pair of one term in sample k: a long, smaller is better, its low 31 bits the pair's hash."""
    h = F.xxhash64(term, F.lit(k))
    # twice the middle of one of 4,096 cells of the unit interval, four times, and 16 bits for b
    odd = lambda at: F.shiftrightunsigned(h, at).bitwiseAND(F.lit(0xFFF).cast("long")).cast("double") + F.lit(0.5)
    gamma = lambda at: F.lit(2 * math.log(4096.0)) - F.log(odd(at) * odd(at + 12))
    r, log_c = gamma(0), F.log(gamma(24))
    b = F.shiftrightunsigned(h, 48).cast("double") * F.lit(2.0**-16)
    t = F.floor(log_weight / r + b)
    value = log_c - r * (t.cast("double") - b + F.lit(1.0))
    level = ((value + F.lit(96.0)) * F.lit(float(2**25))).cast("long")
    pair = h.bitwiseXOR(t * F.lit(1_000_003)).bitwiseAND(F.lit(2**31 - 1).cast("long"))
    return F.shiftleft(level, 31).bitwiseOR(pair)


def terms(text: Column) -> Column:
    """The sorted hashes of a text's terms, repeats included."""
    words = F.array_remove(F.split(text, SPACE), "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def weighted_terms(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row (keys, term, log_weight) per distinct term of each row's text; a null term where it has none."""
    sorted_terms = rows.select(*keys, terms(F.col(text)).alias("s"))
    last = lambda x, i: (i == F.size("s") - 1) | (F.get(F.col("s"), i + 1) != x)
    positions = F.filter(F.transform("s", lambda x, i: F.when(last(x, i), i)), lambda i: i.isNotNull())
    ends = sorted_terms.select(*keys, "s", positions.alias("ends"))
    pairs = F.transform("ends", lambda e, i: F.struct(F.get(F.col("s"), e).alias("term"), (e - F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("ends"), i - 1))).alias("count")))
    return ends.select(*keys, F.inline_outer(pairs)).select(*keys, "term", F.log(F.col("count").cast("double")).alias("log_weight"))


def fingerprints(rows: DataFrame, text: str, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and fingerprint (array of ints) of each row's text; the keys name a row.

    Where rows are partitioned by some of the keys already, nothing moves.
    """
    value = lambda k: F.min(sample_value(F.col("term"), F.col("log_weight"), k)).alias(f"m{k}")
    selected = weighted_terms(rows, text, keys).groupBy(*keys).agg(*map(value, range(samples)))
    slot = lambda k: F.coalesce(F.col(f"m{k}").bitwiseAND(F.lit(2**31 - 1).cast("long")), F.lit(NO_TERM).cast("long")).cast("int")
    return selected.select(*keys, F.array(*map(slot, range(samples))).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal places of two fingerprints."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x).cast("double") / F.size(a)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def edited_fingerprints(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edit, and their likeness; see query()."""
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    # descending ids as ascending text of one length, nulls last, then a hash of the text
    number = F.lit(2**63 - 1).cast("decimal(20,0)") - F.coalesce(doc_id, F.lit(-(2**63))).cast("decimal(20,0)")
    key = F.concat(F.lpad(number.cast("string"), 20, "0"), F.when(doc_id.isNull(), "~").otherwise(" "), F.hex(F.xxhash64(text)))
    docs = documents.select(doc_id.alias("doc_id"), text.alias("text"), key.alias("key"))
    dealt = deal(docs, "key", ring=True).where("guest >= 0")
    order = Window.partitionBy("block").orderBy("guest", "key", "text")
    # a block beside which there is no other is a ring of its own
    first = F.first("text").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    following_text = F.coalesce(F.lead("text").over(order), first)
    ahead = dealt.select("block", (F.col("guest") > 0).alias("guest"), "doc_id", "text", F.row_number().over(order).alias("place"), following_text.alias("next"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.when(~F.col("guest"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)))
    both = ahead.select("block", "guest", "doc_id", "place", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    keys = ["block", "guest", "place", "doc_id", "n_chars", "edited_sha256"]
    forms = F.array(F.struct(F.lit(0).alias("form"), F.col("text").alias("body")), F.struct(F.lit(1).alias("form"), F.col("edited").alias("body")))
    bodies = both.select(*keys[:-1], F.sha2("edited", 256).alias("edited_sha256"), F.inline(forms)).where("body is not null")
    found = fingerprints(bodies, "body", [*keys, "form"], samples)
    paired = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("form", "fingerprint"))).alias("f"))
    own, other = F.get("f", F.lit(0))["fingerprint"], F.get("f", F.lit(1))["fingerprint"]
    rows = paired.select(*keys, own.alias("own"), other.alias("other"))
    by_place = Window.partitionBy("block").orderBy("place")
    following = F.coalesce(F.lead("own").over(by_place), F.first("own").over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.withColumn("following", following).where("not guest").select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every text of documents, its edit and the next document's text."""
    from .common import table

    return edited_fingerprints(table(spark, sf_dir, "documents"))
