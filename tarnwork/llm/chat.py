"""Chat formatting checked by a grammar round trip, with DataFrame functions only.

A conversation is rendered with its texts as they are, reparsed by a
deterministic parser and compared with its turns. Where anything differs, its
texts are rendered again with escapes; so are those of a conversation with a
control string inside a text, as that never reads back. A rendering that still
differed would stop the job. The parser is
the same for both: it finds the marked turns and undoes escapes.

Template: ``<<SYS>>text<</SYS>>`` for system, ``[INST]text[/INST]`` for user,
``<s>text</s>`` for assistant, ``[ROLE=hex]text[/ROLE]`` for any other role,
by the hex form of its name, and ``[ROLE]text[/ROLE]`` for a null role.
Escapes: a backslash is doubled, and one is put after the first character of a
control string. Reading back, a backslash stands for the character after it.

The loss mask is kept as runs (loss, chars) over the rendered text: true over
the texts of the assistant, false over everything else.

Defined cases: a null text is empty; turns are ordered by (turn, role, text),
nulls last, so ties and repeated rows have one order and all count; an
empty table gives an empty result; other columns are not read. A conversation
is one value of the result, so its turns meet in one task; texts of any number
of conversations never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Role, opening mark, closing mark.
MARKS = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
OTHER_CLOSE = "[/ROLE]"
CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE(?:=[0-9A-F]*)?\]"
CONFLICT = r"([<\[])(?=/?s>|/?INST\]|</?SYS>>|/?ROLE(?:=[0-9A-F]*)?\])"
TURN = r"(?s)<<SYS>>.*?<</SYS>>|\[INST\].*?\[/INST\]|<s>.*?</s>|\[ROLE(?:=[0-9A-F]*)?\].*?\[/ROLE\]"
OPENING = r"^(?:<<SYS>>|\[INST\]|<s>|\[ROLE(?:=[0-9A-F]*)?\])"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONFLICT, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _opening(role: Column) -> Column:
    found = F.when(role.isNull(), F.lit("[ROLE]"))
    for name, opening, _ in MARKS:
        found = found.when(role == name, F.lit(opening))
    return found.otherwise(F.concat(F.lit("[ROLE="), F.hex(role), F.lit("]")))


def _closing(role: Column) -> Column:
    found = F.when(role.isNull(), F.lit(OTHER_CLOSE))
    for name, _, closing in MARKS:
        found = found.when(role == name, F.lit(closing))
    return found.otherwise(F.lit(OTHER_CLOSE))


def render(turns: Column, escaped: bool) -> Column:
    """The text of an array of (role, text)."""
    body = (lambda t: escape(t["text"])) if escaped else (lambda t: t["text"])
    return F.array_join(F.transform(turns, lambda t: F.concat(_opening(t["role"]), body(t), _closing(t["role"]))), "")


def segments(rendered: Column) -> Column:
    """The marked turns of a rendered text: (role, raw, opening_chars, closing_chars), raw still escaped."""

    def one(found: Column) -> Column:
        opening = F.regexp_extract(found, OPENING, 0)
        role = F.when(opening == "[ROLE]", F.lit(None).cast("string"))
        for name, mark, _ in MARKS:
            role = role.when(opening == mark, F.lit(name))
        role = role.otherwise(F.decode(F.unhex(F.regexp_extract(opening, "=([0-9A-F]*)", 1)), "utf-8"))
        opened = F.char_length(opening)
        closed = F.char_length(_closing(role))
        raw = F.substring(found, opened + 1, F.char_length(found) - opened - closed)
        return F.struct(role.alias("role"), raw.alias("raw"), opened.alias("opening_chars"), closed.alias("closing_chars"))

    return F.transform(F.regexp_extract_all(rendered, F.lit(TURN), 0), one)


def turns_of(found: Column, rendered: Column) -> Column:
    """The turns of a rendered text from its segments; null if a control string stands inside a turn or text between turns."""
    covered = F.aggregate(found, F.lit(0), lambda n, s: n + s["opening_chars"] + s["closing_chars"] + F.char_length(s["raw"]))
    clean = ~F.exists(found, lambda s: s["raw"].rlike(CONTROL)) & (covered == F.char_length(rendered))
    return F.when(clean, F.transform(found, lambda s: F.struct(s["role"].alias("role"), unescape(s["raw"]).alias("text"))))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (read back), loss_runs from rows (conv_id, turn, role, text)."""
    in_order = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    source = rows.groupBy("conv_id").agg(F.transform(in_order, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    plain = source.withColumn("plain", render(F.col("source"), escaped=False))
    # stray marks would make the parser look for their ends again and again; with one the plain rendering is out anyway
    conflict = F.exists("source", lambda t: t["text"].rlike(CONTROL))
    read = plain.withColumn("found", F.when(~conflict, segments(F.col("plain"))))
    checked = read.withColumn("same", turns_of(F.col("found"), F.col("plain")).eqNullSafe(F.col("source")))
    # what was read back of the plain rendering is kept; the escaped one is read anew
    chosen = checked.select("conv_id", "source", F.when(F.col("same"), F.col("plain")).otherwise(render(F.col("source"), escaped=True)).alias("formatted"), F.when(F.col("same"), F.col("found")).alias("found"))
    again = chosen.select("conv_id", "source", "formatted", F.coalesce("found", segments(F.col("formatted"))).alias("segments"))
    parsed = again.withColumn("turns", turns_of(F.col("segments"), F.col("formatted")))
    same = F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("turns")).otherwise(F.raise_error(F.concat(F.lit("no round trip: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))

    def runs(s: Column) -> Column:
        no = F.lit(False)
        run = lambda loss, chars: F.struct(loss.alias("loss"), chars.alias("chars"))
        return F.array(run(no, s["opening_chars"]), run(F.coalesce(s["role"] == LOSS_ROLE, no), F.char_length(s["raw"])), run(no, s["closing_chars"]))

    return parsed.select("conv_id", "formatted", same.alias("turns"), F.flatten(F.transform("segments", runs)).alias("loss_runs"))


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of formatted conversations, from what was read back."""
    turns = F.col("turns")
    every = F.array_join(F.transform(turns, lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter(turns, lambda t: F.coalesce(t["role"] == LOSS_ROLE, F.lit(False))), lambda t: t["text"]), "")
    return formatted.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.aggregate("loss_runs", F.lit(0).cast("long"), lambda n, r: n + F.when(r["loss"], r["chars"]).otherwise(0)).alias("masked_chars"),
    )


#: The conversation added by the contract: both turns hold control strings.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all conversations and conversation -7."""
    from .common import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(rows.unionByName(spark.createDataFrame(ADDED, rows.schema))))


_SQL_CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE(?:=[0-9A-F]*)?\]"
ORACLE_SQL = rf"""
WITH given AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, CASE WHEN role = 'system' THEN 15 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 7
                 WHEN role IS NULL THEN 13 ELSE 14 + 2 * octet_length(encode(role)) END AS marks,
         len(regexp_extract_all(text, '{_SQL_CONTROL}')) AS n_control,
         length(text) - length(replace(text, chr(92), '')) AS n_back,
         regexp_matches(text, '(?s)\\.') AS undone
  FROM given
), conv AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role NULLS LAST, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role NULLS LAST, text) FILTER (role = 'assistant'), '') AS loss,
         sum(marks + length(text)) AS plain, sum(n_control + n_back) AS added,
         sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS mask, sum(CASE WHEN role = 'assistant' THEN n_control + n_back ELSE 0 END) AS mask_added,
         bool_or(n_control > 0 OR undone) AS escaped
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       (plain + CASE WHEN escaped THEN added ELSE 0 END)::BIGINT AS formatted_chars,
       (mask + CASE WHEN escaped THEN mask_added ELSE 0 END)::BIGINT AS masked_chars
FROM conv
"""
