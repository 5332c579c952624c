"""Chat formatting with Spark expressions only.

A conversation becomes one string. Adjacent turns of one role form a block:

    ### role:
    text<more>text</turn>

Inside roles and texts `\\`, `<` and `#` are written `\\b`, `\\l` and `\\h`, and a line end in a role `\\e`; so no text holds a control
string, and every text can be read back. The loss mask is a list of code point ranges of the string, one for each
assistant text.

Turns go by turn number (null first), then role, then text, so ties have a fixed order; repeated rows are repeated turns. Null texts and
roles count as empty. The null conv_id is a conversation like others. A conversation is one row of output and has to fit in
one; conversations never meet each other in a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MORE, END = "### ", "<more>", "</turn>\n"
ASSISTANT = "assistant"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))


def escaped(text: Column, more: tuple = ()) -> Column:
    for plain, code in (*ESCAPES, *more):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in (("\n", "\\e"), *reversed(ESCAPES)):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation (conv_col, formatted, loss_spans array of (start, stop) from 0)."""
    rows = df.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.coalesce(role_col, F.lit("")).alias("r"), F.coalesce(text_col, F.lit("")).alias("x"))
    order = Window.partitionBy("c").orderBy("t", "r", "x")
    # Where a text stands in the string is a running sum over the turns before it.
    head = F.concat(F.lit(START), escaped(F.col("r"), (("\n", "\\e"),)), F.lit(":\n"))
    before = F.lag("r").over(order)
    lead = F.when(before.isNull(), head).when(before == F.col("r"), F.lit(MORE)).otherwise(F.concat(F.lit(END), head))
    placed = rows.withColumns({"head": head, "body": escaped(F.col("x")), "size": F.length(lead)}).withColumn("stop", F.sum(F.col("size") + F.length("body")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    turns = F.array_sort(F.collect_list(F.struct("t", "r", "x", "stop", "head", "body")))
    grouped = placed.groupBy("c").agg(turns.alias("a"))
    # A block starts where the role changes, and has the turns up to the next start.
    starts = F.filter(F.sequence(F.lit(0), F.size("a") - 1), lambda i: (i == 0) | (F.get("a", i)["r"] != F.get("a", i - 1)["r"]))
    merged = grouped.withColumn("s", starts).withColumn("blocks", F.transform("s", lambda at, k: F.struct(
        F.get("a", at)["head"].alias("head"), F.transform(F.slice("a", at + 1, F.coalesce(F.get("s", k + 1), F.size("a")) - at), lambda t: t["body"]).alias("bodies"))))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["bodies"], MORE), F.lit(END))), "")
    loss = F.transform(F.filter("a", lambda t: t["r"] == ASSISTANT), lambda t: F.struct((t["stop"] - F.length(t["body"])).cast("int").alias("start"), t["stop"].cast("int").alias("stop")))
    return merged.select(F.col("c").alias(conv_col), formatted.alias("formatted"), loss.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    blocks = F.split(formatted, END)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        at = F.instr(block, ":\n")
        role = unescaped(F.substring(block, F.lit(len(START) + 1), at - len(START) - 1))
        return F.transform(F.split(F.substring(block, at + 2, F.length(block)), MORE), lambda text: F.struct(role.alias("role"), unescaped(text).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(df: DataFrame, conv_col: str = "conv_id", **columns) -> DataFrame:
    """Per conversation, read back from the formatted string: (conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    done = format_conversations(df, conv_col, **columns).withColumn("turns", read_back(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", s["start"] + 1, s["stop"] - s["start"]))), "")
    return done.withColumn("loss", learned).select(
        conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before,
    length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')) AS body,
    length('### ' || replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), chr(10), '\e') || ':' || chr(10)) AS head
  FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(length(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant')), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN k = 1 THEN head + 8 WHEN before = role THEN 6 ELSE head + 8 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
