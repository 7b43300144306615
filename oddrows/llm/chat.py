"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns before it as context, then the reply, which alone is trainable. What
follows the last reply (or a conversation without one) is one more example without a target, so that no turn is lost.

    <s>role[INST]text</s> ...      a turn, its role and text escaped

A control string inside a role or text gets a backslash after its first sign, and one more if it has some there already:
``[INST]`` is written ``[\\INST]``, ``[\\INST]`` is written ``[\\\\INST]``. Reading takes one away. The bare strings stand only
where the template puts them.

A conversation is one row here, as its context is one text of the output; rows of one conversation are ordered by turn, then
role and text, so repeated turns have a defined place. A null text or role is empty; rows of a null ``conv_id`` form one
conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(c: Column) -> Column:
    c = F.regexp_replace(c, r"<(\\*)(/?s>)", r"<\\$1$2")
    return F.regexp_replace(c, r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(c: Column) -> Column:
    c = F.regexp_replace(c, r"<\\(\\*)(/?s>)", "<$1$2")
    return F.regexp_replace(c, r"\[\\(\\*)(/?INST\])", "[$1$2")


def expand(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trainable: str = "assistant") -> DataFrame:
    """Examples of every conversation: key, example (from 0), formatted, loss_start, loss_chars.

    The trainable reply is the ``loss_chars`` code points of ``formatted`` after the first ``loss_start``; an example without a target has 0.
    """
    said = df.select(
        F.col(f"`{key}`").alias(key),
        F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).alias("said"),
    )
    turns = said.groupBy(key).agg(F.sort_array(F.collect_list("said")).alias("turns"))
    parts = turns.select(
        key,
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == trainable).alias("reply"),
                F.concat(F.lit("<s>"), escape(t["role"]), F.lit("[INST]")).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("parts"),
    )
    # places of the replies, and the last turn where it is none
    ends = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.element_at("parts", i)["reply"] | (i == F.size("parts")))
    placed = parts.select(key, "parts", F.posexplode(ends).alias("example", "n"))
    before = F.array_join(F.transform(F.slice("parts", 1, F.col("n") - 1), lambda p: F.concat(p["head"], p["body"], F.lit("</s>"))), "")
    last = F.element_at("parts", F.col("n"))
    lead = placed.select(key, "example", F.concat(before, last["head"]).alias("lead"), last["body"].alias("body"), last["reply"].alias("reply"))
    return lead.select(
        key,
        F.col("example").cast("long").alias("example"),
        F.concat("lead", "body", F.lit("</s>")).alias("formatted"),
        F.length("lead").cast("long").alias("loss_start"),
        F.when(F.col("reply"), F.length("body")).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted example."""
    blocks = F.split(formatted, "<s>", -1)
    blocks = F.slice(blocks, F.lit(2), F.size(blocks) - 1)

    def block(b: Column) -> Column:
        cut = F.instr(b, "[INST]")
        return F.struct(
            unescape(F.substring(b, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(b, cut + 6, F.length(b) - cut - 9)).alias("text"),
        )

    return F.transform(blocks, block)


def read_loss(formatted: Column, start: Column, chars: Column) -> Column:
    """The trainable text of an example, read back from its mask."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), chars.cast("int")))


def chat_digests(df: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns and their digest, trainable text and its digest, formatted size."""
    made = expand(df)
    back = made.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_sort(F.collect_list(F.struct("example", read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss")))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    read = back.select("conv_id", "formatted_chars", read_turns(F.col("whole")).alias("turns"), F.array_join("losses.loss", "").alias("loss"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
written AS (
  SELECT *, 13 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*/?s>')) + len(regexp_extract_all(text, '\[\\*/?INST\]')) AS w,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r, count(*) OVER (PARTITION BY conv_id) AS n
  FROM said),
summed AS (SELECT *, sum(w) OVER (PARTITION BY conv_id ORDER BY r) AS upto FROM written)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY r)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY r) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR r = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""
