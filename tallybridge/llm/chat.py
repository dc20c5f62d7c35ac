"""Chat formatting as column expressions.

A conversation's turns are collected as structs and sorted, neighbours of one role are merged
into blocks, and the blocks are concatenated under a template:

    <|im_start|> role <|im_sep|> text (<|im_turn|> text)* <|im_end|>

(without the blanks). Merged turns keep a mark between them, so they can be told apart again.
Control strings inside roles and texts, the template's own and those of other common templates,
are broken by ``\\!`` after their first character, and a backslash is doubled; both are undone
when a conversation is read back. ``segments`` are the stretches of the formatted text with
their loss mask: exactly the texts of the learned roles are under it.

Edge cases. A null text or role is empty. Turns sort by number, then role, then text, null
numbers first; equal rows stay, each a turn. Rows without a conversation id are one conversation.
An empty table has no conversations. One conversation is one text by definition, so it has to
fit a row; the number of conversations is not bounded. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .registry import query, table
from .shared import let

OPEN, BODY, NEXT, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>"
LEARNED = ("assistant",)

# Control strings of the template and of other common chat templates.
CONTROL = r"([<\[])(\|(?:im_start|im_sep|im_turn|im_end|endoftext)\|>|/?s>|</?SYS>>|/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\!$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|!)", "$1")


def _quoted(mark: str) -> str:
    return mark.replace("|", r"\|")


def _blocks(turns: Column) -> Column:
    """Neighbouring turns of one role as one struct (role, texts)."""
    n = F.size(turns)

    def role(i: Column) -> Column:
        return F.get(turns, i)["role"]

    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))

    def cut(starts: Column) -> Column:
        return F.transform(
            starts,
            lambda at, k: F.struct(
                role(at).alias("role"),
                F.transform(F.slice(turns, at + 1, F.coalesce(F.get(starts, k + 1), n) - at), lambda t: t["text"]).alias("texts"),
            ),
        )

    return let(first, cut)


def _segments(blocks: Column, learned: tuple[str, ...]) -> Column:
    def part(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block(b: Column) -> Column:
        loss = b["role"].isin(*learned)
        head = F.concat(F.lit(OPEN), escaped(b["role"]), F.lit(BODY))
        texts = F.transform(
            b["texts"],
            lambda t, i: F.array(part(F.when(i == 0, head).otherwise(F.lit(NEXT)), F.lit(False)), part(escaped(t), loss)),
        )
        return F.concat(F.flatten(texts), F.array(part(F.lit(CLOSE), F.lit(False))))

    return F.flatten(F.transform(blocks, block))


def formatted(
    rows: DataFrame, ids: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: tuple[str, ...] = LEARNED
) -> DataFrame:
    """``ids``, ``formatted`` and ``segments`` (text, loss), one row per conversation."""
    each = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    turns = rows.select(F.col(ids), each.alias("_t")).groupBy(ids).agg(F.array_sort(F.collect_list("_t")).alias("_turns"))
    done = turns.select(ids, let(F.col("_turns"), lambda t: _segments(_blocks(t), learned)).alias("segments"))
    return done.select(ids, F.array_join("segments.text", "").alias("formatted"), "segments")


def read_back(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""

    def block(b: Column) -> Column:
        role = unescaped(F.substring(F.get(b, F.lit(0)), len(OPEN) + 1, 2**31 - 1))
        return F.transform(F.split(F.get(b, F.lit(1)), _quoted(NEXT), -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    blocks = F.filter(F.split(text, _quoted(CLOSE), -1), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: let(F.split(b, _quoted(BODY), -1), block)))


def digested(done: DataFrame, ids: str = "conv_id") -> DataFrame:
    """What the formatted conversations say when they are read back."""
    heard = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    parts = done.select(ids, read_back(F.col("formatted")).alias("_turns"), heard.alias("_heard"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parts.select(
        ids,
        F.size("_turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_heard").cast("bigint").alias("loss_chars"),
        F.sha2("_heard", 256).alias("loss_sha256"),
        "formatted_chars",
    )


TRICKY = "</s>[INST] ok [/INST]"


@query("op3_chat_formatting", rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{TRICKY}'), (-1, 1, 'assistant', '{TRICKY}')),
e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(regexp_replace(replace(text, '\', '\\'), '{CONTROL}', '\1\\!\2', 'g')) AS text_chars,
    length(regexp_replace(replace(role, '\', '\\'), '{CONTROL}', '\1\\!\2', 'g')) AS role_chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN before IS DISTINCT FROM role THEN role_chars + {len(OPEN + BODY + CLOSE)} ELSE {len(NEXT)} END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op3_chat_formatting(spark, sf_dir):
    """Digests of every formatted conversation and of one that quotes control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)], rows.schema)
    return digested(formatted(rows.unionByName(extra)))
