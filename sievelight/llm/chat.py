"""Chat formatting by prefix-target expansion, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spill, table

# The marks of the template.
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
ASSISTANT = "assistant"
#: A control string of this or another template, up to its last character, with the backslashes put before that.
_CONTROL = r"(<|</?s|\[/?INST)(\\*)([|>\]])"
_ESCAPED = r"(<|</?s|\[/?INST)\\(\\*)([|>\]])"


def escape(text: Column) -> Column:
    r"""Puts a backslash before the last character of what could be a control string: `</s>` becomes `</s\>`,
    `<|` becomes `<\|`. Strings that have backslashes there get one more, so unescape is exact."""
    return F.regexp_replace(text, F.lit(_CONTROL), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2$3"))


def examples(conversations: DataFrame) -> DataFrame:
    """Each assistant turn with all turns before it: conv_id, example (its turn's place), formatted, loss_start
    and loss_length (code points of the one reply that is trainable).

    Turns are ordered by turn, then role and text (ties, repeated rows). Null roles and texts are empty, a null
    conv_id is a conversation of its own. Where other turns follow the last reply, one more example holds them
    with nothing to train (loss_length 0, loss_start null), so the output has every turn. A conversation is the unit of work: its
    examples grow with the square of its turns, as each holds all before it. Texts of any length are kept whole. Other columns are
    left out, so none can clash. An empty table gives an empty one.
    """
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    a = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(ROLE), escape(t["role"]), F.lit(TEXT))
    a = a.withColumn("parts", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"),
        escape(t["text"]).alias("body"))))
    a = a.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("parts"))))
    last = F.get("parts", F.col("n") - 1)
    a = a.withColumn("reply", last["role"] == ASSISTANT).filter(F.col("reply") | (F.col("n") == F.size("parts")))
    text = lambda k: F.array_join(F.transform(F.slice("parts", F.lit(1), k), lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    before = text(F.col("n") - 1)
    return a.select("conv_id", F.col("n").alias("example"), F.concat(before, last["head"], last["body"], F.lit(END)).alias("formatted"),
                    F.when(F.col("reply"), F.length(before) + F.length(last["head"])).cast("long").alias("loss_start"),
                    F.when(F.col("reply"), F.length(last["body"])).otherwise(0).cast("long").alias("loss_length"))


def turns_of(formatted: Column) -> Column:
    """Array of (role, text) read back from an example."""
    # no mark can stand inside an escaped text; what is before the first one is empty
    parts = F.filter(F.split(formatted, r"\Q" + ROLE + r"\E", -1), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(p, TEXT, 1)).alias("role"),
        unescape(F.regexp_replace(p, F.lit(r"(?s)^.*?\Q" + TEXT + r"\E(.*)\Q" + END + r"\E\z"), F.lit("$1"))).alias("text")))


def digest(made: DataFrame) -> DataFrame:
    """Per conversation what its examples hold: all turns from the longest one, and the text under the loss masks."""
    reply = F.when(F.col("loss_start").isNotNull(),
        unescape(F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_length as int))"))).otherwise("")
    a = made.select("conv_id", "example", "formatted", reply.alias("reply"))
    a = a.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("_all"),
        F.sort_array(F.collect_list(F.struct("example", "reply"))).alias("_replies"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    a = a.withColumn("_turns", turns_of(F.col("_all"))).withColumn("_loss", F.array_join(F.transform("_replies", lambda r: r["reply"]), ""))
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return a.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
                    F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
                    "formatted_chars")


# The conversation that the query adds.
ADDED = ((-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    added = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"),
        F.lit(r).alias("role"), F.lit(x).alias("text")) for c, t, r, x in ADDED])))
    return digest(spill(examples(own.unionByName(added)), "chat-examples"))


OP8_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, 8 + length(regexp_replace(role, '(<|</?s|\[/?INST)(\\*)([|>\]])', '\1\\\2\3', 'g')) + 8
                + length(regexp_replace(text, '(<|</?s|\[/?INST)(\\*)([|>\]])', '\1\\\2\3', 'g')) + 7 AS len,
             max(turn) OVER (PARTITION BY conv_id) AS last FROM c),
p AS (SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR turn = last THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
