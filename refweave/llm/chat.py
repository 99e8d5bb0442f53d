"""Chat formatting by prefix-target expansion (DataFrame operations only).

Every assistant turn becomes an example of its own: all turns before it are the context and only its reply is trainable. Turns after the
last assistant turn (or all turns, where there is none) come as one more example without a target, so that nothing is lost.

Template. Assistant: ``<s>TEXT</s>``. Any other role: ``[INST] ROLE\\nTEXT [/INST]``. Control strings inside roles and texts get a backslash
after their first character (one more if they have some), so that none is left; reading takes it away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
CONTROL_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"
TURN = r"(?s)<s>(.*?)</s>|\[INST\] (.*?)\n(.*?) \[/INST\]"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_ESCAPED, r"$1$2$3")


def _role_out(role: Column) -> Column:
    """On one line: a backslash is doubled and a line feed becomes backslash n, before the control strings are escaped."""
    return escape(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n"))


def _role_in(role: Column) -> Column:
    marked = F.regexp_replace(unescape(role), r"\\\\", "\x00")
    return F.replace(F.replace(marked, F.lit("\\n"), F.lit("\n")), F.lit("\x00"), F.lit("\\"))


def format_turn(role: Column, text: Column) -> Column:
    return F.when(role == ASSISTANT, F.concat(F.lit("<s>"), escape(text), F.lit("</s>"))).otherwise(F.concat(F.lit("[INST] "), _role_out(role), F.lit("\n"), escape(text), F.lit(" [/INST]")))


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, target_turn, text, loss_start, loss_chars): one row per assistant turn, in order, from 1.

    ``text`` is the context and the reply; the loss mask covers ``loss_chars`` code points from the 0-based ``loss_start``. A last example
    with a null ``target_turn`` and an empty mask holds turns that no reply follows. Null texts and roles are empty; null conv_ids make
    one conversation; turns are ordered by turn (nulls first), then role, then text, and repeated rows count each. Other columns go.
    A conversation is one row of the result's size at most: its turns are needed together by definition.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns"))
    shaped = grouped.select("conv_id", "_turns", F.transform("_turns", lambda t: format_turn(t["role"], t["text"])).alias("_said"))
    last = F.size("_turns") - 1
    numbered = shaped.select(
        "conv_id", "_turns", "_said",
        F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("_turns", i)["role"] == ASSISTANT) | (i == last)).alias("_ends"),
    )
    examples = numbered.select("conv_id", "_turns", "_said", F.posexplode("_ends").alias("_at", "_end"))
    own = F.get("_turns", F.col("_end"))
    is_reply = own["role"] == ASSISTANT
    reply = F.length(F.get("_said", F.col("_end"))) - 7  # <s> and </s>
    whole = examples.select(
        "conv_id",
        (F.col("_at") + 1).alias("example"),
        F.when(is_reply, own["turn"]).alias("target_turn"),
        F.array_join(F.slice("_said", F.lit(1), F.col("_end") + 1), "").alias("text"),
        F.when(is_reply, reply).otherwise(F.lit(0)).alias("loss_chars"),
        is_reply.alias("_reply"),
    )
    return whole.select("conv_id", "example", "target_turn", "text", (F.length("text") - F.when(F.col("_reply"), F.col("loss_chars") + 4).otherwise(F.lit(0))).alias("loss_start"), "loss_chars")


def read_back(text: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted text."""
    pieces = F.regexp_extract_all(text, F.lit(TURN), F.lit(0))
    return F.transform(
        pieces,
        lambda p: F.when(
            p.startswith("<s>"), F.struct(F.lit(ASSISTANT).alias("role"), unescape(F.substring(p, F.lit(4), F.length(p) - 7)).alias("text"))
        ).otherwise(
            F.struct(
                _role_in(F.substring(p, F.lit(8), F.instr(p, F.lit("\n")) - 8)).alias("role"),
                unescape(F.substring(p, F.instr(p, F.lit("\n")) + 1, F.length(p) - F.instr(p, F.lit("\n")) - 8)).alias("text"),
            )
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone: the turns of its last example, and what the loss masks cover."""
    masked = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_chars")))
    told = examples.select("conv_id", "example", "text", masked.alias("_loss"))
    by = told.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("_text"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "_loss"))), lambda x: x["_loss"]), "").alias("_all"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    turns = by.select("conv_id", read_back(F.col("_text")).alias("_turns"), "_all", "formatted_chars")
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("_all").cast("long").alias("loss_chars"),
        F.sha2(F.col("_all").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digest(expand(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)))


OP4_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN role = 'assistant' THEN 7 ELSE 16 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) END
  + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS chars FROM n),
c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM f)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (WHERE role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
