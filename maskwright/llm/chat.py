"""Chat formatting with collapse of cumulative snapshots, in DataFrame functions only.

A log often holds a conversation again and again as it grows. Each turn gets a
rolling hash of all turns up to it; a conversation whose hash equals that of a
proper prefix of another one is a snapshot and goes. Of equal conversations the
smallest conv_id stays. What is left is rendered.

The order of turns is (turn, role, text), null turns first, so ties have one
order. Exact repeats of a row count once. A null role reads ``unknown`` and a
null text is empty. Rows with a null conv_id belong to no known conversation:
each distinct one is a conversation of a single turn whose id is null, never
merged with strangers. Equality means the same roles and texts in the same
order, whatever the turn numbers. Texts of any length are hashed and rendered
whole; a conversation is the largest unit one task holds. An empty table gives
an empty result; columns besides conv_id, turn, role and text are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

ORACLE_SQL = """
WITH told AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), turns AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) ELSE 0 END AS lone FROM told
), rendered AS (
  SELECT conv_id, lone, count(*) AS n_turns,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS chat
  FROM turns GROUP BY conv_id, lone
), one AS (
  SELECT min(conv_id) AS conv_id, max(n_turns) AS n_turns, chat, count(*) AS n_equal FROM rendered GROUP BY chat
), prefixes AS (
  SELECT DISTINCT string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '')
      OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS chat,
    row_number() OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id, lone) AS n
  FROM turns
)
SELECT o.conv_id, CAST(o.n_turns AS BIGINT) AS n_turns, CAST(o.n_equal AS BIGINT) AS n_equal, o.chat
FROM one o WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.k < p.n AND p.k = o.n_turns AND p.chat = o.chat)
"""


#: A conversation: its id, or for a row without one a 128-bit hash of the row, which is 0 for all others. No part is ever null, so joins and aggregations by it share one exchange.
KEY = ["id", "lone1", "lone2"]


def rolling_hashes(conversations: DataFrame) -> DataFrame:
    """(id, lone1, lone2, turn, role, text, k, n, h1, h2): the position, the number of turns and a 128-bit hash of the turns up to this one."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    lone = lambda n: F.when(F.col("conv_id").isNull(), F.xxhash64(F.lit(n), "turn", "role", "text")).otherwise(0)
    none = F.lit(0).cast(conversations.schema["conv_id"].dataType)
    turns = turns.select(F.coalesce("conv_id", none).alias("id"), lone(1).alias("lone1"), lone(2).alias("lone2"), "turn", "role", "text")
    order = Window.partitionBy(*KEY).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("k", F.row_number().over(order))
    # bits of position-tagged turn hashes: order matters, and a running xor needs no state beyond a number
    return placed.select(
        *KEY, "turn", "role", "text", "k",
        F.count("*").over(Window.partitionBy(*KEY)).alias("n"),
        F.bit_xor(F.xxhash64("k", "role", "text")).over(upto).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("second"), "text", "role", "k")).over(upto).alias("h2"),
    )


def is_lone():
    return (F.col("lone1") != 0) | (F.col("lone2") != 0)


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """(id, lone1, lone2, n_equal) of the conversations that no other one continues; of equal ones the smallest id, rows without one last."""
    lone = lambda c: F.when(is_lone(), F.col(c))
    final = hashed.filter(F.col("k") == F.col("n")).groupBy("n", "h1", "h2").agg(
        F.min(F.when(~is_lone(), F.col("id"))).alias("known"), F.min(lone("lone1")).alias("l1"), F.min_by(lone("lone2"), lone("lone1")).alias("l2"), F.count("*").alias("n_equal")
    )
    proper = hashed.filter(F.col("k") < F.col("n")).select(F.col("k").cast("long").alias("n"), "h1", "h2").distinct()
    left, none = final.join(proper, ["n", "h1", "h2"], "left_anti"), F.lit(0).cast(hashed.schema["id"].dataType)
    part = lambda c: F.when(F.col("known").isNull(), F.col(c)).otherwise(0)
    return left.select(F.coalesce("known", none).alias("id"), part("l1").alias("lone1"), part("l2").alias("lone2"), "n_equal")


def format_chats(conversations: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """One row (conv_id, n_turns, n_equal, chat) for each maximal conversation."""
    hashed = rolling_hashes(conversations)
    turns = hashed.join(maximal_conversations(hashed), KEY)
    line = F.concat(F.lit(begin), F.col("role"), F.lit("\n"), F.col("text"), F.lit(end), F.lit("\n"))
    listed = F.array_sort(F.collect_list(F.struct("k", line.alias("line"))))
    out = turns.groupBy(*KEY).agg(
        F.count("*").alias("n_turns"), F.max("n_equal").alias("n_equal"), F.array_join(F.transform(listed, lambda x: x["line"]), "").alias("chat")
    )
    return out.select(F.when(~is_lone(), F.col("id")).alias("conv_id"), "n_turns", "n_equal", "chat")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
