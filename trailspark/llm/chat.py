"""Chat formatting: logged snapshots of a growing conversation are collapsed, then rendered.

A log that writes a conversation anew after each turn holds all its prefixes. Each turn has a
hash of its place, role and text; the hash of a prefix is the XOR of its turns' hashes (two of
64 bits), which can be summed up in blocks, so that a long conversation is many tasks' work.
Conversations whose hash is a prefix of a longer one are dropped by an anti-join; of equal ones
the least id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.llm.common import NO_ID, smaller_before, stored, table

PART_TURNS = 1024  # turns in one rendered row; a longer conversation has several, numbered parts
BLOCK = 1024
START, END = "<|im_start|>", "<|im_end|>"

_TURN = ["conv", "at_turn", "role", "t1", "t2"]


def rendered(role: Column, text: Column) -> Column:
    """One turn in ChatML; marks inside the text are broken up so that it cannot forge turns."""
    safe = F.replace(text, F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit(START), F.replace(role, F.lit("<|im_"), F.lit("<| im_")), F.lit("\n"), safe, F.lit(END + "\n"))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv, at_turn, role, text and two text hashes; nulls get values of their own."""
    text = F.coalesce("text", F.lit(""))
    return conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(NO_ID)).alias("at_turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), text.alias("text"),
        F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("2"), text).alias("t2"),
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Adds pos, p1 and p2: a turn's place in its conversation and the hashes of the prefix it ends."""
    place = turns.select(*_TURN, F.lit(1).alias("n"), F.struct(*_TURN[1:]).alias("order"))
    placed = smaller_before(place, ["conv"], "order", F.shiftright("at_turn", 10)).select(*_TURN, F.col("before").alias("pos"))
    salted = placed.withColumn("h1", F.xxhash64("pos", "role", "t1", "t2")).withColumn("h2", F.xxhash64("t2", "t1", "role", "pos"))
    salted = stored(salted.withColumn("block", F.expr(f"pos div {BLOCK}")), "chat-turns")
    blocks = salted.groupBy("conv", "block").agg(F.expr("bit_xor(h1)").alias("b1"), F.expr("bit_xor(h2)").alias("b2"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("b1", "b2")])
    inside = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inner = salted.select(*_TURN, "pos", "block", F.bit_xor("h1").over(inside).alias("i1"), F.bit_xor("h2").over(inside).alias("i2"))
    return inner.join(blocks, ["conv", "block"]).select(
        *_TURN, "pos", F.col("i1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("i2").bitwiseXOR(F.col("b2")).alias("p2")
    )


def maximal_turns(conversations: DataFrame) -> DataFrame:
    """The turns (conv, at_turn, role, t1, t2, pos) of conversations that prefix no longer one."""
    turns = stored(turn_rows(conversations).select(*_TURN).distinct(), "chat-rows")
    prefixes = stored(prefix_hashes(turns), "chat-prefixes")
    ends = prefixes.groupBy("conv").agg(F.max("pos").alias("last"))
    marked = prefixes.join(ends, "conv")
    whole = marked.where("pos = last").groupBy("pos", "p1", "p2").agg(F.min("conv").alias("conv"))
    inner = marked.where("pos < last").select("pos", "p1", "p2").distinct()
    kept = whole.join(inner, ["pos", "p1", "p2"], "left_anti").select("conv")
    return prefixes.join(kept, "conv", "left_semi").select(*_TURN, "pos")


def formatted(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, n_turns, text of every maximal conversation.

    Turns are in order of turn, then role and text hash; a null turn comes first, a null role
    is ``unknown``, a null text empty, a null conv_id an id of its own. Rows that repeat
    conversation, turn, role and text are one turn. A row holds up to ``part_turns`` turns.
    """
    turns = maximal_turns(conversations)
    texts = turn_rows(conversations).dropDuplicates(_TURN)
    lines = turns.join(texts, _TURN).select(
        "conv", F.expr(f"cast(pos div {part_turns} AS int)").alias("part"), F.struct("pos", rendered(F.col("role"), F.col("text")).alias("line")).alias("l")
    )
    text = F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), "")
    out = lines.groupBy("conv", "part").agg(F.count("*").alias("n_turns"), text.alias("text"))
    return out.select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), "part", "n_turns", "text")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations"))


OP5_SQL = f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
lines AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
    '{START}' || replace(role, '<|im_', '<| im_') || chr(10) || replace(text, '<|im_', '<| im_') || '{END}' || chr(10) AS line
  FROM turns
),
prefixes AS (
  SELECT conv_id, pos, line, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM lines
),
whole AS (SELECT prefix, min(conv_id) AS conv_id FROM prefixes WHERE pos + 1 = n GROUP BY prefix),
kept AS (SELECT conv_id FROM whole WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE pos + 1 < n))
SELECT conv_id, CAST(pos // {PART_TURNS} AS INTEGER) AS part, count(*) AS n_turns, string_agg(line, '' ORDER BY pos) AS text
FROM lines WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id, pos // {PART_TURNS}
"""
