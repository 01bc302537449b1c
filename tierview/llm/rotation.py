"""Chat formatting from every participant's point of view.

For each participant of a dialogue all its turns are rendered, that speaker's as the assistant's and the
others' as those of named users; system turns stay system turns, and the loss mask covers the assistant's
text and end mark only. A row is one turn as one participant sees it, with its place in the whole
rendering, so a dialogue of any length is never gathered in one task: offsets are summed within blocks
of turns and over blocks. ``dialogues`` puts the segments of each rendering together.

Defined cases: a null text is empty; a null role speaks as user ``unknown`` and has no view of
its own; null conv_ids are one dialogue; null turns come first, and equal turns are ordered by role
and text; repeated rows are repeated turns; marks inside a text or a speaker's name are defused, and a name's
line ends become spaces; a dialogue of system turns
only, or an empty table, gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SYSTEM, UNKNOWN, END = "system", "unknown", "<|end|>\n"
#: Turn numbers that one block of a dialogue spans.
BLOCK = 256
#: What a speaker's name can't have in a head, and what stands for it.
MARKS = (("<|", "< |"), ("|>", "| >"), ("\n", " "))


def rotate(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, participant, turn, place, speaker, as_role, segment, loss, start, content_start, content_end, finish)."""
    body = F.replace(F.coalesce(df[text], F.lit("")), F.lit("<|"), F.lit("< |"))
    turns = df.select(df[conv].alias("conv_id"), df[turn].alias("turn"), df[role].alias("role"), body.alias("body"))
    people = turns.where(F.col("role").isNotNull() & (F.col("role") != SYSTEM)).select(F.col("conv_id").alias("__conv"), F.col("role").alias("participant")).distinct()
    seen = turns.join(people, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    speaker = F.coalesce("role", F.lit(UNKNOWN))
    as_role = F.when(F.col("role").eqNullSafe(F.col("participant")), "assistant").when(speaker == SYSTEM, "system").otherwise("user")
    seen = seen.withColumn("speaker", speaker).withColumn("as_role", as_role)
    name = F.col("speaker")
    for mark, plain in MARKS:
        name = F.replace(name, F.lit(mark), F.lit(plain))
    head = F.when(F.col("as_role") == "user", F.concat(F.lit("<|user:"), name, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), "as_role", F.lit("|>\n")))
    seen = seen.withColumn("__head", head).withColumn("segment", F.concat("__head", "body", F.lit(END)))
    seen = seen.withColumn("__size", F.length("segment").cast("long")).withColumn("__block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    whose = ["conv_id", "participant"]
    blocks = seen.groupBy(*whose, "__block").agg(F.sum("__size").alias("__sum"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*whose).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("__c"), F.col("participant").alias("__p"), F.col("__block").alias("__b"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__turns"))
    seen = seen.join(blocks, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("participant") == F.col("__p")) & (F.col("__block") == F.col("__b")))
    inside = Window.partitionBy(*whose, "__block").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "body")
    start = F.col("__before") + F.coalesce(F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return seen.select(
        *whose, "turn", (F.col("__turns") + F.row_number().over(inside) - 1).alias("place"), "speaker", "as_role", "segment",
        (F.col("as_role") == "assistant").cast("int").alias("loss"), start.alias("start"), (start + F.length("__head")).alias("content_start"),
        (start + F.col("__size")).alias("content_end"), (start + F.col("__size")).alias("finish"),
    ).withColumn("content_end", F.when(F.col("loss") == 1, F.col("finish")).otherwise(F.col("content_start")))


def dialogues(rotated: DataFrame) -> DataFrame:
    """(conv_id, participant, rendering, mask): whole renderings and [from, to) of the masked-in text; a dialogue must fit in a row."""
    parts = F.sort_array(F.collect_list(F.struct("place", "segment", "loss", "content_start", "content_end")))
    spans = F.transform(F.filter("parts", lambda x: x["loss"] == 1), lambda x: F.struct(x["content_start"].alias("from"), x["content_end"].alias("to")))
    return rotated.groupBy("conv_id", "participant").agg(parts.alias("parts")).select("conv_id", "participant", F.array_join(F.transform("parts", lambda x: x["segment"]), "").alias("rendering"), spans.alias("mask"))


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role IS NOT NULL AND role <> 'system'),
s AS (
  SELECT t.conv_id, p.participant, t.turn, t.role, t.body, coalesce(t.role, 'unknown') AS speaker,
    CASE WHEN t.role = p.participant THEN 'assistant' WHEN t.role = 'system' THEN 'system' ELSE 'user' END AS as_role
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, CASE WHEN as_role = 'user' THEN '<|user:' || replace(replace(replace(speaker, '<|', '< |'), '|>', '| >'), chr(10), ' ') || '|>' || chr(10) ELSE '<|' || as_role || '|>' || chr(10) END AS head FROM s),
g AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM h),
w AS (
  SELECT *, row_number() OVER o - 1 AS place,
    CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, role NULLS FIRST, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM g WINDOW o AS (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, role NULLS FIRST, body))
SELECT conv_id, participant, turn, place, speaker, as_role, segment, CAST(as_role = 'assistant' AS INTEGER) AS loss, start,
  start + length(head) AS content_start, CASE WHEN as_role = 'assistant' THEN start + length(segment) ELSE start + length(head) END AS content_end,
  start + length(segment) AS finish
FROM w
"""
