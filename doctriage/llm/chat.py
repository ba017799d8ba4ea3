"""Conversations rendered once from the view of every participant.

In the view of one speaker, that speaker's turns are the assistant's and carry the training
mask; other speakers are users with their names; system turns stay as they are.  The
rendering of a conversation is its turns' pieces end to end, in the order of turns:
each row of the result is one piece with its place in the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctriage.llm.common import partitions, stored, whole_text

# The marks around a piece, and the speaker that takes no view of its own.
START, MIDDLE, STOP = "<|im_start|>", "\n", "<|im_end|>\n"
SYSTEM = "system"


def _header(speaker: Column, viewer: Column) -> Column:
    role = F.when(speaker == SYSTEM, F.lit("system")).when(speaker == viewer, F.lit("assistant"))
    return F.concat(F.lit(START), F.coalesce(role, F.concat(F.lit("user name="), speaker)), F.lit(MIDDLE))


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per turn and participant of its conversation:

    conv_col, viewer, position (of the turn, from 0), turn_col, role (assistant, user or system), name,
    rendered (the piece), start and end (the piece's place in the rendering), mask_start and
    mask_end (what is trained on: an assistant's text and its end mark; NULL for others).

    A conversation without any speaker but the system has no view.  NULL speakers are named
    'unknown', NULL texts are empty.  Turns are ordered by turn (NULL first), speaker and text; repeated
    rows are repeated turns.  Rows with a NULL conversation are one conversation.  Other columns are not read.

    A conversation may hold a third of all rows: turns are range-partitioned by sampled
    splitters, so a long one spans many partitions; places are summed within each part of it, and the
    parts' sums, one row for each partition, are summed in turn.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"),
        whole_text(text_col).alias("text"),
    )
    keys = ["conv", "turn", "speaker", "text"]
    ordered = rows.repartitionByRange(partitions(turns), *keys).sortWithinPartitions(*keys)
    ordered = stored(ordered.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "turns")

    viewers = ordered.where(F.col("speaker") != SYSTEM).select("conv", F.col("speaker").alias("viewer")).distinct()
    views = ordered.join(viewers.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    header = _header(F.col("speaker"), F.col("viewer"))
    views = views.withColumn("rendered", F.concat(header, "text", F.lit(STOP))).withColumn("head", F.length(header))

    view = ["conv", "viewer"]
    within = Window.partitionBy(*view, "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*view).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    size, zero = F.length("rendered").cast("long"), F.lit(0).cast("long")
    parts = views.groupBy(*view, "part").agg(F.sum(size).alias("chars"), F.count(F.lit(1)).alias("turns"))
    parts = parts.select(
        F.col("conv").alias("c"), F.col("viewer").alias("v"), F.col("part").alias("p"),
        F.coalesce(F.sum("chars").over(across), zero).alias("chars_before"), F.coalesce(F.sum("turns").over(across), zero).alias("turns_before"),
    )
    placed = views.withColumn("chars", F.coalesce(F.sum(size).over(within), zero)).withColumn("turns", F.count(F.lit(1)).over(within))
    placed = placed.join(parts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("viewer") == F.col("v")) & (F.col("part") == F.col("p")))
    start = F.col("chars") + F.col("chars_before")
    own = F.col("speaker") == F.col("viewer")
    return placed.select(
        F.col("conv").alias(conv_col),
        "viewer",
        (F.col("turns") + F.col("turns_before")).alias("position"),
        F.col("turn").alias(turn_col),
        F.when(F.col("speaker") == SYSTEM, "system").when(own, "assistant").otherwise("user").alias("role"),
        F.when(F.col("speaker") != SYSTEM, F.col("speaker")).alias("name"),
        "rendered",
        start.alias("start"),
        (start + size).alias("end"),
        F.when(own, start + F.col("head")).alias("mask_start"),
        F.when(own, start + size - 1).alias("mask_end"),  # without the line's end
    )


ORACLE = f"""
WITH turns AS (
  SELECT conv_id AS conv, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), viewers AS (SELECT DISTINCT conv, speaker AS viewer FROM turns WHERE speaker <> 'system'
), views AS (
  SELECT t.*, v.viewer,
         '{START}' || CASE WHEN t.speaker = 'system' THEN 'system' WHEN t.speaker = v.viewer THEN 'assistant'
                           ELSE 'user name=' || t.speaker END || chr(10) AS head
  FROM turns t JOIN viewers v ON t.conv IS NOT DISTINCT FROM v.conv
), pieces AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM views
), placed AS (
  SELECT *, CAST(sum(length(rendered)) OVER w AS BIGINT) AS stop, row_number() OVER w - 1 AS position
  FROM pieces WINDOW w AS (PARTITION BY conv, viewer ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv AS conv_id, viewer, position, turn,
       CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = viewer THEN 'assistant' ELSE 'user' END AS role,
       CASE WHEN speaker <> 'system' THEN speaker END AS name,
       rendered, stop - length(rendered) AS start, stop AS "end",
       CASE WHEN speaker = viewer THEN stop - length(rendered) + length(head) END AS mask_start,
       CASE WHEN speaker = viewer THEN stop - 1 END AS mask_end
FROM placed
"""
