"""Multi-party chat formatting: every dialogue from the side of each of its participants.

For each participant the dialogue is rendered with that speaker as ``assistant``, all others as
named users, and context roles (``system``) as they are. The result has one row per turn and
perspective: the rendered turn, where it stands in the dialogue, and the part to learn from, which
is what the assistant says and the mark that ends it. Rows joined in order of ``start`` give the
dialogue, so a dialogue of any length needs no task that holds it whole. Positions are code points.

Everything is DataFrame functions. Positions are running sums in two steps, inside pieces of
a dialogue and over the pieces' totals, so a very long dialogue is spread over tasks too.

Results for odd input: a null text is empty; a null role is a participant named ``unknown``; rows
with null ``conv_id`` form one dialogue; a dialogue of context roles alone has no participants and
no rows; a null turn comes first, and equal turns are ordered by role, then text; repeated rows are
turns of their own; marks in a text are broken by a backslash; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The marks of a turn.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
CONTEXT_ROLES = ("system",)
UNNAMED = "unknown"
PIECE = 256


def rotate(conversations: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES, piece: int = PIECE) -> DataFrame:
    """One row per turn and perspective of ``conv_id, turn, role, text``."""
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(UNNAMED)).alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<\\|")).alias("said"),
    )
    context = F.col("speaker").isin(*context_roles) if context_roles else F.lit(False)
    sides = turns.filter(~context).select(F.col("conv_id").alias("side_conv"), F.col("speaker").alias("perspective")).distinct()
    own: Column = F.col("speaker") == F.col("perspective")
    header = F.when(own, F.lit("assistant")).when(context, F.col("speaker")).otherwise(F.concat(F.lit("user name="), "speaker"))
    rendered = F.concat(F.lit(BEGIN), header, F.lit("\n"), F.col("said"), F.lit(END))
    rows = (
        turns.join(sides, turns.conv_id.eqNullSafe(sides.side_conv))
        .select("conv_id", "perspective", "turn", "speaker", rendered.alias("rendered"), F.char_length(F.concat(F.col("said"), F.lit(END))).alias("said_size"))
        .withColumns({"size": F.char_length("rendered").cast("long"), "piece_": F.floor(F.col("turn") / piece), "own": own})
    )
    sums = rows.groupBy("conv_id", "perspective", "piece_").agg(F.sum("size").alias("total"))
    over = Window.partitionBy("conv_id", "perspective").orderBy(F.asc_nulls_first("piece_")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        F.col("conv_id").alias("c_"), F.col("perspective").alias("p_"), F.col("piece_").alias("k_"), F.coalesce(F.sum("total").over(over), F.lit(0)).alias("before")
    )
    placed = rows.join(before, rows.conv_id.eqNullSafe(before.c_) & (rows.perspective == before.p_) & rows.piece_.eqNullSafe(before.k_))
    inside = (
        Window.partitionBy("conv_id", "perspective", "piece_")
        .orderBy(F.asc_nulls_first("turn"), "speaker", "rendered")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    stop = F.sum("size").over(inside) + F.col("before")
    return placed.withColumn("stop", stop).select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "rendered",
        (F.col("stop") - F.col("size")).alias("start"),
        "stop",
        F.col("own").cast("int").alias("loss"),
        F.when(F.col("own"), F.col("stop") - F.col("said_size")).alias("loss_start"),
        F.when(F.col("own"), F.col("stop")).alias("loss_stop"),
    )


OP2_SQL = """
WITH turns AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|', '<\\|') AS said
  FROM conversations
), sides AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'
), rows AS (
  SELECT t.conv_id, perspective, turn, speaker,
         '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN speaker
                                ELSE 'user name=' || speaker END || chr(10) || said || '<|im_end|>' || chr(10) AS rendered,
         length(said) + 11 AS said_size
  FROM turns t JOIN sides s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, CAST(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective
              ORDER BY turn NULLS FIRST, speaker, rendered ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM rows
)
SELECT conv_id, perspective, turn, speaker, rendered, stop - length(rendered) AS start, stop,
       CASE WHEN speaker = perspective THEN 1 ELSE 0 END AS loss,
       CASE WHEN speaker = perspective THEN stop - said_size END AS loss_start,
       CASE WHEN speaker = perspective THEN stop END AS loss_stop
FROM placed
"""


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
