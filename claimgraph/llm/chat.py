"""Multi-party perspective rotation (operator 4), in DataFrame operations only.

Every participant of a conversation gets a rendering in which that speaker is the assistant and every other one is a
user with a name. The mask holds the character spans to learn from: the texts of the speaker's own turns with their
end marks. ``system`` turns are context for everyone and no participant.

A rendering is one row, so its conversation's turns meet in one task; nothing else does.

Defined cases: turns go by turn number, nulls last, ties by speaker and text; repeated rows are turns of their own; a
null role is the speaker ``unknown``, one with a speaker of that name; a null text is empty; a null conversation id is one conversation; a conversation
of system turns only has no participant and gives no row; a marker's opening ``<|`` inside a text or a name is written
``< |`` and its end ``|>`` inside a name ``| >``, so that no text can forge a marker; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimgraph.llm.common import table

SYSTEM, UNKNOWN = "system", "unknown"
END = "<|end|>\n"


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation and participant: n_turns, n_own, text, mask (array of start, end in characters)."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.replace(safe(F.coalesce(F.col(speaker_col).cast("string"), F.lit(UNKNOWN))), F.lit("|>"), F.lit("| >")).alias("speaker"),
        safe(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("body"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), "speaker", "body")
    rows = rows.withColumn("k", F.row_number().over(order))
    who = rows.filter(F.col("speaker") != SYSTEM).select(F.col("conv").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(who, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    own = (F.col("speaker") == F.col("perspective")) & (F.col("speaker") != SYSTEM)
    head = F.when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), "speaker", F.lit("|>\n")))
    seen = seen.withColumn("own", own).withColumn("piece", F.concat(head, "body", F.lit(END)))
    so_far = Window.partitionBy("conv", "perspective").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("end", F.sum(F.char_length("piece")).over(so_far))
    span = F.struct((F.col("end") - F.char_length("body") - len(END)).alias("start"), "end")
    spans = F.filter(F.collect_list(F.when(F.col("own"), span)), lambda s: s.isNotNull())
    pieces = F.array_sort(F.collect_list(F.struct("k", "piece")))
    return seen.groupBy("conv", "perspective").agg(
        F.count("*").alias("n_turns"), F.count_if("own").alias("n_own"),
        F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"), F.array_sort(spans).alias("mask"),
    ).withColumnRenamed("conv", conv_col)


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("conv_id", "perspective", "n_turns", "n_own", "text", mask.alias("mask"))


SQL = """
WITH r AS (
  SELECT conv_id, replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body, turn FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, speaker, body) AS k FROM r),
w AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> 'system'),
s AS (
  SELECT w.conv_id, perspective, k, body, speaker = perspective AS own,
    CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = perspective THEN '<|assistant|>' ELSE '<|user name=' || speaker || '|>' END
      || chr(10) || body || '<|end|>' || chr(10) AS piece
  FROM w JOIN k ON w.conv_id IS NOT DISTINCT FROM k.conv_id),
e AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, perspective ORDER BY k) AS e FROM s)
SELECT conv_id, perspective, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own, string_agg(piece, '' ORDER BY k) AS text,
  coalesce(string_agg(CAST(CAST(e - length(body) - 8 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE own), '') AS mask
FROM e GROUP BY conv_id, perspective
"""
