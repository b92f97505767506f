"""Chat formatting by perspective rotation: for every participant, the dialogue with that speaker as assistant.

The others become named users, a system turn stays one. A rendering is a sequence of segments, one for each turn, in the order
of turn, speaker and text: a header, the turn's text, an end mark. Each row is one segment with its place in the rendering (``start``,
code points), so a rendering and its mask are whole without being gathered into one row or task. Of a segment the mask gives the span to learn (text and end
mark) where the perspective speaks, and none elsewhere. Places are running sums by ranges: a dialogue of any length spreads over many tasks.
``assemble`` joins segments, for dialogues that fit in a row.

Texts and names are escaped, so that none forges a mark, and so that ``unescape`` undoes it: a backslash doubles, ``<|`` becomes ``<\\|``, and in names ``|>`` becomes ``|\\>``
and a line feed ``\\n``.

Defined cases: a null role is a participant without a name (perspective null, header ``<|user|>``), apart from any named one; a null text is empty; rows without conv_id are one dialogue, rows without turn come first;
repeated rows give repeated segments, one after the other; a dialogue of system turns alone has no participant and no segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import _base
from curata.operators.ordering import running_sums

SYSTEM = "system"
END = "<|end|>\n"


def escape(text: F.Column) -> F.Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: F.Column) -> F.Column:
    """The text that escape was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, turn, speaker, segment, start (of the segment in its rendering), mask_start, mask_end (in the rendering, end exclusive; null where nothing is learnt). All in code points."""
    t = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{speaker_col}`").alias("speaker"), escape(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("body")
    )
    people = t.where(~F.col("speaker").eqNullSafe(SYSTEM)).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    name = F.replace(F.replace(escape(F.col("speaker")), F.lit("|>"), F.lit("|\\>")), F.lit("\n"), F.lit("\\n"))
    header = F.when(own, F.lit("<|assistant|>\n")).when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n")).when(F.col("speaker").isNull(), F.lit("<|user|>\n")).otherwise(F.concat(F.lit("<|user:"), name, F.lit("|>\n")))
    segments = t.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("header", header).withColumn("own", own).withColumn("segment", F.concat("header", "body", F.lit(END)))
    segments = segments.select("conv_id", "perspective", "turn", "speaker", "segment", F.when(F.col("own"), F.length("header")).alias("learn"), F.length("segment").cast("long").alias("size"))
    placed = running_sums(segments, ["conv_id", "perspective", "turn", "speaker", "segment"], {"end": "size"}, by=2)
    start = F.col("end") - F.col("size")
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", "segment", start.alias("start"),
        F.when(F.col("learn").isNotNull(), start + F.col("learn")).alias("mask_start"), F.when(F.col("learn").isNotNull(), F.col("end")).alias("mask_end"),
    )


def assemble(segments: DataFrame) -> DataFrame:
    """One row for each dialogue and perspective, with its text and its mask spans in the text; only for dialogues that fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("start", "segment", F.struct(F.col("mask_start").alias("start"), F.col("mask_end").alias("end")).alias("mask"))))
    whole = segments.groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    mask = F.filter(F.transform("parts", lambda p: p["mask"]), lambda m: m["start"].isNotNull())
    return whole.select("conv_id", "perspective", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("text"), mask.alias("mask"))


def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(_base.read(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, role AS speaker, replace(replace(coalesce(text, ''), '\', '\\'), '<|', '<\|') AS body FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS DISTINCT FROM 'system'),
s AS (
  SELECT t.conv_id, p.perspective, t.turn, t.speaker, t.body,
    CASE WHEN t.speaker IS NOT DISTINCT FROM p.perspective THEN '<|assistant|>' WHEN t.speaker = 'system' THEN '<|system|>' WHEN t.speaker IS NULL THEN '<|user|>'
      ELSE '<|user:' || replace(replace(replace(replace(t.speaker, '\', '\\'), '<|', '<\|'), '|>', '|\>'), chr(10), '\n') || '|>' END || chr(10) AS header
  FROM t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
),
g AS (SELECT *, header || body || '<|end|>' || chr(10) AS segment FROM s),
r AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, segment ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM g
)
SELECT conv_id, perspective, turn, speaker, segment, upto - length(segment) AS start,
  CASE WHEN speaker IS NOT DISTINCT FROM perspective THEN CAST(upto - length(segment) + length(header) AS BIGINT) END AS mask_start,
  CASE WHEN speaker IS NOT DISTINCT FROM perspective THEN CAST(upto AS BIGINT) END AS mask_end
FROM r
"""
