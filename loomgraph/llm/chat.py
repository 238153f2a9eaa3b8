"""Chat formatting: every participant's view of a dialogue, as rendered segments with a training mask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_order, materialize

#: Fixed values of the rendering.
START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, NOBODY = "system", "unknown"
#: Code points of a rendered dialogue in one row.
PART = 1 << 20


def rotate(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """Render each dialogue once for every participant: that speaker as assistant, the others as named users.

    A row is a segment (one message in one view): conv_id, participant, seq (from 0), tag (assistant, user or system), segment,
    start_char and end_char (its place in the rendered dialogue, in code points), mask_start and mask_end (what is trained on: the text
    and end mark of the participant's own messages; else empty, at the start). The rendered dialogue is the segments joined by seq. Views are kept as
    segments since one dialogue may be larger than a task: nothing is gathered by dialogue.

    System messages stand in every view and have none of their own; a dialogue of system messages alone has no view. Null or
    empty speaker: "unknown"; null text: empty; null turn: first; a null conv_id is a dialogue like any other; equal turns go by speaker,
    then text; repeated rows are repeated messages. "<|" in a text or a name becomes "< |", so a text can't forge a mark; line breaks in a name
    become spaces, so a name can't leave its header. Further columns are dropped. No rows: no segments.
    """
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    name = lambda c: F.translate(c, "\n\r", "  ")
    m = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        plain(name(F.coalesce(F.nullif(F.col(speaker), F.lit("")), F.lit(NOBODY)))).alias("speaker"), plain(F.coalesce(F.col(text), F.lit(""))).alias("body"),
    )
    people = materialize(m.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("participant")).distinct())
    own, system = F.col("speaker") == F.col("participant"), F.col("speaker") == SYSTEM
    head = F.when(system, "system\n").when(own, "assistant\n").otherwise(F.concat(F.lit("user name="), "speaker", F.lit("\n")))
    views = m.join(people, m.conv_id.eqNullSafe(people._conv)).select(
        "conv_id", "participant", "turn", "speaker", "body", F.when(system, "system").when(own, "assistant").otherwise("user").alias("tag"),
        F.concat(F.lit(START), head, "body", F.lit(END + "\n")).alias("segment"), F.length(F.concat(F.lit(START), head)).cast("long").alias("_head"),
    ).withColumn("_len", F.length("segment").cast("long"))
    placed = in_order(views, ["conv_id", "participant"], ["turn", "speaker", "body"], {"start_char": "_len"}, rank="seq")
    mine, end = F.col("tag") == "assistant", F.col("start_char") + F.col("_len")
    return placed.select(
        "conv_id", "participant", "seq", "tag", "segment", "start_char", end.alias("end_char"),
        F.when(mine, F.col("start_char") + F.col("_head")).otherwise(F.col("start_char")).alias("mask_start"),
        F.when(mine, end - 1).otherwise(F.col("start_char")).alias("mask_end"),
    )


def dialogues(segments: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, participant, part, rendered, mask): the rendered dialogues, with the spans that are trained on as `from-to,from-to` over the whole dialogue.

    A dialogue of up to `part` code points is one row. A longer one is several, in order of `part`: each holds the segments that start in
    its share of the dialogue, so a row holds `part` code points and one segment at most, however long a dialogue is.
    """
    at = F.floor(F.col("start_char") / part).cast("int").alias("part")
    span = F.when(F.col("mask_end") > F.col("mask_start"), F.concat_ws("-", F.col("mask_start").cast("string"), F.col("mask_end").cast("string")))
    parts = F.sort_array(F.collect_list(F.struct("seq", "segment", span.alias("span"))))
    each = segments.groupBy("conv_id", "participant", at).agg(parts.alias("s"))
    joined = lambda field, by: F.array_join(F.transform("s", lambda x: x[field]), by)
    return each.select("conv_id", "participant", "part", joined("segment", "").alias("rendered"), joined("span", ",").alias("mask"))
