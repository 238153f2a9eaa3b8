"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_order, materialize

#: No document is taken more often than this.
MOST_TIMES = 3


def targets(sizes: DataFrame, period: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, weight, target) from (source, size): shares by weight, none above MOST_TIMES its size.

    Weights repeat over the sources by code point, null last. The excess of sources that reach their bound is shared again by
    weight: all others end at one level per weight, which a few aggregates over the sources find. Only scalars reach the driver.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")).withColumn("_null", F.col("source").isNull())
    by = in_order(by, [], ["_null", "source"], {}, rank="_at")
    weight = F.element_at(F.array(*map(F.lit, period)), (F.col("_at") % len(period) + 1).cast("int"))
    by = materialize(by.select("source", "source_size", weight.cast("long").alias("weight")))
    total = by.agg(F.sum("source_size")).first()[0] or 0
    level, cap = None, MOST_TIMES * F.col("source_size")
    while True:
        full = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        bound, rest = by.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        found = (total - (bound or 0)) / rest if rest else None
        if not rest or (level is not None and found <= level):
            break
        level = found
    share = F.lit(float(level or 0.0)) * F.col("weight")
    return by.withColumn("target", F.when(cap <= share, cap.cast("double")).otherwise(share) if rest else cap.cast("double"))


def _size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _order(docs: DataFrame, doc_id: str, text: str, seed: int) -> list[Column]:
    own = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return [F.md5(F.concat(F.lit(f"{seed}:"), own)).alias("_hash"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_tie")]


def _due(first: Column, target: Column, pull: Column) -> Column:
    """When a source's demand reaches `first` words: the inverse of target * (t + pull * t * (1 - t))."""
    d = first / target
    root = ((1 + pull) - F.sqrt(F.greatest((1 + pull) * (1 + pull) - 4 * pull * d, F.lit(0.0)))) / (2 * pull)
    return F.abs(F.when(F.abs(pull) < 1e-12, d).otherwise(root))


def _place(small: DataFrame, slope: float, period: tuple[int, ...]) -> DataFrame:
    """small: source, size, _hash, _tie and more, written; appends source_size, target, taken, _first, _pull."""
    placed = in_order(small, ["source"], ["_hash", "_tie"], {"_first": "size"})
    g = targets(small.select("source", "size"), period).withColumnRenamed("source", "_g")
    light, heavy = min(period), max(period)
    pull = F.lit(slope) * (1 - 2 * (F.col("weight") - light) / max(heavy - light, 1)) if heavy > light else F.lit(0.0)
    part = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - k * F.col("source_size") - F.col("_first")))
    taken = part(0)
    for k in range(1, MOST_TIMES):
        taken = taken + part(k)
    return placed.join(g, placed.source.eqNullSafe(g._g)).withColumns({"taken": taken.cast("long"), "_pull": pull}).drop("_g", "weight")


def plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", slope: float = 0.5, seed: int = 17, period: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, size, source_size, target, taken, position, position_2 and position_3 of every document, range-sorted by position.

    size: words of the text (null: 0). taken: words that the mix takes of it, repeats counted: a source's documents, in the
    order of a seeded hash of the id, go round at most MOST_TIMES and stop where the target is reached, so a source's sum is its target
    to within one word; its last document counts in part. position: when in training, from 0 to 1, its first word is due (null: never); position_2 and position_3: the
    same for its second and third time. Documents stand in the order of their first position, those that aren't taken last, ties by id.

    A source's demand over the time t in 0..1 is target * (1 + s * (1 - 2t)): s falls from +slope for the lightest weight to -slope
    for the heaviest, so heavy sources come later. Its integral, target * (t + s * t * (1 - t)), is inverted in closed form at the
    words taken before the document. A null source is a source; equal ids are ordered by text; rows equal in both are taken in any
    order, which changes no sum; a null id is an id; further columns are not read; no rows: none.
    """
    small = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _size(F.col(text)).alias("size"), *_order(docs, doc_id, text, seed)))
    out = _place(small, slope, period)
    at = lambda k: F.col("_first") + k * F.col("source_size")
    due = lambda k: F.when((F.col("size") > 0) & (at(k) < F.round("target").cast("long")), _due(at(k), F.col("target"), F.col("_pull")))
    out = out.select("doc_id", "size", "source_size", "target", "taken", *(due(k).alias(f"position_{k + 1}" if k else "position") for k in range(MOST_TIMES)))
    return out.orderBy(F.asc_nulls_last("position"), "doc_id")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", slope: float = 0.5, seed: int = 17, period: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The documents of the mix, a row for each time one is taken, sorted by the training position; columns of docs.

    By plan()'s rules, but no text is cut: the last document of a source is in if at least half of its due words are, and one
    without words goes in once if the mix takes anything of its source.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that no name clashes with one used here
    named = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    rows = materialize(named.withColumns({"_row": F.monotonically_increasing_id(), "_size": _size(F.col(own[text]))}))
    small = materialize(rows.select("_row", F.col(own[source]).alias("source"), F.col("_size").alias("size"), *_order(rows, own[doc_id], own[text], seed)))
    placed = _place(small, slope, period)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.when(F.col("target") > 0, 1).otherwise(0)).cast("int")
    first = F.explode(F.transform(F.sequence(F.lit(0), times - 1), lambda k: F.least(F.col("_first") + k * F.col("source_size"), F.round("target").cast("long"))))
    due = placed.where(times > 0).select("_row", "target", "_pull", first.alias("_at")).select("_row", _due(F.col("_at"), F.col("target"), F.col("_pull")).alias("_position"))
    return rows.join(due, "_row").orderBy("_position", "_row").select(*(F.col(n).alias(c) for c, n in own.items()))
