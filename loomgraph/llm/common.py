"""Shared pieces: word patterns, running totals, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import discard, materialize, scratch

__all__ = ["SPACE", "SPACE_CHARS", "components", "discard", "extended", "in_order", "let", "materialize", "scratch", "words"]

#: White space of all word rules here: space and the five controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def extended(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of df with further columns."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in columns.items())).fields])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def in_order(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], rank: str | None = None) -> DataFrame:
    """For each row, totals over the rows before it in the order of `order` among those with equal `keys`.

    sums: new column -> column added up (null: 0); rank: new column for the number of rows before. Rows are dealt by ranges of
    keys and order, so that a key with very many rows is spread; each range's totals (a few rows each) give its start.
    The dealt rows are written to the shared folder first: a lost executor can't change who is where. Rows equal in
    keys and order stand in any order.
    """
    totals = dict(sums)
    part = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    part = materialize(part)
    one = F.lit(1).cast("long")
    add = {k: F.coalesce(F.col(v), F.lit(0)) for k, v in totals.items()} | ({rank: one} if rank else {})
    tot = part.groupBy(*keys, "_range").agg(*(F.sum(v).alias(k) for k, v in add.items()))
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = tot.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), *(F.coalesce(F.sum(k).over(w), F.lit(0)).alias(f"_b_{k}") for k in add))
    on = part["_range"] == before["_r"]
    for i, k in enumerate(keys):
        on = on & part[k].eqNullSafe(before[f"_k{i}"])
    inner = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = part.join(before, on)
    return out.select(*(part[c] for c in df.columns), *((F.coalesce(F.sum(v).over(inner), F.lit(0)) + F.col(f"_b_{k}")).alias(k) for k, v in add.items()))


def words(text: Column) -> Column:
    """The words of a text: runs of characters that are not white space (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: edges (u, v) -> (node, label), the label being the smallest node.

    Each round takes the smallest label among a node's neighbours and then follows that label's own label, so
    the number of rounds grows with the logarithm of the longest path. Minimum aggregates combine before the
    shuffle, so a node with very many neighbours costs each task one row. Every round is written to the shared folder.
    """
    both = materialize(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).where("u <> v").distinct())
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels, both.v == labels.node).groupBy(F.col("u").alias("near_node")).agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.near_node, "left").select(
            "node", F.col("label").alias("old"), F.least(F.col("label"), F.coalesce("near", "label")).alias("low")
        )
        up = labels.select(F.col("node").alias("up_node"), F.col("label").alias("up"))
        step = materialize(step.join(up, step.low == up.up_node, "left").select("node", "old", F.least("low", F.coalesce("up", "low")).alias("label")))
        changed = step.where("label <> old").limit(1).count()
        discard(labels)
        labels = step
        if not changed:
            discard(both)
            return labels.select("node", "label")
