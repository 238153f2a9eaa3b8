"""Retrieval metrics at k over (query_id, actual ARRAY, predicted ARRAY in order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hits(actual: Column, predicted: Column, k: int) -> Column:
    """1-based positions of the first k predictions that are relevant."""
    top = F.slice(predicted, 1, k)
    return F.filter(F.transform(top, lambda p, i: F.when(F.array_contains(actual, p), i + 1)), lambda x: x.isNotNull())


def average_precision(actual: Column, predicted: Column, k: int) -> Column:
    """Precision at each hit, averaged over the hits found; 0 without one."""
    at = _hits(actual, predicted, k)
    total = F.aggregate(F.transform(at, lambda p, i: (i + 1) / p), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(at) > 0, total / F.size(at)).otherwise(0.0)


def reciprocal_rank(actual: Column, predicted: Column, k: int) -> Column:
    at = _hits(actual, predicted, k)
    return F.when(F.size(at) > 0, 1 / F.element_at(at, 1)).otherwise(0.0) if k > 0 else F.lit(0.0)


def recall(actual: Column, predicted: Column, k: int) -> Column:
    """Share of the distinct relevant items among the first k; 0 without relevant ones."""
    a = F.array_distinct(actual)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, F.slice(predicted, 1, k))) / F.size(a)).otherwise(0.0)


def per_query(rows: DataFrame, k: int) -> DataFrame:
    a, p = F.col("actual"), F.col("predicted")
    return rows.select("query_id", average_precision(a, p, k).alias("ap"), reciprocal_rank(a, p, k).alias("rr"), recall(a, p, k).alias("recall"))


def means(rows: DataFrame, k: int) -> DataFrame:
    """map, mrr, recall and their mean in one row."""
    m = per_query(rows, k).agg(F.avg("ap").alias("map"), F.avg("rr").alias("mrr"), F.avg("recall").alias("recall"))
    return m.withColumn("mean", (F.col("map") + F.col("mrr") + F.col("recall")) / 3)


def truth(pairs: DataFrame) -> DataFrame:
    """(query_id, actual): context ids of each query from (query_id, context_id) pairs."""
    return pairs.groupBy("query_id").agg(F.array_sort(F.collect_set("context_id")).alias("actual"))


def entity_recall(gold: Column, predicted: Column) -> Column:
    """Share of gold names that were predicted."""
    g = F.array_distinct(gold)
    return F.when(F.size(g) > 0, F.size(F.array_intersect(g, predicted)) / F.size(g)).otherwise(0.0)
