"""Keyed tables: lookups, upserts, budgets, first-seen order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "processing", "processed", "failed")


def get_by_ids(table: DataFrame, ids: DataFrame, key: str = "id", fields: list[str] | None = None) -> DataFrame:
    """One row for each of ids (ord, key) in order; columns of missing keys are null."""
    t = table.select(key, *fields) if fields else table
    return ids.join(t, key, "left")


def missing_keys(keys: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Keys that the table doesn't hold."""
    return keys.join(table.select(key), key, "left_anti")


def all_keys(table: DataFrame, key: str = "id") -> DataFrame:
    """The keys that a table holds, each once."""
    return table.select(key).distinct()


def upsert(old: DataFrame, new: DataFrame, key: str = "id", mode: str = "last") -> DataFrame:
    """old with new rows: mode first keeps what is there, mode last replaces it. Both need unique keys."""
    if mode == "first":
        return old.unionByName(new.join(old, key, "left_anti"))
    return old.join(new, key, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: str, version: Column) -> DataFrame:
    """One row for each key, the one with the largest version."""
    w = Window.partitionBy(key).orderBy(version.desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def status_counts(status: DataFrame) -> DataFrame:
    """Rows of each status, zeros included."""
    every = status.sparkSession.createDataFrame([(i, s) for i, s in enumerate(STATUSES)], "_o int, status string")
    n = status.groupBy("status").agg(F.count("*").alias("n"))
    return every.join(n, "status", "left").orderBy("_o").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


#: Parts that each look for the end of a budget on their own.
PARTS = 64


def first_rows(rows: DataFrame, order: list[Column], tokens: Column, most: int, by: list[str]) -> DataFrame:
    """Of each key the first `most` rows that have tokens, and all that have none: more can't fit a budget of `most`, if tokens are whole numbers (else all rows stay).

    Spark cuts each task's rows before it shuffles them (for a `most` up to its own limit of 1,000), so a large key doesn't go to one task whole.
    """
    if rows.select(tokens.alias("_t")).dtypes[0][1] not in ("tinyint", "smallint", "int", "bigint"):
        return rows
    some = F.coalesce(tokens > 0, F.lit(False))
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.where(some).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n").unionByName(rows.where(~some))


def within_budget(rows: DataFrame, order: list[Column], tokens: Column, budget: int, by: list[str] | None = None) -> DataFrame:
    """Rows before the first whose running token sum exceeds the budget (none for a budget of 0 or less).

    Token counts aren't negative, so the running sums that fit are a prefix. Without `by`, rows are dealt by hash to PARTS parts
    first: a row after the first one beyond the budget among the rows of its own part is beyond it among all, so the one task that orders what is left
    gets a budget's worth of rows and one more from each part at most, however many there were (but for rows of no tokens).
    """
    if budget <= 0:
        return rows.where(F.lit(False))
    if not by:
        plain = [c for c, kind in rows.dtypes if not any(x in kind for x in ("map<", "variant"))]
        part = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_part", F.pmod(F.xxhash64(*plain), F.lit(PARTS))).withColumn("_sum", F.sum(tokens).over(part) - tokens).where(F.col("_sum") <= budget).drop("_part", "_sum")
    else:
        rows = first_rows(rows, order, tokens, int(budget), by)
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(tokens).over(w)).where(F.col("_sum") <= budget).drop("_sum")


def pack(rows: DataFrame, by: str, order: str, tokens: str, budget: int) -> DataFrame:
    """Groups filled in order up to the budget: (by, order, tokens, group). A row larger than the budget is a group of its own.

    Filling is sequential, so a `by` key's rows are folded in one place; they are a query's candidates, not a table.
    """
    start = F.struct(F.lit(-1).alias("g"), F.lit(0).cast("long").alias("s"), F.array().cast("array<struct<o:long,t:long,g:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = (a.g < 0) | (a.s + x.t > budget)
        g = F.when(new, a.g + 1).otherwise(a.g)
        return F.struct(g.alias("g"), F.when(new, x.t).otherwise(a.s + x.t).alias("s"), F.concat(a.out, F.array(F.struct(x.o.alias("o"), x.t.alias("t"), g.alias("g")))).alias("out"))

    items = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(tokens).cast("long").alias("t"))))
    packed = rows.groupBy(by).agg(F.aggregate(items, start, step, lambda a: a.out).alias("x"))
    return packed.select(by, F.explode("x").alias("x")).select(by, F.col("x.o").alias(order), F.col("x.t").alias(tokens), F.col("x.g").alias("group"))


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key combination: its first in order, with all columns."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ranked(rows: DataFrame, *order: Column, name: str = "ord", start: int = 0) -> DataFrame:
    """A running number over an ordered result: for top-k lists, which are small."""
    return rows.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1 + start).cast("long"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct nodes and edges in one row."""
    kinds = nodes.select(F.lit("node").alias("kind"), F.col("entity_name").alias("a"), F.lit("").alias("b")).union(
        edges.select(F.lit("edge"), F.least("src_id", "tgt_id"), F.greatest("src_id", "tgt_id"))
    )
    d = kinds.distinct().groupBy().agg(F.count(F.when(F.col("kind") == "node", 1)).alias("nodes"), F.count(F.when(F.col("kind") == "edge", 1)).alias("edges"))
    return d


def nodes_with_text(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each node with the texts of its chunks, in chunk order; nodes: entity_name, source_ids ARRAY; chunks: id, content."""
    each = nodes.select("entity_name", F.explode_outer("source_ids").alias("id"))
    both = each.join(chunks.select("id", "content"), "id", "left")
    return both.groupBy("entity_name").agg(F.expr("listagg(content, '\n') within group (order by id)").alias("content"))


def edge_texts(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges (src_id, tgt_id, source_ids ARRAY and more) with a row for each of their chunks: id and content, so that an edge of many chunks is many rows; chunks: id, content."""
    rest = [c for c in edges.columns if c != "source_ids"]
    return edges.select(*rest, F.explode("source_ids").alias("id")).join(chunks.select("id", "content"), "id").select(*rest, "id", "content")


def edges_with_text(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges (src_id, tgt_id, source_ids ARRAY, created and more) with the texts of their chunks in chunk order, newest edge first; chunks: id, content."""
    each = edges.select("src_id", "tgt_id", F.explode_outer("source_ids").alias("id"))
    text = each.join(chunks.select("id", "content"), "id", "left").groupBy("src_id", "tgt_id").agg(F.expr("listagg(content, '\n') within group (order by id)").alias("content"))
    return edges.join(text, ["src_id", "tgt_id"], "left").orderBy(F.desc("created"), "src_id", "tgt_id")
