"""Merging extracted records into node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FIELD_SEP, content_id
from ..scratch import materialize
from .extract import undirected


def joined(values: Column) -> Column:
    """A set of texts in order, as one field."""
    return F.array_join(F.array_sort(values), FIELD_SEP)


def mode_first_seen(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value): the most frequent value of each key, of equally frequent ones the first in order. Counts combine before the shuffle."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    w = Window.partitionBy(key).orderBy(F.desc("_n"), "_first")
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, value)


def nodes(records: DataFrame, order: list[str]) -> DataFrame:
    """One row for each entity: the most frequent type, and the sets of descriptions and sources joined.

    records: entity_name, entity_type, description, source_id and the order columns; existing nodes come after new ones in order.
    """
    kind = mode_first_seen(records, "entity_name", "entity_type", order)
    rest = records.groupBy("entity_name").agg(joined(F.collect_set("description")).alias("description"), joined(F.collect_set("source_id")).alias("source_id"))
    return kind.join(rest, "entity_name")


def edges(records: DataFrame, directed: bool = False) -> DataFrame:
    """One row for each undirected pair (directed: for each ordered one): weights summed, sets of descriptions, keywords and sources joined, empty ones left out.

    records: src_id, tgt_id, weight, description, keywords, source_id, and `order` if there is one (the smallest stays).
    """
    some = lambda c: joined(F.collect_set(F.nullif(F.col(c), F.lit("")))).alias(c)
    more = [F.min("order").alias("order")] if "order" in records.columns else []
    return (records if directed else undirected(records)).groupBy("src_id", "tgt_id").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), some("description"), some("keywords"), some("source_id"), *more)


def missing_endpoints(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """Nodes for endpoints that no record describes, with the description and source of their first edge."""
    ends = edges_.select(F.explode(F.array("src_id", "tgt_id")).alias("entity_name"), "src_id", "tgt_id", "description", "source_id")
    lone = ends.join(nodes_.select("entity_name"), "entity_name", "left_anti")
    first = lone.groupBy("entity_name").agg(F.min(F.struct("src_id", "tgt_id", "description", "source_id")).alias("e"))
    return first.select("entity_name", F.lit('"UNKNOWN"').alias("entity_type"), "e.description", "e.source_id")


def undescribed(named: DataFrame, *links: DataFrame) -> list[DataFrame]:
    """Those rows of each of links (src_id, tgt_id and more, any number for a pair) that have an end among the names that `named` (entity_name) lacks: all that `missing_endpoints` needs.

    Such names are few, so they are found first, and what is joined to them is filtered and not merged as a whole.
    """
    ends = reduce(DataFrame.unionByName, (t.select(F.explode(F.array("src_id", "tgt_id")).alias("_end")) for t in links)).distinct()
    lone = materialize(ends.join(named.select(F.col("entity_name").alias("_end")), "_end", "left_anti"))
    if lone.isEmpty():
        return [t.where(F.lit(False)) for t in links]
    at = lambda t, end, how: t.join(lone.withColumnRenamed("_end", end), end, how).select(*t.columns)
    return [at(t, "src_id", "left_semi").unionByName(at(at(t, "tgt_id", "left_semi"), "src_id", "left_anti")) for t in links]


def summarised(rows: DataFrame, tokens: Column, summarise: Column, least: int = 500) -> DataFrame:
    """Descriptions of `least` tokens or more put through a summariser."""
    return rows.withColumn("description", F.when(tokens < least, F.col("description")).otherwise(summarise))


def entity_rows(nodes_: DataFrame) -> DataFrame:
    """(id, entity_name, content) to embed."""
    return nodes_.select(content_id(F.col("entity_name"), "ent-").alias("id"), "entity_name", F.concat("entity_name", "description").alias("content"))


def relation_rows(edges_: DataFrame) -> DataFrame:
    """(id, src_id, tgt_id, content) to embed, the pair in order."""
    e = undirected(edges_)
    return e.select(content_id(F.concat("src_id", "tgt_id"), "rel-").alias("id"), "src_id", "tgt_id", F.concat("keywords", "src_id", "tgt_id", "description").alias("content"))


def merge_attributes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and new rows by key; an attribute that new gives replaces the old one, others stay."""
    cols = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    pick = lambda c: F.coalesce(*(F.col(f"{t}.{c}") for t, d in (("n", new), ("o", old)) if c in d.columns)).alias(c)
    return o.join(n, on, "full_outer").select(*map(pick, keys), *map(pick, cols))


def upsert_edges(nodes_: DataFrame, edges_: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src_id, tgt_id and more) with new ones, by pair in either order; ends that are no nodes yet become nodes with a name alone."""
    merged = merge_attributes(undirected(edges_), undirected(new), ["src_id", "tgt_id"])
    ends = new.select(F.explode(F.array("src_id", "tgt_id")).alias("entity_name")).distinct().join(nodes_.select("entity_name"), "entity_name", "left_anti")
    return nodes_.unionByName(ends, allowMissingColumns=True), merged


def custom_graph(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, nodes and edges of a supplied graph: source names become chunk ids, names are quoted and upper-cased, gaps get defaults.

    chunks: content, source_id; entities: entity_name, entity_type, description, source_id; relations: src_id, tgt_id, description, keywords,
    weight, source_id. Endpoints without an entity become UNKNOWN nodes.
    """
    c = chunks.select(content_id(F.trim("content"), "chunk-").alias("id"), F.trim("content").alias("content"), "source_id")
    name = lambda x: F.concat(F.lit('"'), F.upper(x), F.lit('"'))
    source = c.groupBy("source_id").agg(F.max("id").alias("_chunk"))
    with_chunk = lambda t: t.join(source, "source_id", "left").withColumn("source_id", F.coalesce("_chunk", F.lit("UNKNOWN"))).drop("_chunk")
    n = with_chunk(entities).select(name("entity_name").alias("entity_name"), F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type"), F.coalesce("description", F.lit("No description provided")).alias("description"), "source_id")
    e = with_chunk(relations).select(name("src_id").alias("src_id"), name("tgt_id").alias("tgt_id"), "description", "keywords", F.coalesce("weight", F.lit(1.0)).alias("weight"), "source_id")
    lone = missing_endpoints(n, e).withColumns({"entity_type": F.lit("UNKNOWN"), "description": F.lit("UNKNOWN")})
    return c, n.unionByName(lone), e
