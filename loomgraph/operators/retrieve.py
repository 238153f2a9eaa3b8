"""What a query's context is made of: entities, relations and chunks around the best vector matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .graph import both_ways, canonical, degrees, edge_degrees
from .tables import within_budget


def local_entities(best: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """best (entity_name, ord) with the nodes' attributes and rank, their degree; unknown names drop out."""
    d = degrees(edges).withColumnRenamed("node", "entity_name")
    return best.join(nodes, "entity_name").join(d, "entity_name", "left").withColumn("rank", F.coalesce("degree", F.lit(0))).drop("degree")


def chunks_of_entities(best: DataFrame, sources: DataFrame, edges: DataFrame, by_entity: bool = True, shared: str = "last") -> DataFrame:
    """(chunk, ord, relations): the entities' chunks; relations counts the entity's neighbours that name the chunk too.

    sources: entity_name, chunk. A chunk of several entities counts with the last one's order and relations (shared="last") or the
    first one's. Sorted by order, then relations (or relations alone).
    """
    near = both_ways(edges.select("src_id", "tgt_id")).where("node <> neighbour").distinct()
    own = best.select("entity_name", "ord").join(sources, "entity_name")
    around = own.select("entity_name", "ord").distinct().join(near, F.col("entity_name") == F.col("node")).select("entity_name", "neighbour")
    also = around.join(sources.select(F.col("entity_name").alias("neighbour"), "chunk"), "neighbour").groupBy("entity_name", "chunk").agg(F.count("*").alias("relations"))
    each = own.join(also, ["entity_name", "chunk"], "left").withColumn("relations", F.coalesce("relations", F.lit(0)).cast("long"))
    pick = F.max if shared == "last" else F.min
    one = each.groupBy("chunk").agg(pick(F.struct("ord", "relations")).alias("p")).select("chunk", "p.ord", "p.relations")
    return one.orderBy("ord", F.desc("relations"), "chunk") if by_entity else one.orderBy(F.desc("relations"), "ord", "chunk")


def chunks_by_edge_score(best: DataFrame, sources: DataFrame, edges: DataFrame, query: Column | None = None, mode: str = "dot") -> DataFrame:
    """(chunk, score): the entities' chunks by the sum, over their edges whose other end names the chunk too, of a score of the edge.

    mode: count, weight, dot (edge vector and query vector) or dot_weight. An edge without a vector scores 0. First entity wins.
    """
    score = {"count": F.lit(1.0), "weight": F.col("weight"), "dot": dot(F.col("vector"), query) if query is not None else None, "dot_weight": dot(F.col("vector"), query) * F.col("weight") if query is not None else None}[mode]
    near = both_ways(edges.withColumn("_score", F.coalesce(score, F.lit(0.0))).select("src_id", "tgt_id", "_score")).where("node <> neighbour")
    own = best.select("entity_name", "ord").join(sources, "entity_name")
    around = best.select("entity_name").join(near, F.col("entity_name") == F.col("node")).select("entity_name", "neighbour", "_score")
    also = around.join(sources.select(F.col("entity_name").alias("neighbour"), "chunk"), "neighbour").groupBy("entity_name", "chunk").agg(F.sum("_score").alias("score"))
    each = own.join(also, ["entity_name", "chunk"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    one = each.groupBy("chunk").agg(F.min(F.struct("ord", "score")).alias("p")).select("chunk", "p.ord", "p.score")
    return one.orderBy(F.desc("score"), "ord", "chunk")


def relations_of_entities(best: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges at the entities, each once, with ord (its first entity's) and rank, sorted by rank and weight."""
    e = edge_degrees(canonical(edges))
    at = both_ways(e.select("src_id", "tgt_id")).join(best.select(F.col("entity_name").alias("node"), "ord"), "node")
    first = at.groupBy(F.least("node", "neighbour").alias("src_id"), F.greatest("node", "neighbour").alias("tgt_id")).agg(F.min("ord").alias("ord"))
    return e.join(first, ["src_id", "tgt_id"]).orderBy(F.desc("rank"), F.desc("weight"), "ord", "src_id", "tgt_id")


def global_relations(best: DataFrame, edges: DataFrame, tokens: Column, budget: int) -> DataFrame:
    """best (src_id, tgt_id, ord) with attributes and rank, by rank and weight, within the budget; `pos` is the new order."""
    e = edge_degrees(canonical(edges))
    found = canonical(best).join(e, ["src_id", "tgt_id"])
    order = [F.desc("rank"), F.desc("weight"), F.col("ord")]
    kept = within_budget(found, order, tokens, budget)
    return kept.withColumn("pos", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def entities_of_relations(relations: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends of the relations (src_id, tgt_id, pos) in order, each once, with attributes and rank."""
    ends = relations.select(F.posexplode(F.array("src_id", "tgt_id")).alias("_side", "entity_name"), "pos")
    first = ends.groupBy("entity_name").agg(F.min(F.col("pos") * 2 + F.col("_side")).alias("ord"))
    return local_entities(first, nodes, edges)


def chunks_of_relations(relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, ord, ...): the chunks of the relations (source_ids, pos) in the order first seen; chunks that don't exist drop out."""
    each = relations.select("pos", F.explode("source_ids").alias("id"))
    return each.groupBy("id").agg(F.min("pos").alias("ord")).join(chunks, "id").orderBy("ord", "id")


def combined(high: DataFrame, low: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of both lists, high-level ones first, equal ones once, numbered from 1. Both have ord."""
    both = high.select(F.lit(0).alias("_side"), "ord", *columns).unionByName(low.select(F.lit(1).alias("_side"), "ord", *columns))
    first = both.groupBy(*columns).agg(F.min(F.struct("_side", "ord")).alias("_at"))
    return first.withColumn("id", F.row_number().over(Window.orderBy("_at")).cast("long")).drop("_at")


def naive(best: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    """best (id, ord, score) joined to chunks (id, content, tokens), within the budget."""
    return within_budget(best.join(chunks, "id"), [F.col("ord")], F.col("tokens"), budget)


def joined_text(rows: DataFrame, separator: str = "\n--New Chunk--\n", content: str = "content", order: str = "ord") -> DataFrame:
    """One row: the contents in order. For a context within its budget."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda x: x[content])
    return rows.groupBy().agg(F.array_join(parts, separator).alias("context"))


def by_keyword_sum(scored: DataFrame, k: int) -> DataFrame:
    """(entity_name, score): scores of all keywords' matches summed, the k best."""
    return scored.groupBy("entity_name").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "entity_name").limit(k)


def fallback_mode(mode: Column, low: Column, high: Column) -> Column:
    """The mode that keyword gaps leave: fail without any, global without low-level ones, local without high-level ones."""
    none_low, none_high = F.size(low) == 0, F.size(high) == 0
    return (
        F.when(none_low & none_high, "fail").when(none_low & mode.isin("local", "hybrid"), "global")
        .when(none_high & mode.isin("global", "hybrid"), "local").otherwise(mode)
    )
