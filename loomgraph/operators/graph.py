"""Property graphs as node and edge tables: lookups, degrees, neighbourhoods, components, deletes."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import discard, materialize


def canonical(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src_id": F.least("src_id", "tgt_id"), "tgt_id": F.greatest("src_id", "tgt_id")})


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, neighbour, ...) with each edge from both ends; a loop counts twice."""
    rest = [c for c in edges.columns if c not in ("src_id", "tgt_id")]
    a = edges.select(F.col("src_id").alias("node"), F.col("tgt_id").alias("neighbour"), *rest)
    return a.unionByName(edges.select(F.col("tgt_id").alias("node"), F.col("src_id").alias("neighbour"), *rest))


def has_nodes(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """names (entity_name) with `found`."""
    n = nodes.select("entity_name", F.lit(True).alias("found"))
    return names.join(n, "entity_name", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def has_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (in order or not) that are edges."""
    return canonical(pairs).join(canonical(edges).select("src_id", "tgt_id").distinct(), ["src_id", "tgt_id"], "left_semi")


def get_nodes(names: DataFrame, nodes: DataFrame) -> DataFrame:
    return names.join(nodes, "entity_name", "left")


def get_edges(pairs: DataFrame, edges: DataFrame, default_weight: float | None = None) -> DataFrame:
    """Attributes of each pair's edge; null (or the default weight) where there is none."""
    out = canonical(pairs).join(canonical(edges), ["src_id", "tgt_id"], "left")
    return out if default_weight is None else out.withColumn("weight", F.coalesce("weight", F.lit(default_weight)))


def node_edges(names: DataFrame, edges: DataFrame) -> DataFrame:
    """Each name's edges as (node, neighbour, ...); none for an unknown name."""
    return both_ways(edges).join(names.select(F.col("entity_name").alias("node")), "node", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree). Counts combine in each task, so a hub costs one row a task."""
    return both_ways(edges.select("src_id", "tgt_id")).groupBy("node").agg(F.count("*").alias("degree"))


def edge_degrees(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Edges with rank, the sum of their ends' degrees (counted over `of`, the edges themselves by default)."""
    d = degrees(edges if of is None else of)
    s, t = d.select(F.col("node").alias("src_id"), F.col("degree").alias("_s")), d.select(F.col("node").alias("tgt_id"), F.col("degree").alias("_t"))
    out = edges.join(s, "src_id", "left").join(t, "tgt_id", "left")
    return out.withColumn("rank", F.coalesce("_s", F.lit(0)) + F.coalesce("_t", F.lit(0))).drop("_s", "_t")


def labels(nodes: DataFrame) -> DataFrame:
    return nodes.select("entity_name").distinct().orderBy("entity_name")


def within_hops(start: DataFrame, edges: DataFrame, hops: int | None = None, directed: bool = False) -> DataFrame:
    """(node, depth) of all nodes within `hops` edges (without: of all that can be reached) of the start nodes (entity_name), each with its least depth.

    Each round joins the frontier alone and drops what was seen, so cycles end; rounds are written to the shared folder.
    """
    step = (edges.select(F.col("src_id").alias("node"), F.col("tgt_id").alias("neighbour")) if directed else both_ways(edges.select("src_id", "tgt_id"))).distinct()
    seen = start.select(F.col("entity_name").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = seen.select("node")
    for depth in count(1) if hops is None else range(1, hops + 1):
        found = frontier.join(step, "node").select(F.col("neighbour").alias("node")).distinct()
        frontier = materialize(found.join(seen, "node", "left_anti"))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return seen


def subgraph(nodes: DataFrame, edges: DataFrame, label: str, hops: int, directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes within `hops` of the labelled one and the edges among them; "*" takes the whole graph, an unknown label nothing."""
    if label == "*":
        return nodes, edges
    near = within_hops(nodes.where(F.col("entity_name") == label), edges, hops, directed)
    n = nodes.join(near.select(F.col("node").alias("entity_name")), "entity_name", "left_semi")
    inside = near.select("node")
    e = edges.join(inside.withColumnRenamed("node", "src_id"), "src_id", "left_semi").join(inside.withColumnRenamed("node", "tgt_id"), "tgt_id", "left_semi")
    return n, e


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_name, component): the smallest name reachable. Labels halve the way to it in each round."""
    near = materialize(both_ways(edges.select("src_id", "tgt_id")).where("node <> neighbour").distinct())
    label = nodes.select(F.col("entity_name").alias("node"), F.col("entity_name").alias("label")).distinct()
    while True:
        low = near.join(label.select(F.col("node").alias("neighbour"), "label"), "neighbour").groupBy("node").agg(F.min("label").alias("low"))
        new = label.join(low, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("low", "label")).alias("label"))
        up = label.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = materialize(new.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        changed = step.where("label <> old").limit(1).count()
        discard(label)
        label = step
        if not changed:
            discard(near)
            return label.select(F.col("node").alias("entity_name"), F.col("label").alias("component"))


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes of the component with the most nodes (ties: the smallest name)."""
    c = materialize(components(nodes, edges))
    top = c.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return nodes.join(c.join(top, "component", "left_semi").select("entity_name"), "entity_name", "left_semi")


def stable_order(edges: DataFrame) -> DataFrame:
    """Edges with src_id <= tgt_id, sorted by the text "src -> tgt"."""
    return canonical(edges).orderBy(F.concat_ws(" -> ", "src_id", "tgt_id"))


def scaled_sizes(degree: DataFrame) -> DataFrame:
    """(node, size): 0.5 to 2 by degree, 1 if all are alike. The extremes are one row."""
    ends = degree.agg(F.min("degree").alias("_lo"), F.max("degree").alias("_hi"))
    size = F.when(F.col("_hi") > F.col("_lo"), 0.5 + 1.5 * (F.col("degree") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)
    return degree.join(F.broadcast(ends)).select("node", size.alias("size"))


def delete_nodes(names: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the named nodes and their edges."""
    n = names.select("entity_name")
    left = edges.join(n.withColumnRenamed("entity_name", "src_id"), "src_id", "left_anti").join(n.withColumnRenamed("entity_name", "tgt_id"), "tgt_id", "left_anti")
    return nodes.join(n, "entity_name", "left_anti"), left


def delete_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return canonical(edges).join(canonical(pairs).select("src_id", "tgt_id"), ["src_id", "tgt_id"], "left_anti")


def without_sources(rows: DataFrame, chunk_ids: Column) -> DataFrame:
    """Rows (source_ids ARRAY) with the chunks taken out of their sources; those that lose all go. Adds `changed`."""
    left = F.array_except("source_ids", chunk_ids)
    out = rows.withColumns({"changed": F.size(left) < F.size("source_ids"), "source_ids": left})
    return out.where(F.size("source_ids") > 0)


def drop_sources(mentions: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """mentions (entity_name, chunk) of all chunks but those of chunk_ids (id): rows, so neither side is gathered."""
    return mentions.join(chunk_ids.select(F.col("id").alias("chunk")), "chunk", "left_anti")


def residual(rows: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Rows that still name one of the chunks (id): none after a full delete."""
    return rows.withColumn("id", F.explode("source_ids")).join(chunk_ids.select("id"), "id", "left_semi").drop("id").distinct()


def entity_info(names: DataFrame, nodes: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    out = get_nodes(names, nodes)
    return out if vectors is None else out.join(vectors, "entity_name", "left")


def relation_info(pairs: DataFrame, edges: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """pairs (src_id, tgt_id), in either order, with the edge's attributes and, from vectors (src_id, tgt_id and more), its vector row; null where there is none."""
    asked = canonical(pairs.select("src_id", "tgt_id")).distinct()
    out = asked.join(canonical(edges), ["src_id", "tgt_id"], "left")
    return out if vectors is None else out.join(canonical(vectors), ["src_id", "tgt_id"], "left")


def delete_everywhere(names: DataFrame, nodes: DataFrame, edges: DataFrame, entity_vectors: DataFrame, relation_vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Graph and vector tables without the named entities (entity_name) and all relations that end in one. entity_vectors: entity_name and more; relation_vectors: src_id, tgt_id and more."""
    n, e = delete_nodes(names, nodes, edges)
    v, r = delete_nodes(names, entity_vectors, relation_vectors)
    return n, e, v, r


def indexed_clusters(nodes: DataFrame, ids: str = "community_ids") -> DataFrame:
    """clusters ARRAY<STRUCT<level, cluster>> from a list of cluster ids by level."""
    return nodes.withColumn("clusters", F.transform(ids, lambda c, i: F.struct(i.alias("level"), c.alias("cluster"))))


def _adjacency(edges: DataFrame) -> DataFrame:
    """(node, i, neighbour, weight, degree, most): each node's neighbours numbered from 0, with its degree and its largest weight. Numbers are given by ranges, so a hub's neighbours are spread."""
    near = both_ways(edges.select("src_id", "tgt_id", F.coalesce("weight", F.lit(1.0)).cast("double").alias("weight"))).where("weight > 0 AND node <> neighbour")
    near = near.groupBy("node", "neighbour").agg(F.sum("weight").alias("weight"))
    part = materialize(near.repartitionByRange("node", "neighbour").withColumn("_range", F.spark_partition_id()))
    size = part.groupBy("node", "_range").agg(F.count("*").alias("n"), F.max("weight").alias("most"))
    w = Window.partitionBy("node")
    before = size.select("node", "_range", (F.sum("n").over(w.orderBy("_range")) - F.col("n")).alias("before"), F.sum("n").over(w).alias("degree"), F.max("most").over(w).alias("most"))
    own = F.row_number().over(Window.partitionBy("node", "_range").orderBy("neighbour")) - 1
    out = materialize(part.join(before, ["node", "_range"]).select("node", (F.col("before") + own).alias("i"), "neighbour", "weight", "degree", "most"))
    discard(part)
    return out


def _draw(*of: Column | str) -> Column:
    """A number from 0 up to 1, the same whenever it is drawn again."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 52)) / float(1 << 52)


def walks(edges: DataFrame, starts: DataFrame, length: int, per_node: int, seed: int = 3, back: float = 1.0, out: float = 1.0, tries: int = 4) -> DataFrame:
    """(walk, path ARRAY): second-order random walks as sentences for a word-vector model, `per_node` from each start (entity_name).

    After a step from t to v, a neighbour x of v is taken in proportion to its edge's weight, over `back` if it is t, over `out` if it
    isn't t's neighbour. A candidate is one numbered neighbour, taken or refused by a draw, so a step costs a few rows a walk
    whatever the degrees; walks of which all `tries` candidates are refused draw again. A walk at a node without neighbours ends. edges: src_id, tgt_id and a weight (null: 1).
    """
    near = _adjacency(edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0)))
    ends = near.where("i = 0").select("node", "degree", "most")
    pairs = near.select(F.col("node").alias("last"), F.col("neighbour").alias("_to"), F.lit(True).alias("known"))
    top = max(1.0, 1 / back, 1 / out)
    each = starts.select("entity_name").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_node))))
    w = materialize(each.select(F.concat_ws("/", "entity_name", F.col("k").cast("string")).alias("walk"), F.array("entity_name").alias("path"), F.lit(False).alias("done")))
    for step in range(length - 1):
        todo, moved, turn = w.where("NOT done"), None, 0
        while True:
            asked = todo.select("walk", F.element_at("path", -1).alias("node"), F.get(F.reverse("path"), F.lit(1)).alias("last")).join(ends, "node")
            draws = asked.withColumn("t", F.explode(F.sequence(F.lit(turn * tries), F.lit(turn * tries + tries - 1))))
            draws = draws.withColumn("i", F.floor(_draw("walk", "t", F.lit(seed), F.lit(2 * step)) * F.col("degree")).cast("long"))
            found = draws.join(near.select("node", "i", "neighbour", "weight"), ["node", "i"]).withColumn("_to", F.col("neighbour"))
            if back != 1 or out != 1:
                found = found.join(pairs, ["last", "_to"], "left")
                share = F.when(F.col("last").isNull(), top).when(F.col("last") == F.col("_to"), 1 / back).when(F.col("known"), 1.0).otherwise(1 / out)
            else:
                share = F.lit(top)
            taken = found.where(_draw("walk", "t", F.lit(seed), F.lit(2 * step + 1)) < share / top * F.col("weight") / F.col("most"))
            new = materialize(taken.groupBy("walk").agg(F.min_by("_to", "t").alias("to")))
            moved = new if moved is None else materialize(moved.unionByName(new))
            left = todo.join(ends.select(F.col("node").alias("_end")), F.element_at("path", -1) == F.col("_end"), "left_semi").join(moved, "walk", "left_anti")
            if not left.limit(1).count():
                break
            todo, turn = left, turn + 1
        stepped = w.join(moved, "walk", "left")
        ended = F.col("done") | F.col("to").isNull()
        after = materialize(stepped.select("walk", F.when(ended, F.col("path")).otherwise(F.concat("path", F.array("to"))).alias("path"), ended.alias("done")))
        discard(w, moved)
        w = after
    discard(near)
    return w.select("walk", "path")


def node_vectors(paths: DataFrame, size: int = 64, window: int = 5, seed: int = 3, rounds: int = 1) -> DataFrame:
    """(entity_name, vector) by word vectors over walks (path). Spark ML trains on all walks; its model, a vector for each node, passes through the driver, so this is for as many nodes as the driver can hold."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=size, windowSize=window, minCount=0, seed=seed, maxIter=rounds, inputCol="path", outputCol="_v").fit(paths)
    return model.getVectors().select(F.col("word").alias("entity_name"), vector_to_array("vector").alias("vector"))
