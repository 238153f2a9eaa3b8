"""Approximate nearest vectors by layered proximity graphs, one for each shard of a stored index.

A shard's nodes are few enough for a task. Each layer keeps a hashed share of the layer below; in a layer every node is linked to the nearest ones that
aren't nearer to a link it has already, and back. A search walks down the layers from one node, keeping the `width` nearest that it has
seen in the lowest one. Queries are sent to all shards in blocks, and their answers meet at the end.
"""

from __future__ import annotations

import heapq
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .similar import units

#: Nodes of a shard, links of a node in a layer (twice as many in the lowest), the share of a layer that the next one keeps.
SHARD, LINKS, KEEP = 4096, 16, 16
#: Queries that meet a shard together.
BLOCK = 512


def _layer(key: object) -> int:
    """The highest layer of a node, by its key's checksum: a 1 / KEEP share of each layer goes up."""
    h, up = zlib.crc32(str(key).encode()), 0
    while h % KEEP == 0 and up < 8:
        h, up = h // KEEP, up + 1
    return up


def linked(v: np.ndarray, most: int) -> list[list[int]]:
    """For each unit vector its links: of the nearest ones those that are nearer to it than to any link before them, filled up with the nearest; and links back."""
    near = v @ v.T
    np.fill_diagonal(near, -2.0)
    seen = min(len(v) - 1, 4 * most)
    order = np.argsort(-near, axis=1, kind="stable")[:, :seen] if seen > 0 else np.empty((len(v), 0), int)
    links: list[list[int]] = []
    for i, candidates in enumerate(order):
        own: list[int] = []
        for c in candidates.tolist():
            if len(own) < most and (not own or near[c, own].max() < near[i, c]):
                own.append(c)
        rest = [c for c in candidates[:most].tolist() if c not in own]
        links.append(own + rest[: most - len(own)])
    back: list[set[int]] = [set(x) for x in links]
    for i, own in enumerate(links):
        for c in own:
            back[c].add(i)
    return [sorted(x, key=lambda c, i=i: -near[i, c]) for i, x in enumerate(back)]


def build(vectors: DataFrame, path: str, key: str = "id", vector: str = "vector", shard: int = SHARD) -> None:
    """Store an index of vectors (key, vector) below `path`; what is stored there already stays, so more vectors are added by a further call.

    Vectors that are null, zero or hold what is no number aren't indexed. A key that is stored twice is found with its better vector.
    """
    v = F.col(vector).cast("array<double>")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(fit).select(F.col(key).alias("key"), v.alias("vector"))
    n = max(1, -(-rows.count() // shard))

    def graph(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", kind="stable", ignore_index=True)
        v, up = units(group["vector"]), np.array([_layer(k) for k in group["key"]])
        links: list[list[list[int]]] = [[] for _ in range(len(v))]
        for layer in range(int(up.max()) + 1):
            own = np.flatnonzero(up >= layer)
            for i, near in zip(own, linked(v[own], LINKS * (2 if layer == 0 else 1)), strict=True):
                links[i].append(own[near].tolist())
        return pd.DataFrame({"shard": group["shard"], "node": np.arange(len(v), dtype=np.int32), "key": group["key"], "vector": list(v), "links": links})

    kind = vectors.schema[key].dataType.simpleString()
    part = uuid.uuid4().hex
    dealt = rows.withColumn("shard", F.concat_ws("-", F.lit(part), F.pmod(F.xxhash64("key", "vector"), F.lit(n)).cast("string")))
    out = dealt.groupBy("shard").applyInPandas(graph, f"shard string, node int, key {kind}, vector array<double>, links array<array<int>>")
    out.write.mode("append").parquet(path)


def search(v: np.ndarray, links: list[list[list[int]]], q: np.ndarray, k: int, width: int) -> list[tuple[float, int]]:
    """The k nearest nodes that a walk finds, as (cosine, node), nearest first, ties to the smaller node."""
    at = max(range(len(v)), key=lambda i: (len(links[i]), -i))
    score = float(v[at] @ q)
    for layer in range(len(links[at]) - 1, 0, -1):
        while True:
            near = links[at][layer]
            s = v[near] @ q if near else np.empty(0)
            if not len(s) or s.max() <= score:
                break
            score, at = float(s.max()), near[int(s.argmax())]
    seen, todo, best = {at}, [(-score, at)], [(score, -at)]
    while todo:
        s, i = heapq.heappop(todo)
        if len(best) == width and -s < best[0][0]:
            break
        new = [c for c in links[i][0] if c not in seen]
        seen.update(new)
        for c, x in zip(new, (v[new] @ q).tolist() if new else (), strict=True):
            if len(best) < width or x > best[0][0]:
                heapq.heappush(todo, (-x, c))
                heapq.heappush(best, (x, -c))
                if len(best) > width:
                    heapq.heappop(best)
    return [(x, -c) for x, c in sorted(best, key=lambda b: (-b[0], -b[1]))[:k]]


def nearest(spark: SparkSession, path: str, queries: DataFrame, k: int, width: int = 128, block: int = BLOCK) -> DataFrame:
    """(query_id, key, score, ord): for each query (query_id, vector) k of the nearest stored vectors by cosine, ties to the smaller key.

    Approximate: `width` is what a walk keeps in a shard; more finds more. Scores are exact. Queries that are null, zero or no numbers find nothing.
    """
    index = spark.read.parquet(path)
    v = F.col("vector").cast("array<double>")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    asked = queries.where(fit).select("query_id", v.alias("vector"))
    blocks = max(1, -(-asked.count() // block))
    shards = index.groupBy("shard").agg(F.count("*").alias("n"))
    x = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks)).cast("int"))
    each = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    x = each.join(x, "block")
    y = index.join(each, "shard").select(F.col("shard").alias("_shard"), F.col("block").alias("_block"), "node", "key", "vector", "links")
    kinds = queries.schema["query_id"].dataType.simpleString(), index.schema["key"].dataType.simpleString()

    def walk(q: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(q) and len(nodes):
            nodes = nodes.sort_values("node")
            v = np.array(nodes["vector"].tolist())
            links = [[list(layer) for layer in x] for x in nodes["links"]]
            keys = nodes["key"].to_numpy()
            for query, unit in zip(q["query_id"], units(q["vector"]), strict=True):
                found += [(query, keys[c], s) for s, c in search(v, links, unit, k, max(k, width))]
        return pd.DataFrame(found, columns=["query_id", "key", "score"])

    out = x.groupBy("shard", "block").cogroup(y.groupBy("_shard", "_block")).applyInPandas(walk, f"query_id {kinds[0]}, key {kinds[1]}, score double")
    out = out.groupBy("query_id", "key").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return out.withColumn("ord", (F.row_number().over(w) - 1).cast("long")).where(F.col("ord") < k)
