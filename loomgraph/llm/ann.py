"""Approximate nearest neighbours by an inverted multi-index over two vector halves."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, materialize

#: The codebooks are fitted on about this many vectors, a share of all by a hash of their ids.
SAMPLE = 20_000
#: Rows of an index shard and of a block of queries that meet in one task.
SHARD, QUERIES = 2048, 2048


def _usable(vectors: DataFrame, vec: str) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    v = F.col(vec).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vec).isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def kmeans(rows: np.ndarray, k: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    rows = np.unique(rows, axis=0)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        near = _distances(rows, centres).argmin(axis=1)
        for j in range(len(centres)):
            if (own := near == j).any():
                centres[j] = rows[own].mean(axis=0)
    return centres


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(axis=1)[None, :]


def traverse(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, want: int) -> list[int]:
    """Cells i * len(d2) + j in the order of d1[i] + d2[j], until they hold `want` entries.

    A heap holds the front: a pair enters once the pairs before it in both sorted lists have left.
    """
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, width = d1[o1].tolist(), d2[o2].tolist(), len(d2)
    heap, held, out = [(s1[0] + s2[0], 0, 0)], 0, []
    open_from = [0] * len(s1)  # columns of row i that have left
    while heap and held < want:
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * width + int(o2[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        open_from[i] = j + 1
        if i + 1 < len(s1) and open_from[i + 1] == j:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
        if j + 1 < width and (i == 0 or open_from[i - 1] > j + 1):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def books_for(n: int) -> int:
    """Centroids of each half's codebook: a power of two near 0.66 times the root of the number of vectors, 8 to 256."""
    return int(np.clip(2 ** round(np.log2(max(n, 1)) / 2 - 0.6), 8, 256))


def share_for(units: np.ndarray, half: int, c1: np.ndarray, c2: np.ndarray, k: int, n: int, recall: float, most: int = 256) -> float:
    """The share of the entries that a search among n has to visit to find `recall` of the nearest, judged on a sample (unit vectors) of them.

    For some of the sample, the true nearest others are looked up among the order in which the index would visit them. The k nearest of
    n are as near as the k * (sample size) / n nearest of the sample.
    """
    units = np.unique(units, axis=0)
    if len(units) < 3:
        return 1.0
    some = np.linspace(0, len(units) - 1, min(most, len(units))).astype(int)
    near = max(1, min(len(units) - 1, round(k * len(units) / n)))
    e1, e2 = _distances(units[:, :half], c1).argmin(axis=1), _distances(units[:, half:], c2).argmin(axis=1)
    need = []
    for i in some:
        cos = units @ units[i]
        cos[i] = -np.inf
        due = _distances(units[i : i + 1, :half], c1)[0][e1] + _distances(units[i : i + 1, half:], c2)[0][e2]
        need += [(due <= due[j]).mean() for j in np.argpartition(-cos, near - 1)[:near]]
    return float(np.quantile(need, recall))


def search(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vec: str = "embedding", books: int | None = None, share: float | None = None, recall: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row that satisfies `queries`, by cosine in double precision.

    Unit vectors' halves are quantised by two codebooks of `books` centroids (default: books_for); every vector is entered under its pair. A
    query visits pairs by summed distance until they hold `share` of the entries (and 16 * (k + 1) at least), and all their entries are ranked by
    the exact score on the original vectors, ties to the smaller id. The share is the one that finds `recall` of the nearest on the
    sample that the codebooks are fitted on (share_for). Vectors without direction near each other, as random ones, need a large share; clustered ones a small one.

    Null, zero, non-finite or odd-sized vectors (not of the most common length; ties: the longest) take no part; a null id neither. Equal
    vectors are one entry with its k + 1 smallest ids, which is all that an answer can hold, so a vector held by a third of all rows costs no
    more. A row with the query's own id is never its answer; a repeated id counts once for equal vectors. No rows: none.
    """
    usable = vectors.where(_usable(vectors, vec) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vec).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    ok = materialize(usable)
    sizes = ok.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dim, half, n = sizes["n"], (sizes["n"] + 1) // 2, sizes["count"]
    ok = ok.where(F.size("v") == dim)
    part = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)) < SAMPLE / n
    some = ok.select("id", "v").where(part).union(ok.select("id", "v").orderBy("id").limit(1)).toPandas().sort_values("id", kind="stable")
    units = np.array(some["v"].tolist(), np.float64)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    books = books or books_for(n)
    c1 = kmeans(units[:, :half], books)
    c2 = kmeans(units[:, half:], books) if dim > 1 else np.zeros((1, 0))
    width = len(c2)
    share = share_for(units, half, c1, c2, k, n, recall) if share is None else share

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1))
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                cell = _distances(m[:, :half], c1).argmin(axis=1) * width + _distances(m[:, half:], c2).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], [*b.schema.names, "cell"])

    few = Window.partitionBy("v").orderBy("id")
    kept = ok.select("id", "v").distinct().withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= k + 1).drop("_n")
    index = materialize(kept.mapInArrow(enter, extended(kept, cell="int")))

    def by_cell(t: DataFrame) -> np.ndarray:
        out = np.zeros(len(c1) * width, np.int64)
        for r in t.groupBy("cell").count().collect():  # at most books * books rows
            out[r["cell"]] = r["count"]
        return out

    counts = by_cell(index)
    # Neighbouring cells share a shard; a cell larger than a shard is spread over several.
    first = (np.cumsum(counts) - counts) // SHARD
    spread = np.maximum(1, -(-counts // SHARD))
    want = max(16 * (k + 1), int(np.ceil(share * counts.sum())))  # small tables are searched whole
    asking = ok.where("q").select("id", "v").distinct()
    asking = materialize(asking.mapInArrow(enter, extended(asking, cell="int")))
    # Queries of one cell visit the same shards: they share a block, or several if they are many.
    asked_by = by_cell(asking)
    block, blocks = (np.cumsum(asked_by) - asked_by) // QUERIES, np.maximum(1, -(-asked_by // QUERIES))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column(1))
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            d1, d2 = _distances(m[:, :half], c1), _distances(m[:, half:], c2)
            own, ids = b.column(2).to_numpy(), b.column(0).to_numpy()
            at, shard, cells = [], [], []
            for i in range(b.num_rows):
                by: dict[int, list[int]] = {}
                for c in traverse(d1[i], d2[i], counts, want):
                    for s in range(spread[c]):
                        by.setdefault(int(first[c]) + s, []).append(c)
                at += [i] * len(by)
                shard += by.keys()
                cells += by.values()
            rows = b.take(pa.array(at, pa.int64()))
            to = (block[own] + ids % blocks[own])[at]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(shard, pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array(to.astype(np.int32))], ["id", "v", "shard", "cells", "block"])

    ask = materialize(asking.mapInArrow(route, extended(asking.drop("cell"), shard="int", cells="array<int>", block="int")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, ids = b.column(2).to_numpy(), b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((first[cell] + ids % spread[cell]).astype(np.int32))], ["id", "v", "cell", "shard"])

    # A shard goes to the blocks that have a query for it.
    shards = index.mapInArrow(place, extended(index, shard="int"))
    pairs = ask.select(F.col("shard").alias("_shard"), F.col("block").alias("_block")).distinct()
    shards = shards.join(pairs, F.col("shard") == F.col("_shard")).select("id", "v", "cell", "shard", F.col("_block").alias("block"))

    def rank(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        entries = entries.sort_values("id", kind="stable")
        x, ids = np.array(entries["v"].tolist(), np.float64), entries["id"].to_numpy()
        v, asker = np.array(asked["v"].tolist(), np.float64), asked["id"].to_numpy()
        norm, length = np.sqrt((x * x).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
        here, cell = np.unique(entries["cell"].to_numpy(), return_inverse=True)
        visits = np.zeros((len(v), len(here)), bool)
        lists = asked["cells"].tolist()
        at = np.searchsorted(here, flat := np.concatenate(lists))
        of = np.repeat(np.arange(len(lists)), [len(c) for c in lists])
        real = (at < len(here)) & (here[np.minimum(at, len(here) - 1)] == flat)
        visits[of[real], at[real]] = True
        near = (v / length[:, None]) @ (x / norm[:, None]).T  # to a few units in the last place; the scores below are exact
        near[~visits[:, cell] | (ids[None, :] == asker[:, None])] = -np.inf
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        best = np.maximum.reduceat(near, starts, axis=1)  # of rows with one id
        least = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k] if best.shape[1] > k else np.full(len(v), -2.0)
        row, col = np.nonzero((near >= least[:, None] - 1e-9) & (near > -2))
        score = (x[col] * v[row]).sum(axis=1) / (norm[col] * length[row])
        return pd.DataFrame({"query_id": asker[row], "vec_id": ids[col], "score": score})

    found = shards.groupBy("shard", "block").cogroup(ask.groupBy("shard", "block")).applyInPandas(rank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
