"""Vector tables: top-k by cosine, upserts, pairwise matches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from . import similar


def nearest(vectors: DataFrame, query: Column, threshold: float | None = None, vector: str = "vector", strict: bool = False) -> DataFrame:
    """All rows with a cosine at the threshold or above (strict: above it), with score: a filter, without an order."""
    scored = vectors.withColumn("score", cosine(F.col(vector), query))
    if threshold is None:
        return scored.where(F.col("score").isNotNull())
    return scored.where(F.col("score") > threshold if strict else F.col("score") >= threshold)


def top_k(vectors: DataFrame, query: Column, k: int, threshold: float | None = None, key: str = "id", vector: str = "vector", strict: bool = False) -> DataFrame:
    """The k nearest rows by cosine, ties to the smaller key, with score and ord. One pass; each task keeps k rows."""
    best = nearest(vectors, query, threshold, vector, strict).orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("ord", (F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1).cast("long"))


def top_k_many(vectors: DataFrame, queries: DataFrame, k: int, threshold: float = 0.2, key: str = "id", vector: str = "vector", most: int = 4096) -> DataFrame:
    """(query_id, key, score, ord): the k nearest rows of each query vector (query_id, vector), ties to the smaller key.

    Up to `most` queries are sent to every task as one matrix; more are dealt to blocks of about that many, each of which meets
    blocks of the vectors, so no task holds a side whole.
    """
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    schema = f"query_id {kinds[0]}, {key} {kinds[1]}, score double"
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)

    def near_rows(ids: list, q: np.ndarray, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(key, kind="stable")
        s = unit(np.array(b[vector].tolist(), np.float64)) @ q.T
        out = [pd.DataFrame({"query_id": [], key: [], "score": []})]
        for j in range(len(ids)):
            near = np.argsort(-s[:, j], kind="stable")[:k]
            near = near[s[near, j] >= threshold]
            out.append(pd.DataFrame({"query_id": ids[j], key: b[key].to_numpy()[near], "score": s[near, j]}))
        return pd.concat(out[1:] or out)

    got = queries.select("query_id", vector).limit(most + 1).toPandas()
    if len(got) <= most:
        ids = got["query_id"].tolist()
        q = unit(np.array(got[vector].tolist(), np.float64).reshape(len(ids), -1))

        def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in rows:
                if len(b) and ids:
                    yield near_rows(ids, q, b)

        found = vectors.select(key, vector).mapInPandas(run, schema)
    else:
        n_q, n_v = -(-queries.count() // most), max(1, -(-vectors.count() // 8192))
        x = queries.select("query_id", vector, F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("_a")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))))
        y = vectors.select(key, vector, F.pmod(F.xxhash64(key), F.lit(n_v)).cast("int").alias("_b")).withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

        def match(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(y):
                return pd.DataFrame({"query_id": [], key: [], "score": []})
            return near_rows(x["query_id"].tolist(), unit(np.array(x[vector].tolist(), np.float64)), y)

        found = x.groupBy("_a", "_b").cogroup(y.groupBy("_a", "_b")).applyInPandas(match, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("ord", (F.row_number().over(w) - 1).cast("long")).where(F.col("ord") < k)


def nearest_by_hash(vectors: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """Approximate k nearest by random projections on unit vectors: (key, distance, score), score = 1 - cosine distance."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    unit = F.transform(F.col(vector).cast("array<double>"), lambda x: x / F.sqrt(F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda s, y: s + y * y)))
    t = vectors.select(key, array_to_vector(unit).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=1.0, numHashTables=8, seed=7).fit(t)
    q = np.asarray(query, np.float64)
    near = model.approxNearestNeighbors(t, Vectors.dense(q / np.linalg.norm(q)), k)
    d = F.col("distCol") * F.col("distCol") / 2
    return near.select(key, d.alias("distance"), (1 - d).alias("score"))


def embed(rows: DataFrame, model: Callable[[list[str]], np.ndarray], text: str = "content", vector: str = "vector", size: int = 32) -> DataFrame:
    """rows with a vector for each text, `size` texts to a call of the model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made: list[np.ndarray] = []
            for i in range(0, len(b), size):
                part = model(b[text].iloc[i : i + size].fillna("").tolist())
                if len(part) != len(b.iloc[i : i + size]):
                    raise ValueError("the model has to return a vector for each text")
                made += list(np.asarray(part, np.float32))
            yield b.assign(**{vector: made})

    from pyspark.sql import types as T

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(vector, T.ArrayType(T.FloatType()))]))


def hashed_words(texts: list[str], size: int = 64) -> np.ndarray:
    """A stand-in embedder: signed hashed word counts, the same on every run."""
    import zlib

    out = np.zeros((len(texts), size), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % size] += 1 if h >> 16 & 1 else -1
    return out


def best_matches(source: DataFrame, target: DataFrame, threshold: float, rows: int = similar.ROWS) -> DataFrame:
    """(src, tgt, score): for each source vector its most similar target at the threshold or above, ties to the smaller target.

    source, target: key, vector. What can't reach the threshold by its angles to pivots isn't compared; no task holds a side whole.
    """
    return similar.best_above(source, target, threshold, rows=rows)


def of_pair(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The vector of each pair's edge whichever way round it is stored; vectors: src_id, tgt_id, vector."""
    v = vectors.select(F.least("src_id", "tgt_id").alias("_a"), F.greatest("src_id", "tgt_id").alias("_b"), "vector")
    return pairs.join(v, (F.least("src_id", "tgt_id") == v._a) & (F.greatest("src_id", "tgt_id") == v._b), "left").drop("_a", "_b")


def without_entity(relations: DataFrame, name: str) -> DataFrame:
    return relations.where((F.col("src_id") != name) & (F.col("tgt_id") != name))


def stable_uuid(c: Column) -> Column:
    """A version 4 shaped UUID from the first half of a text's SHA-256."""
    h = F.sha2(c, 256)
    variant = F.substring(F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8))), -1, 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
