"""Exact joins of vectors by cosine that compare only what a bound leaves over.

The angle between unit vectors is a distance. Targets are put in the cells of their nearest pivots; a cell's radius is its largest angle to the
pivot. A source at an angle of a to the pivot has no target within r in that cell if a is larger than r and the radius together, so it isn't sent
there. Vectors in groups meet in few cells; vectors without any structure meet in all, as the bound can't be tighter for them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

#: Pivots, which bound the cells; rows of either side that meet as one matrix product.
PIVOTS, ROWS = 64, 2048


def units(vectors: pd.Series) -> np.ndarray:
    v = np.array(vectors.tolist(), np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _classes(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each different vector of a group, with its smallest key; vectors that are null, zero or hold what is no number take no part."""
    v = F.col("vector").cast("array<double>")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(fit).groupBy(*by, v.alias("vector")).agg(F.min("key").alias("key"))


def _angles(rows: DataFrame, pivots: np.ndarray, by: list[str]) -> DataFrame:
    """rows with `angles` to all pivots and `cell`, the nearest one's number."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                angle = np.arccos(np.clip(units(b["vector"]) @ pivots.T, -1, 1))
                yield b.assign(angles=list(angle), cell=angle.argmin(axis=1).astype(np.int32))

    schema = T.StructType([*rows.schema.fields, T.StructField("angles", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])
    return rows.mapInPandas(run, schema)


def best_above(source: DataFrame, target: DataFrame, threshold: float, by: list[str] | None = None, strict: bool = False, pivots: int | None = None, rows: int = ROWS, compared: list[float] | None = None) -> DataFrame:
    """(by, src, tgt, score): each source vector's most similar target of its group at the threshold or above (strict: above it), ties to the smaller target.

    source, target: key, vector and the columns `by`; groups are equal in all of them, and a null one belongs to none. Equal vectors of a
    group are compared once. `compared` gets the share of all pairs of different vectors that the bound left to be compared. The
    pivots are the targets with the smallest hashes, one for each `rows` of them up to PIVOTS, so that sources that no bound keeps from any cell aren't copied more
    often than there are blocks of targets; any choice gives the same result. No task holds more than about `rows` rows of a side.
    """
    by = by or []
    known = lambda t: t.dropna(subset=by) if by else t
    s = materialize(_classes(known(source.select(*by, "key", "vector")), by))
    t = materialize(_classes(known(target.select(*by, "key", "vector")), by))
    pivots = pivots or max(1, min(PIVOTS, t.count() // rows))
    first = [r["vector"] for r in t.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(pivots).collect()]
    kinds = source.schema["key"].dataType.simpleString(), target.schema["key"].dataType.simpleString()
    groups = "".join(f"{c} {target.schema[c].dataType.simpleString()}, " for c in by)
    schema = f"{groups}src {kinds[0]}, tgt {kinds[1]}, score double"
    if not first:
        return source.sparkSession.createDataFrame([], schema)
    pivot = units(pd.Series(first))
    t, x = materialize(_angles(t, pivot, by)), _angles(s, pivot, by)
    cells = t.groupBy(*by, "cell").agg(F.count("*").alias("held"), F.max(F.get("angles", F.col("cell"))).alias("radius"))
    listed = cells.groupBy(*by).agg(F.collect_list(F.struct("cell", "held", "radius")).alias("cells"))  # as many as pivots at most
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    x = x.join(listed, by) if by else x.join(F.broadcast(listed))
    near = F.filter("cells", lambda c: F.get(F.col("angles"), c.cell) <= reach + c.radius)
    sent = materialize(x.select(*by, "key", "vector", F.explode(near).alias("c")).select(*by, "key", "vector", "c.cell", "c.held"))
    if compared is not None:
        each, mine = (r.groupBy(*by).agg(F.count("*").alias(n)) for r, n in ((s, "a"), (t, "b")))
        every = (each.join(mine, by) if by else each.join(F.broadcast(mine))).agg(F.sum(F.col("a") * F.col("b"))).first()[0]
        compared.append((sent.agg(F.sum("held")).first()[0] or 0) / every if every else 0.0)
    # a cell's targets in blocks, the sources that come to it in blocks, and every two of them once
    arrived = sent.groupBy(*by, "cell").agg(F.count("*").alias("come"), F.first("held").alias("held"))
    dealt = arrived.select(*by, "cell", F.ceil(F.col("come") / rows).cast("int").alias("n_a"), F.ceil(F.col("held") / rows).cast("int").alias("n_b"))
    at = [*by, "cell", "a", "b"]
    own = lambda n: F.pmod(F.xxhash64("vector"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sent.drop("held").join(dealt, [*by, "cell"]).withColumn("a", own("n_a")).withColumn("b", all_of("n_b")).select(*at, "key", "vector")
    right = t.drop("angles").join(dealt, [*by, "cell"]).withColumn("b", own("n_b")).withColumn("a", all_of("n_a")).select(*at, "key", "vector")

    def match(group: tuple, m: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        if not len(m) or not len(n):
            return pd.DataFrame({c: [] for c in (*by, "src", "tgt", "score")})
        n = n.sort_values("key", kind="stable")
        sim = units(m["vector"]) @ units(n["vector"]).T
        best = sim.argmax(axis=1)
        score = sim[np.arange(len(m)), best]
        ok = score > threshold if strict else score >= threshold
        return pd.DataFrame({**dict(zip(by, group)), "src": m["key"].to_numpy()[ok], "tgt": n["key"].to_numpy()[best[ok]], "score": score[ok]})

    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(match, schema)
    top = F.min(F.struct((-F.col("score")).alias("s"), F.col("tgt").alias("tgt"))).alias("top")
    found = found.groupBy(*by, F.col("src").alias("key")).agg(top)
    # back from the smallest key of equal vectors to all of them
    same = known(source.select(*by, F.col("key").alias("src"), F.col("vector").cast("array<double>").alias("vector"))).join(s.withColumnRenamed("key", "rep"), [*by, "vector"])
    out = same.join(found.withColumnRenamed("key", "rep"), [*by, "rep"])
    return out.select(*by, "src", F.col("top.tgt").alias("tgt"), (-F.col("top.s")).alias("score"))
