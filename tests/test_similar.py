"""Joins by cosine against brute force, and what the bound saves."""

import numpy as np
import pytest

from loomgraph.operators import similar, smallworld, tables, vectors
from pyspark.sql import functions as F


def clustered(n, seed, spread, size=16, centres=12):
    middle = np.random.default_rng(1).normal(size=(centres, size))
    r = np.random.default_rng(seed)
    return middle[r.integers(centres, size=n)] + spread * r.normal(size=(n, size))


def table(spark, vectors, groups=2):
    rows = [(i, f"g{i % groups}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(9_000, "g0", None), (9_001, "g0", [0.0] * len(vectors[0])), (9_002, "g0", [float("nan")] * len(vectors[0])), (9_003, None, rows[0][2]), (9_004, "g1", rows[3][2]), (9_005, "g0", rows[0][2])]
    return spark.createDataFrame(rows, "key long, g string, vector array<double>"), rows


def brute(a, b, threshold, grouped, strict):
    fit = lambda v: v is not None and any(v) and not any(np.isnan(v))
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    out = {}
    for k, g, v in a:
        if not fit(v) or grouped and g is None:
            continue
        best = min(((-round(float(unit(v) @ unit(w)), 9), j) for j, h, w in b if fit(w) and (not grouped or h == g)), default=None)
        if best and (-best[0] > threshold if strict else -best[0] >= threshold):
            out[k] = (best[1], -best[0])
    return out


@pytest.mark.parametrize(("spread", "threshold", "grouped", "strict"), [(0.05, 0.95, True, True), (0.05, 0.9, False, False), (2.0, 0.3, False, False), (0.3, -1.0, True, False)])
def test_best_above(spark, spread, threshold, grouped, strict):
    (s, a), (t, b) = table(spark, clustered(120, 2, spread)), table(spark, clustered(150, 3, spread))
    share = []
    got = similar.best_above(s, t, threshold, ["g"] if grouped else None, strict, pivots=16, rows=20, compared=share)
    assert got.columns == [*(["g"] if grouped else []), "src", "tgt", "score"]
    assert {r.src: (r.tgt, round(r.score, 9)) for r in got.collect()} == brute(a, b, threshold, grouped, strict)
    assert share[0] < 0.5 if spread == 0.05 else share[0] <= 1


def test_best_above_without_rows(spark):
    s, _ = table(spark, clustered(5, 2, 1.0))
    assert similar.best_above(s, s.limit(0), 0.5).count() == similar.best_above(s.limit(0), s, 0.5).count() == 0


def test_budget_over_many_rows(spark):
    t = spark.range(20_000).select("id", (F.col("id") * 7919 % 20_011).alias("o"), (F.col("id") % 5).alias("tokens"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    rows, want, total = sorted((r.o, r.tokens) for r in t.collect()), [], 0
    for o, n in rows:
        total += n
        if total > 500:
            break
        want.append(o)
    got = tables.within_budget(t, [F.col("o")], F.col("tokens"), 500)
    assert got.columns == t.columns and sorted(r.o for r in got.collect()) == want
    assert tables.within_budget(t, [F.col("o")], F.col("tokens"), 0).count() == 0


@pytest.mark.parametrize("spread", [0.3, 5.0])
def test_small_world_recall(spark, tmp_path, spread):
    v = clustered(900, 5, spread, 24)
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)]
    t = spark.createDataFrame([*rows, (2000, None), (2001, [0.0] * 24)], "id long, vector array<double>")
    path = str(tmp_path / "index")
    smallworld.build(t.where("id < 600 OR id >= 2000"), path, shard=250)
    smallworld.build(t.where("id >= 600"), path, shard=250)  # more vectors later
    q = t.where("id % 10 = 0").select(F.col("id").alias("query_id"), "vector")
    found = smallworld.nearest(spark, path, q, 8, width=64, block=40).collect()
    want = {}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(0, 900, 10):
        want[i] = {int(x) for x in np.argsort(-(unit @ unit[i]), kind="stable")[:8]}
    got = {}
    for r in found:
        assert abs(r.score - float(unit[r.key] @ unit[r.query_id])) < 1e-9
        got.setdefault(r.query_id, set()).add(r.key)
    assert set(got) == set(want) and all(len(x) == 8 for x in got.values())
    assert sum(len(got[i] & want[i]) for i in want) >= 0.95 * 8 * len(want)


def test_recall_of_random_projections(spark):
    v = clustered(500, 6, 5.0, 24)
    t = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, vector array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for i in (0, 77, 300):
        near = {r.id for r in vectors.nearest_by_hash(t, v[i].tolist(), 10).collect()}
        hits += len(near & {int(x) for x in np.argsort(-(unit @ unit[i]), kind="stable")[:10]})
    assert hits >= 0.9 * 30
