import pytest
from pyspark.sql import functions as F

from loomgraph.operators import cache, community, graph, merge, metrics, retrieve, tables, vectors


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def path(spark):
    """A - B - C and D alone."""
    nodes = frame(spark, [("A",), ("B",), ("C",), ("D",)], "entity_name string")
    edges = frame(spark, [("A", "B", 1.0), ("C", "B", 2.0)], "src_id string, tgt_id string, weight double")
    return nodes, edges


def test_edges_merge_both_directions(spark):
    r = frame(spark, [("A", "B", 1.0, "x", "k", "1"), ("B", "A", 2.0, "y", "", "2"), ("A", "B", 4.0, "x", "k", "1")], "src_id string, tgt_id string, weight double, description string, keywords string, source_id string")
    got = merge.edges(r).collect()
    assert [(e.src_id, e.tgt_id, e.weight, e.description, e.keywords) for e in got] == [("A", "B", 7.0, "x<SEP>y", "k")]


def test_type_ties_go_to_the_first_seen(spark):
    r = frame(spark, [("E", "B", "d", "1", 0), ("E", "A", "d", "1", 1), ("E", "A", "d", "2", 2), ("E", "B", "d", "2", 3)], "entity_name string, entity_type string, description string, source_id string, o int")
    assert merge.nodes(r, ["o"]).first().entity_type == "B"


def test_degrees(path):
    _, edges = path
    assert {r.node: r.degree for r in graph.degrees(edges).collect()} == {"A": 1, "B": 2, "C": 1}
    assert {r["rank"] for r in graph.edge_degrees(edges).collect()} == {3}


def test_a_loop_counts_twice(spark):
    e = frame(spark, [("A", "A")], "src_id string, tgt_id string")
    assert graph.degrees(e).first().degree == 2


def test_hops_and_components(path):
    nodes, edges = path
    start = nodes.where("entity_name = 'A'")
    assert {r.node: r.depth for r in graph.within_hops(start, edges, 5).collect()} == {"A": 0, "B": 1, "C": 2}
    assert {r.node for r in graph.within_hops(start, edges, 1, directed=True).collect()} == {"A", "B"}
    assert {r.entity_name: r.component for r in graph.components(nodes, edges).collect()} == {"A": "A", "B": "A", "C": "A", "D": "D"}
    assert {r.entity_name for r in graph.largest_component(nodes, edges).collect()} == {"A", "B", "C"}
    n, e = graph.subgraph(nodes, edges, "none", 2)
    assert (n.count(), e.count()) == (0, 0)


def test_deletes(path, spark):
    nodes, edges = path
    n, e = graph.delete_nodes(nodes.where("entity_name = 'B'"), nodes, edges)
    assert (n.count(), e.count()) == (3, 0)
    rows = frame(spark, [("x", ["c1", "c2"]), ("y", ["c1"])], "entity_name string, source_ids array<string>")
    got = graph.without_sources(rows, F.array(F.lit("c1"))).collect()
    assert [(r.entity_name, r.source_ids) for r in got] == [("x", ["c2"])]


def test_hybrid_rows_are_numbered_from_one(spark):
    h = frame(spark, [(0, "x"), (1, "y")], "ord int, v string")
    lo = frame(spark, [(0, "y"), (1, "z")], "ord int, v string")
    assert {r.v: r.id for r in retrieve.combined(h, lo, ["v"]).collect()} == {"x": 1, "y": 2, "z": 3}


@pytest.mark.parametrize(("actual", "predicted", "k", "ap", "rr", "rec"), [(["a", "c"], ["a", "b", "c"], 3, (1 + 2 / 3) / 2, 1.0, 1.0), (["a", "b", "c", "d"], ["a", "x", "y"], 3, 1.0, 1.0, 0.25), (["c"], ["a", "b", "c"], 2, 0.0, 0.0, 0.0), ([], ["a"], 1, 0.0, 0.0, 0.0)])
def test_metrics(spark, actual, predicted, k, ap, rr, rec):
    r = metrics.per_query(frame(spark, [(1, actual, predicted)], "query_id int, actual array<string>, predicted array<string>"), k).first()
    assert (r.ap, r.rr, r.recall) == pytest.approx((ap, rr, rec))


def test_turns(spark):
    m = frame(spark, [(1, i, r, t) for i, (r, t) in enumerate([("user", "u1"), ("assistant", "a1"), ("user", "u2"), ("assistant", "a2"), ("user", "u3")])], "conv_id int, turn int, role string, text string")
    assert cache.turns(m, 1).first().history == "user: u2\nassistant: a2"


def test_occurrence_and_subs(spark):
    c = frame(spark, [("a", 0, "x"), ("b", 0, "x"), ("c", 0, "y"), ("a", 1, "p"), ("b", 1, "q"), ("c", 1, "q")], "entity_name string, level int, cluster string")
    n = frame(spark, [("a", ["1", "2"]), ("b", ["3", "4"]), ("c", ["1", "2"])], "entity_name string, source_ids array<string>")
    e = frame(spark, [("a", "c", 1.0)], "src_id string, tgt_id string, weight double")
    got = {(r.level, r.cluster): (r.n_edges, r.occurrence) for r in community.schema(c, n, e).collect()}
    assert got[0, "x"] == (1, 1.0)
    assert got[0, "y"] == (1, 0.5)
    assert {(r.cluster, r.sub_cluster) for r in community.sub_clusters(c).collect()} == {("x", "p")}


def test_detected_communities_are_connected_and_nested(spark):
    two = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", 0.1)]
    edges = frame(spark, two, "src_id string, tgt_id string, weight double")
    nodes = frame(spark, [(f"{g}{i}",) for g in "ab" for i in range(5)] + [("lone",)], "entity_name string")
    got = community.detect(nodes, edges).toPandas()
    fine = got[got.level == 1].set_index("entity_name")["cluster"]
    assert fine[[f"a{i}" for i in range(5)]].nunique() == 1
    assert fine["a0"] != fine["b0"]
    assert fine["lone"] == "lone"
    both = got.pivot(index="entity_name", columns="level", values="cluster")
    assert (both.groupby(1)[0].nunique() == 1).all()


def test_upserts_and_status(spark):
    old = frame(spark, [(1, "a"), (2, "b")], "id int, v string")
    new = frame(spark, [(2, "c"), (3, "d")], "id int, v string")
    assert {tuple(r) for r in tables.upsert(old, new, mode="first").collect()} == {(1, "a"), (2, "b"), (3, "d")}
    assert {tuple(r) for r in tables.upsert(old, new).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert [r.n for r in tables.status_counts(frame(spark, [("failed",)], "status string")).collect()] == [0, 0, 0, 1]


def test_pairs_vectors_and_matches(spark):
    s = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "key int, vector array<double>")
    t = frame(spark, [(10, [1.0, 0.1]), (11, [1.0, 0.1]), (12, [0.0, 2.0])], "key int, vector array<double>")
    got = {r.src: r.tgt for r in vectors.best_matches(s, t, 0.8, rows=1).collect()}
    assert got == {1: 10, 2: 12}
    assert vectors.of_pair(frame(spark, [("b", "a")], "src_id string, tgt_id string"), frame(spark, [("a", "b", [1.0])], "src_id string, tgt_id string, vector array<double>")).first().vector == [1.0]


def test_many_queries_in_blocks_and_ties_to_the_smaller_key(spark):
    from loomgraph.operators.vectors import top_k_many

    rows = [(i, [1.0, 0.0]) for i in range(30, 0, -1)] + [(100 + i, [0.0, 1.0]) for i in range(3)]
    t = spark.createDataFrame(rows, "id int, vector array<double>").coalesce(1)
    q = t.selectExpr("id as query_id", "vector").where("query_id in (1, 2, 3, 4, 5, 100)")
    want = {(i, j) for i in range(1, 6) for j in (1, 2, 3)} | {(100, 100 + j) for j in range(3)}
    for most in (4096, 2):
        assert {(r.query_id, r.id) for r in top_k_many(t, q, 3, most=most).collect()} == want


def test_modular_communities(spark):
    """Two groups of two cliques with weaker links between: the modularity of the levels, and what no level may break."""
    rows = [(f"n{c}{i}", f"n{c}{j}", 2.0) for c in range(4) for i in range(4) for j in range(i + 1, 4)]
    rows += [(f"n{c}{i}", f"n{c + 1}{i}", 1.0) for c in (0, 2) for i in range(3)] + [("n10", "n20", 0.5), ("n00", "n00", 9.0), ("n00", "gone", 9.0)]
    edges = spark.createDataFrame(rows, "src_id string, tgt_id string, weight double")
    nodes = spark.createDataFrame([(f"n{c}{i}",) for c in range(4) for i in range(4)] + [("alone",), ("alone",), (None,)], "entity_name string")
    got = community.modular(nodes, edges, largest=5).toPandas()
    by = {k: sorted(g.entity_name) for k, g in got.groupby(["level", "cluster"])}
    assert by[0, "alone"] == ["alone"] and sorted(got[got.level == 0].entity_name) == sorted({f"n{c}{i}" for c in range(4) for i in range(4)} | {"alone"})
    last = {frozenset(g) for k, g in by.items() if len(g) <= 5}
    assert last == {frozenset(f"n{c}{i}" for i in range(4)) for c in range(4)} | {frozenset(["alone"])}
    for (level, cluster), g in by.items():  # within one cluster of the level above
        assert not level or any(set(g) < set(up) for (above, _), up in by.items() if above == level - 1)
    inner = edges.where("tgt_id <> 'gone' AND src_id <> tgt_id")
    mine = spark.createDataFrame(got[got.level == 0])
    one = mine.select("entity_name", F.lit(0).alias("level"), F.lit("x").alias("cluster"))
    q = [community.modularity(inner, c).first()["modularity"] for c in (mine, one)]
    assert q[0] > 0.5 and abs(q[1]) < 1e-9
    assert community.modular(nodes.limit(0), edges).count() == 0


def test_second_order_walks(spark):
    """Shares of the steps after a step from t to v, against the weights that they should follow."""
    links = [("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 1.0), ("b", "d", 1.0), ("d", "e", None), ("x", "y", 1.0)]
    edges = frame(spark, links, "src_id string, tgt_id string, weight double")
    starts = frame(spark, [("a",), ("lone",)], "entity_name string")
    back, out = 4.0, 0.5
    got = [r.path for r in graph.walks(edges, starts, 3, 6000, back=back, out=out).collect()]
    assert sorted(p for p in got if p[0] == "lone") == [["lone"]] * 6000
    near = {}
    for s, t, w in links:
        near.setdefault(s, {})[t] = near.setdefault(t, {})[s] = w or 1.0
    paths = [p for p in got if p[0] == "a"]
    assert len(paths) == 6000 and all(len(p) == 3 and p[1] in near[p[0]] and p[2] in near[p[1]] for p in paths)
    for v in near["a"]:
        after = [p[2] for p in paths if p[1] == v]
        assert abs(len(after) / len(paths) - near["a"][v] / sum(near["a"].values())) < 0.03
        share = {x: w / back if x == "a" else w if x in near["a"] else w / out for x, w in near[v].items()}
        for x, w in share.items():
            assert abs(after.count(x) / len(after) - w / sum(share.values())) < 0.03
    paths = graph.walks(edges, frame(spark, [(x,) for x in "abcdexy"], "entity_name string"), 4, 2)
    assert paths.count() == 14
    vectors = graph.node_vectors(paths, size=4).collect()
    assert {r.entity_name for r in vectors} == set("abcdexy") and all(len(r.vector) == 4 for r in vectors)
