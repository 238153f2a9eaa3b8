import random

from pyspark.sql import functions as F

from loomgraph.operators import community, flows, tables


def test_questions_and_graph(spark):
    def model(question, history):
        if question == "more?":
            return "no"
        if question == "go on":
            return '##("relationship"<|>"A"<|>"Z"<|>"r"<|>"k"<|>3)'
        return '("entity"<|>"a"<|>"t"<|>"d")'

    chunks = spark.createDataFrame([("c1", "x"), ("c2", "y")], "id string, content string")
    known = spark.createDataFrame([("c2",)], "chunk_id string")
    answers = flows.ask(chunks, model, lambda t: f"read {t}", "go on", "more?", 2, known)
    assert [r.chunk_id for r in answers.collect()] == ["c1"]
    nodes, edges = flows.extract_graph(answers)
    assert {r.entity_name: r.entity_type for r in nodes.collect()} == {'"A"': '"T"', '"Z"': '"UNKNOWN"'}
    assert edges.first().weight == 3.0


def test_answers_are_taken_apart_once(spark):
    a = spark.createDataFrame([("c1", '("entity"<|>"a"<|>"t"<|>"d")##("relationship"<|>"a"<|>"z"<|>"r"<|>"k"<|>3)')], "chunk_id string, answer string")
    n = spark.createDataFrame([('"A"', '"OLD"', "x<SEP>d", "s1")], "entity_name string, entity_type string, description string, source_id string")
    e = spark.createDataFrame([('"FAR"', '"A"', 2.0, "r", "", "s1")], "src_id string, tgt_id string, weight double, description string, keywords string, source_id string")
    nodes, edges = flows.extract_into(a, n, e)
    for t in (nodes, edges):
        assert "regexp_extract" not in t._jdf.queryExecution().optimizedPlan().toString()
    assert {r.entity_name: (r.entity_type, r.description, r.source_id) for r in nodes.collect()} == {'"A"': ('"T"', '"d"<SEP>d<SEP>x', "c1<SEP>s1"), '"Z"': ('"UNKNOWN"', '"r"', "c1"), '"FAR"': ('"UNKNOWN"', "r", "s1")}
    assert {(r.src_id, r.tgt_id): r.weight for r in edges.collect()} == {('"A"', '"Z"'): 3.0, ('"A"', '"FAR"'): 2.0}


def test_chunks_and_batches(spark):
    p = spark.createDataFrame([(0, " a "), (1, "b"), (2, "a")], "ord int, content string")
    doc, c = flows.custom_chunks("a b a", p)
    assert doc.count() == 1
    assert sorted((r.content, r.chunk_order_index) for r in c.collect()) == [("a", 0), ("b", 1)]
    assert flows.custom_chunks("a b a", p, c.where("content = 'a'"))[1].count() == 1
    assert flows.in_batches(c, 1).where("batch < 0 or batch > 1").count() == 0


def test_reports_deepest_first(spark):
    seen = []

    def write(rows):
        seen.append({r.level for r in rows.select("level").distinct().collect()})
        return rows.groupBy("level", "cluster").agg(F.count("*").cast("string").alias("report"))

    c = spark.createDataFrame([("a", 0, "x"), ("b", 0, "x"), ("a", 1, "p"), ("b", 1, "q")], "entity_name string, level int, cluster string")
    n = spark.createDataFrame([("a", "d", 1, 2), ("b", "d", 1, 2)], "entity_name string, description string, degree long, tokens int")
    e = spark.createDataFrame([("a", "b", "d", 2, 3)], "src_id string, tgt_id string, description string, rank long, tokens int")
    got = {(r.level, r.cluster): r.report for r in flows.report_levels(c, n, e, write, 100).collect()}
    assert seen == [{1}, {0}]
    assert got == {(0, "x"): "3", (1, "p"): "2", (1, "q"): "2"}


def test_languages_and_pairs(spark):
    e = spark.createDataFrame([("a", "b", "en", "fr")], "src_id string, tgt_id string, original_language string, translated_language string")
    assert {r.entity_name: r.language for r in flows.languages_of_entities(e).collect()} == {"a": "en", "b": "fr"}
    n = spark.createDataFrame([("a",), ("c",)], "entity_name string")
    assert [r.entity_name for r in flows.unlinked(n, e).collect()] == ["c"]
    t = spark.createDataFrame([("it is Paris", ["rome", "paris"]), ("NO MATCH for paris", ["paris"])], "t string, n array<string>")
    assert [r.m for r in t.select(flows.named_in(F.col("t"), F.col("n")).alias("m")).collect()] == ["paris", None]
    a = spark.createDataFrame([(1, "1. Entity: x | Type: t | Description: d\n2. Entity: y | Type: t | Description: d", "1. Entity: X | Type: t | Description: d")], "doc int, original string, translated string")
    assert [(r.src_id, r.tgt_id) for r in flows.parallel_pairs(a).orderBy("ord").collect()] == [("x", "X"), ("y", "X (Copy)")]


def test_evaluation(spark):
    p = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "query_id int, ord int, context_id string")
    t = spark.createDataFrame([(1, ["b"]), (2, ["c"])], "query_id int, actual array<string>")
    got = {r.k: (r.map, r.mrr, r.recall) for r in flows.evaluate(p, t, [1, 2]).collect()}
    assert got == {1: (0.0, 0.0, 0.0), 2: (0.25, 0.25, 0.5)}


def test_points(spark):
    p = spark.createDataFrame([("a", 5, 3), ("b", 9, 3), ("c", 0, 1), ("d", 1, 9)], "answer string, score int, tokens int")
    assert {r.answer for r in flows.map_reduce_points(p, 6).collect()} == {"a", "b"}


def test_reports_stand_in_for_what_does_not_fit(spark):
    """A community of four nodes of which three fit: its sub-community's report comes first, then what it leaves out."""
    seen = {}

    def write(rows):
        for r in rows.orderBy("kind", "ord").collect():
            seen.setdefault((r.level, r.cluster), []).append((r.kind, r.name))
        return rows.groupBy("level", "cluster").agg(F.lit("two words").alias("report"))

    c = spark.createDataFrame([(x, 0, "x") for x in "abcd"] + [(x, 1, "p") for x in "ab"] + [("e", 0, "y")], "entity_name string, level int, cluster string")
    n = spark.createDataFrame([(x, "d", k, 3) for k, x in enumerate("edcba")], "entity_name string, description string, degree long, tokens int")
    e = spark.createDataFrame([("a", "b", "d", 9, 1), ("b", "c", "d", 8, 1), ("c", "d", "d", 7, 1)], "src_id string, tgt_id string, description string, rank long, tokens int")
    o = spark.createDataFrame([(1, "p", 1.0)], "level int, cluster string, occurrence double")
    flows.report_levels(c, n, e, write, 22, o)
    assert seen[0, "y"] == [("node", "e")]
    assert seen[1, "p"] == [("edge", "a -> b"), ("edge", "b -> c"), ("node", "a"), ("node", "b")]
    # 22 - 2 tokens of the report: 10 for nodes, three of them; those that the report doesn't cover first
    assert seen[0, "x"] == [("edge", "c -> d"), ("edge", "a -> b"), ("edge", "b -> c"), ("node", "c"), ("node", "d"), ("node", "a"), ("report", "p")]
    seen.clear()
    flows.report_levels(c, n, e, write, 22)
    assert seen[0, "x"][-3:] == [("node", "a"), ("node", "b"), ("node", "c")]


def test_a_large_key_is_cut_before_its_rows_meet(spark):
    r = random.Random(5)
    data = [(f"k{r.randrange(3)}", i, r.choice([0, 0, 1, 2, 7, None])) for i in range(400)]
    t = spark.createDataFrame(data, "k string, o int, tokens int")
    got = tables.within_budget(t, [F.desc("o")], F.col("tokens"), 20, ["k"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.index("Exchange"):]
    want = []
    for k in ("k0", "k1", "k2"):
        total, any_ = 0, False
        for row in sorted((x for x in data if x[0] == k), key=lambda x: -x[1]):
            total, any_ = total + (row[2] or 0), any_ or row[2] is not None
            if any_ and total <= 20:
                want.append(row)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_lines_of_edges_that_are_stored_twice(spark):
    c = spark.createDataFrame([(x, level, k) for x, k in zip("abcd", "xxyy", strict=True) for level in (0, 1)], "entity_name string, level int, cluster string")
    n = spark.createDataFrame([(x, "d", 1, 2) for x in "abcd"], "entity_name string, description string, degree long, tokens int")
    e = spark.createDataFrame([("a", "b", "d", 2, 3), ("b", "a", "d", 2, 3), ("b", "c", "e", 4, 3), ("d", "d", "l", 1, 3), ("a", "z", "d", 1, 3)], "src_id string, tgt_id string, description string, rank long, tokens int")
    got = sorted((r.level, r.cluster, r.ord, r.name) for r in community.describe(c, n, e, 1000).collect() if r.kind == "edge")
    assert got == [(v, k, i, x) for v in (0, 1) for k, names in (("x", ["b -> c", "a -> b", "a -> z"]), ("y", ["b -> c", "d -> d"])) for i, x in enumerate(names)]
    covered = {(r.cluster, r.name) for r in community._lines(c, n, e, spark.createDataFrame([("b", 0, "x")], "entity_name string, level int, cluster string")).collect() if r.covered}
    assert covered == {("x", "b"), ("x", "a -> b"), ("x", "b -> c")}
