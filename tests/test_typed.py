import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators import typed
from loomgraph.scratch import CLEANUP, tidy

E1 = {"entity_name": " ann &amp; co ", "entity_type": "org", "description": "d", "importance_score": 0.5}
E2 = {"entity_name": "bob", "entity_type": "person", "description": "e", "importance_score": 1}
R1 = {"src_id": "bob", "tgt_id": "ann &amp; co", "description": "works", "weight": 0.25, "order": 2}


def said(entities, relationships=()):
    return json.dumps({"entities": list(entities), "relationships": list(relationships)})


def test_only_whole_records_in_range_count(spark):
    bad = [said([{**E1, "importance_score": 1.5}]), said([{k: v for k, v in E1.items() if k != "entity_type"}]), said([], [{**R1, "order": 4}]), said([], [{**R1, "weight": None}]), said([None]),
           '{"entities": []}', "no json", '{"entities": [', "", None]
    good = [said([]), "Sure:\n" + said([E1, E2], [R1]) + "\nDone."]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(bad + good)], "i int, a string").select("i", typed.parsed(F.col("a")).alias("f")).orderBy("i").collect()
    assert [r.f is None for r in rows] == [True] * len(bad) + [False, False]
    assert [(len(r.f.entities), len(r.f.relationships)) for r in rows[-2:]] == [(0, 0), (2, 1)]


def asking(log):
    """A model whose every question is a line of the log: kind, content, attempt."""
    def noted(kind, answer):
        @F.udf(T.StringType())
        def f(content, current, critique, attempt):
            with open(log, "a") as out:
                out.write(f"{kind} {content} {attempt}\n")
            return answer(content, current, critique, attempt)

        return f

    first = noted("extract", lambda c, _, __, a: "?" if c == "never" or (c == "late" and a == 0) else said([E1]))
    look = noted("critique", lambda c, cur, _, a: f"{len(json.loads(cur)['entities'])} of 2")
    more = noted("refine", lambda c, cur, crit, a: "?" if c == "stubborn" else said([E1, E2], [R1]) if crit in ("1 of 2", "0 of 2") else cur)
    none = F.lit(None).cast("string")
    return typed.Model(lambda c, a: first(c, none, none, a), lambda c, cur, a: look(c, cur, none, a), lambda c, cur, crit, a: more(c, cur, crit, a))


def questions(log):
    try:
        return sorted(open(log).read().splitlines())
    except FileNotFoundError:
        return []


def test_turns_are_stored_and_never_asked_twice(spark, tmp_path):
    log, folder = str(tmp_path / "log"), f"file://{tmp_path}/turns"
    model = asking(log)
    chunks = spark.createDataFrame([("1", "plain", 9), ("2", "late", 9), ("3", "never", 9), ("4", "stubborn", 9), ("4", "stubborn", 8), (None, "x", 1)], "id string, content string, found int")
    got = {r.id: r.found for r in typed.extracted(chunks, model, folder, turns=0, retries=1).collect()}
    assert {k: len(v.entities) for k, v in got.items()} == {"1": 1, "2": 1, "3": 0, "4": 1}
    assert questions(log) == sorted(["extract plain 0", "extract late 0", "extract late 1", "extract never 0", "extract never 1", "extract stubborn 0"])
    open(log, "w").close()
    # one turn more: the extraction isn't asked again
    run = lambda c, b=1: {r.id: r.found for r in typed.extracted(c, model, folder, turns=1, retries=1, batches=b).collect()}
    got = run(chunks)
    assert {k: (len(v.entities), len(v.relationships)) for k, v in got.items()} == {"1": (2, 1), "2": (2, 1), "3": (2, 1), "4": (1, 0)}
    asked = questions(log)
    assert not [q for q in asked if q.startswith("extract")]
    assert [q for q in asked if "refine" in q] == sorted(["refine plain 0", "refine late 0", "refine never 0", "refine stubborn 0", "refine stubborn 1"])
    open(log, "w").close()
    assert run(chunks) == got and questions(log) == []
    # one chunk more: it alone is asked for, in any number of batches
    more = chunks.unionByName(spark.createDataFrame([("5", None, 0)], chunks.schema))
    assert len(run(more, 3)["5"].entities) == 2 and len(run(chunks)) == 4
    assert questions(log) == ["critique  0", "extract  0", "refine  0"]
    with pytest.raises(ValueError):
        typed.extracted(chunks, model, folder, batches=0)


def test_graph_and_examples(spark, tmp_path):
    found = spark.createDataFrame([("1", said([E1, E2], [R1])), ("2", said([E2], [{**R1, "order": 1, "tgt_id": "zoe"}, R1])), ("3", said([E1]))], "id string, a string").select("id", typed.parsed(F.col("a")).alias("found"))
    nodes, edges = typed.graph_of(found)
    assert {r.entity_name: (r.entity_type, r.source_id) for r in nodes.collect()} == {"ANN & CO": ("ORG", "1<SEP>3"), "BOB": ("PERSON", "1<SEP>2"), "ZOE": ('"UNKNOWN"', "2")}
    assert {(r.src_id, r.tgt_id): (r.weight, r.order) for r in edges.collect()} == {("BOB", "ANN & CO"): (0.5, 2), ("BOB", "ZOE"): (0.25, 1)}
    path = f"file://{tmp_path}/examples"
    chunks = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, content string")
    typed.write_examples(chunks, found, path)
    back = spark.read.json(path)
    assert sorted(r.content for r in back.collect()) == ["a", "b"] and sorted(back.columns) == ["content", "entities", "relationships"]
    empty = typed.graph_of(found.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_examples_are_compressed_and_the_session_stays_as_it_was(spark, tmp_path):
    chunks = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, content string")
    found = spark.createDataFrame([("1", ([E1], [R1])), ("2", ([E1], []))], f"id string, found {typed.FOUND}")
    typed.write_examples(chunks, found, f"{tmp_path}/examples")
    assert list((tmp_path / "examples").glob("part-*.json.gz")) and spark.read.json(f"{tmp_path}/examples").count() == 1
    before = spark.conf.get(CLEANUP)
    with tidy(spark):
        assert spark.conf.get(CLEANUP) == "true"
    assert spark.conf.get(CLEANUP) == before
