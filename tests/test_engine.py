import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators.vectors import embed, hashed_words
from loomgraph.plans.engine import Engine, Graph, Params
from loomgraph.sources import files
from loomgraph.streaming.ingest import enqueue, ingest_stream, latest_status, process, retry_failed


@pytest.fixture(scope="module")
def engine(spark):
    nodes = spark.createDataFrame([("ANNA", "P", "anna paints", ["c1"]), ("BEN", "P", "ben sings", ["c1", "c2"]), ("OSLO", "L", "oslo city", ["c2"])], "entity_name string, entity_type string, description string, source_ids array<string>")
    edges = spark.createDataFrame([("ANNA", "BEN", "friends", "friendship", 2.0, ["c1"]), ("BEN", "OSLO", "lives", "home", 1.0, ["c2"])], "src_id string, tgt_id string, description string, keywords string, weight double, source_ids array<string>")
    chunks = spark.createDataFrame([("c1", "anna and ben are friends", 5), ("c2", "ben lives in oslo", 4)], "id string, content string, tokens long")
    v = lambda t, text, *keys: embed(t.withColumn("content", text), hashed_words).select(*keys, "vector")
    g = Graph(nodes, edges, chunks, v(nodes, F.lower(F.concat_ws(" ", "entity_name", "description")), "entity_name"), v(edges, F.concat_ws(" ", "keywords", F.lower("src_id"), F.lower("tgt_id")), "src_id", "tgt_id"), v(chunks, F.col("content"), "id"))
    return Engine(g, hashed_words)


def test_modes(engine):
    p = lambda mode: Params(mode=mode, top_k=2, threshold=0.1)
    local = engine.query("who is anna", ["anna"], [], p("hybrid"))  # no high-level keywords: local
    assert local["entities"].first().entity_name == "ANNA"
    assert {r.id for r in local["sources"].collect()} >= {"c1"}
    far = engine.query("friendship", [], ["friendship"], p("hybrid"))
    assert (far["relations"].first().src_id, far["relations"].first().tgt_id) == ("ANNA", "BEN")
    both = engine.query("x", ["oslo"], ["friendship"], p("mix"))
    assert set(both) == {"entities", "relations", "sources", "vectors"}
    assert [r.number for r in both["entities"].orderBy("number").collect()][0] == 1
    assert engine.query("x", [], [], p("hybrid")) == {}
    assert engine.query("oslo", [], [], p("naive"))["vectors"].first().id == "c2"
    text = engine.render(local["entities"], ["entity_name", "description"]).first().context
    assert text.split("\n")[:2] == ['"entity_name","description"', '"ANNA","anna paints"']


def test_params_are_checked():
    with pytest.raises(ValueError):
        Params(mode="odd")
    with pytest.raises(ValueError):
        Params(top_k=0)


def test_stream_ends_like_a_batch(spark, tmp_path):
    schema = "text string"
    for i, texts in enumerate([["a b c", " a b c "], ["a b c", "d e"], ["", None]]):
        spark.createDataFrame([(t,) for t in texts], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    ingest_stream(spark, stream, f"{tmp_path}/out", 2, 1).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/chunks")
    want, _ = process(enqueue(spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")), 2, 1)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    assert spark.read.parquet(f"{tmp_path}/out/status").count() == 3


def test_graph_files(spark, tmp_path):
    n = spark.createDataFrame([("A & B", "T", "d<x>", "c1")], "entity_name string, entity_type string, description string, source_id string")
    e = spark.createDataFrame([("A & B", "C", 2.5, "d", "k", "c1")], "src_id string, tgt_id string, weight double, description string, keywords string, source_id string")
    body = "\n".join(r.value for r in files.graph_lines(n, e).collect())
    f = tmp_path / "g.graphml"
    f.write_text(f"<graphml><graph>\n{body}\n</graph></graphml>")
    nodes, edges = files.read_graph(spark, str(f))
    assert tuple(nodes.first()) == ("A & B", "T", "d<x>", "c1")
    assert edges.first().weight == 2.5


def test_graph_files_in_parts(spark, tmp_path):
    said = ['say "x" & <y>', "two\nlines\r\n\tand more", "plain"]
    n = spark.createDataFrame([(f"N{i:03}", "T", said[i % 3], "c1") for i in range(200)], "entity_name string, entity_type string, description string, source_id string")
    e = spark.createDataFrame([(f"N{i:03}", f"N{i + 1:03}", float(i), said[i % 3], "k", "c1") for i in range(199)], "src_id string, tgt_id string, weight double, description string, keywords string, source_id string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files.write_graph(n, e, f"{tmp_path}/g")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "g").glob("part-*"))
    assert len(parts) > 2
    rows = lambda t: sorted(tuple(r) for r in t.collect())
    got = files.read_graph(spark, f"{tmp_path}/g")
    assert [rows(t) for t in got] == [rows(n), rows(e)]
    # together the parts are one document, which needs no lines
    f = tmp_path / "whole.graphml"
    f.write_text("".join(p.read_text() for p in parts).replace("<data ", "\n  <data "))
    whole = files.read_graph(spark, str(f))
    assert [t.count() for t in whole] == [200, 199]
    assert whole[1].agg({"weight": "sum"}).first()[0] == sum(range(199))


def test_folders_and_json(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.TXT").write_text("hello")
    (tmp_path / "d" / "b.bin").write_text("no")
    found = files.scan(spark, str(tmp_path / "d"))
    assert [r.text for r in files.extract_text(found).collect()] == ["hello"]
    assert files.scan(spark, str(tmp_path / "d"), found.select("path")).count() == 0
    (tmp_path / "d" / "c.docx").write_text("x")
    (tmp_path / "d" / "e.pdf").write_text("y")

    def broken(content):
        raise ValueError("torn")

    read = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.extract_text(files.scan(spark, str(tmp_path / "d")), {"pdf": broken}).collect()}
    assert read == {"a.TXT": ("hello", None), "c.docx": (None, "no reader for .docx"), "e.pdf": (None, "ValueError: torn")}
    (tmp_path / "kv.json").write_text('{"k1": {"v": 1}, "k2": {"v": 2}}')
    from pyspark.sql import types as T

    got = files.read_keyed_json(spark, str(tmp_path / "kv.json"), T.StructType([T.StructField("v", T.IntegerType())]))
    assert {(r.id, r.v) for r in got.collect()} == {("k1", 1), ("k2", 2)}


def test_matches_by_language(spark, tmp_path):
    p = lambda a: spark.createDataFrame([(a, "x", "en", "fr")], "src string, tgt string, src_lang string, tgt_lang string")
    files.write_matches(p("1"), f"{tmp_path}/m", "20240101")
    files.write_matches(p("2"), f"{tmp_path}/m", "20240102")
    assert files.read_matches(spark, f"{tmp_path}/m", ("en", "fr")).count() == 2
    assert [r.src for r in files.read_matches(spark, f"{tmp_path}/m", latest=True).collect()] == ["2"]


def test_embed_checks_the_model(spark):
    t = spark.createDataFrame([("a",), ("b",)], "content string")
    with pytest.raises(Exception, match="vector for each text"):
        embed(t, lambda x: np.zeros((0, 2))).collect()


def test_failed_documents_are_finished_by_a_retry(spark, tmp_path):
    def model(text):
        if "bad" in text:
            raise ValueError("no answer")
        return text.upper()

    spark.createDataFrame([("a b c",), ("d bad e",), (" a b c ",), (None,)], "text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("text string").parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    ingest_stream(spark, stream, out, 2, 1, ask=model).trigger(availableNow=True).start().awaitTermination()
    read = lambda t: spark.read.parquet(f"{out}/{t}").drop("batch")
    assert sorted((r.status, r.error) for r in read("status").collect()) == [("failed", "ValueError: no answer"), ("processed", None)]
    assert {r.answer for r in read("answers").collect()} == {"A B", "B C", "C"}
    assert retry_failed(spark, out, model, 2, 1) == 1 and retry_failed(spark, out, str.upper, 2, 1) == 1
    assert [r.status for r in latest_status(read("status")).collect()] == ["processed"] * 2
    assert sorted(r.answer for r in read("answers").collect()) == ["A B", "B C", "BAD E", "C", "D BAD", "E"]
    assert read("chunks").count() == 6 and retry_failed(spark, out, model, 2, 1) == 0


def test_chosen_chunks_are_kept_by_query(spark, tmp_path):
    path = str(tmp_path / "chosen")
    rows = lambda *r: spark.createDataFrame(list(r), "query string, ord int, id string, content string")
    files.store_chosen(rows(("who?", 0, "c1", "a"), ("who?", 1, "c2", "b"), ("where/é=?", 0, "c1", "a")), path)
    files.store_chosen(rows(("who?", 0, "c3", "x")), path)
    assert [tuple(r) for r in files.read_chosen(spark, path, "who?").collect()] == [("who?", 0, "c3", "x")]
    assert {(r.query, r.id) for r in files.read_chosen(spark, path).collect()} == {("who?", "c3"), ("where/é=?", "c1")}
    assert files.read_chosen(spark, path, "none").count() == 0
