"""Streams that are broken off, started again and given the same things twice end like one batch."""

import random

import pytest

from loomgraph.operators import flows
from loomgraph.streaming import graph as G
from loomgraph.streaming.ingest import latest_status, scan_stream

ANSWER = "chunk_id string, answer string"


def said(n, seed):
    r = random.Random(seed)
    name = lambda: f"n{r.randrange(12)}"
    out = []
    for i in range(n):
        parts = [f'("entity"<|>"{name()}"<|>"t{r.randrange(3)}"<|>"d{r.randrange(9)}")' for _ in range(3)]
        parts += [f'("relationship"<|>"{name()}"<|>"{name()}"<|>"r{r.randrange(4)}"<|>"k{r.randrange(3)}"<|>{r.randrange(5)})' for _ in range(3)]
        out.append((f"c{seed}-{i}", "##".join(parts) + "<|COMPLETE|>"))
    return [*out, (f"c{seed}-x", None), (f"c{seed}-y", ""), (f"c{seed}-z", '("relationship"<|>"lone"<|>"n1"<|>"r"<|>"k"<|>2)')]


def rows(t):
    return sorted(tuple(r) for r in t.select(*sorted(t.columns)).collect())


def put(spark, folder, part, answers):
    spark.createDataFrame(answers, ANSWER).coalesce(1).write.parquet(f"{folder}/in/{part}")


def run(spark, folder, **settings):
    stream = spark.readStream.schema(ANSWER).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    G.merge_stream(stream, f"{folder}/g", **settings).trigger(availableNow=True).start().awaitTermination()


@pytest.fixture
def state_store(spark):
    for k, v in G.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in G.STATE_STORE:
        spark.conf.unset(k)


def test_graph_grows_by_batches(spark, tmp_path, state_store):
    parts = [said(8, i) for i in range(4)]
    put(spark, tmp_path, 0, parts[0])
    put(spark, tmp_path, 1, parts[1])
    run(spark, tmp_path)
    put(spark, tmp_path, 2, parts[2] + parts[0][:5])  # chunks that were answered before
    run(spark, tmp_path)
    everything = spark.createDataFrame(sum(parts[:3], []), ANSWER)
    none = flows.extract_graph(everything.limit(0))
    want = flows.extract_into(everything, *none)
    got = G.read_graph(spark, f"{tmp_path}/g")
    assert [rows(t) for t in got] == [rows(t) for t in want]
    # a snapshot gives the same graph, and what comes after it is merged with it
    assert G.compact(spark, f"{tmp_path}/g") == 2 and G.compact(spark, f"{tmp_path}/g") is None
    assert [rows(t) for t in G.read_graph(spark, f"{tmp_path}/g")] == [rows(t) for t in want]
    put(spark, tmp_path, 3, parts[3])
    run(spark, tmp_path)
    want = flows.extract_into(spark.createDataFrame(sum(parts, []), ANSWER), *none)
    got = G.read_graph(spark, f"{tmp_path}/g")
    assert [rows(t) for t in got] == [rows(t) for t in want]
    # the last batch's own nodes and edges, as they are in the whole graph
    own = flows.extract_graph(spark.createDataFrame(parts[3], ANSWER))
    nodes, edges = G.read_graph(spark, f"{tmp_path}/g", batch=3)
    assert {r.src_id + r.tgt_id for r in edges.collect()} == {r.src_id + r.tgt_id for r in own[1].collect()}
    assert set(rows(edges)) <= set(rows(want[1])) and {r.entity_name for r in own[0].collect()} <= {r.entity_name for r in nodes.collect()}


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    put(spark, tmp_path, 0, said(5, 1))
    put(spark, tmp_path, 1, said(5, 2))
    run(spark, tmp_path)
    before = [rows(t) for t in G.read_graph(spark, f"{tmp_path}/g")]
    # as after a failure between the batch's work and its commit
    for f in (tmp_path / "g/progress/commits").glob("*1"):
        f.unlink()
    for f in (tmp_path / "g/progress/commits").glob(".1.crc"):
        f.unlink()
    run(spark, tmp_path)
    assert [rows(t) for t in G.read_graph(spark, f"{tmp_path}/g")] == before


def test_a_batch_holds_no_state_of_members(spark, tmp_path):
    put(spark, tmp_path, 0, said(5, 1))
    put(spark, tmp_path, 1, said(5, 1))
    run(spark, tmp_path, once=False)
    assert not (tmp_path / "g/progress/state").exists()
    one, both = (flows.extract_graph(spark.createDataFrame(said(5, 1) * n, ANSWER)) for n in (1, 2))
    got = G.read_graph(spark, f"{tmp_path}/g")
    assert [rows(t) for t in got] == [rows(t) for t in both] and rows(got[0]) == rows(one[0])


def test_graph_that_was_there_before(spark, tmp_path):
    nodes = spark.createDataFrame([('"N1"', '"OLD"', "d1<SEP>x", "s1"), ('"FAR"', '"OLD"', "y", "s2")], "entity_name string, entity_type string, description string, source_id string")
    edges = spark.createDataFrame([('"N2"', '"N1"', 2.5, "r", "k", "s1<SEP>s2"), ('"FAR"', '"GONE"', None, "r", "", "s3")], "src_id string, tgt_id string, weight double, description string, keywords string, source_id string")
    answers = said(6, 3)
    put(spark, tmp_path, 0, answers)
    G.start_from(f"{tmp_path}/g", nodes, edges)
    run(spark, tmp_path, once=False)
    got = G.read_graph(spark, f"{tmp_path}/g")
    want = flows.extract_into(spark.createDataFrame(answers, ANSWER), nodes, edges.fillna(0.0))
    assert [rows(t) for t in got] == [rows(t) for t in want]


def test_files_come_once(spark, tmp_path):
    home, out = tmp_path / "in", f"{tmp_path}/out"
    (home / "deep").mkdir(parents=True)

    def torn(content):
        raise ValueError("torn")

    def go():
        scan_stream(spark, str(home), out, {"pdf": torn, "docx": lambda b: b.decode()[::-1]}, at_once=2, size=2, overlap=1).trigger(availableNow=True).start().awaitTermination()
        read = lambda t: spark.read.parquet(f"{out}/{t}")
        files = {r.path.rsplit("/", 1)[1]: (r.id is None, r.error) for r in read("files").collect()}
        assert read("files").count() == len(files)
        return files, sorted((r.status, r.error) for r in latest_status(read("status").drop("batch")).collect()), sorted(r.content for r in read("chunks").collect())

    (home / "a.txt").write_text(" one two three ")
    (home / "b.TXT").write_text("one two three")  # the same document
    (home / "deep" / "c.docx").write_text("olleh")
    (home / "d.pdf").write_text("x")
    (home / "no.bin").write_text("x")
    first = {"a.txt": (False, None), "b.TXT": (False, None), "c.docx": (False, None), "d.pdf": (True, "ValueError: torn")}
    assert go() == (first, [("failed", "ValueError: torn"), ("processed", None), ("processed", None)], ["hello", "one two", "three", "two three"])
    (home / "e.md").write_bytes(b"\xff\xfe")
    (home / "f.txt").write_text("  \n")
    (home / "g.md").write_text("four")
    later = first | {"e.md": (True, "not UTF-8"), "f.txt": (True, "no text"), "g.md": (False, None)}
    want = later, [("failed", "ValueError: torn"), ("failed", "no text"), ("failed", "not UTF-8"), *[("processed", None)] * 3], ["four", "hello", "one two", "three", "two three"]
    assert go() == want
    assert go() == want  # nothing new
