from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import parallel

NODES = "entity_name string, entity_type string, description string, source_id string"
EDGES = "src_id string, tgt_id string, weight double, description string, keywords string, source_id string"


def lines(listing, cut=0, more=""):
    """Answers to a listing "1. name (Type: t): d": each name with -x, the last `cut` of them left out."""
    each = F.transform(F.slice(F.split(listing, "\n"), F.lit(1), F.greatest(F.size(F.split(listing, "\n")) - cut, F.lit(0))), lambda x: F.regexp_replace(x, r"^(\d+)\. (.*) \(Type: (.*)\): (.*)$", "$1. Entity: $2-x | Type: $3 | Description: $4" + more))
    return F.array_join(each, "\n")


def relation_lines(listing):
    each = F.transform(F.split(listing, "\n"), lambda x: F.regexp_replace(x, r"^(\d+)\. (.*) → (.*): (.*)$", "$1. $2-x → $3-x | Description: $4 | Keywords: k"))
    return F.array_join(F.slice(each, 1, 1), "\n")


def extracted(chunks):
    """Every word is an entity, and each is linked to the next one."""
    w = F.split("content", " ")
    e = F.transform(w, lambda x: F.concat(F.lit('("entity"<|>"'), x, F.lit('"<|>"person"<|>"the '), x, F.lit('")')))
    pair = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(F.lit('("relationship"<|>"'), a, F.lit('"<|>"'), b, F.lit('"<|>"near"<|>"k"<|>2)')))
    return chunks.select(F.col("id").alias("chunk_id"), F.array_join(F.concat(e, pair), "##").alias("answer"))


def model(cut=0, **more):
    return parallel.Model(lambda t: F.concat(F.lit(" made "), t), extracted, lambda ls, text: lines(ls, cut), lambda ls, es, text: relation_lines(ls), **more)


def run(spark, rows, m, known=None, types=("person",)):
    pairs = spark.createDataFrame(rows, "original string, translated string, id int")
    return parallel.insert(pairs, m, spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), list(types), ("Old", "New"), known=known)


def test_pairs_reach_one_graph(spark):
    out = run(spark, [(" ann bob cid ", "eins zwei", 1), ("ann bob cid", None, 2), ("dan", "", 3), (None, "x", 4), ("", "leer", 5), ("eve", "eva", 6)], model(1), spark.createDataFrame([("eve",)], "t string").select(X.doc_id(F.col("t")).alias("id")))
    docs = {(r.content, r.language): (r.status, r.chunks_count) for r in out.documents.collect()}
    assert docs == {("ann bob cid", "Old"): ("processed", 1), ("eins zwei", "New"): ("processed", 1), ("dan", "Old"): ("processed", 1), ("made dan", "New"): ("processed", 1), ("", "Old"): ("processed", 0), ("leer", "New"): ("processed", 1)}
    pairs = sorted((r.doc, r.ord, r.original.name, r.translated.name) for r in out.entity_pairs.collect())
    # "dan" has one name and its answer none: nothing to copy from
    assert [p[1:] for p in pairs] == [(0, "ANN", "ANN-x"), (1, "BOB", "BOB-x"), (2, "CID", "BOB-x (Copy)")]
    assert [(r.translated.src, r.translated.description) for r in out.relation_pairs.orderBy("ord").collect()] == [("ANN-x", '"near"'), ("ANN-x", '"near" (Copy)')]
    nodes = {r.entity_name: (r.entity_type, r.source_id) for r in out.nodes.collect()}
    assert set(nodes) == {'"ANN"', '"BOB"', '"CID"', '"DAN"', '"ANN-X"', '"BOB-X"', '"BOB-X (COPY)"'}
    chunks = {r.content: r.id for r in out.chunks.collect()}
    assert nodes['"ANN-X"'] == ('"PERSON"', chunks["eins zwei"]) and nodes['"ANN"'] == ('"PERSON"', chunks["ann bob cid"])
    edges = {(r.src_id, r.tgt_id): (r.weight, r.description) for r in out.edges.collect()}
    assert edges[('"ANN-X"', '"BOB-X"')] == (2.0, '"near"<SEP>"near" (Copy)') and edges[('"ANN"', '"BOB"')][0] == 2.0 and len(edges) == 3
    links = out.links.orderBy("src_id").collect()
    assert [(r.src_id, r.tgt_id) for r in links] == [('"ANN"', '"ANN-X"'), ('"BOB"', '"BOB-X"'), ('"CID"', '"BOB-X (COPY)"')]
    assert links[0].original_language == "Old" and links[0].translated_language == "New" and links[0].keywords == "translation,cross-lingual,old,new"


def test_counts_are_repaired_by_the_model_first(spark):
    late = lambda original, found, text: F.lit("9. Entity: late | Type: Person | Description: d\n10. Entity: later | Type: odd | Description: d")
    out = run(spark, [("ann bob cid", "eins zwei drei", 1)], model(1, more_entities=late))
    assert [(r.translated.name, r.translated.type) for r in out.entity_pairs.orderBy("ord").collect()] == [("ANN-x", "PERSON"), ("BOB-x", "PERSON"), ("late", "Person")]
    out = run(spark, [("ann bob", "eins zwei", 1)], parallel.Model(F.upper, extracted, lambda ls, text: F.concat(lines(ls), F.lit("\n"), lines(ls)), lambda ls, es, text: relation_lines(ls), late))
    assert [(r.translated.name, r.translated.type) for r in out.entity_pairs.orderBy("ord").collect()] == [("late", "Person"), ("later", "UNKNOWN")]


def test_documents_share_entities_and_translations_fail(spark):
    out = run(spark, [("ann bob", " ", 1), ("bob cid", "eins", 2)], parallel.Model(lambda t: F.when(t == "ann bob", "").otherwise(t), extracted, lambda ls, text: lines(ls), lambda ls, es, text: relation_lines(ls)), types=())
    assert sorted((r.content, r.status) for r in out.documents.collect()) == [("", "failed"), ("ann bob", "processed"), ("bob cid", "processed"), ("eins", "processed")]
    got = [(r.original.name, r.translated.name, r.translated.type) for r in out.entity_pairs.orderBy("ord").collect()]
    assert got == [("BOB", "BOB-x", "UNKNOWN"), ("CID", "CID-x", "UNKNOWN")]


def test_no_pairs(spark):
    out = run(spark, [(None, "x", 1)], model())
    assert [t.count() for t in out] == [0] * 7
