"""Queries over flows of several operators, stored tables and files, translations and windows; with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import cache, community, extract, flows, graph, merge, metrics, parallel, retrieve, tables, typed, vectors
from ..scratch import scratch
from ..sources import files
from ..streaming import graph as stream_graph
from ..streaming.ingest import scan_stream, sessions, windowed_counts
from .catalog_graph import CL, COS, EDGES, GLOBAL, ENDS, NAIVE, REC, _naive, best, described_edges, edges, given_clusters, global_kept, nodes, predictions, records, sharing
from .catalog_text import WORDS, answers, table
from .engine import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = sharing(f)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def named(c):
    return F.concat(F.lit("E"), c.cast("string"))


# Graph tables ------------------------------------------------------------------------------------------------------------------------


@_query("SELECT 'E' || (vec_id * 2) AS entity_name, b.label::VARCHAR AS entity_type FROM embeddings a LEFT JOIN (SELECT vec_id AS v, label FROM embeddings) b ON b.v = a.vec_id * 2")
def get_node(spark, d):
    names = table(spark, d, "embeddings").select(named(F.col("vec_id") * 2).alias("entity_name"))
    return graph.get_nodes(names, nodes(spark, d)).select("entity_name", "entity_type")


PAIRS = "p AS (SELECT least('E' || vec_id, 'E' || (vec_id + 7)) AS src_id, greatest('E' || vec_id, 'E' || (vec_id + 7)) AS tgt_id FROM embeddings)"


def neighbours(spark, d) -> DataFrame:
    """A pair for each embedding, the larger number first."""
    return table(spark, d, "embeddings").select(named(F.col("vec_id") + 7).alias("src_id"), named(F.col("vec_id")).alias("tgt_id"))


@_query(f"WITH {EDGES}, {PAIRS} SELECT src_id, tgt_id, weight FROM edges ANTI JOIN p USING (src_id, tgt_id)")
def delete_edges(spark, d):
    return graph.delete_edges(neighbours(spark, d), edges(spark, d)).select("src_id", "tgt_id", "weight")


@_query(f"WITH {REC} SELECT least(src_id, tgt_id) AS src_id, greatest(src_id, tgt_id) AS tgt_id, l_orderkey, l_linenumber FROM rec")
def stable_edges(spark, d):
    return graph.stable_order(records(spark, d).select("src_id", "tgt_id", "l_orderkey", "l_linenumber"))


@_query("SELECT 'E' || vec_id AS entity_name, 0 AS level, label::VARCHAR AS cluster FROM embeddings UNION ALL SELECT 'E' || vec_id, 1, label || '-' || (vec_id % 2) FROM embeddings")
def indexed_clusters(spark, d):
    t = table(spark, d, "embeddings").select(named(F.col("vec_id")).alias("entity_name"), F.array(F.col("label").cast("string"), F.concat_ws("-", "label", (F.col("vec_id") % 2).cast("string"))).alias("community_ids"))
    return graph.indexed_clusters(t).select("entity_name", F.explode("clusters").alias("c")).select("entity_name", "c.level", "c.cluster")


@_query(f"WITH {REC} SELECT src_id, tgt_id, sum(weight) AS weight, count(DISTINCT source_id) AS sources FROM rec GROUP BY 1, 2")
def merge_edges_directed(spark, d):
    e = merge.edges(records(spark, d), directed=True)
    return e.select("src_id", "tgt_id", "weight", F.size(F.split("source_id", X.quoted(X.FIELD_SEP))).cast("long").alias("sources"))


@_query(f"""WITH {EDGES}, t AS (SELECT least(src_id, tgt_id) AS src_id, greatest(src_id, tgt_id) AS tgt_id, max(l_orderkey) AS created FROM rec GROUP BY 1, 2),
u AS (SELECT DISTINCT least(src_id, tgt_id) AS src_id, greatest(src_id, tgt_id) AS tgt_id, source_id FROM rec), x AS (SELECT src_id, tgt_id, count(*) AS chunks, md5(string_agg(md5(text), chr(10) ORDER BY source_id)) AS content, CAST(sum(length(text)) AS BIGINT) AS size FROM u JOIN documents ON source_id = 'C' || doc_id GROUP BY 1, 2)
SELECT src_id, tgt_id, created, chunks, content, size FROM t JOIN x USING (src_id, tgt_id)""")
def all_edges_with_text(spark, d):
    """The whole texts of each edge's chunks, a row each as they are kept; digests of the texts in chunk order and their length, as one row of a hub's joined texts has no bound."""
    r = extract.undirected(records(spark, d))
    e = r.groupBy("src_id", "tgt_id").agg(F.max("l_orderkey").alias("created"), F.collect_set("source_id").alias("source_ids"))
    c = table(spark, d, "documents").select(F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("content"))
    rows = tables.edge_texts(e, c).select("src_id", "tgt_id", "created", "id", F.md5("content").alias("digest"), F.length("content").alias("size"))
    digests = F.transform(F.array_sort(F.collect_list(F.struct("id", "digest"))), lambda x: x.digest)
    return rows.groupBy("src_id", "tgt_id", "created").agg(F.count("*").alias("chunks"), F.md5(F.array_join(digests, "\n")).alias("content"), F.sum("size").cast("bigint").alias("size"))


@_query(f"WITH {EDGES}, {PAIRS} SELECT p.src_id, p.tgt_id, round(a.embedding[1]::DOUBLE, 6) AS first FROM p LEFT JOIN edges USING (src_id, tgt_id) LEFT JOIN embeddings a ON 'E' || a.vec_id = edges.src_id")
def edge_vectors(spark, d):
    """The vector of an edge, asked for by its ends in the other order."""
    v = nodes(spark, d).select(F.col("entity_name").alias("src_id"), "vector")
    stored = edges(spark, d).select("src_id", "tgt_id").join(v, "src_id")
    out = vectors.of_pair(neighbours(spark, d), stored)
    return out.select(F.least("src_id", "tgt_id").alias("src_id"), F.greatest("src_id", "tgt_id").alias("tgt_id"), F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


@_query(f"WITH {EDGES} SELECT src_id, tgt_id FROM edges WHERE src_id <> 'E1' AND tgt_id <> 'E1'")
def relations_without_entity(spark, d):
    return vectors.without_entity(edges(spark, d), "E1").select("src_id", "tgt_id")


@_query(f"""WITH RECURSIVE {EDGES}, w(node, depth) AS (SELECT 'E1', 0 UNION SELECT neighbour, depth + 1 FROM w JOIN both_ways USING (node) WHERE depth < 1), s AS (SELECT DISTINCT node FROM w)
SELECT src_id, tgt_id, weight FROM edges WHERE src_id IN (SELECT node FROM s) AND tgt_id IN (SELECT node FROM s)""")
def subgraph_edges(spark, d):
    return graph.subgraph(nodes(spark, d), edges(spark, d), "E1", 1)[1].select("src_id", "tgt_id", "weight")


@_query(f"WITH RECURSIVE {EDGES}, w(node) AS (SELECT 'E1' UNION SELECT neighbour FROM w JOIN both_ways USING (node)) SELECT node FROM w")
def reachable_nodes(spark, d):
    """All that can be reached from one entity, without a bound on the way."""
    return graph.within_hops(nodes(spark, d).where("entity_name = 'E1'").select("entity_name"), edges(spark, d)).select("node")


UPSERTED = "nw AS (SELECT 'X' || (vec_id % 7) AS x, 'E' || vec_id AS e FROM embeddings)"


@_query(f"""WITH {EDGES}, {UPSERTED} SELECT 'E' || vec_id AS entity_name, label::VARCHAR AS entity_type FROM embeddings UNION ALL SELECT DISTINCT x, NULL FROM nw""")
def upsert_edge_endpoints(spark, d):
    """The nodes after edges to entities that weren't there."""
    n = nodes(spark, d).select("entity_name", "entity_type")
    new = table(spark, d, "embeddings").select(F.concat(F.lit("X"), (F.col("vec_id") % 7).cast("string")).alias("src_id"), named(F.col("vec_id")).alias("tgt_id"), F.lit(1.0).alias("weight"))
    return merge.upsert_edges(n, edges(spark, d).select("src_id", "tgt_id", "weight"), new)[0]


@_query(f"""WITH {EDGES}, g AS (SELECT 'E' || vec_id AS entity_name FROM embeddings WHERE label = 1), l AS (SELECT src_id, tgt_id FROM edges WHERE src_id NOT IN (SELECT * FROM g) AND tgt_id NOT IN (SELECT * FROM g))
SELECT 'node' AS store, 'E' || vec_id AS a, '' AS b FROM embeddings WHERE label <> 1 UNION ALL SELECT 'edge', src_id, tgt_id FROM l UNION ALL SELECT 'entity vector', 'E' || vec_id, '' FROM embeddings WHERE label <> 1 UNION ALL SELECT 'relation vector', src_id, tgt_id FROM l""")
def delete_three_stores(spark, d):
    """What graph and vector tables hold after entities have gone from all of them."""
    n, e = nodes(spark, d), edges(spark, d)
    gone = n.where("entity_type = '1'").select("entity_name")
    left = graph.delete_everywhere(gone, n, e, n.select("entity_name", "vector"), e.select("src_id", "tgt_id"))
    row = lambda t, store, a, b: t.select(F.lit(store).alias("store"), F.col(a).alias("a"), b.alias("b"))
    out = row(left[0], "node", "entity_name", F.lit("")).unionByName(row(left[1], "edge", "src_id", F.col("tgt_id")))
    return out.unionByName(row(left[2], "entity vector", "entity_name", F.lit(""))).unionByName(row(left[3], "relation vector", "src_id", F.col("tgt_id")))


@_query(f"WITH {EDGES}, {PAIRS} SELECT src_id, tgt_id, weight, description FROM p LEFT JOIN edges USING (src_id, tgt_id)")
def relation_info(spark, d):
    return graph.relation_info(neighbours(spark, d), edges(spark, d).select("src_id", "tgt_id", "weight", "description")).select("src_id", "tgt_id", "weight", "description")


@_query("SELECT event_id, event_type || ',' || json_extract_string(props, '$.k') || ',' || user_id AS keywords FROM events")
def keyword_flatten(spark, d):
    """Lists of keywords with lists in them."""
    said = F.concat(F.lit('["'), "event_type", F.lit('", ["'), F.get_json_object("props", "$.k"), F.lit('", "'), F.col("user_id").cast("string"), F.lit('"]]'))
    return table(spark, d, "events").select("event_id", F.array_join(X.flat_keywords(said), ",").alias("keywords"))


# Extraction --------------------------------------------------------------------------------------------------------------------------

EXTRACTED = f"""a AS (SELECT l_orderkey || '-' || l_linenumber AS source_id, '"P' || l_partkey || '"' AS p, '"S' || l_suppkey || '"' AS s, '"' || l_returnflag || '"' AS pt, '"' || l_linestatus || '"' AS st, '"part ' || l_partkey || '"' AS pd, '"supplier ' || l_suppkey || '"' AS sd, l_linenumber FROM lineitem),
f AS (SELECT p AS entity_name, pt AS entity_type, pd AS description, source_id, 0 AS ord FROM a UNION ALL SELECT s, st, sd, source_id, 1 FROM a)"""


@_query(f"""WITH {EXTRACTED}, o AS (SELECT '"P' || p_partkey || '"' AS entity_name, '"' || p_brand || '"' AS entity_type, 'stored' || '<SEP>' || 'part' AS description, 'old' AS source_id FROM part),
v AS (SELECT entity_name, entity_type, 0 AS stored, source_id, ord FROM f UNION ALL SELECT entity_name, entity_type, 1, '', 0 FROM o),
k AS (SELECT entity_name, entity_type, count(*) AS n, min(stored || source_id || '/' || ord) AS first FROM v GROUP BY 1, 2), t AS (SELECT entity_name, arg_min(entity_type, lpad((1000000000 - n)::VARCHAR, 12, '0') || first) AS entity_type FROM k GROUP BY 1),
x AS (SELECT entity_name, description, source_id FROM f UNION ALL SELECT entity_name, unnest(string_split(description, '<SEP>')), source_id FROM o)
SELECT entity_name, t.entity_type, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description, count(DISTINCT source_id) AS sources FROM x JOIN t USING (entity_name) GROUP BY 1, 2""")
def extract_into_nodes(spark, d):
    """Answers of all order lines merged into a graph that already holds the parts."""
    return _into(spark, d)[0].select("entity_name", "entity_type", "description", F.size(F.split("source_id", X.quoted(X.FIELD_SEP))).cast("long").alias("sources"))


@_query(f"""WITH {EXTRACTED}, o AS (SELECT '"P' || p_partkey || '"' AS a, '"S1"' AS b, p_size::DOUBLE AS weight FROM part), w AS (SELECT p AS a, s AS b, l_linenumber::DOUBLE AS weight FROM a UNION ALL SELECT * FROM o)
SELECT least(a, b) AS src_id, greatest(a, b) AS tgt_id, sum(weight) AS weight FROM w GROUP BY 1, 2""")
def extract_into_edges(spark, d):
    return _into(spark, d)[1].select("src_id", "tgt_id", "weight")


def _into(spark, d):
    part = table(spark, d, "part")
    name = F.concat(F.lit('"P'), F.col("p_partkey").cast("string"), F.lit('"'))
    old = part.select(name.alias("entity_name"), F.concat(F.lit('"'), "p_brand", F.lit('"')).alias("entity_type"), F.lit("stored" + X.FIELD_SEP + "part").alias("description"), F.lit("old").alias("source_id"))
    links = part.select(name.alias("src_id"), F.lit('"S1"').alias("tgt_id"), F.col("p_size").cast("double").alias("weight"), F.lit("d").alias("description"), F.lit("k").alias("keywords"), F.lit("old").alias("source_id"))
    return flows.extract_into(answers(spark, d), old, links)


def _streamed(spark, d):
    """The answers of all order lines, as four files that come one after another, merged by the stream; numbers of lines that come twice count twice."""
    folder = scratch(spark)
    # row groups of 8 MB, so that several tasks read a file
    answers(spark, d).repartition(4, "chunk_id").write.option("parquet.block.size", 8 << 20).parquet(f"{folder}/answers")
    stream = spark.readStream.schema("chunk_id string, answer string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/answers")
    stream_graph.merge_stream(stream, folder, once=False).trigger(availableNow=True).start().awaitTermination()
    return stream_graph.read_graph(spark, folder)


@_query(f"""WITH {EXTRACTED}, k AS (SELECT entity_name, entity_type, count(*) AS n, min(source_id || '/' || ord) AS first FROM f GROUP BY 1, 2), t AS (SELECT entity_name, arg_min(entity_type, lpad((1000000000 - n)::VARCHAR, 12, '0') || first) AS entity_type FROM k GROUP BY 1)
SELECT entity_name, t.entity_type, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description, md5(string_agg(DISTINCT source_id, '<SEP>' ORDER BY source_id)) AS sources FROM f JOIN t USING (entity_name) GROUP BY 1, 2""")
def stream_graph_nodes(spark, d):
    return _streamed(spark, d)[0].select("entity_name", "entity_type", "description", F.md5("source_id").alias("sources"))


@_query(f"""WITH {EXTRACTED} SELECT least(p, s) AS src_id, greatest(p, s) AS tgt_id, sum(l_linenumber::DOUBLE) AS weight, '"supplies"' AS description, '"trade"' AS keywords, md5(string_agg(DISTINCT source_id, '<SEP>' ORDER BY source_id)) AS sources FROM a GROUP BY 1, 2""")
def stream_graph_edges(spark, d):
    return _streamed(spark, d)[1].select("src_id", "tgt_id", "weight", "description", "keywords", F.md5("source_id").alias("sources"))


@_query("SELECT doc_id, CASE WHEN n < 500 THEN md5(text) ELSE md5(substr(text, 1, 100)) END AS description FROM (SELECT doc_id, text, length(text) - length(replace(text, ' ', '')) AS n FROM documents)")
def summarised_descriptions(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("text").alias("description"))
    spaces = F.length("description") - F.length(F.replace("description", F.lit(" "), F.lit("")))
    return merge.summarised(t, spaces, F.substring("description", 1, 100)).select("doc_id", F.md5("description").alias("description"))


@_query("SELECT s_suppkey, s_name AS src, n_name AS tgt, 'in ' || n_name AS description, 'place' AS keywords FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def matched_relation_lines(spark, d):
    t = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    line = F.concat(F.lit("Found:\n1. "), "s_name", F.lit(" → "), "n_name", F.lit(" | Description: in "), "n_name", F.lit(" | Keywords: place\nno more"))
    return t.select("s_suppkey", F.explode(extract.matched_relations(line)).alias("r")).select("s_suppkey", "r.*")


@_query("""WITH x AS (SELECT n_regionkey AS doc, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation), b AS (SELECT doc, n_name, i FROM x WHERE i <= n_2(n)), l AS (SELECT doc, max(i) AS last FROM b GROUP BY doc)
SELECT x.doc, CAST(x.i - 1 AS INTEGER) AS ord, x.n_name AS src_id, coalesce(b.n_name || ' x', z.n_name || ' x' || repeat(' (Copy)', CAST(x.i - l.last AS INTEGER))) AS tgt_id FROM x JOIN l USING (doc) LEFT JOIN b USING (doc, i) JOIN b z ON z.doc = x.doc AND z.i = l.last""".replace("n_2(n)", "greatest(n - 2, 1)"))
def parallel_entities(spark, d):
    """Matched lists of two languages by position; the second lacks two names, which copies of its last stand for."""
    t = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    lines = lambda x, more: F.array_join(F.transform(x, lambda v: F.concat(F.lit("1. Entity: "), v.n_name, F.lit(more + " | Type: t | Description: d"))), "\n")
    both = t.select("doc", lines(F.col("x"), "").alias("original"), lines(F.slice("x", F.lit(1), F.greatest(F.size("x") - 2, F.lit(1))), " x").alias("translated"))
    return flows.parallel_pairs(both).select("doc", "ord", "src_id", "tgt_id")


# Caches and translations -------------------------------------------------------------------------------------------------------------


@_query("""WITH o AS (SELECT event_type AS mode, user_id::VARCHAR AS args_hash, max(event_id) AS answer FROM events WHERE value <= 50 GROUP BY 1, 2), n AS (SELECT event_type AS mode, user_id::VARCHAR AS args_hash, max(event_id) AS answer FROM events WHERE value > 50 GROUP BY 1, 2)
SELECT * FROM n UNION ALL SELECT * FROM o ANTI JOIN n USING (mode, args_hash)""")
def cache_save(spark, d):
    t = table(spark, d, "events")
    made = lambda x: x.groupBy(F.col("event_type").alias("mode"), F.col("user_id").cast("string").alias("args_hash")).agg(F.max("event_id").alias("answer"))
    return cache.save(made(t.where("value <= 50")), made(t.where("value > 50")))


def translations(spark, d) -> DataFrame:
    """A link from each customer's nation to each supplier's of the same number."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.join(s, F.col("c_custkey") == F.col("s_suppkey")).select(F.concat(F.lit("C"), "c_nationkey").alias("src"), F.concat(F.lit("S"), "s_nationkey").alias("tgt"), F.lit(1.0).alias("score"), F.lit("exact").alias("method"), F.col("c_mktsegment").alias("src_lang"), F.lit("xx").alias("tgt_lang")).distinct()


TRANSLATIONS = "tr AS (SELECT DISTINCT 'C' || c_nationkey AS src, 'S' || s_nationkey AS tgt, c_mktsegment AS src_lang FROM customer JOIN supplier ON c_custkey = s_suppkey)"


@_query(f"WITH {TRANSLATIONS}, k AS (SELECT DISTINCT 'C' || n_nationkey AS src, 'S' || n_nationkey AS tgt FROM nation) SELECT src AS src_id, tgt AS tgt_id, src_lang || '|xx' AS languages FROM tr ANTI JOIN k USING (src, tgt)")
def translation_edges(spark, d):
    known = table(spark, d, "nation").select(F.concat(F.lit("S"), "n_nationkey").alias("src_id"), F.concat(F.lit("C"), "n_nationkey").alias("tgt_id"))
    return cache.translation_edges(translations(spark, d), known).select("src_id", "tgt_id", "languages")


@_query(f"WITH {TRANSLATIONS}, l AS (SELECT src AS entity_name, 'xx' AS l FROM tr UNION SELECT tgt, src_lang FROM tr), n AS (SELECT 'C' || n_nationkey AS entity_name FROM nation UNION ALL SELECT 'S' || n_nationkey FROM nation) SELECT entity_name, string_agg(l, '|' ORDER BY l) AS translated_languages, count(l) > 0 AS has_translations FROM n LEFT JOIN l USING (entity_name) GROUP BY 1")
def translated_nodes(spark, d):
    n = table(spark, d, "nation").select(F.explode(F.array(F.concat(F.lit("C"), "n_nationkey"), F.concat(F.lit("S"), "n_nationkey"))).alias("entity_name"))
    return cache.mark_translated(n, translations(spark, d)).select("entity_name", "translated_languages", "has_translations")


@_query(f"WITH {TRANSLATIONS} SELECT 'C' || n_nationkey AS entity_name FROM nation WHERE 'C' || n_nationkey NOT IN (SELECT src FROM tr)")
def unlinked_entities(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("C"), "n_nationkey").alias("entity_name"))
    return flows.unlinked(n, translations(spark, d).select(F.col("src").alias("src_id"), F.col("tgt").alias("tgt_id")))


@_query(f"WITH {TRANSLATIONS} SELECT entity_name, min(l) AS language FROM (SELECT src AS entity_name, src_lang AS l FROM tr UNION ALL SELECT tgt, 'xx' FROM tr) GROUP BY 1")
def entity_languages(spark, d):
    t = translations(spark, d).select(F.col("src").alias("src_id"), F.col("tgt").alias("tgt_id"), F.col("src_lang").alias("original_language"), F.col("tgt_lang").alias("translated_language"))
    return flows.languages_of_entities(t)


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN '\"' || o_orderpriority || '\"' ELSE o_orderstatus || ' ' || o_orderkey END AS name FROM orders")
def model_match(spark, d):
    k = F.col("o_orderkey") % 3
    said = F.when(k == 0, F.concat(F.lit("No match for "), "o_orderpriority")).when(k == 1, F.concat(F.lit("it is "), F.lower("o_orderpriority"))).otherwise(F.concat(F.lit("maybe "), F.lower("o_orderstatus"), F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".")))
    names = F.array(F.concat(F.lit('"'), "o_orderpriority", F.lit('"')), F.concat("o_orderstatus", F.lit(" "), F.col("o_orderkey").cast("string")))
    return table(spark, d, "orders").select("o_orderkey", flows.named_in(said, names).alias("name"))


# Contexts, reports and metrics -------------------------------------------------------------------------------------------------------


@_query(f"""WITH {NAIVE} SELECT '"id","tokens"' || chr(10) || string_agg('"' || id || '","' || tokens || '"', chr(10) ORDER BY ord) AS context FROM r WHERE s <= 4000""")
def rendered_context(spark, d):
    return Engine.render(_naive(spark, d, 60), ["id", "tokens"])


@_query(f"""WITH {GLOBAL}, {ENDS}, {NAIVE}, best AS (SELECT 'E' || vec_id AS entity_name, row_number() OVER (ORDER BY score DESC, 'E' || vec_id) - 1 AS ord FROM (SELECT a.vec_id, {COS} AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY ord LIMIT 20),
mu AS (SELECT 0 AS s, ord, entity_name FROM ge UNION ALL SELECT 1, ord, entity_name FROM best), mf AS (SELECT entity_name, min(s * 1000000 + ord) AS o FROM mu GROUP BY 1), mi AS (SELECT row_number() OVER (ORDER BY o) AS id, entity_name FROM mf),
me AS (SELECT '"id","entity_name"' || chr(10) || string_agg('"' || id || '","' || entity_name || '"', chr(10) ORDER BY id) AS e FROM mi), mv AS (SELECT string_agg(text, chr(10) || '--New Chunk--' || chr(10) ORDER BY ord) AS v FROM r WHERE ord < 10 AND s <= 4000)
SELECT md5(e || chr(10) || chr(10) || '-----' || chr(10) || chr(10) || coalesce(v, '')) AS context FROM me, mv""")
def mix_whole_context(spark, d):
    """The knowledge-graph context of both keyword levels and the naive one of ten chunks, as one text."""
    e = retrieve.combined(retrieve.entities_of_relations(global_kept(spark, d), nodes(spark, d), edges(spark, d)), best(spark, d), ["entity_name"])
    graph_part = Engine.render(e, ["id", "entity_name"], "id").select(F.col("context").alias("e"))
    text = retrieve.joined_text(_naive(spark, d, 10)).select(F.coalesce("context", F.lit("")).alias("v"))
    return graph_part.join(text).select(F.md5(F.concat("e", F.lit("\n\n-----\n\n"), "v")).alias("context"))  # one row on both sides


@_query("""WITH p AS (SELECT p_name || p_partkey AS answer, p_size % 7 AS score, p_size AS tokens FROM part), r AS (SELECT *, sum(tokens) OVER (ORDER BY score DESC, answer) AS s FROM p WHERE score > 0) SELECT answer, score FROM r WHERE s <= 2000""")
def map_reduce_points(spark, d):
    p = table(spark, d, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("answer"), (F.col("p_size") % 7).alias("score"), F.col("p_size").alias("tokens"))
    return flows.map_reduce_points(p, 2000).select("answer", "score")


@_query(f"""WITH {EDGES}, {CL}, nd AS (SELECT level, cluster, 0 AS kind, entity_name AS name, degree AS rank, 3 AS tokens FROM cl JOIN deg ON node = entity_name),
ed AS (SELECT DISTINCT level, cluster, 1 AS kind, least(b.node, neighbour) || ' -> ' || greatest(b.node, neighbour) AS name, s.degree + t.degree AS rank, 5 AS tokens FROM both_ways b JOIN cl ON b.node = entity_name JOIN deg s ON s.node = b.node JOIN deg t ON t.node = neighbour),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY level, cluster, kind ORDER BY rank DESC, name) AS s FROM (SELECT * FROM nd UNION ALL SELECT * FROM ed)) SELECT level, cluster, md5(string_agg(name, ',' ORDER BY name)) AS report FROM r WHERE s <= 50 GROUP BY 1, 2""")
def reports_by_level(spark, d):
    """Reports of all communities, the deepest level first, by a stand-in for the model: the names that a report would be written from."""
    e = graph.edge_degrees(described_edges(spark, d)).withColumn("tokens", F.lit(5))
    n = graph.degrees(e).select(F.col("node").alias("entity_name"), "degree", F.lit(3).alias("tokens"), F.lit("").alias("description"))
    write = lambda rows: rows.groupBy("level", "cluster").agg(F.md5(F.array_join(F.array_sort(F.collect_list("name")), ",")).alias("report"))
    return flows.report_levels(given_clusters(spark, d), n, e.select("src_id", "tgt_id", "rank", "tokens", "description"), write, 100)


@_query(f"""WITH {CL}, k AS (SELECT level, cluster, count(*) AS n FROM cl GROUP BY 1, 2), sb AS (SELECT a.level, a.cluster, b.level AS sub_level, b.cluster AS sub_cluster FROM cl a JOIN cl b ON a.entity_name = b.entity_name AND b.level > a.level JOIN k ON k.level = b.level AND k.cluster = b.cluster GROUP BY a.level, a.cluster, b.level, b.cluster, n HAVING count(*) = n),
r AS (SELECT sb.*, k.n, sum(k.n) OVER (PARTITION BY sb.level, sb.cluster ORDER BY k.n DESC, sb.sub_cluster) AS s FROM sb JOIN k ON k.level = sub_level AND k.cluster = sub_cluster), a AS (SELECT avg(n) * 1.2 AS b FROM k WHERE level = 1) SELECT level, cluster, sub_level, sub_cluster FROM r, a WHERE s <= CAST(b AS BIGINT)""")
def sub_community_reports(spark, d):
    """Reports of sub-communities, at any deeper level, that fit a budget of 1.2 of them at the mean."""
    c = given_clusters(spark, d)
    size = c.groupBy("level", "cluster").agg(F.count("*").alias("tokens"))
    budget = int(round(size.where("level = 1").agg(F.avg("tokens")).first()[0] * 1.2))
    r = size.select("level", "cluster", F.col("tokens").cast("double").alias("occurrence"), "tokens", F.lit("r").alias("report"))
    return community.sub_reports(community.sub_clusters(c, any_deeper=True), r, budget).select("level", "cluster", "sub_level", "sub_cluster")


@_query("SELECT o_custkey, round(len(list_intersect(g, p)) / len(g), 6) AS recall FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) AS g, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F'), []) AS p FROM orders GROUP BY 1)")
def entity_recall(spark, d):
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("g"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("p"))
    return t.select("o_custkey", F.round(metrics.entity_recall(F.col("g"), F.col("p")), 6).alias("recall"))


@_query("""WITH t AS (SELECT o_custkey AS q, list(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS a, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders GROUP BY 1), u AS (SELECT k, coalesce(a, []) AS a, p[1:k] AS p FROM t, (VALUES (1), (3), (10)) v(k)),
h AS (SELECT k, a, p, list_filter(range(1, len(p) + 1), lambda i: list_contains(a, p[i])) AS h FROM u),
m AS (SELECT k, CASE WHEN len(h) = 0 THEN 0.0 ELSE list_sum(list_transform(h, lambda x, i: i / x)) / len(h) END AS ap, CASE WHEN len(h) = 0 THEN 0.0 ELSE 1.0 / h[1] END AS rr, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, p)) / len(a) END AS rc FROM h)
SELECT k, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, round(avg(rc), 6) AS recall FROM m GROUP BY k""")
def evaluation_runs(spark, d):
    p = predictions(spark, d)
    ranked = p.select("query_id", F.posexplode("predicted").alias("ord", "context_id"))
    return flows.evaluate(ranked, p.select("query_id", "actual"), [1, 3, 10]).select("k", *(F.round(c, 6).alias(c) for c in ("map", "mrr", "recall")))


# Stored tables and files -------------------------------------------------------------------------------------------------------------


@_query("SELECT c_custkey::VARCHAR AS id, c_name, c_nationkey FROM customer")
def keyed_json_round_trip(spark, d):
    path = scratch(spark)
    files.write_keyed_json(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_name", "c_nationkey"), path)
    return files.read_keyed_lines(spark, path, T.StructType([T.StructField("c_name", T.StringType()), T.StructField("c_nationkey", T.IntegerType())]))


@_query(f"WITH {EDGES} SELECT src_id, tgt_id, weight, description, keywords FROM edges")
def graph_file_edges(spark, d):
    """The graph written as GraphML and read back."""
    path = scratch(spark)
    n = nodes(spark, d).select("entity_name", "entity_type", F.lit('a & b < "c"').alias("description"), F.lit("s").alias("source_id"))
    files.write_graph(n, edges(spark, d).select("src_id", "tgt_id", "weight", "description", "keywords", F.lit("s").alias("source_id")), path)
    return files.read_graph(spark, path)[1].select("src_id", "tgt_id", "weight", "description", "keywords")


@_query("SELECT 'E' || vec_id AS entity_name, label::VARCHAR AS entity_type, 'a & b < c' AS description FROM embeddings")
def graph_file_nodes(spark, d):
    path = scratch(spark)
    n = nodes(spark, d).select("entity_name", "entity_type", F.lit("a & b < c").alias("description"), F.lit("s").alias("source_id"))
    files.write_graph(n, edges(spark, d).select("src_id", "tgt_id", "weight", "description", "keywords", F.lit("s").alias("source_id")), path)
    return files.read_graph(spark, path)[0].select("entity_name", "entity_type", "description")


@_query("SELECT c_name AS line FROM customer")
def folder_scan(spark, d):
    """Text files of a folder that aren't known yet, as lines; one file is known, and holds what no table does."""
    path = scratch(spark)
    t = table(spark, d, "customer").select("c_name").repartition(4, "c_name")
    t.write.text(f"{path}/new")
    spark.createDataFrame([("old",)], "value string").coalesce(1).write.text(f"{path}/old")
    known = files.scan(spark, f"{path}/old").select("path")
    text = files.extract_text(files.scan(spark, path, known))
    return text.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")


@_query("SELECT c_name AS line FROM customer")
def folder_stream(spark, d):
    """Text files of a folder as a stream in small batches, broken off and started again after more files have come; the lines of its documents."""
    path = scratch(spark)
    t = table(spark, d, "customer").select("c_name", (F.col("c_custkey") % 2 == 0).alias("late"))
    for late in (False, True):
        t.where(F.col("late") == late).select("c_name").repartition(3, "c_name").write.text(f"{path}/in/{late}")
        scan_stream(spark, f"{path}/in", f"{path}/out", at_once=2).trigger(availableNow=True).start().awaitTermination()
    docs = spark.read.parquet(f"{path}/out/docs")
    return docs.select(F.explode(F.split("content", "\n")).alias("line"))


@_query("SELECT o_custkey AS src, max(o_orderkey) AS tgt FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def matches_latest(spark, d):
    """Matches of two batches in the store: those of one language pair and the last batch."""
    path = scratch(spark)
    made = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("src_lang"), F.lit("xx").alias("tgt_lang")).agg(F.max("o_orderkey").alias("tgt"))
    files.write_matches(made.withColumn("tgt", -F.col("tgt")), path, "2024-01")
    files.write_matches(made, path, "2024-02")
    return files.read_matches(spark, path, ("F", "xx"), latest=True).select("src", "tgt")


@_query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def translation_pairs_append(spark, d):
    t = table(spark, d, "orders")
    old = t.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return files.append_pairs(old, t.select("o_custkey", "o_orderkey"), ["o_custkey"])


# Windows -----------------------------------------------------------------------------------------------------------------------------


@_query("""SELECT window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts - INTERVAL '30 minutes') + INTERVAL '30 minutes']) AS window_start FROM events) GROUP BY 1, 2""")
def event_windows_sliding(spark, d):
    return windowed_counts(table(spark, d, "events"), "10 minutes", "1 hour", "30 minutes").select("window_start", "event_type", "n")


@_query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS session_start, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    return sessions(table(spark, d, "events"), "10 minutes", "6 hours")


# Typed extraction --------------------------------------------------------------------------------------------------------------------

LINES = "array<struct<q:int,p:long,s:long>>"


def _order_chunks(spark, d) -> DataFrame:
    """A chunk for each order: its lines in order as JSON."""
    line = F.struct(F.col("l_linenumber").cast("int").alias("q"), F.col("l_partkey").cast("long").alias("p"), F.col("l_suppkey").cast("long").alias("s"))
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(line))).alias("content"))
    return t.select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("id"), "content")


def _typed_model() -> typed.Model:
    """A stand-in: it finds the first line of an order, and all of them once it is told that some are missing.

    By the first line's part it answers without JSON at first (every 7th), out of range for ever (every 11th), or doesn't refine (every 5th).
    """
    lines = lambda content: F.from_json(content, LINES)
    part = lambda content: F.get_json_object(content, "$[0].p").cast("long")

    def listed(of, weight=None):
        score = lambda x: F.lit(weight) if weight else x["q"] / F.lit(10.0)
        name = lambda head, c: F.concat(F.lit(head), c.cast("string"))
        e = F.transform(of, lambda x: F.struct(name("p", x["p"]).alias("entity_name"), F.lit("part").alias("entity_type"), name("part ", x["p"]).alias("description"), score(x).alias("importance_score")))
        r = F.transform(of, lambda x: F.struct(name("p", x["p"]).alias("src_id"), name("s", x["s"]).alias("tgt_id"), F.lit("supplied").alias("description"), score(x).alias("weight"), F.least(x["q"], F.lit(3)).alias("order")))
        return F.concat(F.lit("Found:\n"), F.to_json(F.struct(e.alias("entities"), r.alias("relationships"))))

    first = lambda c: F.slice(lines(c), 1, 1)
    said = lambda c, attempt: F.when(part(c) % 11 == 0, listed(first(c), 2.0)).when((part(c) % 7 == 0) & (attempt == 0), "nothing {").otherwise(listed(first(c)))
    missing = lambda c, current, attempt: F.concat(F.lit("missing "), (F.size(lines(c)) - F.size(F.from_json(current, typed.FOUND)["entities"])).cast("string"))
    refined = lambda c, current, critique, attempt: F.when(part(c) % 5 == 0, "I can't").when(critique == "missing 0", F.concat(F.lit("As before: "), current)).otherwise(listed(lines(c)))
    return typed.Model(said, missing, refined)


def _typed_found(spark, d) -> DataFrame:
    return typed.extracted(_order_chunks(spark, d), _typed_model(), scratch(spark), turns=1, retries=1)


TYPED = """f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r,
first_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p0 FROM lineitem), t AS (SELECT * FROM f WHERE p0 % 5 <> 0 OR (p0 % 11 <> 0 AND r = 1))"""


@_query(f"""WITH {TYPED} SELECT 'P' || l_partkey AS entity_name, 'PART' AS entity_type, 'part ' || l_partkey AS description, md5(string_agg(DISTINCT 'O' || l_orderkey, '<SEP>' ORDER BY 'O' || l_orderkey)) AS sources FROM t GROUP BY l_partkey
UNION ALL SELECT DISTINCT 'S' || l_suppkey, '"UNKNOWN"', 'supplied', '' FROM t""")
def typed_refined_nodes(spark, d):
    nodes_, _ = typed.graph_of(_typed_found(spark, d))
    return nodes_.select("entity_name", "entity_type", "description", F.when(F.col("entity_type") == "PART", F.md5("source_id")).otherwise("").alias("sources"))


@_query(f"""WITH {TYPED} SELECT 'P' || l_partkey AS src_id, 'S' || l_suppkey AS tgt_id, round(sum(l_linenumber / 10.0), 6) AS weight, CAST(min(least(l_linenumber, 3)) AS INTEGER) AS "order", 'supplied' AS description,
md5(string_agg(DISTINCT 'O' || l_orderkey, '<SEP>' ORDER BY 'O' || l_orderkey)) AS sources FROM t GROUP BY l_partkey, l_suppkey""")
def typed_refined_edges(spark, d):
    _, edges_ = typed.graph_of(_typed_found(spark, d))
    return edges_.select("src_id", "tgt_id", F.round("weight", 6).alias("weight"), "order", "description", F.md5("source_id").alias("sources"))


@_query(f"WITH {TYPED} SELECT CAST(count(*) AS BIGINT) AS n_entities, string_agg('p' || l_partkey || '-s' || l_suppkey, ',' ORDER BY r) AS pairs FROM t GROUP BY l_orderkey")
def training_dump(spark, d):
    """Examples written as lines of JSON and read again: those of chunks with an entity and a relation."""
    path = scratch(spark)
    typed.write_examples(_order_chunks(spark, d), _typed_found(spark, d), path)
    back = spark.read.schema(f"content string, entities array<{typed.ENTITY}>, relationships array<{typed.RELATIONSHIP}>").json(path)
    return back.select(F.size("entities").cast("long").alias("n_entities"), F.array_join(F.transform("relationships", lambda x: F.concat(x["src_id"], F.lit("-"), x["tgt_id"])), ",").alias("pairs"))


# Documents in two languages ----------------------------------------------------------------------------------------------------------


def _parallel_model() -> parallel.Model:
    """A stand-in: a chunk's first and last word are its entities and a relation; a translation's names end in -x, and of lists of three or more the last is overlooked."""

    def answers_(chunks_):
        w = X.words(F.col("content"))
        name = lambda x: F.concat(F.lit("w"), F.regexp_replace(x, "[^A-Za-z0-9]", ""))
        a, b = name(F.get(w, F.lit(0))), name(F.element_at(w, -1))
        part = lambda kind, *fields: F.concat(F.lit(f'("{kind}"<|>"'), fields[0], *(x for f in fields[1:] for x in (F.lit('"<|>"'), f)))
        e = lambda x, as_: F.concat(part("entity", x, F.lit("term"), F.lit(as_)), F.lit('")'))
        r = F.concat(part("relationship", a, b, F.lit("span"), F.lit("k")), F.lit('"<|>2)'))
        return chunks_.select(F.col("id").alias("chunk_id"), F.concat_ws("##", e(a, "first"), e(b, "last"), r).alias("answer"))

    def matched(listing, text):
        each = F.transform(F.split(listing, "\n"), lambda x: F.regexp_replace(x, r"^(\d+)\. (.*) \(Type: (.*)\): (.*)$", "$1. Entity: $2-x | Type: $3 | Description: $4"))
        return F.array_join(F.slice(each, F.lit(1), F.when(F.size(each) > 2, F.size(each) - 1).otherwise(F.size(each))), "\n")

    def related(listing, found, text):
        return F.array_join(F.transform(F.split(listing, "\n"), lambda x: F.regexp_replace(x, r"^(\d+)\. (.*) → (.*): (.*)$", "$1. $2-x → $3-x | Description: $4 | Keywords: k")), "\n")

    return parallel.Model(lambda t: F.concat(F.lit("T "), t), answers_, matched, related)


def _parallel(spark, d) -> parallel.Inserted:
    """All documents, two thirds of them with a translation, inserted into an empty graph."""
    pairs = table(spark, d, "documents").select(F.col("text").alias("original"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("T "), X.strip(F.col("text")))).alias("translated"))
    n = spark.createDataFrame([], "entity_name string, entity_type string, description string, source_id string")
    e = spark.createDataFrame([], "src_id string, tgt_id string, weight double, description string, keywords string, source_id string")
    return parallel.insert(pairs, _parallel_model(), n, e, ["term"], ("Old", "New"), 200, 20)


PARALLEL = rf"""d AS (SELECT DISTINCT regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL), w AS (SELECT 'doc-' || md5(t) AS doc, {WORDS.format('t')} AS w FROM d),
c AS (SELECT doc, s // 180 AS i, w[s + 1 : s + 200] AS c, 'chunk-' || md5(array_to_string(list_concat(['T'], w[1 : 199]), ' ')) AS other FROM (SELECT doc, w, unnest(range(0, len(w), 180)) AS s FROM w)),
k AS (SELECT doc, i, other, 'chunk-' || md5(array_to_string(c, ' ')) AS id, 'W' || upper(regexp_replace(c[1], '[^A-Za-z0-9]', '', 'g')) AS a, 'W' || upper(regexp_replace(c[len(c)], '[^A-Za-z0-9]', '', 'g')) AS b FROM c),
m AS (SELECT doc, i, other, id, a AS name, '"first"' AS said FROM k UNION ALL SELECT doc, i, other, id, b, '"last"' FROM k),
n AS (SELECT name, string_agg(DISTINCT said, '<SEP>' ORDER BY said) AS description, string_agg(DISTINCT id, '<SEP>' ORDER BY id) AS sources FROM m GROUP BY name),
o AS (SELECT doc, other, name, row_number() OVER (PARTITION BY doc ORDER BY min(i), name) - 1 AS ord, count(*) OVER (PARTITION BY doc) AS n, lag(name) OVER (PARTITION BY doc ORDER BY min(i), name) AS b FROM m GROUP BY doc, other, name),
p AS (SELECT *, CASE WHEN n > 2 AND ord = n - 1 THEN b ELSE name END AS base, CASE WHEN n > 2 AND ord = n - 1 THEN b || '-X (COPY)' ELSE name || '-X' END AS found FROM o),
e AS (SELECT least(a, b) AS a, greatest(a, b) AS b, 2.0 * count(DISTINCT id) AS weight, string_agg(DISTINCT id, '<SEP>' ORDER BY id) AS sources FROM k GROUP BY 1, 2),
r AS (SELECT DISTINCT doc, other, least(a, b) AS a, greatest(a, b) AS b FROM k)"""


@_query(f"WITH {PARALLEL} SELECT doc, CAST(ord AS BIGINT) AS ord, name AS original, base || CASE WHEN name <> base THEN '-x (Copy)' ELSE '-x' END AS translated FROM p")
def parallel_documents(spark, d):
    """Entities of each document and of its translation, by position."""
    return _parallel(spark, d).entity_pairs.select("doc", "ord", F.col("original.name").alias("original"), F.col("translated.name").alias("translated"))


@_query(f"""WITH {PARALLEL}, x AS (SELECT least('"' || a || '-X"', '"' || b || '-X"') AS a, greatest('"' || a || '-X"', '"' || b || '-X"') AS b, string_agg(DISTINCT other, '<SEP>' ORDER BY other) AS sources FROM r GROUP BY 1, 2),
h AS (SELECT '"' || found || '"' AS name, any_value(description) AS description, string_agg(DISTINCT other, '<SEP>' ORDER BY other) AS sources FROM p JOIN n ON n.name = p.base GROUP BY found),
l AS (SELECT name, min({{'a': a, 'b': b, 's': sources}}) AS e FROM (SELECT unnest([a, b]) AS name, a, b, sources FROM x) ANTI JOIN h USING (name) GROUP BY name)
SELECT '"' || name || '"' AS entity_name, '"TERM"' AS entity_type, description, md5(sources) AS sources FROM n UNION ALL SELECT name, '"TERM"', description, md5(sources) FROM h UNION ALL SELECT name, '"UNKNOWN"', '"span"', md5(e.s) FROM l""")
def parallel_nodes(spark, d):
    """Nodes of both languages; an entity that a translation's list overlooks, but a relation names, has no type."""
    return _parallel(spark, d).nodes.select("entity_name", "entity_type", "description", F.md5("source_id").alias("sources"))


@_query(f"""WITH {PARALLEL} SELECT '"' || a || '"' AS src_id, '"' || b || '"' AS tgt_id, CAST(weight AS DOUBLE) AS weight, '"span"' AS description, md5(sources) AS sources FROM e
UNION ALL SELECT least('"' || a || '-X"', '"' || b || '-X"'), greatest('"' || a || '-X"', '"' || b || '-X"'), CAST(count(*) AS DOUBLE), '"span"', md5(string_agg(DISTINCT other, '<SEP>' ORDER BY other)) FROM r GROUP BY a, b""")
def parallel_edges(spark, d):
    return _parallel(spark, d).edges.select("src_id", "tgt_id", "weight", "description", F.md5("source_id").alias("sources"))


@_query(f"""WITH {PARALLEL} SELECT DISTINCT '"' || name || '"' AS src_id, '"' || found || '"' AS tgt_id, 'Old|New' AS languages FROM p""")
def parallel_links(spark, d):
    return _parallel(spark, d).links.select("src_id", "tgt_id", F.concat_ws("|", "original_language", "translated_language").alias("languages"))
