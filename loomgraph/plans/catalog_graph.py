"""Queries over graphs, vectors, retrieval plans, communities, caches and metrics; with the SQL that gives the same rows.

The graph they read is made of the driver's tables: an entity for each embedding, a record for each order line that links the entities
of its part and of its part and supplier, with the order line's figures, and a document as its source.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import cache, community, extract, graph, merge, metrics, retrieve, smallworld, tables, vectors
from ..scratch import materialize, scratch
from .catalog_text import WORDS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


_SHARED: ContextVar[dict[tuple[str, str], DataFrame] | None] = ContextVar("tables that a query has written", default=None)


def sharing(f):
    """A query of which each call writes the graph tables that it reads several times once, for itself alone."""

    @wraps(f)
    def run(spark, d):
        token = _SHARED.set({})
        try:
            return f(spark, d)
        finally:
            _SHARED.reset(token)

    return run


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = sharing(f)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _written(name: str):
    """A graph table that a query writes to the shared folder when it first needs it."""

    def wrap(make):
        @wraps(make)
        def get(spark, d):
            made = _SHARED.get()
            if made is None:
                return make(spark, d)
            if (d, name) not in made:
                made[d, name] = materialize(make(spark, d))
            return spark.read.schema(made[d, name].schema).parquet(made[d, name]._loomgraph_path)

        return get

    return wrap


def records(spark, d) -> DataFrame:
    n, m = table(spark, d, "embeddings").count(), table(spark, d, "documents").count()
    e = lambda c: F.concat(F.lit("E"), F.pmod(c, F.lit(n)).cast("string"))
    return table(spark, d, "lineitem").select(
        e(F.col("l_partkey")).alias("src_id"), e(F.col("l_partkey") + 7 * F.col("l_suppkey")).alias("tgt_id"), F.col("l_quantity").alias("weight"),
        F.concat("l_returnflag", "l_linestatus").alias("description"), F.col("l_returnflag").alias("keywords"), F.concat(F.lit("C"), F.pmod("l_orderkey", F.lit(m)).cast("string")).alias("source_id"),
        "l_orderkey", "l_linenumber", F.col("l_linestatus").alias("entity_type"),
    )


@_written("edges")
def edges(spark, d) -> DataFrame:
    return merge.edges(records(spark, d))


@_written("described edges")
def described_edges(spark, d) -> DataFrame:
    """Edges without their keywords and sources, which are most of their bytes, for queries that need neither."""
    none = F.lit(None).cast("string")
    return merge.edges(records(spark, d).withColumns({"keywords": none, "source_id": none})).select("src_id", "tgt_id", "weight", "description")


@_written("mentions")
def mentions(spark, d) -> DataFrame:
    """(entity_name, chunk)"""
    return records(spark, d).select(F.explode(F.array("src_id", "tgt_id")).alias("entity_name"), F.col("source_id").alias("chunk")).distinct()


def nodes(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.concat(F.lit("E"), F.col("vec_id").cast("string")).alias("entity_name"), F.col("label").cast("string").alias("entity_type"), F.col("embedding").alias("vector"))


def chunks(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("content"), X.n_words(F.col("text")).alias("tokens"))


def query_vector(spark, d):
    """Embedding 0 as a literal."""
    v = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]
    return F.array(*(F.lit(float(x)) for x in v))


REC = """n AS (SELECT count(*) AS n FROM embeddings), m AS (SELECT count(*) AS m FROM documents),
rec AS (SELECT 'E' || (l_partkey % n) AS src_id, 'E' || ((l_partkey + 7 * l_suppkey) % n) AS tgt_id, l_quantity AS weight, l_returnflag || l_linestatus AS description, l_returnflag AS keywords,
'C' || (l_orderkey % m) AS source_id, l_orderkey, l_linenumber, l_linestatus AS entity_type FROM lineitem, n, m)"""
EDGES = REC + """, edges AS (SELECT least(src_id, tgt_id) AS src_id, greatest(src_id, tgt_id) AS tgt_id, sum(weight) AS weight, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description,
string_agg(DISTINCT keywords, '<SEP>' ORDER BY keywords) AS keywords, string_agg(DISTINCT source_id, '<SEP>' ORDER BY source_id) AS source_id FROM rec GROUP BY 1, 2),
both_ways AS (SELECT src_id AS node, tgt_id AS neighbour, weight FROM edges UNION ALL SELECT tgt_id, src_id, weight FROM edges),
deg AS (SELECT node, count(*) AS degree FROM both_ways GROUP BY node),
mentions AS (SELECT DISTINCT unnest([src_id, tgt_id]) AS entity_name, source_id AS chunk FROM rec)"""
COS = "round(list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 9)"
BEST = EDGES + f""", best AS (SELECT 'E' || vec_id AS entity_name, score, CAST(row_number() OVER (ORDER BY score DESC, 'E' || vec_id) - 1 AS BIGINT) AS ord
FROM (SELECT a.vec_id, {COS} AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY score DESC, entity_name LIMIT 20)"""


def best(spark, d, k: int = 20, threshold: float | None = None) -> DataFrame:
    n = nodes(spark, d).withColumn("score", F.round(V.cosine(F.col("vector"), query_vector(spark, d)), 9))
    n = n if threshold is None else n.where(F.col("score") >= threshold)
    return tables.ranked(n.orderBy(F.desc("score"), "entity_name").limit(k), F.desc("score"), F.col("entity_name")).select("entity_name", "score", "ord")


# Merging -----------------------------------------------------------------------------------------------------------------------------


@_query(f"""WITH {REC}, c AS (SELECT src_id AS entity_name, entity_type, count(*) AS k, min(l_orderkey * 1000 + l_linenumber) AS f FROM rec GROUP BY 1, 2),
t AS (SELECT entity_name, entity_type FROM (SELECT *, row_number() OVER (PARTITION BY entity_name ORDER BY k DESC, f) AS r FROM c) WHERE r = 1)
SELECT entity_name, any_value(t.entity_type) AS entity_type, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description, md5(string_agg(DISTINCT source_id, '<SEP>' ORDER BY source_id)) AS sources
FROM rec JOIN t ON t.entity_name = rec.src_id GROUP BY entity_name""")
def merge_nodes_mode(spark, d):
    r = records(spark, d).withColumnRenamed("src_id", "entity_name")
    return merge.nodes(r, ["l_orderkey", "l_linenumber"]).select("entity_name", "entity_type", "description", F.md5("source_id").alias("sources"))


@_query(f"WITH {EDGES} SELECT src_id, tgt_id, weight, description, keywords, md5(source_id) AS sources FROM edges")
def merge_edges_sum(spark, d):
    return edges(spark, d).select("src_id", "tgt_id", "weight", "description", "keywords", F.md5("source_id").alias("sources"))


@_query(f"WITH {REC} SELECT count(*) AS pairs FROM (SELECT DISTINCT least(src_id, tgt_id), greatest(src_id, tgt_id) FROM rec)")
def undirected_pairs(spark, d):
    return extract.undirected(records(spark, d)).select("src_id", "tgt_id").distinct().agg(F.count("*").alias("pairs"))


@_query(f"""WITH {EDGES}, e AS (SELECT unnest([src_id, tgt_id]) AS entity_name, src_id, tgt_id, description, source_id FROM edges), l AS (SELECT * FROM e WHERE entity_name NOT IN (SELECT 'E' || vec_id FROM embeddings WHERE label < 5)),
f AS (SELECT *, row_number() OVER (PARTITION BY entity_name ORDER BY src_id, tgt_id) AS r FROM l) SELECT entity_name, '"UNKNOWN"' AS entity_type, description, md5(source_id) AS sources FROM f WHERE r = 1""")
def missing_endpoints(spark, d):
    described = nodes(spark, d).where(F.col("entity_type").cast("int") < 5)
    return merge.missing_endpoints(described, edges(spark, d)).select("entity_name", "entity_type", "description", F.md5("source_id").alias("sources"))


@_query(f"WITH {EDGES} SELECT 'rel-' || md5(src_id || tgt_id) AS id, keywords || src_id || tgt_id || description AS content FROM edges")
def vector_row_ids(spark, d):
    return merge.relation_rows(edges(spark, d)).select("id", "content")


@_query("""WITH o AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer), w AS (SELECT o_custkey AS k, max(o_orderpriority) AS segment, count(*) AS orders FROM orders GROUP BY 1)
SELECT coalesce(o.k, w.k) AS k, o.name, coalesce(w.segment, o.segment) AS segment, w.orders FROM o FULL JOIN w ON o.k = w.k""")
def upsert_attributes(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("segment"), F.count("*").alias("orders"))
    return merge.merge_attributes(old, new, ["k"]).select("k", "name", "segment", "orders")


@_query("""WITH c AS (SELECT 'N' || n_nationkey AS source_id, 'chunk-' || md5(n_name) AS id FROM nation), e AS (SELECT '"' || upper(s_name) || '"' AS entity_name, id AS source_id FROM supplier LEFT JOIN c ON c.source_id = 'N' || s_nationkey),
l AS (SELECT DISTINCT '"' || upper(n_name) || '"' AS entity_name FROM nation JOIN supplier ON s_nationkey = n_nationkey) SELECT entity_name, 'SUPPLIER' AS entity_type, source_id FROM e UNION ALL SELECT entity_name, 'UNKNOWN', c.id FROM l JOIN nation ON '"' || upper(n_name) || '"' = entity_name JOIN c ON c.source_id = 'N' || n_nationkey""")
def custom_graph(spark, d):
    nation, supplier = table(spark, d, "nation"), table(spark, d, "supplier")
    source = lambda c: F.concat(F.lit("N"), F.col(c).cast("string")).alias("source_id")
    c = nation.select(F.col("n_name").alias("content"), source("n_nationkey"))
    e = supplier.select(F.col("s_name").alias("entity_name"), F.lit("SUPPLIER").alias("entity_type"), F.lit(None).cast("string").alias("description"), source("s_nationkey"))
    r = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("src_id"), F.col("n_name").alias("tgt_id"), F.lit("in").alias("description"), F.lit("place").alias("keywords"), F.lit(None).cast("double").alias("weight"), source("s_nationkey"))
    return merge.custom_graph(c, e, r)[1].select("entity_name", "entity_type", "source_id")


# Tables ------------------------------------------------------------------------------------------------------------------------------


@_query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def kv_upsert_first(spark, d):
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"))
    return tables.upsert(table(spark, d, "customer").select("c_custkey", "c_name"), new, "c_custkey", "first")


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier")
def kv_upsert_last(spark, d):
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"))
    return tables.upsert(table(spark, d, "customer").select("c_custkey", "c_name"), new, "c_custkey", "last")


@_query("SELECT o_custkey, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS o_orderkey FROM orders GROUP BY 1")
def kv_latest_version(spark, d):
    return tables.latest(table(spark, d, "orders"), "o_custkey", F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey")


@_query("SELECT event_id AS ord, user_id AS c_custkey, c_name FROM events LEFT JOIN customer ON c_custkey = user_id")
def kv_get_by_ids_ordered(spark, d):
    ids = table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("c_custkey"))
    return tables.get_by_ids(table(spark, d, "customer"), ids, "c_custkey", ["c_name"])


@_query("SELECT DISTINCT user_id * 1000 AS c_custkey FROM events WHERE user_id * 1000 NOT IN (SELECT c_custkey FROM customer)")
def kv_missing_keys(spark, d):
    return tables.missing_keys(table(spark, d, "events").select((F.col("user_id") * 1000).alias("c_custkey")).distinct(), table(spark, d, "customer"), "c_custkey")


@_query("SELECT DISTINCT o_custkey FROM orders")
def kv_all_keys(spark, d):
    return tables.all_keys(table(spark, d, "orders"), "o_custkey")


@_query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def kv_delete(spark, d):
    return tables.delete(table(spark, d, "customer"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@_query(f"WITH {EDGES} SELECT (SELECT count(*) FROM embeddings) AS nodes, (SELECT count(*) FROM edges) AS edges")
def graph_statistics(spark, d):
    return tables.graph_statistics(nodes(spark, d), edges(spark, d)).select("nodes", "edges")


@_query(f"WITH {EDGES} SELECT entity_name, md5(string_agg(text, chr(10) ORDER BY chunk)) AS content FROM mentions JOIN documents ON chunk = 'C' || doc_id GROUP BY entity_name")
def all_nodes_with_text(spark, d):
    m = mentions(spark, d).groupBy("entity_name").agg(F.collect_list("chunk").alias("source_ids"))
    return tables.nodes_with_text(m, chunks(spark, d)).select("entity_name", F.md5("content").alias("content"))


# Graphs ------------------------------------------------------------------------------------------------------------------------------


@_query(f"WITH {EDGES} SELECT node, degree FROM deg")
def node_degree(spark, d):
    return graph.degrees(edges(spark, d))


@_query(f"WITH {EDGES} SELECT src_id, tgt_id, s.degree + t.degree AS rank FROM edges JOIN deg s ON s.node = src_id JOIN deg t ON t.node = tgt_id")
def edge_degree(spark, d):
    return graph.edge_degrees(edges(spark, d)).select("src_id", "tgt_id", "rank")


@_query(f"WITH {EDGES} SELECT node, neighbour, weight FROM both_ways WHERE node IN (SELECT 'E' || vec_id FROM embeddings WHERE label = 3)")
def node_edges(spark, d):
    names = nodes(spark, d).where("entity_type = '3'")
    return graph.node_edges(names, edges(spark, d).select("src_id", "tgt_id", "weight"))


@_query(f"WITH {EDGES}, p AS (SELECT least('E' || vec_id, 'E' || (vec_id + 7)) AS src_id, greatest('E' || vec_id, 'E' || (vec_id + 7)) AS tgt_id FROM embeddings) SELECT p.* FROM p SEMI JOIN edges USING (src_id, tgt_id)")
def has_edge_semi(spark, d):
    e = lambda c: F.concat(F.lit("E"), c.cast("string"))
    return graph.has_edges(table(spark, d, "embeddings").select(e(F.col("vec_id") + 7).alias("src_id"), e(F.col("vec_id")).alias("tgt_id")), edges(spark, d))


@_query("SELECT 'E' || (vec_id * 2) AS entity_name, vec_id * 2 IN (SELECT vec_id FROM embeddings) AS found FROM embeddings")
def has_node(spark, d):
    names = table(spark, d, "embeddings").select(F.concat(F.lit("E"), (F.col("vec_id") * 2).cast("string")).alias("entity_name"))
    return graph.has_nodes(names, nodes(spark, d)).select("entity_name", "found")


@_query(f"WITH {EDGES}, p AS (SELECT 'E' || vec_id AS a, 'E' || (vec_id + vec_id % 8) AS b FROM embeddings) SELECT least(a, b) AS src_id, greatest(a, b) AS tgt_id, coalesce(weight, 0.0) AS weight FROM p LEFT JOIN edges ON src_id = least(a, b) AND tgt_id = greatest(a, b)")
def get_edge_default(spark, d):
    e = lambda c: F.concat(F.lit("E"), c.cast("string"))
    pairs = table(spark, d, "embeddings").select(e(F.col("vec_id") + F.col("vec_id") % 8).alias("src_id"), e(F.col("vec_id")).alias("tgt_id"))
    return graph.get_edges(pairs, edges(spark, d), 0.0).select("src_id", "tgt_id", "weight")


@_query("SELECT DISTINCT 'E' || vec_id AS entity_name FROM embeddings")
def labels_sorted(spark, d):
    return graph.labels(nodes(spark, d))


def places(spark, d) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, customers and suppliers as a tree."""
    r, n, c, s = (table(spark, d, x) for x in ("region", "nation", "customer", "supplier"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    e = n.select(name("R", "n_regionkey").alias("src_id"), name("N", "n_nationkey").alias("tgt_id"))
    e = e.union(c.select(name("N", "c_nationkey"), name("C", "c_custkey"))).union(s.select(name("N", "s_nationkey"), name("S", "s_suppkey")))
    v = r.select(name("R", "r_regionkey").alias("entity_name")).union(n.select(name("N", "n_nationkey"))).union(c.select(name("C", "c_custkey"))).union(s.select(name("S", "s_suppkey")))
    return v, e


PLACES = """e AS (SELECT 'R' || n_regionkey AS a, 'N' || n_nationkey AS b FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier),
b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)"""
REGION = """g AS (SELECT 'R' || r_regionkey AS v, r_regionkey AS r FROM region UNION ALL SELECT 'N' || n_nationkey, n_regionkey FROM nation
UNION ALL SELECT 'C' || c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'S' || s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


@_query(f"""WITH RECURSIVE {PLACES}, w(node, depth) AS (SELECT 'S1', 0 UNION SELECT b.b, w.depth + 1 FROM w JOIN b ON b.a = w.node WHERE w.depth < 4) SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def khop_subgraph(spark, d):
    v, e = places(spark, d)
    return graph.within_hops(v.where("entity_name = 'S1'"), e, 4)


@_query(f"WITH {REGION} SELECT v AS entity_name, min(v) OVER (PARTITION BY r) AS component FROM g")
def connected_components(spark, d):
    return graph.components(*places(spark, d))


@_query(f"WITH {REGION}, k AS (SELECT r FROM g GROUP BY r ORDER BY count(*) DESC, min(v) LIMIT 1) SELECT v AS entity_name FROM g JOIN k USING (r)")
def largest_component(spark, d):
    return graph.largest_component(*places(spark, d))


@_query(f"WITH {EDGES} SELECT node, round(0.5 + 1.5 * (degree - (SELECT min(degree) FROM deg)) / (SELECT max(degree) - min(degree) FROM deg), 6) AS size FROM deg")
def degree_scaled_size(spark, d):
    return graph.scaled_sizes(graph.degrees(edges(spark, d))).withColumn("size", F.round("size", 6))


@_query(f"WITH {EDGES} SELECT src_id, tgt_id, weight FROM edges WHERE src_id NOT IN (SELECT 'E' || vec_id FROM embeddings WHERE label = 1) AND tgt_id NOT IN (SELECT 'E' || vec_id FROM embeddings WHERE label = 1)")
def delete_entity(spark, d):
    n = nodes(spark, d)
    return graph.delete_nodes(n.where("entity_type = '1'"), n, edges(spark, d))[1].select("src_id", "tgt_id", "weight")


@_query(f"WITH {EDGES} SELECT entity_name, count(*) AS left_sources FROM mentions WHERE chunk NOT IN (SELECT 'C' || doc_id FROM documents WHERE source = 'src0') GROUP BY entity_name")
def delete_doc_sources(spark, d):
    gone = table(spark, d, "documents").where("source = 'src0'").select(F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("id"))
    return graph.drop_sources(mentions(spark, d), gone).groupBy("entity_name").agg(F.count("*").alias("left_sources"))


@_query(f"WITH {EDGES} SELECT count(DISTINCT entity_name) AS residual FROM mentions WHERE chunk IN (SELECT 'C' || doc_id FROM documents WHERE source = 'src0')")
def verify_deletion(spark, d):
    m = mentions(spark, d).groupBy("entity_name").agg(F.collect_set("chunk").alias("source_ids"))
    gone = table(spark, d, "documents").where("source = 'src0'").select(F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("id"))
    return graph.residual(m, gone).agg(F.count("*").alias("residual"))


@_query(f"WITH {EDGES} SELECT count(DISTINCT entity_name) AS entities FROM mentions WHERE chunk = 'C5'")
def document_entities(spark, d):
    m = mentions(spark, d).groupBy("entity_name").agg(F.collect_set("chunk").alias("source_ids"))
    c = chunks(spark, d).withColumn("full_doc_id", F.col("id"))
    return extract.of_document(m, c, "C5").agg(F.count("*").alias("entities"))


# Vectors -----------------------------------------------------------------------------------------------------------------------------


@_query(f"WITH {BEST} SELECT entity_name, round(score, 6) AS score, ord FROM best")
def vec_topk(spark, d):
    return best(spark, d).withColumn("score", F.round("score", 6))


@_query(f"SELECT a.vec_id, round({COS}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {COS} >= 0.2")
def vec_topk_threshold(spark, d):
    t = table(spark, d, "embeddings")
    return vectors.nearest(t, query_vector(spark, d), 0.2, "embedding").select("vec_id", F.round("score", 6).alias("score"))


@_query(f"SELECT vec_id, ord FROM (SELECT vec_id, CAST(row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS BIGINT) AS ord FROM (SELECT a.vec_id, {COS} AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE vec_id <> 0) WHERE ord < 5")
def vec_topk_strict(spark, d):
    """The 5 nearest others above a strict threshold."""
    t = table(spark, d, "embeddings").where("vec_id <> 0")
    return vectors.top_k(t, query_vector(spark, d), 5, -1.0, "vec_id", "embedding", strict=True).select("vec_id", "ord")


@_query(f"WITH s AS (SELECT q.vec_id AS query_id, a.vec_id, {COS} AS score FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0) SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s WHERE score >= 0.2) WHERE r <= 10")
def vec_topk_many(spark, d):
    t = table(spark, d, "embeddings")
    q = t.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.top_k_many(t, q, 10, 0.2, "vec_id", "embedding").select("query_id", "vec_id", F.round("score", 6).alias("score"))


@_query(f"WITH s AS (SELECT a.vec_id AS src, q.vec_id AS tgt, {COS} AS score FROM embeddings a, embeddings q WHERE a.label < 5 AND q.label >= 5) SELECT src, tgt, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) AS r FROM s) WHERE r = 1 AND score >= 0.3")
def vec_pairwise_argmax(spark, d):
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")
    return vectors.best_matches(t.where("label < 5"), t.where("label >= 5"), 0.3).withColumn("score", F.round("score", 6))


@_query("SELECT vec_id, round(list_min(embedding)::DOUBLE, 6) AS low, CAST(list_sum(list_transform(embedding, lambda x: round_even((x::DOUBLE - list_min(embedding)::DOUBLE) * (255.0 / (list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE)), 0))) AS BIGINT) AS code_sum FROM embeddings")
def vec_quantize(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", V.quantize(F.col("embedding")).alias("q"))
    return t.select("vec_id", F.round("q.low", 6).alias("low"), F.aggregate("q.codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"))


@_query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vec_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@_query()
def vec_topk_lsh(spark, d):
    t = table(spark, d, "embeddings")
    return vectors.nearest_by_hash(t, t.where("vec_id = 0").first()["embedding"], 10, "vec_id", "embedding")


@_query()
def vec_topk_small_world(spark, d):
    """The 10 nearest of every hundredth vector, by an index that is built and stored first."""
    t, path = table(spark, d, "embeddings"), scratch(spark)
    smallworld.build(t, path, "vec_id", "embedding")
    q = t.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return smallworld.nearest(spark, path, q, 10).select("query_id", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "ord")


@_query("""SELECT entity_name, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
FROM (SELECT 'E' || vec_id AS entity_name, sha256('E' || vec_id) AS h FROM embeddings)""")
def vec_stable_uuid(spark, d):
    return nodes(spark, d).select("entity_name", vectors.stable_uuid(F.col("entity_name")).alias("uuid"))


# Retrieval ---------------------------------------------------------------------------------------------------------------------------


@_query(f"WITH {BEST} SELECT entity_name, ord, label::VARCHAR AS entity_type, coalesce(degree, 0) AS rank FROM best JOIN embeddings ON 'E' || vec_id = entity_name LEFT JOIN deg ON node = entity_name")
def local_entities(spark, d):
    return retrieve.local_entities(best(spark, d).drop("score"), nodes(spark, d), edges(spark, d)).select("entity_name", "ord", "entity_type", "rank")


UNITS = BEST + """, own AS (SELECT best.entity_name, ord, chunk FROM best JOIN mentions USING (entity_name)),
near AS (SELECT DISTINCT node, neighbour, weight FROM both_ways WHERE node <> neighbour),
also AS (SELECT own.entity_name, own.chunk, count(*) AS relations, sum({score}) AS score FROM own JOIN near ON node = own.entity_name {extra} JOIN mentions n ON n.entity_name = neighbour AND n.chunk = own.chunk GROUP BY 1, 2),
each AS (SELECT own.chunk, ord, coalesce(relations, 0) AS relations, coalesce(score, 0) AS score FROM own LEFT JOIN also USING (entity_name, chunk))"""


@_query("WITH " + UNITS.format(score="1", extra="") + " SELECT chunk, max(ord) AS ord, arg_max(relations, ord) AS relations FROM each GROUP BY chunk")
def local_text_units(spark, d):
    return retrieve.chunks_of_entities(best(spark, d), mentions(spark, d), edges(spark, d))


@_query("WITH " + UNITS.format(score="weight", extra="") + " SELECT chunk, min(ord) AS ord, CAST(arg_min(score, ord) AS DOUBLE) AS score FROM each GROUP BY chunk")
def local_text_units_weight(spark, d):
    return retrieve.chunks_by_edge_score(best(spark, d), mentions(spark, d), edges(spark, d), mode="weight")


@_query("WITH " + UNITS.format(score="list_dot_product(v.embedding::DOUBLE[], z.embedding::DOUBLE[])", extra="JOIN embeddings v ON least(node, neighbour) = 'E' || v.vec_id CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) z") + " SELECT chunk, min(ord) AS ord, round(CAST(arg_min(score, ord) AS DOUBLE), 5) AS score FROM each GROUP BY chunk")
def local_text_units_dot(spark, d):
    v = nodes(spark, d).select(F.col("entity_name").alias("src_id"), "vector")
    e = edges(spark, d).join(v, "src_id", "left")
    return retrieve.chunks_by_edge_score(best(spark, d), mentions(spark, d), e, query_vector(spark, d), "dot").withColumn("score", F.round("score", 5))


LOCAL_REL = "f AS (SELECT least(node, neighbour) AS src_id, greatest(node, neighbour) AS tgt_id, min(ord) AS ord FROM both_ways JOIN best ON node = entity_name GROUP BY 1, 2), lr AS (SELECT src_id, tgt_id, weight, s.degree + t.degree AS rank, ord FROM edges JOIN f USING (src_id, tgt_id) JOIN deg s ON s.node = src_id JOIN deg t ON t.node = tgt_id)"


@_query(f"WITH {BEST}, {LOCAL_REL} SELECT src_id, tgt_id, weight, rank, ord FROM lr")
def local_relations(spark, d):
    return retrieve.relations_of_entities(best(spark, d), edges(spark, d)).select("src_id", "tgt_id", "weight", "rank", "ord")


GLOBAL = EDGES + f""", gv AS (SELECT src_id, tgt_id, {COS} AS score FROM edges JOIN embeddings a ON src_id = 'E' || a.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
gb AS (SELECT src_id, tgt_id, row_number() OVER (ORDER BY score DESC, src_id, tgt_id) - 1 AS ord FROM gv ORDER BY score DESC, src_id, tgt_id LIMIT 60),
gr AS (SELECT src_id, tgt_id, weight, s.degree + t.degree AS rank, ord, source_id, description, len(string_split(source_id, '<SEP>')) AS tok FROM gb JOIN edges USING (src_id, tgt_id) JOIN deg s ON s.node = src_id JOIN deg t ON t.node = tgt_id),
gl AS (SELECT * FROM (SELECT *, sum(tok) OVER w AS run, row_number() OVER w - 1 AS pos FROM gr WINDOW w AS (ORDER BY rank DESC, weight DESC, ord)) WHERE run <= 40)"""


def global_best(spark, d) -> DataFrame:
    v = nodes(spark, d).select(F.col("entity_name").alias("src_id"), F.round(V.cosine(F.col("vector"), query_vector(spark, d)), 9).alias("score"))
    e = edges(spark, d).select("src_id", "tgt_id").join(v, "src_id")
    order = [F.desc("score"), F.col("src_id"), F.col("tgt_id")]
    return tables.ranked(e.orderBy(*order).limit(60), *order).select("src_id", "tgt_id", "ord")


def global_kept(spark, d) -> DataFrame:
    return retrieve.global_relations(global_best(spark, d), edges(spark, d), F.size(F.split("source_id", "<SEP>")).cast("long"), 40)


@_query(f"WITH {GLOBAL} SELECT src_id, tgt_id, weight, rank, pos FROM gl")
def global_relations(spark, d):
    return global_kept(spark, d).select("src_id", "tgt_id", "weight", "rank", "pos")


ENDS = "ge AS (SELECT entity_name, min(o) AS ord FROM (SELECT src_id AS entity_name, pos * 2 AS o FROM gl UNION ALL SELECT tgt_id, pos * 2 + 1 FROM gl) GROUP BY 1)"


@_query(f"WITH {GLOBAL}, {ENDS} SELECT entity_name, ord, degree AS rank FROM ge JOIN deg ON node = entity_name")
def global_entities(spark, d):
    return retrieve.entities_of_relations(global_kept(spark, d), nodes(spark, d), edges(spark, d)).select("entity_name", "ord", "rank")


@_query(f"WITH {GLOBAL} SELECT id, min(pos) AS ord FROM (SELECT pos, unnest(string_split(source_id, '<SEP>')) AS id FROM gl) JOIN documents ON id = 'C' || doc_id GROUP BY id")
def global_text_units(spark, d):
    r = global_kept(spark, d).select("pos", F.split("source_id", "<SEP>").alias("source_ids"))
    return retrieve.chunks_of_relations(r, chunks(spark, d)).select("id", "ord")


@_query(f"""WITH {GLOBAL}, {ENDS}, best AS (SELECT 'E' || vec_id AS entity_name, row_number() OVER (ORDER BY score DESC, 'E' || vec_id) - 1 AS ord FROM (SELECT a.vec_id, {COS} AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY ord LIMIT 20),
u AS (SELECT 0 AS s, ord, entity_name FROM ge UNION ALL SELECT 1, ord, entity_name FROM best), f AS (SELECT entity_name, min(s * 1000000 + ord) AS o FROM u GROUP BY 1) SELECT row_number() OVER (ORDER BY o) AS id, entity_name FROM f""")
def hybrid_merge_entities(spark, d):
    high = retrieve.entities_of_relations(global_kept(spark, d), nodes(spark, d), edges(spark, d))
    return retrieve.combined(high, best(spark, d), ["entity_name"])


NAIVE = f"""b AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS ord, score FROM (SELECT a.vec_id, {COS} AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY ord LIMIT 60),
c AS (SELECT vec_id AS id, ord, score, text, CAST(len({WORDS.format('text')}) AS BIGINT) AS tokens FROM b JOIN documents ON doc_id = vec_id), r AS (SELECT *, sum(tokens) OVER (ORDER BY ord) AS s FROM c)"""


@_query(f"WITH {NAIVE} SELECT id, ord, round(score, 6) AS score, tokens FROM r WHERE s <= 4000")
def naive_context(spark, d):
    return _naive(spark, d, 60).select("id", "ord", F.round("score", 6).alias("score"), "tokens")


def _naive(spark, d, k: int) -> DataFrame:
    t = table(spark, d, "embeddings").withColumn("score", F.round(V.cosine(F.col("embedding"), query_vector(spark, d)), 9)).select(F.col("vec_id").alias("id"), "score")
    b = tables.ranked(t.orderBy(F.desc("score"), "id").limit(k), F.desc("score"), F.col("id"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), X.n_words(F.col("text")).alias("tokens"))
    return retrieve.naive(b, docs, 4000)


@_query(f"WITH {NAIVE} SELECT md5(string_agg(text, chr(10) || '--New Chunk--' || chr(10) ORDER BY ord)) AS context FROM r WHERE ord < 10 AND s <= 4000")
def mix_context(spark, d):
    return retrieve.joined_text(_naive(spark, d, 10)).select(F.md5("context").alias("context"))


@_query(f"WITH s AS (SELECT q.vec_id AS query_id, a.vec_id, {COS} AS score FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s WHERE score >= 0.2) SELECT 'E' || vec_id AS entity_name, round(sum(score), 5) AS score FROM k WHERE r <= 50 GROUP BY vec_id ORDER BY sum(score) DESC, entity_name LIMIT 20")
def keyword_sum_topk(spark, d):
    t = table(spark, d, "embeddings")
    q = t.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectors.top_k_many(t, q, 50, 0.2, "vec_id", "embedding").withColumn("entity_name", F.concat(F.lit("E"), F.col("vec_id").cast("string")))
    return retrieve.by_keyword_sum(found, 20).withColumn("score", F.round("score", 5))


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'fail' WHEN o_orderkey % 2 = 0 THEN 'global' WHEN o_orderkey % 3 = 0 THEN 'local' ELSE 'hybrid' END AS mode FROM orders")
def keyword_fallback_mode(spark, d):
    some, none = F.array(F.lit("k")), F.array().cast("array<string>")
    pick = lambda n: F.when(F.col("o_orderkey") % n == 0, none).otherwise(some)
    return table(spark, d, "orders").select("o_orderkey", retrieve.fallback_mode(F.lit("hybrid"), pick(2), pick(3)).alias("mode"))


# Communities -------------------------------------------------------------------------------------------------------------------------


def given_clusters(spark, d) -> DataFrame:
    t = table(spark, d, "embeddings").select(F.concat(F.lit("E"), F.col("vec_id").cast("string")).alias("entity_name"), F.col("label").cast("string").alias("l"), (F.col("vec_id") % 2).cast("string").alias("p"))
    return t.select("entity_name", F.lit(0).alias("level"), F.col("l").alias("cluster")).union(t.select("entity_name", F.lit(1), F.concat_ws("-", "l", "p")))


CL = "cl AS (SELECT 'E' || vec_id AS entity_name, 0 AS level, label::VARCHAR AS cluster FROM embeddings UNION ALL SELECT 'E' || vec_id, 1, label || '-' || (vec_id % 2) FROM embeddings)"
SCHEMA = f"""{CL}, cn AS (SELECT level, cluster, count(*) AS n_nodes FROM cl GROUP BY 1, 2), ce AS (SELECT level, cluster, count(DISTINCT least(node, neighbour) || ' ' || greatest(node, neighbour)) AS n_edges FROM both_ways JOIN cl ON node = entity_name GROUP BY 1, 2),
cc AS (SELECT level, cluster, count(DISTINCT chunk) AS n_chunks FROM cl JOIN mentions USING (entity_name) GROUP BY 1, 2), cs AS (SELECT level, cluster, n_nodes, coalesce(n_edges, 0) AS n_edges, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_chunks, 0) / max(coalesce(n_chunks, 0)) OVER () AS occurrence FROM cn LEFT JOIN ce USING (level, cluster) LEFT JOIN cc USING (level, cluster))"""


def _schema(spark, d) -> DataFrame:
    m = mentions(spark, d).groupBy("entity_name").agg(F.collect_set("chunk").alias("source_ids"))
    return community.schema(given_clusters(spark, d), m, edges(spark, d))


@_query(f"WITH {EDGES}, {SCHEMA} SELECT level, cluster, n_nodes, n_edges, n_chunks, round(occurrence, 6) AS occurrence FROM cs")
def community_schema(spark, d):
    return _schema(spark, d).withColumn("occurrence", F.round("occurrence", 6))


@_query(f"WITH {CL}, k AS (SELECT level, cluster, count(*) AS n FROM cl GROUP BY 1, 2) SELECT a.level, a.cluster, b.level AS sub_level, b.cluster AS sub_cluster FROM cl a JOIN cl b ON a.entity_name = b.entity_name AND b.level = a.level + 1 JOIN k ON k.level = b.level AND k.cluster = b.cluster GROUP BY a.level, a.cluster, b.level, b.cluster, n HAVING count(*) = n")
def community_subs(spark, d):
    return community.sub_clusters(given_clusters(spark, d))


def reports(spark, d) -> DataFrame:
    """A report for each part brand's cluster name: rating and tokens from parts."""
    p = table(spark, d, "part")
    return p.groupBy(F.pmod("p_partkey", F.lit(10)).cast("string").alias("cluster")).agg(F.max("p_size").cast("double").alias("rating"), F.sum("p_size").cast("long").alias("tokens"))


REPORTS = "rp AS (SELECT (p_partkey % 10)::VARCHAR AS cluster, CAST(max(p_size) AS DOUBLE) AS rating, CAST(sum(p_size) AS BIGINT) AS tokens FROM part GROUP BY 1)"


@_query(f"WITH {BEST}, {CL}, {REPORTS}, x AS (SELECT cluster, count(*) AS n FROM cl SEMI JOIN best USING (entity_name) WHERE level <= 0 GROUP BY 1), y AS (SELECT *, sum(tokens) OVER (ORDER BY n DESC, rating DESC, cluster) AS s FROM x JOIN rp USING (cluster)) SELECT cluster, n, rating, tokens FROM y WHERE s <= (SELECT sum(tokens) // 2 FROM rp)")
def community_related(spark, d):
    budget = reports(spark, d).agg(F.sum("tokens")).first()[0] // 2
    return community.related(best(spark, d), given_clusters(spark, d), reports(spark, d), 0, budget).select("cluster", "n", "rating", "tokens")


@_query(f"WITH {EDGES}, {SCHEMA}, {REPORTS}, t AS (SELECT * FROM cs WHERE level <= 0 ORDER BY occurrence DESC, cluster LIMIT 6) SELECT cluster, round(occurrence, 6) AS occurrence, rating FROM t LEFT JOIN rp USING (cluster) WHERE coalesce(rating, 0) >= 50")
def community_global_select(spark, d):
    c = _schema(spark, d).join(reports(spark, d), "cluster", "left")
    return community.global_select(c, 0, 6, 50.0).select("cluster", F.round("occurrence", 6).alias("occurrence"), "rating")


@_query("SELECT n_nationkey, '# ' || n_name || chr(10) || chr(10) || 's' || n_regionkey || chr(10) || chr(10) || '## f' || chr(10) || chr(10) || n_name AS report FROM nation")
def community_report_text(spark, d):
    finding = F.struct(F.lit("f").alias("summary"), F.col("n_name").alias("explanation"))
    j = F.to_json(F.struct(F.col("n_name").alias("title"), F.concat(F.lit("s"), F.col("n_regionkey").cast("string")).alias("summary"), F.array(finding).alias("findings")))
    return table(spark, d, "nation").select("n_nationkey", community.report_text(j).alias("report"))


@_query(f"""WITH {EDGES}, {CL}, nd AS (SELECT level, cluster, 'node' AS kind, entity_name AS name, degree AS rank, 3 AS tokens FROM cl JOIN deg ON node = entity_name WHERE level = 0),
ed AS (SELECT DISTINCT level, cluster, 'edge' AS kind, least(b.node, neighbour) || ' -> ' || greatest(b.node, neighbour) AS name, s.degree + t.degree AS rank, 5 AS tokens FROM both_ways b JOIN cl ON b.node = entity_name AND level = 0 JOIN deg s ON s.node = b.node JOIN deg t ON t.node = neighbour),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY level, cluster, kind ORDER BY rank DESC, name) AS s, row_number() OVER (PARTITION BY level, cluster, kind ORDER BY rank DESC, name) - 1 AS ord FROM (SELECT * FROM nd UNION ALL SELECT * FROM ed)) SELECT level, cluster, kind, ord, name, rank FROM r WHERE s <= 50""")
def community_describe(spark, d):
    e = graph.edge_degrees(edges(spark, d)).withColumn("tokens", F.lit(5))
    n = graph.degrees(e).select(F.col("node").alias("entity_name"), "degree", F.lit(3).alias("tokens"), F.lit("").alias("description"))
    c = given_clusters(spark, d).where("level = 0")
    return community.describe(c, n, e.select("src_id", "tgt_id", "rank", "tokens", "description"), 100).select("level", "cluster", "kind", "ord", "name", "rank")


@_query(f"""WITH {EDGES}, {CL}, k AS (SELECT cluster, count(*) AS n FROM cl WHERE level = 1 GROUP BY 1), sb AS (SELECT DISTINCT a.cluster, b.cluster AS sub, n FROM cl a JOIN cl b ON a.entity_name = b.entity_name AND a.level = 0 AND b.level = 1 JOIN k ON k.cluster = b.cluster),
kept AS (SELECT cluster, sub, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, sub) AS r FROM sb) WHERE r = 1), covers AS (SELECT kept.cluster, entity_name FROM kept JOIN cl ON cl.level = 1 AND cl.cluster = kept.sub),
ln AS (SELECT cluster, 'node' AS kind, entity_name AS name, entity_name AS a, entity_name AS b, degree AS rank, 3 AS tokens FROM cl JOIN deg ON node = entity_name WHERE level = 0 UNION ALL
SELECT DISTINCT cluster, 'edge', least(x.node, neighbour) || ' -> ' || greatest(x.node, neighbour), least(x.node, neighbour), greatest(x.node, neighbour), s.degree + t.degree, 5 FROM both_ways x JOIN cl ON x.node = entity_name AND level = 0 JOIN deg s ON s.node = x.node JOIN deg t ON t.node = neighbour),
f AS (SELECT ln.*, EXISTS (SELECT 1 FROM covers c WHERE c.cluster = ln.cluster AND (c.entity_name = a OR c.entity_name = b)) AS covered FROM ln),
r AS (SELECT *, sum(tokens) OVER w AS s, row_number() OVER w - 1 AS ord FROM f WINDOW w AS (PARTITION BY cluster, kind ORDER BY covered, rank DESC, name))
SELECT 0 AS level, cluster, kind, ord, name, rank::DOUBLE AS rank FROM r WHERE s <= 20 UNION ALL SELECT 0, cluster, 'report', 0, sub, n::DOUBLE FROM kept""")
def community_describe_subs(spark, d):
    """Communities that don't fit: the report of the largest sub-community that fits, then what it doesn't cover."""
    e = graph.edge_degrees(described_edges(spark, d)).withColumn("tokens", F.lit(5))
    n = graph.degrees(e).select(F.col("node").alias("entity_name"), "degree", F.lit(3).alias("tokens"), F.lit("").alias("description"))
    c = given_clusters(spark, d)
    r = c.where("level = 1").groupBy("level", "cluster").agg(F.count("*").cast("double").alias("occurrence")).select("*", F.lit(60).cast("long").alias("tokens"), F.lit("r").alias("report"))
    rows = community.describe_with_subs(c, n, e.select("src_id", "tgt_id", "rank", "tokens", "description"), community.sub_clusters(c), r, 100, levels=[0])
    return rows.select("level", "cluster", "kind", "ord", "name", "rank")


@_query()
def propagated_communities(spark, d):
    v, e = places(spark, d)
    return community.detect(v, e.withColumn("weight", F.lit(1.0)))


@_query()
def modular_communities(spark, d):
    """Clusters of the whole graph by modularity, those of over 100 nodes divided again."""
    return community.modular(nodes(spark, d).select("entity_name"), edges(spark, d), largest=100)


# Cache, languages, metrics -----------------------------------------------------------------------------------------------------------


@_query("SELECT event_id, CASE WHEN n IS NULL THEN NULL ELSE 'answer ' || n END AS answer FROM events LEFT JOIN (SELECT user_id AS u, event_type AS e, count(*) AS n FROM events WHERE value > 50 GROUP BY 1, 2) ON u = user_id AND e = event_type")
def cache_exact_lookup(spark, d):
    t = table(spark, d, "events")
    key = X.args_hash(F.col("user_id"))
    c = t.where("value > 50").groupBy("event_type", "user_id").agg(F.count("*").alias("n")).select(F.col("event_type").alias("mode"), key.alias("args_hash"), F.concat(F.lit("answer "), F.col("n").cast("string")).alias("answer"))
    return cache.exact(t.select("event_id", F.col("event_type").alias("mode"), key.alias("args_hash")), c).select("event_id", "answer")


@_query(f"WITH s AS (SELECT q.vec_id AS request_id, a.vec_id AS hit, {COS} AS score FROM embeddings q JOIN embeddings a ON a.label = q.label) SELECT request_id, hit::VARCHAR AS args_hash FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, hit::VARCHAR) AS r FROM s WHERE score > 0.95) WHERE r = 1")
def cache_semantic_best(spark, d):
    t = table(spark, d, "embeddings")
    c = t.select(F.col("label").cast("string").alias("mode"), F.lit("query").alias("cache_type"), F.col("vec_id").cast("string").alias("args_hash"), F.lit("a").alias("answer"), V.quantize(F.col("embedding")).alias("q")).select("*", "q.*")
    r = t.select(F.col("vec_id").alias("request_id"), F.col("label").cast("string").alias("mode"), F.lit("query").alias("cache_type"), F.col("embedding").alias("vector"))
    return cache.semantic(r, c, 0.95).select("request_id", "args_hash")


LANGS = "x AS (SELECT doc_id, lang, source || (doc_id % 7) AS name, embedding FROM documents JOIN embeddings ON vec_id = doc_id)"


def by_language(spark, d) -> DataFrame:
    t = table(spark, d, "documents").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return t.select("lang", F.col("doc_id").alias("key"), F.concat("source", (F.col("doc_id") % 7).cast("string")).alias("name"), F.col("embedding").alias("vector"))


@_query(f"""WITH {LANGS}, f AS (SELECT name, min(doc_id) AS tgt FROM x WHERE lang <> 'en' GROUP BY 1), e AS (SELECT doc_id AS src, tgt, 1.0::DOUBLE AS score, 'exact' AS method FROM x JOIN f USING (name) WHERE lang = 'en'),
s AS (SELECT a.doc_id AS src, q.doc_id AS tgt, {COS} AS score FROM x a, x q WHERE a.lang = 'en' AND q.lang <> 'en' AND a.doc_id NOT IN (SELECT src FROM e)), n AS (SELECT src, tgt, score, 'embedding' AS method FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) AS r FROM s) WHERE r = 1 AND score >= 0.25)
SELECT src, tgt, round(score, 6) AS score, method FROM e UNION ALL SELECT src, tgt, round(score, 6), method FROM n""")
def xling_embedding_cascade(spark, d):
    t = by_language(spark, d)
    return cache.match_languages(t.where("lang = 'en'").drop("lang"), t.where("lang <> 'en'").drop("lang"), 0.25).withColumn("score", F.round("score", 6))


@_query("SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def pairs_dedup(spark, d):
    t = table(spark, d, "orders").withColumn("c", F.col("o_custkey").cast("string"))
    return extract.first_of_key(t, ["c", "o_orderpriority"], "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey")


@_query("""WITH k AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names, n_regionkey + 4 AS n FROM nation GROUP BY n_regionkey)
SELECT n_regionkey, array_to_string(CASE WHEN len(names) >= n THEN names[1:n] ELSE list_concat(names, list_transform(range(1, n - len(names) + 1), lambda i: names[len(names)] || repeat(' (Copy)', i::INTEGER))) END, ';') AS names FROM k""")
def pairs_pad_truncate(spark, d):
    t = table(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x.n_name).alias("names"))
    return t.select("n_regionkey", F.array_join(extract.fit_pairs(F.col("names"), F.col("n_regionkey") + 4), ";").alias("names"))


@_query("SELECT n_regionkey, count(*) AS links FROM nation GROUP BY 1 HAVING count(*) > 0")
def matched_lines(spark, d):
    line = F.concat((F.col("n_nationkey") + 1).cast("string"), F.lit(". Entity: "), "n_name", F.lit(" | Type: PLACE | Description: d"))
    t = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(line), "\n").alias("answer"))
    return t.select("n_regionkey", F.size(F.filter(extract.matched_entities(F.col("answer")), lambda x: (x.type == "PLACE") & (x.name != ""))).cast("long").alias("links"))


PRED = "SELECT o_custkey AS q, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS p, list(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS a FROM orders GROUP BY 1"


def predictions(spark, d) -> DataFrame:
    """A ranked list for each customer: their orders by date; those with status F are relevant."""
    o = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x.o_orderkey)
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("query_id")).agg(o.alias("predicted"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("actual"))


METRICS = f"""m AS (SELECT q, coalesce(a, []) AS a, p[1:5] AS p FROM ({PRED})), h AS (SELECT q, a, p, list_filter(range(1, len(p) + 1), lambda i: list_contains(a, p[i])) AS h FROM m),
v AS (SELECT q, CASE WHEN len(h) = 0 THEN 0.0 ELSE list_sum(list_transform(h, lambda x, i: i / x)) / len(h) END AS ap, CASE WHEN len(h) = 0 THEN 0.0 ELSE 1.0 / h[1] END AS rr, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, p)) / len(a) END AS rc FROM h)"""


@_query(f"WITH {METRICS} SELECT q AS query_id, round(CAST(ap AS DOUBLE), 6) AS ap, round(CAST(rr AS DOUBLE), 6) AS rr, round(CAST(rc AS DOUBLE), 6) AS recall FROM v")
def metrics_per_query(spark, d):
    m = metrics.per_query(predictions(spark, d), 5)
    return m.select("query_id", *(F.round(c, 6).alias(c) for c in ("ap", "rr", "recall")))


@_query(f"WITH {METRICS} SELECT round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, round(avg(rc), 6) AS recall, round((avg(ap) + avg(rr) + avg(rc)) / 3, 6) AS mean FROM v")
def metrics_mean(spark, d):
    m = metrics.means(predictions(spark, d), 5)
    return m.select(*(F.round(c, 6).alias(c) for c in ("map", "mrr", "recall", "mean")))


@_query("SELECT o_custkey AS query_id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS actual FROM orders GROUP BY 1")
def truth_sets(spark, d):
    t = metrics.truth(table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("context_id")))
    return t.select("query_id", F.array_join("actual", ",").alias("actual"))
