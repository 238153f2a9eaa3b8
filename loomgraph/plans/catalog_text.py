"""Queries over texts: ids, chunks, tokens, records, conversations; with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.tokens import counted, fixed
from ..operators import cache, chunk, extract, tables
from ..scratch import materialize, scratch
from ..sources.files import page_text
from ..streaming.ingest import enqueue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"


@_query(f"SELECT 'doc-' || md5(t) AS id, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, {STRIP} AS t FROM documents) GROUP BY t")
def doc_dedup_ids(spark, d):
    t = table(spark, d, "documents").withColumn("t", X.strip(F.col("text")))
    return t.groupBy(X.doc_id(F.col("t")).alias("id")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@_query(f"""WITH t AS (SELECT doc_id, {STRIP} AS c FROM documents), known AS (SELECT DISTINCT 'doc-' || md5(c) AS id FROM t JOIN labels USING (doc_id))
SELECT DISTINCT 'doc-' || md5(c) AS id, CAST(length(c) AS INTEGER) AS content_length, 'pending' AS status FROM t WHERE 'doc-' || md5(c) NOT IN (SELECT id FROM known)""")
def doc_enqueue_antijoin(spark, d):
    docs = table(spark, d, "documents")
    known = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(X.doc_id(X.strip(F.col("text"))).alias("id")).distinct()
    return enqueue(docs, known).select("id", "content_length", "status")


@_query(f"SELECT doc_id, CASE WHEN length(t) <= 100 THEN t ELSE substr(t, 1, 100) || '...' END AS summary FROM (SELECT doc_id, {STRIP} AS t FROM documents)")
def doc_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", X.summary(F.col("text")).alias("summary"))


STATUS_SQL = "CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN quality = 1 THEN 'processed' ELSE 'failed' END"


def _status(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.withColumn("status", F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "processed").otherwise("failed"))


@_query(f"""WITH s AS (SELECT {STATUS_SQL} AS status FROM documents d LEFT JOIN labels l USING (doc_id)), k(status) AS (VALUES ('pending'), ('processing'), ('processed'), ('failed'))
SELECT k.status, count(s.status) AS n FROM k LEFT JOIN s USING (status) GROUP BY k.status""")
def doc_status_counts(spark, d):
    return tables.status_counts(_status(spark, d))


@_query(f"""SELECT {STATUS_SQL} AS status, d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id)""")
def docs_by_status_group(spark, d):
    """Documents by status, as rows: a status may hold most of a table."""
    return _status(spark, d).select("status", "doc_id").repartition("status", "doc_id").sortWithinPartitions("status", "doc_id")


@_query(r"SELECT doc_id, CAST(trunc((length(text) - length(r)) * 1.5 + length(r) * 0.25) AS INTEGER) AS tokens FROM (SELECT doc_id, text, regexp_replace(text, '[\x{4e00}-\x{9fff}]', '', 'g') AS r FROM documents)")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@_query(f"SELECT source, doc_id, n FROM (SELECT source, doc_id, n, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS s FROM (SELECT source, doc_id, CAST(len({WORDS.format('text')}) AS BIGINT) AS n FROM documents)) WHERE s <= 4000")
def token_budget_prefix(spark, d):
    t = table(spark, d, "documents").select("source", "doc_id", X.n_words(F.col("text")).alias("n"))
    return tables.within_budget(t, [F.col("doc_id")], F.col("n"), 4000, ["source"])


@_query("SELECT CAST(0 AS BIGINT) AS kept")
def token_budget_zero(spark, d):
    t = table(spark, d, "documents").select("source", "doc_id", F.lit(0).alias("n"))
    return tables.within_budget(t, [F.col("doc_id")], F.col("n"), 0, ["source"]).agg(F.count("*").alias("kept"))


@_query("""WITH RECURSIVE m AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
p AS (SELECT conv_id, turn, t, r, 0 AS g, t AS s FROM m WHERE r = 1 UNION ALL
SELECT m.conv_id, m.turn, m.t, m.r, CASE WHEN p.s + m.t > 1500 THEN p.g + 1 ELSE p.g END, CASE WHEN p.s + m.t > 1500 THEN m.t ELSE p.s + m.t END FROM p JOIN m ON m.conv_id = p.conv_id AND m.r = p.r + 1)
SELECT conv_id, turn, t, CAST(g AS INTEGER) AS "group" FROM p""")
def greedy_pack_groups(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("t"))
    return tables.pack(t, "conv_id", "turn", "t", 1500)


@_query(f"""WITH w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 180)) AS s FROM w)
SELECT doc_id, CAST(s // 180 AS INTEGER) AS chunk_order_index, CAST(len(w[s + 1 : s + 200]) AS BIGINT) AS tokens, md5(array_to_string(w[s + 1 : s + 200], ' ')) AS content_md5 FROM s""")
def chunk_window_words(spark, d):
    c = chunk.by_tokens(table(spark, d, "documents").select("doc_id", "text"), "text", 200, 20)
    return c.select("doc_id", "chunk_order_index", "tokens", F.md5("content").alias("content_md5"))


PIECES_SQL = r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_order_index, regexp_replace(x[i], '^\s+|\s+$', '', 'g') AS c FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"""


@_query(f"SELECT doc_id, chunk_order_index, CAST(len({WORDS.format('c')}) AS BIGINT) AS tokens, md5(c) AS content_md5 FROM ({PIECES_SQL})")
def chunk_by_char(spark, d):
    c = chunk.by_character(table(spark, d, "documents").select("doc_id", "text"), "\n")
    return c.select("doc_id", "chunk_order_index", "tokens", F.md5("content").alias("content_md5"))


@_query(f"""WITH p AS (SELECT doc_id, chunk_order_index AS i, c, {WORDS.format('c')} AS w FROM ({PIECES_SQL})),
q AS (SELECT doc_id, i, s, CASE WHEN len(w) > 30 THEN array_to_string(w[s + 1 : s + 30], ' ') ELSE c END AS c FROM (SELECT *, unnest(CASE WHEN len(w) > 30 THEN range(0, len(w), 25) ELSE [CAST(0 AS BIGINT)] END) AS s FROM p))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, s) - 1 AS INTEGER) AS chunk_order_index, CAST(len({WORDS.format('c')}) AS BIGINT) AS tokens, md5(c) AS content_md5 FROM q""")
def chunk_by_char_resplit(spark, d):
    c = chunk.by_character(table(spark, d, "documents").select("doc_id", "text"), "\n", size=30, overlap=5)
    return c.select("doc_id", "chunk_order_index", "tokens", F.md5("content").alias("content_md5"))


@_query(f"""WITH p AS (SELECT doc_id, chunk_order_index AS i, {WORDS.format('c')} AS w FROM ({PIECES_SQL})),
q AS (SELECT doc_id, i, w, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), []) AS b FROM p),
r AS (SELECT doc_id, i, list_concat(b[greatest(len(b) - 4, 1) : len(b)], w)[1:40] AS j FROM q)
SELECT doc_id, i AS chunk_order_index, CAST(len(j) AS BIGINT) AS tokens, md5(array_to_string(j, ' ')) AS content_md5 FROM r""")
def chunk_overlap_prev(spark, d):
    c = chunk.by_character(table(spark, d, "documents").select("doc_id", "text"), "\n")
    c = chunk.with_previous(c, "doc_id", 5, 40)
    return c.select("doc_id", "chunk_order_index", "tokens", F.md5("content").alias("content_md5"))


@_query(f"""SELECT 'chunk-' || md5(c) AS id, max(doc_id) AS doc_id, arg_max(chunk_order_index, doc_id * 1000000 + chunk_order_index) AS chunk_order_index FROM ({PIECES_SQL}) GROUP BY c""")
def chunk_ids_last_wins(spark, d):
    c = chunk.by_character(table(spark, d, "documents").select("doc_id", "text"), "\n")
    return chunk.with_ids(c, "doc_id").select("id", "doc_id", "chunk_order_index")


@_query(f"""SELECT doc_id, CAST(i AS INTEGER) AS chunk_order_index, CAST(least(50, ceil((length(t) - i * 180) / 4.0)) AS BIGINT) AS tokens, md5(trim(substr(t, i * 180 + 1, 200), chr(9) || chr(10) || chr(13) || ' ')) AS content
FROM (SELECT doc_id, coalesce(text, '') AS t, unnest(range(0, CAST(ceil(ceil(length(coalesce(text, '')) / 4.0) / 45) AS BIGINT))) AS i FROM documents)""")
def chunk_window_tokens(spark, d):
    """Windows of 50 tokens of four characters each, of which the next window starts 45 on."""
    c = chunk.by_tokens(table(spark, d, "documents").select("doc_id", "text"), "text", 50, 5, fixed(4))
    return c.select("doc_id", "chunk_order_index", "tokens", F.md5("content").alias("content"))


@_query("SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", counted(F.col("text"), fixed(4)).alias("tokens"))


@_query()
def chunk_by_separators(spark, d):
    return chunk.by_separators(table(spark, d, "documents").select("doc_id", "text"), "doc_id", size=200, overlap=20)


@_query(r"""SELECT doc_id, md5(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\x00-\x1f\x7f-\x{9f}]', '', 'g')) AS cleaned
FROM (SELECT doc_id, regexp_replace('  &lt;' || text || '&amp;&quot; ', '^\s+|\s+$', '', 'g') AS t FROM documents)""")
def clean_str(spark, d):
    t = F.concat(F.lit("  &lt;"), "text", F.lit("&amp;&quot; "))
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean(t)).alias("cleaned"))


ANSWER_SQL = """'("entity"<|>"p' || l_partkey || '"<|>"' || l_returnflag || '"<|>"part ' || l_partkey || '")##("entity"<|>"s' || l_suppkey || '"<|>"' || l_linestatus || '"<|>"supplier ' || l_suppkey || '")##("relationship"<|>"p' || l_partkey || '"<|>"s' || l_suppkey || '"<|>"supplies"<|>"trade"<|>' || l_linenumber || ')##(entity<|>x<|>y<|>z)<|COMPLETE|>'"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    """An extraction answer for each order line: two entities, a relation, and a record without its marker."""
    c, s = F.lit, lambda n: F.col(n).cast("string")
    parts = [c('("entity"<|>"p'), s("l_partkey"), c('"<|>"'), s("l_returnflag"), c('"<|>"part '), s("l_partkey"), c('")##("entity"<|>"s'), s("l_suppkey"), c('"<|>"'), s("l_linestatus"), c('"<|>"supplier '), s("l_suppkey"), c('")##("relationship"<|>"p'), s("l_partkey"), c('"<|>"s'), s("l_suppkey"), c('"<|>"supplies"<|>"trade"<|>'), s("l_linenumber"), c(")##(entity<|>x<|>y<|>z)<|COMPLETE|>")]
    return table(spark, d, "lineitem").select(F.concat_ws("-", s("l_orderkey"), s("l_linenumber")).alias("chunk_id"), F.concat(*parts).alias("answer"))


@_query(f"SELECT n AS pieces, count(*) AS answers FROM (SELECT len(list_filter(list_transform(string_split_regex({ANSWER_SQL}, '##|<\\|COMPLETE\\|>'), lambda x: trim(x)), lambda x: x <> '')) AS n FROM lineitem) GROUP BY n")
def split_multi_marker(spark, d):
    n = F.size(X.split_markers(F.col("answer"), X.RECORD_DELIMITER, X.COMPLETION_DELIMITER)).cast("long")
    return answers(spark, d).groupBy(n.alias("pieces")).agg(F.count("*").alias("answers"))


@_query("""SELECT entity_name, entity_type, count(*) AS records, count(DISTINCT source_id) AS sources FROM (SELECT '"P' || l_partkey || '"' AS entity_name, '"' || l_returnflag || '"' AS entity_type, l_orderkey || '-' || l_linenumber AS source_id FROM lineitem
UNION ALL SELECT '"S' || l_suppkey || '"', '"' || l_linestatus || '"', l_orderkey || '-' || l_linenumber FROM lineitem) GROUP BY 1, 2""")
def parse_entities(spark, d):
    e = extract.entities(extract.records(answers(spark, d)))
    return e.groupBy("entity_name", "entity_type").agg(F.count("*").alias("records"), F.count_distinct("source_id").alias("sources"))


@_query("""SELECT '"P' || l_partkey || '"' AS src_id, '"S' || l_suppkey || '"' AS tgt_id, min('"trade"') AS keywords, CAST(sum(l_linenumber) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2""")
def parse_relations(spark, d):
    r = extract.relations(extract.records(answers(spark, d)))
    return r.groupBy("src_id", "tgt_id").agg(F.min("keywords").alias("keywords"), F.sum("weight").alias("weight"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_body_extract(spark, d):
    said = F.concat(F.lit("Sure:\n"), F.translate("props", '"', "'"), F.lit("\nDone."))
    return table(spark, d, "events").select("event_id", F.get_json_object(X.repaired_json(said), "$.k").cast("long").alias("k"))


@_query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN '{\"a\": {\"k\": ' || json_extract_string(props, '$.k') || '}}' END AS first_object FROM events")
def json_first_object(spark, d):
    """Objects with an inner one and a line break; a third of them aren't JSON."""
    k = F.get_json_object("props", "$.k")
    said = F.when(F.col("event_id") % 3 == 2, F.concat(F.lit("a } {k "), k, F.lit("} "), "props")).otherwise(F.concat(F.lit('a } {"a": \n{"k": '), k, F.lit("}} {x"), "props"))
    return table(spark, d, "events").select("event_id", X.first_json(said).alias("first_object"))


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type || ' of user ' || user_id AS kind, '{\"u\": ' || user_id || ', w: two words}' AS inner_object, user_id::VARCHAR AS u, 'two words' AS w FROM events")
def json_loose_values(spark, d):
    """Bare values with spaces, repeated keys and an inner object."""
    u = F.col("user_id").cast("string")
    said = F.concat(F.lit("{kind: x, inner: {\"u\": "), u, F.lit(", w: two words}, kind: "), "event_type", F.lit(" of user "), u, F.lit(", \"k\" : \""), F.get_json_object("props", "$.k"), F.lit("\"}"))
    t = table(spark, d, "events").select("event_id", X.loose_values(said).alias("v")).withColumn("i", X.loose_values(F.col("v")["inner"]))
    return t.select("event_id", F.col("v")["k"].alias("k"), F.col("v")["kind"].alias("kind"), F.col("v")["inner"].alias("inner_object"), F.col("i")["u"].alias("u"), F.col("i")["w"].alias("w"))


@_query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"k\": ' || json_extract_string(props, '$.k') || '}' ELSE '{\"answer\":\"' || event_type || ' it is\"}' END AS answer FROM events")
def json_response(spark, d):
    """The first object where there is one, else the loose pairs."""
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("So: {\"k\": "), F.get_json_object("props", "$.k"), F.lit("}."))).otherwise(F.concat(F.lit("{answer: "), "event_type", F.lit(" it is}")))
    return table(spark, d, "events").select("event_id", X.response_json(said).alias("answer"))


@_query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN 'boolean' WHEN 2 THEN 'int' WHEN 3 THEN 'float' ELSE 'text' END AS kind, CASE event_id % 6 WHEN 2 THEN user_id::DOUBLE WHEN 3 THEN user_id + 0.5::DOUBLE END AS number FROM events")
def json_scalars(spark, d):
    k, u = F.col("event_id") % 6, F.col("user_id").cast("string")
    bare = F.when(k == 0, F.lit(" null ")).when(k == 1, F.lit("true")).when(k == 2, u).when(k == 3, F.concat(u, F.lit(".5"))).when(k == 4, F.concat(F.lit('"'), u, F.lit('"'))).otherwise(F.lit("1.2.3"))
    return table(spark, d, "events").select("event_id", X.scalar(bare).alias("s")).select("event_id", "s.kind", "s.number")


@_query(r"""SELECT event_id, 'say "' || event_type || '"' || chr(10) || chr(9) || 'é \new \"' || chr(128512) || user_id || 'A' AS said FROM events""")
def json_unicode_texts(spark, d):
    """Escapes in texts with line breaks, tabs, quotes, other escapes and a pair of halves."""
    said = F.concat(F.lit('say \\u0022'), "event_type", F.lit('"\n\t\\u00e9 \\new \\"\\ud83d\\uDE00'), F.col("user_id").cast("string"), F.lit("\\u0041"))
    return table(spark, d, "events").select("event_id", X.unicode_escapes(said).alias("said"))


@_query("SELECT n_nationkey, n_name || ' é\"' AS name FROM nation")
def json_unicode_escapes(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.unicode_escapes(F.concat("n_name", F.lit(' \\u00e9"'))).alias("name"))


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || ' is due' ELSE 'hm' END AS answer FROM orders")
def response_cleanup(spark, d):
    system, query = F.lit("You answer."), F.col("o_orderpriority")
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("<system>You answer.</system>user "), F.lit("model "), F.substring("o_orderpriority", 1, 1), F.substring("o_orderpriority", 2, 99), F.lit(" is due"))).otherwise(F.lit("hm"))
    said = F.concat(said, F.lit(""))
    return table(spark, d, "orders").select("o_orderkey", X.clean_response(said, system, F.concat(query, F.lit("?"))).alias("answer"))


@_query("SELECT o_orderkey, md5('Answer.' || chr(10) || chr(10) || '### Keywords:' || chr(10) || 'High-level: ' || o_orderpriority || chr(10) || 'Low-level: ' || o_orderstatus || ', ' || o_custkey || chr(10) || chr(10) || '### Query:' || chr(10) || 'q' || o_orderkey) AS question FROM orders")
def keyword_question(spark, d):
    q = X.keyword_question(F.lit("Answer."), F.concat(F.lit("q"), F.col("o_orderkey").cast("string")), F.array("o_orderpriority"), F.array("o_orderstatus", F.col("o_custkey").cast("string")))
    return table(spark, d, "orders").select("o_orderkey", F.md5(q).alias("question"))


@_query("SELECT n_nationkey, 'x' || lower(hex(encode(n_name))) AS label, n_name AS name FROM nation")
def label_codec(spark, d):
    n = table(spark, d, "nation").withColumn("label", X.encode_label(F.col("n_name")))
    return n.select("n_nationkey", "label", X.decode_label(F.col("label")).alias("name"))


@_query(f"""WITH w AS (SELECT doc_id, list_distinct({WORDS.format('lower(text)')}) AS w FROM documents)
SELECT a.doc_id, round(CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def jaccard_docs(spark, d):
    t = table(spark, d, "documents")
    other = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return t.join(other, "doc_id").select("doc_id", F.round(X.jaccard(F.col("text"), F.col("other")), 6).alias("jaccard"))


@_query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'mix' ELSE 'hybrid' END AS mode, CASE o_orderkey % 4 WHEN 3 THEN '/loud ' || o_orderpriority ELSE o_orderpriority END AS text FROM orders""")
def mode_prefix(spark, d):
    k = F.col("o_orderkey") % 4
    q = F.concat(F.when(k == 0, "/local ").when(k == 1, "/mix   ").when(k == 3, "/loud ").otherwise(""), "o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", X.mode_of(q).alias("m")).select("o_orderkey", "m.mode", "m.text")


@_query("""WITH m AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations WHERE role IN ('user', 'assistant')),
p AS (SELECT *, n // 2 AS pair, count(*) OVER (PARTITION BY conv_id, n // 2) AS k FROM m), f AS (SELECT *, max(pair) OVER (PARTITION BY conv_id) AS last FROM p WHERE k = 2)
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY pair, role <> 'user', n) AS history FROM f WHERE pair > last - 2 GROUP BY conv_id""")
def conversation_turns(spark, d):
    return cache.turns(table(spark, d, "conversations"), 2)


@_query("""SELECT c_custkey, '"' || replace(c_name, '"', '""') || '","' || c_nationkey || '","' || c_mktsegment || '"' AS line FROM customer""")
def csv_render(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.csv_row(F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")).alias("line"))


@_query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def csv_parse(spark, d):
    t = table(spark, d, "customer").withColumn("line", X.csv_row(F.col("c_name"), F.col("c_mktsegment")))
    return t.select("c_custkey", X.csv_cells(F.col("line"), 2).alias("c")).select("c_custkey", F.col("c.c0").alias("c_name"), F.col("c.c1").alias("c_mktsegment"))


@_query("""SELECT c_custkey, '"' || c_name || '",' || chr(9) || c_nationkey AS line FROM customer""")
def tab_render(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.tab_row((F.concat(F.lit('"'), "c_name", F.lit('"')), False), (F.col("c_nationkey"), True)).alias("line"))


@_query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def page_texts(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(page_text(F.col("html"))).alias("text_md5"))


@_query("SELECT event_id, md5('extract:' || event_type || CAST(user_id AS VARCHAR)) AS hash FROM events")
def args_hash(spark, d):
    return table(spark, d, "events").select("event_id", X.args_hash(F.col("event_type"), F.col("user_id"), cache_type="extract").alias("hash"))


STOPS = {"en": ("the", "and", "of"), "fr": ("le", "la", "et"), "de": ("der", "die", "und"), "es": ("el", "los", "de")}


@_query("WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT doc_id, " + ", ".join(f"len(list_filter(w, lambda x: x IN {v})) AS {k}" for k, v in STOPS.items()) + " FROM w) SELECT doc_id, CASE WHEN greatest(en, fr, de, es) = 0 THEN NULL WHEN en = greatest(en, fr, de, es) THEN 'English' WHEN fr = greatest(en, fr, de, es) THEN 'French' WHEN de = greatest(en, fr, de, es) THEN 'German' ELSE 'Spanish' END AS language FROM n")
def language_vote(spark, d):
    return table(spark, d, "documents").select("doc_id", X.language_name(X.by_stop_words(F.col("text"), STOPS)).alias("language"))


@_query("SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, md5(coalesce(text, '')) AS content FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations)")
def alternate_messages(spark, d):
    """Each conversation's texts in order, as user and assistant in turn."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    m = X.in_turn(F.transform("t", lambda x: x.text))
    return c.select("conv_id", F.posexplode(m).alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", F.md5("m.content").alias("content"))


@_query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    from ..streaming.ingest import windowed_counts

    return windowed_counts(table(spark, d, "events"), "10 minutes", "1 hour").withColumn("total", F.round("total", 4))


@_query(f"SELECT 'doc-' || md5(t) AS id, 'processed' AS status, CAST(greatest(ceil(len({WORDS.format('t')}) / 180.0), 0) AS BIGINT) AS chunks_count FROM (SELECT DISTINCT {STRIP} AS t FROM documents)")
def stream_ingest_dedup(spark, d):
    """documents as a stream of files through the ingest query, run to its end; the status table that it leaves."""
    from ..streaming.ingest import STATUS, ingest_stream

    schema = table(spark, d, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/document[s].parquet")  # a pattern takes a file or a folder
    folder = scratch(spark)
    q = ingest_stream(spark, stream, folder).trigger(availableNow=True).start()
    q.awaitTermination()
    return materialize(spark.read.schema(f"{STATUS}, batch int").parquet(f"{folder}/status").select("id", "status", "chunks_count"))
