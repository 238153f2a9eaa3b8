"""A graph that grows by micro-batches of extraction answers.

A batch takes its answers apart and writes their records to a folder of its own, so it costs what its own answers cost, holds no state (but the chunks that were
answered, where each counts once), and one that is run again replaces what it had written. Reading the graph merges the records of all batches. `compact` turns them into members:
one for each type a node has been given, each description, keyword list and source, and an edge's weight, with a count, a weight and the first place of each; an entity with millions of
sources is millions of small rows there and not one large one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import FIELD_SEP, quoted
from ..operators import extract, merge

FIELDS = ("type", "description", "keywords", "source")
KEY = ["kind", "a", "b", "field", "value"]
#: What a batch stores of its answers.
RECORDS = "linked boolean, a string, b string, description string, keywords string, weight double, source_id string, ord long"
#: kind: node or edge; a, b: the name, or the pair in order; n: times seen; first: where it was first seen, stored rows last.
MEMBERS = "kind string, a string, b string, field string, value string, n long, weight double, first struct<stored:int,source_id:string,ord:long>"
#: For a state that outgrows memory: set these before a stream is started.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def _members(rows: DataFrame, kind: str, names: tuple[str, str | None], fields: dict[str, str], weight: str | None, stored: int, split: bool) -> DataFrame:
    """A row for each member that the rows name; empty values are none. split: values hold several members, joined."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    several = lambda f, c: F.split(text(c), quoted(FIELD_SEP)) if split and f != "type" else F.array(text(c))
    zero = F.lit(0.0)
    member = lambda f: lambda v: F.struct(F.lit(f).alias("field"), v.alias("value"), zero.alias("weight"))
    each = [F.transform(several(f, c), member(f)) for f, c in fields.items()]
    held = F.filter(F.concat(*each), lambda m: m.value != "")
    if weight:
        held = F.concat(held, F.array(F.struct(F.lit("weight").alias("field"), F.lit("").alias("value"), F.coalesce(F.col(weight).cast("double"), zero).alias("weight"))))
    first = F.struct(F.lit(stored).alias("stored"), F.col("source_id").alias("source_id"), F.col("ord").cast("long").alias("ord"))
    b = F.col(names[1]) if names[1] else F.lit("")
    out = rows.select(F.lit(kind).alias("kind"), F.col(names[0]).alias("a"), b.alias("b"), F.explode(held).alias("m"), F.lit(1).cast("long").alias("n"), first.alias("first"))
    return out.select("kind", "a", "b", "m.field", "m.value", "n", "m.weight", "first")


def stored_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The members of a graph: each node's type is one vote that loses ties."""
    at = lambda t: t.withColumn("ord", F.lit(0))
    n = _members(at(nodes), "node", ("entity_name", None), {"type": "entity_type", "description": "description", "source": "source_id"}, None, 1, True)
    e = _members(at(extract.undirected(edges)), "edge", ("src_id", "tgt_id"), {"description": "description", "keywords": "keywords", "source": "source_id"}, "weight", 1, True)
    return n.unionByName(e).withColumn("first", F.struct(F.lit(1).alias("stored"), F.lit("").alias("source_id"), F.lit(0).cast("long").alias("ord")))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.min("first").alias("first"))


def start_from(folder: str, nodes: DataFrame, edges: DataFrame) -> None:
    """Put a graph below answers that a stream will add; before the stream first starts."""
    _summed(stored_members(nodes, edges)).write.mode("overwrite").parquet(f"{folder}/stored")


def _rows(table: DataFrame, kind: Column, b: Column, **fields: Column) -> DataFrame:
    """What graph_of merges: one row names a node (a) or an edge (a, b) and holds some of its fields, empty ones as null."""
    value = lambda f: F.nullif(fields[f], F.lit("")).alias(f)
    return table.select(kind.alias("kind"), "a", b.alias("b"), *map(value, FIELDS), fields["weight"].alias("weight"), fields["n"].alias("n"), fields["first"].alias("first"))


def _of_records(table: DataFrame) -> DataFrame:
    node = ~F.col("linked")
    t = table.where("linked OR trim(a) <> ''").select("*", F.when(node, F.col("a")).otherwise(F.least("a", "b")).alias("_a"), F.when(node, F.lit("")).otherwise(F.greatest("a", "b")).alias("_b"), F.when(node, F.col("b")).alias("type"))
    t = t.drop("a", "b").withColumnRenamed("_a", "a")
    first = F.when(node, F.struct(F.lit(0).alias("stored"), F.col("source_id").alias("source_id"), F.col("ord").alias("ord")))
    weight = F.when(F.col("linked"), F.coalesce("weight", F.lit(0.0))).otherwise(F.lit(0.0))
    return _rows(t, F.when(node, "node").otherwise("edge"), F.col("_b"), type=F.col("type"), description=F.col("description"), keywords=F.col("keywords"), source=F.col("source_id"), weight=weight, n=F.lit(1).cast("long"), first=first)


def _of_members(table: DataFrame) -> DataFrame:
    of = {f: F.when(F.col("field") == f, F.col("value")) for f in FIELDS}
    return _rows(table, F.col("kind"), F.col("b"), **of, weight=F.col("weight"), n=F.col("n"), first=F.col("first"))


def _as_members(rows: DataFrame) -> DataFrame:
    """A row for each field of the rows, summed."""
    member = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.lit(0.0).alias("weight"))
    weight = F.struct(F.lit("weight").alias("field"), F.lit("").alias("value"), F.col("weight").alias("weight"))
    held = F.concat(F.filter(F.array(*map(member, FIELDS)), lambda m: m.value.isNotNull()), F.when(F.col("kind") == "edge", F.array(weight)).otherwise(F.array().cast("array<struct<field:string,value:string,weight:double>>")))
    return _summed(rows.select("kind", "a", "b", F.explode(held).alias("m"), "n", "first").select("kind", "a", "b", "m.field", "m.value", "n", "m.weight", "first"))


def merge_stream(answers: DataFrame, folder: str, once: bool = True) -> DataStreamWriter:
    """A query, to be started, that merges a stream of answers (chunk_id, answer) into the graph below `folder`.

    With `once` a chunk that is answered again, in the same batch or a later one, changes nothing: its first answer counts. Null
    and empty answers and records without a name add nothing.
    """
    new = answers.select("chunk_id", "answer")
    new = new.dropDuplicates(["chunk_id"]) if once else new

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/records/batch={number}")

    return extract.said(new).writeStream.option("checkpointLocation", f"{folder}/progress").foreachBatch(batch)


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _batches(spark: SparkSession, folder: str, table: str) -> list[int]:
    """Numbers of the batches that were written whole."""
    fs, top = _files(spark, f"{folder}/{table}")
    if not fs.exists(top):
        return []
    jvm = spark.sparkContext._jvm
    dirs = [s.getPath() for s in fs.listStatus(top)]
    return sorted(int(d.getName().removeprefix("batch=")) for d in dirs if d.getName().startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS")))


def _answered(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the stream's answers: of the last snapshot, and of the batches after it."""
    snapshots = _batches(spark, folder, "snapshot")
    base = snapshots[-1] if snapshots else None
    later = [b for b in _batches(spark, folder, "records") if base is None or b > base]
    out = _of_members(spark.read.schema(MEMBERS).parquet(f"{folder}/snapshot/batch={base}")) if snapshots else None
    if later:
        new = _of_records(spark.read.schema(RECORDS).parquet(*(f"{folder}/records/batch={b}" for b in later)))
        out = new if out is None else out.unionByName(new)
    return _of_members(spark.createDataFrame([], MEMBERS)) if out is None else out


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """The totals of each member of the stream's answers."""
    return _as_members(_answered(spark, folder))


def compact(spark: SparkSession, folder: str) -> int | None:
    """Write the totals as one snapshot and delete the batches and snapshots before it, while the stream isn't running; returns the last batch that it holds.

    A snapshot counts once it is whole, so a run that is broken off loses nothing and can be repeated.
    """
    done = _batches(spark, folder, "records")
    if not done:
        return None
    old = _batches(spark, folder, "snapshot")
    if not old or old[-1] < done[-1]:
        totals(spark, folder).write.mode("overwrite").parquet(f"{folder}/snapshot/batch={done[-1]}")
    for table, numbers in (("records", done), ("snapshot", [b for b in old if b < done[-1]])):
        for b in numbers:
            fs, p = _files(spark, f"{folder}/{table}/batch={b}")
            fs.delete(p, True)
    return done[-1]


def graph_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (entity_name, entity_type, description, source_id) and edges (src_id, tgt_id, weight, description, keywords, source_id) of rows; endpoints that nothing describes are nodes too."""
    of = lambda f: merge.joined(F.collect_set(f))
    node, edge = rows.where("kind = 'node'"), rows.where("kind = 'edge'")
    typed = node.where("type IS NOT NULL").groupBy("a", "type").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    best = Window.partitionBy("a").orderBy(F.desc("n"), "first")
    kind = typed.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(F.col("a").alias("entity_name"), F.col("type").alias("entity_type"))
    sets = node.groupBy(F.col("a").alias("entity_name")).agg(of("description").alias("description"), of("source").alias("source_id"))
    nodes = kind.join(sets, "entity_name")

    def merged(t: DataFrame) -> DataFrame:
        return t.groupBy(F.col("a").alias("src_id"), F.col("b").alias("tgt_id")).agg(F.sum("weight").alias("weight"), of("description").alias("description"), of("keywords").alias("keywords"), of("source").alias("source_id"))

    ends = edge.select(F.col("a").alias("src_id"), F.col("b").alias("tgt_id"), *(c for c in edge.columns if c not in ("a", "b")))
    few = merge.undescribed(typed.select(F.col("a").alias("entity_name")).distinct(), ends)[0].withColumnsRenamed({"src_id": "a", "tgt_id": "b"})
    return nodes.unionByName(merge.missing_endpoints(nodes, merged(few))), merged(edge)


def read_graph(spark: SparkSession, folder: str, batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the graph below `folder`; with `batch`, of those that this batch has touched, as they are now."""
    rows = _answered(spark, folder)
    fs, stored = _files(spark, f"{folder}/stored")
    if fs.exists(stored):
        rows = rows.unionByName(_of_members(spark.read.schema(MEMBERS).parquet(f"{folder}/stored")))
    if batch is not None:
        touched = _of_records(spark.read.schema(RECORDS).parquet(f"{folder}/records/batch={batch}")).select("kind", "a", "b").distinct()
        rows = rows.join(touched, ["kind", "a", "b"], "left_semi")
    return graph_of(rows)
