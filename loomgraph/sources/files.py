"""Folders of documents, JSON key-value files, graph XML, query sets, and tables of paired records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
SUFFIXES = ("txt", "md", "pdf", "docx", "pptx", "xlsx")
GRAPH_KEYS = {"node": ("entity_type", "description", "source_id"), "edge": ("weight", "description", "keywords", "source_id")}


def supported(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(" + "|".join(SUFFIXES) + ")$")


def scan(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """path, content and modificationTime of all supported files below a folder that `known` (path) doesn't list."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(supported(F.col("path")))
    return files if known is None else files.join(known.select("path"), "path", "left_anti")


#: Columns of a binary file, as a stream has to name them.
FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, at_once: int = 100) -> DataFrame:
    """A stream of the supported files below a folder, old ones and those that are added while it runs, at most `at_once` a micro-batch; each comes once, by its path."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", at_once).load(folder)
    return files.where(supported(F.col("path")))


def extract_text(files: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, text and error. Plain text is decoded as UTF-8 in the JVM, and one that isn't UTF-8 has an error; other formats go through `readers` by suffix, in Python.

    A file of a format without a reader, or one that its reader can't read, has a null text and an error: no file is left out.
    """
    suffix = F.regexp_extract(F.lower("path"), r"\.([a-z]+)$", 1)
    readers = readers or {}
    none = F.lit(None).cast("string")
    said = F.col("content").cast("string")
    valid = F.is_valid_utf8(said)
    plain = files.where(suffix.isin("txt", "md")).select("path", F.when(valid, said).alias("text"), F.when(~valid, F.lit("not UTF-8")).alias("error"))
    unread = files.where(~suffix.isin("txt", "md", *readers)).select("path", none.alias("text"), F.concat(F.lit("no reader for ."), suffix).alias("error"))
    out = plain.unionByName(unread)
    if not readers:
        return out

    def read(suffix: str, content: bytes) -> tuple[str | None, str | None]:
        try:
            return readers[suffix](content), None
        except Exception as e:  # a reader's own errors are part of the result
            return None, f"{type(e).__name__}: {e}"

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            made = [read(s, bytes(c)) for s, c in zip(b["suffix"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "text": [t for t, _ in made], "error": [e for _, e in made]})

    other = files.withColumn("suffix", suffix).where(F.col("suffix").isin(*readers)).select("path", "suffix", "content")
    return out.unionByName(other.mapInPandas(run, "path string, text string, error string"))


def page_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags dropped, basic entities resolved, white space made single."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def read_keyed_json(spark: SparkSession, path: str, value: T.StructType) -> DataFrame:
    """A file {id: {...}, ...} as rows (id and the value's fields): one object is one row of text, so it has to fit a task."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", T.MapType(T.StringType(), value))).alias("id", "v")).select("id", "v.*")


def write_keyed_json(table: DataFrame, path: str) -> None:
    """A row for each id as {"id": ..., fields}: JSON lines, which are written and read in parallel."""
    table.write.mode("overwrite").json(path)


def read_keyed_lines(spark: SparkSession, path: str, value: T.StructType) -> DataFrame:
    """What write_keyed_json has written: id and the value's fields."""
    return spark.read.schema(T.StructType([T.StructField("id", T.StringType()), *value.fields])).json(path)


#: A line of what write_graph writes: an element, or the document's head or foot.
GRAPH_LINE = r'<(node id="[^"<]*"|edge source="[^"<]*" target="[^"<]*")>(<data key="d\d+">[^<]*</data>)*</(node|edge)>|<\?xml [^<]*<graphml [^<]*(<key [^<]*)*<graph [^<]*|</graph></graphml>|'


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of GraphML: data keys d0.. in the order of GRAPH_KEYS, names without quotes, a missing weight is 0.

    A document of any layout is read as a whole by one task for each file. The parts that write_graph leaves are no documents each, but have an element on
    each line: where all lines are such, they are read line by line, side by side.
    """
    data = "array<struct<_key:string,_VALUE:string>>"
    value = lambda k: F.get(F.filter("data", lambda d: d["_key"] == k), F.lit(0))["_VALUE"]
    bare = lambda c: F.regexp_replace(c, '^"|"$', "")
    lines = spark.read.text(path)
    by_line = lines.where(~F.col("value").rlike(f"^(?:{GRAPH_LINE})$")).isEmpty()

    def rows(tag: str, columns: str) -> DataFrame:
        schema = f"{columns}, data {data}"
        if not by_line:
            return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
        return lines.where(F.col("value").startswith(f"<{tag} ")).select(F.from_xml("value", schema, {"rowTag": tag}).alias("x")).select("x.*")

    nodes, edges = rows("node", "_id string"), rows("edge", "_source string, _target string")
    n = nodes.select(bare("_id").alias("entity_name"), *(bare(value(f"d{i}")).alias(c) for i, c in enumerate(GRAPH_KEYS["node"])))
    e = edges.select(bare("_source").alias("src_id"), bare("_target").alias("tgt_id"), F.coalesce(value("d3").cast("double"), F.lit(0.0)).alias("weight"), *(bare(value(f"d{i + 3}")).alias(c) for i, c in enumerate(GRAPH_KEYS["edge"]) if c != "weight"))
    return n, e


#: What can't stand in a line of GraphML as it is.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;"))


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The elements of a GraphML file as text rows, each one line, to be written between its head and foot."""

    def esc(c: Column) -> Column:
        out = c.cast("string")
        for char, name in ESCAPES:
            out = F.replace(out, F.lit(char), F.lit(name))
        return out

    data = lambda cols, first: F.concat(*(F.concat(F.lit(f'<data key="d{i + first}">'), F.coalesce(esc(F.col(c)), F.lit("")), F.lit("</data>")) for i, c in enumerate(cols)))
    n = nodes.select(F.concat(F.lit('<node id="'), esc(F.col("entity_name")), F.lit('">'), data(GRAPH_KEYS["node"], 0), F.lit("</node>")).alias("value"))
    e = edges.select(F.concat(F.lit('<edge source="'), esc(F.col("src_id")), F.lit('" target="'), esc(F.col("tgt_id")), F.lit('">'), data(GRAPH_KEYS["edge"], 3), F.lit("</edge>")).alias("value"))
    return n.unionByName(e)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A GraphML document in parts: the text files below path, in the order of their names, are one document with an element a line."""
    keys = "".join(f'<key id="d{i}" for="{kind}" attr.name="{name}" attr.type="{"double" if name == "weight" else "string"}"/>' for i, (kind, name) in enumerate((k, c) for k, names in GRAPH_KEYS.items() for c in names))
    head = f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="undirected">'
    ends = nodes.sparkSession.createDataFrame([(0, head), (2, "</graph></graphml>")], "_o int, value string")
    lines = graph_lines(nodes, edges).select((F.lit(1)).alias("_o"), "value")
    # Node elements sort before edge elements only by their place, so the place is part of the order.
    place = F.when(F.col("value").startswith("<edge"), 1).otherwise(0)
    ends.unionByName(lines).orderBy("_o", place, "value").select("value").write.mode("overwrite").text(path)


def append_pairs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored translation pairs with new ones added, each key combination once, the stored one first."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else new.distinct()  # of equal keys the smallest row
    return old.unionByName(one.join(old.select(*keys), keys, "left_anti"))


def write_matches(pairs: DataFrame, path: str, batch: str) -> None:
    """Matched pairs by language pair and batch; a batch is written once."""
    pairs.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("src_lang", "tgt_lang", "batch").parquet(path)


def read_matches(spark: SparkSession, path: str, languages: tuple[str, str] | None = None, latest: bool = False) -> DataFrame:
    """Stored matches, of one language pair or all, of the last batch or all; filters prune folders."""
    t = spark.read.option("basePath", path).parquet(path)
    if languages:
        t = t.where((F.col("src_lang") == languages[0]) & (F.col("tgt_lang") == languages[1]))
    return t.join(t.agg(F.max("batch").alias("batch")), "batch") if latest else t


def retrieved_rows(chosen: DataFrame) -> DataFrame:
    """(query, ord, id, content): what a run chose for each query, ready to be appended to a table of runs."""
    return chosen.select("query", "ord", "id", "content")


def store_chosen(chosen: DataFrame, path: str) -> None:
    """Keep the chunks (query, ord, id, content) that queries have chosen; those stored for the same queries before are replaced, others stay."""
    rows = retrieved_rows(chosen).withColumn("part", F.md5("query"))
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def read_chosen(spark: SparkSession, path: str, query: str | None = None) -> DataFrame:
    """Stored chunks (query, ord, id, content) of one query, of which only its own folder is read, or of all."""
    rows = spark.read.parquet(path)
    if query is not None:
        rows = rows.where((F.col("part") == F.md5(F.lit(query))) & (F.col("query") == query))
    return rows.drop("part")
