"""From extraction answers to entity and relation records, and repairs of paired lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import COMPLETION_DELIMITER, RECORD_DELIMITER, TUPLE_DELIMITER, clean, split_markers, weight


def records(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """One row for each parenthesised record of an answer: answers' columns but the text, ord, attrs ARRAY."""
    parts = split_markers(F.col(answer), RECORD_DELIMITER, COMPLETION_DELIMITER)
    # Split inside the exploded array: what is exploded is computed once, whatever filters follow.
    attrs = F.transform(parts, lambda r: split_markers(F.regexp_extract(r, r"\(([^\n]*)\)", 1), TUPLE_DELIMITER))
    keep = [c for c in answers.columns if c != answer]
    out = answers.select(*keep, F.posexplode(attrs).alias("ord", "attrs"))
    return out.where(F.size("attrs") > 0).withColumn("ord", F.col("ord").cast("long"))


def entities(recs: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """Records marked "entity" (quotes included) of four attributes or more and with a name."""
    a = F.col("attrs")
    ok = recs.where((F.size(a) >= 4) & (F.get(a, F.lit(0)) == '"entity"'))
    out = ok.select(
        clean(F.upper(a[1])).alias("entity_name"), clean(F.upper(a[2])).alias("entity_type"), clean(a[3]).alias("description"), F.col(chunk).alias("source_id"), "ord",
    )
    return out.where(F.trim("entity_name") != "")


def relations(recs: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """Records marked "relationship" of five attributes or more; the weight is the last one if it is a number, else 1."""
    a = F.col("attrs")
    ok = recs.where((F.size(a) >= 5) & (F.get(a, F.lit(0)) == '"relationship"'))
    return ok.select(
        clean(F.upper(a[1])).alias("src_id"), clean(F.upper(a[2])).alias("tgt_id"), clean(a[3]).alias("description"), clean(a[4]).alias("keywords"),
        weight(F.element_at(a, -1)).alias("weight"), F.col(chunk).alias("source_id"), "ord",
    )


def said(answers: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """Entity and relation records of answers in one table, so that answers are taken apart once: what `said_entities` and `said_relations` take from it is what `entities` and `relations` give.

    linked: false for an entity (a: its name, b: its type), true for a relation (a, b: its ends, keywords, weight).
    """
    a = F.col("attrs")
    marker = F.get(a, F.lit(0))
    ok = records(answers).where(((F.size(a) >= 4) & (marker == '"entity"')) | ((F.size(a) >= 5) & (marker == '"relationship"')))
    return ok.select(
        (marker == '"relationship"').alias("linked"), clean(F.upper(a[1])).alias("a"), clean(F.upper(a[2])).alias("b"), clean(a[3]).alias("description"),
        F.when(marker == '"relationship"', clean(a[4])).alias("keywords"), F.when(marker == '"relationship"', weight(F.element_at(a, -1))).alias("weight"), F.col(chunk).alias("source_id"), "ord",
    )


def said_entities(rows: DataFrame) -> DataFrame:
    return rows.where("NOT linked AND trim(a) <> ''").select(F.col("a").alias("entity_name"), F.col("b").alias("entity_type"), "description", "source_id", "ord")


def said_relations(rows: DataFrame) -> DataFrame:
    return rows.where("linked").select(F.col("a").alias("src_id"), F.col("b").alias("tgt_id"), "description", "keywords", "weight", "source_id", "ord")


def undirected(edges: DataFrame) -> DataFrame:
    """Edges with src_id <= tgt_id."""
    return edges.withColumns({"src_id": F.least("src_id", "tgt_id"), "tgt_id": F.greatest("src_id", "tgt_id")})


def typed(entities_: DataFrame) -> DataFrame:
    """Typed records normalised: names cleaned and upper-cased, scores as numbers."""
    return entities_.withColumns({"entity_name": clean(F.upper("entity_name")), "entity_type": clean(F.upper("entity_type")), "description": clean("description"), "importance_score": F.col("importance_score").cast("double")})


def training_examples(chunks: DataFrame) -> DataFrame:
    """Chunks with an entity and a relation at least."""
    return chunks.where((F.size("entities") > 0) & (F.size("relationships") > 0))


def matched_entities(answer: Column) -> Column:
    """ARRAY<STRUCT<name, type, description>> of lines like `1. Entity: x | Type: y | Description: z`."""
    lines = F.filter(F.split(answer, "\n"), lambda x: x.contains("Entity:") & x.contains("|"))
    part = lambda x, label: F.trim(F.regexp_extract(x, label + r":\s*([^|]*)", 1))
    return F.transform(lines, lambda x: F.struct(part(x, "Entity").alias("name"), part(x, "Type").alias("type"), part(x, "Description").alias("description")))


def matched_relations(answer: Column) -> Column:
    """ARRAY<STRUCT<src, tgt, description, keywords>> of lines like `1. a → b | Description: d | Keywords: k`."""
    lines = F.filter(F.split(answer, "\n"), lambda x: x.contains("→"))
    head = lambda x: F.regexp_replace(F.get(F.split(x, r"\|"), F.lit(0)), r"^\s*\d+\.\s*", "")
    side = lambda x, i: F.trim(F.get(F.split(head(x), "→"), F.lit(i)))
    part = lambda x, label: F.trim(F.regexp_extract(x, label + r":\s*([^|]*)", 1))
    return F.transform(lines, lambda x: F.struct(side(x, 0).alias("src"), side(x, 1).alias("tgt"), part(x, "Description").alias("description"), part(x, "Keywords").alias("keywords")))


def fit_pairs(names: Column, n: Column) -> Column:
    """Exactly n names: cut, or filled by the last one with one " (Copy)" more each time; an empty list stays empty."""
    missing = n - F.size(names)
    copies = F.transform(F.sequence(F.lit(1), missing), lambda i: F.concat(F.element_at(names, -1), F.repeat(F.lit(" (Copy)"), i)))
    return F.when((F.size(names) == 0) | (missing == 0), names).when(missing < 0, F.slice(names, F.lit(1), n)).otherwise(F.concat(names, copies))


def cross_lingual_edges(a: Column, b: Column) -> Column:
    """Pairs of names by position, as many as the shorter list has."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n > 0, F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.alias("src_id"), y.alias("tgt_id")))).otherwise(F.array().cast("array<struct<src_id:string,tgt_id:string>>"))


def first_of_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key combination; rows without a full key stay."""
    full = F.lit(True)
    for k in keys:
        full = full & F.col(k).isNotNull() & (F.col(k) != "")
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where(~full | (F.col("_n") == 1)).drop("_n")


def of_document(rows: DataFrame, chunks: DataFrame, doc: str) -> DataFrame:
    """Entities or relations (source_ids ARRAY) that one of the document's chunks mentions."""
    own = chunks.where(F.col("full_doc_id") == doc).select(F.col("id").alias("_c"))
    return rows.withColumn("_c", F.explode("source_ids")).join(own, "_c", "left_semi").drop("_c").distinct()
