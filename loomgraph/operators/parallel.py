"""Documents in two languages into one graph: translation, matched entities and relations by position, and the links between them."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FIELD_SEP, content_id, doc_id, quoted, strip, summary
from ..scratch import materialize
from . import chunk, extract, flows, merge

ENTITIES = "array<struct<name:string,type:string,description:string>>"
RELATIONS = "array<struct<src:string,tgt:string,description:string,keywords:string>>"


class Model(NamedTuple):
    """A language model's parts. Listings are numbered lines; answers have the form that `extract.matched_entities` and `matched_relations` read.

    `more_entities` and `more_relations` are asked where an answer has another number of lines than the original: they get the original listing,
    the listing of what was found and the text, and answer with the lines that are missing, or with the chosen ones where there are too many.
    """

    translate: Callable[[Column], Column]  # text
    extract: Callable[[DataFrame], DataFrame]  # chunks (id, content): (chunk_id, answer)
    entities: Callable[[Column, Column], Column]  # listing, translated text
    relations: Callable[[Column, Column, Column], Column]  # listing, translated entities' listing, translated text
    more_entities: Callable[[Column, Column, Column], Column] | None = None
    more_relations: Callable[[Column, Column, Column], Column] | None = None


class Inserted(NamedTuple):
    documents: DataFrame  # id, original_id, language, content, content_summary, content_length, chunks_count, status
    chunks: DataFrame  # id, full_doc_id, language, chunk_order_index, tokens, content
    nodes: DataFrame
    edges: DataFrame
    links: DataFrame  # src_id, tgt_id, weight, description, keywords, source_id, original_language, translated_language
    entity_pairs: DataFrame  # doc, ord, original, translated: structs of name, type, description
    relation_pairs: DataFrame  # doc, ord, original, translated: structs of src, tgt, description, keywords


def fitted(found: Column, n: Column, field: str) -> Column:
    """Exactly n records: cut, or filled by copies of the last whose `field` ends in one " (Copy)" more each time; an empty list stays empty."""
    missing = n - F.size(found)
    last = F.element_at(found, -1)
    copies = F.transform(F.sequence(F.lit(1), missing), lambda i: last.withField(field, F.concat(last[field], F.repeat(F.lit(" (Copy)"), i))))
    return F.when((F.size(found) == 0) | (missing == 0), found).when(missing < 0, F.slice(found, F.lit(1), n)).otherwise(F.concat(found, copies))


def _numbered(rows: Column, line: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), line(x))), "\n")


def entity_listing(rows: Column) -> Column:
    return _numbered(rows, lambda x: F.concat(x["name"], F.lit(" (Type: "), x["type"], F.lit("): "), x["description"]))


def relation_listing(rows: Column) -> Column:
    return _numbered(rows, lambda x: F.concat(x["src"], F.lit(" → "), x["tgt"], F.lit(": "), x["description"]))


def _of_documents(rows: DataFrame, keys: list[str], chunks: DataFrame, record: Column, name: str, kind: str) -> DataFrame:
    """(id, name): for each document the records of the graph rows that one of its chunks mentions, by first mention and key."""
    named = rows.select(*keys, F.explode(F.split("source_id", quoted(FIELD_SEP))).alias("_c"))
    first = named.join(chunks.select(F.col("id").alias("_c"), "full_doc_id", "chunk_order_index"), "_c").groupBy("full_doc_id", *keys).agg(F.min("chunk_order_index").alias("_o"))
    each = first.join(rows, keys).select(F.col("full_doc_id").alias("id"), F.struct("_o", *keys, record.alias("_r")).alias("_s"))
    return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("_s")), lambda x: x["_r"]).cast(kind).alias(name))


def _settle(docs: DataFrame, original: str, answer: Column, parse: Callable[[Column], Column], kind: str, more, listing, field: str, name: str, last: bool) -> DataFrame:
    """docs with `name`: the parsed answers, repaired to as many records as the original list has. Each answer is stored before it is read.

    After the last question the translation isn't stored with the answers.
    """
    n = F.size(original)
    none = F.array().cast(kind)
    done = lambda t: t.drop("translated") if last else t
    said = docs.withColumn("_answer", F.when(n > 0, answer))
    found = materialize(done(said) if more is None else said).withColumn(name, F.coalesce(parse(F.col("_answer")).cast(kind), none)).drop("_answer")
    if more is not None:
        extra = more(listing(F.col(original)), listing(F.col(name)), F.col("translated"))
        asked = materialize(done(found.withColumn("_extra", F.when(F.size(name) != n, extra))))
        said = F.coalesce(parse(F.col("_extra")).cast(kind), none)
        found = asked.withColumn(name, F.when(F.size(name) < n, F.concat(F.col(name), said)).when(F.size(name) > n, said).otherwise(F.col(name))).drop("_extra")
    return found.withColumn(name, fitted(F.col(name), n, field))


def insert(
    pairs: DataFrame, model: Model, nodes: DataFrame, edges: DataFrame, types: list[str], languages: tuple[str, str] = ("Vietnamese", "English"),
    size: int = 1200, overlap: int = 100, known: DataFrame | None = None,
) -> Inserted:
    """The graph (nodes, edges) with paired documents (original, translated) in it, and what was stored on the way.

    Originals that are null or whose id is in `known` (id) are left out; of one original with several translations the first text in order counts.
    Where the translation is null or empty the model translates. Chunks of the originals are extracted and merged into the graph; a document's
    entities and relations (by first mention, then name) are matched in the translation by position; counts are repaired by the model, then by cutting
    or copying; types outside of `types` become UNKNOWN. What was matched is merged with the translation's first chunk as its source, weight 1 a
    relation, and each pair of entities becomes a link. A translation without words has no chunk: its document is `failed` and adds no matches.
    """
    source, target = languages
    some = lambda c: F.nullif(strip(F.col(c)), F.lit(""))
    given = pairs.select(strip(F.col("original")).alias("original"), some("translated").alias("translated")).where(F.col("original").isNotNull())
    docs = given.groupBy("original").agg(F.min("translated").alias("translated")).withColumn("id", doc_id(F.col("original")))
    if known is not None:
        docs = docs.join(known.select("id"), "id", "left_anti")
    translated = F.coalesce("translated", strip(model.translate(F.col("original"))), F.lit(""))
    docs = materialize(docs.withColumn("translated", translated).withColumn("translated_id", doc_id(F.col("translated"))))

    side = lambda i, text, language: docs.select(F.col(i).alias("full_doc_id"), F.lit(language).alias("language"), F.col(text).alias("text"))
    texts = side("id", "original", source).unionByName(side("translated_id", "translated", target))
    # Whole chunks are cut again where they are read; only their ids and places are stored.
    whole = chunk.by_tokens(texts, "text", size, overlap).withColumn("id", content_id(F.col("content"), "chunk-"))
    cut = materialize(whole.drop("content"))
    own, other = cut.where(F.col("language") == source), cut.where(F.col("language") == target)

    answers = materialize(model.extract(whole.where(F.col("language") == source).select("id", "content").dropDuplicates(["id"])))
    nodes, edges = (materialize(t) for t in flows.extract_into(answers, nodes, edges))
    bare = lambda c: F.btrim(F.col(c), F.lit('"'))
    entity = F.struct(bare("entity_name").alias("name"), bare("entity_type").alias("type"), F.coalesce("description", F.lit("")).alias("description"))
    relation = F.struct(bare("src_id").alias("src"), bare("tgt_id").alias("tgt"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("keywords", F.lit("")).alias("keywords"))
    mine = _of_documents(nodes, ["entity_name"], own, entity, "entities", ENTITIES)
    joins = _of_documents(edges, ["src_id", "tgt_id"], own, relation, "relations", RELATIONS)
    first = other.where("chunk_order_index = 0").select(F.col("full_doc_id").alias("translated_id"), F.col("id").alias("first_chunk")).distinct()
    lists = docs.select("id", "translated_id").join(first, "translated_id").drop("translated_id").join(mine, "id", "left").join(joins, "id", "left")
    lists = lists.withColumns({"entities": F.coalesce("entities", F.array().cast(ENTITIES)), "relations": F.coalesce("relations", F.array().cast(RELATIONS))})
    lists = lists.join(docs.select("id", "translated"), "id")

    usual = F.array(*(F.lit(t.lower()) for t in types)).cast("array<string>")
    matched = lambda a: F.transform(extract.matched_entities(a), lambda x: x.withField("type", F.when(F.array_contains(usual, F.lower(x["type"])), x["type"]).otherwise(F.lit("UNKNOWN"))))
    asked = model.entities(entity_listing(F.col("entities")), F.col("translated"))
    lists = _settle(lists, "entities", asked, matched, ENTITIES, model.more_entities, entity_listing, "name", "found_entities", False)
    asked = model.relations(relation_listing(F.col("relations")), entity_listing(F.col("found_entities")), F.col("translated"))
    lists = _settle(lists, "relations", asked, extract.matched_relations, RELATIONS, model.more_relations, relation_listing, "description", "found_relations", True)

    def paired(original: str, found: str) -> DataFrame:
        n = F.least(F.size(original), F.size(found))
        both = F.zip_with(F.slice(original, F.lit(1), n), F.slice(found, F.lit(1), n), lambda a, b: F.struct(a.alias("original"), b.alias("translated")))
        return lists.select(F.col("id").alias("doc"), "first_chunk", F.posexplode(both).alias("ord", "p")).select("doc", "first_chunk", F.col("ord").cast("long").alias("ord"), "p.*")

    e, r = paired("entities", "found_entities"), paired("relations", "found_relations")
    name = lambda c: F.concat(F.lit('"'), F.upper(c), F.lit('"'))
    more_nodes = e.select(name("translated.name").alias("entity_name"), name("translated.type").alias("entity_type"), "translated.description", F.col("first_chunk").alias("source_id"), "ord")
    more_edges = r.select(name("translated.src").alias("src_id"), name("translated.tgt").alias("tgt_id"), F.lit(1.0).alias("weight"), "translated.description", "translated.keywords", F.col("first_chunk").alias("source_id"), "ord")
    nodes, edges = flows.merge_into(more_nodes, more_edges, nodes, edges)

    links = e.select(name("original.name").alias("src_id"), name("translated.name").alias("tgt_id")).distinct().withColumns(
        {
            "weight": F.lit(1.0), "description": F.lit(f"Translation equivalent ({source} ↔ {target})"), "keywords": F.lit(f"translation,cross-lingual,{source.lower()},{target.lower()}"),
            "source_id": F.lit("cross_lingual"), "original_language": F.lit(source), "translated_language": F.lit(target),
        }
    )
    counts = cut.groupBy("full_doc_id", "language").agg(F.count_distinct("chunk_order_index").alias("chunks_count"))
    state = lambda i, text, language: docs.select(F.col(i).alias("id"), F.col("id").alias("original_id"), F.lit(language).alias("language"), F.col(text).alias("content"), summary(F.col(text)).alias("content_summary"), F.length(text).alias("content_length"), F.when(F.lit(language == source) | (F.size(F.split("translated", r"\S", 2)) > 1), "processed").otherwise("failed").alias("status"))
    documents = state("id", "original", source).unionByName(state("translated_id", "translated", target).dropDuplicates(["id"]))
    documents = documents.join(counts.withColumnRenamed("full_doc_id", "id"), ["id", "language"], "left").withColumn("chunks_count", F.coalesce("chunks_count", F.lit(0)).cast("long"))
    return Inserted(documents, chunk.with_ids(whole, "full_doc_id"), nodes, edges, links, e.drop("first_chunk"), r.drop("first_chunk"))
