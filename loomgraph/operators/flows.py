"""Flows of several operators around a model: extraction with follow-up questions, reports by level, parallel documents, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FIELD_SEP, content_id, doc_id, n_words, quoted, strip
from . import cache, community, extract, merge, metrics, tables
from ..scratch import materialize

Model = Callable[[str, list[dict[str, str]]], str]


def ask(chunks: DataFrame, model: Model, prompt: Callable[[str], str], more: str, is_more: str, rounds: int = 1, known: DataFrame | None = None) -> DataFrame:
    """(chunk_id, answer) of an extraction model for chunks (id, content), with up to `rounds` follow-up questions in one history.

    After each follow-up but the last the model is asked whether there is more and goes on at "yes". Chunks that `known` (chunk_id)
    answers aren't asked again, so a rerun costs nothing for finished chunks.
    """
    todo = chunks if known is None else chunks.join(known.select(F.col("chunk_id").alias("id")), "id", "left_anti")

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            out = []
            for text in b["content"]:
                history: list[dict[str, str]] = []

                def say(question: str, history: list[dict[str, str]] = history) -> str:
                    answer = model(question, history)
                    history += [{"role": "user", "content": question}, {"role": "assistant", "content": answer}]
                    return answer

                answer = say(prompt(text))
                for i in range(rounds):
                    answer += say(more)
                    if i < rounds - 1 and model(is_more, history).strip().strip("\"'").lower() != "yes":
                        break
                out.append(answer)
            yield pd.DataFrame({"chunk_id": b["id"], "answer": out})

    return todo.select("id", "content").mapInPandas(run, "chunk_id string, answer string")


def extract_graph(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of extraction answers (chunk_id, answer), endpoints without a record included."""
    recs = extract.records(answers)
    found = extract.entities(recs)
    edges = merge.edges(extract.relations(recs))
    nodes = merge.nodes(found, ["source_id", "ord"])
    return nodes.unionByName(merge.missing_endpoints(nodes, edges)), edges


def _sets(new: DataFrame, old: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The fields' values by key, new ones and those that old rows hold joined, as sets joined again. All fields of a new row go through one shuffle."""
    value = lambda c: F.nullif(c, F.lit(""))
    rows = new.select(*keys, *(value(F.col(f)).alias(f) for f in fields))
    for f in fields:
        held = F.explode(F.split(F.col(f), quoted(FIELD_SEP)))
        rows = rows.unionByName(old.select(*keys, held.alias(f)).select(*keys, value(F.col(f)).alias(f)), allowMissingColumns=True)
    return rows.where(F.coalesce(*fields).isNotNull()).groupBy(*keys).agg(*(merge.joined(F.collect_set(f)).alias(f) for f in fields))


def extract_into(answers: DataFrame, nodes: DataFrame, edges: DataFrame, tokens: Column | None = None, summarise: Column | None = None, least: int = 500) -> tuple[DataFrame, DataFrame]:
    """The graph with an extraction's answers (chunk_id, answer) merged into it.

    Types are voted on by all new records and one vote of the stored node, which loses ties; descriptions and sources are united, weights
    added; endpoints that neither side describes become nodes. With `summarise`, descriptions of `least` tokens or more go through it.
    Answers are taken apart once; their records are a table in the shared folder.
    """
    rows = materialize(extract.said(answers))
    return merge_into(extract.said_entities(rows), extract.said_relations(rows), nodes, edges, tokens, summarise, least)


def merge_into(found: DataFrame, links: DataFrame, nodes: DataFrame, edges: DataFrame, tokens: Column | None = None, summarise: Column | None = None, least: int = 500) -> tuple[DataFrame, DataFrame]:
    """The graph with entity and relation records merged into it, by the rules of `extract_into`."""
    links = extract.undirected(links)
    votes = found.select("entity_name", "entity_type", F.lit(0).alias("stored"), "source_id", "ord")
    votes = votes.unionByName(nodes.select("entity_name", "entity_type", F.lit(1).alias("stored"), F.lit("").alias("source_id"), F.lit(0).cast("long").alias("ord")))
    kind = merge.mode_first_seen(votes, "entity_name", "entity_type", ["stored", "source_id", "ord"])
    n = kind.join(_sets(found, nodes, ["entity_name"], ["description", "source_id"]), "entity_name", "left")
    old = extract.undirected(edges)
    pair = ["src_id", "tgt_id"]
    weight = lambda new, old: new.select(*pair, "weight").unionByName(old.select(*pair, "weight")).groupBy(*pair).agg(F.sum("weight").alias("weight"))
    e = weight(links, old).join(_sets(links, old, pair, ["description", "keywords", "source_id"]), pair, "left")
    few = merge.undescribed(votes.select("entity_name").distinct(), links, old)
    ends = weight(*few).join(_sets(*few, pair, ["description", "source_id"]), pair, "left")
    n = n.unionByName(merge.missing_endpoints(n, ends))
    if summarise is not None:
        n, e = (merge.summarised(t, tokens, summarise, least) for t in (n, e))
    return n, e


def custom_chunks(text: str, pieces: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A document given with its chunks (ord, content): its row, and those of its chunks that aren't stored yet."""
    spark = pieces.sparkSession
    doc = spark.createDataFrame([(text,)], "content string").select(strip(F.col("content")).alias("content")).select(doc_id(F.col("content")).alias("id"), "content")
    own = doc.first()["id"]
    c = pieces.select(strip(F.col("content")).alias("content"), F.col("ord").cast("int").alias("chunk_order_index")).withColumns({"id": content_id(F.col("content"), "chunk-"), "full_doc_id": F.lit(own)})
    c = tables.first_seen(c, ["id"], "chunk_order_index")
    return doc, c if known is None else tables.missing_keys(c, known)


def in_batches(rows: DataFrame, size: int, key: str = "id") -> DataFrame:
    """rows with `batch`: about `size` rows each, by a hash of the key, so that numbering needs no single task."""
    if size < 1:
        raise ValueError("a batch holds one row at least")
    n = max(1, -(-rows.count() // size))
    return rows.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def report_levels(clusters: DataFrame, nodes: DataFrame, edges: DataFrame, write: Callable[[DataFrame], DataFrame], budget: int, occurrence: DataFrame | None = None, count: Callable[[Column], Column] = n_words, force: bool = False) -> DataFrame:
    """(level, cluster, report) for all communities, deepest level first: `write` gets one level's description rows and returns its reports.

    With `occurrence` (level, cluster, occurrence), a community that doesn't fit the budget is described by the reports of its sub-communities, which
    the deeper levels have left, as far as they go; `count` gives a report's tokens. Levels depend on each other, so the
    loop over them is the driver's; each level's communities are written side by side.
    """
    out = None
    subs = None if occurrence is None else materialize(community.sub_clusters(clusters, any_deeper=True))
    for level in sorted((r["level"] for r in clusters.select("level").distinct().collect()), reverse=True):
        at = F.col("level") == level
        if out is None or subs is None:
            rows = community.describe(clusters.where(at), nodes, edges, budget)
        else:
            known = out.join(occurrence, ["level", "cluster"]).withColumn("tokens", count(F.col("report")))
            rows = community.describe_with_subs(clusters.where(F.col("level") >= level), nodes, edges, subs.where(at), known, budget, force, [level])
        made = materialize(write(rows))
        out = made if out is None else out.unionByName(made)
    return out


def map_reduce_points(points: DataFrame, budget: int) -> DataFrame:
    """Points (answer, score, tokens) of all groups' answers that score above 0, best first, within the budget."""
    order = [F.desc("score"), F.col("answer")]
    return tables.within_budget(points.where("score > 0"), order, F.col("tokens"), budget)


def languages_of_entities(edges: DataFrame) -> DataFrame:
    """(entity_name, language) from the edges (src_id, tgt_id, original_language, translated_language) that link translations."""
    a = edges.select(F.col("src_id").alias("entity_name"), F.col("original_language").alias("language"))
    both = a.unionByName(edges.select(F.col("tgt_id").alias("entity_name"), F.col("translated_language").alias("language")))
    return both.where(F.col("language").isNotNull()).groupBy("entity_name").agg(F.min("language").alias("language"))


def unlinked(nodes: DataFrame, translations: DataFrame) -> DataFrame:
    """Nodes without a translation edge (src_id, tgt_id)."""
    linked = translations.select(F.explode(F.array("src_id", "tgt_id")).alias("entity_name"))
    return nodes.join(linked, "entity_name", "left_anti")


def named_in(answer: Column, names: Column) -> Column:
    """The first of the names that a model's answer holds, in capitals or not; null for "NO MATCH"."""
    upper = F.upper(answer)
    hit = F.filter(names, lambda n: upper.contains(cache.bare(n)))
    return F.when(~upper.contains("NO MATCH"), F.get(hit, F.lit(0)))


def parallel_pairs(answers: DataFrame) -> DataFrame:
    """Translation edges by position of two matched lists: answers (doc, original, translated) in the numbered-line form.

    The second list is cut or padded to the first one's length.
    """
    name = lambda c: F.transform(extract.matched_entities(F.col(c)), lambda x: x["name"])
    both = answers.select("doc", name("original").alias("a"), name("translated").alias("b"))
    pairs = both.select("doc", F.posexplode(extract.cross_lingual_edges(F.col("a"), extract.fit_pairs(F.col("b"), F.size("a")))).alias("ord", "e"))
    return pairs.select("doc", "ord", "e.src_id", "e.tgt_id")


def evaluate(predictions: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """(k, map, mrr, recall, mean): predictions (query_id, ord, context_id) against truth (query_id, actual); queries without predictions count."""
    ranked = predictions.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "context_id"))), lambda x: x.context_id).alias("predicted"))
    none = F.array().cast(ranked.schema["predicted"].dataType)
    rows = truth.join(ranked, "query_id", "left").withColumn("predicted", F.coalesce("predicted", none))
    out = None
    for k in ks:
        m = metrics.means(rows, k).select(F.lit(k).alias("k"), "map", "mrr", "recall", "mean")
        out = m if out is None else out.unionByName(m)
    return out
