"""Queries by mode over a knowledge graph's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MODES, csv_row, n_words
from ..operators import community, retrieve
from ..operators.tables import within_budget
from ..operators.vectors import top_k


@dataclass(frozen=True)
class Params:
    """What a query may set; values never change after the query has started."""

    mode: str = "hybrid"
    top_k: int = 60
    entity_tokens: int = 4000
    relation_tokens: int = 4000
    text_tokens: int = 4000
    threshold: float = 0.2
    level: int = 2
    report_tokens: int = 16384
    max_communities: int = 512
    min_rating: float = 0.0

    def __post_init__(self) -> None:
        if self.mode not in (*MODES, "community"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.top_k < 1:
            raise ValueError("top_k has to be 1 or more")


@dataclass(frozen=True)
class Graph:
    """nodes: entity_name, entity_type, description, source_ids; edges: src_id, tgt_id, description, keywords, weight, source_ids;
    chunks: id, content, tokens; vectors of entities (entity_name, vector), relations (src_id, tgt_id, vector) and chunks (id, vector);
    communities: level, cluster, occurrence, rating, tokens, report."""

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    entity_vectors: DataFrame
    relation_vectors: DataFrame
    chunk_vectors: DataFrame
    communities: DataFrame | None = None


class Engine:
    """Plans a query's context; nothing runs before the result is read."""

    def __init__(self, graph: Graph, embed: Callable[[list[str]], np.ndarray], count: Callable[[Column], Column] = n_words):
        """count: a text's tokens, as budgets count them (`functions.tokens.counted` for a tokenizer); chunks bring their own numbers."""
        self.graph, self.embed, self.count = graph, embed, count

    def _vector(self, text: str):
        return F.array(*(F.lit(float(x)) for x in self.embed([text])[0]))

    def local(self, keywords: str, p: Params) -> dict[str, DataFrame]:
        """Entities near the keywords; chunks and relations of all of them, the entity list cut last."""
        g = self.graph
        best = top_k(g.entity_vectors, self._vector(keywords), p.top_k, p.threshold, "entity_name").select("entity_name", "ord")
        found = retrieve.local_entities(best, g.nodes, g.edges)
        sources = g.nodes.select("entity_name", F.explode("source_ids").alias("chunk"))
        chunks = retrieve.chunks_of_entities(best, sources, g.edges).join(g.chunks, F.col("chunk") == F.col("id"))
        relations = retrieve.relations_of_entities(best, g.edges)
        return {
            "entities": within_budget(found, [F.col("ord")], self.count(F.col("description")), p.entity_tokens),
            "relations": within_budget(relations, [F.desc("rank"), F.desc("weight"), F.col("ord"), F.col("src_id"), F.col("tgt_id")], self.count(F.col("description")), p.relation_tokens),
            "sources": within_budget(chunks, [F.col("ord"), F.desc("relations"), F.col("id")], F.col("tokens"), p.text_tokens),
        }

    def global_(self, keywords: str, p: Params) -> dict[str, DataFrame]:
        """Relations near the keywords, cut first; entities and chunks of those that are left."""
        g = self.graph
        v = g.relation_vectors.withColumn("pair", F.concat_ws("\0", "src_id", "tgt_id"))
        best = top_k(v, self._vector(keywords), p.top_k, p.threshold, "pair").select("src_id", "tgt_id", "ord")
        relations = retrieve.global_relations(best, g.edges, self.count(F.col("description")), p.relation_tokens)
        entities = retrieve.entities_of_relations(relations, g.nodes, g.edges)
        chunks = retrieve.chunks_of_relations(relations, g.chunks)
        return {
            "entities": within_budget(entities, [F.col("ord")], self.count(F.col("description")), p.entity_tokens),
            "relations": relations,
            "sources": within_budget(chunks, [F.col("ord"), F.col("id")], F.col("tokens"), p.text_tokens),
        }

    def hybrid(self, low: str, high: str, p: Params) -> dict[str, DataFrame]:
        """Both lists, high-level rows first, equal rows once."""
        a, b = self.global_(high, p), self.local(low, p)
        placed = {k: t.withColumn("ord", F.col("pos")) if "pos" in t.columns else t for k, t in a.items()}
        entities = retrieve.combined(placed["entities"], b["entities"], ["entity_name", "entity_type", "description", "rank"]).withColumnRenamed("id", "number")
        relations = retrieve.combined(placed["relations"], b["relations"], ["src_id", "tgt_id", "description", "keywords", "weight", "rank"]).withColumnRenamed("id", "number")
        high_chunks, low_chunks = (t.withColumnRenamed("id", "chunk_id") for t in (placed["sources"], b["sources"]))
        return {"entities": entities, "relations": relations, "sources": retrieve.combined(high_chunks, low_chunks, ["chunk_id", "content"])}

    def naive(self, text: str, p: Params, k: int | None = None) -> DataFrame:
        g = self.graph
        best = top_k(g.chunk_vectors, self._vector(text), k or p.top_k, p.threshold).select("id", "ord", "score")
        return retrieve.naive(best, g.chunks, p.text_tokens)

    def mix(self, text: str, low: str, high: str, p: Params) -> dict[str, DataFrame]:
        """The hybrid context and the naive one of at most ten chunks."""
        return self.hybrid(low, high, p) | {"vectors": self.naive(text, p, min(10, p.top_k))}

    def community(self, p: Params) -> DataFrame:
        """Reports that a global question is put to."""
        return community.global_select(self.graph.communities, p.level, p.max_communities, p.min_rating)

    def query(self, text: str, low: list[str], high: list[str], p: Params | None = None) -> dict[str, DataFrame]:
        """The context tables of a query with its low- and high-level keywords; {} if keywords are needed and missing."""
        p = p or Params()
        if p.mode == "naive":
            return {"vectors": self.naive(text, p)}
        if p.mode == "community":
            return {"reports": self.community(p)}
        if p.mode == "bypass" or not (low or high):
            return {}
        mode = "global" if not low and p.mode in ("local", "hybrid") else "local" if not high and p.mode in ("global", "hybrid") else p.mode
        lo, hi = ", ".join(low), ", ".join(high)
        return {"local": lambda: self.local(lo, p), "global": lambda: self.global_(hi, p), "hybrid": lambda: self.hybrid(lo, hi, p), "mix": lambda: self.mix(text, lo, hi, p)}[mode]()

    @staticmethod
    def render(rows: DataFrame, columns: list[str], order: str = "ord") -> DataFrame:
        """One row: the rows as quoted CSV lines in order, under a header. For a context within its budget."""
        line = csv_row(*(F.col(c) for c in columns))
        lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x.line)
        head = F.lit(",".join(f'"{c}"' for c in columns))
        return rows.groupBy().agg(F.array_join(F.concat(F.array(head), lines), "\n").alias("context"))
