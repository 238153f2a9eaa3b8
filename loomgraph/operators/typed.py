"""Typed extraction: a model's JSON answers as checked records, corrected by turns of critique and refinement that are stored as they end."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, json_body, let
from ..scratch import materialize, stored, tidy
from . import extract, merge

ENTITY = "struct<entity_name:string,entity_type:string,description:string,importance_score:double>"
RELATIONSHIP = "struct<src_id:string,tgt_id:string,description:string,weight:double,order:int>"
FOUND = f"struct<entities:array<{ENTITY}>,relationships:array<{RELATIONSHIP}>>"
TURN = f"id string, attempt int, critique string, found {FOUND}"


class Model(NamedTuple):
    """Columns of a model's answers; `attempt` counts from 0 up when an answer couldn't be used."""

    extract: Callable[[Column, Column], Column]  # content, attempt: JSON
    critique: Callable[[Column, Column, Column], Column]  # content, current JSON, attempt: text
    refine: Callable[[Column, Column, Column, Column], Column]  # content, current JSON, critique, attempt: JSON


def parsed(answer: Column) -> Column:
    """The records of the JSON object in an answer, {"entities": [...], "relationships": [...]}.

    Null unless both lists are there and every record has all its fields: scores and weights as numbers from 0 to 1, an order of 1, 2 or 3.
    """
    there = lambda x, *fields: [x[f].isNotNull() for f in fields]

    def all_of(conditions: list[Column]) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & c
        return F.coalesce(out, F.lit(False))

    def fit(f: Column) -> Column:
        e = F.forall(f["entities"], lambda x: all_of([*there(x, "entity_name", "entity_type", "description"), x["importance_score"].between(0, 1)]))
        r = F.forall(f["relationships"], lambda x: all_of([*there(x, "src_id", "tgt_id", "description"), x["weight"].between(0, 1), x["order"].between(1, 3)]))
        return F.when(F.coalesce(e & r, F.lit(False)), f)

    return let(F.from_json(json_body(answer), FOUND), fit)


def _turn(ids: DataFrame, todo: DataFrame, path: str, ask: Callable[[DataFrame, Column], DataFrame], retries: int, batches: int) -> DataFrame:
    """(id, found) of a turn for the ids, whose rows `todo` holds; found null where no attempt gave records. What the path holds isn't asked again.

    Each batch of each attempt is one job, whose rows are stored when it ends: that is what a lost driver can lose. What is left for an attempt is found by the ids
    alone, without their contents.
    """
    spark = todo.sparkSession
    for attempt in range(retries + 1):
        had, left = stored(spark, path, TURN), todo
        if not had.isEmpty():
            settled = had.where(F.col("found").isNotNull() | (F.col("attempt") >= attempt)).select("id")
            open_ = materialize(ids.join(settled, "id", "left_anti"))
            if open_.isEmpty():
                continue
            left = todo.join(open_, "id", "left_semi")
        for b in range(batches):
            part = left.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == b) if batches > 1 else left
            with tidy(spark):
                ask(part, F.lit(attempt)).write.mode("append").option("compression", "zstd").parquet(path)
    last = stored(spark, path, TURN).groupBy("id").agg(F.max_by("found", "attempt").alias("found"))
    return last.join(ids, "id", "left_semi")


def extracted(chunks: DataFrame, model: Model, folder: str, turns: int = 1, retries: int = 3, batches: int = 1) -> DataFrame:
    """(id, found) for chunks (id, content): extraction, then `turns` of critique and refinement, each of which replaces the records.

    Answers that can't be used are asked for again, up to `retries` times. An extraction without a usable answer counts as no records, a
    refinement without one leaves the records as they are. `folder` keeps every turn: a rerun asks for chunks and attempts that it lacks
    alone, so more chunks or more turns cost only themselves. Chunks without an id are left out, repeated ids are asked once; content that
    is null goes to the model as an empty text.
    """
    if turns < 0 or retries < 0 or batches < 1:
        raise ValueError("turns and retries can't be negative, and there is one batch at least")
    c = chunks.select("id", F.coalesce("content", F.lit("")).alias("content")).where(F.col("id").isNotNull()).dropDuplicates(["id"])
    c = materialize(c)  # each turn and attempt reads the chunks, which may be the result of a long plan
    ids = c.select("id")
    nothing = F.from_json(F.lit('{"entities": [], "relationships": []}'), FOUND)

    def first(todo: DataFrame, attempt: Column) -> DataFrame:
        return todo.select("id", attempt.alias("attempt"), F.lit(None).cast("string").alias("critique"), parsed(model.extract(F.col("content"), attempt)).alias("found"))

    def again(todo: DataFrame, attempt: Column) -> DataFrame:
        said = todo.withColumn("critique", model.critique(F.col("content"), F.col("current"), attempt))
        answer = model.refine(F.col("content"), F.col("current"), F.col("critique"), attempt)
        return said.select("id", attempt.alias("attempt"), "critique", parsed(answer).alias("found"))

    now = _turn(ids, c, f"{folder}/extract", first, retries, batches).select("id", F.coalesce("found", nothing).alias("found"))
    for t in range(turns):
        todo = c.join(now.select("id", F.to_json("found").alias("current")), "id")
        new = _turn(ids, todo, f"{folder}/refine-{t}", again, retries, batches)
        now = now.join(new.withColumnRenamed("found", "_new"), "id").select("id", F.coalesce("_new", "found").alias("found"))
    return now


def records(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity and relationship records of (id, found), normalised: names and types cleaned and upper-cased, descriptions cleaned."""
    each = lambda kind: found.select(F.col("id").alias("source_id"), F.posexplode(f"found.{kind}").alias("ord", "_r")).select("source_id", F.col("ord").cast("long").alias("ord"), "_r.*")
    links = each("relationships").withColumns({"src_id": clean(F.upper("src_id")), "tgt_id": clean(F.upper("tgt_id")), "description": clean(F.col("description"))})
    return extract.typed(each("entities")), links


def graph_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and directed edges of (id, found): weights summed, the smallest order, endpoints without a record included."""
    entities, links = records(materialize(found))  # nodes and edges read it several times, and it is the result of a long plan
    edges = merge.edges(links.withColumn("keywords", F.lit("")), directed=True)
    nodes = merge.nodes(entities, ["source_id", "ord"])
    return nodes.unionByName(merge.missing_endpoints(nodes, edges)), edges


def write_examples(chunks: DataFrame, found: DataFrame, path: str) -> None:
    """Training examples as lines of JSON: content, entities and relationships of the chunks that have one of each at least."""
    both = chunks.select("id", "content").join(found.select("id", "found.entities", "found.relationships"), "id")
    with tidy(chunks.sparkSession):
        extract.training_examples(both).drop("id").write.option("compression", "gzip").json(path)
