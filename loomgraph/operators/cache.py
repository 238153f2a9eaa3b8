"""Answer cache and links between languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dequantize
from .similar import best_above
from .vectors import best_matches


def exact(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (mode, args_hash) with the cached answer or null."""
    return requests.join(cache.select("mode", "args_hash", "answer"), ["mode", "args_hash"], "left")


def semantic(requests: DataFrame, cache: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Each request's most similar cached answer of its mode and type beyond the threshold, ties to the smaller hash.

    requests: request_id, mode, cache_type, vector; cache: mode, cache_type, args_hash, answer, codes, low, high (quantised vectors).
    """
    by = ["mode", "cache_type"]
    held = cache.select(*by, F.col("args_hash").alias("key"), dequantize(F.col("codes"), F.col("low"), F.col("high")).alias("vector"))
    near = best_above(requests.select(*by, F.col("request_id").alias("key"), "vector"), held, threshold, by, strict=True)
    near = near.select(*by, F.col("src").alias("request_id"), F.col("tgt").alias("args_hash"), "score")
    return near.join(cache.select(*by, "args_hash", "answer"), [*by, "args_hash"]).select("request_id", "args_hash", "answer", "score")


def lookup(requests: DataFrame, cache: DataFrame, threshold: float = 0.95) -> DataFrame:
    """The exact answer if there is one, else the semantic one: (request_id, answer)."""
    hit = exact(requests, cache).select("request_id", F.col("answer").alias("_exact"))
    near = semantic(requests, cache, threshold).select("request_id", F.col("answer").alias("_near"))
    return hit.join(near, "request_id", "left").select("request_id", F.coalesce("_exact", "_near").alias("answer"))


def save(cache: DataFrame, new: DataFrame) -> DataFrame:
    """cache with new entries in place of those of equal mode and hash."""
    return cache.join(new, ["mode", "args_hash"], "left_anti").unionByName(new)


def bare(name: Column) -> Column:
    """A name for comparison: upper-cased, without outer quotes."""
    return F.trim(F.translate(F.upper(F.replace(name, F.lit("ß"), F.lit("SS"))), '"', ""))


def match_languages(source: DataFrame, target: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(src, tgt, score, method): equal names first, then the nearest vector of those without one. Rows: key, name, vector."""
    s, t = source.withColumn("_n", bare(F.col("name"))), target.withColumn("_n", bare(F.col("name")))
    first = t.groupBy("_n").agg(F.min("key").alias("tgt"))
    same = s.join(first, "_n").select(F.col("key").alias("src"), "tgt", F.lit(1.0).alias("score"), F.lit("exact").alias("method"))
    rest = source.join(same.select(F.col("src").alias("key")), "key", "left_anti")
    near = best_matches(rest.select("key", "vector"), target.select("key", "vector"), threshold).withColumn("method", F.lit("embedding"))
    return same.unionByName(near)


def translation_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """New edges for matched pairs (src, tgt, score, method, src_lang, tgt_lang) that aren't linked yet."""
    e = pairs.select(F.least("src", "tgt").alias("src_id"), F.greatest("src", "tgt").alias("tgt_id"), F.col("score").alias("confidence"), "method", F.concat_ws("|", "src_lang", "tgt_lang").alias("languages"))
    known = edges.select(F.least("src_id", "tgt_id").alias("src_id"), F.greatest("src_id", "tgt_id").alias("tgt_id"))
    return e.join(known, ["src_id", "tgt_id"], "left_anti")


def mark_translated(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """nodes with has_translations and translated_languages (joined by |, sorted)."""
    a = pairs.select(F.col("src").alias("entity_name"), F.col("tgt_lang").alias("_l")).unionByName(pairs.select(F.col("tgt").alias("entity_name"), F.col("src_lang").alias("_l")))
    langs = a.groupBy("entity_name").agg(F.array_join(F.array_sort(F.collect_set("_l")), "|").alias("translated_languages"))
    return nodes.join(langs, "entity_name", "left").withColumn("has_translations", F.col("translated_languages").isNotNull())


def turns(messages: DataFrame, n: int, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, history): the last n pairs of user and assistant messages, the user's first, as `role: text` lines.

    Assistant messages that hold only keyword JSON and other roles' messages are left out; an odd last message has no pair.
    """
    keep = F.col(role).isin("user", "assistant") & ~((F.col(role) == "assistant") & F.col(text).contains("high_level_keywords"))
    w = Window.partitionBy(conv).orderBy(turn)
    m = messages.where(keep).withColumn("_n", F.row_number().over(w) - 1).withColumn("_pair", F.floor(F.col("_n") / 2))
    by_pair = Window.partitionBy(conv, "_pair")
    m = m.withColumn("_full", F.count("*").over(by_pair) == 2).where("_full")
    m = m.withColumn("_last", F.max("_pair").over(Window.partitionBy(conv))).where(F.col("_pair") > F.col("_last") - n)
    line = F.struct("_pair", (F.col(role) != "user").alias("late"), "_n", F.concat(F.col(role), F.lit(": "), F.coalesce(F.col(text), F.lit(""))).alias("line"))
    return m.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.line), "\n").alias("history"))
