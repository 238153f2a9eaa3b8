"""Incremental ingest: new documents become chunks once, whatever arrives twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import doc_id, strip, summary
from ..operators.chunk import by_tokens, with_ids
from ..scratch import discard, materialize
from ..sources.files import arriving, extract_text

STATUS = "id string, content_summary string, content_length int, status string, chunks_count long, error string"
ANSWERS = "full_doc_id string, chunk_id string, answer string"


def enqueue(docs: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Distinct stripped texts that aren't known yet, as pending documents: id, content, content_summary, content_length, status."""
    c = docs.select(strip(F.col(text)).alias("content")).where(F.col("content").isNotNull()).dropDuplicates(["content"])
    out = c.select(doc_id(F.col("content")).alias("id"), "content", summary(F.col("content")).alias("content_summary"), F.length("content").alias("content_length"), F.lit("pending").alias("status"))
    return out if known is None else out.join(known.select("id"), "id", "left_anti")


def process(pending: DataFrame, size: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Chunks of pending documents, and the documents' new status rows."""
    cut = by_tokens(pending.select(F.col("id").alias("full_doc_id"), F.col("content").alias("text")), "text", size, overlap)
    n = cut.groupBy("full_doc_id").agg(F.count("*").alias("chunks_count"))
    status = pending.join(n, pending.id == n.full_doc_id, "left").select("id", "content_summary", "content_length", F.lit("processed").alias("status"), F.coalesce("chunks_count", F.lit(0)).cast("long").alias("chunks_count"))
    return with_ids(cut, "full_doc_id"), status


def to_resume(status: DataFrame) -> DataFrame:
    """Documents that a run has left unfinished."""
    return status.where(F.col("status").isin("pending", "processing", "failed"))


def answered(chunks: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """(full_doc_id, chunk_id, answer, error) of a model for chunks (id, full_doc_id, content); an error of one chunk stops no other."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            answers, errors = [], []
            for text in b["content"]:
                try:
                    answers.append(ask(text))
                    errors.append(None)
                except Exception as e:  # whatever a model raises is the document's error, kept in its status
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"full_doc_id": b["full_doc_id"], "chunk_id": b["id"], "answer": answers, "error": errors})

    return chunks.select("id", "full_doc_id", "content").mapInPandas(run, ANSWERS + ", error string")


def _ingest(pending: DataFrame, folder: str, number: int, size: int, overlap: int, ask: Callable[[str], str] | None, also: DataFrame | None = None) -> None:
    """Write one batch's documents, chunks, answers and status, that of `also` with it. A document of which a chunk fails leaves only its text and its status."""
    batch = f"batch={number}"
    pending.write.mode("overwrite").parquet(f"{folder}/docs/{batch}")
    pending = pending.sparkSession.read.schema(pending.schema).parquet(f"{folder}/docs/{batch}")
    chunks, status = process(pending, size, overlap)
    if ask is None:
        status = status.withColumn("error", F.lit(None).cast("string"))
    else:
        said = materialize(answered(chunks, ask))  # the model is asked once
        failed = said.where(F.col("error").isNotNull()).groupBy(F.col("full_doc_id").alias("id")).agg(F.min("error").alias("error"))
        status = status.join(failed, "id", "left").withColumn("status", F.when(F.col("error").isNull(), F.col("status")).otherwise("failed"))
        bad = failed.select(F.col("id").alias("full_doc_id"))
        chunks = chunks.join(bad, "full_doc_id", "left_anti")
        said.join(bad, "full_doc_id", "left_anti").drop("error").write.mode("overwrite").parquet(f"{folder}/answers/{batch}")
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks/{batch}")
    (status if also is None else status.unionByName(also)).write.mode("overwrite").parquet(f"{folder}/status/{batch}")
    if ask is not None:
        discard(said)


def latest_status(rows: DataFrame) -> DataFrame:
    """One status row for each document of several runs: a processed one if there is any."""
    done = (F.col("status") == "processed").cast("int")
    best = F.max_by(F.struct("content_summary", "content_length", "status", "chunks_count", "error"), F.struct(done, F.col("status"), F.col("error"))).alias("r")
    return rows.groupBy("id").agg(best).select("id", "r.*")


def ingest_stream(spark: SparkSession, stream: DataFrame, folder: str, size: int = 200, overlap: int = 20, text: str = "text", ask: Callable[[str], str] | None = None):
    """Start a query that appends each micro-batch's new documents and chunks, and a model's answers to them, to Parquet tables below `folder`.

    A batch writes its own subfolder, so a batch that is run again after a failure replaces what it had written: all
    tables are exactly-once without a lock. A document of which a chunk fails is `failed` with its error, has no chunks and answers, and
    is taken again when it arrives again or by `retry_failed`.
    """

    def batch(rows: DataFrame, number: int) -> None:
        done = _read(spark, f"{folder}/status", STATUS, number).where("status = 'processed'")
        _ingest(enqueue(rows, done, text), folder, number, size, overlap, ask)

    return stream.writeStream.option("checkpointLocation", f"{folder}/progress").foreachBatch(batch)


FILES = "path string, modified timestamp, id string, error string"


def scan_stream(spark: SparkSession, folder: str, out: str, readers: dict[str, Callable[[bytes], str]] | None = None, at_once: int = 100, size: int = 200, overlap: int = 20, ask: Callable[[str], str] | None = None):
    """A query, to be started, that takes in the supported files of a folder, those that come while it runs too, as `ingest_stream` takes texts.

    It knows the files that it has taken over a restart, and takes at most `at_once` in a micro-batch. `out`/files says for each file which document it is
    (id), or why it is none: a file that can't be read, or holds no text, is `failed` in the status table too, under an id made of its path; no other file waits for it.
    """

    def batch(files: DataFrame, number: int) -> None:
        read = materialize(extract_text(files.select("path", "content"), readers))  # each file is read once
        said = strip(F.col("text"))
        error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce(said, F.lit("")) == "", F.lit("no text"))
        found = read.select("path", said.alias("text"), error.alias("error")).join(files.select("path", F.col("modificationTime").alias("modified")), "path")
        found.select("path", "modified", F.when(F.col("error").isNull(), doc_id(F.col("text"))).alias("id"), "error").write.mode("overwrite").parquet(f"{out}/files/batch={number}")
        failed = found.where(F.col("error").isNotNull()).select(
            doc_id(F.col("path")).alias("id"), summary(F.col("path")).alias("content_summary"), F.lit(0).alias("content_length"), F.lit("failed").alias("status"), F.lit(0).cast("long").alias("chunks_count"), "error",
        )
        done = _read(spark, f"{out}/status", STATUS, number).where("status = 'processed'")
        _ingest(enqueue(found.where(F.col("error").isNull()), done), out, number, size, overlap, ask, failed)
        discard(read)

    return arriving(spark, folder, at_once).writeStream.option("checkpointLocation", f"{out}/progress").foreachBatch(batch)


def retry_failed(spark: SparkSession, folder: str, ask: Callable[[str], str], size: int = 200, overlap: int = 20) -> int:
    """Take the failed documents of a stream again, while it isn't running; returns how many there were. Batches of retries count down from -1."""
    status = _read(spark, f"{folder}/status", STATUS)
    failed = latest_status(status.drop("batch")).where("status = 'failed'").select("id")
    docs = _read(spark, f"{folder}/docs", "id string, content string, content_summary string, content_length int, status string")
    todo = docs.drop("batch").join(failed, "id", "left_semi").dropDuplicates(["id"])
    n = todo.count()
    if n:
        lowest = status.agg(F.min("batch")).first()[0]
        _ingest(todo, folder, min(lowest, 0) - 1, size, overlap, ask)
    return n


def _read(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """A batch table as it was before a batch, or all of it with `batch`; empty if nothing was written."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema if before is not None else f"{schema}, batch int")
    rows = spark.read.schema(f"{schema}, batch int").parquet(path)
    return rows if before is None else rows.where(F.col("batch") < before).drop("batch")


def windowed_counts(events: DataFrame, late: str, length: str, slide: str | None = None) -> DataFrame:
    """Events of each type in time windows, late ones dropped by a watermark; the same plan on a table or a stream."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str, gap: str) -> DataFrame:
    """Events of each user in sessions that end after a pause of `gap`; the same plan on a table or a stream."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), "user_id", "n")
