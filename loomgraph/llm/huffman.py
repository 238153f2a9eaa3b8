"""Token-id files: canonical length-limited Huffman codes from global counts, in blocks that decode independently.

A file set is a folder with two Parquet tables. `code`: id, length (bits of the id's canonical code). `blocks`: part and seq
(the order), before (ids of the part before the block), doc_ids and n_ids (by document), bits (the codes, first bit first), checks (the bit
at which every CHECK-th id starts). The codes follow from the lengths: ids sorted by length, then id, count upwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .wordtable import default_vocabulary, library_table, slices, tokenizer

#: Longest code in bits, ids between checkpoints, ids of a block (more, if one document is longer).
LONGEST, CHECK, BLOCK = 16, 256, 1 << 18


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits of each id's code for the least total of counts * bits with no code beyond `longest` (0: not used), by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need codes of more than {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    items, levels = weight, []
    for _ in range(longest - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        at = np.argsort(both, kind="stable")
        levels.append(at < len(weight))
        items = both[at]
    take = 2 * len(order) - 2
    for leaf in reversed(levels):
        own = int(leaf[:take].sum())
        out[order[:own]] += 1
        take = 2 * (take - own)
    out[order[:take]] += 1
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by id, and the ids in the order of their codes."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    n = lengths[order]
    # A code is its place on the scale of the longest codes.
    step = (1 << (LONGEST - n)).astype(np.int64)
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = (np.cumsum(step) - step) >> (LONGEST - n)
    return codes, order


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of the ids bit after bit, and where every CHECK-th id starts."""
    n = lengths[ids]
    ends = np.cumsum(n)
    at = ends - n
    total = int(ends[-1]) if len(ends) else 0
    size = (total + 7) // 8
    # Three bytes hold any code from any bit on; codes don't overlap, so adding them up joins them.
    window = np.bincount(at >> 3, weights=codes[ids] << (24 - n - (at & 7)), minlength=size).astype(np.int64)
    out = np.zeros(size + 2, np.int64)
    out[:size] += window >> 16
    out[1 : size + 1] += (window >> 8) & 255
    out[2 : size + 2] += window & 255
    return out[:size].astype(np.uint8).tobytes(), at[::CHECK].astype(np.int32)


class Decoder:
    """Decodes by a table of all LONGEST-bit strings: the id that each begins with and its bits."""

    def __init__(self, lengths: np.ndarray):
        _, order = canonical(lengths)
        each = 1 << (LONGEST - lengths[order])
        self.id = np.zeros(1 << LONGEST, np.uint32)
        self.bits = np.ones(1 << LONGEST, np.int64)
        self.id[: each.sum()] = np.repeat(order, each)
        self.bits[: each.sum()] = np.repeat(lengths[order], each)

    def __call__(self, bits: bytes, checks: np.ndarray, n: int) -> np.ndarray:
        """The n ids of a block, its checkpoints side by side."""
        raw = np.frombuffer(bits + bytes(4), np.uint8).astype(np.uint32)
        three = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
        at, out = checks.astype(np.int64), np.empty((CHECK, len(checks)), np.uint32)
        last = len(three) - 1
        for i in range(CHECK):
            seen = (three[np.minimum(at >> 3, last)] >> (8 - (at & 7)).astype(np.uint32)) & np.uint32((1 << LONGEST) - 1)
            out[i] = self.id[seen]
            at += self.bits[seen]
        return out.T.ravel()[:n]


def _plain(vocabulary: str, end: int) -> str:
    """The type of plain ids: 16 bits if all fit."""
    return "<u2" if max(tokenizer(vocabulary).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"


def _counted(ids: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in rows of plain ids; every task sums its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                n = np.bincount(np.frombuffer(raw, kind))
                total = np.pad(total, (0, max(0, len(n) - len(total))))
                total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    got = ids.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary's ids
    out = np.zeros(int(got["id"].max()) + 1 if len(got) else 1, np.int64)
    out[got["id"]] = got["n"]
    return out


def _blocks(docs: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """Rows of about BLOCK ids of whole documents in id order: part, seq, before, doc_ids, n_ids and the plain ids."""
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    names, kind = ["part", "seq", "before", "doc_ids", "n_ids", "ids"], _plain(vocabulary, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = library_table(vocabulary), TaskContext.get().partitionId()
        seq = before = size = 0
        held: list[np.ndarray] = []
        held_docs: list[int | None] = []
        held_n: list[int] = []

        def flush() -> pa.RecordBatch:
            row = [part, seq, before, held_docs, held_n, np.concatenate(held).astype(kind).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                flat, n = table.ids(b.column(1).to_pylist())
                ids = np.full(len(flat) + len(n), end, np.int64)
                own = np.ones(len(ids), bool)
                own[np.cumsum(n + 1) - 1] = False
                ids[own] = flat
                held.append(ids)
                held_docs += b.column(0).to_pylist()
                held_n += (n + 1).tolist()
                size += len(ids)
                if size >= BLOCK:
                    yield flush()
                    seq, before, size, held, held_docs, held_n = seq + 1, before + size, 0, [], [], []
        if size:
            yield flush()

    dealt = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(run, "part int, seq int, before long, doc_ids array<long>, n_ids array<int>, ids binary")


def write(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None, end: int = 1) -> None:
    """Write the token ids of every text, each followed by `end`, in ascending doc_id order (null first; ties by text).

    Null or blank text: the end alone. Repeated rows are written each. Further columns are not read. No rows: empty tables.
    Documents are dealt by ranges of their ids, so file order is id order. Texts are tokenised once, into blocks of plain ids in the
    shared folder; the counts are taken from those, and each block is then coded on its own. Only counts of ids reach the driver.
    """
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    plain = materialize(_blocks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), vocabulary, end))
    kind = _plain(vocabulary, end)
    lengths = code_lengths(_counted(plain.select("ids"), kind))
    used = np.flatnonzero(lengths).tolist()
    spark.createDataFrame([(i, int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{path}/code")
    sent = spark.sparkContext.broadcast(lengths.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lens = sent.value
        codes = canonical(lens)[0]
        for b in batches:
            made = [pack(np.frombuffer(raw, kind).astype(np.int64), lens, codes) for raw in b.column("ids").to_pylist()]
            cols = [pa.array([x for x, _ in made], pa.binary()), pa.array([c.tolist() for _, c in made], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*b.schema.names[:-1], "bits", "checks"])

    plain.mapInArrow(run, "part int, seq int, before long, doc_ids array<long>, n_ids array<int>, bits binary, checks array<int>").write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    discard(plain)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids BINARY) of every document of a file set, ids as little-endian unsigned 32-bit integers."""
    return _decoded(spark, path, "ids binary", lambda ids: ids.astype("<u4").tobytes(), pa.binary())


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a file set, from the decoded ids."""
    return _decoded(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def _decoded(spark: SparkSession, path: str, column: str, make, kind: pa.DataType) -> DataFrame:
    code = spark.read.parquet(f"{path}/code").toPandas()
    lengths = np.zeros(int(code["id"].max()) + 1 if len(code) else 2, np.int64)
    lengths[code["id"]] = code["length"]
    blocks = spark.read.parquet(f"{path}/blocks")
    sent = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(sent.value)
        for b in batches:
            for part, before, docs, n, bits, checks in zip(*(b.column(i).to_pylist() for i in range(5)), (np.asarray(x) for x in b.column(5).to_pylist()), strict=True):
                n = np.asarray(n, np.int64)
                ends = np.cumsum(n)
                ids = decode(bits, checks, int(ends[-1]))
                cols = [pa.array([part] * len(n), pa.int32()), pa.array(docs, pa.int64()), pa.array(before + ends - n), pa.array(n), pa.array([make(ids[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)], kind)]
                yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "at", "n_tokens", column.split()[0]])

    docs = blocks.select("part", "before", "doc_ids", "n_ids", "bits", "checks").mapInArrow(run, f"part int, doc_id long, at long, n_tokens long, {column}")
    # One row for each part, so the order over all parts is a small window.
    size = F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = blocks.select("part", size.alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    first = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return docs.join(first, docs.part == first._part).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", column.split()[0])

