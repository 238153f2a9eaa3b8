"""Importance resampling towards a target distribution, by hashed word counts of whole texts.

Words and checksums come from a byte automaton over Arrow's text buffers: a lookup table gives each byte's class and lower-case form, word
bounds are where the class changes or a text ends, and a table-driven CRC-32 moves on by a byte at all words at once. No text is
decoded and no word becomes an object.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, in_order, materialize

#: Buckets, scale of gains and scores.
BUCKETS, SCALE = 10_000, 1000
#: Bytes of the texts that are worked on together; a longer text is worked on alone.
SLICE = 1 << 22
#: Bytes of a word that all words take together; the rest of the few longer ones is taken word by word.
TOGETHER = 48

#: The lower-case form of a byte in a word; 0 for bytes between words. Bytes from 0x80 on belong to words.
FORM = np.zeros(256, np.uint8)
for _low, _high, _up in ((0x30, 0x3A, 0), (0x41, 0x5B, 0x20), (0x61, 0x7B, 0), (0x80, 0x100, 0)):
    FORM[_low:_high] = np.arange(_low + _up, _high + _up)
#: CRC-32's step for each low byte.
STEP = np.array([reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(8), i) for i in range(256)], np.uint32)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes and the bounds of its texts in them; null ones have no bytes."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), bounds


def _words(form: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: a word ends where the class of bytes changes and where a text does."""
    inside = np.concatenate(([False], form != 0, [False]))
    cut = np.zeros(len(form) + 1, bool)
    cut[bounds] = True
    start = inside[1:] & (~inside[:-1] | cut)
    end = inside[:-1] & (~inside[1:] | cut)
    return np.flatnonzero(start), np.flatnonzero(end)


def _checksums(form: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC states after as many further bytes from each start on; all words move on side by side, the longest ones last."""
    order = np.argsort(-length, kind="stable")
    start, falling, crc = start[order], -length[order], state[order]
    for i in range(min(-int(falling[0]), TOGETHER) if len(falling) else 0):
        n = int(np.searchsorted(falling, -i, "left"))  # words of more than i bytes
        crc[:n] = STEP[(crc[:n] ^ form[start[:n] + i]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
    for i in range(int(np.searchsorted(falling, -TOGETHER, "left"))):
        rest = form[start[i] + TOGETHER : start[i] - falling[i]].tobytes()
        crc[i] = zlib.crc32(rest, int(crc[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(column: pa.Array, most: int = 1, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a string array: words of each text, and for each run of 1 to `most` words in a text, joined by a space, its text's number in the slice and its bucket."""
    data, bounds = _texts(column)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE, "right")) - 1)
        own = bounds[at : stop + 1] - bounds[at]
        form = FORM[data[bounds[at] : bounds[stop]]]
        start, end = _words(form, own)
        length, text, first = end - start, np.searchsorted(own, start, "right") - 1, np.arange(len(start))
        crc = _checksums(form, start, length, np.full(len(start), 0xFFFFFFFF, np.uint32))
        texts, crcs = [text], [crc]
        for n in range(1, most):
            inside = first + n < len(start)
            first, crc = first[inside], crc[inside]
            same = text[first + n] == text[first]
            first, crc = first[same], crc[same]
            spaced = STEP[(crc ^ np.uint32(0x20)) & 0xFF] ^ (crc >> np.uint32(8))
            crc = _checksums(form, start[first + n], length[first + n], spaced)
            texts.append(text[first])
            crcs.append(crc)
        yield np.bincount(text, minlength=stop - at), np.concatenate(texts), (~np.concatenate(crcs)).astype(np.int64) % buckets
        at = stop


def bucket_counts(texts: DataFrame, text_col: str = "text", most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of a column of texts. A task sums up all it reads before it gives its rows, a bucket each at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, bucket in features(b.column(0), most, buckets):
                n += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], ["bucket", "n"])

    return texts.select(texts[text_col].alias("_text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket, by how much the target texts hold its features more often than docs: logarithms of smoothed shares, in whole thousandths.

    The driver gets a number for each bucket that is used, of either table.
    """
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for n, table, column in ((s, docs, text_col), (t, target, target_col)):
        for r in bucket_counts(table, column, most, buckets).collect():
            n[r["bucket"]] = r["n"]
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(SCALE * math.log((y + 1.0) * all_s / ((x + 1.0) * all_t))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most: int = 1) -> DataFrame:
    """id_col, n_words, n_features and weight, the sum of the gains of a text's features, for each row of docs."""
    out = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("_text"))
    fixed = out.sparkSession.sparkContext.broadcast(gain)  # as many numbers as there are buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, number, weight = [], [], []
            for n, text, bucket in features(b.column(1), most, len(gain)):
                words.append(n)
                number.append(np.bincount(text, minlength=len(n)))
                weight.append(np.bincount(text, fixed.value[bucket], len(n)).astype(np.int64))
            new = [pa.array(np.concatenate([np.empty(0, np.int64), *x]), pa.int64()) for x in (words, number, weight)]
            yield pa.RecordBatch.from_arrays([b.column(0), *new], [b.schema.names[0], "n_words", "n_features", "weight"])

    return out.mapInArrow(run, extended(out.select(id_col), n_words="long", n_features="long", weight="long"))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in whole thousandths, from a digest of seed and key (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(id_col, n_features, weight, score, rank) for each row of docs: those of at least `least_words` words with the highest scores, `percent` of them, get ranks from 1.

    score: weight and Gumbel noise, so that a draw without replacement is a sort. Ties go to the smaller id. Null and empty texts have no
    features and weight 0; a null id counts as an empty text and comes first among equal scores; rows of one id are ranked apart; an empty table (of docs or
    target) is no error; other columns of docs aren't carried, whatever their names. Texts are read twice and never shuffled; the
    rows that are ordered hold five numbers each and are dealt by ranges of the order.
    """
    w = weighed(docs, gains(docs, target, text_col, target_col, most, buckets), id_col, text_col, most)
    w = materialize(w.withColumn("score", F.col("weight") + noise(F.col(id_col), seed)))
    few = F.col("n_words") < least_words
    take = w.where(~few).count() * percent // 100
    rows = in_order(w.where(~few).withColumn("_first", -F.col("score")), [], ["_first", id_col, "n_features", "weight"], {}, rank="_before")
    rank = F.when(F.col("_before") < take, F.col("_before") + 1).alias("rank")
    names = [id_col, "n_features", "weight", "score"]
    return rows.select(*names, rank).unionByName(w.where(few).select(*names, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of docs, with all columns, whose id `ranked` draws; all rows of an id that is drawn (null ids too)."""
    ids = ranked(docs, target, id_col=id_col, **settings).where("rank IS NOT NULL").select(F.col(id_col).alias("_drawn")).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(ids["_drawn"]), "left_semi")
