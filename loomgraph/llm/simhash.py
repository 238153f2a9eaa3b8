"""SimHash near-dedup: fingerprints of word shingles, bit-sliced comparison, components of linked fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, discard, materialize
from .wordtable import as_bytes

SEED = 42
LANES = 64
#: Fingerprints that are compared all with all in one task, and bytes of their shingle sets.
MOST, SET_BYTES = 4096, 1 << 25
#: Fingerprints under one key that meet in one task; more are dealt to blocks, each two of which meet.
LARGEST = 1 << 17
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd factors whose products order the shingle hashes for the min-wise keys: the first from a generator with a fixed seed.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(w: list[bytes], words: int) -> list[bytes]:
    return [b" ".join(w)] if len(w) < words else list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))


def shingle_set(text: bytes | None, words: int) -> bytes:
    """The sorted 32-bit hashes of a text's distinct shingles."""
    w = text.lower().split() if text else []
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh32_digest, _shingles(w, words) if w else [])), np.uint32)).tobytes()


def fingerprint(text: bytes | None, words: int = 3, width: int = 1, keys: int = 0) -> tuple[bytes, list[int], bytes]:
    """The fingerprint (width 64-bit words), the smallest of the shingle hashes in `keys` orders, and with keys a digest of the set of them.

    A bit is 1 if set in over half the shingles' hashes, repeats included; without a word all are 0. Width 1: XXH64, seed 42;
    width 2: XXH3 of 128 bits.
    """
    w = text.lower().split() if text else []
    if not w:
        return bytes(8 * width), [0] * keys, bytes(8)
    shingles = _shingles(w, words)
    lows = []
    votes, least = np.zeros(64 * width, np.int64), np.full(keys, ONES, np.uint64)
    for i in range(0, len(shingles), 1 << 17):
        part = shingles[i : i + (1 << 17)]
        if width == 1:
            h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.dtype(">u8"), len(part)).view(np.uint8).reshape(-1, 8)
        else:
            h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s, SEED) for s in part]), np.uint8).reshape(-1, 16)
        votes += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int32)
        if keys:
            low = np.ascontiguousarray(h[:, :8]).view(np.uint64)
            least = np.minimum(least, (low * FACTORS[:keys]).min(axis=0))
            lows.append(low.ravel())
    digest = xxhash.xxh64_digest(np.unique(np.concatenate(lows)).tobytes()) if keys else bytes(8)
    return np.packbits(2 * votes > len(shingles)).tobytes(), least.view(np.int64).tolist(), digest


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, width: int = 1, keys: int = 0) -> DataFrame:
    """Append _fp (BINARY, 8 * width bytes), _keys (ARRAY<LONG>) and _set (BINARY: what stands for the set of shingles) to all rows and columns of docs. Null text: zeros."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_fp", T.BinaryType()), T.StructField("_keys", T.ArrayType(T.LongType())), T.StructField("_set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [fingerprint(t, words, width, keys) for t in as_bytes(b.column(text))]
            cols = [pa.array([f for f, _, _ in made], pa.binary()), pa.array([k for _, k, _ in made], pa.list_(pa.int64())), pa.array([d for _, _, d in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "_fp", "_keys", "_set"])

    return docs.mapInArrow(run, schema)


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of tiles of 64 fingerprints: word [b, t] holds bit b of the tile's fingerprints, a lane each."""
    n, width = fps.shape
    out = np.empty((64 * width, n // LANES), np.uint64)
    for b in range(64 * width):
        bits = ((fps[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.uint8).reshape(-1, LANES)
        out[b] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def tile_links(fps: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of fps (a multiple of 64 of them) within the radius, between the tiles a[i] and b[i], each pair once.

    For one lane of every tile a at a time, the distances to all 64 lanes of b are counted at once: each bit plane is added
    with carries to the counter planes, and lanes that pass the radius stick. Tile pairs without a lane left are abandoned.
    """
    planes, found = _planes(fps), []
    counters = (radius + 1).bit_length()
    limit = [ONES if radius + 1 >> k & 1 else np.uint64(0) for k in range(counters)]
    for lane in range(LANES):
        at = np.arange(len(a))
        ta, tb = a, b
        over = np.where(ta == tb, ONES >> np.uint64(LANES - 1 - lane), np.uint64(0))  # within a tile, later lanes only
        count = [np.zeros(len(a), np.uint64) for _ in range(counters)]
        for bit in range(len(planes)):
            own = np.uint64(0) - ((planes[bit, ta] >> np.uint64(lane)) & np.uint64(1))
            carry = planes[bit, tb] ^ own
            short = np.zeros(len(ta), np.uint64)
            for k in range(counters):
                count[k], carry = count[k] ^ carry, count[k] & carry
                short |= count[k] ^ limit[k]
            over |= ~short
            if bit % 8 == 7:
                left = np.flatnonzero(over != ONES)
                if len(left) < 0.8 * len(at):
                    at, ta, tb, over = at[left], ta[left], tb[left], over[left]
                    count = [x[left] for x in count]
                    if not len(at):
                        break
        hit = np.flatnonzero(over != ONES)
        if len(hit):
            rows, lanes = np.nonzero(np.unpackbits((~over[hit])[:, None].view(np.uint8), axis=1, bitorder="little"))
            found.append((ta[hit][rows] * LANES + lane, tb[hit][rows] * LANES + lanes))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join each node to the smallest of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[far]], nodes[far]


#: Of linked fingerprints in one bucket: (keys, further split) for each of several ways to split it, or none: then all are compared.
Split = Callable[[np.ndarray], "list[tuple[np.ndarray, Split]]"]


def whole(fps: np.ndarray) -> list[tuple[np.ndarray, Split]]:
    return []


def by_free_bits(free: list[int], radius: int) -> Split:
    """Splits 64-bit fingerprints that are equal but for the free bits: at most `radius` of these differ, so one of radius + 1 parts of them is equal.

    In what such a part leaves, the same holds of the bits that are still free.
    """

    def split(fps: np.ndarray) -> list[tuple[np.ndarray, Split]]:
        if len(free) <= radius:
            return []
        parts = [free[p :: radius + 1] for p in range(radius + 1)]
        return [(fps[:, 0] & np.uint64(sum(1 << b for b in p)), by_free_bits([b for b in free if b not in p], radius)) for p in parts]

    return split


def bucket_pairs(fps: np.ndarray, keys: np.ndarray, radius: int, split: Split = whole, most: int = MOST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows of fps with equal keys (sorted by key), as pairs of rows; some may come twice.

    Tiles are cut across buckets, as a link found between two buckets is a link too. A bucket beyond `most` is split in each
    way that `split` gives, and so on; with none, all its tiles are compared.
    """
    rows = np.arange(len(fps))
    if len(fps) < 2:
        return
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(fps)))
    large = sizes > most
    for at in np.flatnonzero(large):
        s, m = starts[at], sizes[at]
        ways = split(fps[s : s + m])
        large[at] = bool(ways)
        for key, further in ways:
            order = np.argsort(key, kind="stable")
            for u, v in bucket_pairs(fps[s + order], key[order], radius, further, most):
                yield s + order[u], s + order[v]
    keep = np.repeat(~large & (sizes > 1), sizes)
    fps, keys, rows = fps[keep], keys[keep], rows[keep]
    if not len(fps):
        return
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    last = np.append(first[1:], len(fps)) - 1
    tiles = -(-len(fps) // LANES)
    at = np.minimum(np.arange(tiles * LANES), len(fps) - 1)
    padded, rows = fps[at].reshape(tiles, LANES, -1), rows[at]
    a, b = [np.arange(tiles)], [np.arange(tiles)]
    wide = np.flatnonzero(last // LANES > first // LANES)
    for lo, hi in zip(first[wide] // LANES, last[wide] // LANES, strict=True):
        x, y = np.triu_indices(hi - lo + 1, 1)
        a.append(lo + x)
        b.append(lo + y)
    a, b = np.concatenate(a), np.concatenate(b)
    for i in range(0, len(a), 1 << 11):
        used, where = np.unique(np.concatenate([a[i : i + (1 << 11)], b[i : i + (1 << 11)]]), return_inverse=True)
        half = len(where) // 2
        u, v = tile_links(padded[used].reshape(-1, padded.shape[2]), where[:half], where[half:], radius)
        u, v = (used[x // LANES] * LANES + x % LANES for x in (u, v))
        if (real := at[u] != at[v]).any():
            yield rows[u[real]], rows[v[real]]


def alike_enough(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets (sorted distinct hashes) have a Jaccard similarity of `least` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= least * (len(both) - shared)


def confirmed(pairs: Iterator[tuple[np.ndarray, np.ndarray]], sets: list[np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges whose components are those of all pairs alike enough. Pairs that earlier edges join are not looked at."""
    label = np.arange(len(sets))
    for u, v in pairs:
        take = 1
        while True:
            apart = label[u] != label[v]
            u, v = u[apart], v[apart]
            if not len(u):
                break
            order = np.argsort(label[u], kind="stable")
            of = label[u][order]
            begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            rank = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
            now = order[rank < take]  # a few of each component's pairs
            ok = now[[alike_enough(sets[x], sets[y], least) for x, y in zip(u[now].tolist(), v[now].tolist(), strict=True)]]
            if len(ok):
                yield u[ok], v[ok]
                root, far = _forest(label[u[ok]], label[v[ok]])
                to = np.arange(len(label))
                to[far] = root
                label = to[label]
            if 2 * len(ok) < len(now):
                take *= 2
            rest = np.ones(len(u), bool)
            rest[now] = False
            u, v = u[rest], v[rest]


def _compared(rows: DataFrame, width: int, radius: int, split: Callable[[int], Split], least: float | None = None) -> DataFrame:
    """Edges (u, v) between nodes (BINARY, `width` words of fingerprint first) that meet under a key. rows: i, k, node, set.

    least: the similarity of the sets (sorted 32-bit hashes) that a link needs besides.
    """
    dealt = rows.select("i", "k", "node", "set").repartition("i", "k").sortWithinPartitions("i", "k")

    def flush(i: np.ndarray, k: np.ndarray, f: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        raw = f.astype(">u8")
        for which in np.unique(i):
            sel = np.flatnonzero(i == which)
            pairs = bucket_pairs(np.ascontiguousarray(f[sel, :width]), k[sel], radius, split(int(which)))
            found = (_forest(u, v) for u, v in pairs) if least is None else confirmed(pairs, [np.frombuffer(s[x], np.uint32) for x in sel], least)
            for u, v in found:
                cols = [pa.array([raw[x].tobytes() for x in sel[e]], pa.binary()) for e in (u, v)]
                yield pa.RecordBatch.from_arrays(cols, ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], []]
        size = 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            f = np.frombuffer(b"".join(b.column(2).to_pylist()), ">u8").astype(np.uint64).reshape(n, -1)
            sets = np.empty(n, object)
            sets[:] = b.column(3).to_pylist()
            for h, c in zip(held, (b.column(0).to_numpy(), b.column(1).to_numpy(), f, sets), strict=True):
                h.append(c)
            size += n + sum(map(len, sets)) // 128
            if size >= 1 << 19:
                i, k, f, s = map(np.concatenate, held)
                cut = np.flatnonzero((i != i[-1]) | (k != k[-1]))
                cut = cut[-1] + 1 if len(cut) else 0
                yield from flush(i[:cut], k[:cut], f[:cut], s[:cut])
                held = [[i[cut:]], [k[cut:]], [f[cut:]], [s[cut:]]]
                size = len(i) - cut + sum(map(len, s[cut:])) // 128
        if size:
            yield from flush(*map(np.concatenate, held))

    return dealt.mapInArrow(run, "u binary, v binary").distinct()


def _spread(rows: DataFrame, most: int) -> DataFrame:
    """rows (i, k, node, bytes) with large buckets in blocks: a bucket's rows are dealt to shards, and each two shards meet under a key of their own."""
    shards = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("bytes") / SET_BYTES)).cast("int")
    large = materialize(rows.groupBy("i", "k").agg(shards.alias("_n")).where("_n > 1"))
    own = F.pmod(F.xxhash64("node"), F.col("_n")).cast("int")
    out = rows.join(large, ["i", "k"], "left").withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1)))
    key = F.when(F.col("_n").isNull(), F.col("k")).otherwise(F.xxhash64("k", F.least("_own", "_other"), F.greatest("_own", "_other")))
    return out.select("i", key.alias("k"), "node")


def links(fps: DataFrame, radius: int = 3, bands: int = 5) -> DataFrame:
    """Edges (u, v) over 64-bit fingerprints (_fp) whose components are those of all links within a small radius; none is lost.

    Of `bands` parts of the bits at least bands - radius are equal in two linked fingerprints, so each set of that many parts
    makes a key. Fingerprints meet in their key's partition, where runs of equal keys are compared; only forests leave a task.
    """
    sets = list(combinations(range(bands), bands - radius))
    edges = [64 * i // bands for i in range(bands + 1)]
    masks = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in s) for s in sets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    free = [[b for b in range(64) if not m >> b & 1] for m in masks]
    word = F.conv(F.hex("_fp"), 16, -10).cast("long")
    key = [F.struct(F.lit(i).alias("i"), word.bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)]
    rows = fps.select("_fp", F.explode(F.array(*key)).alias("key")).select("key.i", "key.k", F.col("_fp").alias("node"), F.lit(0).alias("bytes"))
    rows = _spread(rows, LARGEST).withColumn("set", F.lit(b""))
    return _compared(rows, 1, radius, lambda i: by_free_bits(free[i], radius))


def wide_links(nodes: DataFrame, docs: DataFrame, radius: int, width: int, words: int, least: float, most: int = MOST) -> DataFrame:
    """Edges (u, v) whose components are those of all links: nodes that share a min-wise key (_keys), lie within a wide radius and whose
    shingle sets are alike by `least` or more.

    nodes: node, _keys, th, len; docs: th, len, _text. Documents whose shingle sets are alike by a share J agree on one of n keys with
    a chance of 1 - (1 - J)^n. Sets are made only for nodes with another one in their radius, then all their pairs are looked at again.
    """
    rows = nodes.select(F.posexplode("_keys").alias("i", "k"), "node")
    first = _spread(rows.withColumn("bytes", F.lit(0)), most).withColumn("set", F.lit(b""))
    near = _compared(first, width, radius, lambda i: whole)
    near = materialize(near.select(F.explode(F.array("u", "v")).alias("node")).distinct())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, words) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    asked = materialize(nodes.join(near, "node").select("node", "th", "len"))
    texts = docs.join(asked.select("th", "len").distinct(), ["th", "len"], "left_semi").dropDuplicates(["th", "len"])
    sets = materialize(texts.join(asked, ["th", "len"]).select("node", "_text").mapInArrow(make, "node binary, set binary"))
    again = _spread(rows.join(sets.select("node", F.length("set").alias("bytes")), "node").select("i", "k", "node", "bytes"), most)
    return _compared(again.join(sets, "node"), width, radius, lambda i: whole, least)


def _grouped(docs: DataFrame, text: str, doc_id: str, words: int, radius: int, width: int, keys: int, least: float) -> DataFrame:
    """doc_id, th and len (hash and bytes of the text), _fp and first (null, doc_id, th, len: the first row of the component) of every row."""
    t = F.coalesce(F.col("_text"), F.lit(""))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).withColumns({"th": F.xxhash64(t), "len": F.octet_length(t)})
    fp = fingerprints(texts, "_text", words, width, keys).drop("_text").withColumn("node", F.concat("_fp", "_set") if keys else F.col("_fp"))
    fp = materialize(fp.drop("_set") if keys else fp.drop("_set", "_keys"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "len")).alias("first")
    classes = materialize(fp.groupBy("node").agg(first, *([F.min(F.struct("th", "len")).alias("t"), F.first("_keys").alias("_keys")] if keys else [])))
    if keys:
        nodes = classes.select("node", "_keys", "t.th", "t.len")
        label = components(wide_links(nodes, texts.select("th", "len", "_text"), radius, width, words, least))
    else:
        label = components(links(classes.select(F.col("node").alias("_fp")), radius))
    own = classes.select(F.col("node").alias("_node"), "first").join(label, F.col("_node") == label.node, "left").select("_node", "first", F.coalesce("label", "_node").alias("label"))
    own = materialize(own)  # a component may hold a third of all: plain tables are split where a key is hot
    of = materialize(own.groupBy("label").agg(F.min("first").alias("first")))
    known = materialize(own.select("_node", "label").join(of, "label").select("_node", "first"))
    discard(classes, label, own, of)
    return fp.join(known, fp.node == known._node).select("doc_id", "th", "len", "_fp", "first")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, radius: int = 3, width: int = 1, keys: int = 0, least: float = 0.0) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: components of fingerprints that link at `radius` or fewer differing bits.

    keys = 0 takes all links (a small radius, 64 bits); otherwise links are looked for among documents that share one of that many
    min-wise keys (any radius), and count if the texts' sets of shingles have a Jaccard similarity of `least` or more. component_id is the smallest id reachable, a row's own included (null only if all are). Null or blank text:
    fingerprint zero, linked like any other. Rows with equal fingerprints are one class, so thousands of copies cost one
    comparison; repeated rows stay repeated; further columns are not read; no rows: none.
    """
    out = _grouped(docs, text, doc_id, words, radius, width, keys, least)
    return out.select("doc_id", F.lower(F.hex("_fp")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, radius: int = 36, width: int = 2, keys: int = 6, least: float = 0.8) -> DataFrame:
    """One document of each near-duplicate group, with all columns: the one with the smallest id, of equal ids the one with the smallest hash of its text.

    With 128-bit fingerprints of five-word shingles, texts of similarity 0.8 differ in 19 bits at the mean (deviation 4), unrelated
    ones in 64; the radius only says which sets of shingles are compared. A null id comes after all others and stands for no document
    in particular, so rows without an id fold only where their texts are near copies; an id on different texts is several documents.
    Of rows equal in id and text one stays, the first by a hash of its other columns. Null and blank texts are one group; no rows: none.
    """
    groups = materialize(_grouped(docs, text, doc_id, words, radius, width, keys, least))
    t = F.coalesce(F.col(text), F.lit(""))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "len")
    gone = groups.where(own != F.col("first")).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("len").alias("_len")).distinct()
    keyed = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(t) == F.col("_th")) & (F.octet_length(t) == F.col("_len"))
    out = docs.join(materialize(gone).hint("merge"), keyed, "left_anti")  # as on large tables, at every size
    twice = materialize(groups.where(own == F.col("first")).groupBy("doc_id", "th", "len").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("len").alias("_len")))
    if twice.limit(1).count():
        rest = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
        place = Window.partitionBy("_id", "_th", "_len").orderBy(F.xxhash64(*rest))
        some = docs.join(twice, keyed).withColumn("_at", F.row_number().over(place)).where("_at = 1").select(*docs.columns)
        out = out.join(twice, keyed, "left_anti").unionByName(some)
    return out
