"""Suffix-array dedup: every byte of a string of at least `length` bytes that also starts elsewhere.

Any `length` bytes hold an anchor: of their k-byte strings the one with the smallest hash, wherever the bytes stand. So two
occurrences of a repeat meet at an anchor of equal content. Around each repeated anchor the contexts are compared as an enhanced suffix
array: sorted by what follows, their common-prefix intervals are scanned with a stack; the left extensions of an interval's members form
intervals in turn, and one whose members differ on both sides is a maximal repeat with all its occurrences. A context that occurs
several times is one leaf with a count.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, extended, materialize
from .wordtable import as_bytes, slices

#: Bytes of text whose anchors are chosen at once.
PIECE = 1 << 20
#: Contexts of one anchor that are compared in one task; larger groups are split first.
GROUP = 2_000
#: Bytes that stand for a word where passages are judged in words.
WIDTH = 4

#: A word: bytes between white space, but each character of scripts without spaces (U+3000 to U+D7FF) by itself.
_WORD = re.compile(rb"[\xe3-\xed][\x80-\xbf]{2}|[^\x20\x09-\x0d\xe3-\xed]+|[\xe3-\xed]")
_UNSPACED = re.compile(rb"[\xe3-\xed]")

_FACTOR = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_LOW = np.uint64((1 << 24) - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _FACTOR, np.uint64), np.full(n, pow(_FACTOR, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Anchors:
    """Positions of the anchors of byte strings."""

    def __init__(self, length: int, k: int):
        self.length, self.k = length, k
        self.value = np.random.default_rng(9).integers(0, 1 << 63, 256, np.uint64)
        self.up, self.down = _powers(2 * PIECE + 4 * length)

    def _chosen(self, joined: bytes, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Positions in the joined strings, ascending; only what lies within one string is looked at."""
        n, w = len(joined), self.length - self.k + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[np.frombuffer(joined, np.uint8)] * self.up[:n], out=sums[1:])
        key = (sums[self.k :] - sums[: -self.k]) * self.down[: n - self.k + 1]
        key ^= key >> np.uint64(29)
        key *= _MIX
        key = (key & ~_LOW) | np.arange(len(key), dtype=np.uint64)
        rows = -(-len(key) // w)
        block = np.concatenate([key, np.full(rows * w - len(key), ~np.uint64(0))]).reshape(rows, w)
        before = np.minimum.accumulate(block, axis=1).ravel()
        after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        open_ = np.zeros(n + 1, np.int8)
        np.add.at(open_, starts, 1)
        np.add.at(open_, starts + lens - self.length + 1, -1)
        at = np.flatnonzero(np.cumsum(open_[:-1]))
        pos = (np.minimum(after[at], before[at + w - 1]) & _LOW).astype(np.int64)
        return pos[np.concatenate([[True], pos[1:] != pos[:-1]])] if len(pos) else pos

    def __call__(self, texts: list[bytes]) -> Iterator[tuple[int, int]]:
        """(which text, position) of every anchor."""
        held: list[bytes] = []
        of: list[tuple[int, int]] = []
        size, last = 0, (-1, -1)

        def flush() -> Iterator[tuple[int, int]]:
            nonlocal last
            lens = np.array([len(x) for x in held], np.int64)
            starts = np.cumsum(lens) - lens
            pos = self._chosen(b"".join(held), starts, lens)
            piece = np.searchsorted(starts, pos, side="right") - 1
            for p, a in zip(piece.tolist(), (pos - starts[piece]).tolist(), strict=True):
                found = (of[p][0], of[p][1] + a)
                if found > last:  # pieces of one text overlap, in one flush or in two
                    yield found
                    last = found

        for i, t in enumerate(texts):
            for start in range(0, max(len(t) - self.length, 0) + 1, PIECE):
                part = t[start : start + PIECE + self.length - 1]
                if len(part) < self.length:
                    continue
                if size + len(part) > 2 * PIECE and held:
                    yield from flush()
                    held, of, size = [], [], 0
                held.append(part)
                of.append((i, start))
                size += len(part)
        if held:
            yield from flush()


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (depth, first, last) of a sorted list whose neighbours share common[i], inner ones first, by a stack."""
    stack: list[tuple[int, int]] = []  # depth, first
    for at, depth in enumerate([*common, -1]):
        first = at
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, at
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def groups(lefts: list[bytes], rights: list[bytes], length: int, counts: list[int] | None = None) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats of at least `length` bytes among distinct contexts around one anchor: (bytes left, bytes right, contexts that hold it).

    rights: bytes from the anchor on; lefts: bytes before it, reversed; counts: how often a context occurs. Each common-prefix interval
    of the sorted rights has its members put in the order of their lefts, where intervals are formed again: the members of one share
    `depth` bytes to the right and all of their common left extension, beyond which they differ. It is a maximal repeat if they lie in
    two or more of the right interval's parts, so that they differ on the right as well. A context with a count is a repeat by itself.
    """
    for i, n in enumerate(counts or ()):
        if n > 1 and len(lefts[i]) + len(rights[i]) >= length:
            yield len(lefts[i]), len(rights[i]), [i]
    n = len(rights)
    by_left = sorted(range(n), key=lefts.__getitem__)
    rank = [0] * n
    for r, i in enumerate(by_left):
        rank[i] = r
    longest = max(map(len, lefts), default=0)
    suffixes = sorted(range(n), key=rights.__getitem__)
    common = [_common(rights[a], rights[b]) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    for depth, first, last in _intervals(common):
        if depth + longest < length:
            continue
        part, members = 0, []
        for at in range(first, last + 1):
            members.append((rank[suffixes[at]], part))
            part += at < last and common[at] == depth
        members.sort()
        inside = [by_left[r] for r, _ in members]
        other = [last - first + 1] * len(members)  # the next member of another part
        for x in range(len(members) - 2, -1, -1):
            other[x] = x + 1 if members[x][1] != members[x + 1][1] else other[x + 1]
        for shared, lo, hi in _intervals([_common(lefts[a], lefts[b]) for a, b in zip(inside, inside[1:], strict=False)]):
            if shared + depth >= length and other[lo] <= hi:
                yield shared, depth, inside[lo : hi + 1]


def extents(lefts: list[bytes], rights: list[bytes], length: int) -> list[tuple[int, int] | None]:
    """How far left and right the maximal repeats that a context holds reach; None without one."""
    out: list[tuple[int, int] | None] = [None] * len(rights)
    for left, right, members in groups(lefts, rights, length):
        for i in members:
            old = out[i]
            if old is None or old[0] < left or old[1] < right:
                out[i] = (left, right) if old is None else (max(old[0], left), max(old[1], right))
    return out


def word_ids(text: bytes) -> bytes:
    """WIDTH bytes for each word, equal for equal words."""
    words = _WORD.findall(text) if _UNSPACED.search(text) else text.split()
    return b"".join(map(xxhash.xxh32_digest, words))


def _in_bytes(text: bytes, spans: list[dict], least: int) -> list[dict]:
    """Byte runs of the text for sorted runs in its word_ids; of these, only whole words count, `least` bytes or more of them."""
    runs: list[list[int]] = []
    for x in spans:
        start, end = -(-x["start"] // WIDTH), x["end"] // WIDTH
        if WIDTH * (end - start) < least:
            continue
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    if not runs:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]


def _identity(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("th"), F.octet_length(t).cast("long").alias("len")]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., x0, x1, y0, y1): the other columns, and the lengths of the two common prefixes in place of the four."""
    for b in batches:
        names = b.schema.names[:-4]
        x0, x1, y0, y1 = (c.to_pylist() for c in b.columns[-4:])
        both = [[0 if a is None or z is None else _common(a, z) for a, z in zip(*p, strict=True)] for p in ((x0, x1), (y0, y1))]
        yield pa.RecordBatch.from_arrays([*b.columns[:-4], *(pa.array(v, pa.int32()) for v in both)], [*names, "x", "y"])


def _backwards(c: Column) -> Column:
    """The half bytes in reverse order: bytes that end alike begin alike, two for each byte."""
    return F.reverse(F.hex(c)).cast("binary")


def _hot(rows: DataFrame, length: int, group: int, deep: bool) -> tuple[DataFrame, DataFrame | None]:
    """Rows (h, hh, lo, ctx) with a key `g` whose groups are bounded, and (g, h, hh, lo, ctx, left, right) of groups that repeat as a whole.

    All members of a large group share some bytes: from -a to b around the anchor, the first and the last in order of both sides tell
    how far. If these are `length` or more, they are a maximal repeat of the whole group. If not, the group is split into those that
    share half of what is missing more on the left, and on the right: a repeat's occurrences stay together in one of the two.
    deep: groups that repeat as a whole are split as well, by the next byte on the left and on the right, for the repeats inside them.
    """
    k = F.lit(0)
    todo = rows.withColumns({"_a": k, "_b": F.lit(length // 2), "g": F.xxhash64("h")})
    shared = F.xxhash64("h", "_a", "_b", F.substring(F.col("ctx"), F.col("lo") - F.col("_a") + 1, F.col("_a") + F.col("_b")))
    ready, known = None, None
    while True:
        # A context may have come to its group on two ways; it counts once, as it is no repeat of itself.
        keys = todo if ready is None else todo.select("g", "hh").distinct()
        sizes = materialize(keys.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > 1))
        big = materialize(sizes.where(F.col("n") > group).select("g"))
        if not big.limit(1).count():
            done = todo.join(sizes.select("g"), "g", "left_semi") if ready is not None else todo
            return (done if ready is None else ready.unionByName(done)), known
        large = todo.join(big, "g", "left_semi")
        done = todo.join(big, "g", "left_anti").join(sizes.select("g"), "g", "left_semi")
        ready = done if ready is None else ready.unionByName(done)
        before = _backwards(F.substring(F.col("ctx"), F.lit(1), F.col("lo") - F.col("_a")))
        after = F.substring(F.col("ctx"), F.col("lo") + F.col("_b") + 1, F.length("ctx"))
        ends = large.select("g", before.alias("x"), after.alias("y")).groupBy("g").agg(*(f(c).alias(c + n) for c in "xy" for f, n in ((F.min, "0"), (F.max, "1"))))
        wider = materialize(ends.mapInArrow(_pairs, "g long, x int, y int"))
        large = large.join(wider, "g").withColumns({"_a": F.col("_a") + F.floor(F.col("x") / 2).cast("int"), "_b": F.col("_b") + F.col("y")})
        # Two ways of splitting may lead to one group.
        large = materialize(large.drop("x", "y").withColumn("g", shared).dropDuplicates(["g", "h", "hh"]))
        whole = large.where(F.col("_a") + F.col("_b") >= length).select("g", "h", "hh", "lo", "ctx", F.col("_a").alias("left"), F.col("_b").alias("right"))
        known = whole if known is None else known.unionByName(whole)
        more = F.greatest(F.ceil((length - F.col("_a") - F.col("_b")) / 2).cast("int"), F.lit(1))
        split = large if deep else large.where(F.col("_a") + F.col("_b") < length)
        split = split.withColumn("_s", F.explode(F.array(F.struct((F.col("_a") + more).alias("a"), F.col("_b").alias("b")), F.struct(F.col("_a").alias("a"), (F.col("_b") + more).alias("b")))))
        split = split.withColumns({"_a": F.col("_s.a"), "_b": F.col("_s.b")}).drop("_s").where((F.col("_a") <= F.col("lo")) & (F.col("_b") <= F.length("ctx") - F.col("lo")))
        todo = materialize(split.withColumn("g", shared))


def _nearest(known: DataFrame, side: Column) -> DataFrame:
    """(g, h, hh, best): the most bytes at the beginning of `side` that a row of a group has in common with another row of it.

    Rows with equal sides are one leaf. Leaves are sorted by ranges, so that a large group is spread over tasks, and the neighbours
    of a leaf share most with it; those of a range's first and last leaf come from the ends of the ranges, a row each. A row that is
    there twice counts once.
    """
    own = known.select("g", "h", "hh", side.alias("s"))
    leaves = own.groupBy("g", "s").agg((F.min("hh") != F.max("hh")).alias("several"))
    leaves = materialize(leaves.repartitionByRange("g", "s").withColumn("_range", F.spark_partition_id()))
    leaf = F.struct("g", "s")
    ends = leaves.groupBy("_range").agg(F.min(leaf).alias("first"), F.max(leaf).alias("last"))
    ranges = Window.orderBy("_range")
    ends = ends.select("_range", F.lag("last").over(ranges).alias("before"), F.lead("first").over(ranges).alias("after"))
    inside = Window.partitionBy("_range").orderBy("g", "s")
    near = leaves.join(ends, "_range").select("g", "s", "several", F.coalesce(F.lag(leaf).over(inside), "before").alias("a"), F.coalesce(F.lead(leaf).over(inside), "after").alias("z"))
    sides = [F.when(F.col(f"{c}.g") == F.col("g"), F.col(f"{c}.s")) for c in "az"]
    near = near.select("g", "s", "several", F.col("s").alias("x0"), sides[0].alias("x1"), F.col("s").alias("y0"), sides[1].alias("y1"))
    best = F.when(F.col("several"), F.length("s")).otherwise(F.greatest("x", "y"))
    best = materialize(near.mapInArrow(_pairs, "g long, s binary, several boolean, x int, y int").select("g", "s", best.alias("best")))
    return own.join(best, ["g", "s"]).select("g", "h", "hh", "best")


class _Found(NamedTuple):
    """What the anchors have shown: all repeated ones (th, len, pos, right, h, hh), their classes of equal contexts (h, hh, n, one),
    and the contexts to compare, in bounded groups (g, h, hh, lo, ctx), with the large groups that repeat as a whole, if any."""

    anchors: DataFrame
    classes: DataFrame
    rows: DataFrame
    known: DataFrame | None


def _anchored(docs: DataFrame, text: str, length: int, group: int, words: int | None, deep: bool = False) -> _Found:
    k = length // 2
    encoded = (lambda texts: [word_ids(t) for t in texts]) if words else (lambda texts: texts)
    least = words if words else length

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, k)
        for whole in batches:
            for b in slices(whole, "text"):
                texts = encoded(as_bytes(b.column(2)))
                which, pos = [], []
                for i, a in anchors(texts):
                    which.append(i)
                    pos.append(a)
                h = [xxhash.xxh64_intdigest(texts[i][a : a + k]) for i, a in zip(which, pos, strict=True)]
                hh = [xxhash.xxh64_intdigest(texts[i][max(0, a - k) : a + length], min(a, k)) for i, a in zip(which, pos, strict=True)]
                at = pa.array(which, pa.int64())
                right = pa.array([min(len(texts[i]) - a, length) for i, a in zip(which, pos, strict=True)], pa.int32())
                cols = [b.column(0).take(at), b.column(1).take(at), pa.array(pos, pa.int64()), right, *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (h, hh))]
                yield pa.RecordBatch.from_arrays(cols, ["th", "len", "pos", "right", "h", "hh"])

    d = docs.select(*_identity(F.col(text)), F.col(text).alias("text"))
    every = materialize(d.where(F.col("len") >= least).mapInArrow(find, "th long, len long, pos long, right int, h long, hh long"))
    # What an aggregate has to be joined to is written first: joins of plain tables are split where a key is hot.
    twice = materialize(every.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("h"))
    found = materialize(every.join(twice, "h", "left_semi"))
    discard(every, twice)
    # Anchors with equal contexts are one class, a leaf of the tree: a class of several repeats its whole context.
    classes = materialize(found.groupBy("h", "hh").agg(F.count("*").alias("n"), F.min(F.struct("th", "len", "pos")).alias("one")))
    mixed = materialize(classes.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > 1).select("h"))
    wanted = materialize(classes.join(mixed, "h", "left_semi").select("h", "hh", "one.th", "one.len", "one.pos"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                texts = encoded(as_bytes(b.column(0)))
                h, hh, lo, ctx = [], [], [], []
                for t, want in zip(texts, b.column(1).to_pylist(), strict=True):
                    for w in want:
                        h.append(w["h"])
                        hh.append(w["hh"])
                        lo.append(min(w["pos"], k))
                        ctx.append(t[max(0, w["pos"] - k) : w["pos"] + length])
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(hh, pa.int64()), pa.array(lo, pa.int32()), pa.array(ctx, pa.binary())], ["h", "hh", "lo", "ctx"])

    per_text = materialize(wanted.groupBy("th", "len").agg(F.collect_list(F.struct("h", "hh", "pos")).alias("want")))
    contexts = d.join(per_text, ["th", "len"]).select("text", "want").mapInArrow(cut, "h long, hh long, lo int, ctx binary")
    contexts = materialize(contexts.groupBy("h", "hh").agg(F.first("lo").alias("lo"), F.first("ctx").alias("ctx")))
    discard(mixed, wanted, per_text)
    return _Found(found, classes, *_hot(contexts, length, group, deep))


def _compared(rows: DataFrame, compare: Callable[[list[tuple[int, int, int, bytes]]], pa.RecordBatch], schema: str) -> DataFrame:
    """compare() of the contexts (h, hh, lo, ctx) of each group of rows; one that is there several times counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, int, int, bytes]] = {}
        key = None
        for b in batches:
            for g, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != key:
                    if len(held) > 1:
                        yield compare(list(held.values()))
                    held, key = {}, g
                held[row[0], row[1]] = tuple(row)
        if len(held) > 1:
            yield compare(list(held.values()))

    return rows.select("g", "h", "hh", "lo", "ctx").repartition("g").sortWithinPartitions("g").mapInArrow(run, schema)


def repeats(docs: DataFrame, text: str = "text", length: int = 400, group: int = GROUP, words: int | None = None) -> DataFrame:
    """(th, len, spans): for each distinct text (by hash and length) with repeats, the ARRAY<STRUCT<start, end>> of byte runs to remove.

    Matches lie within one text each; strings overlap freely; the other occurrence may be in the same text.
    words: repeats of so many words instead of `length` bytes; the runs are then in word_ids of the text.
    """
    length = WIDTH * words if words else length
    got = _anchored(docs, text, length, group, words)

    def compare(members: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        reach = extents([c[:lo][::-1] for _, _, lo, c in members], [c[lo:] for _, _, lo, c in members], length)
        found = [(m[0], m[1], *r) for m, r in zip(members, reach, strict=True) if r]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["h", "hh", "left", "right"])

    reach = _compared(got.rows, compare, "h long, hh long, left int, right int")
    if got.known is not None:
        # A window that goes beyond what such a group shares on one side is within it on the other, so the sides are independent.
        left = _nearest(got.known, _backwards(F.substring(F.col("ctx"), F.lit(1), F.col("lo"))))
        right = _nearest(got.known, F.substring(F.col("ctx"), F.col("lo") + 1, F.length("ctx")))
        reach = reach.unionByName(left.select("h", "hh", F.floor(F.col("best") / 2).cast("int").alias("left"), F.lit(None).cast("int").alias("right")))
        reach = reach.unionByName(right.select("h", "hh", F.lit(None).cast("int").alias("left"), F.col("best").alias("right")))
    reach = materialize(reach.groupBy("h", "hh").agg(F.max("left").alias("left"), F.max("right").alias("right")))
    alone = got.classes.where("n = 1").join(reach, ["h", "hh"]).select("one.*", "left", "right")
    leaf = F.least(F.col("pos"), F.lit(length // 2)).cast("int")
    both = got.anchors.join(got.classes.where("n > 1").select("h", "hh"), ["h", "hh"], "left_semi").select("th", "len", "pos", leaf.alias("left"), "right")
    span = F.struct((F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end"))
    every = both.unionByName(alone).select("th", "len", span.alias("span")).distinct()
    out = materialize(every.groupBy("th", "len").agg(F.array_sort(F.collect_list("span")).alias("spans")))
    discard(got.anchors, got.classes, reach)
    return out


def repeat_groups(docs: DataFrame, text: str = "text", length: int = 400, group: int = GROUP) -> DataFrame:
    """(repeat, th, len, start, end): the maximal repeats of at least `length` bytes with all their occurrences, for distinct texts th, len.

    A repeat is looked for in contexts of length / 2 bytes before an anchor and `length` from it on, so a longer one is a chain of
    overlapping repeats, one for each of its anchors. Null and short texts have none; an occurrence in a repeated row counts once, and
    what only whole copies of one text repeat is not listed; no rows: none.
    """
    got = _anchored(docs.dropDuplicates([text]), text, length, group, None, deep=True)
    of = "repeat long, h long, hh long, left int, right int"

    def compare(members: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        out = []
        for left, right, inside in groups([c[:lo][::-1] for _, _, lo, c in members], [c[lo:] for _, _, lo, c in members], length):
            _, _, lo, c = members[inside[0]]
            name = np.uint64(xxhash.xxh64_intdigest(c[lo - left : lo + right], left)).astype(np.int64)
            out += [(int(name), members[i][0], members[i][1], left, right) for i in inside]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], [f.split()[0] for f in of.split(", ")])

    found = _compared(got.rows, compare, of)
    if got.known is not None:
        piece = F.substring(F.col("ctx"), F.col("lo") - F.col("left") + 1, F.col("left") + F.col("right"))
        found = found.unionByName(got.known.select(F.xxhash64("left", piece).alias("repeat"), "h", "hh", "left", "right"))
    found = materialize(found.distinct())
    leaf = got.classes.where("n > 1").select(F.xxhash64("h", "hh").alias("repeat"), "h", "hh", F.lit(None).cast("int").alias("left"), F.lit(None).cast("int").alias("_right"))
    every = found.withColumnRenamed("right", "_right").unionByName(leaf).join(got.anchors, ["h", "hh"])
    left, right = F.coalesce("left", F.least(F.col("pos"), F.lit(length // 2)).cast("int")), F.coalesce("_right", "right")
    return every.select("repeat", "th", "len", (F.col("pos") - left).alias("start"), (F.col("pos") + right).alias("end"))


def remove(docs: DataFrame, text: str = "text", length: int = 400, group: int = GROUP, words: int | None = None) -> DataFrame:
    """Append kept (BINARY: the text without its repeats), n_bytes, n_removed and n_spans to all rows and columns of docs.

    Every occurrence of a repeat goes, the first included, judged on the input. Null text: empty. Texts shorter than `length` stay
    whole; an exact copy of a longer text goes whole, wherever it stands; repeated rows are copies; columns named like the new ones are
    replaced; no rows: none. words: repeats of so many words go instead, whatever their bytes and the white space between them.
    """
    new = ["kept", "n_bytes", "n_removed", "n_spans"]
    docs = docs.drop(*(c for c in new if c != text and c in docs.columns))
    spans = repeats(docs, text, length, group, words)
    th, size = _identity(F.col(text))
    keyed = docs.withColumns({"_th": th, "_len": size})
    joined = keyed.join(spans, (keyed._th == spans.th) & (keyed._len == spans.len), "left").drop("_th", "_len", "th", "len")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text):
                names = b.schema.names
                kept, size, gone, runs = [], [], [], []
                for t, s in zip(as_bytes(b.column(text)), b.column("spans").to_pylist(), strict=True):
                    t = t or b""
                    rest, at, n = [], 0, 0
                    for x in _in_bytes(t, s or [], WIDTH * words) if words else s or ():
                        if x["start"] > at or not n:
                            rest.append(t[at : x["start"]])
                            n += 1
                        at = max(at, x["end"])
                    rest.append(t[at:])
                    kept.append(b"".join(rest))
                    size.append(len(t))
                    gone.append(len(t) - len(kept[-1]))
                    runs.append(n)
                cols = [b.column(c) for c in names if c != "spans"] + [pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (size, gone, runs))]
                yield pa.RecordBatch.from_arrays(cols, [c for c in names if c != "spans"] + new)

    schema = extended(docs, kept="binary", n_bytes="long", n_removed="long", n_spans="long")
    return joined.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, text: str = "text", length: int = 400, words: int | None = None) -> DataFrame:
    """docs with their repeats taken out of the text (bytes of a cut character go too) and n_chars, if there is one, counted anew."""
    names = docs.columns
    out = remove(docs.select("*", F.lit(0).alias("_mark")), text, length, words=words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [k.decode("utf-8", "ignore") if t else None for t, k in zip(b.column(text).is_valid().to_pylist(), b.column("kept").to_pylist(), strict=True)]
            cols = [pa.array(whole, pa.string()) if c == text else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    out = out.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out

