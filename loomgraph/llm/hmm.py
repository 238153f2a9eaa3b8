"""Hidden Markov language model: Baum-Welch over all training documents, exact likelihood by the scaled forward recursion.

A state emits a word's class; within its class a word has its share of the smoothed corpus frequency, whatever the state. The most
frequent words and the end of a document are classes of their own, other words share classes by hash. So the model that every task
needs has a fixed size, while the word counts, which grow with the corpus, stay in a table that is joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .wordtable import as_bytes

#: The end of a document as a word: no word holds a space.
END = " "
#: Classes of single words (the first is the end), classes by hash, and words whose counts every task holds.
OWN, HASHED, HELD = 4096, 4096, 200_000
CLASSES = OWN + HASHED
#: Words of a text that are worked on at once in training; messages between the pieces keep the counts those of the whole text.
SEGMENT = 1024


def count_words(docs: DataFrame, text: str, most: int = 400_000) -> DataFrame:
    """(word, n): how often each word and the end occur. Counts are summed in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for t in as_bytes(b.column(0)):
                if t:
                    seen.update(t.lower().split())
                seen[END.encode()] += 1
                if len(seen) > most:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """The most frequent words, as many steps of the frequency scale as hold no more than `most` words together."""
    step = F.floor(F.log2("n") * 8)
    held, least = 0, None
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # some hundred steps
        held += r["count"]
        if held > most:
            break
        least = r["step"]
    return counts.where(step >= least if least is not None else F.lit(False)).toPandas()


def _hashed(word: bytes) -> int:
    return OWN + xxhash.xxh64_intdigest(word, 42) % HASHED


class _Words(dict):
    """Word -> number; class_of and weight hold a class and a log10 frequency (nan: not held) by number."""

    def __init__(self, held: list[str], weight: np.ndarray, own: dict[str, int]):
        super().__init__((w.encode(), i) for i, w in enumerate(held))
        self.kept, self.words = len(held), [w.encode() for w in held]
        self.classes = [own.get(w, -1) for w in held]
        self.classes = [c if c >= 0 else _hashed(w) for c, w in zip(self.classes, self.words, strict=True)]
        self.weight = weight

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        self.classes.append(_hashed(word))
        return n

    def trim(self) -> None:
        if len(self.words) > self.kept + 600_000:
            for w in self.words[self.kept :]:
                del self[w]
            del self.words[self.kept :], self.classes[self.kept :]


def _sequences(docs: DataFrame, held: list[str], weight: np.ndarray, own: dict[str, int]) -> DataFrame:
    """docs: doc_id, held_out, text -> row, doc_id, held_out, n_tokens, n_held, base (of held words), classes (16-bit), rare, times."""
    shared = docs.sparkSession.sparkContext.broadcast((held, weight, own))
    fields = "doc_id:long,held_out:boolean,n_tokens:long,n_held:long,base:double,classes:binary,rare:array<string>,times:array<int>"
    kinds = dict(f.split(":") for f in fields.split(",")) | {"doc_id": docs.schema["doc_id"].dataType.simpleString()}
    schema = T._parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Words(*shared.value)
        end = np.array([table[END.encode()]])
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                table.trim()
                texts = as_bytes(b.column(2))
                ids = [np.concatenate([np.fromiter(map(table.__getitem__, t.lower().split()), np.int64), end]) if t else end for t in texts]
                classes = np.array(table.classes, np.uint16)
                n_held, base, rare, times = [], [], [], []
                for x in ids:
                    own_words = x < table.kept
                    n_held.append(int(own_words.sum()))
                    base.append(float(table.weight[x[own_words]].sum()))
                    far, k = np.unique(x[~own_words], return_counts=True)
                    rare.append([table.words[i] for i in far])
                    times.append(k.astype(np.int32))
                cols = [
                    b.column(0), b.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array(n_held, pa.int64()), pa.array(base, pa.float64()),
                    pa.array([classes[x].tobytes() for x in ids], pa.binary()), pa.array(rare, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


class Model:
    """start (S), move (S, S), emit (S, CLASSES) and the classes' own frequencies (CLASSES)."""

    def __init__(self, frequency: np.ndarray, states: int, seed: int = 11, stay: float = 0.95):
        rng = np.random.default_rng(seed)
        self.frequency = frequency
        self.start = np.full(states, 1 / states)
        self.move = np.full((states, states), (1 - stay) / max(states - 1, 1))
        np.fill_diagonal(self.move, stay if states > 1 else 1.0)
        emit = frequency * rng.uniform(0.5, 1.5, (states, len(frequency)))
        self.emit = emit / emit.sum(axis=1, keepdims=True)

    def ratios(self) -> np.ndarray:
        """(CLASSES, S): a state's probability of a class over the class's own frequency."""
        return np.ascontiguousarray((self.emit / self.frequency).T)

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: float = 100.0) -> None:
        """The counts' estimate, drawn to the corpus frequency by `prior` words a state."""
        self.start = (start + 1) / (start + 1).sum()
        self.move = (move + 1) / (move + 1).sum(axis=1, keepdims=True)
        emit = emit + prior * self.frequency
        self.emit = emit / emit.sum(axis=1, keepdims=True)


def _messages(segments: list[np.ndarray], doc: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each segment of a cut text is told: how likely its first state is by what lies before, the state just before it (0 for a
    first segment), and how likely all that comes after is by its last state. Segments of a text follow each other; doc numbers the texts.

    A segment is a product of S x S matrices, made for all segments side by side; the messages go through these products.
    """
    start, move, ratio = model
    n, s = len(segments), len(start)
    lens = np.array([len(x) for x in segments])
    order = np.argsort(-lens, kind="stable")
    flat, at = np.concatenate(segments).astype(np.int64), (np.cumsum(lens) - lens)[order]
    through = np.repeat(np.eye(s)[None], n, axis=0)
    for t, k in enumerate(np.searchsorted(-lens[order], -np.arange(lens.max()), side="left")):
        e = ratio[flat[at[:k] + t]]
        now = through[:k] if not t else (through[:k].reshape(-1, s) @ move).reshape(k, s, s)
        through[:k] = now * e[:, None, :]
        if t % 4 == 3:
            through[:k] /= through[:k].sum(axis=(1, 2), keepdims=True)
    product = np.empty_like(through)
    product[order] = through / through.sum(axis=(1, 2), keepdims=True)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    count = np.diff(np.append(first, n))
    ahead, before, behind = np.tile(start, (n, 1)), np.zeros((n, s)), np.ones((n, s))
    for k in range(1, count.max()):
        own = first[count > k] + k
        end = np.einsum("ni,nij->nj", ahead[own - 1], product[own - 1])
        before[own] = end / end.sum(axis=1, keepdims=True)
        ahead[own] = before[own] @ move
        own = (first + count)[count > k] - k
        back = np.einsum("nij,nj->ni", product[own], behind[own]) @ move.T
        behind[own - 1] = back / back.sum(axis=1, keepdims=True)
    return ahead, before, behind


def expect(docs: list[np.ndarray], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions (S, CLASSES) of whole class sequences, by forward and backward passes.

    Long sequences are worked on in segments, which changes no count: only a text's first word is a start, and moves from one segment
    to the next are counted.
    """
    start, move, ratio = model
    s = len(start)
    starts, moves, emits = np.zeros(s), np.zeros((s, s)), np.zeros((s, CLASSES))
    parts = [x[i : i + SEGMENT] for x in docs for i in range(0, len(x), SEGMENT)]
    doc = np.repeat(np.arange(len(docs)), [-(-len(x) // SEGMENT) for x in docs])
    if not parts:
        return starts, moves, emits
    n = len(parts)
    ahead, before, behind = np.tile(start, (n, 1)), np.zeros((n, s)), np.ones((n, s))
    cut = np.flatnonzero(np.bincount(doc)[doc] > 1)
    if len(cut):
        ahead[cut], before[cut], behind[cut] = _messages([parts[i] for i in cut], doc[cut], model)
    head = np.concatenate([[True], doc[1:] != doc[:-1]])
    lens = np.array([len(x) for x in parts])
    order = np.argsort(-lens, kind="stable")
    parts, lens, ahead, before, behind, head = [parts[i] for i in order], lens[order], ahead[order], before[order], behind[order], head[order]
    active = np.searchsorted(-lens, -np.arange(lens[0]), side="left")
    offset = np.cumsum(active) - active
    o = np.empty(lens.sum(), np.int32)  # step by step, the segments side by side
    for j, x in enumerate(parts):
        o[offset[: len(x)] + j] = x
    alpha, scale = np.empty((len(o), s)), np.empty(len(o))
    for t, k in enumerate(active):
        now = slice(offset[t], offset[t] + k)
        a = (ahead if not t else alpha[offset[t - 1] : offset[t - 1] + k] @ move) * ratio[o[now]]
        scale[now] = a.sum(axis=1)
        alpha[now] = a / scale[now, None]
    later = None
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        now = slice(offset[t], offset[t] + k)
        m = 0 if later is None else len(later)
        if m:
            moves += alpha[offset[t] : offset[t] + m].T @ later
        beta = np.empty((k, s))
        if m:
            beta[:m] = later @ move.T
        if k > m:  # these segments end here
            beta[m:] = behind[m:k] / (alpha[offset[t] + m : offset[t] + k] * behind[m:k]).sum(axis=1, keepdims=True)
        later = beta * ratio[o[now]] / scale[now, None]
        alpha[now] *= beta  # from here on: how likely each state is
    moves += before.T @ later
    starts += alpha[: active[0]][head].sum(axis=0)
    for i in range(s):
        emits[i] = np.bincount(o, weights=alpha[:, i], minlength=CLASSES)
    return starts, moves * move, emits


def forward(docs: list[np.ndarray], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of how much likelier each class sequence is than by the classes' own frequencies: exact, over whole sequences."""
    start, move, ratio = model
    out = np.zeros(len(docs))
    lens = np.array([len(x) for x in docs], np.int64)
    order = np.argsort(-lens, kind="stable")
    for i in range(0, len(order), 1024):
        part = order[i : i + 1024]
        n = lens[part]
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        flat = np.concatenate([docs[j] for j in part]).astype(np.int64)
        active = np.searchsorted(-n, -np.arange(n[0]), side="left")
        total, a = np.zeros(len(part)), None
        for t, k in enumerate(active):
            e = ratio[flat[at[:k] + t]]
            a = start * e if a is None else (a[:k] @ move) * e
            scale = a.sum(axis=1)
            a /= scale[:, None]
            total[:k] += np.log10(scale)
        out[part] = total
    return out


def _counts(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round of Baum-Welch counts: summed in each task, then across tasks by the place in the model."""
    s, shared = len(model.start), (model.start, model.move, model.ratios())
    sent = rows.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, held, size = sent.value, [np.zeros(s), np.zeros((s, s)), np.zeros((s, CLASSES))], [], 0
        for b in batches:
            for raw in b.column(0).to_pylist():
                held.append(np.frombuffer(raw, np.uint16))
                size += len(held[-1])
                if size > 1 << 20:
                    sums = [a + c for a, c in zip(sums, expect(held, known), strict=True)]
                    held, size = [], 0
        if held:
            sums = [a + c for a, c in zip(sums, expect(held, known), strict=True)]
        flat = np.concatenate([x.ravel() for x in sums])
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(flat[used])], ["at", "n"])

    got = rows.select("classes").mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(s + s * s + s * CLASSES)
    flat[got["at"]] = got["n"]
    sent.unpersist()
    return flat[:s], flat[s : s + s * s].reshape(s, s), flat[s + s * s :].reshape(s, CLASSES)


def score(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", states: int = 6, rounds: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document, learning from those not held out.

    Tokens are the A-Z lower-cased words and one end. base_score: by smoothed word counts; score: log10 of the text's probability
    under the model, base_score plus the forward recursion's gain. Word counts and Baum-Welch counts cover all training texts whole.
    Null or blank text: the end alone; repeated rows are learnt from and scored each; no training documents: N and V are 0 and score is
    base_score; no rows: none. Further columns are not read.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    counts = materialize(count_words(d.where(~F.col("held_out")), "text"))
    n, v = counts.agg(F.sum("n"), F.count("*")).first()
    n, v = n or 0, v or 0
    whole = n + 0.5 * (v + 1)
    top = _frequent(counts, HELD).sort_values(["n", "word"], ascending=[False, True])
    held, times = top["word"].tolist(), top["n"].to_numpy(np.float64)
    if END not in held:
        held, times = [*held, END], np.append(times, 0.0 if not n else counts.where(F.col("word") == END).first()["n"])
    own = {END: 0} | {w: i + 1 for i, w in enumerate([w for w in held if w != END][: OWN - 1])}
    rows = materialize(_sequences(d, held, np.log10((times + 0.5) / whole), own))
    # The classes' frequencies: those of single words are at hand, the others are summed by hash.
    mass = np.full(CLASSES, 0.5 / whole)
    for w, k in zip(held, times, strict=True):
        if w in own:
            mass[own[w]] = (k + 0.5) / whole
    names = counts.sparkSession.createDataFrame([(w,) for w in own], "word string")
    by_hash = counts.join(names, "word", "left_anti").groupBy(F.pmod(F.xxhash64("word"), F.lit(HASHED)).alias("at")).agg(F.sum(F.col("n") + 0.5).alias("n"))
    for r in by_hash.collect():  # at most HASHED rows
        mass[OWN + r["at"]] = r["n"] / whole
    excess = float(np.log10(mass.sum()))  # the smoothed frequencies of all classes are a little over 1
    model = Model(mass / mass.sum(), states)
    if n:
        train = rows.where(~F.col("held_out"))
        for _ in range(rounds):
            model.update(*_counts(train, model))
    sent = docs.sparkSession.sparkContext.broadcast((model.start, model.move, model.ratios()) if n else None)

    def gain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [np.frombuffer(x, np.uint16) for x in b.column(b.schema.names.index("classes")).to_pylist()]
            more = forward(texts, sent.value) - excess * np.array([len(x) for x in texts]) if sent.value and texts else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(more)], [*b.schema.names[:-1], "gain"])

    few = ["row", "doc_id", "held_out", "n_tokens", "n_held", "base"]
    schema = T.StructType([*(rows.schema[c] for c in few), T.StructField("gain", T.DoubleType())])
    gained = rows.select(*few, "classes").mapInArrow(gain, schema)
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    found = rare.join(counts, "word", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(whole))
    sums = found.groupBy("row").agg(F.sum(F.col("k") * log).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("known"))
    out = gained.join(sums, "row", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0))
    known = (F.col("n_held") if n else F.lit(0)) + F.coalesce("known", F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))


