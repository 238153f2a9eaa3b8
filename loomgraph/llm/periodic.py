"""Runs of words that repeat with a period, found by matching aligned power-of-two blocks.

A run of period q is a stretch of words in which words q apart are equal, that no neighbouring word extends, and that is at least
4 q and 6 words long. With b the largest power of two up to q, such a run holds a block of b words that starts at a multiple of b, and
the same b words q places on. So for each b the aligned blocks are the keys of an automaton over word numbers that searches the
document; an occurrence b to 2 b - 1 words after its block seeds an exact extension to both sides.

Blocks that can't seed a run are left out before: each word of a run but those of its last period is followed by itself within q words, so
a block counts only if all its words come again within 2 b - 1 words and enough such words stand side by side. A seed inside a run of a
smaller period is a multiple of it and says nothing new. So prose costs hardly any search, and one word a million times one extension.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extended

#: Least words and periods of a run.
LEAST_WORDS, LEAST_PERIODS = 6, 4

Run = tuple[int, int, int]


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal words sharing one."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _gaps(ids: np.ndarray) -> np.ndarray:
    """Words from each word to its next occurrence; the document's length where there is none."""
    order = np.argsort(ids, kind="stable")
    gap = np.full(len(ids), len(ids), np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def _streaks(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of set flags."""
    edge = np.diff(np.concatenate(([0], flag.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _matched(a: np.ndarray, b: np.ndarray) -> int:
    """Equal leading words of two arrays, compared in pieces that double."""
    n, at, size = min(len(a), len(b)), 0, 32
    while at < n:
        differ = a[at : at + size] != b[at : at + size] if at + size <= n else a[at:n] != b[at:n]
        if differ.any():
            return at + int(differ.argmax())
        at, size = at + size, size * 2
    return n


def _fingerprints(ids: np.ndarray) -> Callable[[np.ndarray, np.ndarray | int], np.ndarray]:
    """A function of places and a width: polynomial fingerprints of as many words from each place on."""
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        up = np.cumprod(np.append(np.uint64(1), np.full(len(ids), base)))
        down = np.cumprod(np.append(np.uint64(1), np.full(len(ids), np.uint64(pow(int(base), -1, 1 << 64)))))
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        total = np.append(np.uint64(0), np.cumsum(mixed * up[:-1]))
    return lambda at, width: (total[at + width] - total[at]) * down[at]


def _repeating(gap: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that come again within 2 b - 1 words, as long as a run's words but its last period."""
    low, high = _streaks(gap < 2 * b)
    long = high - low >= max((LEAST_PERIODS - 1) * b, LEAST_WORDS - 1 if b == 1 else 0)
    return low[long], high[long]


def _seeds(ids: np.ndarray, streaks: tuple[np.ndarray, np.ndarray], b: int, period: np.ndarray, end: np.ndarray, print_of: Callable[[np.ndarray, np.ndarray | int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of aligned blocks of b words, and distances of b to 2 b - 1 at which they come again, but for those inside a run of a smaller period.

    streaks: stretches of words that come again soon, in which blocks count. period, end: for each aligned block, the known run that holds 2 b words from its start on (0: none). A key names a block's two halves by
    numbers, so the automaton stays two steps deep: full sequences of b words that repeat within themselves would make its search quadratic.
    Numbers stand for fingerprints: of two that share one by chance the extension finds no equal words.
    """
    low, high = streaks
    step = np.zeros(len(period) + 1, np.int64)
    np.add.at(step, -(-low // b), 1)
    np.add.at(step, np.maximum(high // b, -(-low // b)), -1)
    todo = np.cumsum(step[:-1]) > 0
    todo &= np.arange(len(period)) * b + 3 * b - 1 > end  # else all that it seeds lies inside that run
    half = max(1, b // 2)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for first, last in zip(*(x.tolist() for x in _streaks(todo)), strict=True):
        low, high = first * b, min(len(ids), (last + 2) * b - 1)
        names = np.unique(print_of(np.arange(low, high + 1 - half), half), return_inverse=True)[1]
        keys = names[: (last - first) * b : half].reshape(-1, b // half)  # of the aligned blocks, a row each
        kinds, block = np.unique(keys, axis=0, return_inverse=True)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, key in enumerate(kinds.tolist()):
            automaton.add_word(tuple(key), i)
        automaton.make_automaton()
        # the document from the first block on, once for each shift of up to half a block, as names half a block apart; a name of its own parts the shifts
        apart = names.max() + 1
        rows = -(-len(names) // half)
        shifts = np.full((half, rows + 1), apart)
        shifts[:, :rows] = np.append(names, np.full(rows * half - len(names), apart)).reshape(rows, half).T
        hits = np.fromiter((x for hit in automaton.iter(tuple(shifts.ravel().tolist())) for x in hit), np.int64).reshape(-1, 2)
        shift, row = np.divmod(hits[:, 0], rows + 1)
        at = low + (row - b // half + 1) * half + shift
        home = at // b - 1  # the one block of which this place is at a distance of b to 2 b - 1
        ok = (home >= first) & (home < last)
        at, home, key = at[ok], home[ok], hits[ok, 1]
        ok = block[home - first] == key
        found.append((home[ok], at[ok] - home[ok] * b))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    home, distance = (np.concatenate(x) for x in zip(*found, strict=True))
    q = period[home]
    new = (q == 0) | (distance % np.maximum(q, 1) != 0) | (home * b + distance + b > end[home])
    return _promising(home[new] * b, distance[new], print_of, len(ids))


def _promising(at: np.ndarray, d: np.ndarray, print_of: Callable[[np.ndarray, np.ndarray | int], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of which half a run's words or more, the last period aside, follow or precede by fingerprints."""
    least = (np.maximum(LEAST_WORDS - d, (LEAST_PERIODS - 1) * d) + 1) // 2
    after, before = at + d + least <= n, at >= least
    i = np.flatnonzero(after)
    after[i] = print_of(at[i], least[i]) == print_of(at[i] + d[i], least[i])
    i = np.flatnonzero(before)
    before[i] = print_of(at[i] - least[i], least[i]) == print_of(at[i] - least[i] + d[i], least[i])
    ok = after | before
    return at[ok], d[ok]


def find_runs(ids: np.ndarray) -> list[Run]:
    """(start, length, period) of all runs of a sequence of word numbers, by start and then period."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    gap = _gaps(ids)
    low, high = _streaks(gap < n)
    longest = int((high - low).max(initial=0))
    found: dict[tuple[int, int], int] = {}  # start and end of a stretch: its smallest period
    print_of = None
    for b in (1 << k for k in range(longest.bit_length()) if (LEAST_PERIODS - 1) << k <= longest):
        streaks = _repeating(gap, b)
        if not len(streaks[0]):
            continue
        print_of = print_of or _fingerprints(ids)
        # for each aligned block, the run of a smaller period that holds 2 b words from its start on: there is one at most
        period, end = np.zeros(n // b + 1, np.int64), np.zeros(n // b + 1, np.int64)
        for (s, e), q in found.items():
            if e - s >= 2 * b:
                inside = slice(-(-s // b), (e - 2 * b) // b + 1)
                period[inside], end[inside] = q, e
        at, distance = _seeds(ids, streaks, b, period, end, print_of)
        order = np.lexsort((at, distance))
        at, distance = at[order], distance[order]
        i = 0
        while i < len(at):
            a, d = int(at[i]), int(distance[i])
            right = a + _matched(ids[a:], ids[a + d :])
            if right < a + b:
                i += 1
                continue
            left = a - _matched(ids[:a][::-1], ids[: a + d][::-1])
            if right + d - left >= max(LEAST_WORDS, LEAST_PERIODS * d):
                found.setdefault((left, right + d), d)
            last = int(np.searchsorted(distance, d, "right"))
            i += int(np.searchsorted(at[i:last], right))  # what follows at this distance and lies in the stretch seeds the same
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Flags of n words: all but those that a run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) == 0


def split(text: str | None) -> list[bytes]:
    """The words of a text (null: none): bytes are split at ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def without_repeats(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by a space, of every run only its first period."""
    return b" ".join(compress(words, kept_words(len(words), runs)) if runs else words)


def repeated_from(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as they are, or for the tenth of the documents that its id's checksum chooses, repeated with a period from a place on."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _judged(batches: Iterator[pa.RecordBatch], rewrite: Callable[[list[bytes], int | None], list[bytes]] | None, whole: bool) -> Iterator[pa.RecordBatch]:
    """Figures of batches of an id and a text."""
    for b in batches:
        tops, numbers, listed, digests, collapsed = [], [], [], [], []
        for key, text in zip(b.column(0), b.column(1), strict=True):
            words = split(text.as_py())
            words = rewrite(words, key.as_py()) if rewrite else words
            runs = find_runs(numbered(words))
            top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
            tops.append((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
            numbers.append(len(runs))
            listed.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            digests.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest())
            collapsed.append(without_repeats(words, runs))
        longest = [pa.array(c, pa.int64()) for c in zip(*tops, strict=True)] if tops else [pa.array([], pa.int64())] * 4
        out = [b.column(0), pa.array(numbers, pa.int64()), *longest, pa.array(digests, pa.string()), pa.array([hashlib.sha256(c).hexdigest() for c in collapsed], pa.string())]
        names = [b.schema.names[0], *FIGURES]
        if whole:
            out += [pa.array(listed, _RUN), pa.array([c.decode("utf-8", "surrogatepass") for c in collapsed], pa.string())]
            names += ["runs", "collapsed"]
        yield pa.RecordBatch.from_arrays(out, names)


FIGURES = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string"}


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[list[bytes], int | None], list[bytes]] | None = None, whole: bool = False) -> DataFrame:
    """id_col, and of each text's runs: their number, the longest (ties: the first, then the smallest period), and digests of the runs and the collapsed text.

    `rewrite` may change a document's words first; whole=True adds `runs` (start, length, period) and `collapsed`, the words that no run holds
    after its first period, joined by a space. Null, empty and blank texts have no runs and an empty collapsed text; rows with a null or
    repeated id stay as they are; other columns of docs, whatever their names, aren't carried. No shuffle; a task holds one text and a few numbers for each of its words.
    """
    given = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("_text"))
    more = {"runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"} if whole else {}
    return given.mapInArrow(lambda b: _judged(b, rewrite, whole), extended(given.select(id_col), **FIGURES, **more))


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `text_col` collapsed: of every run only its first period stays, words joined by a space. A text without runs stays as it is, null too."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text in b.column(at).to_pylist():
                words = split(text)
                runs = find_runs(numbered(words))
                texts.append(without_repeats(words, runs).decode("utf-8", "surrogatepass") if runs else text)
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.column(at).type))

    return docs.mapInArrow(run, docs.schema)
