"""BPE encoding and decoding by a prefix-sharing trie traversal.

The distinct words of a batch are put in a trie. A depth-first walk gives every node the last token of the encoding of
its prefix: the one token t that ends there such that t may follow the last token of the prefix that t leaves. Two
tokens may stand side by side exactly if merging their joined symbols gives the two of them again; the encoding of a
text is the only sequence of tokens in which all neighbours may stand side by side, and each of its prefixes at a
token's end is the encoding of that prefix. So the work for a shared prefix is done once, whatever the words below it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .wordtable import PieceTable, default_vocabulary, slices, tokenizer

_END = "</w>"


class TrieEncoder:
    """Encodes byte-level pieces by a BPE vocabulary file that marks word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # merged token: rank, left and right part
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right, both = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault((left, right), r)
            self.parts.setdefault(both, (r, left, right))
        self.width = {i: len(t.removesuffix(_END)) or len(t) for t, i in self.vocab.items()}
        #: All ends of tokens, those of tokens at a word's end apart: a longer candidate is only looked for while one exists.
        self.tails: tuple[set[str], set[str]] = (set(), set())
        for t in self.vocab:
            end = t.endswith(_END) and t != _END
            body = t.removesuffix(_END) if end else t
            self.tails[end].update(body[i:] for i in range(len(body)))
        self.beside: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        #: Tokens that merging their own symbols gives, without and with a word end (which is left out of the key).
        ends = {t: i for t, i in self.vocab.items() if t.endswith(_END) and t != _END}
        self.middle = {t: i for t, i in self.vocab.items() if t not in ends and self._is_whole(i)}
        self.final = {t.removesuffix(_END): i for t, i in ends.items() if self._is_whole(i)}

    def _is_whole(self, t: int) -> bool:
        """Whether merging a token's own symbols gives it: its two parts are whole and may not stand side by side unmerged."""
        if (ok := self.whole.get(t)) is None:
            if t not in self.parts:
                ok = True
            else:
                rank, left, right = self.parts[t]
                ok = self._is_whole(left) and self._is_whole(right) and self._crossing(left, right) == rank
            self.whole[t] = ok
        return ok

    def _crossing(self, u: int, t: int) -> int:
        """The rank of the first merge over the border of two neighbouring tokens; -1 if there is none.

        The border's neighbours are looked at in the order of merging, backwards: of the two, the one made last is undone.
        A merge over the border happens while both its parts stand there, that is before the part next in line is made;
        with equal ranks the left one is made first.
        """
        parts, found, made = self.parts, -1, (1 << 30, 0)
        while True:
            r = self.rank.get((u, t))
            if r is not None and (r, 1) < made:
                found = r
            a, b = parts.get(u, (-1,))[0], parts.get(t, (-1,))[0]
            if a < 0 and b < 0:
                return found
            if a > b:
                made, u = (a, 0), parts[u][2]
            else:
                made, t = (b, 2), parts[t][1]

    def _may_follow(self, u: int, t: int) -> bool:
        key = u << 20 | t
        if (ok := self.beside.get(key)) is None:
            if len(self.beside) > 300_000:
                self.beside.clear()
            ok = self.beside[key] = self._crossing(u, t) < 0
        return ok

    def _last(self, prefix: str, k: int, tokens: dict[str, int], last: list[int]) -> int:
        """The longest fitting token of at most k symbols at the end of prefix; last[d]: the last token of its first d symbols."""
        n, known = len(prefix), self.beside
        for k in range(k, 0, -1):
            t = tokens.get(prefix[n - k :])
            if t is not None and (k == n or known.get(last[n - k] << 20 | t) or self._may_follow(last[n - k], t)):
                return t
        raise ValueError(f"no token ends {prefix!r}")

    def __call__(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Ids of each piece, by a depth-first walk over their trie."""
        root: dict = {}
        for p in pieces:
            node = root
            for c in p[:-1]:
                if (child := node.get(c)) is None:
                    child = node[c] = {}
                node = child
            if None in node:
                node[None].append(p[-1])
            else:
                node[None] = [p[-1]]
        out: dict[str, tuple[int, ...]] = {}
        tails, end_tails, width = *self.tails, self.width
        last = [-1]  # last[d]: last token of the first d symbols on the way to the node
        stack: list[tuple[dict, str]] = [(root, "")]  # nodes and the symbols to them
        while stack:
            node, prefix = stack.pop()
            d = len(prefix)
            if d:
                k = 2
                while k <= d and prefix[d - k :] in tails:
                    k += 1
                k = min(k - 1, d)
                del last[d:]
                last.append(self._last(prefix, k, self.middle, last))
            for c in node.pop(None, ()):
                word, m = prefix + c, 1
                while m <= d and word[d - m :] in end_tails:
                    m += 1
                ids = [self._last(word, m, self.final, last)]
                at = d + 1 - width[ids[0]]
                while at:
                    ids.append(last[at])
                    at -= width[ids[-1]]
                out[word] = tuple(ids[::-1])
            for c, child in node.items():
                stack.append((child, prefix + c))
        return [out[p] for p in pieces]


@lru_cache(maxsize=2)
def _table(path: str) -> PieceTable:
    return PieceTable(path, TrieEncoder(path))


@lru_cache(maxsize=2)
def _token_strings(path: str) -> pa.Array:
    t = tokenizer(path)
    return pa.array([t.id_to_token(i) for i in range(t.get_vocab_size())], pa.string())


def _encoded(batches: Iterator[pa.RecordBatch], text_col: str, ids_col: str, path: str) -> Iterator[pa.RecordBatch]:
    table = _table(path)
    try:
        for whole in batches:
            for b in slices(whole, text_col, 2 << 20):
                flat, n = table.ids(b.column(text_col).to_pylist())
                at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, ids_col])
    finally:  # a worker outlives its task; only the vocabulary stays in it
        table.clear()
        table.encode.beside.clear()


def _decoded(batches: Iterator[pa.RecordBatch], ids_col: str, out_col: str, path: str) -> Iterator[pa.RecordBatch]:
    strings = _token_strings(path)
    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            b = whole.slice(i, 256)
            lists = b.column(ids_col)
            flat = pc.list_flatten(lists)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(strings)))
            if not pc.all(known).as_py() and len(flat):
                keep = known.to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(n)), n)[keep]
                n, flat = np.bincount(doc, minlength=len(n)), flat.filter(known)
            at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
            text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at), strings.take(flat)), " ")
            yield pa.RecordBatch.from_arrays([*b.columns, text.cast(pa.string())], [*b.schema.names, out_col])


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Append the token ids (ARRAY<INT>) of a text column to all columns of docs.

    A null or blank text gets an empty array; repeated rows stay repeated; an empty table stays empty; a column already
    named `ids_col` is replaced. No shuffle: every partition is encoded where it is read, in batches of bounded bytes.
    """
    path = vocabulary or default_vocabulary()
    docs = docs.drop(ids_col) if ids_col != text_col else docs
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])
    return docs.mapInArrow(lambda b: _encoded(b, text_col, ids_col, path), schema)


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Append the text that the vocabulary's library decodes from a column of ids: token strings joined by a space.

    (The vocabulary names no decoder, so word ends stay visible.) Null ids give an empty text; ids outside the vocabulary are
    left out, as the library does. A column already named `out_col` is replaced.
    """
    path = vocabulary or default_vocabulary()
    encoded = encoded.drop(out_col) if out_col != ids_col else encoded
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())])
    return encoded.mapInArrow(lambda b: _decoded(b, ids_col, out_col, path), schema)


def round_trip(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """encode() and decode() in one Python pass, so that ids aren't sent out and back between them."""
    path = vocabulary or default_vocabulary()
    docs = docs.drop(ids_col, out_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField(out_col, T.StringType())])
    return docs.mapInArrow(lambda b: _decoded(_encoded(b, text_col, ids_col, path), ids_col, out_col, path), schema)
