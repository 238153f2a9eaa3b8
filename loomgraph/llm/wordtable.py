"""Token ids of whole texts through a table of their distinct pieces.

The vocabulary's normaliser and splitter cut a text into pieces (runs of letters, single digits, runs of other characters) that
are encoded one by one, so the ids of a text are those of its pieces in order, and every distinct piece has to be encoded only once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Texts of these characters alone (printable ASCII, white space and the letters of Latin-1) are in normal form, and have single
#: lower-case letters; they are cut by the splitter's own alternatives. All others go through the library's normaliser and splitter.
_ODD = re.compile(r"[^\x09-\x0d\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]|<\|")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff\s]+")
_LETTERS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")
#: A symbol for each byte: itself if it is printable in Latin-1, else one from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SYMBOLS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - _PRINTABLE))}
#: What leads a piece that is given in symbols, and one that is a special token.
_RAW, _SPECIAL = "\0", "\1"


class _Index(dict):
    """Piece -> number; unseen pieces get the next number and are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """a, or a longer copy with room for n values."""
    return a if n <= len(a) else np.concatenate([a, np.empty(max(len(a), n - len(a)), a.dtype)])


class PieceTable:
    """Ids of texts. encode(pieces in symbols) gives the ids of pieces when first seen; beyond `limit` pieces the table is emptied."""

    def __init__(self, path: str, encode: Callable[[list[str]], Iterable[tuple[int, ...]]], limit: int = 300_000):
        self.lib, self.encode, self.limit = tokenizer(path), encode, limit
        self.special = {t.content: i for i, t in self.lib.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.flat, self.start, self.length = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.used = self.known = 0  # how much of these is filled

    def pieces(self, text: str) -> list[str]:
        if not _ODD.search(text):
            return _PIECES.findall(text.lower())
        out: list[str] = []
        for part in self.cut.split(text) if self.cut and "<|" in text else (text,):
            if part in self.special:
                out.append(_SPECIAL + part)
            elif part:
                out += [_RAW + p for p, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(part)) if p]
        return out

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        symbols = [p[1:] if p[0] == _RAW else p if p.isascii() else p.encode().decode("latin-1").translate(_SYMBOLS) for p in new if p[0] != _SPECIAL]
        got = iter(self.encode(symbols))
        ids = [(self.special[p[1:]],) if p[0] == _SPECIAL else next(got) for p in new]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        more, total = len(n), int(n.sum())
        self.start, self.length, self.flat = _room(self.start, self.known + more), _room(self.length, self.known + more), _room(self.flat, self.used + total)
        self.start[self.known : self.known + more] = self.used + np.cumsum(n) - n
        self.length[self.known : self.known + more] = n
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        self.known, self.used = self.known + more, self.used + total

    def _numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > self.limit:
            self.clear()
        look = self.index.__getitem__
        rows = [np.fromiter(map(look, p), np.int64, len(p)) for p in (self.pieces(t) if t else () for t in texts)]
        if self.index.new:
            self._learn()
        return rows

    def _spread(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.length[numbers]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[numbers] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the number of each text's ids (null: none)."""
        rows = self._numbers(texts)
        flat, n = self._spread(np.concatenate(rows) if rows else np.empty(0, np.int64))
        total = np.concatenate([[0], np.cumsum(n)])
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int64)
        return flat, total[at[1:]] - total[at[:-1]]


def library_pieces(path: str) -> Callable[[list[str]], Iterable[tuple[int, ...]]]:
    """Encode pieces by the tokenizers library: runs of letters many to a text, cut at the tokens that end a word."""
    t = tokenizer(path)
    ends = np.array([t.id_to_token(i).endswith("</w>") for i in range(t.get_vocab_size())])
    back = {v: k for k, v in _SYMBOLS.items()}

    def encode(pieces: list[str]) -> Iterable[tuple[int, ...]]:
        out: list[tuple[int, ...] | None] = [None] * len(pieces)
        easy: list[tuple[int, str]] = []
        for i, p in enumerate(pieces):
            if not p.isascii():
                try:
                    p = p.translate(back).encode("latin-1").decode()
                except UnicodeError:
                    continue
            if _LETTERS.fullmatch(p):
                easy.append((i, p))
        for i in range(0, len(easy), 2000):
            part = easy[i : i + 2000]
            ids = t.encode(" ".join([p for _, p in part]), add_special_tokens=False).ids
            cuts = [0, *(np.flatnonzero(ends[ids]) + 1).tolist()]
            for (at, _), a, b in zip(part, cuts[:-1], cuts[1:], strict=True):
                out[at] = tuple(ids[a:b])
        return [x if x is not None else tuple(y.id for y in t.model.tokenize(p)) for x, p in zip(out, pieces, strict=True)]

    return encode


@lru_cache(maxsize=2)
def library_table(path: str) -> PieceTable:
    """The process's table for a vocabulary: what one task has learnt serves the next."""
    return PieceTable(path, library_pieces(path), 1_500_000)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterable[pa.RecordBatch]:
    """Cut a batch so that each part holds about `most` bytes of a text column, or one longer text."""
    lens = np.array([len(x) if x is not None else 0 for x in as_bytes(batch.column(column))], np.int64)
    first, total = 0, 0
    for i, n in enumerate(lens):
        if i > first and total + n > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < len(lens):
        yield batch.slice(first)
