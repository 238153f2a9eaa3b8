"""Secrets in texts: patterns, and stretches of high Shannon entropy within long strings of one character class.

Built-in functions only, without a shuffle: a text's spans are found where it is read. Positions come from the pieces between the matches. A
long string is cut into pieces that overlap by a window less one character, so the fold over its characters is bounded whatever its length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: The kinds' patterns, and the least length of the whole match (access, hex: a
#: run of hex digits is long enough or isn't matched) or of its second group (assign).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{32,}"
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Characters of a window.
WINDOW = 24
#: Windows of a piece of a long string.
PIECE = 512
#: Entropies are compared as whole millionths.
UNIT = 1_000_000


@dataclass(frozen=True)
class CharacterClass:
    """Strings of `symbols` (in either case, if `fold`) in which a window with `bits` of entropy for each character or more is suspicious."""

    kind: str
    pattern: str
    symbols: str
    bits: float
    fold: bool = False

    @property
    def most(self) -> int:
        """The largest sum of c log2 c over a window's symbol counts c that still has the entropy."""
        return math.floor(UNIT * WINDOW * (math.log2(WINDOW) - self.bits))


_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharacterClass("entropy64", "[A-Za-z0-9+/=_-]", _LETTERS.upper() + _LETTERS + _DIGITS + "+/=_-", 4.0),
    CharacterClass("entropy16", "[0-9A-Fa-f]", _DIGITS + "abcdef", 3.2, True),
)
#: Strings that match one of these aren't reported: words without a digit, numbers, UUIDs, stand-ins and alphabets.
ALLOWED = (
    "^[^0-9]*$", "^[^A-Za-z]*$", "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]", "[Ss][Aa][Mm][Pp][Ll][Ee]", "[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]", "[Dd][Uu][Mm][Mm][Yy]", "[Xx]{6}", "[Aa][Bb][Cc][Dd][Ee][Ff][Gg]", "01234567",
)


def costs() -> list[int]:
    """c log2 c for the counts that a symbol has in a window, and one more."""
    return [round(UNIT * c * math.log2(c)) if c else 0 for c in range(WINDOW + 2)]


def _sums(x: Column, start: Column) -> Column:
    """For each number of a short array, start and those before it added up."""
    first = F.struct(start.alias("sum"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(x, first, lambda a, v: F.struct((a.sum + v).alias("sum"), F.concat(a.out, F.array(a.sum)).alias("out")), lambda a: a.out)


def before(x: Column, block: int = 256) -> Column:
    """For each number of an array, the sum of those before it; in blocks, as an array that grows by one is copied each time."""
    zero = F.lit(0).cast("bigint")

    def spread(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, v: a + v))
        return F.flatten(F.zip_with(parts, _sums(totals, zero), _sums))

    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(block)), lambda i: F.slice(x, i, F.lit(block)))
    return let(cut, spread)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of a pattern's leftmost non-overlapping matches, in code points, `end` exclusive; value is the given group."""
    size = lambda c: F.length(c).cast("bigint")

    def placed(found: Column) -> Column:
        def at(x: Column) -> Column:
            place = lambda m, p: F.struct((p + m.gap).alias("start"), (p + m.gap + m.size).alias("end"), m.value.alias("value"))
            return F.zip_with(x, before(F.transform(x, lambda m: m.gap + m.size)), place)

        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        sized = F.zip_with(gaps, found, lambda g, m: F.struct(size(g).alias("gap"), size(m).alias("size"), m.alias("value")))
        if group:
            sized = F.zip_with(sized, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m, v: F.struct(m.gap.alias("gap"), m["size"].alias("size"), v.alias("value")))
        return F.when(F.size(found) > 0, let(sized, at)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _hot(piece: Column, c: CharacterClass) -> Column:
    """array<struct<start, end>>: the windows of a piece that have the class's entropy, those that meet as one.

    A fold over the characters: the one that enters raises its symbol's count, the one that leaves lowers its own, and the sum of c log2 c changes by
    these two counts' shares alone.
    """
    table = F.array(*(F.lit(x).cast("bigint") for x in costs()))
    cost = lambda n: F.get(table, n)
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def walk(codes: Column) -> Column:
        start = F.struct(
            F.array_repeat(F.lit(0), len(c.symbols) + 1).alias("n"), F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("i"),
            F.lit(-1).alias("start"), F.lit(-1).alias("end"), empty.alias("out"),
        )

        def step(a: Column, new: Column) -> Column:
            old = F.when(a.i >= WINDOW, F.get(codes, a.i - WINDOW)).otherwise(F.lit(-1))

            def moved(x: Column) -> Column:
                more, less = F.get(a.n, new), F.get(a.n, x.old)
                change = cost(more + 1) - cost(more) + F.when(x.old >= 0, cost(less - 1) - cost(less)).otherwise(F.lit(0).cast("bigint"))
                return F.when(x.old == new, a["sum"]).otherwise(a["sum"] + change)

            def put(x: Column) -> Column:
                hot = (a.i >= WINDOW - 1) & (x["sum"] <= c.most)
                from_ = a.i - (WINDOW - 1)
                apart = hot & ((a.start < 0) | (from_ > a.end))
                return F.struct(
                    F.when(x.old == new, a.n).otherwise(F.transform(a.n, lambda v, k: v + (k == new).cast("int") - (k == x.old).cast("int"))).alias("n"), x["sum"].alias("sum"), (a.i + 1).alias("i"),
                    F.when(apart, from_).otherwise(a.start).alias("start"), F.when(hot, from_ + WINDOW).otherwise(a.end).alias("end"),
                    F.when(apart & (a.start >= 0), F.concat(a.out, F.array(F.struct(a.start.alias("start"), a.end.alias("end"))))).otherwise(a.out).alias("out"),
                )

            leaving = let(F.struct(old.alias("old")), lambda x: F.struct(x.old.alias("old"), moved(x).alias("sum")))
            return let(leaving, put)

        last = lambda a: F.when(a.start < 0, a.out).otherwise(F.concat(a.out, F.array(F.struct(a.start.alias("start"), a.end.alias("end")))))
        return F.aggregate(codes, start, step, last)

    return let(F.transform(F.split(piece, ""), lambda s: F.instr(F.lit(c.symbols), s)), walk)


def _merged(spans: Column) -> Column:
    """Sorted spans, those that overlap or meet as one."""

    def join(x: Column) -> Column:
        last = F.size(x) - 1
        at = F.sequence(F.lit(0), last)
        heads = F.filter(at, lambda i: (i == 0) | (F.get(x, i).start > F.get(x, i - 1).end))
        tails = F.filter(at, lambda i: (i == last) | (F.get(x, i + 1).start > F.get(x, i).end))
        return F.when(last < 0, x).otherwise(F.zip_with(heads, tails, lambda h, t: F.struct(F.get(x, h).start.alias("start"), F.get(x, t).end.alias("end"))))

    return let(spans, join)


def suspicious(value: Column, c: CharacterClass) -> Column:
    """array<struct<start, end>> of a string's stretches of high entropy, from its first character on; none without enough different symbols in a piece."""
    known = F.lower(value) if c.fold else value
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.length(value) - WINDOW, F.lit(0)), F.lit(PIECE)), lambda k: F.struct(k.alias("k"), F.substring(known, k + 1, F.lit(PIECE + WINDOW - 1)).alias("text")))
    rich = lambda p: F.size(F.array_distinct(F.split(p.text, ""))) >= math.ceil(2**c.bits - 1e-9)
    found = F.transform(F.filter(pieces, rich), lambda p: F.transform(_hot(p.text, c), lambda s: F.struct((s.start + p.k).alias("start"), (s.end + p.k).alias("end"))))
    return _merged(F.flatten(found))


def entropy_spans(text: Column, c: CharacterClass, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """array<struct<start, end>>: stretches of high entropy in the text's strings of a class, but for strings that are allowed."""
    listed = "|".join(allowed)
    candidates = matches(text, f"{c.pattern}{{{WINDOW},}}")
    if allowed:
        candidates = F.filter(candidates, lambda m: ~m.value.rlike(listed))
    inside = lambda m: F.transform(suspicious(m.value, c), lambda s: F.struct((s.start + m.start).alias("start"), (s.end + m.start).alias("end")))
    return F.flatten(F.transform(candidates, inside))


def _long(found: Column, least: int) -> Column:
    return F.filter(found, lambda m: F.length(m.value) >= least)


def spans(text: Column, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """array<struct<start, rank, kind, end>> of all a text's secrets, sorted by start and then by kind as listed."""
    text = F.coalesce(text, F.lit(""))
    named = lambda x, rank, kind: F.transform(x, lambda m: F.struct(m.start.cast("bigint").alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m.end.cast("bigint").alias("end")))
    base = (("assign", matches(text, ASSIGN, 2)), ("access", matches(text, ACCESS)), ("hex", matches(text, HEX)))
    parts = [named(_long(x, LEAST[kind]), i, kind) for i, (kind, x) in enumerate(base)]
    parts += [named(entropy_spans(text, c, allowed), len(base) + i, c.kind) for i, c in enumerate(classes)]
    return F.array_sort(F.concat(*parts))


def scan(docs: DataFrame, text_col: str = "text", classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs without its text, with n_assign, n_access, n_hex, base and spans: the patterns' matches and all spans, as kind:start:end by start and kind, comma-joined.

    Spans are in code points, the end exclusive; an entropy span may lie in one of a pattern. Null and empty texts have none; rows stay as they are, whatever
    their ids; columns of docs named like a new one are replaced.
    """
    new = ("n_assign", "n_access", "n_hex", "base", "spans")
    count = lambda x, kind: F.size(F.filter(x, lambda s: s.kind == kind)).cast("bigint")
    line = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    out = let(spans(docs[text_col], classes, allowed), lambda x: F.struct(*(count(x, k).alias(f"n_{k}") for k in LEAST), line(F.filter(x, lambda s: s["rank"] < len(LEAST))).alias("base"), line(x).alias("spans")))
    rest = [docs[c] for c in docs.columns if c != text_col and c not in new]
    return docs.select(*rest, out.alias("_found")).select(*(c for c in docs.columns if c != text_col and c not in new), *(F.col(f"_found.{c}").alias(c) for c in new))
