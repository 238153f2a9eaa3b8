"""Chunking by token windows, characters and separators; a token is a word unless an array of other tokens is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_id, let, quoted, strip, words
from ..functions.tokens import Tokenizer, pieces

#: Where texts are cut, the first that fits counts.
SEPARATORS = (
    "\n\n", "\r\n\r\n", "\n", "\r\n", "。", "．", ".", "！", "!", "？", "?", " ", "\t", "　", "​",
)


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """ARRAY of token arrays: windows that start every size - overlap tokens, a last one within the overlap too; none without tokens."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap has to be smaller than the size")
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), n - 1, F.lit(size - overlap))
    return F.when(n > 0, F.transform(starts, lambda s: F.slice(tokens, s + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def by_tokens(docs: DataFrame, text: str = "text", size: int = 1200, overlap: int = 100, tokenizer: Tokenizer | None = None) -> DataFrame:
    """docs' columns but the text, and chunk_order_index, tokens, content. A tokenizer's tokens give the text back as it stands, stripped; words are joined by a space."""
    cut = docs.withColumn("_t", pieces(F.col(text), tokenizer) if tokenizer else words(F.coalesce(text, F.lit("")))).drop(text)
    out = cut.select(*(c for c in cut.columns if c != "_t"), F.posexplode(windows(F.col("_t"), size, overlap)).alias("chunk_order_index", "_w"))
    content = strip(F.array_join("_w", "")) if tokenizer else F.array_join("_w", " ")
    return out.withColumns({"tokens": F.size("_w").cast("long"), "content": content}).drop("_w")


def by_character(docs: DataFrame, separator: str, text: str = "text", size: int | None = None, overlap: int = 0) -> DataFrame:
    """Pieces between separators, stripped, empty ones kept; with a size, longer pieces are cut to token windows."""
    pieces = F.split(F.coalesce(text, F.lit("")), quoted(separator), -1)
    if size:
        cut = lambda p: F.when(F.size(words(p)) > size, F.transform(windows(words(p), size, overlap), lambda w: F.array_join(w, " "))).otherwise(F.array(p))
        pieces = F.flatten(F.transform(pieces, cut))
    keep = [c for c in docs.columns if c != text]
    out = docs.select(*keep, F.posexplode(F.transform(pieces, strip)).alias("chunk_order_index", "content"))
    return out.withColumn("tokens", F.size(words(F.col("content"))).cast("long"))


def with_previous(chunks: DataFrame, doc: str, overlap: int, size: int) -> DataFrame:
    """Each chunk led by the last `overlap` words of the one before it, cut to `size` words."""
    w = Window.partitionBy(doc).orderBy("chunk_order_index")
    own = words(F.col("content"))
    before = F.lag(own).over(w)
    tail = F.when(before.isNull(), F.array().cast("array<string>")).otherwise(F.slice(before, F.greatest(F.size(before) - overlap + 1, F.lit(1)), F.lit(overlap)))
    joined = F.slice(F.concat(tail, own), 1, size)
    return chunks.withColumns({"content": F.array_join(joined, " "), "tokens": F.size(joined).cast("long")})


def _cut_after(separators: tuple[str, ...]) -> str:
    """A pattern of the places after separators. A single space belongs to the word after it, so as a separator it counts where another one stands before it."""
    return "|".join(f"(?<={quoted(m if m != ' ' else '  ')})" for m in separators)


def _chunk_starts(sizes: Column, size: int) -> Column:
    """Where chunks start, in words, when pieces of these sizes are joined as long as they fit: a fold over numbers that grows an array by one for each chunk alone."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("starts"))

    def step(a: Column, n: Column) -> Column:
        new = (F.size(a.starts) == 0) | (a.held + n > size)
        return F.struct((a["at"] + n).alias("at"), F.when(new, n).otherwise(a.held + n).alias("held"), F.when(new, F.concat(a.starts, F.array(a["at"]))).otherwise(a.starts).alias("starts"))

    return F.aggregate(sizes, start, step, lambda a: a.starts)


def by_separators(docs: DataFrame, key: str, text: str = "text", size: int = 1200, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """(key, chunk_order_index, tokens, content): texts are cut after separators, pieces joined as long as they fit, and led by the last words of the chunk before, cut to the size.

    What the lead pushes over the size is dropped, and so are windows within the overlap where a text that makes a single oversized
    chunk is cut to windows (those have no lead); a piece that is larger than the size stays whole as a first chunk. Null and blank texts make no chunks.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap has to be smaller than the size")

    def led(x: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            end = F.coalesce(F.get(x.starts, i + 1), F.size(x.words))
            before = F.greatest(F.coalesce(F.get(x.starts, F.greatest(i - 1, F.lit(0))), F.lit(0)), s - overlap)
            lead = F.when(i > 0, F.slice(x.words, before + 1, s - before)).otherwise(F.slice(x.words, F.lit(1), F.lit(0)))
            whole = F.concat(lead, F.slice(x.words, s + 1, end - s))
            return F.when((i > 0) & (F.size(whole) > size), F.slice(whole, F.lit(1), F.lit(size))).otherwise(whole) if overlap else whole

        return F.transform(x.starts, one)

    def chunks(x: Column) -> Column:
        alone = (F.size(x.starts) == 1) & (F.size(x.words) > size)
        return F.when(alone, F.filter(windows(x.words, size, overlap), lambda w: F.size(w) > overlap)).otherwise(led(x))

    pieces = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), _cut_after(separators), -1), words), lambda w: F.size(w) > 0)
    both = let(pieces, lambda p: F.struct(F.flatten(p).alias("words"), _chunk_starts(F.transform(p, lambda w: F.size(w)), size).alias("starts")))
    out = docs.select(F.col(key), F.posexplode(let(both, chunks)).alias("chunk_order_index", "_w"))
    return out.select(key, "chunk_order_index", F.size("_w").cast("long").alias("tokens"), F.array_join("_w", " ").alias("content"))


def with_ids(chunks: DataFrame, doc_order: str) -> DataFrame:
    """One row for each chunk id: of equal contents the last one's fields, in document and chunk order."""
    w = Window.partitionBy("id").orderBy(F.desc(doc_order), F.desc("chunk_order_index"))
    return chunks.withColumn("id", content_id(F.col("content"), "chunk-")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
