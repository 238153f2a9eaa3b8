"""Quality rules: a document's own figures, and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, discard, let, materialize, words

#: Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 10, 20


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def _line(line: Column) -> Column:
    """What stands for a line."""
    return F.xxhash64(_normal(line))


def _repeated(w: Column) -> Column:
    """Words in 5-word windows that occur twice or more in the text."""

    def marked(keys: Column) -> Column:
        def count(s: Column) -> Column:
            twin = F.filter(F.transform(s, lambda x, j: F.when((x.k == F.get(s, j - 1).k) | (x.k == F.get(s, j + 1).k), x.i)), lambda i: i.isNotNull())
            gap = lambda at: F.transform(at, lambda i, j: F.least(F.lit(5), F.coalesce(F.get(at, j + 1) - i, F.lit(5))))
            return let(F.array_sort(twin), lambda at: F.aggregate(gap(at), F.lit(0).cast("long"), lambda a, x: a + x))

        pairs = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(let(F.array_sort(pairs), count))

    def windows(h: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.size(h) - 4), lambda i: F.xxhash64(F.slice(h, i, F.lit(5)))), marked)

    return F.when(F.size(w) < 6, F.lit(0).cast("long")).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), windows))


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to docs (such columns are replaced)."""
    t = F.coalesce(F.col(text), F.lit(""))
    plain = F.length(F.translate(t, SPACE_CHARS, ""))
    out = docs.withColumns({
        "word_chars": plain.cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(_lines(t), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "_of_words": let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("r"))),
    })
    out = out.withColumns({"n_words": F.col("_of_words.n"), "n_repeat_words": F.col("_of_words.r")}).drop("_of_words")
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def _key(text: str) -> list[Column]:
    """What stands for a text: two documents of one host with equal keys get one verdict."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("_text"), F.length(t).alias("_chars")]


def losses(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str | None = None, most_docs: int = 10, least_left: float = 0.3) -> DataFrame:
    """(_host, _text, _chars, _out, _n, _bad) of the texts that hold frequent lines of their host: the lines' hashes, how many lines go, and whether the text loses too much.

    A line (lower-cased, white space made single spaces) is frequent if more than most_docs distinct documents of its host hold it,
    however large the host is. A text is depleted if less than least_left of its words are outside frequent lines. Copies of one text
    are one document here: a text that is copied a thousand times doesn't make its own lines frequent, and one copy of it can stay.
    With doc_id, distinct ids are counted instead, so each copy counts.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    parts = F.transform(_lines(t), lambda x: F.struct(_line(x).alias("line"), F.size(words(x)).alias("n")))
    one = F.struct(*_key(text)) if doc_id is None else F.struct(F.col(doc_id))
    own = materialize(docs.select(F.coalesce(F.col(host), F.lit("")).alias("_host"), *_key(text), F.xxhash64(one).alias("_one"), parts.alias("parts")))
    each = own.select("_host", "_text", "_chars", "_one", F.explode("parts").alias("p")).select("_host", "_text", "_chars", "_one", "p.line", "p.n")
    frequent = each.groupBy("_host", "line").agg(F.count_distinct("_one").alias("docs")).where(F.col("docs") > most_docs).select("_host", "line")
    frequent = materialize(frequent)
    n = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x.n)
    # Copies are counted alike, so sums over all of them compare like one text's.
    total = own.select("_host", "_text", "_chars", n.alias("n"))
    found = each.join(frequent, ["_host", "line"]).groupBy("_host", "_text", "_chars")
    lost = materialize(found.agg(F.sum("n").alias("lost"), F.count("*").alias("gone"), F.collect_set("line").alias("_out")))
    whole = total.join(lost.select("_host", "_text", "_chars"), ["_host", "_text", "_chars"], "left_semi").groupBy("_host", "_text", "_chars").agg(F.sum("n").alias("n"), F.count("*").alias("copies"))
    bad = (F.col("n") - F.col("lost") < least_left * F.col("n")).alias("_bad")
    out = materialize(lost.join(whole, ["_host", "_text", "_chars"]).select("_host", "_text", "_chars", "_out", (F.col("gone") / F.col("copies")).cast("long").alias("_n"), bad))
    discard(own, frequent, lost)
    return out


NEW = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_frequent_lines", "cleaned", "kept"]


def judge(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str | None = None, **limits: float) -> DataFrame:
    """All rows and columns of docs with their figures, n_frequent_lines, `cleaned`, and `kept` (false if the base rules or the shared lines speak against it).

    cleaned: the text without its host's frequent lines, every occurrence; the figures are those of the whole text.
    Null text: empty, which fails; a null host is the host ""; repeated rows get one verdict; an empty table stays empty;
    columns named like the new ones are replaced, any other name may occur. limits: those of losses().
    """
    kept = [c for c in docs.columns if c not in NEW or c in (text, host, doc_id)]
    own = {c: f"c{i}" for i, c in enumerate(kept)}  # so that no name clashes with one used here
    docs = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    lost = losses(docs, own[text], own[host], own.get(doc_id), **limits)
    t = F.coalesce(F.col(own[text]), F.lit(""))
    out = figures(docs, own[text]).withColumns({"_h": F.coalesce(F.col(own[host]), F.lit("")), "_t": _key(own[text])[0], "_c": _key(own[text])[1]})
    # A sort-merge join at every size, as on large tables: it is split where a host is hot.
    lost = lost.hint("merge")
    out = out.join(lost, (out._h == lost._host) & (out._t == lost._text) & (out._c == lost._chars), "left")
    frequent = lambda x: F.array_contains(F.col("_out"), _line(x))
    left = F.array_join(F.filter(F.split(t, "\n"), lambda x: ~frequent(x)), "\n")
    none = F.col("_out").isNull()
    out = out.withColumns({
        "kept": ~F.col("base_failed") & ~F.coalesce("_bad", F.lit(False)),
        "cleaned": F.when(none, F.col(own[text])).otherwise(left),
        "n_frequent_lines": F.coalesce("_n", F.lit(0)).cast("long"),
    })
    return out.select(*(F.col(n).alias(c) for c, n in own.items() if c not in NEW), *NEW)


def keep(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that judge() keeps, with their own columns: the text without frequent lines, and n_chars, if there is one, counted anew."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    options = {"host": own[options.pop("host", "source")]} | options
    out = judge(named, own[text], **options).where("kept").withColumn(own[text], F.col("cleaned"))
    out = out.withColumn(own["n_chars"], F.length(own[text]).cast(docs.schema["n_chars"].dataType)) if "n_chars" in own else out
    return out.select(*(F.col(n).alias(c) for c, n in own.items()))
