"""Text, id and JSON expressions; every function maps Columns to a Column and stays in the JVM unless it says otherwise."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the formats.
FIELD_SEP = "<SEP>"
TUPLE_DELIMITER = "<|>"
RECORD_DELIMITER = "##"
COMPLETION_DELIMITER = "<|COMPLETE|>"
CJK = r"[\x{4e00}-\x{9fff}]"
MODES = ("local", "global", "naive", "hybrid", "mix", "bypass")
#: White space of all scripts.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
FLOAT = r"^[-+]?[0-9]*\.?[0-9]+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def quoted(marker: str) -> str:
    """A regular expression that matches the marker itself."""
    return "\\Q" + marker + "\\E"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(c, F.lit(SPACES))


def doc_id(c: Column) -> Column:
    return F.concat(F.lit("doc-"), F.md5(c))


def content_id(c: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.md5(c))


def args_hash(*args: Column, cache_type: str | None = None) -> Column:
    """md5 of the arguments joined without a separator, after "type:" if one is given (so ab + c and a + bc agree)."""
    head = [F.lit(f"{cache_type}:")] if cache_type else []
    return F.md5(F.concat(*head, *(F.coalesce(a.cast("string"), F.lit("None")) for a in args)))


def clean(c: Column) -> Column:
    """Stripped, the basic HTML entities resolved (in capitals too, as names are upper-cased first), control characters dropped."""
    plain = out = strip(c)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&LT;", "<"), ("&GT;", ">"), ("&QUOT;", '"'), ("&#X27;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(out, "&(amp|AMP);", "&")
    return F.regexp_replace(F.when(plain.contains("&"), out).otherwise(plain), r"[\x00-\x1f\x7f-\x9f]", "")


@F.pandas_udf(T.StringType())
def clean_html(c: pd.Series) -> pd.Series:
    """clean() with all named and numeric HTML entities (Arrow batches in Python)."""
    return c.map(html.unescape, na_action="ignore").str.strip().str.replace(r"[\x00-\x1f\x7f-\x9f]", "", regex=True)


def split_markers(c: Column, *markers: str) -> Column:
    """Pieces between any of the markers, stripped, without empty ones."""
    parts = F.split(c, "|".join(map(quoted, markers)))
    # trimming walks through the whole piece, so one without white space at its ends is left alone
    space = lambda x, at: F.lit(SPACES).contains(F.substring(x, at, 1))
    stripped = lambda x: F.when(space(x, 1) | space(x, -1), strip(x)).otherwise(x)
    return F.filter(F.transform(parts, stripped), lambda x: x != "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def n_words(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def estimate_tokens(c: Column) -> Column:
    """1.5 for a CJK character, a quarter for any other, cut to a whole number."""
    rest = F.length(F.regexp_replace(c, CJK, ""))
    return ((F.length(c) - rest) * 1.5 + rest * 0.25).cast("int")


def summary(c: Column, most: int = 100) -> Column:
    t = strip(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most), F.lit("...")))


def weight(last: Column) -> Column:
    """A record's last attribute as a number, 1.0 if it is none."""
    t = strip(last)
    return F.when(t.rlike(FLOAT), t.cast("double")).otherwise(F.lit(1.0))


def encode_label(c: Column) -> Column:
    return F.concat(F.lit("x"), F.lower(F.hex(F.encode(c, "UTF-8"))))


def decode_label(c: Column) -> Column:
    return F.decode(F.unhex(F.substring(c, 2, 1 << 30)), "UTF-8")


def json_body(c: Column) -> Column:
    """From the first { to the last }; null without one."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def repaired_json(c: Column) -> Column:
    """The body with line breaks gone; where that isn't JSON, with ' for \" too."""
    body = F.regexp_replace(json_body(c), r"\n", " ")
    return F.when(F.get_json_object(body, "$").isNotNull(), body).otherwise(F.translate(body, "'", '"'))


def keywords(response: Column) -> Column:
    """struct(high, low) of a keyword answer; empty arrays where it can't be read."""
    parsed = F.from_json(repaired_json(response), "high_level_keywords array<string>, low_level_keywords array<string>")
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(parsed.high_level_keywords, none).alias("high"), F.coalesce(parsed.low_level_keywords, none).alias("low"))


def flat_keywords(c: Column) -> Column:
    """A JSON list of keywords as an array; lists in it are taken apart (null or no list: empty)."""
    listed = "array<string>"
    items = F.coalesce(F.from_json(c, listed), F.array().cast(listed))
    inner = F.transform(items, lambda x: F.when(x.startswith("["), F.coalesce(F.from_json(x, listed), F.array(x))).otherwise(F.array(x)))
    return F.filter(F.flatten(inner), lambda x: x.isNotNull())


def first_json(c: Column) -> Column:
    """The first balanced {...} without its line breaks; null if there is none or if it isn't JSON. Folded in the JVM, a piece between braces at a time."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        depth = a.depth + F.when(x == "{", 1).when((x == "}") & (a.depth > 0), -1).otherwise(0)
        inside = (a.depth > 0) | (depth > 0)
        new = F.struct(depth.alias("depth"), F.when(inside, F.concat(a.text, x)).otherwise(a.text).alias("text"), (inside & (depth == 0)).alias("done"))
        return F.when(a.done, a).otherwise(new)

    found = F.aggregate(F.regexp_extract_all(c, F.lit(r"[^{}]+|[{}]"), F.lit(0)), start, step, lambda a: F.when(a.done, F.replace(a.text, F.lit("\n"), F.lit(""))))
    return F.when(F.try_parse_json(found).isNotNull(), found)


#: Fixed value: a key, quoted or not, and an object without inner ones, a quoted text, or all up to a comma or a closing brace.
LOOSE_PAIR = r'("?\w+"?)\s*:\s*(\{[^}]*\}|".*?"|[^,}]+)'


def loose_values(c: Column) -> Column:
    """map(key, text) of all `key: value` pairs of a broken JSON text; later ones win. Objects stay as they stand: apply it to them again.

    Pairs with equal keys are sorted next to each other, so the work grows with the text and not with the pairs' pairs.
    """
    pair = F.lit("(?s)" + LOOSE_PAIR)
    both = F.arrays_zip(F.regexp_extract_all(c, pair, F.lit(1)).alias("k"), F.regexp_extract_all(c, pair, F.lit(2)).alias("v"))
    key = lambda x, i: F.struct(F.btrim(x.k, F.lit('"')).alias("k"), i.alias("i"), strip(x.v).alias("v"))
    text = lambda x: F.when(x.v.startswith("{"), x.v).otherwise(F.btrim(x.v, F.lit('"')))

    def last(x: Column) -> Column:
        kept = F.filter(x, lambda y, j: ~F.coalesce(F.get(x, j + 1).k == y.k, F.lit(False)))
        return F.map_from_entries(F.transform(F.array_sort(kept, lambda a, b: (a.i - b.i).cast("int")), lambda y: F.struct(y.k.alias("k"), text(y).alias("v"))))

    return let(F.array_sort(F.transform(both, key)), last)


def response_json(c: Column) -> Column:
    """A model's answer as JSON text: its first object, else the loose pairs as an object of texts; null if neither is found."""
    pairs = loose_values(c)
    return F.coalesce(first_json(c), F.when(F.size(pairs) > 0, F.to_json(pairs)))


def clean_response(response: Column, system: Column, query: Column) -> Column:
    """An answer without the prompt, the query and role words that a model has repeated; answers no longer than the prompt stay as they are."""
    out = response
    for part in (system, F.lit("user"), F.lit("model"), query, F.lit("<system>"), F.lit("</system>")):
        out = F.when(part == "", out).otherwise(F.replace(out, part, F.lit("")))
    return F.when(F.length(response) > F.length(system), strip(out)).otherwise(response)


def keyword_question(prompt: Column, query: Column, high: Column, low: Column) -> Column:
    """A question that carries its keywords (arrays), as a query with separate keyword extraction puts it."""
    return F.concat(prompt, F.lit("\n\n### Keywords:\nHigh-level: "), F.array_join(high, ", "), F.lit("\nLow-level: "), F.array_join(low, ", "), F.lit("\n\n### Query:\n"), query)


def scalar(c: Column) -> Column:
    """struct(kind, number, text) of a bare value: null, true, false, float with a dot, int, else text without quotes."""
    t = strip(c)
    kind = (
        F.when(t == "null", "null").when(t.isin("true", "false"), "boolean").when(t.rlike(r"^[-+]?\d*\.\d+$|^[-+]?\d+\.$"), "float")
        .when(t.rlike(r"^[-+]?\d+$"), "int").otherwise("text")
    )
    return F.struct(kind.alias("kind"), F.when(kind.isin("float", "int"), t.try_cast("double")).alias("number"), F.regexp_replace(t, r"^\"|\"$", "").alias("text"))


def unicode_escapes(c: Column) -> Column:
    r"""\uXXXX escapes as characters, two halves of a pair as the one that they stand for; all else, other escapes too, as it is. A half without its other one is U+FFFD."""
    escape = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}"
    number = lambda x, at: F.conv(F.substring(x, at, 4), 16, 10).cast("int")
    utf8 = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")

    def character(x: Column) -> Column:
        one = number(x, 3)
        pair = 0x10000 + (one - 0xD800) * 0x400 + number(x, 9) - 0xDC00
        return F.when(F.length(x) > 6, utf8(pair)).when(one.between(0xD800, 0xDFFF), F.lit("\ufffd")).otherwise(utf8(one))

    gaps = F.split(c, escape, -1)
    found = F.transform(F.regexp_extract_all(c, F.lit(escape), F.lit(0)), character)
    return F.when(c.contains("\\u"), F.array_join(F.zip_with(gaps, found, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")).otherwise(c)


def mode_of(query: Column) -> Column:
    """struct(text, mode) of a query with a /mode prefix; hybrid without one."""
    found = F.regexp_extract(query, "^/(" + "|".join(MODES) + ") ", 1)
    rest = F.ltrim(F.substring(query, F.length(found) + 2, F.length(query)))
    return F.struct(F.when(found != "", rest).otherwise(query).alias("text"), F.when(found != "", found).otherwise("hybrid").alias("mode"))


def csv_row(*cells: Column) -> Column:
    """All cells quoted, inner quotes doubled, commas between."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *map(q, cells))


def tab_row(*cells: tuple[Column, bool]) -> Column:
    """(cell, is number): text without its outer quotes in quotes, numbers bare, comma and tab between."""
    one = lambda c, number: c.cast("string") if number else F.concat(F.lit('"'), F.regexp_replace(c, r'^"+|"+$', ""), F.lit('"'))
    return F.concat_ws(",\t", *(one(*c) for c in cells))


def csv_cells(line: Column, n: int) -> Column:
    """A line written by csv_row as struct c0..c(n-1); NUL characters are dropped."""
    return F.from_csv(F.replace(line, F.lit("\0"), F.lit("")), ", ".join(f"c{i} string" for i in range(n)), {"quote": '"', "escape": '"'})


def jaccard(a: Column, b: Column) -> Column:
    """Share of lower-cased words that two texts have in common; 0 for two empty ones."""
    x, y = (F.array_distinct(words(F.lower(c))) for c in (a, b))
    n = F.size(F.array_union(x, y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(0.0)


def in_turn(texts: Column) -> Column:
    """An array of texts as user and assistant messages in turn."""
    return F.transform(texts, lambda x, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), x.alias("content")))


def messages(*texts: Column) -> Column:
    """Texts in turn as user and assistant messages."""
    return in_turn(F.array(*texts))


#: Language codes and names.
LANGUAGES = {
    "en": "English", "fr": "French", "de": "German", "es": "Spanish", "vi": "Vietnamese", "zh": "Chinese", "zh-cn": "Chinese", "zh-tw": "Chinese", "ja": "Japanese", "ko": "Korean",
    "ru": "Russian", "ar": "Arabic", "hi": "Hindi", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "th": "Thai",
}


def language_name(code: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for p in LANGUAGES.items() for x in p))[code], code)


def by_stop_words(c: Column, stops: dict[str, tuple[str, ...]]) -> Column:
    """The language whose stop words are most frequent (ties: the first listed): a stand-in for a trained detector."""
    w = words(F.lower(c))
    among = lambda s: F.size(F.filter(w, lambda x: x.isin(*s)))
    n = [among(s) for s in stops.values()]
    best = F.greatest(*n) if len(n) > 1 else n[0]
    out = F.lit(None).cast("string")
    for code, k in reversed(list(zip(stops, n, strict=True))):
        out = F.when((k == best) & (best > 0), code).otherwise(out)
    return out


def batches_of(rows: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Arrow batches cut to a model's batch size."""
    for b in rows:
        for i in range(0, len(b), size):
            yield b.iloc[i : i + size]
