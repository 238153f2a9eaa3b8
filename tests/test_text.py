import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions import tokens
from loomgraph.functions import vectors as V
from loomgraph.operators import chunk, extract, tables


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) and (not v or isinstance(v[0], str)) else 'array<double>' if isinstance(v, list) else 'bigint'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("n", "size", "overlap", "want"), [(10, 4, 1, [4, 4, 4, 1]), (0, 4, 1, []), (7, 4, 1, [4, 4, 1])])
def test_windows(spark, n, size, overlap, want):
    got = one(spark, F.transform(chunk.windows(F.col("t"), size, overlap), F.size), t=[str(i) for i in range(n)])
    assert got == want


def test_windows_refuse_a_wide_overlap():
    with pytest.raises(ValueError):
        chunk.windows(None, 4, 4)


@pytest.mark.parametrize(("counts", "budget", "want"), [([3, 4, 5], 7, 2), ([8, 1], 7, 0), ([1], 0, 0)])
def test_budget_is_a_prefix(spark, counts, budget, want):
    t = spark.createDataFrame(list(enumerate(counts)), "o int, n int")
    assert tables.within_budget(t, [F.col("o")], F.col("n"), budget).count() == want


def test_summary(spark):
    assert one(spark, X.summary(F.col("t")), t="a" * 100) == "a" * 100
    assert one(spark, X.summary(F.col("t")), t="a" * 101) == "a" * 100 + "..."


def test_strip_is_unicode(spark):
    assert one(spark, X.strip(F.col("t")), t="\u3000\xa0 a b\x85\n\u200a") == "a b"
    assert one(spark, X.strip(F.col("t")), t=" \n") == ""


def test_estimate(spark):
    assert one(spark, X.estimate_tokens(F.col("t")), t="中文ab") == 3


def test_split_markers(spark):
    assert one(spark, X.split_markers(F.col("t"), "##", "<|COMPLETE|>"), t="a##b<|COMPLETE|> ## c") == ["a", "b", "c"]


@pytest.mark.parametrize(("t", "want"), [("7", 7.0), (".5", 0.5), ("-2.0", -2.0), ("x", 1.0), ("5.", 1.0)])
def test_weight(spark, t, want):
    assert one(spark, X.weight(F.col("t")), t=t) == want


def test_entity_records(spark):
    a = spark.createDataFrame([("c", '("entity"<|>"Alex"<|>"person"<|>"d")##(entity<|>A<|>T<|>d)')], "chunk_id string, answer string")
    got = extract.entities(extract.records(a)).collect()
    assert [(r.entity_name, r.entity_type, r.description) for r in got] == [('"ALEX"', '"PERSON"', '"d"')]


@pytest.mark.parametrize(("q", "want"), [("/mix  hi", ("hi", "mix")), ("hi", ("hi", "hybrid")), ("/loud hi", ("/loud hi", "hybrid"))])
def test_mode_prefix(spark, q, want):
    assert tuple(one(spark, X.mode_of(F.col("t")), t=q)) == want


def test_labels_round_trip(spark):
    assert one(spark, X.decode_label(X.encode_label(F.col("t"))), t="Straße 中") == "Straße 中"


def test_packing_gives_large_rows_their_own_group(spark):
    t = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 4, 9, 1, 20, 2])], "q int, o int, n int")
    got = {r.o: r.group for r in tables.pack(t, "q", "o", "n", 9).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 4}


def test_pairs_are_padded(spark):
    assert one(spark, extract.fit_pairs(F.col("t"), F.lit(3)), t=["N"]) == ["N", "N (Copy)", "N (Copy) (Copy)"]
    assert one(spark, extract.fit_pairs(F.col("t"), F.lit(1)), t=["a", "b"]) == ["a"]
    assert one(spark, extract.fit_pairs(F.col("t"), F.lit(2)), t=[]) == []


def test_quantise(spark):
    assert one(spark, V.quantize(F.col("v"))["codes"], v=[0.0, 0.5, 1.0]) == [0, 128, 255]
    assert one(spark, V.quantize(F.col("v"))["codes"], v=[2.0, 2.0]) == [0, 0]
    assert one(spark, V.cosine(F.col("v"), F.col("v")), v=[0.0, 0.0]) is None


def test_json(spark):
    assert one(spark, X.first_json(F.col("t")), t='x {"a": {"b": 1}} y {') == '{"a": {"b": 1}}'
    assert one(spark, X.first_json(F.col("t")), t="none") is None
    k = one(spark, X.keywords(F.col("t")), t="Sure {'high_level_keywords': ['a'], 'low_level_keywords': ['b', 'c']}")
    assert (k.high, k.low) == (["a"], ["b", "c"])
    assert one(spark, X.loose_values(F.col("t")), t='title: "T", n: 3') == {"title": "T", "n": "3"}
    assert one(spark, X.scalar(F.col("t"))["kind"], t="3.5") == "float"


def test_csv(spark):
    assert one(spark, X.csv_row(F.col("t"), F.lit(1)), t='a"b') == '"a""b","1"'
    assert one(spark, X.csv_cells(X.csv_row(F.col("t"), F.lit("z")), 2)["c0"], t='a"b,c') == 'a"b,c'


def test_separators(spark):
    t = spark.createDataFrame([(1, "a b c. d e. f g h i."), (2, None)], "k int, text string")
    got = chunk.by_separators(t, "k", size=5, overlap=1).orderBy("chunk_order_index").collect()
    assert [r.content for r in got] == ["a b c. d e.", "e. f g h i."]


@pytest.mark.parametrize(("t", "want"), [('x } {"a": {"b": 1}\n} {', '{"a": {"b": 1}}'), ("{not json}", None), ("{", None), ("", None), (None, None), ('{"a": 1} {"b": 2}', '{"a": 1}')])
def test_first_json(spark, t, want):
    assert one(spark, X.first_json(F.col("t")), t=t) == want


def test_loose_values(spark):
    got = one(spark, X.loose_values(F.col("t")), t='{answer: hello world, "n": 3, o: {a: 1, b: 2}, n: 4}')
    assert got == {"answer": "hello world", "n": "4", "o": "{a: 1, b: 2}"}
    assert one(spark, X.response_json(F.col("t")), t="nothing") is None


def test_clean_response(spark):
    assert one(spark, X.clean_response(F.col("t"), F.lit("Be short."), F.lit("why?")), t="<system>Be short.</system>user why? Because.") == "Because."
    assert one(spark, X.clean_response(F.col("t"), F.lit("Be short."), F.lit("why?")), t="user") == "user"


def test_escapes_alone_are_changed(spark):
    cases = {"a\n\\u0041": "a\nA", 'say "x" \\u0041\t': 'say "x" A\t', "dir\\new \\u0041": "dir\\new A", "\\ud83d\\ude00\\ud83d!": "😀\ufffd!", "\\u12 \\": "\\u12 \\", "": ""}
    t = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "a string, b string").withColumn("c", X.unicode_escapes(F.col("a")))
    assert [r.c for r in t.collect()] == [r.b for r in t.collect()]


def test_many_loose_pairs(spark):
    text = "{" + ", ".join(f"k{i % 5000}: v{i}" for i in range(10_000)) + "}"
    got = spark.createDataFrame([(text,), ("{b: 1, a: {x: 1}, b: \"2\"}",), ("",), (None,)], "t string").select(X.loose_values(F.col("t")).alias("m")).collect()
    assert got[0].m == {f"k{i}": f"v{i + 5000}" for i in range(5000)}
    assert [r.m for r in got[1:]] == [{"a": "{x: 1}", "b": "2"}, {}, None]


def separated(text, size, overlap):
    """Chunks by separators, word by word."""
    cuts = "\n。．.！!？?\t\u3000\u200b"
    pieces, now = [], ""
    for i, c in enumerate(text or ""):
        now += c
        if c in cuts or c == " " and text[i - 1 : i] == " ":
            pieces.append(now.split())
            now = ""
    merged = []
    for p in filter(None, [*pieces, now.split()]):
        if merged and len(merged[-1]) + len(p) <= size:
            merged[-1] = merged[-1] + p
        else:
            merged.append(p)
    if len(merged) == 1 and len(merged[0]) > size:
        w = merged[0]
        return [x for x in (w[i : i + size] for i in range(0, len(w), size - overlap)) if len(x) > overlap]
    return [((merged[i - 1][-overlap:] + m)[: max(size, 0)] if i and overlap else m) for i, m in enumerate(merged)]


@pytest.mark.parametrize(("size", "overlap"), [(5, 1), (8, 3), (4, 0), (50, 10)])
def test_separators_against_brute_force(spark, size, overlap):
    import random

    r = random.Random(size)
    texts = ["".join(r.choice(["ab", "c", " ", " ", "  ", ".", "! ", "\n", "\n\n", "\t", "。", "x y z "]) for _ in range(r.randrange(120))) for _ in range(60)]
    texts += [None, "", "  ", "a " * 40, "a b c d e f g h.", "one. " * 400]
    t = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for x in chunk.by_separators(t, "k", "t", size, overlap).orderBy("k", "chunk_order_index").collect():
        got.setdefault(x.k, []).append(x.content)
    assert got == {k: v for k, v in ((i, [" ".join(c) for c in separated(x, size, overlap)]) for i, x in enumerate(texts)) if v}


VOCABULARY = "/opt/tokenizers"


def test_tokens_give_the_text_back(spark):
    import os

    files = [f"{VOCABULARY}/{f}" for f in sorted(os.listdir(VOCABULARY)) if f.endswith(".json")] if os.path.isdir(VOCABULARY) else []
    texts = ["It's a naïve 日本語 text,  with   gaps.\n\n😀😀 end ", "", None, "  ", "x" * 300, "a\u200bb\x00c"]
    t = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for tokenizer in [tokens.fixed(3), *map(tokens.vocabulary, files[:2])]:
        got = t.select("k", tokens.pieces(F.col("t"), tokenizer).alias("p"), tokens.counted(F.col("t"), tokenizer).alias("n")).collect()
        assert {r.k: "".join(r.p) for r in got} == {k: x or "" for k, x in enumerate(texts)}
        assert all(len(r.p) == r.n for r in got)
        cut = chunk.by_tokens(t, "t", 7, 2, tokenizer).orderBy("k", "chunk_order_index").collect()
        assert all(r.tokens <= 7 and r.content in texts[r.k] for r in cut)
