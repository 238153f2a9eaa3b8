"""Each operator against brute force on small odd tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import ann, bpe, chat, hmm, huffman, mixing, quality, simhash, suffix, urlfilter
from loomgraph.llm.common import components, in_order, scratch
from loomgraph.llm.wordtable import default_vocabulary, tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["the", "an", "or", "ti", "on", "é", "ß", "St"]) for _ in range(r.randint(1, 4))) for _ in range(n))


LONG = prose(4000, 1)
TEXTS = [
    None, "", "   \n\t ", "one", "Two words", prose(30, 2), prose(30, 2), prose(200, 3), prose(200, 3) + " more", "lead " + prose(200, 3)[100:900] + " end", LONG, LONG[5000:9000] + prose(50, 4),
    "ab" * 900, "x " * 600, "line a b c\nline a b c\n" * 8, "Ünï¢ödé 日本語 <|endoftext|> it's 'S 12 #$% \x00\x85 ﬁ" * 3, "A" * 399, "B" * 400, "C" * 401, "C" * 401, " ".join(["a b c d e"] * 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, 0) for i, t in enumerate(TEXTS)]
    rows += [rows[7], (None, "no id " + prose(20, 5), None, "src1", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(25)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_in_order(spark):
    rows = [(None if i % 5 == 0 else i % 3, i // 2, i) for i in range(60)]
    got = in_order(spark.createDataFrame(rows, "k int, o int, n int"), ["k"], ["o", "n"], {"before": "n"}, rank="r").collect()
    for x in got:
        own = sorted((o, n) for k, o, n in rows if k == x.k)
        at = own.index((x.o, x.n))
        assert (x.r, x.before) == (at, sum(n for _, n in own[:at]))


# 1


def removed(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "group"), [(400, 2_000), (60, 2_000), (60, 2)])
def test_suffix_dedup(docs, length, group):
    rows = docs.collect()
    want = Counter(zip([r.doc_id for r in rows], removed([(r.text or "").encode() for r in rows], length), strict=True))
    got = suffix.remove(docs.withColumn("kept", F.lit(1)), length=length, group=group)
    assert Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())) for r in got.collect()) == want


def test_suffix_extents_by_pairs():
    r = random.Random(1)
    for _ in range(60):
        n, length = r.randint(2, 9), 8
        lefts = ["".join(r.choice("ab") for _ in range(r.randint(0, 6))).encode() for _ in range(n)]
        rights = [("xy" + "".join(r.choice("ab") for _ in range(r.randint(0, 8)))).encode() for _ in range(n)]
        share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        for i, got in enumerate(suffix.extents(lefts, rights, length)):
            pairs = [(share(lefts[i], lefts[j]), share(rights[i], rights[j])) for j in range(n) if j != i]
            pairs = [p for p in pairs if sum(p) >= length]
            assert got == ((max(a for a, _ in pairs), max(b for _, b in pairs)) if pairs else None)


def test_suffix_groups_by_pairs():
    r = random.Random(4)
    share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for _ in range(200):
        length = r.randint(2, 9)
        both = list({("".join(r.choice("ab") for _ in range(r.randint(0, 6))).encode(), ("x" + "".join(r.choice("ab") for _ in range(r.randint(0, 7)))).encode()) for _ in range(r.randint(1, 12))})
        lefts, rights, counts = [a for a, _ in both], [b for _, b in both], [r.randint(1, 2) for _ in both]
        want = {(len(a), len(b), (i,)) for i, (a, b) in enumerate(both) if counts[i] > 1 and len(a) + len(b) >= length}
        for i, j in ((i, j) for i in range(len(both)) for j in range(i)):
            a, b = share(lefts[i], lefts[j]), share(rights[i], rights[j])
            if a + b >= length:
                want.add((a, b, tuple(m for m in range(len(both)) if share(lefts[m], lefts[i]) >= a and share(rights[m], rights[i]) >= b)))
        got = [(a, b, tuple(sorted(m))) for a, b, m in suffix.groups(lefts, rights, length, counts)]
        assert len(set(got)) == len(got) and set(got) == want


def test_suffix_rows_of_a_passage_that_many_share(spark):
    r = random.Random(8)
    some = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, half = some(150), some(45)
    texts = [some(r.randint(0, 90)) + passage + some(r.randint(0, 90)) for _ in range(500)]
    texts += ["-" * r.randint(0, 40) + passage[:75] + some(70) for _ in range(100)] + [some(70) + half + some(70) for _ in range(300)] + ["tail " + texts[i][-100:] for i in range(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix._anchored(docs, "text", 60, 50, None)
    assert got.known.count() > 500
    assert got.rows.count() + got.known.count() < 3 * got.classes.count()
    want = Counter(zip(range(len(texts)), removed([t.encode() for t in texts], 60), strict=True))
    out = suffix.remove(docs, length=60, group=50)
    assert Counter((x.doc_id, (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest())) for x in out.collect()) == want


@pytest.mark.parametrize("part", [1, 5])
def test_suffix_group_that_is_reached_on_two_ways(spark, part):
    r = random.Random(12)
    some = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = []
    for _ in range(12):
        left, right = some(60), some(90)
        own = [some(40) + left[-16:] + right[:46] + some(40) for _ in range(part - 1)]
        texts += [left + right, *own, *(some(40) + left[-n:] + right[: 59 - n] + some(40) for n in (15, 14) for _ in range(6))]
    want = dict(enumerate(removed([t.encode() for t in texts], 60)))
    out = suffix.remove(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=60, group=4)
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in out.collect()} == want


@pytest.mark.parametrize("group", [2_000, 2])
def test_suffix_repeat_groups_hold_all_occurrences(spark, docs, group):
    some = spark.createDataFrame([("x" * 70 + c + "y" * 70,) for c in "abcd"] + [("z" + "x" * 70 + "a",)], "text string")
    docs = docs.select("text").union(some)
    texts = {t.encode() for t in (r.text for r in docs.distinct().collect()) if t}
    keyed = {(r.th, r.len): bytes(r.b) for r in docs.distinct().select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.octet_length(F.coalesce("text", F.lit(""))).alias("len"), F.coalesce("text", F.lit("")).cast("binary").alias("b")).collect()}
    by = {}
    for r in suffix.repeat_groups(docs, length=60, group=group).collect():
        by.setdefault(r.repeat, set()).add((keyed[r.th, r.len], r.start, r.end))
    assert by
    for members in by.values():
        held = {t[a:b] for t, a, b in members}
        assert len(held) == 1 and len(members) > 1
        s = held.pop()
        assert len(s) >= 60
    cover = lambda t: {i for m in by.values() for x, a, b in m if x == t for i in range(a, b)}
    seen = Counter(t[p : p + 60] for t in texts for p in range(len(t) - 59))
    for t in texts:
        assert cover(t) == {i for p in range(len(t) - 59) if seen[t[p : p + 60]] > 1 for i in range(p, p + 60)}


def test_suffix_stage(docs, none):
    got = suffix.without_repeats(docs, length=400)
    assert got.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.text is not None)
    assert got.where("doc_id = 0").first().text is None
    assert suffix.without_repeats(none).count() == 0


def test_suffix_by_words(spark, docs):
    count, pattern = 12, re.compile(r"[\u3000-\ud7ff]|[^\x20\x09-\x0D\u3000-\ud7ff]+")
    short = " ".join("abcdefghijkl")
    texts = [r.text for r in docs.collect()] + [short, "lead\n" + short.replace(" ", "\n") + " end", "m " + short[2:] + " n", "日本語の文章です。同じ文です" + "甲", "乙日本語の文章です。同じ文です"]
    rows = list(enumerate(texts))
    at = [list(pattern.finditer(t or "")) for t in texts]
    seen = Counter(tuple(m[0] for m in w[i : i + count]) for w in at for i in range(len(w) - count + 1))
    want = {}
    for (i, t), w in zip(rows, at, strict=True):
        gone = set()
        for p in range(len(w) - count + 1):
            if seen[tuple(m[0] for m in w[p : p + count])] > 1:
                gone |= set(range(p, p + count))
        cut = set()
        for j in gone:
            cut |= set(range(w[j].start(), w[j + 1].start() if j + 1 in gone else w[j].end()))
        want[i] = t if t is None else "".join(c for j, c in enumerate(t) if j not in cut)
    for group in (20_000, 2):
        got = suffix.remove(spark.createDataFrame(rows, "doc_id int, text string").repartition(3), words=count, group=group)
        assert {r.doc_id: r.kept.decode() for r in got.collect()} == {i: t or "" for i, t in want.items()}
    assert want[len(texts) - 5] == "" and want[len(texts) - 4] == "lead\n end" and want[len(texts) - 3] == texts[-3]


def test_suffix_pieces_repeat_no_anchor(spark, monkeypatch):
    real = random.Random(6).randbytes(5 << 19)
    assert len(set(found := list(suffix.Anchors(400, 200)([real])))) == len(found)
    monkeypatch.setattr(suffix, "PIECE", 500)
    texts = [TEXTS[7].encode(), LONG.encode(), real[:4000], real[700:1900] + real[:90], b"short", LONG[2000:4000].encode()]
    for length in (60, 400):
        found = list(suffix.Anchors(length, length // 2)(texts))
        assert len(set(found)) == len(found)
        monkeypatch.setattr(suffix, "PIECE", 1 << 20)
        assert found == list(suffix.Anchors(length, length // 2)(texts))
        monkeypatch.setattr(suffix, "PIECE", 500)


def test_suffix_of_texts_over_a_piece(spark):
    unique = "".join(random.Random(7).choices("abcdefghijklmnopqrstuvwxyz ", k=5 << 19))
    got = {r.doc_id: r for r in suffix.remove(spark.createDataFrame([(1, unique), (2, unique[1_000_000:1_002_000])], "doc_id int, text string")).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed) == (2000, 1, 2000)
    assert got[1].kept.decode() == unique[:1_000_000] + unique[1_002_000:]


# 2


@pytest.mark.parametrize("segment", [1024, 1, 2, 3])
def test_forward_and_expectation_by_enumeration(monkeypatch, segment):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    m = hmm.Model(np.full(hmm.CLASSES, 1 / hmm.CLASSES), 3, stay=0.6)
    r = np.random.default_rng(0)
    m.start = np.array([0.5, 0.3, 0.2])
    seq = [r.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 3)]
    model = (m.start, m.move, m.ratios())
    starts, moves, emits = hmm.expect(list(seq), model)
    import itertools

    s0, m0, e0 = np.zeros(3), np.zeros((3, 3)), np.zeros((3, hmm.CLASSES))
    for x, got in zip(seq, hmm.forward(list(seq), model), strict=True):
        paths = {}
        for p in itertools.product(range(3), repeat=len(x)):
            w = m.start[p[0]] * model[2][x[0], p[0]]
            for a, b, o in zip(p, p[1:], x[1:], strict=False):
                w *= m.move[a, b] * model[2][o, b]
            paths[p] = w
        total = sum(paths.values())
        assert got == pytest.approx(np.log10(total))
        for p, w in paths.items():
            s0[p[0]] += w / total
            for a, b in zip(p, p[1:], strict=False):
                m0[a, b] += w / total
            for a, o in zip(p, x, strict=True):
                e0[a, o] += w / total
    assert np.allclose(s0, starts) and np.allclose(m0, moves) and np.allclose(e0, emits)


def test_training_is_baum_welch_over_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 7)
    r = np.random.default_rng(2)
    seqs = [r.integers(0, 9, n).astype(np.uint16) for n in (1, 2, 7, 8, 14, 40, 133, 21)]
    frequency = np.full(hmm.CLASSES, 1e-6)
    frequency[:9] = (np.bincount(np.concatenate(seqs), minlength=9) + 1) / 300
    mine, spread = hmm.Model(frequency, 3), hmm.Model(frequency, 3)
    rows = spark.createDataFrame([(x.tobytes(),) for x in seqs], "classes binary").repartition(3)
    for _ in range(4):
        spread.update(*hmm._counts(rows, spread))
        s, m, e = np.zeros(3), np.zeros((3, 3)), np.zeros((3, hmm.CLASSES))
        ratio = mine.ratios()
        for x in seqs:
            a, b = np.zeros((len(x), 3)), np.ones((len(x), 3))
            a[0] = mine.start * ratio[x[0]]
            for t in range(1, len(x)):
                a[t] = (a[t - 1] @ mine.move) * ratio[x[t]]
            for t in range(len(x) - 2, -1, -1):
                b[t] = mine.move @ (ratio[x[t + 1]] * b[t + 1])
            p = a[-1].sum()
            s += a[0] * b[0] / p
            for t in range(len(x)):
                e[:, x[t]] += a[t] * b[t] / p
                if t:
                    m += np.outer(a[t - 1], ratio[x[t]] * b[t]) * mine.move / p
        mine.update(s, m, e)
    assert np.allclose(mine.start, spread.start) and np.allclose(mine.move, spread.move) and np.allclose(mine.emit, spread.emit)


def test_hmm_base_and_gain(docs, none):
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    got = hmm.score(docs, part, rounds=2).collect()
    rows = [(r.doc_id, zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 1, [w.translate(LOWER) for w in WORD.findall(r.text or "")] + [None]) for r in docs.collect()]
    c = Counter(w for _, out, ws in rows if not out for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, out, len(ws), sum(w in c for w in ws), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, out, ws in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert sum(r.score - r.base_score for r in got if not r.held_out) > 0
    assert hmm.score(none, part).count() == 0
    lone = hmm.score(docs.where("doc_id = 3"), F.lit(True)).first()
    assert (lone.train_tokens, lone.n_known, lone.score) == (0, 0, lone.base_score)


def test_rare_words_are_counted_in_the_join(docs, monkeypatch):
    want = {(r.doc_id, r.n_tokens): round(r.base_score, 6) for r in hmm.score(docs, F.lit(False), rounds=0).collect()}
    monkeypatch.setattr(hmm, "HELD", 3)
    assert {(r.doc_id, r.n_tokens): round(r.base_score, 6) for r in hmm.score(docs, F.lit(False), rounds=0).collect()} == want


# 3


def test_mixing(docs, none):
    got = mixing.plan(docs).collect()
    again = mixing.plan(docs).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    sizes = Counter()
    source = {}
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
        source[r.doc_id] = r.source
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, want = set(), {}
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in sizes if x not in full) for s in sizes if s not in full}
        if not (over := {s for s in share if share[s] > 3 * sizes[s]}):
            break
        full |= over
    want = {s: 3 * sizes[s] if s in full else share[s] for s in sizes}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert (r.source_size, r.target) == (sizes[s], pytest.approx(want[s]))
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        times = [p for p in (r.position, r.position_2, r.position_3) if p is not None]
        assert len(times) == -(-r.taken // r.size if r.size else 0) and times == sorted(times)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    first = [r.position for r in got]
    assert first == sorted(first, key=lambda p: (p is None, p or 0))
    assert mixing.plan(none).count() == 0
    stage = mixing.mix(docs.withColumns({"taken": F.lit(1), "_row": F.lit("r"), "size": F.lit(2)}))
    assert stage.columns == [*docs.columns, "taken", "_row", "size"]
    assert mixing.mix(none).count() == 0


def test_positions_invert_the_demand(spark):
    t = spark.createDataFrame([(i, f"s{i % 3}", 1) for i in range(30)], "doc_id int, source string, n int").withColumn("text", F.lit("w w"))
    for r in mixing.plan(t, slope=0.5).join(t, "doc_id").collect():
        if r.position is not None:
            pull = {"s0": 0.5, "s1": 0.0, "s2": -0.5}[r.source]
            words = r.target * (r.position + pull * r.position * (1 - r.position))
            assert words == pytest.approx(round(words / 2) * 2, abs=1e-6)


# 4


def test_url_rules(spark, monkeypatch):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "", "")]
    urls = [None, "", "x", "http://A.Example.COM/en/1?q", "https://www.example.com/en/", "http://example.com", "http://myexample.com/en/", "http://a.net/es/x#y", "http://a.net/esx", "http://net/es/", "s://h?x://a.net/es/", "http://a.com.net/es/", "://q.com/é?"]
    t = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls + urls[3:5])], "page_id int, url string, verdict string")

    def want(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        h, p = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fit = [(len(rh + rp), rh + rp, a) for a, rh, rp in rules[:4] if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        return (h, p, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow")

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(t, rules[:4]).collect()}
    assert got == {i: want(u) for i, u in enumerate(urls + urls[3:5])}
    assert urlfilter.judge(t.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge(t, []).collect()} == {"allow"}


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda s: 7)
    f = str(tmp_path / "i")
    urlfilter.Index.write(f, [("block", "a", "/"), ("allow", "b", "/"), ("block", "b", "/x")])
    assert urlfilter.Index(f).longest([b"b", b"b", b"c", b"a"], [b"/x", b"/", b"/", b"/"]) == [("b/x", 1), ("b/", 0), (None, -1), ("a/", 1)]


# 5


def test_search_finds_most_neighbours(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 8))
    rows = [(i, [float(v) for v in np.float32(p)]) for i, p in enumerate(x)] + [(1000 + i, [1.0] * 8) for i in range(40)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0, None] + [0.0] * 6), (2003, [float("nan")] * 8), (2004, [1.0]), (50, rows[50][1]), (None, [1.0] * 8)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0)).repartition(5)
    asked = F.col("vec_id") % 50 == 0
    got = {}
    for a in ann.search(t, asked, 5, books=8).collect():
        got.setdefault(a.query_id, []).append((a["rank"], a.vec_id, a.score))
    ok = {i: np.float64(np.float32(v)) for i, v in rows if i is not None and v and None not in v and len(v) == 8 and np.isfinite(v).all() and np.any(v)}
    cos = lambda a, b: (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
    hits = total = 0
    for q in ok:
        if q % 50 == 0:
            want = sorted(((-cos(ok[q], v), i) for i, v in ok.items() if i != q))[:5]
            mine = sorted(got[q])
            assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
            assert all(m[2] == pytest.approx(cos(ok[q], ok[m[1]]), abs=1e-12) for m in mine)
            hits += len({m[1] for m in mine} & {i for _, i in want})
            total += 5
    assert set(got) == {q for q in ok if q % 50 == 0}
    assert hits >= 0.9 * total
    assert [m[1] for m in sorted(got[1000])] == [1001, 1002, 1003, 1004, 1005]
    assert ann.search(t.limit(0), asked).count() == 0
    few = ann.search(t.where("vec_id in (0, 1, 2)"), asked, 5).collect()
    assert sorted((a["rank"], a.query_id) for a in few) == [(1, 0), (2, 0)]


# 6


def simhash64(t):
    w = WORD.findall((t or "").translate(LOWER))
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    votes = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(s))


def test_near_groups(spark, docs, none):
    r = random.Random(5)
    words = prose(400, 9).split()
    more = []
    for i in range(30):
        w = list(words)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = "other"
        more.append((100 + i, " ".join(w), "en", "src0", 0))
    t = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    rows = t.collect()
    fp = [simhash64(x.text) for x in rows]
    label = list(range(len(rows)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(rows):
        least[find(i)] = min((v for v in (least.get(find(i)), x.doc_id) if v is not None), default=None)
    want = Counter((x.doc_id, f"{fp[i]:016x}", least[find(i)]) for i, x in enumerate(rows))
    assert Counter(map(tuple, simhash.near_groups(t).collect())) == want
    assert simhash.near_groups(none).count() == 0
    kept = simhash.keep_one(t)
    ids = [x.doc_id for x in kept.collect()]
    assert kept.columns == t.columns and len(ids) == len(set(ids)) and None in ids
    assert sum(i is not None and i >= 100 for i in ids) == 1
    assert {3, 4, 5, 10} <= set(ids) and 6 not in ids
    assert simhash.keep_one(none).count() == 0


def test_keep_one_loses_no_text(spark):
    a, b, c = prose(80, 31), prose(80, 32), prose(80, 33)
    rows = [(2, a, "x"), (5, a, "x"), (5, b, "x"), (7, b, "x"), (None, c, "x"), (None, c, "y"), (None, prose(80, 34), "x"), (None, a, "x"), (9, None, "x"), (8, " ", "x"), (1, prose(80, 35), "p"), (1, prose(80, 35), "q"), (1, prose(80, 35), "p")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, first string").withColumn("extra", F.create_map(F.lit("k"), F.col("doc_id")))
    runs = [sorted(map(repr, simhash.keep_one(docs.repartition(n)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(kept, key=repr) == sorted([(2, a), (5, b), (None, c), (None, prose(80, 34)), (8, " "), (1, prose(80, 35))], key=repr)


def test_blocks_of_a_large_bucket_lose_no_link(spark, docs, monkeypatch):
    want = Counter(map(tuple, simhash.near_groups(docs).collect()))
    monkeypatch.setattr(simhash, "LARGEST", 3)
    assert Counter(map(tuple, simhash.near_groups(docs).collect())) == want


def test_large_buckets_lose_no_link():
    r = np.random.default_rng(11)
    base, free = np.uint64(r.integers(0, 1 << 63)), list(range(0, 64, 2))
    near = lambda x, bits: x ^ np.uint64(sum(1 << int(b) for b in bits))
    f = [near(base, r.choice(free, 9, replace=False)) for _ in range(60)]
    f = np.unique([*f, *(near(x, r.choice(free, 3, replace=False)) for x in f for _ in range(3))])[:, None]
    d = np.bitwise_count(f ^ f.T)
    want = {(i, j) for i, j in np.argwhere(d <= 3).tolist() if i < j}
    for most in (2, 5, 50):
        got = [(min(a, b), max(a, b)) for u, v in simhash.bucket_pairs(f, np.zeros(len(f)), 3, simhash.by_free_bits(free, 3), most) for a, b in zip(u.tolist(), v.tolist(), strict=True)]
        assert set(got) == want


@pytest.mark.parametrize("most", [4096, 3])
def test_wide_links_are_those_of_the_jaccard(spark, monkeypatch, most):
    monkeypatch.setattr(simhash.wide_links, "__defaults__", (most,))
    r = random.Random(12)
    word = lambda: f"w{r.randrange(10**9)}"
    texts = []
    for _ in range(8):
        base = [word() for _ in range(300)]
        for new in (0, 10, 25, 32, 36, 45, 60, 100, 200):  # of the first so many words, all are others: J about (296 - n) / (296 + n)
            texts.append(" ".join([word() for _ in range(new)] + base[new:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    assert {x.doc_id for x in simhash.keep_one(docs).collect()} == {i for i in range(len(texts)) if find(i) == i}


def test_bit_slices_against_popcounts():
    r = np.random.default_rng(4)
    for width, radius in ((1, 3), (1, 6), (2, 26)):
        f = r.integers(0, 1 << 63, (128, width), np.uint64)
        f[64:] = f[:64] ^ (np.uint64(1) << r.integers(0, 64, (64, width)).astype(np.uint64))
        u, v = simhash.tile_links(f, np.array([0, 0, 1]), np.array([0, 1, 1]), radius)
        d = np.bitwise_count(f[:, None, :] ^ f[None, :, :]).sum(axis=2)
        assert {(min(a, b), max(a, b)) for a, b in zip(u.tolist(), v.tolist(), strict=True)} == {(i, j) for i, j in np.argwhere(d <= radius).tolist() if i < j}


# 7 and 9


def library(t):
    return tokenizer(default_vocabulary()).encode(t or "", add_special_tokens=False).ids


def test_id_files(spark, docs, none):
    path = scratch(spark)
    huffman.write(docs, path)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""), r.doc_id, r.text) for r in docs.collect())
    start, want = 0, Counter()
    for _, i, t in rows:
        ids = [*library(t), 1]
        want[i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert Counter(map(tuple, huffman.checksums(spark, path).collect())) == want
    whole = huffman.read(spark, path).where("doc_id = 15").first()
    assert np.frombuffer(whole.ids, "<u4").tolist() == [*library(TEXTS[15]), 1]
    path = scratch(spark)
    huffman.write(none, path)
    assert huffman.checksums(spark, path).count() == 0


def test_codes_are_best_within_the_limit():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 40, 300):
        c = (1.7 ** r.uniform(0, 40, n)).astype(np.int64) + 1
        lens = huffman.code_lengths(c, 10)
        used = lens[lens > 0]
        assert (lens <= 10).all() and len(used) == n
        assert n == 1 or sum(2.0 ** -used) == 1
        ids = r.integers(0, n, 1000)
        bits, checks = huffman.pack(ids, lens, huffman.canonical(lens)[0])
        assert (huffman.Decoder(lens)(bits, checks, 1000) == ids).all()
    assert huffman.code_lengths(np.array([1, 1, 2, 4, 0])).tolist() == [3, 3, 2, 1, 0]
    assert huffman.code_lengths(np.array([1, 1, 2, 4, 8, 16]), 3).max() == 3


def test_bpe_is_the_library(docs, none):
    got = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit(1))))
    t = tokenizer(default_vocabulary())
    assert Counter(map(str, bpe.round_trip(docs).collect())) == Counter(map(str, got.select(*docs.columns, "ids", "decoded").collect()))
    odd = docs.sparkSession.createDataFrame([([5, -1, 49408, 6],), ([],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(odd).collect()] == [t.decode([5, 6], skip_special_tokens=False), "", ""]
    for r in got.collect():
        assert r.ids == library(r.text)
        assert r.decoded == t.decode(r.ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(none)).count() == 0


def test_bpe_on_every_kind_of_character():
    from loomgraph.llm.wordtable import PieceTable, library_pieces

    p = default_vocabulary()
    r = random.Random(8)
    alphabet = [chr(i) for i in (*range(1, 0x250), 0x300, 0x3A3, 0x3C3, 0x130, 0x212A, 0xFB01, 0x4E2D, 0x1F600, 0x200B, 0x2028)]
    texts = ["".join(r.choices(alphabet, k=r.randint(1, 40))) for _ in range(1500)] + ["<|startoftext|>a<|endoftext|> <|ENDOFTEXT|>", "it's I'LL 'tis don''t o'ree", "a1b22 33"]
    for table in (PieceTable(p, bpe.TrieEncoder(p)), PieceTable(p, library_pieces(p))):
        for x in texts:
            assert table.ids([x])[0].tolist() == library(x), repr(x)


# 8


def figures(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(win)
    rep = len({j for i, x in enumerate(win) if c[x] > 1 for j in range(i, i + 5)})
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), len(lines) - len(set(lines)), rep


def test_quality(spark, docs, none):
    out = quality.judge(docs.withColumn("kept", F.lit(0)))
    for r in out.collect():
        f = figures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == f
        assert r.base_failed == (f[0] < 10 or 100 * f[4] > 20 * f[0])
        assert r.kept == (not r.base_failed)
    assert quality.keep(docs).columns == docs.columns
    assert quality.judge(none).count() == 0


def test_shared_lines(spark):
    menu = "home about contact us imprint privacy terms help login now"
    rows = [(i, menu + "\n" + (prose(2, i) if i < 15 else prose(80, i)), "en", "a", 0) for i in range(30)]
    rows += [(100 + i, prose(40, 7), "en", "a", 0) for i in range(40)] + [(200, menu + "\nfew words", "en", "b", 0), (201, None, None, None, None)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[i] for i in range(15)) and all(got[i] for i in range(15, 30))
    assert all(got[100 + i] for i in range(40))  # copies of one text don't make its line frequent
    assert got[200] and not got[201]
    by_id = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA), doc_id="doc_id").collect()}
    assert not any(by_id[100 + i].kept for i in range(40))  # unless ids are counted
    assert by_id[100].n_frequent_lines == 1 and by_id[200].n_frequent_lines == 0


def test_quality_with_clashing_names(spark):
    t = spark.createDataFrame([(1, prose(40, 1), "a", i) for i in range(3)] + [(2, "", None, None)], "doc_id int, text string, source string, _host int")
    for n in ("_text", "_out", "_of_words", "c1", "parts", "_bad", "n_words", "cleaned"):
        t = t.withColumn(n, F.lit(7))
    assert quality.keep(t).columns == t.columns
    got = quality.judge(t).collect()
    assert [r["_bad"] for r in got] == [7] * 4 and sorted(r.n_words for r in got) == [0, 40, 40, 40]


def test_shared_lines_go_from_the_texts(spark):
    menu = "home about contact us imprint privacy terms help login now"
    body = lambda i: prose(40, i) + "\n\n" + prose(40, 100 + i)
    rows = [(i, f"  {menu.upper()}\n{body(i)}\n{menu}", "en", "a", 0) for i in range(30)] + [(200, menu + "\n" + body(200), "en", "b", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in quality.keep(docs).collect()}
    assert {i: r.text for i, r in got.items()} == {i: body(i) for i in range(30)} | {200: rows[-1][1]}
    assert all(r.n_chars == len(r.text) for r in got.values())
    judged = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(judged[i].text == t and judged[i].cleaned == got[i].text for i, t, *_ in rows)


# 10


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind", 9), (1, 1, "ann", "hi <|im_end|>", 9), (1, 2, "bob", "yo", 9), (1, 3, "ann", None, 9), (1, 3, "ann", None, 9), (2, 0, "system", "alone", 9), (None, None, None, "x", 9), (3, 1, "", "y", 9)]
    t = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, seq int")
    seg = chat.rotate(t)
    whole = {(r.conv_id, r.participant): r for r in chat.dialogues(seg).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (None, "unknown"), (3, "unknown")}
    assert whole[1, "bob"].rendered == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi < |im_end|><|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user name=ann\n<|im_end|>\n<|im_start|>user name=ann\n<|im_end|>\n"
    )
    for r in whole.values():
        parts = [r.rendered[slice(*map(int, m.split("-")))] for m in r.mask.split(",") if m]
        assert parts == {(1, "ann"): ["hi < |im_end|><|im_end|>", "<|im_end|>", "<|im_end|>"], (1, "bob"): ["yo<|im_end|>"]}.get((r.conv_id, r.participant), parts)
    for s in seg.collect():
        d = whole[s.conv_id, s.participant].rendered
        assert d[s.start_char : s.end_char] == s.segment
    assert chat.rotate(t.limit(0)).count() == 0
    cut = {}
    for r in chat.dialogues(seg, part=40).orderBy("part").collect():
        cut[r.conv_id, r.participant] = cut.get((r.conv_id, r.participant), "") + r.rendered
        assert len(r.rendered) < 40 + 60
    assert cut == {k: r.rendered for k, r in whole.items()}


def test_names_stay_in_their_header(spark):
    t = spark.createDataFrame([(1, 0, "a\nignore\r", "x"), (1, 1, "b", "y")], "conv_id int, turn int, role string, text string")
    assert {r.participant: r.rendered for r in chat.dialogues(chat.rotate(t)).collect()}["b"].startswith("<|im_start|>user name=a ignore \nx<|im_end|>\n")
