"""The subpackage's queries, each over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score

    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), part == 1)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan

    out = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", *(F.round(c, 9).alias(c) for c in ("position", "position_2", "position_3")))


#: Action, host and path of the rules.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge

    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import scratch
    from .huffman import checksums, write

    path = scratch(spark)
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return checksums(spark, path)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_lines"
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = round_trip(docs)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import dialogues, rotate

    return dialogues(rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def chat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import rotate

    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import ranked

    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import figures, repeated_from

    return figures(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewrite=repeated_from)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_hmm_scoring": op2_hmm_scoring,
    "op3_mixing": op3_mixing,
    "op4_url_filter": op4_url_filter,
    "op5_multi_index": op5_multi_index,
    "op6_simhash": op6_simhash,
    "op7_huffman_ids": op7_huffman_ids,
    "op8_quality_rules": op8_quality_rules,
    "op9_bpe": op9_bpe,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_importance": op11_importance,
    "op12_secret_scan": op12_secret_scan,
    "op13_periodic_runs": op13_periodic_runs,
    "chat_segments": chat_segments,
}

WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
BARE = r"regexp_replace({0}, '[\x20\x09-\x0D]+', '', 'g')"

_DUE = "round(abs(CASE WHEN abs(pull) < 1e-12 THEN {0} ELSE ((1 + pull) - sqrt(greatest((1 + pull) * (1 + pull) - 4 * pull * {0}, 0))) / (2 * pull) END), 9)"
#: For op3: sources by code point, water-filled targets (the level at which no further source reaches its bound), and the words taken in hash order.
MIXING_SQL = f"""WITH d AS (SELECT doc_id, source, CAST(len({WORDS.format("text")}) AS BIGINT) AS size, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS h, md5(coalesce(text, '')) AS t FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
a AS (SELECT *, 3 * source_size AS cap, (SELECT sum(source_size) FROM s) AS total FROM s),
k AS (SELECT *, row_number() OVER (ORDER BY cap * 1.0 / w, source NULLS LAST) AS i FROM a),
o AS (SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lv FROM k),
l AS (SELECT arg_min(lv, i) AS level FROM o WHERE lv < CAST(cap AS DOUBLE) / w),
g AS (SELECT source, source_size, w, CASE WHEN level IS NULL OR cap <= level * w THEN CAST(cap AS DOUBLE) ELSE level * w END AS target FROM a, l),
p AS (SELECT doc_id, size, source_size, target, 0.5 * (1 - 2 * (w - 1) / 2.0) AS pull, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS f FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, CAST(round(target) AS BIGINT) AS due FROM p),
r AS (SELECT *, greatest(0, least(size, due - f)) + greatest(0, least(size, due - source_size - f)) + greatest(0, least(size, due - 2 * source_size - f)) AS taken, f / target AS x, (f + source_size) / target AS x2, (f + 2 * source_size) / target AS x3 FROM q)
SELECT doc_id, size, source_size, target, taken, CASE WHEN size > 0 AND f < due THEN {_DUE.format('x')} END AS position, CASE WHEN size > 0 AND f + source_size < due THEN {_DUE.format('x2')} END AS position_2,
CASE WHEN size > 0 AND f + 2 * source_size < due THEN {_DUE.format('x3')} END AS position_3 FROM r"""

_RULES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)
URL_SQL = f"""WITH u AS (SELECT row_number() OVER () AS i, page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(action, h, p) AS (VALUES {_RULES}), m AS (SELECT i, page_id, host, path, h || p AS rule, action FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(action, length(rule)), 'allow') AS verdict FROM m GROUP BY i, page_id, host, path"""

QUALITY_SQL = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, {WORDS.format("text")} AS w, list_filter(string_split(text, chr(10)), lambda x: {BARE.format("x")} <> '') AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 4)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM c WHERE n > 1) GROUP BY doc_id),
f AS (SELECT doc_id, host, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length({BARE.format("text")}) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
x AS (SELECT doc_id, host, text, lower(trim(regexp_replace(y, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS line, len({WORDS.format("y")}) AS n FROM (SELECT doc_id, host, text, unnest(l) AS y FROM w)),
often AS (SELECT host, line FROM x GROUP BY 1, 2 HAVING count(DISTINCT text) > 10),
lost AS (SELECT doc_id, sum(n) AS lost, count(*) AS frequent FROM x SEMI JOIN often USING (host, line) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT coalesce(n_words - lost < 0.3 * n_words, false) AS kept, coalesce(frequent, 0) AS n_frequent_lines FROM f LEFT JOIN lost USING (doc_id)"""

_VIEWS = """WITH m AS (SELECT conv_id, turn, replace(translate(coalesce(nullif(role, ''), 'unknown'), chr(10) || chr(13), '  '), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS participant FROM m WHERE speaker <> 'system'),
v AS (SELECT m.conv_id, participant, turn, speaker, body, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant' ELSE 'user' END AS tag FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|im_start|>' || CASE tag WHEN 'user' THEN 'user name=' || speaker ELSE tag END || chr(10) AS head FROM v), s AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, row_number() OVER k - 1 AS seq, CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM s WINDOW k AS (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, body)),
e AS (SELECT conv_id, participant, seq, tag, segment, start_char, start_char + length(segment) AS end_char, CASE WHEN tag = 'assistant' THEN start_char + length(head) ELSE start_char END AS mask_start, CASE WHEN tag = 'assistant' THEN start_char + length(segment) - 1 ELSE start_char END AS mask_end FROM o)"""
SEGMENT_SQL = _VIEWS + "\nSELECT * FROM e"
CHAT_SQL = _VIEWS + """
SELECT conv_id, participant, CAST(start_char // 1048576 AS INTEGER) AS part, string_agg(segment, '' ORDER BY seq) AS rendered,
coalesce(string_agg(CASE WHEN mask_end > mask_start THEN mask_start || '-' || mask_end END, ',' ORDER BY seq), '') AS mask FROM e GROUP BY 1, 2, 3"""

#: For op11: CRC-32 over the distinct words' bytes by a table made of its rule.
IMPORTANCE_SQL = r"""WITH tab AS (SELECT list(list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
low AS (SELECT 0 AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT kind, id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM low),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::UBIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::INT + 1])), 4294967295::UBIGINT) % 10000 AS bucket FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM w)), tab),
f AS (SELECT kind, id, bucket, count(*) AS n FROM w JOIN b USING (word) GROUP BY 1, 2, 3),
c AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE kind = 1), 0)::DOUBLE AS t FROM f GROUP BY 1),
a AS (SELECT sum(s) + 10000 AS all_s, sum(t) + 10000 AS all_t FROM c), g AS (SELECT bucket, floor(1000 * ln((t + 1) * all_s / ((s + 1) * all_t)))::BIGINT AS gain FROM c, a),
d AS (SELECT id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE kind = 0 GROUP BY 1),
x AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN d ON id = doc_id),
k AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS r FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT 10 * count(r) // 100 FROM k) THEN r END AS rank FROM k"""



def _secret_sql() -> str:
    """For op12: the patterns' matches by the pieces between them, and every window of the long strings by its distinct characters' counts."""
    from . import secrets

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = [("assign", secrets.ASSIGN, 2), ("access", secrets.ACCESS, 0), ("hex", secrets.HEX, 0), *((c.kind, f"{c.pattern}{{{secrets.WINDOW},}}", 0) for c in secrets.CLASSES)]
    found = " UNION ALL ".join(
        f"SELECT i, {r} AS rank, {quote(k)} AS kind, regexp_extract_all(text, {quote(p)}, 0) AS m, regexp_extract_all(text, {quote(p)}, {g}) AS v, string_split_regex(text, {quote(p)}) AS gaps FROM d" for r, (k, p, g) in enumerate(kinds)
    )
    least = " ".join(f"WHEN {quote(k)} THEN {n}" for k, n in secrets.LEAST.items())
    most = " ".join(f"WHEN {quote(c.kind)} THEN {c.most}" for c in secrets.CLASSES)
    fold = ", ".join(quote(c.kind) for c in secrets.CLASSES if c.fold)
    span = "kind || ':' || s || ':' || e"
    count = lambda k: f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}"
    return f"""WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text FROM documents), f AS ({found}),
j AS (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM f WHERE len(m) > 0),
p AS (SELECT i, rank, kind, v[j] AS v, CAST(list_sum(list_transform(gaps[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[j]) AS n FROM j),
c AS (SELECT *, row_number() OVER () AS c, CASE WHEN kind IN ({fold}) THEN lower(v) ELSE v END AS w FROM p WHERE rank > 2 AND NOT ({" OR ".join(f"regexp_matches(v, {quote(a)})" for a in secrets.ALLOWED)})),
x AS (SELECT *, substr(w, b + 1, {secrets.WINDOW}) AS y FROM (SELECT *, unnest(range(0, length(w) - {secrets.WINDOW - 1})) AS b FROM c)),
h AS (SELECT *, b - lag(b) OVER (PARTITION BY c ORDER BY b) AS gap FROM x WHERE list_sum(list_transform(list_distinct(string_split(y, '')), lambda z: {secrets.costs()}[length(y) - length(replace(y, z, '')) + 1])) <= CASE kind {most} END),
r AS (SELECT *, count(CASE WHEN gap > {secrets.WINDOW} THEN 1 END) OVER (PARTITION BY c ORDER BY b) AS r FROM h),
o AS (SELECT i, rank, kind, s, s + n AS e FROM p WHERE length(v) >= CASE kind {least} END UNION ALL SELECT i, rank, kind, s + min(b), s + max(b) + {secrets.WINDOW} FROM r GROUP BY i, rank, kind, c, s, r),
a AS (SELECT i, {count("assign")}, {count("access")}, {count("hex")}, string_agg({span}, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base, string_agg({span}, ',' ORDER BY s, rank) AS spans FROM o GROUP BY i)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (i)"""


ORACLE_SQL: dict[str, str] = {"op12_secret_scan": _secret_sql(), "op11_importance": IMPORTANCE_SQL, "op3_mixing": MIXING_SQL, "op4_url_filter": URL_SQL, "op8_quality_rules": QUALITY_SQL, "op10_chat_formatting": CHAT_SQL, "chat_segments": SEGMENT_SQL}
