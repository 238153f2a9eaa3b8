import os

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import quality

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_one_by_one(spark):
    words = lambda n, s: " ".join(f"w{(i * i + s * 7919) % 9973}x{i % 13}{'abcdefgh'[(i + s) % 8]}" for i in range(n))
    passage = words(70, 1)
    rows = [(i, words(120, 10 + i), "en", f"s{i % 4}", 0) for i in range(12)]
    rows += [(20, words(300, 50), "en", "s0", 0), (21, words(300, 50), "en", "s1", 0), (22, words(300, 50).replace("w", "W", 3), "en", "s2", 0)]
    rows += [(30 + i, words(200, 60 + i) + " " + passage + " " + words(90, 80 + i), "en", "s3", 0) for i in range(3)]
    rows += [(40, "too short", "en", "s0", 0), (41, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "near_dedup", "repeat_dedup", "source_mix", "token_ids"]
    seen = [docs]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        seen.append(pipeline.common.materialize(stage(spark, seen[-1], "")))
        if i < 4:
            assert seen[-1].columns == docs.columns
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    assert ids[1] == ids[0] - {40, 41}
    assert ids[2] == ids[1] - {21, 22}
    assert seen[3].where(F.col("text").contains(passage[50:250])).count() == 0
    assert seen[3].where("doc_id < 20").join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").where("text <> t").count() == 0
    assert ids[4] <= ids[3]
    assert seen[5].where(F.size("ids") == 0).count() == 0
    assert seen[5].count() == seen[4].count()


def test_run(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g h i j k", "en", "s", 21)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).select("doc_id").collect()[0].doc_id == 1
    assert quality.keep(spark.read.parquet(f"{tmp_path}/documents.parquet")).count() == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_some_lines_of_the_tables_are_over_the_limit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    line = F.explode(F.split("text", "\n")).alias("line")
    spread = docs.select("source", "text", line).groupBy("source", "line").agg(F.count_distinct("text").alias("n")).where("n > 50 and trim(line) <> ''")
    assert spread.count()
    kept = pipeline.common.materialize(pipeline.quality_rules(spark, docs, ""))
    held = kept.select("source", line).join(spread, ["source", "line"], "left_semi")
    assert kept.count() > 0 and held.count() == 0
