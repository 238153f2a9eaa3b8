"""A few catalogue queries against their SQL, on the smallest tables, if those are there."""

import os

import pytest

from loomgraph.plans import catalog_graph, catalog_text

SF = "/root/testdata/sf0.001"
NAMES = ["doc_dedup_ids", "chunk_window_words", "merge_edges_sum", "node_degree", "local_text_units", "hybrid_merge_entities", "naive_context", "community_schema", "metrics_mean"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    known = catalog_text.QUERIES | catalog_graph.QUERIES
    got = known[name](spark, SF).toPandas()
    want = con.sql((catalog_text.ORACLE_SQL | catalog_graph.ORACLE_SQL)[name]).df()
    rows = lambda t: sorted(map(repr, (tuple(v.item() if hasattr(v, "item") else v for v in r) for r in t[sorted(t.columns)].itertuples(index=False))))
    assert rows(got) == rows(want)


def test_entry_works_without_the_optional_parts():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
