"""Catalog queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quarry import catalog
from quarry.plans import hybrid

D = "/root/testdata/sf0.001"
NAMES = ["chunk_windows", "segment_ids", "bm25_topk", "symbol_references", "edge_budget", "replace_merge", "enclosing_scope", "intent_detection"]


def _plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = catalog.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(catalog.SQL[name])
    at = [[x[0] for x in cur.description].index(c) for c in cols]
    assert got == sorted(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())


def test_context_candidates_equal_sql(spark):
    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    want = sorted(con.execute(catalog.SQL["vector_context_candidates"]).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["vector_context_candidates"](spark, data).collect())) == want
    assert len(want) > 23  # as many as the 60 nearest of all contexts hold


def test_hybrid_vector_list_reaches_past_other_contexts(spark):
    """450 nearer vectors of another context do not crowd out the only segment's vector."""
    segments = spark.createDataFrame([("s", "src/a.py", "python", 1, 9, "alpha")], "segment_id string, file_path string, language string, line_start long, line_end long, content string")
    rows = [("s", [0.5, 0.5], "mine")] + [(f"o{k}", [1.0, 0.0], "other") for k in range(450)]
    vectors = spark.createDataFrame(rows, "vec_id string, embedding array<float>, context_id string")
    got = hybrid.hybrid_search(segments, None, "beta", 5, vectors, [1.0, 0.0]).collect()
    assert [(r["segment_id"], round(r["score"], 6)) for r in got] == [("s", round(1.5 / 61, 6))]
