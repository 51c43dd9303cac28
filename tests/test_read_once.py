"""Searches that read the texts once, and names counted within a segment's row."""

import pytest
from pyspark.sql import functions as F

from quarry import catalog
from quarry.operators import search, segments, symbols
from test_scans import D, scans


@pytest.mark.parametrize("name", ["fused_top", "fused_boosts", "rrf_fusion", "overlap_dedupe_file_cap"])
def test_fused_queries_read_texts_once(spark, monkeypatch, name):
    read, kept = [], getattr(search, "read_once", None)
    monkeypatch.setattr(search, "read_once", lambda rows: read.append(scans(rows)) or kept(rows), raising=False)
    assert scans(catalog.QUERIES[name](spark, D)) == 0 and read == [1]


def test_held_names_are_those_of_occurrences(spark):
    names = ["B-c", "bc", "a\nb", None, "!", "BC"]
    rows = [("1", names, ["bc", "x"]), ("2", ["x", "X"], None), ("3", [], []), ("4", None, ["A-B", "ab", "abc"]), ("5", ["ab", None], ["b", "c"])]
    s = spark.createDataFrame(rows, "segment_id string, defined_symbols array<string>, referenced_symbols array<string>")
    for wanted in (["bc", "ab"], ["a", "b", "x", ""], ["Ä"]):
        want = symbols.occurrences(s).where(F.col("canonical_symbol").isin(*wanted) & (F.col("canonical_symbol") != "")).groupBy("segment_id").count()
        got = symbols.with_held(s, wanted, "n").select("segment_id", "n").where("n > 0")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_letters_tell_where_a_name_may_stand(spark):
    s = spark.createDataFrame([("1", "  E-Da.n x\nno"), ("2", "ed an"), ("3", "nothing here"), ("4", None)], "segment_id string, content string")
    may = s.withColumn("_t", search.tokens(F.col("content"))).select("segment_id", symbols.may_hold(F.array_join("_t", ""), ["edan"]).alias("m"))
    n = symbols.with_held(segments.line_symbols(s), ["edan"], "n").select("segment_id", "n")
    assert {r["segment_id"] for r in n.where("n > 0").collect()} == {"1"} <= {r["segment_id"] for r in may.where("m").collect()} == {"1", "2"}


def test_hybrid_search_reads_texts_for_counts_anchors_and_contents_only(spark, monkeypatch):
    read, kept = [], getattr(search, "read_once", None)
    monkeypatch.setattr(search, "read_once", lambda rows: read.append(scans(rows)) or kept(rows), raising=False)
    assert scans(catalog.QUERIES["hybrid_search"](spark, D)) <= 2 and read == [1]
