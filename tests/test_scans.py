"""How often the named queries read the texts, and what they do to each of them."""

import re

import pytest
from pyspark.sql import functions as F

from quarry import catalog
from quarry.operators import search, segments, symbols

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def scans(df):
    return len(re.findall(r"Relation \[[^\]]*text#", plan(df)))


@pytest.mark.parametrize("name, most", [("symbol_rows", 1), ("symbol_contains", 1), ("symbol_references", 1), ("symbol_exact", 2), ("symbol_fuzzy", 2), ("overlap_dedupe_file_cap", 5), ("fused_top", 5), ("fused_boosts", 5), ("rrf_fusion", 4)])
def test_texts_are_read_no_oftener(spark, name, most):
    assert scans(catalog.QUERIES[name](spark, D)) <= most


@pytest.mark.parametrize("name", ["hybrid_search", "rrf_fusion", "fused_boosts"])
def test_no_filter_repeats_the_reading_of_a_text(spark, name):
    filters = [x for x in plan(catalog.QUERIES[name](spark, D)).splitlines() if re.match(r"[\s:+-]*Filter ", x)]
    assert filters and not any(f"{x}(" in f for f in filters for x in ("split", "regexp_replace", "regexp_extract_all"))


def test_inverted_index_exchanges_terms_only(spark):
    s = spark.createDataFrame([("a", "x y x"), ("b", ""), ("c", "- Y"), ("d", None)], "segment_id string, content string")
    p = search.postings(s)
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, p.select("segment_id", "term", "tf", "len").collect())) == [("a", "x", 2, 3), ("a", "y", 1, 3), ("c", "y", 1, 1)]


def test_first_spelling_of_each_name(spark):
    names = ["B-c", "bc", "Ä", "a\nb", None, "ab", "!", "BC"]
    s = spark.createDataFrame([("1", names, ["bc"]), ("2", ["x", "X"], None), ("3", [], [])], "segment_id string, defined_symbols array<string>, referenced_symbols array<string>")
    got = symbols.occurrences(s).select("segment_id", "reference_kind", "canonical_symbol", "symbol").collect()
    assert sorted(map(tuple, got)) == [("1", "definition", "ab", "a\nb"), ("1", "definition", "bc", "B-c"), ("1", "definition", "ä", "Ä"), ("1", "usage", "bc", "bc"), ("2", "definition", "x", "x")]


def test_tokens_of_a_line(spark):
    text = "  ab  cdef ääää abc\n\n   \nx\rlong\u2028word yy zzzz\n"
    row = segments.line_symbols(spark.createDataFrame([(text,)], "content string")).first()
    assert row["defined_symbols"] == ["ab", "x\rlong\u2028word"] and row["referenced_symbols"] == ["cdef", "ääää", "zzzz"]


@pytest.mark.parametrize("text, lines", [("a\n\n", ["a", ""]), ("a\r\n", ["a"]), ("a\n\r", ["a", "\r"]), ("\n", [""]), ("", []), (None, []), ("a\r\nb", ["a", "b"])])
def test_one_line_end_goes(spark, text, lines):
    assert spark.createDataFrame([(text,)], "content string").select(segments.lines_of(F.col("content"))).first()[0] == lines


def test_references_and_both_kinds(spark):
    s = spark.createDataFrame([("1", "n", "N", "definition"), ("1", "n", "n", "usage"), ("2", "n", "n", "usage"), ("3", "m", "m", "usage")], "segment_id string, canonical_symbol string, symbol string, reference_kind string")
    assert sorted(map(tuple, symbols.references(s, "n").collect())) == [("1", "definition"), ("2", "usage")]
    segs = spark.createDataFrame([(k, "p", 1) for k in "123"], "segment_id string, file_path string, line_start long")
    assert len(symbols.exact(s, segs, "n", None).collect()) == 3 and len(symbols.exact(s, segs, "n").collect()) == 1


def test_fuzzy_reads_one_exchange(spark):
    df = catalog.QUERIES["symbol_fuzzy"](spark, D)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1
