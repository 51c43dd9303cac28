"""Symbols taken from texts in columns of bytes and numbers."""

import re

import duckdb
import pytest

from quarry import catalog
from quarry.operators import segments, symbols
from test_scans import D, plan

ODD = ["", " ", "\n", "a", "  ab  cdef ääää abc cdef CDEF\n\n   \nx\rlong word yy zzzz\n", "\n \n B-c bc_ B-C_ é-é éé-é\n", "Ä ä ΟΔΟΣ οδος ΟΔΟΣ.x\nİx ix", "_ __ !!!! -\n!!!! abcd", "αβγ αβγδ 1 12 1234 ½½½½\n٣٣٣٣ x\x00yzw", "same same\nsame same", "l" * 70 + " " + "m" * 70]


def _segments(spark, texts):
    return spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "segment_id string, content string")


@pytest.mark.parametrize("piece", [1, 40, 1 << 21])
def test_line_occurrences_are_those_of_line_symbols(spark, monkeypatch, piece):
    monkeypatch.setattr(symbols, "PIECE", piece)
    s = _segments(spark, [*ODD, None, *reversed(ODD)]).coalesce(1)
    got = symbols.line_occurrences(s)
    want = symbols.occurrences(segments.line_symbols(s)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["symbol_rows", "symbol_exact", "symbol_references"])
def test_occurrences_take_no_pattern_and_no_sort_of_tokens(spark, name):
    p = plan(catalog.QUERIES[name](spark, D))
    assert "MapInArrow" in p and not re.search(r"regexp_extract_all|sort_array|array_except", p)


def test_letters_newer_than_java_are_those_of_sql(spark, tmp_path):
    rows = [(1, "newࡰword ࡱࡲࡳࡴ ab-cd ABCD\nx Äbcd äbcd", "en", "s"), (2, None, "en", "s"), (3, "", "de", "t"), (4, "a\r\nb cdef\r\n", "de", "t")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    df = catalog.QUERIES["symbol_rows"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(catalog.SQL["symbol_rows"]).fetchall())


@pytest.mark.parametrize("piece", [1, 40, 1 << 21])
def test_line_names_are_those_of_occurrences(spark, monkeypatch, piece):
    monkeypatch.setattr(symbols, "PIECE", piece)
    s = _segments(spark, [*ODD, None, *reversed(ODD)]).coalesce(1)
    want = {r["canonical_symbol"] for r in symbols.occurrences(segments.line_symbols(s)).collect()}
    assert {r["canonical_symbol"] for r in symbols.line_names(s).collect()} == want


@pytest.mark.parametrize("name", ["symbol_contains", "symbol_prefix", "symbol_fuzzy"])
def test_distinct_names_leave_workers_without_their_segments(spark, name):
    p = plan(catalog.QUERIES[name](spark, D))
    assert re.search(r"MapInArrow take\(content#\d+\)#\d+, \[canonical_symbol#\d+\]", p) and "reference_kind" not in p
