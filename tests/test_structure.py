"""Structural segments of small sources, and what is read from them."""

import pytest

from quarry.operators import context, structure

RUST = '''use std::io::Read;

/// A shelf.
pub struct Shelf {
    books: Vec<Book>,
}

impl Store for Shelf {
    // finds "fn ghost() {"
    fn find(&self, key: &str) -> Option<Book> {
        for b in self.books.iter() {
            if b.matches(key) {
                return Some(codec::decode(b));
            }
        }
        log!("none");
        None
    }
}
'''
PYTHON = '''import os
from a import b as c

@wrap
def run(x):
    for y in x:
        if y:
            helper.call(y)

class Box(Base):
    def get(self):
        return make(self.item)
'''
TS = '''import { a } from "./a";

export interface Shape extends Base, Other<Thing> { area(): number; }

export class Round extends Solid implements Shape {
  area() { return new Disk(this.r).size(); }
}
export function draw(s: Shape) { paint.line(s); }
'''


def by_name(text, language):
    return {(b.block_type, b.name or b.defines[0]): b for b in structure.blocks(text, language)}


def test_rust_blocks():
    b = by_name(RUST, "rust")
    assert list(b) == [("import", "std::io::Read"), ("struct", "Shelf"), ("impl", "Shelf"), ("function", "find")]
    assert (b["struct", "Shelf"].first, b["struct", "Shelf"].last) == (3, 6)
    f = b["function", "find"]
    assert (f.breadcrumb, f.role, f.complexity, f.first, f.last) == ("Shelf", "IMPLEMENTATION", 2, 9, 18)
    assert ("codec::decode", "qualified_path", None) in f.calls and ("log", "macro_like", None) in f.calls and ("b.matches", "member_access", None) in f.calls
    assert ("Store", "bare_identifier", "conformance") in b["impl", "Shelf"].refers


def test_python_blocks():
    b = by_name(PYTHON, "python")
    run = b["function", "run"]
    assert (run.first, run.last, run.complexity) == (4, 8, 2) and run.calls == [("helper.call", "member_access", None)]
    assert b["function", "get"].breadcrumb == "Box" and b["class", "Box"].role == "DEFINITION"
    assert "self" not in [t for t, _, _ in b["function", "get"].refers]
    assert structure.blocks("def broken(:", "python") == []


def test_typescript_blocks():
    b = by_name(TS, "typescript")
    assert [t for t, _, k in b["interface", "Shape"].refers if k] == ["Base", "Other"]
    assert [t for t, _, k in b["class", "Round"].refers if k] == ["Solid", "Shape"]
    assert ("Disk", "constructor_like", None) in b["function", "area"].calls and b["function", "area"].breadcrumb == "Round"
    assert b["function", "draw"].calls == [("paint.line", "member_access", None)]


def test_ingest_routes_and_context(spark):
    files = spark.createDataFrame([("c", "src/shelf.rs", RUST), ("c", "notes.md", "# a\nb"), ("c", "bad.py", "def broken(:"), ("c", "x.unknown", "x")], "context_id string, file_path string, content string")
    segs = structure.ingest(files)
    got = {(r["file_path"], r["block_type"]) for r in segs.collect()}
    assert got == {("src/shelf.rs", t) for t in ("import", "struct", "impl", "function")} | {("notes.md", "chunk"), ("bad.py", "chunk")}
    points = spark.createDataFrame([("src/shelf.rs", 12), ("src/shelf.rs", 2), ("../x", 1), ("notes.md", 99)], "file_path string, line long")
    out = {r["line"]: (r["scope"], r["line_start"], r["line_end"]) for r in context.context(files, segs, points, 1).collect()}
    assert out == {12: ("function", 9, 18), 2: ("lines", 1, 3)}


def test_structural_search(spark):
    files = spark.createDataFrame([("a.py", PYTHON), ("b.rs", RUST)], "file_path string, content string")
    assert [r["line"] for r in structure.search(files, "python", "FunctionDef").orderBy("line").collect()] == [5, 11]
    assert [r["text"] for r in structure.search(files, "rust", r"fn (\w+)").collect()] == ["find"]
    with pytest.raises(ValueError):
        structure.search(files, "python", "NoSuchNode")
