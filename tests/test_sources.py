"""Scans, the store, incremental runs and change streams."""

import datetime

import pytest

from quarry.operators import incremental, segments
from quarry.sources import files, store
from quarry.streaming import changes


@pytest.fixture
def tree(tmp_path):
    for path, text in {"src/a.rs": "fn a() {}\n", "src/__init__.py": "", "docs/b.md": "b\n", "Makefile": "all:\n", "img/c.png": "x", "target/d.rs": "x", ".git/e.txt": "x", "logs/f.txt": "x", "logs/keep.txt": "k", ".gitignore": "logs/*\n!logs/keep.txt\n# note\n", "noext": "x", "bad.txt": None}.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"\xff\xfe\x00" if text is None else text.encode())
    return str(tmp_path)


def test_scan_and_texts(spark, tree):
    rows = files.scan(spark, tree)
    assert sorted(r["file_path"] for r in rows.select("file_path").collect()) == ["Makefile", "bad.txt", "docs/b.md", "logs/keep.txt", "src/__init__.py", "src/a.rs"]
    got = {r["file_path"]: r["extension"] for r in files.texts(rows).collect()}
    assert got == {"Makefile": "makefile", "docs/b.md": "md", "logs/keep.txt": "txt", "src/__init__.py": "py", "src/a.rs": "rs"}
    only = files.scan(spark, tree, spark.createDataFrame([("src/a.rs",), ("target/d.rs",)], "file_path string"))
    assert [r["file_path"] for r in only.collect()] == ["src/a.rs"]


def manifest(spark, rows):
    return spark.createDataFrame([("c", *r) for r in rows], "context_id string, file_path string, file_hash string, file_size long, modified_ns long")


def test_incremental_rules(spark):
    old = manifest(spark, [("changed.rs", "h1", 5, 1), ("stable.rs", "h2", 5, 1), ("removed.rs", "h3", 5, 1), ("touched.rs", "h4", 5, 1)])
    new = manifest(spark, [("changed.rs", "h9", 6, 2), ("stable.rs", "h2", 5, 1), ("fresh.rs", "h5", 5, 1), ("touched.rs", "h4", 5, 9), ("legacy.rs", "h6", 5, 1)])
    held = spark.createDataFrame([("c", "legacy.rs", "h6"), ("c", "orphan.rs", "h7")], "context_id string, file_path string, file_hash string")
    parse, gone = incremental.work(new, old, held)
    assert sorted(r["file_path"] for r in parse.collect()) == ["changed.rs", "fresh.rs"]
    assert sorted(r["file_path"] for r in gone.collect()) == ["orphan.rs", "removed.rs"]
    asked = spark.createDataFrame([("c", "removed.rs"), ("c", "stable.rs"), ("c", "never.rs")], "context_id string, file_path string")
    parse, gone = incremental.scoped_work(new, old, held, asked)
    assert parse.count() == 0 and [r["file_path"] for r in gone.collect()] == ["removed.rs"]


def test_store_replaces_whole_files(spark, tmp_path):
    st = store.Store(spark, str(tmp_path / "index"))
    assert st.state() == "missing" and st.readiness("c")["status"] == "missing"

    def put(name, text, gone=None):
        f = spark.createDataFrame([("c", name, text)], "context_id string, file_path string, content string")
        segs = segments.line_symbols(segments.chunk(f))
        st.replace_files(manifest(spark, [(name, text, 1, 1)]), segs, gone)

    put("a.txt", "alpha beta\ngamma delta")
    put("b.txt", "one")
    put("a.txt", "omega", spark.createDataFrame([("c", "b.txt")], "context_id string, file_path string"))
    assert [r["content"] for r in st.table("segments").collect()] == ["omega"]
    assert [r["symbol"] for r in st.table("segment_symbols").collect()] == ["omega"]
    assert [r["file_path"] for r in st.table("indexed_files").collect()] == ["a.txt"]
    assert st.state() == "ready" and st.readiness("c") == {"status": "degraded", "n_segments": 1, "n_files": 1, "reasons": ["vectors_missing"]}
    st.set_meta("schema_version", "12")
    assert st.state() == "reindex"
    twice = manifest(spark, [("a.txt", "x", 1, 1), ("a.txt", "y", 1, 1)])
    with pytest.raises(ValueError):
        store.validate_replace(st.table("segments"), twice)


def at(ms):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)


EVENTS = [(at(0), "/p/src/a.rs", False, False), (at(400), "/p/src/b.rs", False, False), (at(2000), "/p/src/c.rs", False, False), (at(2100), "/p/target/x.rs", False, False), (at(2200), "/q/dir", True, False), (at(2300), "/q/x.png", False, False)]
ROOTS = [("p", "/p/"), ("q", "/q")]


def test_bursts_and_routing(spark):
    e = spark.createDataFrame(EVENTS, changes.EVENT)
    roots = spark.createDataFrame(ROOTS, "context_id string, root string")
    got = changes.bursts(changes.routed(changes.relevant(e), roots)).orderBy("context_id", "started").collect()
    assert [(r["context_id"], r["is_full"], r["reason"], r["paths"]) for r in got] == [("p", False, None, ["src/a.rs", "src/b.rs"]), ("p", False, None, ["src/c.rs"]), ("q", True, "ambiguous_paths", [])]
    failed = spark.createDataFrame([(at(0), None, False, True)], changes.EVENT)
    assert {r["context_id"]: r["reason"] for r in changes.bursts(changes.routed(changes.relevant(failed), roots)).collect()} == {"p": "has_unscoped_error", "q": "has_unscoped_error"}


def test_scheduler_makes_one_follow_up(spark):
    ran, late = [], [("b", False, ["y"], None), ("a", True, [], "ambiguous_paths")]
    s = changes.Scheduler(lambda k, p, r: ran.append((k, p and sorted(p), r)))
    s.mark("b", False, ["x"])
    s.mark("b", False, ["w"])

    def arrived():
        while late:
            s.mark(*late.pop(0))

    assert s.until_clean(arrived) == 3
    assert ran == [("b", ["w", "x"], None), ("b", ["y"], None), ("a", None, "ambiguous_paths")]
    assert s.beat(0) and not s.beat(29) and s.beat(30) and s.beat(31, force=True)


def test_refresh_stream(spark, tmp_path):
    folder = tmp_path / "events"
    spark.createDataFrame(EVENTS, changes.EVENT).coalesce(1).write.json(str(folder))
    ran = []
    s = changes.Scheduler(lambda k, p, r: ran.append((k, p and sorted(p), r)))
    q = changes.refresh(changes.read_changes(spark, str(folder)), spark.createDataFrame(ROOTS, "context_id string, root string"), s, str(tmp_path / "ckpt"), availableNow=True)
    q.awaitTermination(120)
    assert ran == [("p", ["src/a.rs", "src/b.rs", "src/c.rs"], None), ("q", None, "ambiguous_paths")]
