"""Impact exploration on hand-built indexes."""

import pytest

from quarry.operators import segments as S
from quarry.operators.impact import Graph
from quarry.plans import impact

RELATION = "array<struct<symbol:string,edge_kind:string,kind:string>>"
SCHEMA = f"segment_id string, file_path string, language string, block_type string, content string, line_start long, line_end long, breadcrumb string, complexity int, role string, defined_symbols array<string>, referenced_symbols array<string>, called_symbols array<string>, called_relations {RELATION}, referenced_relations {RELATION}"


@pytest.fixture(autouse=True, scope="module")
def interpreted(spark):
    """A few rows are not worth compiling each plan's long expressions for."""
    conf = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def seg(name, path, line, block="function", role="DEFINITION", defines=(), refers=(), calls=(), call_edges=(), ref_edges=(), lines=5, complexity=1, crumb=None):
    return (name, path, "rust", block, f"fn {name}() {{}}", line, line + lines - 1, crumb, complexity, role, list(defines), list(refers), list(calls), list(call_edges), list(ref_edges))


def graph(spark, *rows):
    s = spark.createDataFrame(list(rows), SCHEMA).coalesce(1)
    return Graph(s, S.relations_of(s))


def told(envelope):
    rows = envelope.candidates.collect()
    return [(r["segment_id"], r["reasons"][0]["kind"]) for r in rows if r["bucket"] == "primary"], {r["segment_id"]: r["reasons"][0]["kind"] for r in rows if r["bucket"] == "contextual"}


def test_bare_call_sibling_and_test_stay_contextual(spark):
    g = graph(
        spark, seg("read", "src/settings.rs", 1, defines=["read_settings"]), seg("check", "src/settings.rs", 20, role="IMPLEMENTATION", defines=["check_settings"]),
        seg("start", "src/server.rs", 5, role="ORCHESTRATION", defines=["start_server"], calls=["read_settings"]), seg("probe", "tests/settings_test.rs", 3, defines=["settings_test"], refers=["read_settings"]))
    e = impact.from_segment(g, "read")
    primary, contextual = told(e)
    assert e.status == "empty" and primary == [] and e.hint.code == "context_only"
    assert contextual == {"check": "same_file", "start": "called_by", "probe": "test_for_file"}


def test_qualified_call_reaches_only_the_matching_owner(spark):
    g = graph(
        spark, seg("renew", "src/login/session.rs", 1, role="ORCHESTRATION", defines=["renew"], calls=["crate::login::store::open_store"]),
        seg("login-open", "src/login/store.rs", 10, defines=["open_store"]), seg("disk-open", "src/disk/store.rs", 10, defines=["open_store"]))
    e = impact.from_segment(g, "renew", limit=10)
    primary, contextual = told(e)
    assert e.status == "expanded" and [n for n, _ in primary] == ["login-open"] and "disk-open" not in contextual


def test_owner_match_survives_the_shortlist_of_three(spark):
    rows = [seg(f"{d}-open", f"src/{d}/store.rs", 10, defines=["open_store"]) for d in ("aaa", "bbb", "ccc", "zlogin")]
    edge = ("zlogin::store::open_store", "qualified_path", "call")
    g = graph(spark, seg("renew", "src/renew.rs", 1, role="ORCHESTRATION", defines=["renew"], calls=["open_store"], call_edges=[edge]), *rows)
    assert [n for n, _ in told(impact.from_segment(g, "renew", limit=10))[0]] == ["zlogin-open"]


def test_bare_call_with_two_targets_is_ambiguous(spark):
    g = graph(
        spark, seg("renew", "src/app/renew.rs", 1, role="ORCHESTRATION", defines=["renew"], calls=["open_store"]),
        seg("a-open", "src/a/store.rs", 10, defines=["open_store"]), seg("b-open", "src/b/store.rs", 10, defines=["open_store"]))
    e = impact.from_segment(g, "renew", limit=10)
    primary, contextual = told(e)
    assert e.status == "empty" and list(contextual.values()) == ["calls"]


def test_macro_edge_never_resolves_to_a_function(spark):
    g = graph(spark, seg("main", "src/main.rs", 1, role="ORCHESTRATION", defines=["main"], calls=["trace"], call_edges=[("trace", "macro_like", "call")]), seg("trace", "src/log.rs", 1, defines=["trace"]))
    assert impact.from_segment(g, "main").candidates.count() == 0


def test_trait_anchor_names_its_implementor(spark):
    impl = seg("disk-impl", "src/disk.rs", 30, block="impl", role="IMPLEMENTATION", defines=["Disk"], refers=["Store"], ref_edges=[("Store", "bare_identifier", "conformance")], lines=20, complexity=3)
    g = graph(spark, seg("store", "src/store.rs", 1, block="trait", defines=["Store"]), seg("disk", "src/disk.rs", 5, block="struct", defines=["Disk"]), impl)
    e = impact.from_symbol(g, "Store")
    primary, _ = told(e)
    assert primary == [("disk-impl", "implemented_by")]


def test_broad_symbols_are_refused_and_a_scope_narrows_them(spark):
    rows = [seg(f"{d}-conf", f"{d}/core/conf.rs", 1, block="struct", defines=["Conf"]) for d in ("api", "cli", "web", "job")]
    user = seg("build", "api/core/build.rs", 9, role="ORCHESTRATION", defines=["build"], refers=["Conf"], calls=["Conf"], ref_edges=[("api::core::conf::Conf", "qualified_path", None)], lines=12, complexity=4)
    g = graph(spark, *rows, user, seg("probe", "tests/conf_test.rs", 1, block="struct", defines=["Conf"]))
    e = impact.from_symbol(g, "Conf")
    assert (e.status, e.refusal, e.hint.code) == ("refused", "symbol_too_broad", "narrow_with_scope")
    e = impact.from_symbol(g, "Conf", scope="api")
    assert e.status == "expanded_scoped" and told(e)[0][0][0] == "build"


def test_refusals(spark):
    g = graph(spark, seg("abc1", "src/a.rs", 1, defines=["a"]), seg("abc2", "src/b.rs", 1, defines=["b"]))
    assert impact.from_file(g, "src/none.rs").refusal == "anchor_not_indexed"
    assert impact.from_segment(g, ":zz").refusal == "anchor_not_found"
    assert impact.from_segment(g, "abc").refusal == "anchor_ambiguous"
    e = impact.from_file(g, "./src/a.rs", scope="lib")
    assert (e.refusal, e.hint.code, e.hint.scope) == ("anchor_out_of_scope", "align_anchor_and_scope", "src")
    assert impact.from_symbol(g, "nothinglikeit").refusal == "anchor_not_found"
    with pytest.raises(ValueError):
        impact.from_file(g, "src/a.rs", 0)


def test_file_line_takes_the_nearest_segment(spark):
    g = graph(spark, seg("top", "src/a.rs", 1, defines=["top"]), seg("low", "src/a.rs", 20, defines=["low"]))
    e = impact.from_file(g, "src/a.rs", 18)
    assert e.status == "empty" and told(e)[1] == {"top": "same_file"}


def test_isolated_file_in_scope_is_empty(spark):
    g = graph(spark, seg("only", "src/deep/only.rs", 1, defines=["only"]))
    e = impact.from_file(g, "src/deep/only.rs", scope="src/deep")
    assert (e.status, e.hint.code, e.candidates.count()) == ("empty_scoped", "no_likely_impact", 0)


def test_two_sources_promote_a_reference(spark):
    user = seg("user", "lib/user.rs", 1, role="IMPLEMENTATION", defines=["user"], refers=["Shared"], lines=12, complexity=3)
    g = graph(spark, seg("one", "src/one.rs", 1, block="struct", defines=["Shared"]), seg("two", "src/two.rs", 1, block="struct", defines=["Shared"]), user)
    e = impact.from_symbol(g, "Shared")
    assert told(e)[0] == [("user", "references_symbol")]
