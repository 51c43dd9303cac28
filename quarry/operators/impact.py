"""Impact exploration: anchors, two budgeted hops over late-bound edges, and ranked, explained candidates.

Nodes are segments, edges name symbols. A hop is a handful of joins keyed by the frontier: edges of
the frontier are filtered first, then budgeted, then resolved, so no step touches the whole graph.
Every candidate is scored by one column expression; choices among candidates are windows over an
edge's few definitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Budgets, weights and thresholds.
PER_HOP, MAX_DEPTH, MAX_LIMIT, PER_FILE, REASONS = 8, 2, 20, 3, 3
FILE_SEEDS, SYMBOL_SEEDS, SYMBOL_FILES, SYMBOL_DIRS, TARGETS = 5, 3, 3, 2, 3
TEST_FILES, TEST_FACTOR = (2, 12), 2
BASE = {"call": 1.0, "conformance": 1.05, "reference": 0.65}
SAME_FILE, TEST = 0.70, 0.55
DECAY, SCOPED, WORKING = 0.70, 1.10, 1.05
SOLO, CONTESTED, CONTEXTUAL, MARGIN, OWNED, SIGNALS = 0.45, 0.55, 0.35, 0.08, 0.60, 2
EDGE_SIGNAL, PATH_SIGNAL, ROLE_SIGNAL = 0.65, 0.30, 0.75
DEFINITION_TYPES = ("function", "method", "impl", "struct", "enum", "trait", "type", "class", "interface", "module", "macro")
DECLARATIONS = ("struct", "enum", "trait", "type", "class", "interface", "module")
CONSTRUCTED = ("constructor", "class", "struct", "enum")
OUT_REASON = {"call": "calls", "conformance": "conforms_to", "reference": "references_symbol"}
IN_REASON = {"call": "called_by", "conformance": "implemented_by", "reference": "references_symbol"}
NODE = ("segment_id", "file_path", "language", "block_type", "line_start", "line_end", "breadcrumb", "complexity", "role", "defined_symbols", "called_symbols")
OBSERVED = ("segment_id", "bucket", "score", "hop", "kind", "symbol", "origin")


def _pick(key: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def node(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in NODE])


def defined(n: Column) -> Column:
    return F.coalesce(n["defined_symbols"], F.array().cast("array<string>"))


def lookup_tail(symbol: Column) -> Column:
    return F.try_element_at(T.components(symbol), F.lit(-1))


def is_definition_like(n: Column) -> Column:
    return F.coalesce(n["role"] == "DEFINITION", F.lit(False)) | ((F.size(defined(n)) > 0) & n["block_type"].isin(*DEFINITION_TYPES))


def is_working(n: Column) -> Column:
    return F.coalesce(n["role"].isin("IMPLEMENTATION", "ORCHESTRATION"), F.lit(False))


def is_test_context(n: Column) -> Column:
    return T.is_test_path(n["file_path"]) | T.has_test_token(n["file_path"]) | (F.lower(n["block_type"]) == "test") | T.has_test_token(n["breadcrumb"]) | F.exists(defined(n), T.has_test_token)


def definition_owner(n: Column) -> Column:
    """Owner components of a definition: its path's, then new ones of its breadcrumb and of its symbols' qualifiers."""
    none = F.array().cast("array<string>")
    qualifiers = F.flatten(F.transform(F.transform(defined(n), T.owner_components), lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))))
    more = F.array_distinct(F.concat(F.coalesce(T.owner_components(n["breadcrumb"]), none), qualifiers))
    return T.let(T.owner_components(n["file_path"]), lambda path: F.concat(path, F.filter(more, lambda x: ~F.array_contains(path, x))))


def symbol_score(edge: Column, n: Column) -> Column:
    """1 where a defined symbol is the target, 0.85 where its last component is, else 0."""
    same = F.exists(defined(n), lambda s: T.canonical(s) == edge["canonical_target"])
    tail = F.exists(defined(n), lambda s: F.coalesce(lookup_tail(s) == edge["lookup_symbol"], F.lit(False)))
    return F.when(same, 1.0).when(tail, 0.85).otherwise(0.0)


def edge_score(edge: Column, n: Column, aligned: Column, named: Column) -> Column:
    kind, bare = edge["edge_kind"], edge["owner"] == ""
    structure = F.when(bare, named).otherwise(aligned)
    settled = F.coalesce(n["role"].isin("DEFINITION", "IMPLEMENTATION", "ORCHESTRATION"), F.lit(False))
    return (
        F.when(kind == "qualified_path", aligned * 0.65 + 0.35)
        .when(kind.isin("member_access", "method_receiver"), (structure * 0.60 + 0.40) * F.when(settled, 1.0).otherwise(0.8))
        .when(kind == "constructor_like", n["block_type"].isin(*CONSTRUCTED).cast("double"))
        .when(kind == "macro_like", (n["block_type"] == "macro").cast("double"))
        .when(kind == "bare_identifier", F.when(bare, 0.30).otherwise(aligned * 0.40 + 0.45))
        .otherwise(structure * 0.50 + 0.35)
    )


def role_score(role: Column) -> Column:
    return F.coalesce(_pick(role, {"IMPLEMENTATION": 1.0, "ORCHESTRATION": 0.95, "DEFINITION": 0.75, "IMPORT": 0.10, "DOCS": 0.05}), F.lit(0.60))


def is_wrapper(n: Column) -> Column:
    """A short working segment without branches that calls one thing at most."""
    return is_working(n) & (n["line_end"] - n["line_start"] + 1 <= 4) & (F.coalesce(n["complexity"], F.lit(0)) <= 1) & (F.size(F.coalesce(n["called_symbols"], F.array().cast("array<string>"))) <= 1)


def scored(rows: DataFrame, edge: str, source_path: str, target: str, emitted: str) -> DataFrame:
    """`rows` with confidence, signals, aligned and exact of an edge to its target, for the node it emits."""
    e, t, m = F.col(edge), F.col(target), F.col(emitted)
    one = F.lit(1)
    rows = rows.withColumns({"qualifier": T.owner_components(e["owner"]), "owners": definition_owner(t)})
    rows = rows.withColumns({"named": symbol_score(e, t), "aligned": T.alignment(F.col("qualifier"), F.col("owners")), "near": T.component_affinity(F.col(source_path), t["file_path"]), "suits": role_score(m["role"])})
    rows = rows.withColumn("shaped", edge_score(e, t, F.col("aligned"), F.col("named")))
    plain = (e["owner"] == "") & (e["edge_kind"] == "bare_identifier")
    rows = rows.withColumn("exact", F.when(e["kind"] == "conformance", F.col("named") >= 0.85).otherwise((F.col("named") >= 1) & ~plain))
    count = lambda c: F.when(c, one).otherwise(0)
    rows = rows.withColumn("signals", count(F.col("exact")) + count(F.col("aligned") >= OWNED) + count(F.col("shaped") >= EDGE_SIGNAL) + count(F.col("near") >= PATH_SIGNAL) + count(F.col("suits") >= ROLE_SIGNAL))
    gate = F.when(e["owner"] == "", 1.0).otherwise(F.greatest("aligned", "shaped") * 0.45 + 0.55)
    loose = (F.col("aligned") == 0) & (e["owner"] != "") & e["edge_kind"].isin("member_access", "method_receiver")
    declared = (e["kind"] != "conformance") & (F.col("aligned") == 0) & F.coalesce(m["role"] == "DEFINITION", F.lit(False)) & m["block_type"].isin(*DECLARATIONS)
    factor = F.when(F.col("signals") < SIGNALS, 0.85).otherwise(1.0) * F.when(is_wrapper(m), 0.82).otherwise(1.0) * F.when(loose, 0.35).otherwise(1.0) * F.when(declared, 0.68).otherwise(1.0)
    weight = _pick(e["kind"], {"call": 1.0, "conformance": 1.05, "reference": 0.85})
    total = F.col("named") * 0.30 + F.col("aligned") * 0.25 + F.col("shaped") * 0.15 + F.col("near") * 0.15 + F.col("suits") * 0.10 + weight * 0.05
    return rows.withColumn("confidence", F.when(F.col("named") == 0, 0.0).otherwise(total * gate * factor))


def bucket(emitted: Column, runner_up: Column, in_tests: Column) -> Column:
    """primary, contextual or null, for scored rows; runner_up is the next candidate's confidence, null without one, in_tests whether it is a test's."""
    c = F.col("confidence")
    clear = F.coalesce(c - runner_up >= MARGIN, F.lit(True)) | F.col("exact") | (F.col("aligned") >= OWNED)
    only = F.coalesce(emitted["role"].isin("IMPORT", "DOCS"), F.lit(False)) | in_tests
    enough = c >= F.when(runner_up.isNull(), SOLO).otherwise(CONTESTED)
    return F.when(c < CONTEXTUAL, None).when(~only & (F.col("signals") >= SIGNALS) & clear & enough, "primary").otherwise("contextual")


def hop_score(base: Column, hop: int, n: Column, scope: str | None) -> Column:
    out = base * (DECAY**hop) * F.when(is_working(n), WORKING).otherwise(1.0)
    return out if scope is None else out * F.when(T.in_scope(n["file_path"], scope), SCOPED).otherwise(1.0)


def kind_priority(kind: Column) -> Column:
    return F.when(kind == "conformance", 0).when(kind == "call", 1).otherwise(2)


@dataclass(frozen=True)
class Graph:
    """Tables of one context: segments (NODE, referenced_symbols, content), definitions (symbol, segment_id) and edges."""

    segments: DataFrame
    edges: DataFrame

    @property
    def nodes(self) -> DataFrame:
        return self.segments.select("segment_id", node().alias("n"))

    def definitions(self) -> DataFrame:
        """(symbol, n): each canonical symbol with the segments that define it."""
        return self.segments.select(F.explode(F.array_distinct(F.transform(F.coalesce("defined_symbols", F.array().cast("array<string>")), T.canonical))).alias("symbol"), node().alias("n")).where("symbol <> ''")

    def edge(self) -> Column:
        return F.struct("kind", "raw_target", "canonical_target", "lookup_symbol", "owner", "edge_kind")


def outbound(g: Graph, frontier: DataFrame, scope: str | None, hop: int) -> DataFrame:
    """Observations of what the frontier (segment_id, n) points at: the best definition of each budgeted edge."""
    order = Window.partitionBy("source_id").orderBy(kind_priority(F.col("kind")), "canonical_target", "edge_kind", "raw_target")
    edges = g.edges.join(F.broadcast(frontier.select(F.col("segment_id").alias("source_id"), F.col("n.file_path").alias("source_path"))), "source_id")
    edges = edges.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= PER_HOP).select("source_id", "source_path", "nth", g.edge().alias("e"))
    found = edges.join(g.definitions().withColumnRenamed("symbol", "lookup"), F.col("e.lookup_symbol") == F.col("lookup")).where(T.in_scope(F.col("n.file_path"), scope))
    per_edge = Window.partitionBy("source_id", "nth")
    found = found.withColumns({"qualifier": T.owner_components(F.col("e.owner")), "owners": definition_owner(F.col("n"))})
    qualifier, own = F.col("qualifier"), F.col("owners")
    ends = (F.size(qualifier) > 0) & (F.size(own) >= F.size(qualifier)) & (F.slice(own, F.greatest(F.size(own) - F.size(qualifier) + 1, F.lit(1)), F.size(qualifier)) == qualifier)
    found = found.withColumn("owned", ends).withColumn("any_owned", F.max("owned").over(per_edge)).where("owned OR NOT any_owned")
    n = F.col("n")
    fits = F.when(F.col("e.edge_kind") == "macro_like", n["block_type"] == "macro").when(F.col("e.edge_kind") == "constructor_like", n["block_type"].isin(*CONSTRUCTED)).otherwise(True)
    found = scored(found.where(~T.is_test_path(n["file_path"]) & fits), "e", "source_path", "n", "n").withColumn("late", is_test_context(n))
    group = Window.partitionBy("source_id", "nth", "late")
    keeps_owner = (F.col("aligned") >= OWNED) & (F.size("owners") > 0)
    found = found.withColumn("shortlist", F.max(keeps_owner).over(group)).where((F.col("aligned") >= OWNED) | ~F.col("shortlist"))
    best = group.orderBy(F.desc("confidence"), F.desc("signals"), F.desc("aligned"), "n.file_path", "n.line_start", "n.segment_id")
    found = found.withColumn("place", F.row_number().over(best)).withColumn("next", F.lead("confidence").over(best)).where("place = 1")
    found = found.withColumn("bucket", bucket(n, F.col("next"), F.col("late"))).where("bucket IS NOT NULL")
    first = Window.partitionBy("source_id", "nth").orderBy("late")
    found = found.withColumn("turn", F.row_number().over(first)).where("turn = 1")
    return found.select("n.segment_id", "bucket", hop_score(_pick(F.col("e.kind"), BASE) * F.col("confidence"), hop, n, scope).alias("score"), F.lit(hop).alias("hop"), _pick(F.col("e.kind"), OUT_REASON).alias("kind"), F.col("e.raw_target").alias("symbol"), F.col("source_id").alias("origin"))


def inbound(g: Graph, frontier: DataFrame, scope: str | None, hop: int) -> DataFrame:
    """Observations of what points at the frontier's symbols; an implementor stands for its conformance block."""
    asked = frontier.select(F.col("segment_id").alias("origin"), F.col("n").alias("t"), F.posexplode(defined(F.col("n"))).alias("pos", "symbol")).withColumn("lookup", lookup_tail(F.col("symbol")))
    order = Window.partitionBy("origin").orderBy("pos", kind_priority(F.col("kind")), "source_id", "edge_kind", "raw_target")
    edges = g.edges.join(F.broadcast(asked.where("lookup IS NOT NULL")), F.col("lookup_symbol") == F.col("lookup"))
    edges = edges.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= PER_HOP)
    edges = edges.select("origin", "nth", "t", "symbol", "source_id", g.edge().alias("e")).join(g.nodes.select(F.col("segment_id").alias("source_id"), F.col("n").alias("s")), "source_id")
    # A conformance edge from a block that defines nothing itself emits the type's own definitions, if any.
    moves = (F.col("e.kind") == "conformance") & ~is_definition_like(F.col("s"))
    names = F.transform(defined(F.col("s")), lambda x: F.trim(F.regexp_extract(x, r"^([^<(\[]*)", 1)))
    lookups = F.filter(F.array_distinct(F.flatten(F.transform(names, lambda x: F.array(T.canonical(x), F.coalesce(lookup_tail(x), F.lit("")))))), lambda x: x != "")
    types = edges.where(moves).select("origin", "nth", F.col("s.segment_id").alias("own"), F.explode(lookups).alias("lookup")).join(g.definitions().withColumnRenamed("symbol", "lookup"), "lookup")
    types = types.where((F.col("n.segment_id") != F.col("own")) & T.in_scope(F.col("n.file_path"), scope) & ~T.is_test_path(F.col("n.file_path")))
    types = types.groupBy("origin", "nth").agg(F.collect_set("n").alias("types"))
    edges = edges.join(types, ["origin", "nth"], "left").withColumn("m", F.explode(F.when(moves & F.col("types").isNotNull(), F.col("types")).otherwise(F.array("s"))))
    m = F.col("m")
    edges = edges.where(T.in_scope(m["file_path"], scope) & ~T.is_test_path(m["file_path"])).withColumn("source_path", F.col("s.file_path"))
    found = scored(edges, "e", "source_path", "t", "m").withColumn("late", is_test_context(m)).withColumn("bucket", bucket(m, F.lit(None).cast("double"), F.col("late"))).where("bucket IS NOT NULL")
    return found.select("m.segment_id", "bucket", hop_score(_pick(F.col("e.kind"), BASE) * F.col("confidence"), hop, m, scope).alias("score"), F.lit(hop).alias("hop"), _pick(F.col("e.kind"), IN_REASON).alias("kind"), "symbol", "origin")


def same_file(g: Graph, seeds: DataFrame, scope: str | None) -> DataFrame:
    """Siblings of the seeds, once for each file, from its first seed."""
    first = seeds.groupBy(F.col("n.file_path").alias("file_path")).agg(F.min_by("segment_id", "at").alias("origin"))
    found = g.segments.join(F.broadcast(first), "file_path").select(node().alias("n"), "origin")
    found = found.join(F.broadcast(seeds.select("segment_id")), F.col("n.segment_id") == F.col("segment_id"), "left_anti").where(T.in_scope(F.col("n.file_path"), scope))
    return found.select("n.segment_id", F.lit("contextual").alias("bucket"), hop_score(F.lit(SAME_FILE), 1, F.col("n"), scope).alias("score"), F.lit(1).alias("hop"), F.lit("same_file").alias("kind"), F.lit(None).cast("string").alias("symbol"), "origin")


def tests_of(g: Graph, seeds: DataFrame, scope: str | None, files: int, most: int) -> DataFrame:
    """Segments of test files that share a seed's stem or mention one of its symbols, within budgets.

    Files are taken by path, twice the budget, then those that share a stem first. Segments count by
    file, then line.
    """
    known = seeds.agg(F.collect_list("n.file_path").alias("paths"), F.array_distinct(F.filter(F.flatten(F.collect_list(F.transform(defined(F.col("n")), T.canonical))), lambda x: x != "")).alias("names"))
    candidates = g.segments.where(test_like(F.col("file_path")) & T.in_scope(F.col("file_path"), scope)).select("file_path").distinct().orderBy("file_path").limit(files * TEST_FACTOR)
    candidates = candidates.join(F.broadcast(known)).withColumn("stem", F.exists("paths", lambda a: T.shares_test_stem(a, F.col("file_path"))))
    candidates = candidates.orderBy(F.desc("stem"), "file_path").limit(files)
    found = g.segments.join(F.broadcast(candidates), "file_path").join(F.broadcast(seeds.select("segment_id")), "segment_id", "left_anti")
    empty = F.array().cast("array<string>")
    every = F.concat(F.coalesce("defined_symbols", empty), F.coalesce("referenced_symbols", empty), F.coalesce("called_symbols", empty))
    said = F.filter(every, lambda s: F.array_contains("names", T.canonical(s)))
    inside = F.filter("names", lambda s: F.lower("content").contains(s))
    found = found.withColumn("symbol", F.coalesce(F.try_element_at(said, F.lit(1)), F.try_element_at(F.array_sort(inside), F.lit(1)))).where("stem OR symbol IS NOT NULL")
    found = found.orderBy(F.desc("stem"), "file_path", "line_start", "segment_id").limit(most).select(node().alias("n"), "stem", "symbol")
    return found.select("n.segment_id", F.lit("contextual").alias("bucket"), hop_score(F.lit(TEST), 1, F.col("n"), scope).alias("score"), F.lit(1).alias("hop"), F.when(F.col("stem"), "test_for_file").otherwise("test_for_symbol").alias("kind"), "symbol", F.lit(None).cast("string").alias("origin"))


#: Patterns of test-like paths; an underscore is a wildcard in them.
TEST_LIKE = ("tests/%", "%/tests/%", "%/test/%", "%/spec/%", "%/__tests__/%", "%_test.rs", "%_spec.rs", "%.test.ts", "%.spec.ts", "%.test.js", "%.spec.js")


def test_like(path: Column) -> Column:
    out = F.lit(False)
    for p in TEST_LIKE:
        out = out | F.lower(path).like(p)
    return out


def aggregated(observations: DataFrame, g: Graph, anchors: list[str], high_signal: bool) -> DataFrame:
    """One row a candidate: scores and hops by bucket, its reasons best first, and the bucket it ends in.

    A contextual candidate is promoted where two reasons from two sources tie it to an anchor symbol.
    """
    reason = observations.groupBy("segment_id", "bucket", "kind", "symbol", "origin").agg(F.max("score").alias("best"), F.sum("score").alias("sum"), F.min("hop").alias("hop"))
    ties = F.col("kind").isin("references_symbol", "calls", "called_by") & F.coalesce(T.canonical(F.col("symbol")).isin(*anchors) if anchors else F.lit(False), F.lit(False)) & F.col("origin").isNotNull() & (F.col("bucket") == "contextual")
    told = F.struct((F.col("bucket") != "primary").alias("later"), (-F.col("best")).alias("rank"), "kind", F.coalesce("symbol", F.lit("")).alias("symbol"), F.coalesce("origin", F.lit("")).alias("origin"))
    by = lambda b, c: F.sum(F.when(F.col("bucket") == b, F.col(c)).otherwise(0.0))
    hops = lambda b: F.min(F.when(F.col("bucket") == b, F.col("hop")))
    a = reason.groupBy("segment_id").agg(by("primary", "sum").alias("p"), by("contextual", "sum").alias("c"), hops("primary").alias("p_hop"), hops("contextual").alias("c_hop"), F.array_sort(F.collect_list(told)).alias("reasons"), F.sum(F.when(ties, 1).otherwise(0)).alias("ties"), F.count_distinct(F.when(ties, F.col("origin"))).alias("sources"))
    a = a.join(g.nodes, "segment_id")
    weak = is_test_context(F.col("n")) | (T.is_low_signal_path(F.col("n.file_path")) if high_signal else F.lit(False))
    some = (F.col("p") > 0) | (F.col("c") > 0)
    end = F.when(~some, None).when(weak, "contextual").when(F.col("p") > 0, "primary").when((F.col("ties") >= 2) & (F.col("sources") >= 2), "primary").otherwise("contextual")
    a = a.withColumn("bucket", end)
    # What is only contextual is told by its contextual observations alone.
    a = a.where((F.col("bucket") == "primary") | ((F.col("bucket") == "contextual") & (F.col("c") > 0)))
    kept = F.when(F.col("bucket") == "primary", F.col("reasons")).otherwise(F.filter("reasons", lambda r: r["later"]))
    score = F.when(F.col("bucket") == "primary", F.greatest("p", "c")).otherwise(F.col("c"))
    return a.select("segment_id", "n", "bucket", score.alias("score"), F.when(F.col("bucket") == "primary", F.coalesce("p_hop", "c_hop")).otherwise(F.col("c_hop")).alias("hop"), F.slice(kept, 1, REASONS).alias("reasons"))


def ranked(candidates: DataFrame, limit: int) -> DataFrame:
    """Both buckets by ten keys, three rows a file, `limit` rows in all, primary ones first; `place` tells the order in a bucket."""
    kinds = lambda *ks: F.size(F.filter("reasons", lambda r: r["kind"].isin(*ks)))
    n = F.col("n")
    wrapper = is_working(n) & (n["line_end"] - n["line_start"] + 1 <= 4) & (F.coalesce(n["complexity"], F.lit(0)) <= 1)
    strongest = F.array_max(F.transform("reasons", lambda r: F.coalesce(_pick(r["kind"], {"implemented_by": 4, "called_by": 3, "calls": 2, "conforms_to": 1}), F.lit(0))))
    c = candidates.withColumns({"implemented": kinds("implemented_by"), "strongest": strongest, "direct": kinds("implemented_by", "called_by", "calls"), "wrapper": wrapper})
    order = [F.desc(F.col("implemented") > 0), F.desc("strongest"), F.desc("implemented"), F.desc("direct"), F.col("wrapper").asc(), F.desc("score"), F.col("hop").asc(), F.col("n.file_path").asc(), F.col("n.line_start").asc(), F.col("segment_id").asc()]
    c = c.withColumn("in_file", F.row_number().over(Window.partitionBy("bucket", "n.file_path").orderBy(*order))).where(F.col("in_file") <= PER_FILE)
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where(F.col("place") <= limit)
    main = c.where("bucket = 'primary'").agg(F.count(F.lit(1)).alias("main"))
    c = c.join(F.broadcast(main)).where((F.col("bucket") == "primary") | (F.col("place") <= limit - F.col("main")))
    return c.select("bucket", "place", "segment_id", "n.file_path", "n.language", "n.block_type", "n.line_start", "n.line_end", "score", "hop", F.transform("reasons", lambda r: F.struct(r["kind"].alias("kind"), F.nullif(r["symbol"], F.lit("")).alias("symbol"), F.nullif(r["origin"], F.lit("")).alias("origin"))).alias("reasons"), "n.breadcrumb", "n.complexity", "n.role", "n.defined_symbols")


def fixed(rows: DataFrame) -> DataFrame:
    """Rows whose number the budgets bound, as literals."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def expand(g: Graph, seeds: DataFrame, scope: str | None, anchors: list[str], high_signal: bool, depth: int, limit: int) -> DataFrame:
    """Ranked candidates around the seeds (segment_id, n, at). Only nodes that end as primary are expanded further.

    Seeds number at most five, and a hop's frontier at most seeds times both budgets: frontiers and
    what a hop observed are fetched, so each hop's plan starts from a few literal rows.
    """
    ids = seeds.select("segment_id")
    frontier, seen, every = seeds.select("segment_id", "n"), ids, None
    for hop in range(1, depth + 1):
        found = fixed(outbound(g, frontier, scope, hop).unionByName(inbound(g, frontier, scope, hop)).join(F.broadcast(ids), "segment_id", "left_anti"))
        every = every.unionByName(found) if every is not None else found
        if hop < depth:
            frontier = fixed(aggregated(found, g, anchors, high_signal).where("bucket = 'primary'").select("segment_id", "n").join(F.broadcast(seen), "segment_id", "left_anti"))
            if not frontier.limit(1).count():
                break
            seen = seen.unionByName(frontier.select("segment_id"))
    files = min(max(max(limit, 1) * max(depth, 1), TEST_FILES[0]), TEST_FILES[1])
    every = every.unionByName(same_file(g, seeds, scope)).unionByName(tests_of(g, seeds, scope, files, max(limit, 1) * PER_FILE))
    return ranked(fixed(aggregated(fixed(every), g, anchors, high_signal)), limit)
