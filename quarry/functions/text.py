"""Symbol, path and text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that say nothing about an owner.
LOW_INFORMATION = "crate self super this src lib mod index main tests test spec rs py js jsx ts tsx go java c cpp cc cxx h hpp hh hxx kt kts".split()
#: Query words that carry no meaning.
STOP_WORDS = "a an and does for how in is of on per the to what where".split()
#: Substrings that signal what a query is after, in order of precedence.
INTENTS = {
    "definition": ("define", "definition", "struct", "class", "trait", "interface", "type", "enum", "fn ", "func ", "function ", "declare", "schema", "model", "what is", "where is"),
    "flow": ("flow", "pipeline", "workflow", "sequence", "orchestrat", "lifecycle", "process", "how does", "how is", "control flow", "call chain", "data flow", "request flow"),
    "usage": ("usage", "use ", "used", "using", "call", "invoke", "import", "reference", "depend", "consumer", "caller", "who calls", "where is .* used", "example"),
    "docs": ("doc", "readme", "comment", "explain", "description", "overview", "guide", "tutorial", "help", "api doc", "documentation"),
}
#: Test files by suffix and by directory.
TEST_SUFFIXES = ("_test.rs", "_tests.rs", "_spec.rs", ".test.ts", ".spec.ts", ".test.js", ".spec.js")
TEST_DIRS = ("tests", "test", "spec", "__tests__")
#: Directories whose hits are weak evidence, besides tests.
LOW_SIGNAL_DIRS = ("evals", "benches", "examples", "vendor")
TEST_TOKENS = ("test", "tests", "spec", "specs")
#: Names of a syntax node that stand for an edge identity; all others are bare identifiers.
EDGE_SYNONYMS = {
    "qualified_path": "qualifiedpath scopedidentifier qualifiedidentifier qualifiedname namespaceidentifier scoperesolution pathexpression".split(),
    "member_access": "memberaccess fieldexpression memberexpression fieldaccess navigationexpression attribute".split(),
    "method_receiver": "methodreceiver methodcallexpression methodinvocation".split(),
    "constructor_like": "constructorlike newexpression objectcreationexpression".split(),
    "macro_like": "macrolike macroinvocation".split(),
}


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shifted(values: Column) -> Column:
    """Each element's predecessor in an array of strings; null before the first."""
    return F.concat(F.array(F.lit(None).cast("string")), F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))))


def canonical(symbol: Column) -> Column:
    return F.regexp_replace(F.lower(symbol), r"[^\p{L}\p{N}]", "")


def components(symbol: Column) -> Column:
    return F.filter(F.transform(F.split(symbol, r"[^\p{L}\p{N}_]+"), canonical), lambda x: x != "")


def owner_components(symbol: Column) -> Column:
    """Components without low-information tokens; adjacent repeats are one."""
    kept = F.filter(components(symbol), lambda x: ~x.isin(*LOW_INFORMATION))
    return F.aggregate(kept, F.array().cast("array<string>"), lambda a, x: F.when(F.try_element_at(a, F.lit(-1)).eqNullSafe(x), a).otherwise(F.concat(a, F.array(x))))


def owner_fingerprint(symbol: Column) -> Column:
    return let(owner_components(symbol), lambda own: F.when(F.size(own) <= 1, "").otherwise(F.array_join(F.slice(own, F.lit(1), F.size(own) - 1), "/")))


def camel_tokens(text: Column) -> Column:
    spaced = F.lower(F.regexp_replace(text, r"([\p{Ll}0-9])(\p{Lu})", "$1 $2"))
    return F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def edge_kind(target: Column) -> Column:
    """Edge identity from the target's shape."""
    return F.when(target.contains("::"), "qualified_path").when(target.contains(".") | target.contains("->"), "member_access").otherwise("bare_identifier")


def intent(query: Column) -> Column:
    q = F.lower(query)
    n = {k: sum((F.when(q.contains(s), 1).otherwise(0) for s in v), F.lit(0)) for k, v in INTENTS.items()}
    best = F.greatest(*n.values())
    out = F.when(best == 0, "general")
    for name, count in n.items():
        out = out.when(count == best, name)
    return out


def path_in_dir(lower: Column, name: str) -> Column:
    """Whether a lower-cased path is the directory or lies below one of that name."""
    return (lower == name) | lower.startswith(name + "/") | lower.contains(f"/{name}/")


def any_of(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def is_test_path(path: Column) -> Column:
    return let(F.lower(path), lambda lower: any_of([path_in_dir(lower, d) for d in TEST_DIRS] + [lower.endswith(s) for s in TEST_SUFFIXES]))


def is_low_signal_path(path: Column) -> Column:
    return is_test_path(path) | let(F.lower(path), lambda lower: any_of(path_in_dir(lower, d) for d in LOW_SIGNAL_DIRS) | lower.contains("node_modules"))


def has_test_token(value: Column) -> Column:
    """Whether an ASCII word of the value is a test word; null has none."""
    return F.coalesce(F.arrays_overlap(F.split(F.lower(value), "[^a-z0-9]+"), F.array(*[F.lit(t) for t in TEST_TOKENS])), F.lit(False))


def normalize_path(path: Column) -> Column:
    """Slashes for backslashes, without leading ./ and outer slashes."""
    p = F.translate(F.trim(path), "\\", "/")
    return F.regexp_replace(p, r"^(\./)+|^/+|/+$", "")


def normalize_scope(scope: str | None) -> str | None:
    """The scope as a path prefix; none where it is empty or the root."""
    p = (scope or "").strip().replace("\\", "/")
    while p.startswith("./"):
        p = p[2:]
    p = p.strip("/")
    return p if p and p != "." else None


def in_scope(path: Column, scope: str | None) -> Column:
    return F.lit(True) if scope is None else (path == scope) | path.startswith(scope + "/")


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def top_level_dir(path: Column) -> Column:
    return F.try_element_at(path_parts(path), F.lit(1))


def parent_scope(path: Column) -> Column:
    parts = path_parts(path)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))


def common_scope(paths: Column) -> Column:
    """The deepest directory of two components or more that holds all of an array of paths, two at least; else null."""
    least, most = F.array_min(paths), F.array_max(paths)
    a, b = path_parts(least), path_parts(most)
    a, b = F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(b, F.lit(1), F.greatest(F.size(b) - 1, F.lit(0)))
    # What the first and the last path in byte order share, all between them share too.
    n = F.size(F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda k: (k > 0) & (F.slice(a, F.lit(1), k) == F.slice(b, F.lit(1), k))))
    return F.when((F.size(paths) >= 2) & (n >= 2), F.array_join(F.slice(a, F.lit(1), n), "/"))


def normalized_stem(path: Column) -> Column:
    base = F.lower(F.substring_index(F.substring_index(path, "/", -1), ".", 1))
    for affix in ("^(test_)+", "^(spec_)+", "(_test)+$", "(_spec)+$"):
        base = F.regexp_replace(base, affix, "")
    return base


def shares_test_stem(path: Column, test_path: Column) -> Column:
    a, b = normalized_stem(path), normalized_stem(test_path)
    return b.contains(a) | a.contains(b)


def normalize_edge_kind(name: Column) -> Column:
    """One of six edge identities for the name of an identity or of a syntax node."""
    key, out = canonical(name), F.lit("bare_identifier")
    for kind, names in EDGE_SYNONYMS.items():
        out = F.when(key.isin(*names), kind).otherwise(out)
    return out


def _pair(left: Column, right: Column, body) -> Column:
    return let(F.struct(left.alias("a"), right.alias("b")), lambda p: body(p["a"], p["b"]))


def shares_suffix(left: Column, right: Column) -> Column:
    """Whether two owners (text) end with the same component."""
    return _pair(owner_components(left), owner_components(right), lambda a, b: F.coalesce(F.try_element_at(a, F.lit(-1)) == F.try_element_at(b, F.lit(-1)), F.lit(False)))


def _matched(needle: Column, haystack: Column) -> Column:
    """How many leading components of the needle occur in the haystack in order."""
    return F.aggregate(haystack, F.lit(0), lambda n, x: F.when(F.try_element_at(needle, n + 1).eqNullSafe(x), n + 1).otherwise(n))


def shares_subsequence(left: Column, right: Column) -> Column:
    """Whether the shorter of two owners is a subsequence of the other; empty ones are not."""
    ordered = lambda a, b: F.when(F.size(a) <= F.size(b), F.struct(a.alias("a"), b.alias("b"))).otherwise(F.struct(b.alias("a"), a.alias("b")))
    return let(_pair(owner_components(left), owner_components(right), ordered), lambda p: (F.size(p["a"]) > 0) & (_matched(p["a"], p["b"]) == F.size(p["a"])))


def _leading(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return let(same, lambda s: F.coalesce(F.nullif(F.array_position(s, False), F.lit(0)) - 1, F.size(s)))


def alignment(needle: Column, haystack: Column) -> Column:
    """0.65 of the share found in order and 0.35 of the share that both end with; 0 where either is empty."""
    score = lambda n, h: F.when((F.size(n) == 0) | (F.size(h) == 0), 0.0).otherwise((_matched(n, h) * 0.65 + _leading(F.reverse(n), F.reverse(h)) * 0.35) / F.size(n))
    return _pair(needle, haystack, score)


def component_affinity(a: Column, b: Column) -> Column:
    """Shared leading owner components of two paths over the longer one's number; 0 where either has none."""
    score = lambda x, y: F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(_leading(x, y) / F.greatest(F.size(x), F.size(y)))
    return _pair(owner_components(a), owner_components(b), score)


def path_affinity(a: Column, b: Column) -> Column:
    """Shared leading components over the longer path's number of components."""
    x, y = F.split(a, "/"), F.split(b, "/")
    n = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(x), F.size(y))), lambda k: F.slice(x, F.lit(1), k) == F.slice(y, F.lit(1), k)))
    return n / F.greatest(F.size(x), F.size(y))


def file_path_boost(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.contains("test") | p.contains("spec"), 0.7).when(p.contains("doc") | p.contains("readme"), 0.8).when(p.contains("vendor") | p.contains("node_modules"), 0.5).otherwise(1.0)


def short_segment_penalty(lines: Column) -> Column:
    return F.when(lines <= 2, 0.6).when(lines <= 5, 0.85).otherwise(1.0)


def content_kind_boost(language: Column, path: Column, docs_intent: bool) -> Column:
    markdown = (F.lower(language) == "markdown") | F.lower(path).endswith(".md") | F.lower(path).endswith(".markdown")
    return F.when(markdown, 1.15 if docs_intent else 0.72).otherwise(1.0)


def display_score(x: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.round(x * 100).cast("int")))
