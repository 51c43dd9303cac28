"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import ranking
from .operators import graph, impact, incremental, search, segments, symbols
from .plans import hybrid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        SQL[name] = sql


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    top = F.when(i % 10 == 0, "tests/").when(i % 10 == 1, "docs/").when(i % 10 == 2, "vendor/").otherwise("src/")
    ext = F.when(i % 4 == 0, ".md").when(i % 4 == 1, ".txt").when(i % 4 == 2, ".sql").otherwise(".rst")
    path = F.concat(top, "lang", F.lit("/"), "source", F.lit("/doc_"), i.cast("string"), ext)
    return _t(spark, d, "documents").select("doc_id", F.col("source").alias("context_id"), path.alias("file_path"), F.col("text").alias("content"))


def segs(spark, d):
    return segments.chunk(files(spark, d))


def syms(spark, d):
    return symbols.line_occurrences(segs(spark, d))


def names(spark, d):
    return symbols.line_names(segs(spark, d))


def links(spark, d):
    """href targets of pages; by position in the page they are in turn calls, references and conformance."""
    p = _t(spark, d, "pages").select(F.col("page_id").alias("source_id"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "raw_target"))
    kind = F.when(F.col("pos") % 3 == 0, "call").when(F.col("pos") % 3 == 1, "reference").otherwise("conformance")
    return segments.relation_rows(p.withColumn("kind", kind))


def page_definitions(spark, d):
    return _t(spark, d, "pages").select(T.canonical(F.regexp_extract("html", "<title>\\s*([^\\s<]+)", 1)).alias("symbol"), F.col("page_id").alias("node")).where("symbol <> ''")


FILES = r"""files AS (SELECT doc_id, source AS context_id, CASE doc_id % 10 WHEN 0 THEN 'tests/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'vendor/' ELSE 'src/' END || lang || '/' || source || '/doc_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.sql' ELSE '.rst' END AS file_path, text AS content, CASE doc_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'text' WHEN 2 THEN 'sql' ELSE 'rst' END AS language FROM documents)"""
SEGS = FILES + r""", fl AS (SELECT *, string_split_regex(regexp_replace(content, '\r?\n$', ''), '\r?\n') AS l, CASE WHEN doc_id % 4 = 2 THEN 0 ELSE 10 END AS o FROM files WHERE content <> ''),
fs AS (SELECT *, unnest(CASE WHEN o = 0 THEN range(0, len(l), 60) ELSE range(0, len(l), 50) END) AS s FROM fl),
segs AS (SELECT doc_id, left(sha256(context_id || chr(0) || file_path || chr(0) || (s + 1) || chr(0) || least(s + 60, len(l))), 32) AS segment_id, context_id, file_path, language, array_to_string(l[s + 1:s + 60], chr(10)) AS content, CAST(s + 1 AS BIGINT) AS line_start, CAST(least(s + 60, len(l)) AS BIGINT) AS line_end FROM fs WHERE s = 0 OR s + o < len(l))"""
SYMS = SEGS + r""", ln AS (SELECT segment_id, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line FROM segs),
wd AS (SELECT segment_id, line, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM ln),
tok AS (SELECT segment_id, line, unnest(w) AS symbol, generate_subscripts(w, 1) - 1 AS k FROM wd),
occ AS (SELECT segment_id, symbol, CASE WHEN k = 0 THEN 'definition' ELSE 'usage' END AS reference_kind, line * 1000000 + k AS pos, regexp_replace(lower(symbol), '[^\p{L}\p{N}]', '', 'g') AS canonical_symbol FROM tok WHERE k = 0 OR length(symbol) >= 4),
syms AS (SELECT segment_id, reference_kind, canonical_symbol, arg_min(symbol, pos) AS symbol FROM occ WHERE canonical_symbol <> '' GROUP BY ALL)"""
COMP = r"list_filter(list_transform(string_split_regex({0}, '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]', '', 'g')), lambda x: x <> '')"
LOW = "[" + ", ".join(f"'{x}'" for x in T.LOW_INFORMATION) + "]"
EDGES = r"""hr AS (SELECT page_id AS source_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages),
he AS (SELECT source_id, unnest(h) AS raw_target, generate_subscripts(h, 1) - 1 AS pos FROM hr),
hk AS (SELECT *, CASE pos % 3 WHEN 0 THEN 'call' WHEN 1 THEN 'reference' ELSE 'conformance' END AS kind, regexp_replace(lower(raw_target), '[^\p{L}\p{N}]', '', 'g') AS canonical_target, @COMP AS c FROM he),
ho AS (SELECT *, coalesce(c[-1], '') AS lookup_symbol, list_filter(c, lambda x: NOT list_contains(@LOW, x)) AS oc FROM hk),
hp AS (SELECT *, list_filter(oc, lambda x, i: i = 1 OR oc[i - 1] <> x) AS od FROM ho),
hq AS (SELECT *, CASE WHEN len(od) <= 1 THEN '' ELSE array_to_string(od[1:len(od) - 1], '/') END AS owner, CASE WHEN contains(raw_target, '::') THEN 'qualified_path' WHEN contains(raw_target, '.') OR contains(raw_target, '->') THEN 'member_access' ELSE 'bare_identifier' END AS edge_kind FROM hp WHERE lookup_symbol <> ''),
edges AS (SELECT source_id, kind, raw_target, canonical_target, lookup_symbol, owner, edge_kind FROM hq QUALIFY row_number() OVER (PARTITION BY source_id, kind, lookup_symbol, owner, edge_kind ORDER BY pos) = 1)""".replace("@COMP", COMP.format("raw_target")).replace("@LOW", LOW)


# Ingest.
_add("chunk_windows", lambda s, d: segs(s, d).select("file_path", "line_start", "line_end", F.char_length("content").cast("long").alias("n")), f"WITH {SEGS} SELECT file_path, line_start, line_end, CAST(length(content) AS BIGINT) AS n FROM segs")
_add("segment_ids", lambda s, d: segs(s, d).select("segment_id", "context_id"), f"WITH {SEGS} SELECT segment_id, context_id FROM segs")
_add("file_hashes", lambda s, d: files(s, d).groupBy("file_path").agg(F.max(F.sha2("content", 256)).alias("file_hash")), f"WITH {FILES} SELECT file_path, max(sha256(content)) AS file_hash FROM files GROUP BY file_path")
_add("language_counts", lambda s, d: segs(s, d).groupBy("language").agg(F.countDistinct("file_path").alias("n_files"), F.count(F.lit(1)).alias("n_segments")), f"WITH {SEGS} SELECT language, count(DISTINCT file_path) AS n_files, count(*) AS n_segments FROM segs GROUP BY language")
_add("count_segments_files", lambda s, d: segs(s, d).groupBy("context_id").agg(F.count(F.lit(1)).alias("n_segments"), F.countDistinct("file_path").alias("n_files")), f"WITH {SEGS} SELECT context_id, count(*) AS n_segments, count(DISTINCT file_path) AS n_files FROM segs GROUP BY context_id")
_add("paths_by_language", lambda s, d: segs(s, d).where("language = 'sql'").select("file_path").distinct(), f"WITH {SEGS} SELECT DISTINCT file_path FROM segs WHERE language = 'sql'")
_LIKE = " OR ".join(f"lower(file_path) LIKE '{p}'" for p in ("tests/%", "%/tests/%", "%/test/%", "%/spec/%", "%/__tests__/%", "%_test.rs", "%_spec.rs", "%.test.ts", "%.spec.ts", "%.test.js", "%.spec.js"))
_add("test_like_paths", lambda s, d: files(s, d).where(impact.test_like(F.col("file_path"))).select("file_path").distinct(), f"WITH {FILES} SELECT DISTINCT file_path FROM files WHERE {_LIKE}")
_add("scoped_test_like_paths", lambda s, d: files(s, d).where(impact.test_like(F.col("file_path"))).where(T.in_scope(F.col("file_path"), "tests/en")).select("file_path").distinct(), f"WITH {FILES} SELECT DISTINCT file_path FROM files WHERE ({_LIKE}) AND (file_path = 'tests/en' OR starts_with(file_path, 'tests/en/'))")
_add("segments_by_file", lambda s, d: segs(s, d).where(F.col("file_path").endswith("/doc_7.rst")).select("segment_id", "line_start"), f"WITH {SEGS} SELECT segment_id, line_start FROM segs WHERE ends_with(file_path, '/doc_7.rst')")
_add("path_functions", lambda s, d: files(s, d).select("file_path", T.top_level_dir(F.col("file_path")).alias("top"), T.parent_scope(F.col("file_path")).alias("parent"), T.normalized_stem(F.col("file_path")).alias("stem"), T.is_test_path(F.col("file_path")).alias("test"), F.round(T.path_affinity(F.col("file_path"), F.lit("src/en/src0/doc_3.rst")), 6).alias("affinity")),
     f"""WITH {FILES}, p AS (SELECT *, string_split(file_path, '/') AS x, string_split('src/en/src0/doc_3.rst', '/') AS y FROM files)
SELECT file_path, x[1] AS top, array_to_string(x[:-2], '/') AS parent, regexp_replace(lower(string_split(x[-1], '.')[1]), '^(test_)*(spec_)*|((_test)|(_spec))+$', '', 'g') AS stem, list_has_any(x, ['tests', 'test', 'spec', '__tests__']) AS test, round(len(list_filter(range(1, least(len(x), len(y)) + 1), lambda k: x[1:k] = y[1:k])) / greatest(len(x), len(y)), 6) AS affinity FROM p""")

# Retrieval.
def _query_vector(s, d):
    rows = _t(s, d, "embeddings").where("vec_id = 0").select("embedding").take(1)
    return rows[0][0] if rows else []


def _vectors(s, d):
    return _t(s, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding", F.concat(F.lit("ctx"), (F.col("label") % 3).cast("string")).alias("context_id"))


_COS = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"
_VEC = f"v AS (SELECT e.vec_id, 'ctx' || (e.label % 3) AS context_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
_add("vector_topk", lambda s, d: search.vector_topk(_vectors(s, d), _query_vector(s, d), 20).select("vec_id", F.round("score", 6).alias("score")), f"WITH {_VEC} SELECT vec_id, round(score, 6) AS score FROM v ORDER BY score DESC, vec_id LIMIT 20")
_add("vector_topk_then_filter", lambda s, d: search.vector_topk(_vectors(s, d), _query_vector(s, d), 60).where("context_id = 'ctx1'").select("vec_id", F.round("score", 6).alias("score")), f"WITH {_VEC} SELECT vec_id, round(score, 6) AS score FROM (SELECT * FROM v ORDER BY score DESC, vec_id LIMIT 60) WHERE context_id = 'ctx1'")


def _context_candidates(s, d):
    v = _vectors(s, d)
    return search.vector_topk(v, _query_vector(s, d), search.vector_k(search.n_contexts(v))).where("context_id = 'ctx1'").select("vec_id", F.round("score", 6).alias("score"))


_add("vector_context_candidates", _context_candidates, f"WITH {_VEC} SELECT vec_id, round(score, 6) AS score FROM (SELECT * FROM v ORDER BY score DESC, vec_id LIMIT (SELECT 400 * greatest(1, least(8, count(DISTINCT context_id))) FROM v)) WHERE context_id = 'ctx1'")
_add("embedding_norms", lambda s, d: _vectors(s, d).select("vec_id", F.round(F.sqrt(search.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm")), "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
_add("vector_contexts", lambda s, d: _vectors(s, d).agg(F.countDistinct("context_id").alias("n")), "SELECT count(DISTINCT label % 3) AS n FROM embeddings")
QUERY = ranking.Query("edan stupid with src")
TERMS = tuple(QUERY.terms)
BM25 = r"""tk AS (SELECT segment_id, list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM segs),
tf AS (SELECT segment_id, len(t)::DOUBLE AS n, w, len(list_filter(t, lambda x: x = w))::DOUBLE AS tf FROM tk, (SELECT unnest(@TERMS) AS w)),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tk), df AS (SELECT w, sum(CASE WHEN tf > 0 THEN 1 ELSE 0 END) AS df FROM tf GROUP BY w),
sc AS (SELECT segment_id, sum(greatest(ln((st.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tf.n / a))) AS score FROM tf JOIN df USING (w), st GROUP BY segment_id HAVING sum(tf) > 0),
fts AS (SELECT *, row_number() OVER (ORDER BY score DESC, segment_id) AS r FROM sc ORDER BY score DESC, segment_id LIMIT 400)""".replace("@TERMS", "[" + ", ".join(f"'{t}'" for t in TERMS) + "]")
_add("bm25_topk", lambda s, d: search.bm25_topk(segs(s, d), TERMS).select("segment_id", F.round("score", 6).alias("score")), f"WITH {SEGS}, {BM25} SELECT segment_id, round(score, 6) AS score FROM fts")
_add("bm25_index_topk", lambda s, d: search.postings_topk(search.positions(segs(s, d)), [[t] for t in TERMS], search.index_stats(segs(s, d))).select("segment_id", F.round("score", 6).alias("score")), f"WITH {SEGS}, {BM25} SELECT segment_id, round(score, 6) AS score FROM fts")
PHRASES = (("the", "the"), ("in", "the"), ("of", "the"))
_PH = BM25.replace("(SELECT unnest(" + "[" + ", ".join(f"'{t}'" for t in TERMS) + "]" + ") AS w)", "(SELECT unnest([" + ", ".join(f"' {'  '.join(p)} '" for p in PHRASES) + "]) AS w)").replace("len(list_filter(t, lambda x: x = w))::DOUBLE", "(len(string_split('  ' || array_to_string(t, '  ') || '  ', w)) - 1)::DOUBLE")
_add("bm25_phrase", lambda s, d: search.phrase_topk(segs(s, d), PHRASES).select("segment_id", F.round("score", 6).alias("score")), f"WITH {SEGS}, {_PH} SELECT segment_id, round(score, 6) AS score FROM fts")
_add("inverted_index", lambda s, d: search.postings(segs(s, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf")), rf"WITH {SEGS}, w AS (SELECT segment_id, unnest(string_split_regex(lower(content), '[^\p{{L}}\p{{N}}]+')) AS term FROM segs) SELECT term, count(DISTINCT segment_id) AS df, count(*) AS cf FROM w WHERE term <> '' GROUP BY term")


def _read_once(s, d):
    """A row a segment without its text: its columns, what full text counts in it, and how many of the terms are its symbols."""
    own = [c for c in segs(s, d).columns if c != "content"]
    letters = F.array_join("_t", "")
    t = search.counted(segs(s, d), [[t] for t in TERMS], [*own, F.when(symbols.may_hold(letters, TERMS), F.col("content")).alias("content")])
    named = symbols.with_held(segments.line_symbols(t), TERMS)
    return search.read_once(named.drop("content", "defined_symbols", "referenced_symbols"))


def _symbol_list(rows):
    return rows.where("named > 0").groupBy("segment_id").agg(F.sum("named").cast("double").alias("score")).orderBy(F.desc("score"), "segment_id").limit(400)


VECTORS = f"""{_VEC}, vt AS (SELECT vec_id, score FROM v ORDER BY score DESC, vec_id LIMIT (SELECT 400 * greatest(1, least(8, count(DISTINCT context_id))) FROM v)),
vl AS (SELECT segment_id, row_number() OVER (ORDER BY score DESC, segment_id) AS r FROM vt JOIN segs ON vt.vec_id = segs.doc_id AND line_start = 1)"""
_TOK = r"list_filter(string_split_regex(lower(regexp_replace(file_path, '([\p{Ll}0-9])(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_TERMS = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
BOOSTS = rf"""bt AS (SELECT segs.*, rrf, len(list_filter({_TERMS}, lambda t: list_contains({_TOK}, t))) AS m, len(list_filter({_TERMS}, lambda t: contains(lower(file_path), t))) AS o FROM rrf JOIN segs USING (segment_id)),
bo AS (SELECT *, rrf * 1.15 * CASE WHEN contains(lower(file_path), 'test') OR contains(lower(file_path), 'spec') THEN 0.7 WHEN contains(lower(file_path), 'doc') OR contains(lower(file_path), 'readme') THEN 0.8 WHEN contains(lower(file_path), 'vendor') THEN 0.5 ELSE 1.0 END
 * (1.0 + 0.06 * least(o, 3)) * (1.0 + 0.06 * least(m, 4) + CASE WHEN m = 4 THEN 0.35 WHEN m = 3 THEN 0.12 ELSE 0 END) * CASE m WHEN 0 THEN 0.75 WHEN 1 THEN 0.82 ELSE 1.0 END
 * CASE WHEN language = 'markdown' THEN 0.72 ELSE 1.0 END * CASE WHEN line_end - line_start + 1 <= 2 THEN 0.6 WHEN line_end - line_start + 1 <= 5 THEN 0.85 ELSE 1.0 END AS score FROM bt),
"""
_RRF = "rrf AS (SELECT segment_id, sum(w / (60 + r)) AS rrf FROM (@LISTS) GROUP BY segment_id)"
FUSED = SYMS + ", " + BM25 + ", " + VECTORS + """, sl AS (SELECT *, row_number() OVER (ORDER BY score DESC, segment_id) AS r FROM (SELECT segment_id, count(*)::DOUBLE AS score FROM syms WHERE canonical_symbol IN (@T) GROUP BY segment_id ORDER BY score DESC, segment_id LIMIT 400)),
""".replace("@T", ", ".join(f"'{t}'" for t in TERMS)) + _RRF.replace("@LISTS", "SELECT segment_id, r, 1.5 AS w FROM vl UNION ALL SELECT segment_id, r, 1.0 FROM fts UNION ALL SELECT segment_id, r, 4.0 FROM sl") + ", " + BOOSTS + r"""gr AS (SELECT file_path, list({'s': line_start, 'e': line_end, 'i': segment_id, 'c': score} ORDER BY score DESC, line_start, segment_id) AS a FROM bo GROUP BY file_path),
fo AS (SELECT file_path, list_reduce(a, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: x.s < y.e + 1 AND y.s < x.e + 1)) > 0 THEN acc ELSE list_append(acc, x) END, []::STRUCT(s BIGINT, e BIGINT, i VARCHAR, c DOUBLE)[])[1:3] AS a FROM gr),
su AS (SELECT file_path, unnest(a) AS x FROM fo)"""


def _segment_vectors(s, d, rows):
    """A document's vector, bound to its first segment; vectors of no document stay candidates and go later."""
    first = rows.where("line_start = 1").select("segment_id", F.regexp_extract("file_path", r"/doc_(\d+)\.", 1).cast("long").alias("vec_id"))
    return _vectors(s, d), first


def _vector_list(s, d, rows):
    v, first = _segment_vectors(s, d, rows)
    near = search.vector_topk(v, _query_vector(s, d), search.vector_k(search.n_contexts(v)))
    return search.ranked(first.join(near.select("vec_id", "score"), "vec_id"), "vector")


def _fused(s, d, rows=None):
    rows = _read_once(s, d) if rows is None else rows
    return search.fuse([_vector_list(s, d, rows), search.ranked(search.counted_topk(rows, len(TERMS)), "fts"), search.ranked(_symbol_list(rows), "symbol")])


def _boosted(s, d):
    rows = _read_once(s, d)
    return search.boosted(hybrid.with_meta(rows).join(F.broadcast(_fused(s, d, rows)), "segment_id"), QUERY)


def _hybrid(s, d):
    v, first = _segment_vectors(s, d, segs(s, d))
    named = v.join(first, "vec_id", "left").select(F.coalesce("segment_id", F.concat(F.lit("none-"), F.col("vec_id").cast("string"))).alias("vec_id"), "embedding", "context_id")
    return hybrid.hybrid_search(segs(s, d), None, QUERY.text, 10, named, _query_vector(s, d)).select("file_path", "segment_id", F.round("score", 9).alias("score"))


_add("rrf_fusion", lambda s, d: _fused(s, d).select("segment_id", F.round("rrf", 9).alias("rrf")), f"WITH {FUSED} SELECT segment_id, round(rrf, 9) AS rrf FROM rrf")
_add("fused_boosts", lambda s, d: _boosted(s, d).select("segment_id", F.round("score", 9).alias("score")), f"WITH {FUSED} SELECT segment_id, round(score, 9) AS score FROM bo")
_add("overlap_dedupe_file_cap", lambda s, d: search.suppressed(_boosted(s, d)).select("file_path", "segment_id", F.round("score", 9).alias("score")), f"WITH {FUSED} SELECT file_path, x.i AS segment_id, round(x.c, 9) AS score FROM su")
_add("fused_top", lambda s, d: search.top(search.suppressed(_boosted(s, d)), 10).select("file_path", "segment_id", F.round("score", 9).alias("score")), f"WITH {FUSED} SELECT file_path, x.i AS segment_id, round(x.c, 9) AS score FROM su ORDER BY x.c DESC, file_path, x.s, x.i LIMIT 10")
_TWO = FUSED.replace(" UNION ALL SELECT segment_id, r, 4.0 FROM sl", "")
_add("hybrid_search", _hybrid, f"WITH {_TWO} SELECT file_path, x.i AS segment_id, round(x.c, 9) AS score FROM su ORDER BY x.c DESC, file_path, x.s, x.i LIMIT 10")

# Symbols.
_add("symbol_rows", lambda s, d: syms(s, d).select("segment_id", "reference_kind", "canonical_symbol", "symbol"), f"WITH {SYMS} SELECT segment_id, reference_kind, canonical_symbol, symbol FROM syms")
_add("symbol_exact", lambda s, d: symbols.exact(syms(s, d), segs(s, d), "the", None).select("segment_id", "file_path", "symbol"), f"WITH {SYMS} SELECT segment_id, file_path, symbol FROM syms JOIN segs USING (segment_id) WHERE canonical_symbol = 'the'")
_add("symbol_prefix", lambda s, d: symbols.prefix(names(s, d), "th"), f"WITH {SYMS} SELECT DISTINCT canonical_symbol, length(canonical_symbol) FROM syms WHERE starts_with(canonical_symbol, 'th') ORDER BY 2, 1 LIMIT 32".replace("SELECT DISTINCT canonical_symbol, length(canonical_symbol)", "SELECT canonical_symbol FROM (SELECT DISTINCT canonical_symbol").replace(" ORDER BY 2, 1", ") ORDER BY length(canonical_symbol), canonical_symbol"))
_add("symbol_contains", lambda s, d: symbols.containing(names(s, d), "tion"), f"WITH {SYMS} SELECT canonical_symbol FROM (SELECT DISTINCT canonical_symbol FROM syms WHERE contains(canonical_symbol, 'tion')) ORDER BY CASE WHEN starts_with(canonical_symbol, 'tion') THEN 0 ELSE 1 END, abs(length(canonical_symbol) - 4), length(canonical_symbol), canonical_symbol LIMIT 32")
_add("symbol_fuzzy", lambda s, d: symbols.fuzzy(names(s, d), "thhee"), f"WITH {SYMS}, m AS (SELECT DISTINCT canonical_symbol AS c FROM syms), n AS (SELECT c FROM m WHERE contains(c, 'thhee') OR (contains('thhee', c) AND strlen(c) * 2 >= 5) OR levenshtein(c, 'thhee') <= 2) SELECT c AS canonical_symbol FROM n WHERE c = 'thhee' OR NOT EXISTS (SELECT 1 FROM n WHERE c = 'thhee')")
_add("symbol_references", lambda s, d: symbols.references(syms(s, d), "that").select("segment_id", "reference_kind"), f"WITH {SYMS}, x AS (SELECT segment_id, reference_kind FROM syms WHERE canonical_symbol = 'that') SELECT * FROM x WHERE reference_kind = 'definition' OR segment_id NOT IN (SELECT segment_id FROM x WHERE reference_kind = 'definition')")
_HANDLES = (":0", ":00", ":a1b2c3", ":ffff", ":zz")
_add("handle_prefix", lambda s, d: symbols.handles(segs(s, d), s.createDataFrame([(h,) for h in _HANDLES], "handle string")), f"WITH {SEGS}, h AS (SELECT unnest({list(_HANDLES)}) AS handle), m AS (SELECT handle, substr(handle, 2) AS p, list_sort(list(segment_id)) AS ids FROM h LEFT JOIN segs ON starts_with(segment_id, substr(handle, 2)) GROUP BY handle), n AS (SELECT handle, list_distinct(list_filter(ids, lambda x: x IS NOT NULL)) AS ids FROM m) SELECT handle, CASE WHEN len(ids) = 1 THEN 'found' WHEN len(ids) = 0 THEN 'not_found' ELSE 'ambiguous' END AS status, array_to_string(list_sort(ids)[1:5], ',') AS segment_ids FROM n")

# Relations and context.
_add("relation_rows", lambda s, d: links(s, d), f"WITH {EDGES} SELECT * FROM edges")
_add("edges_outbound", lambda s, d: graph.outbound(links(s, d), 3, 5).select("kind", "raw_target"), f"WITH {EDGES} SELECT kind, raw_target FROM edges WHERE source_id = 3 ORDER BY CASE WHEN kind = 'call' THEN 0 ELSE 1 END, canonical_target, raw_target, edge_kind LIMIT 5")
_add("edges_inbound", lambda s, d: graph.inbound(links(s, d), "canonical_target", "the", 20).select("source_id", "kind"), f"WITH {EDGES} SELECT source_id, kind FROM edges WHERE canonical_target = 'the' ORDER BY CASE WHEN kind = 'call' THEN 0 ELSE 1 END, source_id, raw_target, edge_kind LIMIT 20")
_add("edges_lookup", lambda s, d: graph.inbound(links(s, d).where("kind = 'call'"), "lookup_symbol", "de", 20).select("source_id", "raw_target"), f"WITH {EDGES} SELECT source_id, raw_target FROM edges WHERE lookup_symbol = 'de' AND kind = 'call' ORDER BY source_id, raw_target, edge_kind LIMIT 20")
BUDGET = EDGES + ", bud AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY CASE kind WHEN 'conformance' THEN 0 WHEN 'call' THEN 1 ELSE 2 END, canonical_target, raw_target, edge_kind) AS nth FROM edges)"
_add("edge_budget", lambda s, d: graph.budgeted(links(s, d), 4).select("source_id", "kind", "raw_target", "nth"), f"WITH {BUDGET} SELECT source_id, kind, raw_target, CAST(nth AS INTEGER) AS nth FROM bud WHERE nth <= 4")
_add("impact_two_hop", lambda s, d: graph.two_hops(links(s, d), page_definitions(s, d), _t(s, d, "pages").where("page_id < 3").select(F.col("page_id").alias("source_id"))),
     rf"""WITH {BUDGET}, defs AS (SELECT regexp_replace(lower(regexp_extract(html, '<title>\s*([^\s<]+)', 1)), '[^\p{{L}}\p{{N}}]', '', 'g') AS symbol, page_id AS node FROM pages),
st AS (SELECT source_id, node, (CASE kind WHEN 'conformance' THEN 1.05 WHEN 'call' THEN 1.0 ELSE 0.65 END)::DOUBLE AS w FROM bud JOIN defs ON lookup_symbol = symbol WHERE nth <= 8 AND symbol <> ''),
a AS (SELECT node, w * 0.7 AS score, 1 AS hop FROM st WHERE source_id < 3),
b AS (SELECT st.node, w * 0.49 AS score, 2 AS hop FROM st JOIN (SELECT DISTINCT node FROM a WHERE node >= 3) f ON st.source_id = f.node)
SELECT node, round(sum(score::DOUBLE), 6) AS score, CAST(min(hop) AS INTEGER) AS hop, count(*) AS reasons FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE node >= 3 GROUP BY node""")
_POINTS = "SELECT file_path, CAST(5 + doc_id % 90 AS BIGINT) AS line FROM files"


def _points(s, d):
    return files(s, d).select("file_path", (5 + F.col("doc_id") % 90).alias("line"))


_add("enclosing_scope", lambda s, d: graph.enclosing(segs(s, d), _points(s, d)), f"WITH {SEGS}, p AS ({_POINTS}), j AS (SELECT p.file_path, line, segment_id, line_end - line_start AS span, line_start FROM p JOIN segs USING (file_path) WHERE line BETWEEN line_start AND line_end) SELECT file_path, line, segment_id, span FROM j QUALIFY row_number() OVER (PARTITION BY file_path, line ORDER BY span, line_start, segment_id) = 1")
_add("nearest_segment", lambda s, d: graph.nearest(segs(s, d), _points(s, d)), f"WITH {SEGS}, p AS ({_POINTS}), j AS (SELECT p.file_path, line, segment_id, greatest(0, line_start - line, line - line_end) AS distance, line_start FROM p JOIN segs USING (file_path)) SELECT file_path, line, segment_id, distance FROM j QUALIFY row_number() OVER (PARTITION BY file_path, line ORDER BY distance, line_start, segment_id) = 1")
_add("suggested_scope", lambda s, d: files(s, d).groupBy("context_id", T.parent_scope(F.col("file_path")).alias("scope")).agg(F.count(F.lit(1)).alias("n")).groupBy("context_id").agg(F.max(F.struct("n", -F.char_length("scope"), "scope"))["scope"].alias("scope")), f"WITH {FILES}, g AS (SELECT context_id, array_to_string(string_split(file_path, '/')[:-2], '/') AS scope, count(*) AS n FROM files GROUP BY ALL) SELECT context_id, scope FROM g QUALIFY row_number() OVER (PARTITION BY context_id ORDER BY n DESC, length(scope), scope DESC) = 1")


# Incremental maintenance.
def _old(s, d):
    return files(s, d).where("doc_id % 10 <> 0").select("context_id", "file_path", F.sha2("content", 256).alias("file_hash"), F.char_length("content").cast("long").alias("file_size"), F.col("doc_id").alias("modified_ns"))


def _new(s, d):
    text = F.when(F.col("doc_id") % 10 == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return files(s, d).where("doc_id % 10 <> 1").withColumn("content", text).select("context_id", "file_path", F.sha2("content", 256).alias("file_hash"), F.char_length("content").cast("long").alias("file_size"), F.col("doc_id").alias("modified_ns"))


SNAP = FILES + ", old AS (SELECT context_id, file_path, sha256(content) AS file_hash, length(content) AS file_size, doc_id AS modified_ns FROM files WHERE doc_id % 10 <> 0), new AS (SELECT context_id, file_path, sha256(CASE WHEN doc_id % 10 = 2 THEN content || '!' ELSE content END) AS file_hash, length(content) + CASE WHEN doc_id % 10 = 2 THEN 1 ELSE 0 END AS file_size, doc_id AS modified_ns FROM files WHERE doc_id % 10 <> 1)"
_add("metadata_prefilter", lambda s, d: incremental.metadata_changed(_new(s, d), _old(s, d)).select("context_id", "file_path"), f"WITH {SNAP} SELECT context_id, file_path FROM new ANTI JOIN old USING (context_id, file_path, file_size, modified_ns)")
_add("hash_skip", lambda s, d: incremental.hash_changed(_new(s, d), _old(s, d)).select("context_id", "file_path"), f"WITH {SNAP} SELECT context_id, file_path FROM new ANTI JOIN old USING (context_id, file_path, file_hash)")
_add("deleted_files", lambda s, d: incremental.deleted(_old(s, d), _new(s, d)), f"WITH {SNAP} SELECT DISTINCT context_id, file_path FROM old ANTI JOIN new USING (context_id, file_path)")
_add("replace_merge", lambda s, d: incremental.replaced(_old(s, d), incremental.hash_changed(_new(s, d), _old(s, d)).select(*_old(s, d).columns), incremental.deleted(_old(s, d), _new(s, d))).select("context_id", "file_path", "file_hash"), f"WITH {SNAP} SELECT context_id, file_path, file_hash FROM new")

# Queries and change streams.
_add("intent_detection", lambda s, d: _t(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.intent(F.col("text")).alias("intent")),
     "WITH c AS (SELECT conv_id, turn, lower(text) AS q FROM conversations WHERE role = 'user'), n AS (SELECT conv_id, turn, " + ", ".join(f"len(list_filter({list(v)}, lambda s: contains(q, s))) AS {k}" for k, v in T.INTENTS.items()) + " FROM c) SELECT conv_id, turn, CASE WHEN greatest(" + ", ".join(T.INTENTS) + ") = 0 OR greatest(" + ", ".join(T.INTENTS) + ") IS NULL THEN 'general' " + " ".join(f"WHEN {k} = greatest({', '.join(T.INTENTS)}) THEN '{k}'" for k in T.INTENTS) + " END AS intent FROM n")
_add("camel_tokens", lambda s, d: _t(s, d, "benchmark").select("item_id", F.array_join(T.camel_tokens(F.col("text")), " ").alias("tokens")), r"SELECT item_id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(text, '([\p{Ll}0-9])(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') AS tokens FROM benchmark")
_add("burst_sessions", lambda s, d: _t(s, d, "events").groupBy("user_id", F.session_window("ts", "10 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), "n"), "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS brk FROM events), g AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS started, count(*) AS n FROM g GROUP BY user_id, g")
_add("dirty_scopes", lambda s, d: _t(s, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("is_full"), F.size(F.collect_set("event_type")).cast("long").alias("n_paths")), "SELECT user_id, bool_or(event_type = 'error') AS is_full, count(DISTINCT event_type) AS n_paths FROM events GROUP BY user_id")
_add("vector_label_share", lambda s, d: search.vector_topk(_vectors(s, d), _query_vector(s, d), 10).join(_t(s, d, "embeddings").select("vec_id", "label"), "vec_id").agg(F.round(F.avg((F.col("label") == 0).cast("double")), 6).alias("share")), f"WITH {_VEC} SELECT round(avg(CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share FROM (SELECT * FROM v ORDER BY score DESC, vec_id LIMIT 10) JOIN embeddings USING (vec_id)")


# Functions and statements of the index, over the tables' own names and paths.
def _roles(s, d):
    """Segments with block types, roles and symbols dealt by document number, as a code index would have them."""
    i = F.col("doc_id")
    block = F.element_at(F.array(*[F.lit(x) for x in ("function", "struct", "class", "macro", "chunk")]), (i % 5 + 1).cast("int"))
    role = F.element_at(F.array(*[F.lit(x) for x in ("IMPLEMENTATION", "DEFINITION", "ORCHESTRATION", "IMPORT", "DOCS", None)]), (i % 6 + 1).cast("int"))
    return files(s, d).select("doc_id", "file_path", block.alias("block_type"), role.alias("role"), (i % 4).cast("int").alias("complexity"), (i % 9 + 1).alias("n_lines"))


ROLES = FILES + """, roles AS (SELECT doc_id, file_path, (['function', 'struct', 'class', 'macro', 'chunk'])[doc_id % 5 + 1] AS block_type, (['IMPLEMENTATION', 'DEFINITION', 'ORCHESTRATION', 'IMPORT', 'DOCS', NULL])[doc_id % 6 + 1] AS role, doc_id % 4 AS complexity, doc_id % 9 + 1 AS n_lines FROM files)"""
_add("role_scores", lambda s, d: _roles(s, d).select("doc_id", impact.role_score(F.col("role")).alias("role_score"), F.round(impact.hop_score(F.lit(1.05), 2, F.struct("role", "file_path"), "tests"), 9).alias("hop_score")),
     f"WITH {ROLES} SELECT doc_id, CASE role WHEN 'IMPLEMENTATION' THEN 1.0 WHEN 'ORCHESTRATION' THEN 0.95 WHEN 'DEFINITION' THEN 0.75 WHEN 'IMPORT' THEN 0.10 WHEN 'DOCS' THEN 0.05 ELSE 0.60 END::DOUBLE AS role_score, round(1.05::DOUBLE * 0.7 * 0.7 * CASE WHEN role IN ('IMPLEMENTATION', 'ORCHESTRATION') THEN 1.05 ELSE 1.0 END * CASE WHEN starts_with(file_path, 'tests/') THEN 1.10 ELSE 1.0 END, 9) AS hop_score FROM roles")
_add("low_signal_paths", lambda s, d: files(s, d).select("file_path", T.is_test_path(F.col("file_path")).alias("test"), T.is_low_signal_path(F.col("file_path")).alias("low"), T.has_test_token(F.col("file_path")).alias("token")),
     f"WITH {FILES}, p AS (SELECT file_path, '/' || lower(file_path) AS q FROM files) SELECT file_path, regexp_matches(q, '/(tests|test|spec|__tests__)/') AS test, regexp_matches(q, '/(tests|test|spec|__tests__|evals|benches|examples|vendor)/|node_modules') AS low, list_has_any(string_split_regex(lower(file_path), '[^a-z0-9]+'), ['test', 'tests', 'spec', 'specs']) AS token FROM p")
_add("owner_alignment", lambda s, d: files(s, d).select("file_path", F.round(T.alignment(F.array(F.lit("en"), F.lit("src0")), T.owner_components(F.col("file_path"))), 9).alias("aligned")),
     rf"WITH {FILES}, c AS (SELECT file_path, list_filter(list_transform(string_split_regex(file_path, '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]', '', 'g')), lambda x: x <> '' AND NOT list_contains({LOW}, x)) AS h FROM files), k AS (SELECT file_path, h, list_position(h, 'en') AS a FROM c) SELECT file_path, round((0.65::DOUBLE * CASE WHEN a IS NULL OR a = 0 THEN 0 WHEN list_contains(h[a + 1:], 'src0') THEN 2 ELSE 1 END + 0.35::DOUBLE * CASE WHEN h[-1] = 'src0' THEN CASE WHEN h[-2] = 'en' THEN 2 ELSE 1 END ELSE 0 END) / 2, 9) AS aligned FROM k")
_add("component_affinity", lambda s, d: files(s, d).select("file_path", F.round(T.component_affinity(F.col("file_path"), F.lit("tests/en/src0/doc_3.rst")), 9).alias("near")),
     rf"WITH {FILES}, c AS (SELECT file_path, list_filter(list_transform(string_split_regex(file_path, '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]', '', 'g')), lambda x: x <> '' AND NOT list_contains({LOW}, x)) AS x, ['en', 'src0', 'doc3', 'rst'] AS y FROM files) SELECT file_path, round(len(list_filter(range(1, least(len(x), len(y)) + 1), lambda k: x[1:k] = y[1:k]))::DOUBLE / greatest(len(x), len(y)), 9) AS near FROM c")
_add("common_scope", lambda s, d: files(s, d).groupBy("context_id").agg(F.collect_set("file_path").alias("p")).select("context_id", T.common_scope(F.filter("p", lambda x: x.startswith("src/en/"))).alias("scope")),
     f"WITH {FILES}, g AS (SELECT context_id, count(DISTINCT file_path) FILTER (starts_with(file_path, 'src/en/')) AS n FROM files GROUP BY context_id) SELECT context_id, CASE WHEN n >= 2 THEN 'src/en/' || context_id END AS scope FROM g")
_add("routes", lambda s, d: files(s, d).select("file_path", segments.route(F.col("file_path")).alias("route"), segments.embeds(F.lit("chunk"), segments.language(F.col("file_path"))).alias("embeds")),
     f"WITH {FILES} SELECT file_path, 'chunk' AS route, language <> 'sql' AS embeds FROM files")
_add("vector_recall", lambda s, d: search.recall_quantised(_vectors(s, d), _vectors(s, d).where("vec_id < 5"), 10),
     f"WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS top FROM embeddings), z AS (SELECT vec_id, e, list_transform(e, lambda x: round(x / top * 127)) AS c FROM m), p AS (SELECT q.vec_id AS query_id, z.vec_id, list_dot_product(q.e, z.e) / sqrt(list_dot_product(z.e, z.e)) AS exact, list_dot_product(q.c, z.c) / sqrt(list_dot_product(z.c, z.c)) AS rough FROM z q, z WHERE q.vec_id < 5), r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, vec_id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY rough DESC, vec_id) AS b FROM p) SELECT round(count(*) FILTER (a <= 10 AND b <= 10) / (10.0 * count(DISTINCT query_id)), 6)::DOUBLE AS recall FROM r")
_add("stored_hashes", lambda s, d: incremental.stored_hashes(_old(s, d).where("modified_ns % 7 <> 0"), _new(s, d)).select("file_path", "file_hash"), f"WITH {SNAP} SELECT file_path, coalesce(o.file_hash, n.file_hash) AS file_hash FROM (SELECT * FROM old WHERE modified_ns % 7 <> 0) o FULL JOIN new n USING (context_id, file_path)")
_add("full_run_work", lambda s, d: incremental.work(_new(s, d), _old(s, d), _old(s, d))[0].select("file_path"), f"WITH {SNAP} SELECT file_path FROM new ANTI JOIN old USING (context_id, file_path, file_hash)")
