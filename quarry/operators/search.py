"""Vector and full-text retrieval, rank fusion, boosts, suppression and caps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking as R
from ..functions import text as T
from .impact import DEFINITION_TYPES

K1, B, K_RRF, TOP = 1.2, 0.75, 60, 400
WEIGHTS = {"vector": 1.5, "fts": 1.0, "symbol": 4.0}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_k(contexts: int) -> int:
    return TOP * min(max(contexts, 1), 8)


def n_contexts(vectors: DataFrame) -> int:
    """Contexts that hold vectors, as far as vector_k tells them apart; 1 without a column context_id."""
    return vectors.where("context_id IS NOT NULL").select("context_id").distinct().limit(8).count() if "context_id" in vectors.columns else 1


def vector_topk(vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """(vec_id, ..., score): the k most similar, ties to the smaller id.

    The query's norm is a constant; a stored norm of the vectors (column norm) is used where there is one.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    size = math.sqrt(sum(float(x) * float(x) for x in query))
    norm = F.col("norm") if "norm" in vectors.columns else F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    score = dot(F.col("embedding"), q) / (norm * size)
    return vectors.withColumn("score", score).orderBy(F.desc("score"), "vec_id").limit(k)


def quantised(v: Column) -> Column:
    """Components as whole numbers from -127 to 127, the largest at an end."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.transform(v, lambda x: F.round(x.cast("double") / top * 127))


def recall_quantised(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row: the mean share of the true k nearest that quantised vectors find for a fixed list of queries."""
    q = F.broadcast(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"), quantised(F.col("embedding")).alias("_qc")))
    p = vectors.select("vec_id", "embedding", quantised(F.col("embedding")).alias("_c")).join(q)
    p = p.select("query_id", "vec_id", (dot(F.col("_q"), F.col("embedding")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")))).alias("exact"), (dot(F.col("_qc"), F.col("_c")) / F.sqrt(dot(F.col("_c"), F.col("_c")))).alias("rough"))
    top = lambda c: p.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "vec_id"))).where(F.col("n") <= k).select("query_id", "vec_id")
    return recall(top("exact"), top("rough"))


def recall(gold: DataFrame, found: DataFrame) -> DataFrame:
    """One row: the mean over queries of the share of their gold rows (query_id, vec_id) that were found."""
    hit = gold.join(found.withColumn("_hit", F.lit(1)), ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.count("_hit") / F.count(F.lit(1))).alias("share"))
    return hit.agg(F.round(F.avg("share"), 6).alias("recall"))


def postings(segments: DataFrame, id_col: str = "segment_id") -> DataFrame:
    """(id, len, term, tf): the inverted index; a row a text, so repeats are counted within it and nothing is exchanged."""
    t = segments.select(id_col, F.sort_array(tokens(F.col("content"))).alias("t"))
    t = t.select(id_col, "t", T.shifted(F.col("t")).alias("p"), F.slice(F.sequence(F.lit(0), F.size("t")), F.lit(1), F.size("t")).alias("i"))
    # Equal tokens stand together; a term's count is the way from its first place to the next term's.
    t = t.select(id_col, F.size("t").alias("len"), F.filter(F.arrays_zip("t", "p", "i"), lambda x: ~x["t"].eqNullSafe(x["p"])).alias("f"))
    t = t.select(id_col, "len", F.col("f.t").alias("term"), F.col("f.i").alias("a"), F.concat(F.slice("f.i", F.lit(2), F.size("f")), F.array("len")).alias("b"))
    t = t.select(id_col, "len", F.explode(F.arrays_zip("term", "a", "b")).alias("x")).where("x.term IS NOT NULL")
    return t.select(id_col, "len", F.col("x.term").alias("term"), (F.col("x.b") - F.col("x.a")).cast("long").alias("tf"))


def tokens(content: Column) -> Column:
    return F.regexp_extract_all(F.lower(content), F.lit(r"[\p{L}\p{N}]+"), 0)


def _bm25(matches: DataFrame, stats: DataFrame, n: int, k: int, id_col: str) -> DataFrame:
    """(id, score): best k of rows (id, len, tf0, tf1, ...) by the statistics of one row (n, avg_len, df0, df1, ...)."""
    j = matches.where(" OR ".join(f"tf{i} > 0" for i in range(n))).join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(n):
        idf = F.greatest(F.ln((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        tf = F.col(f"tf{i}").cast("double")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return j.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def phrase_topk(segments: DataFrame, phrases: Sequence[Sequence[str]], k: int = TOP, id_col: str = "segment_id") -> DataFrame:
    """(id, score): best k segments with any of the phrases, each some tokens in a row; statistics cover all segments.

    Each text is read in its own row, so only matching rows leave the scan.
    """
    if not phrases:
        return segments.select(id_col, F.lit(0.0).alias("score")).limit(0)
    return counted_topk(counted(segments, phrases, [id_col]), len(phrases), k, id_col)


def counted(segments: DataFrame, phrases: Sequence[Sequence[str]], keep: Sequence[str | Column]) -> DataFrame:
    """(*keep, len, tf0, tf1, ...): tokens of each text and how often it holds each phrase. `keep` may name the tokens as _t."""
    line = F.concat(F.lit("  "), F.array_join("_t", "  "), F.lit("  "))
    padded = [" " + "  ".join(p) + " " for p in phrases]
    count = lambda p: F.when(F.col("_l").contains(p), F.size(F.split("_l", p, -1)) - 1).otherwise(0)  # noqa: E731  tokens hold no sign of a pattern
    s = segments.withColumn("_t", tokens(F.col("content"))).select(*keep, F.size("_t").cast("double").alias("len"), line.alias("_l"))
    kept = [c for c in s.columns if c not in ("len", "_l")]
    # A filter on the counts stops at the generator; below it, it would read each text again for each phrase.
    return s.select(*kept, F.inline(F.array(F.struct("len", *[count(p).alias(f"tf{i}") for i, p in enumerate(padded)]))))


def counted_topk(s: DataFrame, n: int, k: int = TOP, id_col: str = "segment_id") -> DataFrame:
    """(id, score): best k of counted rows; statistics cover them all."""
    stats = s.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), *[F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(n)])
    return _bm25(s, stats, n, k, id_col)


def read_once(rows: DataFrame) -> DataFrame:
    """Rows without their texts, computed now and kept by the executors as long as the result is in use.

    What several lists ask of the texts is read from them in one pass. It holds some hundred bytes a
    segment, on disk where memory is short. It is lost with an executor, and the query then fails.
    """
    return rows.localCheckpoint()


def bm25_topk(segments: DataFrame, terms: Sequence[str], k: int = TOP, id_col: str = "segment_id") -> DataFrame:
    return phrase_topk(segments, [[t] for t in terms], k, id_col)


def positions(segments: DataFrame, id_col: str = "segment_id") -> DataFrame:
    """(term, id, len, at): the stored index, with each term's positions; written by term, a query reads its terms only."""
    t = segments.select(id_col, tokens(F.col("content")).alias("_t"))
    e = t.select(id_col, F.size("_t").alias("len"), F.posexplode("_t").alias("pos", "term"))
    return e.groupBy("term", id_col, "len").agg(F.array_sort(F.collect_list("pos")).alias("at"))


def index_stats(segments: DataFrame) -> DataFrame:
    """One row: how many segments there are and their mean length in tokens."""
    return segments.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens(F.col("content")))).alias("avg_len"))


def postings_topk(index: DataFrame, phrases: Sequence[Sequence[str]], stats: DataFrame | None = None, k: int = TOP, id_col: str = "segment_id") -> DataFrame:
    """phrase_topk from a stored index of positions; without `stats` they are counted from the index, empty texts left out."""
    if not phrases:
        return index.select(id_col, F.lit(0.0).alias("score")).limit(0)
    own = index.where(F.col("term").isin(*{t for p in phrases for t in p}))
    if stats is None:
        stats = index.select(id_col, "len").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    rows = own.groupBy(id_col, "len").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("m"))
    empty = F.array().cast("array<int>")

    def count(phrase):
        # A phrase starts where each of its tokens stands at its own distance.
        starts = F.coalesce(F.col("m")[phrase[0]], empty)
        for i, t in enumerate(phrase[1:], 1):
            shift = F.lit(i)
            starts = F.array_intersect(starts, F.transform(F.coalesce(F.col("m")[t], empty), lambda x: x - shift))  # noqa: B023
        return F.size(starts)

    rows = rows.select(id_col, "len", *[count(p).alias(f"tf{i}") for i, p in enumerate(phrases)])
    df = rows.agg(*[F.coalesce(F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)), F.lit(0)).alias(f"df{i}") for i in range(len(phrases))])
    return _bm25(rows, stats.join(df), len(phrases), k, id_col)


def placed(rows: DataFrame, source: str, order: Sequence[str], id_col: str = "segment_id") -> DataFrame:
    """Positions of a list in its own order, TOP at most."""
    nth = F.row_number().over(Window.orderBy(*order, id_col))
    return rows.select(id_col, nth.alias("rank"), F.lit(source).alias("src")).where(F.col("rank") <= TOP)


def ranked(hits: DataFrame, source: str, id_col: str = "segment_id") -> DataFrame:
    """Positions of a result list that a limit has already bounded."""
    return hits.select(id_col, F.row_number().over(Window.orderBy(F.desc("score"), id_col)).alias("rank"), F.lit(source).alias("src"))


def fuse(lists: Sequence[DataFrame], id_col: str = "segment_id") -> DataFrame:
    """Reciprocal-rank fusion: sum of weight / (60 + rank) over the lists that hold a row."""
    u = lists[0]
    for x in lists[1:]:
        u = u.unionByName(x)
    weight = F.lit(0.0)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("src") == name, w).otherwise(weight)
    return u.groupBy(id_col).agg(F.sum(weight / (K_RRF + F.col("rank"))).alias("rrf"))


def boosted(rows: DataFrame, q: R.Query) -> DataFrame:
    """The fused score: rrf times all boosts."""
    n = F.col("line_end") - F.col("line_start") + 1
    empty = F.array().cast("array<string>")
    symbols = [F.array_join(c, " ") for c in ("defined_symbols", "referenced_symbols", "called_symbols")]
    likely = (F.size(F.coalesce("defined_symbols", empty)) > 0) & F.coalesce(F.col("block_type").isin(*DEFINITION_TYPES), F.lit(False))
    by_intent = R.intent_boost(q, F.coalesce("role", F.lit("")), likely, F.size(F.coalesce("called_symbols", empty)) > 0)
    match = R.query_match_boost(q, [F.col("file_path"), F.col("block_type"), F.col("breadcrumb"), *symbols])
    score = F.col("rrf") * by_intent * T.file_path_boost(F.col("file_path")) * R.query_path_boost(q, F.col("file_path")) * match
    score = score * T.content_kind_boost(F.col("language"), F.col("file_path"), q.intent == "docs") * T.short_segment_penalty(n)
    return rows.withColumn("score", score)


def suppressed(rows: DataFrame, cap: int = 3) -> DataFrame:
    """Greedy per file: by score a row stays if it overlaps no kept row, then `cap` rows a file.

    Input is a bounded result list, so a file's rows fit one array.
    """
    row = F.struct((-F.col("score")).alias("k"), F.col("line_start"), F.col("segment_id"), F.col("line_end"), F.col("score"))
    kind = "array<struct<k:double,line_start:bigint,segment_id:string,line_end:bigint,score:double>>"
    fold = f"aggregate(_r, cast(array() as {kind}), (a, x) -> if(exists(a, y -> x.line_start < y.line_end + 1 and y.line_start < x.line_end + 1), a, concat(a, array(x))))"
    g = rows.groupBy("file_path").agg(F.array_sort(F.collect_list(row)).cast(kind).alias("_r")).withColumn("_r", F.expr(f"slice({fold}, 1, {cap})"))
    return g.select("file_path", F.explode("_r").alias("x")).select("x.segment_id", "file_path", "x.line_start", "x.line_end", "x.score")


def top(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.desc("score"), "file_path", "line_start", "segment_id").limit(max(0, min(limit, 20)))
