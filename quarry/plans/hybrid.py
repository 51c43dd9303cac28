"""Hybrid search as one plan: lists, fusion, boosts, suppression, cap, limit, late hydration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranking as R
from ..operators import search as S
from ..operators import symbols as Y

META = ("segment_id", "file_path", "language", "block_type", "line_start", "line_end", "breadcrumb", "role", "defined_symbols", "referenced_symbols", "called_symbols")


def with_meta(segments: DataFrame) -> DataFrame:
    """Segments with every column that ranking reads; those that the table lacks are null, as for chunks."""
    types = {"block_type": "string", "breadcrumb": "string", "role": "string"}
    missing = {c: F.lit(None).cast(types.get(c, "array<string>")) for c in META if c not in segments.columns}
    return segments.withColumns(missing) if missing else segments


def symbol_list(segments: DataFrame, symbols: DataFrame, q: R.Query) -> DataFrame:
    """(segment_id, rank, src) of the name that the query may be: definitions, and usages too where it asks for them."""
    found = Y.lookup(segments, symbols, q.symbol, "definition").select("segment_id", "at", F.lit(0).alias("part"))
    if q.intent == "usage":
        uses = Y.lookup(segments, symbols, q.symbol, "usage").select("segment_id", "at", F.lit(1).alias("part"))
        found = found.unionByName(uses.join(found.select("segment_id"), "segment_id", "left_anti"))
    return S.placed(found, "symbol", ["part", "at"])


def hybrid_search(segments: DataFrame, symbols: DataFrame | None, query: str, limit: int = 5, vectors: DataFrame | None = None, query_vector=None, postings: DataFrame | None = None) -> DataFrame:
    """(segment_id, file_path, line_start, line_end, score), best first; content is joined last.

    `vectors` (vec_id = segment_id, embedding, context_id) may hold other contexts than `segments`:
    candidates are taken over all of them, and those of no given segment go before ranks are dealt.
    They are not asked where a single literal word has found something. `postings` is the stored
    index; without it full text is read from the segments.
    """
    q = R.Query(query)
    segments = with_meta(segments)
    meta, lists = segments.select(*META), []
    phrases = [p for p in map(R.phrase_tokens, R.phrases(query)) if p]
    if phrases and postings is None:
        rows = S.read_once(S.counted(segments, phrases, META))
        meta = rows.select(*META)
        lists.append(S.ranked(S.counted_topk(rows, len(phrases)), "fts"))
    elif phrases:
        lists.append(S.ranked(S.postings_topk(postings, phrases), "fts"))
    if symbols is not None and q.symbol:
        lists.append(symbol_list(segments, symbols, q))
    literal = q.exact_word and any(x.limit(1).count() for x in lists)
    if vectors is not None and query_vector is not None and not literal:
        near = S.vector_topk(vectors, query_vector, S.vector_k(S.n_contexts(vectors))).select(F.col("vec_id").alias("segment_id"), "score")
        lists.insert(0, S.ranked(near.join(meta.select("segment_id"), "segment_id", "left_semi"), "vector"))
    if not lists:
        return segments.select("segment_id", "file_path", "line_start", "line_end", F.lit(0.0).alias("score"), "content").limit(0)
    fused = F.broadcast(S.fuse(lists))  # three lists of bounded length
    best = S.top(S.suppressed(S.boosted(meta.join(fused, "segment_id"), q)), limit)
    return segments.select("segment_id", "content").join(F.broadcast(best), "segment_id").select(*best.columns, "content")
