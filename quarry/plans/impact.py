"""Impact exploration from an anchor: what it resolves to, or why it is refused, and what depends on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import impact as I
from ..operators import symbols as Y


@dataclass(frozen=True)
class Hint:
    code: str
    scope: str | None = None
    segment_id: str | None = None


@dataclass(frozen=True)
class Envelope:
    """status is expanded, expanded_scoped, empty, empty_scoped or refused; a refusal's reason is its code.

    `candidates` holds both buckets (primary, contextual) in order; it is None where refused.
    """

    status: str
    anchor: str
    scope: str | None = None
    refusal: str | None = None
    hint: Hint | None = None
    candidates: DataFrame | None = None


def _refused(anchor: str, reason: str, code: str, scope: str | None = None, segment_id: str | None = None) -> Envelope:
    return Envelope("refused", anchor, scope, reason, Hint(code, scope, segment_id))


def _suggested(seeds: DataFrame) -> str | None:
    """The commonest directory of the seeds; of equally common ones the shortest, then the last."""
    scopes = seeds.select(T.parent_scope(F.col("n.file_path")).alias("scope")).where("scope IS NOT NULL").groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    row = scopes.orderBy(F.desc("n"), F.octet_length("scope"), F.desc("scope")).limit(1).collect()
    return row[0]["scope"] if row else None


def _outside(seeds: DataFrame, scope: str | None, anchor: str) -> Envelope | None:
    """The refusal of seeds that lie outside an explicit scope."""
    if scope is None:
        return None
    out = seeds.where(~T.in_scope(F.col("n.file_path"), scope)).orderBy("at").limit(1).collect()
    return _refused(anchor, "anchor_out_of_scope", "align_anchor_and_scope", _suggested(seeds), out[0]["segment_id"]) if out else None


def _finish(g: I.Graph, anchor: str, seeds: DataFrame, scope: str | None, names: list[str], depth: int, limit: int) -> Envelope:
    """Seeds number five at most, so their rows are fetched once and the plan starts from literals."""
    fixed = I.fixed(seeds)
    signal = fixed.where(~T.is_low_signal_path(F.col("n.file_path"))).limit(1).count() > 0
    depth = I.MAX_DEPTH if depth == 0 else min(max(depth, 1), I.MAX_DEPTH)
    limit = I.MAX_LIMIT if limit == 0 else min(limit, I.MAX_LIMIT)
    got = I.expand(g, fixed, scope, names, signal, depth, limit)
    ranked = got.orderBy(F.desc("bucket"), "place")  # primary before contextual; 2 * limit rows at most
    top = ranked.collect()
    found = g.segments.sparkSession.createDataFrame(top, got.schema)
    first = {b: next((r["segment_id"] for r in top if r["bucket"] == b), None) for b in ("primary", "contextual")}
    status = ("expanded" if first["primary"] else "empty") + ("_scoped" if scope else "")
    if first["primary"]:
        hint = Hint("inspect_candidate", scope, first["primary"])
    else:
        hint = Hint("context_only", scope, first["contextual"]) if first["contextual"] else Hint("no_likely_impact", scope)
    return Envelope(status, anchor, scope, None, hint, found)


def from_file(g: I.Graph, path: str, line: int | None = None, scope: str | None = None, depth: int = 2, limit: int = 20) -> Envelope:
    """Seeds are the nearest segment to the line, or the five leading segments: definitions, then working ones."""
    if line is not None and line < 1:
        raise ValueError("lines count from 1")
    scope = T.normalize_scope(scope)
    path = T.normalize_scope(path) or ""
    own = g.segments.where(F.col("file_path") == path).select("segment_id", I.node().alias("n"))
    if line is None:
        lead = F.when(I.is_definition_like(F.col("n")), 0).when(I.is_working(F.col("n")), 1).otherwise(2)
        order, most = [lead, F.col("n.line_start"), F.col("segment_id")], I.FILE_SEEDS
    else:
        away = F.when(F.lit(line) < F.col("n.line_start"), F.col("n.line_start") - line).otherwise(F.greatest(F.lit(0), line - F.col("n.line_end")))
        order, most = [away, F.col("n.line_start"), F.col("segment_id")], 1
    seeds = own.withColumn("at", F.row_number().over(Window.orderBy(*order))).where(F.col("at") <= most)  # the segments of one file
    if not seeds.limit(1).count():
        return _refused(path, "anchor_not_indexed", "reindex_or_search", scope)
    return _outside(seeds, scope, path) or _finish(g, path, seeds, scope, [], depth, limit)


def from_segment(g: I.Graph, handle: str, scope: str | None = None, depth: int = 2, limit: int = 20) -> Envelope:
    scope = T.normalize_scope(scope)
    h = handle.strip().removeprefix(":").lower()
    hits = g.segments.where(F.lower("segment_id").startswith(h)).select("segment_id", I.node().alias("n")).orderBy(F.lower("segment_id") != h, "segment_id").limit(5)
    rows = hits.collect()
    if not rows:
        return _refused(handle, "anchor_not_found", "refresh_anchor", scope)
    if len(rows) > 1 and rows[0]["segment_id"].lower() != h:
        return _refused(handle, "anchor_ambiguous", "disambiguate_anchor", scope)
    seeds = g.segments.sparkSession.createDataFrame(rows[:1], hits.schema).withColumn("at", F.lit(1))
    return _outside(seeds, scope, handle) or _finish(g, handle, seeds, scope, [], depth, limit)


def from_symbol(g: I.Graph, name: str, scope: str | None = None, depth: int = 2, limit: int = 20) -> Envelope:
    """Definitions of the name (or of the nearest names), of high-signal paths where there are any; too many are refused."""
    scope = T.normalize_scope(scope)
    found = Y.lookup(g.segments, Y.occurrences(g.segments), name, "definition").where(T.in_scope(F.col("file_path"), scope))
    seeds = found.select("segment_id", I.node().alias("n"), F.col("at").cast("int").alias("at"))
    low = T.is_low_signal_path(F.col("n.file_path"))
    if seeds.where(~low).limit(1).count():
        seeds = seeds.where(~low)
    paths = F.collect_set("n.file_path")
    told = seeds.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("n.file_path").alias("files"), F.count_distinct(T.top_level_dir(F.col("n.file_path"))).alias("dirs")).first()
    if not told["n"]:
        return _refused(name, "anchor_not_found", "narrow_with_scope", scope)
    if told["n"] > I.SYMBOL_SEEDS or told["files"] > I.SYMBOL_FILES or (scope is None and told["dirs"] > I.SYMBOL_DIRS):
        return _refused(name, "symbol_too_broad", "narrow_with_scope", _suggested(seeds) or scope)
    wide = scope or seeds.agg(T.common_scope(paths).alias("scope")).first()["scope"]
    canonical = "".join(c for c in name.lower() if c.isalnum())
    return _finish(g, name, seeds, wide, [canonical] if canonical else [], depth, limit)
