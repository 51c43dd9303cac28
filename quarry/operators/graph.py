"""Edges, context lookups and bounded impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .impact import BASE, DECAY, kind_priority



def outbound(edges: DataFrame, source, limit: int) -> DataFrame:
    return edges.where(F.col("source_id") == source).orderBy(F.when(F.col("kind") == "call", 0).otherwise(1), "canonical_target", "raw_target", "edge_kind").limit(limit)


def inbound(edges: DataFrame, column: str, symbol: str, limit: int) -> DataFrame:
    return edges.where(F.col(column) == symbol).orderBy(F.when(F.col("kind") == "call", 0).otherwise(1), "source_id", "raw_target", "edge_kind").limit(limit)


def budgeted(edges: DataFrame, limit: int = 8) -> DataFrame:
    """At most `limit` edges per source: conformance, then calls, then references, sharing one budget."""
    w = Window.partitionBy("source_id").orderBy(kind_priority(F.col("kind")), "canonical_target", "raw_target", "edge_kind")
    return edges.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit)


def two_hops(edges: DataFrame, definitions: DataFrame, seeds: DataFrame, per_hop: int = 8) -> DataFrame:
    """(node, score, hop, reasons) over two budgeted hops from `seeds` (source_id): edges of a frontier, then their budget, then definitions.

    An edge's lookup symbol resolves through `definitions` (symbol, node). Each edge scores its
    kind's weight times 0.7 per hop; a node sums its scores, and seeds never appear. A hop's
    frontier is at most seeds times budget times definitions of a symbol; no size is assumed, Spark
    picks the join.
    """
    weight = F.lit(BASE["reference"])
    for kind in ("call", "conformance"):
        weight = F.when(F.col("kind") == kind, BASE[kind]).otherwise(weight)

    def hop(front: DataFrame, n: int) -> DataFrame:
        own = budgeted(edges.join(front, "source_id", "left_semi"), per_hop)
        found = own.join(definitions.withColumnRenamed("symbol", "lookup_symbol"), "lookup_symbol")
        return found.select("node", (weight * DECAY**n).alias("score"), F.lit(n).alias("hop"))

    first = hop(seeds.select("source_id"), 1)
    front = first.select(F.col("node").alias("source_id")).distinct().join(seeds.select("source_id"), "source_id", "left_anti")
    seen = first.unionByName(hop(front, 2)).join(seeds.select(F.col("source_id").alias("node")).distinct(), "node", "left_anti")
    return seen.groupBy("node").agg(F.round(F.sum("score"), 6).alias("score"), F.min("hop").alias("hop"), F.count(F.lit(1)).alias("reasons"))


def enclosing(segments: DataFrame, points: DataFrame) -> DataFrame:
    """The smallest segment that holds (file_path, line)."""
    j = points.join(segments, "file_path").where("line BETWEEN line_start AND line_end")
    best = F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "line_start", "segment_id"))
    return j.groupBy("file_path", "line").agg(best.alias("x")).select("file_path", "line", "x.segment_id", "x.span")


def nearest(segments: DataFrame, points: DataFrame) -> DataFrame:
    """The segment nearest to (file_path, line): distance 0 inside, else to the nearer end."""
    distance = F.greatest(F.lit(0), F.col("line_start") - F.col("line"), F.col("line") - F.col("line_end"))
    j = points.join(segments, "file_path")
    return j.groupBy("file_path", "line").agg(F.min(F.struct(distance.cast("long").alias("distance"), "line_start", "segment_id")).alias("x")).select("file_path", "line", "x.segment_id", "x.distance")
