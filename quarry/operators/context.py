"""Context around a location: the smallest enclosing construct, else a window of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import segments as S

AROUND = 50


def parse_location(location: Column) -> Column:
    """(file_path, line) of file:line, split at the last colon; null unless the line is a number from 1."""
    path, line = F.regexp_extract(location, r"^(.+):(\d+)$", 1), F.try_to_number(F.regexp_extract(location, r"^(.+):(\d+)$", 2), F.lit("9999999999")).cast("long")
    return F.when((path != "") & (line >= 1), F.struct(path.alias("file_path"), line.alias("line")))


def safe_location(path: Column) -> Column:
    """Whether a path is relative and stays inside its root."""
    return (path != "") & ~path.startswith("/") & ~F.exists(F.split(path, "/"), lambda p: p == "..")


def context(files: DataFrame, segments: DataFrame, points: DataFrame, expansion: int = AROUND) -> DataFrame:
    """Points (file_path, line) with scope, line_start, line_end and content of the smallest structural segment around them.

    Where none encloses a point, `expansion` lines before and after it are given, as scope `lines`;
    points beyond the file's end or outside the tree are left out.
    """
    p = points.where(safe_location(F.col("file_path")) & (F.col("line") >= 1)).select("file_path", "line").distinct()
    inside = p.join(segments.where("block_type <> 'chunk'").select("file_path", "block_type", "line_start", "line_end", "segment_id"), "file_path").where("line BETWEEN line_start AND line_end")
    best = inside.groupBy("file_path", "line").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "line_start", "line_end", "block_type", "segment_id")).alias("x"))
    at = p.join(best, ["file_path", "line"], "left").join(files.select("file_path", S.lines_of(F.col("content")).alias("_l")), "file_path").where(F.col("line") <= F.size("_l"))
    first = F.coalesce("x.line_start", F.greatest(F.lit(1), F.col("line") - expansion)).cast("long")
    last = F.coalesce("x.line_end", F.least(F.size("_l"), F.col("line") + expansion)).cast("long")
    at = at.select("file_path", "line", F.coalesce("x.block_type", F.lit("lines")).alias("scope"), first.alias("line_start"), last.alias("line_end"), "_l")
    return at.withColumn("content", F.array_join(F.slice("_l", F.col("line_start").cast("int"), (F.col("line_end") - F.col("line_start") + 1).cast("int")), "\n")).drop("_l")
