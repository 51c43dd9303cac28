"""Result rows as text and as an envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def handle(segment_id: Column) -> Column:
    return F.concat(F.lit(":"), F.left(segment_id, F.lit(12)))


def lean_row(channel: Column | None = None) -> Column:
    """score, path:first-last, kind, breadcrumb::symbol, :handle and, where given, ~P or ~C; two blanks between."""
    name = F.coalesce(F.try_element_at("defined_symbols", F.lit(1)), F.lit(""))
    crumb = F.coalesce("breadcrumb", F.lit(""))
    label = F.when((crumb != "") & (name != ""), F.concat(crumb, F.lit("::"), name)).otherwise(F.concat(crumb, name))
    span = F.format_string("%s:%d-%d", F.col("file_path"), F.col("line_start"), F.col("line_end"))
    parts = [T.display_score(F.col("score")).cast("string"), span, F.col("block_type"), F.when(label != "", label), handle(F.col("segment_id"))]
    return F.concat_ws("  ", *parts, *([channel] if channel is not None else []))


def channel(bucket: Column) -> Column:
    return F.when(bucket == "primary", "~P").when(bucket == "contextual", "~C")


def truncated(content: Column, lines: int) -> Column:
    """At most `lines` lines, then how many more there are."""
    x = F.split(content, "\n")
    more = F.size(x) - lines
    return F.when(more > 0, F.concat(F.array_join(F.slice(x, 1, lines), "\n"), F.lit("\n... ("), more.cast("string"), F.lit(" more lines)"))).otherwise(content)


def envelope(rows: DataFrame, summary: str, limit: int = 20) -> DataFrame:
    """One row of JSON: status, summary and data of a result that a limit has bounded."""
    data = F.array_sort(F.collect_list(F.struct("place", F.struct(*[c for c in rows.columns if c != "place"]).alias("row"))))
    got = rows.where(F.col("place") <= limit).agg(data.alias("x"))
    return got.select(F.to_json(F.struct(F.when(F.size("x") > 0, "ok").otherwise("empty").alias("status"), F.lit(summary).alias("summary"), F.transform("x", lambda r: r["row"]).alias("data"))).alias("json"))
