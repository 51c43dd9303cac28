"""Mix sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id. Sizes are summed by source and hash bucket; the bucket
where a source's running sum passes its budget is found, and only that bucket is summed again on the
next bits, until single hashes remain. What is below the threshold is taken: a filter, no sort of
documents. Budgets nest: a larger target keeps what a smaller one took.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

LEVEL_BITS, LEVELS = 12, 5
#: Largest table of sources that is broadcast, in rows; beyond it the joins shuffle.
BROADCAST_SOURCES = 100_000
#: What the mix adds to a document; a name that the input has already gets the prefix mix_.
ADDED = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_hash(id_col: Column) -> Column:
    """60 bits of the id's MD5, the same on every run and engine; a null id hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _weighted(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(source, source_size, weight): by code point, null last, the sources take the weights in turn.

    The rank is that within a range of sources plus the sizes of the ranges before it, so sources may
    be many; only the ranges' sizes meet in one task.
    """
    name = F.col("source").asc_nulls_last()
    s = checkpointed(sources.repartitionByRange(name).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = s.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(name)) - 1 + F.col("before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    return s.join(F.broadcast(parts), "part").select("source", "source_size", weight.alias("weight"))  # a row a shuffle partition


def water_fill(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    `share` of all sizes is dealt by weight; a target stops at `most` times its source's size and its
    excess goes to the others by weight, until none is above: target = min(most * size, level *
    weight). The level rises from that of no stopped source; each round stops the sources above it
    and deals what is left to the others. A round is one sum over the sources, and the stopped ones
    only grow, so there are few.
    """
    s = checkpointed(_weighted(sources, weights))
    cap = F.col("source_size") * F.lit(float(most))
    budget = (s.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level = 0.0
    while True:
        stops = cap < level * F.col("weight")
        got = s.agg(F.sum(F.when(stops, cap).otherwise(0.0)), F.sum(F.when(stops, 0.0).otherwise(F.col("weight")))).first()
        if not got[1]:
            level = float("inf")
            break
        new = max(level, (budget - got[0]) / got[1])
        if new == level:
            break
        level = new
    target = cap if level == float("inf") else F.least(cap, F.lit(level) * F.col("weight"))
    return s.select("source", "source_size", F.round(target, 6).alias("target"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def _same(a: str, b: str) -> Column:
    return F.expr(f"{a}.source <=> {b}.source")


def mix_plan(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target, whole, last) from checkpointed rows (source, size, h).

    A document is taken `whole` times, and once more where its hash is at most `last`.
    """
    plan = checkpointed(water_fill(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    n = plan.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    whole = F.least(whole, F.lit(int(most)))
    plan = plan.withColumn("whole", whole.cast("int")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))

    state = plan.select("source", "left", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        at = F.shiftright(F.col("d.h"), shift)
        inside = _same("d", "s") & (F.shiftright(F.col("d.h"), shift + LEVEL_BITS) == F.col("s.prefix"))
        b = sized.alias("d").join(_small(state, n).alias("s"), inside).groupBy("s.source", "s.left", "s.below", at.alias("prefix")).agg(F.sum("d.size").alias("size"))
        run = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        b = b.withColumn("upto", F.col("below") + F.sum("size").over(run))
        # The boundary is the first bucket whose end reaches the budget; without one all are taken.
        passed = F.col("upto") >= F.col("left")
        bucket = F.struct("prefix", (F.col("upto") - F.col("size")).alias("below"), "upto")
        b = b.groupBy("source", "left").agg(F.coalesce(F.min(F.when(passed, bucket)), F.max(bucket)).alias("x"))
        state = checkpointed(b.select("source", "left", "x.prefix", "x.below", "x.upto"))
    # The last bucket is one hash: it is taken if that comes nearer to the budget.
    nearer = F.col("upto") - F.col("left") < F.col("left") - F.col("below")
    cut = state.select("source", F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("last"))
    return checkpointed(plan.alias("p").join(cut.alias("c"), _same("p", "c"), "left").select("p.source", "p.source_size", "p.target", "p.whole", F.coalesce("c.last", F.lit(-1)).alias("last")))


def added_name(name: str, columns: Sequence[str]) -> str:
    """The name under which the mix adds a column to an input with these columns."""
    return f"mix_{name}" if name in {c.lower() for c in columns} else name


def mix_sources(docs: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2.0, source_col: str = "source", keep: bool = False) -> DataFrame:
    """The mix of (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    Each source contributes whole passes over its documents and then the documents of least hash,
    as many as bring it nearest to its target; copies is 0 up to `most`, taken = copies * size. With
    `keep`, all columns of `docs` stay as they are, followed by those of ADDED. A null text has size
    0; null sources are one source; repeated rows share their hash and are taken together; an empty
    table gives an empty result. The sizes are written once to the checkpoint folder, so the
    histograms don't read texts again.
    """
    size, h = word_count(F.col("text").cast("string")), mix_hash(F.col("doc_id"))
    source = F.col(source_col).cast("string")
    sized = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), size.alias("size"), h.alias("h")))
    plan = mix_plan(sized, weights, share, most)
    own = sized.select(F.struct("doc_id", "source").alias("row"), "source", "size", "h")
    names = ADDED
    if keep:
        own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source.alias("source"), size.alias("size"), h.alias("h"))
        names = [added_name(c, docs.columns) for c in ADDED]
    copies = F.col("p.whole") + F.when((F.col("d.h") <= F.col("p.last")) & (F.col("p.whole") < int(most)), 1).otherwise(0)
    out = own.alias("d").join(_small(plan, plan.count()).alias("p"), _same("d", "p"))
    values = (F.col("d.size"), F.col("p.source_size"), F.col("p.target"), copies.cast("int"), (copies * F.col("d.size")).cast("long"))
    return out.select("d.row.*", *[v.alias(c) for v, c in zip(values, names)])
