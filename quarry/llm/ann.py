"""Nearest neighbours by randomly rotated one-bit codes.

A vector's code is the sign pattern of its direction after a random rotation into `bits` dimensions,
packed, with two scalars: its norm and the inner product f of the direction and its own code. For a
query direction q, <code, q> / f estimates the inner product without bias, and the error is below
eps * sqrt((1 - f^2) / (f^2 (bits - 1))) but for a tiny probability. The query is taken in six bit
planes, so <code, q> is six counts of common bits of packed words; its rounding is part of the
bound. A candidate is reranked on its original vector unless its distance is above the k-th smallest
upper bound even at its lower bound.

The index holds codes and scalars only: bits / 8 + 16 bytes a vector. It is written once and read
once for each block of queries, which is broadcast (its size is bounded); no candidate and no query
is replicated or shuffled for the estimates. Of the pairs that a task's own bounds leave, the 2 k
likeliest of each query are joined to original vectors; their k-th true distance cuts the others
once more, and only what then remains is joined too.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

#: Bytes of broadcast queries (bit planes, scalars and running bounds) in a block.
BLOCK_BYTES = 8_000_000
#: Pairs that a task holds before it hands them on.
HELD = 1 << 22
PLANES = 6
RESULT = "query_id long, rank int, vec_id long, score double"
FOUND = "q long, id long, low float, high float"
_FOUND = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("low", pa.float32()), ("high", pa.float32())])
_CODED = pa.schema([("id", pa.int64()), ("code", pa.binary()), ("norm", pa.float32()), ("f", pa.float32())])


def usable(v: Column) -> Column:
    """Not null, not all zero, every component finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """Orthonormal map from dim to bits >= dim dimensions, the same in every task."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, dim)))[0].T


def _matrix(column, dim: int) -> np.ndarray:
    values = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(values.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def encode(vectors: DataFrame, dim: int, bits: int, seed: int) -> DataFrame:
    """The index: (id, code, norm, f) for (id, v)."""

    def codes(batches):
        turn = rotation(dim, bits, seed)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim)
            # The largest component is taken out first, so that squares neither vanish nor overflow.
            most = np.abs(x).max(1)
            norm = np.sqrt(((x / most[:, None]) ** 2).sum(1)) * most
            y = x / norm[:, None] @ turn
            f = np.abs(y).sum(1) / math.sqrt(bits)
            yield pa.record_batch([batch.column(0), pa.array([p.tobytes() for p in np.packbits(y > 0, axis=1)], pa.binary()), norm.astype(np.float32), f.astype(np.float32)], schema=_CODED)

    return vectors.mapInArrow(codes, "id long, code binary, norm float, f float")


class Block:
    """Queries as bit planes: q is about low + step * plane value, with a rounding of at most step / 2 a component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, bits: int, seed: int):
        self.ids = ids
        norm = np.sqrt((x * x).sum(1))
        y = x / norm[:, None] @ rotation(x.shape[1], bits, seed)
        self.norm = norm.astype(np.float32)
        low, high = y.min(1), y.max(1)
        step = np.maximum((high - low) / ((1 << PLANES) - 1), 1e-12)
        level = np.rint((y - low[:, None]) / step[:, None]).astype(np.uint8)
        planes = [np.packbits((level >> k) & 1, axis=1) for k in range(PLANES)]
        self.planes = np.stack([p.view(np.uint64) for p in planes], 1)
        self.low, self.step = low.astype(np.float32), step.astype(np.float32)
        self.level_sum = level.sum(1).astype(np.float32)
        # What rounding left, as a vector: the same bound as for a code holds for its inner product with one.
        self.lost = np.sqrt(((y - low[:, None] - step[:, None] * level) ** 2).sum(1)).astype(np.float32)

    def bounds(self, j: int, code: np.ndarray, ones: np.ndarray, norm: np.ndarray, f: np.ndarray, eps: float, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of query j to the coded vectors."""
        common = np.zeros(len(code), np.float32)
        for k in range(PLANES):
            common += np.bitwise_count(code & self.planes[j, k]).sum(1, dtype=np.int32) * np.float32(1 << k)
        # A code's direction has components +-1 / sqrt(bits): twice the sum over its ones less the sum of all.
        product = 2 * (self.low[j] * ones + self.step[j] * common) - (self.low[j] * bits + self.step[j] * self.level_sum[j])
        cosine = product / (f * np.float32(math.sqrt(bits)))
        error = eps * (np.sqrt(np.maximum(1 - f * f, 0)) + self.lost[j]) / (f * np.float32(math.sqrt(max(bits - 1, 1))))
        base, reach = norm * norm + self.norm[j] ** 2, 2 * norm * self.norm[j]
        slack = base * np.float32(1e-5)
        return base - reach * np.minimum(cosine + error, 1) - slack, base - reach * np.maximum(cosine - error, -1) + slack


def _search(block, k: int, bits: int, eps: float):
    """Pairs of a task that its own k-th smallest upper bound of each query leaves; at most HELD are held at once."""

    def pieces(queries, kept, best):
        for j, parts in enumerate(kept):
            if parts:
                ids, low, high = _left(parts, best[j, -1])
                yield pa.record_batch([np.full(len(ids), queries.ids[j]), ids, low, high], schema=_FOUND)

    def run(batches):
        queries: Block = block.value
        n = len(queries.ids)
        best = np.full((n, k), np.inf, np.float32)
        kept: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0).to_numpy())
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(len(ids), -1)
            ones = np.bitwise_count(code).sum(1, dtype=np.int32).astype(np.float32)
            norm, f = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for j in range(n):
                low, high = queries.bounds(j, code, ones, norm, f, eps, bits)
                own = ids == queries.ids[j]
                if own.any():
                    low[own] = high[own] = np.inf
                top = np.concatenate((best[j], high[high < best[j, -1]]))
                best[j] = np.sort(top)[:k]
                pick = np.flatnonzero(low <= best[j, -1]) if best[j, -1] < np.inf else np.flatnonzero(low < np.inf)
                kept[j].append((ids[pick], low[pick], high[pick]))
                held += len(pick)
            if held > HELD:
                kept = [[_left(parts, best[j, -1])] if parts else [] for j, parts in enumerate(kept)]
                held = sum(len(p[0]) for parts in kept for p in parts)
                if held > HELD // 2:
                    yield from pieces(queries, kept, best)
                    kept, held = [[] for _ in range(n)], 0
        yield from pieces(queries, kept, best)

    return run


def _left(parts, limit):
    ids, low, high = (np.concatenate([p[m] for p in parts]) for m in range(3))
    pick = low <= limit
    return ids[pick], low[pick], high[pick]


def _distance(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", bits: int = 0, eps: float = 3.0, seed: int = 17) -> DataFrame:
    """The k nearest of `vectors` to each of `queries` by Euclidean distance: query_id, rank, vec_id, score.

    Vectors that are null, zero or hold a null or non-finite component take no part, and neither do
    those without an id or with another length than most of `vectors`. A row never finds rows of its
    own id. Every other row counts: repeated ids may appear more than once, and repeated query rows
    share one list. Ties go to the smaller id, fewer candidates give fewer rows. Extra columns are
    ignored; an empty table gives no rows. `bits` is sixteen for each dimension where it is 0.
    """
    spark = vectors.sparkSession

    def ready(df: DataFrame) -> DataFrame:
        v = F.col(vec_col)
        kind = df.schema[vec_col].dataType.simpleString()
        d = df.select(F.col(id_col).cast("long").alias("id"), (v if kind in ("array<float>", "array<double>") else v.cast("array<double>")).alias("v"))
        return d.where(F.col("id").isNotNull() & usable(F.col("v")))

    c, q = ready(vectors), ready(queries)
    sizes = c.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], RESULT)
    dim = sizes[0]["dim"]
    bits = 64 * math.ceil(max(bits or 16 * dim, dim) / 64)
    c, q = c.where(F.size("v") == dim), q.where(F.size("v") == dim)
    index = checkpointed(encode(c, dim, bits, seed))
    per_block = max(1, BLOCK_BYTES // (PLANES * bits // 8 + 4 * k + 8 * dim + 32))
    blocks = max(1, math.ceil(q.count() / per_block))
    found = []
    for b in range(blocks):
        # A block's size is about per_block and its parts are hashed evenly; one block at a time is on the driver.
        own = q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        if not own.num_rows:
            continue
        sent = spark.sparkContext.broadcast(Block(np.asarray(own["id"].to_numpy()), _matrix(own["v"], dim), bits, seed))
        found.append(checkpointed(index.mapInArrow(_search(sent, k, bits, eps), FOUND)))
        sent.unpersist()
    if not found:
        return spark.createDataFrame([], RESULT)
    pairs = reduce(DataFrame.unionByName, found)
    vectors_of = lambda left: left.join(c, "id").select("q", F.col("id").alias("vec_id"), "v").join(q.select(F.col("id").alias("q"), F.col("v").alias("w")), "q").select(F.col("q").alias("query_id"), "vec_id", _distance(F.col("v"), F.col("w")).alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    # The true distances of the likeliest pairs bound each query's k-th; no pair with a lower bound beyond it can matter.
    likely = Window.partitionBy("q").orderBy(F.col("low") + F.col("high"), "id")
    first = pairs.select("q", "id", F.row_number().over(likely).alias("n")).where(F.col("n") <= 2 * k).select("q", "id").distinct()
    near = vectors_of(first).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    limit = near.groupBy(F.col("query_id").alias("q")).agg(F.max("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    limit = limit.select("q", F.when(F.col("n") < k, float("inf")).otherwise(F.col("kth") * F.col("kth") * (1 + 1e-5)).alias("limit"))
    left = checkpointed(pairs.join(limit, "q").where(F.col("low") <= F.col("limit")).select("q", "id").distinct())
    return vectors_of(left).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
