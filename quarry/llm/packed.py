"""Packed key exchange: joins hundreds of millions of hashes without a row for each.

Documents are dealt to groups by a hash of their id. Each group sends the sorted set of its keys,
packed into one binary per key range (bucket); a bucket combines what all groups sent and answers
every group with one value per key *in the order sent*, so the answer needs no keys. A key that a
third of all rows hold still arrives once per group. The exchange of the documents themselves is
the same plan wherever it is used, so Spark shuffles them once and reuses it.

Groups, buckets and the partitions of every exchange follow the bytes of the input, not the
session's number of shuffle partitions, so a task's share stays the same at every size. Rows sent
number groups times buckets at most, and never more than the keys, since empty buckets are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit

SENT = "bucket int, grp int, keys binary, vals binary"
BACK = "grp int, kind string, bucket int, vals binary"
_SENT = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])
_BACK = pa.schema([("grp", pa.int32()), ("kind", pa.string()), ("bucket", pa.int32()), ("vals", pa.binary())])


#: Bytes of text in a group, and in a partition of groups.
GROUP_BYTES, PARTITION_BYTES = 16_000_000, 24_000_000
#: Fewest partitions, for tables too small to fill more.
LEAST = 12


@dataclass(frozen=True)
class Layout:
    """How a table is dealt: its rows and bytes, and the groups, bucket bits and partitions that follow from them."""

    rows: int
    size: int

    @property
    def partitions(self) -> int:
        return max(LEAST, math.ceil(self.size / PARTITION_BYTES))

    @property
    def groups(self) -> int:
        return max(2 * LEAST, 2 * math.ceil(self.size / GROUP_BYTES))

    @property
    def bits(self) -> int:
        return max(4, math.ceil(math.log2(self.groups / 2)))

    def exchange(self, df: DataFrame, key: str) -> DataFrame:
        return df.repartition(self.partitions, key)


def layout(df: DataFrame, text_col: str) -> Layout:
    """Counted in one pass over the lengths of the texts."""
    got = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()
    return Layout(got[0], got[1] or 0)


def group_of(id_col: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(groups)).cast("int")


def dealt(df: DataFrame, id_col: str, text_col: str, plan: Layout) -> DataFrame:
    """(grp, id, text), exchanged by group; rows without an id are dealt by their text."""
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col)))
    return plan.exchange(df.select(group_of(key, plan.groups).alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "grp")


def cut(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) over sorted 64-bit keys, by their top bits; empty buckets are left out."""
    if not len(keys):
        return []
    tops = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate(([True], tops[1:] != tops[:-1], [True])))
    return [(int(tops[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]


def send(grp: int, keys: np.ndarray, bits: int, width: int, values: Callable[[int, int], bytes]) -> pa.Table:
    """Rows for sorted unique keys, whose `width` bytes below the bucket's bits are sent."""
    rest = (keys << np.uint64(bits)) >> np.uint64(64 - 8 * width) if width < 8 else keys
    raw = rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    found = cut(keys, bits)
    return pa.table([[k for k, _, _ in found], [grp] * len(found), [np.ascontiguousarray(raw[a:b].T).tobytes() for _, a, b in found], [values(a, b) for _, a, b in found]], schema=_SENT)


def trim(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The part of a key that is sent: its top `bits` + 8 * `width` bits."""
    low = 64 - bits - 8 * width
    return keys >> np.uint64(low) << np.uint64(low) if low > 0 else keys


def answer(sent: DataFrame, kind: str, width: int, plan: Layout, combine: Callable[[np.ndarray, np.ndarray, list[bytes], list[int]], list[bytes | None]]) -> DataFrame:
    """combine(order, starts, values, lengths) of a bucket: a binary for each sender, or None; exchanged by group."""

    @textkit.frugal
    def reduce(table):
        blobs, values, grp = table["keys"].to_pylist(), table["vals"].to_pylist(), table["grp"].to_pylist()
        parts = []
        for x in blobs:
            wide = np.zeros((len(x) // width, 8), np.uint8)
            wide[:, :width] = np.frombuffer(x, np.uint8).reshape(width, -1).T
            parts.append(wide.view("<u8").ravel())
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        back = combine(order, starts, values, [len(x) for x in parts])
        bucket = table["bucket"][0].as_py()
        rows = [(g, b) for g, b in zip(grp, back) if b is not None]
        return pa.table([[g for g, _ in rows], [kind] * len(rows), [bucket] * len(rows), [b for _, b in rows]], schema=_BACK)

    return plan.exchange(plan.exchange(sent, "bucket").groupBy("bucket").applyInArrow(reduce, BACK), "grp")


def split(values: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(lengths)[:-1]) if lengths else []


def spread(order: np.ndarray, starts: np.ndarray, per_key: np.ndarray) -> np.ndarray:
    """A value per key, given back to every entry that was sent, in the order sent."""
    out = np.empty(len(order), per_key.dtype)
    out[order] = np.repeat(per_key, np.diff(np.append(starts, len(order))))
    return out


def received(side: pa.Table, kind: str, keys: np.ndarray, bits: int, read: Callable[[bytes, int], np.ndarray], missing: np.ndarray) -> np.ndarray:
    """One value per sorted key from a group's answers; `missing` holds where none came."""
    got = {b: v for k, b, v in zip(side["kind"].to_pylist(), side["bucket"].to_pylist(), side["vals"].to_pylist()) if k == kind}
    for bucket, a, b in cut(keys, bits):
        if bucket in got:
            missing[a:b] = read(got[bucket], b - a)
    return missing


def bits_of(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
