"""Exact substring dedup by fixed-block anchors.

Every document's words are cut into non-overlapping reference blocks of `(window + 1) // 2` words;
these are indexed, and every rolling window of that many words, of every document, probes the
index. A repeat of `window` words holds at least one whole reference block, so no repeat is missed.
Hits are then extended: the `window`-word windows around a hit are compared over all documents by a
64-bit hash, and overlapping repeated windows merge to maximal exact repeats.

Keys travel packed (see packed.py): about 4 bytes for each distinct probe of a group, and one bit
back. A key of any frequency arrives once per group, so no task gathers a hot passage.

Two different windows share a 64-bit hash with probability below n*n / 2**65 over n windows.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import packed, textkit

RESULT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
_NO_ID = np.iinfo(np.int64).max


class _Group:
    """The words, anchors and windows of one group of documents."""

    def __init__(self, table: pa.Table, window: int, bits: int):
        self.rows, self.hashes = textkit.words(table["text"])
        self.ids = np.asarray(table["id"].fill_null(_NO_ID).to_numpy())
        self.window, self.block, self.bits = window, (window + 1) // 2, bits
        self.first = textkit.first_of_row(self.rows, table.num_rows)

    def anchors(self) -> None:
        b = self.block
        self.at = np.flatnonzero(textkit.same_row(self.rows, b))
        keys = packed.trim(textkit.grams(self.hashes, b)[self.at], self.bits, 4)
        self.order = np.argsort(keys, kind="stable")
        keys = keys[self.order]
        self.new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        self.starts = np.flatnonzero(self.new)
        self.keys = keys[self.starts]

    def sent_anchors(self, grp: int) -> pa.Table:
        self.anchors()
        row = self.rows[self.at][self.order]
        aligned = ((self.at - self.first[self.rows[self.at]]) % self.block == 0)[self.order]
        if len(self.starts):
            indexed = np.logical_or.reduceat(aligned, self.starts)
            many = np.minimum.reduceat(row, self.starts) != np.maximum.reduceat(row, self.starts)
        else:
            indexed = many = np.zeros(0, bool)
        flags = lambda a, b: np.packbits(np.concatenate((indexed[a:b], many[a:b]))).tobytes()
        return packed.send(grp, self.keys, self.bits, 4, flags)

    def candidates(self, side: pa.Table) -> None:
        """Windows that hold a hit, of documents with an id."""
        self.anchors()
        hit = packed.received(side, "anchor", self.keys, self.bits, packed.bits_of, np.zeros(len(self.keys), bool))
        found = np.zeros(len(self.rows) + 1, np.int64)
        if len(self.keys):
            found[1 + self.at[self.order]] = hit[np.cumsum(self.new) - 1]
        found = np.cumsum(found)
        whole = textkit.same_row(self.rows, self.window)
        n, reach = len(whole), self.window - self.block + 1
        self.near = np.flatnonzero(whole & (found[reach : reach + n] > found[:n])) if n else np.zeros(0, np.int64)
        self.near = self.near[self.ids[self.rows[self.near]] != _NO_ID]
        keys = textkit.grams(self.hashes, self.window)[self.near] if n else np.zeros(0, np.uint64)
        self.near_order = np.argsort(keys, kind="stable")
        keys = keys[self.near_order]
        self.near_new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        starts = np.flatnonzero(self.near_new)
        self.near_keys = keys[starts]
        own = self.ids[self.rows[self.near]][self.near_order]
        self.least = np.minimum.reduceat(own, starts) if len(starts) else np.zeros(0, np.int64)

    def covered(self, side: pa.Table) -> np.ndarray:
        """Whether each word is in a window that also starts in a document of smaller id."""
        self.candidates(side)
        other = packed.received(side, "window", self.near_keys, self.bits, packed.bits_of, np.zeros(len(self.near_keys), bool))
        edge = np.zeros(len(self.rows) + 1, np.int64)
        if len(self.near):
            k = np.cumsum(self.near_new) - 1
            at = self.near[self.near_order]
            gone = at[other[k] | (self.ids[self.rows[at]] > self.least[k])]
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + self.window, -1)
        return np.cumsum(edge)[: len(self.rows)] > 0


def _shared(order, starts, values, lengths):
    flags = [packed.bits_of(v, 2 * n) for v, n in zip(values, lengths)]
    indexed = np.concatenate([f[: len(f) // 2] for f in flags])[order]
    many = np.concatenate([f[len(f) // 2 :] for f in flags])[order]
    held = np.diff(np.append(starts, len(order)))
    hit = packed.spread(order, starts, np.logical_or.reduceat(indexed, starts) & ((held > 1) | np.logical_or.reduceat(many, starts)))
    return [np.packbits(x).tobytes() if x.any() else None for x in packed.split(hit, lengths)]


def _earlier(order, starts, values, lengths):
    ids = np.concatenate([textkit.from_planes(v, np.int64) for v in values])
    least = packed.spread(order, starts, np.minimum.reduceat(ids[order], starts))
    return [np.packbits(x).tobytes() if x.any() else None for x in packed.split(least < ids, lengths)]


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Remove every word covered by a `window`-word passage that also starts in a document of smaller id.

    Words are maximal runs of anything but space and tab to carriage return. Returns doc_id, n_words,
    n_removed, kept_text (kept words joined by one space) and spans (word ranges removed, maximal).
    A null text has no words; texts shorter than the window are kept whole. Of rows with equal ids
    neither counts as smaller, so repeated rows keep their words unless an earlier id has them. Rows
    with a null id are returned unchanged and never remove words of others. Other columns of `df`
    are ignored, whatever their names. An empty table gives an empty result.
    """
    if window < 3:
        raise ValueError("window must be 3 words at least")
    plan = packed.layout(df, text_col)
    bits = plan.bits
    docs = packed.dealt(df, id_col, text_col, plan)

    def anchors(key, table):
        return _Group(table, window, bits).sent_anchors(key[0].as_py())

    def windows(key, table, side):
        g = _Group(table, window, bits)
        g.candidates(side)
        return packed.send(key[0].as_py(), g.near_keys, bits, 8, lambda a, b: textkit.planes(g.least[a:b]))

    def finish(key, table, side):
        g = _Group(table, window, bits)
        gone = g.covered(side)
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[g.first[1:]] - total[g.first[:-1]]
        kept, spans = [], []
        for k, text in enumerate(table["text"].to_pylist()):
            own = (text or "").encode().split()
            if removed[k]:
                mask = gone[g.first[k] : g.first[k + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                own = compress(own, ~mask)
            else:
                spans.append([])
            kept.append(b" ".join(own).decode())
        return pa.table([table["id"], np.diff(g.first), removed, pa.array(kept, pa.string()), spans], schema=_RESULT)

    hits = packed.answer(docs.groupBy("grp").applyInArrow(anchors, packed.SENT), "anchor", 4, plan, _shared)
    sent = docs.groupBy("grp").cogroup(hits.groupBy("grp")).applyInArrow(windows, packed.SENT)
    back = hits.unionByName(packed.answer(sent, "window", 8, plan, _earlier))
    return docs.groupBy("grp").cogroup(back.groupBy("grp")).applyInArrow(finish, RESULT)
