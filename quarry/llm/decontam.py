"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are normalised (lower-case ASCII, everything but letters and digits one space). A passage of m
bytes within e edits of a benchmark item shares at least m + 1 - q * (e + 1) of the item's q-grams,
all on diagonals at most e apart. Shared q-grams are counted in overlapping diagonal bands, each 2 w
wide and starting every w > e diagonals, so some band holds them all; regions that meet the bound
are verified by a banded alignment of the whole item. Items longer than a block are no special case;
items too short for the lemma (bound below 1) are searched for exactly, as whole words.

A q-gram that an item repeats at places at most w apart, as in repetitive text, fills a range of
bands without a gap. It is counted by the range's two ends, so the work and the memory of a text
position don't grow with the repeats.

The items reach the tasks in blocks of bounded size, one pass over the documents for each block. A
single block is one lazy plan. With more, each pass is written before the next block is fetched, so
the driver holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .shared import checkpointed

Q = 12
#: Normalised bytes of items that one pass ships to the tasks.
BLOCK_BYTES = 8_000_000
#: Runs of places that are looked at together; beyond it rows and items are taken one by one.
ENTRIES = 8_000_000
#: Diagonals that one alignment takes at most.
DIAGONALS = 1 << 16
_SIEVE_BITS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
RESULT = "doc_id long, item_id long, start int, end int, edits int"
_RESULT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])
_FOLD = textkit.LOWER.copy()
_FOLD[textkit.NOT_ALNUM[textkit.LOWER]] = 0x20


def normalise(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with runs of separators as one space, and the new offsets."""
    x = _FOLD[body]
    keep = np.ones(len(x), bool)
    blank = x == 0x20
    keep[1:] = ~(blank[1:] & blank[:-1])
    total = np.concatenate(([0], np.cumsum(keep)))
    return x[keep], total[offsets]


def qgrams(x: np.ndarray) -> np.ndarray:
    """A 64-bit key of the Q bytes from each position on."""
    m = len(x) - Q + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    two = x[:-1].astype(np.uint64) | (x[1:].astype(np.uint64) << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    return eight[:m] * _ODD ^ (four[8 : 8 + m] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)


def edit_budget(m: int, rate: float) -> int:
    """Edits allowed for an item of m bytes: `rate` of them, less where the lemma's bound would fall below 1.

    At a rate of 0.05 that is none below 36 bytes, and one or two edits less than the rate up to 80.
    """
    return max(0, min(int(m * rate), (m + 1) // Q - 2))


def banded_edits(item: np.ndarray, text: np.ndarray, shift: int, width: int) -> tuple[int, int, int]:
    """Least edits that turn the item into a part of `text`, on diagonals shift - width .. shift + width.

    Returns (edits, start, end). Row i holds the costs of cells (i, i + d); a gap within a row is a
    running minimum. Start positions are carried along.
    """
    n, far = 2 * width + 1, 1 << 20
    d = np.arange(n)
    j = shift - width + d
    cost = np.where((j >= 0) & (j <= len(text)), 0, far).astype(np.int64)
    start = j.copy()
    padded = np.concatenate((np.zeros(1, np.uint8), text))
    for i in range(1, len(item) + 1):
        j = i + shift - width + d
        ok = (j >= 1) & (j <= len(text))
        change = cost + np.where(ok, padded[np.where(ok, j, 0)] != item[i - 1], far)
        drop, drop_start = np.append(cost[1:] + 1, far), np.append(start[1:], 0)
        best = np.where(change <= drop, change, drop)
        own = np.where(change <= drop, start, drop_start)
        flat = (best - d) * n + d
        low = np.minimum.accumulate(flat)
        source = low % n
        cost, start = np.minimum((low - source) // n + d, far), own[source]
        cost[(j < 0) | (j > len(text))] = far
    k = int(np.argmin(cost))
    return int(cost[k]), int(start[k]), int(len(item) + shift - width + k)


class Index:
    """The q-grams of a block of items."""

    def __init__(self, ids: list[int], texts: list[bytes], rate: float):
        self.ids, self.texts = ids, [np.frombuffer(t, np.uint8) for t in texts]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.edits = np.array([edit_budget(int(m), rate) for m in self.sizes], np.int64)
        self.bound = self.sizes + 1 - Q * (self.edits + 1)
        grams = [qgrams(t) for t in self.texts]
        keys = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, item, place = keys[order], item[order], place[order]
        # Places of one q-gram in one item that lie within the band width are one run.
        apart = np.ones(len(keys), bool)
        if len(keys):
            apart[1:] = (keys[1:] != keys[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > self.edits[item[1:]] + 1)
        run = np.flatnonzero(apart)
        keys, self.item, self.place = keys[run], item[run], place[run]
        self.last = place[np.append(run[1:], len(place)) - 1] if len(run) else self.place
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.first, self.held = keys[first], first, np.diff(np.append(first, len(keys)))
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[(self.keys * _ODD) >> np.uint64(64 - _SIEVE_BITS)] = True
        self.short = [k for k, m in enumerate(self.sizes) if 0 < m < Q]

    def search(self, x: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of every item within its budget, the first such place of each."""
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        grams = qgrams(x)
        at = np.flatnonzero(self.sieve[(grams * _ODD) >> np.uint64(64 - _SIEVE_BITS)]) if len(self.keys) else np.zeros(0, np.int64)
        k = np.searchsorted(self.keys, grams[at])
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == grams[at] if len(at) else np.zeros(0, bool)
        at, k = at[hit], k[hit]
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[row + 1]
        at, k, row = at[inside], k[inside], row[inside]
        if self.held[k].sum() <= ENTRIES:
            self._hits(x, offsets, at, k, row, None, found)
        else:  # one row and one item at a time
            for r in np.unique(row):
                own = np.flatnonzero(row == r)
                for t in range(len(self.ids)):
                    self._hits(x, offsets, at[own], k[own], row[own], t, found)
        for t in self.short:
            word = b" " + self.texts[t].tobytes() + b" "
            for r in range(len(offsets) - 1):
                p = (b" " + x[offsets[r] : offsets[r + 1]].tobytes() + b" ").find(word)
                if p >= 0:
                    found[r, t] = (0, p, p + len(word) - 2)
        return [(r, t, s, e, c) for (r, t), (c, s, e) in sorted(found.items())]

    def _hits(self, x, offsets, at, k, row, only, found) -> None:
        """Look at the entries of the q-grams at `at`, of one item only where that is given."""
        held = self.held[k]
        if only is not None:
            has = np.zeros(len(self.keys), bool)
            has[np.searchsorted(self.first, np.flatnonzero(self.item == only), "right") - 1] = True
            at, k, row, held = at[has[k]], k[has[k]], row[has[k]], held[has[k]]
        if not len(at):
            return
        which = np.repeat(np.arange(len(at)), held)
        entry = np.arange(len(which)) - np.repeat(np.cumsum(held) - held, held) + self.first[k][which]
        if only is not None:
            which, entry = which[self.item[entry] == only], entry[self.item[entry] == only]
        origin = at[which] - offsets[row[which]]
        self._bands(x, offsets, row[which], self.item[entry], origin - self.last[entry], origin - self.place[entry], found)

    def _bands(self, x, offsets, row, item, least, most, found) -> None:
        """Count shared q-grams in bands of two neighbouring buckets and verify those that meet the bound.

        An entry adds one to each bucket from that of its least to that of its greatest diagonal.
        Counts change only where a range starts or ends, so they are kept as steps: from bucket b of
        a step up to that of the next one every bucket has the step's count.
        """
        low = 1 << 31
        width = self.edits[item] + 1
        row, item = np.concatenate((row, row)), np.concatenate((item, item))
        bucket = np.concatenate(((least + low) // width, (most + low) // width + 1))
        change = np.ones(len(bucket), np.int64)
        change[len(width) :] = -1
        order = np.lexsort((bucket, item, row))
        r, t, b, change = row[order], item[order], bucket[order], change[order]
        new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (t[1:] != t[:-1]) | (b[1:] != b[:-1]))))
        change = np.add.reduceat(change, new)
        new, n = new[change != 0], np.cumsum(change)[change != 0]
        r, t, b = r[new], t[new], b[new]
        follows = np.append((r[1:] == r[:-1]) & (t[1:] == t[:-1]), False)
        upto = np.where(follows, np.append(b[1:], 0), b + 1)
        beyond = np.where(follows, np.append(n[1:], 0), 0)
        bound = np.maximum(self.bound[t], 1)
        # Within a step two neighbours hold twice its count, at its end its own and the next one's.
        for i in np.flatnonzero((n > 0) & (np.where(upto - b > 1, np.maximum(2 * n, n + beyond), n + beyond) >= bound)):
            key = (int(r[i]), int(t[i]))
            w = int(self.edits[t[i]]) + 1
            first = int(b[i]) if 2 * n[i] >= bound[i] else int(upto[i]) - 1
            most = max(1, DIAGONALS // w)
            for start in range(first, int(upto[i]), most):
                if key in found:
                    break
                bands = min(most, int(upto[i]) - start)
                best = self._verify(self.texts[t[i]], x[offsets[r[i]] : offsets[r[i] + 1]], start * w - low, (bands + 1) * w, w)
                if best[0] <= self.edits[t[i]]:
                    found[key] = best

    @staticmethod
    def _verify(item: np.ndarray, text: np.ndarray, d: int, span: int, w: int) -> tuple[int, int, int]:
        """(edits, start, end) of the best place whose diagonal is one of `span` from d on; w is the margin."""
        m, at = len(item), max(d, 0)
        p = text[at : d + span + m - 1].tobytes().find(item.tobytes()) if d + span > 0 else -1
        if p >= 0:
            return 0, at + p, at + p + m
        a = max(0, d - w)
        half = span // 2
        c, s, e = banded_edits(item, text[a : d + span + m + w], d + half - a, half + w + 1)
        return c, s + a, e + a


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, start, end, edits.

    An item is found where a part of the text differs from it by at most `edit_budget` edits (both
    normalised): `rate` of its bytes, fewer for items below 80 bytes. One row is returned for each
    document row and item, with the first place in normalised bytes. Null or empty texts and items
    match nothing; repeated documents are searched each and repeated items reported once; null item
    ids are left out, null document ids are reported as null. Other columns are ignored; an empty
    table on either side gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def pass_over(ids: list[int], words: list[bytes]) -> DataFrame:
        def search(batches):
            index = Index(ids, words, rate)
            for batch in batches:
                own = batch.column(0).to_pylist()
                for a, rows in _searched(index, batch.column(1)):
                    yield pa.record_batch([[own[a + r] for r, *_ in rows], [ids[t] for _, t, *_ in rows], [s for _, _, s, _, _ in rows], [e for *_, e, _ in rows], [c for *_, c in rows]], schema=_RESULT)

        return texts.mapInArrow(search, RESULT)

    out = None
    for ids, words, more in _blocks(benchmark, item_id_col, item_text_col):
        part = pass_over(ids, words)
        part = checkpointed(part) if more else part
        out = out.unionByName(part) if out else part
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """The rows of `docs`, with all columns, in which `decontaminate` finds no item; no shuffle."""
    at = docs.columns.index(text_col)

    def pass_over(d: DataFrame, ids: list[int], words: list[bytes]) -> DataFrame:
        def select(batches):
            index = Index(ids, words, rate)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for a, rows in _searched(index, batch.column(at)):
                    clean[[a + r for r, *_ in rows]] = False
                yield batch.filter(pa.array(clean))

        return d.mapInArrow(select, d.schema)

    for ids, words, more in _blocks(benchmark, item_id_col, item_text_col):
        docs = pass_over(docs, ids, words)
        docs = checkpointed(docs) if more else docs
    return docs


def _searched(index: Index, column):
    """(first row, matches) of each run of rows."""
    body, offsets = textkit.buffers(column)
    for a, b in textkit.pieces(offsets):
        yield a, index.search(*normalise(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
    textkit.give_back()


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[int], list[bytes], bool]]:
    """Normalised items in blocks of about BLOCK_BYTES, and whether more blocks follow; one empty block if there are none."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct().orderBy("i", "t")
    ids: list[int] = []
    words: list[bytes] = []
    seen: set[bytes] = set()
    size, last = 0, None
    for r in items.toLocalIterator():
        body = np.frombuffer(r["t"].encode(), np.uint8)
        word = normalise(body, np.array([0, len(body)]))[0].tobytes().strip()
        seen = seen if r["i"] == last else set()
        last = r["i"]
        if not word or word in seen:
            continue
        seen.add(word)
        if size + len(word) > BLOCK_BYTES and ids:
            yield ids, words, True
            ids, words, size = [], [], 0
        ids.append(r["i"])
        words.append(word)
        size += len(word)
    yield ids, words, False
