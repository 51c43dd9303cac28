"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade >= j) = sigmoid(score - threshold_j): one weight vector is shared by all ordered thresholds.
Features are hashed words, present or not. The model is fitted in numpy on a bounded sample of
labelled documents with proximal L1 steps, after words that tell nothing about
any threshold are left out, so that long texts gather no noise.

The sample is bounded twice: by `sample` documents and by `sample_bytes` of their text. Documents
are drawn by a hash of the id, the same ones on every run; those that hash to `HELD_OUT` of FOLDS
never take part, so the model can be judged on them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit

BITS = 18
FOLDS, HELD_OUT = 5, 0


def _features(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each word, repeats included."""
    rows, hashes = textkit.words(column, textkit.NOT_ALNUM, lower=True)
    return rows, (hashes >> np.uint64(64 - BITS)).astype(np.int32)


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """About n rows and never more than 2 n, the same ones on every run: those whose key hashes low."""
    total = df.count()
    if total <= n:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 40)) < F.lit(int((1 << 40) * n / total))).orderBy(F.xxhash64(key, F.lit(7)), key).limit(2 * n)


def held_out(id_col: Column) -> Column:
    """Whether a document never takes part in a fit."""
    return F.pmod(F.xxhash64(id_col.cast("long"), F.lit(11)), F.lit(FOLDS)) == HELD_OUT


@dataclass
class OrdinalModel:
    weights: np.ndarray
    cuts: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, ..., one column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -40, 40)))

    def score(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        use = np.flatnonzero(self.weights[features])
        pairs = np.unique(rows[use] * np.int64(1 << BITS) + features[use])
        return np.bincount(pairs >> BITS, self.weights[pairs & ((1 << BITS) - 1)], n) if len(pairs) else np.zeros(n)


def _sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run; empty runs give 0."""
    out = np.zeros(len(starts))
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(values, starts[full])
    return out


def _telling(flat: np.ndarray, sizes: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Features in three documents or more whose presence depends on some threshold.

    The deviation of the documents above a threshold from its share of all must pass
    sqrt(2 ln features) standard deviations, which features without a bearing seldom do.
    """
    seen = np.bincount(flat, minlength=1 << BITS)
    names = np.flatnonzero(seen >= 3)
    bound = np.sqrt(2 * np.log(max(len(names), 2)))
    keep = np.zeros(len(names), bool)
    for j in range(hit.shape[1]):
        above = np.bincount(flat[np.repeat(hit[:, j], sizes)], minlength=1 << BITS)[names]
        q = np.clip(hit[:, j].mean(), 1e-9, 1 - 1e-9)
        keep |= np.abs(above - q * seen[names]) >= bound * np.sqrt(seen[names] * q * (1 - q))
    return names[keep]


def fit_ordinal(flat: np.ndarray, sizes: np.ndarray, grades: np.ndarray, l1: float = 5e-5, epochs: int = 200) -> OrdinalModel:
    """Fit by accelerated proximal gradient on the mean log loss.

    Documents are sets of features: `flat` holds them one document after another, `sizes` how many
    each has. With K grades there are K - 1 thresholds, kept in order. Features that tell nothing
    about any threshold are left out. Without any document, or with one grade only, every score is
    0 and nothing reaches grade 1.
    """
    weights = np.zeros(1 << BITS)
    top = int(grades.max()) if len(grades) else 0
    if not top:
        return OrdinalModel(weights, np.array([40.0]))
    n = len(sizes)
    hit = grades[:, None] >= np.arange(1, top + 1)[None, :]
    names = _telling(flat, sizes, hit)
    m = len(names)
    place = np.full(1 << BITS, -1, np.int32)
    place[names] = np.arange(m)
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
    flat = place[flat]
    doc, flat = doc[flat >= 0], flat[flat >= 0]
    by_doc = np.bincount(doc, minlength=n)
    doc_starts = np.cumsum(by_doc) - by_doc
    seen = np.bincount(flat, minlength=m)
    starts = np.cumsum(seen) - seen
    doc = doc[np.argsort(flat, kind="stable")]
    # Features are scaled to unit size, so that rare decisive words move as fast as others.
    scale = 1 / np.sqrt(np.maximum(seen, 1) / n)
    forth = lambda x: _sums((x * scale)[flat], doc_starts, by_doc)
    back = lambda x: _sums(x[doc], starts, seen) * scale
    share = np.clip(hit.mean(0), 1e-4, 1 - 1e-4)
    cuts = -np.log(share / (1 - share))
    # The step is one over the largest curvature: a quarter of the features' largest eigenvalue for each threshold.
    u, size = np.ones(m) / np.sqrt(max(m, 1)), 1.0
    for _ in range(20):
        u = back(forth(u)) / n
        size = max(float(np.sqrt(u @ u)), 1.0)
        u /= size
    step = 4 / (top * (size + 1))
    w = np.zeros(m)
    v, vc, t = w.copy(), cuts.copy(), 1.0
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(forth(v)[:, None] - vc[None, :], -40, 40)))
        e = (p - hit) / n
        g = back(e.sum(1))
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1 * scale.clip(max=30), 0)
        cut = np.sort(vc + step * e.sum(0))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        turned = (v - new) @ (new - w) + (vc - cut) @ (cut - cuts) > 0
        v, vc = new + (t - 1) / t2 * (new - w), cut + (t - 1) / t2 * (cut - cuts)
        if turned:
            t2, v, vc = 1.0, new.copy(), cut.copy()
        w, cuts, t = new, cut, t2
    weights[names] = w * scale
    return OrdinalModel(weights, cuts)


def fit_toxicity(docs: DataFrame, grades: DataFrame, sample: int = 20_000, sample_bytes: int = 64_000_000, **how) -> OrdinalModel:
    """Fit on documents with a grade (doc_id, grade 0, 1, ...); null grades are left out, of repeated ones the highest counts.

    At most 2 * `sample` documents take part, fewer where their texts would pass `sample_bytes`; a
    document of more than a hundredth of that takes no part. Held-out documents never do.
    """
    g = grades.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    g = bounded_sample(g.where(~held_out(F.col("doc_id"))), "doc_id", sample)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    d = d.join(F.broadcast(g), "doc_id").where(size <= sample_bytes // 100)  # 2 * sample rows at most
    total = d.agg(F.sum(size)).first()[0] or 0
    if total > sample_bytes:
        d = d.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 40)) < F.lit(int((1 << 40) * sample_bytes / total)))

    def pack(batches):
        for batch in batches:
            rows, f = _features(batch.column(1))
            pairs = np.unique(rows * np.int64(1 << BITS) + f)
            edge = np.searchsorted(pairs >> BITS, np.arange(batch.num_rows + 1))
            own = (pairs & ((1 << BITS) - 1)).astype(np.int32)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([own[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())], names=["doc_id", "grade", "f"])

    got = d.select("doc_id", "text", "grade").mapInArrow(pack, "doc_id long, grade int, f binary").toArrow().sort_by([("doc_id", "ascending"), ("f", "ascending")])
    f = got["f"].cast(pa.large_binary()).combine_chunks() if got.num_rows else pa.array([], pa.large_binary())
    f = pa.concat_arrays(f.chunks) if isinstance(f, pa.ChunkedArray) else f
    if not len(f):
        return fit_ordinal(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), **how)
    offsets = np.frombuffer(f.buffers()[1], np.int64)[f.offset : f.offset + len(f) + 1]
    flat = np.frombuffer(f.buffers()[2], np.int32)[offsets[0] // 4 : offsets[-1] // 4] if f.buffers()[2] else np.zeros(0, np.int32)
    return fit_ordinal(flat, np.diff(offsets) // 4, got["grade"].to_numpy().astype(np.int64), **how)


RESULT = "doc_id long, score double, severity double, p_toxic double, grade int, toxic boolean"


class _Shipped:
    """A model as its nonzero weights: what travels with a task."""

    def __init__(self, model: OrdinalModel):
        self.names = np.flatnonzero(model.weights)
        self.values, self.cuts = model.weights[self.names], model.cuts

    def model(self) -> OrdinalModel:
        weights = np.zeros(1 << BITS)
        weights[self.names] = self.values
        return OrdinalModel(weights, self.cuts)

    def p_toxic(self, p: np.ndarray, toxic_from: int) -> np.ndarray:
        """P(grade >= toxic_from), 0 beyond the highest grade that was learned."""
        return p[:, toxic_from - 1] if toxic_from <= p.shape[1] else np.zeros(len(p))


def _scored(model: OrdinalModel, column) -> tuple[np.ndarray, np.ndarray]:
    """(score, whether it has a word) of each text; runs of rows are read one by one, so a batch's words are never held at once."""
    scores, said = [np.zeros(0)], [np.zeros(0, bool)]
    for a, b in textkit.pieces(textkit.buffers(column)[1]):
        rows, f = _features(column.slice(a, b - a))
        scores.append(model.score(rows, f, b - a))
        said.append(np.bincount(rows, minlength=b - a) > 0)
    textkit.give_back()
    return np.concatenate(scores), np.concatenate(said)


def toxicity(docs: DataFrame, model: OrdinalModel, toxic_from: int = 1, threshold: float = 0.5) -> DataFrame:
    """Grade every whole text: doc_id, score, severity (expected grade), p_toxic, grade, toxic.

    p_toxic is P(grade >= toxic_from), and toxic says whether it reaches `threshold`. A null or
    empty text has score 0, so the thresholds alone speak, but it is never toxic. Repeated rows and
    null ids are returned each; other columns are ignored; an empty table gives no rows. The model
    is shipped with the task as its nonzero weights, at most 2**18 and in practice a few thousand.
    """
    shipped = _Shipped(model)

    def predict(batches):
        m = shipped.model()
        for batch in batches:
            s, said = _scored(m, batch.column(1))
            p = m.at_least(s)
            q = shipped.p_toxic(p, toxic_from)
            yield pa.record_batch([batch.column(0), s, p.sum(1), q, (p >= 0.5).sum(1).astype(np.int32), (q >= threshold) & said], names=["doc_id", "score", "severity", "p_toxic", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(predict, RESULT)


def without_toxic(docs: DataFrame, model: OrdinalModel, toxic_from: int = 1, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all columns, that `toxicity` doesn't call toxic; no shuffle. Null and empty texts stay."""
    shipped, at = _Shipped(model), docs.columns.index("text")

    def select(batches):
        m = shipped.model()
        for batch in batches:
            score, said = _scored(m, batch.column(at))
            q = shipped.p_toxic(m.at_least(score), toxic_from)
            yield batch.filter(pa.array((q < threshold) | ~said))

    return docs.mapInArrow(select, docs.schema)
