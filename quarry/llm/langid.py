"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are byte 3-grams and 4-grams of lower-cased words with their boundaries, hashed to 2**16
buckets. A text is the mean of its subwords' embeddings, followed by a linear layer and a softmax.
Training is minibatch stochastic gradient descent in numpy on a bounded sample; a temperature and a
rejection threshold are then calibrated on a tenth of the sample that training did not see. Since
the mean and the layer are linear, prediction sums one precomputed row of logits per subword.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .toxicity import bounded_sample

BITS = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _subwords(body: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(position, bucket) of the 3-grams and of the 4-grams, each within one row."""
    x = textkit.LOWER[body]
    x = np.where(textkit.NOT_ALNUM[x] | ((x >= 0x30) & (x <= 0x39)), 0x20, x).astype(np.uint64)
    out = []
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets[:-1]] = True
    for n in (3, 4):
        m = len(body) - n + 1
        if m <= 0:
            continue
        key = np.zeros(m, np.uint64)
        cross = np.zeros(m, bool)
        letters = np.zeros(m, np.int8)
        for k in range(n):
            key |= x[k : m + k] << np.uint64(8 * k)
            letters += x[k : m + k] != 0x20
            if k:
                cross |= edge[k : m + k]
        at = np.flatnonzero(~cross & (letters >= 2))
        out.append((at, ((key[at] + np.uint64(n)) * _ODD >> np.uint64(64 - BITS)).astype(np.int32)))
    return out


def _counts(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their counts for each row."""
    body, offsets = textkit.buffers(column)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in textkit.pieces(offsets):
        part, own = body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        keys = [np.zeros(0, np.int64)]
        for at, bucket in _subwords(part, own):
            row = np.searchsorted(own, at, "right") - 1
            keys.append(row * np.int64(1 << BITS) + bucket)
        u, c = np.unique(np.concatenate(keys), return_counts=True)
        edge = np.searchsorted(u >> BITS, np.arange(b - a + 1))
        out += [((u[i:j] & ((1 << BITS) - 1)).astype(np.int32), c[i:j].astype(np.int32)) for i, j in zip(edge[:-1], edge[1:])]
    return out


@dataclass
class LanguageModel:
    labels: list[str]
    logits: np.ndarray  # (buckets, labels) float32: embedding times layer
    bias: np.ndarray
    temperature: float
    reject_below: float


def fit_language(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], dim: int = 16, steps: int = 320, rate: float = 4.0, batch: int = 32, keep: float = 0.98, seed: int = 0) -> LanguageModel:
    """Train on (distinct buckets, counts) per document, about `steps` minibatches. `keep` of the calibration rows stay above the rejection threshold."""
    names = sorted(set(labels))
    y = np.searchsorted(names, labels)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, train = order[: len(order) // 10], order[len(order) // 10 :]
    emb = rng.normal(0, 0.1, (1 << BITS, dim))
    layer = rng.normal(0, 0.1, (dim, len(names)))
    bias = np.zeros(len(names))

    def features(chosen):
        flat = np.concatenate([rows[i][0] for i in chosen])
        w = np.concatenate([rows[i][1] / max(rows[i][1].sum(), 1) for i in chosen])
        return flat, w, np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])

    def forward(flat, w, doc, n):
        mean = np.zeros((n, dim))
        for k in range(dim):
            mean[:, k] = np.bincount(doc, emb[flat, k] * w, n)
        z = mean @ layer + bias
        e = np.exp(z - z.max(1, keepdims=True))
        return mean, z, e / e.sum(1, keepdims=True)

    epochs = max(1, round(steps * batch / max(len(train), 1)))
    for epoch in range(epochs if len(names) > 1 else 0):
        lr = rate * (1 - epoch / epochs)
        rng.shuffle(train)
        for a in range(0, len(train), batch):
            own = train[a : a + batch]
            flat, w, doc = features(own)
            mean, _, p = forward(flat, w, doc, len(own))
            p[np.arange(len(own)), y[own]] -= 1
            p /= len(own)
            back = p @ layer.T
            layer -= lr * mean.T @ p
            bias -= lr * 0.1 * p.sum(0)
            np.add.at(emb, flat, -lr * 8 * w[:, None] * back[doc])
    temperature, reject = 1.0, 0.0
    if len(held) and len(names) > 1:
        flat, w, doc = features(held)
        _, z, _ = forward(flat, w, doc, len(held))
        grid = np.geomspace(0.05, 5, 60)
        logp = lambda t: z / t - np.log(np.exp(z / t - (z / t).max(1, keepdims=True)).sum(1, keepdims=True)) - (z / t).max(1, keepdims=True)
        loss = [-logp(t)[np.arange(len(held)), y[held]].mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        reject = float(np.quantile(np.exp(logp(temperature)).max(1), 1 - keep))
    return LanguageModel(names, (emb @ layer).astype(np.float32), bias.astype(np.float32), temperature, reject)


def fit_langid(docs: DataFrame, sample: int = 2_000, sample_bytes: int = 16_000_000, **how) -> LanguageModel:
    """Fit on about `sample` documents (2 * `sample` at most) of (doc_id, text, lang); null texts and langs are left out.

    Ids are drawn by their hash; of rows that repeat an id the text of least hash speaks, and rows
    with a null id are one document. Fewer take part where their texts would pass `sample_bytes`,
    and none of more than a hundredth of that, so what reaches the driver is bounded in bytes too.
    """
    size = F.octet_length("text").cast("long")
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    d = d.where("lang IS NOT NULL AND text IS NOT NULL").where(size <= sample_bytes // 100)
    ids = bounded_sample(d.select("doc_id").distinct(), "doc_id", sample)
    d = d.join(F.broadcast(ids), "doc_id", "left_semi")  # 2 * sample ids at most
    d = d.groupBy("doc_id").agg(F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "lang")).alias("x")).select("doc_id", "x.text", "x.lang")
    total = d.agg(F.sum(size)).first()[0] or 0
    if total > sample_bytes:
        d = d.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 40)) < F.lit(int((1 << 40) * sample_bytes / total)))

    def pack(batches):
        for batch in batches:
            rows = _counts(batch.column(1))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([f.tobytes() for f, _ in rows], pa.binary()), pa.array([c.tobytes() for _, c in rows], pa.binary())], names=["doc_id", "lang", "f", "c"])

    got = d.mapInArrow(pack, "doc_id long, lang string, f binary, c binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["lang"], r["f"]))
    got = [r for r in got if r["f"]]
    if not got:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    return fit_language([(np.frombuffer(r["f"], np.int32), np.frombuffer(r["c"], np.int32)) for r in got], [r["lang"] for r in got], **how)


RESULT = "doc_id long, lang_pred string, score double, rejected boolean"


def langid(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The language of every whole text: doc_id, lang_pred, score (calibrated probability), rejected.

    A null text, or one without a letter, is `und` with score 0, and so is every text when nothing
    could be learned. `rejected` marks predictions below the calibrated confidence; they keep their
    label. Repeated rows and null ids are returned each; other columns are ignored; an empty table
    gives no rows. The model, 4 * 2**16 bytes a language, is broadcast.
    """
    labels = np.array([*model.labels, "und"], object)
    bias, t, reject, n_labels = model.bias, model.temperature, model.reject_below, len(model.labels)
    logits = docs.sparkSession.sparkContext.broadcast(model.logits)

    def predict(batches):
        table = logits.value
        for batch in batches:
            body, offsets = textkit.buffers(batch.column(1))
            n = batch.num_rows
            z, total = np.zeros((n, n_labels)), np.zeros(n)
            for a, b in textkit.pieces(offsets):
                own = offsets[a : b + 1] - offsets[a]
                for at, bucket in _subwords(body[offsets[a] : offsets[b]], own):
                    edge = np.searchsorted(at, own)
                    total[a:b] += np.diff(edge)
                    for k in range(n_labels):
                        sums = np.concatenate(([0.0], np.cumsum(table[bucket, k], dtype=np.float64)))
                        z[a:b, k] += sums[edge[1:]] - sums[edge[:-1]]
            letters = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool) & (n_labels > 0)
            best, score, low = np.full(n, n_labels), np.zeros(n), np.ones(n, bool)
            if n_labels:
                z = (z / np.maximum(total, 1)[:, None] + bias) / t
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = np.where(letters, p.argmax(1), n_labels)
                score = np.where(letters, p.max(1), 0.0)
                low = score < max(reject, 1e-12)
            yield pa.record_batch([batch.column(0), pa.array(labels[best], pa.string()), score, low], names=["doc_id", "lang_pred", "score", "rejected"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return d.mapInArrow(predict, RESULT)
