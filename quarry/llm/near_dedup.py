"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of all word shingles come from the packed exchange (packed.py).
2. Shingles that no other document holds bound what a text can have in common with any other: with W
   its whole and C its common weight, a link to another needs C >= threshold * W. Texts that fail are
   classes of their own. With C summed in blocks of the shingles' hashes and M the sum of both texts'
   lesser blocks, M / (W + W' - M) bounds the similarity of two texts. Every other distinct text gets
   `bands * rows` consistent weighted samples of its TF-IDF shingles: with r, c ~ Gamma(2, 1) and
   b ~ U(0, 1) by shingle and sample, t = floor(ln w / r + b), the sample is the pair (shingle, t)
   of least ln c - r (t - b) - r. Two texts agree in a sample with a probability equal to their
   weighted Jaccard similarity. Texts that agree in a whole band share a bucket.
3. A bucket's text of least id leads it, and every member is verified against it by exact weighted
   Jaccard similarity. Where all members end in the leader's component, nothing is left to do. In the
   other buckets each member outside that component is verified against every member of another
   component, unless that bound is too small or the distances of both to the leader differ by more
   than 1 - threshold: weighted Jaccard distance is a metric, so those cannot link. No link within a
   bucket is lost, and none is capped. Large buckets are cut into cells of bounded size.
4. Links join into components by minimum labels; a class is named by its least id.

The weight of a shingle is (1 + ln tf) * (1 + alpha * ln(1 + N / df) / ln(1 + N)). alpha is small on
purpose: with a plain IDF the common shingles of a large group of near copies would weigh so little
against each copy's own edits that true near copies fell below the threshold.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed, textkit
from .shared import checkpointed, dropped

WIDTH = 5  # bytes of a shingle's hash that are sent, below the bucket's bits
#: Most ids that are broadcast to thin out the documents before a verification; beyond it all are dealt.
BROADCAST_IDS = 1_000_000
#: Blocks of shingles whose weights bound what two texts share.
BLOCKS = 64
#: Members and outsiders of a bucket that meet in one group.
CELL = 4096
#: Slack for the rounding of 32-bit weights where distances are compared.
SLACK = 1e-4
_POOL = np.random.default_rng(31337)
_R = _POOL.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_C = np.log(_POOL.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_B = _POOL.random(1 << 16, dtype=np.float32)
_STEP = np.uint64(0xD6E8FEB86659FD93)
SIGNED = "grp int, digest binary, ids array<long>, bands array<long>, levels binary, whole double, common array<float>"
_SIGNED = pa.schema([("grp", pa.int32()), ("digest", pa.binary()), ("ids", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64())), ("levels", pa.binary()), ("whole", pa.float64()), ("common", pa.list_(pa.float32()))])
SIDE = "grp int, kind string, a long, b long, vals binary"
_SIDE = pa.schema([("grp", pa.int32()), ("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("vals", pa.binary())])
_LINK = pa.schema([("u", pa.int64()), ("l", pa.int64()), ("sim", pa.float64())])


def _distinct(table: pa.Table) -> pa.Table:
    """One row per id: of rows that repeat an id, the text of least MD5 speaks."""
    digest = [hashlib.md5((t or "").encode()).digest() for t in table["text"].to_pylist()]
    best: dict[int, int] = {}
    for k, i in enumerate(table["id"].to_pylist()):
        if i not in best or digest[k] < digest[best[i]]:
            best[i] = k
    order = sorted(best.values(), key=lambda k: (digest[k], table["id"][k].as_py()))
    return table.take(pa.array(order, pa.int64())).append_column("digest", pa.array([digest[k] for k in order], pa.binary()))


class _Shingles:
    """Distinct shingles of each text: row, key and count, by row and key."""

    def __init__(self, column, shingle: int, bits: int):
        rows, hashes = textkit.words(column)
        n = len(column)
        first = textkit.first_of_row(rows, n)
        at = np.flatnonzero(textkit.same_row(rows, shingle))
        keys, owner = textkit.grams(hashes, shingle)[at], rows[at]
        short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < shingle))
        if len(short):  # a shorter text is one shingle
            own = [textkit.grams(hashes[first[r] : first[r + 1]], int(first[r + 1] - first[r]))[0] for r in short]
            keys, owner = np.concatenate((keys, np.array(own, np.uint64))), np.concatenate((owner, short))
        keys = packed.trim(keys, bits, WIDTH)
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))) if len(keys) else np.zeros(0, np.int64)
        self.count = np.diff(np.append(new, len(keys)))
        self.keys, self.rows = keys[new], owner[new]
        self.edge = np.searchsorted(self.rows, np.arange(n + 1))

    def weights(self, levels: np.ndarray, total: int, alpha: float) -> np.ndarray:
        df = np.exp2(levels / 8.0)
        return (1 + np.log(self.count)) * (1 + alpha * np.log1p(total / df) / np.log1p(total))


def weighted_samples(keys: np.ndarray, weights: np.ndarray, edge: np.ndarray, samples: int) -> np.ndarray:
    """The sampled (key, t) of each text (edge[i]:edge[i+1] of keys, none empty) for each sample, as one hash."""
    out = np.zeros((len(edge) - 1, samples), np.uint64)
    odd = np.random.default_rng(4242).integers(1, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low16 = np.uint64(0xFFFF)
    a = 0
    while a < len(edge) - 1:
        b = max(a + 1, int(np.searchsorted(edge, edge[a] + (1 << 16), "right")) - 1)
        h = textkit.mix(keys[edge[a] : edge[b]])
        lw = np.log(weights[edge[a] : edge[b]]).astype(np.float32)
        starts = edge[a:b] - edge[a]
        sizes = np.diff(edge[a : b + 1])
        for k in range(samples):
            g = h * odd[k]
            r = _R[g >> np.uint64(48)]
            beta = _B[(g >> np.uint64(32)) & low16]
            t = np.floor(lw / r + beta)
            value = _C[(g >> np.uint64(16)) & low16] - r * (t - beta + 1)
            least = np.minimum.reduceat(value, starts)
            at = np.flatnonzero(value == np.repeat(least, sizes))
            owner = np.searchsorted(starts, at, "right") - 1
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            pick = at[first]
            out[a:b, k] = textkit.mix(h[pick] + t[pick].astype(np.int64).view(np.uint64) * _STEP)
        a = b
    return out


def _frequency(order, starts, values, lengths):
    counts = np.concatenate([textkit.from_planes(v, np.uint32) for v in values]).astype(np.int64)
    df = np.add.reduceat(counts[order], starts)
    level = packed.spread(order, starts, np.round(8 * np.log2(df)).astype(np.uint8))
    return [x.tobytes() if x.any() else None for x in packed.split(level, lengths)]


def weighted_jaccard(ka: np.ndarray, wa: np.ndarray, kb: np.ndarray, wb: np.ndarray) -> float:
    """Sum of minima over sum of maxima; keys are sorted and distinct."""
    at = np.searchsorted(kb, ka)
    at[at == len(kb)] = 0
    both = kb[at] == ka if len(kb) else np.zeros(len(ka), bool)
    low = np.minimum(wa[both], wb[at[both]]).sum()
    high = wa.sum() + wb.sum() - low
    return float(low / high) if high else 0.0


def components(links: DataFrame, a: str = "u", b: str = "l") -> DataFrame:
    """(node, comp) for every node of the links: the least node that it is connected with.

    Labels start as the least neighbour. Each round passes them both ways over the links and then
    jumps to the label's own label, so rounds grow with the logarithm of a chain's length. Links come
    from written tables and labels are written too, so joins on a hot node are dealt by plain
    exchanges, which Spark can split.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = checkpointed(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).select("node", F.least("node", "comp").alias("comp")))
    while True:
        la = links.join(labels.select(F.col("node").alias("b"), "comp"), "b").select(F.col("a").alias("node"), "comp")
        lb = links.join(labels.select(F.col("node").alias("a"), "comp"), "a").select(F.col("b").alias("node"), "comp")
        passed = la.unionByName(lb).withColumn("old", F.lit(None).cast("long")).unionByName(labels.select("node", "comp", F.col("comp").alias("old")))
        near = checkpointed(passed.groupBy("node").agg(F.min("comp").alias("comp"), F.min("old").alias("old")))
        up = near.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        new = checkpointed(near.join(up, "comp", "left").select("node", F.least("comp", F.coalesce("top", "comp")).alias("comp"), "old"))
        dropped(labels, near)
        labels = new.select("node", "comp")
        if not new.where("comp <> old").limit(1).count():
            return labels


def _with_component(rows: DataFrame, known: DataFrame, node: str, name: str) -> DataFrame:
    """The component of column `node`, which is the node itself where it has no link."""
    return rows.join(known.select(F.col("node").alias(node), F.col("comp").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def _across(pairs: DataFrame, sims: DataFrame, known: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """(u, l) of the bucket members in different components that may link though neither leads.

    A member outside its leader's component meets the members of other components whose distance to
    the leader is within 1 - threshold of its own, if the bound of both weights allows a link. Those
    inside the leader's component never meet each other, so a large group of copies costs one row
    for each of its members and outsider.
    """
    least = threshold - SLACK
    # Only pairs below the threshold can have their ends in different components.
    loose = _with_component(_with_component(sims.where(F.col("sim") < threshold), known, "u", "cu"), known, "l", "cl")
    loose = checkpointed(loose.where("cu <> cl"))
    outside = checkpointed(pairs.join(loose, ["u", "l"]).join(sizes, "u").select("key", F.col("u").alias("l"), F.col("cu").alias("cr"), F.col("sim").alias("sr"), F.col("whole").alias("wr"), F.col("common").alias("mr")))
    in_mixed = pairs.join(outside.select("key").distinct(), "key", "left_semi").join(sims, ["u", "l"])
    in_mixed = _with_component(_with_component(in_mixed, known, "u", "cu"), known, "l", "cl")
    inner = checkpointed(in_mixed.join(sizes, "u").select("key", "u", "cu", (F.col("cu") != F.col("cl")).alias("out"), "sim", "whole", "common"))
    # Members and outsiders of a bucket meet in cells of at most about CELL by CELL.
    counts = inner.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(outside.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key")
    sides = counts.select("key", F.ceil(F.col("n") / CELL).cast("int").alias("a"), F.ceil(F.col("m") / CELL).cast("int").alias("b"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    split = inner.join(sides, "key").withColumn("pa", F.pmod(F.xxhash64("u"), "a").cast("int")).withColumn("pb", every("b")).drop("a", "b")
    copied = outside.join(sides, "key").withColumn("pb", F.pmod(F.xxhash64("l"), "b").cast("int")).withColumn("pa", every("a")).drop("a", "b")

    def meet(left, right):
        u, cu, sim, whole, out = (np.asarray(left[c].to_numpy(zero_copy_only=False)) for c in ("u", "cu", "sim", "whole", "out"))
        common = np.asarray(left["common"].combine_chunks().flatten().to_numpy(), np.float64).reshape(-1, BLOCKS)
        l, cr, sr, wr = (np.asarray(right[c].to_numpy()) for c in ("l", "cr", "sr", "wr"))
        theirs = np.asarray(right["mr"].combine_chunks().flatten().to_numpy(), np.float64).reshape(-1, BLOCKS)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for j in range(len(l)):
            both = whole + wr[j]
            at = np.flatnonzero((cu != cr[j]) & (~out | (u > l[j])) & (np.abs(sim - sr[j]) <= 1 - least) & (np.minimum(whole, wr[j]) * (1 + least) >= both * least))
            if len(at):
                at = at[np.minimum(common[at], theirs[j]).sum(1) * (1 + least) >= both[at] * least]
                found.append((u[at], np.full(len(at), l[j])))
        return pa.table([np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])], names=["u", "l"])

    cell = ["key", "pa", "pb"]
    met = split.groupBy(*cell).cogroup(copied.groupBy(*cell)).applyInArrow(meet, "u long, l long")
    met = checkpointed(met.distinct())
    dropped(loose, outside, inner)
    return met


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, bands: int = 12, rows: int = 4, alpha: float = 0.25) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links) for every distinct id.

    class_id is the least id of the document's near-duplicate class, copy_of the least id with the
    very same text, n_links the verified links of that text to leaders. Words are runs of anything
    but space and tab to carriage return; a text of fewer words than a shingle is one shingle. Texts
    without a word (or null) are classes of their own. Rows that repeat an id are one document,
    for which the text of least MD5 speaks; rows with a null id are left out. Other columns
    are ignored; an empty table gives no rows.
    """
    docs = df.where(F.col(id_col).isNotNull())
    plan = packed.layout(docs, text_col)
    groups, bits, total = plan.groups, plan.bits, max(plan.rows, 1)
    dealt = packed.dealt(docs, id_col, text_col, plan)

    @textkit.frugal
    def keys(key, table):
        s = _Shingles(_distinct(table)["text"], shingle, bits)
        k, count = np.unique(s.keys, return_counts=True)
        return packed.send(key[0].as_py(), k, bits, WIDTH, lambda a, b: textkit.planes(count[a:b].astype(np.uint32)))

    @textkit.frugal
    def sign(key, table, side):
        t = _distinct(table)
        s = _Shingles(t["text"], shingle, bits)
        k, place = np.unique(s.keys, return_inverse=True)
        level = packed.received(side, "level", k, bits, lambda v, n: np.frombuffer(v, np.uint8), np.zeros(len(k), np.uint8))[place]
        digest, ids = t["digest"].to_pylist(), t["id"].to_pylist()
        new = [i for i in range(len(ids)) if not i or digest[i] != digest[i - 1]]
        weight = s.weights(level, total, alpha)
        whole = np.bincount(s.rows, weight, len(ids))
        block = s.rows * BLOCKS + (textkit.mix(s.keys) % np.uint64(BLOCKS)).astype(np.int64)
        common = np.bincount(block, np.where(level > 0, weight, 0.0), len(ids) * BLOCKS).reshape(-1, BLOCKS)
        own = [i for i in new if s.edge[i + 1] > s.edge[i] and common[i].sum() >= (threshold - SLACK) * whole[i]]
        use = np.zeros(len(ids), bool)
        use[own] = True
        pick = use[s.rows]
        edge = np.concatenate(([0], np.cumsum(np.diff(s.edge)[own]))).astype(np.int64)
        sampled = weighted_samples(s.keys[pick], weight[pick], edge, bands * rows)
        band = np.zeros((len(own), bands), np.uint64)
        for j in range(bands):
            band[:, j] = textkit.grams(sampled[:, j * rows : (j + 1) * rows].ravel(), rows)[::rows] + np.uint64(j) if len(own) else 0
        band = dict(zip(own, textkit.mix(band).view(np.int64).tolist()))
        ends = [*new[1:], len(ids)]
        return pa.table([
            [key[0].as_py()] * len(new), [digest[i] for i in new], [ids[i:e] for i, e in zip(new, ends)], [band.get(i, []) for i in new],
            [zlib.compress(level[s.edge[i] : s.edge[i + 1]].tobytes(), 1) if i in band else None for i in new], whole[new], [common[i].astype(np.float32) if i in band else None for i in new]], schema=_SIGNED)

    back = packed.answer(dealt.groupBy("grp").applyInArrow(keys, packed.SENT), "level", WIDTH, plan, _frequency)
    signed = checkpointed(dealt.groupBy("grp").cogroup(back.groupBy("grp")).applyInArrow(sign, SIGNED))
    # A text without words, or one that can have no link, is a class of its own; other copies share the least id.
    worded = signed.where(F.size("bands") > 0)
    texts = checkpointed(worded.groupBy("digest").agg(F.min(F.element_at("ids", 1)).alias("u"), F.min("bands").alias("bands"), F.min("whole").alias("whole"), F.min("common").alias("common")))
    member = texts.select("u", F.explode("bands").alias("key"))

    def vector(t: pa.Table, levels: dict[int, bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        s = _Shingles(t["text"], shingle, bits)
        ids = t["id"].to_pylist()
        level = np.frombuffer(b"".join(zlib.decompress(levels[i]) for i in ids), np.uint8)
        w = s.weights(level, total, alpha).astype(np.float32)
        return {i: (s.keys[a:b], w[a:b]) for i, a, b in zip(ids, s.edge[:-1], s.edge[1:])}

    def needed(table, side, kind):
        """Vectors of the ids asked for (column a of the kind), and the asking rows."""
        rows_of = [r for r in side.select(["kind", "a", "b", "vals"]).to_pylist() if r["kind"] == kind]
        want = {r["a"] for r in rows_of}
        if not want:
            return {}, []
        levels = {r["a"]: r["vals"] for r in side.to_pylist() if r["kind"] == "levels" and r["a"] in want}
        t = table.filter(pa.array([i in want for i in table["id"].to_pylist()], pa.bool_()))
        return vector(_distinct(t), levels), rows_of

    @textkit.frugal
    def ship(key, table, side):
        vectors, asks = needed(table, side, "ask")
        blob = {i: textkit.planes(k) + w.tobytes() for i, (k, w) in vectors.items()}
        return pa.table([[r["b"] for r in asks], ["vector"] * len(asks), [r["a"] for r in asks], [len(vectors[r["a"]][0]) for r in asks], [blob[r["a"]] for r in asks]], schema=_SIDE)

    @textkit.frugal
    def compare(key, table, side):
        vectors, pairs = needed(table, side, "pair")
        leads = {}
        for r in side.to_pylist() if pairs else ():
            if r["kind"] == "vector":
                n = r["b"]
                leads[r["a"]] = (textkit.from_planes(r["vals"][: 8 * n], np.uint64), np.frombuffer(r["vals"][8 * n :], np.float32))
        sims = [weighted_jaccard(*vectors[r["a"]], *leads[r["b"]]) for r in pairs]
        return pa.table([[r["a"] for r in pairs], [r["b"] for r in pairs], sims], schema=_LINK)

    levels = worded.select("grp", F.lit("levels").alias("kind"), F.element_at("ids", 1).alias("a"), F.lit(None).cast("long").alias("b"), F.col("levels").alias("vals"))
    nothing = F.lit(None).cast("binary").alias("vals")

    def verify(ask: DataFrame, n: int) -> DataFrame:
        """(u, l, sim) of n pairs: the leaders' vectors go once to each group that asks, wherever a leader is hot."""
        ids = ask.select(F.col("u").alias("a")).unionByName(ask.select(F.col("l").alias("a"))).distinct()
        few = docs
        if 2 * n <= BROADCAST_IDS:
            ids = F.broadcast(ids)
            few = docs.join(F.broadcast(ids.withColumnRenamed("a", id_col)), id_col, "left_semi")
        some = packed.dealt(few, id_col, text_col, plan)
        known = levels.join(ids, "a", "left_semi").select("grp", "kind", "a", "b", "vals")
        gu, gl = packed.group_of(F.col("u"), groups), packed.group_of(F.col("l"), groups)
        asks = ask.select(gl.alias("grp"), F.lit("ask").alias("kind"), F.col("l").alias("a"), gu.cast("long").alias("b")).distinct().withColumn("vals", nothing)
        sent = some.groupBy("grp").cogroup(plan.exchange(known.unionByName(asks), "grp").groupBy("grp")).applyInArrow(ship, SIDE)
        pairs = ask.select(gu.alias("grp"), F.lit("pair").alias("kind"), F.col("u").alias("a"), F.col("l").alias("b"), nothing)
        side = plan.exchange(known.unionByName(pairs).unionByName(sent), "grp")
        return some.groupBy("grp").cogroup(side.groupBy("grp")).applyInArrow(compare, "u long, l long, sim double")

    lead = member.groupBy("key").agg(F.min("u").alias("l"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "l")
    pairs = checkpointed(member.join(lead, "key").where("l < u").select("key", "u", "l"))
    ask = checkpointed(pairs.select("u", "l").distinct())
    n = ask.count()
    out = worded.join(texts.select("digest", "u"), "digest").select("ids", "u")
    if n:
        sims = checkpointed(verify(ask, n))
        links = sims.where(F.col("sim") >= threshold).select("u", "l")
        known = components(links)
        cross = _across(pairs, sims, known, texts.select("u", "whole", "common"), threshold)
        n = cross.count()
        if n:
            new = checkpointed(verify(cross, n).where(F.col("sim") >= threshold).select("u", "l"))
            ends = _with_component(_with_component(new, known, "u", "cu"), known, "l", "cl")
            joined = components(ends.where("cu <> cl").select(F.col("cu").alias("u"), F.col("cl").alias("l")).distinct())
            # A component without links before is a node that `known` does not hold.
            every = known.unionByName(joined.select("node", F.col("node").alias("comp")).join(known.select("node"), "node", "left_anti"))
            known = _with_component(every.withColumnRenamed("comp", "old"), joined, "old", "comp").select("node", "comp")
            links = links.unionByName(new)
        degree = links.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
        named = known.join(degree, "node", "left")
        out = out.join(named, F.col("u") == F.col("node"), "left").select("ids", "u", "comp", "n_links")
    else:
        out = out.withColumns({"comp": F.lit(None).cast("long"), "n_links": F.lit(0).cast("long")})
    out = out.select(F.explode("ids").alias("doc_id"), F.coalesce("comp", "u").alias("class_id"), F.col("u").alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    blank = signed.where(F.size("bands") == 0).select(F.explode("ids").alias("doc_id"))
    return out.unionByName(blank.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links")))
