"""Secret scan: credential patterns, and a randomness test battery for tokens without a pattern.

Patterns are matched leftmost and non-overlapping; positions are code points and come from the
lengths of what the pattern splits the text into. Long tokens, without what a pattern took of them,
and their parts between / _ - are tested for randomness under the
encoding that their characters allow (hex, base32, base64): a chi-squared test of alphabet
uniformity over the whole alphabet, a runs test about the alphabet's middle, and a lag-1 serial
correlation test, joined by Bonferroni. Ordinary words fail these tests, the more surely the longer
they are, so the threshold is set per encoding and length class: tokens with p above 1/2 tell how
many random ones there are, and the lowest threshold is taken at which the share of others among
the accepted is at most `fdr`. Each distinct token counts once there, however often it is repeated.
Where all of a class's tokens may well be random, as where they are few, the lowest threshold 1/BINS
is taken: too few tokens say nothing about others. All of it is built-in expressions; the histogram
behind the thresholds has a fixed number of cells. What a scan found is written once with its rows,
so that texts are scanned once and not again for the answer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

#: Fixed patterns; group 2 of the first is the value.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
PART = r"(?<![A-Za-z0-9+])[A-Za-z0-9+]{20,}"
KINDS = ("assign", "access", "hex", "random")
_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HEX = "0123456789abcdef"
SPAN = "array<struct<start:int,end:int,kind:int>>"
BINS = 50
#: Standard deviations by which tokens above 1/2 may fall short of half before a class is held to have others (1 %).
SLACK = 2.33


def _found(text: str, pattern: str, value: str | None = None, least: int = 0) -> str:
    """SQL of array<struct<start,end,m>>, a pattern's matches in `text`."""
    lit = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    p = lit(pattern)
    matches = f"regexp_extract_all({text}, {p}, 0)"
    size = f"transform(regexp_extract_all({text}, {p}, 2), v -> char_length(v))" if value else f"transform({matches}, v -> char_length(v))"
    none = "cast(array() as array<struct<start:int,end:int,m:string>>)"
    steps = f"zip_with(zip_with(slice(split({text}, {p}, -1), 1, size({matches})), {matches}, (g, m) -> struct(char_length(g) as gap, m as m)), {size}, (x, n) -> struct(x.gap as gap, x.m as m, n as n))"
    fold = (
        f"aggregate({steps}, struct(0 as pos, {none} as found), "
        f"(a, x) -> struct(a.pos + x.gap + char_length(x.m) as pos, if(x.n >= {least}, concat(a.found, array(struct(a.pos + x.gap as start, a.pos + x.gap + char_length(x.m) as end, x.m as m))), a.found) as found), a -> a.found)"
    )
    return f"if({text} rlike {p}, {fold}, {none})"


def _pieces(d: DataFrame) -> DataFrame:
    """`tokens` with what spans of patterns leave of its runs, each such piece followed by its parts between / _ -."""
    none = "cast(array() as array<struct<start:int,end:int,m:string>>)"
    met = "filter(base, b -> b.start < t.end and t.start < b.end)"
    add = lambda end: f"if({end} - a.pos >= 20, concat(a.out, array(struct(a.pos as start, {end} as end, substring(t.m, a.pos - t.start + 1, {end} - a.pos) as m))), a.out)"
    rest = f"aggregate({met}, struct(t.start as pos, {none} as out), (a, b) -> struct(greatest(a.pos, b.end) as pos, {add('b.start')} as out), a -> {add('t.end')})"
    d = d.withColumn("tokens", F.expr(f"flatten(transform(tokens, t -> {rest}))"))
    parts = f"transform({_found('s.m', PART)}, y -> struct(s.start + y.start as start, s.start + y.end as end, y.m as m))"
    return d.withColumn("tokens", F.expr(f"flatten(transform(tokens, s -> concat(array(s), if(s.m rlike '[/_-]', {parts}, {none}))))"))


def _erfc(t: Column) -> Column:
    """Complementary error function for t >= 0, to 1.5e-7."""
    u = 1 / (1 + t * 0.3275911)
    poly = u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429))))
    return poly * F.exp(-t * t)


def _tested(tokens: Column) -> Column:
    """array<struct<start, end, r: struct<stratum, p, h>>>: the battery's p-value of each token, and its hash.

    Each step is a transform of the step before, so nothing is evaluated twice. One fold over the
    characters (as fractions of the alphabet) gathers the sums of the runs and the serial test, one
    over the sorted characters the squared counts of each, which give chi-squared over the alphabet;
    its p-value takes the cube-root normal form of the distribution.
    """
    plain = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["m"].alias("m"), F.when(t["m"].rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(t["m"].rlike("^[A-Z2-7]+$"), 32).otherwise(64).alias("k"), F.xxhash64(t["m"]).alias("h")))

    def digits(t: Column) -> Column:
        alphabet = F.when(t["k"] == 16, _HEX).when(t["k"] == 32, _B32).otherwise(_B64)
        text = F.when(t["k"] == 16, F.lower(t["m"])).otherwise(F.translate(t["m"], "-_", "+/"))
        x = F.transform(F.split(F.regexp_replace(text, "(.)(?=.)", "$1 "), " "), lambda c: (F.call_function("instr", alphabet, c) - 1).cast("double") / t["k"])
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["k"].alias("k"), t["h"].alias("h"), x.alias("x"))

    zero = F.struct(F.lit(None).cast("double").alias("p"), F.lit(-1.0).alias("first"), *[F.lit(0.0).alias(c) for c in ("s1", "s2", "s11", "runs", "high")])

    def step(a: Column, v: Column) -> Column:
        one = lambda c: F.when(c, 1.0).otherwise(0.0)
        fresh = a["p"].isNull()
        return F.struct(
            v.alias("p"), F.when(fresh, v).otherwise(a["first"]).alias("first"), (a["s1"] + v).alias("s1"), (a["s2"] + v * v).alias("s2"), (a["s11"] + F.coalesce(a["p"] * v, F.lit(0.0))).alias("s11"),
            (a["runs"] + one(fresh | ((a["p"] >= 0.5) != (v >= 0.5)))).alias("runs"), (a["high"] + one(v >= 0.5)).alias("high"))

    # A character seen r times before raises the sum of squared counts by 2 r + 1.
    alone = F.struct(F.lit(-1.0).alias("c"), F.lit(0.0).alias("r"), F.lit(0.0).alias("square"))

    def count(a: Column, v: Column) -> Column:
        r = F.when(v == a["c"], a["r"] + 1).otherwise(0.0)
        return F.struct(v.alias("c"), r.alias("r"), (a["square"] + r * 2 + 1).alias("square"))

    sums = lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["k"].alias("k"), t["h"].alias("h"), F.size(t["x"]).cast("double").alias("n"), F.aggregate(t["x"], zero, step).alias("a"), F.aggregate(F.array_sort(t["x"]), alone, count, lambda a: a["square"]).alias("counts"))

    def derived(t: Column) -> Column:
        n, a = t["n"], t["a"]
        mean = a["s1"] / n
        chi = t["counts"] * t["k"] / n - n
        square = a["s2"] - n * mean * mean
        cross = a["s11"] - mean * (a["s1"] * 2 - a["first"] - a["p"]) + (n - 1) * mean * mean
        mu = a["high"] * (n - a["high"]) * 2 / n + 1
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["k"].alias("k"), t["h"].alias("h"), n.alias("n"), chi.alias("chi"), square.alias("square"), cross.alias("cross"), mu.alias("mu"), a["runs"].alias("runs"), a["high"].alias("high"))

    def judged(t: Column) -> Column:
        n, mu = t["n"], t["mu"]
        free = t["k"] - 1
        z = (F.cbrt(t["chi"] / free) - 1 + F.lit(2 / 9) / free) / F.sqrt(F.lit(4 / 9) / free)
        p_chi = F.when(z >= 0, _erfc(z) / 2).otherwise(1 - _erfc(-z) / 2)
        flat = (t["high"] < 2) | (n - t["high"] < 2)
        p_runs = F.when(flat, 0.0).otherwise(_erfc(F.abs(t["runs"] - mu) / F.sqrt(F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(1e-9)) * 2)))
        p_serial = F.when(t["square"] <= 1e-12, 0.0).otherwise(_erfc(F.abs(t["cross"] / t["square"] * F.sqrt(n) + 1 / F.sqrt(n)) / math.sqrt(2)))
        p = F.least(F.lit(1.0), F.least(p_chi, p_runs, p_serial) * 3)
        stratum = t["k"] * 100 + F.least(F.lit(99), F.floor(F.log2(n) * 2)).cast("int")
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), F.struct(stratum.cast("int").alias("stratum"), p.alias("p"), t["h"].alias("h")).alias("r"))

    return F.transform(F.transform(F.transform(F.transform(plain, digits), sums), derived), judged)


def scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, base, tokens): the input's row as a struct, spans of patterns, and other long tokens with their p-values."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    low = F.lower("text")
    keyed = low.contains("pass") | low.contains("secret") | low.contains("token") | low.contains("api")
    none = F.expr("cast(array() as array<struct<start:int,end:int,m:string>>)")
    d = d.withColumn("assign", F.when(keyed, F.expr(_found("text", ASSIGN, value="2", least=12))).otherwise(none))
    d = d.withColumn("access", F.when(F.col("text").contains("AKIA"), F.expr(_found("text", ACCESS))).otherwise(none))
    d = d.withColumn("hex", F.expr(_found("text", HEX))).withColumn("tokens", F.expr(_found("text", TOKEN)))
    tag = lambda c, k: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind")))
    d = d.withColumn("base", F.array_sort(F.concat(tag("assign", 0), tag("access", 1), tag("hex", 2))).cast("array<struct<start:int,end:int,kind:int>>"))
    d = _pieces(d.select("row", "base", "tokens"))
    return d.select("row", "base", _tested(F.col("tokens")).alias("tokens"))


def thresholds(d: DataFrame, fdr: float) -> DataFrame:
    """One row: a map from stratum to the p-value from which a token counts as random."""
    t = d.select(F.explode("tokens.r").alias("r")).select("r.stratum", "r.h", F.least(F.lit(BINS - 1), F.floor(F.col("r.p") * BINS)).cast("int").alias("bin"))
    h = t.where("bin > 0").distinct().groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = h.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0)).alias("top"))
    grid = grid.select("stratum", "m", "top", F.explode(F.sequence(F.lit(1), F.lit(BINS - 1))).alias("j"))
    taken = F.aggregate(F.sequence("j", F.lit(BINS - 1)), F.lit(0).cast("long"), lambda a, b: a + F.coalesce(F.col("m")[b], F.lit(0)).cast("long"))
    grid = grid.withColumn("taken", taken)
    others = F.col("taken") - F.col("top") * 2 * (1 - F.col("j") / BINS)
    half = F.lit(BINS / 2) / (BINS - F.col("j"))  # share of p above 1/2 if all that is taken is random
    short = F.col("taken") * half - F.col("top") - 0.5
    plain = (F.col("j") == 1) & (short <= F.sqrt(F.col("taken") * half * (1 - half)) * SLACK)
    ok = grid.where((F.col("taken") > 0) & ((others <= F.col("taken") * fdr) | plain)).groupBy("stratum").agg((F.min("j") / BINS).alias("least"))
    return ok.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "least"))).alias("least"))


def secret_scan(docs: DataFrame, text_col: str = "text", fdr: float = 0.1) -> DataFrame:
    """All columns of `docs` with secret_base and secret_spans, arrays of (start, end, kind number).

    Kinds are numbered as in KINDS; spans are in code points, end exclusive, by start and then kind.
    A null text counts as empty. Repeated rows are scanned each; an empty table gives an empty
    result. A column of the input called secret_base or secret_spans is replaced; every other name
    is kept as it is. Of tokens with equal p all or none are taken.
    """
    keep = [f"`{c}`" for c in docs.columns if c.lower() not in ("secret_base", "secret_spans")]
    d = checkpointed(scanned(docs.select(*keep), text_col))
    d = d.join(F.broadcast(thresholds(d.select("tokens"), fdr)))  # one row of bounded width
    # A part lies behind its piece in tokens and goes where the whole piece is taken.
    rare = F.expr(f"aggregate(filter(tokens, t -> t.r.p >= least[t.r.stratum]), struct(-1 as upto, cast(array() as {SPAN}) as out), (a, t) -> if(t.end <= a.upto, a, struct(t.end as upto, concat(a.out, array(struct(t.start as start, t.end as end, 3 as kind))) as out)), a -> a.out)")
    spans = F.array_sort(F.concat(F.col("base"), rare.cast(SPAN)))
    return d.select("row.*", F.col("base").alias("secret_base"), spans.alias("secret_spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """Column `text` with each span replaced by the mark; overlapping spans are replaced as one."""
    return F.expr(
        f"aggregate({spans}, struct(0 as pos, '' as out), (a, s) -> struct(greatest(a.pos, s.end) as pos, "
        f"if(s.start >= a.pos, concat(a.out, substring({text}, a.pos + 1, s.start - a.pos), '{mark}'), a.out) as out), "
        f"a -> concat(a.out, substring({text}, a.pos + 1)))"
    )
