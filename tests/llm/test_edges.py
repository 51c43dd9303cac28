"""Every operator on nulls, empty and very long texts, ties, repeats, empty tables and clashing column names."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import ann, decontam, langid, licenses, mixing, near_dedup, queries, secret_scan, substring_dedup, toxicity, url_filter

# Names that operators use inside, beside the real ones.
COLUMNS = "doc_id long, text string, lang string, source string, row string, base string, tokens string, h long, size long, copies long, grp int, class_id long"
LONG = "spam " * 200_000


def table(spark, texts, ids=None):
    ids = ids or list(range(1, len(texts) + 1))
    return spark.createDataFrame([(i, t, "xx", "src0", "r", "b", "t", 1, 2, 3, 4, 5) for i, t in zip(ids, texts)], COLUMNS)


TEXTS = [None, "", " \t\n", LONG, "one two three", "one two three", "naïve — ünïcödé 😀 " * 3]
IDS = [1, 2, 3, 4, 5, 5, None]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, TEXTS, IDS).cache()


def test_substring_dedup(odd):
    got = substring_dedup.substring_dedup(odd).collect()
    n = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in got}
    assert len(got) == 7 and n[1, 0] == n[2, 0] == n[3, 0] == 0 and n[4, 200_000] == 0 and n[5, 3] == 0 and n[None, 12] == 0


def test_near_dedup(odd):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(odd).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}


def test_decontaminate(spark, odd):
    bench = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (4, "spam " * 300), (None, "x"), (5, "two thr"), (6, "ham" * 200)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.decontaminate(odd, bench).collect())
    assert got == [(4, 4), (5, 1), (5, 1)]  # repeated documents are searched each; no match inside a word
    assert decontam.decontaminate(odd, bench.limit(0)).count() == 0 and decontam.without_benchmark(odd.limit(0), bench).count() == 0
    assert decontam.without_benchmark(odd, bench).columns == odd.columns


def edits_within(item, text):
    """Least edits of the item against any part of the text."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = np.array(new)
    return row.min()


def test_decontamination_index_equals_alignment():
    r = random.Random(8)
    for _ in range(120):
        alphabet = r.choice(["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz   "])
        item = "".join(r.choice(alphabet) for _ in range(r.randrange(20, 120))) if r.random() < 0.7 else (r.choice(["ab", "a", "xyz "]) * 120)[: r.randrange(20, 120)]
        item = " ".join(item.split())
        text = list(item)
        for _ in range(r.randrange(9)):
            k = r.randrange(len(text) + 1)
            text[k : k + r.randrange(2)] = r.choice(["", r.choice(alphabet)])
        text = "".join(r.choice(alphabet) for _ in range(30)) + "".join(text) + "tail"
        body = np.frombuffer(text.encode(), np.uint8)
        x, offsets = decontam.normalise(body, np.array([0, len(body)]))
        m = len(item)
        if m >= decontam.Q:
            found = decontam.Index([1], [item.encode()], 0.05).search(x, offsets)
            assert bool(found) == (edits_within(item, x.tobytes().decode()) <= decontam.edit_budget(m, 0.05))


def test_license_base_columns_equal_brute_force(spark, odd):
    r = random.Random(2)
    pieces = ["under", "the", "MIT", "license", "apache", "version", "2", "cc", "by", "nc", "under the mit license", "Apache-License, Version 2", "cc by nc", "é", "-", ".", "\x00"]
    texts = [None, "", *(" ".join(r.choice(pieces) for _ in range(r.randrange(40))) for _ in range(150))]
    got = licenses.license_scan(table(spark, texts)).orderBy("doc_id").collect()
    for row, text in zip(got, texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1
    assert licenses.license_scan(odd).count() == 7


def fill(template, r):
    """A text that a template accepts: regions taken or left, blanks filled."""
    out = []
    for part in re.findall(r"\[[^\]]*\]|\{\d+\}|[^\s\[\]{}]+", template):
        if part[0] == "[":
            out += part[1:-1].split() if r.random() < 0.5 else []
        elif part[0] == "{":
            out += ["filler"] * r.randrange(1, int(part[1:-1]) + 1)
        else:
            out.append(part)
    return out


def test_license_templates_accept_whole_wordings_only(spark):
    r = random.Random(4)
    texts, want, altered = [], [], []
    for label, templates in licenses.TEMPLATES.items():
        words = fill(templates[0], r)
        texts.append("Note. " + ", ".join(words) + ". End")
        want.append(label)
        words[max(1, len(words) - 9)] = "changed"
        altered.append(" ".join(words))
    got = licenses.license_scan(table(spark, texts + altered)).orderBy("doc_id").collect()
    for k, label in enumerate(want):
        assert label in got[k]["labels"].split(",") and got[k]["score"] == 1
    cut = dict(zip(want, got[len(want) :]))
    assert cut["mit-text"]["labels"] == "" and 0.9 < cut["mit-text"]["score"] < 1 and cut["bsd-3-clause"]["labels"] == ""


def test_mixing_keeps_clashing_columns(spark, odd):
    out = mixing.mix_sources(odd, (5, 2, 1), keep=True)
    assert out.columns == [*odd.columns, "mix_size", "source_size", "target", "mix_copies", "taken"] and out.count() == 7
    assert {r["h"] for r in out.collect()} == {1} and {r["size"] for r in out.collect()} == {2}
    assert corpus_pipeline.mix(spark, odd, "").where("mix_copies = 0").count() == 0


def test_water_fill_equals_rounds(spark):
    r = random.Random(6)
    sizes = {f"s{k:02}": r.choice([0, 1, 10, 1000, 50_000]) * r.randrange(1, 9) for k in range(30)} | {None: 77}
    got = {x["source"]: x["target"] for x in mixing.water_fill(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 1.5, 2.0).collect()}
    names = sorted(k for k in sizes if k) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
        left -= sum(want[s] for s in over)
        free -= over
    want |= {s: level * weight[s] for s in free}
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-5) for s in names)


def test_secret_scan(spark, odd):
    got = secret_scan.secret_scan(odd)
    assert got.columns == [*odd.columns, "secret_base", "secret_spans"] and all(not r["secret_spans"] for r in got.collect())
    token = "password=" + "a" * 300_000
    twice = secret_scan.secret_scan(table(spark, [token, token])).collect()
    assert [[tuple(s) for s in r["secret_base"]] for r in twice] == [[(0, len(token), 0), (9, len(token), 2)]] * 2
    assert secret_scan.secret_scan(odd.limit(0)).count() == 0


def test_secret_battery_at_size(spark):
    r = random.Random(11)
    tokens = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(44)) for _ in range(200)]
    words = ["".join(r.choice(["tion", "ment", "ing", "ed", "re", "con", "ness", "able"]) for _ in range(9)) for _ in range(60)]
    found = [bool(x["secret_spans"]) for x in secret_scan.secret_scan(table(spark, [f"see {t} here" for t in tokens + words])).orderBy("doc_id").collect()]
    assert sum(found[:200]) >= 190 and sum(found[200:]) <= 2


def test_toxicity_grades(spark):
    r = random.Random(5)
    plain = [f"word{k}" for k in range(300)]
    rows, grades = [], []
    for k in range(900):
        g = k % 3
        rows.append(" ".join(r.sample(plain, 30) + ["meh"] * (g > 0) + ["awful", "vile"] * (g > 1)))
        grades.append((k + 1, g))
    docs, truth = table(spark, rows), spark.createDataFrame([*grades, (None, 1), (7, None)], "doc_id long, grade int")
    model = toxicity.fit_toxicity(docs, truth)
    assert len(model.cuts) == 2 and list(model.cuts) == sorted(model.cuts)
    got = toxicity.toxicity(docs, model, toxic_from=2).join(truth.withColumnRenamed("grade", "truth").where("truth IS NOT NULL AND doc_id IS NOT NULL"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) > 100 and sum(x["grade"] == x["truth"] for x in got) > 0.95 * len(got)
    odd = table(spark, TEXTS, IDS)
    assert not any(x["toxic"] for x in toxicity.toxicity(odd, model, 2).collect()) and toxicity.without_toxic(odd, model, 2).count() == 7
    assert toxicity.without_toxic(docs, model, 2).count() == pytest.approx(600, abs=20)
    none = toxicity.fit_toxicity(docs.limit(0), truth)
    assert not any(x["toxic"] for x in toxicity.toxicity(docs.limit(9), none, 2).collect())
    g = {tuple(x) for x in queries.severity_grades(spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1), (4, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")).collect()}
    assert g == {(1, 0), (2, 1), (3, 2), (4, None), (5, 2)}


def test_language_id(spark, odd):
    r = random.Random(9)
    speech = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["xyzzy", "qwert", "zxcv"]}
    rows = [(k, " ".join(r.choices(speech[lang], k=12)), lang) for k in range(200) for lang in (("aa", "bb")[k % 2],)]
    docs = spark.createDataFrame(rows + [(None, "lorem", "aa"), (3, None, "aa"), (4, "lorem", None)], "doc_id long, text string, lang string")
    held = F.coalesce(F.col("doc_id"), F.lit(0)) % 4 == 2
    model = langid.fit_langid(docs.where(~held))
    got = langid.langid(docs, model).join(spark.createDataFrame(rows, "doc_id long, text string, truth string").drop("text"), "doc_id").collect()
    assert all(x["lang_pred"] == x["truth"] for x in got if x["score"] > 0) and model.labels == ["aa", "bb"]
    # The prediction reads nothing but the text.
    swapped = langid.langid(docs.withColumn("lang", F.lit("bb")).withColumn("doc_id", F.col("doc_id") + 1), model).select("lang_pred").where("lang_pred = 'aa'").count()
    assert swapped == langid.langid(docs, model).where("lang_pred = 'aa'").count()
    out = {(x["doc_id"], x["lang_pred"]) for x in langid.langid(odd, model).where("score = 0").collect()}
    assert out == {(1, "und"), (2, "und"), (3, "und")}
    empty = langid.fit_langid(docs.limit(0))
    assert {x["lang_pred"] for x in langid.langid(docs, empty).collect()} == {"und"} and langid.langid(odd.limit(0), model).count() == 0


def test_url_filter(spark):
    rows = [(k, f"http://bad.example.com/p/{k}") for k in range(60)] + [(100 + k, f"https://good.site.org/x?{k}") for k in range(60)] + [(None, "http://Bad.Example.com/q"), (7, None), (8, "no scheme"), (9, "http://a.b.org/es/x"), (9, "http://a.b.org/es/x"), (10, "http://notexample.com/en/x")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(k, 1) for k in range(60)] + [(100 + k, 0) for k in range(60)] + [(None, 1), (3, None), (3, 0)], "page_id long, bad int")
    got = url_filter.url_filter(pages, outcomes, queries.RULES).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r["host"], r["rule"]), set()).add(r["verdict"])
    assert by["bad.example.com", None] == {"block"} and by["good.site.org", None] == {"allow"}
    assert by["a.b.org", "org/es/"] == {"block"} and by["notexample.com", "com/en/"] == {"block"} and ("", None) in by
    assert url_filter.url_filter(pages.limit(0), outcomes, queries.RULES).count() == 0
    assert {r["verdict"] for r in url_filter.url_filter(pages, outcomes.limit(0)).collect()} == {"allow"}


def test_beta_quantile(spark):
    rng = np.random.default_rng(3)
    pairs = [(2.0, 5.0), (30.0, 70.0), (500.0, 20.0), (1.0, 1.0), (5000.0, 5000.0), (0.0, 3.0), (3.0, 0.0)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a double, b double").coalesce(1).select(url_filter.beta_quantile(F.col("a"), F.col("b"), 0.05)).collect()]
    for (a, b), q in zip(pairs[:5], got):
        assert abs(q - np.quantile(rng.beta(a, b, 400_000), 0.05)) < 0.003
    assert got[5:] == [0.0, 1.0]


def test_nearest_recall_repeats_and_empty(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 32))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1, x[0].tolist()), (1, x[5].tolist()), (None, x[0].tolist()), (9000, [1.0]), (9001, None)]
    v = spark.createDataFrame([(*r, "q") for r in rows], "vec_id long, embedding array<double>, id string")
    got = ann.nearest(v, v.where("vec_id % 100 = 0"), k=10).collect()
    every = [(i, np.array(e)) for i, e in rows if i is not None and e is not None and len(e) == 32]
    hit = total = 0
    for q in range(0, 3000, 100):
        d = sorted((float(np.sqrt(((e - x[q]) ** 2).sum())), i) for i, e in every if i != q)[:10]
        mine = [(r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert len(mine) == 10
        hit += len({i for _, i in d} & {i for _, i in mine})
        total += len({i for _, i in d})
    assert hit >= 0.99 * total
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 0 and r["rank"] == 1] == [(1, 0.0)]  # a repeated id counts by each of its rows
    assert ann.nearest(v.limit(0), v.limit(0)).count() == 0


def test_weighted_samples_agree_as_weighted_jaccard():
    """(shingle, t) agree with the probability of weighted Jaccard; the shingle alone agrees more often."""
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
    wa, wb = np.full(400, 1.0), np.full(400, 4.0)
    s = near_dedup.weighted_samples(np.concatenate((keys, keys)), np.concatenate((wa, wb)), np.array([0, 400, 800]), 2000)
    assert abs((s[0] == s[1]).mean() - 0.25) < 0.04


def test_pipeline_stages(spark, tmp_path):
    """Each stage on a small table against what it must keep."""
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(900)]
    text = lambda: " ".join(r.choices(vocabulary, k=60))
    item = text()
    texts = [text() for _ in range(120)]
    toxic = [f"{text()} vile awful" for _ in range(40)]
    rows = [(k, t, "xx", f"src{k % 3}", len(t)) for k, t in enumerate(texts + toxic)]
    rows += [(500, texts[0], "xx", "src0", 1), (501, texts[1] + " more", "xx", "src1", 1), (502, f"{text()} {item} {text()}", "xx", "src2", 1), (503, "password = hunter2hunter2 end", "xx", "src0", 1), (504, None, "xx", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k >= 120)) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({x["doc_id"] for x in docs.collect()})
    ids = {x[0] for x in rows}
    assert kept[0] == ids - set(range(120, 160))
    assert kept[1] == kept[0] - {500, 501} and kept[2] == kept[1] - {502} and kept[3] == kept[2]
    redacted = spark.read.parquet(f"{tmp_path}/secret_scan").where("doc_id = 503").first()
    assert redacted["text"] == "[SECRET] end" and redacted["n_chars"] == 12
    assert kept[4] <= kept[3] and docs.where("taken <> copies * size OR copies < 1").count() == 0
