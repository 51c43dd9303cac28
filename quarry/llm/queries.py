"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(_table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM p WHERE i + 12 <= len(ws)),
m AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT win.doc_id, i FROM win JOIN m USING (k) WHERE m < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM hit, (SELECT unnest(range(13)) AS j)),
kept AS (SELECT p.doc_id, string_agg(ws[p.i], ' ' ORDER BY p.i) AS t FROM p ANTI JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i GROUP BY p.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op1_substring_dedup": op1_substring_dedup}
SQL = {"op1_substring_dedup": OP1_SQL}


RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page is bad where the label of the same number is toxic or of quality 0 (a stand-in: no table labels pages)."""
    from .url_filter import url_filter

    labels = _table(spark, sf_dir, "labels")
    bad = F.greatest(F.coalesce("toxic", F.lit(0)), 1 - F.coalesce("quality", F.lit(1)))
    return url_filter(_table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), RULES)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    out = mix_sources(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_scan, spans_text

    out = secret_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secret_base", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_text(F.col("secret_base")), 256).alias("base_sha256"), spans_text(F.col("secret_spans")).alias("spans"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM d GROUP BY source),
lv AS (SELECT a.source, (1.5 * (SELECT sum(s) FROM s) - coalesce((SELECT sum(2 * b.s) FROM s b WHERE 2 * b.s / b.w < 2 * a.s / a.w), 0)) / (SELECT sum(b.w) FROM s b WHERE 2 * b.s / b.w >= 2 * a.s / a.w) AS lev, 2 * a.s / a.w AS ratio FROM s a),
pick AS (SELECT arg_min(lev, ratio) AS lev FROM lv WHERE lev <= ratio),
t AS (SELECT source, s, round(CASE WHEN lev IS NULL THEN 2 * s ELSE least(2 * s, lev * w) END, 6) AS target FROM s, pick),
t2 AS (SELECT *, CASE WHEN s > 0 THEN least(2, floor(target / s)) ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
c AS (SELECT g.source, h, sum(size) OVER (PARTITION BY g.source ORDER BY h) AS upto, size FROM g),
k AS (SELECT c.source, h, CASE WHEN upto - size >= target - whole * s THEN 0 WHEN upto < target - whole * s THEN 1
  WHEN upto - (target - whole * s) < (target - whole * s) - (upto - size) THEN 1 ELSE 0 END AS extra FROM c JOIN t2 ON c.source IS NOT DISTINCT FROM t2.source)
SELECT doc_id, size, CAST(t2.s AS BIGINT) AS source_size, target, CAST((whole + CASE WHEN whole < 2 THEN extra ELSE 0 END) * size AS BIGINT) AS taken
FROM d JOIN t2 ON d.source IS NOT DISTINCT FROM t2.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""
OP2_SQL = r"""
WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
b AS (SELECT doc_id AS page_id, max(greatest(coalesce(toxic, 0), 1 - coalesce(quality, 1))) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
x AS (SELECT host, string_split(host, '.') AS l FROM (SELECT DISTINCT host FROM u)),
nm AS (SELECT host, array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three, l[-1] AS one FROM x),
nn AS (SELECT host, CASE WHEN two IN (@SUFFIXES) THEN three ELSE two END AS domain, CASE WHEN two IN (@SUFFIXES) THEN two ELSE one END AS suffix FROM nm),
h AS (SELECT host, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad, CAST(count(bad) AS DOUBLE) AS n FROM u LEFT JOIN b USING (page_id) GROUP BY host),
hd AS (SELECT * FROM h JOIN nn USING (host)),
sx AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM hd GROUP BY suffix),
m0 AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.0) AS m0 FROM sx),
k1 AS (SELECT coalesce(1 / least(greatest((sum((bad - n * m0) ** 2) - sum(n * m0 * (1 - m0))) / nullif(sum(n * (n - 1) * m0 * (1 - m0)), 0), 1 / 1001.0::DOUBLE), 1 / 1.5::DOUBLE) - 1, 8.0) AS k FROM sx, m0),
m1 AS (SELECT suffix, (bad + m0 * k) / (n + k) AS m1 FROM sx, m0, k1),
dx AS (SELECT domain, bad, n, m1 FROM (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM hd GROUP BY domain, suffix) JOIN m1 USING (suffix)),
k2 AS (SELECT coalesce(1 / least(greatest((sum((bad - n * m1) ** 2) - sum(n * m1 * (1 - m1))) / nullif(sum(n * (n - 1) * m1 * (1 - m1)), 0), 1 / 1001.0::DOUBLE), 1 / 1.5::DOUBLE) - 1, 8.0) AS k FROM dx),
m2 AS (SELECT domain, (bad + m1 * k) / (n + k) AS m2 FROM dx, k2),
hx AS (SELECT host, bad, n, m2 FROM hd JOIN m2 USING (domain)),
k3 AS (SELECT coalesce(1 / least(greatest((sum((bad - n * m2) ** 2) - sum(n * m2 * (1 - m2))) / nullif(sum(n * (n - 1) * m2 * (1 - m2)), 0), 1 / 1001.0::DOUBLE), 1 / 1.5::DOUBLE) - 1, 8.0) AS k FROM hx),
ab AS (SELECT host, bad + m2 * k AS a, n - bad + (1 - m2) * k AS b FROM hx, k3),
fr AS (SELECT *, greatest(asin(sqrt(a / (a + b))) - 4 / sqrt(a + b + 1), 0.0) AS lo, least(asin(sqrt(a / (a + b))) + 4 / sqrt(a + b + 1), pi() / 2) AS hi FROM ab),
pt AS (SELECT host, a, b, lo, hi, unnest(range(128)) AS i FROM fr WHERE a > 0 AND b > 0),
ld AS (SELECT host, a, b, i, lo, (hi - lo) / 128 AS step, (2 * a - 1) * ln(sin(lo + (hi - lo) / 128 * (i + 0.5))) + (2 * b - 1) * ln(cos(lo + (hi - lo) / 128 * (i + 0.5))) - ((2 * a - 1) * ln(sin(lo + (hi - lo) / 128 * 64.5)) + (2 * b - 1) * ln(cos(lo + (hi - lo) / 128 * 64.5))) AS g FROM pt),
cu AS (SELECT host, lo, step, exp(g) AS g, sum(exp(g)) OVER (PARTITION BY host ORDER BY i) - exp(g) AS below, 0.05 * sum(exp(g)) OVER (PARTITION BY host) AS goal FROM ld),
qu AS (SELECT host, sin(any_value(lo) + any_value(step) * sum(greatest(0.0, least(1.0, (goal - below) / g)))) ** 2 AS q FROM cu GROUP BY host),
r AS (SELECT ab.host, a / (a + b) AS bad_mean, CASE WHEN a <= 0 THEN 0.0 WHEN b <= 0 THEN 1.0 ELSE q END AS bad_lower FROM ab LEFT JOIN qu ON ab.host = qu.host),
rules(action, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
hit AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action FROM u, rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT u.page_id, u.host, u.path, rule, coalesce(action, CASE WHEN bad_lower > 0.2 THEN 'block' ELSE 'allow' END) AS verdict, round(bad_mean, 9) AS bad_mean, round(bad_lower, 7) AS bad_lower
FROM u JOIN r ON u.host = r.host LEFT JOIN hit ON u.page_id = hit.page_id
"""


def _op2_sql() -> str:
    from .url_filter import TWO_LABEL_SUFFIXES

    return OP2_SQL.replace("@SUFFIXES", ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES))


QUERIES.update(op2_url_filter=op2_url_filter, op5_mix_sources=op5_mix_sources, op10_secret_scan=op10_secret_scan)
SQL.update(op2_url_filter=_op2_sql(), op5_mix_sources=OP5_SQL)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def severity_grades(labels: DataFrame) -> DataFrame:
    """Ordered grades of the labels table: 0 clean and good, 1 of low quality, 2 toxic; null where nothing is said."""
    grade = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when((F.col("toxic") == 0) | (F.col("quality") == 1), 0)
    return labels.select("doc_id", grade.alias("grade"))


#: Grade from which a document counts as toxic, and the probability of it that rejects one.
TOXIC_GRADE, TOXIC_AT = 2, 0.3


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, toxicity

    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, severity_grades(_table(spark, sf_dir, "labels")))
    return toxicity(docs, model, toxic_from=TOXIC_GRADE, threshold=TOXIC_AT)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose crc32(doc_id as text) mod 4 is 2 are held out; a null id hashes as the empty text."""
    from .langid import fit_langid, langid

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    out = langid(docs, fit_langid(docs.where(~held)))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


QUERIES.update(op4_license_scan=op4_license_scan, op6_toxicity=op6_toxicity, op7_language_id=op7_language_id)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP3_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 10
"""
QUERIES.update(op3_nearest=op3_nearest, op9_decontaminate=op9_decontaminate)
SQL.update(op3_nearest=OP3_SQL)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(_table(spark, sf_dir, "documents"))


QUERIES.update(op8_near_dedup=op8_near_dedup)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES.update(pipeline=pipeline)
