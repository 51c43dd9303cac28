"""Corpus pipeline: toxicity, near-dedup, decontamination, secret scan and source mixing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before
the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.decontam import without_benchmark
from quarry.llm.mixing import added_name, mix_sources
from quarry.llm.near_dedup import near_dedup
from quarry.llm.queries import TOXIC_AT, TOXIC_GRADE, severity_grades
from quarry.llm.secret_scan import redacted, secret_scan
from quarry.llm.shared import checkpointed, shared_folder
from quarry.llm.toxicity import fit_toxicity, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go; null texts stay."""
    model = fit_toxicity(docs, severity_grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return without_toxic(docs, model, toxic_from=TOXIC_GRADE, threshold=TOXIC_AT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: that of least id, or one without an id where no row has any.

    Rows are compared one by one, whether ids repeat or are null. Texts without a word are classes of
    their own, but rows that repeat both such a text and its id are one class.
    """
    # Written once, since row numbers must be the same wherever they are read.
    rows = checkpointed(docs.withColumn("_row", F.monotonically_increasing_id()))
    same = F.when(F.col("doc_id").isNotNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\t-\r]"), F.struct("doc_id", F.xxhash64("text")))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("h"), "_row")
    classes = near_dedup(rows, "_row").select(F.col("doc_id").alias("_row"), "class_id").join(rows.select("_row", same.alias("same"), order.alias("order")), "_row")
    own = F.when(F.col("same").isNull(), F.col("class_id")).alias("class")
    keep = classes.groupBy(own, "same").agg(F.min("order").alias("least")).select("least._row")
    return rows.join(keep, "_row", "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; found secrets are replaced in its text, and n_chars follows."""
    out = secret_scan(docs)
    text = F.when(F.size("secret_spans") > 0, redacted("text", "secret_spans")).otherwise(F.col("text"))
    n = F.when(F.size("secret_spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("text", text).withColumn("n_chars", n).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often; sources weigh 5, 2, 1, repeating, and share 150% of all words."""
    return mix_sources(docs, weights=(5, 2, 1), share=1.5, most=2.0, keep=True).where(F.col(added_name("copies", docs.columns)) > 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("mixing", mix),
]

#: Weighted sampling and the severity model have no SQL form. No brute-force test covers the whole run yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
