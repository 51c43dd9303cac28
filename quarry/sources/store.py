"""The index as Parquet snapshots: schemas, checks, file-atomic replaces and keyed writes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The stored schema's version, its tables and their keys.
SCHEMA_VERSION = 13
TABLES = {
    "segments": "segment_id string, context_id string, file_path string, language string, block_type string, content string, line_start long, line_end long, breadcrumb string, complexity int, role string, defined_symbols array<string>, referenced_symbols array<string>, called_symbols array<string>, file_hash string",
    "segment_vectors": "segment_id string, embedding array<float>",
    "segment_symbols": "context_id string, segment_id string, symbol string, canonical_symbol string, reference_kind string",
    "segment_relations": "context_id string, source_id string, kind string, raw_target string, canonical_target string, lookup_symbol string, owner string, edge_kind string",
    "indexed_files": "context_id string, file_path string, extension string, file_hash string, file_size long, modified_ns long",
    "meta": "key string, value string",
}
KEYS = {
    "segments": ("segment_id",), "segment_vectors": ("segment_id",), "segment_symbols": ("context_id", "segment_id", "canonical_symbol", "reference_kind"),
    "segment_relations": ("context_id", "source_id", "kind", "canonical_target", "raw_target", "edge_kind"), "indexed_files": ("context_id", "file_path"), "meta": ("key",),
}
FILE = ("context_id", "file_path")


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of `old` that `new` doesn't replace, and one row a key of `new`: the last by `order`."""
    last = new
    if order:
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        last = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", order)
    else:
        last = new.dropDuplicates(list(keys))
    return old.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def deleted(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`old` without the rows whose keys are in `gone`."""
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def validate_replace(segments: DataFrame, batch: DataFrame) -> None:
    """A replace names each file once, and its segments belong to the batch's files."""
    twice = batch.groupBy(*FILE).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"file {twice[0]['file_path']} is twice in a batch")
    stray = segments.join(batch.select(*FILE), list(FILE), "left_anti").limit(1).collect()
    if stray:
        raise ValueError(f"segment of {stray[0]['file_path']}, which is not in the batch")


def check_context(context_id: str) -> str:
    if not context_id or context_id != context_id.strip():
        raise ValueError("a context id is not empty and has no outer blanks")
    return context_id


class Store:
    """An index in one directory. A write makes a new snapshot of the tables it changes and moves the pointer last.

    Readers see the pointer's snapshot only, so a write that fails leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def snapshot(self) -> dict[str, str]:
        """Table name to the folder that holds it now; empty where there is no index."""
        fs, path = self._fs("current")
        if not fs.exists(path):
            return {}
        rows = self.spark.read.json(f"{self.path}/current").collect()
        return {r["table"]: r["folder"] for r in rows}

    def table(self, name: str) -> DataFrame:
        folder = self.snapshot().get(name)
        schema = TABLES[name]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}") if folder else self.spark.createDataFrame([], schema)

    def write(self, **tables: DataFrame) -> None:
        """Write whole tables and make them current together."""
        now = self.snapshot()
        for name, df in tables.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            df.select(*[c.split()[0] for c in TABLES[name].split(", ")]).write.parquet(f"{self.path}/{folder}")
            now[name] = folder
        fs, fresh = self._fs(f"next-{uuid.uuid4().hex}")
        _, current = self._fs("current")
        self.spark.createDataFrame(sorted(now.items()), "table string, folder string").coalesce(1).write.json(fresh.toString())
        fs.delete(current, True)
        if not fs.rename(fresh, current):
            raise OSError("the index pointer could not be moved")

    def replace_files(self, batch: DataFrame, segments: DataFrame, gone: DataFrame | None = None) -> None:
        """Replace the files of `batch` (manifest rows) by `segments`, and drop those of `gone`, all or nothing.

        Symbols and relations follow from the segments. Segments of one file and span keep the last id.
        """
        from ..operators import segments as S
        from ..operators import symbols as Y

        validate_replace(segments, batch)
        # Columns that a segmenter doesn't fill are null.
        segments = self.spark.createDataFrame([], TABLES["segments"]).unionByName(segments, allowMissingColumns=True)
        touched = batch.select(*FILE) if gone is None else batch.select(*FILE).unionByName(gone.select(*FILE))
        old = self.table("segments")
        kept = deleted(old, touched, FILE)
        all_segments = kept.unionByName(segments.dropDuplicates(["segment_id"]), allowMissingColumns=True)
        keep_ids = kept.select("segment_id")
        symbols = self.table("segment_symbols").join(keep_ids, "segment_id", "left_semi").unionByName(Y.occurrences(segments))
        edges = self.table("segment_relations").join(keep_ids.withColumnRenamed("segment_id", "source_id"), "source_id", "left_semi").unionByName(S.relations_of(segments))
        manifest = deleted(self.table("indexed_files"), touched, FILE).unionByName(batch, allowMissingColumns=True)
        vectors = self.table("segment_vectors").join(keep_ids, "segment_id", "left_semi")
        meta = upserted(self.table("meta"), self.spark.createDataFrame([("schema_version", str(SCHEMA_VERSION))], TABLES["meta"]), KEYS["meta"])
        self.write(segments=all_segments, segment_symbols=symbols, segment_relations=edges, indexed_files=manifest, segment_vectors=vectors, meta=meta)

    def get_meta(self, key: str) -> str | None:
        row = self.table("meta").where(F.col("key") == key).limit(1).collect()
        return row[0]["value"] if row else None

    def set_meta(self, key: str, value: str | None) -> None:
        """Set a key; None deletes it."""
        old = self.table("meta")
        new = self.spark.createDataFrame([(key, value or "")], TABLES["meta"])
        self.write(meta=deleted(old, new, ["key"]) if value is None else upserted(old, new, ["key"]))

    def state(self) -> str:
        """ready, missing, unreadable, reindex (older or partial) or upgrade (newer)."""
        now = self.snapshot()
        if not now:
            return "missing"
        version = self.get_meta("schema_version")
        if version is None or not version.isdigit():
            return "unreadable"
        if int(version) != SCHEMA_VERSION:
            return "reindex" if int(version) < SCHEMA_VERSION else "upgrade"
        return "ready" if set(TABLES) <= set(now) else "reindex"

    def accepts_model(self, model: str) -> bool:
        """Whether vectors of this model may be added: none are stored, or they are of the same one."""
        return not self.has_embeddings() or self.get_meta("embedding_model") == model

    def has_embeddings(self, context_id: str | None = None) -> bool:
        v = self.table("segment_vectors").select("segment_id")
        if context_id is not None:
            v = v.join(self.table("segments").where(F.col("context_id") == context_id).select("segment_id"), "segment_id", "left_semi")
        return v.limit(1).count() > 0

    def readiness(self, context_id: str, named_branch: bool = True, indexing: bool = False) -> dict:
        """status ready, degraded, indexing, stale, missing or blocked, with counts of the context."""
        state = self.state()
        status = {"missing": "missing", "unreadable": "blocked", "upgrade": "blocked", "reindex": "stale"}.get(state, "ready")
        counts = {"n_segments": 0, "n_files": 0}
        if state == "ready":
            row = self.table("segments").where(F.col("context_id") == context_id).agg(F.count(F.lit(1)).alias("n_segments"), F.count_distinct("file_path").alias("n_files")).first()
            counts = row.asDict()
            reasons = [] if named_branch else ["branch_not_named"]
            reasons += [] if self.has_embeddings(context_id) else ["vectors_missing"]
            status = "missing" if not counts["n_segments"] else "degraded" if reasons else "ready"
            counts["reasons"] = reasons if status == "degraded" else []
        return {"status": "indexing" if indexing else status, **counts}
