"""Incremental maintenance: what to skip, index and delete, and the file-atomic replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import segments as S

KEY = ["context_id", "file_path"]


def metadata_changed(scan: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose size or time differs from the manifest, or that it lacks."""
    same = [*KEY, "file_size", "modified_ns"]
    return scan.join(manifest.select(*same), same, "left_anti")


def hash_changed(scan: DataFrame, manifest: DataFrame) -> DataFrame:
    return scan.join(manifest.select(*KEY, "file_hash"), [*KEY, "file_hash"], "left_anti")


def stored_hashes(manifest: DataFrame, segments: DataFrame) -> DataFrame:
    """(context_id, file_path, file_hash): the manifest's hash, or the greatest of the segments' where it lacks the file."""
    m = manifest.select(*KEY, F.col("file_hash").alias("own"))
    s = segments.groupBy(*KEY).agg(F.max("file_hash").alias("held"))
    return m.join(s, KEY, "full_outer").select(*KEY, F.coalesce("own", "held").alias("file_hash"))


def known_files(manifest: DataFrame, segments: DataFrame) -> DataFrame:
    return manifest.select(*KEY).unionByName(segments.select(*KEY)).distinct()


def deleted(known: DataFrame, scan: DataFrame) -> DataFrame:
    return known.select(*KEY).distinct().join(scan.select(*KEY), KEY, "left_anti")


def work(scan: DataFrame, manifest: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to parse, files to delete) of a full run: changed metadata first, then changed content."""
    return hash_changed(metadata_changed(scan, manifest), stored_hashes(manifest, segments)), deleted(known_files(manifest, segments), scan)


def scoped_work(scan: DataFrame, manifest: DataFrame, segments: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for given paths (context_id, file_path) only; a vanished path is deleted where something of it is stored."""
    own = paths.select(*KEY).distinct()
    part = lambda df: df.join(own, KEY, "left_semi")
    return work(part(scan), part(manifest), part(segments))


def fallback_reason(path: Column, exists: Column, is_dir: Column, scanned: Column, scannable: Column, stored: Column) -> Column:
    """Why a scoped run on a path must become a full one; null where it need not."""
    name = F.substring_index(path, "/", -1)
    rules = name.isin(".gitignore", ".ignore") | (path == ".git/info/exclude")
    plain = (F.regexp_extract(name, r"[^/]\.([^./]+)$", 1) == "") & ~F.lower(name).isin(*S.NAMED)
    return (
        F.when(rules, "changes ignore semantics")
        .when(exists & is_dir, "resolved to a directory")
        .when(exists & ~scanned & scannable, "is excluded by full-scan ignore semantics")
        .when(exists & ~scanned & stored, "no longer matches scanner filters")
        .when(~exists & ~stored & plain, "disappeared without indexed content")
    )


def replaced(old: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """Segments after a run: those of untouched files, and the new ones; whole files only.

    A file that was parsed into nothing is in neither `new` nor `gone`, so what it had stays.
    """
    touched = new.select(*KEY).unionByName(gone.select(*KEY)).distinct()
    return old.join(touched, KEY, "left_anti").unionByName(new)
