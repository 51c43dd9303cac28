"""Directory scans: which files are read, which are left out, and their text."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import segments as S

#: Extensions of binary files, and directories that are never entered. A tool's own state directories are a parameter.
BINARY = (
    "png jpg jpeg gif bmp ico svg webp tiff tif psd pxd ai sketch fig xcf raw cr2 nef heic heif avif mp3 mp4 avi mov wav flac ogg mkv wmv webm aac m4a "
    "zip tar gz bz2 xz 7z rar zst lz4 zstd exe dll so dylib bin obj o a lib wasm pyc pyo class pdf doc docx xls xlsx ppt pptx ttf otf woff woff2 eot "
    "db sqlite sqlite3 lock parquet arrow pkl pickle npy npz h5 hdf5 dmg iso deb rpm msi apk ipa"
).split()
IGNORED_DIRS = "node_modules .git vendor target build dist out .next .nuxt __pycache__ .venv venv .tox .mypy_cache .pytest_cache .cargo .gradle .idea .vscode coverage".split()
IGNORE_FILES = (".gitignore", ".ignore")
SCANNED = "file_path string, extension string, file_size long, modified_ns long, content binary"


def is_binary(path: Column) -> Column:
    return S.extension(path).isin(*BINARY)


def in_ignored_dir(path: Column, extra: Sequence[str] = ()) -> Column:
    """Whether a directory above the file is one that is never entered, or hidden."""
    above = F.slice(T.path_parts(path), F.lit(1), F.greatest(F.size(T.path_parts(path)) - 1, F.lit(0)))
    return F.arrays_overlap(above, F.array(*[F.lit(d) for d in (*IGNORED_DIRS, *extra)])) | F.exists(above, lambda d: d.startswith("."))


def is_scannable(path: Column) -> Column:
    """Of a known type, neither binary nor hidden."""
    return (S.extension(path) != "") & ~is_binary(path) & ~F.substring_index(path, "/", -1).startswith(".")


def ignore_pattern(rule: str, base: str = "") -> tuple[str, bool] | None:
    """(regular expression over relative paths, whether it ignores) of one line of an ignore file in `base`; none for blanks and comments."""
    line = rule.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    ignores = not line.startswith("!")
    line = line.lstrip("!").lstrip("\\")
    only_dir = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    parts = [".*" if p == "**" else fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z").replace(".*", "[^/]*") for p in line.lstrip("/").split("/")]
    start = re.escape(base.strip("/") + "/") if base.strip("/") else ""
    start += "" if anchored else "(?:.*/)?"
    return f"^{start}{'/'.join(parts)}{'/.+' if only_dir else '(?:/.*)?'}$", ignores


def ignored(path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Whether the last rule (line, directory of its file) that fits a path ignores it.

    Rules of a tree's ignore files are a small parameter of the scan and become one expression.
    """
    out = F.lit(False)
    for line, base in rules:
        found = ignore_pattern(line, base)
        if found:
            out = F.when(path.rlike(found[0]), found[1]).otherwise(out)
    return out


def kept(files: DataFrame, rules: Sequence[tuple[str, str]] = (), extra_dirs: Sequence[str] = ()) -> DataFrame:
    """Rows of file_path that a scan takes."""
    p = F.col("file_path")
    return files.where(is_scannable(p) & ~in_ignored_dir(p, extra_dirs) & ~ignored(p, rules))


def walk(root: str, extra_dirs: Sequence[str] = ()) -> tuple[list[tuple[str, int, int]], list[tuple[str, str]]]:
    """((path, size, modified ns) of every file, (line, directory) of every ignore file), outer rules first.

    Spark's own listing passes over names that begin with an underscore, which source trees have, so
    the tree is listed here: names and sizes only, and never below an ignored directory.
    """
    tree, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    base = base.rstrip("/")
    found, rules, todo = [], [], [base]
    while todo:
        here = todo.pop(0)
        for f in sorted(tree.get_file_info(fs.FileSelector(here)), key=lambda f: f.path):
            rel = f.path[len(base) :].lstrip("/")
            if f.type == fs.FileType.Directory:
                if not f.base_name.startswith(".") and f.base_name not in (*IGNORED_DIRS, *extra_dirs):
                    todo.append(f.path)
            elif f.base_name in IGNORE_FILES:
                with tree.open_input_stream(f.path) as stream:
                    rules += [(line, rel.rpartition("/")[0]) for line in stream.read().decode("utf-8", "replace").splitlines()]
            else:
                found.append((rel, f.size, f.mtime_ns))
    return found, rules


def scan(spark: SparkSession, root: str, paths: DataFrame | None = None, extra_dirs: Sequence[str] = (), contents: bool = True) -> DataFrame:
    """SCANNED rows of a tree that all executors can open, with paths relative to its root; with `paths` (file_path) only of those.

    Metadata is listed by the driver, contents are read by the tasks; without `contents` only the metadata is given.
    """
    found, rules = walk(root, extra_dirs)
    d = kept(spark.createDataFrame(found, "file_path string, file_size long, modified_ns long"), rules, extra_dirs)
    d = d if paths is None else d.join(paths.select("file_path").distinct(), "file_path", "left_semi")
    d = d.select("file_path", S.extension(F.col("file_path")).alias("extension"), "file_size", "modified_ns")
    if not contents:
        return d

    def read(batches):
        tree, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            for k, path in enumerate(batch.column(0).to_pylist()):
                try:
                    with tree.open_input_stream(f"{base.rstrip('/')}/{path}") as stream:
                        body = stream.read()
                except OSError:  # it vanished since the listing
                    body = None
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns), pa.array([body], pa.binary())], names=[*batch.schema.names, "content"])

    return d.mapInArrow(read, SCANNED)


def texts(scanned: DataFrame) -> DataFrame:
    """Scanned rows with `content` as text; what is not UTF-8 is left out."""
    ok = F.expr("is_valid_utf8(cast(content as string))")
    return scanned.where(F.col("content").isNotNull() & ok).withColumn("content", F.col("content").cast("string")).withColumn("file_hash", F.sha2("content", 256))
