"""From a stream of file changes to runs: classify, filter, coalesce, route, and one follow-up run at most.

All steps are DataFrame functions, so a batch of events and a stream give the same rows. Events are
(ts, context-free) path, is_file, is_dir, is_error; a vanished path is neither file nor directory.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import segments as S

EVENT = "ts timestamp, path string, is_dir boolean, is_error boolean"
#: Directories and extensions whose changes are passed over, fewer than a scan leaves out.
SKIP_DIRS = "node_modules .git target vendor build dist __pycache__".split()
SKIP_EXTENSIONS = "png jpg jpeg gif zip tar gz exe dll so dylib bin wasm pyc db sqlite lock".split()
GAP = "500 milliseconds"
HEARTBEAT_SECONDS = 30


def read_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The change stream: JSON lines of EVENT that a watcher drops into a folder."""
    return spark.readStream.schema(EVENT).json(folder)


def kind(path: Column, is_dir: Column, is_error: Column) -> Column:
    """file, ambiguous (a directory) or error (no path, or the watcher failed)."""
    return F.when(F.coalesce(is_error, F.lit(False)) | path.isNull(), "error").when(F.coalesce(is_dir, F.lit(False)), "ambiguous").otherwise("file")


def skipped(path: Column) -> Column:
    return F.arrays_overlap(T.path_parts(path), F.array(*[F.lit(d) for d in SKIP_DIRS])) | S.extension(path).isin(*SKIP_EXTENSIONS)


def relevant(events: DataFrame) -> DataFrame:
    """Events with their kind, without skipped paths; errors always stay."""
    e = events.withColumn("kind", kind(F.col("path"), F.col("is_dir"), F.col("is_error")))
    return e.where((F.col("kind") == "error") | ~F.coalesce(skipped(F.col("path")), F.lit(False)))


def routed(events: DataFrame, roots: DataFrame) -> DataFrame:
    """Events by context: those below a context's root (context_id, root), and errors to every context.

    Registered projects are few and are broadcast; the join tests each event against each root.
    """
    r = F.broadcast(roots.select("context_id", F.regexp_replace("root", "/+$", "").alias("root")))
    inside = (F.col("kind") == "error") | (F.col("path") == F.col("root")) | F.col("path").startswith(F.concat(F.col("root"), F.lit("/")))
    rel = F.when(F.col("kind") == "file", F.expr("substring(path, char_length(root) + 2)"))
    return events.join(r, inside).select("ts", "context_id", "kind", rel.alias("file_path"))


def bursts(events: DataFrame, gap: str = GAP) -> DataFrame:
    """(context_id, started, is_full, reason, paths): changes with no silence of `gap` between them are one burst.

    A directory or an error promotes the burst to a full run and says why.
    """
    g = events.groupBy("context_id", F.session_window("ts", gap).alias("w"))
    failed, vague = F.bool_or(F.col("kind") == "error"), F.bool_or(F.col("kind") == "ambiguous")
    b = g.agg((failed | vague).alias("is_full"), F.when(failed, "has_unscoped_error").when(vague, "ambiguous_paths").alias("reason"), F.array_sort(F.collect_set("file_path")).alias("paths"))
    return b.select("context_id", F.col("w.start").alias("started"), "is_full", "reason", F.when(F.col("is_full"), F.array().cast("array<string>")).otherwise(F.col("paths")).alias("paths"))


def merged(scopes: DataFrame) -> DataFrame:
    """One scope a context: full absorbs paths, else the union of paths; the last reason stays."""
    paths = F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths"))))
    m = scopes.groupBy("context_id").agg(F.bool_or("is_full").alias("is_full"), F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("started"))).alias("reason"), paths.alias("paths"))
    return m.withColumn("paths", F.when(F.col("is_full"), F.array().cast("array<string>")).otherwise(F.col("paths")))


@dataclass
class Pending:
    """What waits to be run for one context; None paths stand for a full run."""

    paths: set[str] | None = field(default_factory=set)
    dirty: bool = False
    running: bool = False
    reason: str | None = None

    def mark(self, is_full: bool, paths: list[str], reason: str | None = None) -> None:
        if is_full or self.paths is None:
            self.paths = None
        else:
            self.paths |= set(paths)
        self.dirty, self.reason = True, reason or self.reason

    def start(self) -> tuple[set[str] | None, str | None]:
        scope = self.paths, self.reason
        self.paths, self.reason, self.dirty, self.running = set(), None, False, True
        return scope


class Scheduler:
    """Runs contexts until none is dirty: the one that just ran first if it changed meanwhile, else the least id."""

    def __init__(self, run: Callable[[str, set[str] | None, str | None], None]):
        self.run, self.contexts, self.last_beat = run, {}, None

    def mark(self, context_id: str, is_full: bool, paths: list[str], reason: str | None = None) -> None:
        if is_full or paths:
            self.contexts.setdefault(context_id, Pending()).mark(is_full, paths, reason)

    def next_key(self, preferred: str | None = None) -> str | None:
        ready = [k for k, p in self.contexts.items() if p.dirty and not p.running]
        return preferred if preferred in ready else min(ready, default=None)

    def until_clean(self, arrived: Callable[[], None] = lambda: None) -> int:
        """Number of runs made; `arrived` marks what came in during a run. A failed run is not repeated by itself."""
        runs, preferred = 0, None
        while (key := self.next_key(preferred)) is not None:
            state = self.contexts[key]
            scope, reason = state.start()
            try:
                self.run(key, scope, reason)
            finally:
                state.running = False
            runs += 1
            arrived()
            preferred = key if state.dirty else None
        return runs

    def renamed(self, old: str, new: str) -> None:
        """A branch change moves a context to a new id, which needs a full run."""
        state = self.contexts.pop(old, Pending())
        state.mark(True, [])
        if new in self.contexts:
            self.contexts[new].mark(True, [], state.reason)
        else:
            self.contexts[new] = state

    def beat(self, now: float, force: bool = False) -> bool:
        """Whether a heartbeat is due: forced, the first, or half a minute after the last."""
        due = force or self.last_beat is None or now - self.last_beat >= HEARTBEAT_SECONDS
        self.last_beat = now if due else self.last_beat
        return due


def refresh(events: DataFrame, roots: DataFrame, scheduler: Scheduler, checkpoint: str, **trigger):
    """Start the stream: each micro-batch is coalesced, routed and run until clean. Batches are bursts of changes, so their scopes are small."""

    def batch(df: DataFrame, _: int) -> None:
        for r in merged(bursts(routed(relevant(df), roots))).collect():
            scheduler.mark(r["context_id"], r["is_full"], r["paths"], r["reason"])
        scheduler.until_clean()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()
