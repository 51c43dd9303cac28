"""Symbol lookup: exact, prefix, containment and fuzzy; definitions and references."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def exact(symbols: DataFrame, segments: DataFrame, canonical: str, kind: str | None = "definition") -> DataFrame:
    """Segments that hold the name as one kind; as either, one row each, where `kind` is None."""
    s = symbols.where(F.col("canonical_symbol") == canonical)
    s = (s if kind is None else s.where(F.col("reference_kind") == kind)).select("segment_id", "symbol")
    return segments.select("segment_id", "file_path", "line_start").join(s, "segment_id")


def prefix(symbols: DataFrame, start: str, limit: int = 32) -> DataFrame:
    c = symbols.where(F.col("canonical_symbol").startswith(start)).select("canonical_symbol").distinct()
    return c.orderBy(F.char_length("canonical_symbol"), "canonical_symbol").limit(limit)


def containing(symbols: DataFrame, part: str, limit: int = 32) -> DataFrame:
    c = symbols.where(F.col("canonical_symbol").contains(part)).select("canonical_symbol").distinct()
    return c.orderBy(F.when(F.col("canonical_symbol").startswith(part), 0).otherwise(1), F.abs(F.char_length("canonical_symbol") - len(part)), F.char_length("canonical_symbol"), "canonical_symbol").limit(limit)


def fuzzy(symbols: DataFrame, wanted: str) -> DataFrame:
    """Exact matches if any; else containment, reverse containment of half the length, or a small edit distance (lengths in bytes)."""
    n = len(wanted.encode())
    c = F.col("canonical_symbol")
    m = symbols.select("canonical_symbol").distinct().withColumn("exact", c == wanted)
    far = 1 if n <= 4 else 2
    # Names whose length differs by more than that need no distance; this is asked of every occurrence.
    close = (F.abs(F.char_length(c) - len(wanted)) <= far) & (F.levenshtein(c, F.lit(wanted)) <= far)
    near = c.contains(wanted) | (F.lit(wanted).contains(c) & (F.octet_length(c) * 2 >= n)) | close
    m = m.where(near)
    # A sum, which needs the distinct names, lets both sides read one exchange; bool_or would scan the texts once more.
    any_exact = m.agg((F.coalesce(F.sum(F.col("exact").cast("int")), F.lit(0)) > 0).alias("any_exact"))
    return m.join(F.broadcast(any_exact)).where("exact OR NOT any_exact").select("canonical_symbol")


#: Block types whose definitions come first, fallback names from each of two lists, and the prefix that finds them.
LEADING_TYPES = ("function", "struct", "trait", "class", "interface", "type", "enum")
FALLBACK, SEED = 32, 3


def occurrences(segments: DataFrame) -> DataFrame:
    """(context_id, segment_id, symbol, canonical_symbol, reference_kind): the first spelling of each name and kind of a segment.

    A segment's symbols stand in its row, so repeats go within the row and nothing is exchanged.
    """
    empty, null = F.array().cast("array<string>"), F.array(F.lit(None).cast("string"))
    context = F.col("context_id") if "context_id" in segments.columns else F.lit("default")
    lists = [F.struct(F.lit(kind).alias("reference_kind"), F.array_except(F.coalesce(column, empty), null).alias("s")) for column, kind in (("defined_symbols", "definition"), ("referenced_symbols", "usage"))]
    own = ("context_id", "segment_id", "reference_kind")
    rows = segments.select(context.alias("context_id"), "segment_id", F.inline(F.array(*lists)))
    # All spellings of a row are made canonical at once; one that holds the separator sends its row to the slow way.
    rows = rows.select(*own, "s", F.split(F.regexp_replace(F.lower(F.array_join("s", "\n")), r"[^\p{L}\p{N}\n]", ""), "\n").alias("j"))
    rows = rows.select(*own, "s", F.when(F.size("j") == F.size("s"), F.col("j")).otherwise(F.transform("s", T.canonical)).alias("c"), F.slice(F.sequence(F.lit(0), F.size("s")), F.lit(1), F.size("s")).alias("i"))
    rows = rows.select(*own, F.sort_array(F.arrays_zip("c", "i", "s")).alias("n"))
    rows = rows.select(*own, F.col("n.c").alias("c"), F.col("n.s").alias("s"), T.shifted(F.col("n.c")).alias("before"))
    rows = rows.select(*own, F.explode(F.arrays_zip("c", "s", "before")).alias("x")).where("x.c <> '' AND NOT x.c <=> x.before")
    return rows.select("context_id", "segment_id", F.col("x.s").alias("symbol"), F.col("x.c").alias("canonical_symbol"), "reference_kind")


#: Bytes of text whose tokens a worker holds at once, and characters that a referenced symbol has at least.
PIECE, LEAST = 1 << 21, 4


def _tokens(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """What stands between spaces and line ends of non-null texts: the tokens, each one's text, and whether it is its line's first."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    ends = data == 10
    inside = ~(ends | (data == 32))
    # A token starts behind a space or line end, and where a text starts.
    behind = np.concatenate(([True], ~inside))
    behind[at] = True
    behind = behind[:-1]
    starts = np.flatnonzero(inside & behind)
    offsets = np.append(np.flatnonzero(behind[inside]), np.count_nonzero(inside)).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, at)))
    # A line without tokens points at a later line's first.
    first = np.zeros(len(starts) + 1, bool)
    first[np.searchsorted(starts, np.append(at[:-1], np.flatnonzero(ends) + 1))] = True
    return tokens, text, first[:-1]


#: ASCII letters in lower case, and ASCII characters but letters, digits and line ends.
_LOWER, _MARKS = bytes(range(256)).lower(), bytes(c for c in range(128) if not chr(c).isalnum() and c != 10)


def _canonical(spellings: pa.StringArray) -> pa.StringArray:
    """`canonical` of strings without line ends, all in one text of a line each."""
    if not len(spellings):
        return spellings
    plain = pc.string_is_ascii(spellings).to_numpy(zero_copy_only=False)
    if not plain.all() and plain.any():
        order = np.argsort(np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain))))
        return pa.concat_arrays([_canonical(spellings.filter(pa.array(keep))) for keep in (plain, ~plain)]).take(pa.array(order))
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(spellings)], pa.int32()), spellings), "\n")[0].as_py()
    joined = text.encode().translate(_LOWER, _MARKS) if plain.all() else re.sub(r"[^\w\n]+|_+", "", text.lower()).encode()
    data = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(data == 10)
    offsets = np.concatenate(([0], ends - np.arange(len(ends)), [len(data) - len(ends)])).astype(np.int32)
    return pa.StringArray.from_buffers(len(spellings), pa.py_buffer(offsets), pa.py_buffer(data[data != 10]))


def _named(texts: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spellings, names, and of each occurrence in order its spelling, name, text and whether it is a definition; nameless ones and short usages left out."""
    tokens, text, first = _tokens(texts)
    coded = tokens.dictionary_encode()
    spellings, spelling = coded.dictionary, coded.indices.to_numpy()
    named = _canonical(spellings).dictionary_encode()
    name_of = named.indices.to_numpy()
    some = pc.not_equal(named.dictionary, "").to_numpy(zero_copy_only=False)[name_of]
    long = some & (pc.utf8_length(spellings).to_numpy() >= LEAST)
    kept = np.flatnonzero(np.where(first, some[spelling], long[spelling]))
    return spellings, named.dictionary, spelling[kept], name_of[spelling[kept]], text[kept], first[kept]


def _pieces(texts: pa.Array) -> Iterator[tuple[int, pa.StringArray]]:
    """Runs of texts of PIECE bytes, or of one longer text, with the first one's place."""
    ends, a = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, "right")))
        yield a, texts[a:b]
        a = b


def line_occurrences(segments: DataFrame) -> DataFrame:
    """(segment_id, reference_kind, canonical_symbol, symbol): `occurrences` of `line_symbols`.

    They are taken from the texts in columns of bytes and numbers rather than token by token. Letters
    and digits are those of Python's Unicode tables, which are newer than Java 17's.
    """

    def take(batches):
        for batch in batches:
            ids, texts = (batch.column(i).cast(pa.string()) for i in range(2))
            for a, piece in _pieces(pc.fill_null(texts, "")):
                spellings, names, spelling, name, text, first = _named(piece)
                seen = pa.array((2 * text + first) * len(names) + name).dictionary_encode().indices.to_numpy()
                # Codes are dealt by first occurrence, so one above all before it is new.
                new = np.flatnonzero(np.diff(np.maximum.accumulate(seen), prepend=-1))
                kinds = pa.array(["usage", "definition"]).take(pa.array(first[new].astype(np.int8)))
                columns = [ids.take(pa.array(text[new] + a)), kinds, names.take(pa.array(name[new])), spellings.take(pa.array(spelling[new]))]
                yield pa.RecordBatch.from_arrays(columns, names=["segment_id", "reference_kind", "canonical_symbol", "symbol"])

    return segments.select(F.col("segment_id").cast("string"), "content").mapInArrow(take, "segment_id string, reference_kind string, canonical_symbol string, symbol string")


def line_names(segments: DataFrame) -> DataFrame:
    """The canonical names of `line_occurrences`, each once a piece of text or oftener."""

    def take(batches):
        for batch in batches:
            for _, piece in _pieces(pc.fill_null(batch.column(0).cast(pa.string()), "")):
                _, names, _, name, _, _ = _named(piece)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.flatnonzero(np.bincount(name, minlength=len(names)))))], names=["canonical_symbol"])

    return segments.select("content").mapInArrow(take, "canonical_symbol string")


def with_held(segments: DataFrame, names: Sequence[str], name: str = "named") -> DataFrame:
    """Segments with how many rows of `occurrences` with one of the names each gives, counted within its row."""
    lists = ("defined_symbols", "referenced_symbols")
    # Columns of their own, since each stands more than once in the count.
    s = segments.withColumns({f"_s{i}": F.array_compact(F.coalesce(F.col(c), F.array().cast("array<string>"))) for i, c in enumerate(lists)})
    s = s.withColumns({f"_j{i}": F.concat(F.lit("\n"), F.regexp_replace(F.lower(F.array_join(f"_s{i}", "\n")), r"[^\p{L}\p{N}\n]", ""), F.lit("\n")) for i in range(len(lists))})
    total = F.lit(0)
    for i in range(len(lists)):
        # A symbol that holds the separator sends its row to the slow way.
        plain = F.size(F.split(f"_j{i}", "\n", -1)) == F.size(f"_s{i}") + 2
        for n in sorted(set(names) - {""}):
            total = total + F.when(plain, F.col(f"_j{i}").contains(f"\n{n}\n")).otherwise(F.array_contains(F.transform(f"_s{i}", T.canonical), n)).cast("int")
    return s.withColumn(name, total).drop(*[f"_{k}{i}" for k in "sj" for i in range(len(lists))])


def may_hold(letters: Column, names: Sequence[str]) -> Column:
    """Whether a text may hold one of the names as a symbol; `letters` are its letters and digits, lower-cased.

    A capital sigma is lower-cased by what stands around it, so names beyond ASCII may stand anywhere.
    """
    return T.any_of([letters.contains(n) if n.isascii() else F.lit(True) for n in names])


def fallback_names(symbols: DataFrame, wanted: str) -> DataFrame:
    """(canonical_symbol, turn): names that share the query's first letters, then names that contain it, each list by its own order."""
    n = Window.orderBy("list", "at")
    by_prefix = prefix(symbols, wanted[:SEED], FALLBACK).withColumn("at", F.struct(F.lit(0), F.lit(0), F.char_length("canonical_symbol"), "canonical_symbol"))
    inside = containing(symbols, wanted, FALLBACK).withColumn("at", F.struct(F.when(F.col("canonical_symbol").startswith(wanted), 0).otherwise(1), F.abs(F.char_length("canonical_symbol") - len(wanted)), F.char_length("canonical_symbol"), "canonical_symbol"))
    both = by_prefix.select("canonical_symbol", F.lit(0).alias("list"), F.col("at").cast("struct<a:int,b:int,c:int,d:string>").alias("at")).unionByName(inside.select("canonical_symbol", F.lit(1).alias("list"), F.col("at").cast("struct<a:int,b:int,c:int,d:string>").alias("at")))
    first = both.groupBy("canonical_symbol").agg(F.min(F.struct("list", "at")).alias("x")).select("canonical_symbol", "x.*")
    return first.select("canonical_symbol", F.row_number().over(n).alias("turn"))  # 64 names at most


def lookup(segments: DataFrame, symbols: DataFrame, name: str, kind: str = "definition", fuzzy_too: bool = True) -> DataFrame:
    """Segments that hold the name, with symbol and their position `at`: the exact name, else the nearest names in turn.

    Within a name leading block types come first, then path, line and spelling. One row a segment.
    """
    wanted = "".join(c for c in name.lower() if c.isalnum())
    own = symbols.where(F.col("reference_kind") == kind)
    hits = own.where(F.col("canonical_symbol") == wanted).withColumn("turn", F.lit(0))
    if fuzzy_too and wanted and not hits.limit(1).count():
        near = fuzzy(fallback_names(own, wanted), wanted).join(fallback_names(own, wanted), "canonical_symbol")
        hits = own.join(F.broadcast(near), "canonical_symbol")
    rows = segments.join(hits.select("segment_id", "symbol", "turn"), "segment_id")
    lead = F.when(F.col("block_type").isin(*LEADING_TYPES), 0).otherwise(1)
    order = F.struct("turn", lead.alias("lead"), "file_path", "line_start", "symbol", "segment_id")
    once = rows.withColumn("place", order).withColumn("nth", F.row_number().over(Window.partitionBy("segment_id").orderBy("place"))).where("nth = 1")
    return once.withColumn("at", F.row_number().over(Window.orderBy("place"))).drop("place", "nth", "turn")  # the holders of one name


def lookup_references(segments: DataFrame, symbols: DataFrame, name: str, include: str = "both", fuzzy_too: bool = True) -> DataFrame:
    """Definitions, then usages of segments that don't define the name; `include` is definitions, references or both.

    References are what `both` gives without the definitions.
    """
    if include not in ("definitions", "references", "both"):
        raise ValueError("include must be definitions, references or both")
    d = lookup(segments, symbols, name, "definition", fuzzy_too).withColumn("reference_kind", F.lit("definition"))
    if include == "definitions":
        return d
    u = lookup(segments, symbols, name, "usage", fuzzy_too).withColumn("reference_kind", F.lit("usage")).join(d.select("segment_id"), "segment_id", "left_anti")
    return u if include == "references" else d.unionByName(u.select(*d.columns))


def references(symbols: DataFrame, canonical: str) -> DataFrame:
    """Definitions, then usages of segments that don't define the symbol."""
    s = symbols.where(F.col("canonical_symbol") == canonical).select("segment_id", "reference_kind")
    s = s.withColumn("_d", F.max(F.col("reference_kind") == "definition").over(Window.partitionBy("segment_id")))
    return s.where("reference_kind = 'definition' OR NOT _d").drop("_d")


def handles(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """(handle, status, segment_ids): exact id first, else a unique prefix; ambiguous ones list at most five ids.

    Handles are a request's list. Each length among them joins by the ids' prefix of that length, so
    the join has a key and segments are read once for each of the few lengths.
    """
    h = wanted.select("handle", F.lower(F.regexp_replace(F.trim("handle"), "^:", "")).alias("_h")).withColumn("_n", F.char_length("_h"))
    lengths = [r["_n"] for r in h.select("_n").distinct().orderBy("_n").limit(65).collect()]
    ids = segments.select("segment_id")
    prefixes = ids.select("segment_id", F.explode(F.array(*[F.lit(n) for n in lengths] or [F.lit(0)])).alias("_n")).select("segment_id", "_n", F.lower(F.left("segment_id", F.col("_n"))).alias("_h"))
    m = h.join(prefixes, ["_n", "_h"], "left")
    g = m.groupBy("handle", "_h").agg(F.count("segment_id").alias("n"), F.max((F.col("segment_id") == F.col("_h")).cast("int")).alias("hit"), F.slice(F.array_sort(F.collect_set("segment_id")), 1, 5).alias("ids"))
    status = F.when((F.col("hit") == 1) | (F.col("n") == 1), "found").when(F.col("n") == 0, "not_found").otherwise("ambiguous")
    return g.select("handle", status.alias("status"), F.when(F.col("hit") == 1, F.col("_h")).otherwise(F.array_join("ids", ",")).alias("segment_ids"))


def hydrate(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requests (pos, handle) in order with status and, where found, the segment's columns."""
    state = handles(segments, wanted.select("handle").distinct())
    found = state.where("status = 'found'").select("handle", F.col("segment_ids").alias("segment_id"))
    rows = found.join(segments, "segment_id")
    return wanted.join(state, "handle").join(rows, "handle", "left").orderBy("pos")


def read_status(hydrated: DataFrame) -> DataFrame:
    """One row: ok where every handle was found, partial where some were, else empty."""
    ok = F.col("status") == "found"
    return hydrated.agg(F.when(F.bool_and(ok), "ok").when(F.bool_or(ok), "partial").otherwise("empty").alias("status"))
