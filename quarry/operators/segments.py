"""Files to line-addressed segments, symbol occurrences and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Extensions whose chunks don't overlap.
NO_OVERLAP = "json toml yaml yml proto properties conf ini tf hcl sql sq sqm".split()
#: Languages of the chunker by extension; any other extension names itself.
LANGUAGES = {
    "markdown": ("md", "markdown"), "text": ("txt",), "json": ("json",), "yaml": ("yaml", "yml"), "toml": ("toml",), "xml": ("xml",), "html": ("html", "htm"), "css": ("css",),
    "sql": ("sql", "sq", "sqm"), "shell": ("sh", "bash", "zsh"), "ruby": ("rb",), "php": ("php",), "swift": ("swift",), "r": ("r",), "scala": ("scala",), "elixir": ("ex", "exs"),
    "erlang": ("erl", "hrl"), "haskell": ("hs",), "lua": ("lua",), "perl": ("pl", "pm"), "dart": ("dart",), "protobuf": ("proto",), "dockerfile": ("dockerfile",),
    "makefile": ("makefile", "mk", "justfile"), "cmake": ("cmake",), "terraform": ("tf", "hcl"), "config": ("properties", "conf", "ini"),
}
#: Languages with a grammar, by extension; those that structure cuts into segments; text types without a grammar.
GRAMMARS = {
    "rust": ("rs",), "python": ("py", "pyi"), "javascript": ("js", "mjs", "cjs", "jsx"), "typescript": ("ts", "mts", "cts", "tsx"), "go": ("go",), "java": ("java",), "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), "kotlin": ("kt", "kts"), "css": ("css",), "html": ("html", "htm"), "json": ("json",), "bash": ("sh", "bash", "zsh"),
    "toml": ("toml",), "yaml": ("yaml", "yml"), "markdown": ("md", "markdown"),
}
STRUCTURAL = ("rust", "python", "javascript", "typescript", "go", "java", "c", "cpp", "kotlin", "css", "bash")
TEXT_TYPES = "txt rst adoc asciidoc tex org proto properties conf ini tf hcl sql sq sqm dockerfile makefile justfile".split()
#: Names that are a file type without an extension, and languages whose chunks get no vector.
NAMED = ("dockerfile", "makefile", "justfile")
DATA_LANGUAGES = ("json", "yaml", "toml", "protobuf", "terraform", "sql", "config", "makefile", "dockerfile")


def extension(path: Column) -> Column:
    """The lower-cased extension, or the name itself of the few files that need none; else empty."""
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    name = F.lower(F.substring_index(path, "/", -1))
    return F.when(ext != "", ext).when(name.isin(*NAMED), name).otherwise("")


def _by_extension(ext: Column, table: dict[str, tuple[str, ...]], otherwise: Column) -> Column:
    out = otherwise
    for language_, extensions in table.items():
        out = F.when(ext.isin(*extensions), language_).otherwise(out)
    return out


def language(path: Column) -> Column:
    ext = extension(path)
    return _by_extension(ext, LANGUAGES, ext)


def grammar(path: Column) -> Column:
    return _by_extension(extension(path), GRAMMARS, F.lit(None).cast("string"))


def route(path: Column) -> Column:
    """structural, chunk or skip."""
    ext = extension(path)
    return F.when(grammar(path).isin(*STRUCTURAL), "structural").when(grammar(path).isNotNull() | ext.isin(*TEXT_TYPES), "chunk").otherwise("skip")


def embeds(block_type: Column, language_: Column) -> Column:
    """Whether a segment gets a vector: all but chunks of data languages."""
    return (block_type != "chunk") | ~language_.isin(*DATA_LANGUAGES)


def lines_of(content: Column) -> Column:
    """Lines without a trailing empty one or a carriage return; empty content has none."""
    # A pattern's $ would also stand before a last line end and take two empty lines.
    # One character is split at without a pattern.
    n = F.char_length(content)
    body = F.when(content.endswith("\r\n"), F.left(content, n - 2)).when(content.endswith("\n"), F.left(content, n - 1)).otherwise(content)
    return F.when(F.coalesce(content, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\n"))


def segment_id(context: Column, path: Column, first: Column, last: Column) -> Column:
    nul = F.decode(F.unhex(F.lit("00")), "utf-8")
    return F.left(F.sha2(F.concat(context, nul, path, nul, first.cast("string"), nul, last.cast("string")), 256), F.lit(32))


def chunk(files: DataFrame, window: int = 60, overlap: int = 10) -> DataFrame:
    """(context_id, file_path, content) to segments; a window at s exists iff s = 0 or s + overlap < lines."""
    window = max(window, 1)
    own = F.when(extension(F.col("file_path")).isin(*NO_OVERLAP), 0).otherwise(min(overlap, window - 1))
    # Only empty content has no line; asking that of the content keeps the lines from being cut twice.
    f = files.where(F.col("content") != "").withColumn("_l", lines_of(F.col("content"))).withColumn("_o", own)
    starts = F.filter(F.expr(f"sequence(0, size(_l) - 1, {window} - _o)"), lambda s: (s == 0) | (s + F.col("_o") < F.size("_l")))
    # Each window's lines are cut out before they become rows, so no row carries the whole file.
    cut = lambda i: F.struct((i + 1).cast("long").alias("line_start"), F.least(i + window, F.size("_l")).cast("long").alias("line_end"), F.array_join(F.slice("_l", i + 1, F.lit(window)), "\n").alias("content"))
    f = f.select("context_id", "file_path", F.explode(F.transform(starts, cut)).alias("w")).select("context_id", "file_path", "w.*")
    return f.select(
        segment_id(F.col("context_id"), F.col("file_path"), F.col("line_start"), F.col("line_end")).alias("segment_id"), "context_id", "file_path", language(F.col("file_path")).alias("language"), F.lit("chunk").alias("block_type"),
        "content", "line_start", "line_end", F.lit("IMPLEMENTATION").alias("role"), F.lit(0).alias("complexity"))


def line_symbols(segments: DataFrame) -> DataFrame:
    """Segments with symbols read from prose: a line's first token is defined, its further tokens of four or more characters are referenced."""
    # Patterns over the whole text; functions of each line and token would be interpreted.
    first = F.regexp_extract_all("content", F.lit(r"(?:^|\n) *+([^ \n]+)"), 1)
    further = F.regexp_replace("content", r"(?:^|\n) *+[^ \n]+", "\n")
    return segments.withColumns({"defined_symbols": first, "referenced_symbols": F.regexp_extract_all(further, F.lit(r"[^ \n]{4,}"), 0)})


def relation_rows(raw: DataFrame) -> DataFrame:
    """(source_id, kind, raw_target, pos) to edges, the first of each (kind, lookup, owner, shape) kept."""
    parts = T.components(F.col("raw_target"))
    r = raw.select("source_id", "kind", "raw_target", "pos", T.canonical(F.col("raw_target")).alias("canonical_target"), F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")).alias("lookup_symbol"), T.owner_fingerprint(F.col("raw_target")).alias("owner"), T.edge_kind(F.col("raw_target")).alias("edge_kind"))
    r = r.where("lookup_symbol <> ''")
    first = Window.partitionBy("source_id", "kind", "lookup_symbol", "owner", "edge_kind").orderBy("pos")
    return r.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "pos")


def relations_of(segments: DataFrame) -> DataFrame:
    """(context_id, source_id, kind, raw_target, canonical_target, lookup_symbol, owner, edge_kind) of segments.

    Calls come first, then references; a relation's own kind goes before that of its list. Where a
    list of relations is empty, its symbols make bare identifiers. Of edges that agree in kind,
    lookup, owner and shape the first stays. All of it happens within a segment's row.
    """
    kind_of = "array<struct<symbol:string,edge_kind:string,kind:string>>"
    lists = []
    for relations, names, kind in (("called_relations", "called_symbols", "call"), ("referenced_relations", "referenced_symbols", "reference")):
        own = F.col(relations).cast(kind_of) if relations in segments.columns else F.lit(None).cast(kind_of)
        bare = F.transform(F.coalesce(F.col(names), F.array().cast("array<string>")), lambda s: F.struct(s.alias("symbol"), F.lit("bare_identifier").alias("edge_kind"), F.lit(None).cast("string").alias("kind")))
        own = F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(bare.cast(kind_of))
        default = F.lit(kind)
        lists.append(F.transform(own, lambda r: F.struct(F.coalesce(r["kind"], default).alias("kind"), r["symbol"].alias("raw_target"), T.normalize_edge_kind(r["edge_kind"]).alias("edge_kind"))))  # noqa: B023
    context = F.col("context_id") if "context_id" in segments.columns else F.lit("default")
    r = segments.select(context.alias("context_id"), F.col("segment_id").alias("source_id"), F.concat(*lists).alias("r"))
    r = r.select("context_id", "source_id", F.transform("r", lambda x, i: F.struct(
        x["kind"].alias("kind"), F.coalesce(F.try_element_at(T.components(x["raw_target"]), F.lit(-1)), F.lit("")).alias("lookup_symbol"), T.owner_fingerprint(x["raw_target"]).alias("owner"),
        x["edge_kind"].alias("edge_kind"), i.alias("i"), x["raw_target"].alias("raw_target"), T.canonical(x["raw_target"]).alias("canonical_target"))).alias("r"))
    r = r.withColumn("r", F.array_sort(F.filter("r", lambda x: x["lookup_symbol"] != "")))
    key = lambda x: F.struct(x["kind"], x["lookup_symbol"], x["owner"], x["edge_kind"])
    first = F.filter("r", lambda x, i: (i == 0) | (key(F.col("r")[F.greatest(i - 1, F.lit(0))]) != key(x)))
    out = r.select("context_id", "source_id", F.explode(first).alias("x"))
    return out.select("context_id", "source_id", *[F.col(f"x.{c}").alias(c) for c in ("kind", "raw_target", "canonical_target", "lookup_symbol", "owner", "edge_kind")])
