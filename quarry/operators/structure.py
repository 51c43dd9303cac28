"""Structural segments: one for each top-level construct and each member of a container.

Python is read by its own grammar (`ast`). Languages with braces are read by a scanner: strings and
comments are blanked, a construct starts where a line opens with one of the language's headers, and
ends with its matching brace or semicolon. Files are independent rows, so this is a map without a
shuffle; a file that cannot be read is left to the chunker.
"""

from __future__ import annotations

import ast
import builtins
import keyword
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segments as S

RELATION = pa.list_(pa.struct([("symbol", pa.string()), ("edge_kind", pa.string()), ("kind", pa.string())]))
_NAMES = pa.list_(pa.string())
_PARSED = pa.schema([
    ("context_id", pa.string()), ("file_path", pa.string()), ("language", pa.string()), ("block_type", pa.string()), ("content", pa.string()), ("line_start", pa.int64()), ("line_end", pa.int64()), ("breadcrumb", pa.string()), ("complexity", pa.int32()), ("role", pa.string()),
    ("defined_symbols", _NAMES), ("referenced_symbols", _NAMES), ("called_symbols", _NAMES), ("called_relations", RELATION), ("referenced_relations", RELATION)])
_EDGE = "array<struct<symbol:string,edge_kind:string,kind:string>>"
PARSED = f"context_id string, file_path string, language string, block_type string, content string, line_start long, line_end long, breadcrumb string, complexity int, role string, defined_symbols array<string>, referenced_symbols array<string>, called_symbols array<string>, called_relations {_EDGE}, referenced_relations {_EDGE}"
#: Words that are never references, by language family, and calls that branch.
KEYWORDS = {
    "python": {*keyword.kwlist, *dir(builtins), "self", "cls"},
    "rust": set("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while bool char str u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 String Vec Option Result Some None Ok Err Box".split()),
    "typescript": set("abstract any as async await boolean break case catch class const continue default delete do else enum export extends false finally for from function if implements import in instanceof interface let new null number of private protected public readonly return static string super switch this throw true try type typeof undefined var void while yield object never unknown".split()),
    "java": set("abstract boolean break byte case catch char class const continue default do double else enum extends final finally float for if implements import instanceof int interface long native new null package private protected public return short static super switch this throw throws true false try var void volatile while String Object Integer Long List Map fun val when override object data".split()),
    "c": set("auto bool break case char class const continue default delete do double else enum extern false float for goto if inline int long namespace new nullptr operator private protected public register return short signed sizeof static struct switch template this throw true try typedef typename union unsigned using virtual void volatile while string std func go defer range type package import var map chan interface nil error".split()),
}
KEYWORDS["javascript"] = KEYWORDS["typescript"]
KEYWORDS["kotlin"] = KEYWORDS["java"]
KEYWORDS["cpp"] = KEYWORDS["go"] = KEYWORDS["c"]
BRANCH = re.compile(r"\b(?:if|for|while|match|switch|loop|try|catch|when|select)\b")
_VIS = r"(?:pub(?:\([^)]*\))?\s+)?"
_MOD = r"(?:(?:public|private|protected|static|final|abstract|async|export|default|open|override|data|sealed|inline|virtual|const)\s+)*"
#: (block type, role, header) in the order they are tried; the header's group is the name.
HEADERS = {
    "rust": [("import", "IMPORT", rf"{_VIS}use\s+([^;]+)"), ("function", "IMPLEMENTATION", rf"{_VIS}(?:(?:async|const|unsafe|extern(?:\s+\"\s*\")?)\s+)*fn\s+(\w+)"), ("struct", "DEFINITION", rf"{_VIS}struct\s+(\w+)"), ("enum", "DEFINITION", rf"{_VIS}enum\s+(\w+)"), ("trait", "DEFINITION", rf"{_VIS}(?:unsafe\s+)?trait\s+(\w+)"), ("impl", "IMPLEMENTATION", r"(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s*([^{]+)"), ("type", "DEFINITION", rf"{_VIS}type\s+(\w+)"), ("const", "DEFINITION", rf"{_VIS}const\s+(\w+)"), ("static", "DEFINITION", rf"{_VIS}static\s+(?:mut\s+)?(\w+)"), ("module", "ORCHESTRATION", rf"{_VIS}mod\s+(\w+)"), ("macro", "DEFINITION", r"macro_rules!\s*(\w+)")],
    "typescript": [("import", "IMPORT", r"import\b([^;]*)"), ("function", "IMPLEMENTATION", rf"{_MOD}function\s*\*?\s*(\w+)"), ("class", "DEFINITION", rf"{_MOD}class\s+(\w+)"), ("interface", "DEFINITION", rf"{_MOD}interface\s+(\w+)"), ("type", "DEFINITION", rf"{_MOD}type\s+(\w+)"), ("enum", "DEFINITION", rf"{_MOD}enum\s+(\w+)"), ("variable", "DEFINITION", r"(?:export\s+)?(?:const|let|var)\s+(\w+)")],
    "java": [("import", "IMPORT", r"import\s+([^;]+)"), ("class", "DEFINITION", rf"{_MOD}(?:class|record|object)\s+(\w+)"), ("interface", "DEFINITION", rf"{_MOD}interface\s+(\w+)"), ("enum", "DEFINITION", rf"{_MOD}enum\s+(?:class\s+)?(\w+)"), ("function", "IMPLEMENTATION", rf"{_MOD}fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)")],
    "go": [("import", "IMPORT", r"import\b(.*)"), ("function", "IMPLEMENTATION", r"func\s+(?:\([^)]*\)\s*)?(\w+)"), ("type", "DEFINITION", r"type\s+(\w+)"), ("const", "DEFINITION", r"const\s+(\w+)"), ("variable", "DEFINITION", r"var\s+(\w+)")],
    "c": [("import", "IMPORT", r"#\s*include\s*(.*)"), ("module", "ORCHESTRATION", r"namespace\s+(\w+)"), ("struct", "DEFINITION", r"(?:typedef\s+)?struct\s+(\w+)"), ("class", "DEFINITION", r"(?:template\s*<[^>]*>\s*)?class\s+(\w+)"), ("enum", "DEFINITION", r"(?:typedef\s+)?enum\s+(?:class\s+)?(\w+)"), ("type", "DEFINITION", r"typedef\s+[^;{]*?(\w+)\s*;"), ("function", "IMPLEMENTATION", r"(?:[\w:*&<>]+\s+[*&]*)+([\w:~]+)\s*\([^;{]*\)[^;{]*(?=\{)")],
}
HEADERS["javascript"], HEADERS["kotlin"], HEADERS["cpp"] = HEADERS["typescript"], HEADERS["java"], HEADERS["c"]
#: Containers and how their members start.
MEMBERS = {
    "rust": ({"impl", "trait", "module"}, [h for h in HEADERS["rust"] if h[0] in ("function", "struct", "enum")]),
    "typescript": ({"class"}, [("function", "IMPLEMENTATION", rf"{_MOD}(?:get\s+|set\s+)?\*?(\w+)\s*\([^;{{]*\)[^;{{]*(?=\{{)")]),
    "java": ({"class", "interface", "enum"}, [("function", "IMPLEMENTATION", rf"(?:@\w+\s+)*{_MOD}(?:<[^>]*>\s*)?(?:[\w<>\[\],.?]+\s+)?(\w+)\s*\([^;{{]*\)[^;{{]*(?=\{{)"), HEADERS["java"][-1]]),
    "go": (set(), []),
    "c": ({"class", "struct", "module"}, [HEADERS["c"][-1]]),
}
MEMBERS["javascript"], MEMBERS["kotlin"], MEMBERS["cpp"] = MEMBERS["typescript"], MEMBERS["java"], MEMBERS["c"]


@dataclass
class Block:
    block_type: str
    role: str
    first: int  # lines from 1
    last: int
    name: str = ""
    breadcrumb: str | None = None
    complexity: int = 0
    defines: list[str] = field(default_factory=list)
    calls: list[tuple[str, str, str | None]] = field(default_factory=list)
    refers: list[tuple[str, str, str | None]] = field(default_factory=list)


def sanitize(target: str) -> str:
    """A target's text with single blanks, none around separators, and without generic arguments and qualifier words."""
    depth, out = 0, []
    for c in target:
        depth += (c == "<") - (c == ">" and depth > 0)
        if depth == 0 and c != ">":
            out.append(c)
    text = " ".join(w for w in "".join(out).split() if w not in ("dyn", "impl", "const", "mut"))
    return re.sub(r"\s*(::|\.)\s*", r"\1", text)


def shape(target: str, macro: bool = False, new: bool = False) -> str:
    if macro or new:
        return "macro_like" if macro else "constructor_like"
    return "qualified_path" if "::" in target else "member_access" if "." in target or "->" in target else "bare_identifier"


def _distinct(items):
    return list(dict.fromkeys(items))


# Python.


def _dotted(node: ast.AST) -> str:
    """The text of a name or an attribute chain; calls and subscripts in between fall away."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        left = _dotted(node.value)
        return f"{left}.{node.attr}" if left else node.attr
    if isinstance(node, (ast.Call, ast.Subscript)):
        return _dotted(node.func if isinstance(node, ast.Call) else node.value)
    return ""


_NESTS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)


def _depth(node: ast.AST) -> int:
    return max((_depth(c) + isinstance(c, _NESTS) for c in ast.iter_child_nodes(node)), default=0)


def python_blocks(content: str) -> list[Block]:
    tree, out = ast.parse(content), []

    def add(node, crumb):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            out.append(Block("import", "IMPORT", node.lineno, node.end_lineno, defines=[a.asname or a.name for a in node.names]))
            return
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            return
        is_class = isinstance(node, ast.ClassDef)
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        b = Block("class" if is_class else "function", "DEFINITION" if is_class else "IMPLEMENTATION", first, node.end_lineno, node.name, crumb, _depth(node), [node.name])
        names = []
        for x in ast.walk(node):
            if isinstance(x, ast.Call) and (target := _dotted(x.func)):
                b.calls.append((target, shape(target), None))
            elif isinstance(x, ast.Name):
                names.append(x.id)
            elif isinstance(x, ast.Attribute):
                names.append(x.attr)
        b.refers = [(n, "bare_identifier", None) for n in sorted(set(names) - {node.name} - KEYWORDS["python"])]
        b.calls = _distinct(b.calls)
        out.append(b)
        if is_class:
            for member in node.body:
                add(member, node.name)

    for node in tree.body:
        add(node, None)
    return out


# Languages with braces.
_BLANKED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'", re.S)


def masked(content: str) -> str:
    """The text with comments and strings blanked, every position and line kept."""
    return _BLANKED.sub(lambda m: (lambda s: s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1] if s[0] in "\"`'" else re.sub(r"[^\n]", " ", s))(m[0]), content)


def _end(text: str, at: int) -> int:
    """Where a construct that starts at `at` ends: after its matching brace, or its semicolon if that comes first."""
    depth = 0
    for k in range(at, len(text)):
        c = text[k]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return k + 1
        elif c == ";" and depth == 0:
            return k + 1
    return len(text)


def brace_blocks(content: str, language: str) -> list[Block]:
    text, out = masked(content), []
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    row = lambda k: next(i for i in range(_bisect(lines, k), 0, -1))

    def comment_start(first: int) -> int:
        """The first line of comments and attributes that stand directly above."""
        source = content.split("\n")
        while first > 1 and re.match(r"\s*(//|/\*|\*|#\[|@\w)", source[first - 2]):
            first -= 1
        return first

    def conformance(kind: str, head: str) -> list[tuple[str, str, str | None]]:
        found = []
        if language == "rust" and kind == "impl" and (m := re.match(r"(?s)(.*?)\bfor\b", head)):
            found = [m[1]]
        elif language in ("typescript", "javascript", "java"):
            for m in re.finditer(r"\b(?:extends|implements)\s+([\w$.<>,\s]+?)(?=\bextends\b|\bimplements\b|\{|$)", head):
                found += re.sub(r"<[^<>]*>", "", m[1]).split(",")
        return [(t, shape(t), "conformance") for t in map(sanitize, found) if t]

    def take(start: int, stop: int, headers, crumb):
        at = start
        while at < stop:
            line_end = text.find("\n", at)
            line_end = stop if line_end < 0 else line_end
            begin = at + len(text[at:line_end]) - len(text[at:line_end].lstrip())
            for kind, role, header in headers:
                m = re.compile(header).match(text, begin, stop)
                if m and m[1].strip() not in ("if", "for", "while", "switch", "return", "catch", "else"):
                    end = line_end if kind == "import" and language in ("go", "c", "cpp") else min(_end(text, begin), stop)
                    open_at = text.find("{", begin, end)
                    head = text[begin : open_at if open_at >= 0 else end]
                    raw = content[m.start(1) : m.end(1)].strip()
                    name = sanitize(re.split(r"\bfor\b", raw)[-1].split(" where ")[0]) if kind == "impl" else raw
                    body = text[m.end() : end]
                    b = Block(kind, role, comment_start(row(begin)), row(max(begin, end - 1)), name, crumb)
                    b.defines = [re.sub(r"[{};].*", "", name, flags=re.S).strip()] if name else []
                    depth, nest = 0, 0
                    if kind != "import":
                        b.complexity = _nesting(body)
                        for c in re.finditer(r"(\bnew\s+)?([A-Za-z_$][\w$]*(?:\s*(?:::|\.|->)\s*[A-Za-z_$][\w$]*)*)\s*(!)?\s*(?:::\s*<[^()]*>\s*)?[(\[{]", body):
                            target, macro = sanitize(c[2]), bool(c[3])
                            if (c[0].rstrip()[-1] == "(" or macro) and target not in KEYWORDS[language] and not BRANCH.fullmatch(target):
                                b.calls.append((target, shape(target, macro, bool(c[1])), None))
                        words = set(re.findall(r"[A-Za-z_$][\w$]*", body)) - KEYWORDS[language] - set(b.defines)
                        b.refers = conformance(kind, head[head.find(m[1][:1]) :] if kind != "impl" else m[1]) + [(w, "bare_identifier", None) for w in sorted(words)]
                        b.calls = _distinct(b.calls)
                    out.append(b)
                    kinds, members = MEMBERS[language]
                    if kind in kinds and open_at >= 0:
                        take(open_at + 1, end - 1, members, name)
                    at = end
                    break
            else:
                # Not a construct: on to the next line, past any block that opens here.
                brace = text.find("{", begin, line_end)
                at = _end(text, begin) if brace >= 0 else line_end + 1

    take(0, len(text), HEADERS[language], None)
    return out


def _bisect(lines: list[int], k: int) -> int:
    from bisect import bisect_right

    return bisect_right(lines, k)


def _nesting(body: str) -> int:
    """The deepest nesting of branching constructs: blocks whose head, since the last brace or semicolon, branches."""
    most, stack, last = 0, [], 0
    for m in re.finditer(r"[{};]", body):
        if m[0] == "{":
            stack.append(bool(BRANCH.search(body[last : m.start()])))
            most = max(most, sum(stack))
        elif m[0] == "}" and stack:
            stack.pop()
        last = m.end()
    return most


def blocks(content: str, language: str) -> list[Block]:
    """Blocks of a file; none where the language or the text cannot be read."""
    try:
        return python_blocks(content) if language == "python" else brace_blocks(content, language) if language in HEADERS else []
    except (SyntaxError, ValueError, RecursionError):
        return []


def rows(context_id: str, path: str, language: str, content: str) -> Iterator[dict]:
    lines = content.split("\n")
    for b in blocks(content, language):
        yield {
            "context_id": context_id, "file_path": path, "language": language, "block_type": b.block_type, "content": "\n".join(lines[b.first - 1 : b.last]), "line_start": b.first, "line_end": b.last, "breadcrumb": b.breadcrumb, "complexity": b.complexity, "role": b.role,
            "defined_symbols": b.defines, "referenced_symbols": _distinct(t for t, _, _ in b.refers), "called_symbols": _distinct(t for t, _, _ in b.calls),
            "called_relations": [dict(zip(("symbol", "edge_kind", "kind"), c)) for c in b.calls], "referenced_relations": [dict(zip(("symbol", "edge_kind", "kind"), r)) for r in b.refers]}


def structural(files: DataFrame) -> DataFrame:
    """(context_id, file_path, content) to structural segments; files without one give no row."""

    def parse(batches):
        for batch in batches:
            found = [r for c, p, lang, text in zip(*(batch.column(k).to_pylist() for k in range(4))) if text for r in rows(c, p, lang, text)]
            yield pa.RecordBatch.from_pylist(found, schema=_PARSED)

    f = files.select("context_id", "file_path", S.grammar(F.col("file_path")).alias("language"), "content")
    out = f.mapInArrow(parse, PARSED)
    return out.select(S.segment_id(F.col("context_id"), F.col("file_path"), F.col("line_start"), F.col("line_end")).alias("segment_id"), *out.columns)


def ingest(files: DataFrame) -> DataFrame:
    """Segments of every file that its type routes to a parser; a structural file that yields nothing is chunked."""
    known = files.withColumn("route", S.route(F.col("file_path")))
    parsed = structural(known.where("route = 'structural'"))
    missed = known.where("route = 'structural'").join(parsed.select("context_id", "file_path").distinct(), ["context_id", "file_path"], "left_anti")
    chunks = S.chunk(known.where("route = 'chunk'").unionByName(missed.select(*known.columns)).drop("route"))
    return parsed.unionByName(chunks, allowMissingColumns=True)


def search(files: DataFrame, language: str, pattern: str) -> DataFrame:
    """(file_path, line, text): matches of a pattern outside comments and strings, one for each span of a file.

    Python patterns name a node of its grammar (FunctionDef, Call, ...); others are regular
    expressions over the blanked text, whose first group, if any, is what is captured. A pattern that
    cannot be read raises at once.
    """
    if language == "python":
        if not (isinstance(getattr(ast, pattern, None), type) and issubclass(getattr(ast, pattern), ast.AST)):
            raise ValueError(f"no such node: {pattern}")
    else:
        compiled = re.compile(pattern, re.M)

    def hits(text: str):
        if language == "python":
            try:
                found = [(n.lineno, ast.get_source_segment(text, n) or "") for n in ast.walk(ast.parse(text)) if isinstance(n, getattr(ast, pattern)) and hasattr(n, "lineno")]
            except (SyntaxError, ValueError):
                found = []
        else:
            blank = masked(text)
            spans = [m.span(1 if m.re.groups else 0) for m in compiled.finditer(blank)]
            found = [(text.count("\n", 0, a) + 1, text[a:b]) for a, b in spans if b > a]
        return _distinct(found)

    def scan(batches):
        for batch in batches:
            got = [(p, line, t) for p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for line, t in hits(text or "")]
            yield pa.record_batch([[g[0] for g in got], pa.array([g[1] for g in got], pa.int64()), [g[2] for g in got]], schema=pa.schema([("file_path", pa.string()), ("line", pa.int64()), ("text", pa.string())]))

    own = files.where(S.grammar(F.col("file_path")) == language).select("file_path", "content")
    return own.mapInArrow(scan, "file_path string, line long, text string")
