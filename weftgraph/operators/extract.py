"""Extractors: a file in, nodes, edges, raw calls and raw relations out.

Formats that regular expressions describe run in the JVM.  Python is parsed by
its own grammar in workers.  Other languages go to a parser that is registered
for them, else to a scanner of declarations, calls and imports by pattern,
which sees no types; files of languages without either are counted as
unextracted.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import line_of, make_id, make_id_text, normalize_sql_ident
from ..schema import LOC

#: One extraction: lists of nodes, edges, calls, relations and warnings.
RESULT = (
    f"nodes array<struct<id: string, label: string, kind: string, loc: {LOC}, properties: map<string,string>>>, edges array<struct<source: string, target: string, relation: string>>, "
    f"calls array<struct<caller_id: string, callee_label: string, line: int, is_member_call: boolean>>, relations array<struct<source_id: string, target_label: string, relation: string, context: string, allow_same_file: boolean>>, warnings array<string>"
)

#: More matches than a text can have: keeps those of one rule together.
_MATCHES = 1 << 32

# --- formats of the JVM ----------------------------------------------------

_SQL_NAME = r'("[^"]+"|[A-Za-z_][A-Za-z0-9_$]*)'
_SQL_QUAL = r'(?:(?:"[^"]+"|[A-Za-z_][A-Za-z0-9_$]*)\s*\.\s*)?'
_SQL_NC = r'(?:"[^"]+"|[A-Za-z_][A-Za-z0-9_$]*)'

#: What each format's patterns find, as (kind, pattern, group).
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "msbuild": [
        ("msbuild_element", r"(?i)<\s*(Project|Target|ItemGroup|PropertyGroup)\b[^>]*>"),
        ("target", r"""(?i)<\s*Target\b[^>]*\bName\s*=\s*["']([^"']+)["']"""),
        ("package_reference", r"""(?i)<\s*PackageReference\b[^>]*\bInclude\s*=\s*["']([^"']+)["']"""),
    ],
    "delphi": [
        ("form_object", r"(?i)(?:object|inherited)\s+([A-Za-z_][A-Za-z0-9_]*)\s*:"),
        ("procedure", r"(?i)\bprocedure\s+([A-Za-z_][A-Za-z0-9_.]*)\s*\("),
        ("function", r"(?i)\bfunction\s+([A-Za-z_][A-Za-z0-9_.]*)\s*\("),
    ],
    "apex": [
        ("class", r"\b(?:public|private|global|protected)?\s*(?:with\s+sharing|without\s+sharing|virtual|abstract)?\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\b"),
        ("trigger", r"\btrigger\s+([A-Za-z_][A-Za-z0-9_]*)\s+on\s+(?:[A-Za-z_][A-Za-z0-9_]*)\b"),
        ("method", r"\b(?:public|private|global|protected|static|virtual|override|\s)+\s+[A-Za-z_][A-Za-z0-9_<>,\[\]]*\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("),
    ],
}
PATTERNS["xml"] = PATTERNS["msbuild"]


def pattern_nodes(files: DataFrame) -> DataFrame:
    """(path, id, label, kind, source_file, start_line) of MSBuild, XML, Delphi and Apex files (path, language, text)."""
    # one pass over the files: each rule makes a list, null for files of other languages
    lists = [F.when(F.col("language") == lang, _hits(kind, pattern, k)) for lang, rules in PATTERNS.items() for k, (kind, pattern) in enumerate(rules)]
    hits = files.filter(F.col("language").isin(*PATTERNS)).select("path", F.explode(F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))).alias("h")).select("path", "h.*")
    return hits.select("path", make_id(F.concat_ws(":", "path", "kind", "label")).alias("id"), "label", "kind", F.col("path").alias("source_file"), "start_line", "at")


def _hits(kind: str, pattern: str, rule: int) -> Column:
    """The matches of a rule in ``text``, with kind, order and line."""
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.transform(found, lambda label, i: F.struct(label.alias("label"), F.lit(kind).alias("kind"), (i + F.lit(rule).cast("long") * _MATCHES).alias("at"), _line(text, pattern, i).alias("start_line")))


def _line(text: Column, pattern: str, nth: Column) -> Column:
    """1-based line on which the ``nth`` (from 0) match of a pattern begins."""
    before = F.element_at(F.split(text, pattern), (nth + 1).cast("int"))
    # lines in the pieces up to the match and in the matches among them
    pieces = F.array_join(F.slice(F.split(text, pattern), F.lit(1), nth + 1), "")
    inner = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(1), nth), "")
    return F.when(before.isNotNull(), F.regexp_count(pieces, F.lit("\n")) + F.regexp_count(inner, F.lit("\n")) + 1).cast("int")


def sql_entities(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of SQL scripts: a node a file, tables and enums keyed by name alone, foreign keys as references."""
    f = files.filter("language = 'sql'").select("path", "text")
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    rules = [
        ("sql_table", rf"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{_SQL_QUAL}{_SQL_NAME}"),
        ("sql_enum", rf"(?i)CREATE\s+TYPE\s+{_SQL_QUAL}{_SQL_NAME}\s+AS\s+ENUM"),
        ("sql_table", rf"(?i)ALTER\s+TABLE\s+{_SQL_QUAL}{_SQL_NC}\s+RENAME\s+TO\s+{_SQL_QUAL}{_SQL_NAME}"),
    ]

    def found(kind: str, pattern: str, k: int) -> Column:
        names = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda raw, i: F.struct(normalize_sql_ident(raw).alias("label"), F.lit(kind).alias("kind"), (i + F.lit(k).cast("long") * _MATCHES).alias("at"), _line(F.col("text"), pattern, i).alias("start_line")))
        return F.filter(names, lambda x: x["label"] != "")

    itself = F.array(F.struct(name.alias("label"), F.lit("sql_file").alias("kind"), F.lit(-1).cast("long").alias("at"), F.lit(None).cast("int").alias("start_line")))
    every = f.select("path", F.explode(F.concat(itself, *[found(kind, pattern, k) for k, (kind, pattern) in enumerate(rules)])).alias("x")).select("path", "x.*")
    key = F.when(F.col("kind") == "sql_file", F.concat("path", F.lit(":sql_file:"), "label")).otherwise(F.concat("kind", F.lit(":"), "label"))
    nodes = every.select("path", make_id(key).alias("id"), "label", "kind", "at", "start_line")
    fk = rf"(?i)ALTER\s+TABLE\s+{_SQL_QUAL}{_SQL_NAME}\s+ADD\s+(?:CONSTRAINT\s+{_SQL_NC}\s+)?FOREIGN\s+KEY\s*\([^)]*\)\s*REFERENCES\s+{_SQL_QUAL}{_SQL_NAME}"
    both = f.select("path", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(fk), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(fk), F.lit(2)).alias("b"))).alias("x"))
    table = lambda c: make_id(F.concat(F.lit("sql_table:"), normalize_sql_ident(F.col(c))))
    edges = both.select("path", table("x.a").alias("source"), table("x.b").alias("target"), F.lit("references").alias("relation"))
    return nodes.withColumn("source_file", F.col("path")), edges


def mcp_servers(files: DataFrame) -> DataFrame:
    """Servers and commands of MCP configurations; text that is no JSON gives none."""
    m = files.filter("language = 'mcp_config'").select("path", F.from_json("text", "mcpServers map<string, struct<command: string>>").alias("j"))
    each = m.select("path", F.explode(F.map_entries("j.mcpServers")).alias("e")).select("path", F.explode(F.array(F.struct(F.col("e.key").alias("label"), F.lit("mcp_server").alias("kind")), F.struct(F.col("e.value.command").alias("label"), F.lit("mcp_command").alias("kind")))).alias("x")).filter("x.label is not null")
    return each.select("path", make_id(F.concat_ws(":", "path", "x.kind", "x.label")).alias("id"), "x.label", "x.kind", F.col("path").alias("source_file"))


# --- parsers in workers ----------------------------------------------------


class Result:
    """What an extractor collects for one file."""

    def __init__(self, path: str):
        self.path = path
        self.file = make_id_text(path)
        self.nodes: list[dict] = []
        self.edges: list[tuple] = []
        self.calls: list[tuple] = []
        self.relations: list[tuple] = []
        self.warnings: list[str] = []
        self.ids: set[str] = set()
        self.node(path.rsplit("/", 1)[-1], "file", None, id_=self.file)

    def node(self, label: str, kind: str, loc: tuple | None, id_: str | None = None, **props: str) -> str:
        """Add a node; a name used before in the file gets its place as a suffix."""
        id_ = id_ or make_id_text(f"{self.path}:{label}")
        if id_ in self.ids and loc:
            id_ = make_id_text(f"{self.path}:{label}:{loc[0]}:{loc[1]}")
        base, n = id_, 2
        while id_ in self.ids:
            id_, n = f"{base}_{n}", n + 1
        self.ids.add(id_)
        self.nodes.append({"id": id_, "label": label, "kind": kind, "loc": loc and dict(zip(("start_line", "start_column", "end_line", "end_column"), loc, strict=True)), "properties": list(props.items())})
        return id_

    def stub(self, spec: str, item: str = "", relation: str = "imports_from", prefix: str = "import") -> None:
        """An import to be bound later: a module, or an item of one."""
        id_ = make_id_text(f"{prefix}-{'symbol' if item else 'module'}:{spec}:{item}")
        if id_ not in self.ids:
            self.ids.add(id_)
            self.nodes.append({"id": id_, "label": item or spec, "kind": "import" if item else "module", "loc": None, "properties": [("import_path", spec), *([("item", item)] if item else [])]})
        self.edges.append((self.file, id_, relation))


def extract_python(path: str, text: str) -> Result:
    """Classes, functions, methods, imports and calls, from the syntax tree."""
    r = Result(path)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        r.warnings.append(f"{path}: {e}")
        return r
    here = path.rsplit("/", 1)[0] if "/" in path else ""

    def module(name: str | None, level: int) -> str:
        parts = here.split("/") if here else []
        base = parts[: len(parts) - level + 1] if level else []
        return "/".join([*base, *(name.split(".") if name else [])])

    def walk(body, owner: str, kind: str, depth: int) -> None:
        if depth > 200:
            r.warnings.append(f"{path}: nested too deeply")
            return
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(n, ast.ClassDef)
                id_ = r.node(n.name, "class" if is_class else "function", (n.lineno, n.col_offset, n.end_lineno, n.end_col_offset))
                r.edges.append((owner, id_, "method" if kind == "class" and not is_class else "contains"))
                if is_class:
                    for b in n.bases:
                        if isinstance(b, (ast.Name, ast.Attribute)):
                            r.relations.append((id_, b.id if isinstance(b, ast.Name) else b.attr, "inherits", "base", True))
                walk(n.body, id_, "class" if is_class else "function", depth + 1)
            elif isinstance(n, ast.Import):
                for a in n.names:
                    r.stub(a.name.replace(".", "/"), relation="imports_from")
            elif isinstance(n, ast.ImportFrom):
                spec = module(n.module, n.level)
                r.stub(spec)
                for a in n.names:
                    if a.name != "*":
                        r.stub(spec, a.name, "imports")
            else:
                if kind == "function":
                    calls(n, owner)
                inner = [x for f in ("body", "orelse", "finalbody", "handlers") for x in (getattr(n, f, None) or []) if isinstance(x, ast.AST)]
                walk([y for x in inner for y in (x.body if isinstance(x, ast.ExceptHandler) else [x])], owner, kind, depth + 1) if inner else None

    def calls(n: ast.AST, owner: str) -> None:
        todo = [n]
        while todo:
            x = todo.pop(0)
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(x, ast.Call):
                f = x.func
                if isinstance(f, ast.Name):
                    r.calls.append((owner, f.id, x.lineno, False))
                elif isinstance(f, ast.Attribute):
                    r.calls.append((owner, f.attr, x.lineno, True))
            # statements within are walked with their own owner
            todo += [c for c in ast.iter_child_nodes(x) if not isinstance(c, ast.stmt)]

    walk(tree.body, r.file, "file", 0)
    return r


_ID = r"[A-Za-z_$][\w$]*"
#: By language: patterns of classes, types, functions and imports; a scanner's, not a grammar's.
SCANNERS: dict[str, dict[str, str]] = {
    "c": {"type": rf"\b(?:struct|union|enum)\s+({_ID})\s*\{{", "function": rf"^[A-Za-z_][\w\s\*]*?\b({_ID})\s*\([^;{{}}]*\)\s*\{{", "import": r'^\s*#\s*include\s*[<"]([^>"]+)[>"]'},
    "cpp": {"class": rf"\b(?:class|struct)\s+({_ID})[^;{{]*\{{", "function": rf"^[A-Za-z_][\w\s\*&:<>,~]*?\b({_ID})\s*\([^;{{}}]*\)[\w\s]*\{{", "import": r'^\s*#\s*include\s*[<"]([^>"]+)[>"]'},
    "java": {"class": rf"\b(?:class|interface|enum|record)\s+({_ID})", "function": rf"^\s*(?:[\w<>\[\],.@]+\s+)+({_ID})\s*\([^;{{}}]*\)[\w\s,.]*\{{"},
    "csharp": {"class": rf"\b(?:class|interface|struct|namespace|record)\s+({_ID})", "function": rf"^\s*(?:[\w<>\[\],.?]+\s+)+({_ID})\s*\([^;{{}}]*\)\s*(?:\{{|=>)"},
    "ruby": {"class": r"^\s*(?:class|module)\s+([A-Z]\w*)", "function": r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)"},
    "kotlin": {"class": rf"\b(?:class|interface|object)\s+({_ID})", "function": rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?({_ID})\s*\("},
    "scala": {"class": rf"\b(?:class|trait|object)\s+({_ID})", "function": rf"\bdef\s+({_ID})"},
    "go": {"type": rf"^type\s+({_ID})\s+(?:struct|interface)", "function": rf"^func\s+(?:\([^)]*\)\s*)?({_ID})\s*\(", "import": r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\s]+)"\s*$'},
    "rust": {"type": rf"\b(?:struct|enum|trait|union)\s+({_ID})", "function": rf"\bfn\s+({_ID})", "import": r"^\s*(?:pub\s+)?use\s+([A-Za-z0-9_:]+)"},
    "groovy": {"class": rf"\b(?:class|interface|trait)\s+({_ID})", "function": rf"^\s*(?:def|[\w<>\[\]]+)\s+({_ID})\s*\([^;{{}}]*\)\s*\{{"},
    "javascript": {"class": rf"\bclass\s+({_ID})", "function": rf"(?:\bfunction\s*\*?\s*({_ID})\s*\(|\b(?:const|let|var)\s+({_ID})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{_ID})\s*=>)", "import": r"""(?:\bfrom\s*|\bimport\s*|\brequire\(\s*)["']([^"']+)["']"""},
}
SCANNERS["typescript"] = SCANNERS["tsx"] = SCANNERS["javascript"] | {"type": rf"\b(?:interface|enum|type)\s+({_ID})\s*[<={{]"}
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "sizeof", "function", "def", "fn", "func", "fun", "new", "else", "do", "try", "with", "match", "case", "using", "lock", "throw", "await", "super", "this", "class", "import", "require"}
_CALL = re.compile(rf"(\.|->|::)?\s*\b({_ID})\s*\(")


def scan_by_pattern(language: str, path: str, text: str) -> Result:
    """Declarations, calls and imports by pattern: no types, no overloads, scopes by the last declaration above."""
    r = Result(path)
    rules = SCANNERS[language]
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    import bisect

    def place(at: int) -> tuple[int, int]:
        k = bisect.bisect_right(starts, at) - 1
        return k + 1, at - starts[k]

    found = []
    for kind in ("class", "type", "function"):
        if kind in rules:
            for m in re.finditer(rules[kind], text, re.M):
                name = next((g for g in m.groups() if g), None)
                if name and name not in _KEYWORDS:
                    found.append((m.start(m.lastindex or 0), kind, name))
    found.sort()
    spans, owner = [], None
    for k, (at, kind, name) in enumerate(found):
        end = found[k + 1][0] if k + 1 < len(found) else len(text)
        line, col = place(at)
        id_ = r.node(name, kind, (line, col, max(line, place(max(at, end - 1))[0]), 0))
        indent = len(text[starts[line - 1] :]) - len(text[starts[line - 1] :].lstrip(" \t"))
        if kind == "class":
            owner = (id_, indent)
            r.edges.append((r.file, id_, "contains"))
        else:
            method = kind == "function" and owner is not None and indent > owner[1]
            r.edges.append((owner[0] if method else r.file, id_, "method" if method else "contains"))
        spans.append((at, end, kind, id_, name))
    for at, end, kind, id_, name in spans:
        if kind == "function":
            for m in _CALL.finditer(text, at, end):
                if m[2] not in _KEYWORDS and not (m.start(2) == at and m[2] == name):
                    r.calls.append((id_, m[2], place(m.start(2))[0], bool(m[1]) and m[1] != "::"))
    if "import" in rules:
        here = path.rsplit("/", 1)[0] if "/" in path else ""
        import posixpath

        for m in re.finditer(rules["import"], text, re.M):
            spec = m[1]
            if language == "rust":
                spec = re.sub(r"^(crate|self|super)::", "", spec).replace("::", "/")
            elif spec.startswith("."):
                spec = posixpath.normpath(posixpath.join(here, spec))
            r.stub(spec, relation="imports" if language in ("c", "cpp", "go") else "imports_from")
    return r


#: Parsers by language: (path, text) to :class:`Result`.  Register a grammar's here to replace a scanner.
REGISTRY: dict[str, Callable[[str, str], Result]] = {"python": extract_python} | {lang: (lambda path, text, lang=lang: scan_by_pattern(lang, path, text)) for lang in SCANNERS}


def extract(files: DataFrame) -> DataFrame:
    """(path, nodes, edges, calls, relations, warnings) of files (path, language, text) whose language has a parser.

    A failing parser makes a warning, not a failed job.
    """
    parsers = REGISTRY
    fields = RESULT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    r = parsers[lang](path, text or "")
                except Exception as e:  # one file's fault
                    r = Result(path)
                    r.warnings.append(f"{path}: {type(e).__name__}: {e}")
                rows.append({
                    "path": path, "nodes": r.nodes, "edges": [dict(zip(("source", "target", "relation"), e, strict=True)) for e in r.edges],
                    "calls": [dict(zip(("caller_id", "callee_label", "line", "is_member_call"), c, strict=True)) for c in r.calls],
                    "relations": [dict(zip(("source_id", "target_label", "relation", "context", "allow_same_file"), x, strict=True)) for x in r.relations], "warnings": r.warnings,
                })
            yield pa.RecordBatch.from_pylist(rows, schema=arrow) if rows else pa.RecordBatch.from_pylist([], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(f"path string, {fields}"))
    return files.filter(F.col("language").isin(*parsers)).select("path", "language", "text").mapInArrow(run, f"path string, {fields}")


def flatten(extractions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, calls, relations) with ordinals: files in path order, then each file's own order."""
    from .base import settle
    from .merge import renumber

    rank = renumber(extractions.select(F.col("path").alias("ord"), "path")).select("path", ((F.col("ord") + 1) * (1 << 24)).alias("base"))
    x = settle(extractions.join(rank, "path"))
    at = lambda c: x.select("path", "base", F.posexplode(c).alias("k", "x")).select((F.col("base") + F.col("k")).alias("ord"), "path", "x.*")
    n = at("nodes").withColumnRenamed("path", "source_file").withColumn("source_file", F.when(F.col("kind").isin("module", "import"), "").otherwise(F.col("source_file")))
    c = at("calls").withColumnRenamed("path", "source_file").withColumn("loc", F.col("line"))
    return n, at("edges").drop("path"), c, at("relations").withColumnRenamed("path", "source_file")


def unextracted(files: DataFrame) -> DataFrame:
    """(language, n) of files of known language that nothing parses."""
    done = [*REGISTRY, *PATTERNS, "sql", "mcp_config"]
    return files.filter(F.col("language").isNotNull() & ~F.col("language").isin(done)).groupBy("language").agg(F.count("*").alias("n"))


def offset_line(text: Column, offset: Column) -> Column:
    return line_of(text, offset)
