"""Source trees as tables: scan, classify, ignore, hash, compare with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import ascii_lower, lit_array, merkle_inner, merkle_leaf

LARGEST = 8 << 20

#: Languages by file suffix.
EXTENSIONS = {
    "c": [".c", ".h"], "cpp": [".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx"], "csharp": [".cs"], "apex": [".cls", ".trigger"], "go": [".go"], "rust": [".rs"],
    "groovy": [".groovy", ".gvy", ".gradle"], "java": [".java"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "kotlin": [".kt", ".kts"], "delphi": [".pas", ".pp", ".dpr", ".lfm", ".dfm"],
    "python": [".py", ".pyw"], "ruby": [".rb"], "scala": [".scala", ".sc"], "typescript": [".ts"], "tsx": [".tsx"], "sql": [".sql"], "xml": [".xml"],
}
#: Names of MCP configurations, and endings of MSBuild files.
MCP_NAMES = ["mcp.json", ".mcp.json", "mcp_config.json", "mcp-server.json", "mcp-servers.json"]
MSBUILD = [".csproj", ".vbproj", ".fsproj", ".vcxproj", ".props", ".targets"]
#: Names of languages.
LANGUAGE_NAMES = {
    "c": "C", "cpp": "C++", "csharp": "C#", "apex": "Apex", "go": "Go", "rust": "Rust", "groovy": "Groovy", "java": "Java", "javascript": "JavaScript", "kotlin": "Kotlin", "delphi": "Delphi",
    "python": "Python", "ruby": "Ruby", "scala": "Scala", "typescript": "TypeScript", "tsx": "TSX", "sql": "SQL", "xml": "XML", "php_blade": "PHP Blade", "mcp_config": "MCP config", "msbuild": "MSBuild",
}
#: Directories that hold no source of the project.
SKIPPED = [
    ".git", ".hg", ".svn", ".cache", ".idea", ".vscode", ".agents", "build", "cmake-build-debug", "cmake-build-release", "coverage", "dist", ".next", "node_modules", "target", "vendor", "weftgraph-out",
    ".venv", "venv", "site-packages", "__pycache__", ".tox", ".nox", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".hypothesis", ".eggs",
    ".claude", ".codex", ".gemini", ".cursor", ".factory", ".opencode", ".windsurf", ".aider", ".specify",
]
#: Suffixes of documents and of media.
DOCUMENTS = [".md", ".markdown", ".mdx", ".rst", ".txt", ".adoc", ".org", ".pdf", ".doc", ".docx"]
MEDIA = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".mp3", ".wav", ".m4a", ".mp4", ".mov", ".webm"]


def suffix(path: Column) -> Column:
    return ascii_lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def language(path: Column) -> Column:
    """Language of a file by its name; null if unknown."""
    name = ascii_lower(F.regexp_extract(path, "([^/]*)$", 1))
    out = F.when(name.endswith(".blade.php"), "php_blade").when(name.isin(MCP_NAMES), "mcp_config")
    ends = F.lit(False)
    for s in MSBUILD:
        ends = ends | name.endswith(s)
    out = out.when(ends, "msbuild")
    for lang, exts in EXTENSIONS.items():
        out = out.when(suffix(path).isin(exts), lang)
    return out


def language_name(lang: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv]), lang)


def kind_of_file(path: Column) -> Column:
    """``code``, ``document``, ``media`` or null, as the watcher and the enrichment plan tell them apart."""
    return F.when(language(path).isNotNull(), "code").when(suffix(path).isin(DOCUMENTS), "document").when(suffix(path).isin(MEDIA), "media")


def _dirs(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def in_skipped_directory(path: Column) -> Column:
    """A directory by name, or ``worktrees`` under one that begins with a dot."""
    d = _dirs(path)
    return F.exists(d, lambda x: x.isin(SKIPPED)) | path.rlike(r"(^|/)\.[^/]*/worktrees/")


def without_dependencies(files: DataFrame) -> DataFrame:
    """Files outside skipped directories, and outside trees marked by ``pyvenv.cfg`` or a ``.git`` file.

    A file meets the marked directories through its own parents, by equality.
    """
    kept = files.filter(~in_skipped_directory(F.col("path")))
    marks = files.filter(F.col("path").rlike(r"/pyvenv\.cfg$|/\.git$")).select(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).distinct()
    parents = kept.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(_dirs(F.col("path")))), lambda i: F.array_join(F.slice(_dirs(F.col("path")), 1, i), "/"))).alias("dir")).filter("dir <> ''")
    lost = parents.join(marks, "dir", "left_semi").select("path").distinct()
    return kept.join(lost, "path", "left_anti")


def read_gitignore(text: str) -> list[tuple[str, bool, bool]]:
    """(pattern, anchored, has a slash) of a root ignore file; comments and negations are left out, globs are not known."""
    out = []
    for line in text.splitlines():
        p = line.strip()
        if not p or p[0] in "#!":
            continue
        anchored = p.startswith("/")
        p = p.strip("/")
        if p:
            out.append((p, anchored, "/" in p))
    return out


def ignored(path: Column, patterns: list[tuple[str, bool, bool]]) -> Column:
    """Whether a simple ignore file takes a path: by file name, by directory or by prefix."""
    prefixes = [p for p, _, _ in patterns]
    names = [p for p, anchored, slash in patterns if not anchored and not slash]
    under = F.exists(lit_array(prefixes), lambda p: (path == p) | path.startswith(F.concat(p, F.lit("/")))) if prefixes else F.lit(False)
    inside = F.exists(F.split(path, "/"), lambda x: x.isin(names)) if names else F.lit(False)
    return under | inside


def scan(spark: SparkSession, root: str, gitignore: str = "") -> DataFrame:
    """(path, language, size, mtime, content, state) of a tree's files of known language.

    ``state`` is ``too_large`` beyond ``LARGEST`` bytes, and the content null.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = "^.*?" + root.rstrip("/").split(":")[-1].lstrip("/").replace(".", "\\.") + "/"
    files = raw.select(F.regexp_replace("path", top, "").alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"), F.when(F.col("length") <= LARGEST, F.col("content")).alias("content"))
    files = without_dependencies(files).filter(~ignored(F.col("path"), read_gitignore(gitignore)))
    return files.withColumn("language", language(F.col("path"))).withColumn("state", F.when(F.col("content").isNull(), "too_large").otherwise("read"))


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", F.sha2("content", 256))


def content_root(files: DataFrame) -> DataFrame:
    """One row (algorithm, sha256, leaf_count): the Merkle root over (path, sha256) in path order.

    Leaves are numbered; each level joins a node with its right neighbour by
    half its number, and an odd last one goes up as it is: log2(n) small plans.
    """
    from ..operators.base import settle
    from ..operators.merge import renumber

    n = files.count()
    leaves = files.select(F.col("path").alias("ord"), merkle_leaf(F.col("path"), F.col("sha256")).alias("h"))
    level = renumber(leaves).select(F.col("ord").alias("k"), "h") if n else None
    size = n
    while size > 1:
        two = level.groupBy(F.floor(F.col("k") / 2).alias("k")).agg(F.max(F.when(F.col("k") % 2 == 0, F.col("h"))).alias("l"), F.max(F.when(F.col("k") % 2 == 1, F.col("h"))).alias("r"))
        level = settle(two.select("k", F.coalesce(merkle_inner(F.col("l"), F.col("r")), "l").alias("h")))
        size = -(-size // 2)
    if not n:
        return files.sparkSession.range(1).select(F.lit("sha256-merkle-v1").alias("algorithm"), F.sha2(F.unhex(F.lit("02")), 256).alias("sha256"), F.lit(0).cast("long").alias("leaf_count"))
    return level.select(F.lit("sha256-merkle-v1").alias("algorithm"), F.col("h").alias("sha256"), F.lit(n).cast("long").alias("leaf_count"))


def classify_changes(now: DataFrame, manifest: DataFrame, content: bool = True) -> DataFrame:
    """(path, change): New, StatHit, HashHit, Stale, Unreadable or Deleted.

    ``content`` compares hashes even where size and time agree.
    """
    a = now.select("path", *[F.col(c).alias(f"n_{c}") for c in ("size", "mtime", "sha256")], F.lit(True).alias("here"))
    b = manifest.select("path", *[F.col(c).alias(f"m_{c}") for c in ("size", "mtime", "sha256")], F.lit(True).alias("was"))
    same_stat = (F.col("n_size") == F.col("m_size")) & (F.col("n_mtime") == F.col("m_mtime"))
    change = (
        F.when(F.col("here").isNull(), "Deleted").when(F.col("was").isNull(), "New").when(F.lit(not content) & same_stat, "StatHit")
        .when(F.col("n_sha256").isNull(), "Unreadable").when(F.col("n_sha256") == F.col("m_sha256"), "HashHit").otherwise("Stale")
    )
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def tree_matches(now: DataFrame, manifest: DataFrame) -> bool:
    """Whether the same paths have the same hashes."""
    return classify_changes(now, manifest).filter("change <> 'HashHit'").isEmpty()


def synthetic_tree(spark: SparkSession, files: int) -> DataFrame:
    """(path, content): a project of ``files`` modules of four functions; each imports and calls its neighbours."""
    i = F.col("id")
    name = lambda k: F.format_string("mod_%05d", k % files)
    body = F.concat(
        F.lit("from "), name(i + 1), F.lit(" import f0 as a\nfrom "), name(i + 2), F.lit(" import f1 as b\n"),
        *[F.lit(f"\n\ndef f{k}():\n    return {'a() + b()' if k == 0 else f'f{k - 1}()'}\n") for k in range(4)],
    )
    return spark.range(files).select(F.concat(F.lit("pkg/"), name(i), F.lit(".py")).alias("path"), body.alias("content"))
