"""Documents and code: links, enrichment plans, fragments and their cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_capitalized, is_compound_identifier, leading_identifier
from .base import top_by

#: Names that more nodes share are no evidence; links of a document at most; kinds of types.
SHARED, LINKS, TYPES = 8, 10, ("class", "type", "interface", "enum")
#: Files and bytes of a chunk of work.
CHUNK_FILES, CHUNK_BYTES = 8, 1 << 20


def symbol_index(nodes: DataFrame) -> DataFrame:
    """(name, id, type_like): what a document may call a node."""
    first = [F.col("ord")] if "ord" in nodes.columns else []
    return nodes.filter("kind <> 'file'").select(*first, leading_identifier(F.col("label")).alias("name"), "id", F.col("kind").isin(*TYPES).alias("type_like")).filter("name <> ''")


def doc_links(docs: DataFrame, symbols: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, name, id, rank): code that documents (key, text) name.

    A token of two letters and more counts if at most ``SHARED`` nodes have the
    name and it is compound, or capitalised and a type.  Names of few nodes
    come first, then long ones; ``LINKS`` links of a document count, those of one
    name in the nodes' order.  Tokens meet names in one equi-join, the names
    being counted before.
    """
    names = symbols.groupBy("name").agg(F.count("*").alias("n"), F.max("type_like").alias("typed")).filter(F.col("n") <= SHARED)
    good = names.filter((F.char_length("name") >= 2) & (is_compound_identifier(F.col("name")) | (is_capitalized(F.col("name")) & F.col("typed"))))
    tokens = docs.select(F.col(key).alias("doc"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("name"))
    hit = tokens.join(good, "name")
    first = ["ord"] if "ord" in symbols.columns else []
    links = hit.join(symbols.select("name", "id", *first), "name")
    return top_by(links, ["doc"], LINKS, F.col("n"), F.desc(F.char_length("name")), F.col("name"), *map(F.col, first), F.col("id"), rank="rank").select("doc", "name", "id", "rank")


def plan_chunks(files: DataFrame, group: str | None = None) -> DataFrame:
    """(path, chunk): files in path order, a new chunk at ``CHUNK_FILES`` files or beyond ``CHUNK_BYTES``.

    The rule is sequential; a fold over each group's sorted list applies it.
    Groups (``group``, else the first directory) are planned on their own, so
    that no list is of all files.
    """
    g = F.col(group) if group else F.regexp_extract("path", "^([^/]*/)?", 1)
    rows = files.select(g.alias("grp"), F.struct("path", "size").alias("f")).groupBy("grp").agg(F.sort_array(F.collect_list("f")).alias("fs"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("bytes"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        fresh = (a["n"] > 0) & ((a["n"] >= CHUNK_FILES) | (a["bytes"] + x["size"] > CHUNK_BYTES))
        chunk = F.when(fresh, a["chunk"] + 1).otherwise(a["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(fresh, 1).otherwise(a["n"] + 1).alias("n"), F.when(fresh, x["size"]).otherwise(a["bytes"] + x["size"]).alias("bytes"), F.concat(a["out"], F.array(chunk)).alias("out"))

    done = rows.withColumn("out", F.aggregate("fs", start, step, lambda a: a["out"]))
    return done.select("grp", F.explode(F.arrays_zip("fs", "out")).alias("x")).select("grp", F.col("x.fs.path").alias("path"), F.col("x.out").alias("chunk"))


FRAGMENT_FIELDS = {"nodes": ("id", "label"), "edges": ("source", "target", "relation"), "hyperedges": ("id", "relation", "nodes")}


def _lacks(items, field: str):
    """Whether any entry is without a field of the right kind."""
    kind = "array<variant>" if field == "nodes" else "string"
    return F.exists(items, lambda x: F.try_variant_get(x, f"$.{field}", kind).isNull())


def validate_fragments(files: DataFrame) -> DataFrame:
    """(path, errors) of fragment files (path, text): accepted where ``errors`` is empty.

    Text that is no JSON object, a list that is missing or none, and entries
    without a required field each make an error that names the path.
    """
    v = F.try_parse_json("text")
    errors = []
    for part, fields in FRAGMENT_FIELDS.items():
        items = F.try_variant_get(F.col("v"), f"$.{part}", "array<variant>")
        there = F.expr(f"variant_get(v, '$.{part}', 'variant') is not null and not is_variant_null(variant_get(v, '$.{part}', 'variant'))")
        if part == "hyperedges":
            errors.append(F.when(there & items.isNull(), F.concat("path", F.lit(f": {part} is no list"))))
        else:
            errors.append(F.when(items.isNull(), F.concat("path", F.lit(f": {part} is missing"))))
        for f in fields:
            errors.append(F.when(_lacks(items, f), F.concat("path", F.lit(f": {part} without {f}"))))
    checked = files.withColumn("v", v)
    bad = F.array(F.concat("path", F.lit(": no JSON object")))
    ok = F.expr("v is not null and schema_of_variant(v) like 'OBJECT%'")
    return checked.select("path", F.when(ok, F.filter(F.array(*errors), lambda e: e.isNotNull())).otherwise(bad).alias("errors"))


def cache_states(records: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, fragment, valid) of cached enrichment (source, sha256, fragment, node_id).

    A record is valid if its source is there with the same hash and its node
    exists; one bad record makes its fragment's others bad too.
    """
    f = files.select(F.col("path").alias("source"), F.col("sha256").alias("now"))
    r = records.join(f, "source", "left").join(nodes.select(F.col("id").alias("node_id"), F.lit(True).alias("there")), "node_id", "left")
    r = r.withColumn("ok", F.coalesce((F.col("now") == F.col("sha256")) & F.col("there"), F.lit(False)))
    return r.select("source", "fragment", F.min("ok").over(Window.partitionBy("fragment")).alias("valid"))


def external_dependencies(nodes: DataFrame, edges: DataFrame, hashes: DataFrame) -> DataFrame:
    """(source, id, source_file, sha256) of the nodes outside a fragment that its edges need; null hash: not to be had."""
    ends = edges.select("source", F.explode(F.array("source", "target")).alias("id")).distinct()
    out = ends.join(nodes.select("id", "source_file"), "id", "left")
    return out.join(hashes.select(F.col("path").alias("source_file"), "sha256"), "source_file", "left").select("source", "id", "source_file", "sha256")
