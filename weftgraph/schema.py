"""Tables of the graph.

``ord`` is the place of first occurrence; every operator that says "first" means
the least ``ord``.  An absent text is the empty string, never null.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOC = "struct<start_line: int, start_column: int, end_line: int, end_column: int>"
NODES = f"ord long, id string, label string, kind string, source_file string, loc {LOC}, confidence string, confidence_score double, properties map<string,string>"
EDGES = "ord long, source string, target string, relation string, confidence string, confidence_score double, properties map<string,string>"
HYPEREDGES = "ord long, id string, members array<string>, relation string, confidence string, confidence_score double, properties map<string,string>"
RAW_CALLS = f"ord long, caller_id string, callee_label string, source_file string, loc {LOC}, is_member_call boolean"
RAW_RELATIONS = "ord long, source_id string, target_label string, relation string, context string, source_file string, allow_same_file boolean"
FILES = "path string, language string, size long, mtime long, sha256 string, state string"

CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")

_DEFAULTS = {
    "nodes": {"label": "id", "kind": "''", "source_file": "''", "loc": f"cast(null as {LOC})", "confidence": "'EXTRACTED'", "confidence_score": "cast(null as double)", "properties": "cast(map() as map<string,string>)"},
    "edges": {"confidence": "'EXTRACTED'", "confidence_score": "cast(null as double)", "properties": "cast(map() as map<string,string>)"},
}


def conform(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a table of nodes or edges: missing columns get their defaults, others stay behind."""
    want = [c.split(" ", 1)[0] for c in {"nodes": NODES, "edges": EDGES}[kind].replace(LOC, "loc").split(", ")]
    return df.select(*[F.col(c) if c in df.columns else F.expr(_DEFAULTS[kind][c]).alias(c) for c in want])


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
