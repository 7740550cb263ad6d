"""The driver's tables as one graph: regions, nations, customers, suppliers, parts and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (table, kind, key, label): the order is that of the nodes' ordinals.
_KINDS = [
    ("region", "region", "r_regionkey", "r_name"),
    ("nation", "nation", "n_nationkey", "n_name"),
    ("customer", "customer", "c_custkey", "c_name"),
    ("supplier", "supplier", "s_suppkey", "s_name"),
    ("part", "part", "p_partkey", "p_name"),
    ("orders", "order", "o_orderkey", "concat('Order#', o_orderkey)"),
]
_STEP = 1 << 40

NODES_SQL = " union all ".join(
    f"select {k}::bigint * {_STEP} + {key}::bigint as ord, '{kind}:' || {key} as id, {label.replace('concat(', '').replace(', o_orderkey)', ' || o_orderkey') if 'concat' in label else label} as label, '{kind}' as kind, '{t}' as source_file from {t}"
    for k, (t, kind, key, label) in enumerate(_KINDS)
)
EDGES_SQL = """
select 'nation:' || n_nationkey as source, 'region:' || n_regionkey as target, 'PART_OF' as relation from nation
union select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'IN_NATION' from customer
union select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IN_NATION' from supplier
union select 'order:' || o_orderkey, 'customer:' || o_custkey, 'PLACED_BY' from orders
union select 'order:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS' from lineitem
union select 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY' from lineitem"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, id, label, kind, source_file; ordinals by kind, then key, without a global sort."""
    parts = [
        spark.read.parquet(f"{sf_dir}/{t}.parquet").select(
            (F.lit(k * _STEP) + F.col(key).cast("long")).alias("ord"), F.concat(F.lit(f"{kind}:"), F.col(key)).alias("id"), F.expr(label).alias("label"), F.lit(kind).alias("kind"), F.lit(t).alias("source_file")
        )
        for k, (t, kind, key, label) in enumerate(_KINDS)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    """source, target, relation, all distinct; only ``lineitem`` can repeat one.

    With ``repeated`` repeats stay, for what they make no difference to: no row is shuffled to find them.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")

    def edge(t: str, a: str, ak: str, b: str, bk: str, relation: str, distinct: bool = False) -> DataFrame:
        df = read(t).select(ak, bk)
        df = df.distinct() if distinct and not repeated else df
        return df.select(F.concat(F.lit(f"{a}:"), F.col(ak)).alias("source"), F.concat(F.lit(f"{b}:"), F.col(bk)).alias("target"), F.lit(relation).alias("relation"))

    out = edge("nation", "nation", "n_nationkey", "region", "n_regionkey", "PART_OF")
    for e in (
        edge("customer", "customer", "c_custkey", "nation", "c_nationkey", "IN_NATION"),
        edge("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "IN_NATION"),
        edge("orders", "order", "o_orderkey", "customer", "o_custkey", "PLACED_BY"),
        edge("lineitem", "order", "l_orderkey", "part", "l_partkey", "CONTAINS", True),
        edge("lineitem", "part", "l_partkey", "supplier", "l_suppkey", "SUPPLIED_BY", True),
    ):
        out = out.unionByName(e)
    return out
