"""Entity resolution: exact and fuzzy duplicates of nodes become one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fuzzy_merge_blocked, has_meaningful_entropy, jaro_winkler, lsh_bands, make_id, minhash, shingles
from .base import few, settle
from .merge import rewrite_edges
from .traverse import components

ENTROPY, APART, TOGETHER = 2.5, 0.92, 0.88


def _prepared(nodes: DataFrame) -> DataFrame:
    """Nodes that take part, with their normal label, made once for each distinct label."""
    norm = nodes.select("label").distinct().withColumn("norm", make_id(F.col("label")))
    site = F.when(F.col("loc").isNotNull(), F.concat_ws(":", F.col("loc.start_line"), F.col("loc.start_column"))).otherwise(F.lit(""))
    community = F.coalesce(F.element_at("properties", F.lit("community")), F.lit("")) if "community" not in nodes.columns else F.coalesce("community", F.lit(""))
    return nodes.filter("kind <> 'file'").join(norm, "label").select("ord", "id", "label", "kind", "source_file", "norm", site.alias("site"), community.alias("community"))


def exact_pairs(prepared: DataFrame) -> DataFrame:
    """(a, b): each node with the first of its label, file and place; nodes without a file don't take part."""
    w = Window.partitionBy("norm", "source_file", "site")
    return prepared.filter("source_file <> ''").select(F.min("ord").over(w).alias("a"), F.col("ord").alias("b")).filter("a <> b")


def fuzzy_pairs(prepared: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(a, b) of labels that are near: candidates share a band of their MinHash or a community.

    Labels, not nodes, are banded and compared, each distinct pair once.  Nodes
    that the rules for places can't tell apart make a class, and classes meet
    under those rules: a pair of classes is told by the first node of either,
    and a class with any pair by its first node with each of the others, as
    all of it hangs together then.
    """
    telling = settle(prepared.select("norm").distinct().filter(has_meaningful_entropy(F.col("norm"), ENTROPY)))
    ok = prepared.join(few(telling), "norm", "left_semi")
    if scope is not None:
        ok = ok.join(scope.select("ord").distinct().withColumn("_in", F.lit(True)), "ord", "left").withColumn("hit", F.coalesce("_in", F.lit(False)))
    else:
        ok = ok.withColumn("hit", F.lit(True))
    alike = ["norm", "kind", "source_file", "site", "community", "hit"]
    ok = settle(ok.select("ord", *alike))
    classes = settle(ok.groupBy(*alike).agg(F.min("ord").alias("first"), F.count("*").alias("n")))
    nodes, ok = ok, classes  # from here on a class stands for its nodes
    labels = ok.select("norm").distinct()
    banded = labels.select("norm", F.posexplode(lsh_bands(minhash(shingles(F.col("norm"))))).alias("k", "band"))
    l, r = (banded.select(F.col("norm").alias(c), "k", "band") for c in ("x", "y"))
    cand = l.join(r, ["k", "band"]).filter("x < y").select("x", "y").distinct()
    mates = ok.filter("community <> ''").select("norm", "community").distinct()
    near = mates.select(F.col("norm").alias("x"), "community").join(mates.select(F.col("norm").alias("y"), "community"), "community").filter("x < y").select("x", "y").distinct()
    scored = cand.union(near).distinct().withColumn("jw", jaro_winkler(F.col("x"), F.col("y"))).filter(F.col("jw") >= TOGETHER)
    scored = scored.filter(~fuzzy_merge_blocked(F.col("x"), F.col("y"), F.col("jw")))
    # equal labels merge too, unless a source says that they are two
    same = labels.select(F.col("norm").alias("x"), F.col("norm").alias("y"), F.lit(1.0).alias("jw"))
    side = lambda c: ok.select(*[F.col(k).alias(f"{k}_{c}") for k in (*alike, "first", "n")])
    p = scored.unionByName(same).join(side("a"), F.col("x") == F.col("norm_a")).join(side("b"), F.col("y") == F.col("norm_b"))
    p = p.filter("(hit_a or hit_b) and (x <> y or first_a < first_b or first_a = first_b and n_a > 1)")
    together = (F.col("community_a") == F.col("community_b")) & (F.col("community_a") != "")
    sourced = lambda c: F.col(f"source_file_{c}") != ""
    prose = F.lower("kind_a").isin("document", "media") | F.lower("kind_b").isin("document", "media")
    same_file = (F.col("source_file_a") == F.col("source_file_b")) & sourced("a")
    blocked = (
        (sourced("a") != sourced("b")) | ((F.col("x") == F.col("y")) & sourced("a")) | (prose & ~same_file)
        | ((F.col("site_a") != "") & (F.col("site_b") != "") & ((F.col("source_file_a") != F.col("source_file_b")) | (F.col("site_a") != F.col("site_b"))))
    )
    p = p.filter((F.col("jw") >= F.when(together, TOGETHER).otherwise(APART)) & ~blocked)
    p = settle(p.select("first_a", "first_b"))
    linked = p.select(F.explode(F.array("first_a", "first_b")).alias("first")).distinct()
    many = classes.filter("n > 1").join(linked, "first", "left_semi").select("first", *[F.col(c).alias(f"_{c}") for c in alike])
    within = nodes.join(many, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in alike]).select(F.col("first").alias("first_a"), F.col("ord").alias("first_b"))
    return p.union(within).filter("first_a <> first_b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")).distinct()


def deduplicate(nodes: DataFrame, edges: DataFrame, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after merging: of each component the first node stays as it is.

    Pairs don't depend on what has been merged, so the components of all pairs
    are the result of merging one after the other.  Edges are mapped and made
    distinct; self-loops stay.  With ``scope`` (ord) only pairs that touch it
    are made.
    """
    p = _prepared(nodes)
    exact = exact_pairs(p)
    if scope is not None:
        exact = exact.join(scope.select(F.col("ord").alias("b")), "b", "left_semi").select("a", "b")
    root = components(nodes, exact.union(fuzzy_pairs(p, scope)))
    at = nodes.select("ord", "id").join(root, "ord")
    remap = at.filter("ord <> root").join(nodes.select(F.col("ord").alias("root"), F.col("id").alias("new")), "root").select(F.col("id").alias("old"), "new").filter("old <> new")
    kept = nodes.join(root.filter("ord = root").select("ord"), "ord", "left_semi").select(*nodes.columns)
    return kept, rewrite_edges(edges, remap)
