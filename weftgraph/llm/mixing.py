"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words (:func:`targets`); a document of a source
whose target is ``r`` times its size is due ``r`` copies.  The whole part of
``r`` is taken outright; the fraction is a probability that must become 0 or 1
without moving the source's total.  Pairs of documents pass *words* to each
other until one of the two is taken or left as a whole (the pivotal step,
weighted by size, so the source's sum of words is kept exactly), and the one
still fractional goes on to the next pair.  A reduction tree does this: blocks
of at most 63 documents are folded to one residual each, residuals make up the
blocks of the next level, until one is left per source, which goes to the
nearer end.  A source therefore ends within half a document of its target.

Only DataFrame expressions run; a level shuffles a few dozen bytes a document,
and each level is a 63rd of the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh, lookup, numbered, settle, word_count

#: Documents of a block: their picks fit into the bits of a long.
BLOCK = 63
#: Equal rows that are numbered at a time.
REPEATS = 10_000
_SEED = 20_240_611


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(_SEED), *parts), 11).cast("double") * F.lit(2.0**-53)


def _crc(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Words due from each source: ``sources`` (source, source_size) gains ``sid`` and ``target``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` times all words by weight; none gets more than ``cap`` times its
    own, what is left over going to the others by weight.  The fixed point has
    one level of words per weight unit below the caps, found from prefix sums
    over the sources in the order in which they reach their caps.  One row a
    source comes here, so the windows see only that.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("sid", F.row_number().over(rank).cast("long"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("_w", pick).withColumn("_cap", F.col("source_size").cast("double") * cap)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    s = s.withColumn("_total", F.sum("source_size").over(whole).cast("double") * share)
    s = s.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    s = s.withColumn("_open", F.col("_cap") / F.col("_w") > F.col("_level"))
    s = s.withColumn("_level", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("sid"), F.col("_level").alias("at")))).over(whole)["at"])
    due = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
    return s.withColumn("target", due).select("source", "sid", "source_size", "target", "n")


def _fold(level: int) -> Column:
    """Fold the sorted array ``items`` (h, size, mass, ...) by pivotal steps.

    Returns at (index of the one still open), size, mass, h and the bits of
    those taken.
    """
    first = F.element_at("items", 1)
    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("next"), first["size"].alias("size"), first["mass"].alias("mass"), first["h"].alias("h"), F.lit(0).cast("long").alias("ones"))

    def step(c: Column, x: Column) -> Column:
        up = F.least(c["size"] - c["mass"], x["mass"])
        down = F.least(c["mass"], x["size"] - x["mass"])
        raise_it = (up + down <= 0) | (_uniform(F.lit(level), c["h"], x["h"]) * (up + down) < down)
        both = c["mass"] + x["mass"]
        # what stays open, and whether the one that closes is taken
        keep = F.when(raise_it, c["size"] - c["mass"] > x["mass"]).otherwise(c["mass"] > x["size"] - x["mass"])
        take = F.when(raise_it, ~keep).otherwise(keep)
        mass = F.when(~take, both).when(keep, both - x["size"]).otherwise(both - c["size"])
        closed = F.when(keep, c["next"]).otherwise(c["at"])
        bit = F.when(take, F.expr("1L")).otherwise(F.expr("0L"))
        return F.struct(
            F.when(keep, c["at"]).otherwise(c["next"]).alias("at"),
            (c["next"] + 1).alias("next"),
            F.when(keep, c["size"]).otherwise(x["size"]).alias("size"),
            F.greatest(mass, F.lit(0.0)).alias("mass"),
            F.when(keep, c["h"]).otherwise(x["h"]).alias("h"),
            c["ones"].bitwiseOR(F.call_function("shiftleft", bit, closed)).alias("ones"),
        )

    return F.aggregate(F.slice("items", 2, BLOCK), start, step)


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """How often the mix takes each document.

    Returns doc_id, source, size (words), source_size, target (its source's
    words due), copies, taken (= size * copies) and text_crc32, a row for each
    row of ``docs``.

    Null or empty texts have size 0 and are taken ``floor(target/source_size)``
    times at no cost of words; a source without words has target 0.  Null
    sources are one source, null ids are ids like others, and equal rows are
    rounded each on its own.  The result depends on the rows alone, not on
    their order or partitions.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _crc(text).alias("text_crc32"))
    # equal rows are numbered, so that a row that is often repeated is not one block
    rows = settle(rows.groupBy("doc_id", "source", "size", "text_crc32").agg(F.count("*").alias("times")))
    src = settle(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("times")).otherwise(0)).alias("n")), weights, share, cap))
    n_src = src.count()
    # null-safe: sources are matched by their text, marked by whether there is one
    mark = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = numbered(rows, "times", "copy", REPEATS)
    h = F.xxhash64(F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("copy"))
    base = lookup(rows.withColumn("_k", mark).withColumn("h", h), src.withColumn("_k", mark).drop("source"), "_k", h).drop("_k")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio)
    base = base.select("*", whole.cast("int").alias("whole"), (ratio - whole).alias("_p"))
    kept = ["doc_id", "text_crc32", "sid", "size", "whole"]
    open_ = (F.col("_p") > 0) & (F.col("size") > 0)
    done = base.filter(~open_).select(*kept, F.lit(0).alias("pick"))
    cur = base.filter(open_).select(
        *kept, "h", (F.col("size") * F.col("_p")).alias("mass"),
        F.pmod(F.col("h"), F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1))).alias("block"),
    )
    level = 0
    while True:
        within = Window.partitionBy("sid", "block").orderBy("h", "doc_id", "mass")
        item = F.struct("h", "doc_id", "text_crc32", F.col("size").cast("double").alias("size"), "mass", "whole")
        folded = (
            cur.withColumn("sub", F.expr(f"(row_number() over (partition by sid, block order by h, doc_id, mass) - 1) div {BLOCK}"))
            .groupBy("sid", "block", "sub")
            .agg(F.sort_array(F.collect_list(item)).alias("items"))
            .withColumn("f", _fold(level))
            .select("sid", "block", "f", F.posexplode("items").alias("pos", "x"))
            .select(
                F.col("x.doc_id").alias("doc_id"), F.col("x.text_crc32").alias("text_crc32"), "sid", F.col("x.size").cast("long").alias("size"), F.col("x.whole").alias("whole"),
                F.col("x.h").alias("h"), F.col("f.mass").alias("mass"), F.floor(F.col("block") / BLOCK).alias("block"),
                (F.col("pos") == F.col("f.at")).alias("left"), F.expr("cast(shiftrightunsigned(f.ones, pos) & 1 as int)").alias("pick"),
            )
        )
        folded = settle(folded)
        done = done.unionByName(folded.filter(~F.col("left")).select(*kept, "pick"))
        rest = folded.filter(F.col("left")).drop("left", "pick")
        level += 1
        if rest.groupBy("sid").count().filter("count > 1").isEmpty():
            last = F.col("mass") * 2 >= F.col("size")
            done = done.unionByName(rest.select(*kept, F.when(last, 1).otherwise(0).alias("pick")))
            break
        cur = rest
    out = lookup(done, src.drop("n"), "sid", F.col("text_crc32")) if n_src else done.join(src.drop("n"), "sid")
    n = F.col("whole") + F.col("pick")
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", n.alias("copies"), (F.col("size") * n).cast("long").alias("taken"), "text_crc32")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mixed table: ``docs`` with each row as often as the mix takes it (not at all, once, ...).

    Rows that agree in id, source and text share their copies evenly, and of
    those the ones whose other columns come first by hash get what is over.
    Null ids, sources and texts are values like others, texts without words are
    taken as :func:`copies` says, and columns of any name are kept as they are.
    An empty table stays empty.
    """
    plan = copies(docs, doc_id, text, source, weights, share, cap)
    ident, of, crc, n, rows = (fresh(docs, c) for c in ("id", "source", "crc", "n", "rows"))
    key = [ident, of, crc]
    named = lambda c: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))
    sums = plan.groupBy(named(F.col("doc_id")).alias(ident), named(F.col("source")).alias(of), F.col("text_crc32").alias(crc)).agg(F.sum("copies").alias(n), F.count("*").alias(rows))
    sums = settle(sums.filter(F.col(n) > 0))
    keyed = docs.select("*", named(F.col(doc_id)).alias(ident), named(F.col(source)).alias(of), _crc(text).alias(crc))
    times = lambda df: df.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)
    out = times(keyed.join(sums.filter(F.col(rows) == 1), key))
    again = sums.filter(F.col(rows) > 1)
    if again.isEmpty():
        return out
    # rows that agree in all columns are one, taken as often as all of them
    kind, every, before, count = (fresh(docs, c) for c in ("kind", "every", "before", "count"))
    several = keyed.join(again.select(*key), key, "left_semi").withColumn(every, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    several = settle(several.withColumn(kind, F.xxhash64(F.to_json(every))).groupBy(*key, kind).agg(F.first(every).alias(every), F.count("*").alias(count)))
    shares = several.select(*key, kind, count).join(again, key)
    shares = shares.withColumn(before, F.sum(count).over(Window.partitionBy(*key).orderBy(kind)) - F.col(count))
    over = F.greatest(F.lit(0), F.least(F.col(count), F.col(n) % F.col(rows) - F.col(before)))
    shares = shares.withColumn(n, F.col(count) * F.floor(F.col(n) / F.col(rows)) + over).filter(F.col(n) > 0).select(*key, kind, n)
    return out.unionByName(times(several.join(shares, [*key, kind]).select(f"{every}.*", n)))
