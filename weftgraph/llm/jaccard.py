"""N-gram Jaccard join: near-duplicate documents by their word shingles.

Texts with the same set of shingles are one class, and only classes are joined.

*Order.*  All shingles are counted into a table of fixed size by their leading
bits; the rarer a shingle's count, the earlier it comes, its hash breaking
ties.  Any order gives whole results; this one keeps common shingles out of the
prefixes.

*Prefixes.*  Two sets of which the larger has n shingles and which reach the
threshold t share one of the first n - ceil(t n) + 1 of each.  The prefixes
meet in one sort by shingle; those that meet nobody are dropped there.  The
counters tell which shingles may stand in more than a thousandth of all
documents: their lists are dealt to as many parts as that takes, by class.

*Filters.*  Lengths must allow the threshold; the first shingle that two sets
have in common leaves what follows it in each to share (positional filter: a
pair that is a link passes it in the list of that shingle); and the sets must
not differ too much.  The last is asked twice.  Before texts are read, parities
of the shingles by hash bucket bound the Hamming distance of whole sets.  When
both sets are there, the suffix filter bounds it again: what lies before and
behind the shared shingle is split at the middle of the one set, and each half
again, and what the halves differ in size adds up.

*Groups.*  Links make components, so a large group of copies needs a tree of
links, not all pairs.  In every part of a list each set is first held against
the part's leader, the one with the fewest rare shingles, and against its
neighbour, and each leader of a part against the list's.  Then the pairs that
are still in different components are compared, in blocks of bounded size, of
which two that hold the same component alone don't meet.  No pair is verified
twice, and none that could join two components is left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from ._common import HOT, fresh, join_counted, lookup, settle
from .components import components

#: Counters of the order: 4 bytes each, sent to every task.
COUNTERS_LOG2 = 20
_BLOCKS = 16
#: Sets of a list that make up a block, of which two are compared in one unit of work.
CHUNK = 512
#: How often the suffix filter halves.
HALVES = 3


def _keys(order: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Where shingles stand in the global order; what is equal has equal keys."""
    return order[(s >> np.uint64(64 - COUNTERS_LOG2)).astype(np.int64)].astype(np.uint64) << np.uint64(32) | s & np.uint64(0xFFFFFFFF)


def _rank(order: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Indices that put a sorted set into the global order."""
    return np.argsort(_keys(order, s), kind="stable")


def _survey(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, row, node, n, map), and rows of counters (block, counts) per task."""
    size = 1 << COUNTERS_LOG2
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "row", "node", "n", "map", "block", "counts"]

    def run(batches):
        counters, id_type = np.zeros(size, np.uint32), None
        for b in batches:
            id_type = b.schema.field(0).type
            for lo in range(0, len(b), 1024):
                rows: list[tuple] = []
                held: list[np.ndarray] = []
                for s in shingles.sets_of(b.column(2).slice(lo, 1024)):
                    rows.append((shingles.digest(s), len(s), shingles.parity(s)) if len(s) else (None, 0, None))
                    held.append(s >> np.uint64(64 - COUNTERS_LOG2))
                for part in held:
                    counters += np.bincount(part.astype(np.int64), minlength=size).astype(np.uint32) if len(part) > size // 16 else 0
                small = [x for x in held if len(x) <= size // 16]
                if small:
                    counters += np.bincount(np.concatenate(small).astype(np.int64), minlength=size).astype(np.uint32)
                k = len(rows)
                node, n, maps = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, k), b.column(1).slice(lo, k), pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(maps, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if counters.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counters, _BLOCKS)]
            none = [pa.nulls(_BLOCKS, t) for t in (id_type, pa.int64(), pa.int64(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(_BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names)

    return settle(docs.mapInArrow(run, f"doc_id {kind}, row long, node long, n int, map binary, block int, counts binary"))


def _order(survey: DataFrame) -> np.ndarray:
    """The counters of all tasks added up: first those of neighbouring tasks, then by block."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(c), np.uint32)
                total[k] = np.minimum(total[k] + x.astype(np.uint64), np.uint64(2**32 - 1)).astype(np.uint32) if k in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["block", "counts"])

    tasks = max(1, round(int(survey.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    rows = survey.filter("block is not null").select("block", "counts").coalesce(tasks).mapInArrow(add, "block int, counts binary")
    rows = rows.repartition(_BLOCKS, "block").mapInArrow(add, "block int, counts binary")
    order = np.zeros(1 << COUNTERS_LOG2, np.uint32)
    step = len(order) // _BLOCKS
    for r in rows.collect():  # _BLOCKS rows, whatever the input
        order[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint32)
    return order


def _prefixes(docs: DataFrame, order: np.ndarray, most: int, percent: int) -> DataFrame:
    """(shingle, part, last, node, n, pos) for the prefix of every set; copies within a task are left out.

    A list has the parts 0 to ``last``, of some ``most`` classes at most.
    """
    names = ["shingle", "part", "last", "node", "n", "pos"]

    def run(batches):
        met: set[int] = set()
        for b in batches:
            for lo in range(0, len(b), 256):
                out = []
                for s in shingles.sets_of(b.column(0).slice(lo, 256)):
                    if not len(s):
                        continue
                    node = shingles.digest(s)
                    if node in met:
                        continue
                    met.add(node)
                    if len(met) > 1_000_000:
                        met.clear()
                    p = len(s) - -(-percent * len(s) // 100) + 1
                    out.append((s[_rank(order, s)[:p]], node, len(s)))
                if not out:
                    continue
                size = [len(x) for x, _, _ in out]
                shingle = np.concatenate([x for x, _, _ in out])
                node = np.repeat(np.array([k for _, k, _ in out], np.int64), size)
                last = np.minimum(order[(shingle >> np.uint64(64 - COUNTERS_LOG2)).astype(np.int64)] // np.uint32(most), np.uint32(HOT)).astype(np.int32)
                part = ((node.view(np.uint64) >> np.uint64(33)).astype(np.int64) % (last.astype(np.int64) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shingle.view(np.int64)), pa.array(part), pa.array(last), pa.array(node),
                        pa.array(np.repeat(np.array([n for _, _, n in out], np.int32), size)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in size])),
                    ], names)

    return docs.mapInArrow(run, "shingle long, part int, last int, node long, n int, pos int")


def _may_link(na, nb, pa_, pb, percent: int):
    """SQL of the length and positional filters for two sets in the list of one shingle."""
    share = f"(100 + {percent})"
    length = f"100L * least({na}, {nb}) >= {percent}L * greatest({na}, {nb})"
    place = f"cast({share} as long) * least({na} - {pa_}, {nb} - {pb}) >= {percent}L * ({na} + {nb})"
    return f"({length}) and ({place})"


def _first_met(pairs: DataFrame) -> DataFrame:
    """Each pair (a, b) once, with the place in either set of the first shingle that they met by."""
    return pairs.groupBy("a", "b").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"))


def _pair(lists: DataFrame, node: str, pos: str) -> DataFrame:
    """Candidate pairs of the rows' own sets and others."""
    less = F.col("node") < F.col(node)
    return lists.select(F.least("node", node).alias("a"), F.greatest("node", node).alias("b"), F.when(less, F.col("pos")).otherwise(F.col(pos)).alias("pa"), F.when(less, F.col(pos)).otherwise(F.col("pos")).alias("pb"))


def _differ_little(x: np.ndarray, y: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether parity maps x and y leave room for the threshold; total is the sum of both sizes."""
    bits = np.bitwise_count(x ^ y).sum(axis=-1).astype(np.int64)
    shared = -(-percent * total // (100 + percent))
    return bits <= total - 2 * shared


def _screen(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, pa, pb) whose parity maps allow a link."""
    of = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("map").alias(f"m{c}"))

    def run(batches):
        for b in batches:
            keep = []
            for na, nb, x, y in zip(*(b.column(k).to_pylist() for k in (4, 5, 6, 7)), strict=True):
                if len(x) < len(y):
                    x, y = y, x
                x = np.frombuffer(x, np.uint8)[None]
                while x.shape[1] > len(y):
                    x = shingles.fold(x)
                keep.append(bool(_differ_little(x.view(np.uint64)[0], np.frombuffer(y, np.uint64), np.int64(na + nb), percent)))
            yield b.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "pa", "pb", "na", "nb", "ma", "mb").mapInArrow(run, "a long, b long, pa int, pb int")


def _apart(x: np.ndarray, y: np.ndarray, most: int, halves: int = HALVES) -> int:
    """A number that sorted x and y differ in at least; beyond ``most`` it isn't looked for closer."""
    if not halves or not len(x) or not len(y):
        return abs(len(x) - len(y))
    middle = y[len(y) // 2]
    (x0, x1), (y0, y1) = ((int(s.searchsorted(middle)), int(s.searchsorted(middle, "right"))) for s in (x, y))
    same = abs((x1 - x0) - (y1 - y0))
    left, right = abs(x0 - y0), abs((len(x) - x1) - (len(y) - y1))
    if left + same + right <= most:
        left = _apart(x[:x0], y[:y0], most - same - right, halves - 1)
    if left + same + right <= most:
        right = _apart(x[x1:], y[y1:], most - same - left, halves - 1)
    return left + same + right


def _linked(x: np.ndarray, y: np.ndarray, px: int, py: int, order: np.ndarray, percent: int) -> bool:
    """Whether sets in the global order, equal at px and py, reach the threshold."""
    total = len(x) + len(y)
    most = total - 2 * -(-percent * total // (100 + percent))
    kx, ky = _keys(order, x), _keys(order, y)
    before = _apart(kx[:px], ky[:py], most)
    if before > most or before + _apart(kx[px + 1 :], ky[py + 1 :], most - before) > most:
        return False
    z = np.sort(np.concatenate([x, y]))
    return (100 + percent) * int((z[1:] == z[:-1]).sum()) >= percent * total


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, order: np.ndarray, percent: int) -> DataFrame:
    """The pairs whose sets pass the suffix filter and, counted shingle by shingle, reach the threshold."""
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("copies"))
    need = settle(need.join(classes.select("node", "rep"), "node").select("node", "rep.row", "copies"))
    texts = lookup(docs.select("row", "text"), need.select("node", "row"), "row", F.xxhash64("text"))

    def hashed(batches):
        """A text's set in the global order; where texts share a row's hash, the one that is meant."""
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                sets = [s if len(s) and shingles.digest(s) == k else None for k, s in zip(part.column(0).to_pylist(), shingles.sets_of(part.column(1)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if s is None else s[_rank(order, s)].tobytes() for s in sets], pa.binary())], ["node", "words"])

    sets = texts.select("node", "text").mapInArrow(hashed, "node long, words binary").filter("words is not null").dropDuplicates(["node"])

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                keep = []
                for px, py, x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4), part.column(5), strict=True):
                    keep.append(_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), px, py, order, percent))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # a set of many pairs, as a list's leader is, is copied, and each pair takes one of the copies
    often = settle(need.filter("copies > 1").select("node", "copies"))
    for c in ("a", "b"):
        other = F.xxhash64("b" if c == "a" else "a")
        pairs = lookup(pairs, often.select(F.col("node").alias(c), F.col("copies").alias(f"of_{c}")), c, other, "left")
        pairs = pairs.withColumn(f"of_{c}", F.when(F.col(f"of_{c}").isNull(), 0).otherwise(F.pmod(other, F.col(f"of_{c}"))).cast("int"))
    sets = lookup(sets, often, "node", F.col("node"), "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
    side = lambda c: sets.select(F.col("node").alias(c), F.col("copy").alias(f"of_{c}"), F.col("words").alias(f"w{c}"))
    pairs = pairs.join(side("a"), ["a", "of_a"]).join(side("b"), ["b", "of_b"])
    return settle(pairs.select("a", "b", "pa", "pb", "wa", "wb").mapInArrow(run, "a long, b long"))


def _mixed(lists: DataFrame, label: DataFrame) -> DataFrame:
    """(shingle, m, node, root, n, pos) of the lists that hold more than one component; m is a list's length."""
    entries = lists.select("shingle", "part", "last", "node", "n", "pos").join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = entries.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m"), F.max("last").alias("last")).filter("lo <> hi")
    mixed = mixed.select("shingle", "m", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("part"))
    return settle(entries.join(mixed, ["shingle", "part"]).select("shingle", "m", "node", "root", "n", "pos"))


def _met(rows: DataFrame, unit: list[str], percent: int, also: str = "true") -> DataFrame:
    """Pairs within units of different components that pass the filters of length and place."""
    x, y = (rows.select(*unit, *[F.col(c).alias(f"{c}{k}") for c in rows.columns if c not in unit]) for k in (1, 2))
    both = x.join(y, unit).filter(f"node1 < node2 and root1 <> root2 and {_may_link('n1', 'n2', 'pos1', 'pos2', percent)} and ({also})")
    return both.select(F.col("node1").alias("a"), F.col("node2").alias("b"), F.col("pos1").alias("pa"), F.col("pos2").alias("pb"))


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b, pa, pb) across the components of each list.

    Lists longer than ``CHUNK`` are cut into blocks: a component that fills half
    of one has blocks to itself, the others share some.  Each two blocks are a
    unit of work, but for two of one component.
    """
    pairs = _met(rows.filter(F.col("m") <= CHUNK).select("shingle", "node", "root", "n", "pos"), ["shingle"], percent)
    long = rows.filter(F.col("m") > CHUNK)
    if not long.isEmpty():
        sizes = long.groupBy("shingle", "root").agg(F.count("*").alias("r"))
        sizes = sizes.withColumn("own", F.col("r") * 2 >= CHUNK)
        blocks = lambda n: F.greatest(F.ceil(n / CHUNK), F.lit(1)).cast("int")
        block = lambda own, root, k: F.struct(own.alias("own"), root.alias("root"), k.cast("int").alias("k"))
        own = F.collect_list(F.when(F.col("own"), F.struct("root", blocks(F.col("r")).alias("k"))))
        plan = sizes.groupBy("shingle").agg(blocks(F.sum(F.when(F.col("own"), 0).otherwise(F.col("r")))).alias("pools"), own.alias("owns"))
        shared = F.transform(F.sequence(F.lit(0), F.col("pools") - 1), lambda k: block(F.lit(False), F.lit(0).cast("long"), k))
        alone = F.flatten(F.transform("owns", lambda o: F.transform(F.sequence(F.lit(0), o["k"] - 1), lambda k: block(F.lit(True), o["root"], k))))
        plan = settle(plan.select("shingle", "pools", F.transform("owns", lambda o: o["root"]).alias("roots"), F.transform("owns", lambda o: o["k"]).alias("ks"), F.concat(shared, alone).alias("all")))
        dealt = lookup(long.select("shingle", "node", "root", "n", "pos"), plan, "shingle", F.col("node"), weight=F.size("all") + F.size("roots") + 1)
        at = F.array_position("roots", F.col("root"))
        mine = F.when(at > 0, block(F.lit(True), F.col("root"), F.pmod(F.xxhash64("node"), F.element_at("ks", F.greatest(at, F.lit(1)).cast("int"))))).otherwise(block(F.lit(False), F.lit(0).cast("long"), F.pmod(F.xxhash64("root"), F.col("pools"))))
        dealt = dealt.withColumn("mine", mine)
        other = F.explode(F.filter("all", lambda c: ~(c["own"] & F.col("mine.own") & (c["root"] == F.col("mine.root")))))
        dealt = dealt.select("shingle", "node", "root", "n", "pos", "mine", other.alias("other"))
        dealt = dealt.select("shingle", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "root", "n", "pos", "mine")
        pairs = pairs.union(_met(dealt, ["shingle", "i", "j"], percent, "i = j or mine1 <> mine2"))
    return _first_met(pairs)


def _placed(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, row, n, best) for each row of ``docs`` (doc_id, row, text).

    ``best`` is the first row (is its id null, doc_id, row) of the row's
    component; it is null where the row is alone.
    """
    survey = _survey(docs)
    rows = survey.filter("block is null").select("doc_id", "row", "node", "n")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    classes = settle(survey.filter("n > 0").groupBy("node").agg(F.min(first).alias("rep"), F.first("n").alias("n"), F.first("map").alias("map"), F.count("*").alias("copies")))
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    order = _order(survey)
    met = Window.partitionBy("shingle", "part").orderBy("pos", "n", "node")
    lists = _prefixes(docs.select("text"), order, max(4 * CHUNK, total // HOT), percent).select(
        "*", F.lag("node").over(met).alias("prev"), F.lag("n").over(met).alias("prev_n"), F.lag("pos").over(met).alias("prev_pos"), F.lead("node").over(met).alias("next"),
        F.first("node").over(met).alias("lead"), F.first("n").over(met).alias("lead_n"), F.first("pos").over(met).alias("lead_pos"),
    )
    # copies from several tasks stand side by side; one row of each set stays, if the list has another
    lists = settle(lists.filter("(prev is null or prev <> node) and (lead <> node or next is not null or last > 0)"))
    star = lists.filter("lead <> node and " + _may_link("n", "lead_n", "pos", "lead_pos", percent))
    chain = lists.filter("prev is not null and " + _may_link("n", "prev_n", "pos", "prev_pos", percent))
    heads = lists.filter("last > 0 and lead = node").select("shingle", "node", "n", "pos")
    top = heads.groupBy("shingle").agg(F.min(F.struct("pos", "n", "node")).alias("top")).select("shingle", F.col("top.pos").alias("top_pos"), F.col("top.n").alias("top_n"), F.col("top.node").alias("top"))
    heads = heads.join(top, "shingle").filter("top <> node and " + _may_link("n", "top_n", "pos", "top_pos", percent))
    near = _pair(star, "lead", "lead_pos").union(_pair(chain, "prev", "prev_pos")).union(_pair(heads, "top", "top_pos"))
    tried = settle(_screen(_first_met(near), classes, percent))
    links = _verify(tried, classes, docs, order, percent)
    across = _across(_mixed(lists, components(links)), percent).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    links = links.union(_verify(settle(_screen(across, classes, percent)), classes, docs, order, percent))
    named = classes.select("node", "rep", "copies").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = settle(named.groupBy("root").agg(F.min("rep").alias("best"), F.count("*").alias("sets")).filter("sets > 1").drop("sets"))
    # most sets are no one's copy: only the others need a join with the rows
    moved = lookup(named, least, "root", F.col("node"), "left").withColumn("best", F.coalesce("best", "rep"))
    moved = settle(moved.filter("copies > 1 or best <> rep").select("node", "best", "copies"))
    out = join_counted(rows.filter("n > 0"), moved, "node", "copies", total).select("doc_id", "row", "n", "best")
    return out.unionByName(rows.filter("n = 0").select("doc_id", "row", "n"), allowMissingColumns=True)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, DataFrame]:
    """A hash that tells rows of other ids or texts apart, and ``docs`` with it as (doc_id, row, text)."""
    row = F.xxhash64(F.col(doc_id), F.lit("\0"), F.col(text))
    return row, docs.select(F.col(doc_id).alias("doc_id"), row.alias("row"), F.col(text).alias("text"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """Component of each document under the links ``100 * shared >= percent * joint``.

    Returns doc_id, n_shingles (size of the set) and component_id (the least
    doc_id reachable by links, itself included), a row for each row of
    ``docs``.  Words are runs of anything but ASCII white space, A-Z lower-cased;
    a set holds the distinct shingles of five words, or the whole of fewer
    words as one.  Null, empty and blank texts have no shingles and are linked
    with nothing.  Ids may be of any type that has an order.  Rows of null id
    link others but name no component; their own is that of their component,
    null where all its ids are.  Equal rows are all returned; an id with several
    texts is a document for each.  An empty table gives an empty result.
    """
    out = _placed(_keyed(docs, doc_id, text)[1], percent)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("best.doc_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """One document of each component, that of the least id, with all its columns.

    Only in a component without ids one of null id stays.  Where the least id
    has several texts in a component, one of them stays; of rows that agree in
    id and text too, the one whose columns come first.  Texts without words are
    no one's copies and all stay.  Columns of any name are kept as they are.
    """
    row, keyed = _keyed(docs, doc_id, text)
    found = settle(_placed(keyed, percent))
    gone = found.filter("best is not null and row <> best.row").select("row").distinct()
    key = fresh(docs, "row")
    left = lookup(docs.withColumn(key, row), gone.withColumnRenamed("row", key), key, F.xxhash64(F.col(text)), "left_anti")
    again = found.filter("best is not null and row = best.row").groupBy("row").count().filter("count > 1").select(F.col("row").alias(key))
    if again.isEmpty():
        return left.drop(key)
    # equal rows don't tell which of them stays: their other columns do
    every = fresh(docs, "all")
    several = lookup(left, again, key, F.xxhash64(F.col(text)), "left_semi").withColumn(every, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    one = several.groupBy(key).agg(F.min_by(every, F.to_json(every)).alias(every)).select(f"{every}.*")
    return lookup(left, again, key, F.xxhash64(F.col(text)), "left_anti").drop(key).unionByName(one)


ORACLE = r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) end as s from words),
classes as (select row_number() over () as c, * from (select min(doc_id) as rep, list_sort(s) as s, len(any_value(s)) as n from sets where len(s) > 0 group by list_sort(s))),
items as (select c, n, unnest(s) as x from classes),
links as (select a.c as a, b.c as b from items a join items b on a.x = b.x and a.c < b.c
    where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    group by a.c, b.c, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways as (select a, b from links union all select b, a from links),
reach as (select c as node, c as other from classes union select r.node, l.b from reach r join both_ways l on l.a = r.other),
root as (select node, min(rep) as component_id from reach join classes on c = other group by node)
select d.doc_id, len(d.s)::bigint as n_shingles, coalesce(r.component_id, d.doc_id) as component_id
from sets d left join classes c on len(d.s) > 0 and c.s = list_sort(d.s) left join root r on r.node = c.c
"""
