"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is indexed in one of its
leaves.  For the largest inner product, vectors get one more coordinate that
brings all to the same length, so that the nearest by distance is the largest by
product.  A query opens branches best bin first, from a priority queue over the
whole tree, and visits as many leaves as a calibration on some queries against
all vectors finds necessary for the recall wanted.  A leaf that the table has
outgrown gets a tree of its own, fitted by one task on a bounded sample of that
leaf's vectors; such trees stay in a table and go to the tasks that need them.
Leaves that lie side by side make a tile, to which a query goes once, with the
leaves that it visits there, so that its vector isn't sent for every visit.
Tiles and queries meet in units of bounded size, whatever the size of a leaf.
Vectors of single precision are kept and sent as such; all is computed in double.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import lookup, settle, tidy

#: Bounds of the fit: vectors, and numbers in them.
SAMPLE, SAMPLE_VALUES = 20_000, 4_000_000
#: Children of a node, vectors of a leaf aimed at, and leaves at most.
BRANCH, LEAF, LEAVES = 16, 256, 2048
#: Queries that calibrate, and the recall that they must reach.
CALIBRATE, RECALL = 100, 0.96
#: Leaves that a query visits first; the k-th best of them bounds what the others need return.
FIRST = 4
#: Vectors of a unit of work at least and visiting queries of one at most, about, and bytes of either in double precision.
VECTORS, VISITS, UNIT_BYTES = 4096, 16384, 8 << 20
#: Leaves of an outgrown leaf's own tree that make a tile.
TILE = 16
#: Queries whose visits are found at a time.
AT_ONCE = 256
#: Numbers of the vectors whose products are taken exactly at a time, about.
PIECE_VALUES = 1 << 21


@dataclass
class Tree:
    radius2: float = 0.0
    #: centre and children of each node; a leaf has no children but a number
    centres: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    n_leaves: int = 0

    def parts(self) -> tuple:
        """What :class:`Tree` is made of, to be stored."""
        return self.radius2, self.centres, self.children, self.leaf, self.n_leaves

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that brings them to the radius."""
        rest = np.maximum(self.radius2 - np.einsum("ij,ij->i", x, x), 0)
        return np.hstack([x, np.sqrt(rest)[:, None]])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        y, out = self.lift(x), np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
            elif len(rows):
                c = self.centres[kids]
                best = ((c**2).sum(axis=1) - 2 * (y[rows] @ c.T)).argmin(axis=1)
                todo += [(kid, rows[best == k]) for k, kid in enumerate(kids) if (best == k).any()]
        return out

    def visits(self, q: np.ndarray, n: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first ``n`` leaves of a query, best bin first, and further ones until their ``sizes`` make ``least``."""
        y = np.append(q, 0.0)
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < n or (sizes is not None and held < least)):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                out.append(self.leaf[node])
                held += sizes.get(out[-1], 0) if sizes else 0
                continue
            d = ((self.centres[kids] - y) ** 2).sum(axis=1)
            for k, v in zip(kids, d.tolist(), strict=True):
                heapq.heappush(queue, (v, k))
        return out


def _kmeans(x: np.ndarray, k: int, rnd: np.random.Generator) -> np.ndarray:
    centres = x[rnd.choice(len(x), k, replace=False)]
    for _ in range(12):
        best = ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
        n = np.bincount(best, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def grow(sample: np.ndarray, radius2: float, leaves: int) -> Tree:
    """Fit a tree of about ``leaves`` leaves."""
    tree = Tree(radius2)
    x = tree.lift(sample)
    rnd = np.random.default_rng(9)
    centres = [x.mean(axis=0)]
    tree.children, tree.leaf = [[]], [-1]
    todo = [(0, np.arange(len(x)), leaves)]
    while todo:
        node, rows, want = todo.pop()
        k = min(BRANCH, want, len(rows) // 4)
        if k >= 2:
            c = _kmeans(x[rows], k, rnd)
            best = ((c**2).sum(axis=1) - 2 * (x[rows] @ c.T)).argmin(axis=1)
            n = np.bincount(best, minlength=k)
            if (n > 0).sum() >= 2:
                for j in np.flatnonzero(n):
                    tree.children[node].append(len(centres))
                    todo.append((len(centres), rows[best == j], round(want * n[j] / len(rows))))
                    centres.append(c[j])
                    tree.children.append([])
                    tree.leaf.append(-1)
                continue
        tree.leaf[node] = tree.n_leaves
        tree.n_leaves += 1
    tree.centres = np.array(centres)
    return tree


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Vectors stored as bytes of numbers of ``kind``, in double precision."""
    raw = [v.as_buffer() for v in column]
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64) if raw else np.zeros((0, 1))


def _near(q: np.ndarray, x: np.ndarray, seen: np.ndarray | None, bounds: np.ndarray | None) -> np.ndarray:
    """Products of q and x, at least those of the leaves that a query has ``seen``; x lies leaf by leaf within ``bounds``."""
    if seen is None or 2 * np.count_nonzero(seen) > seen.size:
        return q @ x.T
    near = np.full((len(q), len(x)), -np.inf)
    for leaf in np.flatnonzero(seen.any(axis=0)).tolist():
        rows, lo, hi = np.flatnonzero(seen[:, leaf]), bounds[leaf], bounds[leaf + 1]
        near[rows, lo:hi] = q[rows] @ x[lo:hi].T
    return near


def _best(q_id: np.ndarray, q: np.ndarray, x_id: np.ndarray, x: np.ndarray, k: int, least: np.ndarray | None = None, seen: np.ndarray | None = None, bounds: np.ndarray | None = None):
    """For each query its ``k`` best of ``x``: (rows of q, rows of x, scores), ties to the smaller id; those of at least ``least`` only."""
    for lo in range(0, len(q), AT_ONCE):
        part = slice(lo, lo + AT_ONCE)
        near = _near(q[part], x, None if seen is None else seen[part], bounds)
        near[q_id[part, None] == x_id[None]] = -np.inf
        floor = np.full(len(near), -np.inf) if least is None else least[part].copy()
        many = np.flatnonzero(np.count_nonzero(near >= floor[:, None], axis=1) > 4 * k)
        if len(many) and near.shape[1] > k:
            at = near.shape[1] - k
            floor[many] = np.maximum(floor[many], np.partition(near[many], at, axis=1)[:, at])
        # products of columns differ in the last bits from those of rows
        slack = 1e-12 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0))) * x.shape[1]
        good = (near >= (floor - slack)[:, None]) & (near > -np.inf)
        # where many are equal, few queries at a time
        piece = np.cumsum(np.count_nonzero(good, axis=1)) // max(1, PIECE_VALUES // x.shape[1])
        for rows in np.split(np.arange(len(near)), np.flatnonzero(np.diff(piece)) + 1):
            row, some = np.nonzero(good[rows])
            row += rows[0]
            score = (x[some] * q[lo + row]).sum(axis=1)
            order = np.lexsort((x_id[some], -score, row))
            row, some, score = row[order], some[order], score[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            yield lo + row[kept], some[kept], score[kept]


def stored(vectors: DataFrame, vector: str) -> type:
    """Single precision where the vectors are given in it, else double."""
    return np.float32 if vectors.select(vector).dtypes[0][1] == "array<float>" else np.float64


def valid(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part: v are numbers of :func:`stored` as bytes.

    Left out are null ids and vectors that are null, empty, zero or hold null or
    non-finite numbers, and those of another dimension than most (of the
    smaller, on a tie).  Of an id's vectors the least takes part.
    """
    kind = stored(vectors, vector)
    numbers = F.col(vector) if kind is np.float32 else F.col(vector).cast("array<double>")
    v = vectors.select(F.col(vec_id).alias("vec_id"), numbers.alias("v")).filter("vec_id is not null and size(v) > 0")
    v = v.filter("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    v = v.groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if sizes:
        v = v.filter(F.size("v") == sizes[0]["d"])

    def pack(batches):
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            d = len(flat) // len(b) if len(b) else 1
            rows = flat.reshape(len(b), d)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "v"])

    return settle(v.mapInArrow(pack, "vec_id long, v binary"))


def _share(u, want, of):
    """Rows whose hash ``u``, 40 bits, is among the lowest: about ``want`` of ``of``."""
    return u < (F.least(F.lit(1.0), F.lit(float(want)) / F.greatest(of, F.lit(1))) * (1 << 40)).cast("long") + 1


def _planted(indexed: DataFrame, big: DataFrame, radius2: float, bound: int, leaves: int, kind: type) -> DataFrame:
    """(leaf, tree) for each leaf of ``big`` (leaf, n): a tree fitted on about ``bound`` of its vectors."""

    def plant(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        x, n = _matrix(t["v"].combine_chunks(), kind), t["n"][0].as_py()
        tree = grow(x, radius2, max(1, min(leaves, n // LEAF)))
        return pa.table({"leaf": t["leaf"].slice(0, 1), "tree": pa.array([pickle.dumps((tree.parts(), None))], pa.binary())})

    u = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 40))
    some = indexed.join(F.broadcast(big), "leaf").filter(_share(u, bound, F.col("n"))).select("leaf", "vec_id", "v", "n")
    return settle(some.groupBy("leaf").applyInArrow(plant, "leaf int, tree binary"))


def _with_trees(rows: DataFrame, trees: DataFrame, sizes: DataFrame, spread: str, unit: int, func, schema: str) -> DataFrame:
    """``func(rows, (tree, sizes of its leaves))`` over units of about ``unit`` rows of a leaf; ``sizes`` (leaf, n) counts the rows of leaves.

    Where there are no rows, it is called with None.
    """
    units = F.greatest(F.ceil(F.col("n") / unit).cast("int"), F.lit(1))
    few = F.broadcast(sizes.select("leaf", units.alias("units")))
    left = rows.join(few, "leaf").withColumn("i", F.pmod(F.xxhash64(spread), F.col("units")).cast("int")).drop("units")
    right = trees.join(few, "leaf").select("leaf", "tree", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("i"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        parts, held = pickle.loads(b["tree"][0].as_py())
        return func(a, (Tree(*parts), held) if len(a) else None)

    return left.groupBy("leaf", "i").cogroup(right.groupBy("leaf", "i")).applyInArrow(run, schema)


def search(
    vectors: DataFrame, queries: str, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL, leaves: int = LEAVES, split: int = VECTORS
) -> DataFrame:
    """The ``k`` vectors of largest inner product for each query.

    ``queries`` is SQL over ``vec_id`` that tells which rows ask; all rows but
    the query's own are candidates.  Returns query_id, rank (from 1), vec_id and
    score (the inner product in double precision), nearest first, ties to the
    smaller id; all candidates if they are fewer.  See :func:`valid` for the
    vectors that take part.  An empty table gives an empty result.  A tree has
    at most ``leaves`` leaves, and a leaf of more than ``split`` vectors a tree
    of its own.
    """
    x = valid(vectors, vec_id, vector)
    kind = stored(vectors, vector)
    schema = "query_id long, rank int, vec_id long, score double"
    n = x.count()
    if not n:
        return x.sparkSession.createDataFrame([], schema)
    dim = x.select(F.octet_length("v")).first()[0] // np.dtype(kind).itemsize

    def norms(batches):
        for b in batches:
            m = _matrix(b.column(1), kind)
            yield pa.RecordBatch.from_pydict({"r": [float((m**2).sum(axis=1).max())] if len(m) else []}, pa.schema([("r", pa.float64())]))

    radius2 = x.mapInArrow(norms, "r double").agg(F.max("r")).first()[0]
    bound = min(SAMPLE, SAMPLE_VALUES // dim)
    u = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 40))
    rows = sorted((r["vec_id"], bytes(r["v"])) for r in x.filter(_share(u, bound, F.lit(n))).collect())
    sample = np.array([np.frombuffer(v, kind) for _, v in rows], np.float64).reshape(-1, dim)
    tree = grow(sample, radius2, max(1, min(leaves, n // LEAF))) if len(sample) else Tree(radius2, np.zeros((1, dim + 1)), [[]], [0], 1)

    def index(batches):
        for b in batches:
            m = _matrix(b.column(1), kind)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.assign(m) if len(m) else [], pa.int32())], ["vec_id", "v", "leaf"])

    indexed = settle(x.mapInArrow(index, "vec_id long, v binary, leaf int"))
    spark = x.sparkSession
    del x  # what is settled twice is kept once
    tidy(spark, True)
    # a row for each leaf of the first tree, of which there are ``leaves`` at most
    counts = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}
    outgrown = [(leaf, c) for leaf, c in counts.items() if c > split]
    big = spark.createDataFrame(outgrown, "leaf int, n long")
    aim = recall**0.5 if outgrown else recall  # both steps must find a neighbour
    # from here on a leaf is told by its number times ``step``, and that of its own tree's leaf added; trees have about ``leaves`` leaves
    step, flat = 8 * leaves, F.col("leaf") * (8 * leaves)
    if outgrown:
        trees = _planted(indexed, big, radius2, bound, leaves, kind)

        def place(a: pa.Table, own) -> pa.Table:
            at = own[0].assign(_matrix(a["v"].combine_chunks(), kind)) if own else np.zeros(0, np.int64)
            leaf = a["leaf"].to_numpy().astype(np.int64) * step + at
            return pa.table({"vec_id": a["vec_id"], "v": a["v"], "leaf": pa.array(leaf, pa.int32())})

        deep = _with_trees(indexed, trees, big, "vec_id", VECTORS, place, "vec_id long, v binary, leaf int")
        indexed = settle(indexed.join(F.broadcast(big), "leaf", "left_anti").select("vec_id", "v", flat.alias("leaf")).unionByName(deep))
        held = indexed.groupBy("leaf").count().groupBy(F.expr(f"leaf div {step}").cast("int").alias("leaf")).agg(F.collect_list(F.struct((F.col("leaf") % step).alias("s"), "count")).alias("held"))
        held_by = trees.join(held, "leaf")  # at most ``leaves`` counts a tree

        def weigh(batches):
            for b in batches:
                out = []
                for raw, h in zip(b.column(1), b.column(2), strict=True):
                    out.append(pickle.dumps((pickle.loads(raw.as_py())[0], {e["s"]: e["count"] for e in h.as_py()})))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["leaf", "tree"])

        trees = settle(held_by.select("leaf", "tree", "held").mapInArrow(weigh, "leaf int, tree binary"))
    else:
        indexed = indexed.withColumn("leaf", flat)
    asking = indexed.filter(queries).select("vec_id", "v")
    n_queries = asking.count()
    # centres lie close to the vectors that they were fitted on, so those that calibrate are drawn by a hash of their own
    u = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 40))
    few = sorted((r["vec_id"], bytes(r["v"])) for r in asking.filter(_share(u, CALIBRATE, F.lit(n_queries))).collect())
    few_id = np.array([i for i, _ in few], np.int64)
    few_v = np.array([np.frombuffer(v, kind) for _, v in few], np.float64).reshape(-1, dim)

    def truth(batches):
        """Of each batch the best for the calibrating queries, with their leaves."""
        for b in batches:
            ids, m, leaf = b.column(0).to_numpy(), _matrix(b.column(1), kind), b.column(2).to_numpy()
            for j, at, score in _best(few_id, few_v, ids, m, k) if len(m) else ():
                yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(ids[at]), pa.array(score), pa.array(leaf[at], pa.int32())], ["q", "vec_id", "score", "leaf"])

    if len(few):
        found = indexed.mapInArrow(truth, "q int, vec_id long, score double, leaf int")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        met = found.withColumn("r", rank).filter(F.col("r") <= k).select("q", "leaf").collect()  # k rows a calibrating query
        places = [{leaf: at for at, leaf in enumerate(tree.visits(v, tree.n_leaves))} for v in few_v]
        enough = lambda needed: int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(aim * len(needed))) - 1)]) if len(needed) else 1
        n_visits = enough([places[r["q"]][r["leaf"] // step] + 1 for r in met])
        n_deep = 1
        if outgrown:
            split_ones = {leaf for leaf, _ in outgrown}
            seen = [(few_v[r["q"]].astype(kind).tobytes(), r["leaf"] // step, r["leaf"] % step) for r in met if r["leaf"] // step in split_ones and places[r["q"]][r["leaf"] // step] < n_visits]
            asked = spark.createDataFrame([(i, bytearray(v), a, b) for i, (v, a, b) in enumerate(seen)], "i0 long, q binary, leaf int, s int")

            def reach(a: pa.Table, own) -> pa.Table:
                out = [own[0].visits(v, own[0].n_leaves).index(s) + 1 for v, s in zip(_matrix(a["q"].combine_chunks(), kind), a["s"].to_pylist(), strict=True)] if own else []
                return pa.table({"needed": pa.array(out, pa.int32())})

            n_deep = enough([r["needed"] for r in _with_trees(asked, trees, big.withColumn("n", F.lit(1)), "i0", VECTORS, reach, "needed int").collect()])
    else:
        n_visits = n_deep = tree.n_leaves

    split_at = np.zeros(tree.n_leaves, bool)
    split_at[np.array([leaf for leaf, _ in outgrown], np.int64)] = True
    most_x = max(VECTORS, min(n // 32, UNIT_BYTES // (8 * dim)))
    most_q = max(1, min(VISITS, UNIT_BYTES // (8 * dim)))
    # leaves that lie side by side, up to some ``most_x`` vectors, and the first of each such tile
    held_before = np.cumsum([0] + [0 if split_at[leaf] else counts.get(leaf, 0) for leaf in range(tree.n_leaves)])[:-1]
    begins = np.flatnonzero(np.diff(held_before // most_x, prepend=-1) > 0)
    start = begins[np.searchsorted(begins, np.arange(tree.n_leaves), side="right") - 1]

    def tile_of(leaf: np.ndarray) -> np.ndarray:
        own, sub = leaf // step, leaf % step
        return np.where(split_at[own], own * step + sub // TILE * TILE, start[own] * step)

    ints = lambda rows: pa.array([np.asarray(r, np.int32).tobytes() for r in rows], pa.binary())

    def route(batches):
        """Of each query the leaves that it visits first, and those later; those of outgrown leaves stand apart."""
        for b in batches:
            for lo in range(0, len(b), AT_ONCE):
                part = b.slice(lo, AT_ONCE)
                early, late, deep = [], [], []
                for v in _matrix(part.column(1), kind):
                    seen = np.array(tree.visits(v, n_visits, counts, k + 1), np.int64)  # the query itself is in one of them
                    place, more = np.arange(len(seen)), split_at[seen]
                    early.append(seen[~more & (place < FIRST)] * step)
                    late.append(seen[~more & (place >= FIRST)] * step)
                    deep.append(np.stack([seen[more], place[more]], axis=1).ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ints(early), ints(late), ints(deep)], ["query_id", "q", "early", "late", "deep"])

    routed = settle(asking.mapInArrow(route, "query_id long, q binary, early binary, late binary, deep binary"))
    if outgrown:

        def spread(batches):
            for b in batches:
                for lo in range(0, len(b), AT_ONCE):
                    part = b.slice(lo, AT_ONCE)
                    pairs = [np.frombuffer(v.as_buffer(), np.int32).reshape(-1, 2) for v in part.column(2)]
                    at = np.repeat(np.arange(len(part)), [len(x) for x in pairs])
                    flat_pairs = np.concatenate(pairs)
                    for i in range(0, len(at), 8 * AT_ONCE):
                        j, y = pa.array(at[i : i + 8 * AT_ONCE]), flat_pairs[i : i + 8 * AT_ONCE]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(j), part.column(1).take(j), pa.array(y[:, 0], pa.int32()), pa.array(y[:, 1], pa.int32())], ["query_id", "q", "leaf", "place"])

        def onward(a: pa.Table, own) -> pa.Table:
            """The leaves of a leaf's own tree, those nearest first, as long as calibrated or until they hold enough."""
            early, late = [], []
            for v, leaf, place in zip(_matrix(a["q"].combine_chunks(), kind), a["leaf"].to_pylist(), a["place"].to_pylist(), strict=True) if own else ():
                seen = leaf * step + np.array(own[0].visits(v, n_deep, own[1], k + 1), np.int64)
                early.append(seen[: max(FIRST - place, 0)])
                late.append(seen[max(FIRST - place, 0) :])
            return pa.table({"query_id": a["query_id"], "q": a["q"], "early": ints(early), "late": ints(late)})

        deep = routed.filter(F.octet_length("deep") > 0).select("query_id", "q", "deep").mapInArrow(spread, "query_id long, q binary, leaf int, place int")
        visiting = deep.groupBy("leaf").agg(F.count("*").alias("n"))
        deep = _with_trees(deep, trees, visiting, "query_id", 8 * AT_ONCE, onward, "query_id long, q binary, early binary, late binary")
        routed = settle(routed.select("query_id", "q", "early", "late").unionByName(deep))

    def to_tiles(batches):
        """A row for each tile that a query visits, with its leaves there."""
        for b in batches:
            for lo in range(0, len(b), AT_ONCE):
                part = b.slice(lo, AT_ONCE)
                at, tiles, seen = [], [], []
                for j, raw in enumerate(part.column(3)):
                    leaf = np.sort(np.frombuffer(raw.as_buffer(), np.int32))
                    tile, begin = np.unique(tile_of(leaf), return_index=True)
                    at += [j] * len(tile)
                    tiles += tile.tolist()
                    seen += np.split(leaf, begin[1:]) if len(tile) else []
                for i in range(0, len(at), 8 * AT_ONCE):
                    j = pa.array(at[i : i + 8 * AT_ONCE], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(j), part.column(1).take(j), part.column(2).take(j), pa.array(tiles[i : i + 8 * AT_ONCE], pa.int32()), ints(seen[i : i + 8 * AT_ONCE])], ["query_id", "q", "least", "tile", "seen"])

    own_leaf = F.col("leaf") - F.col("leaf") % step
    shallow = spark.createDataFrame([(leaf * step, int(start[leaf]) * step) for leaf in range(tree.n_leaves) if not split_at[leaf]], "own int, start int")
    indexed = indexed.join(F.broadcast(shallow), own_leaf == F.col("own"), "left").withColumn("tile", F.coalesce("start", own_leaf + F.floor(F.col("leaf") % step / TILE).cast("int") * TILE)).drop("own", "start")
    nx = settle(indexed.groupBy("tile").agg(F.ceil(F.count("*") / most_x).cast("int").alias("nx")))
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if len(a) and len(b):
            a, b = a.sort_by([("leaf", "ascending"), ("vec_id", "ascending")]), b.sort_by("query_id")
            ids, m, leaf = a["vec_id"].to_numpy(), _matrix(a["v"].combine_chunks(), kind), a["leaf"].to_numpy()
            asks, q, least = b["query_id"].to_numpy(), _matrix(b["q"].combine_chunks(), kind), b["least"].to_numpy()
            there, begin = np.unique(leaf, return_index=True)
            lists = [np.frombuffer(v.as_buffer(), np.int32) for v in b["seen"].combine_chunks()]
            row, some = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
            at = np.minimum(np.searchsorted(there, some), len(there) - 1)
            seen = np.zeros((len(lists), len(there)), bool)
            held_here = there[at] == some
            seen[row[held_here], at[held_here]] = True
            for j, x, score in _best(asks, q, ids, m, k, least, seen, np.append(begin, len(leaf))):
                for c, v in zip(out, (asks[j], ids[x], score), strict=True):
                    c.append(v)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, t) for c, v, t in zip(("query_id", "vec_id", "score"), out, kinds, strict=True)})

    def met_by(visits: DataFrame) -> DataFrame:
        visits = visits.mapInArrow(to_tiles, "query_id long, q binary, least double, tile int, seen binary")
        nq = visits.groupBy("tile").agg(F.ceil(F.count("*") / most_q).cast("int").alias("nq"))
        parts = settle(nx.join(nq, "tile"))
        left = lookup(indexed, parts, "tile", F.xxhash64("vec_id")).withColumn("i", F.pmod(F.xxhash64("vec_id"), F.col("nx")).cast("int")).withColumn("j", span("nq"))
        left = left.select("tile", "i", "j", "leaf", "vec_id", "v")
        right = lookup(visits, parts, "tile", F.xxhash64("query_id")).withColumn("j", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int")).withColumn("i", span("nx"))
        right = right.select("tile", "i", "j", "query_id", "q", "least", "seen")
        return left.groupBy("tile", "i", "j").cogroup(right.groupBy("tile", "i", "j")).applyInArrow(compare, "query_id long, vec_id long, score double")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = lambda met: met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    none = F.lit(float("-inf"))
    first = settle(best(met_by(routed.filter(F.octet_length("early") > 0).select("query_id", "q", none.alias("least"), "early"))))
    known = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(none).alias("least"))
    later = routed.filter(F.octet_length("late") > 0).join(known, "query_id", "left").select("query_id", "q", F.coalesce("least", none).alias("least"), "late")
    # where queries visit most leaves of a tile, all of it is compared: what was found first can come again
    both = first.drop("rank").unionByName(met_by(later)).repartition("query_id")
    return best(both.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
