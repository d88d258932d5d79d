"""The minimum spanning tree of points by mutual reachability (V3, V5): exact, without comparing all points.

Points lie in parts of at most ``PART`` around sampled ones. Two parts can only hold points nearer than a bound if their
middles and radii allow it, so the triangle inequality tells which pairs of parts have to meet, and a pair meets in one
task as two small matrices. Equal points are one with a weight: a very common vector is no crowd of pairs.

The tree has only edges that the tree of any two blocks of points has, so these are made first. What is left of the
edges goes through Borůvka's rounds: each component takes its shortest edge to another one, and their number at least
halves. Ties go by the edge (distance, smaller id, larger id), which makes the tree unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut, drop
from corpusmill.functions.joins import spread

PART = 256
#: Points of a block; the tree of two blocks is made in one task.
BLOCK = 8_192
#: Edges that one task makes a tree of; more are first made fewer by rounds of joins.
EDGES = 250_000


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def _batch(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values())], list(schema))


def _unique(points: DataFrame) -> DataFrame:
    """(id, v, w): each different vector once, by its smallest id, with how many points have it."""
    return points.groupBy("vector").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("w")).select("id", F.transform("vector", lambda x: x.cast("double")).alias("v"), "w")


def _parts(unique: DataFrame, part: int) -> DataFrame:
    """(part, ids, w, v, m, r): points packed with those that are nearest to the same of some sampled ones; ``m`` is their mean, ``r`` the radius around it."""
    n = unique.count()
    sample = unique.select(F.xxhash64("id").alias("h"), "v").orderBy("h").limit(max(1, round(2 * n**0.5)))  # the same in every run
    told = unique.sparkSession.sparkContext.broadcast(np.array([r["v"] for r in sample.collect()], np.float64))  # twice the root of the rows

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column("v").to_pylist(), np.float64)
            cell = [int(k) for a in range(0, len(v), 256) for k in _distances(v[a:a + 256], told.value).argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], ["id", "v", "w", "cell"])

    placed = cut(unique.mapInArrow(nearest, "id bigint, v array<double>, w bigint, cell bigint"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    dealt = placed.join(sizes, "cell").withColumn("piece", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") * 2 / F.lit(part))))
    packed = dealt.groupBy("cell", "piece").agg(F.array_sort(F.collect_list(F.struct("id", "w", "v"))).alias("s")).withColumn("part", F.monotonically_increasing_id())
    schema = {"part": pa.int64(), "ids": pa.list_(pa.int64()), "w": pa.list_(pa.int64()), "v": pa.binary(), "m": pa.list_(pa.float64()), "r": pa.float64()}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, s in zip(batch.column("part").to_pylist(), batch.column("s").to_pylist()):
                v = np.array([p["v"] for p in s], np.float64)
                m = v.mean(axis=0)
                rows.append((k, [p["id"] for p in s], [p["w"] for p in s], v.tobytes(), m.tolist(), float(_distances(m[None], v).max())))
            yield _batch(schema, rows)

    return cut(packed.select("part", "s").mapInArrow(pack, "part bigint, ids array<bigint>, w array<bigint>, v binary, m array<double>, r double"))


#: Parts of a piece at most, of points that ask and of points that are looked at.
ASKING, LOOKED_AT = 128, 256


def _of_block(asked: dict, known: dict, most: int, copies: bool) -> Iterator[tuple]:
    """(id, part, near) of the points of ``asked`` parts: their nearest ones in ``known`` parts that the triangle inequality allows.

    Products of matrices bound the distances; what can be among the nearest is computed as a distance.
    """
    m, r = np.array(known["m"], np.float64), np.array(known["r"])
    b, ids = np.concatenate([np.frombuffer(v).reshape(-1, m.shape[1]) for v in known["v"]]), np.concatenate([np.array(i, np.int64) for i in known["ids"]])
    w = np.minimum(np.concatenate([np.array(x, np.int64) for x in known["w"]]), most + 1) if copies else np.ones(len(ids), np.int64)
    of_part, squares = np.repeat(np.arange(len(m)), [len(i) for i in known["ids"]]), (b ** 2).sum(axis=1)
    for part, own_ids, v, mine, radius, reach in zip(*(asked[c] for c in ("part", "ids", "v", "m", "r", "reach"))):
        a = np.frombuffer(v).reshape(len(own_ids), -1)
        gap = np.sqrt(((m - np.array(mine)) ** 2).sum(axis=1))
        allowed = gap - r - radius <= reach * (1 + 1e-9) + 1e-12
        if not allowed.any():
            continue
        at = slice(None) if allowed.all() else np.flatnonzero(allowed[of_part])
        near, near_ids, near_w, near_squares = b[at], ids[at], w[at], squares[at]
        own = (a ** 2).sum(axis=1)
        rough = own[:, None] + near_squares[None, :] - 2 * (a @ near.T)
        k = min(most, len(near_ids) - 1)
        within = np.partition(rough, k, axis=1)[:, k] + 1e-9 * (own + near_squares.max())
        for i, point in enumerate(own_ids):
            some = np.flatnonzero(rough[i] <= within[i])
            d = _distances(a[i:i + 1], near[some])[0]
            order = np.lexsort((near_ids[some], d))[:most + 1]
            times = near_w[some[order]] - (near_ids[some[order]] == point)  # without itself
            chosen = np.repeat(order, times)[:most]
            yield point, part, [{"d": float(x), "id": int(y)} for x, y in zip(d[chosen], near_ids[some[chosen]])]


def nearest(parts: DataFrame, most: int, copies: bool = True) -> DataFrame:
    """(id, part, near): the ``most`` nearest other points of each, as structs (d, id) by distance and id; copies of a point are at 0, unless they are left out.

    A point's own part bounds how far they can be, and only parts within that bound are looked at: the result is exact.
    Parts meet in pieces of many, so that a part is sent once to each piece, not to each part it may be near to.
    """
    schema = {"id": pa.int64(), "part": pa.int64(), "near": pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())]))}
    ddl = "id bigint, part bigint, near array<struct<d: double, id: bigint>>"

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pydict()
                yield _batch(schema, list(_of_block(row | {"reach": [float("inf")]}, row, most, copies)))

    def met(table: pa.Table) -> pa.Table:
        asked, known = (table.filter(pc.equal(table["side"], k)).to_pydict() for k in (0, 1))
        rows = list(_of_block(asked, known, most, copies)) if asked["part"] and known["part"] else []
        return pa.Table.from_batches([_batch(schema, rows)])

    own = cut(parts.select("part", "ids", "w", "v", "m", "r").mapInArrow(alone, ddl))
    known = F.when(F.size("near") == most, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf")))
    reach = own.groupBy("part").agg(F.max(known).alias("reach"))
    n = parts.count()
    rows, columns = -(-n // ASKING), -(-n // LOOKED_AT)
    dealt = lambda pieces, seed: F.pmod(F.xxhash64("part", F.lit(seed)), F.lit(pieces)).cast("int")
    each = lambda pieces: F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
    kept = ("part", "ids", "w", "v", "m", "r", "reach")
    asking = parts.join(reach, "part").select(F.lit(0).alias("side"), dealt(rows, 0).alias("i"), each(columns).alias("j"), *kept)
    looked_at = parts.withColumn("reach", F.lit(0.0)).select(F.lit(1).alias("side"), dealt(columns, 1).alias("j"), each(rows).alias("i"), *kept).select(asking.columns)
    pieces = spread(asking.unionByName(looked_at), rows * columns, "i", "j") if n else asking
    found = pieces.groupBy("i", "j").applyInArrow(met, ddl)
    out = cut(found.groupBy("id", "part").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, most).alias("near")))
    drop(own)
    return out


def core_distances(parts: DataFrame, most: int) -> DataFrame:
    """(id, part, cores): distances of a point to its 1st to ``most``-th nearest other points; copies of it are at 0."""
    return nearest(parts, most).select("id", "part", F.transform("near", lambda s: s["d"]).alias("cores"))


def neighbour_graph(points: DataFrame, most: int, part: int = PART) -> DataFrame:
    """V3: (doc_id, neighbour, rank, distance): the ``most`` nearest points of each of (doc_id, vector), exact. Of equal vectors only the smallest doc_id is in the graph."""
    near = nearest(_parts(cut(_unique(points)), part), most, copies=False)
    rows = near.select(F.col("id").alias("doc_id"), F.posexplode("near").alias("rank", "s"))
    return rows.select("doc_id", F.col("s.id").alias("neighbour"), (F.col("rank") + 1).alias("rank"), F.col("s.d").alias("distance"))


def fuzzy_weights(graph: DataFrame, rounds: int = 64) -> DataFrame:
    """V3: (x, y, weight), x < y, of a ``neighbour_graph``: how surely two points belong together, by either's view.

    A point is sure of its nearest neighbour; beyond it certainty falls exponentially, at the rate that makes the
    certainties of its k neighbours add up to log2(k). Two views make 1 - (1 - a) * (1 - b).
    """
    lists = graph.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, near in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                d = np.array([s["distance"] for s in near])
                beyond = np.maximum(0.0, d - (d[d > 0].min() if (d > 0).any() else 0.0))
                low, high = 0.0, np.inf
                rate = 1.0
                for _ in range(rounds):  # bisection
                    if np.exp(-beyond / rate).sum() > np.log2(max(len(d), 2)):
                        high = rate
                    else:
                        low = rate
                    rate = 2 * rate if high == np.inf else (low + high) / 2
                rows += [(min(doc, s["neighbour"]), max(doc, s["neighbour"]), float(w)) for s, w in zip(near, np.exp(-beyond / max(rate, 1e-12)))]
            yield _batch({"x": pa.int64(), "y": pa.int64(), "w": pa.float64()}, rows)

    views = lists.select("doc_id", "near").mapInArrow(run, "x bigint, y bigint, w double")
    return views.groupBy("x", "y").agg((1 - F.product(1 - F.col("w"))).alias("weight"))


def neighbour_distances(points: DataFrame, most: int, part: int = PART) -> DataFrame:
    """(doc_id, distances): how far the nearest ``most`` other points of (doc_id, vector) are, ascending; fewer if there aren't as many."""
    unique = cut(_unique(points))
    cores = cut(core_distances(_parts(unique, part), most))
    rows = points.select("doc_id", F.transform("vector", lambda x: x.cast("double")).alias("v"))
    return rows.join(unique.join(cores, "id").select("v", "cores"), "v").select("doc_id", F.col("cores").alias("distances"))


class Searched:
    """Points (doc_id, vector) packed in parts, with their nearest neighbours: what the trees of several ``min_samples`` share."""

    def __init__(self, points: DataFrame, most: int, part: int = PART):
        self.unique = cut(_unique(points))
        self.parts = _parts(self.unique, part)
        self.cores = core_distances(self.parts, most)


def mutual_reachability_tree(points: DataFrame, min_samples: int, searched: Searched | None = None, part: int = PART, block: int = BLOCK, most: int = EDGES) -> DataFrame:
    """(d, x, y): the edges of the minimum spanning tree of points (doc_id, vector), x < y.

    Two points are as far apart as their distance, and at least as the distances of both to their ``min_samples``-th
    nearest neighbours. Copies of a point hang on the one with the smallest id. Vectors are of one length and without
    nulls; doc_ids are different. No points, or one, have no edge.
    """
    s = searched or Searched(points, min_samples, part)
    core = cut(s.cores.select("id", F.coalesce(F.get("cores", F.least(F.size("cores"), F.lit(min_samples)) - 1), F.lit(0.0)).alias("core")))
    edges, left = _candidates(cut(core.join(s.unique.select("id", "v"), "id")), block), []
    while edges.count() > most:
        ends = edges.select(F.col("a").alias("comp"), F.col("b").alias("to"), "e").unionByName(edges.select(F.col("b").alias("comp"), F.col("a").alias("to"), "e"))
        best = cut(ends.groupBy("comp").agg(F.min(F.struct("e", "to")).alias("s")).select("comp", "s.e", "s.to"))
        left.append(best.select("e.*").distinct())
        roots, _ = _roots(best.select("comp", "to"))
        root = lambda c: roots.select(F.col("comp").alias(c), F.col("to").alias(f"_{c}"))
        moved = edges.join(root("a"), "a").join(root("b"), "b").filter("_a <> _b")
        fewer = cut(moved.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min("e").alias("e")))
        drop(edges)
        edges = fewer
    hung = points.join(s.unique.filter("w > 1").select("id", F.col("v").alias("_v")), F.transform("vector", lambda x: x.cast("double")) == F.col("_v")).filter("doc_id <> id")
    out = hung.join(core, "id").select(F.col("core").alias("d"), F.col("id").alias("x"), F.col("doc_id").alias("y"))
    for df in [*left, _kept(edges)]:
        out = out.unionByName(df)
    return cut(out)


def _prim(ids: np.ndarray, core: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, x, y): the minimum spanning tree of points in order of their ids. Of edges as long as each other that of smaller ids is taken."""
    n = len(ids)
    best, of, left, cells, least = np.full(n, np.inf), np.zeros(n, np.int64), np.arange(n), np.ascontiguousarray(v.T), core.copy()
    ends, d, now, gone = np.zeros((2, max(n - 1, 0)), np.int64), np.zeros(max(n - 1, 0)), 0, 1
    if n:
        least[0] = np.inf  # what is in the tree is never near
    for k in range(n - 1):
        if gone * 4 > len(left):
            some = np.flatnonzero(least < np.inf)
            best, of, left, cells, least, gone = best[some], of[some], left[some], np.ascontiguousarray(cells[:, some]), least[some], 0
        far = np.zeros(len(left))
        for column, x in zip(cells, v[now]):
            gap = column - x
            gap *= gap
            far += gap
        np.sqrt(far, out=far)
        np.maximum(far, least, out=far)
        np.maximum(far, core[now], out=far)
        nearer = (far < best) | ((far == best) & (now < of))
        np.copyto(best, far, where=nearer)
        np.copyto(of, now, where=nearer)
        at = int(best.argmin())
        equal = np.flatnonzero(best == best[at])
        if len(equal) > 1:
            at = int(equal[np.lexsort((np.maximum(of[equal], left[equal]), np.minimum(of[equal], left[equal])))[0]])
        ends[:, k], d[k] = (of[at], left[at]), best[at]
        now, gone = int(left[at]), gone + 1
        best[at] = least[at] = np.inf
    return d, ids[ends.min(axis=0)], ids[ends.max(axis=0)]


def _candidates(points: DataFrame, block: int) -> DataFrame:
    """(a, b, e) for edges e = (d, x, y) that may be in the tree of points (id, core, v): those of the trees of all pairs of blocks; a and b are x and y.

    An edge that isn't in the tree of some points isn't in that of more. So an edge within a block is left only if it
    is in the trees of all pairs that the block is in.
    """
    n = points.count()
    size = min(block, max(16, -(-n // 12)))
    ranged = cut(points.repartitionByRange(max(1, -(-n // size)), F.get("v", F.lit(0))).withColumn("cell", F.spark_partition_id()))
    sizes = ranged.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    dealt = ranged.join(F.broadcast(sizes), "cell").withColumn("piece", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / F.lit(2 * size))))
    packed = dealt.groupBy("cell", "piece").agg(F.array_sort(F.collect_list(F.struct("id", "core", "v"))).alias("s"))
    blocks = cut(packed.withColumn("block", F.monotonically_increasing_id()))
    names = sorted(r[0] for r in blocks.select("block").collect())  # a number for each block
    named = blocks.sparkSession.createDataFrame([(name, k) for k, name in enumerate(names)], "block bigint, k int")
    count = len(names)
    others = F.filter(F.sequence(F.lit(0), F.lit(max(count - 1, 0))), lambda j: (j != F.col("k")) | F.lit(count == 1))
    each = blocks.join(F.broadcast(named), "block").select("k", "s", F.explode(others).alias("j")).select(F.least("k", "j").alias("i"), F.greatest("k", "j").alias("j"), "k", "s")

    def run(table: pa.Table) -> pa.Table:
        rows = pa.concat_arrays([c.flatten() for c in table["s"].chunks])
        of = np.repeat(table["k"].to_numpy(), pc.list_value_length(table["s"]).to_numpy())
        ids, core = rows.field("id").to_numpy(), rows.field("core").to_numpy()
        v = rows.field("v").flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids)
        d, x, y = _prim(ids[order], core[order], v[order])
        block_of = lambda z: of[order][np.searchsorted(ids[order], z)]
        return pa.table({"d": d, "x": x, "y": y, "within": block_of(x) == block_of(y)})

    pairs = count * (count - 1) // 2
    found = spread(each, max(1, pairs), "i", "j").groupBy("i", "j").applyInArrow(run, "d double, x bigint, y bigint, within boolean")
    held = found.groupBy("d", "x", "y", "within").agg(F.count(F.lit(1)).alias("n")).filter(~F.col("within") | (F.col("n") >= max(1, count - 1)))
    out = cut(held.select(F.col("x").alias("a"), F.col("y").alias("b"), F.struct("d", "x", "y").alias("e")))
    drop(ranged, blocks)
    return out


def _kept(edges: DataFrame) -> DataFrame:
    """(d, x, y): the minimum spanning tree of a bounded number of edges (a, b, e) between components, in one task by Borůvka's rounds."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("d", "ascending"), ("x", "ascending"), ("y", "ascending")])
        names, ends = np.unique(np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()]), return_inverse=True)
        a, b = ends.reshape(2, -1)
        label, kept = np.arange(len(names)), np.zeros(len(a), bool)
        while True:
            la, lb = label[a], label[b]
            some = np.flatnonzero(la != lb)
            if not len(some):
                return table.select(["d", "x", "y"]).filter(pa.array(kept))
            first = np.full(len(names), len(a))
            for ends in (la, lb):
                np.minimum.at(first, ends[some], some)
            comp = np.flatnonzero(first < len(a))
            e = first[comp]
            kept[e] = True
            to = np.arange(len(names))
            to[comp] = la[e] + lb[e] - comp
            back = (to[to] == np.arange(len(names))) & (np.arange(len(names)) < to)
            to[back] = np.flatnonzero(back)
            while ((far := to[to]) != to).any():
                to = far
            label = to[label]

    return edges.select("a", "b", "e.*").withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(run, "d double, x bigint, y bigint")


def _roots(chosen: DataFrame) -> tuple[DataFrame, int]:
    """((comp, to), how many roots): where the choices (comp, to) of all components lead; of two that choose each other the smaller is the root."""
    back = chosen.select(F.col("comp").alias("to"), F.col("to").alias("back"))
    root = (F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to"))
    rows = cut(chosen.join(back, "to").select("comp", F.when(root, F.col("comp")).otherwise(F.col("to")).alias("to")))
    while True:
        hop = rows.select(F.col("comp").alias("to"), F.col("to").alias("far"))
        new = cut(rows.join(hop, "to").select("comp", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
        row = new.agg(F.count_if("moved"), F.count_if(F.col("comp") == F.col("to"))).first()
        drop(rows)
        rows = new.select("comp", "to")
        if not row[0]:
            return rows, row[1]
