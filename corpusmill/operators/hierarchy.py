"""Hierarchical density clustering (V4, V5, A17): leaves of the condensed tree, their persistence, and a tuner that reads all from one tree.

Components of a spanning tree below a distance make the hierarchy; only those of ``min_size`` points or more count. A leaf
of the condensed tree begins where small components first reach that size together, takes in small ones as the
distance grows, and ends where it meets another such component. When that is for a point is known from the few points
that it meets first, so a few rounds of joins with the tree tell it, for all sizes at once; an edge whose two ends
count already when it comes is one between leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.functions.checkpointing import cut, drop
from corpusmill.functions.joins import spread
from corpusmill.functions.records import unit
from corpusmill.operators.clustering import NOISE, Grid, composite, reduced
from corpusmill.operators.graph import connected_components
from corpusmill.operators.spanning_tree import EDGES, Searched, mutual_reachability_tree


def first_met(tree: DataFrame, most: int) -> DataFrame:
    """(id, k, e): the edge (d, x, y) of ``tree`` by which a point's component comes to have ``k`` other points, k up to ``most``."""
    e = F.struct("d", "x", "y").alias("e")
    ways = cut(tree.select(F.col("x").alias("id"), F.col("y").alias("next"), e).unionByName(tree.select(F.col("y").alias("id"), F.col("x").alias("next"), e)))
    order = Window.partitionBy("id").orderBy("e", "met")
    first = lambda df: df.groupBy("id", "met").agg(F.min("e").alias("e")).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most)
    direct = ways.select("id", F.col("next").alias("met"), "e")
    lists = cut(first(direct))
    for _ in range(most - 1):
        far = ways.select("id", "next", F.col("e").alias("_e")).join(lists.select(F.col("id").alias("next"), "met", "e"), "next").filter("met <> id")
        new = cut(first(direct.unionByName(far.select("id", "met", F.greatest("_e", "e").alias("e")))))
        drop(lists)
        lists = new
    drop(ways)
    return lists.select("id", "k", "e")


def basins(tree: DataFrame, sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """((size, doc_id, basin, e), (size, a, b, e)): for each least size and point the leaf it falls to and the edge (d, x, y) that brings it there; the edges between leaves.

    ``tree`` are (d, x, y). Points of a tree below a size fall nowhere and have no row.
    """
    met = first_met(tree, max(sizes) - 1)
    alive = cut(met.filter((F.col("k") + 1).isin(list(sizes))).select((F.col("k") + 1).alias("size"), "id", "e"))
    at = lambda k, n: alive.select("size", F.col("id").alias(k), F.col("e").alias(n))
    edges = cut(tree.select(F.struct("d", "x", "y").alias("e"), "x", "y").join(at("x", "ex"), "x").join(at("y", "ey"), ["size", "y"]))
    apart = (F.col("e") > F.col("ex")) & (F.col("e") > F.col("ey"))
    node = lambda c: F.struct("size", F.col(c).alias("id"))
    joined = cut(connected_components(edges.filter(~apart).select(node("x").alias("a"), node("y").alias("b")), "a", "b").select("node.size", "node.id", F.col("component.id").alias("basin")))
    of = lambda k, n: joined.select("size", F.col("id").alias(k), F.col("basin").alias(n))
    between = cut(edges.filter(apart).join(of("x", "a"), ["size", "x"]).join(of("y", "b"), ["size", "y"]).select("size", "a", "b", "e"))
    fallen = cut(alive.join(joined, ["size", "id"]).select("size", F.col("id").alias("doc_id"), "basin", "e"))
    drop(edges, alive, joined)
    return fallen, between


def leaves(fallen: DataFrame, between: DataFrame, epsilons: list[float]) -> tuple[DataFrame, DataFrame]:
    """((size, epsilon, doc_id, cluster), (size, epsilon, cluster, n, persistence)) of ``basins``: clusters numbered from 0 by their smallest id; noise has no row.

    Leaves that end below ``epsilon`` give way to the nearest component above them that ends beyond it; if that were all
    there is, to the last two before it. The persistence is the excess of mass for each member, as a share of the
    largest density in the tree. A tree without a split has no cluster.
    """
    key = ["size", "epsilon"]
    spark = fallen.sparkSession
    tried = F.broadcast(spark.createDataFrame([(float(e),) for e in epsilons], "epsilon double"))  # a few rows
    last = F.broadcast(between.groupBy("size").agg(F.max("e").alias("last")))  # a row per size
    each = cut(between.join(last, "size").crossJoin(tried))
    joined_at = F.when(F.col("last.d") < F.col("epsilon"), F.col("e") < F.col("last")).otherwise(F.col("e.d") < F.col("epsilon"))
    node = lambda c: F.struct(*key, F.col(c).alias("id"))
    groups = connected_components(each.filter(joined_at).select(node("a").alias("a"), node("b").alias("b")), "a", "b").select("node.size", "node.epsilon", F.col("node.id").alias("basin"), F.col("component.id").alias("_to"))
    group = cut(fallen.select("size", "basin").distinct().crossJoin(tried).join(groups, [*key, "basin"], "left").select(*key, "basin", F.coalesce("_to", "basin").alias("group")))
    of = lambda k, n: group.select(*key, F.col("basin").alias(k), F.col("group").alias(n))
    sides = cut(each.join(of("a", "ga"), [*key, "a"]).join(of("b", "gb"), [*key, "b"]).select(*key, "ga", "gb", "e"))
    split = sides.filter("ga = gb").groupBy(*key, F.col("ga").alias("group")).agg(F.max("e.d").alias("split"))
    ends = sides.filter("ga <> gb").select(*key, F.explode(F.array("ga", "gb")).alias("group"), "e").groupBy(*key, "group").agg(F.min("e").alias("end"))
    bounds = group.join(ends, [*key, "group"]).join(split, [*key, "group"], "left")
    held = cut(fallen.join(bounds, ["size", "basin"]).filter(F.col("e") < F.col("end")).select(*key, "doc_id", "group", F.greatest("e.d", F.coalesce("split", F.lit(0.0))).alias("at"), F.col("end.d").alias("end")))
    density = lambda d: F.when(d > 0, 1 / d).otherwise(F.lit(float("inf")))
    most = F.broadcast(fallen.groupBy("size").agg(F.max(density(F.col("e.d"))).alias("most")))  # a row per size
    sums = held.groupBy(*key, "group").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(density(F.col("at")) - density(F.col("end"))).alias("mass")).join(most, "size")
    share = F.when(F.col("most") == float("inf"), 1.0).otherwise(F.col("mass") / (F.col("n") * F.col("most")))
    number = F.row_number().over(Window.partitionBy(*key).orderBy("first")) - 1  # over the clusters
    numbered = cut(sums.select(*key, "group", number.cast("int").alias("cluster"), "n", share.alias("persistence")))
    labels = cut(held.join(numbered, [*key, "group"]).select(*key, "doc_id", "cluster"))
    drop(each, group, sides, held)
    return labels, numbered.select(*key, "cluster", "n", "persistence")


def _density(d: np.ndarray) -> np.ndarray:
    return np.divide(1.0, d, out=np.full(len(d), np.inf), where=d > 0)


def _basins_of(x: np.ndarray, y: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the edge that brings a point to its basin, its basin, numbers of the edges between basins) of a tree's edges in order, as ``basins`` has them; points are numbered by their ids."""
    comp, basin = list(range(n)), list(range(n))
    counts, small = [1] * n, [[k] for k in range(n)]
    brought, between = np.full(n, len(x)), []

    def root(of: list[int], k: int) -> int:
        while of[k] != k:
            of[k] = k = of[of[k]]
        return k

    for e, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        a, b = root(comp, i), root(comp, j)
        if counts[a] < counts[b]:
            a, b = b, a
        if counts[b] >= size:
            between.append(e)
        else:
            p, q = root(basin, i), root(basin, j)
            basin[max(p, q)] = min(p, q)
            if counts[a] + counts[b] < size:
                small[a] += small[b]
            else:
                brought[small[b]] = e
                if counts[a] < size:
                    brought[small[a]] = e
                    small[a] = []
            small[b] = []
        comp[b] = a
        counts[a] += counts[b]
    return brought, np.array([root(basin, k) for k in range(n)], np.int64), np.array(between, np.int64)


def _leaves_of(tree: pa.Table, size: int, epsilons: list[float]) -> Iterator[dict]:
    """For each epsilon the columns of labels and clusters that ``leaves`` makes of a whole tree (d, x, y)."""
    d, ends = tree["d"].to_numpy(), np.stack([tree["x"].to_numpy(), tree["y"].to_numpy()])
    order = np.lexsort((ends[1], ends[0], d))
    d, (ids, at) = d[order], np.unique(ends[:, order], return_inverse=True)
    x, y = at.reshape(2, -1)
    if len(ids) < size or not len(d):
        return
    brought, basin, between = _basins_of(x, y, len(ids), size)
    if size < 2:  # no edge brings a point by itself
        return
    most = _density(d[brought]).max()
    for epsilon in epsilons:
        if not len(between):
            continue
        low = between < between[-1] if d[between[-1]] < epsilon else d[between] < epsilon
        group = list(range(len(ids)))
        for e in between[low].tolist():
            p, q = basin[x[e]], basin[y[e]]
            while group[p] != p:
                group[p] = p = group[group[p]]
            while group[q] != q:
                group[q] = q = group[group[q]]
            group[max(p, q)] = min(p, q)
        to = np.array(group)
        while ((far := to[to]) != to).any():
            to = far
        of = to[basin]
        ga, gb = of[x[between]], of[y[between]]
        split, end = np.zeros(len(ids)), np.full(len(ids), len(d))
        same = ga == gb
        np.maximum.at(split, ga[same], d[between[same]])
        for side in (ga, gb):
            np.minimum.at(end, side[~same], between[~same])
        held = np.flatnonzero((end[of] < len(d)) & (brought < end[of]))
        groups, cluster, n = np.unique(of[held], return_inverse=True, return_counts=True)
        first = np.full(len(groups), len(ids))
        np.minimum.at(first, cluster, held)
        rank = np.argsort(np.argsort(first))
        with np.errstate(invalid="ignore"):
            mass = np.bincount(cluster, _density(np.maximum(d[brought[held]], split[of[held]])) - _density(d[end[of[held]]]), len(groups))
            share = np.ones(len(groups)) if most == np.inf else mass / (n * most)
        yield {"epsilon": epsilon, "doc_id": ids[held], "label": rank[cluster], "cluster": rank, "n": n, "persistence": share}


def condensed(tree: DataFrame, sizes: list[int], epsilons: list[float], most: int = EDGES) -> tuple[DataFrame, DataFrame]:
    """``leaves`` of ``basins`` of ``tree``. A bounded number of edges is read by one task for each size; more go through rounds of joins."""
    if tree.count() > most or min(sizes) < 2:
        return leaves(*basins(tree, sizes), epsilons)
    kinds = {"size": pa.int32(), "epsilon": pa.float64(), "doc_id": pa.int64(), "cluster": pa.int32(), "n": pa.int64(), "persistence": pa.float64()}
    schema = "size int, epsilon double, doc_id bigint, cluster int, n bigint, persistence double"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        size, out = key[0].as_py(), [pa.table({c: pa.array([], kind) for c, kind in kinds.items()})]
        for found in _leaves_of(table, size, [float(e) for e in epsilons]):
            for own in ({"doc_id": found["doc_id"], "cluster": found["label"]}, {c: found[c] for c in ("cluster", "n", "persistence")}):
                rows = len(own["cluster"])
                own |= {"size": np.full(rows, size), "epsilon": np.full(rows, found["epsilon"])}
                out.append(pa.table({c: pa.array(own[c]).cast(kind) if c in own else pa.nulls(rows, kind) for c, kind in kinds.items()}))
        return pa.concat_tables(out)

    each = F.explode(F.array(*[F.lit(int(size)) for size in sizes])).alias("size")
    rows = cut(tree.select("d", F.col("x").cast("long"), F.col("y").cast("long"), each).groupBy("size").applyInArrow(run, schema))
    key = ["size", "epsilon"]
    return rows.filter("doc_id IS NOT NULL").select(*key, "doc_id", "cluster"), rows.filter("doc_id IS NULL").select(*key, "cluster", "n", "persistence")


def density_clusters(points: DataFrame, min_size: int, min_samples: int, epsilon: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """V5: ((doc_id, cluster), (cluster, n, persistence)) of points (doc_id, vector), as ``leaves`` has them; -1 is noise. Fewer than three points are an error."""
    points = cut(points.select("doc_id", "vector"))
    if points.limit(3).count() < 3:
        raise ValueError("three points at least are needed")
    labels, clusters = condensed(mutual_reachability_tree(points, min_samples), [min_size], [epsilon])
    return points.select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster")), clusters.drop("size", "epsilon")


#: Points of a part, and sums of clusters of another; they meet as a matrix, so many rows of it at a time.
POINTS, SUMS, _ROWS = 8_192, 16_384, 256


def silhouettes(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(size, epsilon, silhouette): the mean silhouette by cosine distance of each labelling, from one sum for each cluster.

    Points and sums meet in parts, as matrices: no pair of a point and a cluster is a row, and a point is sent once for all labellings.
    """
    key = ["size", "epsilon"]
    v = cut(vectors.select("doc_id", unit(F.col("vector")).alias("v")).filter("v IS NOT NULL"))
    one, n = v.select(F.size("v").alias("n")).first(), v.count()
    total = F.array(*[F.sum(F.get("v", F.lit(k))) for k in range(one["n"] if one else 0)]).cast("array<double>")
    sums = cut(labels.join(v, "doc_id").groupBy(*key, "cluster").agg(total.alias("sum"), F.count(F.lit(1)).alias("n")))
    held = sums.count()
    parts, groups = max(1, -(-n // POINTS)), max(1, -(-held // SUMS))
    groups = max(groups, min(-(-v.sparkSession.sparkContext.defaultParallelism // parts), -(-held // _ROWS)))
    dealt = lambda pieces, *c: F.pmod(F.xxhash64(*c), F.lit(pieces))
    known = cut(sums.groupBy(dealt(groups, *key, "cluster").alias("group")).agg(F.collect_list(F.struct(*key, "cluster", "sum", "n")).alias("sums")))
    told = labels.groupBy("doc_id").agg(F.collect_list(F.struct(*key, "cluster")).alias("labels")).join(v, "doc_id")
    points = cut(told.groupBy(dealt(parts, "doc_id").alias("part")).agg(F.collect_list(F.struct("doc_id", "v", "labels")).alias("points")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, known = batch.column("points")[k].values, batch.column("sums")[k].values
                matrix, own = rows.field("v").flatten().to_numpy().reshape(len(rows), -1), rows.field("labels")
                at, own = np.repeat(np.arange(len(rows)), own.value_lengths().to_numpy()), own.flatten()
                size, epsilon, cluster = (own.field(c).to_numpy() for c in (*key, "cluster"))
                their_size, their_epsilon, number, times = (known.field(c).to_numpy() for c in (*key, "cluster", "n"))
                total = known.field("sum").flatten().to_numpy().reshape(len(known), -1)
                for m, e in sorted(set(zip(their_size.tolist(), their_epsilon.tolist()))):
                    some, there = (size == m) & (epsilon == e), (their_size == m) & (their_epsilon == e)
                    of, mine, others, n, to = at[some], cluster[some], number[there], times[there], total[there].T
                    a, b = np.full(len(of), np.nan), np.full(len(of), np.nan)
                    for start in range(0, len(of), _ROWS):
                        dots = matrix[of[start:start + _ROWS]] @ to
                        gaps = 1 - dots / n
                        i, j = np.nonzero(mine[start:start + _ROWS, None] == others)
                        more = n[j] > 1
                        a[start + i[more]] = (n[j[more]] - dots[i[more], j[more]]) / (n[j[more]] - 1)
                        gaps[i, j] = np.inf
                        b[start:start + _ROWS] = gaps.min(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), m), kinds[0]), pa.array(np.full(len(of), e), pa.float64()), rows.field("doc_id").take(pa.array(of)), pa.array(a, mask=np.isnan(a)), pa.array(b, mask=~np.isfinite(b))], [*key, "doc_id", "a", "b"])

    kinds = [to_arrow_type(labels.schema["size"].dataType)]
    size, doc = (labels.schema[c].dataType.simpleString() for c in ("size", "doc_id"))
    met = spread(points.crossJoin(known), parts * groups, "part", "group").select("points", "sums")
    near = met.mapInArrow(run, f"size {size}, epsilon double, doc_id {doc}, a double, b double").groupBy(*key, "doc_id").agg(F.max("a").alias("a"), F.min("b").alias("b"))
    share = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return labels.join(near, [*key, "doc_id"], "left").groupBy(*key).agg(F.avg(F.coalesce(share, F.lit(0.0))).alias("silhouette"))


def tune(vectors: DataFrame, grid: Grid, dimensions: int = 5) -> tuple[dict | None, list[dict]]:
    """(the best parameters, a row for each that was tried): all combinations of a ``min_samples`` come from one tree, in jobs that don't grow with them.

    ``radius`` of the grid is the epsilon of ``leaves``. Labels are of the reduced vectors, silhouettes of the whole
    ones; the mean persistence counts. Invalid combinations tell why; of equal scores more clusters, more coverage, a
    better silhouette, smaller parameters.
    """
    points = cut(reduced(vectors, dimensions))
    searched, n, results = Searched(points, max(grid.min_samples)), points.count(), []
    for samples in sorted(grid.min_samples):
        labels, clusters = condensed(mutual_reachability_tree(points, samples, searched), sorted(grid.min_size), sorted(grid.radius))
        figures = clusters.groupBy("size", "epsilon").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("c"), F.avg("persistence").alias("p"))
        known = {(r["size"], r["epsilon"]): r for r in figures.join(silhouettes(vectors, labels), ["size", "epsilon"], "left").collect()}  # a row per combination
        for size, epsilon in product(sorted(grid.min_size), sorted(grid.radius)):
            row = known.get((size, float(epsilon)))
            k, covered = (row["k"], row["c"]) if row else (0, 0)
            entry = {"min_size": size, "min_samples": samples, "radius": epsilon, "n_clusters": k, "coverage": covered / n if n else 0.0, "silhouette": None, "persistence": row["p"] if row else None, "score": None, "reason": None}
            if k < grid.min_clusters:
                entry["reason"] = "fewer_than_min_clusters"
            elif entry["coverage"] < grid.min_coverage:
                entry["reason"] = "coverage_below_threshold"
            else:
                entry["silhouette"] = row["silhouette"]
                entry["score"] = composite(k, entry["coverage"], row["silhouette"], row["p"], n, grid)
            results.append(entry)
    results.sort(key=lambda r: (r["min_size"], r["min_samples"], r["radius"]))
    valid = [r for r in results if r["score"] is not None]
    best = min(valid, key=lambda r: (-r["score"], -r["n_clusters"], -r["coverage"], -r["silhouette"], r["min_size"], r["min_samples"], r["radius"]), default=None)
    return best, results
