"""Clusters of vectors (V3 to V9, V13, V14, A5, A6, A13, A17, W7): density, a tuner, merging, description, stability.

Density-based labels come from the graph of near neighbours: core points, their connected components, and border
points. Neighbours are found by a grid on the first principal components, in which no distance grows, so that only
points of neighbouring cells are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut, drop
from corpusmill.functions.joins import bounded
from corpusmill.functions.records import dot, unit
from corpusmill.functions.terms import clean_terms, label
from corpusmill.operators.graph import connected_components
from corpusmill.operators.ranking import CLUSTERS, centroids
from corpusmill.operators.textscore import cluster_keyphrases, cluster_terms

NOISE = -1


#: Independent runs of many small jobs that are started together.
AT_ONCE = 4


def at_once(work: Callable, items: Iterable) -> list:
    """``work`` of each item, in order; a few at a time, as most of their time is the start of small jobs."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(work, items))


def reduced(vectors: DataFrame, k: int = 5) -> DataFrame:
    """V3: vectors (doc_id, vector) by their first ``k`` principal components, of unit vectors."""
    rows = vectors.select("doc_id", array_to_vector(unit(F.col("vector"))).alias("_v"))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(rows).transform(rows).select("doc_id", vector_to_array("_p").alias("vector"))


def near_pairs(points: DataFrame, radius: float, axes: int = 3) -> DataFrame:
    """(x, y, distance) of points (doc_id, vector) at most ``radius`` apart, x < y, by a grid on the first ``axes`` coordinates."""
    cell = F.transform(F.slice("vector", 1, axes), lambda v: F.floor(v / radius).cast("long"))
    rows = cut(points.select("doc_id", "vector", cell.alias("cell")))
    moves = [list(m) for m in product((-1, 0, 1), repeat=axes)]
    around = F.array(*[F.array(*[F.lit(d).cast("long") for d in m]) for m in moves])
    spread = rows.select(F.col("doc_id").alias("y"), F.col("vector").alias("b"), F.explode(F.transform(around, lambda m: F.zip_with(F.col("cell"), m, lambda p, d: p + d))).alias("cell"))
    pairs = rows.join(spread, "cell").filter(F.col("doc_id") < F.col("y"))
    gap = F.sqrt(F.aggregate(F.zip_with("vector", "b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    return pairs.select(F.col("doc_id").alias("x"), "y", gap.alias("distance")).filter(F.col("distance") <= radius)


def density_labels(points: DataFrame, pairs: DataFrame, radius: float, min_samples: int, min_size: int) -> DataFrame:
    """V5: (doc_id, cluster): clusters numbered from 0 by their smallest id; -1 is noise.

    A point with ``min_samples`` points, itself included, within ``radius`` is a core; cores within it are of one
    cluster, and any other point is of its nearest core's, ties to the smallest. Clusters below ``min_size`` are noise.
    """
    near = pairs.filter(F.col("distance") <= radius)
    ends = near.select(F.col("x").alias("doc_id"), F.col("y").alias("other"), "distance").unionByName(near.select(F.col("y").alias("doc_id"), F.col("x").alias("other"), "distance"))
    degree = points.select("doc_id").join(ends.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id", "left")
    cores = cut(degree.filter(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("doc_id"))
    of = lambda k: cores.select(F.col("doc_id").alias(k))
    joined = connected_components(near.join(of("x"), "x").join(of("y"), "y"), "x", "y").withColumnsRenamed({"node": "doc_id", "component": "root"})
    named = cut(cores.join(joined, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root")))
    border = ends.join(cores, "doc_id", "left_anti").join(named.withColumnRenamed("doc_id", "other"), "other")
    nearest = Window.partitionBy("doc_id").orderBy("distance", "other")
    all_ = named.unionByName(border.withColumn("_r", F.row_number().over(nearest)).filter("_r = 1").select("doc_id", "root"))
    return _numbered(points, cut(all_), min_size)


def _numbered(points: DataFrame, rooted: DataFrame, min_size: int) -> DataFrame:
    """(doc_id, cluster) of all points, from (doc_id, root) of those that are in a cluster of any size."""
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter(F.col("n") >= min_size)
    numbered = cut(sizes.withColumn("cluster", (F.row_number().over(Window.orderBy("first")) - 1).cast("int")).select("root", "cluster"))  # a row per cluster
    out = points.select("doc_id").join(rooted.join(numbered, "root"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))


#: Points of a cell that meet those around it in one task; so many of them, and of these, at a time: a matrix grows with neither.
MEETING, AT_A_TIME, COLUMNS = 4_096, 256, 8_192


def _around(known: DataFrame, visitors: DataFrame, radius: float, axes: int, work: Callable, ddl: str) -> DataFrame:
    """``work(known, visitors, near)`` in each task: the points of a cell, in pieces, and all visitors of it and its neighbours.

    Both are (id, v, w, cell, core). ``near`` gives (rows, columns, distances): some of the known and, turn by turn, all visitors that may be within the radius.
    """
    kept = ("id", "v", "w", "core")
    pieces = known.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / MEETING).cast("int").alias("pieces"))
    own = known.join(pieces, "cell").select(F.lit(0).alias("side"), "cell", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), *kept)
    moves = F.array(*[F.array(*[F.lit(d).cast("long") for d in m]) for m in product((-1, 0, 1), repeat=axes)])
    sent = visitors.select(F.explode(F.transform(moves, lambda m: F.zip_with("cell", m, lambda p, d: p + d))).alias("cell"), *kept)
    sent = sent.join(pieces, "cell").select(F.lit(1).alias("side"), "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), *kept)
    reach = radius * (1 + 1e-9) + 1e-12

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        ids, w, core = (table[c].to_numpy() for c in ("id", "w", "core"))
        v = table["v"].combine_chunks().flatten().to_numpy().reshape(len(side), -1)
        parts = []
        for k in (0, 1):
            at = np.flatnonzero(side == k)
            at = at[np.argsort(v[at, -1], kind="stable")] if len(at) else at
            parts.append({"id": ids[at], "w": w[at], "core": core[at], "v": v[at] if len(at) else np.zeros((0, v.shape[1]))})
        a, b = parts

        def near() -> Iterator[tuple[slice, slice, np.ndarray]]:
            for first in range(0, len(a["id"]), AT_A_TIME):
                rows = slice(first, min(first + AT_A_TIME, len(a["id"])))
                low, high = a["v"][rows.start, -1] - reach, a["v"][rows.stop - 1, -1] + reach
                start, stop = int(np.searchsorted(b["v"][:, -1], low, "left")), int(np.searchsorted(b["v"][:, -1], high, "right"))
                for at in range(start, stop, COLUMNS):
                    columns = slice(at, min(at + COLUMNS, stop))
                    squares = np.zeros((rows.stop - rows.start, columns.stop - columns.start))
                    for x in range(v.shape[1]):  # one coordinate after the other, as the sum of a row is
                        squares += (a["v"][rows, x][:, None] - b["v"][columns, x][None, :]) ** 2
                    yield rows, columns, np.sqrt(squares)

        return work(a, b, near)

    return own.unionByName(sent).groupBy("cell", "piece").applyInArrow(run, ddl)


def rooted_within(points: DataFrame, radius: float, min_samples: int, axes: int = 3) -> DataFrame:
    """(doc_id, root) of the points of ``density_labels`` that are in a cluster of any size, without a table of near pairs.

    Points (doc_id, vector) have three coordinates at least. Equal ones are one with a weight. Those of a cell of the grid
    meet all around it as matrices: first cores are told, then cores within the radius are joined, and of those a task
    gives a tree at most, and any other point's nearest core.
    """
    cell = F.transform(F.slice("vector", 1, axes), lambda v: F.floor(v / radius).cast("long"))
    rows = cut(points.filter("vector IS NOT NULL").groupBy("vector").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("w")).select("id", F.transform("vector", lambda x: x.cast("double")).alias("v"), "w", cell.alias("cell"), F.lit(True).alias("core"), "vector"))
    plain = rows.drop("vector")

    def counted(a: dict, b: dict, near: Callable) -> pa.Table:
        n = np.zeros(len(a["id"]), np.int64)
        for r, c, d in near():
            n[r] += (d <= radius) @ b["w"][c]
        return pa.table({"id": pa.array(a["id"], pa.int64()), "core": pa.array(n >= min_samples, pa.bool_())})

    def linked(a: dict, b: dict, near: Callable) -> pa.Table:
        parent = np.arange(len(b["id"]))
        met, least, nearest = np.full(len(a["id"]), -1), np.full(len(a["id"]), np.inf), np.zeros(len(a["id"]), np.int64)

        def roots(at: np.ndarray) -> np.ndarray:
            while not np.array_equal(up := parent[at], at):
                at = up
            return at

        for r, c, d in near():
            within = d <= radius
            for k, i in enumerate(range(r.start, r.stop)):
                js = np.flatnonzero(within[k])
                if not len(js):
                    continue
                if a["core"][i]:
                    some = js + c.start if met[i] < 0 else np.append(js + c.start, met[i])  # with one of the turns before
                    found = roots(some)
                    parent[found] = parent[some] = found.min()
                    met[i] = some[0]
                else:
                    first = js[np.lexsort((b["id"][js + c.start], d[k][js]))[0]]
                    if (d[k][first], b["id"][first + c.start]) < (least[i], nearest[i]):
                        least[i], nearest[i] = d[k][first], b["id"][first + c.start]
        top = roots(np.arange(len(parent)))
        moved = np.flatnonzero(top != np.arange(len(parent)))
        border = np.flatnonzero(least < np.inf)
        ids = np.concatenate([b["id"][moved], a["id"][border]])
        others = np.concatenate([b["id"][top[moved]], nearest[border]])
        return pa.table({"id": pa.array(ids, pa.int64()), "other": pa.array(others, pa.int64()), "border": pa.array(np.arange(len(ids)) >= len(moved), pa.bool_())})

    told = cut(_around(plain, plain, radius, axes, counted, "id bigint, core boolean"))
    known = cut(plain.drop("core").join(told, "id"))
    links = cut(_around(known, known.filter("core"), radius, axes, linked, "id bigint, other bigint, border boolean"))
    joined = connected_components(links.filter("NOT border"), "id", "other").select(F.col("node").alias("id"), F.col("component").alias("root"))
    named = told.filter("core").select("id").join(joined, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    all_ = named.unionByName(links.filter("border").select(F.col("id").alias("own"), F.col("other").alias("id")).join(named, "id").select(F.col("own").alias("id"), "root"))
    out = cut(points.select("doc_id", "vector").join(rows.select("id", "vector").join(all_, "id"), "vector").select("doc_id", "root"))
    drop(rows, told, known, links)
    return out


def labels_within(points: DataFrame, radius: float, min_samples: int, min_size: int) -> DataFrame:
    """V5: what ``density_labels`` gives for the near pairs of the points, which aren't made."""
    return _numbered(points, rooted_within(points, radius, min_samples), min_size)


def silhouette(vectors: DataFrame) -> DataFrame:
    """One row: the mean silhouette by cosine distance of (cluster, vector), noise left out, from one sum for each cluster.

    The sum vectors travel to every task, in one row of at most ``CLUSTERS`` at a time. Single members count 0.
    """
    rows = vectors.filter(F.col("cluster") != NOISE).select("doc_id", "cluster", unit(F.col("vector")).alias("v"))
    cells = rows.select("cluster", F.posexplode("v").alias("k", "x")).groupBy("cluster", "k").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    sums = cells.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda c: c["s"]).alias("sum"), F.max("n").alias("n"))
    sums = cut(sums)
    blocks, gaps = max(1, -(-sums.count() // CLUSTERS)), None
    for k in range(blocks):  # so many sums at a time that they fit into a row
        some = sums.filter(F.pmod(F.xxhash64("cluster"), F.lit(blocks)) == k) if blocks > 1 else sums
        one = some.agg(F.collect_list(F.struct("cluster", "sum", "n")).alias("_all"))
        e = rows.crossJoin(F.broadcast(one)).select("doc_id", "cluster", F.transform("_all", lambda c: F.struct(c["cluster"].alias("c"), c["n"].alias("n"), dot(c["sum"], F.col("v")).alias("dot"))).alias("t"))  # one row
        own = F.get(F.filter("t", lambda c: c["c"] == F.col("cluster")), F.lit(0))
        a = F.when(own["n"] > 1, (own["n"] - own["dot"]) / (own["n"] - 1))
        b = F.array_min(F.transform(F.filter("t", lambda c: c["c"] != F.col("cluster")), lambda c: 1 - c["dot"] / c["n"]))
        part = e.select("doc_id", "cluster", a.alias("a"), b.alias("b"))
        gaps = part if gaps is None else gaps.unionByName(part)
    if blocks > 1:
        gaps = gaps.groupBy("doc_id", "cluster").agg(F.max("a").alias("a"), F.min("b").alias("b"))
    return gaps.agg(F.avg(F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0))).alias("silhouette"))


def tightness(vectors: DataFrame) -> DataFrame:
    """One row: the mean over clusters, noise left out, of the mean cosine of members to their centroid: it stands for persistence."""
    own = vectors.filter(F.col("cluster") != NOISE)
    centres = centroids(own).select("cluster", "centroid")
    each = own.join(bounded(cut(centres)), "cluster").groupBy("cluster").agg(F.avg(dot(unit(F.col("vector")), F.col("centroid"))).alias("m"))
    return each.agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("tightness"))


@dataclass(frozen=True)
class Grid:
    """V4: what is tried, and how much each factor of the score weighs."""

    min_size: tuple[int, ...] = (2, 3, 4, 5)
    min_samples: tuple[int, ...] = (1, 2)
    radius: tuple[float, ...] = (0.0, 0.05, 0.1)
    min_coverage: float = 0.5
    min_clusters: int = 2
    granularity_floor: int = 10
    weights: tuple[float, float, float, float] = (1.0, 1.0, 2.0, 0.5)


def composite(n_clusters: int, coverage: float, sil: float, tight: float, n: int, grid: Grid) -> float:
    """Silhouette, coverage, number of clusters against the wanted one, and tightness, each to the power of its weight."""
    wanted = max(grid.granularity_floor, round(n**0.5))
    factors = (max(0.0, sil), coverage, min(1.0, n_clusters / wanted), max(0.0, tight))
    out = 1.0
    for f, w in zip(factors, grid.weights):
        out *= f**w
    return out


def tune(vectors: DataFrame, grid: Grid, base_radius: float, dimensions: int = 5) -> tuple[dict | None, list[dict]]:
    """(the best parameters, a row for each that was tried): labels by density on reduced vectors, scores on the whole ones.

    ``radius`` of the grid adds to ``base_radius``. What is near within a radius is found once for all sizes.
    Without a valid combination the best is None. Of equal scores: more clusters, more coverage, a better silhouette,
    smaller parameters.
    """
    points = cut(reduced(vectors, dimensions))
    n = points.count()
    asked = sorted(set(product(grid.min_samples, grid.radius)))
    rooted = dict(zip(asked, at_once(lambda a: rooted_within(points, base_radius + a[1], a[0]), asked)))

    def tried(combination: tuple[int, int, float]) -> dict:
        size, samples, extra = combination
        labels = cut(_numbered(points, rooted[samples, extra], size))
        row = labels.agg(F.count_distinct(F.when(F.col("cluster") != NOISE, F.col("cluster"))).alias("k"), F.count_if(F.col("cluster") != NOISE).alias("c")).first()
        entry = {"min_size": size, "min_samples": samples, "radius": extra, "n_clusters": row["k"], "coverage": row["c"] / n if n else 0.0, "silhouette": None, "tightness": None, "score": None, "reason": None}
        if row["k"] < grid.min_clusters:
            entry["reason"] = "fewer_than_min_clusters"
        elif entry["coverage"] < grid.min_coverage:
            entry["reason"] = "coverage_below_threshold"
        else:
            known = vectors.select("doc_id", "vector").join(labels, "doc_id")
            entry["silhouette"] = silhouette(known).first()[0]
            entry["tightness"] = tightness(known).first()[0]
            entry["score"] = composite(row["k"], entry["coverage"], entry["silhouette"], entry["tightness"], n, grid)
        drop(labels)
        return entry

    results = at_once(tried, sorted(product(grid.min_size, grid.min_samples, grid.radius)))
    valid = [r for r in results if r["score"] is not None]
    best = min(valid, key=lambda r: (-r["score"], -r["n_clusters"], -r["coverage"], -r["silhouette"], r["min_size"], r["min_samples"], r["radius"]), default=None)
    drop(points, *rooted.values())
    return best, results


def cluster_vectors(vectors: DataFrame, parameters: dict, base_radius: float, dimensions: int = 5) -> DataFrame:
    """(doc_id, cluster) with tuned parameters; fewer than three vectors are an error."""
    points = cut(reduced(vectors, dimensions))
    if points.limit(3).count() < 3:
        raise ValueError("three papers at least are needed")
    radius = base_radius + parameters["radius"]
    return labels_within(points, radius, parameters["min_samples"], parameters["min_size"])


def merged_clusters(vectors: DataFrame, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """V6: ((cluster, merged_into), (cluster_a, cluster_b, similarity)) of clusters whose centroids are alike; noise is none of them.

    The smallest of merged clusters gives the name. Merges are the pairs, in ascending order, that join two groups.
    """
    centres = cut(centroids(vectors.filter(F.col("cluster") != NOISE)).select("cluster", "centroid"))
    other = bounded(centres.select(F.col("cluster").alias("b"), F.col("centroid").alias("d")))  # a row per cluster
    pairs = cut(centres.join(other, F.col("cluster") < F.col("b")).select(F.col("cluster").alias("cluster_a"), F.col("b").alias("cluster_b"), dot(F.col("centroid"), F.col("d")).alias("similarity")).filter(F.col("similarity") >= threshold))
    joined = connected_components(pairs, "cluster_a", "cluster_b").withColumnsRenamed({"node": "cluster", "component": "to"})
    names = centres.select("cluster").join(joined, "cluster", "left").select("cluster", F.coalesce("to", "cluster").alias("merged_into"))
    root, merges = {}, []
    for r in pairs.orderBy("cluster_a", "cluster_b").collect():  # few clusters, fewer pairs
        a, b = r["cluster_a"], r["cluster_b"]
        while root.get(a, a) != a:
            a = root[a]
        while root.get(b, b) != b:
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
            merges.append((r["cluster_a"], r["cluster_b"], r["similarity"]))
    kind = vectors.schema["cluster"].dataType.simpleString()
    return names, vectors.sparkSession.createDataFrame(merges, f"cluster_a {kind}, cluster_b {kind}, similarity double")


def topic_distances(centres: DataFrame) -> DataFrame:
    """(a, b, distance), a < b, of centroids (cluster, centroid): one less their cosine, within 0 and 2; a zero one is at 1 from all others."""
    rows = cut(centres.select("cluster", unit(F.col("centroid")).alias("v")))
    other = bounded(rows.select(F.col("cluster").alias("b"), F.col("v").alias("w")))  # a row per cluster
    cosine = F.when(F.forall("v", lambda x: x == 0) | F.forall("w", lambda x: x == 0), 0.0).otherwise(dot(F.col("v"), F.col("w")))
    pairs = rows.withColumnRenamed("cluster", "a").join(other, F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - cosine)).alias("distance"))


def described(members: DataFrame) -> DataFrame:
    """One row for each cluster of (cluster, doc_id, text): label, top_terms, top_phrases, paper_ids, representative_paper_ids, is_noise.

    Ids ascend and the first three represent the cluster. A cluster of noise has terms, but no phrases are drawn from
    its own weight alone: it counts as a cluster like any other.
    """
    terms = cluster_terms(members.select("cluster", "text")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("_terms"))
    phrases = cluster_keyphrases(members.select("cluster", "text"))
    ids = members.groupBy("cluster").agg(F.array_sort(F.collect_list("doc_id")).alias("paper_ids"))
    rows = ids.join(terms, "cluster", "left").join(phrases, "cluster", "left")
    none = F.expr("CAST(array() AS array<string>)")
    top = F.coalesce(clean_terms(F.col("_terms"), 10), none)
    name = F.when(F.size(top) > 0, label(top)).otherwise(F.concat(F.lit("Topic "), F.col("cluster").cast("string")))
    return rows.select("cluster", name.alias("label"), top.alias("top_terms"), F.coalesce("phrases", none).alias("top_phrases"), "paper_ids", F.slice("paper_ids", 1, 3).alias("representative_paper_ids"), (F.col("cluster") == NOISE).alias("is_noise"))


def size_statistics(labels: DataFrame) -> DataFrame:
    """A5: one row of (cluster) rows: clusters without noise, their least, largest, mean and median size, noise, and coverage."""
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("cluster") != NOISE, F.col("n"))
    noise = F.coalesce(F.sum(F.when(F.col("cluster") == NOISE, F.col("n"))), F.lit(0))
    return sizes.agg(F.count(own).alias("n_clusters"), F.min(own).alias("smallest"), F.max(own).alias("largest"), F.avg(own).alias("mean"), F.median(own).alias("median"), noise.alias("n_noise"), (1 - noise / F.sum("n")).alias("coverage"))


def adjusted_rand(labels: DataFrame) -> DataFrame:
    """One row: agreement of labels ``a`` and ``b``, from their contingency table; 1 where there is nothing to tell apart."""
    table = labels.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    both = table.agg(pairs.alias("i"), F.sum("n").alias("n"))
    side = lambda k, to: table.groupBy(k).agg(F.sum("n").alias("n")).agg(pairs.alias(to))
    row = both.join(side("a", "x")).join(side("b", "y"))  # one row each
    expected = F.col("x") * F.col("y") / (F.col("n") * (F.col("n") - 1) / 2)
    return row.select("n", F.coalesce(F.try_divide(F.col("i") - expected, (F.col("x") + F.col("y")) / 2 - expected), F.lit(1.0)).alias("ari"))


def core_survival(labels: DataFrame, core: DataFrame) -> DataFrame:
    """One row: the largest share of the core's documents (doc_id) that stay in one cluster."""
    counts = labels.join(core, "doc_id", "left_semi").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.max("n") / F.sum("n")).alias("core_survival"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_core"))


def ablation(vectors: DataFrame, parameters: dict, base_radius: float, core: DataFrame, named: dict[str, list[int]], draws: int = 5, share: float = 0.15) -> list[dict]:
    """How labels hold when documents go: none, each named set, and ``draws`` random shares with fixed seeds.

    Each scenario has the adjusted Rand index on common documents, the core's survival and the number of clusters. A
    share are the documents whose hash with the seed falls below it, so that no ids are drawn anywhere.
    """
    spark, kind = vectors.sparkSession, vectors.schema["doc_id"].dataType.simpleString()
    reference = cut(cluster_vectors(vectors, parameters, base_radius).withColumnRenamed("cluster", "a"))
    listed = {name: vectors.join(F.broadcast(spark.createDataFrame([(k,) for k in gone], f"doc_id {kind}")), "doc_id", "left_anti") for name, gone in named.items()}  # short lists
    drawn = {f"random {1000 + k}": vectors.filter(F.pmod(F.xxhash64("doc_id", F.lit(1000 + k)), F.lit(10_000)) >= round(10_000 * share)) for k in range(draws)}
    n = vectors.count()

    def held(scenario: tuple[str, DataFrame]) -> dict:
        name, left = scenario
        new = cut(cluster_vectors(left, parameters, base_radius))
        ari = adjusted_rand(reference.join(new.withColumnRenamed("cluster", "b"), "doc_id")).first()["ari"]
        rest = core_survival(new, core).first()
        counts = new.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("k")).first()
        drop(new)
        return {"scenario": name, "n_dropped": n - counts["n"], "ari": round(ari, 3), "core_survival": None if rest["core_survival"] is None else round(rest["core_survival"], 3), "n_core": rest["n_core"], "n_clusters": counts["k"]}

    out = at_once(held, ({"full set": vectors} | listed | drawn).items())
    drop(reference)
    return out
