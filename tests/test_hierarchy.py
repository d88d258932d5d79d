"""Spanning trees and hierarchical density clusters against a brute-force condensed tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import clustering
from corpusmill.operators import hierarchy as H
from corpusmill.operators.clustering import Grid, reduced, silhouette
from corpusmill.operators.spanning_tree import fuzzy_weights, mutual_reachability_tree, neighbour_graph
from corpusmill.sources.catalog import vectors


def by_hand(ids, v, k):
    """The spanning tree by Kruskal over all pairs."""
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(k, len(ids) - 1)]
    m = np.maximum(d, np.maximum(core[:, None], core[None]))
    edges = sorted((m[i, j], *sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in range(i))
    root, tree = {i: i for i in ids}, []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for e in edges:
        a, b = find(e[1]), find(e[2])
        if a != b:
            root[a] = b
            tree.append(e)
    return tree


def clusters_by_hand(ids, tree, size, epsilon):
    """{members: persistence} of the leaves of the condensed tree."""
    node = {i: (1, None, [i]) for i in ids}
    top = {i: i for i in ids}
    for d, x, y in tree:
        a, b = top[x], top[y]
        new = ("n", len(node))
        members = node[a][2] + node[b][2]
        node[new] = (len(members), (a, b, d), members)
        for i in members:
            top[i] = new
    root = top[ids[0]]
    rows, birth, parent, members = [], {0: 0.0}, {}, {0: node[root][2]}
    todo = [(root, 0)]
    while todo:
        at, c = todo.pop()
        n, split, own = node[at]
        if split is None:
            continue
        a, b, d = split
        big = [s for s in (a, b) if node[s][0] >= size]
        lam = 1 / d if d > 0 else np.inf
        if len(big) == 2:
            for s in big:
                k = len(birth)
                birth[k], parent[k], members[k] = lam, c, node[s][2]
                rows.append((c, lam, node[s][0]))
                todo.append((s, k))
        else:
            for s in (a, b):
                if s in big:
                    todo.append((s, c))
                else:
                    rows += [(c, lam, 1)] * node[s][0]
    most = max((lam for _, lam, _ in rows), default=0)
    chosen = set()
    for leaf in set(birth) - set(parent.values()) - {0}:
        if 1 / birth[leaf] < epsilon:
            while parent[leaf] != 0:
                leaf = parent[leaf]
                if 1 / birth[leaf] > epsilon:
                    break
        chosen.add(leaf)
    return {frozenset(members[c]): sum((lam - birth[c]) * n for p, lam, n in rows if p == c) / (len(members[c]) * most) for c in chosen}


def clusters_of(labels, clusters):
    members, share = {}, {r["cluster"]: (r["n"], r["persistence"]) for r in clusters.collect()}
    for r in labels.collect():
        members.setdefault(r["cluster"], set()).add(r["doc_id"])
    members.pop(-1, None)
    assert {c: len(m) for c, m in members.items()} == {c: n for c, (n, _) in share.items()}
    assert [min(members[c]) for c in sorted(members)] == sorted(min(m) for m in members.values())
    return {frozenset(m): share[c][1] for c, m in members.items()}


def test_condensed_trees_of_all_combinations(spark):
    points = reduced(vectors(spark, "/root/testdata/sf0.01"), 5).cache()
    rows = sorted((r["doc_id"], list(r["vector"])) for r in points.collect())
    ids, v = [i for i, _ in rows], np.array([v for _, v in rows])
    want = by_hand(ids, v, 2)
    tree = mutual_reachability_tree(points, 2, part=64)
    got = sorted(tuple(r) for r in tree.collect())
    assert [e[1:] for e in got] == [e[1:] for e in sorted(want)] and np.allclose([e[0] for e in got], [e[0] for e in sorted(want)])
    lengths = sorted(e[0] for e in want)
    sizes, epsilons = [2, 3, 5], [0.0, lengths[len(lengths) * 3 // 4], 10.0]
    labels, clusters = H.leaves(*H.basins(tree, sizes), epsilons)
    for size in sizes:
        for epsilon in epsilons:
            own = (F.col("size") == size) & (F.col("epsilon") == epsilon)
            found, expected = clusters_of(labels.filter(own), clusters.filter(own)), clusters_by_hand(ids, want, size, epsilon)
            assert found.keys() == expected.keys() and all(found[m] == pytest.approx(expected[m], abs=1e-9) for m in found)


def test_copies_and_few_points(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [0.0, 0.0]) for k in range(0, 60, 2)] + [(k, rng.normal(5, 1, 2).tolist()) for k in range(1, 60, 2)]
    df = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    tree = mutual_reachability_tree(df, 2, part=8)
    assert tree.count() == 59 and tree.filter("d = 0").count() == 29
    labels, clusters = H.leaves(*H.basins(tree, [5]), [0.0])
    assert frozenset(range(0, 60, 2)) in clusters_of(labels, clusters) and {r["persistence"] for r in clusters.collect()} == {1.0}
    with pytest.raises(ValueError):
        H.density_clusters(df.limit(2), 2, 1)


def test_tuner(spark):
    rows = vectors(spark, "/root/testdata/sf0.001")
    best, tried = H.tune(rows, Grid(min_size=(2, 4), min_samples=(1,), radius=(0.0, 0.1)))
    assert len(tried) == 4 and all((r["score"] is None) == (r["reason"] is not None) for r in tried) and (best is None or best["score"] == max(r["score"] for r in tried if r["score"] is not None))
    labels, clusters = H.leaves(*H.basins(mutual_reachability_tree(reduced(rows), 1), [2]), [0.0])
    one = H.silhouettes(rows, labels).first()["silhouette"]
    assert one == pytest.approx(silhouette(rows.select("doc_id", "vector").join(labels.drop("size", "epsilon"), "doc_id")).first()[0])
    assert next(r for r in tried if (r["min_size"], r["radius"]) == (2, 0.0))["n_clusters"] == clusters.count()


@pytest.mark.parametrize("k, part", [(4, 16), (7, 256)])
def test_neighbour_graph_and_weights(spark, k, part):
    rng = np.random.default_rng(9)
    v = np.vstack([rng.normal(0, 1, (60, 3)), rng.normal(8, 0.2, (40, 3))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(100, v[0].tolist())], "doc_id long, vector array<double>")
    graph = neighbour_graph(df, k, part)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), r + 1) for i in range(100) for r, j in enumerate(np.argsort(d[i])[:k])}
    assert {(r["doc_id"], r["neighbour"], r["rank"]) for r in graph.collect()} == want
    one = np.zeros((100, 100))
    for i in range(100):
        near = np.sort(d[i])[:k]
        beyond, rates = near - near[0], np.geomspace(1e-6, 1e3, 200_000)
        sums = np.exp(-beyond[:, None] / rates).sum(axis=0)
        one[i, np.argsort(d[i])[:k]] = np.exp(-beyond / rates[np.abs(sums - np.log2(k)).argmin()])
    both = one + one.T - one * one.T
    got = {(r["x"], r["y"]): r["weight"] for r in fuzzy_weights(graph).collect()}
    assert got.keys() == {(i, j) for i in range(100) for j in range(i + 1, 100) if both[i, j] > 0}
    assert all(w == pytest.approx(both[p], abs=1e-3) for p, w in got.items())


def test_silhouette_in_blocks(spark, monkeypatch):
    rows = vectors(spark, "/root/testdata/sf0.001")
    want = silhouette(rows).first()[0]
    monkeypatch.setattr(clustering, "CLUSTERS", 3)
    assert silhouette(rows).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("block, most", [(16, 250_000), (16, 50), (8_192, 250_000)])
def test_tree_by_blocks_is_the_tree_of_all_pairs(spark, block, most):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.integers(0, 4, (150, 3)).astype(float), rng.normal(size=(60, 3))])  # a grid has very many equal distances
    ids = rng.permutation(1_000)[:len(v)].tolist()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "doc_id long, vector array<double>")
    got = {(round(r["d"], 9), r["x"], r["y"]) for r in mutual_reachability_tree(df, 3, part=16, block=block, most=most).collect()}
    by_id = sorted(zip(ids, v.tolist()))
    first = {}
    for i, x in by_id:
        first.setdefault(tuple(x), i)
    d = np.sqrt(((np.array([x for _, x in by_id])[:, None] - np.array([x for _, x in by_id])[None]) ** 2).sum(axis=2))
    core = {i: float(np.sort(d[k])[3]) for k, (i, _) in enumerate(by_id)}
    one = [k for k, (i, x) in enumerate(by_id) if first[tuple(x)] == i]
    edges = sorted((max(d[a, b], core[by_id[a][0]], core[by_id[b][0]]), by_id[a][0], by_id[b][0]) for a in one for b in one if a < b)
    root = {by_id[k][0]: by_id[k][0] for k in one}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = {(round(core[i], 9), *sorted((i, first[tuple(x)]))) for i, x in by_id if first[tuple(x)] != i}
    for e in edges:
        if find(e[1]) != find(e[2]):
            root[find(e[1])] = find(e[2])
            want.add((round(float(e[0]), 9), e[1], e[2]))
    assert got == want


def test_tree_takes_few_jobs(spark):
    v = np.random.default_rng(4).normal(size=(400, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, vector array<double>")
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.jobsList(None).size()
    assert mutual_reachability_tree(df, 2).count() == 399
    assert store.jobsList(None).size() - before < 60


@pytest.mark.parametrize("kind", ["grid", "normal", "one"])
def test_condensed_in_one_task_is_that_of_rounds(spark, kind):
    rng = np.random.default_rng(5)
    v = {"grid": rng.integers(0, 9, (300, 2)).astype(float), "normal": rng.normal(size=(300, 3)), "one": rng.normal(size=(4, 2))}[kind]
    df = spark.createDataFrame([(3 * k, x.tolist()) for k, x in enumerate(v)], "doc_id long, vector array<double>")
    tree = mutual_reachability_tree(df, 2)
    middle = tree.selectExpr("percentile(d, 0.7)").first()[0]
    sizes, epsilons = [2, 3, 7], [0.0, middle + 0.1, 50.0]
    for a, b in zip(H.condensed(tree, sizes, epsilons), H.condensed(tree, sizes, epsilons, most=0)):
        a, b = (sorted(tuple(r) for r in df.select(a.columns).collect()) for df in (a, b))
        assert [r[:4] for r in a] == [r[:4] for r in b] and [r[-1] for r in a] == pytest.approx([r[-1] for r in b], nan_ok=True)


def test_silhouettes_in_parts_and_few_jobs(spark, monkeypatch):
    rows = vectors(spark, "/root/testdata/sf0.001").select("doc_id", "vector").cache()
    labels = rows.select(F.explode(F.array(F.lit(2), F.lit(3))).alias("size"), F.lit(0.5).alias("epsilon"), "doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(40))).cast("int").alias("cluster"))
    labels = labels.filter("size = 2 OR cluster < 30").cache()
    monkeypatch.setattr(H, "POINTS", 64)
    monkeypatch.setattr(H, "SUMS", 16)
    got = {r["size"]: r["silhouette"] for r in H.silhouettes(rows, labels).collect()}
    for size in (2, 3):
        assert got[size] == pytest.approx(silhouette(rows.join(labels.filter(F.col("size") == size).select("doc_id", "cluster"), "doc_id")).first()[0])
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.jobsList(None).size()
    H.tune(vectors(spark, "/root/testdata/sf0.001"), Grid(min_samples=(1,)))
    assert store.jobsList(None).size() - before < 150  # with rounds of joins, 542 for the two trees of sf0.01
