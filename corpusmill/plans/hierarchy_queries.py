"""Queries on neighbours, spanning trees and hierarchical density clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import hierarchy as H
from corpusmill.operators.clustering import Grid, reduced
from corpusmill.operators.spanning_tree import fuzzy_weights, mutual_reachability_tree, neighbour_distances, neighbour_graph
from corpusmill.plans.queries import query
from corpusmill.sources.catalog import vectors


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
 n AS (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS k FROM p QUALIFY k <= 3)
 SELECT vec_id AS doc_id, round(max(d) FILTER (k = 1), 6) AS first, round(max(d) FILTER (k = 2), 6) AS second, round(max(d) FILTER (k = 3), 6) AS third FROM n GROUP BY vec_id""")
def nearest_neighbours(spark, d):
    """V3: distances of every vector to its three nearest others, exact."""
    rows = neighbour_distances(vectors(spark, d), 3)
    return rows.select("doc_id", *[F.round(F.get("distances", F.lit(k)), 6).alias(name) for k, name in enumerate(("first", "second", "third"))])


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS other, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id)
 SELECT vec_id AS doc_id, other AS neighbour, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS INTEGER) AS rank, round(d, 6) AS distance FROM p QUALIFY rank <= 10""")
def nearest_graph(spark, d):
    """V3: the ten nearest neighbours of every vector, exact."""
    return neighbour_graph(vectors(spark, d), 10).withColumn("distance", F.round("distance", 6))


@query()
def fuzzy_graph(spark, d):
    """V3: how surely neighbours belong together; tested against numpy."""
    return fuzzy_weights(neighbour_graph(vectors(spark, d), 10)).withColumn("weight", F.round("weight", 6))


@query()
def spanning_tree(spark, d):
    """V5: the minimum spanning tree of all vectors by mutual reachability; tested against all pairs."""
    tree = mutual_reachability_tree(reduced(vectors(spark, d)), 2)
    return tree.select("x", "y", F.round("d", 9).alias("distance"))


@query()
def hierarchical_clusters(spark, d):
    """V5: leaves of the condensed tree; tested against a brute-force one."""
    return H.density_clusters(reduced(vectors(spark, d)), 3, 1, 0.05)[0]


@query()
def hierarchical_tuner(spark, d):
    """All 24 combinations, two trees for them."""
    best, tried = H.tune(vectors(spark, d), Grid(radius=(0.0, 0.1, 0.2)))
    rows = [(r["min_size"], r["min_samples"], r["radius"], r["n_clusters"], r["coverage"], r["silhouette"], r["persistence"], r["score"], r["reason"], r is best) for r in tried]
    out = spark.createDataFrame(rows, "min_size int, min_samples int, epsilon double, n_clusters bigint, coverage double, silhouette double, persistence double, score double, reason string, best boolean")
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "silhouette", "persistence", "score")})
