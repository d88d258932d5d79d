"""Sampling, recall and ranking of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut
from corpusmill.functions.records import citation_velocity, cosine, dot, let, recency, unit
from corpusmill.operators.matching import seed_overlap
from corpusmill.operators.textscore import tfidf_cosine

#: The weights of the hybrid score; they aren't normalised.
WEIGHTS = {"lexical": 0.15, "semantic": 0.25, "concept": 0.15, "seed_overlap": 0.15, "recency": 0.10, "velocity": 0.10, "work_type": 0.10}
NOISE = -1
#: Clusters up to which all centroids travel in one row to every task.
CLUSTERS = 5_000


def top_by_year(catalog: DataFrame, reference: int, window: int = 5, per_year: int = 75) -> DataFrame:
    """The most cited of each of the last years, with their rank over all years ascending, from 0.

    The row number over (year) plans a partial and a final group limit: at most ``per_year`` rows of a year and task
    are shuffled.
    """
    recent = catalog.filter(F.col("year").between(reference - window + 1, reference))
    order = Window.partitionBy("year").orderBy(F.col("citations").desc(), "doc_id")
    top = recent.withColumn("rank_in_year", F.row_number().over(order)).filter(F.col("rank_in_year") <= per_year)
    return top


def hit_counts(catalog: DataFrame, queries: dict[str, Column]) -> DataFrame:
    """Hits of many predicates in one pass, and whether a query is too broad."""
    row = catalog.agg(*[F.count(F.when(p, 1)).alias(k) for k, p in queries.items()])
    stacked = ", ".join(f"'{k}', `{k}`" for k in queries)
    return row.selectExpr(f"stack({len(queries)}, {stacked}) AS (query, hits)").withColumn("too_broad", F.col("hits") > 5000)


def coverage(seeds: DataFrame, catalog: DataFrame, predicate: Column) -> DataFrame:
    """Seeds (doi) that are in the catalog, and that the query finds: recall of those, and of all."""
    known = catalog.filter("doi IS NOT NULL").groupBy("doi").agg(F.max(predicate.cast("int")).alias("hit"))
    rows = seeds.join(known, "doi", "left")
    n, probeable, found = F.count(F.lit(1)), F.count("hit"), F.count_if(F.col("hit") == 1)
    return rows.agg(n.alias("n_seeds"), probeable.alias("n_probeable"), found.alias("n_found"), F.coalesce(F.try_divide(found.cast("double"), probeable), F.lit(0.0)).alias("recall_probeable"), F.coalesce(F.try_divide(found.cast("double"), n), F.lit(0.0)).alias("recall_total"))


def centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector of each cluster but noise, of length one, and the cluster's size."""
    each = vectors.filter(F.col("cluster") != NOISE).select("cluster", F.posexplode("vector").alias("k", "v"))
    means = each.groupBy("cluster", "k").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    rows = means.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("a"), F.max("n").alias("size"))
    mean = F.transform("a", lambda s: s["m"])
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda s, v: s + v * v))
    return rows.select("cluster", "size", F.transform(mean, lambda v: F.when(norm > 0, v / norm).otherwise(v)).alias("centroid"))


def similarities(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """``vectors`` with ``_all``: structs (similarity, less: the cluster below zero) with each centroid.

    The centroids travel to every task in one row, so no vector is shuffled. Vectors are brought to length one before,
    not once for each centroid. More than ``CLUSTERS`` centroids are an error: such a table is no set of topics.
    """
    centres = cut(centres.select("cluster", "centroid"))
    if centres.count() > CLUSTERS:
        raise ValueError(f"more than {CLUSTERS} clusters")
    row = centres.agg(F.collect_list(F.struct("cluster", "centroid")).alias("_centres"))
    rows = vectors.crossJoin(F.broadcast(row))  # one row
    zero = F.forall("vector", lambda x: x == 0)
    near = lambda v: F.transform("_centres", lambda c: F.struct(F.round(dot(v, c["centroid"]), 9).alias("similarity"), (-c["cluster"]).alias("less")))
    return rows.withColumn("_all", F.when(~zero, let(unit(F.col("vector")), near))).drop("_centres")


def membership(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """Nearest centroid of each vector (ties: smallest cluster), its similarity and whether it is the own one.

    A zero vector is near none: its match is unknown.
    """
    best = similarities(vectors, centres).withColumn("_best", F.array_max("_all"))
    near = -F.col("_best.less")
    return best.select("doc_id", "cluster", near.alias("nearest_topic"), F.col("_best.similarity").alias("similarity"), (near == F.col("cluster")).alias("cluster_match"))


def focused(members: DataFrame, least: float | None = None, mode: str = "match") -> DataFrame:
    """Members that stay, with ``focus_rank`` in their cluster, by similarity, then the final score if there is one.

    ``mode`` "match" keeps those nearest to their own cluster, "all" keeps every one; ``least`` is an optional threshold.
    """
    kept = members.filter("cluster_match") if mode == "match" else members
    kept = kept if least is None else kept.filter(F.col("similarity") >= least)
    final = [F.round("final", 9).desc()] if "final" in kept.columns else []
    order = Window.partitionBy("cluster").orderBy(F.round("similarity", 6).desc(), *final, "doc_id")
    return kept.withColumn("focus_rank", F.row_number().over(order).cast("long"))


def quality_report(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """For each cluster, and ALL: kept rows, affinity, final score, means and contributions of the components, and the strongest.

    ``rows`` are (cluster, cluster_match, similarity, final, and the components). Medians of ALL come from counts of
    values rounded to six places, so no task sorts all rows. The strongest has the largest mean, weighted if weights are
    given; of equals the first; none where all are 0.
    """
    parts = [c for c in WEIGHTS if c in rows.columns]
    kept = F.col("cluster_match")
    inside = lambda c: F.when(kept, F.col(c))
    figures = [F.count(F.lit(1)).alias("n_input"), F.count_if(kept).alias("n_kept"), F.coalesce(F.avg(inside("similarity")), F.lit(0.0)).alias("affinity_mean"),
               F.coalesce(F.min(inside("similarity")), F.lit(0.0)).alias("affinity_min"), F.count_if(kept & (F.col("similarity") < 0.30)).alias("n_affinity_below_0_3"), F.coalesce(F.avg(inside("final")), F.lit(0.0)).alias("final_mean")]
    figures += [F.coalesce(F.avg(inside(c)), F.lit(0.0)).alias(f"mean_{c}") for c in parts]
    name = F.when(F.grouping("cluster") == 1, "ALL").otherwise(F.col("cluster").cast("string"))
    table = rows.rollup("cluster").agg(*figures, name.alias("_name"))
    out = table.select(F.col("_name").alias("cluster"), *[c for c in table.columns if c not in ("cluster", "_name")])
    for c in ("similarity", "final"):
        counted = rows.filter(kept & F.col(c).isNotNull()).groupBy("cluster", F.round(c, 6).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        both = counted.select(F.col("cluster").cast("string").alias("cluster"), "v", "n").unionByName(counted.groupBy("v").agg(F.sum("n").alias("n")).select(F.lit("ALL").alias("cluster"), "v", "n"))
        # the middle of the sorted values: where the running count passes it
        upto = F.sum("n").over(Window.partitionBy("cluster").orderBy("v"))
        total = F.sum("n").over(Window.partitionBy("cluster"))
        ranged = both.withColumns({"_to": upto, "_all": total}).withColumn("_from", F.col("_to") - F.col("n"))
        low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
        covers = lambda at: (F.col("_from") <= at) & (at < F.col("_to"))
        median = ranged.groupBy("cluster").agg(((F.max(F.when(covers(low), F.col("v"))) + F.max(F.when(covers(high), F.col("v")))) / 2).alias(f"{'affinity' if c == 'similarity' else c}_median"))
        out = out.join(median, "cluster", "left")
    worth = {c: F.col(f"mean_{c}") * (weights.get(c, 0.0) if weights else 1.0) for c in parts}
    most = F.greatest(*worth.values()) if len(worth) > 1 else next(iter(worth.values()))
    strongest = F.coalesce(*[F.when((w == most) & F.greatest(*[x != 0 for x in worth.values()], F.lit(False)), F.lit(c)) for c, w in worth.items()])
    return out.withColumns({"kept_pct": F.try_divide(100.0 * F.col("n_kept"), F.col("n_input")), "strongest": strongest} | {f"contribution_{c}": w for c, w in worth.items() if weights})


def rank_candidates(candidates: DataFrame, clusters: DataFrame, seeds: DataFrame, reference: int, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Candidates (cluster, doc_id, text, vector, year, citations) with the seven components, final and rank.

    ``clusters`` are (cluster, query, vector, phrases, work_types): a text and a vector for the cluster, phrases whose
    share in a text is the concept score, and words for kinds of work. ``seeds`` are (cluster, doc_id, vector).
    """
    among = lambda low, phrases: F.size(F.filter(phrases, lambda p: low.contains(F.lower(p)))).cast("double") / F.size(phrases)
    share = lambda phrases: F.coalesce(F.when(F.size(phrases) > 0, let(F.lower("text"), lambda low: among(low, phrases))), F.lit(0.0))
    about = F.broadcast(clusters.select("cluster", F.col("vector").alias("_topic"), "phrases", "work_types")) if clusters.count() <= CLUSTERS else clusters.select("cluster", F.col("vector").alias("_topic"), "phrases", "work_types")
    lexical = tfidf_cosine(candidates.select("cluster", "doc_id", "text"), clusters.select("cluster", F.col("query").alias("text")))
    rows = candidates.join(about, "cluster").withColumns({"semantic": F.coalesce(cosine(F.col("vector"), F.col("_topic")), F.lit(0.0)), "concept": share(F.col("phrases")), "work_type": share(F.col("work_types"))})
    keys = ["cluster", "doc_id"]
    rows = rows.select(*keys, "year", "citations", "semantic", "concept", "work_type").join(lexical, keys).join(seed_overlap(candidates, seeds), keys)
    return rank_within(hybrid_score(rows, reference, weights), "cluster")


def hybrid_score(candidates: DataFrame, reference: int, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """V2: weighted sum of the components in columns of their names; recency and velocity come from year and citations."""
    rows = candidates.withColumns({"recency": recency(F.col("year"), reference), "velocity": citation_velocity(F.col("citations"), F.col("year"), reference)})
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * F.coalesce(F.col(name), F.lit(0.0))
    return rows.withColumn("final", total)


def rank_within(rows: DataFrame, group: str, k: int | None = None) -> DataFrame:
    """Rank by the final score within a group, ties by doc_id; the first ``k`` if given."""
    order = Window.partitionBy(group).orderBy(F.round("final", 9).desc(), "doc_id")
    out = rows.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.filter(F.col("rank") <= k)
