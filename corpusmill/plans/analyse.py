"""What a cluster is about, from its members alone (V9, V13, S17): profiles, briefs, and clusters after a review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut
from corpusmill.functions.joins import bounded
from corpusmill.functions.records import dot, unit
from corpusmill.functions.terms import named_in
from corpusmill.operators.clustering import NOISE, described
from corpusmill.operators.ranking import centroids
from corpusmill.operators.strategies import WORK_TYPES

#: Mean distances to the centroid up to which a cluster is called close, and fairly close.
CLOSE, FAIR = 0.25, 0.45


def profiles(vectors: DataFrame, k: int = 3, margin: float = 0.05, least: int = 3) -> DataFrame:
    """V9: (cluster, n_papers, mean_distance, outlier, neighbours): of (cluster, doc_id, vector), noise left out.

    The outlier is the member farthest from the centroid, if it is ``margin`` farther than the mean and the cluster has
    ``least`` members; neighbours are the ``k`` nearest clusters, as structs (distance, cluster), nearest first.
    """
    own = vectors.filter(F.col("cluster") != NOISE)
    centres = cut(centroids(own).select("cluster", "centroid"))
    each = own.join(bounded(centres), "cluster").select("cluster", "doc_id", (1 - dot(unit(F.col("vector")), F.col("centroid"))).alias("d"))
    far = F.row_number().over(Window.partitionBy("cluster").orderBy(F.round("d", 9).desc(), "doc_id"))
    sums = each.withColumn("_r", far).groupBy("cluster").agg(F.count(F.lit(1)).alias("n_papers"), F.avg("d").alias("mean_distance"), F.max("d").alias("most"), F.max(F.when(F.col("_r") == 1, F.col("doc_id"))).alias("far"))
    other = bounded(centres.select(F.col("cluster").alias("neighbour"), F.col("centroid").alias("there")))  # a row per cluster
    pairs = centres.join(other, F.col("cluster") != F.col("neighbour")).select("cluster", F.struct(F.round(1 - dot(F.col("centroid"), F.col("there")), 9).alias("distance"), F.col("neighbour").alias("cluster")).alias("n"))
    near = pairs.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_list("n")), 1, k).alias("neighbours"))
    odd = (F.col("n_papers") >= least) & (F.col("most") > F.col("mean_distance") + margin)
    return sums.join(near, "cluster", "left").select("cluster", "n_papers", "mean_distance", F.when(odd, F.col("far")).alias("outlier"), "neighbours")


def briefs(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """A brief of each cluster without asking anyone: of members (cluster, doc_id, title, text) and their vectors.

    Its theme are the first phrases, its concepts the phrases and terms that stand word for word in the cluster's texts,
    words for kinds of work that all members have, or half of them; it names the nearest clusters and the outlier.
    """
    own = members.filter(F.col("cluster") != NOISE)
    about = described(own.select("cluster", "doc_id", "text")).select("cluster", "label", "top_terms", "top_phrases")
    low = F.lower("text")
    shares = own.groupBy("cluster").agg(*[F.avg(low.contains(t).cast("double")).alias(f"_{k}") for k, t in enumerate(WORK_TYPES)])
    having = lambda least: F.array_compact(F.array(*[F.when(F.col(f"_{k}") >= least, F.lit(t)) for k, t in enumerate(WORK_TYPES)]))
    kinds = shares.select("cluster", having(1.0).alias("work_type_terms"), having(0.5).alias("work_type_signal_terms"))
    # a phrase that some member has is in the cluster's text
    phrases = about.select("cluster", F.explode(F.array_union("top_phrases", "top_terms")).alias("phrase"))
    found = own.join(bounded(cut(phrases)), "cluster").groupBy("cluster", "phrase").agg(F.max(named_in(F.col("phrase"), F.col("text"))).alias("there")).filter("there")
    kept = found.groupBy("cluster").agg(F.collect_set("phrase").alias("_kept"))
    rows = about.join(kinds, "cluster").join(profiles(vectors), "cluster", "left").join(kept, "cluster", "left")
    title = members.select(F.col("cluster"), F.col("doc_id").alias("outlier"), F.col("title").alias("_title"))
    rows = rows.join(title, ["cluster", "outlier"], "left")
    verbatim = lambda c: F.filter(c, lambda p: F.array_contains("_kept", p))
    coherence = F.when(F.col("mean_distance") <= CLOSE, "high").when(F.col("mean_distance") <= FAIR, "medium").otherwise("low")
    none = F.expr("CAST(array() AS array<struct<paper_id: string, title: string, reason: string, suggested_action: string>>)")
    odd = F.array(F.struct(F.col("outlier").cast("string").alias("paper_id"), F.col("_title").alias("title"), F.lit("farthest from the centroid").alias("reason"), F.lit("keep_with_warning").alias("suggested_action")))
    return rows.select(
        F.col("cluster").alias("cluster_id"), "label", F.array_join(F.slice("top_phrases", 1, 3), "; ").alias("synthesized_theme"), "work_type_terms", "work_type_signal_terms", coherence.alias("coherence"),
        F.col("mean_distance").alias("intra_cluster_distance_mean"), verbatim("top_phrases").alias("distinctive_concepts"), verbatim("top_terms").alias("characterizing_terms"),
        F.transform("neighbours", lambda n: n["cluster"]).alias("contrast_with"), F.when(F.col("outlier").isNotNull(), odd).otherwise(none).alias("anomalous_papers"))


def after_review(members: DataFrame, vectors: DataFrame, assignment: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(described clusters, centroids) for the ``assignment`` (cluster, doc_id) of an applied review.

    Terms, phrases, representatives and centroids are made anew for all clusters; ``labels`` (cluster, label) that a
    person gave take the place of made ones.
    """
    texts = members.select("doc_id", "text").join(assignment, "doc_id")
    given = labels.select("cluster", F.col("label").alias("_given"))
    about = described(texts).join(given, "cluster", "left").withColumn("label", F.coalesce("_given", "label")).drop("_given")
    return about, centroids(vectors.select("doc_id", "vector").join(assignment, "doc_id"))


def upserted(briefs_: DataFrame, new: DataFrame) -> DataFrame:
    """The briefs with those of ``new`` in place of the same clusters' old ones."""
    return briefs_.join(new.select("cluster_id"), "cluster_id", "left_anti").unionByName(new, allowMissingColumns=True)
