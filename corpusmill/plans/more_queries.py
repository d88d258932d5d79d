"""Further queries: text scores, clusters, loops and record merging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import records as R
from corpusmill.functions.checkpointing import cut
from corpusmill.functions.joins import bounded
from corpusmill.operators import ranking as K
from corpusmill.operators import review
from corpusmill.plans.queries import _CENTROIDS, _p, query
from corpusmill.sources.catalog import papers, vectors


@query(f"""WITH {_CENTROIDS}, x AS (SELECT vec_id AS doc_id, v.label AS cluster, 1 - list_cosine_similarity(embedding::DOUBLE[], centroid) AS d FROM embeddings v JOIN centroids c ON c.cluster = v.label)
 SELECT cluster, round(avg(d), 6) AS mean_distance, CASE WHEN count(*) >= 3 AND max(d) > avg(d) + 0.05 THEN min(doc_id) FILTER (round(d, 9) = m) END AS outlier FROM (SELECT *, max(round(d, 9)) OVER (PARTITION BY cluster) AS m FROM x) GROUP BY cluster""")
def intra_distance_outlier(spark, d):
    """Mean distance to the centroid, and the farthest member if it is far enough."""
    v = vectors(spark, d)
    x = v.join(bounded(cut(K.centroids(v).select("cluster", "centroid"))), "cluster").select("cluster", "doc_id", (1 - R.cosine(F.col("vector"), F.col("centroid"))).alias("d"))
    far = F.row_number().over(Window.partitionBy("cluster").orderBy(F.round("d", 9).desc(), "doc_id"))
    a = x.withColumn("_r", far).groupBy("cluster").agg(F.avg("d").alias("m"), F.max("d").alias("most"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("_r") == 1, F.col("doc_id"))).alias("o"))
    return a.select("cluster", F.round("m", 6).alias("mean_distance"), F.when((F.col("n") >= 3) & (F.col("most") > F.col("m") + 0.05), F.col("o")).alias("outlier"))


@query(_p("SELECT doc_id, min(it) AS first_iteration, string_agg(CAST(it AS VARCHAR), ',' ORDER BY it) AS iterations FROM (SELECT doc_id, 1 AS it FROM papers WHERE year >= 2022 UNION ALL SELECT doc_id, 2 FROM papers WHERE citations > 150 UNION ALL SELECT doc_id, 3 FROM papers WHERE subject = 'fr') GROUP BY doc_id HAVING min(it) <= 2"))
def final_pool(spark, d):
    """Rows of all iterations by paper, those found up to the best iteration."""
    p = papers(spark, d)
    pool = None
    for k, cond in enumerate(("year >= 2022", "citations > 150", "subject = 'fr'"), 1):
        rows = p.filter(cond).select("doc_id", F.lit(k).alias("it"))
        pool = rows if pool is None else pool.unionByName(rows)
    found = pool.groupBy("doc_id").agg(F.array_sort(F.collect_set("it")).alias("its"))
    return found.filter(F.array_min("its") <= 2).select("doc_id", F.array_min("its").alias("first_iteration"), F.array_join(F.transform("its", lambda i: i.cast("string")), ",").alias("iterations"))


_REVIEW = "SELECT (label + CASE WHEN vec_id % 17 = 0 THEN 1 ELSE 0 END) AS cluster_id, vec_id AS paper_id FROM embeddings WHERE vec_id % 50 <> 0 UNION ALL SELECT 3, 7 UNION ALL SELECT 1, -5"


@query(f"""WITH r AS ({_REVIEW}), o AS (SELECT label AS cluster_id, vec_id AS paper_id FROM embeddings) SELECT DISTINCT 'phantom' AS kind, paper_id FROM r WHERE paper_id NOT IN (SELECT paper_id FROM o)
 UNION SELECT 'duplicate', paper_id FROM r GROUP BY paper_id HAVING count(*) > 1 UNION SELECT 'unassigned', paper_id FROM o WHERE paper_id NOT IN (SELECT paper_id FROM r)""")
def review_violations(spark, d):
    """What makes a review invalid."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("paper_id"))
    r = e.filter("paper_id % 50 <> 0").withColumn("cluster_id", F.col("cluster_id") + F.when(F.col("paper_id") % 17 == 0, 1).otherwise(0))
    return review.violations(e, r.unionByName(spark.createDataFrame([(3, 7), (1, -5)], "cluster_id int, paper_id long")))


@query(_p("SELECT v.label AS cluster, v.vec_id AS paper, coalesce(p.title, f.text) AS title FROM embeddings v LEFT JOIN (SELECT * FROM papers WHERE doc_id % 4 <> 0) p ON p.doc_id = v.vec_id LEFT JOIN (SELECT doc_id, split_part(text, chr(10), 1) AS text FROM documents WHERE doc_id % 8 = 0) f ON f.doc_id = v.vec_id WHERE coalesce(p.title, f.text) IS NOT NULL"))
def seed_resolution(spark, d):
    """Enriched record, else the fallback, else dropped."""
    p = papers(spark, d)
    first, rest = p.filter("doc_id % 4 <> 0").select("doc_id", "title"), p.filter("doc_id % 8 = 0").select("doc_id", F.col("title").alias("other"))
    both = vectors(spark, d).select("cluster", "doc_id").join(first, "doc_id", "left").join(rest, "doc_id", "left")
    return both.select("cluster", F.col("doc_id").alias("paper"), F.coalesce("title", "other").alias("title")).filter("title IS NOT NULL")


@query("SELECT coalesce(lang, 'ALL') AS lang, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY ROLLUP (lang)")
def focus_summary_rollup(spark, d):
    """Groups and the total."""
    return spark.read.parquet(f"{d}/documents.parquet").rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars")).withColumn("lang", F.coalesce("lang", F.lit("ALL")))


