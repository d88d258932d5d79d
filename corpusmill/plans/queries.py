"""One query per operator group, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import records as R
from corpusmill.functions.checkpointing import cut
from corpusmill.functions.joins import bounded
from corpusmill.operators import query_language as Q
from corpusmill.operators import ranking as K
from corpusmill.sources.catalog import PAPERS_SQL, papers, vectors

REFERENCE = 2024
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _p(s: str) -> str:
    return f"WITH {PAPERS_SQL} {s}"


_DOI_SQL = "nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^https?://(dx\\.)?doi\\.org/', ''), '^doi:\\s*', ''), '[/.,;: ]+$', ''), '')"
_TITLE_SQL = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')"
_VARIANT = "CASE doc_id % 4 WHEN 0 THEN 'https://doi.org/' || doi || '.' WHEN 1 THEN ' DOI: ' || doi ELSE doi END"


@query(_p(f"SELECT doc_id, {_DOI_SQL.format('(' + _VARIANT + ')')} AS doi FROM papers"))
def doi_normalize(spark, d):
    return papers(spark, d).select("doc_id", R.normalize_doi(F.expr(_VARIANT)).alias("doi"))


@query(_p(f"SELECT doc_id, {_TITLE_SQL.format('title')} AS title_key FROM papers"))
def title_normalize(spark, d):
    return papers(spark, d).select("doc_id", R.normalize_title(F.col("title")).alias("title_key"))


@query(_p(f"SELECT doc_id, year, citations, row_number() OVER (ORDER BY year, rn) - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY citations DESC, doc_id) AS rn FROM papers WHERE year BETWEEN {REFERENCE - 4} AND {REFERENCE}) WHERE rn <= 10"))
def year_topk_sample(spark, d):
    top = K.top_by_year(papers(spark, d), REFERENCE, 5, 10)  # 50 rows, so one sort gives the rank
    return top.select("doc_id", "year", "citations", (F.row_number().over(Window.orderBy("year", "rank_in_year")) - 1).cast("long").alias("rank"))


_OR = Q.build(["the and", "edonre", "des"])
_AXES = Q.build(axes=[["the", "les"], ["tion", "ent"]], work_types=["re"])
_NOT = Q.build(["the", "que"], exclusions=["scum", "idiot"])
_TEXT = "lower(concat_ws(' ', title, abstract, ''))"
_OR_SQL = f"(contains({_TEXT}, 'the and') OR contains({_TEXT}, 'edonre') OR contains({_TEXT}, 'des'))"
_AXES_SQL = f"(contains({_TEXT}, 'the') OR contains({_TEXT}, 'les')) AND (contains({_TEXT}, 'tion') OR contains({_TEXT}, 'ent')) AND contains({_TEXT}, 're')"
_NOT_SQL = f"(contains({_TEXT}, 'the') OR contains({_TEXT}, 'que')) AND NOT (contains({_TEXT}, 'scum') OR contains({_TEXT}, 'idiot'))"


def _searched(name: str, text: str, sql: str) -> None:
    def run(spark, d):
        return papers(spark, d).filter(Q.compile_query(text)).select("doc_id", "year")

    run.__name__ = name
    query(_p(f"SELECT doc_id, year FROM papers WHERE {sql}"))(run)


_searched("bool_query_or", _OR, _OR_SQL)
_searched("bool_query_axes", _AXES, _AXES_SQL)
_searched("bool_query_exclude", _NOT, _NOT_SQL)
_searched("bool_query_fields", 'TITLE("the") AND SUBJAREA(en) AND PUBYEAR IS 2020', "contains(lower(title), 'the') AND subject = 'en' AND year = 2020")


@query(_p(f"SELECT q AS query, n AS hits, n > 5000 AS too_broad FROM (SELECT 'or' AS q, count(*) FILTER ({_OR_SQL}) AS n FROM papers UNION ALL SELECT 'axes', count(*) FILTER ({_AXES_SQL}) FROM papers UNION ALL SELECT 'not', count(*) FILTER ({_NOT_SQL}) FROM papers)"))
def hit_counts(spark, d):
    return K.hit_counts(papers(spark, d), {"or": Q.compile_query(_OR), "axes": Q.compile_query(_AXES), "not": Q.compile_query(_NOT)})


@query(_p(f"""SELECT count(*) AS n_seeds, count(hit) AS n_probeable, count(*) FILTER (hit = 1) AS n_found, coalesce(count(*) FILTER (hit = 1) / nullif(count(hit), 0)::DOUBLE, 0) AS recall_probeable,
 coalesce(count(*) FILTER (hit = 1) / count(*)::DOUBLE, 0) AS recall_total FROM (SELECT DISTINCT '10.5555/D' || doc_id AS doi FROM labels WHERE quality = 1) s LEFT JOIN (SELECT doi, max(CAST({_AXES_SQL} AS INTEGER)) AS hit FROM papers WHERE doi IS NOT NULL GROUP BY doi) k USING (doi)"""))
def coverage_recall(spark, d):
    seeds = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1").select(F.concat(F.lit("10.5555/D"), "doc_id").alias("doi")).distinct()
    return K.coverage(seeds, papers(spark, d), Q.compile_query(_AXES))


@query(_p("SELECT v.label AS cluster, v.vec_id AS doc_id, p.title, p.year, p.venue, p.doi FROM embeddings v LEFT JOIN papers p ON p.doc_id = v.vec_id"))
def seed_map(spark, d):
    return vectors(spark, d).select("cluster", "doc_id").join(papers(spark, d), "doc_id", "left").select("cluster", "doc_id", "title", "year", "venue", "doi")



@query(f"SELECT doc_id, round(pow(0.5, greatest(0, {REFERENCE} - year) / 3.0), 9) AS recency, round(least(1.0, citations / greatest(1, {REFERENCE} - year + 1)::DOUBLE / 30.0), 9) AS velocity FROM ({_p('SELECT * FROM papers')})")
def recency_and_velocity(spark, d):
    p = papers(spark, d)
    return p.select("doc_id", F.round(R.recency(F.col("year"), REFERENCE), 9).alias("recency"), F.round(R.citation_velocity(F.col("citations"), F.col("year"), REFERENCE), 9).alias("velocity"))


_PHRASES = ["the and", "tion", "Les", "idiot"]


@query("SELECT doc_id, round((" + " + ".join(f"CAST(contains(lower(text), '{p.lower()}') AS DOUBLE)" for p in _PHRASES) + ") / 4, 9) AS concept FROM documents")
def concept_fraction(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.round(R.phrase_fraction(F.col("text"), _PHRASES), 9).alias("concept"))


_CENTROIDS = """cells AS (SELECT label AS cluster, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings),
means AS (SELECT cluster, k, avg(v) AS m, count(*) AS n FROM cells GROUP BY 1, 2),
centroids AS (SELECT cluster, max(n) AS size, list(m / sqrt(s) ORDER BY k) AS centroid FROM (SELECT *, sum(m * m) OVER (PARTITION BY cluster) AS s FROM means) GROUP BY cluster)"""


@query(f"WITH {_CENTROIDS} SELECT cluster, size, round(centroid[1], 6) AS first, round(list_sum(centroid), 6) AS total FROM centroids")
def cluster_centroids(spark, d):
    c = K.centroids(vectors(spark, d))
    return c.select("cluster", "size", F.round(F.col("centroid")[0], 6).alias("first"), F.round(F.aggregate("centroid", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query(f"WITH {_CENTROIDS} SELECT cluster, neighbour, round(distance, 6) AS distance, rank FROM (SELECT a.cluster, b.cluster AS neighbour, 1 - list_cosine_similarity(a.centroid, b.centroid) AS distance, row_number() OVER (PARTITION BY a.cluster ORDER BY round(1 - list_cosine_similarity(a.centroid, b.centroid), 9), b.cluster) AS rank FROM centroids a JOIN centroids b ON a.cluster <> b.cluster) WHERE rank <= 3")
def cluster_neighbours(spark, d):
    """Over a row per cluster."""
    c = K.centroids(vectors(spark, d)).select("cluster", "centroid")
    other = c.select(F.col("cluster").alias("neighbour"), F.col("centroid").alias("b"))
    pairs = c.join(bounded(cut(other)), F.col("cluster") != F.col("neighbour")).withColumn("distance", 1 - R.cosine(F.col("centroid"), F.col("b")))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.round("distance", 9), "neighbour")).cast("long")
    return pairs.withColumn("rank", rank).filter("rank <= 3").select("cluster", "neighbour", F.round("distance", 6).alias("distance"), "rank")


_MEMBERS = f"""{_CENTROIDS}, scored AS (SELECT vec_id AS doc_id, label AS cluster, c.cluster AS topic, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 9) AS s FROM embeddings, centroids c),
members AS (SELECT doc_id, cluster, topic AS nearest_topic, s, topic = cluster AS cluster_match FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, topic) = 1)"""


@query(f"WITH {_MEMBERS} SELECT doc_id, cluster, nearest_topic, round(s, 4) AS similarity, cluster_match FROM members")
def membership_verify(spark, d):
    v = vectors(spark, d)
    return K.membership(v, K.centroids(v)).withColumn("similarity", F.round("similarity", 4))


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1")
def source_mix(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


_OLD, _NEW = "label", "CASE WHEN vec_id % 17 = 0 THEN (label + 1) % 10 ELSE label END"


@query(f"SELECT CAST(o AS INTEGER) AS from_cluster, CAST(n AS INTEGER) AS to_cluster, count(*) AS moved FROM (SELECT {_OLD} AS o, {_NEW} AS n FROM embeddings) WHERE o <> n GROUP BY 1, 2")
def review_diff(spark, d):
    """Papers that a review moved, by origin and target."""
    old = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("label").alias("o"))
    new = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.expr(_NEW).cast("int").alias("n"))
    return old.join(new, "vec_id", "full_outer").filter(~F.col("o").eqNullSafe(F.col("n"))).groupBy(F.col("o").cast("int").alias("from_cluster"), F.col("n").alias("to_cluster")).agg(F.count(F.lit(1)).alias("moved"))


@query("""SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n, coalesce(n - lag(n) OVER w, 0) AS gain, coalesce(max(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best_before
 FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY day)""")
def stop_policy_trace(spark, d):
    """Gain over the last step and the best so far."""
    runs = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id").orderBy("day")
    return runs.withColumns({"gain": F.coalesce(F.col("n") - F.lag("n").over(w), F.lit(0)), "best_before": F.coalesce(F.max("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})


