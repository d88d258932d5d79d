"""Queries over files that are written from the tables and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import session_folder
from corpusmill.plans.queries import _p, query
from corpusmill.sources import catalog as C
from corpusmill.sources import export as E
from corpusmill.sources.catalog import papers, vectors
from corpusmill.streaming.pool import pool_key, run_to_end


def _place(spark) -> str:
    return f"{session_folder(spark)}/{uuid.uuid4().hex}"


def _arrays(rows: DataFrame, by: Column, record: Column, path: str) -> str:
    """Files that are each an array of records, as many as ``by`` has values; returns a pattern for them."""
    listed = rows.groupBy(by.alias("k")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(record)), ","), F.lit("]")).alias("value"))
    listed.repartition("k").write.partitionBy("k").text(path)
    return f"{path}/k=*/*.txt"


@query(_p("SELECT 'p' || doc_id AS paper_id, title, year, doi, CAST(citations AS INTEGER) AS citations_count, 'a' || doc_id || '|b' AS keywords FROM papers WHERE doc_id % 9 <> 0"))
def json_papers(spark, d):
    """S3: papers in JSON files of arrays; those without a title are left out."""
    p = papers(spark, d)
    record = F.struct(F.concat(F.lit("p"), "doc_id").alias("paper_id"), F.when(F.col("doc_id") % 9 != 0, F.col("title")).alias("title"), "year", "doi", F.col("citations").alias("citations_count"), F.array(F.concat(F.lit("a"), "doc_id"), F.lit("b")).alias("keywords"))
    rows = C.read_papers(spark, _arrays(p, F.floor(F.col("doc_id") / 50), record, _place(spark)))
    return rows.select("paper_id", "title", "year", "doi", "citations_count", F.array_join("keywords", "|").alias("keywords"))


@query(_p("""SELECT doi, regexp_replace(title, '[\\r"]', ' ', 'g') || ', "quoted"' AS title FROM papers WHERE title <> ''"""))
def csv_catalog(spark, d):
    """A catalog in CSV, with quotes and commas; rows without a title are left out."""
    path = _place(spark)
    title = F.when(F.col("title") != "", F.concat(F.regexp_replace("title", '[\\r"]', " "), F.lit(', "quoted"')))
    papers(spark, d).select(F.col("doi").alias("DOI"), title.alias("Title"), F.col("year").alias("Year")).write.csv(path, header=True, escape='"', quoteAll=True)
    return C.read_catalog(spark, path).select("doi", "title")


_IDS = "list_sort(list('p' || vec_id))"


@query(f"SELECT label AS cluster_id, 'Topic ' || label AS label, array_to_string({_IDS}, ',') AS paper_ids FROM embeddings GROUP BY label")
def json_clusters(spark, d):
    """Clusters in JSON files, each a mapping of one."""
    clusters = vectors(spark, d).groupBy(F.col("cluster").alias("cluster_id")).agg(F.array_sort(F.collect_list(F.concat(F.lit("p"), "doc_id"))).alias("paper_ids"))
    path, record = _place(spark), F.to_json(F.struct("cluster_id", F.concat(F.lit("Topic "), "cluster_id").alias("label"), "paper_ids"))
    lines = clusters.select(F.col("cluster_id").alias("k"), F.concat(F.lit('{"it": '), record, F.lit("}")).alias("value"))
    lines.repartition("k").write.partitionBy("k").text(path)
    return C.read_clusters(spark, f"{path}/k=*/*.txt").select("cluster_id", "label", F.array_join("paper_ids", ",").alias("paper_ids"))


@query("SELECT label AS cluster, 'p' || vec_id AS paper_id FROM embeddings WHERE NOT (vec_id % 5 = 0 AND label % 2 = 0)")
def excluded_seeds(spark, d):
    """Seeds without those that the briefs of their clusters call anomalous and to be excluded."""
    v = vectors(spark, d).select("cluster", F.concat(F.lit("p"), "doc_id").alias("paper_id"), (F.col("doc_id") % 5 == 0).alias("odd"))
    odd = F.struct("paper_id", F.lit("T").alias("title"), F.lit("r").alias("reason"), F.when(F.col("cluster") % 2 == 0, "exclude_from_seeds").otherwise("keep_with_warning").alias("suggested_action"))
    briefs = v.groupBy("cluster").agg(F.collect_list(F.when(F.col("odd"), odd)).alias("anomalous_papers"))
    pattern = _arrays(briefs, F.pmod("cluster", F.lit(3)), F.struct(F.col("cluster").alias("cluster_id"), "anomalous_papers"), _place(spark))
    return C.without_excluded(v.select("cluster", "paper_id"), C.read_briefs(spark, pattern))


@query("SELECT label AS cluster_id, vec_id AS paper_id, '20240102_000000' AS run_ts FROM embeddings")
def latest_whole_run(spark, d):
    """Of three runs in Parquet the last one with all clusters."""
    rows, path = vectors(spark, d).select(F.col("cluster").alias("cluster_id"), F.col("doc_id").alias("paper_id")), _place(spark)
    for stamp, some in (("20240101_000000", rows), ("20240102_000000", rows), ("20240103_000000", rows.filter("cluster_id % 2 = 0"))):
        E.write_run(some, path, stamp)
    return E.latest_run(spark.read.parquet(path), complete=True).select(F.col("cluster_id").cast("int").alias("cluster_id"), "paper_id", F.col("run_ts").cast("string").alias("run_ts"))


@query("""WITH f AS (SELECT doc_id, lower(coalesce(CASE WHEN doc_id % 3 = 1 THEN '10.5555/D' || (doc_id // 7) END, split_part(text, chr(10), 1))) AS key, 1 + doc_id % 4 AS iteration FROM documents)
 SELECT key, arg_min(doc_id, (iteration, doc_id)) AS doc_id, min(iteration) AS first_iteration, string_agg(DISTINCT iteration::VARCHAR, ',' ORDER BY iteration::VARCHAR) AS iterations, count(*) AS seen FROM f WHERE key <> '' GROUP BY key""")
def streamed_pool(spark, d):
    """The pool of all finds, kept up by a stream of files with state for each key."""
    path = _place(spark)
    key = pool_key(F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("10.5555/D"), F.floor(F.col("doc_id") / 7))), F.col("title"))
    finds = papers(spark, d).select(key.alias("key"), "doc_id", (1 + F.col("doc_id") % 4).alias("iteration"), F.col("doc_id").alias("ord"))
    finds.repartition(6, "doc_id").write.parquet(f"{path}/finds")
    stream = spark.readStream.schema(finds.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/finds")
    rows = run_to_end(stream, f"{path}/pool", f"{path}/checkpoint")
    return rows.withColumn("iterations", F.array_join(F.transform("iterations", lambda i: i.cast("string")), ","))
