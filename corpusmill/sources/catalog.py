"""Readers: papers, clusters and briefs in JSON, catalogs in CSV, and the fixture tables seen as a bibliographic catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.records import blank_to_null

PAPER = """paper_id string, title string, abstract string, keywords array<string>, authors array<string>, year int, doi string,
source string, venue string, url string, citations_count int, warnings array<string>, _corrupt_record string"""


def _records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of JSON files, each an array of records, a mapping to records or one record, read one by one: a bad one spoils no other."""
    files = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", "array<string>")
    mapped = F.map_values(F.from_json("value", "map<string, string>"))
    named = [part.split()[0] for part in schema.split(",")][0]
    alone = F.get_json_object("value", f"$.{named}").isNotNull()
    each = files.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).when(alone, F.array("value")).otherwise(mapped)).alias("_json"))
    return each.select(F.from_json("_json", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*").filter("_corrupt_record IS NULL").drop("_corrupt_record")


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """S3: papers; records that can't be read, or have no id or title, are left out."""
    return _records(spark, path, PAPER).filter("paper_id IS NOT NULL AND title IS NOT NULL")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, doi, title) of a CSV catalog with or without a byte order mark; rows without a title are left out."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = {c.lstrip("\ufeff").strip().strip('"').lower(): c for c in rows.columns}
    of = lambda name: F.col(f"`{names[name]}`") if name in names else F.lit(None).cast("string")
    kept = rows.select(F.monotonically_increasing_id().alias("doc_id"), blank_to_null(of("doi")).alias("doi"), blank_to_null(of("title")).alias("title"))
    return kept.filter("title IS NOT NULL")


CLUSTER = "cluster_id int, label string, top_terms array<string>, top_phrases array<string>, paper_ids array<string>, representative_paper_ids array<string>, is_noise boolean, _corrupt_record string"
BRIEF = """cluster_id int, label string, synthesized_theme string, work_type_terms array<string>, work_type_signal_terms array<string>, distinctive_concepts array<string>,
characterizing_terms array<string>, suggested_query_concepts array<string>, suggested_query_exclusions array<string>, core_query_axes array<array<string>>,
anomalous_papers array<struct<paper_id: string, title: string, reason: string, suggested_action: string>>, _corrupt_record string"""


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Clusters, one row each; those that can't be read or have no id are left out."""
    return _records(spark, path, CLUSTER).filter("cluster_id IS NOT NULL")


def read_briefs(spark: SparkSession, path: str) -> DataFrame:
    """Briefs, one of each cluster id."""
    return _records(spark, path, BRIEF).filter("cluster_id IS NOT NULL").dropDuplicates(["cluster_id"])


def without_excluded(seeds: DataFrame, briefs: DataFrame) -> DataFrame:
    """seeds (cluster, paper_id) but those that a brief calls anomalous and to be excluded."""
    odd = briefs.select(F.col("cluster_id").alias("cluster"), F.explode("anomalous_papers").alias("a")).filter("a.suggested_action = 'exclude_from_seeds'")
    return seeds.join(odd.select("cluster", F.col("a.paper_id").alias("paper_id")), ["cluster", "paper_id"], "left_anti")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers, by fixed expressions (the same in SQL as PAPERS_SQL)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        "doc_id", F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("abstract"),
        (F.lit(2015) + F.col("doc_id") % 10).cast("int").alias("year"), ((F.col("doc_id") * 37) % 211).alias("citations"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("10.5555/D"), F.col("doc_id"))).alias("doi"),
        F.col("source").alias("venue"), F.col("lang").alias("subject"))


PAPERS_SQL = """papers AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS abstract, CAST(2015 + doc_id % 10 AS INTEGER) AS year,
 (doc_id * 37) % 211 AS citations, CASE WHEN doc_id % 3 <> 0 THEN '10.5555/D' || doc_id END AS doi, source AS venue, lang AS subject FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as (doc_id, cluster, vector)."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster"), F.col("embedding").alias("vector"))


#: Documents as raw records with the flaws that validation, normalisation and merging are about: the same text in Spark and in SQL.
_T = "split_part(text, chr(10), 1)"
RECORD = {
    "paper_id": "'p' || doc_id",
    "title": f"""CASE doc_id % 29 WHEN 1 THEN '' WHEN 2 THEN substr({_T}, 1, 7) WHEN 3 THEN '12345678 ' || substr({_T}, 1, 20) WHEN 4 THEN {_T} || ' 436..461' WHEN 5 THEN 'https://x.org/' || {_T}
 WHEN 6 THEN 'International Conference ' || {_T} WHEN 7 THEN 'Preprint of ' || {_T} WHEN 8 THEN ' Chapter 12  ' || {_T} WHEN 9 THEN {_T} || '__v' WHEN 10 THEN 'Report_proof of ' || {_T} WHEN 11 THEN 'Some Title v2'
 WHEN 12 THEN 'Review Article' WHEN 13 THEN 'On Work 3, Anna Smith' WHEN 14 THEN 'study1*Anna of things' WHEN 15 THEN '12 A. B title of work' WHEN 16 THEN 'Bell et al. on work' WHEN 17 THEN 'one-word-title' WHEN 18 THEN 'doi : 10.1/x of work' ELSE {_T} END""",
    "authors": """CASE doc_id % 11 WHEN 0 THEN '' WHEN 1 THEN 'Abstract; Anna Smith' WHEN 2 THEN 'This is not any name at all; Bob Stone' WHEN 3 THEN 'Smith 2; Jones B.' WHEN 4 THEN 'Dal Mas F.; Francesca Dal Mas; J. Smith; Smith J.; John Smith PhD'
 WHEN 5 THEN 'AB; Carl Menger' WHEN 6 THEN 'ANNA SMITH; Bob Stone' ELSE 'Alberto Rossi; Maria van der Berg; Rossi A.; van der Berg M.; Antonio Rossi' END""",
    "year": "CASE doc_id % 13 WHEN 0 THEN NULL WHEN 1 THEN 1985 WHEN 2 THEN 2150 ELSE CAST(2015 + doc_id % 10 AS INTEGER) END",
    "abstract": "CASE doc_id % 17 WHEN 0 THEN '' WHEN 1 THEN substr(text, 1, 100) ELSE text END",
    "keywords": f"""CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'cs.AI|cs.CL' WHEN 2 THEN 'a1|b2|c3|d4|e5|f6|g7|h8|i9|j10|k11|l12|m13' WHEN 3 THEN 'Agents · Models · Trust 1 Introduction ' || repeat('word ', 14) || '|more of it'
 WHEN 4 THEN 'alpha; beta,beta|gamma ray' ELSE replace(substr({_T}, 1, 40), ' ', '|') END""",
    "doi": "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'https://doi.org/10.5555/D' || doc_id || '.' WHEN 2 THEN ' DOI:10.5555/D' || doc_id WHEN 3 THEN '' ELSE '10.5555/D' || doc_id || ';, ' END",
    "venue": "CASE doc_id % 5 WHEN 0 THEN NULL ELSE source END",
    "url": "CASE doc_id % 4 WHEN 0 THEN '' ELSE 'https://example.org/' || doc_id END",
    "citations": "(doc_id * 37) % 211",
    "pdf_path": f"""'/pdf/' || CASE doc_id % 5 WHEN 0 THEN '2308.' || (10000 + doc_id % 9000) || 'v2.pdf' WHEN 1 THEN 'book_978-3-16-148410-' || (doc_id % 10) || '_' || (doc_id % 20) || '.pdf' WHEN 2 THEN replace(substr({_T}, 1, 20), ' ', '_') || '-12.pdf' ELSE 'paper-no_' || doc_id || 'v3.pdf' END""",
}
RECORDS_SQL = "records AS (SELECT doc_id, text, lang, source, " + ", ".join(f"{e} AS {c}" for c, e in RECORD.items()) + " FROM documents)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw records; lists are arrays here, and joined by "; " and "|" in RECORDS_SQL."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = d.select("doc_id", "text", "lang", "source", *[F.expr(e).alias(c) for c, e in RECORD.items()])
    split = lambda c, by: F.when(F.col(c) == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.split(c, by))
    return rows.withColumns({"authors": split("authors", "; "), "keywords": split("keywords", r"\|")})
