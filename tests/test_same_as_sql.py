"""Queries against their SQL on rows that the test tables don't have."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from corpusmill.plans import record_queries, retrieval_queries, text_queries  # noqa: F401
from corpusmill.plans.queries import QUERIES, SQL


def _same(spark, folder, name: str, table: str, rows) -> None:
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    want = con.sql("SELECT {} FROM ({})".format(", ".join(columns), SQL[name])).fetchall()
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want)


def _documents(spark, texts: dict[int, str]):
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return rows.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.length("text").cast("long").alias("n_chars"))


def test_arxiv_answers_of_six_digits(spark, tmp_path):
    _same(spark, tmp_path, "arxiv_answers", "documents", _documents(spark, {7: "x", 99_999: "x", 123_456: "x"}))


def test_guarded_search_of_too_many_hits(spark, tmp_path):
    rows = spark.range(100_050).select(F.col("id").alias("doc_id"), F.lit("the and more").alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"))
    _same(spark, tmp_path, "guarded_search", "documents", rows)


_SHORT = "er st nd ou ti es ha en le ri po".split()
#: The ten commonest terms are words of two letters; only stop words; ordinary.
_POOR = {29: " ".join(_SHORT[i * k % 11] for k in range(1, 11) for i in range(11)), 57: "the and of " * 20, 85: "models of trust " * 10}


def test_keyword_cascade_of_texts_without_usable_terms(spark, tmp_path):
    _same(spark, tmp_path, "keyword_cascade", "documents", _documents(spark, _POOR))


def test_keyword_synthesis_of_short_texts(spark, tmp_path):
    texts = {20: "A " * 20 + "en works", 27: "a " * 30, 48: "De De De De De De De De De De De De De que que que", 76: "some ordinary title"}
    _same(spark, tmp_path, "keyword_synthesis", "documents", _documents(spark, texts))


def test_merge_from_registry_of_empty_keywords(spark, tmp_path):
    texts = {34: "Ani | tho | in | th | an | the | hee | won | or", 153: " | Ani | tho | in | th | an | the | hee | won", 272: "a b c d e f g h i j k l m n"}
    _same(spark, tmp_path, "merge_from_registry", "documents", _documents(spark, texts))


def test_page_text_of_quotes(spark, tmp_path):
    title = 'token = &quot;5aa2&quot; and "plain" &amp;quot; &lt;x&gt;'
    rows = spark.createDataFrame([(1, f"<html><head><title>{title}</title></head><body><p>more</p></body></html>")], "page_id long, html string")
    _same(spark, tmp_path, "page_text", "pages", rows)
