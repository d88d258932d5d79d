"""Queries on many searches at once: predicates as data, the loop over all clusters, stop rules over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut
from corpusmill.operators import query_batch as B
from corpusmill.plans.queries import REFERENCE, _p, query
from corpusmill.plans.retrieve_all import RefineAll
from corpusmill.plans.stop_policy import StopPolicy
from corpusmill.sources.catalog import papers, vectors


def _asked(spark, d) -> DataFrame:
    """A query for each benchmark item, of the first words of five letters or more that it has."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))
    w = lambda k: F.coalesce(F.get("w", F.lit(k)), F.lit("zzzzz"))
    text = F.format_string('TITLE-ABS-KEY("%s" OR "%s" OR TITLE("%s")) AND (TITLE-ABS-KEY("%s") OR TITLE-ABS-KEY("%s")) AND NOT TITLE-ABS-KEY("%s")', *[w(k) for k in range(6)])
    more = F.when(F.col("item_id") % 3 == 1, F.concat(F.lit(" AND PUBYEAR IS "), 2015 + F.col("item_id") % 10)).when(F.col("item_id") % 3 == 2, " AND (SUBJAREA(en) OR SUBJAREA(de))").otherwise("")
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", words.alias("w")).select(F.col("item_id").alias("query"), F.concat(text, more).alias("text"))


_ASKED_SQL = """, b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{5,}') AS w FROM benchmark),
 c AS (SELECT item_id, coalesce(w[1], 'zzzzz') AS a, coalesce(w[2], 'zzzzz') AS b, coalesce(w[3], 'zzzzz') AS c, coalesce(w[4], 'zzzzz') AS e, coalesce(w[5], 'zzzzz') AS f, coalesce(w[6], 'zzzzz') AS g FROM b),
 t AS (SELECT *, lower(concat_ws(' ', title, abstract, '')) AS t FROM papers),
 m AS (SELECT item_id AS query, doc_id FROM c, t WHERE (contains(t, a) OR contains(t, b) OR contains(lower(title), c.c)) AND (contains(t, e) OR contains(t, f)) AND NOT contains(t, g)
 AND CASE item_id % 3 WHEN 1 THEN year = 2015 + item_id % 10 WHEN 2 THEN subject IN ('en', 'de') ELSE true END)"""


@query(_p("").strip() + _ASKED_SQL + " SELECT query, doc_id FROM m")
def query_batch(spark, d):
    """Q7, Q9: the hits of a query for each benchmark item, in one scan of the papers."""
    return B.matches(papers(spark, d), B.parsed(_asked(spark, d)), ["doc_id"]).select("query", "doc_id")


@query(_p("").strip() + _ASKED_SQL + " SELECT item_id AS query, count(doc_id) AS hits, count(doc_id) > 20 AS too_broad FROM benchmark LEFT JOIN m ON query = item_id GROUP BY item_id")
def query_batch_counts(spark, d):
    """Hits of each of these queries."""
    return B.hit_counts(papers(spark, d), _asked(spark, d), 20)


def loop_of_all(spark, d) -> RefineAll:
    """Every cluster of vectors, with the good documents among its members as seeds."""
    v = vectors(spark, d)
    catalog = cut(papers(spark, d).join(v.select("doc_id", "vector"), "doc_id").withColumn("text", F.col("abstract")))
    good = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1").select("doc_id")
    seeds = catalog.join(good, "doc_id", "left_semi").join(v.select("doc_id", "cluster"), "doc_id").filter("title <> ''")
    words = F.array(*[F.array(*map(F.lit, p)) for p in (["the and", "tion that"], ["des les", "und der"], ["que los", "edonre"])])
    about = v.select("cluster").distinct().select("cluster", F.get(words, F.pmod("cluster", F.lit(3))).alias("phrases"), F.array(F.lit("the"), F.lit("tion")).alias("concepts"))
    return RefineAll(catalog, seeds.select("cluster", "doc_id", "doi", "title", "text", "vector"), about, REFERENCE, per_year=20)


@query()
def retrieve_all_clusters(spark, d):
    """The rounds of every cluster; tested against a loop of each by itself."""
    return loop_of_all(spark, d).run()[0]


@query()
def retrieve_all_final(spark, d):
    """The pools of the best rounds, ranked."""
    return loop_of_all(spark, d).run()[1].select("cluster", "doc_id", F.round("final", 6).alias("final"), "rank")


_P = StopPolicy()


def _histories(spark, d) -> DataFrame:
    """The days of each user as rounds: shares of kinds of events as recall and precision."""
    days = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_id") % 7 != 3).alias("a"), F.count_if(F.col("event_id") % 5 < 3).alias("b"))
    figures = F.struct("day", F.least(F.lit(1.0), F.col("a") / F.col("n") + 0.08).alias("recall"), (F.col("b") / F.col("n")).alias("precision"), (F.col("n") % 4).alias("n_results"))
    rows = days.groupBy("user_id").agg(F.array_sort(F.collect_list(figures)).alias("_all"))
    return rows.select("user_id", F.transform(F.slice("_all", F.lit(1), (1 + F.col("user_id") % 5).cast("int")), lambda m: F.struct(m["recall"].alias("recall"), m["precision"].alias("precision"), m["n_results"].alias("n_results"))).alias("history"))


_HISTORY_SQL = """d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, least(1.0::DOUBLE, count(*) FILTER (event_id % 7 <> 3) / count(*) + 0.08::DOUBLE) AS r, count(*) FILTER (event_id % 5 < 3) / count(*) AS p FROM events GROUP BY ALL),
 i AS (SELECT user_id, n % 4 AS n, r, p, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM d QUALIFY i <= 1 + user_id % 5),
 w AS (SELECT *, lag(r) OVER u AS r0, lag(p) OVER u AS p0, lag(n) OVER u AS n0, count(*) OVER (PARTITION BY user_id) AS k, max(CASE WHEN n > 0 AND r >= 0.9 THEN r END) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS good,
  min(CASE WHEN n > 0 AND p < 0.25 THEN 1 ELSE 0 END) OVER (u ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS low FROM i WINDOW u AS (PARTITION BY user_id ORDER BY i)),
 l AS (SELECT *, n > 0 AND n0 > 0 AS c FROM w)"""


@query(f"""WITH {_HISTORY_SQL}, b AS (SELECT user_id, arg_max(i, (r >= 0.9, n > 0, r, p, -i)) AS best FROM i GROUP BY user_id)
 SELECT user_id, k AS rounds, CASE WHEN r >= 0.9 AND p >= 0.6 THEN 'success' WHEN k >= 5 THEN 'max_iterations' WHEN r <= good - 0.3::DOUBLE THEN 'recall_regression' WHEN c AND r >= r0 - 1e-9 AND p - p0 < 0.01 THEN 'plateau'
  WHEN k >= 2 AND low = 1 THEN 'low_precision' WHEN c AND r - r0 < 0.02 AND p < p0 THEN 'no_gain' END AS reason, best FROM l JOIN b USING (user_id) WHERE i = k""")
def stop_reasons(spark, d):
    """Why rounds end, and which was the best, for the histories of a whole table."""
    rows = _histories(spark, d)
    return rows.select("user_id", F.size("history").cast("long").alias("rounds"), _P.reason(F.col("history")).alias("reason"), (_P.best_place(F.col("history")) + 1).cast("long").alias("best"))
