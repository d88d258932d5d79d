"""Queries over whole tables for operators that others only show on a few values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from corpusmill.functions import terms as T
from corpusmill.operators import review as V
from corpusmill.operators import strategies as S
from corpusmill.operators.authors import name_key
from corpusmill.plans.queries import query
from corpusmill.sources.catalog import vectors

_WORDS = "regexp_extract_all(lower(text), '[a-z]{4,}')"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), n AS (SELECT doc_id, w[1] AS a, w[2] AS b FROM w WHERE len(w) > 1)
 SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN 'van ' ELSE '' END || b AS surname, a[1] AS initial, CASE WHEN doc_id % 5 IN (0, 3, 4) THEN a ELSE '' END AS given FROM n""")
def author_names(spark, d):
    """Keys of names in several writings, made of the first words of all texts; the SQL has their parts."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)).alias("w")).filter(F.size("w") > 1)
    given, last, k = F.initcap(F.get("w", F.lit(0))), F.initcap(F.get("w", F.lit(1))), F.col("doc_id") % 5
    initial = F.concat(F.substring(given, 1, 1), F.lit("."))
    name = F.when(k == 1, F.concat_ws(" ", last, initial)).when(k == 2, F.concat_ws(" ", initial, last)).when(k == 3, F.concat_ws(" ", given, F.lit("van"), last)).when(k == 4, F.concat_ws(" ", given, last, F.lit("PhD"))).otherwise(F.concat_ws(" ", given, last))

    @F.pandas_udf("surname string, initial string, given string")
    def keys(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([name_key(n) for n in names], columns=["surname", "initial", "given"])

    return docs.select("doc_id", keys(name).alias("k")).select("doc_id", "k.*")


_UMBRELLA = ", ".join("'" + u.replace("'", "''") + "'" for u in T.UMBRELLA)


@query(f"""WITH p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'AI' WHEN 1 THEN '"Machine Learning"' WHEN 2 THEN source ELSE split_part(text, ' ', 1) END AS phrase FROM documents)
 SELECT lower(replace(phrase, '"', '')) IN ({_UMBRELLA}) AS umbrella, count(*) AS n FROM p WHERE NOT regexp_matches(phrase, '^["'']+$') GROUP BY 1""")
def umbrella_words(spark, d):
    """how many phrases of documents, quoted or not, are umbrella terms."""
    phrase = F.when(F.col("doc_id") % 6 == 0, "AI").when(F.col("doc_id") % 6 == 1, '"Machine Learning"').when(F.col("doc_id") % 6 == 2, F.col("source")).otherwise(F.split_part("text", F.lit(" "), F.lit(1)))
    rows = spark.read.parquet(f"{d}/documents.parquet").select(phrase.alias("phrase")).filter(~F.col("phrase").rlike("^[\"']+$"))
    return rows.groupBy(T.is_umbrella(F.col("phrase")).alias("umbrella")).agg(F.count(F.lit(1)).alias("n"))


def _worded(spark, d):
    """(doc_id, w): the words of four letters or more of each text that has eight."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)).alias("w")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", w).filter(F.size("w") > 7)


_WORDED = f"w AS (SELECT * FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 7)"


@query(f"""WITH {_WORDED}, p AS (SELECT doc_id, [w[1] || ' ' || w[2], upper(w[3]), CASE WHEN w[1] <> w[3] THEN w[1] END] AS p FROM w)
 SELECT doc_id, array_to_string(list_filter(p, lambda x: x IS NOT NULL AND lower(x) NOT IN ({_UMBRELLA})), '|') AS phrases FROM p""")
def widened_blocks(spark, d):
    """Q3: what queries that find nothing are widened by: no clauses, no umbrella terms, each once whatever its case."""
    w = lambda k: F.get("w", F.lit(k))
    concepts, terms = F.array(F.concat_ws(" ", w(0), w(1)), F.lit("Machine Learning"), F.concat(F.lit("x, "), w(0))), F.array(F.upper(w(2)), w(2), w(0))
    return _worded(spark, d).select("doc_id", F.array_join(S.widening(concepts, terms), "|").alias("phrases"))


_Q = "list_transform({0}, lambda x: '\"' || x || '\"')"


def _any(items: str) -> str:
    return "array_to_string(" + _Q.format(items) + ", ' OR ')"


@query(f"""WITH {_WORDED}, t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN list_prepend('Agents', w[1:6]) ELSE w[1:4] END AS t, CASE WHEN doc_id % 2 = 0 THEN w[7:8] ELSE [] END AS n, w[5:7] AS k FROM w),
 g AS (SELECT *, list_transform(t[1:3], lambda x: '(' || CASE WHEN x = 'Agents' THEN '"Agents" OR "autonomous agents" OR "AI agents"' WHEN x = 'agents' THEN '"agents" OR "autonomous agents" OR "AI agents"' WHEN x = 'systems' THEN '"systems" OR "systems" OR "agent systems"'
  WHEN x = 'clinical' THEN '"clinical" OR "clinical" OR "healthcare"' WHEN x = 'agentic' THEN '"agentic" OR "autonomous" OR "agent-based"' WHEN x = 'generative' THEN '"generative" OR "generative" OR "generative models"' WHEN x = 'genai' THEN '"genai" OR "generative AI" OR "generative models"'
  WHEN x = 'chatgpt' THEN '"chatgpt" OR "chatgpt" OR "GPT"' ELSE '"' || x || '"' END || ')') AS g FROM t)
 SELECT doc_id, unnest(['strategy_0', 'strategy_1', 'strategy_2', 'strategy_3']) AS strategy, unnest(['TITLE-ABS-KEY(' || CASE WHEN len(t) > 5 THEN '(' || {_any('t[1:5]')} || ') AND (' || {_any('t[6:7]')} || ')' ELSE {_any('t[1:5]')} END || ')',
  CASE WHEN len(n) > 0 THEN 'TITLE((' || {_any('n')} || ')) AND ' ELSE '' END || 'TITLE-ABS-KEY((' || {_any('t[1:4]')} || '))', 'TITLE-ABS-KEY(' || array_to_string(g, ' AND ') || ')', 'TITLE-ABS-KEY((' || array_to_string(list_concat(t[1:3], k[1:2]), ' OR ') || '))']) AS query FROM g""")
def strategy_texts(spark, d):
    """Q8: the four queries of the first words of every text, as columns."""
    k = F.col("doc_id")
    terms = F.when(k % 3 == 0, F.concat(F.array(F.lit("Agents")), F.slice("w", 1, 6))).otherwise(F.slice("w", 1, 4))
    titles = F.when(k % 2 == 0, F.slice("w", 7, 2)).otherwise(F.expr("CAST(array() AS array<string>)"))
    rows = _worded(spark, d).select("doc_id", terms.alias("t"), titles.alias("n"), F.slice("w", 5, 3).alias("k"))
    return rows.select("doc_id", F.explode(S.strategy_queries(F.col("t"), F.col("n"), F.col("k"))).alias("s")).select("doc_id", "s.*")


def _reviewed(spark, d):
    """Clusters of vectors, and a review that moves every seventh paper, empties cluster 3 into 4, and renames every other cluster."""
    original = vectors(spark, d).select(F.col("cluster").alias("cluster_id"), F.col("doc_id").alias("paper_id"))
    p, c = F.col("paper_id"), F.col("cluster_id")
    review = original.select(F.when(c == 3, 4).when(p % 7 == 0, 100 + p % 2).otherwise(c).alias("cluster_id"), "paper_id")
    clusters = original.select("cluster_id").distinct().select("cluster_id", F.concat(F.lit("Topic "), "cluster_id").alias("label"), F.lit("").alias("description"))
    blocks = review.select("cluster_id").distinct().select("cluster_id", F.when(c % 2 == 0, F.concat(F.lit("Renamed "), "cluster_id")).otherwise("").alias("label"), F.when(c % 3 == 0, "told").alias("description"))
    return original, clusters, review, blocks


_REVIEWED = """o AS (SELECT label AS c, vec_id AS p, CASE WHEN label = 3 THEN 4 WHEN vec_id % 7 = 0 THEN 100 + vec_id % 2 ELSE label END AS r FROM embeddings),
 a AS (SELECT DISTINCT c FROM o), b AS (SELECT DISTINCT r FROM o), k AS (SELECT c FROM a JOIN b ON c = r),
 x AS (SELECT 'moved' AS kind, r AS cluster_id, p AS paper_id, c::VARCHAR AS before, r::VARCHAR AS after FROM o WHERE c <> r
 UNION ALL SELECT 'label', c, NULL, 'Topic ' || c, 'Renamed ' || c FROM k WHERE c % 2 = 0 UNION ALL SELECT 'description', c, NULL, '', 'told' FROM k WHERE c % 3 = 0
 UNION ALL SELECT 'new', r, NULL, NULL, NULL FROM b WHERE r NOT IN (SELECT c FROM a) UNION ALL SELECT 'dropped', c, NULL, NULL, NULL FROM a WHERE c NOT IN (SELECT r FROM b)
 UNION ALL SELECT 'remap', c, NULL, c::VARCHAR, min(r)::VARCHAR FROM o WHERE c <> r GROUP BY c HAVING count(DISTINCT r) = 1)"""


@query(f"WITH {_REVIEWED} SELECT kind, cluster_id::VARCHAR AS cluster_id, paper_id::VARCHAR AS paper_id, before, after FROM x")
def review_changes(spark, d):
    """What a review of all papers changes."""
    return V.changes(*_reviewed(spark, d))


@query(f"""WITH {_REVIEWED} SELECT count(*) FILTER (kind = 'moved') AS n_moved, count(*) FILTER (kind = 'label') AS n_labels, count(*) FILTER (kind = 'description') AS n_descriptions, count(*) FILTER (kind = 'new') AS n_new,
 count(*) FILTER (kind = 'dropped') AS n_dropped, count(*) FILTER (kind IN ('moved', 'new', 'dropped')) > 0 AS recompute FROM x""")
def review_counts(spark, d):
    """How much that is."""
    return V.change_counts(V.changes(*_reviewed(spark, d)))
