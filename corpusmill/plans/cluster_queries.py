"""Queries on vectors, clusters and their reviews."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut
from corpusmill.functions.records import ascii_folded
from corpusmill.operators import clustering as C
from corpusmill.operators import ranking as K
from corpusmill.operators import review as V
from corpusmill.operators import tree
from corpusmill.operators.matching import exclude_seed_copies
from corpusmill.plans.analyse import after_review, briefs, profiles
from corpusmill.plans.queries import _CENTROIDS, _MEMBERS, REFERENCE, _p, query
from corpusmill.plans.text_queries import ASKED, _members
from corpusmill.sources import export as E
from corpusmill.sources.catalog import PAPERS_SQL, papers, vectors


def _noisy(spark, d):
    """Vectors whose every eleventh is noise."""
    return vectors(spark, d).withColumn("cluster", F.when(F.col("doc_id") % 11 == 0, -1).otherwise(F.col("cluster")))


_NOISY = "CASE WHEN vec_id % 11 = 0 THEN -1 ELSE label END"


@query(f"SELECT count(n) FILTER (c <> -1) AS n_clusters, min(n) FILTER (c <> -1) AS smallest, max(n) FILTER (c <> -1) AS largest, round(avg(n) FILTER (c <> -1), 6) AS mean, median(n) FILTER (c <> -1) AS median, sum(n) FILTER (c = -1)::BIGINT AS n_noise, round(1 - sum(n) FILTER (c = -1) / sum(n), 9) AS coverage FROM (SELECT {_NOISY} AS c, count(*) AS n FROM embeddings GROUP BY 1)")
def cluster_size_stats(spark, d):
    """A5: sizes without noise, noise and coverage."""
    out = C.size_statistics(_noisy(spark, d))
    return out.withColumns({"mean": F.round("mean", 6), "coverage": F.round("coverage", 9)})


@query(f"""WITH v AS (SELECT vec_id, {_NOISY} AS cluster, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
 x AS (SELECT a.vec_id, a.cluster, b.cluster AS other, avg(1 - list_inner_product(a.e, b.e)) AS far FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.cluster <> -1 AND b.cluster <> -1 GROUP BY ALL),
 s AS (SELECT vec_id, max(far) FILTER (cluster = other) AS a, min(far) FILTER (cluster <> other) AS b FROM x GROUP BY 1) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s""")
def silhouette_cosine(spark, d):
    """Without noise; the SQL compares all pairs."""
    return C.silhouette(_noisy(spark, d)).select(F.round("silhouette", 6).alias("silhouette"))


@query("""WITH t AS (SELECT v.label AS a, d.lang AS b FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id), c AS (SELECT a, b, count(*) AS n FROM t GROUP BY 1, 2),
 s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS i, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS x, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS y, (SELECT sum(n) FROM c) AS n),
 k AS (SELECT max(n) / sum(n) AS survival, sum(n)::BIGINT AS n_core FROM (SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 9 = 0 GROUP BY 1))
 SELECT CAST(n AS BIGINT) AS n, round(coalesce((i - x * y / (n * (n - 1) / 2)) / nullif((x + y) / 2 - x * y / (n * (n - 1) / 2), 0), 1), 9) AS ari, round(survival, 9) AS core_survival, n_core FROM s, k""")
def ari_contingency(spark, d):
    """Agreement of two labelings, and how much of a core stays together."""
    v = vectors(spark, d)
    t = v.join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").select(F.col("cluster").alias("a"), F.col("lang").alias("b"))
    core = C.core_survival(v, v.filter("doc_id % 9 = 0").select("doc_id"))
    return C.adjusted_rand(t).join(core).select("n", F.round("ari", 9).alias("ari"), F.round("core_survival", 9).alias("core_survival"), "n_core")  # one row each


@query(f"""WITH RECURSIVE {_CENTROIDS}, edges AS (SELECT a.cluster AS a, b.cluster AS b FROM centroids a JOIN centroids b ON a.cluster <> b.cluster WHERE list_cosine_similarity(a.centroid, b.centroid) >= 0.2),
 reach AS (SELECT cluster AS node, cluster AS seen FROM centroids UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen) SELECT node AS cluster, min(seen) AS merged_into FROM reach GROUP BY node""")
def semantic_merge(spark, d):
    """V6: clusters whose centroids are close become one, named by the smallest; noise is none of them."""
    return C.merged_clusters(vectors(spark, d).unionByName(vectors(spark, d).withColumn("cluster", F.lit(-1))), 0.2)[0]


@query()
def density_clusters(spark, d):
    """V3, V5: labels by density on reduced vectors; tested against all pairs compared."""
    return C.labels_within(cut(C.reduced(vectors(spark, d))), 0.1, 3, 2)


@query()
def tuner_composite(spark, d):
    """Every combination of a small grid and its score."""
    v = vectors(spark, d)
    _, results = C.tune(v, C.Grid(min_size=(2, 3), min_samples=(1, 2), radius=(0.0, 0.05), min_coverage=0.2), 0.1)
    rows = [tuple(r[k] for k in ("min_size", "min_samples", "radius", "n_clusters", "coverage", "silhouette", "tightness", "score", "reason")) for r in results]
    return spark.createDataFrame(rows, "min_size int, min_samples int, radius double, n_clusters long, coverage double, silhouette double, tightness double, score double, reason string")


@query()
def seed_ablation(spark, d):
    """How labels hold when some vectors go."""
    v = vectors(spark, d)
    rows = C.ablation(v, {"min_size": 2, "min_samples": 2, "radius": 0.0}, 0.1, v.filter("doc_id % 9 = 0").select("doc_id"), {"without 0 and 9": [0, 9]})
    return spark.createDataFrame([tuple(r.values()) for r in rows], "scenario string, n_dropped int, ari double, core_survival double, n_core long, n_clusters int")


@query("""SELECT v.label AS cluster, array_to_string(list_sort(list(d.doc_id)), ',') AS paper_ids, array_to_string(list_slice(list_sort(list(d.doc_id)), 1, 3), ',') AS representatives, false AS is_noise
 FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id GROUP BY 1""")
def described_clusters(spark, d):
    """Clusters with their papers in order; terms and phrases have queries of their own."""
    out = C.described(_members(spark, d))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("cluster", ids("paper_ids").alias("paper_ids"), ids("representative_paper_ids").alias("representatives"), "is_noise")


_SCORED = f"""WITH {_MEMBERS}, x AS (SELECT m.cluster, m.doc_id, s, cluster_match, s AS semantic, pow(0.5, greatest(0, {REFERENCE} - (2015 + m.doc_id % 10)) / 3.0) AS recency, (m.doc_id % 7) / 7.0 AS concept FROM members m),
rows AS (SELECT *, 0.25 * semantic + 0.15 * concept + 0.1 * recency AS final FROM x)"""


def _scored(spark, d):
    v = vectors(spark, d)
    rows = K.membership(v, K.centroids(v)).withColumns({"semantic": F.col("similarity"), "concept": (F.col("doc_id") % 7) / 7.0, "recency": F.pow(F.lit(0.5), F.greatest(F.lit(0), REFERENCE - (2015 + F.col("doc_id") % 10)) / 3.0)})
    return rows.withColumn("final", 0.25 * F.col("semantic") + 0.15 * F.col("concept") + 0.1 * F.col("recency"))


@query(f"""{_SCORED}, g AS (SELECT coalesce(CAST(cluster AS VARCHAR), 'ALL') AS cluster, count(*) AS n_input, count(*) FILTER (cluster_match) AS n_kept, round(100.0 * count(*) FILTER (cluster_match) / count(*), 6) AS kept_pct,
 round(coalesce(avg(s) FILTER (cluster_match), 0), 6) AS affinity_mean, round(coalesce(min(s) FILTER (cluster_match), 0), 6) AS affinity_min, round(median(round(s, 6)) FILTER (cluster_match), 6) AS affinity_median, count(*) FILTER (cluster_match AND s < 0.3) AS n_affinity_below_0_3,
 round(coalesce(avg(final) FILTER (cluster_match), 0), 6) AS final_mean, round(median(round(final, 6)) FILTER (cluster_match), 6) AS final_median,
 coalesce(avg(semantic) FILTER (cluster_match), 0) * 0.25 AS ws, coalesce(avg(concept) FILTER (cluster_match), 0) * 0.15 AS wc, coalesce(avg(recency) FILTER (cluster_match), 0) * 0.1 AS wr FROM rows GROUP BY ROLLUP (cluster))
 SELECT * EXCLUDE (ws, wc, wr), CASE WHEN ws = 0 AND wc = 0 AND wr = 0 THEN NULL WHEN ws >= wc AND ws >= wr THEN 'semantic' WHEN wc >= wr THEN 'concept' ELSE 'recency' END AS strongest FROM g""")
def quality_report(spark, d):
    """Per cluster and over all, with the strongest component by weighted contribution."""
    rows = K.quality_report(_scored(spark, d), K.WEIGHTS)
    six = ["kept_pct", "affinity_mean", "affinity_min", "affinity_median", "final_mean", "final_median"]
    return rows.select("cluster", "n_input", "n_kept", "n_affinity_below_0_3", "strongest", *[F.round(c, 6).alias(c) for c in six])


@query()
def quality_report_text(spark, d):
    """K3: the report as a table of fixed width, a line each."""
    lines = E.report_text(K.quality_report(_scored(spark, d), K.WEIGHTS), "20240101_000000").split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


@query(f"{_SCORED} SELECT cluster, doc_id, row_number() OVER (PARTITION BY cluster ORDER BY round(s, 6) DESC, round(final, 9) DESC, doc_id) AS focus_rank FROM rows WHERE cluster_match AND s >= 0.05")
def focus_filter(spark, d):
    """Matching rows by similarity, then by score."""
    return K.focused(_scored(spark, d), 0.05).select("cluster", "doc_id", "focus_rank")


@query(f"""WITH {_MEMBERS} SELECT coalesce(CAST(cluster AS VARCHAR), 'ALL') AS cluster, count(*) FILTER (cluster_match) AS n_papers, count(*) AS n_input, round(100.0 * count(*) FILTER (cluster_match) / count(*), 1) AS kept_pct, CASE WHEN cluster IS NOT NULL THEN 'Topic ' || cluster END AS label FROM members GROUP BY ROLLUP (cluster)""")
def frozen_manifest(spark, d):
    """What a frozen run holds."""
    v = vectors(spark, d)
    labels = v.select(F.col("cluster").alias("cluster_id")).distinct().withColumn("label", F.concat(F.lit("Topic "), "cluster_id"))
    return E.manifest(K.membership(v, K.centroids(v)).withColumnRenamed("cluster", "cluster_id"), labels)


@query(f"WITH {_CENTROIDS} SELECT CAST(l AS INTEGER) AS cluster_id, coalesce(size, 0) AS n_papers, coalesce(len(centroid), 0) AS dimensions FROM (SELECT unnest(range(0, 12)) AS l) LEFT JOIN centroids ON cluster = l")
def centroid_sidecar(spark, d):
    """K6: centroids of all labelled clusters, also those without members."""
    labels = spark.range(12).select(F.col("id").cast("int").alias("cluster_id"), F.concat(F.lit("Topic "), "id").alias("label"))
    return E.centroid_rows(K.centroids(vectors(spark, d)), labels).select("cluster_id", "n_papers", F.size("centroid").alias("dimensions"))


#: Rules by which a venue tells its area, the first that fits (fixed values).
AREAS = [
    ("ECON", "econometric|economics and finance|risk research|quantitative marketing|electronic commerce|finance"),
    ("DECI", "causal inference|decision|expert systems"),
    ("ENGI", "manufacturing|production research|transportation research|automation in construction|building simulation|engineering|electronics|advanced materials|royal society|applied sciences|materials"),
    ("SOCI", "technology in society|sociologic|human resource|computers in human behavior|responsible technology|human agent interaction|human factors|society"),
    ("BUSI", "strategic management|strategy science|business|management|organization|organisational|managerial|entrepreneur|innovation management|product innovation|forecasting and social change|information management|california"),
    ("COMP", "arxiv|iclr|aaai|ijcai|computational linguistics|emnlp|neurips|computer|computing|neural|intelligent systems|software engineering|knowledge and data|machine intelligence|ai open|ai review|future internet|array|information fusion|lecture notes in computer|information sciences|information systems|cognitive computing|neurocomputing|ict express|health information science|data mining|intelligence review"),
]


def area(venue: Column) -> Column:
    """A venue's area by ordered rules; none, or a preprint, is COMP."""
    v = F.lower(ascii_folded(F.coalesce(venue, F.lit(""))))
    out = F.when((v == "") | v.startswith("(arxiv") | v.contains("none"), "COMP")
    for name, words in AREAS:
        out = out.when(v.rlike(words), name)
    return out.otherwise("OTHER")


_VENUES = "CASE k WHEN 0 THEN NULL WHEN 1 THEN 'Journal of Finance' WHEN 2 THEN 'Expert Systems' WHEN 3 THEN 'Applied Sciences' WHEN 4 THEN 'Human Factors' WHEN 5 THEN 'Strategy Science' WHEN 6 THEN 'NeurIPS' WHEN 7 THEN '(arXiv)' ELSE 'Botany' END"
_AREA = "CASE k WHEN 0 THEN 'COMP' WHEN 1 THEN 'ECON' WHEN 2 THEN 'DECI' WHEN 3 THEN 'ENGI' WHEN 4 THEN 'SOCI' WHEN 5 THEN 'BUSI' WHEN 6 THEN 'COMP' WHEN 7 THEN 'COMP' ELSE 'OTHER' END"


def _mode(rows):
    """(cluster, area) with the most rows, of equals the one seen first."""
    counts = rows.groupBy("cluster", "area").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    best = Window.partitionBy("cluster").orderBy(F.col("n").desc(), "first")
    return counts.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("cluster", F.col("area").alias("mode"))


@query(f"""WITH s AS (SELECT label AS cluster, {_AREA} AS area, vec_id AS ord FROM (SELECT *, (vec_id * 5 + label) % 9 AS k FROM embeddings) WHERE vec_id % 3 = 0), c AS (SELECT label AS cluster, {_AREA} AS area, vec_id AS ord FROM (SELECT *, (vec_id * 7 + label) % 9 AS k FROM embeddings) WHERE vec_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY (vec_id * 13) % 101 DESC, vec_id) <= 5),
 m AS (SELECT cluster, area AS seed_mode FROM (SELECT cluster, area, count(*) AS n, min(ord) AS f FROM s GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f) = 1), q AS (SELECT cluster, area AS disc_mode FROM (SELECT cluster, area, count(*) AS n, min(ord) AS f FROM c GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f) = 1)
 SELECT cluster, seed_mode, coalesce(disc_mode, seed_mode) AS disc_mode, seed_mode <> coalesce(disc_mode, seed_mode) AS shifted, round(coalesce((SELECT avg(CASE WHEN c.area <> m.seed_mode THEN 1.0 ELSE 0.0 END) FROM c WHERE c.cluster = m.cluster), 0), 3) AS outside FROM m LEFT JOIN q USING (cluster)""")
def field_shift(spark, d):
    """The usual area of a cluster's seeds and of its best discoveries, and the share outside."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    rows = lambda factor, keep: e.filter(keep).withColumn("k", (F.col("vec_id") * factor + F.col("label")) % 9).select(F.col("label").alias("cluster"), F.col("vec_id").alias("ord"), area(F.expr(_VENUES)).alias("area"))
    seeds = rows(5, "vec_id % 3 = 0")
    top = Window.partitionBy("cluster").orderBy(((F.col("ord") * 13) % 101).desc(), "ord")
    found = rows(7, "vec_id % 3 <> 0").withColumn("_r", F.row_number().over(top)).filter("_r <= 5")
    own = _mode(seeds).withColumnRenamed("mode", "seed_mode")
    outside = found.join(F.broadcast(own), "cluster").groupBy("cluster").agg(F.avg((F.col("area") != F.col("seed_mode")).cast("double")).alias("o"))
    out = own.join(_mode(found).withColumnRenamed("mode", "disc_mode"), "cluster", "left").join(outside, "cluster", "left")
    mode = F.coalesce("disc_mode", "seed_mode")
    return out.select("cluster", "seed_mode", mode.alias("disc_mode"), (F.col("seed_mode") != mode).alias("shifted"), F.round(F.coalesce("o", F.lit(0.0)), 3).alias("outside"))


@query(_p("""SELECT doc_id, subject, rank FROM (SELECT doc_id, subject, row_number() OVER (PARTITION BY subject ORDER BY citations DESC, doc_id) AS rank FROM (SELECT * FROM papers WHERE doc_id % 4 <> 0 AND title <> '') p
 WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.quality = 1 AND l.doc_id % 4 = 0 AND '10.5555/D' || l.doc_id = p.doi) AND NOT EXISTS (SELECT 1 FROM labels l JOIN papers s ON s.doc_id = l.doc_id WHERE l.quality = 1 AND l.doc_id % 4 = 0 AND s.title = p.title)) WHERE rank <= 5"""))
def discovery_topn(spark, d):
    """The most cited of each subject that are no seed, by DOI or title; 1.0 alike, as SQL can tell."""
    p = papers(spark, d)
    seeds = p.join(spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1 AND doc_id % 4 = 0").select("doc_id"), "doc_id", "left_semi")
    rest = exclude_seed_copies(p.filter("doc_id % 4 <> 0 AND title <> ''"), seeds, 1.0)
    order = F.row_number().over(Window.partitionBy("subject").orderBy(F.col("citations").desc(), "doc_id")).cast("long")
    return rest.withColumn("rank", order).filter("rank <= 5").select("doc_id", "subject", "rank")


def _tree(spark, d):
    rows = K.centroids(vectors(spark, d)).orderBy("cluster").collect()  # a row per cluster
    ids = [r["cluster"] for r in rows]
    return ids, tree.agglomerate(ids, tree.cosine_distances(np.array([r["centroid"] for r in rows]))), {r["cluster"]: r["size"] for r in rows}


@query()
def topic_tree(spark, d):
    """Merges of the clusters' centroids by average cosine distance."""
    return spark.createDataFrame(_tree(spark, d)[1], "node int, left int, right int, distance double, n_leaves int")


@query()
def topic_tree_text(spark, d):
    """The tree drawn with lines."""
    ids, merges, sizes = _tree(spark, d)
    text = tree.tree_text(tree.nested(ids, merges, {i: [f"term {i}"] for i in ids}, sizes))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


@query(f"WITH {_CENTROIDS} SELECT a.cluster AS a, b.cluster AS b, round(1 - list_cosine_similarity(a.centroid, b.centroid), 6) AS distance FROM centroids a JOIN centroids b ON a.cluster < b.cluster")
def topic_distances(spark, d):
    """Cosine distances of topics."""
    return C.topic_distances(K.centroids(vectors(spark, d))).select("a", "b", F.round("distance", 6).alias("distance"))


def _reviewed(spark, d):
    rows = vectors(spark, d).groupBy("cluster").agg(F.array_sort(F.collect_list(F.concat(F.lit("p"), F.col("doc_id").cast("string")))).alias("ids")).orderBy("cluster").collect()  # clusters under review
    clusters = [{"cluster_id": r["cluster"], "label": f"Topic {r['cluster']}", "paper_ids": r["ids"]} for r in rows]
    edited = V.read_review(V.snapshot(clusters))
    by = {c.id: c for c in edited}
    by[1].papers.append(by[0].papers.pop(0))
    by[2].label = "Renamed"
    edited.append(V.ReviewedCluster(100, by.pop(9).papers))
    return V.apply_review(clusters, [c for c in edited if c.id != 9])


@query("""WITH p AS (SELECT label AS cluster, 'p' || vec_id AS paper FROM embeddings), f AS (SELECT min(paper) AS paper FROM p WHERE cluster = 0) SELECT paper AS paper_id, CAST(cluster AS INTEGER) AS from_cluster, CASE WHEN cluster = 9 THEN 100 ELSE 1 END AS to_cluster FROM p WHERE cluster = 9 OR paper = (SELECT paper FROM f)""")
def review_applied(spark, d):
    """A snapshot is written, read, edited and applied: one paper moves, one cluster gets another number."""
    rows = [(m["paper_id"], m["from_cluster"], m["to_cluster"]) for m in _reviewed(spark, d).moved]
    return spark.createDataFrame(rows, "paper_id string, from_cluster int, to_cluster int")


@query("SELECT change, cluster_id, what FROM (VALUES ('new', 100, NULL), ('dropped', 9, NULL), ('label', 2, 'Renamed'), ('remap', 0, '1'), ('remap', 9, '100')) AS v(change, cluster_id, what), (SELECT count(*) FROM region) WHERE true")
def review_summary(spark, d):
    """What else an applied review changes."""
    a = _reviewed(spark, d)
    rows = [("new", i, None) for i in a.new_ids] + [("dropped", i, None) for i in a.dropped_ids] + [("label", c["cluster_id"], c["after"]) for c in a.label_changes] + [("remap", k, str(v)) for k, v in a.remap.items()]
    return spark.createDataFrame(rows, "change string, cluster_id int, what string")


@query(f"""WITH {_CENTROIDS}, cand AS (SELECT (label + 1) % 10 AS cluster, vec_id AS doc_id, embedding::DOUBLE[] AS e, text, 2015 + vec_id % 10 AS year, (vec_id * 37) % 211 AS citations FROM embeddings JOIN documents ON doc_id = vec_id),
 seeds AS (SELECT label AS cluster, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 7 = 0), o AS (SELECT c.cluster, c.doc_id, max(list_cosine_similarity(c.e, s.e)) AS seed_overlap FROM cand c JOIN seeds s USING (cluster) GROUP BY ALL)
 SELECT c.cluster, c.doc_id, round(list_cosine_similarity(c.e, m.centroid), 6) AS semantic, round((CASE WHEN contains(lower(text), 'the thing') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'les') THEN 1 ELSE 0 END) / 2.0, 6) AS concept, round(coalesce(seed_overlap, 0), 6) AS seed_overlap,
 round(pow(0.5, greatest(0, {REFERENCE} - year) / 3.0), 6) AS recency, round(least(1.0, citations / greatest(1, {REFERENCE} - year + 1)::DOUBLE / 30.0), 6) AS velocity, round(CASE WHEN contains(lower(text), 'un') THEN 1.0 ELSE 0.0 END, 6) AS work_type
 FROM cand c JOIN centroids m USING (cluster) LEFT JOIN o USING (cluster, doc_id)""")
def hybrid_components(spark, d):
    """Six of the components; the lexical one has its own query, tfidf_lexical."""
    return _ranked(spark, d).select("cluster", "doc_id", *[F.round(c, 6).alias(c) for c in ("semantic", "concept", "seed_overlap", "recency", "velocity", "work_type")])


def _ranked(spark, d):
    v = vectors(spark, d)
    about = K.centroids(v).select("cluster", F.lit(ASKED).alias("query"), F.col("centroid").alias("vector"), F.array(F.lit("The Thing"), F.lit("les")).alias("phrases"), F.array(F.lit("un")).alias("work_types"))
    docs = papers(spark, d).select("doc_id", F.col("abstract").alias("text"), "year", "citations")
    rows = v.withColumn("cluster", (F.col("cluster") + 1) % 10).join(docs, "doc_id")
    return K.rank_candidates(rows, about, v.filter("doc_id % 7 = 0"), REFERENCE)



@query(f"""WITH {_CENTROIDS}, {PAPERS_SQL}, scored AS (SELECT c.cluster, p.doc_id, 0.25 * list_cosine_similarity(v.embedding::DOUBLE[], c.centroid) + 0.1 * pow(0.5, greatest(0, {REFERENCE} - p.year) / 3.0)
 + 0.1 * least(1.0, p.citations / greatest(1, {REFERENCE} - p.year + 1)::DOUBLE / 30.0) AS final FROM embeddings v JOIN papers p ON p.doc_id = v.vec_id, centroids c)
 SELECT cluster, doc_id, round(final, 6) AS final, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(final, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 5""")
def hybrid_rank(spark, d):
    """The flagship: for each cluster its best candidates of all papers, by likeness, age and citations."""
    v = vectors(spark, d)
    near = K.similarities(v.drop("cluster"), K.centroids(v).select("cluster", "centroid")).select("doc_id", F.explode("_all").alias("s"))
    rows = near.select("doc_id", (-F.col("s.less")).alias("cluster"), F.col("s.similarity").alias("semantic")).join(papers(spark, d).select("doc_id", "year", "citations"), "doc_id")
    scored = K.hybrid_score(rows, REFERENCE, {k: K.WEIGHTS[k] for k in ("semantic", "recency", "velocity")})
    return K.rank_within(scored, "cluster", 5).select("cluster", "doc_id", F.round("final", 6).alias("final"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_CENTROIDS}, x AS (SELECT vec_id AS doc_id, v.label AS cluster, 1 - list_cosine_similarity(embedding::DOUBLE[], centroid) AS d FROM embeddings v JOIN centroids c ON c.cluster = v.label),
 n AS (SELECT a.cluster, b.cluster AS o, row_number() OVER (PARTITION BY a.cluster ORDER BY round(1 - list_cosine_similarity(a.centroid, b.centroid), 9), b.cluster) AS r FROM centroids a JOIN centroids b ON a.cluster <> b.cluster),
 s AS (SELECT cluster, count(*) AS n_papers, avg(d) AS m, max(d) AS most, min(doc_id) FILTER (round(d, 9) = w) AS far FROM (SELECT *, max(round(d, 9)) OVER (PARTITION BY cluster) AS w FROM x) GROUP BY 1)
 SELECT s.cluster, n_papers, round(m, 6) AS mean_distance, CASE WHEN n_papers >= 3 AND most > m + 0.05 THEN far END AS outlier, (SELECT string_agg(CAST(o AS VARCHAR), ',' ORDER BY r) FROM n WHERE n.cluster = s.cluster AND r <= 3) AS neighbours FROM s""")
def cluster_profiles(spark, d):
    """V9: size, spread, outlier and nearest clusters of each cluster."""
    out = profiles(vectors(spark, d))
    return out.select("cluster", "n_papers", F.round("mean_distance", 6).alias("mean_distance"), "outlier", F.array_join(F.transform("neighbours", lambda n: n["cluster"].cast("string")), ",").alias("neighbours"))


@query()
def cluster_briefs(spark, d):
    """Briefs from statistics."""
    rows = _members(spark, d).withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))
    out = briefs(rows, vectors(spark, d))
    join = lambda c: F.array_join(c, "|")
    return out.select("cluster_id", "label", "synthesized_theme", "coherence", join("distinctive_concepts").alias("concepts"), join("characterizing_terms").alias("terms"), F.size("anomalous_papers").alias("n_anomalous"))


@query("""WITH a AS (SELECT CASE WHEN vec_id % 17 = 0 THEN (label + 1) % 10 ELSE label END AS cluster, vec_id FROM embeddings) SELECT cluster, CASE WHEN cluster = 2 THEN 'Given' END AS given, array_to_string(list_slice(list_sort(list(a.vec_id)), 1, 3), ',') AS representatives, count(*) AS n
 FROM a JOIN documents d ON d.doc_id = a.vec_id GROUP BY cluster""")
def reassigned_clusters(spark, d):
    """Clusters made anew after papers moved; a given label stays."""
    v = vectors(spark, d)
    moved = v.select(F.when(F.col("doc_id") % 17 == 0, (F.col("cluster") + 1) % 10).otherwise(F.col("cluster")).alias("cluster"), "doc_id")
    about, _ = after_review(_members(spark, d), v, moved, spark.createDataFrame([(2, "Given")], "cluster int, label string"))
    ids = F.array_join(F.transform("representative_paper_ids", lambda x: x.cast("string")), ",")
    return about.select("cluster", F.when(F.col("label") == "Given", "Given").alias("given"), ids.alias("representatives"), F.size("paper_ids").cast("long").alias("n"))
