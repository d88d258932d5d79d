"""Queries as data against compiled ones; the loop over all clusters against a loop of each; stop rules as columns."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import query_batch as B
from corpusmill.operators import query_language as Q
from corpusmill.plans.batch_queries import loop_of_all
from corpusmill.plans.retrieve import RefineLoop
from corpusmill.plans.stop_policy import HISTORY, Metrics, StopPolicy
from corpusmill.sources.catalog import papers

DATA = "/root/testdata/sf0.001"


def generated(n, seed=5):
    rng = random.Random(seed)
    phrase = lambda: rng.choice(["the", "and", "tion", "des", "Les", "que los", "edonre", "of the", "re", "x", "agents", "e", "zzz"])

    def part(depth):
        kind = rng.randrange(8)
        if depth and kind < 4:
            return f"({part(depth - 1)} {rng.choice(['OR', 'AND', 'AND NOT', 'AND'])} {part(depth - 1)})"
        return {4: f'TITLE("{phrase()}" OR "{phrase()}")', 5: f"PUBYEAR IS {2014 + rng.randrange(12)}", 6: f"SUBJAREA({rng.choice(['en', 'de', 'fr', 'xx'])})", 7: f'DOI("https://doi.org/10.5555/D{rng.randrange(40)}")'}.get(kind, f'TITLE-ABS-KEY("{phrase()}" OR "{phrase()}")')

    return [part(3) for _ in range(n)]


@pytest.mark.parametrize("most", [B.LITERALS, 60])
def test_batch_equals_compiled(spark, most):
    extra = spark.createDataFrame([(-1, None, None, None, 1, None, None, None), (-2, "", "", 2020, 1, "10.5555/D7", None, "en")], "doc_id long, title string, abstract string, year int, citations long, doi string, venue string, subject string")
    catalog = papers(spark, DATA).unionByName(extra)
    texts = generated(150)
    queries = spark.createDataFrame(list(enumerate(texts)), "query long, text string")
    got = {}
    for r in B.matches(catalog, B.parsed(queries), ["doc_id"], most=most).collect():
        got.setdefault(r["query"], []).append(r["doc_id"])
    row = catalog.agg(*[F.sort_array(F.collect_list(F.when(Q.compile_query(t), F.col("doc_id")))).alias(f"q{k}") for k, t in enumerate(texts)]).first()
    assert {k: sorted(v) for k, v in got.items()} == {k: row[f"q{k}"] for k in range(len(texts)) if row[f"q{k}"]}


def test_clauses():
    sets = {frozenset(c) for c in B.clauses_of('TITLE-ABS-KEY((a OR B) AND c) AND NOT (TITLE(d) OR SUBJAREA(en))')}
    assert sets == {frozenset([("text", "a", False), ("text", "b", False)]), frozenset([("text", "c", False)]), frozenset([("title", "d", True)]), frozenset([("subject", "en", True)])}
    with pytest.raises(ValueError):
        B.clauses_of("TITLE(a")
    with pytest.raises(ValueError):
        B.clauses_of(" OR ".join(f"(a{k} AND b{k})" for k in range(12)))


def test_no_queries(spark):
    none = spark.createDataFrame([], "query string, text string")
    assert B.matches(papers(spark, DATA), B.parsed(none), ["doc_id"]).count() == 0 and B.hit_counts(papers(spark, DATA), none).count() == 0


def test_stop_rules_as_columns(spark):
    rng, policy = random.Random(3), StopPolicy()
    pick = lambda: (rng.choice([0.0, 0.3, 0.6, 0.61, 0.9, 0.95, 1.0]), rng.choice([0.1, 0.2, 0.205, 0.5, 0.6, 0.7]), rng.choice([0, 1, 9]))
    histories = [[pick() for _ in range(rng.randrange(6))] for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(histories)), f"k int, history {HISTORY}")
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in rows.select("k", policy.reason(F.col("history")).alias("a"), policy.best_place(F.col("history")).alias("b"), policy.reason(F.col("history"), F.lit(True)).alias("c")).collect()}
    for k, h in enumerate(histories):
        metrics = [Metrics(*m) for m in h]
        assert got[k] == (policy.decide(metrics), policy.best(metrics), policy.decide(metrics, True))


def test_all_clusters_equal_single_loops(spark):
    every = loop_of_all(spark, DATA)
    rounds, final = every.run()
    by_cluster, ranks = {}, {}
    for r in rounds.collect():
        by_cluster.setdefault(r["cluster"], []).append(tuple(r)[1:])
    for r in final.collect():
        ranks.setdefault(r["cluster"], []).append((r["rank"], r["doc_id"], round(r["final"], 9)))
    about = {r["cluster"]: r for r in every.about.collect()}
    assert len(by_cluster) >= 5
    for cluster in sorted(by_cluster)[:3]:
        one = RefineLoop(every.catalog, every.seeds.filter(F.col("cluster") == cluster).drop("cluster"), about[cluster]["phrases"], every.reference, concepts=about[cluster]["concepts"], per_year=every.per_year)
        want, ranked = one.run()
        names = ["iteration", "query", "recall", "precision", "focus", "n_results", "hits", "best", "stop_reason"]
        rows = {r["iteration"]: {c: r[c] for c in names} for r in want.collect()}
        got = {r["iteration"]: {c: r[c] for c in names} for r in rounds.filter(F.col("cluster") == cluster).collect()}
        for k in rows.keys() | got.keys():
            assert got[k].pop("precision") == pytest.approx(rows[k].pop("precision"), abs=1e-8) and got[k].pop("focus") == pytest.approx(rows[k].pop("focus"), abs=1e-8)
            assert got[k] == rows[k]
        assert sorted(ranks.get(cluster, [])) == sorted((r["rank"], r["doc_id"], round(r["final"], 9)) for r in ranked.collect())
