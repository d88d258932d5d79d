"""The refine loop of a cluster (L1): build, search, pool, rank, measure, stop or narrow; then the best iteration's pool.

Only one row of figures for each iteration comes to the driver. The pool is a table that each iteration adds to.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut, drop, kept
from corpusmill.functions.joins import bounded
from corpusmill.operators import query_language as Q
from corpusmill.operators.ranking import coverage, rank_candidates
from corpusmill.operators.strategies import Strategy, execute, widening, with_subjects, work_types_of
from corpusmill.operators.textscore import or_phrases, shared_phrases
from corpusmill.plans.stop_policy import Metrics, StopPolicy


@dataclass
class RefineLoop:
    """``catalog`` is (doc_id, doi, title, abstract, year, citations, subject, venue, text, vector), ``seeds`` (doc_id, doi, title, text, vector).

    Both are read in every round, so they are written down first, unless they are tables that ``cut`` has made.

    ``phrases`` are the cluster's keyphrases, ``concepts`` what its brief adds to scores and, where a query finds
    nothing, to the query. Seeds are no candidates unless ``keep_seeds``.
    """

    catalog: DataFrame
    seeds: DataFrame
    phrases: list[str]
    reference: int
    concepts: list[str] = field(default_factory=list)
    policy: StopPolicy = StopPolicy()
    per_year: int = 75
    top: int = 20
    subjects: list[str] = field(default_factory=list)
    keep_seeds: bool = False
    recall_floor: float = 0.30

    def parts(self) -> tuple[list[str], list[str], list[str]]:
        """(OR-phrases, words for kinds of work, phrases that every seed has), from the seeds alone."""
        spark = self.catalog.sparkSession
        own = self.seeds.withColumn("cluster", F.lit(0))
        top = spark.createDataFrame([(0, self.phrases)], "cluster int, phrases array<string>")
        titles = own.select("cluster", F.col("doc_id").alias("ord"), "title", F.lit(None).cast("string").alias("title_candidate"))
        listed = lambda df, c: next((r[0] for r in df.select(c).collect()), []) or []  # noqa: E731  one row
        kinds = listed(work_types_of(own.select("cluster", "text")), "terms")
        shared = listed(shared_phrases(own.select("cluster", "doc_id", "text")), "phrases")
        return listed(or_phrases(titles, top), "phrases"), kinds, [p for p in shared if p not in {k.lower() for k in kinds}]

    def middle(self) -> DataFrame:
        """One row: the mean vector of the seeds."""
        cells = self.seeds.select(F.posexplode("vector").alias("k", "v")).groupBy("k").agg(F.avg(F.col("v").cast("double")).alias("m"))
        return cut(cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("vector")))

    def ranked(self, pool: DataFrame, query: str, middle: DataFrame) -> DataFrame:
        spark = self.catalog.sparkSession
        about = spark.createDataFrame([(0, " ".join([query, *self.concepts]), self.concepts or self.phrases, [])], "cluster int, query string, phrases array<string>, work_types array<string>")
        rows = cut(bounded(pool.select("doc_id")).join(self.catalog.select("doc_id", "text", "vector", "year", "citations"), "doc_id").withColumn("cluster", F.lit(0)))
        return rank_candidates(rows, about.crossJoin(middle), self.seeds.select(F.lit(0).alias("cluster"), "doc_id", "vector"), self.reference)  # one row each

    def run(self) -> tuple[DataFrame, DataFrame]:
        """((iteration, query, recall, precision, focus, n_results, hits, best, stop_reason), the best iteration's pool, ranked)."""
        return replace(self, catalog=kept(self.catalog), seeds=kept(self.seeds))._rounds()

    def _rounds(self) -> tuple[DataFrame, DataFrame]:
        spark = self.catalog.sparkSession
        middle, dois = self.middle(), cut(self.seeds.select("doi").filter("doi IS NOT NULL"))
        probed = cut(self.catalog.join(bounded(dois.distinct()), "doi", "left_semi"))
        any_of, kinds, shared = self.parts()
        constraints: list[str] = []
        waiting, used = list(shared), set()
        history: list[Metrics] = []
        rows: list[tuple] = []
        pool = None
        while True:
            text = with_subjects(Q.build(any_of, work_types=kinds, constraints=constraints), self.subjects)
            n = len(history) + 1
            found = execute(self.catalog, [Strategy(f"iter_{n}", "", "medium", text)], self.reference, per_year=self.per_year)
            if not self.keep_seeds:
                found = found.join(F.broadcast(self.seeds.select("doc_id")), "doc_id", "left_anti") if self.seeds.count() <= 100_000 else found.join(self.seeds.select("doc_id"), "doc_id", "left_anti")
            found = cut(found)
            fresh = found.select("doc_id", F.lit(n).alias("first_iteration"))
            new = fresh if pool is None else pool.unionByName(fresh.join(pool, "doc_id", "left_anti"))
            new = cut(new)
            drop(pool)
            pool = new
            ranked = self.ranked(pool, text, middle)
            best = ranked.filter(F.col("rank") <= self.top).agg(F.coalesce(F.avg("final"), F.lit(0.0)).alias("precision"), F.coalesce(F.avg("concept"), F.lit(0.0)).alias("focus"))
            counts = found.agg(F.coalesce(F.max("hits"), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("now"))
            seen = coverage(dois, probed, Q.compile_query(text)).select(F.col("recall_probeable").alias("recall"))
            m = seen.crossJoin(best).crossJoin(counts).crossJoin(pool.agg(F.count(F.lit(1)).alias("n_results"))).first()  # one row each
            drop(found)
            history.append(Metrics(m["recall"], m["precision"], m["n_results"]))
            why = self.policy.decide(history)
            rows.append((n, text, m["recall"], round(m["precision"], 9), round(m["focus"], 9), m["n_results"], m["hits"], why))
            if why:
                break
            widened = False
            if not m["now"] and self.concepts:
                more = spark.range(1).select(widening(F.array(*map(F.lit, self.concepts)), F.expr("CAST(array() AS array<string>)")).alias("w")).first()["w"]
                more = [p for p in more if p.lower() not in {a.lower() for a in any_of}]
                any_of, widened = any_of + more, bool(more)
            if constraints and (m["recall"] < history[0].recall - 1e-9 or m["recall"] < self.recall_floor):
                constraints.pop()
            if not widened:
                barred = {p.lower() for p in [*constraints, *any_of]} | used
                while waiting:
                    phrase = waiting.pop(0)
                    if phrase.lower() not in barred:
                        constraints.append(phrase)
                        used.add(phrase.lower())
                        break
        at = self.policy.best(history)
        final = self.ranked(pool.filter(F.col("first_iteration") <= at + 1), rows[at][1], middle)
        kind = "iteration int, query string, recall double, precision double, focus double, n_results bigint, hits bigint, stop_reason string"
        return spark.createDataFrame(rows, kind).withColumn("best", F.col("iteration") == at + 1), final
