"""The refine loop of all clusters at once (L1): bulk-synchronous rounds over a table with a row for each cluster.

A round builds the queries of the clusters still at work, finds the hits of all of them in one scan of the catalog,
samples, pools, ranks and measures by cluster, and decides and refines by column expressions on the table of states.
The jobs of a round don't depend on how many clusters there are, and nothing about single clusters comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut, drop, kept
from corpusmill.functions.joins import bounded
from corpusmill.operators.query_batch import matches, parsed
from corpusmill.operators.ranking import rank_candidates
from corpusmill.operators.strategies import sampled, widening, work_types_of
from corpusmill.operators.textscore import or_phrases, shared_phrases
from corpusmill.plans.stop_policy import HISTORY, StopPolicy

_NONE = "CAST(array() AS array<string>)"


def _group(phrases: Column) -> Column:
    return F.concat(F.lit("TITLE-ABS-KEY("), F.array_join(F.transform(phrases, lambda p: F.concat(F.lit('"'), p, F.lit('"'))), " OR "), F.lit(")"))


def query_text(any_of: Column, kinds: Column, constraints: Column, subjects: list[str] = ()) -> Column:
    """The query of a cluster's phrases, words for kinds of work and constraints, within subjects."""
    parts = F.concat(F.array(_group(F.when(F.size(any_of) > 0, F.slice(any_of, 1, 8)).otherwise(F.array(F.lit("agents"))))),
                     F.when(F.size(kinds) > 0, F.array(_group(F.slice(kinds, 1, 8)))).otherwise(F.expr(_NONE)), F.transform(constraints, lambda c: _group(F.array(c))))
    text = F.array_join(parts, " AND ")
    return F.concat(F.lit("("), text, F.lit(f") AND ({' OR '.join(f'SUBJAREA({c})' for c in subjects)})")) if subjects else text


@dataclass
class RefineAll:
    """``catalog`` is as in ``RefineLoop``; ``seeds`` (cluster, doc_id, doi, title, text, vector); ``about`` (cluster, phrases, concepts).

    Catalog and seeds are read in every round, so they are written down first, unless they are tables that ``cut`` has
    made. A cluster without a row of ``about`` has neither phrases nor concepts; one without seeds takes no part.
    """

    catalog: DataFrame
    seeds: DataFrame
    about: DataFrame
    reference: int
    policy: StopPolicy = StopPolicy()
    per_year: int = 75
    top: int = 20
    subjects: list[str] = field(default_factory=list)
    keep_seeds: bool = False
    recall_floor: float = 0.30

    def begun(self) -> DataFrame:
        """The state of each cluster before its first round."""
        clusters = self.seeds.select("cluster").distinct()
        about = clusters.join(self.about, "cluster", "left").select("cluster", F.coalesce("phrases", F.expr(_NONE)).alias("phrases"), F.coalesce("concepts", F.expr(_NONE)).alias("concepts"))
        titles = self.seeds.select("cluster", F.col("doc_id").alias("ord"), "title", F.lit(None).cast("string").alias("title_candidate"))
        rows = about.join(or_phrases(titles, about.select("cluster", "phrases")).withColumnRenamed("phrases", "any_of"), "cluster", "left")
        rows = rows.join(work_types_of(self.seeds.select("cluster", "text")).withColumnRenamed("terms", "kinds"), "cluster", "left")
        rows = rows.join(shared_phrases(self.seeds.select("cluster", "doc_id", "text")).withColumnRenamed("phrases", "shared"), "cluster", "left")
        rows = rows.withColumns({c: F.coalesce(c, F.expr(_NONE)) for c in ("any_of", "kinds", "shared")})
        waiting = F.filter("shared", lambda p: ~F.array_contains(F.transform("kinds", F.lower), p))
        return rows.select("cluster", "phrases", "concepts", "any_of", "kinds", F.expr(_NONE).alias("constraints"), waiting.alias("waiting"), F.expr(_NONE).alias("used"), F.expr(f"CAST(array() AS {HISTORY})").alias("history"), F.lit(None).cast("string").alias("reason"))

    def ranked(self, pool: DataFrame, asked: DataFrame, centres: DataFrame) -> DataFrame:
        """Candidates (cluster, doc_id) ranked for the queries (cluster, text, phrases, concepts) of their clusters."""
        about = asked.select("cluster", F.array_join(F.concat(F.array("text"), "concepts"), " ").alias("query"), F.when(F.size("concepts") > 0, F.col("concepts")).otherwise(F.col("phrases")).alias("phrases"), F.expr(_NONE).alias("work_types"))
        rows = cut(bounded(cut(pool.select("cluster", "doc_id"))).join(self.catalog.select("doc_id", "text", "vector", "year", "citations"), "doc_id"))
        return rank_candidates(rows, cut(about.join(centres, "cluster")), self.seeds.select("cluster", "doc_id", "vector"), self.reference)

    def _refined(self, state: DataFrame) -> DataFrame:
        """Q3: the states after a round, with its figures in ``history`` and ``now``: widened where nothing was found, else narrowed by the next shared phrase."""
        lower = lambda c: F.transform(c, F.lower)
        more = F.filter(widening(F.col("concepts"), F.expr(_NONE)), lambda p: ~F.array_contains(lower("any_of"), F.lower(p)))
        rows = state.withColumn("_more", F.when((F.col("now") == 0) & (F.size("concepts") > 0), more).otherwise(F.expr(_NONE)))
        recall = F.element_at("history", -1)["recall"]
        back = (F.size("constraints") > 0) & ((recall < F.get("history", F.lit(0))["recall"] - 1e-9) | (recall < self.recall_floor))
        rows = rows.withColumns({"any_of": F.concat("any_of", "_more"), "constraints": F.when(back, F.slice("constraints", F.lit(1), F.size("constraints") - 1)).otherwise(F.col("constraints"))})
        barred = F.concat(lower("constraints"), lower("any_of"), F.col("used"))
        rows = rows.withColumn("_barred", barred).withColumn("_next", F.get(F.filter("waiting", lambda p: ~F.array_contains("_barred", F.lower(p))), F.lit(0)))
        widened, narrowed = F.size("_more") > 0, F.col("_next").isNotNull()
        kept = F.when(narrowed, F.slice("waiting", F.array_position("waiting", F.col("_next")).cast("int") + 1, F.size("waiting"))).otherwise(F.expr(_NONE))
        return rows.withColumns({
            "waiting": F.when(widened, F.col("waiting")).otherwise(kept),
            "constraints": F.when(~widened & narrowed, F.concat("constraints", F.array("_next"))).otherwise(F.col("constraints")),
            "used": F.when(~widened & narrowed, F.concat("used", F.array(F.lower("_next")))).otherwise(F.col("used"))}).drop("_more", "_barred", "_next")

    def run(self) -> tuple[DataFrame, DataFrame]:
        """((cluster, iteration, query, recall, precision, focus, n_results, hits, best, stop_reason), the pools of the best iterations, ranked by cluster)."""
        return replace(self, catalog=kept(self.catalog), seeds=kept(self.seeds))._rounds()

    def _rounds(self) -> tuple[DataFrame, DataFrame]:
        cells = self.seeds.select("cluster", F.posexplode("vector").alias("k", "v")).groupBy("cluster", "k").agg(F.avg(F.col("v").cast("double")).alias("m"))
        centres = cut(cells.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("vector")))
        own = cut(self.seeds.select("cluster", "doc_id").distinct())
        wanted = self.seeds.filter("doi IS NOT NULL").select("cluster", "doi")
        probed = cut(wanted.join(self.catalog.select("doi").filter("doi IS NOT NULL").distinct(), "doi", "left_semi").groupBy("cluster", "doi").agg(F.count(F.lit(1)).alias("n")))
        title = F.coalesce("title", F.lit(""))
        keyed = self.catalog.withColumn("_key", F.coalesce(F.lower(F.when(F.col("doi") != "", F.col("doi"))), F.when(title != "", F.md5(F.lower(title))).otherwise("")))
        state, pool, told = cut(self.begun()), None, []
        for n in range(1, self.policy.iterations + 1):
            active = state.filter("reason IS NULL")
            if active.isEmpty():
                break
            asked = cut(active.select("cluster", query_text(F.col("any_of"), F.col("kinds"), F.col("constraints"), self.subjects).alias("text"), "phrases", "concepts"))
            hits = cut(matches(keyed, parsed(asked.select(F.col("cluster").alias("query"), "text")), ["doc_id", "year", "citations", "doi", "_key"]).withColumnRenamed("query", "strategy"))
            found = sampled(hits, self.reference, per_year=self.per_year).select(F.col("strategy").alias("cluster"), "doc_id", "hits")
            found = cut(found if self.keep_seeds else found.join(own, ["cluster", "doc_id"], "left_anti"))
            fresh = found.select("cluster", "doc_id", F.lit(n).alias("first_iteration"))
            grown = cut(fresh if pool is None else pool.unionByName(fresh.join(pool, ["cluster", "doc_id"], "left_anti")))
            drop(pool)
            pool = grown
            live = pool.join(bounded(asked.select("cluster")), "cluster")
            best = self.ranked(live, asked, centres).filter(F.col("rank") <= self.top).groupBy("cluster").agg(F.avg("final").alias("precision"), F.avg("concept").alias("focus"))
            covered = hits.filter("doi IS NOT NULL").select(F.col("strategy").alias("cluster"), "doi").distinct().withColumn("_hit", F.lit(1))
            recall = probed.join(covered, ["cluster", "doi"], "left").groupBy("cluster").agg((F.sum(F.when(F.col("_hit") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("recall"))
            counts = found.groupBy("cluster").agg(F.max("hits").alias("hits"), F.count(F.lit(1)).alias("now"))
            figures = asked.select("cluster", "text")
            for df in (best, recall, counts, live.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_results"))):
                figures = figures.join(df, "cluster", "left")
            figures = cut(figures.na.fill(0))
            history = F.concat("history", F.array(F.struct("recall", "precision", "n_results")))
            stepped = state.join(figures, "cluster", "left").withColumn("history", F.when(F.col("text").isNotNull(), history).otherwise(F.col("history")))
            stepped = cut(stepped.withColumn("reason", F.coalesce("reason", self.policy.reason(F.col("history")))))
            told.append(stepped.filter("text IS NOT NULL").select("cluster", F.lit(n).alias("iteration"), F.col("text").alias("query"), "recall", F.round("precision", 9).alias("precision"), F.round("focus", 9).alias("focus"), "n_results", "hits", F.col("reason").alias("stop_reason")))
            new = cut(self._refined(stepped).select(state.columns))
            drop(state, hits, found)
            state = new
        best_at = state.select("cluster", (self.policy.best_place(F.col("history")) + 1).alias("_best"))
        rows = told[0]
        for df in told[1:]:
            rows = rows.unionByName(df)
        rows = cut(rows.join(best_at, "cluster").withColumn("best", F.col("iteration") == F.col("_best")).drop("_best"))
        asked = cut(rows.filter("best").select("cluster", F.col("query").alias("text"), F.col("iteration").alias("_at")).join(state.select("cluster", "phrases", "concepts"), "cluster"))
        final = pool.join(bounded(asked.select("cluster", "_at")), "cluster").filter(F.col("first_iteration") <= F.col("_at"))
        return rows, self.ranked(final, asked, centres)
