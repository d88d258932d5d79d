"""Search and its strategies (S8, S9, Q2 to Q9, L3, L4): what a cluster's terms and seeds say becomes queries and results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.terms import is_or_phrase, is_umbrella
from corpusmill.operators import query_language as Q
from corpusmill.operators.textscore import noun_phrases

#: Words that tell what kind of work a paper is, in this order.
WORK_TYPES = ["systematic review", "literature review", "scoping review", "meta-analysis", "review", "survey", "taxonomy", "benchmark",
              "empirical study", "case study", "comparative study", "perspective", "tutorial", "primer"]
#: Related terms of single words.
EXPANSIONS = {
    "agentic": ["autonomous", "agent-based", "agentic AI", "agent systems"],
    "agents": ["autonomous agents", "AI agents", "software agents", "intelligent agents"],
    "genai": ["generative AI", "generative models", "LLM", "large language models"],
    "generative": ["generative", "generative models", "generative AI"],
    "systems": ["systems", "agent systems", "multi-agent systems"],
    "chatgpt": ["chatgpt", "GPT", "LLM", "language models"],
    "clinical": ["clinical", "healthcare", "medical", "patient"],
}


@dataclass(frozen=True)
class Strategy:
    strategy_id: str
    name: str
    complexity: str
    query: str


def with_subjects(query: str, codes: list[str] = ()) -> str:
    """the query within subject areas; unchanged without any."""
    return f"({query}) AND ({' OR '.join(f'SUBJAREA({c})' for c in codes)})" if codes else query


def search(catalog: DataFrame, query: str, most: int, per_page: int = 25, year: int | None = None) -> DataFrame:
    """The most cited hits of a query, of one year if given: ``most`` rows, and the page each is on, from 0.

    Only the first rows of each task are gathered for the answer.
    """
    hits = catalog.filter(Q.compile_query(query))
    hits = hits if year is None else hits.filter(F.col("year") == year)
    top = hits.orderBy(F.col("citations").desc(), "doc_id").limit(most)
    at = F.row_number().over(Window.orderBy(F.col("citations").desc(), "doc_id")) - 1  # over ``most`` rows
    return top.withColumn("page", F.floor(at / per_page).cast("int"))


def guarded_search(catalog: DataFrame, query: str, most: int = 30, largest: int = 5000, none: bool = True) -> tuple[DataFrame, int, bool]:
    """The first ``most`` hits by id, the number of hits, and whether there are too many: then there are no rows, unless ``none`` is off."""
    hits = catalog.filter(Q.compile_query(query))
    total = hits.count()
    too_many = total > largest
    return hits.limit(0) if too_many and none else hits.orderBy("doc_id").limit(most), total, too_many


def work_types_of(seeds: DataFrame) -> DataFrame:
    """Q4: (cluster, terms): the words for kinds of work that every seed of a cluster (cluster, text) has."""
    low = F.lower("text")
    every = [F.every(low.contains(t)).alias(f"_{k}") for k, t in enumerate(WORK_TYPES)]
    terms = F.array_compact(F.array(*[F.when(F.col(f"_{k}"), F.lit(t)) for k, t in enumerate(WORK_TYPES)]))
    return seeds.groupBy("cluster").agg(*every).select("cluster", terms.alias("terms"))


def widening(concepts: Column, terms: Column) -> Column:
    """Q3: what a query that finds nothing is widened by: usable concepts, then terms, each once."""
    from corpusmill.functions.records import distinct_ignoring_case
    from corpusmill.functions.terms import unquoted

    all_ = F.transform(F.concat(concepts, terms), unquoted)
    return distinct_ignoring_case(F.filter(all_, lambda p: is_or_phrase(p) & ~is_umbrella(p)))


def axis_coverage(seeds: DataFrame, axes: list[list[str]]) -> DataFrame:
    """The share of a cluster's seeds (cluster, text) that have a phrase of every axis."""
    low = F.lower(F.coalesce("text", F.lit("")))
    all_ = F.lit(True)
    for axis in axes:
        any_ = F.lit(False)
        for phrase in axis:
            any_ = any_ | low.contains(phrase.lower())
        all_ = all_ & any_
    return seeds.groupBy("cluster").agg(F.avg(all_.cast("double")).alias("covered"))


def valid_axes(seeds: DataFrame, axes: list[list[str]], most: int = 2, least: float = 0.5) -> list[list[str]]:
    """Q5: the first axes if there are two at least and seeds (text) enough have a phrase of each; none otherwise."""
    axes = [g for g in ([p for p in group if p and p.strip()] for group in axes) if g]
    if len(axes) < 2:
        return []
    row = axis_coverage(seeds.withColumn("cluster", F.lit(0)), axes[:most]).first()
    return axes[:most] if row is not None and row["covered"] >= least else []


def axes_hit_enough(catalog: DataFrame, axes: list[list[str]], least: int = 2000) -> bool:
    """Q6: whether the axes alone find ``least`` papers; no more are counted."""
    return catalog.filter(Q.compile_query(Q.build(axes=axes))).limit(least).count() >= least


def _any(phrases: list[str], quoted: bool = True) -> str:
    return " OR ".join(f'"{p}"' if quoted else p for p in phrases)


@dataclass
class Context:
    """What seeds add to a strategy: phrases of two titles, and of two abstracts and their keywords, in order."""

    title_phrases: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)


def context_of(seeds: DataFrame) -> Context:
    """From the first two of (ord, title, abstract, keywords): noun phrases of titles and of 500 characters of abstracts, keywords."""
    from corpusmill.functions.terms import safe_title

    none = F.expr("CAST(array() AS array<string>)")
    rows = seeds.orderBy("ord").limit(2).select(
        F.coalesce(noun_phrases(safe_title(F.col("title"), F.lit(None).cast("string"))), none).alias("t"),
        F.concat(F.slice(F.coalesce(noun_phrases(F.substring("abstract", 1, 500)), none), 1, 3), F.slice(F.coalesce("keywords", none), 1, 3)).alias("k")).collect()  # two rows
    once = lambda name, n: list(dict.fromkeys(p for r in rows for p in r[name]))[:n]
    return Context(once("t", 3), once("k", 5))


def strategies(terms: list[str], context: Context = Context(), expand: Callable[[str], list[str]] | None = None) -> list[Strategy]:
    """Q8: four queries of a cluster's top terms, from plain to narrow.

    Any of five terms, with two more for context; title phrases of seeds with four terms; three terms with related
    ones each; three terms with words of the seeds' abstracts. ``expand`` gives the related terms of one.
    """
    expand = expand or (lambda t: EXPANSIONS.get(t.lower(), []))
    plain = f"({_any(terms[:5])}) AND ({_any(terms[5:7])})" if len(terms) > 5 else _any(terms[:5])
    by_title = f"TITLE(({_any(context.title_phrases)})) AND " if context.title_phrases else ""
    groups = " AND ".join(f"({_any([t, *expand(t)[:4]][:3])})" for t in terms[:3])
    return [
        Strategy("strategy_0", "Baseline OR", "basic", f"TITLE-ABS-KEY({plain})"),
        Strategy("strategy_1", "Title-Focused", "medium", f"{by_title}TITLE-ABS-KEY(({_any(terms[:4])}))"),
        Strategy("strategy_2", "Semantic Expansion", "high", f"TITLE-ABS-KEY({groups})"),
        Strategy("strategy_3", "Context-Aware Blending", "very_high", f"TITLE-ABS-KEY(({_any([*terms[:3], *context.keywords[:2]], quoted=False)}))"),
    ]


def strategy_queries(terms: Column, title_phrases: Column, keywords: Column) -> Column:
    """Q8: ``strategies`` of columns: an array of structs (strategy, query), for any number of clusters at once."""
    any_of = lambda c: F.array_join(F.transform(c, lambda p: F.concat(F.lit('"'), p, F.lit('"'))), " OR ")
    known = F.create_map(*[x for word, more in EXPANSIONS.items() for x in (F.lit(word), F.array(*map(F.lit, more)))])
    related = lambda t: F.concat(F.array(t), F.coalesce(F.get(F.array(known[F.lower(t)]), F.lit(0)), F.expr("CAST(array() AS array<string>)")))
    first = lambda c, n: F.slice(c, 1, n)
    within = lambda before, inner, after: F.concat(F.lit(before), inner, F.lit(after))
    plain = F.when(F.size(terms) > 5, F.concat(within("(", any_of(first(terms, 5)), ") AND "), within("(", any_of(F.slice(terms, 6, 2)), ")"))).otherwise(any_of(first(terms, 5)))
    by_title = F.when(F.size(title_phrases) > 0, within("TITLE((", any_of(title_phrases), ")) AND ")).otherwise("")
    groups = F.array_join(F.transform(first(terms, 3), lambda t: within("(", any_of(first(related(t), 3)), ")")), " AND ")
    blended = F.array_join(F.concat(first(terms, 3), first(keywords, 2)), " OR ")
    queries = [within("TITLE-ABS-KEY(", plain, ")"), F.concat(by_title, within("TITLE-ABS-KEY((", any_of(first(terms, 4)), "))")), within("TITLE-ABS-KEY(", groups, ")"), within("TITLE-ABS-KEY((", blended, "))")]
    return F.array(*[F.struct(F.lit(f"strategy_{k}").alias("strategy"), q.alias("query")) for k, q in enumerate(queries)])


def execute(catalog: DataFrame, plans: list[Strategy], reference: int, window: int = 5, per_year: int = 75, subjects: list[str] = ()) -> DataFrame:
    """(strategy, doc_id, doi, title, ord, hits, over_broad): of each strategy the most cited of each year, ranked by year.

    One scan evaluates all predicates; a row goes to each strategy whose query it meets.
    """
    met = F.array_compact(F.array(*[F.when(Q.compile_query(with_subjects(p.query, subjects)), F.lit(p.strategy_id)) for p in plans]))
    each = catalog.withColumn("strategy", F.explode(met)).withColumn("_key", F.lower(F.coalesce(F.when(F.col("doi") != "", F.col("doi")), F.col("title"))))
    return sampled(each, reference, window, per_year).select("strategy", "doc_id", "doi", "title", "ord", "hits", (F.col("hits") > 5000).alias("over_broad"))


def sampled(each: DataFrame, reference: int, window: int = 5, per_year: int = 75) -> DataFrame:
    """Of the hits (strategy, doc_id, year, citations, _key) of each strategy the most cited of each year, a key once, with ``ord`` and all ``hits``."""
    hits = each.groupBy("strategy").agg(F.count(F.lit(1)).alias("hits"))
    recent = each.filter(F.col("year").between(reference - window + 1, reference))
    best = Window.partitionBy("strategy", "year").orderBy(F.col("citations").desc(), "doc_id")
    top = recent.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= per_year).filter("_key <> ''")
    first = Window.partitionBy("strategy", "_key").orderBy("year", "_r")
    once = top.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    place = F.row_number().over(Window.partitionBy("strategy").orderBy("year", "_r")) - 1
    return once.withColumn("ord", place).join(F.broadcast(hits), "strategy")  # a row per strategy


def probe_additions(catalog: DataFrame, seeds: DataFrame, query: str, phrases: list[str], least: float = 0.5) -> DataFrame:
    """L3: (phrase, survive, accepted): the share of covered seeds (doi) that a query still finds with each phrase added, in one pass."""
    if not phrases:
        return catalog.sparkSession.createDataFrame([], "phrase string, survive double, accepted boolean")
    inside = [F.max(Q.compile_query(f'({query}) AND TITLE-ABS-KEY("{p}")').cast("int")).alias(f"_{k}") for k, p in enumerate(phrases)]
    known = catalog.filter("doi IS NOT NULL").join(seeds.select("doi").distinct(), "doi", "left_semi").groupBy("doi").agg(*inside)
    row = known.agg(*[F.coalesce(F.avg(F.col(f"_{k}").cast("double")), F.lit(0.0)).alias(f"_{k}") for k in range(len(phrases))])
    each = row.select(F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"_{k}").alias("survive")) for k, p in enumerate(phrases)])).alias("s"))
    return each.select("s.phrase", "s.survive", (F.col("s.survive") >= least).alias("accepted"))


@dataclass(frozen=True)
class Review:
    missing: list[str]
    weaknesses: list[str]
    actions: list[str]
    decision: str


def review_iteration(top_terms: list[str], ranked: DataFrame, recall: float, precision: float, least_recall: float = 0.90, least_precision: float = 0.60) -> Review:
    """L4: terms of the cluster that none of the first ten results (rank, title, abstract) shares a word with, what is weak, and whether to stop."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "abstract")), F.lit(r"[a-z0-9][a-z0-9\-]+"), F.lit(0))
    rows = ranked.orderBy("rank").limit(10).select(words.alias("w")).collect()  # ten rows
    seen = {w for r in rows for w in r["w"] or ()}
    import re

    own = lambda term: set(re.findall(r"[a-z0-9][a-z0-9\-]+", term.lower()))
    missing = [t for t in top_terms if own(t) and not own(t) & seen][:5]
    weak, actions = [], []
    if recall < least_recall:
        weak.append("recall below target")
        actions.append("widen with missing concepts via OR")
    if precision < least_precision:
        weak.append("estimated precision below target")
        actions.append("narrow with AND on the most distinctive cluster term")
    return Review(missing, weak, actions, "refine" if weak else "stop")
