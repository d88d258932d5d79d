"""Terms, phrases and scores of texts: TF-IDF, keyphrases, shared phrases, coherence."""

from __future__ import annotations

import functools
import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut
from corpusmill.functions.joins import bounded
from corpusmill.functions.records import distinct_ignoring_case, let, stripped
from corpusmill.functions.terms import categories_only, clean_keywords, is_keyphrase, is_umbrella, safe_title, stop_words

WORD = r"[\p{L}\p{N}_]{2,}"
PLAIN_WORD = r"(?U)\b[a-z][a-z-]+\b"
NO_STRINGS = "CAST(array() AS array<string>)"


def tokens(text: Column, pattern: str = WORD, stop: list[str] = ()) -> Column:
    """Lower-case matches of ``pattern`` in order, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def _runs(words: Column, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.expr("CAST(array() AS array<int>)"))
    return words if n == 1 else F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def grams(words: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` words, apart by blanks."""
    return let(words, lambda w: F.concat(*[_runs(w, n) for n in range(low, high + 1)]))


def term_counts(docs: DataFrame, words: Column, keys: list[str]) -> DataFrame:
    return docs.select(*keys, F.explode(words).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_cosine(docs: DataFrame, queries: DataFrame, features: int = 10_000) -> DataFrame:
    """(cluster, doc_id, lexical): cosine of each text and its cluster's query as TF-IDF vectors of words and pairs of words.

    ``docs`` are (cluster, doc_id, text), ``queries`` (cluster, text), one for each cluster. A cluster's query counts
    among its texts for document frequencies; its vocabulary are the ``features`` commonest terms, ties by the alphabet.
    A text, or a query, without terms scores 0.
    """
    asked = queries.select("cluster", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(True).alias("asked"), "text")
    all_ = docs.select("cluster", "doc_id", F.lit(False).alias("asked"), "text").unionByName(asked)
    tf = term_counts(all_, grams(tokens(F.col("text")), 1, 2), ["cluster", "doc_id", "asked"])
    stats = tf.groupBy("cluster", "term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"), F.max(F.when(F.col("asked"), F.col("tf"))).alias("q_tf"))
    order = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("total").desc(), "term"))
    sizes = all_.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    kept = stats.withColumn("_r", order).filter(F.col("_r") <= features).join(bounded(cut(sizes)), "cluster")
    idf = F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    weights = cut(kept.select("cluster", "term", idf.alias("idf"), (F.coalesce("q_tf", F.lit(0)) * idf).alias("q")))
    norms = weights.groupBy("cluster").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"))
    w = tf.filter(~F.col("asked")).join(weights, ["cluster", "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    dots = w.groupBy("cluster", "doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(F.col("w") * F.col("q")).alias("dot")).join(bounded(cut(norms)), "cluster")
    scored = dots.select("cluster", "doc_id", F.coalesce(F.try_divide("dot", F.col("norm") * F.col("q_norm")), F.lit(0.0)).alias("lexical"))
    return docs.select("cluster", "doc_id").join(scored, ["cluster", "doc_id"], "left").na.fill({"lexical": 0.0})


def single_text_keyphrases(docs: DataFrame, keys: list[str], text: str = "text", most: int = 10, features: int = 50, language: str = "english") -> DataFrame:
    """(keys, keyphrases): of each text the ``most`` frequent words and pairs of words without stop words, ties by the alphabet.

    The inverse document frequency is the same for all terms of one text, so the sublinear frequency alone ranks them.
    Rows with the same keys are one text.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(text), r"\[[0-9]+\]", ""), r"\s+", " ")
    words = tokens(F.regexp_replace(clean, r"([a-z])\s([a-z](?:\s|$))", "$1$2"), stop=stop_words(language))
    kept = min(most, features)
    again = cut(docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys))
    if again.isEmpty():
        return _frequent_terms(docs.select(*keys, words.alias("words")), kept)
    same = functools.reduce(lambda p, q: p & q, [F.col(f"d.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys])
    side = lambda how: docs.alias("d").join(bounded(again).alias("a"), same, how)
    tf = term_counts(side("left_semi"), grams(words, 1, 2), keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("tf").desc(), "term"))
    top = tf.withColumn("_r", rank).filter(F.col("_r") <= kept)
    several = top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda s: s["term"]).alias("keyphrases"))
    return _frequent_terms(side("left_anti").select(*keys, words.alias("words")), kept).unionByName(several)


def _frequent_terms(rows: DataFrame, most: int) -> DataFrame:
    """Instead of ``words`` the ``keyphrases``: the frequent words and pairs of each row by itself, so that no term is sent anywhere; rows without words go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, column = [], [], batch.column("words")
            for k in range(batch.num_rows):
                if words := column[k].as_py():
                    counts = Counter(words)
                    counts.update(map(" ".join, pairwise(words)))
                    at.append(k)
                    found.append([t for _, t in heapq.nsmallest(most, ((-n, t) for t, n in counts.items()))])
            out = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns[:-1], pa.array(found, pa.list_(pa.string()))], [*batch.schema.names[:-1], "keyphrases"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, keyphrases array<string>")


def synthesised_keywords(papers: DataFrame, threshold: int = 10, most: int = 10, fill: bool = True) -> DataFrame:
    """Papers with an abstract and more than ``threshold`` keywords get ``most`` keyphrases of title, abstract and keywords instead.

    Where the text has fewer, the own keywords fill up; without ``fill`` they never do. Papers are known by paper_id.
    """
    many = (F.size("keywords") > threshold) & (F.col("abstract") != "")
    wide = papers.filter(many).select("paper_id", F.concat_ws("\n", F.col("title"), F.col("abstract"), F.array_join("keywords", " ")).alias("text"))
    found = single_text_keyphrases(wide, ["paper_id"], most=most)
    both = papers.join(found, "paper_id", "left")
    filled = F.slice(F.array_union("keyphrases", "keywords"), 1, most)
    new = F.when(F.col("keyphrases").isNotNull(), filled).otherwise(F.col("keywords")) if fill else F.when(many, F.col("keyphrases")).otherwise(F.col("keywords"))
    return both.withColumn("keywords", new).select(*papers.columns)


def substantive_keywords(papers: DataFrame, least: int = 5, most: int = 8) -> DataFrame:
    """X11: papers whose keywords are categories only get real ones before them, and where from in ``keywords_from``.

    Five clean candidates of extraction at least, else the keyphrases of title and abstract, else nothing changes.
    ``keyphrases`` has all that was found in the text, missing where none was sought or found.
    """
    bare = categories_only(F.col("keywords"))
    chosen = clean_keywords(F.col("keywords_candidate"), most)
    poor = papers.filter(bare & (F.size(chosen) < least) & (F.length("abstract") >= 100)).select("paper_id", F.concat_ws("\n", "title", "abstract").alias("text"))
    found = single_text_keyphrases(poor, ["paper_id"])
    usable = F.slice(F.filter("keyphrases", lambda k: (F.length(k) >= 3) & ~k.rlike("^[0-9]+$")), 1, most)
    both = papers.join(found, "paper_id", "left").withColumn("_new", F.when(bare & (F.size(chosen) >= least), chosen).when(bare, usable))
    source = F.when(F.coalesce(F.size("_new"), F.lit(0)) > 0, F.when(F.size(chosen) >= least, "candidates").otherwise("synthesis"))
    return both.withColumn("keywords_from", source).withColumn("keywords", F.when(F.col("keywords_from").isNotNull(), F.array_union("_new", "keywords")).otherwise(F.col("keywords"))).select(*papers.columns, "keywords_from", "keyphrases")


#: Words that break a phrase of a title, besides the stop words.
BREAKS = """abstract introduction conclusion results method methods study paper article section figure table based using use used show shown
shows found find also however thus therefore hence moreover""".split()


def break_words() -> list[str]:
    return [*stop_words(), *BREAKS]


def title_phrase(title: Column, candidate: Column | None = None) -> Column:
    """The longest run of telling words in a title, the first of the longest, up to five words; none below two, or of an umbrella term."""
    safe = safe_title(title, F.lit(None).cast("string") if candidate is None else candidate)
    segments = F.split(safe, r"[:;,.()\[\]/]")
    words = F.transform(segments, lambda s: F.regexp_extract_all(s, F.lit(r"[A-Za-z0-9][A-Za-z0-9\-]+"), F.lit(0)))
    # break words become a bar, so that runs are what lies between bars
    stop = break_words()
    barred = F.transform(words, lambda ws: F.array_join(F.transform(ws, lambda w: F.when(F.lower(w).isin(*stop), F.lit("|")).otherwise(w)), " "))
    runs = F.filter(F.transform(F.split(F.array_join(barred, " | "), r"\|"), lambda r: F.trim(r)), lambda r: r != "")
    sized = F.transform(runs, lambda r, i: F.struct((-F.size(F.split(r, " "))).alias("n"), i.alias("i"), F.split(r, " ").alias("w")))
    best = F.array_min(sized)["w"]
    phrase = F.lower(F.array_join(F.slice(best, 1, 5), " "))
    return F.when((F.size(best) >= 2) & ~is_umbrella(phrase), phrase)


def shared_phrases(seeds: DataFrame, most: int = 12) -> DataFrame:
    """(cluster, phrases) of one to three words that every seed of a cluster has; longest first, then by the alphabet.

    ``seeds`` are (cluster, doc_id, text). Only phrases of the smallest seed can be in all, and counts tell which are.
    """
    words = F.filter(tokens(F.col("text"), r"[a-z0-9][a-z0-9\-]+"), lambda t: (F.length(t) > 2) & ~t.isin(*break_words()))
    each = seeds.select("cluster", "doc_id", F.explode(F.array_distinct(grams(words, 1, 3))).alias("phrase"))
    sizes = seeds.groupBy("cluster").agg(F.countDistinct("doc_id").alias("n"))
    common = each.groupBy("cluster", "phrase").agg(F.count(F.lit(1)).alias("c")).join(bounded(cut(sizes)), "cluster").filter("c = n")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.size(F.split("phrase", " ")).desc(), "phrase"))
    return common.withColumn("_r", rank).filter(F.col("_r") <= most).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "phrase"))), lambda s: s["phrase"]).alias("phrases"))


def noun_phrases(text: Column) -> Column:
    """Runs of capitalised or hyphenated words, in lower case, of three characters or more."""
    words = F.transform(F.split(stripped(text), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_-]", ""))
    barred = F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^\p{Lu}|-"), w).otherwise(F.lit("|"))), " ")
    return F.filter(F.transform(F.split(barred, r"\|"), lambda r: F.lower(F.trim(r))), lambda r: F.length(r) > 2)


def cluster_terms(docs: DataFrame, most: int = 10) -> DataFrame:
    """(cluster, term, weight, rank) by class-based TF-IDF: frequency in the cluster by log(1 + mean words of a cluster / frequency in all)."""
    tf = term_counts(docs, tokens(F.col("text"), PLAIN_WORD, stop_words()), ["cluster"])
    totals = tf.groupBy("cluster").agg(F.sum("tf").alias("words"))
    mean = totals.agg(F.avg("words").alias("mean"))
    overall = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    w = tf.join(overall, "term").join(bounded(cut(totals)), "cluster").join(F.broadcast(mean))
    scored = w.withColumn("weight", F.col("tf") / F.col("words") * F.log(1 + F.col("mean") / F.col("f")))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.round("weight", 12).desc(), "term")).cast("long")
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most).select("cluster", "term", "weight", "rank")


def keyphrase_weights(docs: DataFrame) -> DataFrame:
    """(cluster, term, weight) of one to three words: sublinear frequency, smooth inverse frequency over clusters, unit length."""
    words = tokens(F.col("text"), PLAIN_WORD, stop_words())
    tf = term_counts(docs, grams(words, 1, 3), ["cluster"])
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.select("cluster").distinct().agg(F.count(F.lit(1)).alias("n"))
    w = tf.join(df, "term").join(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * (F.log((1.0 + F.col("n")) / (1 + F.col("df"))) + 1))
    w = cut(w.select("cluster", "term", "w"))
    norms = w.groupBy("cluster").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(bounded(cut(norms)), "cluster").select("cluster", "term", (F.col("w") / F.col("norm")).alias("weight"))


def _without_overlap(ranked: Column, most: int) -> Column:
    keep = lambda kept, p: (F.size(kept) < most) & ~F.exists(kept, lambda k: k.contains(p) | p.contains(k))
    return F.aggregate(ranked, F.expr(NO_STRINGS), lambda kept, p: F.when(keep(kept, p), F.concat(kept, F.array(p))).otherwise(kept))


def cluster_keyphrases(docs: DataFrame, most: int = 8, window: int = 500) -> DataFrame:
    """(cluster, phrases): the heaviest usable phrases of each cluster, none within another; ties by the alphabet.

    ``docs`` are (cluster, text); a phrase never crosses from one text to the next. Phrases are looked at ``window`` by
    weight, and eight times as many wherever that did not give enough.
    """
    usable = cut(keyphrase_weights(docs).filter(is_keyphrase(F.col("term"))))
    order = F.row_number().over(Window.partitionBy("cluster").orderBy(F.round("weight", 12).desc(), "term"))
    sizes = usable.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    done, todo = None, sizes
    while True:
        top = usable.join(todo.select("cluster"), "cluster", "left_semi").withColumn("_r", order).filter(F.col("_r") <= window)
        lists = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda s: s["term"]).alias("ranked"))
        found = cut(lists.select("cluster", _without_overlap(F.col("ranked"), most).alias("phrases")))
        ready = found.join(sizes, "cluster").filter((F.size("phrases") >= most) | (F.col("n") <= window)).select("cluster", "phrases")
        done = ready if done is None else done.unionByName(ready)
        todo = cut(found.join(ready, "cluster", "left_anti"))
        if todo.isEmpty():
            return done
        window *= 8


def window_counts(docs: DataFrame, topics: dict[int, list[str]], width: int) -> DataFrame:
    """(topic, a, b, n): in how many windows of ``width`` tokens a topic's terms ``a`` and ``b`` are both; topic -1 has the number of windows.

    A text shorter than the window is one window. ``topics`` are small: ten terms each.
    """
    wanted = {t for terms in topics.values() for t in terms}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, str, str], int] = {}
        for batch in batches:
            for words in batch.column(0).to_pylist():
                places: dict[str, list[int]] = {}
                for i, w in enumerate(words or ()):
                    if w in wanted:
                        places.setdefault(w, []).append(i)
                n = max(1, len(words or ()) - width + 1)
                total[-1, "", ""] = total.get((-1, "", ""), 0) + n
                inside = {}
                for w, at in places.items():  # a window that begins at s has the word if one of its places is in [s, s + width)
                    edges = np.zeros(n + 1, np.int64)
                    np.add.at(edges, np.maximum(0, np.array(at) - width + 1), 1)
                    np.add.at(edges, np.minimum(n, np.array(at) + 1), -1)
                    inside[w] = np.cumsum(edges[:-1]) > 0
                for topic, terms in topics.items():
                    here = [t for t in terms if t in inside]
                    for i, a in enumerate(here):
                        for b in here[i:]:
                            if both := int(np.count_nonzero(inside[a] & inside[b])):
                                key = (topic, *sorted((a, b)))
                                total[key] = total.get(key, 0) + both
        columns = list(zip(*((*k, n) for k, n in total.items()))) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()))], ["topic", "a", "b", "n"])

    words = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^a-z\s\-]+", " "), r"\s+"), lambda t: F.length(t) > 2)
    return docs.select(words.alias("words")).mapInArrow(run, "topic bigint, a string, b string, n bigint").groupBy("topic", "a", "b").agg(F.sum("n").alias("n"))


def coherence(docs: DataFrame, topics: dict[int, list[str]], epsilon: float = 1e-12) -> DataFrame:
    """(topic, c_v, c_npmi) of the terms of topics over the texts of ``docs``.

    c_v takes windows of 110 tokens: the mean cosine of each term's vector of normalised pointwise mutual information
    with all terms of the topic, and the sum of these vectors. c_npmi is the mean over pairs, with windows of ten.
    """
    def table(width: int) -> tuple[dict[tuple[int, str, str], int], float]:
        rows = window_counts(docs, topics, width).collect()  # a row for each pair of terms of a topic
        counts = {(r["topic"], r["a"], r["b"]): r["n"] for r in rows}
        return counts, float(counts.pop((-1, "", ""), 0)) or 1.0

    def npmi(counts: dict, n: float, topic: int, a: str, b: str) -> float:
        p = lambda x, y: counts.get((topic, *sorted((x, y))), 0) / n
        both, one, other = p(a, b), p(a, a), p(b, b)
        if not one or not other:
            return 0.0
        return math.log((both + epsilon) / (one * other)) / -math.log(both + epsilon)

    wide, n_wide = table(110)
    narrow, n_narrow = table(10)
    rows = []
    for topic, terms in topics.items():
        v = np.array([[npmi(wide, n_wide, topic, a, b) for b in terms] for a in terms])
        whole = v.sum(axis=0)
        size = np.linalg.norm(v, axis=1) * np.linalg.norm(whole)
        c_v = float(np.mean(np.divide(v @ whole, size, out=np.zeros(len(terms)), where=size > 0))) if terms else 0.0
        pairs = [npmi(narrow, n_narrow, topic, a, b) for i, a in enumerate(terms) for b in terms[:i]]
        rows.append((topic, c_v, float(np.mean(pairs)) if pairs else 0.0))
    return docs.sparkSession.createDataFrame(rows, "topic bigint, c_v double, c_npmi double")


def or_phrases(seed_titles: DataFrame, top_phrases: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """Q2: (cluster, phrases): a phrase of each seed's title, the cluster's keyphrases, then concepts; usable ones, each once.

    ``seed_titles`` are (cluster, ord, title, title_candidate), the others (cluster, phrases).
    """
    from corpusmill.functions.terms import is_or_phrase, unquoted

    first = seed_titles.select("cluster", "ord", title_phrase(F.col("title"), F.col("title_candidate")).alias("p")).filter("p IS NOT NULL")
    first = first.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "p"))), lambda s: s["p"]).alias("_0"))
    out = top_phrases.select("cluster", F.col("phrases").alias("_1")).join(first, "cluster", "full_outer")
    parts = ["_0", "_1"]
    if concepts is not None:
        out, parts = out.join(concepts.select("cluster", F.col("phrases").alias("_2")), "cluster", "full_outer"), ["_0", "_1", "_2"]
    all_ = F.transform(F.concat(*[F.coalesce(p, F.expr(NO_STRINGS)) for p in parts]), unquoted)
    return out.select("cluster", distinct_ignoring_case(F.filter(all_, lambda p: is_or_phrase(p) & ~is_umbrella(p))).alias("phrases"))
