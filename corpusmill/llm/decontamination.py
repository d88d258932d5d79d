"""Benchmark decontamination by a prefix-filtered join of shingles.

A window is ``window`` consecutive words of a benchmark item, or the whole of a shorter item. Windows consist of
shingles of ``shingle`` words. One pass over the documents keeps the places where a shingle of any window stands. Their
counts order the shingles by rarity over all documents. As a window must be contained whole, its rarest shingle is the
prefix that it can't do without: places of that shingle alone make candidates, those that would begin before the
document or end behind it go, and the rest are verified: each shingle of the window has to stand at its own place.

DataFrame functions only. The shingles of the items are broadcast, a bounded number at a time; a larger benchmark is
taken in blocks, each with a pass of its own over the documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut
from corpusmill.functions.joins import ROWS, bounded
from corpusmill.llm.text import identity, whole_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The entry of a document itself among those of its shingles.
_SELF = -1


@dataclass(frozen=True)
class Settings:
    """``window``: words of a window. ``shingle``: words of a shingle. ``block``: shingles that are broadcast at a time."""

    window: int = 10
    shingle: int = 3
    block: int = ROWS


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case: a generator of one row, as a plain column would be computed anew for each use."""
    return F.explode(F.array(_split(text)))


def _split(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))


def _windows(items: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Owners (window, item_id), parts (window, words, shingles, place, shingle) and shingles (shingle, k, part) of the items."""
    words = items.select(F.col("item_id").cast("string"), words_of(whole_text()).alias("_words")).filter(F.size("_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_words") - s.window + 1))
    each = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("_words", i, s.window))).alias("_window"))
    windows = cut(each.select("_window").distinct().withColumn("window", F.monotonically_increasing_id()))
    owners = cut(each.join(windows, "_window").select("window", "item_id").distinct())
    k = F.least(F.size("_window"), F.lit(s.shingle))
    pieces = windows.select("window", F.size("_window").alias("words"), k.alias("k"), (F.size("_window") - k + 1).alias("shingles"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_window") - k + 1), lambda i: F.slice("_window", i, k))).alias("place", "part"))
    shingles = cut(pieces.select("k", "part").distinct().withColumn("shingle", F.monotonically_increasing_id()))
    parts = cut(pieces.join(shingles.drop("k"), "part").select("window", "words", "shingles", "place", "shingle"))
    return owners, parts, shingles


def _hashes(k: int) -> Column:
    """For each word of ``_words`` the hash of the k words from there on."""
    return F.transform("_words", lambda w, i: F.xxhash64(w, *[F.get("_words", i + j) for j in range(1, k)]))


def _places(docs: DataFrame, shingles: DataFrame, s: Settings) -> DataFrame:
    """(_a, _b, doc_id, n_words, at, shingle): where shingles stand, and one row per document with the shingle ``_SELF``."""
    given, _ = identity(docs)
    sizes = sorted(r[0] for r in shingles.select("k").distinct().collect())
    blocks = max(1, -(-shingles.count() // s.block))
    text = docs.select(given.alias("doc_id"), whole_text().alias("_text"))
    rows = text.select("doc_id", F.xxhash64(F.lit(1), "_text", "doc_id").alias("_a"), F.xxhash64("_text", "doc_id", F.lit(2)).alias("_b"), words_of(F.col("_text")).alias("_words"))
    marked = rows.select("doc_id", "_a", "_b", "_words", F.concat(F.array(F.lit(_SELF).cast("long")), *[_hashes(k) for k in sizes]).alias("_hashes"))
    entries = marked.select("doc_id", "_a", "_b", "_words", F.posexplode("_hashes").alias("_k", "_h"))
    parts = []
    for b in range(blocks):
        block = shingles.filter(F.pmod("shingle", F.lit(blocks)) == b) if blocks > 1 else shingles
        known = block.select("shingle", "k", "part", F.xxhash64(*[F.get("part", F.lit(j)) for j in range(s.shingle)]).alias("_h"))
        if b == 0:
            known = known.unionByName(docs.sparkSession.range(1).select(F.lit(_SELF).cast("long").alias("shingle"), F.lit(0).alias("k"), F.array().cast("array<string>").alias("part"), F.lit(_SELF).cast("long").alias("_h")))
        at = F.pmod(F.col("_k") - 1, F.greatest(F.lit(1), F.size("_words")))
        itself = F.col("shingle") == _SELF
        true = F.when(itself, F.col("_k") == 0).otherwise((F.col("_k") > 0) & (F.slice("_words", at + 1, F.col("k")) == F.col("part")))
        found = entries.join(F.broadcast(known), "_h").filter(true)
        parts.append(found.select("_a", "_b", F.when(itself, F.col("doc_id")).alias("doc_id"), F.when(itself, F.size("_words")).alias("n_words"), F.when(~itself, at).alias("at"), "shingle"))
    return reduce(DataFrame.unionByName, parts)


def occurrences(places: DataFrame, parts: DataFrame) -> DataFrame:
    """(_a, _b, window, start, words): where windows stand whole."""
    doc = ["_a", "_b"]
    held = places.filter(F.col("shingle") != _SELF).select(*doc, "at", "shingle").distinct()
    rare = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("_n"))
    first = Window.partitionBy("window").orderBy("_n", "place")
    counted = cut(parts.join(bounded(cut(rare)), "shingle").withColumns({"_first": F.row_number().over(first), "_all": F.count(F.lit(1)).over(Window.partitionBy("window"))}))
    whole = counted.filter("_all = shingles")  # of the others a shingle stands nowhere
    prefix = cut(whole.filter("_first = 1").select("window", "words", "shingles", "place", "shingle"))
    sizes = places.filter(F.col("shingle") == _SELF).select(*doc, "n_words").distinct()
    begun = held.join(bounded(prefix), "shingle").select(*doc, "window", "words", "shingles", (F.col("at") - F.col("place")).alias("start")).filter("start >= 0")
    fits = begun.join(sizes, doc).filter(F.col("start") + F.col("words") <= F.col("n_words")).drop("n_words")
    asked = fits.join(bounded(cut(whole.select("window", "place", "shingle"))), "window").withColumn("at", F.col("start") + F.col("place"))
    seen = asked.join(held, [*doc, "at", "shingle"]).groupBy(*doc, "window", "start", "words", "shingles").agg(F.count(F.lit(1)).alias("_n"))
    return seen.filter("_n = shingles").select(*doc, "window", "start", "words")


def contaminated(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A missing text is an empty one and has no words. Rows that repeat a doc_id are judged one by one, and those that
    repeat the text as well alike; a missing doc_id stays missing. Texts of any length are read whole. Without items,
    or without documents, nothing is hit. Items that share an item_id count as one; an item without item_id hits words
    but is neither counted nor named, and one without words has no window. Only doc_id, item_id and text are read,
    whatever the other columns are called.
    """
    doc = ["_a", "_b"]
    owners, parts, shingles = _windows(items, settings)
    places = cut(_places(docs, shingles, settings))
    hits = cut(occurrences(places, parts))
    before = F.max(F.col("start") + F.col("words")).over(Window.partitionBy(*doc).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.groupBy(*doc, "start").agg(F.max("words").alias("words")).withColumn("_before", F.coalesce(before, F.lit(0)))
    hit = spans.groupBy(*doc).agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("words") - F.greatest("start", "_before"))).alias("n_hit"))
    names = hits.select(*doc, "window").distinct().join(bounded(owners), "window").groupBy(*doc).agg(F.array_sort(F.collect_set("item_id")).alias("_items"))
    rows = places.filter(F.col("shingle") == _SELF).select(*doc, "doc_id", F.col("n_words").cast("long").alias("n_words"))
    told = rows.join(hit.join(names, doc, "left"), doc, "left")
    listed = F.coalesce("_items", F.array().cast("array<string>"))
    hit_words = F.coalesce("n_hit", F.lit(0)).cast("long")
    return told.select("doc_id", "n_words", hit_words.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (hit_words > 0).alias("contaminated"))


#: The same in SQL: every window of the documents is joined whole.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS x FROM (SELECT item_id, unnest(list_transform(range(greatest(1, len(w) - 9)), lambda k: w[k + 1:k + 10])) AS x FROM i WHERE len(w) > 0)),
o AS (SELECT doc_id, n, k, array_to_string(w[k + 1:k + n], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, item_id, k, n FROM o JOIN v USING (n, x)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
