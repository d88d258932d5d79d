"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of characters. The different blocks of the corpus, sorted, get integer
names; then, level by level, adjacent names are paired and the different pairs, sorted, get names again, until one
name stands for the whole text. Two texts have the same final name at the same level if and only if they are equal:
no step compares fingerprints alone.

Whole blocks are shuffled once, after a map-side aggregation that leaves one copy of each per task. From there on a
block is referred to by a 64-bit fingerprint, and the fingerprints that stand for more than one block, if there are
any, are told apart by the blocks themselves before names are given.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut
from corpusmill.llm.text import boxed, whole_text

BLOCK = 4096
#: Names are dense within so many shares of the sorted keys: each share is sorted by itself.
SHARES = 65536


def _names(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``name``: the place of a key in the sorted order of its share, and the share. Keys must be distinct."""
    share = F.pmod(F.xxhash64(*keys), F.lit(SHARES))
    place = F.row_number().over(Window.partitionBy("_share").orderBy(*keys)).cast("long")
    return distinct.withColumn("_share", share).withColumn("name", place * SHARES + F.col("_share")).drop("_share")


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    cut_up = F.when(F.length("_text") == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{block}}}+"), F.lit(0)))
    return rows.select("doc_id", "_hash", F.greatest(F.lit(1), F.ceil(F.length("_text") / F.lit(block))).cast("long").alias("_n"), F.posexplode(cut_up).alias("_pos", "_block"))


def _block_names(blocks: DataFrame, fingerprint: Column) -> DataFrame:
    """Rows of ``blocks`` with the name of their block."""
    marked = blocks.withColumn("_print", fingerprint)
    different = marked.groupBy("_print", "_block").agg(F.lit(1).alias("_one"))
    counted = cut(different.groupBy("_print").agg(F.count(F.lit(1)).alias("_k")))
    shared = counted.filter("_k > 1").select("_print")
    if shared.isEmpty():
        names = _names(counted.select("_print").withColumn("_tie", F.lit(0)), ["_print", "_tie"])
        return marked.drop("_block").join(cut(names), "_print").drop("_print", "_tie")
    order = F.row_number().over(Window.partitionBy("_print").orderBy("_block"))
    ties = cut(marked.join(shared, "_print", "left_semi").select("_print", "_block").distinct().withColumn("_tie", order))
    pairs = counted.filter("_k = 1").select("_print", F.lit(0).alias("_tie")).unionByName(ties.select("_print", "_tie"))
    names = cut(_names(pairs, ["_print", "_tie"]))
    tied = marked.join(ties, ["_print", "_block"], "left").withColumn("_tie", F.coalesce("_tie", F.lit(0)))
    return tied.drop("_block").join(names, ["_print", "_tie"]).drop("_print", "_tie")


def identities(rows: DataFrame, block: int = BLOCK, fingerprint: Column | None = None) -> DataFrame:
    """(doc_id, _hash, level, name) for rows (doc_id, _hash, _text): equal texts, and only they, share level and name."""
    current = cut(_block_names(_blocks(rows, block), F.xxhash64("_block") if fingerprint is None else fingerprint))
    most = current.agg(F.max("_n")).first()[0] or 1
    done = [current.filter("_n = 1").select("doc_id", "_hash", F.lit(0).alias("level"), "name")]
    for level in range(1, math.ceil(math.log2(most)) + 1 if most > 1 else 1):
        even = F.pmod("_pos", F.lit(2)) == 0
        pairs = current.filter("_n > 1").groupBy("doc_id", "_hash", F.ceil(F.col("_n") / 2).alias("_n"), F.floor(F.col("_pos") / 2).alias("_pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("_left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("_right"))
        pairs = cut(pairs)
        names = cut(_names(pairs.groupBy("_left", "_right").agg(F.lit(1).alias("_one")), ["_left", "_right"]).drop("_one"))
        current = cut(pairs.join(names, ["_left", "_right"]).drop("_left", "_right"))
        done.append(current.filter("_n = 1").select("doc_id", "_hash", F.lit(level).alias("level"), "name"))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.groupBy("doc_id", "_hash").agg(F.max("level").alias("level"), F.max("name").alias("name"))


def exact_duplicates(docs: DataFrame, block: int = BLOCK, fingerprint: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A missing text is an empty one. Of equal texts the row with the largest doc_id is kept; a missing doc_id is the
    smallest. Of rows that repeat doc_id and text, all are returned and count in group_size, and one of them is
    kept. Rows with one doc_id and different texts are different rows. Only doc_id and text are read.
    """
    rows = docs.select("doc_id", whole_text().alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    names = identities(rows, block, fingerprint)
    copy = F.row_number().over(Window.partitionBy("doc_id", "_hash").orderBy("text_sha256"))
    each = rows.select("doc_id", "_hash", F.sha2("_text", 256).alias("text_sha256")).withColumn("_copy", copy)
    named = cut(each.alias("e").join(names.alias("n"), F.col("e.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("e._hash") == F.col("n._hash"))).select("e.doc_id", "e._copy", "e.text_sha256", "n.level", "n.name"))
    groups = cut(named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    return named.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, one for each different text, all columns unchanged."""
    kept = exact_duplicates(docs, block).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_kept"))
    marked = boxed(docs).withColumn("_sha", F.sha2(whole_text(), 256))
    stay = marked.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_kept")), "left_semi")
    return stay.dropDuplicates(["doc_id", "_sha"]).select("_row.*")
