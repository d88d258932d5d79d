"""The pool of all iterations, kept up as finds come in (U3, U4; an extension): the first record of each key, and who found it when."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "iteration long, ord long, doc_id long, iterations array<long>, seen long"
_OUT = "key string, doc_id long, first_iteration long, iterations array<long>, seen long"


def pool_key(doi: Column, title: Column) -> Column:
    """What makes two finds one: the DOI, else the title, in lower case; null without either."""
    return F.nullif(F.lower(F.coalesce(F.when(doi != "", doi), title)), F.lit(""))


def pooled(finds: DataFrame) -> DataFrame:
    """(key, doc_id, first_iteration, iterations, seen) of finds (key, doc_id, iteration, ord): the earliest by iteration and ord, all iterations ascending, and how many finds there were. Finds without key are left out."""
    first = F.min(F.struct("iteration", "ord", "doc_id"))
    rows = finds.filter("key IS NOT NULL").groupBy("key").agg(first.alias("f"), F.array_sort(F.collect_set("iteration")).alias("iterations"), F.count(F.lit(1)).alias("seen"))
    return rows.select("key", "f.doc_id", F.col("f.iteration").alias("first_iteration"), "iterations", "seen")


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    first, iterations, seen = None, set(), 0
    if state.exists:
        *first, known, seen = state.get
        first, iterations = tuple(first), set(known)
    for rows in batches:
        least = min(zip(rows["iteration"], rows["ord"], rows["doc_id"]))
        first = least if first is None else min(first, least)
        iterations |= set(rows["iteration"])
        seen += len(rows)
    first, listed = tuple(map(int, first)), sorted(map(int, iterations))
    state.update((*first, listed, int(seen)))
    yield pd.DataFrame({"key": [key[0]], "doc_id": [first[2]], "first_iteration": [first[0]], "iterations": [listed], "seen": [int(seen)]})


def pooled_stream(finds: DataFrame) -> DataFrame:
    """``pooled`` of a stream: each micro-batch gives the new rows of the keys that it has. A key's state is one record and its iterations."""
    rows = finds.filter("key IS NOT NULL").select("key", F.col("doc_id").cast("long"), F.col("iteration").cast("long"), F.col("ord").cast("long"))
    return rows.groupBy("key").applyInPandasWithState(_update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_end(finds: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """All that a stream has now, pooled: updates go to ``table``, and of each key the one that has seen most counts.

    A restart from ``checkpoint`` goes on where the last run ended; a batch that is written twice changes nothing.
    """
    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    query = pooled_stream(finds).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = finds.sparkSession.read.parquet(table)
    return rows.groupBy("key").agg(F.max_by(F.struct("doc_id", "first_iteration", "iterations"), "seen").alias("r"), F.max("seen").alias("seen")).select("key", "r.*", "seen")
