"""Cutting lineage safely: tables in the shared folder of the cluster, written once and read again.

A table that is read again has its real size, where a checkpoint keeps the estimate of the plan it came from: products
of the estimates of all joins before it, which double in length with every round of a loop until they fill the driver.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_folders: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for tables: the session's own setting; where there is none, a temporary one if all runs on this machine."""
    shared = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not shared:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
        shared = sc._jsc.sc().getCheckpointDir().get()
    return shared


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def session_folder(spark: SparkSession) -> str:
    """This application's folder below the shared one; it goes when the driver ends in good order."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{ensure_checkpoint_dir(spark)}/corpusmill-{app}-{uuid.uuid4().hex[:8]}"

        def end(path: str = _folders[app]) -> None:
            running = SparkContext._active_spark_context
            if running is not None and running.applicationId == app:
                _delete(spark, path)

        atexit.register(end)
    return _folders[app]


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised once as a table of the shared folder; later reads survive lost executors."""
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path  # type: ignore[attr-defined]
    return out


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table of the shared folder, for what is read many times; one that ``cut`` has made stays as it is."""
    return df if getattr(df, "_cut_path", None) else cut(df)


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` made, once nothing that is still to run reads them."""
    for table in tables:
        path = getattr(table, "_cut_path", None)
        if path is not None:
            _delete(table.sparkSession, path)
