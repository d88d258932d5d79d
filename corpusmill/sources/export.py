"""Sinks (K1 to K3, K6 to K9) and scans of what they wrote (S4, S5): run outputs, readable files, reports, frozen runs, references."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.records import citation_key, surname_and_given

#: Short names of the components in reports.
SHORT = {"lexical": "lex", "semantic": "sem", "concept": "con", "seed_overlap": "seed", "recency": "rec", "velocity": "cit", "work_type": "wtype"}
MOST = 10_000


def write_run(rows: DataFrame, path: str, run_ts: str) -> None:
    """K2: rows with a cluster_id as Parquet by run and cluster; other runs stay."""
    rows.withColumn("run_ts", F.lit(run_ts)).repartition("cluster_id").write.mode("append").partitionBy("run_ts", "cluster_id").parquet(path)


def read_run_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Rows of ``..._cluster{id}_focused_{date}_{time}.json`` files, with cluster_id and run_ts from their names."""
    rows = spark.read.schema(schema).json(pattern, multiLine=True).withColumn("_file", F.input_file_name())
    at = lambda k: F.regexp_extract("_file", r"cluster(-?[0-9]+)_focused_([0-9]{8}_[0-9]{6})\.json$", k)
    return rows.withColumns({"file_cluster_id": at(1).try_cast("int"), "run_ts": F.nullif(at(2), F.lit(""))}).drop("_file")


def latest_run(runs: DataFrame, complete: bool = False) -> DataFrame:
    """The rows of the last run, or of the last among those with the most clusters that have rows."""
    by_run = runs.groupBy("run_ts").agg(F.countDistinct("cluster_id").alias("n"))
    order = [F.col("n").desc(), F.col("run_ts").desc()] if complete else [F.col("run_ts").desc()]
    return runs.join(F.broadcast(by_run.orderBy(*order).limit(1).select("run_ts")), "run_ts", "left_semi")  # one row


def manifest(rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """For each cluster, and ALL: kept and all rows of ``cluster_match``, the share kept to one place, and the label."""
    kept, n = F.count_if("cluster_match"), F.count(F.lit(1))
    name = F.when(F.grouping("cluster_id") == 1, "ALL").otherwise(F.col("cluster_id").cast("string"))
    table = rows.rollup("cluster_id").agg(kept.alias("n_papers"), n.alias("n_input"), F.round(F.try_divide(100.0 * kept, n), 1).alias("kept_pct"), name.alias("cluster"))
    out = table.select("cluster", "n_papers", "n_input", "kept_pct")
    return out if labels is None else out.join(labels.select(F.col("cluster_id").cast("string").alias("cluster"), "label"), "cluster", "left")


def freeze(spark: SparkSession, runs: str, final: str, run_ts: str | None = None, labels: DataFrame | None = None) -> dict:
    """K8: the last run, or the named one, as the only content of ``final``, with its manifest; an unknown run is an error.

    What was frozen before is overwritten by the new files, so nothing stale stays.
    """
    rows = spark.read.parquet(runs)
    names = sorted(str(r[0]) for r in rows.select("run_ts").distinct().collect())  # a row per run
    if not names or run_ts is not None and run_ts not in names:
        raise ValueError(f"no run {run_ts}; there are {names[-6:]}")
    run = run_ts or names[-1]
    kept = rows.filter(F.col("run_ts").cast("string") == run)
    kept.filter("cluster_match").drop("run_ts").write.mode("overwrite").partitionBy("cluster_id").parquet(f"{final}/papers")
    table = manifest(kept, labels)
    table.write.mode("overwrite").json(f"{final}/MANIFEST")
    entries = [r.asDict() for r in table.orderBy(F.col("cluster").try_cast("int").asc_nulls_last()).collect()]  # a row per cluster
    return {"frozen_run": run, "frozen_at": datetime.now().isoformat(timespec="seconds"), "n_clusters": len(entries) - 1, "total_papers": entries[-1]["n_papers"] if entries else 0, "clusters": entries[:-1]}


def to_json_text(rows: DataFrame, most: int = MOST) -> str:
    """K1: a small table as readable JSON; a larger one is an error, as it must come through the driver."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows; write them with Spark")
    return json.dumps([r.asDict(recursive=True) for r in found], ensure_ascii=False, indent=2, default=str)


def write_json(rows: DataFrame, path: str) -> None:
    """K1: a table of any size as lines of JSON; characters beyond ASCII stay as they are, missing values are written."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def flat_papers(papers: DataFrame) -> DataFrame:
    """The twelve columns of the flat form: authors joined by semicolons, sources by bars."""
    return papers.select("paper_id", "title", "abstract", F.array_join("keywords", "; ").alias("keywords"), F.array_join("authors", "; ").alias("authors"), "year", "doi", "source", "venue", "url", "citations_count", F.array_join("retrieved_from", "|").alias("retrieved_from"))


def centroid_rows(centres: DataFrame, labels: DataFrame) -> DataFrame:
    """K6: (cluster_id, label, n_papers, centroid) of all labelled clusters; one without members has an empty centroid."""
    none = F.expr("CAST(array() AS array<double>)")
    return labels.join(centres.withColumnRenamed("cluster", "cluster_id"), "cluster_id", "left").select("cluster_id", "label", F.coalesce("size", F.lit(0)).alias("n_papers"), F.coalesce("centroid", none).alias("centroid"))


def save_model(model, folder: str, name: str, stamp: str) -> str:
    """K7: a fitted Spark model below ``folder``, by name and time."""
    path = f"{folder}/{name}_{stamp}"
    model.write().overwrite().save(path)
    return path


def load_latest(spark: SparkSession, folder: str, name: str, load: Callable[[str], object]):
    """K7: the model of the last time in its name; none there is an error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}_*")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    if not len(found):
        raise FileNotFoundError(f"no model {name} in {folder}")
    return load(max(f.getPath().toString() for f in found))


def report_text(report: DataFrame, run: str, labels: dict[str, str] | None = None) -> str:
    """K3: a quality report as two tables of fixed width: what was kept, and the components with the strongest marked."""
    labels = labels or {}
    rows = [r.asDict() for r in report.collect()]  # a row per cluster
    clusters = sorted((r for r in rows if r["cluster"] != "ALL"), key=lambda r: int(r["cluster"]))
    total = next((r for r in rows if r["cluster"] == "ALL"), None)
    parts = [c for c in SHORT if rows and f"mean_{c}" in rows[0]]
    weighted = bool(rows) and any(k.startswith("contribution_") for k in rows[0])
    num = lambda v, f: format(v, f) if v is not None else "-".rjust(int(f.split(".")[0].lstrip(">")))
    head = f"{'cid':>3} {'kept':>6} {'kept%':>5} {'rel.mu':>6} {'rel.med':>7} {'aff.mu':>6} {'aff.med':>7} {'aff.min':>7} {'aff<.3':>6} {'strongest':>12}  label"
    out = [f"QUALITY REPORT (run {run}; strongest by {'weighted_contribution' if weighted else 'raw_mean'})", "", "[1] Kept | relevance | cluster affinity", head, "-" * len(head)]
    for r in clusters:
        share = f"{r['kept_pct']:.0f}%" if r["kept_pct"] is not None else "-"
        out.append(f"{r['cluster']:>3} {r['n_kept']:>6} {share:>5} {num(r['final_mean'], '>6.3f')} {num(r['final_median'], '>7.3f')} {num(r['affinity_mean'], '>6.3f')} {num(r['affinity_median'], '>7.3f')} "
                   f"{num(r['affinity_min'], '>7.3f')} {r['n_affinity_below_0_3']:>6} {r['strongest'] or '-':>12}  {labels.get(r['cluster'], '')}")
    if total:
        out += ["-" * len(head), f"ALL {total['n_kept']:>6} {'':>5} {num(total['final_mean'], '>6.3f')} {'':>7} {num(total['affinity_mean'], '>6.3f')}"]
    head = f"{'cid':>3} | " + " ".join(f"{SHORT[c]:>6}" for c in parts) + f" | {'final':>6}"
    out += ["", "[2] Relevance components (mean; * = strongest)", head, "-" * len(head)]
    for r in [*clusters, *([total] if total else [])]:
        cells = " ".join(f"{r[f'mean_{c}']:>5.2f}{'*' if c == r['strongest'] and r is not total else ' '}" for c in parts)
        out.append(f"{r['cluster']:>3} | {cells} | {num(r['final_mean'], '>6.3f')}")
    return "\n".join(out)


def with_citation_keys(papers: DataFrame, taken: list[str] = (), order: str = "doc_id") -> DataFrame:
    """K9: adds ``cite_key``: the key, and from the second of equal keys on a letter a, b, ... in order; taken keys count as first.

    Beyond z the count is written, so that every key stays different.
    """
    base = citation_key(F.col("authors"), F.col("year"), F.col("title"))
    rows = papers.withColumn("_key", base)
    w = Window.partitionBy("_key").orderBy(order)
    n = F.row_number().over(w) - 1 + F.when(F.col("_key").isin(*taken), 1).otherwise(0) if taken else F.row_number().over(w) - 1
    suffix = F.when(F.col("_n") == 0, "").when(F.col("_n") <= 26, F.char(96 + F.col("_n"))).otherwise(F.concat(F.lit("-"), F.col("_n").cast("string")))
    return rows.withColumn("_n", n).withColumn("cite_key", F.concat("_key", suffix)).drop("_key", "_n")


def bibtex(papers: DataFrame) -> Column:
    """K9: the entry of a paper with cite_key, authors, title, year, venue, source and doi."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    name = lambda a: surname_and_given(a)
    full = F.transform(F.coalesce(F.col("authors"), F.expr("CAST(array() AS array<string>)")), lambda a: F.concat_ws(", ", name(a)["surname"], F.nullif(name(a)["given"], F.lit(""))))
    authors = F.coalesce(F.nullif(F.array_join(full, " and "), F.lit("")), F.lit("Anonymous"))
    title = F.translate(text("title"), "{}", "")
    year = F.coalesce(F.nullif(F.nullif(text("year"), F.lit("0")), F.lit("")), F.lit("n.d."))
    doi = F.trim(text("doi"))
    preprint = F.lower(doi).startswith("10.48550") | F.lower(F.concat(text("source"), text("venue"))).contains("arxiv")
    field = lambda k, v: F.concat(F.lit(f"  {k} = {{"), v, F.lit("}"))
    last = F.when(doi != "", field("doi", doi))
    lines = F.when(preprint, F.array_compact(F.array(field("author", authors), field("title", title), field("year", year), field("eprint", F.regexp_replace(doi, r"(?i)10\.48550/arxiv\.", "")), F.lit("  archivePrefix = {arXiv}"), last))).otherwise(
        F.array_compact(F.array(field("author", authors), field("title", title), F.when(text("venue") != "", field("journal", text("venue"))), field("year", year), last)))
    return F.concat(F.when(preprint, "@misc{").otherwise("@article{"), F.col("cite_key"), F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))


def latex_rows(papers: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, line): a table row for each cluster with its label and the keys of its papers by rank."""
    keys = papers.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cite_key"))), lambda s: s["cite_key"]).alias("k"))
    line = F.concat(F.col("cluster").cast("string"), F.lit(" & "), F.coalesce("label", F.lit("")), F.lit(" & \\citep{"), F.array_join("k", ","), F.lit("} \\\\"))
    return keys.join(labels, "cluster", "left").select("cluster", line.alias("line"))
