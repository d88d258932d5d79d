"""Readers and writers of files, settings, models, streams and SQL functions."""

import json

import pytest
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import functions as F

from corpusmill.functions import fuzzy
from corpusmill.functions.checkpointing import cut, drop
from corpusmill.functions.joins import bounded
from corpusmill.sources import catalog, config, export
from corpusmill.streaming.ingest import counts_by_window, new_records


def test_json_scans(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"paper_id": "a", "title": "Ä", "keywords": ["k"], "year": 2020}, {"title": "no id"}, {"paper_id": "b", "title": "T", "year": "x"}]), encoding="utf-8")
    rows = catalog.read_papers(spark, str(tmp_path / "p.json")).collect()
    assert [(r["paper_id"], r["title"]) for r in rows][0] == ("a", "Ä") and all(r["paper_id"] for r in rows)
    (tmp_path / "c.json").write_text(json.dumps([{"cluster_id": 1, "label": "L", "paper_ids": ["a"]}, {"label": "no id"}]))
    assert [r["label"] for r in catalog.read_clusters(spark, str(tmp_path / "c.json")).collect()] == ["L"]
    (tmp_path / "b.json").write_text(json.dumps([{"cluster_id": 1, "core_query_axes": [["x"], ["y"]], "anomalous_papers": [{"paper_id": "a", "suggested_action": "exclude_from_seeds"}, {"paper_id": "b", "suggested_action": "keep_with_warning"}]}]))
    briefs = catalog.read_briefs(spark, str(tmp_path / "b.json"))
    seeds = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "cluster int, paper_id string")
    assert sorted(tuple(r) for r in catalog.without_excluded(seeds, briefs).collect()) == [(1, "b"), (2, "a")]


def test_csv_catalog(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes(b'\xef\xbb\xbfTitle,DOI,Year\n"A title, with comma",10.1/a,2020\n,10.1/b,2021\nOther,,2022\n')
    assert sorted((r["title"], r["doi"]) for r in catalog.read_catalog(spark, str(tmp_path / "c.csv")).collect()) == [("A title, with comma", "10.1/a"), ("Other", None)]


def test_run_files(spark, tmp_path):
    for cluster, ts in ((-1, "20240101_000000"), (3, "20240101_000000"), (3, "20240102_000000")):
        (tmp_path / f"phase7_cluster{cluster}_focused_{ts}.json").write_text(json.dumps({"cluster_id": cluster, "counts": {"n_input": 4}}))
    rows = export.read_run_files(spark, str(tmp_path / "*.json"), "cluster_id int, counts struct<n_input: int>")
    assert sorted((r["file_cluster_id"], r["run_ts"]) for r in rows.collect()) == [(-1, "20240101_000000"), (3, "20240101_000000"), (3, "20240102_000000")]


def test_written_papers(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Ä", "x", ["k", "l"], ["A", "B"], 2020, None, "s", None, None, 0, ["s", "t"])], "paper_id string, title string, abstract string, keywords array<string>, authors array<string>, year int, doi string, source string, venue string, url string, citations_count int, retrieved_from array<string>")
    flat = export.flat_papers(rows).first()
    assert (flat["authors"], flat["retrieved_from"], len(flat)) == ("A; B", "s|t", 12)
    export.write_json(rows, str(tmp_path / "j"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "j").glob("*.json"))
    assert "Ä" in text and '"doi":null' in text
    with pytest.raises(ValueError):
        export.to_json_text(spark.range(5), most=4)
    line = export.latex_rows(spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "cluster int, rank int, cite_key string"), spark.createDataFrame([(1, "L")], "cluster int, label string")).first()["line"]
    assert line == "1 & L & \\citep{a,b} \\\\"


def test_models(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",)], "s string")
    for stamp, df in (("2024", rows.filter("s = 'a'")), ("2025", rows)):
        export.save_model(StringIndexer(inputCol="s", outputCol="i").fit(df), str(tmp_path), "labels", stamp)
    assert sorted(export.load_latest(spark, str(tmp_path), "labels", StringIndexerModel.load).labels) == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        export.load_latest(spark, str(tmp_path), "others", StringIndexerModel.load)


def test_settings(tmp_path):
    assert config.scoring().weights["lexical"] == 0.15 and config.scoring().subject_areas == config.AREAS
    path = tmp_path / "s.yaml"
    path.write_text("weights: {citation_velocity: 0.5}\nrecency: {current_year: 2024}\nsubject_areas: {enabled: false}\nsampling: {per_year_results: 9}\n")
    s = config.scoring(str(path))
    assert (s.weights["velocity"], s.reference_year, s.subject_areas, s.per_year) == (0.5, 2024, (), 9)
    for k, text in enumerate(("", "weights: {other: 1}", "weights: {lexical: -1}")):
        bad = tmp_path / f"bad{k}.yaml"
        bad.write_text(text)
        with pytest.raises(ValueError):
            config.scoring(str(bad))


def test_functions_in_sql(spark):
    fuzzy.register(spark)
    row = spark.sql("SELECT indel_ratio('abc', 'abd') AS a, token_sort_ratio('b a', 'a b') AS b, token_set_ratio('a b c', 'a b') AS c, difflib_ratio('ab', CAST(NULL AS STRING)) AS d, author_dedupe(array('J. Smith', 'John Smith')) AS e").first()
    assert row["a"] == pytest.approx(2 / 3) and row["b"] == row["c"] == 1.0 and row["d"] is None and row["e"] == ["John Smith"]


def test_tables_that_cut_lineage(spark):
    table = cut(spark.range(10).withColumn("x", F.lit("y")))
    assert table.count() == 10 and bounded(table, 10) is not table and bounded(table, 9) is table
    assert "Parquet" in table._jdf.queryExecution().toString() or "parquet" in table._jdf.queryExecution().toString()
    drop(table, None)


def test_streams(spark, tmp_path):
    kind = "paper_id string, doi string, retrieved_at timestamp, event_type string"
    spark.createDataFrame([("a", "10.1/X"), ("b", "https://doi.org/10.1/x"), ("c", None), ("d", None)], "paper_id string, doi string").selectExpr("*", "timestamp'2024-01-01 00:00:00' AS retrieved_at", "'click' AS event_type").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    for k, df in enumerate((new_records(read()), counts_by_window(read().withColumnRenamed("retrieved_at", "ts")))):
        query = df.writeStream.format("memory").queryName(f"out{k}").outputMode("append" if k == 0 else "complete").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.table("out0").count() == 3 and [r["n"] for r in spark.table("out1").collect()] == [4]
