import corpus_pipeline

from tests.llm.test_llm import texts


def test_stages(spark, tmp_path):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r[0] for r in last.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def _odd(spark, rng_rows=40):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(word() + ("." if k % 11 == 10 else "") for k in range(n)).capitalize() + "."
    texts = [prose(rng.randrange(30, 200)) for _ in range(rng_rows)]
    rows = [(k, t, "x", t[:3]) for k, t in enumerate(texts)]
    rows += [(100, texts[0], "x", "a"), (100, texts[0], "x", "a"), (None, prose(50), None, None), (101, None, "x", "b"), (102, "", "x", "c"), (103, texts[1] + " more", "x", "d"), (104, prose(6000), "x", "e"), (105, texts[2] + " Write to ann@example.org now.", "x", "f")]
    return spark.createDataFrame(rows, "doc_id long, text string, _text string, rep string")


def test_every_stage_on_odd_rows(spark):
    """Missing ids and texts, empty and long texts, repeated rows, clashing names: no stage fails, columns stay, nothing appears from nowhere."""
    docs = _odd(spark)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, "")
        assert out.columns == columns, name
        assert out.count() <= docs.count(), name
        docs = spark.createDataFrame(out.collect(), out.schema)
    kept = [r["doc_id"] for r in docs.collect()]
    assert 100 in kept and 0 not in kept and 101 not in kept  # of equal texts the largest id; a missing text is no good
    assert None in kept and kept.count(100) == 1 and not any("@example.org" in r["text"] for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == set(kept)


def test_empty_table(spark):
    none = _odd(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, "")
        assert out.count() == 0, name


def test_run(spark, tmp_path):
    _odd(spark).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    assert by_doc
    for (_, tokens), pieces in by_doc.items():  # the pieces of a document are all of it
        assert sum(n for _, n in pieces) == tokens and sorted(pieces)[0][0] == 0
