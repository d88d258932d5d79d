"""What is shuffled grows with the rows, not with their pairs."""

import random
import time

import numpy as np
import pytest

from pyspark.sql import functions as F

from corpusmill.functions.fuzzy import indel_ratio, token_set_ratio
from corpusmill.operators import matching, similar, textscore
from corpusmill.operators.matching import resolve_in_catalog
from corpusmill.operators.similar import Doubles, Written, alike
from corpusmill.operators.spanning_tree import neighbour_graph
from corpusmill.plans import ingest, retrieval_queries


def _shuffled(spark) -> int:
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_neighbour_graph_sends_a_part_once_to_each_piece(spark):
    def sent(n: int) -> int:
        v = np.random.default_rng(3).normal(size=(n, 64)).round(3)
        points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, vector array<double>")
        before = _shuffled(spark)
        assert neighbour_graph(points, 4, part=32).count() == 4 * n
        return _shuffled(spark) - before

    assert sent(3_000) < 6 * sent(1_000)


def test_alike_sends_strings_without_their_counts(spark):
    rows = spark.range(6_000).select("id", F.concat(F.md5(F.col("id").cast("string")), F.md5(F.concat("id", F.lit("x")))).alias("s"))
    before = _shuffled(spark)
    assert alike(rows, None, 0.9).count() == 0
    assert _shuffled(spark) - before < 12 * 6_000 * 64


def test_chapters_take_words_from_a_text_once(spark):
    text = " ".join(f"w{i * 7919 % 9973}" for i in range(12_000))
    papers = spark.createDataFrame([(f"p{k}", None, "Big book", [], text, "/x/9783161484100.pdf") for k in range(8)], "paper_id string, doi string, title string, keywords array<string>, abstract string, pdf_path string")
    chapters = spark.createDataFrame([("9783161484100", f"10.1/b_{k}", "Some w0 w7919 w5865 other") for k in (2, 1)], "isbn string, doi string, title string")
    start = time.monotonic()
    got = {(r["paper_id"], r["found"]["doi"], round(r["score"], 9)) for r in ingest.chapter_matches(papers, chapters).collect()}
    assert got == {(f"p{k}", "10.1/b_1", round(1 / 3, 9)) for k in range(8)}
    assert time.monotonic() - start < 40


def test_runs_of_two_bound_what_words_of_64_bits_score(monkeypatch):
    monkeypatch.setattr(similar, "_ONE_BY_ONE", 0)
    rng = random.Random(1)
    for trial in range(60):
        letters = ("ab", "abcdef ", "äöü€𝄞 abc")[trial % 3]
        a, *others = ("".join(rng.choices(letters, k=rng.choice([1, 3, 20, 63, 64, 65, 128, 130, 200]))) for _ in range(9))
        want, sizes = np.array([indel_ratio(a, b) for b in others]), np.array([len(a) + len(b) for b in others])
        some = np.array(rng.sample(range(8), 5))
        assert list(Written(others).ratios(a, some)) == list(want[some])
        assert (Doubles([a]).apart(Doubles(others))[0] <= (1 - want) * sizes + 1e-3).all()


def test_catalog_search_does_not_score_all_pairs(spark):
    digest = "concat(md5(CAST(id AS string)), ' ', md5(concat(id, 'x')))"
    rows = spark.range(4_000).selectExpr("id AS doc_id", "CAST(NULL AS string) AS doi", f"{digest} AS title")
    catalog = rows.withColumn("title", F.concat(F.substring("title", 1, 22), F.lit("zzzzzzzzzz"), F.substring("title", 33, 40)))
    start = time.monotonic()
    got = resolve_in_catalog(rows, catalog).agg(F.count_if(F.expr("doc_id = match_id AND method = 'fuzzy'")), F.count(F.lit(1))).first()
    assert tuple(got) == (4_000, 4_000)
    assert time.monotonic() - start < 60


def test_token_sets_find_misspelt_words_in_another_order(spark):
    rows = [(1, "azzzzzzzzzzzz mm"), (2, "zzzzzzzzzzzz mm"), *[(k, f"mm {'qwertyuiopas'[k % 10:]}{k}") for k in range(10, 40)]]
    df = spark.createDataFrame(rows, "id long, s string")
    got = {(r["x"], r["y"]): r["score"] for r in similar.token_set_alike(df, df, 0.8).collect()}
    want = {(i, j): v for i, a in rows for j, b in rows if (v := token_set_ratio(a, b)) >= 0.8}
    assert got == want and (1, 2) in got


def test_token_sets_of_a_block_are_those_one_by_one(monkeypatch):
    monkeypatch.setattr(similar, "_FEW", 2)
    rng, words = random.Random(3), ["trust", "market", "agents", "model", "études", "of", "in", "a", "language", "intermediation", "review"]
    text = lambda: " ".join((w[:-1] + rng.choice("xyz")) if rng.random() < 0.2 else w for w in rng.choices(words, k=rng.randrange(25)))
    for t in (0.5, 0.8, 0.95):
        left, right = ([{"id": k, "s": text()} for k in range(n)] for n in (60, 70))
        want = {(a["id"], b["id"]): v for a in left for b in right if a["s"] and b["s"] and (v := token_set_ratio(a["s"], b["s"])) >= t}
        assert {(x, y): v for x, y, v in similar._set_ratios(left, right, t)} == want and want


def test_ingest_steps_read_what_the_one_before_has_written(spark, monkeypatch):
    monkeypatch.setattr(ingest, "without_duplicates", lambda papers: papers)
    d = "/root/testdata/sf0.001"
    raw = retrieval_queries._raw(spark, d).limit(20)
    titles = raw.select("paper_id", F.concat(F.lit("Registered "), "paper_id").alias("title"), F.lit(None).cast("string").alias("doi"), F.lit(95.0).alias("confidence"))
    out = ingest.ingest(raw, ingest.Sources(titles=[("crossref_title_search", titles)], index=retrieval_queries._index(spark, d).drop("doc_id")))
    assert out._jdf.queryExecution().analyzed().collectLeaves().size() == 1
    assert out.count() == 20


def test_refine_loop_sends_its_catalog_once(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # so that vectors are no small table
    try:
        chars = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
        before = _shuffled(spark)
        assert retrieval_queries._loop(spark, "/root/testdata/sf0.001").run()[0].count() > 0
        sent = _shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sent < 20 * chars  # 15 without the catalog's repeats, 25 with them; terms of candidates are most of it


@pytest.mark.parametrize("t", [0.85, 0.9, 0.95])
def test_long_strings_are_told_apart_before_they_are_scored(t):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdeghilmnoprstu"), rng.integers(2, 10))) for _ in range(2_000)]
    strings = [" ".join(rng.choice(words, rng.integers(90, 130))) for _ in range(60)]
    for k in range(60):  # changed in scattered places, and moved by what is put in before
        s = list(strings[k])
        for at in rng.integers(0, len(s), int(rng.uniform(0, 0.25) * len(s))).tolist():
            s[at] = str(rng.choice(["", "z", "ab"]))
        strings.append("".join(s))
    strings += ["a", "ab", "xy" * 400, "xy" * 401, "yx" * 402]
    scored = {(i, int(j)) for i, at in similar._candidates((strings, strings), t, lambda i, part: np.arange(part.start, min(part.stop, len(strings))) > i) for j in at}
    want = {(i, j) for j in range(len(strings)) for i in range(j) if indel_ratio(strings[i], strings[j]) >= t}
    assert want <= scored and len(want) > 5
    for i, j in scored:
        value = similar._ratio_from(strings[i], strings[j], t)
        assert value == indel_ratio(strings[i], strings[j]) or value < t and (i, j) not in want
    assert t < 0.9 or len(scored) < 3 * len(want) + 50


def test_many_strings_make_few_parts():
    sizes = {43: (64 * 2_000_000, 2_000_000)}
    assert similar._pieces(sizes, 3, 100)[43] <= 62  # 489 before, each sent to all others
    few = {band: (300 * 1_000, 1_000) for band in range(50, 90)}
    assert set(similar._pieces(few, 3, 100).values()) == {1} and set(similar._pieces(few, 3, 300).values()) == {2}
    assert similar._pieces({43: (64 * 40, 40)}, 3, 100) == {43: 3} and similar._pieces({}, 3, 100) == {}


def test_catalog_parts_are_as_large_as_keeps_tasks_busy(spark, monkeypatch):
    assert matching._larger(334, 147, 64) == 8 and matching._larger(34, 15, 64) == 2 and matching._larger(3, 2, 64) == 1
    rows = spark.range(400).selectExpr("id AS doc_id", "CAST(NULL AS string) AS doi", "concat(md5(CAST(id AS string)), ' ', md5(concat(id, 'x'))) AS title")
    asked = rows.withColumn("title", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("A "), "title")).otherwise(F.concat(F.substring("title", 1, 60), F.lit("zzzzz"))))
    found, sent = [], []
    monkeypatch.setattr(matching, "TITLES", 8)
    monkeypatch.setattr(matching, "CATALOG_TITLES", 16)
    for times in (1, 8):
        monkeypatch.setattr(matching, "LARGER", times)
        before = _shuffled(spark)
        found.append(sorted(tuple(r) for r in resolve_in_catalog(asked, rows).collect()))
        sent.append(_shuffled(spark) - before)
    assert found[0] == found[1] and len(found[0]) == 400 and sent[1] < sent[0] / 2


def test_keyphrases_send_no_terms(spark):
    text = " ".join(f"word{i * 7919 % 4001}" for i in range(8_000))
    rows = [(k, f"{text} common{k} pair common{k} pair common{k}") for k in range(40)] + [(7, "zeta zeta zeta zeta zeta pair"), (None, "null null alpha"), (None, "alpha alpha"), (99, None), (98, "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = _shuffled(spark)
    got = {r["doc_id"]: r["keyphrases"] for r in textscore.single_text_keyphrases(docs.filter("doc_id <> 7 AND doc_id < 98"), ["doc_id"]).collect()}
    assert _shuffled(spark) - before < 100_000 and len(got) == 39
    assert all(g[0] == f"common{k}" and {"pair", f"common{k} pair", f"pair common{k}"} <= set(g) and len(g) == 10 for k, g in got.items())
    both = {r["doc_id"]: r["keyphrases"] for r in textscore.single_text_keyphrases(docs, ["doc_id"]).collect()}
    assert both.keys() == set(range(40)) | {None} and both[None] == ["alpha", "null", "alpha alpha", "null alpha", "null null"]
    assert all(both[k] == got[k] for k in got) and both[7][0] == "zeta"
