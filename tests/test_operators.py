import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import fuzzy
from corpusmill.functions import records as R
from corpusmill.operators import query_language as Q
from corpusmill.operators.fuzzy_dedup import fuzzy_duplicates
from corpusmill.operators.graph import connected_components
from corpusmill.plans.stop_policy import Metrics, StopPolicy


def test_doi_and_title(spark):
    df = spark.createDataFrame([("https://dx.doi.org/10.1/AB.",), ("doi:10.1/ab",), ("",), (None,)], "d string")
    assert [r[0] for r in df.select(R.normalize_doi(F.col("d"))).collect()] == ["10.1/ab", "10.1/ab", None, None]
    t = spark.createDataFrame([("  Café: the   Test! ",)], "t string")
    assert t.select(R.normalize_title(F.col("t"))).first()[0] == "café the test"


def test_warnings_in_order(spark):
    df = spark.createDataFrame([(None, [], 1800, "x", ["k"] * 13)], "t string, a array<string>, y int, ab string, k array<string>")
    assert df.select(R.warnings(*map(F.col, "t a y ab k".split()), 2024)).first()[0] == ["title:missing", "authors:missing", "year:out_of_range", "abstract:too_short", "keywords:too_many"]


def test_query_text_and_errors():
    assert Q.build(["a b"], constraints=["c"], exclusions=["d"]) == 'TITLE-ABS-KEY("a b") AND TITLE-ABS-KEY("c") AND NOT TITLE-ABS-KEY("d")'
    assert Q.build() == 'TITLE-ABS-KEY("agents")'


@pytest.mark.parametrize("bad", ["TITLE(", "a AND", "a)", '(a OR "b"'])
def test_bad_queries(spark, bad):
    with pytest.raises(ValueError):
        Q.compile_query(bad)


def test_year_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("t", "a", 2020, "s", "d")], "title string, abstract string, year int, subject string, doi string").write.parquet(str(tmp_path / "c"))
    df = spark.read.parquet(str(tmp_path / "c")).filter(Q.compile_query("TITLE(t) AND PUBYEAR IS 2020"))
    assert "EqualTo(year,2020)" in df._jdf.queryExecution().toString()
    assert df.count() == 1


@pytest.mark.parametrize("history, why", [
    ([(0.95, 0.7)], "success"), ([(0.1, 0.5)], None), ([(0.95, 0.5), (0.6, 0.55)], "recall_regression"), ([(0.6, 0.5), (0.3, 0.52)], None), ([(0.5, 0.5), (0.5, 0.505)], "plateau"), ([(0.5, 0.5), (0.6, 0.4)], "plateau"),
    ([(0.5, 0.1), (0.6, 0.2)], "low_precision"), ([(0.5, 0.5), (0.49, 0.4)], "no_gain"), ([(0.0, 0.0, 0), (0.0, 0.0, 0)], None), ([(0.1, 0.3), (0.2, 0.4), (0.3, 0.5), (0.4, 0.55), (0.5, 0.58)], "max_iterations")])
def test_stop_policy(history, why):
    assert StopPolicy().decide([Metrics(*h) for h in history]) == why


def test_best_iteration():
    best = lambda *rows: StopPolicy().best([Metrics(*r) for r in rows])
    assert best() is None and best((0.9, 0.1), (1.0, 0.0, 0), (0.9, 0.1)) == 0 and best((0.5, 0.9), (0.6, 0.1)) == 1


def test_fuzzy_scores():
    def lcs(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    rng = random.Random(3)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert fuzzy._common(a, b) == lcs(a, b)
    assert fuzzy.indel_ratio("", "") == 1.0
    assert fuzzy.token_sort_ratio("b a", "a b") == 1.0
    assert fuzzy.token_set_ratio("a b c", "a b") == 1.0
    assert fuzzy.difflib_ratio("abc", "abd") == SequenceMatcher(None, "abc", "abd").ratio()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_greedy_duplicates(spark):
    rows = [(1, 2020, None, "A study of agents in the wild"), (2, 2020, "10.1/x", "A Study of Agents in the Wild!"), (3, 2020, None, "A study of agents in the wilds"), (4, 2021, None, "Something else entirely")]
    got = {r[0]: r[1] for r in fuzzy_duplicates(spark.createDataFrame(rows, "doc_id long, year int, doi string, title string")).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: None}
