import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import actions
from corpusmill.functions.fuzzy import token_sort_ratio
from corpusmill.operators import matching, review, strategies, tree
from corpusmill.operators.authors import collapse
from corpusmill.operators.matching import resolve_in_catalog
from corpusmill.sources import export

BASE = [(-1, "n1"), (-1, "n2"), (0, "a"), (0, "b"), (0, "c"), (1, "d"), (1, "e")]


def table(spark, rows):
    return spark.createDataFrame(rows, "cluster_id int, paper_id string")


def test_review(spark):
    original = table(spark, BASE)
    assert review.violations(original, original).count() == 0 and review.moves(original, original).count() == 0
    rescued = table(spark, [(100 if c == -1 else c, p) for c, p in BASE])
    assert [tuple(r) for r in review.remap(original, rescued).collect()] == [(-1, 100)]
    split = table(spark, [({"n1": 5, "n2": 6}.get(p, c), p) for c, p in BASE])
    assert review.remap(original, split).count() == 0 and review.moves(original, split).count() == 2
    bad = table(spark, [*BASE[1:], (0, "d"), (0, "zz")])
    assert sorted(tuple(r) for r in review.violations(original, bad).collect()) == [("duplicate", "d"), ("phantom", "zz"), ("unassigned", "n1")]


def test_catalog_cascade(spark):
    kind = "doc_id long, doi string, title string"
    catalog = spark.createDataFrame([(1, "10.1/a", "First title here"), (2, None, "Second title here"), (3, None, "A rather long third heading about agents")], kind)
    asked = spark.createDataFrame([(10, "https://doi.org/10.1/A", "x"), (11, None, "second  TITLE here"), (12, None, "about agents a rather long third headng"), (13, None, "zq"), (14, None, "On the Second title here"), (15, None, None)], kind)
    assert sorted((r["doc_id"], r["match_id"], r["method"]) for r in resolve_in_catalog(asked, catalog).collect()) == [(10, 1, "doi"), (11, 2, "title"), (12, 3, "fuzzy"), (14, 2, "containment")]


@pytest.mark.parametrize("parts", [(256, 1024), (3, 5)])
def test_catalog_likeness_one_by_one(spark, monkeypatch, parts):
    rng, kind = random.Random(6), "doc_id long, doi string, title string"
    monkeypatch.setattr(matching, "TITLES", parts[0])
    monkeypatch.setattr(matching, "CATALOG_TITLES", parts[1])
    words = ["trust", "market", "agent", "model", "study", "of", "in", "language", "review"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 7))) for _ in range(60)]
    typo = lambda t: t[:(k := rng.randrange(len(t)))] + rng.choice("xyz ") + t[k + rng.randrange(2):]
    known = [(k, None, rng.choice(["", typo(typo(t)), t])) for k, t in enumerate(base)] + [(100, None, None)]
    asked = [(k, None, rng.choice([t, typo(t), " ".join(reversed(t.split())), typo(typo(typo(t)))])) for k, t in enumerate(base)]
    form = lambda t: re.sub(r"\s+", " ", (t or "").strip().lower())
    want = set()
    for k, _, title in asked:
        t = form(title)
        others = [(i, form(x)) for i, _, x in known if form(x)]
        same = [i for i, x in others if x == t]
        inside = [i for i, x in others if x in t or t in x]
        scores = sorted(((-token_sort_ratio(t, x), i) for i, x in others))
        best, second = -scores[0][0], -scores[1][0]
        if same or inside:
            want.add((k, min(same or inside), "title" if same else "containment"))
        elif best >= 0.72 and (best - second >= 0.05 or best >= 0.9):
            want.add((k, scores[0][1], "fuzzy"))
    got = {(r["doc_id"], r["match_id"], r["method"]) for r in resolve_in_catalog(spark.createDataFrame(asked, kind), spark.createDataFrame(known, kind)).collect()}
    assert got == want and len({m for _, _, m in want}) == 3


def test_actions():
    a = actions.parse(['add AND constraint with multi agent from the brief', 'drop "x"', "exclude: robots", "add: Multi Agent", "think harder", "", "narrow on trust", "removed things"])
    assert (a.add, a.exclude, a.other) == (["multi agent", "trust"], ["x", "robots"], ["think harder", "removed things"])
    seeds = ["Multi agent systems", "multi agent robots"]
    add, exclude, rejected = actions.validate(a, seeds, 0.6, applied=("TRUST",), excluded=("X",))
    assert (add, exclude) == (["multi agent"], []) and [(r.phrase, r.mode, r.coverage) for r in rejected] == [("trust", "add", None), ("x", "exclude", None), ("robots", "exclude", 0.5)]
    assert actions.coverage("x", []) == 0.0 and actions.coverage(" ", seeds) == 0.0


def test_authors_and_tree():
    assert collapse(["J. Smith", "John Smith", "Jane Smith", "Anna van der Berg", "van der Berg A.", "Cavazza A.", "Alberto Cavazza PhD", "", "  "]) == ["John Smith", "Jane Smith", "Anna van der Berg", "Alberto Cavazza PhD"]
    gaps = np.array([[0, 1.0, 4.0], [1.0, 0, 3.0], [4.0, 3.0, 0]])
    assert tree.agglomerate([0, 1, 2], gaps) == [(3, 0, 1, 1.0, 2), (4, 2, 3, 3.5, 3)]
    assert tree.agglomerate([0, 1, 2], gaps, "single")[1][3] == 3.0 and tree.agglomerate([0, 1, 2], gaps, "complete")[1][3] == 4.0
    assert tree.agglomerate([0, 1, 2], gaps, "ward")[1][3] == pytest.approx(((2 * 16 + 2 * 9 - 1) / 3) ** 0.5)
    root = tree.nested([0, 1, 2], tree.agglomerate([0, 1, 2], gaps), {0: ["a", "b"]}, {0: 5, 1: 2, 2: 1})
    text = tree.tree_text(root)
    assert "Topic 0 (5 papers)" in text and "a | b" in text and "papers: 8" in text and "[empty]" in text
    assert json.loads(tree.tree_json(root, {0: ["a"]}, "average"))["hierarchy"]["papers"] == 8
    assert tree.dendrogram_html(root).count("<line") == 6
    assert tree.topic_rows(tree.agglomerate([0, 1, 2], gaps), [0, 1, 2])[1]["topics"] == [0, 1, 2]
    assert tree.cosine_distances(np.eye(2)).tolist() == [[0, 1], [1, 0]]


CLUSTERS = [{"cluster_id": c, "label": f"Topic {c}", "paper_ids": p} for c, p in ((-1, ["n1", "n2"]), (0, ["a", "b", "c"]), (1, ["d", "e"]))]


def edited(change):
    entries = review.read_review(review.snapshot(CLUSTERS, {"a": "Ä title"}))
    return change(entries) or entries


def test_apply_review():
    same = review.apply_review(CLUSTERS, edited(lambda e: None))
    assert not same.recompute and not same.moved and not same.remap and [c["cluster_id"] for c in same.clusters] == [-1, 0, 1]

    def move(e):
        e[1].papers.append(e[0].papers.pop())
        e[1].label, e[1].description = "New", "What it is"

    moved = review.apply_review(CLUSTERS, edited(move))
    assert moved.moved == [{"paper_id": "n2", "from_cluster": -1, "to_cluster": 0}] and moved.recompute and moved.remap == {-1: 0}
    assert moved.label_changes[0]["after"] == "New" and moved.description_changes and json.loads(review.audit(moved))["summary"]["moved"] == 1
    rescued = review.apply_review(CLUSTERS, edited(lambda e: [review.ReviewedCluster(100, ["n1", "n2"]), *e[1:]]))
    assert (rescued.new_ids, rescued.dropped_ids, rescued.remap) == ([100], [-1], {-1: 100}) and "New clusters:          [100]" in review.summary(rescued)


@pytest.mark.parametrize("change", [
    lambda e: e[0].papers.append("zz"), lambda e: e[0].papers.append("a"), lambda e: e[0].papers.pop(), lambda e: e[1].papers.clear(), lambda e: [*e, review.ReviewedCluster(0, ["a"])]])
def test_invalid_reviews(change):
    entries = review.read_review(review.snapshot(CLUSTERS))
    result = change(entries)
    with pytest.raises(review.ReviewError):
        review.apply_review(CLUSTERS, result if isinstance(result, list) else entries)


@pytest.mark.parametrize("text", ["", "version: 2\nclusters: []", "version: 1", "version: 1\nclusters: [{label: x}]"])
def test_unreadable_reviews(text):
    with pytest.raises(review.ReviewError):
        review.read_review(text)


def test_gate(tmp_path):
    path = tmp_path / "review.yaml"
    path.write_text("")
    answers = iter(["what", "ready", "reload", "ready"])
    said = []

    def ask(_):
        answer = next(answers)
        if answer == "reload":
            path.write_text(review.snapshot(CLUSTERS), encoding="utf-8")
        return answer

    assert not review.confirm(path, CLUSTERS, ask, said.append, needs_terminal=False).recompute
    assert "empty" in said[1] and len(said) == 4
    with pytest.raises(review.ReviewCancelled):
        review.confirm(path, CLUSTERS, lambda _: "cancel", needs_terminal=False)


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, True), (1, False), (2, True)], "cluster_id int, cluster_match boolean")
    export.write_run(rows, str(tmp_path / "r"), "2024-01")
    export.write_run(rows.filter("cluster_id = 1"), str(tmp_path / "r"), "2024-02")
    runs = spark.read.parquet(str(tmp_path / "r"))
    assert export.latest_run(runs).count() == 2 and export.latest_run(runs, complete=True).count() == 3
    assert {tuple(r) for r in export.manifest(rows).collect()} == {("1", 1, 2, 50.0), ("2", 1, 1, 100.0), ("ALL", 2, 3, 66.7)}
    done = export.freeze(spark, str(tmp_path / "r"), str(tmp_path / "f"))
    assert done["frozen_run"] == "2024-02" and done["total_papers"] == 1 and spark.read.parquet(str(tmp_path / "f/papers")).count() == 1
    assert export.freeze(spark, str(tmp_path / "r"), str(tmp_path / "f"), "2024-01")["n_clusters"] == 2 and spark.read.parquet(str(tmp_path / "f/papers")).count() == 2
    with pytest.raises(ValueError):
        export.freeze(spark, str(tmp_path / "r"), str(tmp_path / "f"), "1999")
    assert '"cluster_id": 1' in export.to_json_text(rows.limit(1))


def test_strategies_as_columns(spark):
    cases = [(["alpha", "Agents", "beta", "gamma", "delta", "eps", "zeta", "eta"], ["on trust"], ["k1", "k2", "k3"]), (["alpha"], [], []), (["systems", "clinical"], ["a", "b"], ["k"]), (["a", "b", "c", "d", "e"], [], ["k"])]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, t array<string>, n array<string>, w array<string>")
    got = {r["k"]: [(s["strategy"], s["query"]) for s in r["s"]] for r in rows.select("k", strategies.strategy_queries(F.col("t"), F.col("n"), F.col("w")).alias("s")).collect()}
    assert got == {k: [(p.strategy_id, p.query) for p in strategies.strategies(t, strategies.Context(n, w))] for k, (t, n, w) in enumerate(cases)}


def test_review_changes_as_tables(spark):
    blocks = "cluster_id int, label string, description string"
    original, edited = table(spark, BASE), table(spark, [(100 if c == -1 else c, p) for c, p in BASE])
    before = spark.createDataFrame([(-1, "Noise", None), (0, "Zero", None), (1, "One", "told")], blocks)
    after = spark.createDataFrame([(100, "", None), (0, " Zero ", ""), (1, "New", "told more")], blocks)
    got = {(r["kind"], r["cluster_id"], r["paper_id"], r["before"], r["after"]) for r in review.changes(original, before, edited, after).collect()}
    moved = {("moved", "100", p, "-1", "100") for c, p in BASE if c == -1}
    assert got == moved | {("new", "100", None, None, None), ("dropped", "-1", None, None, None), ("label", "1", None, "One", "New"), ("description", "1", None, "told", "told more"), ("remap", "-1", None, "-1", "100")}
    assert tuple(review.change_counts(review.changes(original, before, original, before)).first()) == (0, 0, 0, 0, 0, False)


def test_candidates_known_by_title_are_not_looked_for_by_abstract(spark, monkeypatch):
    long = "quite a long abstract of a paper on trust among agents in markets, and on what they owe each other "
    seeds = spark.createDataFrame([(k, k, f"10.1/{k}" if k < 3 else None, f"{'abcdefghi'[k] * 12} title", long + "z" * k) for k in range(9)], "doc_id long, ord long, doi string, title string, abstract string")
    candidates = seeds.drop("ord").unionByName(spark.createDataFrame([(100, "10.1/1", "other", long), (101, None, "nothing like it", long + "yy"), (102, None, "", ""), (8, None, "again", long)], "doc_id long, doi string, title string, abstract string"))
    asked, alike = [], matching.token_set_alike

    def counted(left, right, t):
        asked.append(left.count())
        return alike(left, right, t)

    monkeypatch.setattr(matching, "token_set_alike", counted)
    got = {tuple(r) for r in matching.match_seeds(candidates, seeds).collect()}
    assert {(0, "doi", 0), (100, "doi", 1), (3, "title", 3), (101, "abstract", 0), (8, "title", 8)} <= got and len(got) == 11
    assert asked == [8, 1]  # 12 titles, 10 abstracts before
