"""Density labels without a table of near pairs: the same as from the pairs, and growing with the points."""

import numpy as np

from corpusmill.operators import clustering as C
from tests.test_growth import _shuffled

KIND = "doc_id long, vector array<double>"


def test_labels_within_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(C, "MEETING", 16)  # several pieces of a cell
    rng = np.random.default_rng(5)
    some = rng.normal(0, 0.15, (330, 5)).round(2)
    v = np.concatenate([some, some[:40], some[:9]])  # copies count
    rows = [(int(i), x.tolist()) for i, x in zip(rng.permutation(len(v)), v)]
    points = spark.createDataFrame(rows, KIND)
    for radius, samples, size in ((0.12, 3, 2), (0.15, 4, 3), (0.1, 1, 1)):
        pairs = C.near_pairs(points, radius)
        want = {(r["doc_id"], r["cluster"]) for r in C.density_labels(points, pairs, radius, samples, size).collect()}
        assert {(r["doc_id"], r["cluster"]) for r in C.labels_within(points, radius, samples, size).collect()} == want
        assert len({c for _, c in want}) > 3


def test_labels_within_send_no_pairs(spark):
    v = np.random.default_rng(6).normal(0, 0.02, (3_000, 5))  # nearly all are near to each other
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(i + 3_000, [0.0] * 5) for i in range(3_000)], KIND)
    before = _shuffled(spark)
    assert {r["cluster"] for r in C.labels_within(points, 0.1, 3, 2).collect()} == {0}
    assert _shuffled(spark) - before < 30_000_000


def test_labels_within_are_the_same_whatever_meets_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(5)
    some = rng.normal(0, 0.12, (260, 5)).round(2)
    points = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(rng.permutation(300), np.concatenate([some, some[:40]]))], KIND)
    want = {tuple(r) for r in C.density_labels(points, C.near_pairs(points, 0.12), 0.12, 3, 2).collect()}
    monkeypatch.setattr(C, "AT_A_TIME", 16)
    monkeypatch.setattr(C, "COLUMNS", 7)  # a matrix was as wide as all that meets
    assert {tuple(r) for r in C.labels_within(points, 0.12, 3, 2).collect()} == want and len({c for _, c in want}) > 3
