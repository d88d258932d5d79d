"""Toxic words of few examples, and few labels."""

import random

from corpusmill.llm import toxicity


def _prose(rng, n):
    return " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}" for _ in range(n))


def _scores(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}


def test_words_of_few_examples(spark):
    rng = random.Random(3)
    rows = [(k, _prose(rng, 30) + (f" zz{'vwxyz'[k // 5 % 5]}qq" if k % 5 == 0 else "")) for k in range(400)]
    got = _scores(spark, rows, [(k, int(k % 5 == 0)) for k, _ in rows])
    assert all(r["predicted"] == int(k % 5 == 0) and (k % 5 or r["evidence"]) for k, r in got.items() if r["held_out"])


def test_few_labels(spark):
    rng = random.Random(4)
    known = [k for k in range(400) if not toxicity.held_out(k)][:4]
    rows = [(k, _prose(rng, 30) + (" zzvqq" if k in known else "")) for k in range(400)] + [(1000, _prose(rng, 30) + " zzvqq"), (1001, _prose(rng, 30))]
    got = _scores(spark, rows, [(k, int(k in known)) for k in range(400)])
    assert got[1000]["score"] > got[1001]["score"] and set(got[1000]["evidence"]) & set(known)
