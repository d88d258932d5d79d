"""Identifiers of several runs, and contexts of one word or at a text's beginning."""

from corpusmill.llm import personal_data


def _spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["spans"].split(",") for r in personal_data.digests(df).collect()}


def test_joined_runs(spark):
    seeds = [f"please call me at +1 743 555 10{k:02d} today" for k in range(40)]
    texts = seeds + ["please call me at 743 555 9999 today", "please call me at (743) 555-9999 today"]
    got = _spans(spark, texts)
    assert "phone:18:30" in got[40] and "phone:18:32" in got[41]


def test_contexts_at_the_beginning(spark):
    seeds = [f"Tel: +1-743-555-10{k:02d} Fax: +1-743-555-20{k:02d}" for k in range(40)]
    got = _spans(spark, seeds + ["Tel: 743-555-9999 Fax: 743-555-8888"])
    assert got[40] == ["phone:5:17", "phone:23:35"]


def test_secrets_behind_their_names(spark):
    """Long hexadecimal numbers make their contexts known; other keys are found there, and numbers elsewhere are not."""
    rows = [(k, f'some words before token = "{k:02d}{"ab12cd34" * 4}" and after') for k in range(8)]
    rows += [(50, 'here token = "Zx9-Kq_77Lm2P0aa" ends'), (51, f'the digest {"0f" * 20} of a file'), (52, 'token = yes then'), (53, None)]
    got = {r["doc_id"]: r["spans"] for r in personal_data.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].startswith("secret:26:") for k in range(8)) and got[50] == "secret:13:31" and got[51] == got[52] == got[53] == ""


def test_values_of_other_contexts(spark):
    """A value that mostly stands behind patterns of other things is no identifier, though one trusted pattern is before it."""
    rows = [(k, f"please call me at +1 (743) 555-{1000 + k} now") for k in range(10)]
    rows += [(100 + k, f"the order number {700 + k}-555-12{k:02d} came") for k in range(10)]
    rows += [(200, "so call me at 743-555-9999 then"), (201, "so call me at 700-555-1200 then")]
    got = {r["doc_id"]: r["spans"] for r in personal_data.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200] == "phone:14:26" and got[201] == "" and got[100] == ""
