"""Operators that SQL cannot express, against plain loops over small tables."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import firstpage
from corpusmill.functions.fuzzy import difflib_ratio, indel_ratio, token_set_ratio
from corpusmill.operators import clustering as C
from corpusmill.operators import textscore as X
from corpusmill.operators.fuzzy_dedup import fuzzy_duplicates
from corpusmill.operators.matching import aggregate_strategies, exclude_seed_copies, match_seeds
from corpusmill.operators.ranking import quality_report
from corpusmill.operators.similar import alike, token_set_alike
from corpusmill.plans import ingest
from corpusmill.sources import connectors as N
from corpusmill.sources import documents as D

WORDS = "agents models of trust in large systems and the study case review deep learning market design a b xy".split()


def titles(rng, n):
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            t = list(rng.choice(out))
            for _ in range(rng.randrange(3)):
                if t:
                    t[rng.randrange(len(t)):][:1] = rng.choice(["", "x", "qz"])
            out.append("".join(t)[: rng.choice([5, 9, 200])].strip() or "t")
        else:
            out.append(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9))))
    return out


@pytest.mark.parametrize("t", [0.9, 0.85, 0.95, 0.7])
def test_alike(spark, t):
    rng = random.Random(int(100 * t))
    strings = sorted({s for s in titles(rng, 150) if s})
    df = spark.createDataFrame(list(enumerate(strings)), "id long, s string")
    got = {(r["x"], r["y"]) for r in alike(df, None, t).collect()}
    want = {(i, j) for i in range(len(strings)) for j in range(i + 1, len(strings)) if indel_ratio(strings[i], strings[j]) >= t}
    assert got == want and (t > 0.9 or want)
    left, right = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    got = {(r["x"], r["y"]) for r in alike(left, right, t, score=difflib_ratio).collect()}
    assert got == {(i, j) for i in range(0, len(strings), 2) for j in range(1, len(strings), 2) if difflib_ratio(strings[i], strings[j]) >= t}


@pytest.mark.parametrize("t", [0.95, 0.88, 0.8])
def test_token_sets(spark, t):
    rng = random.Random(int(100 * t) + 1)
    strings = sorted({s for s in titles(rng, 80) if s})
    df = spark.createDataFrame(list(enumerate(strings)), "id long, s string")
    got = {(r["x"], r["y"]) for r in token_set_alike(df, df, t).collect()}
    want = {(i, j) for i in range(len(strings)) for j in range(len(strings)) if token_set_ratio(strings[i], strings[j]) >= t}
    assert got <= want and len(got) >= 0.98 * len(want)


def greedy(rows):
    kept, out = [], {}
    for i, year, doi, title in sorted(rows, key=lambda r: r[0]):
        hit = next((k for k in kept if doi and k[2] == doi), None)
        if hit is None and title:
            hit = next((k for k in kept if k[3] and (not year or not k[1] or year == k[1]) and indel_ratio(title, k[3]) >= 0.9), None)
        if hit is None:
            kept.append((i, year, doi, title))
        out[i] = hit and hit[0]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_order(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, 2020, 2021]), rng.choice([None, None, f"10.1/{rng.randrange(40)}"]), t if rng.random() < 0.95 else None) for i, t in enumerate(titles(rng, 160))]
    got = {r["doc_id"]: r["duplicate_of"] for r in fuzzy_duplicates(spark.createDataFrame(rows, "doc_id long, year int, doi string, title string")).collect()}
    assert got == greedy(rows)


def test_strategies_by_title(spark):
    rng = random.Random(3)
    names = titles(rng, 60)
    rows = [(s, k, 100 * j + k, rng.choice([None, f"10.1/{rng.randrange(12)}"]), t) for j, s in enumerate("abc") for k, t in enumerate(rng.sample(names, 25))]
    seeds = [("10.1/3", names[0]), (None, names[1])]
    gone, seed_titles = {"10.1/3"}, {t.lower() for _, t in seeds}
    by_doi, standing = {}, []
    for s, k, i, doi, t in rows:
        if doi:
            if doi not in gone:
                by_doi.setdefault(doi, [i, []])[1].append(s)
        else:
            hit = next((x for x in standing if token_set_ratio(t.lower(), x[1]) >= 0.95), None)
            if hit:
                hit[2].append(s)
            elif t.lower() not in seed_titles:
                standing.append((i, t.lower(), [s]))
    want = {(i, tuple(dict.fromkeys(s))) for i, s in by_doi.values()} | {(i, tuple(dict.fromkeys(s))) for i, _, s in standing}
    found = spark.createDataFrame(rows, "strategy string, ord long, doc_id long, doi string, title string")
    out = aggregate_strategies(found, spark.createDataFrame(seeds, "doi string, title string")).collect()
    assert {(r["doc_id"], tuple(r["strategies"])) for r in out} == want
    assert [r["n_strategies"] for r in out] == sorted((r["n_strategies"] for r in out), reverse=True)


def test_seeds(spark):
    kind = "doc_id long, doi string, title string, abstract string"
    long = "A long abstract that says quite a lot about agents and trust in markets, so that it can be told again by its words"
    seeds = spark.createDataFrame([(1, "10.1/a", "Agents in Markets", long), (2, None, "single", None), (3, None, "Trust and Design of Systems", None)], kind).withColumn("ord", F.col("doc_id"))
    asked = spark.createDataFrame([(10, "https://doi.org/10.1/A", None, None), (11, None, "markets: agents in Markets", None), (12, None, "nothing", long + " indeed"), (13, None, "single", None), (3, None, None, None), (14, None, "design of systems and trust", "x")], kind)
    got = {r["doc_id"]: (r["method"], r["seed_id"]) for r in match_seeds(asked, seeds).collect()}
    assert got == {10: ("doi", 1), 11: ("title", 1), 12: ("abstract", 1), 3: ("paper_id", 3), 14: ("title", 3)}
    rest = exclude_seed_copies(spark.createDataFrame([(1, "10.1/A", "x"), (2, None, "Ágents in market"), (3, None, "Other"), (4, None, None)], "doc_id long, doi string, title string"), seeds)
    assert {r[0] for r in rest.select("doc_id").collect()} == {3, 4}


def test_coherence(spark):
    rng = random.Random(4)
    docs = [[rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rng.choice([3, 8, 40, 150]))] for _ in range(30)] + [[]]
    df = spark.createDataFrame([(" ".join(d),) for d in docs], "text string")
    topic = ["alpha", "beta", "gamma", "zzz"]

    def windows(width):
        return [set(d[i:i + width]) for d in docs for i in range(max(1, len(d) - width + 1))]

    def npmi(ws, a, b):
        n, one, other, both = len(ws), sum(a in w for w in ws), sum(b in w for w in ws), sum(a in w and b in w for w in ws)
        return math.log((both / n + 1e-12) / (one / n * other / n)) / -math.log(both / n + 1e-12) if one and other else 0.0

    wide, narrow = windows(110), windows(10)
    v = np.array([[npmi(wide, a, b) for b in topic] for a in topic])
    s = v.sum(0)
    cos = [float(x @ s / (np.linalg.norm(x) * np.linalg.norm(s))) if np.linalg.norm(x) * np.linalg.norm(s) else 0.0 for x in v]
    pairs = [npmi(narrow, a, b) for i, a in enumerate(topic) for b in topic[:i]]
    got = X.coherence(df, {7: topic}).first()
    assert got["topic"] == 7 and got["c_v"] == pytest.approx(np.mean(cos)) and got["c_npmi"] == pytest.approx(np.mean(pairs))


def test_density(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.05, (30, 4)) for c in (0, 1, 3)] + [rng.uniform(-2, 5, (15, 4))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "doc_id long, vector array<double>")
    radius, samples, size = 0.15, 4, 3
    gap = np.linalg.norm(points[:, None] - points[None], axis=2)
    pairs = C.near_pairs(df, radius)
    assert {(r["x"], r["y"]) for r in pairs.collect()} == {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if gap[i, j] <= radius}
    core = {i for i in range(len(points)) if (gap[i] <= radius).sum() >= samples}
    label = {}
    for i in sorted(core):
        todo = [] if i in label else [i]
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = i
                todo += [k for k in core if gap[j, k] <= radius]
    for i in set(range(len(points))) - core:
        near = [(gap[i, k], k) for k in core if gap[i, k] <= radius]
        if near:
            label[i] = label[min(near)[1]]
    groups = {}
    for i, r in label.items():
        groups.setdefault(r, set()).add(i)
    want = {frozenset(g) for g in groups.values() if len(g) >= size}
    got = {}
    for r in C.density_labels(df, pairs, radius, samples, size).collect():
        got.setdefault(r["cluster"], set()).add(r["doc_id"])
    noise = got.pop(-1, set())
    assert {frozenset(g) for g in got.values()} == want and noise == set(range(len(points))) - set().union(*want)
    assert sorted(got) == list(range(len(got)))


def test_composite_score():
    g = C.Grid()
    assert C.composite(10, 0.8, 0.5, 0.25, 100, g) == pytest.approx(0.5 * 0.8 * 1.0 * 0.5)
    assert C.composite(5, 1.0, -0.5, 1.0, 100, g) == 0.0 and C.composite(5, 1.0, 1.0, 1.0, 400, g) == pytest.approx((5 / 20) ** 2)


def test_report(spark):
    rows = spark.createDataFrame([(1, True, 0.7, 0.5, 0.9, 0.1)] + [(1, True, 0.2, 0.5, 0.9, 0.1)] + [(1, False, 0.1, None, None, None)] * 8, "cluster int, cluster_match boolean, similarity double, final double, recency double, semantic double")
    weighted = {r["cluster"]: r for r in quality_report(rows, {"semantic": 10.0, "recency": 0.1}).collect()}["1"]
    assert (weighted["kept_pct"], weighted["affinity_min"], weighted["n_affinity_below_0_3"], weighted["strongest"]) == (20.0, 0.2, 1, "semantic")
    assert weighted["affinity_median"] == pytest.approx(0.45) and {r["cluster"]: r["strongest"] for r in quality_report(rows).collect()} == {"1": "recency", "ALL": "recency"}


def pdf(text, title=b"(A Title in \\(parts\\))"):
    lines = b" T* ".join(b"[(" + w.encode() + b") -300 (end)] TJ" for w in text.split("\n"))
    data = zlib.compress(b"BT /F1 12 Tf " + lines + b" ET")
    return b"%PDF-1.4\n1 0 obj << /Title " + title + b" >> endobj\n2 0 obj << /Length 9 /Filter /FlateDecode >>\nstream\n" + data + b"\nendstream endobj\n%%EOF"


def test_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/2308.12345v2.pdf").write_bytes(pdf("A Study of Things\nAnna Smith, Bob Stone and Carl Menger\nUniversity of X\nAbstract: " + "we study many things at length here " * 3))
    (tmp_path / "broken.pdf").write_bytes(b"nothing")
    (tmp_path / "zz_some-paper-7.pdf").write_bytes(pdf("x", b"(a__b)"))
    files = D.scan(spark, str(tmp_path))
    assert files.count() == 3 and D.scan(spark, str(tmp_path), most=1).count() == 1 and D.scan(spark, str(tmp_path), recursive=False).count() == 2
    rows = {r["paper_id"]: r for r in D.papers_from_pages(D.decoded(files)).collect()}
    first = rows["p_arxiv_2308_12345"]
    assert first["title"] == "A Title in (parts)" and first["authors"] == ["Anna Smith", "Bob Stone", "Carl Menger"] and first["abstract"].startswith("we study many") and first["pdf_num_pages"] == 1
    assert len(rows) == 2 and any(r["title"] == "zz some paper" for r in rows.values())
    assert D.full_texts(D.decoded(files), 10).count() == 1 and D.full_texts(D.decoded(files), 500).count() == 0
    with pytest.raises(ValueError):
        D.decode_pdf(b"x")


PAGES = {
    "": (None, []),
    "Abstract\nshort": (None, []),
    "Title\nAnna de la Cruz\nUniversity of Y\nAbstract": ("Anna de la Cruz", []),
    "A Title of Work\nAnna Cruz\nUniversity of Y\n": ("A Title of Work", ["Anna Cruz"]),
    "arXiv:1\nThe Real Title\nover two lines\nAbstract": ("The Real Title over two lines", []),
    "Deep Learning\nAnna Smith, Bob van der Berg and Carl Menger\nCollege of Z": ("Deep Learning", ["Anna Smith", "Bob van der Berg", "Carl Menger"]),
    "Copyright 2020\n12\nTrust in markets of many agents\nAnna Smith a, Bob Stone b\n1 Institute of W\nDan Brown, Eve Black": ("Trust in markets of many agents", ["Anna Smith", "Bob Stone"]),
    "Anna Smith and Bob Stone\nA study of trust\nKeywords: a, b": ("A study of trust", ["Anna Smith", "Bob Stone"]),
    "Trust and agents in the large, Anna Smith\nx@y.org": ("Trust and agents in the large", []),
    "Introduction to the algebra of things\nmore\nIntroduction\nAnna Smith, Bob Stone": ("Introduction to the algebra of things", []),
}


def test_first_page_names(spark):
    rows = spark.createDataFrame([(t,) for t in [*PAGES, None]], "text string")
    got = {r["text"]: (r["title_candidate"], r["authors_candidate"]) for r in firstpage.first_page_metadata(rows).collect()}
    assert got == PAGES | {None: (None, [])}


def test_retries():
    waits, answers = [], iter([OSError(), N.Answer(503), N.Answer(429, retry_after=9.0), N.Answer(200, "ok")])

    def ask():
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    assert N.get_with_retries(ask, 4, waits.append).body == "ok" and waits == [1.0, 2.0, 9.0]
    assert N.get_with_retries(lambda: N.Answer(404), wait=waits.append).status == 404
    assert N.get_with_retries(lambda: N.Answer(429), 2, lambda s: None).status == 429
    with pytest.raises(OSError):
        N.get_with_retries(lambda: (_ for _ in ()).throw(OSError()), 2, lambda s: None)


def test_advice_and_lookup(spark):
    papers = spark.createDataFrame([("a", "x"), ("b", "y")], "paper_id string, title string")
    said = N.advised(papers, lambda r: {"title": "T"} if r["paper_id"] == "a" else 1 / 0, ["title"], "struct<title: string>")
    assert [(r["paper_id"], r["said"]["title"]) for r in said.collect()] == [("a", "T")] and N.advised(papers, None, ["title"], "struct<title: string>").count() == 0


def test_chapters(spark):
    kind = "paper_id string, doi string, title string, keywords array<string>, abstract string, pdf_path string"
    papers = spark.createDataFrame([("a", None, "Trust in big markets", ["k"], "of agents and people", "/x/9783161484100_2.pdf"), ("b", "10.1/x", "Trust in big markets", [], "", "/x/9783161484100_2.pdf"), ("c", None, "Other", [], "", "/x/9783161484100.pdf")], kind)
    chapters = spark.createDataFrame([("9783161484100", "10.1/b_1", "Trust in Big Markets"), ("9783161484100", "10.1/b", "Trust in Big Markets"), ("9783161484100", "10.1/b_2", "Other work"), ("9783161484100", "10.1/b_3", "Trust in Big Shops today")], "isbn string, doi string, title string")
    got = {r["paper_id"]: (r["found"]["doi"], r["score"]) for r in ingest.chapter_matches(papers, chapters).collect()}
    assert got == {"a": ("10.1/b_1", 1.0)}
