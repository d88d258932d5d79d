"""Lexical search, decontamination and snapshot differences against brute force on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import decontamination, lexical_search, snapshots

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(LOWER)


def prose(rng, n, words=300):
    return " ".join(rng.choice(["the", "of", "And", "É", f"w{rng.randrange(words)}"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [prose(rng, n) for n in (5, 30, 80, 200, 300)]
    odd = [None, "", " .,;\n", "the", "THE the", "été ÉTÉ KK 10² \U0001f600x", "x" * 3000, "the " * 400, base[2], base[3][:400] + " " + base[2]]
    return base + odd + [prose(rng, 12000, 3000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, k % 3, [t]) for k, t in enumerate(texts)] + [(0, texts[0], 0, None), (None, "the of w1", 1, None), (0, "w7 w8 another text", 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, term int, `_words` array<string>").repartition(3)


def all_rows(texts):
    return [*enumerate(texts), (0, texts[0]), (None, "the of w1"), (0, "w7 w8 another text")]


@pytest.fixture(scope="module")
def item_rows(texts):
    words = texts[3].split()
    return [(1, "the of w5 W5 É"), (2, " ".join(words[20:45])), (3, " ".join(words[20:45])), (4, "the"), (5, "nothing here qqq zzz"), (6, None), (7, "?!"), (None, "w9 the"), (8, "w11"), (8, "w12 of"), (9, " ".join(words[5:8])), (10, "the " * 12)]


@pytest.fixture(scope="module")
def items(spark, item_rows):
    return spark.createDataFrame(item_rows, "item_id long, text string")


def ranked_by_hand(rows, item_rows, top):
    found = [(d, collections.Counter(TERM(lower(t)))) for d, t in rows]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    total, length = len(found), sum(n for _, _, n in found)
    df = collections.Counter(t for _, c, _ in found for t in c)
    terms = collections.defaultdict(set)
    for k, t in item_rows:
        terms[k] |= set(TERM(lower(t)))
    out = []
    for k, asked in terms.items():
        scores = []
        for d, c, n in found:
            m = 50 + (50 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                scores.append((-score, -1 if d is None else d))
        out += [(k, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("top, vocabulary, buckets", [(50, 200_000, 64), (4, 2, 3)])
def test_search(docs, items, texts, item_rows, top, vocabulary, buckets):
    index = lexical_search.build_index(docs, items, buckets, vocabulary)
    got = [(r["item_id"], r["rank"], -1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in lexical_search.search(index, items, top).collect()]
    assert sorted(got, key=str) == ranked_by_hand(all_rows(texts), item_rows, top)


def test_search_whole_index_and_empty_tables(docs, items, texts, item_rows):
    index = lexical_search.build_index(docs)
    assert index.postings.count() == sum(len(set(TERM(lower(t)))) for _, t in all_rows(texts))
    got = [(r["item_id"], r["rank"], -1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in lexical_search.search(index, items).collect()]
    assert sorted(got, key=str) == ranked_by_hand(all_rows(texts), item_rows, 50)
    assert lexical_search.ranked(docs.limit(0), items).count() == 0 and lexical_search.ranked(docs, items.limit(0)).count() == 0


def hit_by_hand(rows, item_rows, window):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = collections.defaultdict(set)
    for k, t in item_rows:
        w = find(lower(t))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i:i + window])].add(k)
    out = []
    for d, t in rows:
        w, hit, named = find(lower(t)), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if ids := windows.get(tuple(w[i:i + size])):
                    hit |= set(range(i, i + size))
                    named |= ids
        named = sorted(str(k) for k in named if k is not None)
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, shingle, block", [(10, 3, 10**6), (10, 1, 7), (4, 3, 10**6), (25, 5, 10**6)])
def test_decontamination(docs, items, texts, item_rows, window, shingle, block):
    got = decontamination.contaminated(docs, items, decontamination.Settings(window, shingle, block)).collect()
    assert sorted((tuple(r) for r in got), key=str) == hit_by_hand(all_rows(texts), item_rows, window)


def test_decontamination_of_nothing(docs, items):
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    rows = decontamination.contaminated(docs, items.limit(0)).collect()
    assert len(rows) == docs.count() and not any(r["contaminated"] or r["n_items"] for r in rows)


def changed(rows):
    out = []
    for k, t, a, b in rows:
        r = 15 if k is None else zlib.crc32(str(k).encode()) % 16
        if r == 0:
            continue
        if r == 1:
            t = (t or "") + "+"
        if r == 2:
            a, b = b, a
        out.append((-1 - k, t, a, None if r == 4 else b) if r in (3, 4) else (k, t, a, b))
        if r == 5:
            out.append((-1 - k, t, a, b))
    return out


def digest(row):
    return hashlib.sha256("\n".join("~" if x is None else x for x in row).encode()).hexdigest()


def difference_by_hand(earlier, later):
    """For keys that are different within a snapshot."""
    old, new = {r[0]: r[1:] for r in earlier}, {r[0]: r[1:] for r in later}
    out, names = [], ["text", "lang", "source"]
    told = lambda a, b: ",".join(n for n, x, y in zip(names, a, b) if x != y)
    for k in old.keys() & new.keys():
        out.append((k, k, "same" if old[k] == new[k] else "update", told(old[k], new[k]), digest(new[k])))
    lone = [collections.defaultdict(list), collections.defaultdict(list)]
    for side, mine, other in ((0, old, new), (1, new, old)):
        for k in sorted(mine.keys() - other.keys(), key=lambda k: (k is not None, k)):
            lone[side][mine[k][0]].append(k)
    for text in lone[0].keys() | lone[1].keys():
        a, b = lone[0][text], lone[1][text]
        out += [(y, x, "rekey", told(old[x], new[y]), digest(new[y])) for x, y in zip(a, b)]
        out += [(x, x, "delete", "", None) for x in a[len(b):]] + [(y, None, "insert", "", digest(new[y])) for y in b[len(a):]]
    return sorted(out, key=str)


KIND = "doc_id long, text string, lang string, source string"


def test_snapshot_difference(spark):
    rng = random.Random(8)
    shared = ["one text", "", None, "long " * 5000]
    rows = [(k, rng.choice(shared) if rng.random() < 0.6 else prose(rng, 9), rng.choice(["en", "de", None, "~"]), rng.choice(["a", "b", None])) for k in range(-150, 250)] + [(None, "null key", "en", "a")]
    docs = spark.createDataFrame(rows, KIND).withColumns({"key": F.lit("k"), "_sign": F.lit(3)}).repartition(5)
    later = snapshots.later_snapshot(docs.filter("doc_id >= 0 OR doc_id IS NULL"))
    after = changed([r for r in rows if r[0] is None or r[0] >= 0])
    assert sorted(map(str, later.collect())) == sorted(map(str, spark.createDataFrame(after, KIND).collect()))
    got = sorted((tuple(r) for r in snapshots.difference(docs, later).collect()), key=str)
    assert got == difference_by_hand(rows, after)
    assert {r[2] for r in got} == {"same", "update", "rekey", "insert", "delete"}


def test_repeated_keys_and_rows(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "COPIES", 2)
    a = spark.createDataFrame([(1, "x", "l", "s")] * 7 + [(2, "y", "l", "s"), (2, "z", "l", "s"), (3, "w", "l", "s"), (3, "w", "l", "s")], KIND)
    b = spark.createDataFrame([(1, "x", "l", "s")] * 5 + [(2, "z", "l", "s"), (2, "q", "l", "s"), (4, "x", "m", "s"), (5, "w", "l", None)], KIND)
    got = collections.Counter((r["key"], r["old_key"], r["op"], r["changed"]) for r in snapshots.difference(a, b).collect())
    assert got == {(1, 1, "same", ""): 5, (2, 2, "same", ""): 1, (2, 2, "update", "text"): 1, (4, 1, "rekey", "lang"): 1, (1, 1, "delete", ""): 1, (5, 3, "rekey", "source"): 1, (3, 3, "delete", ""): 1}


def test_empty_snapshots(spark):
    a, none = spark.createDataFrame([(1, "x", "l", "s")], KIND), spark.createDataFrame([], KIND)
    assert [r["op"] for r in snapshots.difference(a, none).collect()] == ["delete"] and [r["op"] for r in snapshots.difference(none, a).collect()] == ["insert"]
    assert snapshots.difference(none, none).count() == 0


def test_places_in_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") * 7919 % 5000).alias("o"))
    got = {}
    for r in snapshots.placed(rows, ["g"], ["o"]).collect():
        got.setdefault(r["g"], []).append((r["_place"], r["o"]))
    assert all(sorted(v) == list(enumerate(sorted(o for _, o in v))) for v in got.values()) and len(got["hot"]) == 1667
