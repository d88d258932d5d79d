"""The operators against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from corpusmill.llm import exact_dedup, language_model, licences, near_dedup, packing, passages, personal_data, piece_codec, quality, toxicity
from corpusmill.llm.queries import _tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
LOWER = {c: c + 32 for c in range(65, 91)}


def _prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "and", "the", "of", f"w{rng.randrange(400)}"]) for _ in range(n))


def texts():
    rng = random.Random(11)
    base = [_prose(rng, n) for n in (60, 80, 120, 200)]
    near = [b.replace("beta", "betas", 1) for b in base]
    passage = _prose(rng, 70)
    odd = [None, "", " \n\t", "one", "One", "x " * 30, "é😀 \x00 \x1c ü　x", "<|endoftext|> <s> ▁▁", "+1 (743) 555-3824 a@b.co 1.2.3.4 4111 1111 1111 1111", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."]
    long_ = _prose(rng, 9000)
    return base + near + [base[0], base[1], passage + " " + _prose(rng, 60), _prose(rng, 50) + " " + passage] + odd + [long_, long_ + "!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, k % 3, "x", 1, [t]) for k, t in enumerate(texts())]
    rows += [rows[0], (None, "no id at all", 0, "x", 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, `_hash` int, name string, n long, `_row` array<string>").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def all_texts():
    return [(k, t or "") for k, t in enumerate(texts())] + [(0, texts()[0]), (None, "no id at all")]


def test_pieces(docs, none):
    import sentencepiece

    path = _tokenizer("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((str(d), lib.encode(t), [p.begin for p in lib.encode(t, return_type="proto").pieces], [p.end for p in lib.encode(t, return_type="proto").pieces]) for d, t in all_texts())
    got = piece_codec.encode(docs, path)
    assert sorted((str(r["doc_id"]), r["ids"], r["begins"], r["ends"]) for r in rows_of(got)) == want
    assert sorted(r["text"] for r in rows_of(piece_codec.decode(got, path))) == sorted(lib.decode(ids) for _, ids, _, _ in want)
    digests = {str(r["doc_id"]): r for r in rows_of(piece_codec.round_trip(docs, path))}
    assert all(digests[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for d, ids, _, _ in want)
    assert piece_codec.round_trip(none, path).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    lib, model = sentencepiece.SentencePieceNormalizer(rule_name=rule), pb.ModelProto()
    model.ParseFromString(lib.serialized_model_proto())
    spec = model.normalizer_spec
    own = piece_codec.Normaliser(piece_codec.read_character_map(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
    for text in ["", " ", "  a  b ", "ＡＢＣ ﬁ①  ㌀ x", "ｶﾞ が é  é\n"]:
        want = lib.normalize(text, with_offsets=True)
        norm, align = own(text)
        lead = np.concatenate([(np.frombuffer(norm.encode(), np.uint8) & 0xC0) != 0x80, [True]])
        at = np.cumsum([0] + [len(ch.encode()) for ch in text])  # the library counts characters
        assert (norm, align[lead].tolist()) == (want[0], [int(at[k]) for k in want[1]])


@pytest.mark.parametrize("group", [packing.GROUP, 8192])
def test_packing(docs, none, group):
    from tokenizers import Tokenizer

    path = _tokenizer("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = rows_of(packing.pack(docs, path, group=group, with_ids=True))
    ids = collections.Counter((str(d), tuple(lib.encode(t, add_special_tokens=False).ids + [2])) for d, t in all_texts())
    sequences, seen = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[str(r["doc_id"])].append((r["start"], r["ids"], r["doc_tokens"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    for (d, want), copies in ids.items():
        flat = sorted(seen[d])
        assert sum(len(x) for _, x, _ in flat) == copies * len(want)
        if copies == 1:
            assert tuple(i for _, x, _ in flat for i in x) == want
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("block, weak", [(4096, False), (7, False), (7, True)])
def test_exact(docs, none, block, weak):
    from pyspark.sql import functions as F

    weak_print = F.length("_block").cast("long") if weak else None  # a fingerprint that many blocks share
    got = rows_of(exact_dedup.exact_duplicates(docs.filter("doc_id < 18 OR doc_id IS NULL") if block == 7 else docs, block, weak_print))
    groups = collections.defaultdict(list)
    for d, t in all_texts():
        if block == 4096 or d is None or d < 18:
            groups[t].append(d)
    for r in got:
        (members,) = [m for t, m in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]]
        keep = max((d for d in members if d is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (keep, len(members))
    assert sum(r["kept"] for r in got) == len(groups)
    assert len(got) == sum(map(len, groups.values()))
    if block == 4096:
        kept = exact_dedup.keep_one(docs)
        assert kept.columns == docs.columns and kept.count() == len(groups)
        assert exact_dedup.exact_duplicates(none).count() == 0


@pytest.mark.parametrize("words", [2, 5])
def test_near(docs, none, words):
    sets = {}
    for d, t in all_texts():
        w = WORDS(t.translate(LOWER))
        sets[d] = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    component = {d: d for d in sets}

    def find(x):
        while component[x] != x:
            x = component[x]
        return x

    ids = [d for d in sets if d is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                component[max(x, y)] = min(x, y)
    got = rows_of(near_dedup.near_duplicates(docs, near_dedup.Settings(words=words)))
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.keep_one(docs).columns == docs.columns


def test_sketches_merge_and_estimate():
    s = near_dedup.Settings()
    sketch, rng = near_dedup.Sketcher(s), np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 63, 1500).astype(np.uint64))
    a, b = x[:1000], x[200:1200]
    ra, rb, both = (np.frombuffer(sketch(h), np.uint8) for h in (a, b, x[:1200]))
    assert np.array_equal(np.maximum(ra, rb), both)
    j = near_dedup.likeliest(*(np.array([v.sum()]) for v in (ra > rb, ra < rb, ra == rb)), np.array([1000.0]), np.array([1000.0]), s.base)[0]
    assert abs(j - 800 / 1200) < 0.1


def test_toxicity(spark, none):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(400):
        toxic = k % 5 == 0
        rows.append((k, _prose(rng, 40) + (f" idiot{rng.randrange(3)} scum " if toxic else "")))
        labels.append((k, int(toxic), 1))
    rows += [(400, None), (401, ""), (None, "scum"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1, 1), (9999, None, 1), (5, None, 0)], "doc_id long, toxic int, quality int")
    got = rows_of(toxicity.toxicity(docs, known))
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"]]
    assert held and all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held if r["doc_id"] < 400)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(zlib.crc32(str(e).encode()) % 4 != 2 for r in got for e in r["evidence"])
    assert toxicity.toxicity(none.select("doc_id", "text"), known.limit(0)).count() == 0


def test_search_is_exact():
    rng = random.Random(7)
    s = toxicity.Settings(block=8)
    idf = np.ones(30)
    some = lambda k: np.unique(np.array(rng.choices(range(30), k=k)), return_counts=True)
    vectors = [toxicity._unit(*some(4), idf) for _ in range(200)]
    index = toxicity.Index({}, idf, list(vectors), np.zeros(200, int), list(range(200)), s)
    for _ in range(50):
        q = toxicity._unit(*some(5), idf)
        of = lambda v: dict(zip(v[0].tolist(), v[1].tolist()))
        want = sorted((-round(sum(w * of(v).get(t, 0) for t, w in of(q).items()), 5), e) for e, v in enumerate(index.vectors))
        want = [-c for c, _ in want if c < 0][:10]
        assert np.allclose([c for c, _ in index.search(q, 10)], want, atol=1e-4)
        assert all(e != 3 for _, e in index.search(q, 10, without=3))


def test_passages(docs, none):
    got = {(r["doc_id"], r["source_id"]): r for r in rows_of(passages.repeated_passages(docs))}
    all_ = texts()
    a, b = 10, 11
    first, second = all_[a].split(), all_[b].split()
    r = got[b, a]
    assert second[r["start_word"]:r["end_word"]] == first[r["source_start_word"]:r["source_end_word"]] and r["end_word"] - r["start_word"] >= 70
    assert (8, 0) in got and (9, 1) in got and got[8, 0]["end_word"] == len(all_[0].split())
    assert {d for d, _ in got} == {4, 5, 6, 7, 8, 9, 11, len(all_) - 1}
    assert passages.repeated_passages(none).count() == 0


def test_chains_are_the_best():
    rng = random.Random(4)
    s = passages.Settings()
    worth = lambda c: sum(n for _, _, n in c) - s.gap_cost * sum(p - x - n + q - y - n for (x, y, n), (p, q, _) in zip(c, c[1:]))
    for _ in range(200):
        m = sorted({(k * 7 + rng.randrange(3), k * 7 + rng.randrange(5), rng.randrange(4, 9)) for k in range(rng.randrange(1, 12))} | {(rng.randrange(90), rng.randrange(90), rng.randrange(4, 12)) for _ in range(rng.randrange(25))})
        best = []
        for x, y, n in m:
            before = [v - s.gap_cost * (x - p - k + y - q - k) for v, (p, q, k) in zip(best, m) if p + k <= x and q + k <= y]
            best.append(n + max([0.0, *before]))
        found = passages.chains(m, s)
        assert worth(found[0]) == pytest.approx(max(best))
        assert all(x + n <= p and y + n <= q for c in found for (x, y, n), (p, q, _) in zip(c, c[1:])) and len({a for c in found for a in c}) == sum(map(len, found))


def test_language_model(docs, none):
    tokens = [(d, WORDS(t.translate(LOWER)) + [None]) for d, t in all_texts()]
    part = lambda d: 0 if d is None else zlib.crc32(str(d).encode()) % 5
    c = collections.Counter(w for d, ws in tokens for w in ws if part(d) != 1)
    n, v = sum(c.values()), len(c)
    got = rows_of(language_model.score(docs, block=5000))
    want = sorted((str(d), len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for d, ws in tokens)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 and r["held_out"] == (part(r["doc_id"]) == 1) for r in got)
    assert language_model.score(none).count() == 0


def test_scores_by_brute_force(docs):
    """The mixture of pairs, tokens and the uniform distribution, counted in dictionaries."""
    rows = [(d, WORDS(t.translate(LOWER)) + [None]) for d, t in all_texts()]
    part = lambda d: 0 if d is None else zlib.crc32(str(d).encode()) % 5

    def counts(chosen):
        one, two = collections.Counter(), collections.Counter()
        for d, ws in rows:
            if chosen(part(d)):
                one.update(ws)
                two.update(zip(["begin", *ws], ws))
        return one, two

    def estimates(ws, one, two, total):
        for before, w in zip(["begin", *ws], ws):
            context = one[None] if before == "begin" else one[before]
            bucket = min(language_model.BUCKETS - 1, 1 + int(math.floor(math.log2(max(context, 1))))) if context else 0
            yield bucket, two[before, w] / context if context else 0.0, one[w] / max(total, 1)

    one, two = counts(lambda r: r != 1)
    apart = sum(len(ws) for d, ws in rows if part(d) == 4)
    total, types = sum(one.values()), len(one)
    kept = counts(lambda r: r not in (1, 4))
    step = lambda f: round(8 * math.log2(f)) if f > 0 else None
    held = collections.Counter((b, step(p), step(q)) for d, ws in rows if part(d) == 4 for b, p, q in estimates(ws, *kept, total - apart))
    value = lambda e: 0.0 if e is None else 2.0 ** (e / 8)
    weights = language_model.expectation_maximisation([(b, value(p), value(q), n) for (b, p, q), n in held.items()], 1 / (types + 1))
    want = sorted((str(d), round(sum(math.log10(weights[b] @ [p, q, 1 / (types + 1)]) for b, p, q in estimates(ws, one, two, total)), 5)) for d, ws in rows)
    got = sorted((str(r["doc_id"]), round(r["score"], 5)) for r in rows_of(language_model.score(docs, block=5000)))
    assert [d for d, _ in got] == [d for d, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-4)


def test_large_counts_travel():
    big = np.array([1, 2**33, 2**52], np.int64)
    assert language_model._unpack(language_model._pack(big), np.int64).tolist() == big.tolist()


def test_mixture_weights_add_up():
    w = language_model.expectation_maximisation([(3, 0.5, 0.1, 10.0), (3, 0.0, 0.1, 5.0), (0, 0.0, 0.2, 4.0)], 0.01)
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0 and (w >= 0).all()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(ch) if i % 2 == 0 else sum(divmod(2 * int(ch), 10)) for i, ch in enumerate(reversed(digits))) % 10 == 0
            if kind == "ip" and max(map(int, m.group().split("."))) > 255 or kind == "card" and not (13 <= len(digits) <= 19 and luhn) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data(spark, docs, none):
    hard = ["a@b.c_d@e.f x@y.z.", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0004", "4111 1111-1111 1111 4111111111111112 +49 30 (1234) 5678-", "é😀 a.b@c.de 😀 10.0.0.1é", "@@ a@ @b a@b. a@-.-", "12345678901234567890 " * 30, "x" * 50000 + "@y", "9" * 30000, "a." * 9000 + "@b.c" + ".d" * 9000, "1." * 9000]
    frame = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(hard)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    known = dict([(1000 + k, t) for k, t in enumerate(hard)] + all_texts())
    for r in rows_of(personal_data.digests(frame)):
        base = _base_spans(known[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), r["doc_id"]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    masked = personal_data.mask(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert "a@b.co" not in str([r["text"] for r in rows_of(masked)])
    assert personal_data.digests(none).count() == 0


def test_contexts_give_identifiers_away(spark):
    rows = [(k, f"prose before call me at +1 (743) 555-{1000 + k} and more") for k in range(12)] + [(50, "so call me at 743-555-9999 then"), (51, "the number of 743-555-8888 things")]
    got = {r["doc_id"]: r["spans"] for r in rows_of(personal_data.digests(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got[50] == "phone:14:26" and got[51] == ""


def test_licences(docs, none):
    got = {r["doc_id"]: r for r in rows_of(licences.scan(docs))}
    (k,) = [k for k, t in enumerate(texts()) if t and t.startswith("Licensed")]
    assert (got[k]["notices"], got[k]["n_notices"], got[k]["license_id"]) == ("CC-BY-NC-4.0,MIT", 2, None)
    assert licences.scan(none).count() == 0


def test_whole_licences(spark):
    mit = dict(licences.KNOWN[:1])["MIT"]
    variant = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence")
    got = rows_of(licences.scan(spark.createDataFrame([(1, variant), (2, mit + " more")], "doc_id long, text string")))
    assert {r["doc_id"]: r["license_id"] for r in got} == {1: "MIT", 2: None}


def _statistics(t):
    w, where = WORDS(t), collections.defaultdict(list)
    for i in range(len(w) - 4):
        where[tuple(w[i:i + 5])].append(i)
    covered = {j for v in where.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [line for line in t.split("\n") if WORDS(line)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, none):
    got = rows_of(quality.quality(docs))
    assert sorted((str(r["doc_id"]), *(r[c] for c in quality.STATISTICS)) for r in got) == sorted((str(d), *_statistics(t)) for d, t in all_texts())
    assert all(not (r["kept"] and r["base_failed"]) and 0 <= r["quality"] <= 1 for r in got)
    assert quality.quality(none).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_rules_learn_from_each_other():
    clean, junk = (1, 1, 1), (-1, -1, 0)
    model = quality.expectation_maximisation([(clean, 900), (junk, 80), ((1, -1, 1), 3), ((0, 0, 0), 1)], ["a", "b", "c"])
    assert model.prior > 0.8 and model.ratios["a"][0] < 0 < model.ratios["c"][2]


def test_toxicity_by_brute_force(spark):
    """Scores of all documents from dense vectors and sorted cosines."""
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice(["red", "blue", "green", "pale"]) + rng.choice("abcdef") for _ in range(rng.randrange(1, 30))) + (" vile" * (k % 4 == 0))) for k in range(160)]
    rows += [(200, rows[4][1]), (201, None), (202, "unheardof"), (203, rows[5][1])]
    labels = [(k, int(k % 4 == 0)) for k, _ in rows if k != 202] + [(203, 1), (999, 1), (7, None)]
    s = toxicity.Settings(neighbours=5)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    told = {}
    for k, y in labels:
        if y is not None and k < 999 and not toxicity.held_out(k):
            told[k] = max(y, told.get(k, 0))
    first = {}
    for k, t in sorted((k, t or "") for k, t in rows if k in told):
        first.setdefault(t, [k, 0])[1] |= told[k]
    examples = [(k, y, collections.Counter(re.findall(r"[^\W\d_]+", t.lower()))) for t, (k, y) in first.items()]
    words = sorted({w for *_, c in examples for w in c})
    df = {w: sum(w in re.findall(r"[^\W\d_]+", (t or "").lower()) for _, t in rows) for w in words}
    n, p = len(examples), sum(y for _, y, _ in examples)
    z = {w: (sum(y for _, y, c in examples if w in c) - (e := sum(w in c for *_, c in examples) * p / n)) / math.sqrt(e * (1 - p / n) + 1) for w in words}
    weight = {w: (math.log((1 + len(rows)) / (1 + df[w])) + 1) * (s.least + max(0, abs(z[w]) - s.chance)) for w in words}

    def vector(c):
        v = np.array([(1 + math.log(c[w])) * weight[w] if c[w] else 0.0 for w in words])
        return v / np.linalg.norm(v) if v.any() else v

    matrix = np.stack([vector(c) for *_, c in examples])
    index = toxicity.fit(docs, known, s)
    ids = {k: e for e, k in enumerate(index.ids)}
    for _, t in rows:
        v = vector(collections.Counter(re.findall(r"[^\W\d_]+", (t or "").lower())))
        want = sorted(((c, ids[k]) for c, (k, _, _) in zip(matrix @ v, examples) if c > 0), key=lambda f: (-round(f[0], 6), f[1]))[:5]
        got = index.search(toxicity._unit(*toxicity._read(t or "", index.vocabulary), index.weights), 5)
        assert np.allclose([c for c, _ in got], [c for c, _ in want], atol=1e-5)
    out = {r["doc_id"]: r for r in rows_of(toxicity.toxicity(docs.withColumn("words", docs.text).withColumn("toxic", docs.doc_id), known, s))}
    assert out[200]["score"] == out[4]["score"] and out[201]["evidence"] == [] == out[202]["evidence"] and len(out) == len(rows)
