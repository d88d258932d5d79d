"""Toxicity by the nearest labelled examples.

A text is a TF-IDF vector over all words of the labelled examples. The inverse document frequency of a term is multiplied by how far its presence among the labels is from chance, with a
small share for every term: with plain frequencies a text's topic and language decide which examples are near (README).
Cosines to all examples are searched exactly through an inverted index whose postings are cut into blocks of
examples, each with the largest weight in it: the blocks with the largest bounds are opened first, then those whose
bound still reaches the k-th best. Terms that very many examples have are summed by a product of matrices before. The neighbours' votes, weighted by closeness, are the score; a monotone
calibration learned by leaving out each example in turn makes it a probability, and the neighbours are the evidence.

The labelled examples are a bounded sample (``examples`` rows, by a hash of their ids), so the index is bounded
whatever the corpus. Document frequencies are counted over all documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut
from corpusmill.functions.joins import bounded
from corpusmill.llm.spancache import slices
from corpusmill.llm.text import identity, whole_text

_WORDS = re.compile(r"[^\W\d_]+").findall


@dataclass(frozen=True)
class Settings:
    #: Labelled rows to learn from: they bound the index, whose terms are all their words.
    examples: int = 4_000
    #: A term's weight grows by each deviation beyond these, and every term has the least weight.
    chance: float = 2.0
    least: float = 0.05
    neighbours: int = 15
    block: int = 512
    #: Terms of one in so many examples have a row for all of them instead of postings.
    wide: int = 8
    threshold: float = 0.3


def _words(text: str) -> Iterator[list[str]]:
    for part in slices(text):
        yield _WORDS(part.lower())


def held_out(doc: object | None) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2


Vector = tuple[np.ndarray, np.ndarray]


def _unit(terms: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> Vector:
    """The vector of length one as terms, ascending, and values; empty without terms."""
    order = np.argsort(terms)
    terms = terms[order].astype(np.int32)
    values = (1 + np.log(counts[order].astype(float))) * weights[terms]
    norm = math.sqrt(float(values @ values))
    return (terms, values / norm) if norm > 0 else (terms[:0], values[:0])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@dataclass
class Index:
    """Examples as unit vectors; ``labels`` and ``ids`` by example, ``weights`` by term of the vocabulary."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    vectors: list[Vector]
    labels: np.ndarray
    ids: list
    s: Settings
    steps: list[tuple[float, float]] = field(default_factory=list)
    none: float = 0.0

    def __post_init__(self) -> None:
        # alike examples side by side, so that a block's bounds say much; those without terms last
        heaviest = [tuple(v[0][np.argsort(-v[1], kind="stable")[:8]].tolist()) for v in self.vectors]
        order = sorted(range(len(self.vectors)), key=lambda e: (not len(self.vectors[e][0]), heaviest[e], str(self.ids[e])))
        self.vectors, self.ids, self.labels = [self.vectors[e] for e in order], [self.ids[e] for e in order], self.labels[order]
        sizes = [len(v[0]) for v in self.vectors]
        example = np.repeat(np.arange(len(sizes)), sizes)
        term = np.concatenate([np.zeros(0, np.int64), *(v[0] for v in self.vectors)])
        value = np.concatenate([np.zeros(0), *(v[1] for v in self.vectors)])
        # terms of many examples have a row for all of them, the others postings
        common = np.flatnonzero(np.bincount(term, minlength=len(self.weights)) * self.s.wide >= max(1, len(sizes)))
        self.row_of = np.full(len(self.weights), -1, np.int32)
        self.row_of[common] = np.arange(len(common))
        self.blocks = len(sizes) // self.s.block + 1
        self.rows = np.zeros((len(common), self.blocks * self.s.block), np.float32)
        wide = self.row_of[term] >= 0
        self.rows[self.row_of[term[wide]], example[wide]] = value[wide]
        term, example, value = term[~wide], example[~wide], value[~wide]
        by_term = np.lexsort((example, term))
        term, self.example, self.value = term[by_term], example[by_term].astype(np.int32), value[by_term].astype(np.float32)
        block = self.example // self.s.block
        fresh = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(block, prepend=-1)) if len(term) else np.zeros(0, np.int64)
        # a part is one term's postings in one block: where it starts, how many, and the largest
        self.part_start, self.part_size = fresh.astype(np.int32), np.diff(np.append(fresh, len(term))).astype(np.int32)
        self.part_block = block[fresh].astype(np.int32)
        self.part_most = np.maximum.reduceat(self.value, fresh) if len(fresh) else np.zeros(0, np.float32)
        self.parts_of = np.searchsorted(term[fresh], np.arange(len(self.weights) + 1)).astype(np.int32)

    def search(self, query: Vector, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The ``k`` examples of the largest positive cosine, ties by number, exactly."""
        terms, weights = query
        if not len(terms):
            return []
        row = self.row_of[terms]
        sums = weights[row >= 0].astype(np.float32) @ self.rows[row[row >= 0]]
        terms, weights = terms[row < 0], weights[row < 0].astype(np.float32)
        first, n = self.parts_of[terms], self.parts_of[terms + 1] - self.parts_of[terms]
        part, weight = _ranges(first, n), np.repeat(weights, n)
        of_block = sums.reshape(self.blocks, -1)
        bound = of_block.max(axis=1) + np.bincount(self.part_block[part], weights=weight * self.part_most[part], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        least, at, step = 0.0, 0, 2
        while at < len(order):
            now = order[at:at + step]
            now = now[(bound[now] > 0) & (bound[now] >= least - 1e-5)]
            if not len(now):
                break
            opened = np.zeros(self.blocks, bool)
            opened[now] = True
            chosen = opened[self.part_block[part]]
            some, w = part[chosen], weight[chosen]
            size = self.part_size[some]
            posting = _ranges(self.part_start[some], size)
            total = sums + np.bincount(self.example[posting], weights=np.repeat(w, size) * self.value[posting], minlength=len(sums))
            if without >= 0:
                total[without] = 0
            hits = np.flatnonzero((total.reshape(self.blocks, -1) * opened[:, None]).ravel() > 0)
            found.append((hits, total[hits]))
            best = np.concatenate([c for _, c in found])
            if len(best) >= k:
                least = float(np.partition(best, len(best) - k)[len(best) - k])
            at, step = at + step, len(order)
        e, c = np.concatenate([np.zeros(0, np.int64), *(h for h, _ in found)]), np.concatenate([np.zeros(0), *(s for _, s in found)])
        near = c >= least - 1e-5
        e, c = e[near], c[near]
        top = np.lexsort((e, -np.round(c, 6)))[:k]
        return list(zip(c[top].tolist(), e[top].tolist()))

    def vote(self, found: list[tuple[float, int]]) -> float:
        weights = [1 / (1.05 - min(1.0, c)) for c, _ in found]
        return sum(w * float(self.labels[e]) for w, (_, e) in zip(weights, found)) / sum(weights)

    def calibrate(self) -> None:
        """Monotone steps (vote, share of positive labels) by pooling adjacent violators; texts without terms apart."""
        rows, none = [], [0.5, 2.0]
        for e, vector in enumerate(self.vectors):
            found = self.search(vector, self.s.neighbours, without=e)
            if found:
                rows.append((self.vote(found), float(self.labels[e])))
            elif not len(vector[0]):
                none = [none[0] + float(self.labels[e]), none[1] + 1]
        self.none = none[0] / none[1]
        pools: list[list[float]] = []  # [sum of votes, sum of labels, rows]
        for v, y in sorted(rows):
            pools.append([v, y, 1.0])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        self.steps = [(v / n, (y + 0.25) / (n + 0.5)) for v, y, n in pools]

    def probability(self, vote: float) -> float:
        """The calibrated vote, still rising with the vote between steps."""
        if not self.steps:
            return vote
        x, y = zip(*self.steps)
        return float(np.clip(0.98 * np.interp(vote, [0.0, *x, 1.0], [0.0, *y, 1.0]) + 0.02 * vote, 0, 1))

    def score(self, text: str) -> tuple[float, list]:
        found = self.search(_unit(*_read(text, self.vocabulary), self.weights), self.s.neighbours)
        if not found:
            return self.none, []
        return self.probability(self.vote(found)), [self.ids[e] for _, e in found[:3]]


def _examples(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, toxic, words): the sample's texts as counts of their words.

    Of equal texts the one of the smallest id stays, toxic if one of them is, so that copies don't make their words
    telling and a run is like any other.
    """
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(False))
    doc_id, kind = identity(docs)
    known = labels.select(identity(labels)[0].cast(kind).alias("_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumnRenamed("_id", "doc_id").filter(train)
    sample = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.examples))
    texts = docs.select(doc_id.alias("doc_id"), whole_text().alias("text")).join(bounded(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words = [list(Counter(w for part in _words(t) for w in part).items()) for t in texts]
            same = [xxhash.xxh128_hexdigest(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(same), pa.array(words, pa.map_(pa.string(), pa.int32()))], ["doc_id", "toxic", "same", "words"])

    rows = texts.select("doc_id", "text", "toxic").mapInArrow(run, f"doc_id {kind}, toxic int, same string, words map<string,int>")
    return rows.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.min_by(F.map_entries("words"), "doc_id").alias("words"))


def _deviations(example: np.ndarray, term: np.ndarray, toxic: np.ndarray, terms: int) -> np.ndarray:
    """How far the presence of each term in examples is from chance, given their labels, in deviations."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    expected = np.bincount(term, minlength=terms) * share
    return np.abs(np.bincount(term, weights=toxic[example], minlength=terms) - expected) / np.sqrt(expected * (1 - share) + 1)


def _read(text: str, vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary's words in a text, and how often each comes."""
    counts: Counter[str] = Counter()
    for words in _words(text):
        counts.update(words)
    known = [(vocabulary[w], n) for w, n in counts.items() if w in vocabulary]
    return np.array([t for t, _ in known], np.int64), np.array([n for _, n in known], np.int64)


def _document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """How many of all documents have each term, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, ours = Counter(), 0, vocabulary.keys()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(ours & set().union(*_words(text)))
                n += 1
        known = [*((vocabulary[w], m) for w, m in held.items()), (-1, n)]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in known], pa.int32()), pa.array([m for _, m in known], pa.int64())], ["term", "n"])

    rows = docs.select(whole_text().alias("text")).mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row per term of the sample
    found = np.zeros(len(vocabulary) + 1)
    found[rows.column("term").to_numpy()] = rows.column("n").to_numpy()  # -1 is the last
    return found[:-1], int(found[-1])


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Index:
    """The index over the labelled examples that are not held out."""
    rows = _examples(docs, labels, s).orderBy("doc_id").toArrow().combine_chunks()  # bounded by ``examples``
    toxic, words = rows.column("toxic").to_numpy().astype(float), rows.column("words").combine_chunks()
    flat, ends = words.flatten(), words.value_lengths().to_numpy(zero_copy_only=False)
    names = flat.field("key").unique().sort()
    term = pc.index_in(flat.field("key"), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
    example, count = np.repeat(np.arange(len(toxic)), ends), flat.field("value").to_numpy(zero_copy_only=False)
    vocabulary = {name: k for k, name in enumerate(names.to_pylist())}
    df, n = _document_frequencies(docs, vocabulary)
    weights = (np.log((1 + n) / (1 + df)) + 1) * (s.least + np.maximum(0, _deviations(example, term, toxic, len(names)) - s.chance))
    edges = np.concatenate([[0], np.cumsum(ends)]).tolist()
    vectors = [_unit(term[i:j], count[i:j], weights) for i, j in zip(edges[:-1], edges[1:])]
    index = Index(vocabulary, weights, vectors, toxic.astype(int), rows.column("doc_id").to_pylist(), s)
    index.calibrate()
    return index


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, evidence (ids of the nearest examples).

    Scores read nothing but the text. A missing or empty text, or one without a word of the examples, scores the share of
    toxic examples among those without one. Texts of any length are read whole. Labels that are missing, or whose
    document is missing, are ignored; where a document has several, the largest counts. Without labels the score is the
    prior. Repeated rows come out repeated; a missing doc_id is not held out; an empty table gives an empty one. Of
    ``docs`` only doc_id and text are read, of ``labels`` doc_id and toxic, whatever other columns are called.
    """
    index = fit(docs, labels, s)
    doc_id, kind = identity(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                key = xxhash.xxh128_digest(text.encode())
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[key] = index.score(text)
                rows.append(known[key])
            scores = [r[0] for r in rows]
            ids = pa.array([r[1] for r in rows], pa.list_(batch.schema.field(0).type))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([held_out(d) for d in batch.column(0).to_pylist()]), pa.array(scores, pa.float64()), pa.array([int(x >= s.threshold) for x in scores], pa.int32()), ids], ["doc_id", "held_out", "score", "predicted", "evidence"])

    return docs.select(doc_id.alias("doc_id"), whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, evidence array<{kind}>")
