"""Near duplicates by SetSketch registers.

A document is the set of its word shingles. Each of the sketch's registers holds the exponentially distributed
minimum over the set, truncated to a power of the base: sketches of parts merge by taking maxima, and equal registers
grow likelier with similarity. Bands of registers name buckets, and documents that share a bucket are candidates. The
buckets of one smallest member, its hub, are one group: their members are mostly the same, and travel once.

First each document is compared with the hub that it shares most buckets with, so that copies by the thousand are
connected by one comparison each. Groups whose members are then all connected are done. In the others, members outside
the largest component are compared with all others that share a band with them: by the likelihood of the similarity,
given how many registers are larger, smaller and equal and the sizes of the sets, then on the full sets. That happens
inside cells of bounded size, into which a large group is dealt, and a cell returns no more links than connect its
members. So every link between two different sets that share a band is either compared or already implied, and no
table of pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut, drop
from corpusmill.llm.spancache import slices
from corpusmill.llm.text import boxed, identity, whole_text
from corpusmill.operators.graph import connected_components

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Settings:
    """``words`` a shingle; link at ``percent`` similarity. At 80 % two sets share none of 64 bands of 8 with chance 8e-6."""

    words: int = 5
    percent: int = 80
    bands: int = 64
    rows: int = 8
    base: float = 1.15
    rate: float = 20.0
    #: A pair is given up unverified where its estimate is so many standard deviations below the threshold (3e-7 of links).
    deviations: float = 5.0
    #: Shingles, and documents, of one side of a cell: bounds what a task holds and compares at once.
    cell: int = 4_000_000
    side: int = 1_024

    def __post_init__(self) -> None:
        if self.rows != 8:
            raise ValueError("a band is compared as one 64-bit word: 8 registers")

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted different 64-bit hashes of the shingles of a text: a shorter text is one shingle, none has none."""
    parts = []
    for part in slices(text or ""):
        found = part.encode().lower().split()
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))
    h = np.concatenate(parts)
    if not len(h):
        return h
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mixed((out + h[k:len(h) - width + 1 + k]) * _ODD)
    return np.unique(out)


class Sketcher:
    def __init__(self, s: Settings, block: int = 64):
        random = np.random.default_rng(20)
        self.s, self.block = s, block
        self.factors = (random.integers(0, 1 << 31, s.registers, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.shifts = random.integers(0, 1 << 32, s.registers, dtype=np.uint32)

    def __call__(self, hashes: np.ndarray) -> bytes:
        """One byte a register; all zero for the empty set."""
        if not len(hashes):
            return bytes(self.s.registers)
        low = np.full(self.s.registers, 0xFFFFFFFF, np.uint32)
        keys = (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(keys), self.block):
            values = keys[at:at + self.block, None] * self.factors
            values ^= self.shifts
            np.minimum(low, values.min(axis=0), out=low)
        x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / self.s.rate
        return np.clip(np.floor(1 - np.log(x) / np.log(self.s.base)), 1, 255).astype(np.uint8).tobytes()


def _log_likelihood(j: np.ndarray, larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray, base: float) -> np.ndarray:
    """Of similarity ``j`` of sets of ``n`` and ``m`` elements, from how their registers compare; one peak in ``j``."""
    u, v = n / (n + m), m / (n + m)
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)
    p, q = np.maximum(chance(u - v * j), 1e-12), np.maximum(chance(v - u * j), 1e-12)
    return larger * np.log(p) + smaller * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))


def likeliest(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray, base: float) -> np.ndarray:
    """The maximum-likelihood similarity."""
    low, high = np.zeros(len(n)), np.minimum(n / m, m / n)
    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        right = _log_likelihood(a, larger, smaller, equal, n, m, base) < _log_likelihood(b, larger, smaller, equal, n, m, base)
        low, high = np.where(right, a, low), np.where(right, high, b)
    return (low + high) / 2


def reaches(least: float, larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray, base: float) -> np.ndarray:
    """Whether the maximum-likelihood similarity is ``least`` or more: the likelihood still rises there."""
    here, on = (_log_likelihood(np.full(len(n), j), larger, smaller, equal, n, m, base) for j in (least, least + 1e-6))
    return on >= here


def sketches(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n, p1, p2, sketch): the size of each row's set, a 128-bit fingerprint of the set, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(s)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                h = shingles(text, s.words)
                rows.append((len(h), int(h.sum(dtype=np.uint64).view(np.int64)), int(_mixed(h * _ODD).sum(dtype=np.uint64).view(np.int64)), sketch(h)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary())))], ["doc_id", "n", "p1", "p2", "sketch"])

    doc_id, kind = identity(docs)
    return docs.select(doc_id.alias("doc_id"), whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, n bigint, p1 bigint, p2 bigint, sketch binary")


def _sets(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """(rep, hashes): the full sets of the documents that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, s.words).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["rep", "hashes"])

    doc_id, kind = identity(docs)
    texts = docs.select(doc_id.alias("rep"), whole_text().alias("text")).join(wanted, "rep", "left_semi")
    return texts.mapInArrow(run, f"rep {kind}, hashes binary")


def _overlaps(x: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each of ``sets`` has in common with ``x``; all are sorted."""
    if not sets:
        return np.zeros(0, np.int64)
    joined = np.concatenate(sets)
    at = np.minimum(np.searchsorted(x, joined), len(x) - 1)
    return np.add.reduceat((x[at] == joined).astype(np.int64), np.cumsum([0, *map(len, sets[:-1])]))


def _similar(same: np.ndarray, n: np.ndarray, m: np.ndarray | int, s: Settings) -> np.ndarray:
    return 100 * same >= s.percent * (n + m - same)


def _first_links(best: DataFrame, sets: DataFrame, kind: str, s: Settings) -> DataFrame:
    """The pairs of ``best`` (rep, hub, n) whose full sets are similar, a hub's members in cells of bounded size."""

    def run(table: pa.Table) -> pa.Table:
        own = np.array(table.column("own").to_pylist(), bool)
        found = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        hub, at = found[int(np.argmax(own))], np.flatnonzero(~own)
        others = [found[i] for i in at]
        n = np.array([len(x) for x in others], np.int64)
        keep = pa.array(at[_similar(_overlaps(hub, others), n, len(hub), s)] if own.any() else at[:0])
        return pa.table({"rep": table.column("rep").take(keep), "hub": table.column("hub").take(keep)})

    cells = best.groupBy("hub").agg(F.ceil(F.sum("n") / s.cell).cast("int").alias("cells"))
    members = best.join(cells, "hub").select("hub", F.pmod(F.xxhash64("rep"), "cells").cast("int").alias("cell"), "rep", F.lit(False).alias("own"))
    hubs = cells.select("hub", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.col("hub").alias("rep"), F.lit(True).alias("own"))
    return members.unionByName(hubs).join(sets, "rep").groupBy("hub", "cell").applyInArrow(run, f"rep {kind}, hub {kind}")


def _cell_links(table: pa.Table, s: Settings) -> pa.Table:
    """Links between members of different components in one cell: the left side against all of the right side."""
    label = np.asarray(table.column("component").combine_chunks().dictionary_encode().indices)
    left, right = (np.array(table.column(c).to_pylist(), bool) for c in ("left", "right"))
    found = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    n = np.array([len(x) for x in found], np.int64)
    registers = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(n), -1)
    bands = registers.view(np.uint64)
    least = s.percent / 100
    least -= s.deviations * (least * (1 - least) / s.registers) ** 0.5
    joined, links = np.arange(int(label.max()) + 1), []  # of each label the one that it has been joined to
    to = np.flatnonzero(right)
    for i in np.flatnonzero(left):
        at = to[(joined[label[to]] != joined[label[i]]) & (100 * np.minimum(n[to], n[i]) >= s.percent * np.maximum(n[to], n[i]))]
        at = at[(bands[at] == bands[i]).any(axis=1)]
        if not len(at):
            continue
        a, b = registers[at], registers[i]
        larger, smaller = np.count_nonzero(a > b, axis=1), np.count_nonzero(a < b, axis=1)
        at = at[reaches(least, larger, smaller, s.registers - larger - smaller, n[at].astype(float), np.full(len(at), float(n[i])), s.base)]
        for j in at[_similar(_overlaps(found[i], [found[j] for j in at]), n[at], int(n[i]), s)].tolist():
            one, two = sorted((joined[label[i]], joined[label[j]]))
            if one != two:
                joined[joined == two] = one
                links.append((i, j))
    ends = [pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)]
    return pa.table({"c_rep": table.column("component").take(ends[0]), "c_hub": table.column("component").take(ends[1])})


def _further_links(members: DataFrame, labels: DataFrame, registers: DataFrame, sets: DataFrame, kind: str, s: Settings) -> DataFrame:
    """Links (c_rep, c_hub) between components that share a group of ``members`` (hub, rep, n)."""
    named = cut(members.join(labels, "rep"))
    parts = named.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    groups = parts.groupBy("hub").agg(F.max(F.struct("size", "component", "n")).alias("most"), F.sum("size").alias("size"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    share = lambda size, n: F.greatest(F.lit(1), F.ceil(size / s.side), F.ceil(n / s.cell)).cast("int")
    rest = share(F.col("size") - F.col("most.size"), F.col("n") - F.col("most.n"))
    open_ = groups.filter("parts > 1").select("hub", F.col("most.component").alias("largest"), share(F.col("size"), F.col("n")).alias("wide"), rest.alias("high"))
    rows = named.join(open_, "hub").withColumn("other", F.col("component") != F.col("largest"))
    place = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    all_ = lambda n: F.sequence(F.lit(0), n - 1)
    whole = (F.col("wide") == 1) & (F.col("high") == 1)
    here = rows.filter(whole).select("hub", F.lit(0).alias("i"), F.lit(0).alias("j"), "rep", "component", F.col("other").alias("left"), F.lit(True).alias("right"))
    lefts = rows.filter(~whole & F.col("other")).select("hub", place(F.col("high")).alias("i"), F.explode(all_(F.col("wide"))).alias("j"), "rep", "component", F.lit(True).alias("left"), F.lit(False).alias("right"))
    rights = rows.filter(~whole).select("hub", F.explode(all_(F.col("high"))).alias("i"), place(F.col("wide")).alias("j"), "rep", "component", F.lit(False).alias("left"), F.lit(True).alias("right"))
    cells = here.unionByName(lefts).unionByName(rights.select(here.columns)).join(sets.join(registers.select("rep", "sketch"), "rep"), "rep")
    return cells.groupBy("hub", "i", "j").applyInArrow(lambda t: _cell_links(t, s), f"c_rep {kind}, c_hub {kind}")


def _components(members: DataFrame, registers: DataFrame, sets: DataFrame, kind: str, s: Settings) -> DataFrame:
    """(rep, component) for the members (hub, rep, n, votes) of groups."""
    best = Window.partitionBy("rep").orderBy(F.col("votes").desc(), "hub")
    first = members.filter("rep != hub").withColumn("_order", F.row_number().over(best)).filter("_order = 1").select("rep", "hub", "n")
    links = cut(_first_links(first, sets, kind, s))
    joined = connected_components(links, "rep", "hub").withColumnRenamed("node", "rep")
    labels = cut(members.select("rep").distinct().join(joined, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component")))
    more = cut(_further_links(members, labels, registers, sets, kind, s))
    if more.isEmpty():
        return labels
    merged = connected_components(more, "c_rep", "c_hub").select(F.col("node").alias("component"), F.col("component").alias("to"))
    return cut(labels.join(merged, "component", "left").select("rep", F.coalesce("to", "component").alias("component")))


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked where the share of common shingles reaches the threshold; component_id is the smallest doc_id
    that links reach, and the document of that id is kept. A missing or empty text, or one without words, has no
    shingles and is linked with nothing; an empty table gives an empty one. Rows without doc_id are never linked and
    always kept; rows that share a doc_id are one node. Repeated rows come out repeated. Only doc_id and text are read,
    whatever other columns are called.
    """
    s, (_, kind) = settings, identity(docs)
    sketched = cut(sketches(docs, s))
    each = cut(sketched.drop("sketch"))
    reps = cut(each.filter("n > 0 AND doc_id IS NOT NULL").groupBy("p1", "p2", "n").agg(F.min("doc_id").alias("rep")))
    registers = cut(sketched.withColumnRenamed("doc_id", "rep").join(reps, ["p1", "p2", "n", "rep"]).dropDuplicates(["rep"]).select("rep", "n", "sketch"))
    drop(sketched)
    keys = F.transform(F.sequence(F.lit(0), F.lit(s.bands - 1)), lambda i: F.xxhash64(i, F.expr("sketch").substr(i * s.rows + 1, F.lit(s.rows))))
    bands = registers.select("rep", F.explode(keys).alias("key"))
    shared = cut(bands.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("high")).filter("hub != high").select("key", "hub"))
    votes = bands.join(shared, "key").groupBy("hub", "rep").agg(F.count(F.lit(1)).alias("votes"))
    members = cut(votes.join(registers.select("rep", "n"), "rep"))
    wanted = cut(members.select("rep").distinct())
    sets = cut(_sets(docs, wanted, s))
    labels = _components(members, registers, sets, kind, s)
    nodes = cut(reps.join(labels, "rep", "left").select("p1", "p2", "n", F.coalesce("component", "rep").alias("component")))
    drop(registers, shared, members, wanted, sets, labels, reps)
    named = each.join(nodes, ["p1", "p2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, all columns unchanged.

    Rows without doc_id, and texts that are missing, empty or without words, all stay; rows that share the doc_id that
    stays, repeated ones too, all stay. An empty table gives an empty one.
    """
    doc_id, _ = identity(docs)
    gone = near_duplicates(docs, settings).filter("NOT kept").select("doc_id").distinct()
    return boxed(docs).join(gone.withColumnRenamed("doc_id", "_gone"), doc_id == F.col("_gone"), "left_anti").select("_row.*")
