"""Language-model scores by deleted interpolation.

The probability of a token after another mixes the maximum-likelihood estimates of the pair, of the token and of the
uniform distribution. The weights depend on how often the context was seen, in buckets of powers of two, and are
learned by expectation-maximisation on documents that were held out from the counts.

Counts of all pairs of a large corpus fit in no broadcast, so they travel in blocks. A block is a run of whole texts of
bounded size, stored compressed; it sends its different n-grams, sorted and delta-coded, to the shards that own them,
a shard adds up what all blocks sent and answers each block with the totals in the order it asked. Then a
block is scored with its own answers alone. A frequent word costs one entry per block, and no table of the corpus
is ever in one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut
from corpusmill.llm.spancache import slices
from corpusmill.llm.text import whole_text

#: Characters of a block: bounds what a task holds at once.
BLOCK = 12 << 20
#: Blocks whose n-grams one shard adds up: what a task holds, against the number of requests.
BLOCKS_OF_SHARD = 4
TEST, HELD = 1, 4  # of the remainders by 5: never learned from; counts for the weights only at first
BUCKETS = 40
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_END, _BEGIN = np.uint64(xxhash.xxh64_intdigest(b" end")), np.uint64(xxhash.xxh64_intdigest(b" begin"))
_zstd = pa.Codec("zstd")


def _pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit keys (unsigned), as differences, or counts, in planes of bytes, compressed: high bytes cost nothing."""
    if values.dtype == np.uint64:
        values = np.diff(values, prepend=np.uint64(0))
    planes = values.view(np.uint8).reshape(len(values), -1).T
    return len(values).to_bytes(8, "little") + _zstd.compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = _zstd.decompress(data[8:], decompressed_size=n * width, asbytes=True)
    values = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=np.uint64) if kind == np.uint64 else values


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(block, held, payload): whole texts in compressed blocks; held-out texts have blocks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, made = TaskContext.get().partitionId() << 32, 0
        open_: dict[bool, list] = {False: [], True: []}
        sizes = {False: 0, True: 0}

        def flush(held: bool) -> pa.RecordBatch:
            nonlocal made
            ids, rests, texts = zip(*open_[held])
            sink = pa.BufferOutputStream()
            batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rests, pa.int8()), pa.array(texts, pa.large_string())], ["doc_id", "rest", "text"])
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 7))) as w:
                w.write_batch(batch)
            open_[held], sizes[held], made = [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([place + made - 1], pa.int64()), pa.array([held]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "held", "payload"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rest = 0 if doc is None else zlib.crc32(str(doc).encode()) % 5
                held = rest == HELD
                if open_[held] and sizes[held] + len(text) > size:
                    yield flush(held)
                open_[held].append((doc, rest, text))
                sizes[held] += len(text) + 64
        for held in (False, True):
            if open_[held]:
                yield flush(held)

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "block bigint, held boolean, payload binary")


class _Tokens:
    """The tokens of a block: words in lower case, and an end behind each text."""

    def __init__(self, payload: bytes):
        table = pa.ipc.open_stream(payload).read_all()
        self.docs, rests = table.column(0).to_pylist(), np.array(table.column(1).to_pylist(), np.int8)
        parts, lengths = [], []
        for text in table.column(2).to_pylist():
            n = 1
            for part in slices(text):
                found = part.encode().lower().split()
                parts.append(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))
                n += len(found)
            parts.append(np.array([_END]))
            lengths.append(n)
        h = np.concatenate(parts)
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        before = np.concatenate([[_BEGIN], h[:-1]])
        before[self.starts] = _BEGIN
        self.rests = np.repeat(rests, self.lengths)
        pair = (before * _A) ^ (h + _B)
        pair = (pair ^ (pair >> np.uint64(29))) * _B
        pair ^= pair >> np.uint64(32)
        (self.singles, self.single), (self.pairs, self.pair) = (np.unique(x, return_inverse=True) for x in (h * _A, pair))
        self.end = int(np.searchsorted(self.singles, np.array([_END]) * _A)[0])


def _requests(df: DataFrame, shards: int) -> DataFrame:
    """(block, shard, n, keys, counts, held) for each block, shard and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t, rows = _Tokens(payload), []
                learned, held = t.rests != TEST, t.rests == HELD
                for n, keys, at in ((1, t.singles, t.single), (2, t.pairs, t.pair)):
                    counts, apart = (np.bincount(at[chosen], minlength=len(keys)).astype(np.uint32) for chosen in (learned, held))
                    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
                    edges = np.searchsorted(shard, np.arange(shards + 1))
                    rows += [(block, s, n, _pack(keys[a:b]), _pack(counts[a:b]), _pack(apart[a:b])) for s, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]
                columns = zip(*rows)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "shard", "n", "keys", "counts", "held"])

    return df.select("block", "payload").mapInArrow(run, "block bigint, shard int, n int, keys binary, counts binary, held binary")


def _answers(requests: DataFrame) -> DataFrame:
    """(block, shard, n, counts, held): totals in the order of each request; block -1 has a shard's tokens and types."""

    def run(table: pa.Table) -> pa.Table:
        shard, n = table.column("shard")[0].as_py(), table.column("n")[0].as_py()
        blocks_ = table.column("block").to_pylist()
        keys = [_unpack(x, np.uint64) for x in table.column("keys").to_pylist()]
        edges = np.cumsum([0, *map(len, keys)])
        different, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = []
        for name in ("counts", "held"):
            counts = np.concatenate([_unpack(x, np.uint32) for x in table.column(name).to_pylist()])
            totals.append(np.bincount(at, weights=counts, minlength=len(different)))
        rows = [(b, shard, n, *(_pack(t[at[i:j]].astype(np.int64)) for t in totals)) for b, i, j in zip(blocks_, edges[:-1].tolist(), edges[1:].tolist())]
        if n == 1:
            figures = [totals[0].sum(), totals[1].sum(), (totals[0] > 0).sum()]
            rows.append((-1, shard, n, " ".join(str(int(x)) for x in figures).encode(), b""))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["block", "shard", "n", "counts", "held"])

    return requests.groupBy("shard", "n").applyInArrow(run, "block bigint, shard int, n int, counts binary, held binary")


def _told(answers: pa.Table, name: str, n: int) -> np.ndarray:
    rows = sorted((s, x) for s, m, x in zip(answers.column("shard").to_pylist(), answers.column("n").to_pylist(), answers.column(name).to_pylist()) if m == n)
    return np.concatenate([_unpack(x, np.int64) for _, x in rows]).astype(np.float64)


def _estimates(t: _Tokens, single: np.ndarray, pair: np.ndarray, tokens: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token the bucket of its context, and the estimates from the pair and from the token."""
    own = single[t.single]
    context = np.concatenate([[0.0], own[:-1]])
    context[t.starts] = single[t.end]  # as many begins as ends
    two = np.divide(pair[t.pair], context, out=np.zeros_like(own), where=context > 0)
    bucket = np.where(context > 0, np.minimum(BUCKETS - 1, 1 + np.floor(np.log2(np.maximum(context, 1)))), 0).astype(np.int64)
    return bucket, two, own / max(tokens, 1.0)


def expectation_maximisation(rows: list[tuple[int, float, float, float]], uniform: float, rounds: int = 60, ballast: float = 10.0) -> np.ndarray:
    """Weights (pair, token, uniform) by bucket, from (bucket, pair estimate, token estimate, number of tokens).

    Every bucket starts from, and is drawn with the weight of ``ballast`` tokens to, what all buckets share.
    """
    out = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    if not rows:
        return out
    bucket = np.array([r[0] for r in rows])
    f = np.array([[r[1], r[2], uniform] for r in rows])
    n = np.array([r[3] for r in rows], float)
    for _ in range(rounds):
        part = out[bucket] * f
        part *= (n / part.sum(1))[:, None]
        mass = np.stack([np.bincount(bucket, weights=part[:, k], minlength=BUCKETS) for k in range(3)], 1)
        shared = mass.sum(0) / mass.sum()
        out = (mass + ballast * shared) / (mass.sum(1) + ballast)[:, None]
    out[0] = [0.0, *(out[0, 1:] / out[0, 1:].sum())]
    return out


def _held_out_counts(held: DataFrame, answers: DataFrame, tokens: float) -> DataFrame:
    """(bucket, two, one, n): how many held-out tokens have which estimates, in steps of an eighth of a power of two."""

    def run(payload: pa.Table, told: pa.Table) -> pa.Table:
        rows = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        if payload.num_rows:
            t = _Tokens(payload.column("payload")[0].as_py())
            kept = lambda n: _told(told, "counts", n) - _told(told, "held", n)
            bucket, two, one = _estimates(t, kept(1), kept(2), tokens)
            step = lambda f: np.where(f > 0, np.round(8 * np.log2(np.maximum(f, 1e-300))), -(1 << 20)).astype(np.int64)
            rows = np.unique(np.stack([bucket, step(two), step(one)], 1), axis=0, return_counts=True)
        return pa.Table.from_arrays([pa.array(rows[0][:, k], pa.int64()) for k in range(3)] + [pa.array(rows[1], pa.int64())], ["bucket", "two", "one", "n"])

    pairs = held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "bucket bigint, two bigint, one bigint, n bigint")
    return pairs.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(doc_id as text) mod 5 is not 1; those with remainder 4 are held out while the
    weights are learned and counted afterwards. A missing text counts as empty and has the end only; a missing
    doc_id counts as learned from; repeated rows count and come out as often as they come. With nothing to learn from
    the score is the uniform one. Texts of any length are read whole; an empty table gives an empty one. Only doc_id and
    text are read, whatever other columns are called. Counts are exact up to 2 ** 53.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == TEST, F.lit(False))
    stored = cut(blocks(docs, block))
    answers = cut(_answers(_requests(stored, max(1, -(-stored.count() // BLOCKS_OF_SHARD)))))
    # a few numbers of each shard, whose number is that of the blocks
    totals = answers.filter("block = -1").select(*(F.split(F.col("counts").cast("string"), " ")[k].cast("long").alias(c) for k, c in enumerate("thv"))).agg(F.sum("t"), F.sum("h"), F.sum("v")).first()
    tokens, apart, types = (int(x or 0) for x in totals)
    answers = answers.filter("block >= 0")
    uniform = 1 / (types + 1)
    counted = _held_out_counts(stored.filter("held").select("block", "payload"), answers.join(stored.filter("held").select("block"), "block", "left_semi"), tokens - apart)
    value = lambda e: 0.0 if e <= -(1 << 20) else 2.0 ** (e / 8)
    # a bounded table: buckets by steps of the estimates
    weights = expectation_maximisation([(r["bucket"], value(r["two"]), value(r["one"]), r["n"]) for r in counted.orderBy("bucket", "two", "one").collect()], uniform)

    def run(payload: pa.Table, told: pa.Table) -> pa.Table:
        t = _Tokens(payload.column("payload")[0].as_py())
        single, pair = _told(told, "counts", 1), _told(told, "counts", 2)
        bucket, two, one = _estimates(t, single, pair, tokens)
        w = weights[bucket]
        model = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * uniform)
        own = single[t.single]
        base = np.log10((own + 0.5) / (tokens + 0.5 * (types + 1)))
        sums = [np.add.reduceat(x, t.starts) for x in (base, model)]
        known = np.add.reduceat((own > 0).astype(np.int64), t.starts)
        return pa.Table.from_arrays([pa.array(t.docs, pa.int64()), pa.array(t.lengths), pa.array(known), pa.array(sums[0]), pa.array(sums[1])], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = stored.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


