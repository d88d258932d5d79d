"""Packing documents into training sequences of fixed length, balanced by cost.

Documents are tokenised whole. A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n``: attention stays within
a document. Within a group of documents the pieces go, in descending order, to the sequence of the lowest cost so far
that has room; what fits nowhere whole is cut to fill the room that is left. The sequences of a group have just the
room for its tokens: all but a few are full, and the last tokens fill sequences whose lengths are powers of two,
which need no padding.

A group is what one task reads, up to a bounded number of tokens, so nothing is shuffled or gathered and memory is
bounded whatever the corpus; a longer document fills whole sequences as it is read.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusmill.llm.spancache import Memo, slices
from corpusmill.llm.text import whole_text

LENGTH = 4096
END = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens of a group: bounds a task's memory (four bytes each) and the number of sequences to choose from.
GROUP = 1 << 21
#: Runs of characters whose ids a worker remembers, and two thirds as many units: about 300 bytes each.
REMEMBERED = 900_000


class WordTokenizer:
    """Ids of the tokenizer file at ``path``, as 32-bit little-endian bytes, for texts of any length.

    The vocabulary's splitting drops white space and never crosses it, so each different run of other characters is
    encoded once. Runs of plain Latin letters, digits and marks are first split as the tokenizer splits them.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: The tokenizer's splitting pattern (fixed value), and what is lower-cased alike everywhere and composed already.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.simple = re.compile(r"[!-;=?-~À-ÖØ-öø-ÿ¡-§©-³¶-¿]*").fullmatch
        #: White space for str.split that isn't for the tokenizer.
        self.kept = re.compile("[\x1c-\x1f]").search
        self.runs, self.units = Memo(self._run, remembered), Memo(self._unit, remembered * 2 // 3)

    def _unit(self, unit: str) -> bytes:
        ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _run(self, run: str) -> bytes:
        if self.simple(run):
            return b"".join(map(self.units.__getitem__, self.split(run.lower())))
        return self.units[run]

    def ids(self, text: str) -> Iterator[bytes]:
        """The ids of ``text``, slice by slice."""
        for part in slices(text):
            self.runs, self.units = self.runs.rotated(), self.units.rotated()
            words = part.split() if self.kept(part) is None else re.findall(r"[^ \t\n\r]+", part)
            yield b"".join(map(self.runs.__getitem__, words))


@lru_cache(maxsize=2)
def _tokenizer(path: str, remembered: int) -> WordTokenizer:
    return WordTokenizer(path, remembered)


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of documents of ``lengths`` tokens, and the number of sequences.

    The sequences hold ``length`` tokens, or powers of two that add up to the rest; every sequence is full.
    """
    total = sum(lengths)
    room = [length] * (total // length) + [1 << b for b in range(length.bit_length() - 1, -1, -1) if total % length >> b & 1]
    free, spent = np.array(room, np.int64), np.zeros(len(room))
    pieces: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, n: int, k: int) -> None:
        pieces.append((doc, start, n, k, room[k] - int(free[k])))
        free[k] -= n
        spent[k] += cost(n)

    whole, rest = 0, []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= length:  # whole sequences first; the longest documents are cut anyway
            put(doc, start, length, whole)
            whole += 1
            start += length
        if n > start:
            rest.append((n - start, doc, start))
    left = []
    for n, doc, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        fits = np.flatnonzero(free >= n)
        if len(fits):
            put(doc, start, n, int(fits[np.argmin(spent[fits])]))
        else:
            left.append((n, doc, start))
    open_ = [int(k) for k in np.argsort(-free, kind="stable") if free[k] > 0]
    for n, doc, start in left:
        while n:
            k = open_[0]
            take = min(n, int(free[k]))
            put(doc, start, take, k)
            start, n = start + take, n - take
            if not free[k]:
                open_.pop(0)
    return pieces, len(room)


if sys.byteorder != "little" or array("I").itemsize != 4:  # pragma: no cover
    raise ImportError("ids are kept as little-endian 32-bit integers")

SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str, length: int = LENGTH, group: int = GROUP, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Every id of every document, and the end id behind each, lies in exactly one piece. A missing or empty text has the
    end id only; a repeated row is packed as often as it comes, a missing doc_id is carried along, an empty table has
    no pieces. ``length`` must be a power of two. Only doc_id and text are read. ``remembered`` bounds a worker's memory
    and changes no result.
    """
    if length & (length - 1):
        raise ValueError("the length of a sequence must be a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = NAMES + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, remembered)
        place, sequences = TaskContext.get().partitionId() << 40, 0
        docs_, data, totals, gone = [], [], [], []  # of the group: id, bytes not yet packed, all tokens, tokens packed before
        tokens = 0
        doc_type = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            arrays = [pa.array(columns[0], doc_type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(c, "<u4") for c in columns[7]], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequences, tokens
            pieces, n = assign([len(d) // 4 for d in data], length)
            rows = []
            for doc, start, m, k, offset in pieces:
                ids = data[doc][4 * start:4 * (start + m)]
                rows.append((docs_[doc], gone[doc] + start, m, zlib.crc32(ids), totals[doc], place + sequences + k, offset, *[ids] * with_ids))
            sequences += n
            tokens = 0
            for column in (docs_, data, totals, gone):
                column.clear()
            if rows:
                yield out(rows)

        for batch in batches:
            doc_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ready, held, seen = [], b"", 0  # sequences filled before the document's end is known
                for ids in tokenizer.ids(text or ""):
                    held += ids
                    while len(held) > 4 * group:
                        for at in range(0, 4 * group, 4 * length):
                            part = held[at:at + 4 * length]
                            ready.append((seen, zlib.crc32(part), sequences, part if with_ids else b""))
                            sequences += 1
                            seen += length
                        held = held[4 * group:]
                held += END.to_bytes(4, "little")
                total = seen + len(held) // 4
                if ready:
                    yield out([(doc, start, length, crc, total, place + k, 0, *[part] * with_ids) for start, crc, k, part in ready])
                docs_.append(doc)
                data.append(held)
                totals.append(total)
                gone.append(seen)
                tokens += len(held) // 4
                if tokens >= group:
                    yield from flush()
        yield from flush()

    schema = f"doc_id {kind}, {SCHEMA}" + ", ids array<bigint>" * with_ids
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, schema)
